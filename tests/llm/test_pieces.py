import hashlib
import random

import pytest

sp = pytest.importorskip("sentencepiece")
from corpusloom.llm import pieces as P  # noqa: E402

PATH = P.default_model()
HARD = ["", " ", "  a", "a  b\n\tc ", "héé ｆｕｌｌ ﬁ é", "　x", "a\x00b", "▁a", "</s> <s> <0x41>", "\U0001F600", "▁▁▁" * 50, " " * 333, "a" * 5000, "=" * 777 + "-" * 99, "日本語" * 200, "\n\n\n x\n", "ab" * 3000, "the" * 400, "कि" * 50, "\r\n", "é" * 20]


def library():
    return sp.SentencePieceProcessor(model_file=PATH)


def test_matches_library_on_hard_texts():
    lib, coder = library(), P.encoder(PATH)
    for t, ids in zip(HARD, coder.encode(HARD)):
        assert ids.tolist() == lib.encode(t, add_eos=True), t[:40]
        assert coder.model.decode(ids.tolist()) == lib.decode(ids.tolist())


def test_matches_library_on_random_texts():
    rnd, lib, coder = random.Random(3), library(), P.encoder(PATH)
    signs = "abcdefghi  the ing \n\t.,;-=_▁éüñ日本€😀́\x07 0123<>/"
    texts = ["".join(rnd.choice(signs) for _ in range(rnd.randint(0, 300))) for _ in range(1500)]
    for t, ids in zip(texts, coder.encode(texts)):
        assert ids.tolist() == lib.encode(t, add_eos=True), t


def test_decodes_any_ids_as_library():
    rnd, lib, model = random.Random(5), library(), P.encoder(PATH).model
    for _ in range(800):
        ids = [rnd.choice([rnd.randrange(1, 32000), rnd.randrange(3, 259), 1, 2, 28705]) for _ in range(rnd.randint(0, 12))]
        assert model.decode(ids) == lib.decode(ids), ids


def test_digests_of_null_empty_repeated_and_extra_columns(spark):
    rows = [(1, None, 5), (2, "", 5), (3, "a b", 5), (3, "a b", 5), (None, "x " * 30000, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = P.digests(df, PATH).collect()
    lib = library()
    want = sorted((str(i), len(x := lib.encode(t or "", add_eos=True)), hashlib.sha256(" ".join(map(str, x)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for i, t, _ in rows)
    assert sorted((str(r[0]), *r[1:]) for r in got) == want
    assert P.digests(df.limit(0), PATH).count() == 0
    whole = P.encode(df, PATH, keep=("doc_id", "n_tokens")).where("doc_id = 3").first()
    assert whole.decoded == "a b" and whole.ids[-1] == 2 and whole.n_tokens == 5
    again = P.encode(df.selectExpr("doc_id", "text", "1 AS ids", "2 AS decoded"), PATH, keep=("doc_id", "ids", "decoded"))
    assert again.columns == ["doc_id", "ids", "decoded"] and again.where("doc_id = 3").first().decoded == "a b"
