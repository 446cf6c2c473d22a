"""One query per function over the documents table."""

from __future__ import annotations

import os
import struct
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import functions as fn
from ..functions.fasttext import EOS, MAGIC, SOFTMAX
from ..namespace import register_namespace, register_sql
from ..operators import bucket_columns, columns_ending, maxima_at, spread, unnest, with_signals
from ..sources import from_rows, read_table, ship_file
from ..streaming import stream_signals

SCRUB = [r"[A-Za-z0-9._-]+@[A-Za-z0-9-]+\.[A-Za-z]+", r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", r"[0-9]+"]
#: A fixed vocabulary for the tokenizer query.
VOCAB = ["the", "of", "and", "to", "in", "is", "that", "for", "it", "as", "was", "with", "be", "by", "on", "not", "he", "die", "der", "und", "de", "la", "que", "el", "en", "y", "le", "les", "et", "des", ".", ",", "The", "a", "licensed", "under"]
#: Words, label weights and the end mark of the classifier query; counts decide, and ties can't occur.
WEIGHTS = {"the": (3, 0), "of": (2, 0), "and": (2, 0), "der": (0, 3), "die": (0, 3), "und": (0, 2), EOS: (1, 0)}


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(read_table(spark, sf_dir, "documents", ["doc_id", "text"]))


def _simple(name: str, build):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return documents(spark, sf_dir).select("doc_id", build().alias(name))

    return query


def _repetition(**settings):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return unnest(documents(spark, sf_dir).select("doc_id", fn.repetition_signals("text", **settings).alias("repetition")), "repetition")

    return query


def minhash_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    signed = documents(spark, sf_dir).select("doc_id", fn.minhash("text", hash_family="md5", buckets=4, bsize=2).alias("minhash"))
    return bucket_columns(signed, "minhash", 4).drop("minhash")


def minhash_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What holds of every signature whatever its permutations: its form, the constant of short texts, and that texts of equal shingle sets share it."""
    signed = documents(spark, sf_dir).select("doc_id", fn.minhash("text").alias("m"), fn.minhash("text", bsize=1).alias("raw"))
    digits = lambda c, n: F.coalesce(F.col(c).rlike(f"^[0-9a-f]{{{n}}}$"), F.col(c).isNull())
    formed = signed.select("doc_id", "m", (digits("m", 448) & digits("raw", 224)).alias("is_hex"), (F.col("raw") == "f" * 224).alias("is_constant"))
    #: A window, as a join of the table with its groups would sign every text once more for each side.
    return formed.select("doc_id", "is_hex", "is_constant", F.min("doc_id").over(Window.partitionBy("m")).alias("first_alike"))


def stored_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Level 0 stores the bytes in blocks, so sizes and ratios are known exactly."""
    return documents(spark, sf_dir).select("doc_id", fn.compressed_size("text", level=0).alias("size"), F.round(fn.compression_ratio("text", level=0), 4).alias("ratio"))


def deflated_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Default level: no longer than stored, not beyond deflate's best, and the ratio is bytes by size.

    Of an empty text the size is 0 and the ratio no number; a null one must have neither.
    """
    n, size, ratio = F.col("n"), F.col("size"), F.col("ratio")
    sized = documents(spark, sf_dir).select("doc_id", F.octet_length("text").alias("n"), fn.compressed_size("text").alias("size"), fn.compression_ratio("text").alias("ratio"))
    whole = n / F.nullif(size, F.lit(0).cast("long"))
    fits = F.when(n == 0, (size == 0) & F.isnan(ratio)).otherwise(F.abs(ratio - whole) <= 1e-5 * whole)
    bounds = {"not_above": size <= n + 8, "not_below": size * 1032 >= n - 1032, "ratio_fits": fits}
    return sized.select("doc_id", *[F.when(n.isNull(), size.isNull() & ratio.isNull()).otherwise(F.coalesce(holds, F.lit(False))).alias(name) for name, holds in bounds.items()])


def namespace_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Method-style access."""
    register_namespace()
    text = F.col("text").textproc
    return documents(spark, sf_dir).select("doc_id", F.size(text.tokens()).cast("long").alias("n_tokens"), text.scrub(patterns=SCRUB).alias("text"), text.repetition_signals(num_top=1, num_dup=1).getField("top_1_gram_char_ratio").alias("top_1_gram_char_ratio"))


def sql_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All functions by their SQL names, with the tokenizer and the model of the other queries."""
    register_sql(spark, "textproc_")
    model = _shipped(spark, "words.bin", lambda path: write_model(path, WEIGHTS, LABELS))
    own = _shipped(spark, "words.json", lambda path: word_level().save(path))
    patterns = ", ".join("r'" + p + "'" for p in SCRUB)
    documents(spark, sf_dir).createOrReplaceTempView("corpusloom_documents")
    return spark.sql(
        f"""SELECT doc_id, cardinality(textproc_text_tokens(text)) AS n_tokens, textproc_scrub(text, array({patterns})) AS text,
        textproc_normalize(text, 'NFC', true, true, true, true) AS normalized, concat_ws(' ', CAST(textproc_tokenize(text, '{own}') AS ARRAY<STRING>)) AS ids,
        textproc_fasttext(text, '{model}', array({", ".join(f"'{x}'" for x in LABELS)})).top_label AS top_label, textproc_repetition_signals(text).top_1_gram_char_ratio AS top_1_gram_char_ratio,
        length(textproc_minhash(text)) AS n_digits, textproc_compressed_size(text) > 0 AND textproc_compression_ratio(text) > 0 AS has_size,
        textproc_samplebyte() BETWEEN 1 AND 64 AND length(textproc_uuid4()) = 32 AS drawn FROM corpusloom_documents"""
    )


def streamed_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as a stream of files, and what its sink holds when all have been read."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() or "file://" + tempfile.mkdtemp(prefix="corpusloom-")
    folder = f"{shared.rstrip('/')}/stream-{uuid.uuid4().hex}"
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(f"{sf_dir}/documents.parquet").schema)
    signals = {"n_tokens": F.size(fn.tokens("text")).cast("long"), "scrubbed": fn.scrub("text", patterns=SCRUB)}
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/documents.parquet")
    #: A stream reads folders; a table of one file is that file of its folder.
    one = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isFile()
    source, names = (sf_dir, "documents.parquet") if one else (f"{sf_dir}/documents.parquet", None)
    stream_signals(spark, source, schema, f"{folder}/sink", f"{folder}/checkpoint", signals, names=names).awaitTermination()
    return spark.read.schema(f"{schema}, n_tokens long, scrubbed string").parquet(f"{folder}/sink").select("doc_id", "n_tokens", F.col("scrubbed").alias("text"))


def many_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several signals in one pass."""
    signals = {"n_tokens": F.size(fn.tokens("text")).cast("long"), "scrubbed": fn.scrub("text", patterns=SCRUB), "normalized": fn.normalize("text", only_script=True, contract_whitespace=True)}
    return with_signals(documents(spark, sf_dir), **signals).drop("text")


def repeated_text_leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts in memory: every repetition signal is greatest where one sentence stands ten times."""
    sentence = "A small boat left the harbour before the rain began. "
    texts = ["The gardener planted rows of beans beside the old stone wall.", "Vinden drog in från havet och lyfte löven över taken.", None, sentence, sentence * 10]
    rows = from_rows(spark, {"num": range(len(texts)), "text": texts}, "num long, text string")
    wide = unnest(rows.select("num", fn.repetition_signals("text").alias("repetition")), "repetition")
    names = columns_ending(wide, "gram_char_ratio")
    return spark.createDataFrame([(len(names), maxima_at(wide, names, F.col("num") == 4))], "n_signals long, repeated_leads boolean")


def random_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = documents(spark, sf_dir).select("doc_id", fn.samplebyte("text").alias("b"), fn.uuid4("text").alias("u"))
    return drawn.select("doc_id", F.col("b").between(1, 64).alias("byte_in_range"), F.col("u").rlike("^[0-9a-f]{12}4[0-9a-f]{3}[89ab][0-9a-f]{15}$").alias("uuid_valid"))


def word_level(vocab: list[str] = VOCAB):
    """A tokenizer of whole words and signs; id 0 is for all others."""
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    own = Tokenizer(models.WordLevel({"[UNK]": 0} | {w: i + 1 for i, w in enumerate(vocab)}, unk_token="[UNK]"))
    own.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(r"[A-Za-z]+|[^A-Za-z\s]"), "isolated"), pre_tokenizers.Split(Regex(r"\s+"), "removed")])
    return own


def write_model(path: str, weights: dict[str, tuple[float, ...]], labels: list[str]) -> None:
    """A softmax model of the published binary format whose label scores are mean word weights."""
    dim = len(labels)
    out = [struct.pack("<ii", MAGIC, 12), struct.pack("<12i", dim, 5, 1, 1, 5, 1, SOFTMAX, 3, 0, 0, 0, 100), struct.pack("<d", 1e-4)]
    out.append(struct.pack("<iiiqq", len(weights) + dim, len(weights), dim, 1, -1))
    out += [w.encode() + b"\0" + struct.pack("<qb", 1, 0) for w in weights] + [x.encode() + b"\0" + struct.pack("<qb", 1, 1) for x in labels]
    out += [b"\0", struct.pack("<qq", len(weights), dim), *(struct.pack(f"<{dim}f", *v) for v in weights.values())]
    out += [b"\0", struct.pack("<qq", dim, dim), *(struct.pack(f"<{dim}f", *(float(i == j) for j in range(dim))) for i in range(dim))]
    with open(path, "wb") as f:
        f.write(b"".join(out))


LABELS = ["__label__en", "__label__de"]


def _shipped(spark: SparkSession, name: str, write) -> str:
    """A small file made at the driver and sent to all executors."""
    path = os.path.join(tempfile.mkdtemp(prefix="corpusloom-model-"), f"{uuid.uuid4().hex}-{name}")
    write(path)
    return ship_file(spark, path)


def _classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = _shipped(spark, "words.bin", lambda path: write_model(path, WEIGHTS, LABELS))
    return documents(spark, sf_dir).select("doc_id", fn.fasttext("text", path=name, labels=LABELS, output_scores=True).alias("langid"))


def fasttext_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classified(spark, sf_dir).select("doc_id", "langid.top_label", F.col("langid.top_score").between(0.5, 1.0001).alias("top_leads"), F.col("langid.total_score").between(0.999, 1.001).alias("total_is_one"))


def fasttext_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = lambda name: F.round(F.col(f"langid.{name}").cast("double"), 3)
    return _classified(spark, sf_dir).select("doc_id", score("top_score").alias("top_score"), *[score(x).alias(x[9:]) for x in LABELS])


QUERIES = {
    "repetition_signals": _repetition(),
    "repetition_top_only": _repetition(num_top=3, num_dup=3),
    "repetition_dup_only": _repetition(num_top=0, num_dup=3),
    "minhash": _simple("minhash", lambda: fn.minhash("text")),
    "minhash_md5": _simple("minhash", lambda: fn.minhash("text", hash_family="md5")),
    "minhash_buckets": minhash_buckets,
    "minhash_shape": minhash_shape,
    "compressed_size": _simple("compressed_size", lambda: fn.compressed_size("text")),
    "compression_ratio": _simple("compression_ratio", lambda: fn.compression_ratio("text")),
    "stored_sizes": stored_sizes,
    "deflated_bounds": deflated_bounds,
    "random_columns": random_columns,
    "namespace_methods": namespace_methods,
    "sql_functions": sql_functions,
    "streamed_signals": streamed_signals,
    "many_signals": many_signals,
    "repeated_text_leads": repeated_text_leads,
    "scrub": _simple("text", lambda: fn.scrub("text", patterns=SCRUB)),
    "scrub_native": _simple("text", lambda: fn.scrub_native("text", patterns=SCRUB)),
    "fasttext": fasttext_labels,
    "fasttext_scores": fasttext_scores,
    "tokenize": _simple("ids", lambda: F.concat_ws(" ", fn.tokenize("text", tokenizer=word_level()).cast("array<string>"))),
    "tokens": _simple("tokens", lambda: F.concat_ws("|", fn.tokens("text"))),
    "normalize": _simple("text", lambda: fn.normalize("text", contract_whitespace=True, remove_newlines=True, only_script=True, lowercase=True, form="NFC")),
    "normalize_partial": _simple("text", lambda: fn.normalize("text", only_script=True, contract_whitespace=True)),
}
