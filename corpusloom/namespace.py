"""Method-style access: ``F.col("text").textproc.minhash()``, and SQL functions of the same names."""

from __future__ import annotations

import functools
import itertools
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from . import functions as fn
from .functions._parts import in_parts
from .functions._regex import compiled

METHODS = ("normalize", "compressed_size", "compression_ratio", "samplebyte", "uuid4", "minhash", "repetition_signals", "scrub", "fasttext", "tokenize", "tokens")


class TextMethods:
    """The text functions bound to one column."""

    def __init__(self, column: Column):
        self._column = column

    def __getattr__(self, name: str):
        if name not in METHODS:
            raise AttributeError(name)
        return functools.partial(getattr(fn, name), self._column)

    def __dir__(self):
        return METHODS


def register_namespace(name: str = "textproc") -> None:
    """Installs the methods on every column under ``name``."""
    from pyspark.sql.classic.column import Column as Classic

    for kind in {Column, Classic}:
        setattr(kind, name, property(TextMethods))


def register_sql(spark: SparkSession, prefix: str = "") -> list[str]:
    """SQL functions for all text functions; returns their names.

    Signals take a text and use the default settings. The others take their settings as arguments:
    ``normalize(text, form, lowercase, only_script, remove_newlines, contract_whitespace)`` (all but the first may be
    left out), ``scrub(text, patterns, replacement)`` (the last may be left out), ``fasttext(text, path, labels)`` and
    ``tokenize(text, path)``. ``tokens`` is called ``text_tokens``, as SQL has no word of its own for it. What has no
    need of Arrow functions becomes SQL expressions (temporary functions).
    """
    from .functions.compression import deflated
    from .functions.fasttext import folded, model
    from .functions.minhash import SEED, permutations, signature
    from .functions.repetition import field_names, token_signals
    from .functions.scrub import REPLACEMENT, scrubbed
    from .functions.tokenize import from_path, ids_of

    a, b, seed = permutations(SEED, 14 * 8)
    word = fn._default_words

    def repetition_udf(text: pa.Array) -> pa.Array:
        return pa.array([None if t is None else dict(zip(names, token_signals(word(t), 4, 10))) for t in text.to_pylist()], kind)

    def minhash_udf(text: pa.Array) -> pa.Array:
        return pa.array([None if t is None else signature(word(t), a, b, seed, 14, 8, 5, "xxh3") for t in text.to_pylist()], pa.string())

    def size_udf(text: pa.Array) -> pa.Array:
        return pa.array([None if t is None else deflated(t.encode(), 6) for t in text.to_pylist()], pa.int64())

    def ratio_udf(text: pa.Array) -> pa.Array:
        return pa.array([None if t is None else (len(t.encode()) / n if (n := deflated(t.encode(), 6)) else float("nan")) for t in text.to_pylist()], pa.float32())

    def normalize_udf(text: pa.Array, *settings: pa.Array) -> pa.Array:
        rows = zip(text.to_pylist(), *(s.to_pylist() for s in settings))
        return pa.array([None if t is None else _normalized(t, *own) for t, *own in rows], pa.string())

    def scrub_udf(text: pa.Array, *settings: pa.Array) -> pa.Array:
        rows = zip(text.to_pylist(), *(s.to_pylist() for s in settings))
        return pa.array([None if t is None else scrubbed(t, p or (), *(own or [REPLACEMENT])) for t, p, *own in rows], pa.string())

    def fasttext_udf(text: pa.Array, path: pa.Array, labels: pa.Array) -> pa.Array:
        out = []
        for t, p, ls in zip(text.to_pylist(), path.to_pylist(), labels.to_pylist()):
            out.append(None if t is None else dict(zip(("top_label", "top_score", "total_score"), folded(model(p).predict(re.sub(r"\s+", " ", t), True), ls))))
        return pa.array(out, top)

    def tokenize_udf(text: pa.Array, path: pa.Array) -> pa.Array:
        rows, out = list(zip(text.to_pylist(), path.to_pylist())), []
        for p, own in itertools.groupby(rows, lambda r: r[1]):
            out.append(ids_of(from_path(p), [t for t, _ in own]))
        return pa.concat_arrays(out) if out else pa.array([], pa.list_(pa.int64()))

    names = field_names(4, 10)
    kind = pa.struct([(n, pa.float32()) for n in names])
    top = pa.struct([("top_label", pa.string()), ("top_score", pa.float32()), ("total_score", pa.float32())])
    made = {
        "repetition_signals": F.arrow_udf(in_parts(repetition_udf), "struct<" + ",".join(f"{n}:float" for n in names) + ">"),
        "minhash": F.arrow_udf(in_parts(minhash_udf), "string"),
        "compressed_size": F.arrow_udf(in_parts(size_udf), "bigint"),
        "compression_ratio": F.arrow_udf(in_parts(ratio_udf), "float"),
        "fasttext": F.arrow_udf(in_parts(fasttext_udf), "struct<top_label:string,top_score:float,total_score:float>"),
        "tokenize": F.arrow_udf(in_parts(tokenize_udf), "array<bigint>"),
        "normalize": F.arrow_udf(in_parts(normalize_udf), "string"),
        "scrub": F.arrow_udf(in_parts(scrub_udf), "string"),
    }
    for n, f in made.items():
        spark.udf.register(prefix + n, f)

    def expression(name: str, arguments: str, returns: str, body: str) -> None:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}({arguments}) RETURNS {returns} RETURN {body}")

    expression("text_tokens", "t STRING", "ARRAY<STRING>", "regexp_extract_all(t, '(?U)\\\\w+', 0)")
    expression("uuid4", "", "STRING", "replace(uuid(), '-', '')")
    expression("samplebyte", "", "SMALLINT", "CAST(least(64, floor(-log2(1.0D - rand())) + 1) AS SMALLINT)")
    return [prefix + n for n in (*made, "text_tokens", "uuid4", "samplebyte")]


def _normalized(text: str, form: str | None = None, lowercase: bool = False, only_script: bool = False, remove_newlines: bool = False, contract_whitespace: bool = False) -> str:
    """The steps of ``normalize`` on one text."""
    if form is not None:
        text = unicodedata.normalize(form, text)
    if lowercase:
        text = text.lower()
    if only_script:
        text = compiled(r"[\W&&\S]+").sub(" ", text)
    if remove_newlines:
        text = text.replace("\n", " ")
    return compiled(r"[\s--\n]+").sub(" ", text) if contract_whitespace else text
