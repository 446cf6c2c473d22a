"""Unicode form, case, script and white-space cleaning."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ._parts import in_parts
from ._regex import columns, translate

FORMS = ("NFC", "NFD", "NFKC", "NFKD")


def normalize(expr: Column | str, *, form: str | None = None, lowercase: bool = False, only_script: bool = False, remove_newlines: bool = False, contract_whitespace: bool = False) -> Column:
    """The chosen steps, always in this order; null for null.

    Only ``form`` leaves the JVM. ``only_script`` turns runs that are neither word characters nor white space
    into a space, ``remove_newlines`` each newline, and ``contract_whitespace`` runs of white space other than newlines.
    """
    text = columns(expr)
    if form:
        if form not in FORMS:
            raise ValueError(f"form must be one of {', '.join(FORMS)}, not {form}")

        def shaped(column: pa.Array) -> pa.Array:
            return pa.array([None if t is None else unicodedata.normalize(form, t) for t in column.to_pylist()], pa.string())

        text = F.arrow_udf(in_parts(shaped), "string")(text)
    if lowercase:
        text = F.lower(text)
    if only_script:
        text = F.regexp_replace(text, translate(r"[\W&&\S]+").java, " ")
    if remove_newlines:
        text = F.regexp_replace(text, "\n", " ")
    if contract_whitespace:
        text = F.regexp_replace(text, translate(r"[\s--\n]+").java, " ")
    return text
