"""The corpus pipeline: five stages over documents, each reading what the one before wrote.

Every stage but the last returns the columns of documents. A column of another name passes through all of
them. Null and empty texts pass every filter but are never removed by one; the docstrings of the operators
define the rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import decontaminate, forest, lines, pieces, toxicity
from corpusloom.llm._spark import table, written

#: No SQL expresses the toxicity scores or the tokenizer.
ORACLE_SQL = None


def _text_kept(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The given columns, with ``n_chars`` following the text where there is one."""
    if "n_chars" in columns:
        docs = docs.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.char_length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return docs.select(*columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine, fitted on the labels, doesn't find toxic."""
    machine = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, machine)
    return scored.where(F.coalesce(F.length("text"), F.lit(0)).eqNullSafe(0) | (F.col("_toxicity.predicted") == 0)).select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later occurrences of three-line windows; documents of nothing else go."""
    cut = lines.dedup_lines(docs)
    return _text_kept(cut.where((F.col("_lines.n_removed") == 0) | (F.trim("text") != "")), docs.columns)


def _rows_of(docs: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """``docs`` with (``left_semi``) or without (``left_anti``) a row in ``keys`` (doc, tkey), whatever their columns are called."""
    keys = keys.select("doc", "tkey").distinct().alias("wanted")
    same: Column = F.col("own.doc_id").eqNullSafe(F.col("wanted.doc")) & (F.xxhash64("own.text") == F.col("wanted.tkey"))
    return docs.alias("own").join(keys, same, how)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, of the least id, of each group of near duplicates; empty texts are in no group.

    Where rows share their group's least id (or its rows have none), the one of the least text hash stays.
    """
    found = written(forest.near_duplicates(docs).where("n_shingles > 0"), "groups")
    stays = F.col("doc").eqNullSafe(F.col("component"))
    gone = found.where(~stays)
    rest = _rows_of(docs, gone, "left_anti")
    again = written(found.where(stays).groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("tkey", "doc")).alias("one")).where("n > 1"), "again")
    if again.isEmpty():
        return rest
    held = found.where(stays).join(again.select("group"), "group")
    chosen = _rows_of(docs, again.select("one.*"), "left_semi").select(F.xxhash64("text").alias("key"), F.struct("*").alias("row"))
    chosen = chosen.groupBy("row.doc_id", "key").agg(F.first("row").alias("row")).select("row.*")
    return _rows_of(rest, held, "left_anti").unionByName(chosen)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item aligns; items too short to align tell nothing and remove none."""
    leaks = decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark")).where(F.col("item_words") >= decontaminate.LEAST_WORDS)
    leaks = written(leaks.select("doc", "tkey"), "leaks")
    return _rows_of(docs, leaks, "left_anti")


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every remaining text, and the text decoded from them."""
    return pieces.encode(docs, pieces.default_model(), keep=[c for c in docs.columns if c != "text"])


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("encoding", encode_pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and reread by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
