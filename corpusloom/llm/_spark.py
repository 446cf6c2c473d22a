"""Session helpers of the training-data operators: shared-folder tables and batch sizes."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import spread

#: Rows of an Arrow batch: texts may be long, so batches are small.
BATCH_ROWS = 1000
#: A key is hot if more than one row of so many has it; there are fewer hot keys than this.
HOT = 20_000


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as ``spark.checkpoint.dir`` names it.

    Where the setting is absent on a single machine (as in tests) a temporary folder is set; a cluster must name one.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="corpusloom-")
        spark.sparkContext.setCheckpointDir(named)
        named = spark.sparkContext.getCheckpointDir() or named
    path = spark._jvm.org.apache.hadoop.fs.Path(named)
    whole = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    #: Arrow's file systems want an authority, be it empty.
    return re.sub("^file:/+", "file:///", whole).rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: lineage is cut and lost executors cost nothing."""
    path = new_path(df.sparkSession, name)
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    back = df.sparkSession.read.parquet(path)
    back._corpusloom_path = path
    return back


def discard(df: DataFrame) -> None:
    """Delete the files of a table from ``written`` that no later plan reads."""
    path = getattr(df, "_corpusloom_path", None)
    if path:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(conf).delete(target, True)


def small_batches(spark: SparkSession) -> None:
    """Bound the memory of an Arrow batch of long texts (a session setting; rows are not affected)."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a folder; one of fewer splits than cores is spread over all of them."""
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def spread_join(rows: DataFrame, side: DataFrame, keys: list[str], copies: str, spread: list[str], total: int, how: str = "inner", once: bool = False) -> DataFrame:
    """``rows`` joined to ``side``, which has each key once, with how many of the ``total`` rows have it.

    Hot keys of ``side``, fewer than ``HOT`` by definition, are broadcast, and their rows are then shuffled
    by a hash of the ``spread`` columns, away from the other keys, so that no task gets more of one key than
    the share that makes it hot. Gives the columns of ``rows`` and those of ``side`` but its keys.
    ``once`` drops rows that repeat, where the join has put them: equal ones are in one task, so no further shuffle.
    """
    rest = [c for c in side.columns if c not in keys]
    body = F.struct(*rest)
    hot = F.col(copies) * HOT > total
    heavy = side.where(hot).select(*[F.col(k).alias(f"_h_{k}") for k in keys], body.alias("_heavy"))
    #: The optimizer carries a constant into the join's condition, after which rows are shuffled by ``keys`` alone; not so a remainder.
    none = F.pmod(F.xxhash64(*keys), F.lit(1).cast("long")) if once else F.lit(0).cast("long")
    light = side.where(~hot).select(*[F.col(k).alias(f"_l_{k}") for k in keys], body.alias("_light"), none.alias("_l_away"))
    match = lambda p: [F.col(k) == F.col(f"_{p}_{k}") for k in keys]
    out = rows.join(F.broadcast(heavy), match("h"), "left")
    out = out.withColumn("_away", F.when(F.col("_heavy").isNull(), F.lit(0).cast("long")).otherwise(F.pmod(F.xxhash64(*spread), F.lit(2**30)) + 1))
    out = out.join(light, [*match("l"), F.col("_away") == F.col("_l_away")], "left")
    found = F.coalesce("_heavy", "_light")
    if how == "inner":
        out = out.where(found.isNotNull())
    columns = [*rows.columns, *[found.getField(c).alias(c) for c in rest]]
    return out.select("_away", *columns).distinct().drop("_away") if once else out.select(*columns)
