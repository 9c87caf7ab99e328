"""Intermediate tables in the folder that all executors share, and global orders made from them."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import suppress

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a folder of our own where a local session names none (tests); elsewhere that is an error, as executors couldn't see it."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.quire.staging.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.quire.staging.dir", named)
    return named.rstrip("/")


class Staging:
    """Tables of one operator call, written as Parquet to the shared folder and read again.

    Writing cuts the lineage (a lost executor costs a reread, not a recomputation) and gives joins plain scans on both
    sides, which adaptive execution can split when a key is hot.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/quire-{name}-{uuid.uuid4().hex[:12]}"
        self._n = 0

    def path(self, name: str) -> str:
        self._n += 1
        return f"{self.root}/{self._n:03d}-{name}"

    def table(self, df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
        path = self.path(name)
        df.write.option("compression", codec).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._quire_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        """Delete a staged table that nothing reads any more."""
        path = getattr(df, "_quire_path", None)
        if path:
            with suppress(Exception):
                jpath = self.spark._jvm.org.apache.hadoop.fs.Path(path)
                jpath.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(jpath, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def globally_ordered(df: DataFrame, keys: list, stage: Staging) -> DataFrame:
    """``df`` dealt by ranges of ``keys`` and sorted, staged, with part (the range's number) and place (the row's, in it)."""
    dealt = df.repartitionByRange(partitions(df.sparkSession), *keys).sortWithinPartitions(*keys)
    at = F.monotonically_increasing_id()
    dealt = dealt.withColumn("q_at", at)
    out = dealt.withColumn("part", F.shiftright("q_at", 33)).withColumn("place", F.col("q_at").bitwiseAND((1 << 33) - 1)).drop("q_at")
    return stage.table(out, "ordered")


def ranked(df: DataFrame, keys: list, stage: Staging, name: str = "rank", value: Column | None = None) -> DataFrame:
    """``df`` with ``name``: the number of rows before this one in the order of ``keys`` (or the sum of ``value`` over them).

    No task sees more than one range: what comes before a range is summed over a table of ranges.
    """
    rows = globally_ordered(df if value is None else df.withColumn("q_value", value), keys, stage)
    each = F.count("*") if value is None else F.sum("q_value")
    parts = rows.groupBy("part").agg(each.alias("q_n"))
    before = F.sum("q_n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select("part", F.coalesce(before, F.lit(0)).alias("q_base"))
    if value is None:
        inside = F.col("place")
    else:
        inside = F.coalesce(F.sum("q_value").over(Window.partitionBy("part").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = rows.withColumn("q_inside", inside).join(F.broadcast(parts), "part")  # one row per range
    return out.withColumn(name, (F.col("q_base") + F.col("q_inside")).cast("bigint")).drop("part", "place", "q_base", "q_inside", "q_value")


def preceded(df: DataFrame, keys: list, columns: dict[str, str], stage: Staging) -> DataFrame:
    """``df`` with the values that ``columns`` (new name: column) have in the row before this one in the order of ``keys``.

    Rows are dealt by ranges, so a hot key is spread over several; the first row of a range takes the last one of the range before.
    """
    rows = globally_ordered(df, keys, stage)
    ends = rows.groupBy("part").agg(F.max_by(F.struct(*columns.values()), "place").alias("q_last"))
    before = F.lag("q_last").over(Window.orderBy("part"))
    ends = ends.select("part", before.alias("q_last"))
    inside = Window.partitionBy("part").orderBy("place")
    out = rows.withColumn("q_lag", F.lag(F.struct(*columns.values())).over(inside)).join(F.broadcast(ends), "part")  # one row per range
    out = out.withColumn("q_lag", F.when(F.col("place") == 0, F.col("q_last")).otherwise(F.col("q_lag")))
    return out.withColumns({k: F.col("q_lag")[c] for k, c in columns.items()}).drop("part", "place", "q_lag", "q_last")
