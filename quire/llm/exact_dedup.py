"""Exact dedup against a persistent digest index.

The index is a table bucketed and sorted by digest, one row per distinct text: digest, keep_id, group_size, keep_rows, batch. A new
batch is first reduced to one row per digest (partial aggregation, so a text that a third of all rows repeat costs one
row per task), then anti-joined with the index bucket by bucket (sort-merge, the index side is not shuffled), and what
is new is appended, with the batch's name. A row is kept if it is the keeper of a digest that this very batch brought: the same batch
given once more (a retry, say) finds all its digests, appends nothing and keeps nothing.

Defined results: a null text counts as the empty text and all empty texts are one group; a null doc_id loses against any
other and is kept only where every row of the group has a null doc_id; of wholly repeated rows (same doc_id, same text)
exactly one is kept; an empty table gives an empty result; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm.common import Staging, checked_broadcast, partitions, text_or_empty

INDEX_SCHEMA = "digest binary, keep_id bigint, group_size bigint, keep_rows bigint, batch string"


class DigestIndex:
    """A digest index kept as a bucketed, sorted table of the session's catalog."""

    def __init__(self, spark: SparkSession, name: str, buckets: int | None = None):
        self.spark, self.name, self.buckets = spark, name, buckets or partitions(spark)

    def _write(self, df: DataFrame, mode: str) -> None:
        # One writing task per bucket: a bucket gets one sorted file for each batch.
        writer = df.repartition(self.buckets, "digest").write.format("parquet").mode(mode)
        writer.bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(self.name)

    def read(self) -> DataFrame:
        if not self.spark.catalog.tableExists(self.name):
            self._write(self.spark.createDataFrame([], INDEX_SCHEMA), "ignore")
        return self.spark.table(self.name)

    def append_new(self, groups: DataFrame, batch: str) -> None:
        """Append the digests of ``groups`` that the index doesn't hold yet."""
        known = self.read().select("digest")
        new = groups.hint("merge").join(known.hint("merge"), "digest", "left_anti")
        self._write(new.select("digest", "keep_id", "group_size", "keep_rows", F.lit(batch).alias("batch")), "append")
        self.spark.catalog.refreshTable(self.name)

    def plain(self) -> DataFrame:
        """The index as a scan without bucket properties, for joins whose other side may have a hot key."""
        files = self.spark.table(self.name).inputFiles()
        if not files:
            return self.spark.createDataFrame([], INDEX_SCHEMA)
        return self.spark.read.schema(INDEX_SCHEMA).parquet(files[0].rpartition("/")[0])


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, digest): SHA-256 of the unchanged text in UTF-8."""
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.unhex(F.sha2(text_or_empty(text_col), 256)).alias("digest"))


def digest_groups(rows: DataFrame) -> DataFrame:
    """One row per digest: the largest doc_id, all rows, and the rows that have this largest doc_id."""
    by_id = rows.groupBy("digest", "doc_id").agg(F.count("*").alias("n"))
    last = F.max(F.struct(F.col("doc_id"), F.col("n")))
    return by_id.groupBy("digest").agg(last.alias("last"), F.sum("n").alias("group_size")).select("digest", F.col("last.doc_id").alias("keep_id"), "group_size", F.col("last.n").alias("keep_rows"))


def exact_dedup(docs: DataFrame, index: DigestIndex | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    With an index that already holds a digest, keep_id and group_size are those of the batch that brought it first.
    """
    spark = docs.sparkSession
    stage = Staging(spark, "exact")
    rows = stage.table(digests(docs), "digests")  # the only pass over the texts
    index = index or DigestIndex(spark, f"digest_index_{uuid.uuid4().hex[:12]}")
    batch = uuid.uuid4().hex
    index.append_new(digest_groups(rows), batch)
    joined = rows.join(index.plain().hint("merge"), "digest")
    is_last = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("batch") == batch)
    out = [F.col("doc_id"), F.col("keep_id"), F.col("group_size"), F.col("kept"), F.lower(F.hex("digest")).alias("text_sha256")]
    plain = joined.withColumn("kept", is_last & (F.col("keep_rows") == 1)).where(~(is_last & (F.col("keep_rows") > 1)))
    # Wholly repeated rows: only those rows are numbered.
    repeated = joined.where(is_last & (F.col("keep_rows") > 1))
    one = F.row_number().over(Window.partitionBy("digest").orderBy("doc_id")) == 1
    if rows.join(index.plain().where("keep_rows > 1"), "digest", "left_semi").isEmpty():
        return plain.select(*out)
    return plain.select(*out).unionByName(repeated.withColumn("kept", one).select(*out))


def drop_exact_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with all its columns, one row of each group of equal texts.

    The rows to drop are (doc_id, digest) pairs; the texts themselves are not shuffled while these are few enough to
    broadcast. Of wholly repeated rows one stays.
    """
    spark = docs.sparkSession
    decided = exact_dedup(docs)
    stage = Staging(spark, "exact-drop")
    gone = stage.table(decided.where(~F.col("kept")).groupBy("doc_id", "text_sha256").agg(F.max(F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("q_same")), "gone")
    digest = F.sha2(text_or_empty(), 256)
    others = gone.where(~F.col("q_same")).select(F.col("doc_id").alias("q_id"), F.col("text_sha256").alias("q_sha"))
    kept = docs.withColumn("q_digest", digest).join(checked_broadcast(others), F.col("doc_id").eqNullSafe(F.col("q_id")) & (F.col("q_digest") == F.col("q_sha")), "left_anti")
    same = gone.where("q_same").select(F.col("doc_id").alias("q_id"), F.col("text_sha256").alias("q_sha"))
    if same.isEmpty():
        return kept.drop("q_digest")
    tied = F.col("doc_id").eqNullSafe(F.col("q_id")) & (F.col("q_digest") == F.col("q_sha"))
    single = kept.join(checked_broadcast(same), tied, "left_anti")
    first = F.row_number().over(Window.partitionBy("q_digest", "doc_id").orderBy("doc_id"))
    several = kept.join(checked_broadcast(same), tied, "left_semi").withColumn("q_rank", first).where("q_rank = 1")
    return single.drop("q_digest").unionByName(several.drop("q_rank", "q_digest"))
