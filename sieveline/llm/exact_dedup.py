"""Exact dedup against a persistent digest index.

The index is a Parquet table bucketed and sorted by digest.  New rows are
digested, the digests that the index lacks are found by a sort-merge anti-join
that needs no shuffle of the index, and the survivors are appended.  Only
(digest, id) pairs are shuffled, never texts, and a group of copies is reduced
map-side to one row, so no group lands in one task.

Defined edge cases: a null text equals the empty text; a null id is allowed and
sorts after all others; a text that the index has keeps the index's id, be the
new one smaller or not; of rows that repeat both text and id each is marked
kept; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import at_end, delete, partitions, settle, shared_dir, table

ASCII_SPACE = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), ASCII_SPACE, " ")


def digest(text: Column) -> Column:
    return F.sha2(F.encode(normalised(text), "UTF-8"), 256)


class DigestIndex:
    """A digest table under ``path``: (digest, id), bucketed and sorted by digest.

    The number of buckets is written beside the files, at ``path``-buckets.  An
    index that is opened again takes it from there and refuses another one."""

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None):
        self.spark = spark
        self.path = path or f"{shared_dir(spark)}/digests-{uuid.uuid4().hex}"
        had = self._written(spark) if path else None
        if had and buckets and had != buckets:
            raise ValueError(f"the index at {path} has {had} buckets, not {buckets}")
        self.buckets = had or buckets or partitions(spark)
        if not had:
            spark.range(self.buckets, self.buckets + 1, numPartitions=1).write.parquet(f"{self.path}-buckets")
        self.name = f"digest_index_{uuid.uuid4().hex}"
        spark.sql(
            f"CREATE TABLE {self.name} (digest STRING, id BIGINT) USING parquet OPTIONS (path '{self.path}') "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS"
        )

    def _written(self, spark: SparkSession) -> int | None:
        """The number of buckets of an index that is there already."""
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}-buckets")
        if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            return None
        return spark.read.schema("id long").parquet(f"{self.path}-buckets").first()["id"]

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def append(self, digests: DataFrame) -> None:
        """Add the (digest, id) rows whose digest is new; the smallest id of each."""
        fresh = digests.groupBy("digest").agg(F.min("id").alias("id"))
        new = fresh.join(self.read().hint("merge"), "digest", "left_anti")
        # one task a bucket, so that each bucket gets one sorted file
        rows = new.repartition(self.buckets, "digest")
        rows.write.mode("append").format("parquet").option("path", self.path).bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(self.name)

    def drop(self) -> None:
        """Delete the index, files and all."""
        self.deregister()
        for folder in (self.path, f"{self.path}-buckets"):
            delete(self.spark, folder)

    def deregister(self) -> None:
        """Forget the table in this session's catalog; its files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def _passing_index(spark: SparkSession) -> DigestIndex:
    index = DigestIndex(spark)
    at_end(index.drop)
    return index


def digests_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), digest(F.col(text_col)).alias("digest"))


def assign(docs: DataFrame, index: DigestIndex | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Append ``docs`` to the index (a new one if none is given) and say of each
    row which id stays for its text: id, digest, keep_id, group_size (rows of
    this batch), kept."""
    spark = docs.sparkSession
    batch = settle(digests_of(docs, id_col, text_col), "digests")
    index = index or _passing_index(spark)
    index.append(batch)
    sizes = batch.groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"))
    # settled, so that the join below starts from two shuffles, of which adaptive execution splits a hot group's
    groups = settle(sizes.join(index.read().select("digest", F.col("id").alias("keep_id")).hint("merge"), "digest"), "groups")
    return batch.join(groups.hint("merge"), "digest").select("id", "digest", "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"))


def distinct_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, all columns; one row of each text."""
    spark = docs.sparkSession
    batch = settle(digests_of(docs, id_col, text_col), "digests")
    index = _passing_index(spark)
    index.append(batch)
    keep = index.read().select(F.col("id").alias("__keep"))
    # ids that stay are unique unless the input repeats an id or has null ids
    kept = docs.join(keep.hint("merge"), docs[id_col].cast("long").eqNullSafe(F.col("__keep")), "left_semi")
    repeats = settle(batch.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id"), "repeats")
    if repeats.isEmpty():
        return kept
    return _one_of_each(docs, index, id_col, text_col)


def _one_of_each(docs: DataFrame, index: DigestIndex, id_col: str, text_col: str) -> DataFrame:
    """The same where ids repeat: the digest decides with the id, then one row of equal ones."""
    marked = docs.select("*", digest(F.col(text_col)).alias("__digest"))
    kept = marked.join(index.read().select(F.col("digest").alias("__d"), F.col("id").alias("__keep")).hint("merge"), (F.col("__digest") == F.col("__d")) & docs[id_col].cast("long").eqNullSafe(F.col("__keep")), "left_semi")
    return kept.dropDuplicates(["__digest"]).drop("__digest")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""
