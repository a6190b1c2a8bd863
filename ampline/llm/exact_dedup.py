"""Exact deduplication against a persistent digest index (operator 8).

Two texts are equal when they are identical after each run of ASCII white space
has become one space. The index is a Parquet table of one row per distinct
digest, bucketed and sorted by digest; a new batch is first reduced to one row
per digest (so a hot text is one row), then sort-merge anti-joined with the
index, and what is new is appended.

Null text counts as empty; empty texts equal each other. Rows with equal
doc_id and text are members of their group like any other. An empty table
gives no rows and leaves the index as it was. Extra columns are ignored.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, materialise, read_table, shared_dir


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def digest(text: Column) -> Column:
    """SHA-256 of the normalised text, as 32 bytes."""
    return F.unhex(F.sha2(normalised(text).cast("binary"), 256))


class DigestIndex:
    """Digests seen so far: (digest binary, keep_id bigint), one row each, bucketed and sorted by digest."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 32):
        self.spark, self.path, self.buckets = spark, path, buckets
        self.table = f"digest_index_{uuid.uuid5(uuid.NAMESPACE_URL, path).hex}"
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.table} (digest BINARY, keep_id BIGINT) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{path}'"
        )

    def read(self) -> DataFrame:
        return self.spark.table(self.table)

    def unseen(self, groups: DataFrame) -> DataFrame:
        """Rows of groups (one per digest) whose digest the index lacks: a sort-merge anti-join."""
        return groups.join(self.read().hint("merge"), "digest", "left_anti")

    def append(self, groups: DataFrame) -> None:
        """Adds digests; each bucket's rows come from one task, sorted."""
        (
            groups.select("digest", "keep_id").repartition(self.buckets, "digest").write.bucketBy(self.buckets, "digest")
            .sortBy("digest").mode("append").format("parquet").option("path", self.path).saveAsTable(self.table)
        )
        self.spark.catalog.refreshTable(self.table)


def deduplicate(docs: DataFrame, index: DigestIndex) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    A digest that the index already holds keeps the id it has there, so none of
    the new documents with it stays; group_size counts the new documents.
    """
    digests = materialise(docs.select("doc_id", digest(F.col("text")).alias("digest")), "digests")
    groups = materialise(digests.groupBy("digest").agg(F.min("doc_id").alias("new_id"), F.count(F.lit(1)).alias("group_size")), "groups")
    unseen = groups.withColumn("keep_id", F.col("new_id"))
    index.append(materialise(index.unseen(unseen), "unseen"))
    known = groups.join(index.read().hint("merge"), "digest").select("digest", "keep_id", "group_size")
    # Both sides are exchanged by digest, so the adaptive planner can split the partition of a hot text.
    out = digests.join(materialise(known, "known").hint("merge"), "digest")
    return out.select(
        "doc_id", "keep_id", "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = DigestIndex(spark, f"{shared_dir(spark)}/digest-index-{uuid.uuid4().hex}")
    return deduplicate(read_table(spark, sf_dir, "documents"), index)


OP8_SQL = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h FROM documents),
g AS (SELECT h, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY h)
SELECT d.doc_id, g.keep_id, CAST(g.group_size AS BIGINT) AS group_size, d.doc_id = g.keep_id AS kept, d.h AS text_sha256
FROM d JOIN g ON d.h = g.h
"""
