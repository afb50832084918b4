"""Exact duplicates by progressive refinement.

Three passes, each over what the one before has left: rows whose byte length occurs
twice or more; of these, rows whose (length, hash of the first bytes) occurs twice or
more; of these, rows whose whole text has the same SHA-256.  The keys left after a pass
go to the next as a key filter of fixed size, so no text is ever shuffled and a wrong
positive only costs one hash.  The row that stays comes back to its group by a join on the
hash, for large groups by a broadcast of their few rows.

Nulls count as empty texts; empty texts are equal to each other.  Of equal texts the row
with the largest id stays; repeated rows with that id all count as kept.  A null id is
below all others.  An empty table gives an empty result; other columns don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_hot, key_filter, maybe_in, prepare, store, table


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix: int = 64, carry: dict[str, Column] | None = None) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, and the ``carry`` columns,
    which may read ``_id`` and ``_text`` (the text, null as empty)."""
    base = docs.select(F.col(id_col).alias("_id"), F.coalesce(text_col, F.lit("")).alias("_text"))
    length, head = F.octet_length("_text"), F.xxhash64(F.octet_length("_text"), F.substring("_text", 1, prefix))

    lengths = base.groupBy(length.alias("k")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    by_length = maybe_in(base, F.xxhash64(length), key_filter(lengths, F.xxhash64("k")), "_long")
    heads = by_length.filter("_long").groupBy(head.alias("k")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    by_head = maybe_in(base, head, store_filter(key_filter(heads, F.col("k"))), "_open")

    carry = carry or {}
    read = store(
        by_head.select("_id", *[c.alias(n) for n, c in carry.items()], F.when(F.col("_open"), F.unhex(F.sha2("_text", 256))).alias("_full")),
        "exact",
    )
    groups = read.filter("_full is not null").groupBy("_full").agg(F.max("_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    met = join_hot(read.filter("_full is not null"), groups, "_full", "group_size", read.count())
    alone = read.filter("_full is null").withColumn("keep_id", F.col("_id")).withColumn("group_size", F.lit(1).cast("long"))
    return met.unionByName(alone).select(
        F.col("_id").alias(id_col), "keep_id", "group_size", F.col("_id").eqNullSafe(F.col("keep_id")).alias("kept"), *carry
    )


def store_filter(keys: DataFrame) -> DataFrame:
    return store(keys, "filter")


def op5_exact_dedup(spark, sf_dir: str) -> DataFrame:
    prepare(spark)
    return exact_dedup(table(spark, sf_dir, "documents"), carry={"text_sha256": F.sha2("_text", 256)})


OP5_SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW g AS (PARTITION BY coalesce(text, ''))
"""
