"""Fusion of scored views.  Input is long: hits(qid, chunk_hash, view, raw, rank).

Weighted fusion ranks and normalises inside (qid, view), takes the least normalised value
of a view as what a chunk missing from it gets, and sums over all views that have hits for
the query.  The sum is taken as floor of all views plus what each hit has above its
floor, so no grid of chunks and views is built.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .lexical import PLACES

RRF_K = 60


def weights_frame(spark, weights: dict[str, float]) -> DataFrame:
    return spark.createDataFrame(list(weights.items()), "view string, weight double")


def emit(fused: DataFrame) -> DataFrame:
    """Add the rank: score descending, then chunk."""
    window = Window.partitionBy("qid").orderBy(F.round("score", PLACES).desc(), "chunk_hash")
    return fused.withColumn("rank", F.row_number().over(window).cast("long"))


def view_scores(hits: DataFrame, views: list[str]) -> DataFrame:
    """One row per (qid, chunk_hash) with the raw score of each view, null where it has none: the full outer join of the views."""
    return hits.groupBy("qid", "chunk_hash").agg(*[F.max(F.when(F.col("view") == v, F.col("raw"))).alias(v) for v in views])


def rrf(hits: DataFrame, k: int = RRF_K, weights: DataFrame | None = None) -> DataFrame:
    """Reciprocal rank fusion: (qid, chunk_hash, score, rank).  A view of weight 0 adds chunks, not score."""
    rows = hits if weights is None else hits.join(F.broadcast(weights), "view", "left")
    weight = F.lit(1.0) if weights is None else F.coalesce("weight", F.lit(0.0))
    return emit(rows.groupBy("qid", "chunk_hash").agg(F.sum(weight / (k + F.col("rank"))).alias("score")))


def normalized(hits: DataFrame, norm: str = "minmax") -> DataFrame:
    """``hits`` with ``value``: minmax (1 where all are equal) or z-score by the population deviation (0 where it is 0)."""
    window = Window.partitionBy("qid", "view")
    if norm == "minmax":
        low, high = F.min("raw").over(window), F.max("raw").over(window)
        value = F.when(high > low, (F.col("raw") - low) / (high - low)).otherwise(1.0)
    elif norm == "zscore":
        sd = F.stddev_pop("raw").over(window)
        value = F.when(sd > 0, (F.col("raw") - F.avg("raw").over(window)) / sd).otherwise(0.0)
    else:
        raise ValueError(f"unknown norm {norm}")
    return hits.withColumn("value", value)


def weighted(hits: DataFrame, weights: DataFrame, norm: str = "minmax") -> DataFrame:
    """Weighted fusion: (qid, chunk_hash, score, rank).  ``weights`` are (view, weight), or (qid, view, weight)."""
    window = Window.partitionBy("qid", "view")
    keys = ["qid", "view"] if "qid" in weights.columns else ["view"]
    rows = normalized(hits, norm).withColumn("floor", F.min("value").over(window)).join(weights, keys, "left")
    rows = rows.withColumn("weight", F.coalesce("weight", F.lit(0.0)))
    floors = rows.select("qid", "view", "floor", "weight").distinct().groupBy("qid").agg(F.sum(F.col("weight") * F.col("floor")).alias("base"))
    above = rows.groupBy("qid", "chunk_hash").agg(F.sum(F.col("weight") * (F.col("value") - F.col("floor"))).alias("above"))
    return emit(above.join(floors, "qid").select("qid", "chunk_hash", (F.col("base") + F.col("above")).alias("score")))


def fuse(hits: DataFrame, method: str, weights: DataFrame | None = None, norm: str = "minmax", k: int = RRF_K, views: int | None = None) -> DataFrame:
    """``none`` or a single view: raw scores unchanged; ``rrf``; ``weighted`` or ``adaptive`` with weights."""
    if method == "none" or views == 1:
        return emit(hits.select("qid", "chunk_hash", F.col("raw").alias("score")))
    if method == "rrf":
        return rrf(hits, k)
    if method in ("weighted", "adaptive"):
        if weights is None:
            raise ValueError(f"{method} fusion needs weights")
        return weighted(hits, weights, norm)
    raise ValueError(f"unknown fusion {method}")


def combine_subqueries(hits: DataFrame, subs: DataFrame, depth: int, k: int = RRF_K) -> DataFrame:
    """Inside each view, the hits of sub-queries (qid, sub, view, chunk_hash, rank) combined by RRF with the
    sub-queries' weights (qid, sub, weight) and cut to ``depth``; the sum becomes the view's raw score."""
    summed = hits.join(subs, ["qid", "sub"]).groupBy("qid", "view", "chunk_hash").agg(F.sum(F.col("weight") / (k + F.col("rank"))).alias("raw"))
    window = Window.partitionBy("qid", "view").orderBy(F.round("raw", 12).desc(), "chunk_hash")
    return summed.withColumn("rank", F.row_number().over(window).cast("long")).filter(F.col("rank") <= depth)
