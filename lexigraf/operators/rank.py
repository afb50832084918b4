"""What happens to a fused list: cuts, reranking, lineages, history, diversity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import dot, jaccard, unit
from .lexical import PLACES


def cut(fused: DataFrame, k: int) -> DataFrame:
    return fused.filter(F.col("rank") <= k)


def rerank(fused: DataFrame, pair_scores: DataFrame, depth: int = 20, blend: float = 0.0, step: float = 1e-3) -> DataFrame:
    """The first ``depth`` of each query by their pair score (qid, chunk_hash, pair), mixed with ``blend`` of the old;
    the others stay below, in order, each ``step`` lower.  Pairs without a score keep the old one."""
    head = fused.filter(F.col("rank") <= depth).join(pair_scores, ["qid", "chunk_hash"], "left")
    new = F.coalesce((1 - blend) * F.col("pair") + blend * F.col("score"), F.col("score"))
    head = head.select("qid", "chunk_hash", new.alias("score"))
    floors = head.groupBy("qid").agg(F.min("score").alias("floor"))
    tail = fused.filter(F.col("rank") > depth).join(floors, "qid").select("qid", "chunk_hash", (F.col("floor") - (F.col("rank") - depth) * step).alias("score"))
    window = Window.partitionBy("qid").orderBy(F.round("score", PLACES).desc(), "chunk_hash")
    return head.unionByName(tail).withColumn("rank", F.row_number().over(window).cast("long"))


def version_rank(versions: DataFrame, head: str = "HEAD") -> DataFrame:
    """(version_id, version_rank): oldest 0, the head after all."""
    window = Window.orderBy("timestamp", "version_id")  # one row per version
    known = versions.withColumn("version_rank", (F.row_number().over(window) - 1).cast("long")).select("version_id", "version_rank")
    last = versions.agg((F.count(F.lit(1)) + 1).cast("long").alias("version_rank")).select(F.lit(head).alias("version_id"), "version_rank")
    return known.filter(F.col("version_id") != head).unionByName(last)


def lineage_dedup(hits: DataFrame, chunks: DataFrame, ranks: DataFrame, target: str = "HEAD", keep_history: bool = False) -> DataFrame:
    """One hit per lineage (chunks without one stand alone): the target version's, else the newest, with the best score
    of its lineage.  With ``keep_history`` all stay, newest first, each 1e-6 below the one before."""
    rows = hits.join(chunks.select("chunk_hash", "lineage_id", "version_id"), "chunk_hash").join(ranks, "version_id", "left")
    rows = rows.withColumn("line", F.coalesce("lineage_id", F.concat(F.lit("chunk:"), F.col("chunk_hash")))).withColumn("version_rank", F.coalesce("version_rank", F.lit(-1)))
    line = Window.partitionBy("qid", "line")
    newest = F.desc("version_rank")
    order = (newest, F.asc("chunk_hash")) if keep_history else (F.desc(F.col("version_id") == target), newest, F.asc("chunk_hash"))
    rows = rows.withColumn("best", F.max("score").over(line)).withColumn("place", F.row_number().over(line.orderBy(*order)) - 1)
    rows = rows.withColumn("score", F.col("best") - F.col("place") * 1e-6) if keep_history else rows.filter("place = 0").withColumn("score", F.col("best"))
    window = Window.partitionBy("qid").orderBy(F.round("score", PLACES).desc(), "chunk_hash")
    return rows.select("qid", "chunk_hash", "lineage_id", "version_id", "score").withColumn("rank", F.row_number().over(window).cast("long"))


def lineage_history(nodes: DataFrame, ranks: DataFrame) -> DataFrame:
    """(lineage_id, history): all nodes of each lineage, oldest first."""
    rows = nodes.join(ranks, "version_id", "left")
    entry = F.struct(F.coalesce("version_rank", F.lit(-1)).alias("at"), "version_id", "change_type", "symbol_id")
    return rows.groupBy("lineage_id").agg(F.array_sort(F.collect_list(entry)).alias("history"))


def evolution_view(query_tokens: DataFrame, candidates: DataFrame, nodes: DataFrame, tags: DataFrame) -> DataFrame:
    """hits of the view ``evolution``: (qid, tokens, refs) against candidates (qid, chunk_hash, lineage_id, rank) and lineage
    nodes (lineage_id, version_id, change_type, message_tokens).  A node scores the share of the query's tokens in its
    message, 0.5 more if the query names its version or tag (version_id, tag), 0.1 more if it changed something; a lineage
    its best node, for its first candidate.

    Messages meet queries token by token, by a join on (lineage, token), and only tokens that some query has leave their
    row; no list of tokens is shuffled."""
    first = Window.partitionBy("qid", "lineage_id").orderBy("rank")
    pool = candidates.filter("lineage_id is not null").withColumn("r", F.row_number().over(first)).filter("r = 1").select("qid", "chunk_hash", "lineage_id")
    node = F.xxhash64("lineage_id", "version_id", "change_type", "message_tokens")
    told = nodes.join(pool.select("lineage_id").distinct(), "lineage_id", "left_semi").withColumn("node", node)  # no other lineage scores
    asked = query_tokens.select("qid", F.array_distinct("tokens").alias("tokens"), "refs")
    each = asked.select("qid", F.explode("tokens").alias("token"))
    said = told.select("lineage_id", "node", F.explode(F.array_distinct("message_tokens")).alias("token")).join(each.select("token").distinct(), "token", "left_semi").distinct()
    common = pool.select("qid", "lineage_id").join(each, "qid").join(said, ["lineage_id", "token"]).groupBy("qid", "node").agg(F.count(F.lit(1)).alias("common"))
    facts = told.select("lineage_id", "version_id", "change_type", "node").distinct().join(tags, "version_id", "left")
    rows = pool.join(facts, "lineage_id").join(asked.select("qid", "refs", F.size("tokens").alias("n")), "qid").join(common, ["qid", "node"], "left")
    share = F.coalesce("common", F.lit(0)) / F.greatest("n", F.lit(1))
    named = F.coalesce(F.array_contains("refs", F.col("version_id")), F.lit(False)) | F.coalesce(F.array_contains("refs", F.col("tag")), F.lit(False))
    score = share + F.when(named, 0.5).otherwise(0.0) + F.when(F.col("change_type").isin("unchanged", "added"), 0.0).otherwise(0.1)
    best = rows.groupBy("qid", "chunk_hash").agg(F.max(score).alias("raw")).filter("raw > 0")
    window = Window.partitionBy("qid").orderBy(F.round("raw", PLACES).desc(), "chunk_hash")
    return best.withColumn("rank", F.row_number().over(window).cast("long")).select("qid", "chunk_hash", F.lit("evolution").alias("view"), "raw", "rank")


def collapse_copies(hits: DataFrame, chunks: DataFrame, limit: int) -> DataFrame:
    """Hits of equal content as one, at its best rank, with the versions that hold it; then the first ``limit``."""
    rows = hits.join(chunks.select("chunk_hash", "content_hash", "version_id"), "chunk_hash")
    grouped = rows.groupBy("qid", "content_hash").agg(
        F.min_by("chunk_hash", "rank").alias("chunk_hash"), F.max("score").alias("score"), F.min("rank").alias("first"), F.array_sort(F.collect_set("version_id")).alias("versions")
    )
    window = Window.partitionBy("qid").orderBy("first")
    return grouped.withColumn("rank", F.row_number().over(window).cast("long")).filter(F.col("rank") <= limit).drop("first")


def mmr(fused: DataFrame, features: DataFrame, lam: float = 0.7, k: int = 20, step: float = 1e-4) -> DataFrame:
    """Maximal marginal relevance over the first ``k`` of each query: (qid, chunk_hash, score, rank).

    ``features`` are (chunk_hash, vector), compared by cosine, or (chunk_hash, words), by their overlap; a chunk without any
    is like no other.  A query's ``k`` rows become one array, which is folded into the new order: what is left carries its
    greatest similarity to what was taken.  Scores fall by ``step`` from that of the first; the others stay below, in order.
    Lists of fewer than three keep theirs."""
    by_vector = "vector" in features.columns
    told = features.select("chunk_hash", (unit("vector") if by_vector else F.col("words")).alias("v"))
    alike = (lambda a, b: F.coalesce(dot(a, b), F.lit(0.0))) if by_vector else (lambda a, b: F.coalesce(jaccard(a, b, 0.0), F.lit(0.0)))
    head = fused.filter(F.col("rank") <= k).select("qid", "chunk_hash", "score", "rank").join(told, "chunk_hash", "left")
    listed = head.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_hash", "score", "v"))).alias("rows"))
    scores = F.transform("rows", lambda r: r["score"])
    low, high = F.array_min(scores), F.array_max(scores)
    value = lambda s: F.when((low >= 0) & (high > 0), s / high).when(high > low, (s - low) / (high - low)).otherwise(1.0)
    item = lambda r, near: F.struct(r["rank"].alias("rank"), r["chunk_hash"].alias("chunk_hash"), r["score"].alias("score"), r["v"].alias("v"), near.alias("near"))
    listed = listed.withColumn("left", F.transform("rows", lambda r: item(r, F.lit(0.0)))).withColumns({"low": low, "high": high})
    low, high = F.col("low"), F.col("high")
    kind = dict(listed.dtypes)["left"]
    start = F.struct(F.array().cast(kind).alias("taken"), F.col("left").alias("left"))

    def take(state: Column, _: Column) -> Column:
        worth = F.transform(state["left"], lambda r: lam * value(r["score"]) - (1 - lam) * r["near"])
        place = F.array_position(worth, F.array_max(worth)).cast("int")
        one = F.element_at(state["left"], place)
        rest = F.filter(state["left"], lambda r: r["rank"] != one["rank"])
        closer = lambda r: F.when(F.size(state["taken"]) == 0, alike(r["v"], one["v"])).otherwise(F.greatest(r["near"], alike(r["v"], one["v"])))
        return F.struct(F.array_append(state["taken"], one).alias("taken"), F.transform(rest, lambda r: item(r, closer(r))).alias("left"))

    order = F.aggregate(F.sequence(F.lit(1), F.size("rows")), start, take)["taken"]
    small = F.size("rows") < 3
    done = listed.select("qid", small.alias("small"), F.when(small, F.col("left")).otherwise(order).alias("rows")).persist()  # ``k`` rows of each query, folded once
    placed = done.select("qid", "small", F.col("rows")[0]["score"].alias("first"), F.posexplode("rows").alias("i", "r"))
    score = F.when(F.col("small"), F.col("r.score")).otherwise(F.col("first") - F.col("i") * step)
    top = placed.select("qid", F.col("r.chunk_hash").alias("chunk_hash"), score.alias("score"), (F.col("i") + 1).cast("long").alias("rank"))
    floors = top.groupBy("qid").agg(F.min("score").alias("floor"))
    tail = fused.filter(F.col("rank") > k).join(floors, "qid").select("qid", "chunk_hash", (F.col("floor") - (F.col("rank") - k) * step).alias("score"), "rank")
    return top.unionByName(tail)


def word_overlap(rows: DataFrame) -> DataFrame:
    """(qid, a, b, similarity) of the word sets of each pair in a query's list (qid, chunk_hash, words); lists are cut before."""
    a = rows.select("qid", F.col("chunk_hash").alias("a"), F.col("words").alias("wa"))
    b = rows.select("qid", F.col("chunk_hash").alias("b"), F.col("words").alias("wb"))
    return a.join(b, "qid").filter("a < b").select("qid", "a", "b", jaccard("wa", "wb", 0.0).alias("similarity"))
