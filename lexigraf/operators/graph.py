"""Traversal of code graphs: edges(src, dst, kind).  Rounds are joins, as many as hops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Weights of the edge kinds.
EDGE_WEIGHTS = {"calls": 1.0, "inherits": 0.8, "dataflow": 0.7, "imports": 0.6, "references": 0.5, "defines": 0.3}
#: Phrases by which a query asks for incoming and for outgoing edges.
INCOMING = r"(?i)\b(who calls|callers?|called by|used by|uses of|who uses|imported by|referenced by|invoked by|subclass(?:es)?)\b"
OUTGOING = r"(?i)\b(callees?|calls?|depends on|dependenc(?:y|ies)|imports?|invokes?|inherits?|uses?)\b"


def weight_of(kind: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in EDGE_WEIGHTS.items() for x in pair])
    return F.coalesce(F.element_at(table, kind), F.lit(0.0))


def direction_for(text: Column) -> Column:
    inward = text.rlike(INCOMING)
    outward = F.regexp_replace(text, INCOMING, " ").rlike(OUTGOING)
    return F.when(inward & ~outward, "in").when(outward & ~inward, "out").otherwise("both")


def kinds_for(text: Column) -> Column:
    low = F.lower(text)
    every = F.array(*[F.lit(k) for k in EDGE_WEIGHTS])
    return (
        F.when(low.contains("import"), F.array(F.lit("imports")))
        .when(low.contains("inherit") | low.contains("subclass"), F.array(F.lit("inherits")))
        .when(low.contains("call") | low.contains("invok"), F.array(F.lit("calls")))
        .otherwise(every)
    )


def wants_graph(typed: DataFrame) -> Column:
    """Whether a typed query asks for dependencies: by its type, mixed ones too, or by a phrase."""
    return F.col("query_type").isin("dependency", "mixed") | (F.size("dependency_cues") > 0)


def other_end(symbol: Column | str) -> Column:
    """Of an edge's ends the one that isn't the symbol."""
    return F.when(F.col("src") == symbol, F.col("dst")).otherwise(F.col("src"))


def clean_edges(edges: DataFrame) -> DataFrame:
    return edges.filter("src <> dst").select("src", "dst", "kind").distinct()


def steps(edges: DataFrame, direction: str = "both", kinds: list[str] | None = None) -> DataFrame:
    """(at, to, kind, src, dst): each edge in the directions in which it may be walked."""
    rows = edges if kinds is None else edges.filter(F.col("kind").isin(kinds))
    out = rows.select(F.col("src").alias("at"), F.col("dst").alias("to"), "kind", "src", "dst")
    back = rows.select(F.col("dst").alias("at"), F.col("src").alias("to"), "kind", "src", "dst")
    return {"out": out, "in": back, "both": out.unionByName(back)}[direction]


def neighbors(edges: DataFrame, symbol: str, direction: str = "both", kinds: list[str] | None = None) -> DataFrame:
    return steps(edges, direction, kinds).filter(F.col("at") == symbol).select("to", "kind")


def resolve(symbols: DataFrame, name: str) -> DataFrame:
    """symbol_ids that are the name, whose symbol is it, or whose last part is it; an exact id wins."""
    exact = F.col("symbol_id") == name
    loose = (F.col("symbol") == name) | (F.element_at(F.split("symbol", r"\."), -1) == name)
    found = symbols.filter(exact | loose).withColumn("exact", exact)
    best = found.agg(F.max("exact").alias("any_exact"))
    return found.crossJoin(F.broadcast(best)).filter("exact = any_exact").select("symbol_id").distinct().orderBy("symbol_id")


def degrees(edges: DataFrame) -> DataFrame:
    rows = edges.select(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(edges.select("dst", F.lit(0), F.lit(1)))
    return rows.groupBy("node").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))


def expand(seeds: DataFrame, edges: DataFrame, hops: int = 1, decay: float = 0.5, direction: str = "both", kinds: list[str] | None = None, most: int = 10, include_seeds: bool = True) -> DataFrame:
    """(qid, node, score): seeds (qid, node, score) at score / best, and what is reached from them, each step times
    ``decay`` and the edge's weight, the best walk counting.  Rounds take the best per node before they go on."""
    window = Window.partitionBy("qid").orderBy(F.desc("score"), "node")
    top = seeds.withColumn("r", F.row_number().over(window)).filter(F.col("r") <= most)
    best = F.max("score").over(Window.partitionBy("qid"))
    start = top.withColumn("score", F.col("score") / F.when(best != 0, best).otherwise(1.0)).groupBy("qid", "node").agg(F.max("score").alias("score"))
    walk = steps(edges, direction, kinds).select(F.col("at").alias("node"), "to", (F.lit(decay) * weight_of(F.col("kind"))).alias("w"))
    every, front = start, start
    for _ in range(hops):
        front = front.join(walk, "node").groupBy("qid", F.col("to").alias("node")).agg(F.max(F.col("score") * F.col("w")).alias("score")).filter("score > 0")
        every = every.unionByName(front)
    out = every.groupBy("qid", "node").agg(F.max("score").alias("score"))
    return out if include_seeds else out.join(start.select("qid", "node"), ["qid", "node"], "left_anti")


def dependency_chains(edges: DataFrame, starts: DataFrame, direction: str = "out", kinds: list[str] | None = None, depth: int = 3, decay: float = 0.8, limit: int | None = 50) -> DataFrame:
    """(start, symbols, kinds, score, length): all simple paths from the starts (start) of up to ``depth`` edges.  A
    chain's score is the product of its weights, times ``decay`` for each edge after the first."""
    walk = steps(edges, direction, kinds).select(F.col("at").alias("last"), "to", "kind")
    front = starts.select("start", F.array("start").alias("symbols"), F.array().cast("array<string>").alias("kinds"), F.lit(1.0).alias("score"), F.col("start").alias("last"))
    found = None
    for hop in range(depth):
        front = (
            front.join(walk, "last")
            .filter(~F.array_contains("symbols", F.col("to")))
            .select("start", F.array_append("symbols", F.col("to")).alias("symbols"), F.array_append("kinds", F.col("kind")).alias("kinds"), (F.col("score") * weight_of(F.col("kind")) * (decay if hop else 1.0)).alias("score"), F.col("to").alias("last"))
        )
        found = front if found is None else found.unionByName(front)
    out = found.select("start", "symbols", "kinds", "score", F.size("kinds").cast("long").alias("length"))
    if limit is None:
        return out
    window = Window.partitionBy("start").orderBy(F.round("score", 9).desc(), "length", F.array_join("symbols", "\u0001"), F.array_join("kinds", "\u0001"))
    return out.withColumn("rank", F.row_number().over(window).cast("long")).filter(F.col("rank") <= limit)


def graph_view(seeds: DataFrame, chunk_symbols: DataFrame, edges: DataFrame, k: int | None = None, **how) -> DataFrame:
    """hits of the view ``graph``: seeds (qid, chunk_hash, score) through the symbols (chunk_hash, symbol_id) and back; with ``k``
    the first ``k`` of each query.  Of a symbol's chunks only the first ``k`` can be among them, since all score as much by it."""
    nodes = seeds.join(chunk_symbols, "chunk_hash").groupBy("qid", F.col("symbol_id").alias("node")).agg(F.max("score").alias("score"))
    back = chunk_symbols.withColumnRenamed("symbol_id", "node")
    if k is not None:
        first = F.row_number().over(Window.partitionBy("node").orderBy("chunk_hash"))
        back = back.select("node", "chunk_hash").distinct().withColumn("r", first).filter(F.col("r") <= k).drop("r")
    best = expand(nodes, edges, **how).join(back, "node").groupBy("qid", "chunk_hash").agg(F.max("score").alias("raw"))
    window = Window.partitionBy("qid").orderBy(F.round("raw", 9).desc(), "chunk_hash")
    ranked = best.withColumn("rank", F.row_number().over(window).cast("long")).select("qid", "chunk_hash", F.lit("graph").alias("view"), "raw", "rank")
    return ranked if k is None else ranked.filter(F.col("rank") <= k)
