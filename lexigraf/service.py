"""What a user asks of a store: search, symbols, dependencies, comparison, history."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions.text import symbol_id, unified_diff

from .operators import fusion, graph, lexical, lineage, rank
from .sources import git
from .sources.store import VersionedStore


def bounded(name: str, value: int, low: int, high: int) -> int:
    if not low <= value <= high:
        raise ValueError(f"{name} must be from {low} to {high}")
    return value


def search(store: VersionedStore, text: str, ref: str = "HEAD", limit: int = 10, history: bool = False, use_graph: bool = False) -> list[dict]:
    """Ranked chunks of a commit; with ``history`` of all indexed commits, copies as one with their versions."""
    if not text.strip() or limit < 1:
        return []
    store.index_commit(ref)
    commit = store.resolve(ref)
    chunks = store.ranking_chunks(store.commits() if history else [commit]).persist()
    asked = store.spark.createDataFrame([(1, text)], "qid long, text string")
    hits = lexical.search_chunks(chunks, asked, max(100, limit * 4 if history else limit))
    use_graph = use_graph and not history
    if use_graph:
        seeds = hits.select("qid", "chunk_hash", F.col("raw").alias("score"))
        direction = store.spark.range(1).select(graph.direction_for(F.lit(text)), graph.kinds_for(F.lit(text))).first()
        view = graph.graph_view(seeds, store.symbols(commit).select("chunk_hash", "symbol_id"), store.table("edges", commit), direction=direction[0], kinds=list(direction[1]))
        hits = hits.unionByName(view)
    fused = fusion.fuse(hits, "rrf", views=1 if not use_graph else 2)
    out = rank.collapse_copies(fused, chunks, limit) if history else rank.cut(fused, limit)
    rows = out.join(chunks.select("chunk_hash", "path", "symbol", "kind", "start_line", "end_line", "version_id", F.array_join(F.slice(F.split("body", "\n"), 1, 40), "\n").alias("snippet")), "chunk_hash").orderBy("rank")
    return [r.asDict(recursive=True) for r in rows.drop("qid").collect()]


def search_baseline(store: VersionedStore, text: str, ref: str = "HEAD", limit: int = 10, history: bool = False) -> list[dict]:
    """The plain ranking alone: distinct terms over path, symbol and text; ties by path and line."""
    if not text.strip() or limit < 1:
        return []
    store.index_commit(ref)
    chunks = store.ranking_chunks(store.commits() if history else [store.resolve(ref)]).persist()
    asked = store.spark.createDataFrame([(1, text)], "qid long, text string")
    found = lexical.search_baseline_chunks(chunks, asked, 1 << 30).select("chunk_hash", "raw").join(chunks, "chunk_hash")
    rows = found.orderBy(F.round("raw", 9).desc(), "path", "start_line").limit(limit)
    return [r.asDict() for r in rows.select("chunk_hash", F.col("raw").alias("score"), "path", "symbol", "kind", "start_line", "end_line", "version_id", F.col("body").alias("text")).collect()]


def find_symbol(store: VersionedStore, name: str, ref: str = "HEAD") -> list[dict]:
    commit = store.index_commit(ref).commit_id
    found = graph.resolve(store.symbols(commit), name)
    rows = store.symbols(commit).join(found, "symbol_id")
    return [r.asDict() for r in rows.orderBy("symbol_id", "start_line").collect()]


def find_dependencies(store: VersionedStore, name: str, ref: str = "HEAD", direction: str = "out", kinds: list[str] | None = None, depth: int = 3, limit: int = 50) -> list[dict]:
    bounded("depth", depth, 1, 6), bounded("limit", limit, 1, 50)
    commit = store.index_commit(ref).commit_id
    starts = graph.resolve(store.symbols(commit), name).select(F.col("symbol_id").alias("start"))
    rows = graph.dependency_chains(store.table("edges", commit), starts, direction, kinds, depth, limit=limit)
    return [r.asDict(recursive=True) for r in rows.orderBy("start", "rank").collect()]


def compare_versions(store: VersionedStore, a: str, b: str, limit: int = 200, most: int = 40) -> dict:
    """Changed symbols with diffs, changed edges, counts per change and the commits between, each with the changed symbols of
    its files."""
    bounded("limit", limit, 1, 200)
    ca, cb = store.index_commit(a).commit_id, store.index_commit(b).commit_id
    old, new = store.chunks(ca), store.chunks(cb)
    every, summary = lineage.compare_versions(old, new, None)
    every = every.persist()
    named = lambda ref, side: F.when(F.col(f"{side}_symbol").isNotNull(), F.concat(F.lit(f"{ref}:"), F.col(f"{side}_symbol"))).otherwise(F.lit(ref))
    order = F.array_position(F.array(*[F.lit(c) for c in lineage.CHANGE_ORDER]), F.col("change_type"))
    shown = every.orderBy(order, F.coalesce("new_symbol", "old_symbol")).limit(limit)
    shown = shown.select("change_type", "old_symbol", "new_symbol", "similarity", unified_diff("old_text", "new_text", named(ca[:7], "old"), named(cb[:7], "new"), F.lit(most).cast("long")).alias("diff"))
    listed = [{"change": r["change_type"], "old": r["old_symbol"], "new": r["new_symbol"], "similarity": r["similarity"], "diff": r["diff"]} for r in shown.orderBy(order, F.coalesce("new_symbol", "old_symbol")).collect()]
    names = every.filter("old_symbol is not null and new_symbol is not null and old_symbol <> new_symbol").select(F.col("old_symbol").alias("was"), F.col("new_symbol").alias("now"))
    edges = lineage.edge_changes(store.table("edges", ca), store.table("edges", cb), names)
    commits = git.commits_between(store.repo, ca, cb)
    touched = touched_symbols(store.spark.createDataFrame([(c[0], c[5]) for c in commits], "commit_id string, files array<string>"), every)
    symbols = {r["commit_id"]: r["symbols"] for r in touched.collect()}  # of the commits listed
    out = {
        "from": ca, "to": cb, "symbols": listed, "summary": {r["change_type"]: r["n"] for r in summary.collect()},
        "edges": [r.asDict() for r in edges.orderBy("change", "src", "dst", "kind").limit(2 * limit).collect()],
        "commits": [{"commit": c[0], "author": c[2], "timestamp": c[3], "subject": c[4], "files": c[5], "symbols": symbols.get(c[0], [])} for c in commits],
    }
    every.unpersist()
    return out


def touched_symbols(commits: DataFrame, changes: DataFrame) -> DataFrame:
    """(commit_id, symbols): commits (commit_id, files) with the changed symbols (old_symbol, new_symbol) of the files that they touch."""
    name = F.coalesce("new_symbol", "old_symbol")
    by_path = changes.select(F.split_part(name, F.lit("::"), F.lit(1)).alias("path"), name.alias("symbol"))
    rows = commits.select("commit_id", F.explode("files").alias("path")).join(by_path, "path")
    return rows.groupBy("commit_id").agg(F.array_sort(F.collect_set("symbol")).alias("symbols"))


def diff_symbol(store: VersionedStore, symbol: str, a: str, b: str, most: int | None = None) -> dict:
    """What became of a symbol (its id or a name) between two versions, through renames and moves: change, texts and diff."""
    ca, cb = store.index_commit(a).commit_id, store.index_commit(b).commit_id
    pair = lineage.find_pair(store.table("lineage"), symbol, ca, cb)
    side = lambda c, n: store.chunks(c).select(F.col("occurrence_id").alias(n), F.col("path").alias(f"{n}_path"), F.col("symbol").alias(f"{n}_name"), symbol_id("path", "symbol").alias(f"{n}_id"), F.col("text").alias(f"{n}_text"), F.col("content_hash").alias(f"{n}_hash"))
    rows = pair.join(side(ca, "old"), "old", "left").join(side(cb, "new"), "new", "left")
    gone, come = F.col("old_id").isNull(), F.col("new_id").isNull()
    change = (
        F.when(gone & come, "unchanged").when(gone, "added").when(come, "deleted")
        .when(F.expr("old_name <=> new_name and old_path = new_path"), F.when(F.expr("old_hash = new_hash"), "unchanged").otherwise("modified"))
        .when(F.expr("old_name <=> new_name"), "moved").otherwise("renamed")
    )
    label = lambda ref, n: F.concat_ws(":", F.lit(ref), f"{n}_id")
    diff = unified_diff("old_text", "new_text", label(a, "old"), label(b, "new"), F.lit(most).cast("long"))
    row = rows.select(change.alias("change"), "old_id", "new_id", "old_text", "new_text", diff.alias("diff")).first()
    base = {"symbol": symbol, "from": ca, "to": cb}
    return {**base, **row.asDict()} if row else {**base, "change": "unchanged", "old_id": None, "new_id": None, "old_text": None, "new_text": None, "diff": ""}


def versions(store: VersionedStore) -> list[dict]:
    return [r.asDict() for r in store.versions().orderBy("version_rank").collect()]


def symbol_history(store: VersionedStore, name: str, ref: str = "HEAD") -> list[dict]:
    """All versions of a symbol's lineage, oldest first, following renames and moves."""
    store.index_commit(ref)
    order = {c: i for i, c in enumerate(store.commits())}
    rows = store.table("lineage")
    last = F.element_at(F.split("symbol", r"\."), -1)
    ids = rows.filter((F.col("symbol") == name) | (last == name) | (F.concat_ws("::", "path", "symbol") == name)).select("lineage_id").distinct()
    found = rows.join(ids, "lineage_id", "left_semi").collect()
    return [r.asDict() for r in sorted(found, key=lambda r: (r["lineage_id"], order.get(r["commit_id"], -1)))]
