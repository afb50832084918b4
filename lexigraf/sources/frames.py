"""Stores over frames that are at hand, for what does not come from Git: chunks, versions with lineage, and code graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import unified_diff
from ..operators import graph, lineage


class ChunkFrame:
    """chunks: (chunk_hash, text, version_id, ...)."""

    def __init__(self, chunks: DataFrame):
        self.chunks = chunks

    def iter(self, version: str = "*") -> DataFrame:
        return self.chunks if version == "*" else self.chunks.filter(F.col("version_id") == version)

    def get(self, chunk_hash: str) -> dict:
        row = self.chunks.filter(F.col("chunk_hash") == chunk_hash).first()
        if row is None:
            raise KeyError(chunk_hash)
        return row.asDict()

    def changed_since(self, version: str, head: str) -> DataFrame:
        """(change, chunk_hash) of a version's chunks against the head's."""
        return lineage.changed_since(self.iter(version), self.iter(head), "chunk_hash")


class VersionFrame:
    """versions: (version_id, tag, timestamp); nodes: (lineage_id, symbol_id, version_id, chunk_hash, change_type); texts:
    (chunk_hash, text)."""

    def __init__(self, versions: DataFrame, nodes: DataFrame, texts: DataFrame):
        self.all, self.nodes, self.texts = versions, nodes, texts

    def versions(self) -> DataFrame:
        """Oldest first, with ``version_rank`` from 0."""
        window = Window.orderBy("timestamp", "version_id")  # a row for each version
        return self.all.withColumn("version_rank", (F.row_number().over(window) - 1).cast("long")).orderBy("version_rank")

    def lineage(self, lineage_id: str) -> DataFrame:
        rows = self.nodes.filter(F.col("lineage_id") == lineage_id).join(self.versions().select("version_id", "version_rank"), "version_id", "left")
        return rows.orderBy(F.coalesce("version_rank", F.lit(0)), "chunk_hash")

    def diff_symbol(self, symbol: str, a: str, b: str, most: int | None = None) -> dict:
        """What became of a symbol, by its id, from one version to another, with both texts and their diff."""
        mine = self.nodes.filter((F.col("symbol_id") == symbol) & F.col("version_id").isin(a, b)).join(self.texts, "chunk_hash", "left")
        at = lambda v: F.first(F.when(F.col("version_id") == v, F.col("text")), ignorenulls=True)
        row = mine.agg(at(a).alias("old"), at(b).alias("new"))
        diff = unified_diff("old", "new", F.lit(a), F.lit(b), F.lit(most).cast("long"))
        change = F.when(F.col("old").eqNullSafe(F.col("new")), "unchanged").when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "deleted").otherwise("modified")
        return {"symbol": symbol, "from": a, "to": b, **row.select(change.alias("change"), "old", "new", diff.alias("diff")).first().asDict()}


class GraphFrame:
    """symbols: (symbol_id, chunk_hash, seq), of which the last row of a symbol counts; edges: (src, dst, kind)."""

    def __init__(self, symbols: DataFrame, edges: DataFrame):
        self.symbols = symbols.groupBy("symbol_id").agg(F.max_by("chunk_hash", "seq").alias("chunk_hash"))
        self.edges = graph.clean_edges(edges)

    def chunk_for(self, symbol: str) -> str | None:
        row = self.symbols.filter(F.col("symbol_id") == symbol).first()
        return row["chunk_hash"] if row else None

    def symbols_for(self, chunk_hash: str) -> list[str]:
        return sorted(r["symbol_id"] for r in self.symbols.filter(F.col("chunk_hash") == chunk_hash).collect())  # of one chunk

    def neighbors(self, symbol: str, direction: str = "both", kinds: list[str] | None = None) -> DataFrame:
        return graph.neighbors(self.edges, symbol, direction, kinds)

    def resolve(self, name: str) -> DataFrame:
        last = F.element_at(F.split("symbol_id", r"::"), -1)
        return graph.resolve(self.symbols.withColumn("symbol", last), name)
