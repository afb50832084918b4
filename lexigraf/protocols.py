"""What may be plugged into a pipeline: functions and objects from frames to frames.

Anything with these methods will do; nothing has to be inherited from.  All of them take
whole batches of queries, with ``qid`` as a key.
"""

from __future__ import annotations

from typing import Protocol, runtime_checkable

from pyspark.sql import DataFrame


@runtime_checkable
class ChunkStore(Protocol):
    def iter(self, version: str = "*") -> DataFrame: ...

    def get(self, chunk_hash: str) -> dict: ...


@runtime_checkable
class CodeGraph(Protocol):
    symbols: DataFrame
    edges: DataFrame

    def neighbors(self, symbol: str, direction: str = "both", kinds: list[str] | None = None) -> DataFrame: ...


@runtime_checkable
class VersionStore(Protocol):
    def versions(self) -> DataFrame: ...

    def lineage(self, lineage_id: str) -> DataFrame: ...

    def diff_symbol(self, symbol: str, a: str, b: str) -> dict: ...


@runtime_checkable
class Retriever(Protocol):
    """Queries (qid, text) to hits (qid, chunk_hash, view, raw, rank)."""

    def __call__(self, queries: DataFrame, depth: int) -> DataFrame: ...


@runtime_checkable
class Embedder(Protocol):
    """Rows (key, text) to (key, vector); kind is ``query`` or ``document``."""

    def __call__(self, rows: DataFrame, key: str, kind: str = "document") -> DataFrame: ...


@runtime_checkable
class PairScorer(Protocol):
    """Queries (qid, text) and a pool (qid, chunk_hash, chunk_text, rank, score) to (qid, chunk_hash, pair)."""

    def __call__(self, queries: DataFrame, pool: DataFrame) -> DataFrame: ...


@runtime_checkable
class QueryAnalyzer(Protocol):
    """Queries (qid, text) to what ``query.classify`` gives of ``query.parse``."""

    def __call__(self, queries: DataFrame) -> DataFrame: ...
