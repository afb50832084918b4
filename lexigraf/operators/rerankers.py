"""Rerankers: functions from queries (qid, text) and a pool (qid, chunk_hash, chunk_text, score) to (qid, chunk_hash, pair).

Kinds of models, by their ``ModelSpec``: ``overlap`` (shared words, in the JVM), ``local`` and
``listwise``.  A local model scores pairs of texts in Arrow batches, a cross encoder or the
probability of "yes" of a language model, whatever the registered loader gives.  A listwise
model is asked once for each query for an order of its pool.  Scores are kept by pair, orders
by query and pool.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import cache_key, head_tail, jaccard, word_set
from ..resilience import MissingKeyError, Pace, repeated, require_key
from ..session import stored
from ..sources.cache import KeyValues, PairScores
from .embedders import LocalModelsDisabledError, ModelSpec
from .query import reorder

#: Rerankers that need nothing but this library; characters of queries and documents that a model gets.
RERANKERS: dict[str, ModelSpec] = {"overlap": ModelSpec("overlap", "overlap")}
QUERY_CHARS, DOCUMENT_CHARS, LISTED_CHARS, WINDOW = 3000, 3000, 1200, 20
_scorers: dict[str, Callable] = {}


def register(spec: ModelSpec, make: Callable) -> None:
    """``make(spec)`` gives, for a local model, a function from a list of (query, document) to scores; for a listwise one a
    function from (query, documents) to a reply that lists places."""
    RERANKERS[spec.name] = spec
    _scorers[spec.name] = make


class Reranker:
    def __init__(self, spec: ModelSpec, spark: SparkSession, cache_dir: str | None = None, allow_local: bool = True):
        self.spec, self.spark, self.allow_local = spec, spark, allow_local
        self.pairs = PairScores(spark, f"{cache_dir}/pairs") if cache_dir else None
        self.orders = KeyValues(spark, f"{cache_dir}/orders") if cache_dir else None

    @property
    def revision(self) -> str:
        return f"{self.spec.name}@{self.spec.revision}"

    def score_pairs(self, pairs: DataFrame) -> DataFrame:
        """``pairs`` (query, chunk_text, ...) with ``pair``."""
        spec = self.spec
        if spec.kind == "overlap":
            return pairs.withColumn("pair", jaccard(word_set("query"), word_set("chunk_text"), 0.0))
        if not self.allow_local and not pairs.isEmpty():
            raise LocalModelsDisabledError(f"{spec.name} has to run for pairs that the cache lacks, but local models are off")
        make, told = _scorers[spec.name], pairs.withColumns({"_q": head_tail("query", QUERY_CHARS), "_d": head_tail("chunk_text", DOCUMENT_CHARS)})

        @F.pandas_udf("double")
        def score(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            model = None
            for q, d in parts:
                if model is None and len(q):
                    model = make(spec)
                out = pd.Series(0.0, index=q.index)
                order = (q.str.len() + d.str.len()).sort_values(ascending=False, kind="stable").index
                for a in range(0, len(order), spec.batch_size):
                    some = order[a : a + spec.batch_size]
                    out[some] = [float(x) for x in model(list(zip(q[some], d[some], strict=True)))]
                yield out

        return told.withColumn("pair", score("_q", "_d")).drop("_q", "_d")

    def _ordered(self, pairs: DataFrame) -> DataFrame:
        """Listwise: the first ``WINDOW`` of each query in the order of a reply, 1 - place / number; the rest keep theirs."""
        spec, make = self.spec, _scorers[self.spec.name]
        listed = pairs.filter(F.col("rank") <= WINDOW).withColumn("shown", head_tail("chunk_text", LISTED_CHARS))
        asked = listed.groupBy("qid").agg(F.first(head_tail("query", QUERY_CHARS)).alias("query"), F.array_sort(F.collect_list(F.struct("rank", "chunk_hash", "shown"))).alias("pool"))
        hashes = F.array_join(F.transform("pool", lambda p: p["chunk_hash"]), "\u0000")
        asked = asked.withColumn("key", cache_key(F.lit(self.revision), F.col("query"), hashes))
        known = self.orders.rows() if self.orders else self.spark.createDataFrame([], "key string, value string")

        def ask(parts):
            model, pace = None, Pace(spec.per_minute)
            for part in parts:
                values = []
                for query, pool in zip(part["query"], part["pool"], strict=True):
                    model = model or make(spec)
                    pace.wait()
                    reply = repeated(lambda query=query, pool=pool, model=model: model(query, [p["shown"] for p in pool]))
                    values.append(json.dumps(reorder(reply or "", len(pool))))
                yield pd.DataFrame({"key": part["key"], "value": values})

        fresh = stored(asked.join(known.select("key"), "key", "left_anti").dropDuplicates(["key"]).select("key", "query", "pool").mapInPandas(ask, "key string, value string"), "orders")
        if self.orders and not fresh.isEmpty():
            self.orders.add(fresh)
        order = F.from_json("value", "array<int>")
        told = asked.join(known.unionByName(fresh).dropDuplicates(["key"]), "key").select("qid", F.size("pool").alias("n"), "pool", F.posexplode(order).alias("place", "which"))
        return told.select("qid", F.element_at("pool", F.col("which") + 1)["chunk_hash"].alias("chunk_hash"), (1.0 - F.col("place") / F.col("n")).alias("pair"))

    def __call__(self, queries: DataFrame, pool: DataFrame) -> DataFrame:
        pairs = pool.join(queries.select("qid", F.col("text").alias("query")), "qid")
        if self.spec.kind == "listwise":
            return self._ordered(pairs)
        if self.pairs is None or self.spec.kind == "overlap":
            return self.score_pairs(pairs).select("qid", "chunk_hash", "pair")
        return self.pairs.through(pairs, self.revision, self.score_pairs)


def load(spark: SparkSession, name: str, cache_dir: str | None = None, fallback: str | None = None, allow_local: bool = True) -> Reranker:
    """The reranker of a name; ``fallback`` is used only where a service's key is missing."""
    spec = RERANKERS[name]
    if spec.key_env:
        try:
            require_key(spec.key_env)
        except MissingKeyError:
            if fallback is None:
                raise
            spec = RERANKERS[fallback]
    return Reranker(spec, spark, cache_dir, allow_local)
