"""Embedders: functions from rows (key, text) to (key, vector), by name.

A model is named by a ``ModelSpec``.  Kinds:

- ``hash``: the tokens of a text counted in slots, in the JVM, offline and deterministic;
- ``local``: a loader that the caller registers; it runs once in each Python worker, when the
  first text comes, and encodes Arrow batches of texts sorted by length;
- ``service``: a client that the caller registers, asked in batches at a pace and again after
  errors that may pass.

``load`` puts a cache of vectors before any of them, so a model is only loaded, and a service
only asked, for texts that were never seen.  Local models can be switched off; vectors that
are in the cache serve on.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import unit
from ..resilience import MissingKeyError, Pace, repeated, require_key
from ..sources.cache import Vectors
from . import dense


@dataclass(frozen=True)
class ModelSpec:
    name: str
    kind: str = "hash"  # hash, local, service; for rerankers overlap, local, listwise
    revision: str = "1"
    dim: int = 64
    max_chars: int = 6000
    batch_size: int = 32
    query_prefix: str = ""
    document_prefix: str = ""
    key_env: str = ""
    per_minute: float = 0.0
    options: dict = field(default_factory=dict)


#: Embedders that need nothing but this library.  Others are added with ``register``.
EMBEDDERS: dict[str, ModelSpec] = {f"hash-{d}": ModelSpec(f"hash-{d}", dim=d) for d in (64, 128, 256, 512, 1024)}
_encoders: dict[str, Callable] = {}


class LocalModelsDisabledError(RuntimeError):
    """A local model would have to run, and the settings forbid it."""


def register(spec: ModelSpec, make: Callable | None = None) -> None:
    """Add an embedder.  ``make(spec)`` gives a function from a list of texts to a list of vectors; it is called in a worker
    (local) or on each worker with a key at hand (service), so it has to be importable or picklable."""
    EMBEDDERS[spec.name] = spec
    if make is not None:
        _encoders[spec.name] = make


def prepared(spec: ModelSpec, text, kind: str):
    """The text as the model gets it: its prefix before it, cut to ``max_chars``; nothing becomes one space."""
    prefix = spec.query_prefix if kind == "query" else spec.document_prefix
    cut = F.substring(F.concat(F.lit(prefix), F.coalesce(text, F.lit(""))), 1, spec.max_chars)
    return F.when(F.trim(cut) == "", F.lit(" ")).otherwise(cut)


def _batches(spec: ModelSpec, make: Callable):
    """A worker's function over Arrow batches (key, text)."""

    def run(batches: Iterator[pa.RecordBatch]):
        encode = None
        pace = Pace(spec.per_minute)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))  # alike lengths together
            vectors: list = [None] * len(texts)
            for a in range(0, len(order), spec.batch_size):
                some = order[a : a + spec.batch_size]
                if encode is None:
                    encode = make(spec)
                if spec.kind == "service":
                    pace.wait()
                got = repeated(lambda some=some: encode([texts[i] for i in some])) if spec.kind == "service" else encode([texts[i] for i in some])
                for i, v in zip(some, got, strict=True):
                    vectors[i] = [float(x) for x in v]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(vectors, pa.list_(pa.float64()))], [batch.schema.names[0], "vector"])

    return run


class Embedder:
    """``embedder(rows, key, kind)`` gives (key, vector) with vectors of length 1."""

    def __init__(self, spec: ModelSpec, cache: Vectors | None = None, allow_local: bool = True, keep_queries: bool = True):
        self.spec, self.cache, self.allow_local, self.keep_queries = spec, cache, allow_local, keep_queries

    @property
    def revision(self) -> str:
        return f"{self.spec.name}@{self.spec.revision}"

    def encode(self, rows: DataFrame, key: str, kind: str) -> DataFrame:
        spec = self.spec
        if spec.kind == "hash":
            return dense.hash_embed(rows, key, dim=spec.dim)
        if rows.isEmpty():
            return rows.sparkSession.createDataFrame([], f"{key} {dict(rows.dtypes)[key]}, vector array<double>")
        if spec.kind == "local" and not self.allow_local:
            raise LocalModelsDisabledError(f"{spec.name} has to run for texts that the cache lacks, but local models are off")
        if spec.kind == "service" and spec.key_env:
            require_key(spec.key_env)
        if spec.name not in _encoders:
            raise ValueError(f"no encoder is registered for {spec.name}")
        told = rows.select(key, prepared(spec, F.col("text"), kind).alias("text"))
        out = told.mapInArrow(_batches(spec, _encoders[spec.name]), f"{key} {dict(rows.dtypes)[key]}, vector array<double>")
        return out.select(key, unit("vector").alias("vector"))

    def __call__(self, rows: DataFrame, key: str, kind: str = "document") -> DataFrame:
        if self.cache is None:
            return self.encode(rows, key, kind)
        return self.cache.through(rows, key, self.revision, kind, lambda texts: self.encode(texts, "text_sha1", kind), self.keep_queries)


def load(spark: SparkSession, name: str, cache_dir: str | None = None, fallback: str | None = None, allow_local: bool = True, keep_queries: bool = True) -> Embedder:
    """The embedder of a name, behind a cache if there is a folder for one.  ``fallback`` is used only where a service's key is missing."""
    spec = EMBEDDERS[name]
    cache = Vectors(spark, f"{cache_dir}/vectors") if cache_dir else None
    if spec.kind == "service" and spec.key_env:
        try:
            require_key(spec.key_env)
        except MissingKeyError:
            if fallback is None:
                raise
            spec = EMBEDDERS[fallback]
    return Embedder(spec, cache, allow_local, keep_queries)
