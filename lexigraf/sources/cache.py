"""Caches as tables: what a model gave for a key, so that it is asked once.

Every cache is a folder of Parquet files that are only added to.  Of several rows with a key
the first written counts (they are equal, unless a run was repeated with another model
under the same name).  Writers name their batch, so a job that is repeated after a
failure adds rows, never half of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import cache_key
from ..session import stored

#: Texts of queries up to which their vectors aren't kept: a search on its own leaves no file.
FEW = 8


class Table:
    """Rows of one schema in one folder; an absent folder is an empty table."""

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str]):
        self.spark, self.path, self.schema, self.keys = spark, path.rstrip("/"), schema, keys

    def rows(self) -> DataFrame:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where):
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(self.path).dropDuplicates(self.keys)

    def found(self, wanted: DataFrame) -> DataFrame:
        """The rows whose keys are among ``wanted``."""
        return self.rows().join(wanted.select(*self.keys).distinct(), self.keys, "left_semi")

    def missing(self, wanted: DataFrame) -> DataFrame:
        """One row of ``wanted`` for each key that the table does not have."""
        return wanted.dropDuplicates(self.keys).join(self.rows().select(*self.keys), self.keys, "left_anti")

    def add(self, rows: DataFrame) -> None:
        rows.select(*[f.name for f in self.rows().schema]).write.mode("append").parquet(self.path)


class KeyValues(Table):
    """Answers of a service by key: (key, value)."""

    def __init__(self, spark: SparkSession, path: str):
        super().__init__(spark, path, "key string, value string", ["key"])

    @staticmethod
    def key(*parts) -> str:
        import hashlib

        return hashlib.sha1(b"".join(str(p).encode() + b"\0" for p in parts)).hexdigest()

    def get_many(self, keys: list[str]) -> dict[str, str]:
        """For the keys that a driver asks for; joins use ``found``."""
        wanted = self.spark.createDataFrame([(k,) for k in dict.fromkeys(keys)], "key string")
        return {r["key"]: r["value"] for r in self.found(wanted).collect()}

    def put_many(self, values: dict[str, str]) -> None:
        if values:
            self.add(self.spark.createDataFrame(list(values.items()), "key string, value string"))


class Vectors(Table):
    """Vectors of texts by model, revision, kind (query or document) and the text's sha1."""

    def __init__(self, spark: SparkSession, path: str):
        super().__init__(spark, path, "model string, kind string, text_sha1 string, vector array<double>", ["model", "kind", "text_sha1"])

    def through(self, rows: DataFrame, key: str, model: str, kind: str, encode, keep_queries: bool = True) -> DataFrame:
        """(key, vector) of rows (key, text): only texts that the table lacks go to ``encode(texts)``, a function from
        (text_sha1, text) to (text_sha1, vector), and each text once."""
        told = rows.select(F.col(key), F.col("text"), F.sha1("text").alias("text_sha1"), F.lit(model).alias("model"), F.lit(kind).alias("kind"))
        fresh = self.missing(told.select("model", "kind", "text_sha1", "text"))
        made = stored(encode(fresh.select("text_sha1", "text")).select(F.lit(model).alias("model"), F.lit(kind).alias("kind"), "text_sha1", "vector"), "vectors")
        have = self.found(told).unionByName(made).dropDuplicates(self.keys)
        if kind == "document" or keep_queries and made.limit(FEW).count() == FEW:
            self.add(made)
        return told.select(key, "text_sha1").join(have.select("text_sha1", "vector"), "text_sha1").select(key, "vector")


class PairScores(Table):
    """Scores of (query, chunk) pairs by reranker: the key is made of the query's text and the chunk's hash."""

    def __init__(self, spark: SparkSession, path: str):
        super().__init__(spark, path, "model string, pair_key string, pair double", ["model", "pair_key"])

    def through(self, pairs: DataFrame, model: str, score) -> DataFrame:
        """(qid, chunk_hash, pair) of pairs (qid, query, chunk_hash, chunk_text); only new ones go to ``score(pairs)``."""
        told = pairs.withColumns({"model": F.lit(model), "pair_key": cache_key(F.col("query"), F.col("chunk_hash"))})
        made = stored(score(self.missing(told)).select("model", "pair_key", "pair"), "pairs")
        have = self.found(told).unionByName(made).dropDuplicates(self.keys)
        if not made.isEmpty():
            self.add(made)
        return told.select("qid", "chunk_hash", "pair_key").join(have.select("pair_key", "pair"), "pair_key").select("qid", "chunk_hash", "pair")
