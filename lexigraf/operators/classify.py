"""A learned query classifier beside the rules: words and word pairs by log-scaled tf-idf, and the parser's features."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, NGram, Normalizer, RegexTokenizer, SQLTransformer, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import json_object_in
from .query import FEATURES, TYPES, parse, rule_classified

BUCKETS, STRENGTH, ROUNDS = 1 << 16, 4.0, 200
#: Each gram as often as 1 + the whole part of log2 of its count.
LOGGED = (
    "flatten(transform(array_distinct(concat(one, two)), g -> "
    "array_repeat(g, 1 + cast(floor(log2(size(filter(concat(one, two), x -> x = g)))) as int))))"
)


def tfidf_stages(out: str, buckets: int = BUCKETS, least: int = 1) -> list:
    """Stages from ``text`` to a unit vector of words and word pairs that at least ``least`` texts have, by tf-idf.  Of a word's
    repeats those at powers of two enter, so its count grows with the logarithm."""
    return [
        RegexTokenizer(inputCol="text", outputCol="one", pattern=r"\W+", minTokenLength=2),
        NGram(n=2, inputCol="one", outputCol="two"),
        SQLTransformer(statement=f"SELECT *, {LOGGED} AS grams FROM __THIS__"),
        HashingTF(inputCol="grams", outputCol="tf", numFeatures=buckets),
        IDF(inputCol="tf", outputCol="weighed", minDocFreq=least),
        Normalizer(inputCol="weighed", outputCol=out),
    ]


def read_examples(spark: SparkSession, path: str) -> DataFrame:
    """Training rows (qid, text, label) from JSON lines with ``query`` and ``type``."""
    rows = spark.read.schema("query string, type string").json(path).filter("query is not null and type is not null")
    return rows.select(F.xxhash64("query", "type").alias("qid"), F.col("query").alias("text"), F.col("type").alias("label"))


class Classifier:
    def __init__(self, model: PipelineModel, labels: list[str]):
        self.model, self.labels = model, labels

    @classmethod
    def fit(cls, rows: DataFrame, buckets: int = BUCKETS, strength: float = STRENGTH) -> Classifier:
        """rows: (qid, text, label)."""
        parsed = parse(rows.select("qid", "text", "label")).persist()
        n = max(1, parsed.count())
        index = StringIndexer(inputCol="label", outputCol="y", stringOrderType="alphabetAsc").fit(parsed)
        stages = [*tfidf_stages("words_x", buckets), VectorAssembler(inputCols=["words_x", *FEATURES], outputCol="x")]
        learner = LogisticRegression(featuresCol="x", labelCol="y", maxIter=ROUNDS, regParam=1 / (strength * n), standardization=False, probabilityCol="p")
        fitted = Pipeline(stages=[*stages, learner]).fit(index.transform(parsed))
        parsed.unpersist()
        return cls(fitted, list(index.labels))

    def classify(self, parsed: DataFrame) -> DataFrame:
        """``parsed`` with p_<type> and query_type, as the rules give them; types that were never seen have probability 0."""
        told = self.model.transform(parsed).withColumn("_p", vector_to_array("p"))
        share = {label: F.col("_p")[i] for i, label in enumerate(self.labels)}
        best = F.element_at(F.array(*[F.lit(x) for x in self.labels]), F.array_position("_p", F.array_max("_p")).cast("int"))
        told = told.withColumns({f"p_{t}": share.get(t, F.lit(0.0)) for t in TYPES})
        return told.withColumn("query_type", best).select(*parsed.columns, *[f"p_{t}" for t in TYPES], "query_type")

    def save(self, path: str) -> None:
        spark = SparkSession.active()
        self.model.write().overwrite().save(f"{path}/model")
        spark.createDataFrame([(json.dumps(self.labels),)], "labels string").write.mode("overwrite").json(f"{path}/labels")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Classifier:
        labels = json.loads(spark.read.schema("labels string").json(f"{path}/labels").first()[0])
        return cls(PipelineModel.load(f"{path}/model"), labels)


def analyzed(queries: DataFrame, classifier: Classifier | None = None, complete=None) -> DataFrame:
    """Queries (qid, text) parsed and typed: by a learned classifier if there is one, else by rules.  ``complete`` is asked
    for each query's type and sub-queries; what can't be read of its reply leaves the rules' answer."""
    parsed = parse(queries)
    typed = classifier.classify(parsed) if classifier is not None else rule_classified(parsed)
    if complete is None:
        return typed.withColumn("told_subs", F.array().cast("array<string>"))
    return asked(typed, complete)


def asked(typed: DataFrame, complete) -> DataFrame:
    """``typed`` with what ``complete(text)`` replies, a JSON object with ``type`` and ``sub_queries`` somewhere in it."""
    @F.pandas_udf("string")
    def ask(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            out = []
            for text in part:
                try:
                    out.append(complete(text))
                except Exception:  # whatever a service fails with, the rules stand
                    out.append(None)
            yield pd.Series(out, index=part.index, dtype=object)

    reply = F.from_json(json_object_in("_reply"), "type string, sub_queries array<string>")
    told = typed.withColumn("_reply", ask("text")).withColumn("_told", reply)
    known = F.lower("_told.type").isin(*TYPES, "mixed")
    return told.withColumns(
        {
            "query_type": F.when(known, F.lower("_told.type")).otherwise(F.col("query_type")),
            "told_subs": F.coalesce(F.filter("_told.sub_queries", lambda s: F.trim(s) != ""), F.array().cast("array<string>")),
        }
    ).drop("_reply", "_told")
