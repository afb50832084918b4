"""The corpus pipeline: documents in, shards out, each stage one operator.

``STAGES`` are (name, function); a function takes (spark, docs, sf_dir) and gives a frame
that is written as Parquet and read again as the next stage's ``docs``.  All but the last
give the columns of documents.  Every stage works on all that the one before has kept:

- language: documents go that are no text in a learned language (``und`` or rejected);
- near_duplicates: one document of each class of copies and near copies stays;
- decontaminate: documents that hold a benchmark passage go;
- mix: sources are brought to their target weights; a document comes as often as the mix
  takes it, which may be never;
- shard: documents get shards and slots; copies stay together.

Documents with null or empty texts go in the first stage.  Empty tables pass through all
stages as empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexigraf.llm import decontaminate, jaccard_join, language_id, mixing, sharding
from lexigraf.llm.common import new_path, prepare, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return language_id.accepted(docs, language_id.train(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return jaccard_join.one_of_each(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return mixing.mix(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return sharding.shard_documents(docs)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontaminate", decontaminated), ("mix", mix), ("shard", shard)]

#: SQL has neither the language models nor the alignment; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        path = new_path(spark, f"pipeline-{name}")
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs


