"""TREC run files, experiment results and reports."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.evaluation import ranked


def write_run(run: DataFrame, path: str, tag: str = "lexigraf", k: int = 1000) -> None:
    """``qid Q0 doc rank score tag`` lines, scores with six decimals, ties by id descending."""
    rows = ranked(run).filter(F.col("rank") <= k)
    line = F.concat_ws(" ", "qid", F.lit("Q0"), "doc_id", F.col("rank").cast("string"), F.format_string("%.6f", F.col("score").cast("double")), F.lit(tag))
    rows.repartitionByRange("qid").sortWithinPartitions("qid", "rank").select(line.alias("value")).write.mode("overwrite").text(path)


def read_run(spark: SparkSession, path: str) -> DataFrame:
    part = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).filter(F.trim("value") != "").select(part[0].alias("qid"), part[2].alias("doc_id"), part[3].cast("long").alias("rank"), part[4].cast("double").alias("score"))


def corpus_chunks(corpus: DataFrame) -> DataFrame:
    """Documents (id, text) as chunks, texts stripped."""
    text = F.regexp_replace("text", r"^\s+|\s+$", "")
    return corpus.select(F.col("id").alias("chunk_hash"), text.alias("text"), F.lit("snippet").alias("kind"), F.lit(1).alias("start_line"), (F.regexp_count(text, F.lit("\n")) + 1).alias("end_line"))


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("id string, title string, text string").json(path).select("id", F.trim(F.concat_ws(" ", "title", "text")).alias("text"))


def read_results(spark: SparkSession, folder: str) -> DataFrame:
    """Result files as (config, split, metric, value)."""
    rows = spark.read.option("multiLine", True).schema("config string, split string, metrics map<string,double>").json(folder)
    return rows.select("config", "split", F.explode("metrics").alias("metric", "value"))


def write_result(path: str, config: str, split: str, metrics: dict, meta: dict) -> None:
    with open(path, "w") as f:
        json.dump({"config": config, "split": split, "metrics": metrics, "meta": meta}, f, indent=2, sort_keys=True)


def report(results: DataFrame, metrics: list[str], base: str | None = None) -> DataFrame:
    """config by (split, metric), and the difference to a base configuration."""
    rows = results.filter(F.col("metric").isin(metrics))
    if base is not None:
        ref = rows.filter(F.col("config") == base).select("split", "metric", F.col("value").alias("base"))
        rows = rows.join(F.broadcast(ref), ["split", "metric"], "left").withColumn("delta", F.col("value") - F.col("base"))
        return rows.groupBy("config", "split").pivot("metric", metrics).agg(F.first("value").alias("value"), F.first("delta").alias("delta"))
    return rows.groupBy("config", "split").pivot("metric", metrics).agg(F.first("value"))


def markdown(rows: list[dict], columns: list[str]) -> str:
    show = lambda v: f"{v:.4f}" if isinstance(v, float) else "n/a" if v is None else str(v)
    head = ["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns)]
    return "\n".join(head + ["| " + " | ".join(show(r.get(c)) for c in columns) + " |" for r in rows])
