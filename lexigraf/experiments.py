"""Runs over a judged collection: splits, searches with times, result files, ladders of configurations."""

from __future__ import annotations

import dataclasses
import json
import os
import platform
import random
import subprocess
import time
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import Settings, load, read
from .operators import evaluation
from .pipeline import Pipeline
from .resilience import MissingKeyError, QuotaExhaustedError
from .session import stored
from .sources import runs


@dataclass
class Collection:
    """corpus (id, text), queries (qid, text, split) and qrels (qid, doc_id, rel).  The training queries are parted into
    ``fit`` and ``dev`` by a seeded shuffle; ``dev_stdin`` are those of dev whose gold documents read standard input."""

    corpus: DataFrame
    queries: DataFrame
    qrels: DataFrame
    revision: str = "unknown"

    def split(self, name: str, final: bool = False) -> tuple[DataFrame, DataFrame]:
        """(queries, qrels) of fit, dev, dev_stdin or test; test needs ``final``."""
        evaluation.guard(name, final)
        if name == "test":
            chosen = self.queries.filter("split = 'test'")
        else:
            training = self.queries.filter("split = 'train'")
            fit, dev = evaluation.split_ids([r["qid"] for r in training.select("qid").collect()])  # ids of the query set
            ids = self.queries.sparkSession.createDataFrame([(i,) for i in (fit if name == "fit" else dev)], training.select("qid").schema)
            chosen = training.join(ids, "qid", "left_semi")
            if name == "dev_stdin":
                gold = evaluation.reads_stdin(self.corpus).select(F.col("id").alias("doc_id"))
                chosen = chosen.join(self.qrels.filter("rel > 0").join(gold, "doc_id", "left_semi").select("qid").distinct(), "qid", "left_semi")
        chosen = chosen.select("qid", "text")
        return chosen, self.qrels.join(chosen.select("qid"), "qid", "left_semi")


def read_collection(spark: SparkSession, folder: str) -> Collection:
    """corpus.jsonl (id, title, text), queries.jsonl (qid, text, split), qrels.jsonl (qid, doc_id, rel), and revision.txt if there is one."""
    from pyspark.errors import AnalysisException

    try:
        revision = spark.read.text(f"{folder}/revision.txt").first()[0].strip()
    except AnalysisException:
        revision = "unknown"
    return Collection(
        runs.read_corpus(spark, f"{folder}/corpus.jsonl"), spark.read.schema("qid string, text string, split string").json(f"{folder}/queries.jsonl"),
        spark.read.schema("qid string, doc_id string, rel long").json(f"{folder}/qrels.jsonl"), revision,
    )


def set_seed(seed: int) -> None:
    random.seed(seed)
    np.random.seed(seed)


def git_sha(folder: str = ".") -> str:
    found = subprocess.run(["git", "-c", "safe.directory=*", "-C", folder, "rev-parse", "--short", "HEAD"], capture_output=True, text=True)
    return found.stdout.strip() or "unknown"


def run_search(search, queries: DataFrame, k: int = 100, batch: int = 64) -> tuple[DataFrame, DataFrame]:
    """(run, times): results (qid, doc_id, score) of ``search(queries, k)`` in batches of about ``batch`` queries by a hash of
    their ids, and (qid, ms), a batch's time shared by its queries."""
    count = queries.count()
    parts, out, times = max(1, -(-count // batch)), None, []
    for i in range(parts):
        some = queries.filter(F.pmod(F.xxhash64("qid"), F.lit(parts)) == i)
        ids = [r["qid"] for r in some.select("qid").collect()]  # of the query set
        if not ids:
            continue
        began = time.perf_counter()
        found = stored(search(some, k).select("qid", F.col("chunk_hash").alias("doc_id"), "score"), "run")
        times += [(q, 1000 * (time.perf_counter() - began) / len(ids)) for q in ids]
        out = found if out is None else out.unionByName(found)
    kind = dict(queries.dtypes)["qid"]
    spark = queries.sparkSession
    return out if out is not None else spark.createDataFrame([], f"qid {kind}, doc_id string, score double"), spark.createDataFrame(times, f"qid {kind}, ms double")


def restricted(search, candidates: DataFrame):
    """``search`` whose results are only among each query's candidates (qid, doc_id), as where a benchmark gives its own first stage."""

    def run(queries: DataFrame, k: int) -> DataFrame:
        wanted = candidates.select("qid", F.col("doc_id").alias("chunk_hash")).distinct()
        most = wanted.groupBy("qid").count().agg(F.max("count")).first()[0] or 0
        return search(queries, max(k, most)).join(wanted, ["qid", "chunk_hash"], "left_semi")

    return run


def run_experiment(spark: SparkSession, settings: Settings, data: Collection, folder: str, split: str = "dev", final: bool = False, k: int = 100, most_queries: int | None = None, **parts) -> dict:
    """Build, search, score; the result and the run are written to ``folder`` on the driver."""
    set_seed(settings.seed)
    queries, qrels = data.split(split, final)
    if most_queries:
        queries = queries.orderBy("qid").limit(most_queries)
        qrels = qrels.join(queries.select("qid"), "qid", "left_semi")
    began = time.perf_counter()
    pipe = Pipeline(settings, runs.corpus_chunks(data.corpus), **parts)
    if "lexical" in settings.views:
        pipe.index.postings.count()
    if "semantic" in settings.views:
        pipe.vectors.count()
    built = time.perf_counter() - began
    run, times = run_search(pipe.search, queries, k)
    metrics = {m: v for m, v in evaluation.evaluate(run, qrels, (1, 10, 100)).first().asDict().items() if m != "n_queries"}
    metrics |= {f"latency_{m}_ms": v for m, v in evaluation.latency(times, "ms").first().asDict().items()}
    meta = {
        "git_sha": git_sha(), "config_hash": settings.digest(), "dataset_revision": data.revision, "models": pipe.metadata(), "seed": settings.seed,
        "python": platform.python_version(), "timestamp": time.strftime("%Y-%m-%dT%H:%M:%S"), "index_seconds": built, "n_queries": queries.count(), "settings": dataclasses.asdict(settings),
    }
    stem = f"{settings.name}__{split}" + (f"__n{most_queries}" if most_queries else "")
    os.makedirs(folder, exist_ok=True)
    runs.write_result(f"{folder}/{stem}.json", settings.name, split, metrics, meta)
    runs.write_run(run, f"file://{os.path.abspath(folder)}/{stem}.trec", settings.name)
    return {"config": settings.name, "split": split, "metrics": metrics, "meta": meta}


@dataclass
class Rung:
    label: str
    settings: Settings
    splits: list[str]
    service: bool = False  # asks a service, so may be left out
    base: str | None = None  # what its difference is taken to


@dataclass
class Ladder:
    rungs: list[Rung]
    splits: list[str] = field(default_factory=lambda: ["dev"])
    not_run: list[dict] = field(default_factory=list)

    @classmethod
    def load(cls, path: str) -> Ladder:
        """A file with ``ladder`` (label, config, splits, service, base), ``splits`` and ``not_run``; a rung's base is the one before it."""
        told, here = read(path), os.path.dirname(path)
        splits, out, before = told.get("splits", ["dev"]), [], None
        for r in told["ladder"]:
            out.append(Rung(r["label"], load(os.path.join(here, r["config"]), r.get("overrides")), r.get("splits", splits), bool(r.get("service")), r.get("base", before)))
            before = r["label"]
        return cls(out, splits, told.get("not_run", []))


def climb(ladder: Ladder, experiment, folder: str, final: bool = False, without_services: bool = False, force: bool = False) -> dict[tuple[str, str], dict | str]:
    """{(label, split): result, or why there is none}.  ``experiment(settings, split)`` runs one; a result file of the same
    settings is used again, but never for the test split."""
    out: dict[tuple[str, str], dict | str] = {}
    for rung in ladder.rungs:
        for split in ["test"] if final else rung.splits:
            at = f"{folder}/{rung.settings.name}__{split}.json"
            if rung.service and without_services:
                out[rung.label, split] = "left out (service)"
                continue
            if not force and not final and os.path.exists(at):
                with open(at) as f:
                    known = json.load(f)
                if known.get("meta", {}).get("config_hash") == rung.settings.digest():
                    out[rung.label, split] = known
                    continue
            try:
                out[rung.label, split] = experiment(rung.settings, split)
            except MissingKeyError:
                out[rung.label, split] = "left out (no key)"
            except QuotaExhaustedError:
                out[rung.label, split] = "left out (quota)"
    return out


def rendered(ladder: Ladder, results: dict, final: bool = False, metrics: tuple[str, str] = ("ndcg_10", "recall_100")) -> str:
    """A table: a row for each rung, per split the metrics and the first one's difference to the base, then the median time."""
    splits = ["test"] if final else ladder.splits
    value = lambda label, split: results[label, split]["metrics"].get(metrics[0]) if isinstance(results.get((label, split)), dict) else None
    rows = []
    for rung in ladder.rungs:
        row = {"component": rung.label}
        for split in splits:
            got = results.get((rung.label, split))
            if not isinstance(got, dict):
                row[f"{split} {metrics[0]}"], row[f"{split} {metrics[1]}"] = got or "n/a", ""
                continue
            own, base = value(rung.label, split), value(rung.base, split)
            row[f"{split} {metrics[0]}"] = f"{own:.4f}" + (f" ({own - base:+.4f})" if base is not None else "")
            row[f"{split} {metrics[1]}"] = got["metrics"].get(metrics[1])
            row.setdefault("p50", f"{got['metrics'].get('latency_p50_ms', 0.0):.1f} ms")
        rows.append({"p50": "", **row})
    for none in ladder.not_run:
        rows.append({"component": none["label"], "p50": none.get("reason", ""), **{f"{s} {m}": "n/a" if i == 0 else "" for s in splits for i, m in enumerate(metrics)}})
    return runs.markdown(rows, ["component", *[f"{s} {m}" for s in splits for m in metrics], "p50"]) + "\n"


def tune_bm25(chunks: DataFrame, queries: DataFrame, qrels: DataFrame, k1s=(0.6, 0.9, 1.2, 1.5, 1.8), bs=(0.3, 0.5, 0.75, 0.9), k: int = 100) -> list[dict]:
    """nDCG@10 over k1, b and stemming; each index is scored once for all cells.  The best first."""
    from .functions.stemmer import stemmed_code_tokens
    from .functions.text import code_terms
    from .operators import lexical

    out = []
    for stem in (True, False):
        tokens = stemmed_code_tokens if stem else code_terms
        asked = lexical.query_terms(queries, tokens).persist()
        found = lexical.tune(lexical.index_chunks(chunks, tokens=tokens, only=asked), queries, k, list(k1s), list(bs), asked).persist()
        for cell in found.select("k1", "b").distinct().collect():  # cells of the grid
            run = found.filter((F.col("k1") == cell["k1"]) & (F.col("b") == cell["b"])).select("qid", F.col("chunk_hash").alias("doc_id"), F.col("raw").alias("score"))
            out.append({"k1": cell["k1"], "b": cell["b"], "stem": stem, "ndcg_10": evaluation.evaluate(run, qrels, (10,)).first()["ndcg_10"]})
        found.unpersist()
    return sorted(out, key=lambda r: (-(r["ndcg_10"] or 0.0), r["k1"], r["b"], r["stem"]))
