"""Evaluation commands: ``python -m lexigraf.eval_cli COMMAND``.

A collection is a folder of JSON lines (see ``experiments.read_collection``).  Commands
print a table and write what they learn; none of them touches the test split without
``--final``.
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import functions as F

from . import experiments, pipeline
from .config import load
from .operators import classify, evaluation, fusion, query, structural
from .session import session
from .sources import runs


def _table(rows: list[dict]) -> str:
    columns = list(dict.fromkeys(k for r in rows for k in r))
    return runs.markdown([{k: json.dumps(v) if isinstance(v, dict) else v for k, v in r.items()} for r in rows], columns)


def _hits(spark, got):
    """(pipeline, queries, qrels, hits of its views)"""
    settings, data = load(got.config, got.set), experiments.read_collection(spark, got.data)
    queries, qrels = data.split(got.split, got.final)
    pipe = pipeline.Pipeline(settings, runs.corpus_chunks(data.corpus))
    return pipe, queries, qrels, pipe.first_stage(queries, settings.first_stage_k).persist()


def run(spark, got):
    out = experiments.run_experiment(spark, load(got.config, got.set), experiments.read_collection(spark, got.data), got.out, got.split, got.final, most_queries=got.most)
    return _table([{"config": out["config"], "split": out["split"], **out["metrics"]}])


def sweep(spark, got):
    data = experiments.read_collection(spark, got.data)
    rows = [experiments.run_experiment(spark, load(c, got.set), data, got.out, got.split, got.final) for c in got.config.split(",")]
    return _table([{"config": r["config"], "split": r["split"], **r["metrics"]} for r in rows])


def table(spark, got):
    rows = runs.report(runs.read_results(spark, got.out), got.metrics.split(","), got.base)
    return _table([r.asDict() for r in rows.orderBy("split", "config").collect()])


def crosscheck(spark, got):
    """A run file scored here against what its result file says."""
    data = experiments.read_collection(spark, got.data)
    _, qrels = data.split(got.split, got.final)
    scored = evaluation.evaluate(runs.read_run(spark, got.run), qrels, (1, 10, 100)).drop("n_queries")
    told = runs.read_results(spark, got.out).filter((F.col("config") == got.name) & (F.col("split") == got.split)).groupBy().pivot("metric").agg(F.first("value"))
    rows = [r.asDict() for r in evaluation.crosscheck(scored, told.select(*scored.columns)).collect()]
    if not all(r["agrees"] for r in rows):
        raise SystemExit(_table(rows))
    return _table(rows)


def tune_bm25(spark, got):
    pipe, queries, qrels, _ = _hits(spark, got)
    return _table(experiments.tune_bm25(pipe.chunks, queries, qrels)[:10])


def tune_fusion(spark, got):
    _, _, qrels, hits = _hits(spark, got)
    cells = [{"lexical": w / 10, "semantic": 1 - w / 10} for w in range(1, 9)]
    return _table(pipeline.tune_fusion(hits, qrels, cells))


def train_structural(spark, got):
    data = experiments.read_collection(spark, got.data)
    queries, qrels = data.split("fit")
    structural.train(queries, runs.corpus_chunks(data.corpus), qrels).save(got.model)
    return f"written to {got.model}"


def tune_structural(spark, got):
    pipe, queries, qrels, hits = _hits(spark, got)
    pool = fusion.fuse(hits, pipe.settings.fusion, fusion.weights_frame(spark, pipe.settings.weights), views=len(pipe.settings.views))
    more = structural.rescore(pool, pipe.traits, structural.TraitModel.load(spark, got.model).weights(queries))
    return _table(pipeline.tune_structural(hits.unionByName(more), qrels, {v: w for v, w in pipe.settings.weights.items() if v in pipe.settings.views}))


def train_classifier(spark, got):
    classify.Classifier.fit(classify.read_examples(spark, got.data)).save(got.model)
    return f"written to {got.model}"


def tune_adaptive(spark, got):
    """Ways to choose weights, cross-validated, and a model of the best learned one."""
    pipe, queries, qrels, hits = _hits(spark, got)
    views = [v for v in pipe.settings.views if v in pipeline.FIRST]
    typed = pipe.analyze(queries)
    x, u = query.weighting_features(typed, hits, views), query.cell_utilities(hits, qrels, query.simplex_grid(spark, views)).persist()
    rows = query.cross_validated(x, u, got.folds, pipe.settings.seed)
    scored = lambda w: evaluation.evaluate(fusion.weighted(hits, w).select("qid", F.col("chunk_hash").alias("doc_id"), "score"), qrels, (10,)).first()["ndcg_10"]
    rows.append({"weighting": "settings", "ndcg_10": scored(fusion.weights_frame(spark, pipe.settings.weights))})
    rows.append({"weighting": "rules", "ndcg_10": scored(query.rule_weights(typed, views))})
    best = max((r for r in rows if "kind" in r), key=lambda r: r["ndcg_10"])
    query.LearnedWeights(best["kind"], best["top_cells"]).fit(x, u).save(got.model)
    return _table(sorted(rows, key=lambda r: -r["ndcg_10"]))


def ablate(spark, got):
    ladder, data = experiments.Ladder.load(got.config), experiments.read_collection(spark, got.data)
    one = lambda settings, split: experiments.run_experiment(spark, settings, data, got.out, split, got.final)
    return experiments.rendered(ladder, experiments.climb(ladder, one, got.out, got.final, got.without_services, got.force), got.final)


def submit(spark, got):
    """The scores of the test split in one file, as a benchmark takes them."""
    out = experiments.run_experiment(spark, load(got.config, got.set), experiments.read_collection(spark, got.data), got.out, "test", got.final)
    with open(f"{got.out}/{out['config']}__submission.json", "w") as f:
        json.dump({"model": out["config"], "revision": out["meta"]["dataset_revision"], "scores": out["metrics"], "settings": out["meta"]["settings"]}, f, indent=2)
    return _table([out["metrics"]])


def question(text: str | None, path: str | None, stdin) -> str:
    """A problem from an argument, a file, or standard input up to its end (or a line with only a dot, where it is typed)."""
    if text:
        return text
    if path:
        with open(path) as f:
            return f.read()
    lines = []
    for line in stdin:
        if stdin.isatty() and line.strip() == ".":
            break
        lines.append(line)
    return "".join(lines)


def ask(spark, got):
    """The best documents for one problem."""
    settings, data = load(got.config, got.set), experiments.read_collection(spark, got.data)
    text = question(got.text, got.file, sys.stdin)
    pipe = pipeline.Pipeline(settings, runs.corpus_chunks(data.corpus))
    rows = pipe.search(spark.createDataFrame([("asked", text)], "qid string, text string"), got.k).orderBy("rank").collect()
    return "\n".join(f"{r['rank']}. {r['chunk_hash']}  {r['score']:.4f}\n{r['snippet']}" for r in rows) or "nothing found"


COMMANDS = {
    "ablate": ablate, "ask": ask, "crosscheck": crosscheck, "run": run, "submit": submit, "sweep": sweep, "table": table, "train-classifier": train_classifier,
    "train-structural": train_structural, "tune-adaptive": tune_adaptive, "tune-bm25": tune_bm25, "tune-fusion": tune_fusion, "tune-structural": tune_structural,
}


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="lexigraf-eval")
    sub = out.add_subparsers(dest="what", required=True)
    for name in COMMANDS:
        p = sub.add_parser(name)
        p.add_argument("--data", help="folder of the collection, or the examples of a classifier")
        p.add_argument("--config")
        p.add_argument("--set", action="append", default=[], help="a.b=value")
        p.add_argument("--split", default="dev", choices=["fit", "dev", "dev_stdin", "test"])
        p.add_argument("--final", action="store_true")
        p.add_argument("--out", default="results")
        p.add_argument("--model", default="model")
        if name == "run":
            p.add_argument("--most", type=int)
        if name == "ask":
            p.add_argument("text", nargs="?")
            p.add_argument("--file")
            p.add_argument("-k", type=int, default=5)
        if name == "table":
            p.add_argument("--metrics", default="ndcg_10,mrr_10,recall_100")
            p.add_argument("--base")
        if name == "crosscheck":
            p.add_argument("--run", required=True)
            p.add_argument("--name", required=True)
        if name == "tune-adaptive":
            p.add_argument("--folds", type=int, default=5)
        if name == "ablate":
            p.add_argument("--without-services", action="store_true")
            p.add_argument("--force", action="store_true")
    return out


def main(args: list[str] | None = None) -> None:
    got = parser().parse_args(args)
    print(COMMANDS[got.what](session("eval"), got))


if __name__ == "__main__":
    main()
