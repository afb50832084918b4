"""Learned classifier, trait models, learned weights and their cross-validation."""

import pytest
from pyspark.sql import functions as F

from lexigraf.operators import classify, graph, query, structural

EXAMPLES = [
    ("who calls parse_config in the loader", "dependency"), ("what depends on read_file", "dependency"), ("callers of main and its imports", "dependency"), ("which modules import utils", "dependency"),
    ("how did parse change since v1.2", "evolutionary"), ("history of the cache before release 2.0", "evolutionary"), ("when was retry removed in the last version", "evolutionary"), ("what changed between versions v1 and v2", "evolutionary"),
    ("sum of the smallest numbers in a list", "semantic"), ("find the largest city on the road", "semantic"), ("words of a text in order of length", "semantic"), ("cost of the cheapest path", "semantic"),
]


@pytest.fixture(scope="module")
def examples(spark):
    return spark.createDataFrame([(i, *e) for i, e in enumerate(EXAMPLES)], "qid long, text string, label string")


def test_classifier(spark, examples, tmp_path):
    made = classify.Classifier.fit(examples, buckets=1 << 10)
    made.save(f"file://{tmp_path}/c")
    again = classify.Classifier.load(spark, f"file://{tmp_path}/c")
    asked = spark.createDataFrame([(1, "who calls load and what depends on it"), (2, "how has it changed since version v3.1"), (3, "largest of the numbers")], "qid long, text string")
    typed = again.classify(query.parse(asked)).orderBy("qid").collect()
    assert [r["query_type"] for r in typed] == ["dependency", "evolutionary", "semantic"]
    assert all(abs(sum(r[f"p_{t}"] for t in query.TYPES) - 1) < 1e-6 and r["p_lexical"] == 0 for r in typed)
    assert [tuple(r) for r in made.classify(query.parse(asked)).orderBy("qid").select("query_type", "p_semantic").collect()] == [(r["query_type"], r["p_semantic"]) for r in typed]
    (tmp_path / "x.jsonl").write_text('{"query": "a b", "type": "semantic"}\n{"query": null, "type": "x"}\n')
    assert [(r["text"], r["label"]) for r in classify.read_examples(spark, f"file://{tmp_path}/x.jsonl").collect()] == [("a b", "semantic")]


def test_a_service_may_type_queries_and_its_failure_leaves_the_rules(spark):
    def complete(text):
        if "broken" in text:
            raise RuntimeError("no")
        return 'Sure: {"type": "Structural", "sub_queries": ["first part", " "]} done' if "ask" in text else "no idea"

    asked = spark.createDataFrame([(1, "please ask"), (2, "broken who calls f"), (3, "who calls f")], "qid long, text string")
    got = {r["qid"]: (r["query_type"], r["told_subs"]) for r in classify.analyzed(asked, complete=complete).collect()}
    assert got == {1: ("structural", ["first part"]), 2: ("dependency", []), 3: ("dependency", [])}
    typed = classify.analyzed(asked)
    assert {r["qid"] for r in typed.filter(graph.wants_graph(typed)).collect()} == {2, 3}


def test_trait_model_of_a_corpus(spark, tmp_path):
    code = {"heap": "import heapq\ndef f(a):\n    heapq.heapify(a)\n", "rec": "def fact(n):\n    return n and n * fact(n - 1)\n"}
    rows = [(f"{k}{i}", t) for k, t in code.items() for i in range(4)]
    chunks = spark.createDataFrame(rows, "chunk_hash string, text string")
    queries = spark.createDataFrame([(f"q{k}{i}", w) for k, w in (("heap", "smallest of the heap"), ("rec", "recursive factorial walk")) for i in range(4)] + [("none", "nothing answers")], "qid string, text string")
    qrels = spark.createDataFrame([(f"q{k}{i}", f"{k}{i}", 1) for k in code for i in range(4)] + [("none", "gone", 1)], "qid string, doc_id string, rel long")
    model = structural.train(queries, chunks, qrels, features=1 << 10)
    assert model.prior["heapq"] == 0.5 and model.prior["imp:heapq"] == 0.5 and set(model.models) == {"heapq", "imp:heapq", "recursion"}
    model.save(f"file://{tmp_path}/t")
    again = structural.TraitModel.load(spark, f"file://{tmp_path}/t")
    asked = spark.createDataFrame([(1, "the smallest of a heap"), (2, "a recursive walk")], "qid long, text string")
    weights = {(r["qid"], r["trait"]): r["weight"] for r in again.weights(asked).collect()}
    assert weights[1, "heapq"] > 0 > weights[2, "heapq"] and weights[2, "recursion"] > 0 > weights[1, "recursion"] and weights[1, "lambda"] == pytest.approx(0)


def test_learned_weights_choose_by_the_query(spark, tmp_path):
    rows = [(i, [float(i % 2), 1.0]) for i in range(40)]
    x = spark.createDataFrame(rows, "qid long, x array<double>")
    u = spark.createDataFrame([(i, c, 0.9 if (c == "a") == bool(i % 2) else 0.1) for i in range(40) for c in "ab"], "qid long, cell string, ndcg double")
    for kind in ("ridge", "trees"):
        model = query.LearnedWeights(kind, 2).fit(x, u)
        model.save(f"file://{tmp_path}/{kind}")
        for m in (model, query.LearnedWeights.load(spark, f"file://{tmp_path}/{kind}")):
            assert all(r["cell"] == ("a" if r["qid"] % 2 else "b") for r in m.predict(x).collect())
    rows = {r["weighting"]: r["ndcg_10"] for r in query.cross_validated(x, u, 4, variants=(("ridge", 2),))}
    assert rows["best of each query"] == pytest.approx(0.9) and rows["learned, ridge, 2 cells"] == pytest.approx(0.9) and rows["best cell in hindsight"] == pytest.approx(0.5)
    assert rows["best cell of the other folds"] <= 0.5 + 1e-9


def test_weighting_features_are_one_vector(spark):
    typed = classify.analyzed(spark.createDataFrame([(1, "read config"), (2, "none")], "qid long, text string"))
    hits = spark.createDataFrame([(1, "A", "lexical", 10.0, 1), (1, "B", "lexical", 5.0, 2), (1, "B", "semantic", 0.9, 1)], "qid long, chunk_hash string, view string, raw double, rank long")
    got = {r["qid"]: r["x"] for r in query.weighting_features(typed, hits, ["lexical", "semantic"]).collect()}
    n = len(query.FEATURES) + 6
    assert len(got[1]) == len(got[2]) == n + 12 + 1
    assert got[1][n : n + 3] == [10.0, pytest.approx(5 / 5), 7.5] and got[1][-1] == 0.1 and got[2][n:] == [0.0] * 13
    assert hits.filter(F.lit(False)).count() == 0
