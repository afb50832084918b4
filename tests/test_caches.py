"""Caches, embedders, rerankers, and calls that are repeated."""

import pytest
from pyspark.sql import functions as F

from lexigraf import resilience
from lexigraf.operators import embedders, rerankers
from lexigraf.sources import cache


def lengths():
    """A model whose vectors tell what it was given; it writes a mark for each text."""

    def make(spec):
        def encode(texts):
            with open(spec.options["mark"], "a") as f:
                f.write("".join(f"{t!r}\n" for t in texts))
            return [[float(len(t)), 1.0] for t in texts]

        return encode

    return make


def marks(path):
    return sorted(path.read_text().splitlines()) if path.exists() else []


def test_only_missing_texts_reach_a_model(spark, tmp_path):
    mark = tmp_path / "mark"
    embedders.register(embedders.ModelSpec("lengths", "local", dim=2, document_prefix="d:", max_chars=6, options={"mark": str(mark)}), lengths())
    rows = spark.createDataFrame([(i, "x" * (i % 10)) for i in range(20)], "k long, text string")
    load = lambda **how: embedders.load(spark, "lengths", f"file://{tmp_path}/cache", **how)
    with pytest.raises(embedders.LocalModelsDisabledError):
        load(allow_local=False)(rows, "k").collect()
    first = sorted(map(tuple, load()(rows, "k").collect()))
    assert marks(mark) == sorted(repr(("d:" + "x" * i)[:6]) for i in range(10)) and len(first) == 20
    assert sorted(map(tuple, load(allow_local=False)(rows, "k").collect())) == first and len(marks(mark)) == 10
    more = rows.union(spark.createDataFrame([(99, "new")], "k long, text string"))
    assert load()(more, "k").count() == 21 and len(marks(mark)) == 11
    # few query texts leave nothing behind, many do
    few = spark.createDataFrame([(1, "q")], "k long, text string")
    for _ in range(2):
        load()(few, "k", "query").collect()
    assert marks(mark).count("'q'") == 2
    many = spark.createDataFrame([(i, f"q{i}") for i in range(8)], "k long, text string")
    for _ in range(2):
        load()(many, "k", "query").collect()
    assert marks(mark).count("'q3'") == 1


def test_services_fall_back_only_without_a_key(spark, tmp_path, monkeypatch):
    embedders.register(embedders.ModelSpec("far", "service", key_env="NO_SUCH_KEY", options={"mark": str(tmp_path / "m")}), lengths())
    monkeypatch.delenv("NO_SUCH_KEY", raising=False)
    with pytest.raises(resilience.MissingKeyError):
        embedders.load(spark, "far")
    assert embedders.load(spark, "far", fallback="hash-64").spec.name == "hash-64"
    monkeypatch.setenv("NO_SUCH_KEY", "k")
    far = embedders.load(spark, "far", fallback="hash-64")
    assert far.revision == "far@1" and far(spark.createDataFrame([(1, "abc")], "k long, text string"), "k").first()["vector"] == pytest.approx([3 / 10**0.5, 1 / 10**0.5])
    spec = embedders.ModelSpec("x", query_prefix="query: ", max_chars=9)
    shown = spark.createDataFrame([("abcdef",), ("",), (None,)], "t string").select(embedders.prepared(spec, F.col("t"), "query").alias("q"), embedders.prepared(spec, F.col("t"), "document").alias("d")).collect()
    assert [tuple(r) for r in shown] == [("query: ab", "abcdef"), ("query: ", " "), ("query: ", " ")]


def test_rerankers(spark, tmp_path):
    mark = tmp_path / "asked"

    def pair_model(spec):
        def score(pairs):
            with open(mark, "a") as f:
                f.write("p\n" * len(pairs))
            return [float(len(d)) for _, d in pairs]

        return score

    def list_model(spec):
        def reply(query, documents):
            with open(mark, "a") as f:
                f.write("l\n")
            return str(sorted(range(len(documents)), key=lambda i: -len(documents[i]))[:2])

        return reply

    rerankers.register(rerankers.ModelSpec("pairs", "local"), pair_model)
    rerankers.register(rerankers.ModelSpec("lists", "listwise"), list_model)
    queries = spark.createDataFrame([(1, "alpha beta"), (2, "gamma")], "qid long, text string")
    pool = spark.createDataFrame([(1, "a", "alpha", 1, 0.9), (1, "b", "alpha beta gamma", 2, 0.8), (1, "c", "zz", 3, 0.7), (2, "a", "alpha", 1, 0.5)], "qid long, chunk_hash string, chunk_text string, rank long, score double")
    here = f"file://{tmp_path}/cache"
    got = lambda name: {(r["qid"], r["chunk_hash"]): round(r["pair"], 6) for r in rerankers.load(spark, name, here)(queries, pool).collect()}
    assert got("overlap") == {(1, "a"): 0.5, (1, "b"): 0.666667, (1, "c"): 0.0, (2, "a"): 0.0}
    assert got("pairs") == got("pairs") == {(1, "a"): 5.0, (1, "b"): 16.0, (1, "c"): 2.0, (2, "a"): 5.0}
    assert got("lists") == got("lists") == {(1, "b"): 1.0, (1, "a"): 0.666667, (1, "c"): 0.333333, (2, "a"): 1.0}
    assert marks(mark).count("p") == 4 and marks(mark).count("l") == 2
    with pytest.raises(rerankers.LocalModelsDisabledError):
        rerankers.load(spark, "pairs", f"file://{tmp_path}/other", allow_local=False)(queries, pool).collect()


def test_key_values(spark, tmp_path):
    kv = cache.KeyValues(spark, f"file://{tmp_path}/kv")
    assert kv.get_many(["a"]) == {}
    kv.put_many({"a": "1", "b": "2"})
    kv.put_many({})
    assert kv.get_many(["a", "b", "c"]) == {"a": "1", "b": "2"} and kv.key("m", "q") != kv.key("mq", "")
    asked = spark.createDataFrame([("a",), ("z",), ("z",)], "key string")
    assert [r["key"] for r in kv.missing(asked).collect()] == ["z"] and kv.found(asked).count() == 1


def test_calls_are_repeated_while_errors_may_pass():
    slept, left = [], ["503 UNAVAILABLE", "429: retry in 7s", "timed out"]

    def call():
        if left:
            raise RuntimeError(left.pop(0))
        return "done"

    assert resilience.repeated(call, sleep=slept.append) == "done" and slept == [4.0, 8.0, 16.0]
    left[:] = ["429 retryDelay: '7s'"]
    slept.clear()
    assert resilience.repeated(call, sleep=slept.append) == "done" and slept == [8.0]
    left[:] = ["503"] * 3
    with pytest.raises(RuntimeError):
        resilience.repeated(call, attempts=2, sleep=slept.append)
    left[:] = ["bad request"]
    with pytest.raises(RuntimeError, match="bad request"):
        resilience.repeated(call, sleep=slept.append)
    left[:] = ["429 PerDay limit"]
    with pytest.raises(resilience.QuotaExhaustedError):
        resilience.repeated(call, sleep=slept.append)


def test_a_pace_spaces_calls():
    now, slept = [0.0], []

    def sleep(s):
        slept.append(s)
        now[0] += s

    pace = resilience.Pace(30, clock=lambda: now[0], sleep=sleep)
    for _ in range(3):
        pace.wait()
    assert slept == [2.0, 2.0]
    free = resilience.Pace(0, clock=lambda: now[0], sleep=sleep)
    free.wait(), free.wait()
    assert len(slept) == 2
