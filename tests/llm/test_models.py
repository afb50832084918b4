"""Quality and language models."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from llm_helpers import SCHEMA, sentence

from lexigraf.llm import language_id, quality


def test_quality(spark, empty, clashing):
    rng = random.Random(7)
    rows, labels = [], []
    for i in range(300):
        good = i % 3 != 0
        words = sentence(rng, rng.randrange(5, 60)).split()
        rows.append((i, " ".join(w if good else w + "***" for w in words), None, None, 1))
        labels.append((i, int(good)))
    docs, marks = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int")
    model = quality.train(docs.filter("doc_id < 200"), marks.filter("doc_id < 200"), "quality")
    got = {r["doc_id"]: r["score"] for r in quality.score(docs.select("doc_id", "text"), model).collect()}
    assert np.mean([(got[i] >= 0.5) == bool(q) for i, q in labels if i >= 200]) > 0.97
    assert all(0 <= s <= 1 for s in got.values())
    assert quality.score(clashing, model).count() == clashing.count()
    none = quality.train(empty, marks.limit(0), "quality")
    assert {r["score"] for r in quality.score(docs.select("doc_id", "text"), none).collect()} == {0.5}


def test_language(spark, empty, clashing):
    rng = random.Random(9)
    alphabets = {"xx": "abcde", "yy": "aefgh"}
    rows = [(i, " ".join("".join(rng.choice(alphabets[g]) for _ in range(5)) for _ in range(rng.randrange(3, 40))), g, None, 1) for i in range(200) for g in [rng.choice(["xx", "yy"])]]
    rows += [(900, None, "xx", None, None), (901, "123 ...", None, None, 1), (902, "", "yy", None, 0), (903, "ЖЖЖЖ ЯЯЯЯ ФФФФ ЦЦЦЦ ЩЩЩЩ ЭЭЭЭ", None, None, 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    model = language_id.train(docs.filter("doc_id < 150"))
    got = {r["doc_id"]: r for r in language_id.identify(docs.select("doc_id", "text"), model).collect()}
    assert np.mean([got[r[0]]["lang_pred"] == r[2] for r in rows[150:200]]) > 0.97
    assert all(got[r[0]]["accepted"] for r in rows[:200])
    assert [got[i]["lang_pred"] for i in (900, 901, 902)] == ["und"] * 3 and not any(got[i]["accepted"] for i in (900, 901, 902, 903))
    assert language_id.identify(clashing, model).count() == clashing.count()
    none = language_id.train(empty)
    assert {r["lang_pred"] for r in language_id.identify(docs.select("doc_id", "text"), none).collect()} == {"und"}


def chance(model, context, c, j):
    """log p(c | context) from the model's arrays: the longest known string, after the back-offs of longer contexts."""
    back = 0.0
    for k in range(min(len(context) + 1, model.order), 0, -1):
        text = (context + c)[-k:]
        key = lambda t: language_id._hashes(np.array([ord(x) for x in t], np.uint32), model.order)[len(t)][-1] if t else language_id._hashes(np.array([32], np.uint32), model.order)[0][0]
        at, there = language_id._find(model.keys[k], np.array([key(text)], np.uint64))
        if there[0]:
            return back + model.logs[k][at[0], j]
        near, known = language_id._find(model.contexts[k - 1], np.array([key(text[:-1])], np.uint64))
        back += model.backs[k - 1][near[0], j] if known[0] else 0.0
    return back + model.floor


def test_probabilities_of_a_model_sum_to_one():
    model = language_id.fit({"aa": ["abc cab bac", "aab cc"], "bb": ["xyz zyx", "zz xy"]})
    every = sorted(set("abcxyz ")) + ["q"]  # q stands for what was never seen
    for j in range(2):
        for context in ("", "a", "ab", "bac", " ca", "b", "zz", "yx", "xq", "q", "ax"):
            assert sum(np.exp(chance(model, context, c, j)) for c in every) == pytest.approx(1, abs=1e-4)


def test_entropies_equal_the_chain_of_probabilities():
    model = language_id.fit({"aa": ["abc cab bac", "aab cc"], "bb": ["xyz zyx", "zz xy"]})
    for text in ("abc", "a", "zyx abc", "qqq x", "cab cab cab", "bz"):
        cost, chars = language_id.entropies(model, *language_id.codes_of(pa.array([text])))
        told = f" {text} "  # the first space is no part of a string
        for j in range(2):
            want = -sum(chance(model, told[max(1, i - model.order + 1) : i], told[i], j) for i in range(1, len(told)))
            assert cost[0, j] * chars[0] == pytest.approx(want, rel=1e-4)


def test_quality_of_awkward_rows(spark, docs):
    """Null, empty and very long texts, repeated ids, and labels of one class only."""
    rows = [(1, None, None, None, None), (2, "", None, None, 0), (3, "good words here", None, None, 1), (3, "good words here", None, None, 1), (4, "bad*** ***", None, None, 1), (5, "good words " * 40_000, None, None, 1), (None, "no id", None, None, 1)]
    frame = spark.createDataFrame(rows, SCHEMA)
    both = spark.createDataFrame([(1, 0), (3, 1), (3, 1), (4, 0), (5, 1)], "doc_id long, quality int")
    got = quality.score(frame, quality.train(frame, both, "quality")).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    for one in (0, 1):
        model = quality.train(frame, both.filter(f"quality = {one}"), "quality")
        assert {r["score"] >= 0.5 for r in quality.score(frame, model).collect()} == {one == 1}


def test_languages_with_few_texts_keep_a_model(spark):
    """One text of a language is enough for a model, whichever side of the calibration it falls on; repeated rows are treated alike."""
    for k in range(8):
        rows = [(i, "abcab bcabc cabca " * 3, "xx", None, 1) for i in range(20)] + [(100 + k, "vwxyz zyxwv wxyzv vwzyx", "yy", None, 1)] * (1 + k % 2)
        docs = spark.createDataFrame(rows, SCHEMA)
        model = language_id.train(docs)
        assert model.languages == ["xx", "yy"]
        got = [(r["lang_pred"], r["score"]) for r in language_id.identify(docs, model).collect() if r["doc_id"] >= 100]
        assert len(set(got)) == 1 and got[0][0] == "yy" and len(got) == 1 + k % 2


def test_fitting_takes_little_of_the_drivers_memory():
    """About a hundred bytes for each character of one language at a time, and not twice as many while the next begins."""
    rng = np.random.default_rng(3)
    texts = {name: ["".join(map(chr, rng.integers(97, 101, 2000))) for _ in range(50)] for name in ("aa", "bb", "cc")}
    language_id.fit({name: found[:1] for name, found in texts.items()})
    tracemalloc.start()
    language_id.fit(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 140 * sum(map(len, texts["aa"]))
