"""Steps that grew faster than their input, or cost too much for each row: the same results by other means."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexigraf.functions import text as T
from lexigraf.operators import dense, lexical


def plan(frame) -> str:
    return frame._jdf.queryExecution().toString().split("== Physical Plan ==")[1]


def texts(n: int, seed: int = 3) -> list[str]:
    rng = random.Random(seed)
    return ["".join(rng.choice("abTHEthe_019 .é\nIsAiN") for _ in range(rng.randrange(40))) for _ in range(n)]


@pytest.mark.parametrize("expression", [T.code_terms, T.plain_tokens])
def test_tokens_of_columns_equal_the_expressions(spark, expression):
    from lexigraf.functions import tokens

    rows = ["", "12ab_c", "parseHTTPResponse_v2 the IF A1B2", *texts(200)]
    want = [sorted(r[0]) for r in spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i long, t string").coalesce(1).orderBy("i").select(expression("t")).collect()]
    column = pa.array(["x", *rows]).slice(1)
    got = [[] for _ in rows]
    for start, n in tokens.slices(column, 100):
        listed, row = tokens.BY[expression](column.slice(start, n))
        for t, r in zip(listed.to_pylist(), row.tolist(), strict=True):
            got[start + r].append(t)
    assert [sorted(x) for x in got] == want


def test_views_shuffle_no_tokens(spark):
    docs = spark.createDataFrame([(f"d{i}", t) for i, t in enumerate(texts(60))], "chunk_hash string, text string")
    embedded = dense.hash_embed(docs, "chunk_hash")
    assert "Generate" not in plan(embedded) and "hashpartitioning" not in plan(embedded)
    lists = {r[0]: r[1] for r in dense._embed_lists(docs, "chunk_hash", "text", 64, T.plain_tokens).collect()}
    assert lists == {r[0]: r[1] for r in embedded.collect()} and len(lists) > 30
    index = lexical.index_chunks(docs)
    assert "Generate" not in plan(index.postings) and "hashpartitioning" not in plan(index.postings)


def test_a_task_sends_on_what_can_be_among_the_best(spark):
    """Of rising scores in many batches all leave, of falling ones only the first; ranks are those of brute force."""
    docs = spark.createDataFrame([(i, [1.0, (5000 - i) / 50.0]) for i in range(5000)], "chunk_hash long, vector array<double>").coalesce(1)
    asked = spark.createDataFrame([(1, [0.0, 1.0])], "qid long, vector array<double>")
    found = dense.search(asked, docs, 3)
    assert [r["chunk_hash"] for r in found.orderBy("rank").collect()] == [0, 1, 2]


def test_native_search_bounds_what_is_sorted(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(i, [float(rng.randrange(-1, 2)) for _ in range(5)]) for i in range(120)]  # many ties
    docs = spark.createDataFrame(rows, "chunk_hash long, vector array<double>")
    asked = docs.filter("chunk_hash % 6 = 0").withColumnRenamed("chunk_hash", "qid")
    want = {(r["qid"], r["rank"]): (r["chunk_hash"], round(r["raw"], 9)) for r in dense.search(asked, docs, 7).collect()}
    for first, block, terms in ((16, 8, 256), (16, 4096, 2), (4096, 4096, 256)):
        monkeypatch.setattr(dense, "FIRST", first)
        monkeypatch.setattr(dense, "BLOCK", block)
        monkeypatch.setattr(dense, "TERMS", terms)
        assert {(r["qid"], r["rank"]): (r["chunk_hash"], round(r["raw"], 9)) for r in dense.search_native(asked, docs, 7).collect()} == want


def test_searches_of_an_index_and_of_texts_agree(spark, monkeypatch):
    docs = spark.createDataFrame([(f"d{i}", t) for i, t in enumerate(texts(150, 5))], "chunk_hash string, text string")
    asked = spark.createDataFrame([(i, t) for i, t in enumerate(texts(20, 6))], "qid long, text string")
    shown = lambda f: sorted((r["qid"], r["rank"], r["chunk_hash"], round(r["raw"], 9)) for r in f.collect())
    index = lexical.index_chunks(docs)
    want = shown(lexical.top(lexical.scores(index, lexical.query_terms(asked)), 5))
    assert want
    monkeypatch.setattr(lexical, "CHUNKS_AT_ONCE", 16)
    assert shown(lexical.search_chunks(docs, asked, 5)) == want
    assert shown(lexical.search(index, asked, 5)) == want
    tuned = lexical.tune(index, asked, 5, [1.2, 0.9], [0.75])
    assert "Expand" not in plan(tuned) and "MapInArrow" in plan(tuned)
    assert shown(tuned.filter("k1 = 1.2")) == want
    assert shown(tuned.filter("k1 = 0.9")) == shown(lexical.top(lexical.scores(index, lexical.query_terms(asked), 0.9), 5))


def test_one_query_scores_no_other_postings(spark):
    docs = spark.createDataFrame([(f"d{i}", t) for i, t in enumerate(texts(80))], "chunk_hash string, text string")
    one = spark.createDataFrame([(1, "the ab TH 01")], "qid long, text string")
    index = lexical.index_chunks(docs)
    found = lexical.scores(index, lexical.query_terms(one))
    scored = lexical.score_all(index, one)
    assert "BroadcastHashJoin" in plan(scored)
    got = {r[0]: round(r[1], 9) for r in scored.collect()}
    assert len(got) == 80 and {k: v for k, v in got.items() if v} == {r["chunk_hash"]: round(r["raw"], 9) for r in found.filter(F.col("raw") > 0).collect()}


@pytest.mark.parametrize("own", [True, False])
def test_similar_pairs_in_small_units(spark, monkeypatch, own):
    """Many parts, pairs listed a few at a time, and groups of sets that share much dealt in blocks, against brute force."""
    from lexigraf.operators import lineage

    rng = random.Random(8)
    base = [rng.sample(range(3000), 40) for _ in range(4)]
    sets = {i: {str(x) for x in rng.sample(base[i % 4], rng.randrange(20, 41))} | {f"{i}-{j}" for j in range(rng.randrange(12))} | {"often"} for i in range(90)}
    frame = spark.createDataFrame([(f"s{i}", "x" if i % 8 else None, sorted(v)) for i, v in sets.items()], "id string, language string, items array<string>")
    for name, value in (("LISTED", 50), ("MET", 64), ("UNIT", 20), ("HELD", 4)):
        monkeypatch.setattr(lineage, name, value)
    found = lineage.similar_pairs(frame) if own else lineage.similar_pairs(frame, frame)
    got = sorted((*(sorted((r["old"], r["new"])) if own else (r["old"], r["new"])), round(r["similarity"], 9)) for r in found.collect())
    alike = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in sets for b in sets if bool(a % 8) == bool(b % 8)}
    want = sorted((*(sorted((f"s{a}", f"s{b}")) if own else (f"s{a}", f"s{b}")), round(s, 9)) for (a, b), s in alike.items() if s >= 0.5 and (a < b or not own))
    assert got == want and len(want) > 100


def test_graph_view_keeps_a_symbols_first_chunks(spark):
    from lexigraf.operators import graph

    rng = random.Random(2)
    symbols = spark.createDataFrame([(f"c{i:03}", f"n{rng.randrange(6)}") for i in range(200)], "chunk_hash string, symbol_id string")
    edges = spark.createDataFrame([(f"n{i}", f"n{(i * 2 + 1) % 6}", k) for i in range(6) for k in ("calls", "imports")], "src string, dst string, kind string")
    seeds = spark.createDataFrame([(q, f"c{rng.randrange(200):03}", rng.random()) for q in range(4) for _ in range(3)], "qid long, chunk_hash string, score double")
    rows = lambda f: sorted(map(tuple, f.filter("rank <= 5").collect()))
    assert rows(graph.graph_view(seeds, symbols, edges, k=5)) == rows(graph.graph_view(seeds, symbols, edges))


def test_evolution_reads_only_lineages_of_candidates(spark):
    from lexigraf.operators import rank

    asked = spark.createDataFrame([(1, ["a", "b"], ["v1"])], "qid long, tokens array<string>, refs array<string>")
    pool = spark.createDataFrame([(1, "c", "l1", 1), (1, "d", None, 2)], "qid long, chunk_hash string, lineage_id string, rank long")
    nodes = spark.createDataFrame([("l1", "v1", "modified", ["a"]), ("l2", "v1", "modified", ["a", "b"])], "lineage_id string, version_id string, change_type string, message_tokens array<string>")
    view = rank.evolution_view(asked, pool, nodes, spark.createDataFrame([], "version_id string, tag string"))
    assert view._jdf.queryExecution().optimizedPlan().toString().count("LeftSemi") > 1  # of tokens, and of lineages
    assert [(r["chunk_hash"], round(r["raw"], 6)) for r in view.collect()] == [("c", 0.5 + 0.5 + 0.1)]
