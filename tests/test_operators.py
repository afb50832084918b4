"""Operators on small inputs with known results."""

import math

import pytest
from pyspark.sql import functions as F

from lexigraf.functions import text as T
from lexigraf.operators import dense, evaluation, fusion, graph, lexical, lineage, query, rank, structural


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "name, pieces",
    [("parseHTTPResponse_v2", ["parse", "http", "response", "v", "2"]), ("read_file", ["read", "file"]), ("x", ["x"]), ("__init__", ["init"])],
)
def test_split_identifier(spark, name, pieces):
    assert one(spark, T.split_identifier("t"), t=name) == pieces


def test_code_tokens_keep_names_and_drop_stop_words(spark):
    assert one(spark, T.code_tokens("t"), t="the parse_config of isValid 42") == ["parse_config", "parse", "config", "isvalid", "valid", "42"]


def test_plain_tokens(spark):
    assert one(spark, T.plain_tokens("t"), t="readFile the_end x9Y") == ["read", "file", "the", "end", "x9", "y"]


def test_head_tail_and_shingles(spark):
    assert one(spark, T.head_tail("t", 10), t="a" * 7 + "-" * 20 + "zzz") == "a" * 7 + "\n...\n" + "zzz"
    assert one(spark, T.shingles("t", "n"), t="def load(a)", n="x.load") == ["def \0 (", "\0 ( a", "( a )"]
    assert one(spark, T.shingles("t"), t="a b") == ["a b"]


def corpus(spark):
    return spark.createDataFrame([("a", "parse the config file"), ("b", "open a socket"), ("c", "")], "chunk_hash string, text string")


def test_bm25_values(spark):
    asked = spark.createDataFrame([(1, "config config"), (2, "the of"), (3, "unknownword")], "qid long, text string")
    hits = lexical.search(lexical.index_chunks(corpus(spark)), asked, 10).collect()
    assert [(h["qid"], h["chunk_hash"], h["rank"]) for h in hits] == [(1, "a", 1)]
    n, df, dl, avg = 3, 1, 3, (3 + 2 + 1) / 3
    expected = 2 * math.log(1 + (n - df + 0.5) / (df + 0.5)) * 1 / (1 + 1.2 * (0.25 + 0.75 * dl / avg))
    assert hits[0]["raw"] == pytest.approx(expected)


def test_score_all_and_saved_index(spark, tmp_path):
    index = lexical.index_chunks(corpus(spark))
    index.save(f"file://{tmp_path}/ix")
    again = lexical.LexicalIndex.load(spark, f"file://{tmp_path}/ix")
    asked = spark.createDataFrame([(1, "socket")], "qid long, text string")
    rows = {r["chunk_hash"]: r["raw"] for r in lexical.score_all(again, asked).collect()}
    assert rows["a"] == 0 and rows["c"] == 0 and rows["b"] > 0


def test_dense_forms_agree(spark):
    rows = [(i, [float((i * 7 + j * 3) % 5) for j in range(6)]) for i in range(20)]
    docs = spark.createDataFrame(rows, "chunk_hash long, vector array<double>")
    asked = docs.filter("chunk_hash < 3").withColumnRenamed("chunk_hash", "qid")
    a = {(r["qid"], r["rank"]): (r["chunk_hash"], round(r["raw"], 9)) for r in dense.search(asked, docs, 4).collect()}
    b = {(r["qid"], r["rank"]): (r["chunk_hash"], round(r["raw"], 9)) for r in dense.search_native(asked, docs, 4).collect()}
    assert a == b and len(a) == 12


def views(spark):
    return spark.createDataFrame(
        [(1, "A", "lexical", 10.0, 1), (1, "B", "lexical", 5.0, 2), (1, "B", "semantic", 0.9, 1), (1, "C", "semantic", 0.8, 2)],
        "qid long, chunk_hash string, view string, raw double, rank long",
    )


def order(frame):
    return [r["chunk_hash"] for r in frame.orderBy("qid", "rank").collect()]


def test_fusion(spark):
    hits = views(spark)
    assert order(fusion.rrf(hits))[0] == "B"
    assert order(fusion.weighted(hits, fusion.weights_frame(spark, {"lexical": 1.0, "semantic": 0.0})))[0] == "A"
    assert order(fusion.weighted(hits, fusion.weights_frame(spark, {"lexical": 0.0, "semantic": 1.0})))[0] == "B"
    raw = {r["chunk_hash"]: (r["lexical"], r["semantic"]) for r in fusion.view_scores(hits, ["lexical", "semantic"]).collect()}
    assert raw == {"A": (10.0, None), "B": (5.0, 0.9), "C": (None, 0.8)}
    shuffled = hits.orderBy(F.rand(3))
    assert order(fusion.rrf(shuffled)) == order(fusion.rrf(hits))


def test_normalisation_of_equal_scores(spark):
    same = spark.createDataFrame([(1, "A", "v", 2.0, 1), (1, "B", "v", 2.0, 2)], "qid long, chunk_hash string, view string, raw double, rank long")
    assert {r["value"] for r in fusion.normalized(same, "minmax").collect()} == {1.0}
    assert {r["value"] for r in fusion.normalized(same, "zscore").collect()} == {0.0}


def test_metrics_closed_form_and_tie_break(spark):
    qrels = spark.createDataFrame([(1, "x", 1), (2, "y", 1), (3, "z", 0)], "qid long, doc_id string, rel long")
    run = spark.createDataFrame([(1, "w", 2.0), (1, "x", 1.0), (2, "y", 1.0), (2, "z", 1.0)], "qid long, doc_id string, score double")
    rows = {r["qid"]: r for r in evaluation.per_query(run, qrels).collect()}
    assert set(rows) == {1, 2}
    assert rows[1]["mrr_10"] == 0.5 and rows[1]["ndcg_10"] == pytest.approx(1 / math.log2(3))
    assert rows[2]["mrr_1"] == 0.0  # ties go by id, descending
    means = evaluation.evaluate(run, qrels).first()
    assert 0 <= means["ndcg_10"] <= 1 and means["n_queries"] == 2


def test_alpha_ndcg_of_the_ideal_is_one(spark):
    intents = spark.createDataFrame([(1, "a", "i"), (1, "a", "j"), (1, "b", "i"), (1, "c", "j")], "qid long, doc_id string, intent string")
    run = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "c", 3)], "qid long, doc_id string, rank long")
    assert evaluation.alpha_ndcg(run, intents).first()["alpha_ndcg"] == pytest.approx(1.0)


def edges(spark):
    return spark.createDataFrame([("main", "load", "calls"), ("load", "read", "calls"), ("main", "conf", "imports")], "src string, dst string, kind string")


def test_expand_and_chains(spark):
    seeds = spark.createDataFrame([(1, "load", 2.0)], "qid long, node string, score double")
    got = {r["node"]: r["score"] for r in graph.expand(seeds, edges(spark), 1).collect()}
    assert got == {"load": 1.0, "read": 0.5, "main": 0.5}
    far = {r["node"]: r["score"] for r in graph.expand(seeds.withColumn("node", F.lit("read")), edges(spark), 2).collect()}
    assert far["main"] == 0.25
    start = spark.createDataFrame([("main",)], "start string")
    chains = {tuple(r["symbols"]): r["score"] for r in graph.dependency_chains(edges(spark), start).collect()}
    assert chains == {("main", "load"): 1.0, ("main", "load", "read"): pytest.approx(0.8), ("main", "conf"): pytest.approx(0.6)}


@pytest.mark.parametrize("text, way", [("who calls load", "in"), ("what does load call", "out"), ("what calls are called by load", "both"), ("load", "both")])
def test_direction(spark, text, way):
    assert one(spark, graph.direction_for(F.col("t")), t=text) == way


def test_lineage_passes(spark):
    body = " ".join(f"word{i} = call({i})" for i in range(12))
    cols = "occurrence_id string, path string, symbol string, kind string, start_line int, language string, content_hash string, text string"
    row = lambda i, p, s, h, t: (i, p, s, "function", 1, "python", h, t)
    old = spark.createDataFrame([row("a1", "m.py", "same", "h1", "x"), row("a2", "m.py", "moves", "h2", "y"), row("a3", "m.py", "old_name", "h3", body), row("a4", "m.py", "gone", "h4", "q"), row("a5", "m.py", "edited", "h5", "e")], cols)
    new = spark.createDataFrame([row("b1", "m.py", "same", "h1", "x"), row("b2", "n.py", "moves", "h2", "y"), row("b3", "m.py", "new_name", "h6", body + " more"), row("b4", "m.py", "fresh", "h7", "tiny"), row("b5", "m.py", "edited", "h8", "ee")], cols)
    got = {(r["old"], r["new"]): (r["change_type"], r["similarity"]) for r in lineage.match_symbols(old, new).collect()}
    assert got[("a1", "b1")] == ("unchanged", 1.0) and got[("a2", "b2")] == ("moved", 1.0) and got[("a5", "b5")] == ("modified", 1.0)
    assert got[("a3", "b3")][0] == "renamed" and 0.5 <= got[("a3", "b3")][1] < 1
    assert got[("a4", None)] == ("deleted", 0.0) and got[(None, "b4")] == ("added", 0.0)


def test_native_dense_search_meets_every_vector(spark):
    from lexigraf.plans import QUERIES

    sf = "/root/testdata/sf0.001"
    a, b = (sorted(map(tuple, QUERIES[n](spark, sf).collect())) for n in ("dense_native_topk", "dense_topk"))
    assert a == b and any(r[1] % 50 for r in a)


def test_version_compare_lists_every_change(spark):
    """Against the three passes by brute force, on tables with more changes than a service lists."""
    from lexigraf.plans import QUERIES, inputs

    sf = "/root/testdata/sf0.01"
    sides = inputs.versions(spark, sf)
    old, new = ({r["occurrence_id"]: r for r in s.withColumn("items", T.shingles("text", "symbol")).collect()} for s in sides)
    want, at = set(), {(r["path"], r["symbol"]): i for i, r in new.items()}

    def take(o, n, change, similarity=1.0):
        old.pop(o, None), new.pop(n, None)
        if change != "unchanged":
            want.add((o, n, change, round(similarity, 4)))

    for o, r in list(old.items()):
        if n := at.get((r["path"], r["symbol"])):
            take(o, n, "unchanged" if r["content_hash"] == new[n]["content_hash"] else "modified")
    order = lambda side: sorted(side, key=lambda i: (side[i]["path"], i))
    for o in order(old):
        if n := next((n for n in order(new) if new[n]["content_hash"] == old[o]["content_hash"]), None):
            take(o, n, "moved" if old[o]["symbol"] == new[n]["symbol"] else "renamed")
    pairs = []
    for o, a in old.items():
        for n, b in new.items():
            x, y = set(a["items"]), set(b["items"])
            if a["language"] == b["language"] and min(len(x), len(y)) >= lineage.LEAST_SHINGLES and (s := len(x & y) / len(x | y)) >= lineage.THRESHOLD:
                bonus = 0.05 * (a["path"] == b["path"]) + 0.05 * (a["symbol"] == b["symbol"])
                pairs.append((s + bonus, s, a["path"], b["path"], o, n))
    for _, s, _, _, o, n in sorted(pairs, reverse=True):
        if o in old and n in new:
            take(o, n, "moved" if old[o]["symbol"] == new[n]["symbol"] else "renamed", s)
    for i in list(old):
        take(i, None, "deleted", 0.0)
    for i in list(new):
        take(None, i, "added", 0.0)
    rows = QUERIES["version_compare"](spark, sf).collect()
    assert len(rows) == len(want) > 200 and {r["change_type"] for r in rows} == {"added", "deleted", "modified", "renamed", "moved"}
    assert {(r["old"], r["new"], r["change_type"], round(r["similarity"], 4)) for r in rows} == want


def test_similar_pairs_against_brute_force(spark):
    import random

    rng = random.Random(5)
    sets = []
    for i in range(60):
        base = set(rng.sample(range(40), rng.randrange(1, 12)))
        sets.append((i, "x", sorted(map(str, base))))
    frame = spark.createDataFrame(sets, "id long, language string, items array<string>")
    got = {(r["old"], r["new"]) for r in lineage.similar_pairs(frame, frame, 0.5).collect()}
    want = {(a[0], b[0]) for a in sets for b in sets if len(set(a[2]) & set(b[2])) / len(set(a[2]) | set(b[2])) >= 0.5}
    assert got == want


def test_query_types(spark):
    rows = [(1, "who calls parse_config and what depends on it"), (2, "how did it change since v1.2 release"), (3, "parseConfig readFile()"), (4, "find the sum of numbers"), (5, "recursive dfs with memoization over nested loops")]
    got = {r["qid"]: r["query_type"] for r in query.classify(query.parse(spark.createDataFrame(rows, "qid long, text string"))).collect()}
    assert got == {1: "dependency", 2: "evolutionary", 3: "lexical", 4: "semantic", 5: "structural"}


def test_decompose_sections_and_grid(spark):
    text = "Do it.\n-----Input-----\nAt most 5 lines.\n-----Output-----\nPrint x."
    subs = {r["facet"]: r["weight"] for r in query.decompose(query.parse(spark.createDataFrame([(1, text)], "qid long, text string"))).collect()}
    assert subs == {"full": 1.0, "core": 1.0, "input": 0.4, "output": 0.4, "constraints": 0.2}
    assert query.simplex_grid(spark, ["a", "b", "c"]).select("cell").distinct().count() == 66


@pytest.mark.parametrize("reply, order_", [("[2, 0]", [2, 0, 1]), ('{"ranking": [1, 1, 7]}', [1, 0, 2]), ("first 1 then 0", [1, 0, 2]), ("", [0, 1, 2])])
def test_reorder(reply, order_):
    assert query.reorder(reply, 3) == order_


def test_traits():
    assert {"heapq", "while_loop", "loop", "imp:heapq"} <= set(structural.traits_of("import heapq\nh = []\nwhile h:\n    heapq.heappop(h)\n"))
    assert "recursion" in structural.traits_of("def f(n):\n    return f(n - 1)\n")
    assert "loop_nested2" in structural.traits_of("for i in a:\n    for j in b:\n        pass\n")
    assert structural.traits_of("def (:\n 1000000007") == ["mod_const"]


def test_rerank_keeps_the_tail_below(spark):
    fused = spark.createDataFrame([(1, f"c{i}", 1.0 - i / 10, i + 1) for i in range(5)], "qid long, chunk_hash string, score double, rank long")
    pairs = spark.createDataFrame([(1, "c0", 0.1), (1, "c1", 0.9)], "qid long, chunk_hash string, pair double")
    assert order(rank.rerank(fused, pairs, 2)) == ["c1", "c0", "c2", "c3", "c4"]


def test_mmr_demotes_near_copies(spark):
    fused = spark.createDataFrame([(1, "a", 1.0, 1), (1, "b", 0.99, 2), (1, "c", 0.8, 3)], "qid long, chunk_hash string, score double, rank long")
    vectors = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 0.01]), ("c", [0.0, 1.0])], "chunk_hash string, vector array<double>")
    assert order(rank.mmr(fused, vectors)) == ["a", "c", "b"]


def test_lineage_dedup_prefers_the_target(spark):
    hits = spark.createDataFrame([(1, "x1", 3.0), (1, "x2", 2.0), (1, "y", 1.0)], "qid long, chunk_hash string, score double")
    chunks = spark.createDataFrame([("x1", "L", "v0"), ("x2", "L", "v1"), ("y", None, "v0")], "chunk_hash string, lineage_id string, version_id string")
    ranks = rank.version_rank(spark.createDataFrame([("v0", 0), ("v1", 1)], "version_id string, timestamp long"), "v2")
    assert order(rank.lineage_dedup(hits, chunks, ranks, "v0")) == ["x1", "y"]
    assert order(rank.lineage_dedup(hits, chunks, ranks, "none")) == ["x2", "y"]
    assert order(rank.lineage_dedup(hits, chunks, ranks, keep_history=True)) == ["x2", "x1", "y"]


def test_alpha_ndcg_against_brute_force(spark):
    import random

    rng = random.Random(4)
    intents = sorted({(q, rng.choice("abcdefgh"), rng.choice("wxyz")) for q in range(8) for _ in range(14)})
    run = [(q, d, i + 1) for q in range(7) for i, d in enumerate(rng.sample("abcdefghij", rng.randrange(1, 10)))]

    def worth(order, of):
        return sum(0.5 ** sum(t in of.get(e, ()) for e in order[:i]) / math.log2(i + 2) for i, d in enumerate(order) for t in of.get(d, ()))

    want = {}
    for q in range(8):
        of = {}
        for _, d, t in (x for x in intents if x[0] == q):
            of.setdefault(d, set()).add(t)
        ideal = []
        while len(ideal) < min(4, len(of)):
            ideal.append(min((d for d in of if d not in ideal), key=lambda d: (-sum(0.5 ** sum(t in of[e] for e in ideal) for t in of[d]), d)))
        want[q] = worth([d for x, d, r in run if x == q and r <= 4], of) / worth(ideal, of)
    got = {r["qid"]: r["alpha_ndcg"] for r in evaluation.alpha_ndcg(spark.createDataFrame(run, "qid long, doc_id string, rank long"), spark.createDataFrame(intents, "qid long, doc_id string, intent string"), 4).collect()}
    assert got == pytest.approx(want) and want[7] == 0


@pytest.mark.parametrize("by", ["vector", "words"])
def test_mmr_against_brute_force(spark, by):
    import random

    rng = random.Random(6)
    features = {f"c{i}": [rng.gauss(0, 1) for _ in range(5)] if by == "vector" else sorted(rng.sample("abcdefg", rng.randrange(0, 5))) for i in range(25)}
    del features["c3"]
    rows = []
    for q, n in enumerate((1, 2, 3, 9, 20)):
        scores = sorted((round(rng.uniform(-1 if q % 2 else 0, 5), 3) for _ in range(n)), reverse=True)
        rows += [(q, c, s, i + 1) for i, (c, s) in enumerate(zip(rng.sample(sorted([*features, "c3"]), n), scores))]

    def alike(a, b):
        if a not in features or b not in features:
            return 0.0
        a, b = features[a], features[b]
        if by == "vector":
            return sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(x * x for x in b))
        return len(set(a) & set(b)) / len(set(a) | set(b)) if a or b else 0.0

    want = {}
    for q in range(5):
        mine = [(c, s) for x, c, s, _ in rows if x == q]
        head, tail = mine[:6], mine[6:]
        if len(head) > 2:
            low, high = min(s for _, s in head), max(s for _, s in head)
            value = {c: s / high if low >= 0 and high > 0 else (s - low) / (high - low) for c, s in head}
            left, taken = [c for c, _ in head], []
            while left:
                best = max(left, key=lambda c: (0.7 * value[c] - 0.3 * max((alike(c, t) for t in taken), default=0.0), -left.index(c)))
                taken.append(best)
                left.remove(best)
            first = dict(head)[taken[0]]
            head = [(c, first - 1e-4 * i) for i, c in enumerate(taken)]
        floor = head[-1][1]
        for i, (c, s) in enumerate(head + [(c, floor - 1e-4 * (i + 1)) for i, (c, _) in enumerate(tail)]):
            want[q, c] = (round(s, 9), i + 1)
    kind = "vector array<double>" if by == "vector" else "words array<string>"
    frame = spark.createDataFrame(list(features.items()), f"chunk_hash string, {kind}")
    got = {(r["qid"], r["chunk_hash"]): (round(r["score"], 9), r["rank"]) for r in rank.mmr(spark.createDataFrame(rows, "qid long, chunk_hash string, score double, rank long"), frame, k=6).collect()}
    assert got == want


def test_code_terms_are_the_code_tokens_in_another_order(spark):
    import random

    rng = random.Random(1)
    parts = ["the", "The", "THE", "a", "A", "i", "I", "of", "Of", "OF", "get", "URL", "x", "9", "42", "_", "__", "é", " ", " ", ".", "Name", "no", "To", "and", "AND", "be"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 9))) for _ in range(3000)] + ["ABc", "aB", "iT", "XYof", "XOf", "ANDs", "software thereby", "9abc_d", ""]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.code_tokens("t").alias("a"), T.code_terms("t").alias("b")).collect()
    assert [(r["t"], sorted(r["a"])) for r in rows] == [(r["t"], sorted(r["b"])) for r in rows]
