"""The similarity join and components."""

import random
import re
from collections import defaultdict

import numpy as np
from llm_helpers import SCHEMA, listed, near, sentence

from lexigraf.llm import common, jaccard_join
from lexigraf.llm.common import components


def brute_join(rows):
    words = lambda t: tuple(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    least = {}
    key = lambda i: (i is not None, i or 0)
    for i, t, *_ in rows:
        w = words(t)
        least[w] = min(least.get(w, i), i, key=key)
    sets = {w: {w[k : k + 5] for k in range(len(w) - 4)} if len(w) >= 5 else ({w} if w else set()) for w in least}
    links = defaultdict(set)
    for a in sets:
        for b in sets:
            if a != b and sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9:
                links[a].add(b)
    root = {}
    for w in sorted(sets, key=lambda w: key(least[w])):
        if w not in root:
            todo = [w]
            while todo:
                x = todo.pop()
                if x not in root:
                    root[x] = w
                    todo += links[x]
    return [(i, least[words(t)], least[root[words(t)]], len(links[words(t)])) for i, t, *_ in rows]


def test_jaccard_join(docs, rows, empty, clashing):
    want = sorted(map(repr, brute_join(rows)))
    assert any(r[3] for r in brute_join(rows))
    assert sorted(map(repr, listed(jaccard_join.jaccard_join(docs)))) == want
    kept = jaccard_join.one_of_each(clashing)
    assert kept.columns == clashing.columns
    assert {r["doc_id"] for r in kept.collect()} == {r[2] for r in brute_join(rows)}
    assert jaccard_join.jaccard_join(empty).count() == 0


def test_jaccard_join_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", 4)
    rng = random.Random(8)
    base = sentence(rng, 150)
    rows = [(i, near(rng, base, rng.randrange(0, 4)), None, None, 1) for i in range(40)]
    frame = spark.createDataFrame(rows, SCHEMA)
    assert sorted(map(repr, listed(jaccard_join.jaccard_join(frame)))) == sorted(map(repr, brute_join(rows)))


def edited(rng, text, edits):
    """``text`` with so many words replaced, each far from the others."""
    words = text.split()
    for k in range(edits):
        words[(2 * k + 1) * len(words) // (2 * edits)] = f"new{rng.randrange(10**9)}"
    return " ".join(words)


def test_links_do_not_depend_on_a_sample(spark):
    """Short texts with partners that any forest finds say nothing of long ones just above the threshold."""
    rng = random.Random(11)
    rows = []
    for base in [sentence(rng, 600) for _ in range(20)]:
        rows += [(len(rows) + i, edited(rng, base, i and 1), None, None, 1) for i in range(3)]
    for base in [sentence(rng, 2100) for _ in range(12)]:
        rows += [(len(rows) + i, edited(rng, base, i * 44), None, None, 1) for i in range(2)]
    frame = spark.createDataFrame(rows, SCHEMA)
    want = brute_join(rows)
    assert all(r[3] == 1 for r in want[60:])
    assert sorted(listed(jaccard_join.jaccard_join(frame, trees=4))) == sorted(want)
    assert {r["doc_id"] for r in jaccard_join.one_of_each(frame, trees=4).collect()} == {r[2] for r in want}


def test_pairs_that_the_forest_misses(spark, monkeypatch):
    """One tree of long prefixes, a passage in all texts, copies, a large group and buckets and blocks of a few rows."""
    monkeypatch.setattr(jaccard_join, "BLOCK", 4)
    monkeypatch.setattr(jaccard_join, "SORTED", 50)
    monkeypatch.setattr(jaccard_join, "prefix_depth", lambda *a: 8)
    rng = random.Random(12)
    line = sentence(rng, 30)
    texts = [line + " " + edited(rng, base, e) for base in [sentence(rng, n) for n in (20, 60, 90, 150, 200, 400)] for e in (0, 1, 2, 3, 4, 5, 6)]
    texts += [f"{line} tail{i}" for i in range(40)] + texts[:9] + [line, "one", "one two", "two one", "a b c d e f", "a b c d e f a b c d e f", "", None]
    base = sentence(rng, 100)
    texts += [base + "".join(f" end{k}" for k in range(i)) for i in range(30)]  # sets inside sets
    rows = [(1000 - i, t, None, None, 1) for i, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert sorted(listed(jaccard_join.jaccard_join(frame, trees=1))) == sorted(brute_join(rows))


def test_prefixes_shorten_until_recall(spark, docs, rows):
    d = jaccard_join.prefix_depth(24, 8, 0.8, 0.999)
    assert d == 6 and 1 - (1 - 0.8**d) ** 24 >= 0.999 > 1 - (1 - 0.8 ** (d + 1)) ** 24
    assert jaccard_join.shortened((5, [1.0] * 8), 24, 8, 0.8, 0.999) == 6  # too little measured
    assert jaccard_join.shortened((100, [1.0] * 7 + [0.9]), 24, 8, 0.8, 0.999) == 7
    assert jaccard_join.shortened((100, [0.5] * 8), 24, 8, 0.8, 0.999) == 1


def test_recall_is_measured_against_brute_force(spark):
    """The recall of each prefix length over all representatives equals what pairs and signatures say."""
    rng = random.Random(5)
    rows = [(8 * k + i, near(rng, base, rng.randrange(0, 7))) for k in range(12) for base in [sentence(rng, 90)] for i in range(8)]
    frame = spark.createDataFrame(rows, "_id long, _text string")
    digest = jaccard_join._digest(frame, 4, 8)
    sig = {r["_id"]: np.frombuffer(r["sig"], ">u2").reshape(4, 8) for r in digest.collect()}
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in rows}
    of = {}
    for a in sets:
        for b in sets:
            if a != b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9:
                same = (sig[a] == sig[b]).cumprod(axis=1).sum(1).max()
                of.setdefault(a, []).append(same)
    want = [np.mean([np.mean([s >= d for s in v]) for v in of.values()]) for d in range(1, 9)]
    seen, got = jaccard_join.measured_recall(frame, digest.select("_id", "n", "sig"), 0.8, 4, 8, sample=10**9)
    assert seen == len(of) > 20 and np.allclose(got, want) and got[0] > got[-1]


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(1000 + i, 1001 + i) for i in range(100)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {r[0]: r[1] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent if find(x) != x}


def test_components_of_a_hub(spark, monkeypatch):
    """A node with most of the edges meets its neighbours by the broadcast side of the join."""
    monkeypatch.setattr(common, "HOT", 4)
    edges = [(0, i) for i in range(1, 400)] + [(500 + i, 501 + i) for i in range(40)] + [(399, 700)]
    got = {r[0]: r[1] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 400)}, 700: 0, **{501 + i: 500 for i in range(40)}}


def test_components_by_tasks_and_by_rounds(spark, monkeypatch):
    """Few edges take one task and few jobs, whatever a component's diameter; with more, tasks tie what they may hold and rounds go on."""
    rng = random.Random(2)
    path = [(i, i + 1) for i in range(300)]
    edges = path + [(600 - i, 599 - i) for i in range(0, 99)] + [(1000 + rng.randrange(400), 1000 + rng.randrange(400)) for _ in range(250)] + [(-5, -5)]
    rng.shuffle(edges)
    want = dict(zip(*(x.tolist() for x in common.least_of(*np.array(edges).T)), strict=True))
    least = {}
    for x in sorted({x for e in edges for x in e}):
        todo = [x]
        while todo:
            y = todo.pop()
            if y not in least:
                least[y] = x
                todo += [b if y == a else a for a, b in edges if y in (a, b)]
    assert want == {x: r for x, r in least.items() if x != r} and want[300] == 0 and want[600] == 501
    frame = spark.createDataFrame(edges, "a long, b long").repartition(5)
    context = spark.sparkContext
    context.setJobGroup("few edges", "components")
    got = {r[0]: r[1] for r in components(frame).collect()}
    jobs = len(context.statusTracker().getJobIdsForGroup("few edges"))
    context.setLocalProperty("spark.jobGroup.id", None)
    assert got == want and jobs <= 6
    monkeypatch.setattr(common, "EDGES_IN_FILE", 40)
    assert {r[0]: r[1] for r in components(frame).collect()} == want
    none = components(spark.createDataFrame([], "a long, b long"))
    assert none.columns == ["node", "root"] and none.count() == 0
