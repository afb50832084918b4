"""Mixing to target weights."""

import re
from collections import Counter

import pytest
from llm_helpers import near

from lexigraf.llm import mixing


def test_mixing(docs, rows, empty, clashing):
    got = mixing.mixed(docs, mixing.mixing_plan(docs)).collect()
    assert len(got) == len(rows)
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    totals = Counter()
    for _, t, _, s, _ in rows:
        totals[s] += words(t)
    order = sorted(totals, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, capped = {}, set()
    while True:  # clamp and share again until none is above
        left = sum(totals.values()) - sum(3 * totals[s] for s in capped)
        over = sum(weight[s] for s in order if s not in capped)
        target = {s: 3.0 * totals[s] if s in capped else left * weight[s] / over for s in order}
        above = {s for s in order if s not in capped and target[s] > 3 * totals[s]}
        if not above:
            break
        capped |= above
    taken = Counter()
    for r in got:
        assert r["size"] == words(r["doc"]["text"]) and r["source_size"] == totals[r["doc"]["source"]]
        assert r["target"] == pytest.approx(target[r["doc"]["source"]]) and 0 <= r["copies"] <= 3
        taken[r["doc"]["source"]] += r["copies"] * r["size"]
    for s in order:
        assert taken[s] <= target[s] + 1e-6
        longest = max(words(t) for _, t, _, x, _ in rows if x == s)
        if longest <= target[s] / 5:  # else whole documents can't come near
            assert target[s] - taken[s] < 0.05 * target[s]
    assert sorted(map(repr, got)) == sorted(map(repr, mixing.mixed(docs, mixing.mixing_plan(docs)).collect()))
    out = mixing.mix(clashing)
    assert out.columns == clashing.columns and out.count() == sum(r["copies"] for r in got)
    assert mixing.mix(empty).count() == 0


def test_mixing_goes_on_past_what_does_not_fit(spark):
    """Nothing that is left out fits, wherever the long documents fall in the order."""
    texts = dict(enumerate(["w " * 7] * 300 + ["w " * 300] * 100 + ["w " * 10_000] * 5))
    docs = spark.createDataFrame([(f"{s}{k}", t, s) for s in "abcdef" for k, t in texts.items()], "doc_id string, text string, source string")
    planned = mixing.mixing_plan(docs)
    plan = {r["source"]: r for r in planned.collect()}
    got = mixing.mixed(docs, planned).collect()
    rest = {s: r["target"] - r["whole"] * r["source_size"] for s, r in plan.items()}
    for r in got:
        rest[r["doc"]["source"]] -= r["size"] * (r["copies"] - plan[r["doc"]["source"]]["whole"])
    assert max(len(r["passes"]) for r in plan.values()) > 1 and min(rest.values()) > -1e-6
    assert all(r["size"] > rest[r["doc"]["source"]] for r in got if r["copies"] == plan[r["doc"]["source"]]["whole"])
