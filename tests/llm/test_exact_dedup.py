"""Exact duplicates."""

from collections import defaultdict

from llm_helpers import listed

from lexigraf.llm import exact_dedup


def test_exact_dedup(docs, rows, empty, clashing):
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[t or ""].append(i)
    best = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    want = sorted(repr((i, best[t or ""], len(groups[t or ""]), i == best[t or ""])) for i, t, *_ in rows)
    assert sorted(map(repr, listed(exact_dedup.exact_dedup(docs)))) == want
    assert sorted(map(repr, listed(exact_dedup.exact_dedup(clashing)))) == want
    assert exact_dedup.exact_dedup(empty).count() == 0
