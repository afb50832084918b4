"""Minimax sharding."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from lexigraf.llm import sharding


def least_capacity(sizes, shards):
    def fits(c):
        at, used = 0, 1
        for s in sizes:
            if s > c:
                return False
            if at + s > c:
                used, at = used + 1, 0
            at += s
        return used <= shards

    low, high = max(sizes), sum(sizes)
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if fits(mid) else (mid + 1, high)
    return low


@pytest.mark.parametrize("shards", [1, 3, 16])
def test_sharding_is_minimax(docs, rows, shards):
    got = sharding.shard_documents(docs, shards).collect()
    assert len(got) == len(rows)
    atoms = {}
    for i, t, *_ in rows:
        first, size = atoms.get(t or "", (i, 0))
        ids = [x for x in (first, i) if x is not None]
        atoms[t or ""] = (min(ids) if ids else None, size + len((t or "").encode()) + 1)
    order = sorted(atoms.items(), key=lambda kv: (kv[1][0] is not None, kv[1][0] or 0, hashlib.sha256(kv[0].encode()).digest()))
    by_shard = Counter()
    for r in got:
        by_shard[r["shard"]] += r["size"]
    assert max(by_shard.values()) == least_capacity([v[1] for _, v in order], shards)
    where = defaultdict(set)
    for r in got:
        where[r["text_crc32"]].add(r["shard"])
        assert r["law"] == "bytes" and r["grown_shard"] is None
    assert all(len(s) == 1 for s in where.values())
    for s in by_shard:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))


def test_minimax_search_at_several_scales(spark, monkeypatch):
    rng = random.Random(2)
    monkeypatch.setattr(sharding, "BLOCKS", 8)
    monkeypatch.setattr(sharding, "PARTS", 4)
    for _ in range(6):
        sizes = [rng.choice([1, 2, 5, 40, 300]) for _ in range(rng.randrange(1, 200))]
        ends = np.cumsum(sizes).tolist()
        frame = spark.createDataFrame([(e,) for e in ends], "end long")
        shards = rng.randrange(1, 9)
        cuts = sharding.minimax_cuts(frame, ends[-1], max(sizes), shards)
        assert len(cuts) <= shards and cuts[-1] == ends[-1] and set(cuts) <= set(ends)
        assert max(np.diff([0, *cuts])) == least_capacity(sizes, shards)


def test_sharding_of_awkward_tables(spark, docs, clashing, empty):
    plain = sorted(map(repr, (tuple(r) for r in sharding.shard_documents(docs, 4).collect())))
    assert sorted(map(repr, (tuple(r) for r in sharding.shard_documents(clashing, 4).collect()))) == plain
    assert sharding.shard_documents(empty).count() == 0
    # one text holds a third of all rows, and all of them stay together
    hot = spark.createDataFrame([(i, "the same" if i % 3 == 0 else f"other {i}", None, "a", 1) for i in range(300)], docs.schema)
    got = sharding.shard_documents(hot, 5).collect()
    assert len({r["shard"] for r in got if r["doc_id"] % 3 == 0}) == 1 and len(got) == 300
