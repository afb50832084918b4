"""Removal of repeated passages and suffix sorting."""

import hashlib
import random

import numpy as np
import pyarrow as pa
from llm_helpers import SCHEMA, listed, sentence

from lexigraf.llm import esais, suffix_dedup


def brute_removed(rows, length=100):
    seen, out = set(), []
    texts = {}
    for i, t, *_ in rows:
        texts.setdefault((i is not None, i or 0, t or ""), None)
    for key in sorted(texts, key=lambda k: k[:2]):
        b = key[2].encode()
        covered = bytearray(len(b))
        fresh = []
        for p in range(len(b) - length + 1):
            w = b[p : p + length]
            if w in seen:
                covered[p : p + length] = b"\1" * length
            else:
                seen.add(w)
                fresh.append(w)
        texts[key] = covered
    for i, t, *_ in rows:
        b, c = (t or "").encode(), texts[(i is not None, i or 0, t or "")]
        spans = sum(1 for j in range(len(c)) if c[j] and (j == 0 or not c[j - 1]))
        out.append((i, len(b), sum(c), spans, hashlib.sha256(bytes(x for x, y in zip(b, c) if not y)).hexdigest()))
    return out


def test_suffix_dedup(docs, rows, empty, clashing):
    want = sorted(map(repr, brute_removed(rows)))
    assert sorted(map(repr, listed(suffix_dedup.suffix_dedup(docs)))) == want
    assert sorted(map(repr, listed(suffix_dedup.suffix_dedup(clashing)))) == want
    assert suffix_dedup.suffix_dedup(empty).count() == 0


def test_suffix_dedup_of_repetitive_text(spark):
    rows = [(1, "ab" * 400, None, None, 1), (2, "ab" * 200 + "c", None, None, 1), (3, "x" * 99, None, None, 1), (4, "x" * 99, None, None, 1), (5, "x" * 100, None, None, 1), (6, "y" + "x" * 100, None, None, 1)]
    got = listed(suffix_dedup.suffix_dedup(spark.createDataFrame(rows, SCHEMA)))
    assert sorted(map(repr, got)) == sorted(map(repr, brute_removed(rows)))


def test_long_texts_go_in_segments(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 300)
    monkeypatch.setattr(suffix_dedup, "PIECE", 100)
    text = sentence(random.Random(1), 500)
    whole = suffix_dedup.runs(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)]))
    starts = set()
    for _, shift, raw, offs in suffix_dedup.segments(pa.array([text])):
        _, _, a, b = suffix_dedup.runs(raw, offs)
        for x, y in zip(a.tolist(), b.tolist()):
            starts |= set(range(shift + x, shift + y + 1))
    assert starts == {s for x, y in zip(whole[2].tolist(), whole[3].tolist()) for s in range(x, y + 1)} == set(range(len(text) - 99))


def test_induced_sorting_orders_suffixes():
    rng = random.Random(3)
    for _ in range(150):
        n = rng.randrange(1, 60)
        t = np.array([rng.randrange(1, rng.choice([2, 3, 6])) for _ in range(n)] + [0], np.uint16)
        assert esais.suffix_order(t, 8, 10**6).tolist() == sorted(range(len(t)), key=lambda i: t[i:].tolist())


def test_induced_sorting_from_a_file(monkeypatch):
    monkeypatch.setattr(esais, "HELD", 4)
    t = np.array([3, 1, 2, 1, 2, 1, 3, 0], np.uint16)
    assert esais.suffix_order(t, 4, 100).tolist() == sorted(range(8), key=lambda i: t[i:].tolist())
