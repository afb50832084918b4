"""Benchmark passages."""

import random
import re

import pyarrow as pa
from llm_helpers import SCHEMA, sentence

from lexigraf.llm import decontaminate


def edit_distance_within(pattern, text):
    """The least edits between the pattern and any stretch of the text."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, c in enumerate(text, 1):
            new.append(min(row[j - 1] + (p != c), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def test_decontamination_against_alignment(spark, clashing, empty):
    rng = random.Random(6)
    items = [(i, " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 7))) for _ in range(rng.randrange(8, 16)))) for i in range(5)] + [(5, None), (6, "Short!"), (7, "a"), (8, "..."), (9, "nineteen characters"), (10, "edit")]
    texts = []
    for k in range(60):
        head, item = sentence(rng, 6), list(items[k % 5][1])
        for _ in range(rng.randrange(0, 9)):
            at = rng.randrange(len(item))
            item[at : at + 1] = rng.choice(["", "z", item[at] + "q"])
        texts.append(head + ("" if k % 7 == 0 else " " + "".join(item)) + " " + sentence(rng, 4))
    texts[3] = texts[3].upper().replace(" ", " -- ")
    texts += ["it is short, a nineteen  characters' thing", "shortly after an edition of nineteen character sets", "a", "short", "Nineteen characters"]
    rows = [(i, t, None, None, 1) for i, t in enumerate(texts)] + [(99, None, None, None, None), (100, "", None, None, 0)]
    got = {(r["doc_id"], r["item_id"]): r for r in decontaminate.contaminated(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(items, "item_id long, text string")).collect()}
    fold = lambda s: re.sub(r"[^a-z0-9]+", " ", s.lower()).strip()
    want = {}
    for i, t in enumerate(texts):
        for j, item in items:
            m = len(fold(item or ""))
            if not m:
                continue
            if m < decontaminate.SHORT:
                if f" {fold(item)} " in f" {fold(t)} ":
                    want[i, j] = 0
                continue
            k = max(0, min(int(decontaminate.RATE * m), (m - decontaminate.Q + 1 - decontaminate.SHARED) // decontaminate.Q))
            d = edit_distance_within(fold(item), " " + fold(t) + " ")
            if d <= k:
                want[i, j] = d
    assert {k: r["edits"] for k, r in got.items()} == want and len(want) > 10
    assert {j for _, j in want} >= {6, 7, 9} and not {j for _, j in want} & {5, 8}
    for (i, j), r in got.items():
        assert r["edits"] <= r["budget"] <= max(0, decontaminate.RATE * len(items[j][1]))
        if not r["edits"]:
            assert fold(texts[i][r["start"] : r["end"]]) == fold(items[j][1])
    kept = decontaminate.clean(clashing, spark.createDataFrame(items, "item_id long, text string"))
    assert kept.columns == clashing.columns and kept.count() <= clashing.count()
    longer = spark.createDataFrame(items[:5], "item_id long, text string")
    assert decontaminate.clean(clashing, longer).count() == clashing.count()
    assert decontaminate.clean(empty, spark.createDataFrame(items[:0], "item_id long, text string")).count() == 0


def test_long_and_repetitive_texts_go_in_segments(spark, monkeypatch):
    """A passage is found once wherever a segment ends in it."""
    rng = random.Random(2)
    item = "".join(rng.choice("abcdefgh ") for _ in range(60)).replace("  ", " a").strip()
    filler = "ab " * 400
    whole = [(i, filler[:n] + item + " " + filler + ("x" if i % 2 else "")) for i, n in enumerate(range(0, 900, 37))] + [(99, filler * 3)]
    items = [(1, item), (2, "ab " * 12)]
    index = decontaminate.index_items([i for i, _ in items], [t for _, t in items])
    once = list(decontaminate.matches(index, pa.array([t for _, t in whole])))
    monkeypatch.setattr(decontaminate, "SEGMENT", 101)
    assert list(decontaminate.matches(index, pa.array([t for _, t in whole]))) == once
    assert [f[0] for f in once if f[1] == 0] == list(range(len(whole) - 1)) and [f[0] for f in once if f[1] == 1] == list(range(len(whole)))
