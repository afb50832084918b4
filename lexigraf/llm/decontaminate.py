"""Benchmark passages in documents, by the q-gram lemma.

Texts are compared as lower-case letters and digits with every other run as one space.
An item of m characters is found where some stretch of a document is within
k = ``RATE`` * m edits of all of it.  Such a stretch shares at least m - q + 1 - k q of
the item's q-grams, and their diagonals (place in the document minus place in the item)
lie within k of each other.  So shared q-grams are counted in bands of 2 (k + 1)
diagonals that overlap by half, bands that reach the bound are kept, and each is aligned
within its diagonals, with free ends in the document.  Where the bound would fall under
``SHARED``, k is lowered (below about 160 characters); each row gives the budget it was
found under.  Items of fewer than ``SHORT`` characters have the budget 0 and are found
only as whole words, spaces around them included; of these the shortest have no q-gram, so
all their characters are one.  Items without a letter or digit say nothing and are never
found.

The items' q-grams are broadcast in blocks of at most ``BLOCK`` characters, one pass per
block; documents are only read, never shuffled, and no document depends on another.  Very
long documents go in segments that overlap by more than the longest item.

Null and empty documents hold no item.  Repeated rows of either table give repeated rows.
Of several places in a document the one with the fewest edits, then the first, is given.
Other columns don't matter.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import codes_of, fold_table, folded, mixed, pieces, prepare, table, texts_of

Q, RATE, SHARED, SHORT, BLOCK, PIECE, SEGMENT, BITS, ALIGNED = 9, 0.1, 8, 25, 1 << 23, 1 << 17, 1 << 18, 22, 256
BASE = 0x9E3779B97F4A7C15


def qgrams(codes: np.ndarray, q: int = Q) -> np.ndarray:
    """A hash of the q characters from each place on."""
    h, span, parts = codes.astype(np.uint64) + np.uint64(1), 1, []
    with np.errstate(over="ignore"):
        while True:  # of 1, 2, 4, ... characters; those of q's binary digits are put together
            if q & span:
                parts.append((span, h))
            if span * 2 > q:
                break
            h = h[:-span] * np.uint64(pow(BASE, span, 1 << 64)) + h[span:] if len(h) > span else h[:0]
            span *= 2
        out, length = parts[0][1], parts[0][0]
        for span, h in parts[1:]:
            n = len(codes) - length - span + 1
            out = h[:n] * np.uint64(pow(BASE, length, 1 << 64)) + out[span : span + n] if n > 0 else out[:0]
            length += span
        return mixed(out)


@dataclass
class Index:
    ids: list
    items: list[np.ndarray]
    budgets: np.ndarray
    needed: np.ndarray
    keys: np.ndarray  # sorted hashes of q-grams
    firsts: np.ndarray  # where the postings of each key begin
    which: np.ndarray  # posting: item
    place: np.ndarray  # posting: place in the item
    present: np.ndarray  # by the upper bits of a hash, whether any key has them
    tiny: dict[int, dict[int, list[int]]]  # items without a q-gram: by length, by hash of all of it
    reach: int  # more than any match is long


def index_items(ids: list, texts: list[str]) -> Index:
    kept, items, budgets, tiny = [], [], [], {}
    for i, text in zip(ids, texts, strict=True):
        codes, offs = codes_of(pa.array([text or ""], pa.string()))
        x = folded(codes, offs, fold_table(True))[0]
        if not (x != 32).any():
            continue
        bare = x[1:-1] if x[-1] == 32 else x[1:]
        if len(bare) >= SHORT:
            x = bare
            budgets.append(max(0, min(int(RATE * len(x)), (len(x) - Q + 1 - SHARED) // Q)))
        else:  # as whole words
            x = np.concatenate((x[:1], bare, x[:1]))
            budgets.append(0)
            if len(x) < Q:
                tiny.setdefault(len(x), {}).setdefault(int(qgrams(x, len(x))[0]), []).append(len(items))
        kept.append(i)
        items.append(x)
    lengths = np.array([len(x) for x in items], np.int64)
    k = np.array(budgets, np.int64)
    hashes = [qgrams(x) for x in items]
    every = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    order = np.argsort(every, kind="stable")
    keys, firsts = np.unique(every[order], return_index=True)
    present = np.zeros(1 << BITS, bool)
    present[every >> np.uint64(64 - BITS)] = True
    return Index(
        kept, items, k, lengths - Q + 1 - k * Q, keys, np.append(firsts, len(every)),
        np.repeat(np.arange(len(items)), [len(h) for h in hashes])[order] if items else np.zeros(0, np.int64),
        np.concatenate([np.arange(len(h)) for h in hashes])[order] if items else np.zeros(0, np.int64), present,
        tiny, int((lengths + 2 * k).max(initial=0)) + Q,
    )


def candidates(index: Index, codes: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Rows (document, item, least diagonal, greatest diagonal) of the bands that reach the bound; diagonals as of the document's start."""
    h = qgrams(codes)
    near = np.flatnonzero(index.present[h >> np.uint64(64 - BITS)])
    if not len(near):
        return np.zeros((0, 4), np.int64)
    at = np.searchsorted(index.keys, h[near])
    at[at == len(index.keys)] = 0
    same = index.keys[at] == h[near] if len(index.keys) else np.zeros(len(near), bool)
    near, at = near[same], at[same]
    doc = np.searchsorted(offs, near, "right") - 1
    inside = near + Q <= offs[doc + 1]
    near, at, doc = near[inside], at[inside], doc[inside]
    counts = index.firsts[at + 1] - index.firsts[at]
    posting = np.repeat(index.firsts[at], counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    item, doc = index.which[posting], np.repeat(doc, counts)
    place = index.place[posting]
    diagonal = np.repeat(near, counts) - offs[doc] - place
    if not len(item):
        return np.zeros((0, 4), np.int64)
    # first by (document, item): too few shared q-grams in all are too few in any band
    pair = doc * len(index.items) + item
    _, inverse, total = np.unique(pair, return_inverse=True, return_counts=True)
    enough = total[inverse] >= index.needed[item]
    item, doc, diagonal, place = item[enough], doc[enough], diagonal[enough], place[enough]
    band = diagonal // (index.budgets[item] + 1)
    item, doc, diagonal, place, band = np.tile(item, 2), np.tile(doc, 2), np.tile(diagonal, 2), np.tile(place, 2), np.concatenate((band, band + 1))
    order = np.lexsort((place, band, item, doc))
    item, doc, diagonal, place, band = item[order], doc[order], diagonal[order], place[order], band[order]
    if not len(item):
        return np.zeros((0, 4), np.int64)
    head = np.concatenate(([True], (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (band[1:] != band[:-1])))
    starts = np.flatnonzero(head)
    # each q-gram of the item counts once, however often a repetitive text has it
    size = np.add.reduceat((head | np.concatenate(([True], place[1:] != place[:-1]))).astype(np.int64), starts)
    found = np.stack((doc[starts], item[starts], np.minimum.reduceat(diagonal, starts), np.maximum.reduceat(diagonal, starts)), 1)
    return found[size >= index.needed[item[starts]]]


def align(index: Index, codes: np.ndarray, offs: np.ndarray, rows: np.ndarray) -> list[tuple]:
    """(document, item, edits, start, end) of the candidates that are within their budget."""
    out = []
    rows = rows[np.argsort([len(index.items[i]) for i in rows[:, 1]], kind="stable")]
    one = np.int64(1) << np.int64(32)
    for a in range(0, len(rows), ALIGNED):
        part = rows[a : a + ALIGNED]
        k = index.budgets[part[:, 1]]
        sizes = np.array([len(index.items[i]) for i in part[:, 1]])
        wide = int((part[:, 3] - part[:, 2] + 2 * k + 1).max())
        low = part[:, 2] - k  # the first diagonal of each band
        begin, end = offs[part[:, 0]], offs[part[:, 0] + 1]
        span = np.arange(wide)
        pattern = np.zeros((len(part), int(sizes.max())), np.uint32)
        for i, r in enumerate(part[:, 1]):
            pattern[i, : sizes[i]] = index.items[r]
        # a cell holds edits and, below, where the match starts in the document (shifted to be positive)
        shift = np.int64(1 << 31)
        cost = np.broadcast_to(low[:, None] + span, (len(part), wide)) + shift // 2
        best = [None] * len(part)
        for r in range(1, int(sizes.max()) + 1):
            at = begin[:, None] + low[:, None] + span + (r - 1)
            valid = (at >= begin[:, None]) & (at < end[:, None])
            text = np.where(valid, codes[np.clip(at, 0, len(codes) - 1)], 0)
            new = cost + one * (text != pattern[:, r - 1 : r])
            new[:, :-1] = np.minimum(new[:, :-1], cost[:, 1:] + one)
            cost = np.minimum.accumulate(new - one * span, axis=1) + one * span
            for i in np.flatnonzero(sizes == r):
                w = int(cost[i].argmin())
                best[i] = (int(cost[i, w] >> 32), int(cost[i, w] & (one - 1)) - int(shift // 2), int(low[i]) + w + r)
        for i, (edits, start, stop) in enumerate(best):
            if edits <= k[i]:
                n = int(end[i] - begin[i])
                out.append((int(part[i, 0]), int(part[i, 1]), edits, max(0, start), min(stop, n)))
    return out


def tiny_matches(index: Index, codes: np.ndarray, offs: np.ndarray) -> list[tuple]:
    """(document, item, 0, start, end) of the first place of each item without a q-gram."""
    out = []
    for length, known in index.tiny.items():
        h = qgrams(codes, length)
        for p in np.flatnonzero(np.isin(h, np.array(list(known), np.uint64))):
            doc = int(np.searchsorted(offs, p, "right")) - 1
            if p + length <= offs[doc + 1]:
                out += [(doc, i, 0, int(p - offs[doc]), int(p - offs[doc]) + length) for i in known[int(h[p])]]
    return out


def _windows(offs: np.ndarray, reach: int):
    """(first document, from, to, offsets from there): all documents of usual length at once, a very long one in segments."""
    long = np.flatnonzero(np.diff(offs) > SEGMENT + reach)
    at = 0
    for d in [*long.tolist(), len(offs) - 1]:
        if d > at:
            yield at, int(offs[at]), int(offs[d]), offs[at : d + 1] - offs[at]
        if d < len(offs) - 1:
            for s in range(int(offs[d]), int(offs[d + 1]), SEGMENT):
                e = min(s + SEGMENT + reach, int(offs[d + 1]))
                yield d, s, e, np.array([0, e - s])
                if e == offs[d + 1]:
                    break
        at = d + 1


def matches(index: Index, texts: pa.Array):
    """(row, item number, edits, start, end) for each document and item found; start and end in characters of the text."""
    for a, b in pieces(texts, PIECE):
        raw, raw_offs = codes_of(texts.slice(a, b - a))
        codes, offs, at = folded(raw, raw_offs, fold_table(True))
        best: dict[tuple[int, int], tuple] = {}
        for first, lo, hi, here in _windows(offs, index.reach):
            part = codes[lo:hi]
            rows = candidates(index, part, here)
            found = align(index, part, here, rows) if len(rows) else []
            for doc, item, edits, start, stop in found + tiny_matches(index, part, here):
                shift = lo - int(offs[first]) if len(here) == 2 else 0  # a segment's place in its document
                key, got = (doc + first, item), (edits, start + shift, stop + shift)
                if key not in best or got[:2] < best[key][:2]:
                    best[key] = got
        for (doc, item), (edits, start, stop) in sorted(best.items()):
            n, base = int(raw_offs[doc + 1] - raw_offs[doc]), int(raw_offs[doc])
            first = max(0, int(at[min(offs[doc] + start, offs[doc + 1] - 1)]) - base)
            last = int(at[max(offs[doc], min(offs[doc] + stop, offs[doc + 1]) - 1)])
            yield a + doc, item, edits, first, n if last < 0 else min(n, last - base + 1)


def _blocks(items: DataFrame, id_col: str, text_col: str):
    """The items as broadcast indexes of at most about ``BLOCK`` characters."""
    spark = items.sparkSession
    total = items.agg(F.sum(F.length(text_col))).first()[0] or 0
    count = -(-total // BLOCK) or 1
    for i in range(count):
        rows = items.filter(F.pmod(F.xxhash64(id_col), F.lit(count)) == i).select(id_col, text_col).collect()
        rows.sort(key=lambda r: (r[0] is None, r[0], r[1] or ""))
        index = index_items([r[0] for r in rows], [r[1] for r in rows])
        if index.items:
            yield spark.sparkContext.broadcast(index)


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per document and item found in it: id, item id, edits, the budget of edits, start, end."""
    schema = T.StructType([docs.schema[id_col], T.StructField("_item", items.schema[item_id].dataType), T.StructField("edits", T.IntegerType()), T.StructField("budget", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    out = docs.sparkSession.createDataFrame([], schema)
    item_type = pa.int64() if isinstance(items.schema[item_id].dataType, (T.LongType,)) else None

    def finder(held):
        def run(batches):
            for batch in batches:
                found = list(matches(held.value, texts_of(batch.column(1))))
                rows = pa.array([f[0] for f in found], pa.int64())
                ids = pa.array([held.value.ids[f[1]] for f in found], item_type)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(rows), ids, pa.array([f[2] for f in found], pa.int32()), pa.array([int(held.value.budgets[f[1]]) for f in found], pa.int32()), pa.array([f[3] for f in found], pa.int64()), pa.array([f[4] for f in found], pa.int64())],
                    [id_col, "_item", "edits", "budget", "start", "end"],
                )

        return run

    for held in _blocks(items, item_id, item_text):
        out = out.unionByName(docs.select(id_col, text_col).mapInArrow(finder(held), schema))
    return out.withColumnRenamed("_item", item_id)


def clean(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs`` in which no item is found."""

    def keeper(held):
        def run(batches):
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                for found in matches(held.value, texts_of(batch.column(batch.schema.get_field_index(text_col)))):
                    keep[found[0]] = False
                yield batch.filter(pa.array(keep))

        return run

    for held in _blocks(items, item_id, item_text):
        docs = docs.mapInArrow(keeper(held), docs.schema)
    return docs


def op7_decontaminate(spark, sf_dir: str) -> DataFrame:
    prepare(spark)
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
