"""Removal of repeated passages: bytes covered by a string of ``LENGTH`` bytes that also starts earlier.

Equal strings are brought together by content.  Of the ``GRAM``-byte grams in a string of
LENGTH bytes the one with the least hash (the leftmost of these) is its anchor; equal
strings have equal anchors at equal places, and strings that follow each other mostly
share one.  A run of such strings is one snippet, about 35 starts on average, whose key is
its anchor's hash.

1. Every text is read and the anchors' hashes are counted.  Those that occur twice or more
   become a filter of fixed size; no other part of a text can hold a repeat.
2. Texts are read again and the snippets that pass the filter are kept.  Of equal snippets
   the earliest stays and all strings of the others are repeats: in each task first, so
   that a very frequent passage never meets in one task, and then over all tasks.
3. Where an anchor has several different snippets, shards of whole anchors go through
   external induced sorting (``esais``): a suffix array with common-prefix values; runs of
   suffixes that share LENGTH bytes show which strings of these snippets start earlier.
4. Repeats are put together per document, and the rest of each text is hashed.

Strings are judged on the input, whatever is removed elsewhere, and never cross documents.
Nulls count as empty texts.  Documents of fewer than LENGTH bytes keep all.  Rows with the
same id and the same text are one document, as are rows with a null id; of documents that
share an id but not their text each is judged by place (id, text's hash).  An empty table
gives an empty result; other columns don't matter.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, key_filter, maybe_in, mixed, pieces, prepare, store, table, texts_of, utf8_of, width
from .esais import repeats

LENGTH, GRAM, BITS, PIECE, SEEN, SHARD = 100, 32, 26, 1 << 17, 1 << 20, 1 << 20
BASE, PLACE = 0x9E3779B97F4A7C15, 24
MASK = np.uint64((1 << PLACE) - 1)
SEGMENT = (1 << (PLACE - 1)) - LENGTH


def gram_hashes(raw: np.ndarray) -> np.ndarray:
    """A hash of the GRAM (a power of two) bytes from each place on."""
    h, span = raw.astype(np.uint64) + np.uint64(1), 1
    while span < GRAM:
        h = h[:-span] * np.uint64(pow(BASE, span, 1 << 64)) + h[span:] if len(h) > span else h[:0]
        span *= 2
    return mixed(h)


def window_least(x: np.ndarray, w: int) -> np.ndarray:
    """The least of every w values in a row, by running minima from both ends of blocks of w."""
    n = len(x) - w + 1
    blocks = -(-len(x) // w)
    padded = np.full(blocks * w, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(x)] = x
    grid = padded.reshape(blocks, w)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[w - 1 : w - 1 + n])


def runs(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor's hash, anchor's place, first start, last start) of each run of strings with one anchor; places in ``raw``."""
    none = np.zeros(0, np.int64)
    if len(raw) < LENGTH:
        return none.astype(np.uint64), none, none, none
    h = gram_hashes(raw)
    keyed = (h & ~MASK) | np.arange(len(h), dtype=np.uint64)
    owner = (window_least(keyed, LENGTH - GRAM + 1) & MASK).astype(np.int64)
    valid = np.zeros(len(owner) + 1, bool)
    sizes = np.diff(offs)
    long = np.flatnonzero(sizes >= LENGTH)
    mark = np.zeros(len(owner) + 1, np.int32)
    np.add.at(mark, offs[long], 1)
    np.add.at(mark, offs[long] + sizes[long] - LENGTH + 1, -1)
    valid = np.cumsum(mark)[: len(owner)] > 0
    first = np.zeros(len(raw) + 1, bool)
    first[offs[:-1]] = True
    new = valid.copy()
    new[1:] &= (owner[1:] != owner[:-1]) | first[1 : len(owner)] | ~valid[:-1]
    starts = np.flatnonzero(new)
    stops = np.concatenate((starts[1:], [len(owner)]))
    ends = np.cumsum(valid)
    last = starts + (ends[stops - 1] - ends[starts])  # valid starts of a run stand together
    return h[owner[starts]], owner[starts], starts, last


def segments(texts: pa.Array):
    """(row, offset of the segment in its text, bytes, offsets) pieces of texts; a very long text in segments that overlap."""
    for a, b in pieces(texts, PIECE):
        raw, offs = utf8_of(texts.slice(a, b - a))
        if b - a == 1 and len(raw) > SEGMENT:
            for s in range(0, len(raw) - LENGTH + 1, SEGMENT):
                part = raw[s : s + SEGMENT + LENGTH - 1]
                yield a, s, part, np.array([0, len(part)])
        else:
            yield a, 0, raw, offs


def _anchors(rows: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            for _, _, raw, offs in segments(texts_of(batch.column(0))):
                yield pa.RecordBatch.from_arrays([pa.array(runs(raw, offs)[0].view(np.int64))], ["h"])

    return rows.select("_text").mapInArrow(run, "h long")


def _snippets(rows: DataFrame, held) -> DataFrame:
    """Snippets whose anchor passes the filter: h, d (a digest; with h 128 bits), node, tie, start, size (strings)
    and the bytes, null where an equal snippet that stands earlier was seen in the task."""

    def run(batches):
        words, seen = held.value, {}
        for batch in batches:
            ids, ties = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for row, shift, raw, offs in segments(texts_of(batch.column(2))):
                h, _, start, last = runs(raw, offs)
                slot = h & np.uint64((1 << BITS) - 1)
                pick = np.flatnonzero((words[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1))
                if not len(pick):
                    continue
                doc = np.searchsorted(offs, start[pick], "right") - 1
                local = start[pick] - offs[doc] + shift
                data, digests, texts = raw.tobytes(), [], []
                owners = [(ids[row + d], ties[row + d]) for d in doc.tolist()]
                for owner, s, e, place in zip(owners, start[pick].tolist(), last[pick].tolist(), local.tolist(), strict=True):
                    text = data[s : e + LENGTH]
                    mark = hashlib.blake2b(text, digest_size=8).digest()
                    before, here = seen.get(mark), (*owner, place)
                    if before is None or here <= before:
                        if len(seen) >= SEEN:
                            seen.clear()
                        seen[mark] = here
                        texts.append(text)
                    else:
                        texts.append(None)
                    digests.append(mark)
                columns = [
                    pa.array(h[pick].view(np.int64)), pa.array(np.frombuffer(b"".join(digests), np.int64)), pa.array([o[0] for o in owners], pa.int64()), pa.array([o[1] for o in owners], pa.int64()),
                    pa.array(local), pa.array(last[pick] - start[pick] + 1), pa.array(texts, pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["h", "d", "node", "tie", "start", "size", "snippet"])

    return rows.select("_node", "_tie", "_text").mapInArrow(run, "h long, d long, node long, tie long, start long, size long, snippet binary")


def _resolve(rows: DataFrame) -> DataFrame:
    """(node, tie, start, size) of the repeats among different snippets of one anchor; rows (h, node, tie, start, size,
    snippet) come sorted by anchor."""

    def shard(held: list):
        held.sort(key=lambda r: r[1:4])  # so that the earlier of two strings is the one with the lower place
        found = repeats([r[5] for r in held], [r[4] for r in held], LENGTH)
        out = [[], [], [], []]
        for r, flags in zip(held, found, strict=True):
            edges = np.flatnonzero(np.diff(np.concatenate(([0], flags.view(np.int8), [0]))))
            for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
                for column, v in zip(out, (r[1], r[2], r[3] + a, b - a), strict=True):
                    column.append(v)
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["node", "tie", "start", "size"])

    def run(batches):
        held, size, last = [], 0, None
        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size > SHARD and r[0] != last:
                    yield shard(held)
                    held, size = [], 0
                held.append(r)
                size += len(r[5])
                last = r[0]
        if held:
            yield shard(held)

    return rows.mapInArrow(run, "node long, tie long, start long, size long")


def _finish(rows: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            out = []
            for text, spans in zip((x.as_py() for x in texts_of(batch.column(1))), batch.column(2).to_pylist(), strict=True):
                raw = text.encode("utf-8")
                kept, upto, removed, count = hashlib.sha256(), 0, 0, 0
                end = -1
                for s in sorted(spans or [], key=lambda s: (s["start"], s["size"])):
                    a, b = s["start"], s["start"] + s["size"] - 1 + LENGTH
                    if a > end:
                        kept.update(raw[upto:a])
                        count += 1
                        removed += b - a
                    elif b > end:
                        removed += b - end
                    end = max(end, b)
                    upto = end
                kept.update(raw[upto:])
                out.append((len(raw), removed, count, kept.hexdigest()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([o[i] for o in out], pa.int64()) for i in range(3)], pa.array([o[3] for o in out], pa.string())], ["_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return rows.mapInArrow(run, "_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_bytes, n_removed, n_spans, kept_sha256."""
    spark = docs.sparkSession
    text = F.coalesce(text_col, F.lit(""))
    node = F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)))
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), text.alias("_text"), node.alias("_node"), F.xxhash64(text).alias("_tie"))
    often = _anchors(rows).groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    mask = key_filter(often, F.col("h"), BITS).toArrow()  # at most 2^BITS / 64 rows of two longs
    words = np.zeros(1 << (BITS - 6), np.uint64)
    words[mask.column(0).to_numpy()] = mask.column(1).to_numpy().view(np.uint64)
    found = store(_snippets(rows, spark.sparkContext.broadcast(words)), "snippets")

    span = ["node", "tie", "start", "size"]
    # equal snippets: in a task's rows at most a few of each are left, so none fills a partition
    earliest = Window.partitionBy("h", "d").orderBy("node", "tie", "start")
    ahead = found.filter("snippet is not null").select("h", "d", *span)
    placed = store(ahead.select("h", *span, (F.rank().over(earliest) > 1).alias("repeat"), (F.row_number().over(earliest) == 1).alias("first")), "placed")
    first = placed.filter("first").select("h", *span)
    several = store(first.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h"), "several")
    texts = maybe_in(found.filter("snippet is not null"), F.col("h"), store(key_filter(several, F.col("h")), "filter"), "_open").filter("_open")
    open_ = (
        texts.select("h", *span, "snippet")
        .join(first.join(several, "h").select("h", "node", "tie", "start"), ["h", "node", "tie", "start"])
        .dropDuplicates(["h", "node", "tie", "start"])
        .repartition(width(spark), "h")
        .sortWithinPartitions("h")
    )
    spans = found.filter("snippet is null").select(span).union(placed.filter("repeat").select(span)).union(_resolve(open_))
    # what an earlier copy of a snippet loses, its later copies have lost already
    per_doc = store(spans.groupBy("node", "tie").agg(F.collect_list(F.struct("start", "size")).alias("spans")), "per_doc")  # of one text, no more than its strings
    for done in (found, placed, several):
        discard(done)
    flagged = maybe_in(rows, F.xxhash64("_node"), store(key_filter(per_doc, F.xxhash64("node")), "filter"), "_open")
    touched = flagged.filter("_open").join(per_doc, (F.col("_node") == F.col("node")) & (F.col("_tie") == F.col("tie")), "left").select("_id", "_text", "spans")
    whole = flagged.filter("not _open").select("_id", F.octet_length("_text").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.sha2("_text", 256).alias("kept_sha256"))
    return whole.unionByName(_finish(touched)).withColumnRenamed("_id", id_col)


def op2_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    prepare(spark)
    return suffix_dedup(table(spark, sf_dir, "documents"))
