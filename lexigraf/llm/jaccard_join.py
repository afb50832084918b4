"""Similarity join on word shingles: MinHash LSH forest, then exact verification.

A text's words are its runs of characters other than ASCII white space; its shingles are
all runs of ``WORDS`` words, or all its words together if they are fewer.  Texts with the
same words in the same order are one class of copies, represented by the least id.

Each representative gets ``TREES`` keys of ``DEPTH`` MinHash values.  A tree's keys, dealt
by range and sorted, are its prefix trie in order: representatives that share a prefix
stand side by side, whatever the number of them, so a large group spreads over tasks.
Prefixes have the longest length by which a pair exactly at the threshold meets with
probability ``RECALL``.  Runs with the same prefix are tied to their first member, and the
components of these ties are the candidate sets: linear in size where pairs would be
quadratic.

What the forest does not bring together is found exactly, so no link depends on chance or
on a sample.  All shingles have one order: first those whose slot in a table of counts over
all texts is lower, then by hash.  Two sets of which one holds n shingles and that reach
the threshold share one of the first n - ceil(SIMILARITY n) + 1 of each.  These first
shingles of all texts meet; of those that stand in different candidate sets, pairs are
formed, and sets are joined where a pair's shared first shingles and all that may follow
them suffice for the threshold.  The counts decide only what that costs.

Candidate sets are verified in units of at most two blocks of about ``BLOCK``
representatives, one unit for each pair of blocks, so no set is gathered in one task.
A unit counts shared shingles of all its pairs exactly, and gives each representative's
number of links and the least representative it is tied to; no pair is ever a row.  The
components of the verified links are the classes.

Nulls count as empty texts.  Texts without words are copies of each other without links.
Rows with the same id are the same document.  A null id is below all others.  An empty
table gives an empty result; other columns don't matter.
"""

from __future__ import annotations

import functools
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, join_hot, key_filter, maybe_in, mixed, pieces, prepare, store, table, texts_of, utf8_of, width

WORDS, SIMILARITY, TREES, DEPTH, RECALL, BLOCK, PIECE, COLUMNS = 5, 0.8, 24, 8, 0.999, 512, 1 << 17, 4096
#: log2 of the slots of the table of counts; the parts it is added up in; first shingles that a worker sorts at a time.
SLOTS, PARTS, SORTED = 21, 64, 1 << 20
#: For reports on the forest alone: texts by which recall is measured, of at most so many shingles; those with a partner that it needs; bits of a filter.
SAMPLE, SHORT, ENOUGH, BITS = 256, 2048, 30, 22
BASE, STEP, NONE = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, -(1 << 63)


@functools.cache
def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def powers(base: int, n: int) -> np.ndarray:
    return _powers(base & ((1 << 64) - 1), 1 << max(10, (max(1, n) - 1).bit_length()))[:n]


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, offsets of each text's words)"""
    raw, offs = utf8_of(texts)
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(len(offs), np.int64)
    solid = (raw != 32) & ((raw < 9) | (raw > 13))
    first = np.zeros(len(raw) + 1, bool)
    first[offs[:-1]] = True  # a text's first byte begins a word whatever stands before
    opens = np.flatnonzero(solid & (first[:-1] | np.concatenate(([True], ~solid[:-1]))))
    ends = np.flatnonzero(solid & (np.concatenate((first[1:-1], [True])) | np.concatenate((~solid[1:], [True])))) + 1
    inverse = pow(BASE, -1, 1 << 64)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(raw.astype(np.uint64) * powers(BASE, len(raw)) + np.uint64(0))))
    h = (sums[ends] - sums[opens]) * powers(inverse, len(raw))[opens]
    return mixed(h + (ends - opens).astype(np.uint64) * np.uint64(STEP)), np.searchsorted(opens, offs)


def shingles_of(words: np.ndarray, offs: np.ndarray, k: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each shingle, offsets of each text's shingles); shingles may repeat."""
    count = np.diff(offs)
    n = np.where(count >= k, count - k + 1, (count > 0).astype(np.int64))
    out = np.concatenate(([0], np.cumsum(n)))
    text = np.repeat(np.arange(len(n)), n)
    start = offs[text] + np.arange(out[-1]) - out[text]
    h = np.zeros(len(start), np.uint64)
    for j in range(k):
        at = start + j
        there = at < offs[text + 1]
        h = h * np.uint64(STEP) + np.where(there, words[np.minimum(at, max(0, len(words) - 1))] if len(words) else 0, 1).astype(np.uint64)
    return mixed(h), out


def signatures(shingles: np.ndarray, offs: np.ndarray, number: int) -> np.ndarray:
    """``number`` 16-bit MinHash values of each text; zeros without shingles."""
    rng = np.random.default_rng(7)
    odd, flip = rng.integers(0, 1 << 31, number, dtype=np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 1 << 32, number, dtype=np.uint32)
    out = np.zeros((len(offs) - 1, number), np.uint16)
    full = np.flatnonzero(np.diff(offs) > 0)
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    # some texts at a time, so that the values stay near the processor
    a = 0
    while a < len(full):
        b = max(a + 1, int(np.searchsorted(offs[full], offs[full[a]] + 32768, "left")))
        rows = full[a:b]
        here, starts = x[offs[rows[0]] : offs[rows[-1] + 1]], offs[rows] - offs[rows[0]]
        for j in range(number):
            least = np.minimum.reduceat((here ^ flip[j]) * odd[j], starts)
            out[rows, j] = (least * np.uint32(0x9E3779B1)) >> np.uint32(16)
        a = b
    return out


def prefix_depth(trees: int, depth: int, similarity: float, recall: float) -> int:
    """The longest prefix by which a pair at the threshold meets with the wanted probability."""
    while depth > 1 and 1 - (1 - similarity**depth) ** trees < recall:
        depth -= 1
    return depth


def class_key(words: np.ndarray, offs: np.ndarray, base: int) -> np.ndarray:
    """A hash of each text's words in their order."""
    count = np.diff(offs)
    inside = np.arange(len(words)) - np.repeat(offs[:-1], count)
    most = int(count.max()) if len(count) else 0
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mixed(words + np.uint64(base)) * powers(base, most)[inside])))
    return (sums[offs[1:]] - sums[offs[:-1]]).view(np.int64)


def _digest(docs: DataFrame, trees: int, depth: int) -> DataFrame:
    """Per document: _id, words' hashes c1 and c2 (the class of copies), number of shingles, signature."""

    def run(batches):
        for batch in batches:
            texts = texts_of(batch.column(1))
            for a, b in pieces(texts, PIECE):
                words, offs = words_of(texts.slice(a, b - a))
                c = [class_key(words, offs, base) for base in (BASE, STEP)]
                shingles, at = shingles_of(words, offs)
                sig = signatures(shingles, at, trees * depth)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(c[0]), pa.array(c[1]), pa.array(np.diff(at)), pa.array([r.tobytes() for r in sig.astype(">u2")], pa.binary())],
                    ["_id", "c1", "c2", "n", "sig"],
                )

    return docs.select("_id", "_text").mapInArrow(run, "_id long, c1 long, c2 long, n long, sig binary")


def _unique(texts: pa.Array):
    """The distinct shingles of each text."""
    for a, b in pieces(texts, PIECE):
        shingles, at = shingles_of(*words_of(texts.slice(a, b - a)))
        for s, e in zip(at[:-1], at[1:], strict=True):
            yield np.unique(shingles[s:e])


def measured_recall(rows: DataFrame, reps: DataFrame, similarity: float, trees: int, depth: int, sample: int = SAMPLE) -> tuple[int, list[float]]:
    """(sampled texts with a partner, recall by prefix length from 1): pairs of about ``sample`` representatives with all texts."""
    spark = rows.sparkSession
    short = reps.filter(F.col("n") <= SHORT)
    span = 1 << 30
    cut = int(span * min(1.0, sample / max(1, short.count()))) + 1
    picked = short.filter(F.pmod(F.xxhash64(F.lit(11), "_id"), F.lit(span)) < cut).select("_id")

    def sets(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([u.tobytes() for u in _unique(batch.column(1))], pa.binary())], ["id", "u"])

    # at most about ``sample`` sets of SHORT numbers; rows that share an id count once
    asked = rows.join(F.broadcast(picked), "_id", "left_semi").mapInArrow(sets, "id long, u binary").groupBy("id").agg(F.min("u").alias("u")).collect()
    if not asked:
        return 0, [1.0] * depth
    ids = np.array([r[0] for r in asked])
    each = [np.frombuffer(r[1], np.uint64) for r in asked]
    every = np.concatenate(each)
    order = np.argsort(every, kind="stable")
    keys, owner = every[order], np.repeat(np.arange(len(each)), [len(e) for e in each])[order]
    present = np.zeros(1 << BITS, bool)
    present[keys >> np.uint64(64 - BITS)] = True
    held = spark.sparkContext.broadcast((ids, np.array([len(e) for e in each]), keys, owner, present))

    def meet(batches):
        ids, sizes, keys, owner, present = held.value
        for batch in batches:
            a, b = [], []
            nodes = batch.column(0).to_numpy()
            for i, u in enumerate(_unique(batch.column(1))):
                near = u[present[u >> np.uint64(64 - BITS)]]
                lo, hi = np.searchsorted(keys, near, "left"), np.searchsorted(keys, near, "right")
                n = hi - lo
                if n.sum() < similarity * len(u) - 1e-6:
                    continue
                both = np.bincount(owner[np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)], minlength=len(ids))
                for k in np.flatnonzero((both > 0) & (both >= similarity * (sizes + len(u) - both) - 1e-6)):
                    if ids[k] != nodes[i]:
                        a.append(ids[k])
                        b.append(nodes[i])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    def longest(batches):
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), ">u2").reshape(batch.num_rows, trees, depth) for k in (1, 2))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.logical_and.accumulate(x == y, axis=2).sum(2).max(1, initial=0))], ["a", "lcp"])

    pairs = store(rows.mapInArrow(meet, "a long, b long").distinct(), "pairs")
    sig = reps.select("_id", "sig")
    met = pairs.join(sig.withColumnsRenamed({"_id": "b", "sig": "y"}), "b").join(sig.withColumnsRenamed({"_id": "a", "sig": "x"}), "a").select("a", "x", "y")
    by_text = met.mapInArrow(longest, "a long, lcp long").groupBy("a").agg(*[F.avg((F.col("lcp") >= d).cast("double")).alias(f"r{d}") for d in range(1, depth + 1)])
    got = by_text.agg(F.count(F.lit(1)), *[F.coalesce(F.avg(f"r{d}"), F.lit(1.0)) for d in range(1, depth + 1)]).first()
    return got[0], list(got[1:])


def shortened(measured: tuple[int, list[float]], trees: int, depth: int, similarity: float, recall: float) -> int:
    """The longest prefix that has the wanted recall; where too little was measured, by the probability at the threshold."""
    seen, found = measured
    if seen < ENOUGH:
        return prefix_depth(trees, depth, similarity, recall)
    while depth > 1 and found[depth - 1] < recall:
        depth -= 1
    return depth


def _ties(keys: DataFrame, length: int) -> DataFrame:
    """(a, b): each representative with the first of its run of equal prefixes.

    ``keys`` are dealt by range and sorted; the first and the last run of each task also give
    their prefix, by which runs that go on in the next task are tied."""

    def run(batches):
        last, head, seen = None, None, 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            raw, offs = batch.column(0), None
            offs = np.frombuffer(raw.buffers()[1], np.int32)[raw.offset : raw.offset + n + 1]
            rows = np.frombuffer(raw.buffers()[2], np.uint8)[offs[0] : offs[-1]].reshape(n, -1)[:, :length]
            ids = batch.column(1).to_numpy()
            new = np.ones(n, bool)
            new[1:] = (rows[1:] != rows[:-1]).any(1)
            new[0] = last is None or rows[0].tobytes() != last
            starts = np.flatnonzero(new)
            run_of = np.cumsum(new) - 1
            first = np.where(run_of >= 0, ids[starts[np.maximum(run_of, 0)]] if len(starts) else 0, head if head is not None else 0)
            tied = ~new
            out_a, out_b, out_k = list(ids[tied]), list(first[tied]), [None] * int(tied.sum())
            if not seen:
                out_a.append(ids[0]), out_b.append(ids[0]), out_k.append(rows[0].tobytes())
            last, head, seen = rows[-1].tobytes(), first[-1], 1
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64()), pa.array(out_k, pa.binary())], ["a", "b", "k"])
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([head], pa.int64()), pa.array([head], pa.int64()), pa.array([last], pa.binary())], ["a", "b", "k"])

    found = store(keys.mapInArrow(run, "a long, b long, k binary"), "ties")
    edge = found.filter("k is not null").select("k", "b")  # two rows for each task
    across = edge.join(edge.groupBy("k").agg(F.min("b").alias("a")), "k").select("a", "b")
    return found.filter("k is null").select("a", "b").union(across).filter("a <> b")


def needed(n, similarity: float):
    """The least number of shingles that a set of n shares with any that reaches the threshold."""
    return np.maximum(1, np.ceil(similarity * n - 1e-5)).astype(np.int64)


def _levels(rows: DataFrame) -> np.ndarray:
    """For each slot of the shingles' first bits the bits that the number of shingles of all texts in it takes."""

    def count(batches):
        total, held, waiting = np.zeros(1 << SLOTS, np.int64), [], 0

        def add():
            nonlocal held, waiting
            if held:
                total[:] += np.bincount(np.concatenate(held), minlength=1 << SLOTS)
            held, waiting = [], 0

        for batch in batches:
            texts = texts_of(batch.column(0))
            for a, b in pieces(texts, PIECE):
                shingles, _ = shingles_of(*words_of(texts.slice(a, b - a)))
                held.append((shingles >> np.uint64(64 - SLOTS)).astype(np.int64))
                waiting += len(shingles)
                if waiting > SORTED:
                    add()
        add()
        parts = [(k, c.astype("<u4").tobytes()) for k, c in enumerate(np.split(np.minimum(total, (1 << 32) - 1), PARTS)) if c.any()]
        packed = [zlib.compress(c, 1) for _, c in parts]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in parts], pa.int32()), pa.array(packed, pa.binary())], ["part", "counts"])

    def add_up(batches):
        sums = {}
        for batch in batches:
            for k, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[k] = sums.get(k, 0) + np.frombuffer(zlib.decompress(packed), "<u4").astype(np.int64)
        bits = [np.frexp(c.astype(np.float64))[1].astype(np.uint8).tobytes() for c in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(bits, pa.binary())], ["part", "bits"])

    parts = rows.select("_text").mapInArrow(count, "part int, counts binary").repartition(min(PARTS, width(rows.sparkSession)), "part")
    out = np.zeros((PARTS, (1 << SLOTS) // PARTS), np.uint8)
    for k, bits in parts.mapInArrow(add_up, "part int, bits binary").collect():
        out[k] = np.frombuffer(bits, np.uint8)
    return out.ravel()


def _firsts(rows: DataFrame, buckets: int, similarity: float) -> DataFrame:
    """(h, c, n): the first shingles of each class of copies, where another class has the same among its first;
    c is the first key of the class, n its number of shingles.  Classes that share c stand for one another."""
    levels = rows.sparkSession.sparkContext.broadcast(_levels(rows))

    def sort(h, c, n):
        order = np.lexsort((c, h))
        h, c, n = h[order], c[order], n[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (c[1:] != c[:-1])
        return h[new], c[new], n[new]

    def take(batches):
        rank, held, waiting = levels.value, [], 0

        def flush():
            nonlocal held, waiting
            h, c, n = (np.concatenate(x) for x in zip(*held, strict=True))
            # the order prefers low first bits, so buckets go by the last ones
            h, c, n = sort(h << np.uint64(32) | h >> np.uint64(32), c, n)
            held, waiting = [], 0
            bucket = ((h >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
            cuts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
            spans = list(zip(cuts, [*cuts[1:], len(h)], strict=True))
            columns = [pa.array([x[a:b].tobytes() for a, b in spans], pa.binary()) for x in (h, c, n)]
            return pa.RecordBatch.from_arrays([pa.array(bucket[cuts].astype(np.int32)), *columns], ["bucket", "h", "c", "n"])

        for batch in batches:
            texts = texts_of(batch.column(0))
            for a, b in pieces(texts, PIECE):
                words, offs = words_of(texts.slice(a, b - a))
                keys = class_key(words, offs, BASE)
                shingles, at = shingles_of(words, offs)
                for k, s, e in zip(keys, at[:-1], at[1:], strict=True):
                    if s == e:
                        continue
                    u = np.unique(shingles[s:e])
                    first = len(u) - int(needed(len(u), similarity)) + 1
                    h = u[np.argsort(rank[u >> np.uint64(64 - SLOTS)], kind="stable")[:first]]
                    held.append((h, np.full(first, k), np.full(first, len(u), np.int64)))
                    waiting += first
                if waiting > SORTED:
                    yield flush()
        if held:
            yield flush()

    def meet(batches):
        def of(held):
            h, c, n = sort(*(np.frombuffer(b"".join(x), kind) for x, kind in zip(zip(*held, strict=True), (np.uint64, np.int64, np.int64), strict=True)))
            new = np.concatenate((h[1:] != h[:-1], [True]))
            some = ~(new & np.concatenate(([True], new[:-1])))
            h, c, n = h[some].view(np.int64), c[some], n[some]
            for a in range(0, len(h), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(x[a : a + (1 << 16)]) for x in (h, c, n)], ["h", "c", "n"])

        key, held = None, []
        for batch in batches:
            for bucket, *row in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if bucket != key and held:
                    yield from of(held)
                    held = []
                key = bucket
                held.append(row)
        if held:
            yield from of(held)

    taken = rows.select("_text").mapInArrow(take, "bucket int, h binary, c binary, n binary")
    dealt = taken.repartition(width(rows.sparkSession), "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(meet, "h long, c long, n long")


def _missed(rows: DataFrame, digest: DataFrame, classes: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b): all pairs of representatives of different candidate sets that may reach the threshold."""
    total = digest.agg(F.sum(F.ceil(F.col("n") * (1 - similarity)) + 1)).first()[0] or 0
    firsts = store(_firsts(rows, int(total) // SORTED + 1, similarity), "firsts")
    who = classes.join(sets, F.col("rep") == F.col("node"), "left").select(F.col("c1").alias("c"), "rep", F.coalesce("root", "rep").alias("root"))
    met = store(firsts.join(who, "c").select("h", "rep", "root", "n"), "met")
    sized = met.groupBy("h", "root").agg(F.count(F.lit(1)).alias("m"))
    groups = sized.groupBy("h").agg(F.sum("m").alias("size"), (F.count(F.lit(1)) > 1).alias("several"), F.max_by("root", F.struct("m", "root")).alias("major"))
    open_ = join_hot(met, groups, "h", "size", met.count()).filter("several")
    blocks = open_.withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int")).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    units = store(blocks.withColumn("p", F.explode(_pairs_of_blocks())).select("h", "p.i", "p.j", "block", "rep", "root", "n", "major"), "units")
    # the largest set among a shingle's texts meets the others, not itself
    one, two = (units.withColumnsRenamed({c: f"{c}{k}" for c in ("block", "rep", "root", "n", "major")}) for k in "12")
    near = one.filter("root1 <> major1").join(two, ["h", "i", "j"]).filter("root1 <> root2 and (root2 = major2 or rep1 < rep2) and (i = j or block1 <> block2)")
    near = near.filter(F.least("n1", "n2") >= similarity * F.greatest("n1", "n2") - 1e-5)
    # of the text whose first shingles end earlier, none but those after them may still be shared
    rest = F.greatest(F.ceil(similarity * F.greatest("n1", "n2") - 1e-5) - 1, F.lit(0))
    pairs = near.groupBy(F.greatest("rep1", "rep2").alias("a"), F.least("rep1", "rep2").alias("b")).agg(
        F.count(F.lit(1)).alias("both"), F.max(rest).alias("rest"), F.min(F.col("n1") + F.col("n2")).alias("sum")
    )
    return pairs.filter(F.col("both") + F.col("rest") >= similarity / (1 + similarity) * F.col("sum") - 1e-5).select("a", "b")


def _pairs_of_blocks():
    """The pairs of blocks, as (i, j) with i <= j, that a row of a block is needed in."""
    return F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least(k, F.col("block")).alias("i"), F.greatest(k, F.col("block")).alias("j")))


def shared(rows: list[np.ndarray], left: int) -> np.ndarray:
    """Numbers of shingles that each of the first ``left`` sets shares with each of the others (with each other, if there are no others)."""
    sizes = [len(r) for r in rows]
    _, column, count = np.unique(np.concatenate(rows), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(rows)), sizes)
    often = count[column] > 1
    row, column = row[often], column[often]
    number = np.cumsum(count > 1) - 1
    column = number[column]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    right = slice(left, None) if left < len(rows) else slice(None)
    out = np.zeros((left, len(rows) - left if left < len(rows) else left), np.float32)
    for a in range(0, int(number[-1]) + 1 if len(number) else 0, COLUMNS):
        lo, hi = np.searchsorted(column, [a, a + COLUMNS])
        has = np.zeros((len(rows), COLUMNS), np.float32)
        has[row[lo:hi], column[lo:hi] - a] = 1
        out += has[:left] @ has[right].T
    return out


def linked(rows: list[np.ndarray], left: int, similarity: float) -> np.ndarray:
    """For each pair of ``shared``, whether its Jaccard similarity reaches the threshold."""
    size = np.array([len(r) for r in rows], np.float64)
    mine, others = size[:left, None], (size[left:] if left < len(rows) else size)[None, :]
    both = shared(rows, left)
    return both >= similarity * (mine + others - both) - 1e-6


def _verify(units: DataFrame, similarity: float) -> DataFrame:
    """(id, links, root) for each representative of a unit that has links in it."""

    def unit(i: int, j: int, members: list[tuple[int, int, str]]):
        members.sort(key=lambda m: (m[1] != i, m[0]))
        ids = np.array([m[0] for m in members])
        left = sum(m[1] == i for m in members) if i != j else len(members)
        if len(members) < 2 or (i != j and left in (0, len(members))):
            return
        sets = []
        texts = pa.array([m[2] for m in members], pa.string())
        for a, b in pieces(texts, PIECE):
            shingles, at = shingles_of(*words_of(texts.slice(a, b - a)))
            sets += [np.unique(shingles[s:e]) for s, e in zip(at[:-1], at[1:], strict=True)]
        near = linked(sets, left, similarity)
        n = len(members)
        full = np.zeros((n, n), bool)
        if i == j:
            np.fill_diagonal(near, False)
            full = near
        else:
            full[:left, left:] = near
            full[left:, :left] = near.T
        links = full.sum(1)
        root = ids.copy()
        while True:
            low = np.minimum(root, np.where(full, root[None, :], np.iinfo(np.int64).max).min(1))
            if (low == root).all():
                break
            root = low
        some = links > 0
        yield ids[some], links[some], root[some]

    def run(batches):
        key, members = None, []
        for batch in batches:
            root, i, j, ids, blocks, texts = (batch.column(k).to_pylist() for k in range(6))
            for r, a, b, node, block, text in zip(root, i, j, ids, blocks, texts, strict=True):
                if key != (r, a, b):
                    for out in unit(key[1], key[2], members) if members else ():
                        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["id", "links", "root"])
                    key, members = (r, a, b), []
                members.append((node, block, text))
        for out in unit(key[1], key[2], members) if members else ():
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["id", "links", "root"])

    return units.mapInArrow(run, "id long, links long, root long")


def jaccard_join(docs: DataFrame, similarity: float = SIMILARITY, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, copy_of (the least id with the same words), class_id (the least id
    of all that are linked, directly or not) and n_links (texts within the threshold, copies counted as one)."""
    spark = docs.sparkSession
    used = prefix_depth(trees, depth, similarity, recall)
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NONE)).alias("_id"), F.coalesce(text_col, F.lit("")).alias("_text"))
    digest = store(_digest(rows, trees, depth), "digest")
    classes = store(digest.groupBy("c1", "c2").agg(F.min("_id").alias("rep")), "classes")
    reps = store(digest.filter("n > 0").join(classes.select(F.col("rep").alias("_id")), "_id", "left_semi").select("_id", "n", "sig"), "reps")
    parts = F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.concat(F.unhex(F.lpad(F.hex(t), 2, "0")), F.substring(F.col("sig"), t * (2 * depth) + 1, F.lit(2 * used))))
    keys = reps.select(F.explode(parts).alias("key"), "_id")
    keys = keys.repartitionByRange(width(spark), "key", "_id").sortWithinPartitions("key", "_id")
    sets = store(components(_ties(keys, 1 + 2 * used)), "sets")
    missed = store(_missed(rows, digest, classes, sets, similarity), "missed")
    if not missed.isEmpty():
        sets = store(components(missed.union(sets.select("node", "root"))), "sets")
    sets = sets.union(sets.select("root", "root").distinct())

    sizes = sets.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    members = store(sets.join(sizes, "root").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")), "members")
    open_ = maybe_in(rows, F.xxhash64("_id"), store(key_filter(members, F.xxhash64("node")), "filter"), "_open").filter("_open").drop("_open")
    held = open_.join(members, F.col("_id") == F.col("node"))
    units = (
        held.select("root", F.explode(_pairs_of_blocks()).alias("p"), "node", "block", "_text")
        .select("root", "p.i", "p.j", "node", "block", "_text")
        .repartition(width(spark), "root", "i", "j")
        .sortWithinPartitions("root", "i", "j")
    )
    found = store(_verify(units, similarity), "links")
    links = found.groupBy("id").agg(F.sum("links").alias("n_links"))
    roots = components(found.select(F.col("id").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "id")
    named = (
        classes.join(links.join(roots, "id", "left").withColumnRenamed("id", "rep"), "rep", "left")
        .withColumn("class_id", F.coalesce("root", "rep"))
        .withColumn("n_links", F.coalesce("n_links", F.lit(0)))
    )
    back = lambda c: F.when(F.col(c) != NONE, F.col(c))
    return digest.join(named, ["c1", "c2"]).select(back("_id").alias(id_col), back("rep").alias("copy_of"), back("class_id").alias("class_id"), "n_links")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", **how) -> DataFrame:
    """The rows of ``docs`` whose document has the least id of its class.  Texts of rows that are
    certainly kept are not shuffled."""
    joined = store(jaccard_join(docs, id_col=id_col, **how).filter(~F.col(id_col).eqNullSafe(F.col("class_id"))).select(F.col(id_col).cast("long").alias("_gone")).distinct(), "gone")
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), F.col(id_col).cast("long").alias("_id"))
    flagged = maybe_in(packed, F.xxhash64("_id"), store(key_filter(joined, F.xxhash64("_gone")), "filter"), "_maybe")
    sure = flagged.filter("not _maybe")
    rest = flagged.filter("_maybe").join(joined, F.col("_id").eqNullSafe(F.col("_gone")), "left_anti")
    return sure.union(rest).select("_doc.*")


def op4_jaccard_join(spark, sf_dir: str) -> DataFrame:
    prepare(spark)
    return jaccard_join(table(spark, sf_dir, "documents"))
