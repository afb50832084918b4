"""Contiguous sharding with the least possible largest shard.

Groups of equal texts are the atoms, ordered by their least id.  The smallest capacity
that a greedy cut into ``shards`` contiguous runs can meet is found by binary search, and
the table is cut there.

The search never needs the atoms on the driver.  Their ends in the running total are
summarised as blocks (least end, greatest end, count), a bounded number of rows.  A
greedy check reads each block as far as it is known, once with the ends known for
certain (if that fits, the capacity is enough) and once with the best that the block
could hold (if that does not fit, it is too small).  Blocks that leave the answer open
are summarised again at a finer scale, until both searches meet; the result is exact.

Only DataFrame operations run on the cluster.  Nulls count as empty texts of size 1, so
are equal to empty texts; repeated rows are equal texts.  An atom larger than a fair
share makes one shard as large as itself; later shards may then be fewer.  An empty
table gives an empty result.
"""

from __future__ import annotations

import bisect

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import prepare, ranks, store, table, width

#: Blocks of the first summary, and parts of a block that is read again.
BLOCKS, PARTS, TRIED = 4096, 64, 9


class _Ends:
    """Blocks of the running total: starts[i] <= (end - 1) < starts[i + 1]."""

    def __init__(self, total: int):
        self.total, self.starts, self.known = total, [0], {}
        self.known[0] = None  # (least end, greatest end, count), or None if no end lies there

    def put(self, old: int, parts: list[tuple[int, tuple | None]]) -> None:
        i = bisect.bisect_left(self.starts, old)
        self.starts[i : i + 1] = [s for s, _ in parts]
        self.known.pop(old)
        self.known.update(parts)
        self.index()

    def index(self) -> None:
        self.last, best = [], 0  # greatest end before each block
        for s in self.starts:
            self.last.append(best)
            best = self.known[s][1] if self.known[s] else best

    def until(self, at: int) -> int:
        i = bisect.bisect_right(self.starts, at) 
        return self.starts[i] if i < len(self.starts) else self.total

    def reach(self, target: int, best: bool) -> tuple[int, int | None]:
        """(greatest end up to target as far as known, or as it might be; the block that leaves it open)."""
        if target >= self.total:
            return self.total, None
        if target <= 0:
            return 0, None
        i = bisect.bisect_right(self.starts, target - 1) - 1
        start, ends = self.starts[i], self.known[self.starts[i]]
        if ends is None or target < ends[0]:
            return self.last[i], None
        if target >= ends[1]:
            return ends[1], None
        if ends[2] <= 2:
            return ends[0], None
        return (target if best else ends[0]), start

    def fits(self, capacity: int, shards: int, best: bool) -> tuple[bool, set[int], list[int]]:
        at, open_, cuts = 0, set(), []
        for _ in range(shards):
            if at >= self.total:
                break
            nxt, block = self.reach(at + capacity, best)
            if block is not None:
                open_.add(block)
            if nxt <= at:
                return False, open_, cuts
            at = nxt
            cuts.append(at)
        return at >= self.total, open_, cuts


def _least(low: int, high: int, fits) -> int:
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if fits(mid) else (mid + 1, high)
    return low


def minimax_cuts(ends: DataFrame, total: int, largest: int, shards: int) -> list[int]:
    """The ends at which to cut, from a frame with the column ``end`` (running totals of the atoms)."""
    if not total:
        return []
    known = _Ends(total)

    def summarise(blocks: list[tuple[int, int]], parts: int) -> None:
        """Read the ends in the blocks (start, until), each cut into ``parts``."""
        steps = {s: max(1, -(-(u - s) // parts)) for s, u in blocks}
        which = F.col("end") - 1
        case, part, inside = None, None, None
        for s, u in blocks:
            here = (which >= s) & (which < u)
            inside = here if inside is None else inside | here
            case = F.when(here, F.lit(s)) if case is None else case.when(here, F.lit(s))
            step = F.floor((which - s) / steps[s])
            part = F.when(here, step) if part is None else part.when(here, step)
        rows = (
            ends.filter(inside)
            .groupBy(case.cast("long").alias("s"), part.cast("long").alias("p"))
            .agg(F.min("end").alias("a"), F.max("end").alias("b"), F.count(F.lit(1)).alias("n"))
            .collect()
        )
        found: dict[int, dict[int, tuple]] = {}
        for r in rows:
            found.setdefault(r["s"], {})[r["p"]] = (r["a"], r["b"], r["n"])
        for s, u in blocks:
            known.put(s, [(s + i * steps[s], found.get(s, {}).get(i)) for i in range(-(-(u - s) // steps[s]))])

    summarise([(0, total)], BLOCKS)
    low, high = max(largest, -(-total // shards)), -(-total // shards) + largest
    while True:
        high = _least(low, high, lambda c: known.fits(c, shards, False)[0])
        low = _least(low, high, lambda c: known.fits(c, shards, True)[0])
        if low == high:
            return known.fits(high, shards, False)[2]
        unsure: set[int] = set()
        for i in range(TRIED):
            c = low + (high - low) * i // (TRIED - 1)
            unsure |= known.fits(c, shards, True)[1] | known.fits(c, shards, False)[1]
        summarise([(s, known.until(s)) for s in sorted(unsure)], PARTS)


def running_totals(atoms: DataFrame, order: list[str], size: str) -> DataFrame:
    """``atoms`` with ``end``, the running total of ``size``: inside ranges of the order, plus what earlier ranges hold."""
    spark = atoms.sparkSession
    dealt = store(atoms.repartitionByRange(width(spark), *[F.col(c) for c in order]).withColumn("_range", F.spark_partition_id()), "atoms")
    before = dealt.groupBy("_range").agg(F.sum(size).alias("_n")).select(
        "_range", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before")
    )  # one row for each range
    inner = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        dealt.withColumn("_inner", F.sum(size).over(inner))
        .join(F.broadcast(before), "_range")
        .withColumn("end", F.col("_before") + F.col("_inner"))
        .drop("_inner", "_before", "_range")
    )


def shard_documents(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, size, text_crc32, law, shard, slot, grown_shard."""
    text = F.coalesce(text_col, F.lit(""))
    rows = store(
        docs.select(
            F.col(id_col).alias("_id"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text).cast("long").alias("text_crc32"),
            F.unhex(F.sha2(text, 256)).alias("_atom"),
        ),
        "rows",
    )
    atoms = rows.groupBy("_atom").agg(F.min("_id").alias("_first"), F.sum("size").alias("_size"))
    ends = store(running_totals(atoms, ["_first", "_atom"], "_size"), "ends")
    sums = ends.agg(F.sum("_size"), F.max("_size")).first()
    cuts = minimax_cuts(ends, sums[0] or 0, sums[1] or 0, shards)
    shard = F.lit(0)
    for c in cuts[:-1]:
        shard = shard + (F.col("end") > F.lit(c)).cast("int")
    placed = rows.join(ends.select("_atom", shard.cast("int").alias("shard")), "_atom").drop("_atom")
    return ranks(placed, ["shard"], ["_id", "text_crc32", "size"], "slot").select(
        F.col("_id").alias(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op1_sharding(spark, sf_dir: str) -> DataFrame:
    prepare(spark)
    return shard_documents(table(spark, sf_dir, "documents"))
