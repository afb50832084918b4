"""What the operators share: the shared folder, tables written to it, key
filters of fixed size, ranks that need no task to hold a whole group, and
Arrow helpers."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import functools
import os
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
#: Used only where the session names no shared folder, as in local tests.
LOCAL_SHARED = "file:///tmp/checkpoints"
#: log2 of the bits of a key filter: at most 2^24 / 64 rows of two longs are broadcast.
FILTER_BITS = 24
#: Rows of an Arrow batch: few, since texts may be very long.
BATCH = 256

_stored: dict[str, tuple[SparkSession, str]] = {}


def prepare(spark: SparkSession) -> None:
    """Let Python workers import this package, and keep Arrow batches small."""
    env = spark.sparkContext.environment
    path = env.get("PYTHONPATH", "")
    if ROOT not in path.split(os.pathsep):
        env["PYTHONPATH"] = f"{ROOT}{os.pathsep}{path}" if path else ROOT
    env.setdefault("OMP_NUM_THREADS", "1")
    env.setdefault("TOKENIZERS_PARALLELISM", "false")
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir is not set, and only one machine shares its own folders")
    root = root or LOCAL_SHARED
    return f"{root.rstrip('/')}/lexigraf-{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, tag: str) -> str:
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex[:12]}"
    _stored[path] = (spark, path)
    return path


def store(df: DataFrame, tag: str) -> DataFrame:
    """Cut lineage: write ``df`` as a table in the shared folder and read it again."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(df: DataFrame) -> None:
    """Delete the table of a frame that ``store`` gave and that nothing reads any more."""
    drop_path(df.sparkSession, df.stored_at)


def drop_path(spark: SparkSession, path: str) -> None:
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(conf).delete(where, True)
    _stored.pop(path, None)


def release(spark: SparkSession) -> None:
    """Delete the tables that ``store`` has written; frames that read them end with it."""
    for _, path in [x for x in _stored.values() if x[0] is spark]:
        drop_path(spark, path)


@atexit.register
def _release_all() -> None:
    for spark, path in list(_stored.values()):
        try:
            drop_path(spark, path)
        except Exception:  # the session may have ended; its folder is then the cluster's to clean
            _stored.pop(path, None)


def give_back() -> None:
    """Hand what this process has freed back to the system, where C's allocator would keep it."""
    with contextlib.suppress(OSError, AttributeError):  # an allocator that can't
        ctypes.CDLL(None).malloc_trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def width(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def fold_of(key: str | Column, folds: int) -> Column:
    """crc32 of the key as text, modulo ``folds``."""
    key = F.col(key) if isinstance(key, str) else key
    return F.pmod(F.crc32(key.cast("string")), F.lit(folds))


# --- key filters -----------------------------------------------------------


def _slot(hashed: Column, bits: int) -> Column:
    return F.pmod(hashed, F.lit(1 << bits))


def key_filter(keys: DataFrame, hashed: Column, bits: int = FILTER_BITS) -> DataFrame:
    """A one-hash filter of the keys: rows (word, mask), at most ``2**bits / 64`` of them
    whatever the number of keys, so it may be broadcast.  It has no false negatives."""
    return (
        keys.select(_slot(hashed, bits).alias("_s"))
        .groupBy(F.shiftright("_s", 6).alias("_word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(_s & 63 as int))")).alias("_mask"))
    )


def maybe_in(df: DataFrame, hashed: Column, keys: DataFrame, flag: str, bits: int = FILTER_BITS) -> DataFrame:
    """``df`` with a boolean column: false where the key is certainly not in the filter."""
    return (
        df.withColumn("_s", _slot(hashed, bits))
        .withColumn("_word", F.shiftright("_s", 6))
        .join(F.broadcast(keys), "_word", "left")
        .withColumn(flag, F.coalesce(F.expr("(shiftright(_mask, cast(_s & 63 as int)) & 1L) = 1L"), F.lit(False)))
        .drop("_s", "_word", "_mask")
    )


# --- ranks -----------------------------------------------------------------


def ranks(df: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    """Add the rank from 0 of each row in its group.

    Rows are dealt by ranges of (group, order), so a group of any size spreads over
    tasks; ranks inside a range are shifted by what earlier ranges hold of the group.
    At most one group continues from an earlier range into each range, so the shifts
    that are not 0 are no more than the ranges, and are broadcast.
    """
    spark = df.sparkSession
    keys = [F.col(c) for c in [*group, *order]]
    dealt = store(df.repartitionByRange(width(spark), *keys).withColumn("__range", F.spark_partition_id()), "ranks")
    shifts = (
        dealt.groupBy(*group, "__range")
        .agg(F.count(F.lit(1)).alias("__n"))
        .withColumn("__shift", F.sum("__n").over(Window.partitionBy(*group).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)))
        .filter("__shift > 0")
        .select(*[F.col(c).alias(f"__{c}") for c in group], F.col("__range").alias("__at"), "__shift")
    )
    same = F.col("__range") == F.col("__at")
    for c in group:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    inner = Window.partitionBy("__range", *group).orderBy(*[F.col(c) for c in order])
    return (
        dealt.withColumn("__rank", F.row_number().over(inner) - 1)
        .join(F.broadcast(shifts), same, "left")
        .withColumn(name, F.col("__rank").cast("long") + F.coalesce("__shift", F.lit(0)))
        .drop("__rank", "__range", "__at", "__shift", *[f"__{c}" for c in group])
    )


#: Rows for which one file of edges is written, so that small tables stay in few tasks; as many a task settles in its memory.
EDGES_IN_FILE = 200_000
#: Keys that may be hot: no more than twice this many have over 1 / HOT of all rows, so these are broadcast.
HOT = 2048


def join_hot(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """``rows`` joined with one row per key of ``groups``, whose column ``size`` counts the key's rows among ``total``.
    Keys with many rows meet theirs by a broadcast of at most ``2 * HOT`` rows; in the join for the others these rows are
    dealt by a hash of the whole row, where they meet nothing, so that no key fills a task."""
    found = [c for c in groups.columns if c != key]
    hot = groups.filter(F.col(size) > max(32, total // HOT)).select(key, F.struct(*found).alias("_hot"))
    zero = F.lit(0).cast("long")
    told = rows.join(F.broadcast(hot), key, "left").withColumn("_near", F.when(F.col("_hot").isNotNull(), F.xxhash64(*rows.columns)).otherwise(zero))
    # one key of both parts: apart, the constant would leave only the other to deal rows by
    told = told.withColumn("_key", F.struct(F.col(key).alias("k"), F.col("_near").alias("n")))
    cold = groups.select(F.struct(F.col(key).alias("k"), zero.alias("n")).alias("_key"), F.struct(*found).alias("_cold"))
    met = told.join(cold, "_key", "left").withColumn("_met", F.coalesce("_hot", "_cold"))
    return met.select(*rows.columns, *[F.col(f"_met.{c}").alias(c) for c in found])


def least_of(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, the least node of its component) for the nodes of the edges that are not that least node themselves."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    root = np.arange(len(nodes))
    while True:
        x, y = root[at[: len(a)]], root[at[len(a) :]]
        apart = x != y
        if not apart.any():
            some = root != np.arange(len(nodes))
            return nodes[some], nodes[root[some]]
        np.minimum.at(root, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while (root[root] != root).any():
            root = root[root]


def contracted(edges: DataFrame) -> DataFrame:
    """Edges (a, b) with the same components: each task ties the nodes of what it reads to the least node of their component
    there, by ``EDGES_IN_FILE`` rows or a few more at a time.  So few edges in one task are settled."""

    def run(batches):
        held, waiting = [], 0

        def tie():
            return least_of(*(np.concatenate(x) for x in zip(*held, strict=True)))

        for batch in batches:
            held.append([batch.column(k).to_numpy() for k in range(2)])
            waiting += batch.num_rows
            if waiting > EDGES_IN_FILE:
                ties = tie()
                held, waiting = [ties], len(ties[0])
                if waiting > EDGES_IN_FILE // 2:  # else they wait for more
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in ties], ["a", "b"])
                    held, waiting = [], 0
        if waiting:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in tie()], ["a", "b"])

    return edges.mapInArrow(run, "a long, b long")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for the nodes of undirected edges (a, b): the least node of each component.

    Tasks first tie what they read by themselves, and edges that are no more than one task
    may hold are settled there.  As long as there are more, large-star and small-star
    alternate, so every round is one aggregation over the edges, no node gathers its
    neighbours in memory or in a task, and rounds grow as the logarithm of a component's
    diameter.  A round's table is deleted when the next is written.
    """

    def star(frame: DataFrame, large: bool, total: int) -> DataFrame:
        both = frame.select("a", "b").union(frame.select(F.col("b"), F.col("a")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count(F.lit(1)).alias("_n"))
        around = join_hot(both, low, "a", "_n", total)
        if large:
            out = around.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            out = around.filter("b < a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        return out.filter("a <> b")

    def mark(frame: DataFrame):
        return frame.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    pairs = store(contracted(edges.filter("a <> b").select(F.col("a").cast("long"), F.col("b").cast("long"))).distinct(), "edges")
    before = mark(pairs)
    for _ in range(rounds):
        if before[0] <= EDGES_IN_FILE:
            return contracted(pairs.coalesce(1)).toDF("node", "root")
        files = -(-before[0] // EDGES_IN_FILE)
        total = 2 * before[0]
        halfway = store(star(pairs, True, total).coalesce(files), "edges")  # else the plan of one star stands in the other's many times
        now = store(star(halfway, False, total).distinct().coalesce(files), "edges")
        discard(pairs)
        discard(halfway)
        pairs, last, before = now, before, mark(now)
        if before == last:
            return pairs.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("root"))
    raise RuntimeError(f"components did not settle in {rounds} rounds")


# --- Arrow -----------------------------------------------------------------


def texts_of(column: pa.Array) -> pa.Array:
    """The column with nulls as empty texts."""
    return pc.fill_null(column, "")


def pieces(texts: pa.Array, budget: int):
    """(start, end) of runs of rows that hold about ``budget`` bytes each, one row at least."""
    lengths = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    start, held = 0, 0
    for i, n in enumerate(lengths):
        if i > start and held + n > budget:
            yield start, i
            start, held = i, 0
        held += n
    if start < len(lengths):
        yield start, len(lengths)


def utf8_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, offsets of each) of an array without nulls."""
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    offs = np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None and offs[-1] > offs[0] else np.zeros(0, np.uint8)
    return raw, offs - offs[0]


def codes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(code points of all texts, offsets of each) of an array without nulls."""
    raw, offs = utf8_of(texts)
    codes = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    starts = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
    return codes, starts[offs]


@functools.cache
def fold_table(digits: bool) -> np.ndarray:
    """For each code point its lower-case letter (or digit, if wanted), or a space."""
    out = np.full(0x110000, 32, np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha() or digits and c.isdigit():
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 else i
    return out


def folded(codes: np.ndarray, offs: np.ndarray, by: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points mapped by a table, runs of spaces as one, a space before and after each text.
    Gives them, the texts' offsets, and the place that each came from (-1: added)."""
    n = len(offs) - 1
    wide, origin = np.full(len(codes) + 2 * n, 32, np.uint32), np.full(len(codes) + 2 * n, -1, np.int64)
    at = np.arange(len(codes)) + 2 * np.repeat(np.arange(n), np.diff(offs)) + 1
    wide[at], origin[at] = by[codes], np.arange(len(codes))
    starts = offs + 2 * np.arange(n + 1)
    keep = np.ones(len(wide), bool)
    keep[1:] = (wide[1:] != 32) | (wide[:-1] != 32)
    keep[starts[:-1]] = True
    upto = np.concatenate(([0], np.cumsum(keep)))
    return wide[keep], upto[starts], origin[keep]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of 64-bit integers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x
