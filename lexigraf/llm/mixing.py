"""Mixing sources to target weights by capped water-filling.

Targets share the budget by weight; a source above ``max_epochs`` times its own size is
clamped there and its excess is shared again by weight, until none is above.  Sorted by
cap / weight this has a closed form: the first level at which the next source is not
clamped.

Every document is then taken floor(target / source size) times, and a seeded part of them
once more: in the order of md5(id:seed) as long as the running size stays within what is
left of the target, then up to ``FILL`` documents, each the largest that still fits, and
then, again in that order, every document that still fits.
The running size needs no source in one task: sums of 4,096 hash buckets are run up
first, and only the bucket that the limit falls in is read row by row.  Going on past a
document that doesn't fit is a pass of the same kind over what is behind it and fits.  The outcome is a
plan with one row per source that decides about each document alone, so texts are only
read, never shuffled.

Null texts have size 0 and are taken 0 words; what has no words comes only as often as its source as a whole.  Null is a source of its own, the last.
Rows with the same id and size are taken alike.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import prepare, store, table

WEIGHTS, MAX_EPOCHS, SEED, FILL = (5.0, 2.0, 1.0), 3, 17, 2
WORD = r"[^\x20\x09-\x0D]+"


def targets(totals: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, target) from (source, source_size); one row per source."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = totals.withColumn("w", F.element_at(cycle, (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")))
    ranked = ranked.withColumn("cap", (F.col("source_size") * max_epochs).cast("double"))
    by_level = Window.orderBy((F.col("cap") / F.col("w")), F.col("source").asc_nulls_last())
    before, after = by_level.rowsBetween(Window.unboundedPreceding, -1), by_level.rowsBetween(0, Window.unboundedFollowing)
    levels = ranked.select(
        "*",
        ((F.sum(F.col("source_size").cast("double")).over(Window.partitionBy()) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(after)).alias("level"),
    )
    water = levels.select("*", F.max(F.when(F.col("level") <= F.col("cap") / F.col("w"), F.col("level"))).over(Window.partitionBy()).alias("water"))
    return water.select("source", "source_size", F.least(F.col("cap"), F.coalesce(F.col("water") * F.col("w"), F.col("cap"))).alias("target"))


def _keyed(docs: DataFrame, seed: int, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(_doc, _source, _size, _key): each row whole, so that its columns' names can't clash, and the key by whose order
    documents are taken once more."""
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    hashed = F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.lit(f":{seed}")))
    key = F.struct(hashed.alias("h"), F.col(id_col).alias("i"), size.alias("n"))
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), F.col(source_col).alias("_source"), size.alias("_size"), key.alias("_key"))


def mixing_plan(docs: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = SEED, id_col="doc_id", text_col="text", source_col="source") -> DataFrame:
    """One row per source: source, source_size, target, whole (repetitions of all its documents), and which
    are taken once more: those in hash buckets up to ``upto``, with keys up to ``cut``, in ``extra``, or in one of the
    ``passes``."""
    rows = store(_keyed(docs, seed, id_col, text_col, source_col).select("_source", "_size", "_key"), "mix")
    plan = targets(rows.groupBy(F.col("_source").alias("source")).agg(F.sum("_size").alias("source_size")), weights, max_epochs)
    plan = store(
        plan.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + 1e-9)).otherwise(0).cast("long")).withColumn(
            "_left", F.floor(F.col("target") - F.col("whole") * F.col("source_size") + 1e-6).cast("long")
        ),
        "plan",
    )
    same = F.col("source").eqNullSafe(F.col("_source"))
    bucket = F.substring("_key.h", 1, 3).alias("_bucket")
    run = Window.partitionBy("_source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
    buckets = store(
        rows.groupBy("_source", bucket).agg(F.sum("_size").alias("_sum")).withColumn("_run", F.sum("_sum").over(run)).join(plan.select("source", "_left"), same).drop("source"),
        "buckets",
    )
    full = buckets.filter("_run <= _left").groupBy("_source").agg(F.max("_bucket").alias("upto"), F.max("_run").alias("_got"))
    edge = buckets.filter("_run > _left and _run - _sum < _left").select(F.col("_source").alias("_s"), F.col("_bucket").alias("_b"), (F.col("_run") - F.col("_sum")).alias("_before"), "_left")
    inside = rows.withColumn("_bucket", bucket).join(edge, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_bucket") == F.col("_b")))
    peers = Window.partitionBy("_source").orderBy("_key").rangeBetween(Window.unboundedPreceding, 0)  # rows of one bucket of each source
    cut = inside.withColumn("_run", F.sum("_size").over(peers) + F.col("_before")).filter("_run <= _left").groupBy("_source").agg(F.max("_key").alias("cut"), F.max("_run").alias("_cut_got"))
    state = plan
    for part, names in ((full, ("upto", "_got")), (cut, ("cut", "_cut_got"))):
        state = state.join(part, same, "left").drop("_source")
    state = state.withColumn("_rest", F.col("_left") - F.coalesce("_cut_got", "_got", F.lit(0))).withColumn("extra", F.filter(F.array(F.col("cut")), lambda x: F.lit(False)))
    state = store(state.drop("_got", "_cut_got"), "state")
    for _ in range(FILL):
        best = (
            rows.join(state, same)
            .filter(~_first() & (F.col("_size") > 0) & (F.col("_size") <= F.col("_rest")))
            .groupBy("_source")
            .agg(F.min(F.struct((-F.col("_size")).alias("n"), "_key")).alias("_best"))
        )
        state = state.join(best, same, "left").drop("_source")
        state = state.withColumn("extra", F.when(F.col("_best").isNotNull(), F.array_append("extra", F.col("_best._key"))).otherwise(F.col("extra")))
        state = store(state.withColumn("_rest", F.col("_rest") + F.coalesce("_best.n", F.lit(0))).drop("_best"), "state")
    none = F.filter(F.array(F.struct(F.col("_rest").alias("most"), F.col("cut").alias("after"), F.col("cut").alias("until"))), lambda x: F.lit(False))
    state = state.withColumn("passes", none).withColumn("_after", F.when(F.lit(False), F.col("cut"))).withColumn("_open", F.col("_rest") > 0)
    fits = (F.col("_size") > 0) & (F.col("_size") <= F.col("_rest")) & (F.col("_after").isNull() | (F.col("_key") > F.col("_after")))
    while not state.filter("_open").isEmpty():
        # what was passed over is longer than what is left, so only what is behind the last that did not fit can follow
        rows = store(rows.join(state.filter("_open"), same).filter(~_again() & fits).select("_source", "_size", "_key"), "fits")
        sums = rows.groupBy("_source", bucket).agg(F.sum("_size").alias("_sum")).withColumn("_run", F.sum("_sum").over(run))
        sums = store(sums.join(state.select("source", "_rest"), same).drop("source"), "buckets")
        got = sums.groupBy("_source").agg(F.coalesce(F.max(F.when(F.col("_run") <= F.col("_rest"), F.col("_run"))), F.lit(0)).alias("_got"))
        edge = sums.filter("_run > _rest and _run - _sum <= _rest").select(F.col("_source").alias("_s"), F.col("_bucket").alias("_b"), (F.col("_run") - F.col("_sum")).alias("_before"), "_rest")
        inside = rows.withColumn("_bucket", bucket).join(edge, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_bucket") == F.col("_b")))
        inside = inside.withColumn("_run", F.sum("_size").over(peers) + F.col("_before"))
        over = F.col("_run") > F.col("_rest")
        stop = inside.groupBy("_source").agg(F.min(F.when(over, F.col("_key"))).alias("_until"), F.max(F.when(~over, F.col("_run"))).alias("_in_got"))
        for part in (got, stop):
            state = state.join(part, same, "left").drop("_source")
        step = F.array(F.struct(F.col("_rest").alias("most"), F.col("_after").alias("after"), F.col("_until").alias("until")))
        state = state.withColumn("passes", F.when(F.col("_got").isNotNull(), F.concat("passes", step)).otherwise(F.col("passes")))
        state = state.withColumn("_rest", F.col("_rest") - F.coalesce("_in_got", "_got", F.lit(0))).withColumn("_after", F.col("_until"))
        state = store(state.withColumn("_open", F.col("_until").isNotNull() & (F.col("_rest") > 0)).drop("_got", "_in_got", "_until"), "state")
    return state.drop("_left", "_rest", "_after", "_open")


def _again():
    """Whether a keyed row is taken once more, by its source's row of the plan."""
    passed = F.exists(
        "passes",
        lambda p: (F.col("_size") > 0) & (F.col("_size") <= p["most"]) & (p["after"].isNull() | (F.col("_key") > p["after"])) & (p["until"].isNull() | (F.col("_key") < p["until"])),
    )
    return _first() | F.coalesce(passed, F.lit(False))


def _first():
    """The same without the passes."""
    return F.coalesce(F.substring("_key.h", 1, 3) <= F.col("upto"), F.lit(False)) | F.coalesce(F.col("_key") <= F.col("cut"), F.lit(False)) | F.coalesce(F.array_contains("extra", F.col("_key")), F.lit(False))


def _planned(docs: DataFrame, plan: DataFrame, seed: int = SEED, id_col="doc_id", text_col="text", source_col="source") -> DataFrame:
    """(_doc, _size, _plan_size, _plan_target, _copies).  The plan has a row for each source; Spark broadcasts it only
    below its own threshold."""
    named = plan.withColumnsRenamed({"source": "_plan_source", "source_size": "_plan_size", "target": "_plan_target"})
    rows = _keyed(docs, seed, id_col, text_col, source_col).join(named, F.col("_source").eqNullSafe(F.col("_plan_source")))
    return rows.select("_doc", "_size", "_plan_size", "_plan_target", (F.col("whole") + (_again() & (F.col("_size") > 0)).cast("long")).alias("_copies"))


def mixed(docs: DataFrame, plan: DataFrame, **how) -> DataFrame:
    """One row per input row: doc (the row), size, source_size, target and copies, the times that the mix takes it."""
    return _planned(docs, plan, **how).toDF("doc", "size", "source_size", "target", "copies")


def mix(docs: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` that the mix takes, each as often as it takes it."""
    rows = _planned(docs, mixing_plan(docs, **how), **{k: v for k, v in how.items() if k in ("seed", "id_col", "text_col", "source_col")})
    return rows.filter("_copies > 0").select("_doc", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int"))).alias("_copy")).select("_doc.*")


def op3_mixing(spark, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    rows = mixed(docs, mixing_plan(docs))
    return rows.select("doc.doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':17') AS h, row_number() OVER () AS r,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
t AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CAST([5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)] AS DOUBLE) AS w, CAST(source_size * 3 AS DOUBLE) AS cap FROM t),
l AS (SELECT *, (sum(CAST(source_size AS DOUBLE)) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
       / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lv FROM w),
p AS (SELECT source, source_size, least(cap, coalesce(max(CASE WHEN lv <= cap / w THEN lv END) OVER () * w, cap)) AS target FROM l),
q AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size + 1e-9) AS BIGINT) ELSE 0 END AS whole FROM p),
a AS (SELECT d.*, source_size, target, whole, CAST(floor(target - whole * source_size + 1e-6) AS BIGINT) AS lft,
      sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id, size RANGE UNBOUNDED PRECEDING) AS run
      FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source),
b AS (SELECT *, run <= lft AS i0 FROM a),
c AS (SELECT *, lft - sum(CASE WHEN i0 THEN size ELSE 0 END) OVER (PARTITION BY source) AS r0 FROM b),
e AS (SELECT *, i0 OR (NOT i0 AND size > 0 AND size <= r0 AND 1 = row_number() OVER (PARTITION BY source, NOT i0 AND size > 0 AND size <= r0 ORDER BY -size, h, doc_id, r)) AS i1 FROM c),
f AS (SELECT *, lft - sum(CASE WHEN i1 THEN size ELSE 0 END) OVER (PARTITION BY source) AS r1 FROM e),
g AS (SELECT *, i1 OR (NOT i1 AND size > 0 AND size <= r1 AND 1 = row_number() OVER (PARTITION BY source, NOT i1 AND size > 0 AND size <= r1 ORDER BY -size, h, doc_id, r)) AS i2 FROM f),
-- in order, every document that still fits: a fold over what is left of each source
k AS (SELECT source, list_reduce(list_prepend(struct_pack(rest := CAST(any_value(lft) - sum(CASE WHEN i2 THEN size ELSE 0 END) AS BIGINT), size := CAST(0 AS BIGINT), got := CAST([] AS BIGINT[])),
        list(struct_pack(rest := CAST(0 AS BIGINT), size := size, got := [r]) ORDER BY h, doc_id, size) FILTER (NOT i2 AND size > 0)),
        lambda a, b: CASE WHEN b.size <= a.rest THEN struct_pack(rest := a.rest - b.size, size := a.size, got := list_concat(a.got, b.got)) ELSE a END).got AS got FROM g GROUP BY source)
SELECT doc_id, size, source_size, target, CAST((whole + CASE WHEN i2 OR list_contains(got, r) THEN 1 ELSE 0 END) * size AS BIGINT) AS taken FROM g JOIN k ON g.source IS NOT DISTINCT FROM k.source
"""
