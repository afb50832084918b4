"""Queries of ranking, fusion, reranking and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import plain_tokens, split_identifier
from ..operators import dense, evaluation, fusion, lexical, query, rank
from .inputs import CHUNKS, HITS, QRELS, chunks, hits, qrels, queries, sql_bm25, sql_code, sql_plain, table, vectors

QUERIES, SQL = {}, {}
six = lambda c, n=None: F.round(c, 6).alias(n or c)


def register(sql: str | None = None):
    def take(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return take


BASE_TERMS = f"{CHUNKS}, dterm AS (SELECT chunk_hash, unnest({sql_plain('text')}) AS term FROM chunks), qterm AS (SELECT DISTINCT qid, unnest({sql_plain('text')}) AS term, 1e0 AS qtf FROM queries)"
RANKED = "SELECT qid, chunk_hash, round(raw, 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY round(raw, 9) DESC, chunk_hash) AS rank FROM lex QUALIFY rank <= 10"


@register(f"WITH {BASE_TERMS}, {sql_bm25('dterm', 'qterm', 'lex', plus_one=True)} {RANKED}")
def bm25_baseline_topk(spark, sf_dir):
    return lexical.search_baseline_chunks(chunks(spark, sf_dir), queries(spark, sf_dir), 10).select("qid", "chunk_hash", six("raw", "score"), "rank")


CODE = f"{CHUNKS}, {sql_code('chunks', 'chunk_hash', 'dterm')}, {sql_code('queries', 'qid', 'qword')}, qterm AS (SELECT qid, term, CAST(count(*) AS DOUBLE) AS qtf FROM qword GROUP BY ALL)"


@register(f"WITH {CODE}, {sql_bm25('dterm', 'qterm', 'lex')} {RANKED}")
def bm25_code_tokens_topk(spark, sf_dir):
    return lexical.search_chunks(chunks(spark, sf_dir), queries(spark, sf_dir), 10).select("qid", "chunk_hash", six("raw", "score"), "rank")


@register(f"""WITH {CHUNKS}, dterm AS (SELECT chunk_hash, unnest({sql_plain('text')}) AS term FROM chunks)
SELECT term, count(DISTINCT chunk_hash) AS df, count(*) AS cf FROM dterm GROUP BY 1""")
def token_df_stats(spark, sf_dir):
    index = lexical.index_chunks(chunks(spark, sf_dir), tokens=plain_tokens, keep=False)
    return index.postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


NAMES = ["parseHTTPResponse_v2", "read_file", "XMLHttpRequest", "snake_case_name", "A1B2", "__init__", "getURLs", "x", "HTTP2Server", "camelCase"]


@register(r"""WITH names AS (SELECT unnest(['""" + "','".join(NAMES) + r"""']) AS name UNION ALL SELECT DISTINCT p_name FROM part)
SELECT name, array_to_string(list_transform(regexp_extract_all(regexp_replace(name, '([A-Z])([A-Z][a-z])', '\1 \2', 'g'), '[A-Z]?[a-z]+|[A-Z]+|[0-9]+'), lambda x: lower(x)), ',') AS pieces FROM names""")
def identifier_split(spark, sf_dir):
    names = spark.createDataFrame([(n,) for n in NAMES], "name string").union(table(spark, sf_dir, "part").select("p_name").distinct())
    return names.select("name", F.array_join(split_identifier("name"), ",").alias("pieces"))


def _vectors(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    asked = rows.filter(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vector"))
    return asked, rows.select(F.col("vec_id").alias("chunk_hash"), F.col("embedding").alias("vector"))


DENSE = """WITH e AS (SELECT vec_id, label, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x) AS v FROM embeddings),
u AS (SELECT vec_id, label, list_transform(v, lambda x: x / greatest(sqrt(list_dot_product(v, v)), 1e-12)) AS v FROM e),
s AS (SELECT q.vec_id AS qid, d.vec_id AS chunk_hash, q.label AS ql, d.label AS dl, list_dot_product(q.v, d.v) AS raw FROM u q, u d WHERE q.vec_id % 50 = 0),
top AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(raw, 9) DESC, chunk_hash) AS rank FROM s QUALIFY rank <= 10)"""


@register(f"{DENSE} SELECT qid, chunk_hash, round(raw, 6) AS score, rank FROM top")
def dense_topk(spark, sf_dir):
    return dense.search(*_vectors(spark, sf_dir), 10).select("qid", "chunk_hash", six("raw", "score"), "rank")


@register(f"{DENSE} SELECT qid, round(sum(CASE WHEN ql = dl THEN 1e0 ELSE 0e0 END) / 10, 6) AS precision_10 FROM top GROUP BY qid")
def dense_label_recall(spark, sf_dir):
    label = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    found = dense.search(*_vectors(spark, sf_dir), 10)
    rows = found.join(label.withColumnsRenamed({"vec_id": "chunk_hash", "label": "dl"}), "chunk_hash").join(label.withColumnsRenamed({"vec_id": "qid", "label": "ql"}), "qid")
    return rows.groupBy("qid").agg(F.round(F.sum(F.when(F.expr("ql = dl"), 1.0).otherwise(0.0)) / 10, 6).alias("precision_10"))


WEIGHTS = {"lexical": 0.2, "semantic": 0.8}
EMIT = "SELECT qid, chunk_hash, round(score, 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, chunk_hash) AS rank FROM fused"
RRF = "fused AS (SELECT qid, chunk_hash, sum(1e0 / (60 + rank)) AS score FROM hits GROUP BY ALL)"


def sql_weighted(norm: str) -> str:
    value = {
        "minmax": "CASE WHEN max(raw) OVER w > min(raw) OVER w THEN (raw - min(raw) OVER w) / (max(raw) OVER w - min(raw) OVER w) ELSE 1e0 END",
        "zscore": "CASE WHEN stddev_pop(raw) OVER w > 0 THEN (raw - avg(raw) OVER w) / stddev_pop(raw) OVER w ELSE 0e0 END",
    }[norm]
    return f"""val AS (SELECT *, {value} AS value, CASE view WHEN 'lexical' THEN 2e-1 ELSE 8e-1 END AS weight FROM hits WINDOW w AS (PARTITION BY qid, view)),
    flo AS (SELECT qid, view, min(value) AS floor FROM val GROUP BY ALL),
    grid AS (SELECT c.qid, c.chunk_hash, f.view, f.floor FROM (SELECT DISTINCT qid, chunk_hash FROM hits) c JOIN flo f USING (qid)),
    fused AS (SELECT g.qid, g.chunk_hash, sum(coalesce(v.value, g.floor) * CASE g.view WHEN 'lexical' THEN 2e-1 ELSE 8e-1 END) AS score
              FROM grid g LEFT JOIN val v USING (qid, chunk_hash, view) GROUP BY ALL)"""


def _emit(fused):
    return fused.select("qid", "chunk_hash", six("score"), "rank")


@register(f"WITH {HITS}, {RRF} {EMIT}")
def fuse_rrf(spark, sf_dir):
    return _emit(fusion.rrf(hits(spark, sf_dir)))


@register(f"WITH {HITS}, {sql_weighted('minmax')} {EMIT}")
def fuse_minmax_weighted(spark, sf_dir):
    return _emit(fusion.weighted(hits(spark, sf_dir), fusion.weights_frame(spark, WEIGHTS)))


@register(f"WITH {HITS}, {sql_weighted('zscore')} {EMIT}")
def fuse_zscore_weighted(spark, sf_dir):
    return _emit(fusion.weighted(hits(spark, sf_dir), fusion.weights_frame(spark, WEIGHTS), "zscore"))


@register(f"WITH {HITS} SELECT qid, chunk_hash, round(max(CASE WHEN view = 'lexical' THEN raw END), 6) AS lexical, round(max(CASE WHEN view = 'semantic' THEN raw END), 6) AS semantic FROM hits GROUP BY ALL")
def full_outer_view_scores(spark, sf_dir):
    return fusion.view_scores(hits(spark, sf_dir), ["lexical", "semantic"]).select("qid", "chunk_hash", six("lexical"), six("semantic"))


SUBS = f"""{CHUNKS}, subs AS (SELECT item_id AS qid, CAST(0 AS BIGINT) AS sub, text, 1e0 AS weight FROM benchmark UNION ALL SELECT item_id, 1, split_part(text, '.', 1), 7e-1 FROM benchmark),
    {sql_code('chunks', 'chunk_hash', 'dterm')}, {sql_code("(SELECT qid || ':' || sub AS qid, text FROM subs)", 'qid', 'qword')},
    qterm AS (SELECT qid, term, CAST(count(*) AS DOUBLE) AS qtf FROM qword GROUP BY ALL), {sql_bm25('dterm', 'qterm', 'lex')},
    placed AS (SELECT CAST(split_part(qid, ':', 1) AS BIGINT) AS qid, CAST(split_part(qid, ':', 2) AS BIGINT) AS sub, chunk_hash, row_number() OVER (PARTITION BY qid ORDER BY round(raw, 9) DESC, chunk_hash) AS rank FROM lex QUALIFY rank <= 100),
    fused AS (SELECT qid, chunk_hash, sum(weight / (60 + rank)) AS raw FROM placed JOIN subs USING (qid, sub) GROUP BY ALL)"""


@register(f"WITH {SUBS} SELECT qid, chunk_hash, round(raw, 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY round(raw, 12) DESC, chunk_hash) AS rank FROM fused QUALIFY rank <= 100")
def subquery_rrf(spark, sf_dir):
    asked = queries(spark, sf_dir)
    subs = asked.select("qid", F.lit(0).cast("long").alias("sub"), "text", F.lit(1.0).alias("weight")).union(asked.select("qid", F.lit(1).cast("long"), F.split_part("text", F.lit("."), F.lit(1)), F.lit(0.7)))
    found = lexical.search_chunks(chunks(spark, sf_dir), subs.select(F.concat_ws(":", "qid", "sub").alias("qid"), "text"), 100)
    part = F.split("qid", ":")
    rows = found.select(part[0].cast("long").alias("qid"), part[1].cast("long").alias("sub"), "view", "chunk_hash", "rank")
    return fusion.combine_subqueries(rows, subs.select("qid", "sub", "weight"), 100).select("qid", "chunk_hash", six("raw", "score"), "rank")


METRICS = f"""{HITS}, {QRELS}, {RRF}, run AS (SELECT qid, chunk_hash AS doc_id, round(score, 9) AS score FROM fused),
    placed AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id DESC) AS rank FROM run),
    judged AS (SELECT q.qid, q.doc_id, rel, rank, row_number() OVER (PARTITION BY q.qid ORDER BY rel DESC, q.doc_id) AS best FROM qrels q LEFT JOIN placed p ON p.qid = q.qid AND p.doc_id = q.doc_id),
    per AS (SELECT qid, {", ".join(f"sum(CASE WHEN rank <= {k} THEN rel / log2(rank + 1e0) ELSE 0e0 END) / sum(CASE WHEN best <= {k} THEN rel / log2(best + 1e0) ELSE 0e0 END) AS ndcg_{k}, coalesce(1e0 / min(CASE WHEN rank <= {k} THEN rank END), 0e0) AS mrr_{k}, sum(CASE WHEN rank <= {k} THEN 1e0 ELSE 0e0 END) / count(*) AS recall_{k}" for k in (1, 10, 100))} FROM judged GROUP BY qid)"""
COLUMNS = [f"{m}_{k}" for k in (1, 10, 100) for m in ("ndcg", "mrr", "recall")]


def _run(spark, sf_dir):
    return fusion.rrf(hits(spark, sf_dir)).select("qid", F.col("chunk_hash").alias("doc_id"), F.round("score", 9).alias("score"))


@register(f"WITH {METRICS} SELECT {', '.join(f'round(avg({c}), 6) AS {c}' for c in COLUMNS)}, count(*) AS n_queries FROM per")
def ndcg_mrr_recall(spark, sf_dir):
    return evaluation.evaluate(_run(spark, sf_dir), qrels(spark, sf_dir)).select(*[six(c) for c in COLUMNS], "n_queries")


@register(f"WITH {METRICS} SELECT qid, {', '.join(f'round({c}, 6) AS {c}' for c in COLUMNS)} FROM per")
def metrics_by_query(spark, sf_dir):
    return evaluation.per_query(_run(spark, sf_dir), qrels(spark, sf_dir)).select("qid", *[six(c) for c in COLUMNS])


@register("SELECT event_type, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY 1")
def latency_percentiles(spark, sf_dir):
    return evaluation.latency(table(spark, sf_dir, "events"), "value", ["event_type"]).select("event_type", six("mean"), six("p50"), six("p95"))


@register(rf"""WITH e AS (SELECT label, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x) AS v, vec_id FROM embeddings),
u AS (SELECT label, vec_id, list_transform(v, lambda x: x / greatest(sqrt(list_dot_product(v, v)), 1e-12)) AS v FROM e)
SELECT CAST(a.label AS BIGINT) AS qid, round(avg(list_dot_product(a.v, b.v)), 6) AS similarity FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id GROUP BY 1""")
def intra_list_similarity(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("qid"), F.col("embedding").alias("vector"))
    return evaluation.intra_list_similarity(rows).select("qid", six("similarity"))


@register(f"""WITH {HITS}, {RRF}, placed AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, chunk_hash) AS rank FROM fused),
head AS (SELECT p.qid, p.chunk_hash, coalesce(h.raw * 75e-2 + p.score * 25e-2, p.score) AS score FROM placed p LEFT JOIN (SELECT * FROM hits WHERE view = 'semantic') h USING (qid, chunk_hash) WHERE p.rank <= 20),
flo AS (SELECT qid, min(score) AS floor FROM head GROUP BY 1),
done AS (SELECT * FROM head UNION ALL SELECT qid, chunk_hash, floor - (rank - 20) * 1e-3 FROM placed JOIN flo USING (qid) WHERE rank > 20)
SELECT qid, chunk_hash, round(score, 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, chunk_hash) AS rank FROM done""")
def rerank_depth_tail(spark, sf_dir):
    pairs = hits(spark, sf_dir).filter("view = 'semantic'").select("qid", "chunk_hash", F.col("raw").alias("pair"))
    return _emit(rank.rerank(fusion.rrf(hits(spark, sf_dir)), pairs, 20, 0.25))


#: (chunk_hash, v): the chunks' vectors as lists.
DENSE_VECTORS = "dvec AS MATERIALIZED (SELECT chunk_hash, list_transform(range(64), lambda i: coalesce(map_extract_value(m, i), 0e0)) AS v FROM (SELECT chunk_hash, map_from_entries(list((slot, x))) AS m FROM dv GROUP BY 1))"


def sql_mmr(source: str, out: str, k: int = 20) -> str:
    """CTEs (recursive) that give ``out`` (qid, chunk_hash, score, rank) from (qid, chunk_hash, score, rank): one document moves over a step."""
    item = "struct_pack(rank := {0}.rank, chunk_hash := {0}.chunk_hash, rel := {0}.rel, v := {0}.v, near := {1})"
    dot = "coalesce(list_dot_product(x.v, open[p].v), 0e0)"
    return f"""
    {out}_h AS (SELECT qid, chunk_hash, score, rank, v, min(score) OVER w AS lo, max(score) OVER w AS hi, count(*) OVER w AS n FROM {source} LEFT JOIN dvec USING (chunk_hash) WHERE rank <= {k} WINDOW w AS (PARTITION BY qid)),
    {out}_g AS (SELECT *, CASE WHEN lo >= 0 AND hi > 0 THEN score / hi WHEN hi > lo THEN (score - lo) / (hi - lo) ELSE 1e0 END AS rel FROM {out}_h),
    {out}_r AS (SELECT qid, any_value(n) AS n, 0 AS step, CAST([] AS VARCHAR[]) AS taken, list({item.format(out + '_g', '0e0')} ORDER BY rank) AS open FROM {out}_g WHERE n > 2 GROUP BY qid
      UNION ALL SELECT qid, n, step + 1, list_append(taken, open[p].chunk_hash), list_transform(list_filter(open, lambda x: x.rank <> open[p].rank), lambda x: {item.format('x', f'CASE WHEN step = 0 THEN {dot} ELSE greatest(x.near, {dot}) END')})
      FROM (SELECT *, list_position(w, list_max(w)) AS p FROM (SELECT *, list_transform(open, lambda x: 7e-1 * x.rel - 3e-1 * x.near) AS w FROM {out}_r WHERE len(open) > 0))),
    {out}_o AS (SELECT qid, unnest(taken) AS chunk_hash, unnest(range(1, len(taken) + 1)) AS rank, taken[1] AS first FROM {out}_r WHERE len(open) = 0),
    {out}_t AS (SELECT o.qid, o.chunk_hash, g.score - (o.rank - 1) * 1e-4 AS score, o.rank FROM {out}_o o JOIN {out}_g g ON g.qid = o.qid AND g.chunk_hash = o.first UNION ALL SELECT qid, chunk_hash, score, rank FROM {out}_g WHERE n <= 2),
    {out} AS (SELECT * FROM {out}_t UNION ALL SELECT s.qid, s.chunk_hash, f.floor - (s.rank - {k}) * 1e-4, s.rank FROM {source} s JOIN (SELECT qid, min(score) AS floor FROM {out}_t GROUP BY 1) f USING (qid) WHERE s.rank > {k})"""


PLACED = "placed AS MATERIALIZED (SELECT qid, chunk_hash, score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, chunk_hash) AS rank FROM fused)"


@register(f"WITH RECURSIVE {HITS}, {RRF}, {PLACED}, {DENSE_VECTORS}, {sql_mmr('placed', 'mmr')} SELECT qid, chunk_hash, round(score, 6) AS score, rank FROM mmr")
def mmr_rerank(spark, sf_dir):
    return _emit(rank.mmr(fusion.rrf(hits(spark, sf_dir)), vectors(spark, sf_dir)))


GRID = """grid AS (SELECT printf('%03d-%03d', a, 10 - a) AS cell, a / 10e0 AS wl, (10 - a) / 10e0 AS ws FROM range(11) t(a))"""


@register(f"""WITH RECURSIVE {GRID} SELECT cell, unnest(['lexical', 'semantic']) AS view, round(unnest([wl, ws]), 6) AS weight FROM grid""")
def simplex_grid(spark, sf_dir):
    return query.simplex_grid(spark, ["lexical", "semantic"]).select("cell", "view", six("weight"))


@register(f"""WITH {HITS}, {QRELS}, {GRID}, val AS (SELECT *, CASE WHEN max(raw) OVER w > min(raw) OVER w THEN (raw - min(raw) OVER w) / (max(raw) OVER w - min(raw) OVER w) ELSE 1e0 END AS value FROM hits WINDOW w AS (PARTITION BY qid, view)),
flo AS (SELECT qid, view, min(value) AS floor FROM val GROUP BY ALL),
mat AS (SELECT c.qid, c.chunk_hash, max(CASE WHEN f.view = 'lexical' THEN coalesce(v.value, f.floor) END) AS l, max(CASE WHEN f.view = 'semantic' THEN coalesce(v.value, f.floor) END) AS s
        FROM (SELECT DISTINCT qid, chunk_hash FROM hits) c JOIN flo f USING (qid) LEFT JOIN val v ON v.qid = c.qid AND v.chunk_hash = c.chunk_hash AND v.view = f.view GROUP BY ALL),
sc AS (SELECT qid, cell, chunk_hash, row_number() OVER (PARTITION BY qid, cell ORDER BY round(coalesce(l, 0) * wl + coalesce(s, 0) * ws, 9) DESC, chunk_hash) AS rank FROM mat, grid QUALIFY rank <= 10),
dcg AS (SELECT sc.qid, cell, sum(rel / log2(rank + 1e0)) AS dcg FROM sc JOIN qrels q ON q.qid = sc.qid AND q.doc_id = sc.chunk_hash GROUP BY ALL),
ideal AS (SELECT qid, sum(rel / log2(r + 1e0)) AS idcg FROM (SELECT qid, rel, row_number() OVER (PARTITION BY qid ORDER BY rel DESC, doc_id) AS r FROM qrels) WHERE r <= 10 GROUP BY 1)
SELECT i.qid, g.cell, round(coalesce(dcg, 0) / idcg, 6) AS ndcg FROM ideal i CROSS JOIN grid g LEFT JOIN dcg d ON d.qid = i.qid AND d.cell = g.cell""")
def cell_utilities(spark, sf_dir):
    grid = query.simplex_grid(spark, ["lexical", "semantic"])
    return query.cell_utilities(hits(spark, sf_dir), qrels(spark, sf_dir), grid).select("qid", "cell", six("ndcg"))


@register(f"""WITH {HITS}, f AS (SELECT *, exp(5 * CASE WHEN max(raw) OVER w > min(raw) OVER w THEN (raw - min(raw) OVER w) / (max(raw) OVER w - min(raw) OVER w) ELSE 1e0 END) AS e FROM hits WHERE rank <= 10 WINDOW w AS (PARTITION BY qid, view)),
p AS (SELECT *, e / sum(e) OVER (PARTITION BY qid, view) AS p FROM f),
s AS (SELECT qid, view, max(raw) AS top, coalesce(max(CASE WHEN rank = 2 THEN raw END), max(raw)) AS second, min(raw) AS last, avg(raw) AS mean, stddev_pop(raw) AS sd, -sum(p * ln(p)) / ln(greatest(count(*), 2)) AS entropy FROM p GROUP BY ALL)
SELECT s.qid, s.view, round(top, 6) AS top, round((top - second) / (abs(top - last) + 1e-9), 6) AS gap, round(mean, 6) AS mean, round(sd, 6) AS sd, round(entropy, 6) AS entropy, CAST(n AS DOUBLE) AS n
FROM s JOIN (SELECT qid, view, count(*) AS n FROM hits GROUP BY ALL) c USING (qid, view)""")
def score_stats_features(spark, sf_dir):
    return query.score_stats(hits(spark, sf_dir)).select("qid", "view", *[six(c) for c in ("top", "gap", "mean", "sd", "entropy")], "n")


TURNS = "queries AS (SELECT conv_id || ':' || turn AS qid, text FROM conversations WHERE role = 'user' AND conv_id % 50 = 0)"


@register(f"""WITH chunks AS (SELECT 'd' || doc_id AS chunk_hash, source || ' d' || doc_id || ' ' || coalesce(text, '') AS text FROM documents), {TURNS}, {sql_code('chunks', 'chunk_hash', 'dterm')}, {sql_code('queries', 'qid', 'qword')},
qterm AS (SELECT qid, term, CAST(count(*) AS DOUBLE) AS qtf FROM qword GROUP BY ALL), {sql_bm25('dterm', 'qterm', 'lex')} {RANKED}""")
def conversation_queries_topk(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").filter("role = 'user' and conv_id % 50 = 0").select(F.concat_ws(":", "conv_id", "turn").alias("qid"), "text")
    return lexical.search_chunks(chunks(spark, sf_dir), turns, 10).select("qid", "chunk_hash", six("raw", "score"), "rank")


def _flagship_sql() -> str:
    """The passages' adaptive weights, weighted fusion, reranking and diversity."""
    from .texts import TYPED, _sql_weight

    views = ["lexical", "semantic"]
    return f"""WITH RECURSIVE {TYPED}, wt AS (SELECT qid - 100 AS qid, {", ".join(f"({_sql_weight(v)}) AS w_{v}" for v in views)} FROM p WHERE qid >= 100), {HITS},
    val AS (SELECT *, CASE WHEN max(raw) OVER w > min(raw) OVER w THEN (raw - min(raw) OVER w) / (max(raw) OVER w - min(raw) OVER w) ELSE 1e0 END AS value FROM hits WINDOW w AS (PARTITION BY qid, view)),
    flo AS (SELECT qid, view, min(value) AS floor FROM val GROUP BY ALL), grid AS (SELECT c.qid, c.chunk_hash, f.view, f.floor FROM (SELECT DISTINCT qid, chunk_hash FROM hits) c JOIN flo f USING (qid)),
    fused AS (SELECT g.qid, g.chunk_hash, sum(coalesce(v.value, g.floor) * CASE g.view WHEN 'lexical' THEN w_lexical ELSE w_semantic END / (w_lexical + w_semantic)) AS score FROM grid g JOIN wt USING (qid) LEFT JOIN val v USING (qid, chunk_hash, view) GROUP BY ALL), {PLACED},
    head AS (SELECT p.qid, p.chunk_hash, coalesce(h.raw * 5e-1 + p.score * 5e-1, p.score) AS score FROM placed p LEFT JOIN (SELECT * FROM hits WHERE view = 'semantic') h USING (qid, chunk_hash) WHERE p.rank <= 20),
    low AS (SELECT qid, min(score) AS floor FROM head GROUP BY 1), done AS (SELECT * FROM head UNION ALL SELECT qid, chunk_hash, floor - (rank - 20) * 1e-3 FROM placed JOIN low USING (qid) WHERE rank > 20),
    again AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, chunk_hash) AS rank FROM done), {DENSE_VECTORS}, {sql_mmr('again', 'mmr')}
    SELECT qid, chunk_hash, round(score, 6) AS score, rank FROM mmr WHERE rank <= 10"""


@register()
def hybrid_pipeline_flagship(spark, sf_dir):
    """First stage, adaptive weights, fusion, reranking and diversity in one plan over all passages."""
    asked = query.classify(query.parse(queries(spark, sf_dir)))
    views = ["lexical", "semantic"]
    fused = fusion.weighted(hits(spark, sf_dir), query.rule_weights(asked, views))
    pairs = hits(spark, sf_dir).filter("view = 'semantic'").select("qid", "chunk_hash", F.col("raw").alias("pair"))
    done = rank.mmr(rank.rerank(fused, pairs, 20, 0.5), vectors(spark, sf_dir))
    return _emit(rank.cut(done, 10))


@register(f"{DENSE} SELECT qid, chunk_hash, round(raw, 6) AS score, rank FROM top")
def dense_native_topk(spark, sf_dir):
    """The column-expression form of the dense search: the query vectors against all."""
    return dense.search_native(*_vectors(spark, sf_dir), 10).select("qid", "chunk_hash", six("raw", "score"), "rank")
