"""What several queries start from: chunks, views, judgements and versions of the test tables, and their SQL.

Views of a session and folder are built once and kept, since many fusions read them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import STOPWORDS, content_hash
from ..operators import dense, lexical
from ..operators.contains import containing
from ..session import spread

DEPTH = 100
_kept: dict[tuple, DataFrame] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def kept(spark: SparkSession, sf_dir: str, name: str, build) -> DataFrame:
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _kept:
        _kept[key] = build(spark, sf_dir).persist()
    return _kept[key]


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(chunk_hash, text): path, symbol and text of each document."""
    d = table(spark, sf_dir, "documents")
    symbol = F.concat(F.lit("d"), F.col("doc_id"))
    return d.select(symbol.alias("chunk_hash"), F.concat_ws(" ", "source", symbol, F.coalesce("text", F.lit(""))).alias("text"))


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), "text")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks' hash vectors, which the dense view and diversity share."""
    return kept(spark, sf_dir, "vectors", lambda s, d: dense.hash_embed(chunks(s, d), "chunk_hash"))


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus, asked = chunks(spark, sf_dir), queries(spark, sf_dir)
    first = lexical.search_chunks(corpus, asked, DEPTH)
    second = dense.search(dense.hash_embed(asked, "qid"), vectors(spark, sf_dir), DEPTH)
    return first.unionByName(second)


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The views ``lexical`` and ``semantic`` of the benchmark passages over documents."""
    return kept(spark, sf_dir, "hits", _hits)


def qrels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(qid, doc_id, rel): documents that hold the passage."""
    d = table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), F.col("doc_id")).alias("doc_id"), "text")
    return containing(spread(d), queries(spark, sf_dir)).select("qid", "doc_id", F.lit(1).cast("long").alias("rel"))


def versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two versions of the documents: the second drops, rewrites and moves some of the first and adds others."""
    d = table(spark, sf_dir, "documents")
    symbol = F.concat(F.lit("d"), F.col("doc_id"))

    def shaped(rows: DataFrame, tag: str, path, text) -> DataFrame:
        rows = rows.select(F.concat(F.lit(tag), F.col("doc_id")).alias("occurrence_id"), path.alias("path"), symbol.alias("symbol"), F.lit(1).alias("start_line"), F.col("lang").alias("language"), text.alias("text"))
        return rows.withColumn("content_hash", content_hash("language", "text"))

    text = F.coalesce("text", F.lit(""))
    one = shaped(d.filter(F.col("doc_id") % 10 != 1), "a", F.col("source"), text)
    moved = F.when(F.col("doc_id") % 11 == 0, F.concat(F.lit("new/"), F.col("source"))).otherwise(F.col("source"))
    two = shaped(d.filter(F.col("doc_id") % 10 != 0), "b", moved, F.when(F.col("doc_id") % 7 == 0, F.concat(text, F.lit(" rewritten"))).otherwise(text))
    return one, two


# --- SQL -------------------------------------------------------------------

STOP = "['" + "','".join(STOPWORDS) + "']"
CHUNKS = "chunks AS (SELECT 'd' || doc_id AS chunk_hash, source || ' d' || doc_id || ' ' || coalesce(text, '') AS text FROM documents), queries AS (SELECT item_id AS qid, text FROM benchmark)"


def sql_plain(text: str) -> str:
    return rf"list_transform(regexp_extract_all(replace(regexp_replace({text}, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '_', ' '), '[A-Za-z][A-Za-z0-9]*|[0-9]+'), lambda x: lower(x))"


def sql_code(source: str, key: str, out: str) -> str:
    """CTEs that give ``out`` (key, term) by code tokens."""
    return rf"""
    {out}_n AS (SELECT {key}, unnest(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*|[0-9]+')) AS name FROM {source}),
    {out}_p AS (SELECT {key}, lower(name) AS low, list_transform(regexp_extract_all(regexp_replace(name, '([A-Z])([A-Z][a-z])', '\1 \2', 'g'), '[A-Z]?[a-z]+|[A-Z]+|[0-9]+'), lambda x: lower(x)) AS parts FROM {out}_n),
    {out} AS (SELECT {key}, low AS term FROM {out}_p WHERE len(parts) > 1 UNION ALL
              SELECT {key}, unnest(list_filter(parts, lambda x: NOT list_contains({STOP}, x))) AS term FROM {out}_p)"""


def sql_bm25(doc_terms: str, query_terms: str, out: str, docs: str = "chunks", plus_one: bool = False) -> str:
    """CTEs that give ``out`` (qid, chunk_hash, raw) from (chunk_hash, term) and (qid, term, qtf)."""
    part = "tf * 22e-1 / (tf + 12e-1 * (25e-2 + 75e-2 * dl / avgdl))" if plus_one else "tf / (tf + 12e-1 * (25e-2 + 75e-2 * dl / avgdl))"
    return f"""
    {out}_tf AS MATERIALIZED (SELECT term, chunk_hash, CAST(count(*) AS DOUBLE) AS tf FROM {doc_terms} GROUP BY ALL),
    {out}_dl AS (SELECT chunk_hash, sum(tf) AS dl FROM {out}_tf GROUP BY 1),
    {out}_df AS (SELECT term, CAST(count(*) AS DOUBLE) AS df FROM {out}_tf GROUP BY 1),
    {out}_c AS (SELECT CAST((SELECT count(*) FROM {docs}) AS DOUBLE) AS n,
                ((SELECT sum(dl) FROM {out}_dl) + (SELECT count(*) FROM {docs}) - (SELECT count(*) FROM {out}_dl)) / CAST((SELECT count(*) FROM {docs}) AS DOUBLE) AS avgdl),
    {out} AS (SELECT qid, chunk_hash, sum(qtf * ln(1 + (n - df + 5e-1) / (df + 5e-1)) * ({part})) AS raw
              FROM {query_terms} JOIN {out}_df USING (term) JOIN {out}_tf USING (term) JOIN {out}_dl USING (chunk_hash), {out}_c GROUP BY ALL)"""


def sql_embed(source: str, key: str, out: str) -> str:
    return f"""
    {out}_s AS (SELECT {key}, CAST('0x' || substr(md5(t), 25, 8) AS BIGINT) % 64 AS slot, CAST(count(*) AS DOUBLE) AS x FROM (SELECT {key}, unnest({sql_plain("text")}) AS t FROM {source}) GROUP BY ALL),
    {out} AS (SELECT {key}, slot, x / sqrt(sum(x * x) OVER (PARTITION BY {key})) AS x FROM {out}_s)"""


HITS = f"""{CHUNKS},
    {sql_code("chunks", "chunk_hash", "dterm")}, {sql_code("queries", "qid", "qword")},
    qterm AS (SELECT qid, term, CAST(count(*) AS DOUBLE) AS qtf FROM qword GROUP BY ALL), {sql_bm25("dterm", "qterm", "lex")},
    {sql_embed("chunks", "chunk_hash", "dv")}, {sql_embed("queries", "qid", "qv")},
    sem AS (SELECT qid, chunk_hash, sum(dv.x * qv.x) AS raw FROM dv JOIN qv USING (slot) GROUP BY ALL),
    allhits AS (SELECT qid, chunk_hash, 'lexical' AS view, raw FROM lex UNION ALL SELECT qid, chunk_hash, 'semantic', raw FROM sem),
    hits AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY qid, view ORDER BY round(raw, 9) DESC, chunk_hash) AS rank FROM allhits
             QUALIFY row_number() OVER (PARTITION BY qid, view ORDER BY round(raw, 9) DESC, chunk_hash) <= {DEPTH})"""
QRELS = "qrels AS (SELECT DISTINCT item_id AS qid, 'd' || doc_id AS doc_id, CAST(1 AS BIGINT) AS rel FROM documents d, benchmark b WHERE contains(d.text, b.text))"
VERSIONS = """
    v1 AS (SELECT 'a' || doc_id AS occurrence_id, source AS path, 'd' || doc_id AS symbol, lang AS language, coalesce(text, '') AS text FROM documents WHERE doc_id % 10 <> 1),
    v2 AS (SELECT 'b' || doc_id AS occurrence_id, CASE WHEN doc_id % 11 = 0 THEN 'new/' || source ELSE source END AS path, 'd' || doc_id AS symbol, lang AS language,
           coalesce(text, '') || CASE WHEN doc_id % 7 = 0 THEN ' rewritten' ELSE '' END AS text FROM documents WHERE doc_id % 10 <> 0),
    o AS MATERIALIZED (SELECT *, sha256(coalesce(language, '') || chr(0) || text) AS content_hash FROM v1), n AS MATERIALIZED (SELECT *, sha256(coalesce(language, '') || chr(0) || text) AS content_hash FROM v2),
    first AS MATERIALIZED (SELECT o.occurrence_id AS old, n.occurrence_id AS new, CASE WHEN o.content_hash = n.content_hash THEN 'unchanged' ELSE 'modified' END AS change_type
              FROM o JOIN n ON o.path = n.path AND o.symbol = n.symbol),
    ol AS (SELECT *, row_number() OVER (PARTITION BY content_hash ORDER BY path, occurrence_id) AS k FROM o WHERE occurrence_id NOT IN (SELECT old FROM first)),
    nl AS (SELECT *, row_number() OVER (PARTITION BY content_hash ORDER BY path, occurrence_id) AS k FROM n WHERE occurrence_id NOT IN (SELECT new FROM first)),
    second AS MATERIALIZED (SELECT ol.occurrence_id AS old, nl.occurrence_id AS new, CASE WHEN ol.symbol = nl.symbol THEN 'moved' ELSE 'renamed' END AS change_type
               FROM ol JOIN nl ON ol.content_hash = nl.content_hash AND ol.k = nl.k),
    matches AS (SELECT old, new, change_type, 1e0 AS similarity FROM first UNION ALL SELECT old, new, change_type, 1e0 FROM second
                UNION ALL SELECT NULL, occurrence_id, 'added', 0e0 FROM nl WHERE occurrence_id NOT IN (SELECT new FROM second)
                UNION ALL SELECT occurrence_id, NULL, 'deleted', 0e0 FROM ol WHERE occurrence_id NOT IN (SELECT old FROM second))"""
