"""Queries of lineage, comparison and history."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import STOPWORDS, content_hash, shingle_hashes, symbol_id
from ..operators import fusion, lineage, rank
from ..session import spread, stored
from .inputs import HITS, STOP, VERSIONS, hits, table, versions
from .retrieval import RRF, six

QUERIES, SQL = {}, {}


#: Copies up to which their ids are broadcast, so that the sets of the others aren't shuffled.
MOST_COPIES = 1 << 21


def register(sql: str | None = None):
    def take(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return take


@register(f"WITH {VERSIONS} SELECT * FROM matches")
def lineage_match_exact(spark, sf_dir):
    return lineage.match_symbols(*versions(spark, sf_dir), similar=False)


SHINGLES = r"""t AS (SELECT doc_id, lang, regexp_extract_all(text, '[\p{L}\p{M}\p{N}\p{Pc}]+|[^\s\p{L}\p{M}\p{N}\p{Pc}]') AS w FROM documents WHERE text IS NOT NULL),
s AS MATERIALIZED (SELECT DISTINCT doc_id, lang, unnest(CASE WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) END) AS sh FROM t),
c AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1)"""


@register(f"""WITH {SHINGLES}, k AS (SELECT doc_id, any_value(lang) AS lang, md5(string_agg(sh, chr(1) ORDER BY sh)) AS key FROM s GROUP BY 1), m AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY lang, key) AS rep FROM k),
r AS MATERIALIZED (SELECT s.* FROM s JOIN m USING (doc_id) WHERE doc_id = rep), p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM r a JOIN r b ON a.sh = b.sh AND a.lang IS NOT DISTINCT FROM b.lang AND a.doc_id < b.doc_id GROUP BY ALL)
SELECT a, b, round(k / CAST(x.n + y.n - k AS DOUBLE), 6) AS similarity FROM p JOIN c x ON x.doc_id = a JOIN c y ON y.doc_id = b WHERE k / CAST(x.n + y.n - k AS DOUBLE) >= 5e-1
UNION ALL SELECT rep, doc_id, 1e0 FROM m WHERE doc_id <> rep""")
def lineage_similarity_pairs(spark, sf_dir):
    """Documents of one language with similar bodies: pairs of representatives of equal sets of shingles, and each other
    member with its representative (similarity 1).  A representative is the least document of its set."""
    d = table(spark, sf_dir, "documents").filter("text is not null")
    language = F.coalesce("lang", F.lit(""))
    sets = spread(d.select("doc_id", "lang", "text")).select("doc_id", language.alias("language"), shingle_hashes(language, "text").alias("items"))
    sets = stored(sets.withColumn("items", F.array_sort("items")), "sets")
    keyed = stored(sets.select("doc_id", "language", F.sha2(F.array_join(F.transform("items", lambda x: x.cast("string")), ","), 256).alias("key")), "keys")
    one = keyed.groupBy("language", "key").agg(F.min("doc_id").alias("rep"))
    members = stored(keyed.join(one, ["language", "key"]).filter("doc_id <> rep").select("doc_id", "rep"), "members")
    few = members.count() <= MOST_COPIES
    reps = sets.join(F.broadcast(members.select("doc_id")) if few else members.select("doc_id"), "doc_id", "left_anti").select(F.col("doc_id").alias("id"), "language", "items")
    pairs = lineage.similar_pairs(reps if few else stored(reps, "sets")).select(F.col("old").alias("a"), F.col("new").alias("b"), six("similarity"))
    return pairs.unionByName(members.select(F.col("rep").alias("a"), F.col("doc_id").alias("b"), F.lit(1.0).alias("similarity")))


@register(f"WITH {VERSIONS} SELECT change_type, count(*) AS n FROM matches GROUP BY 1")
def version_changes_summary(spark, sf_dir):
    return lineage.match_symbols(*versions(spark, sf_dir), similar=False).groupBy("change_type").agg(F.count(F.lit(1)).alias("n"))


@register(f"""WITH {VERSIONS} SELECT DISTINCT content_hash, CASE WHEN content_hash IN (SELECT content_hash FROM o) THEN 'unchanged' ELSE 'added' END AS change FROM n
UNION ALL SELECT DISTINCT content_hash, 'removed' FROM o WHERE content_hash NOT IN (SELECT content_hash FROM n)""")
def changed_since(spark, sf_dir):
    return lineage.changed_since(*versions(spark, sf_dir))


@register()
def version_compare(spark, sf_dir):
    """Changed symbols of the two versions with all three passes."""
    symbols, _ = lineage.compare_versions(*versions(spark, sf_dir), limit=None)
    return symbols.select("old", "new", "change_type", six("similarity"), "old_symbol", "new_symbol")


def _line():
    return F.when(F.col("lang").isin("en", "fr"), F.concat(F.lit("l"), F.floor(F.col("doc_id") / 8).cast("string")))


def _lines(spark, sf_dir):
    """Documents as chunks: English and French ones in lineages of neighbouring ids, the others alone; versions by id."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.concat(F.lit("d"), "doc_id").alias("chunk_hash"),
        _line().alias("lineage_id"),
        F.concat(F.lit("v"), F.col("doc_id") % 4).alias("version_id"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("content_hash"),
    )


LINE = "CASE WHEN lang IN ('en', 'fr') THEN 'l' || CAST(doc_id // 8 AS BIGINT) END"
LINES = f"""lines AS (SELECT 'd' || doc_id AS chunk_hash, {LINE} AS lineage_id, 'v' || (doc_id % 4) AS version_id, sha256(coalesce(text, '')) AS content_hash FROM documents)"""
FUSED = f"{HITS}, {RRF}, placed AS (SELECT qid, chunk_hash, score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, chunk_hash) AS rank FROM fused)"


def _ranks(spark):
    return rank.version_rank(spark.createDataFrame([(f"v{i}", i) for i in range(3)], "version_id string, timestamp long"), "v3")


@register(f"""WITH {FUSED}, {LINES}, r AS (SELECT qid, chunk_hash, lineage_id, version_id, max(score) OVER w AS score, row_number() OVER (PARTITION BY qid, coalesce(lineage_id, 'chunk:' || chunk_hash) ORDER BY version_id = 'v1' DESC, version_id DESC, chunk_hash) AS place
FROM placed JOIN lines USING (chunk_hash) WINDOW w AS (PARTITION BY qid, coalesce(lineage_id, 'chunk:' || chunk_hash)))
SELECT qid, chunk_hash, lineage_id, version_id, round(score, 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, chunk_hash) AS rank FROM r WHERE place = 1""")
def lineage_dedup_target(spark, sf_dir):
    out = rank.lineage_dedup(fusion.rrf(hits(spark, sf_dir)), _lines(spark, sf_dir), _ranks(spark), "v1")
    return out.select("qid", "chunk_hash", "lineage_id", "version_id", six("score"), "rank")


@register(f"""WITH n AS (SELECT {LINE} AS lineage_id, 'v' || (doc_id % 4) AS version_id, CASE WHEN doc_id % 2 = 0 THEN 'modified' ELSE 'added' END AS change_type, 'd' || doc_id AS symbol_id FROM documents)
SELECT lineage_id, string_agg(version_id || ':' || change_type || ':' || symbol_id, '>' ORDER BY CASE version_id WHEN 'v3' THEN 4 ELSE CAST(substr(version_id, 2) AS INT) END, version_id, change_type, symbol_id) AS history FROM n WHERE lineage_id IS NOT NULL GROUP BY 1""")
def lineage_history(spark, sf_dir):
    d = table(spark, sf_dir, "documents").filter(_line().isNotNull())
    nodes = d.select(_line().alias("lineage_id"), F.concat(F.lit("v"), F.col("doc_id") % 4).alias("version_id"), F.when(F.col("doc_id") % 2 == 0, "modified").otherwise("added").alias("change_type"), F.concat(F.lit("d"), "doc_id").alias("symbol_id"))
    rows = rank.lineage_history(nodes, _ranks(spark))
    return rows.select("lineage_id", F.array_join(F.transform("history", lambda x: F.concat_ws(":", x["version_id"], x["change_type"], x["symbol_id"])), ">").alias("history"))


def _sql_tokens(text: str) -> str:
    return rf"""list_filter(list_transform(regexp_extract_all({text}, '[A-Za-z]+'), lambda x: lower(x)), lambda x: NOT list_contains({STOP}, x))"""


@register(f"""WITH {FUSED}, {LINES}, pool AS (SELECT qid, chunk_hash, lineage_id FROM placed JOIN lines USING (chunk_hash) WHERE lineage_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY qid, lineage_id ORDER BY rank) = 1),
nodes AS (SELECT {LINE} AS lineage_id, 'v' || (doc_id % 4) AS version_id, CASE WHEN doc_id % 2 = 0 THEN 'modified' ELSE 'unchanged' END AS change_type, {_sql_tokens("text")} AS m FROM documents WHERE lang IN ('en', 'fr')),
q AS (SELECT item_id AS qid, list_distinct({_sql_tokens('text')}) AS t, item_id % 4 AS v FROM benchmark),
s AS (SELECT pool.qid, chunk_hash, max(len(list_intersect(t, list_distinct(m))) / CAST(greatest(len(t), 1) AS DOUBLE) + CASE WHEN version_id = 'v' || v OR v = 2 AND version_id = 'v3' THEN 5e-1 ELSE 0e0 END + CASE WHEN change_type = 'unchanged' THEN 0e0 ELSE 1e-1 END) AS raw
FROM pool JOIN q USING (qid) JOIN nodes USING (lineage_id) GROUP BY ALL)
SELECT qid, chunk_hash, round(raw, 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY round(raw, 9) DESC, chunk_hash) AS rank FROM s WHERE raw > 0""")
def evolution_overlap(spark, sf_dir):
    """The evolution view of all passages over all documents with a lineage, a document's text as its commit's message.
    Every fourth passage names the tag of version v3 besides its own version."""
    d, b = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    words = lambda c: F.array_distinct(F.filter(F.transform(F.regexp_extract_all(c, F.lit("([A-Za-z]+)"), F.lit(1)), F.lower), lambda x: ~x.isin(STOPWORDS)))
    nodes = d.filter(_line().isNotNull()).select(
        _line().alias("lineage_id"), F.concat(F.lit("v"), F.col("doc_id") % 4).alias("version_id"),
        F.when(F.col("doc_id") % 2 == 0, "modified").otherwise("unchanged").alias("change_type"), words("text").alias("message_tokens"),
    )
    version = F.col("item_id") % 4
    refs = F.when(version == 2, F.array(F.lit("v2"), F.lit("release"))).otherwise(F.array(F.concat(F.lit("v"), version)))
    asked = b.select(F.col("item_id").alias("qid"), words("text").alias("tokens"), refs.alias("refs"))
    tags = spark.createDataFrame([("v3", "release")], "version_id string, tag string")
    pool = fusion.rrf(hits(spark, sf_dir)).join(_lines(spark, sf_dir).select("chunk_hash", "lineage_id"), "chunk_hash")
    return rank.evolution_view(asked, pool, nodes, tags).select("qid", "chunk_hash", six("raw", "score"), "rank")


@register(f"""WITH {FUSED}, {LINES}, g AS (SELECT qid, content_hash, min_by(chunk_hash, rank) AS chunk_hash, max(score) AS score, min(rank) AS first, array_to_string(list_sort(list_distinct(list(version_id))), ',') AS versions FROM placed JOIN lines USING (chunk_hash) GROUP BY ALL)
SELECT qid, content_hash, chunk_hash, round(score, 6) AS score, versions, row_number() OVER (PARTITION BY qid ORDER BY first) AS rank FROM g QUALIFY rank <= 10""")
def history_collapse_by_hash(spark, sf_dir):
    out = rank.collapse_copies(fusion.rrf(hits(spark, sf_dir)), _lines(spark, sf_dir), 10)
    return out.select("qid", "content_hash", "chunk_hash", six("score"), F.array_join("versions", ",").alias("versions"), "rank")


@register("""SELECT 'd' || doc_id AS symbol, source || '::d' || doc_id AS symbol_id, sha256(coalesce(lang, '') || chr(0) || coalesce(text, '')) AS content_hash,
sha256('c1' || chr(0) || source || chr(0) || 'd' || doc_id || chr(0) || '1' || chr(0) || sha256(coalesce(lang, '') || chr(0) || coalesce(text, ''))) AS occurrence_id,
substr(sha256('c1' || chr(0) || source || chr(0) || 'd' || doc_id || chr(0) || '1'), 1, 16) AS lineage_id FROM documents""")
def content_hash_ids(spark, sf_dir):
    from ..functions.text import lineage_id, occurrence_id

    d = table(spark, sf_dir, "documents").withColumn("symbol", F.concat(F.lit("d"), F.col("doc_id"))).withColumn("content_hash", content_hash("lang", "text"))
    at = (F.lit("c1"), F.col("source"), F.col("symbol"), F.lit(1))
    return d.select("symbol", symbol_id("source", "symbol").alias("symbol_id"), "content_hash", occurrence_id(*at, F.col("content_hash")).alias("occurrence_id"), lineage_id(*at).alias("lineage_id"))



