"""Queries of operators that the others don't show: saved indexes, tuning, caches, overlaps, run files, views over a fused list."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import capped, lineage_id, plain_tokens, snippet, symbol_id, word_set
from ..operators import evaluation, fusion, graph, lexical, lineage, query, rank, rerankers, structural
from ..operators.embedders import EMBEDDERS, Embedder
from ..session import shared_folder
from ..sources import runs
from ..sources.cache import Vectors
from ..streaming import latency_windows as windows
from .graphs import EDGES, PATTERNS, SQL_TRAITS, edges
from .inputs import CHUNKS, HITS, VERSIONS, chunks, hits, queries, sql_bm25, sql_embed, table, versions
from .retrieval import BASE_TERMS, CODE, RANKED, RRF, six
from .versions import FUSED, LINES, _lines, _ranks

QUERIES, SQL = {}, {}


def register(sql: str | None = None):
    def take(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return take


def _folder(spark, name: str) -> str:
    import uuid

    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"


@register(f"WITH {CODE}, {sql_bm25('dterm', 'qterm', 'lex')} {RANKED}")
def bm25_saved_index(spark, sf_dir):
    """A whole index written, read again and searched."""
    path = _folder(spark, "index")
    lexical.index_chunks(chunks(spark, sf_dir), keep=False).save(path)
    return lexical.search(lexical.LexicalIndex.load(spark, path), queries(spark, sf_dir), 10).select("qid", "chunk_hash", six("raw", "score"), "rank")


def _cell(k1: str, b: str) -> str:
    part = f"tf / (tf + {k1} * (1 - {b} + {b} * dl / avgdl))"
    return f"SELECT {k1} AS k1, {b} AS b, qid, chunk_hash, sum(qtf * ln(1 + (n - df + 5e-1) / (df + 5e-1)) * ({part})) AS raw FROM qterm JOIN lex_df USING (term) JOIN lex_tf USING (term) JOIN lex_dl USING (chunk_hash), lex_c GROUP BY ALL"


@register(f"""WITH {CODE}, {sql_bm25('dterm', 'qterm', 'lex')}, cells AS ({' UNION ALL '.join(_cell(k, b) for k in ('9e-1', '15e-1') for b in ('3e-1', '75e-2'))})
SELECT k1, b, qid, chunk_hash, round(raw, 6) AS score, row_number() OVER (PARTITION BY k1, b, qid ORDER BY round(raw, 9) DESC, chunk_hash) AS rank FROM cells QUALIFY rank <= 5""")
def bm25_tune_grid(spark, sf_dir):
    asked = lexical.query_terms(queries(spark, sf_dir)).persist()
    index = lexical.index_chunks(chunks(spark, sf_dir), only=asked)
    return lexical.tune(index, queries(spark, sf_dir), 5, [0.9, 1.5], [0.3, 0.75], asked).select("k1", "b", "qid", "chunk_hash", six("raw", "score"), "rank")


ONE = "(SELECT min(item_id) FROM benchmark)"


@register(f"WITH {CODE}, {sql_bm25('dterm', 'qterm', 'lex')} SELECT c.chunk_hash, round(coalesce(raw, 0e0), 6) AS score FROM chunks c LEFT JOIN (SELECT * FROM lex WHERE qid = {ONE}) l USING (chunk_hash)")
def bm25_score_all(spark, sf_dir):
    """Every chunk's score for the first passage, 0 without a common term."""
    first = queries(spark, sf_dir).orderBy("qid").limit(1)  # a query of one, as the operator takes
    return lexical.score_all(lexical.index_chunks(chunks(spark, sf_dir), only=lexical.query_terms(first)), first).select("chunk_hash", six("raw", "score"))


@register(f"WITH {HITS} SELECT qid, chunk_hash, round(raw, 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY round(raw, 9) DESC, chunk_hash) AS rank FROM hits WHERE view = 'semantic'")
def fuse_single_view(spark, sf_dir):
    """One view passes unchanged, whatever the method."""
    rows = fusion.fuse(hits(spark, sf_dir).filter("view = 'semantic'"), "weighted", views=1)
    return rows.select("qid", "chunk_hash", six("score"), "rank")


@register(f"""WITH {HITS}, w AS (SELECT * FROM (VALUES ('lexical', 2e0), ('semantic', 0e0)) t(view, weight)), fused AS (SELECT qid, chunk_hash, sum(weight / (60 + rank)) AS score FROM hits JOIN w USING (view) GROUP BY ALL)
SELECT qid, chunk_hash, round(score, 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, chunk_hash) AS rank FROM fused""")
def fuse_rrf_weighted(spark, sf_dir):
    """A view of weight 0 adds chunks, not score."""
    return fusion.rrf(hits(spark, sf_dir), weights=fusion.weights_frame(spark, {"lexical": 2.0, "semantic": 0.0})).select("qid", "chunk_hash", six("score"), "rank")


@register(f"""WITH {HITS}, f AS (SELECT * FROM hits WHERE rank <= 10), b AS (SELECT a.qid, count(*) / 10e0 AS overlap FROM f a JOIN f b ON a.qid = b.qid AND a.chunk_hash = b.chunk_hash AND a.view = 'lexical' AND b.view = 'semantic' GROUP BY 1)
SELECT qid, coalesce(overlap, 0e0) AS overlap FROM (SELECT DISTINCT qid FROM hits) LEFT JOIN b USING (qid)""")
def view_overlap(spark, sf_dir):
    return query.top_overlap(hits(spark, sf_dir), "lexical", "semantic")


WORDS = r"list_distinct(regexp_extract_all(lower({0}), '[\p{{L}}\p{{M}}\p{{N}}\p{{Pc}}]+'))"


@register(f"""WITH {FUSED}, p AS (SELECT qid, chunk_hash FROM placed WHERE rank <= 5), w AS (SELECT p.qid, p.chunk_hash, {WORDS.format('q.text')} AS a, {WORDS.format('c.text')} AS b FROM p JOIN queries q USING (qid) JOIN chunks c USING (chunk_hash))
SELECT qid, chunk_hash, round(CASE WHEN len(list_distinct(a || b)) = 0 THEN 0e0 ELSE len(list_intersect(a, b)) / CAST(len(list_distinct(a || b)) AS DOUBLE) END, 6) AS pair FROM w""")
def rerank_overlap_scores(spark, sf_dir):
    """The pair scores of the offline reranker over each query's first five."""
    pool = rank.cut(fusion.rrf(hits(spark, sf_dir)), 5).join(chunks(spark, sf_dir).withColumnRenamed("text", "chunk_text"), "chunk_hash")
    return rerankers.load(spark, "overlap")(queries(spark, sf_dir), pool).select("qid", "chunk_hash", six("pair"))


@register(f"""WITH {FUSED}, p AS (SELECT qid, chunk_hash, {WORDS.format('c.text')} AS w FROM placed JOIN chunks c USING (chunk_hash) WHERE rank <= 4)
SELECT a.qid, a.chunk_hash AS a, b.chunk_hash AS b, round(CASE WHEN len(list_distinct(a.w || b.w)) = 0 THEN 0e0 ELSE len(list_intersect(a.w, b.w)) / CAST(len(list_distinct(a.w || b.w)) AS DOUBLE) END, 6) AS similarity FROM p a JOIN p b ON a.qid = b.qid AND a.chunk_hash < b.chunk_hash""")
def list_word_overlap(spark, sf_dir):
    """Word overlap inside each query's first four, as diversity without vectors compares."""
    rows = rank.cut(fusion.rrf(hits(spark, sf_dir)), 4).join(chunks(spark, sf_dir).select("chunk_hash", word_set("text").alias("words")), "chunk_hash")
    return rank.word_overlap(rows.select("qid", "chunk_hash", "words")).select("qid", "a", "b", six("similarity"))


@register(f"WITH {CHUNKS}, {sql_embed('queries', 'qid', 'qv')} SELECT qid, slot + 1 AS slot, round(x, 6) AS x FROM qv")
def cached_vectors(spark, sf_dir):
    """Passages' vectors through an empty cache, then from it; slots that hold something."""
    asked, kept = queries(spark, sf_dir), Vectors(spark, _folder(spark, "vectors"))
    through = Embedder(EMBEDDERS["hash-64"], kept)
    through(asked, "qid").count()
    rows = through(asked, "qid").select("qid", F.posexplode("vector").alias("at", "x"))
    return rows.filter("x <> 0").select("qid", (F.col("at") + 1).cast("long").alias("slot"), six("x"))


@register("""WITH t AS (SELECT DISTINCT sha1(coalesce(text, '')) AS text_sha1, doc_id % 2 AS odd FROM documents)
SELECT DISTINCT text_sha1 FROM t WHERE text_sha1 NOT IN (SELECT text_sha1 FROM t WHERE odd = 1)""")
def cache_missing_texts(spark, sf_dir):
    """Texts that a cache with the vectors of every second document lacks."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha1(F.coalesce("text", F.lit(""))).alias("text_sha1"), F.lit("m").alias("model"), F.lit("document").alias("kind"), F.array(F.lit(1.0)).alias("vector"))
    kept = Vectors(spark, _folder(spark, "vectors"))
    kept.add(d.filter("doc_id % 2 = 1"))
    return kept.missing(d.select("model", "kind", "text_sha1")).select("text_sha1")


@register(f"""WITH {HITS}, {RRF}, r AS (SELECT qid, chunk_hash, round(score, 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_hash DESC) AS rank FROM (SELECT qid, chunk_hash, round(score, 9) AS score FROM fused))
SELECT CAST(qid AS VARCHAR) AS qid, chunk_hash AS doc_id, rank, score FROM r WHERE rank <= 20""")
def run_file(spark, sf_dir):
    """A run written as text and read again: twenty lines a query, ties by id descending."""
    path = _folder(spark, "run")
    run = fusion.rrf(hits(spark, sf_dir)).select("qid", F.col("chunk_hash").alias("doc_id"), F.round("score", 9).alias("score"))
    runs.write_run(run, path, k=20)
    return runs.read_run(spark, path)


@register(f"""WITH {FUSED}, {SQL_TRAITS}, w AS (SELECT qid, t.trait, (qid % 5) - 2e0 + i AS weight FROM (SELECT DISTINCT qid FROM placed), (SELECT DISTINCT trait, i FROM traits) t),
s AS (SELECT qid, chunk_hash, rank AS was, sum(weight) AS raw FROM placed JOIN traits USING (chunk_hash) JOIN w USING (qid, trait) GROUP BY ALL)
SELECT qid, chunk_hash, round(raw, 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY round(raw, 9) DESC, was) AS rank FROM s""")
def structural_rescore(spark, sf_dir):
    """The structural view over the fused list; ties keep its order."""
    d = table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), "doc_id").alias("chunk_hash"), "text")
    pool = fusion.rrf(hits(spark, sf_dir))
    names = spark.createDataFrame([(t, float(i)) for i, t in enumerate(PATTERNS)], "trait string, i double")
    weights = pool.select("qid").distinct().join(names).select("qid", "trait", (F.col("qid") % 5 - 2.0 + F.col("i")).alias("weight"))  # a row per query and trait
    return structural.rescore(pool, structural.pattern_traits(d, PATTERNS), weights).select("qid", "chunk_hash", six("raw", "score"), "rank")


@register(f"""WITH {FUSED}, {EDGES}, sy AS (SELECT 'd' || doc_id AS chunk_hash, 'n' || (doc_id % 25) AS node FROM documents), seed AS (SELECT qid, node, max(score) AS score FROM placed JOIN sy USING (chunk_hash) GROUP BY ALL),
top AS (SELECT *, max(score) OVER (PARTITION BY qid) AS best FROM seed QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, node) <= 10), st AS (SELECT qid, node, score / best AS score FROM top),
walk AS (SELECT src AS here, dst AS nxt, w FROM edges UNION ALL SELECT dst, src, w FROM edges), h1 AS (SELECT qid, nxt AS node, max(score * 5e-1 * w) AS score FROM st JOIN walk ON node = here GROUP BY ALL),
every AS (SELECT qid, node, max(score) AS score FROM (SELECT * FROM st UNION ALL SELECT * FROM h1) GROUP BY ALL), v AS (SELECT qid, chunk_hash, max(score) AS raw FROM every JOIN sy USING (node) GROUP BY ALL)
SELECT qid, chunk_hash, round(raw, 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY round(raw, 9) DESC, chunk_hash) AS rank FROM v QUALIFY rank <= 20""")
def graph_view_topk(spark, sf_dir):
    """The graph view of the fused list: documents stand for nations, and nations lead to others by trade."""
    symbols = table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), "doc_id").alias("chunk_hash"), F.concat(F.lit("n"), F.col("doc_id") % 25).alias("symbol_id"))
    view = graph.graph_view(fusion.rrf(hits(spark, sf_dir)).select("qid", "chunk_hash", "score"), symbols, edges(spark, sf_dir), k=20)
    return view.select("qid", "chunk_hash", six("raw", "score"), "rank")


@register(f"""WITH RECURSIVE {EDGES}, chains AS (SELECT src AS start, [src, dst] AS symbols, [kind] AS kinds, w AS score, dst AS last FROM edges WHERE kind IN ('calls', 'inherits')
UNION ALL SELECT start, list_append(symbols, dst), list_append(kinds, kind), score * w * 8e-1, dst FROM chains JOIN edges ON last = src WHERE edges.kind IN ('calls', 'inherits') AND len(kinds) < 2 AND NOT list_contains(symbols, dst))
SELECT start, array_to_string(symbols, '>') AS chain, round(score, 6) AS score, row_number() OVER (PARTITION BY start ORDER BY round(score, 9) DESC, len(kinds), array_to_string(symbols, chr(1)), array_to_string(kinds, chr(1))) AS rank FROM chains QUALIFY rank <= 50""")
def dependency_chains_topk(spark, sf_dir):
    """The best fifty chains of each start over two kinds of edges."""
    e = edges(spark, sf_dir)
    out = graph.dependency_chains(e, e.select(F.col("src").alias("start")).distinct(), kinds=["calls", "inherits"], depth=2)
    return out.select("start", F.array_join("symbols", ">").alias("chain"), six("score"), "rank")


@register(f"WITH {EDGES} SELECT src AS symbol, dst AS other, kind, 'out' AS way FROM edges WHERE kind = 'calls' UNION ALL SELECT dst, src, kind, 'in' FROM edges WHERE kind = 'calls'")
def graph_steps(spark, sf_dir):
    """Every edge of a kind in both directions, with its other end."""
    rows = graph.steps(edges(spark, sf_dir), "both", ["calls"])
    out = rows.withColumn("way", F.when(F.col("at") == F.col("src"), "out").otherwise("in"))
    return out.select(F.col("at").alias("symbol"), graph.other_end(F.col("at")).alias("other"), "kind", "way")


@register("SELECT 'f' || doc_id || '::d' || doc_id AS symbol_id FROM documents WHERE 'd' || doc_id = 'd7' OR 'K.d' || doc_id = 'd7'")
def graph_resolve_name(spark, sf_dir):
    d = F.concat(F.lit("d"), "doc_id")
    symbols = table(spark, sf_dir, "documents").select(F.concat(F.lit("f"), "doc_id", F.lit("::"), d).alias("symbol_id"), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("K."), d)).otherwise(d).alias("symbol"))
    return graph.resolve(symbols, "d7")


@register(f"""WITH {EDGES}, o AS (SELECT DISTINCT CASE src WHEN 'n1' THEN 'n99' ELSE src END AS src, CASE dst WHEN 'n1' THEN 'n99' ELSE dst END AS dst, kind FROM edges WHERE kind IN ('calls', 'imports')),
n AS (SELECT DISTINCT src, dst, kind FROM edges WHERE kind IN ('imports', 'references')) SELECT 'added' AS change, * FROM (SELECT * FROM n EXCEPT SELECT * FROM o) UNION ALL SELECT 'removed', * FROM (SELECT * FROM o EXCEPT SELECT * FROM n)""")
def graph_edge_changes(spark, sf_dir):
    """Edges of two versions after a rename; both keep one kind."""
    e = edges(spark, sf_dir)
    renames = spark.createDataFrame([("n1", "n99")], "was string, now string")
    return lineage.edge_changes(e.filter("kind in ('calls', 'imports')"), e.filter("kind in ('imports', 'references')"), renames).select("change", "src", "dst", "kind")


LINEAGE_OF = "substr(sha256('{0}' || chr(0) || {1} || chr(0) || {2} || chr(0) || '1'), 1, 16)"


@register(f"""WITH {VERSIONS} SELECT 'c2' AS commit_id, coalesce(CASE WHEN old IS NOT NULL THEN {LINEAGE_OF.format('c1', 'o.path', 'o.symbol')} END, {LINEAGE_OF.format('c2', 'n.path', 'n.symbol')}) AS lineage_id, new AS occurrence_id, coalesce(n.path, o.path) AS path, coalesce(n.symbol, o.symbol) AS symbol, change_type, old AS previous, similarity
FROM matches m LEFT JOIN o ON m.old = o.occurrence_id LEFT JOIN n ON m.new = n.occurrence_id""")
def lineage_record(spark, sf_dir):
    """The lineage rows of the second version: the matched old one's lineage, else a new one."""
    old, new = versions(spark, sf_dir)
    previous = old.select("occurrence_id", lineage_id(F.lit("c1"), F.col("path"), F.col("symbol"), F.col("start_line")).alias("lineage_id"), "path", "symbol")
    return lineage.record_lineage(lineage.match_symbols(old, new, similar=False), previous, new, "c2")


@register(f"""WITH {FUSED}, {LINES}, r AS (SELECT qid, chunk_hash, lineage_id, version_id, max(score) OVER w - (row_number() OVER (PARTITION BY qid, coalesce(lineage_id, 'chunk:' || chunk_hash) ORDER BY version_id DESC, chunk_hash) - 1) * 1e-6 AS score
FROM placed JOIN lines USING (chunk_hash) WINDOW w AS (PARTITION BY qid, coalesce(lineage_id, 'chunk:' || chunk_hash)))
SELECT qid, chunk_hash, lineage_id, version_id, round(score, 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, chunk_hash) AS rank FROM r""")
def lineage_dedup_history(spark, sf_dir):
    """All hits of each lineage, newest first, each a little below the one before."""
    out = rank.lineage_dedup(fusion.rrf(hits(spark, sf_dir)), _lines(spark, sf_dir), _ranks(spark), keep_history=True)
    return out.select("qid", "chunk_hash", "lineage_id", "version_id", six("score"), "rank")


@register("""WITH v AS (SELECT 'c' || o_orderstatus || '-' || year(o_orderdate) AS version_id, CAST(epoch(min(o_orderdate)) AS BIGINT) AS timestamp FROM orders GROUP BY 1), r AS (SELECT version_id, row_number() OVER (ORDER BY timestamp, version_id) - 1 AS version_rank FROM v)
SELECT * FROM r UNION ALL SELECT 'HEAD', count(*) + 1 FROM v""")
def version_ranks(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    v = o.groupBy(F.concat(F.lit("c"), "o_orderstatus", F.lit("-"), F.year("o_orderdate")).alias("version_id")).agg(F.unix_timestamp(F.min("o_orderdate")).alias("timestamp"))
    return rank.version_rank(v)


@register(f"""WITH {VERSIONS}, ch AS (SELECT coalesce(n.path || '::' || n.symbol, o.path || '::' || o.symbol) AS symbol, coalesce(n.path, o.path) AS path FROM matches m LEFT JOIN o ON m.old = o.occurrence_id LEFT JOIN n ON m.new = n.occurrence_id WHERE change_type <> 'unchanged'),
co AS (SELECT DISTINCT 'c' || (doc_id % 10) AS commit_id, source AS path FROM documents)
SELECT commit_id, array_to_string(list_sort(list_distinct(list(symbol))), ',') AS symbols FROM co JOIN ch USING (path) GROUP BY 1""")
def commits_touched_symbols(spark, sf_dir):
    """Commits with the changed symbols of the files that they touch."""
    from ..service import touched_symbols

    old, new = versions(spark, sf_dir)
    matches = lineage.match_symbols(old, new, similar=False).filter("change_type <> 'unchanged'")
    name = lambda side, at: side.select(F.col("occurrence_id").alias(at), symbol_id("path", "symbol").alias(f"{at}_symbol"))
    changes = matches.join(name(old, "old"), "old", "left").join(name(new, "new"), "new", "left")
    commits = table(spark, sf_dir, "documents").groupBy(F.concat(F.lit("c"), F.col("doc_id") % 10).alias("commit_id")).agg(F.collect_set("source").alias("files"))
    return touched_symbols(commits, changes).select("commit_id", F.array_join("symbols", ",").alias("symbols"))


@register("SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(avg(value), 6) AS mean, round(max(value), 6) AS most FROM events GROUP BY ALL")
def latency_windows(spark, sf_dir):
    """The stream's windows over the table as a batch."""
    return windows(table(spark, sf_dir, "events")).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", six("mean"), six("most"))


@register(r"SELECT 'd' || doc_id AS id FROM documents WHERE regexp_matches(text, '\binput\(|sys\.stdin')")
def reads_stdin(spark, sf_dir):
    return evaluation.reads_stdin(table(spark, sf_dir, "documents")).select(F.concat(F.lit("d"), "doc_id").alias("id"))


@register("""WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents) SELECT doc_id, substr(text, 1, 4000) AS shown, array_to_string(string_split(text, chr(10))[1:40], chr(10)) AS snippet FROM t""")
def shown_texts(spark, sf_dir):
    """Texts as tools and result lists show them."""
    text = F.coalesce("text", F.lit(""))
    return table(spark, sf_dir, "documents").select("doc_id", capped(text).alias("shown"), snippet(text).alias("snippet"))


@register(f"""WITH {BASE_TERMS} SELECT t.chunk_hash, count(DISTINCT q.term) AS shared FROM dterm t JOIN (SELECT DISTINCT term FROM qterm) q USING (term) GROUP BY 1""")
def vocabulary_shared(spark, sf_dir):
    """How many of the passages' terms each chunk has: postings held to the asked vocabulary."""
    asked = lexical.query_terms(queries(spark, sf_dir), plain_tokens, False)
    index = lexical.index_chunks(chunks(spark, sf_dir), tokens=plain_tokens, only=asked)
    return index.postings.groupBy("chunk_hash").agg(F.count(F.lit(1)).alias("shared"))


