"""Queries of code graphs, over trade between nations and over sources made of the suppliers."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import graph, lexical, structural
from ..operators.resolution import resolve_edges
from ..sources.chunkers import enclosing, spans
from ..sources.references import references
from .inputs import kept, table
from .retrieval import six

QUERIES, SQL = {}, {}


def register(sql: str | None = None):
    def take(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return take


#: Every nation's trade with every other one; kinds go round by the rank of the partner.
KINDS = ["calls", "imports", "references", "inherits"]
EDGES = """pairs AS (SELECT s_nationkey AS a, c_nationkey AS b, count(*) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE s_nationkey <> c_nationkey GROUP BY ALL),
edges AS MATERIALIZED (SELECT 'n' || a AS src, 'n' || b AS dst, ['calls', 'imports', 'references', 'inherits'][CAST((r - 1) % 4 + 1 AS INT)] AS kind, [1e0, 6e-1, 5e-1, 8e-1][CAST((r - 1) % 4 + 1 AS INT)] AS w FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY n DESC, b) AS r FROM pairs))"""


def _edges(spark, sf_dir):
    li, su, o, c = (table(spark, sf_dir, t) for t in ("lineitem", "supplier", "orders", "customer"))
    rows = li.join(su, F.expr("l_suppkey = s_suppkey")).join(o, F.expr("l_orderkey = o_orderkey")).join(c, F.expr("o_custkey = c_custkey")).filter("s_nationkey <> c_nationkey")
    pairs = rows.groupBy("s_nationkey", "c_nationkey").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("s_nationkey").orderBy(F.desc("n"), "c_nationkey")
    kind = F.element_at(F.array(*[F.lit(k) for k in KINDS]), ((F.row_number().over(order) - 1) % 4 + 1).cast("int"))
    return graph.clean_edges(pairs.select(F.concat(F.lit("n"), "s_nationkey").alias("src"), F.concat(F.lit("n"), "c_nationkey").alias("dst"), kind.alias("kind")))


def edges(spark, sf_dir):
    return kept(spark, sf_dir, "edges", _edges)


def _seeds(spark):
    return spark.createDataFrame([(1, "n0", 2.0), (1, "n1", 1.0), (2, "n7", 5.0)], "qid long, node string, score double")


SEEDS = "seeds AS (SELECT * FROM (VALUES (CAST(1 AS BIGINT), 'n0', 1e0), (1, 'n1', 5e-1), (2, 'n7', 1e0)) t(qid, node, score)), steps AS (SELECT src AS here, dst AS nxt, w FROM edges UNION ALL SELECT dst, src, w FROM edges)"
HOP = "SELECT qid, nxt AS node, max(score * 5e-1 * w) AS score FROM {0} JOIN steps ON node = here GROUP BY ALL"


@register(f"WITH {EDGES}, {SEEDS}, h1 AS ({HOP.format('seeds')}) SELECT qid, node, round(max(score), 6) AS score FROM (SELECT * FROM seeds UNION ALL SELECT * FROM h1) GROUP BY ALL")
def graph_expand_1hop(spark, sf_dir):
    return graph.expand(_seeds(spark), edges(spark, sf_dir), 1).select("qid", "node", six("score"))


@register(f"WITH {EDGES}, {SEEDS}, h1 AS ({HOP.format('seeds')}), h2 AS ({HOP.format('h1')}) SELECT qid, node, round(max(score), 6) AS score FROM (SELECT * FROM seeds UNION ALL SELECT * FROM h1 UNION ALL SELECT * FROM h2) GROUP BY ALL")
def graph_expand_2hop(spark, sf_dir):
    return graph.expand(_seeds(spark), edges(spark, sf_dir), 2).select("qid", "node", six("score"))


@register(f"""WITH RECURSIVE {EDGES}, chains AS (SELECT src AS start, [src, dst] AS symbols, [kind] AS kinds, w AS score, dst AS last FROM edges
UNION ALL SELECT start, list_append(symbols, dst), list_append(kinds, kind), score * w * 8e-1, dst FROM chains JOIN edges ON last = src WHERE len(kinds) < 3 AND NOT list_contains(symbols, dst))
SELECT start, array_to_string(symbols, '>') AS chain, array_to_string(kinds, '>') AS kinds, round(score, 6) AS score, CAST(len(kinds) AS BIGINT) AS length FROM chains""")
def dependency_chains(spark, sf_dir):
    e = edges(spark, sf_dir)
    out = graph.dependency_chains(e, e.select(F.col("src").alias("start")).distinct(), limit=None)
    return out.select("start", F.array_join("symbols", ">").alias("chain"), F.array_join("kinds", ">").alias("kinds"), six("score"), "length")


@register(f"WITH {EDGES} SELECT node, CAST(sum(o) AS BIGINT) AS out_degree, CAST(sum(i) AS BIGINT) AS in_degree FROM (SELECT src AS node, 1 AS o, 0 AS i FROM edges UNION ALL SELECT dst, 0, 1 FROM edges) GROUP BY 1")
def graph_in_out_degree(spark, sf_dir):
    return graph.degrees(edges(spark, sf_dir))


#: A repository made of the suppliers: twenty to a file, files in turn Python, TypeScript and Go.  Each supplier is a
#: function that calls the next one of its file, the last that of the next file of its language.
NEXT = "CASE WHEN (k + 1) // 20 = k // 20 THEN k + 1 ELSE k + 41 END"
SUPPLIERS = f"""s0 AS (SELECT s_suppkey AS k, s_suppkey // 20 AS f, row_number() OVER (PARTITION BY s_suppkey // 20 ORDER BY s_suppkey) - 1 AS i FROM supplier),
s AS (SELECT a.k, a.f, a.i, CAST(a.f % 3 AS INT) AS l, b.k AS t, b.f AS tf FROM (SELECT *, {NEXT} AS nxt FROM s0) a LEFT JOIN s0 b ON b.k = a.nxt),
c AS (SELECT *, CASE l WHEN 0 THEN 'pkg/m' || f || '.py' WHEN 1 THEN 'web/m' || f || '.ts' ELSE 'srv/m' || f || '/a.go' END AS path, CASE l WHEN 2 THEN 'S' ELSE 's' END || k AS symbol,
      CASE l WHEN 0 THEN 'pkg/m' || tf || '.py' WHEN 1 THEN 'web/m' || tf || '.ts' ELSE 'srv/m' || tf || '/a.go' END AS tpath, CASE l WHEN 2 THEN 'S' ELSE 's' END || t AS tsymbol,
      CAST(4 + 3 * i AS INT) AS start_line, CAST(CASE l WHEN 0 THEN 5 ELSE 6 END + 3 * i AS INT) AS end_line FROM s)"""


def files(spark, sf_dir):
    """(path, content) of that repository."""
    k, f = F.col("k"), F.col("f")
    window = Window.partitionBy("f").orderBy("k")
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("k"), F.expr("cast(s_suppkey as bigint) div 20").alias("f"))
    told = rows.withColumn("next", F.when(F.expr("(k + 1) div 20") == f, k + 1).otherwise(k + 41))
    told = told.join(rows.select(F.col("k").alias("t"), F.col("f").alias("tf")), F.expr("next = t"), "left").withColumns({"i": F.row_number().over(window), "lang": f % 3})
    far = F.col("t").isNotNull() & (F.col("tf") != f)
    called = F.when(F.col("t").isNull(), "1")
    function = (
        F.when(F.expr("lang = 0"), F.concat(F.lit("def s"), k, F.lit("():\n    return "), F.coalesce(called, F.concat(F.lit("s"), "t", F.lit("()"))), F.lit("\n\n")))
        .when(F.expr("lang = 1"), F.concat(F.lit("export function s"), k, F.lit("(): number {\n  return "), F.coalesce(called, F.concat(F.lit("s"), "t", F.lit("()"))), F.lit(";\n}\n")))
        .otherwise(F.concat(F.lit("func S"), k, F.lit("() int {\n\treturn "), F.coalesce(called, F.when(far, F.concat(F.lit("m"), "tf", F.lit(".S"), "t", F.lit("()"))), F.concat(F.lit("S"), "t", F.lit("()"))), F.lit("\n}\n")))
    )
    imported = (
        F.when(F.expr("lang = 0"), F.concat(F.lit("from pkg.m"), "tf", F.lit(" import s"), "t"))
        .when(F.expr("lang = 1"), F.concat(F.lit("import { s"), "t", F.lit(" } from './m"), "tf", F.lit("';")))
        .otherwise(F.concat(F.lit('import "example.com/x/srv/m'), "tf", F.lit('"')))
    )
    grouped = told.withColumns({"body": function, "head": F.when(far, imported)}).groupBy("f", "lang").agg(F.array_sort(F.collect_list(F.struct("i", "body"))).alias("bodies"), F.max("head").alias("head"))  # twenty to a file
    none = F.when(F.expr("lang = 0"), "import os").when(F.expr("lang = 1"), "const zero = 0;").otherwise('import "fmt"')
    first = F.when(F.expr("lang = 2"), F.concat(F.lit("package m"), f, F.lit("\n"), F.coalesce("head", none), F.lit("\n\n"))).otherwise(F.concat(F.coalesce("head", none), F.lit("\n\n\n")))
    path = F.when(F.expr("lang = 0"), F.concat(F.lit("pkg/m"), f, F.lit(".py"))).when(F.expr("lang = 1"), F.concat(F.lit("web/m"), f, F.lit(".ts"))).otherwise(F.concat(F.lit("srv/m"), f, F.lit("/a.go")))
    return grouped.select(path.alias("path"), F.concat(first, F.array_join(F.transform("bodies", lambda b: b["body"]), "")).alias("content"))


SPAN = "path string, symbol string, kind string, start_line int, end_line int"


def chunk_rows(sources):
    """(path, symbol, kind, start_line, end_line) of files (path, content)."""

    def run(parts):
        for part in parts:
            rows = [(p, s.symbol, s.kind, s.start_line, s.end_line) for p, c in zip(part["path"], part["content"], strict=True) for s in spans(p, c)]
            yield pd.DataFrame(rows, columns=["path", "symbol", "kind", "start_line", "end_line"])

    return sources.mapInPandas(run, SPAN)


def reference_rows(sources):
    def run(parts):
        for part in parts:
            rows = [(p, r.symbol, r.kind, r.target, r.local, i) for p, c in zip(part["path"], part["content"], strict=True) for i, r in enumerate(references(p, c))]
            yield pd.DataFrame(rows, columns=["path", "symbol", "kind", "target", "local", "seq"])

    return sources.mapInPandas(run, "path string, symbol string, kind string, target string, local string, seq int")


@register(f"WITH {SUPPLIERS} SELECT path, symbol, 'function' AS kind, start_line, end_line FROM c")
def source_chunks(spark, sf_dir):
    return chunk_rows(files(spark, sf_dir))


@register(f"""WITH {SUPPLIERS} SELECT path AS src, path || '::' || symbol AS dst, 'defines' AS kind FROM c
UNION ALL SELECT path || '::' || symbol, tpath || '::' || tsymbol, 'calls' FROM c WHERE t IS NOT NULL
UNION ALL SELECT path, CASE l WHEN 2 THEN tpath ELSE tpath || '::' || tsymbol END, 'imports' FROM c WHERE tf <> f""")
def source_references_graph(spark, sf_dir):
    sources = files(spark, sf_dir)
    defs = chunk_rows(sources).select(F.lit("c").alias("commit_id"), "path", F.when(F.col("kind") != "file", F.col("symbol")).alias("symbol"))
    return resolve_edges(defs, reference_rows(sources).withColumn("commit_id", F.lit("c"))).select("src", "dst", "kind")


@register(f"""WITH {SUPPLIERS}, n AS (SELECT path, l, max(end_line) AS last FROM c GROUP BY ALL), lines AS (SELECT path, CAST(unnest(range(1, last + 1)) AS INT) AS line FROM n)
SELECT lines.path, line, symbol FROM lines LEFT JOIN c ON c.path = lines.path AND line BETWEEN start_line AND end_line""")
def line_enclosing_symbol(spark, sf_dir):
    """Each line up to a file's last chunk with the symbol of the shortest chunk that covers it, if any."""

    def run(parts):
        for part in parts:
            rows = []
            for p, c in zip(part["path"], part["content"], strict=True):
                found = spans(p, c)
                rows += [(p, line, enclosing(found, line)) for line in range(1, max(s.end_line for s in found) + 1)]
            yield pd.DataFrame(rows, columns=["path", "line", "symbol"])

    return files(spark, sf_dir).mapInPandas(run, "path string, line int, symbol string")


PATTERNS = {"has_digit": "[0-9]", "has_pipe": "[|]", "has_line": "\\n", "has_shout": "[A-Z]{4}"}
SQL_TRAITS = "traits AS (" + " UNION ALL ".join(f"SELECT 'd' || doc_id AS chunk_hash, '{t}' AS trait, {i} AS i FROM documents WHERE regexp_matches(text, '{p}')" for i, (t, p) in enumerate(PATTERNS.items())) + ")"


@register(f"""WITH {SQL_TRAITS}, share AS (SELECT trait, greatest(1e-3, least(1 - 1e-3, count(DISTINCT chunk_hash) / CAST((SELECT count(*) FROM documents) AS DOUBLE))) AS prior FROM traits GROUP BY 1),
w AS (SELECT item_id AS qid, trait, ln(p / prior) - ln((1 - p) / (1 - prior)) AS weight FROM share, (SELECT item_id, ((item_id % 7) + 1) / 9e0 AS p FROM benchmark)),
s AS (SELECT qid, chunk_hash, sum(weight) AS raw FROM traits JOIN w USING (trait) GROUP BY ALL)
SELECT qid, chunk_hash, round(raw, 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY round(raw, 9) DESC, chunk_hash) AS rank FROM s QUALIFY rank <= 10""")
def structural_llr(spark, sf_dir):
    """The ten documents of each query whose traits speak most for it.  Documents with the same traits score alike, so each
    set of traits is scored once, and only the first ten documents of a set can be among a query's."""
    d = table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), "doc_id").alias("chunk_hash"), "text")
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), ((F.col("item_id") % 7 + 1) / 9.0).alias("p"))
    traits = structural.pattern_traits(d, PATTERNS)
    prior = structural.priors(traits, d.count(), list(PATTERNS))
    weights = structural.llr(prior.join(asked)).select("qid", "trait", "weight")  # a row per query and trait
    sets = traits.groupBy("chunk_hash").agg(F.array_sort(F.collect_set("trait")).alias("traits"))  # of a fixed vocabulary
    alike = Window.partitionBy("traits").orderBy("chunk_hash")
    pool = sets.withColumn("r", F.row_number().over(alike)).filter("r <= 10").select("chunk_hash", F.explode("traits").alias("trait"))
    scored = pool.join(weights, "trait").groupBy("qid", "chunk_hash").agg(F.sum("weight").alias("raw"))
    return lexical.top(scored, 10).select("qid", "chunk_hash", F.round("raw", 6).alias("score"), "rank")


SNIPPETS = [
    (1, "sort the numbers with a heap", "import heapq\ndef f(a):\n    heapq.heapify(a)\n    while a:\n        print(heapq.heappop(a))\n"),
    (2, "recursive factorial", "def fact(n):\n    return 1 if n < 2 else n * fact(n - 1)\n"),
    (3, "grid of nested loops", "n = int(input())\nfor i in range(n):\n    for j in range(n):\n        print(i, j)\n"),
    (4, "smallest items by heap", "from heapq import nsmallest\nprint(nsmallest(3, [int(x) for x in input().split()]))\n"),
    (5, "recursive walk of a tree", "def walk(t):\n    for c in t:\n        walk(c)\n"),
    (6, "nested loops over a matrix", "for r in m:\n    for c in r:\n        print(c)\n"),
]


@register()
def structural_trait_fit(spark, sf_dir):
    """Trait models fitted on pairs of query and code, and the probabilities they give."""
    pairs = spark.createDataFrame(SNIPPETS, "qid long, text string, code string")
    traits = pairs.select("qid", F.explode(structural.traits_udf("code")).alias("trait"))
    names = ["heapq", "recursion", "loop_nested2", "print", "io_input"]
    model = structural.TraitModel(features=256).fit(pairs.select("qid", "text"), traits, names)
    return structural.llr(model.predict(pairs.select("qid", "text"))).select("qid", "trait", six("p"), six("weight"))
