"""Queries of text functions and query understanding."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions.text import head_tail, normal_space, snippet
from ..operators import graph, query
from .inputs import table
from .retrieval import six

QUERIES, SQL = {}, {}


def register(sql: str | None = None):
    def take(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return take


@register("""SELECT doc_id, md5(CASE WHEN length(text) <= 500 THEN text ELSE substr(text, 1, 350) || chr(10) || '...' || chr(10) || right(text, 150) END) AS head_tail,
md5(array_to_string(string_split(text, chr(10))[1:40], chr(10))) AS snippet FROM documents""")
def head_tail_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(head_tail("text", 500)).alias("head_tail"), F.md5(snippet("text")).alias("snippet"))


@register(r"""SELECT page_id, count(*) AS n, count(DISTINCT link) AS n_distinct, min(link) AS first FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS link FROM pages) GROUP BY 1""")
def page_link_extract(spark, sf_dir):
    links = table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("link"))
    return links.groupBy("page_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("link").alias("n_distinct"), F.min("link").alias("first"))


#: Questions in the query's own words, one for each kind and a mixed one.
QUESTIONS = [
    (1, "who calls `parse_config` and what depends on it?"),
    (2, "how did load_settings change since v1.2"),
    (3, "parseConfig readFile()"),
    (4, "count pairs of integers; then print the answer and also sort the array"),
    (5, "recursive dfs with memoization over nested loops"),
    (6, "Find the city.\n-----Input-----\nAt most 5 roads.\n-----Output-----\nPrint the cost."),
    (7, "callers of the renamed handler before commit 1a2b3c4"),
    (8, ""),
]


def _questions(spark):
    return spark.createDataFrame(QUESTIONS, "qid long, text string")


def _all(spark, sf_dir):
    return _questions(spark).union(table(spark, sf_dir, "benchmark").select(F.col("item_id") + 100, "text"))


def _sql_list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _sql_features() -> str:
    rows = ", ".join(f"(CAST({i} AS BIGINT), '" + t.replace("'", "''").replace("\n", "' || chr(10) || '") + "')" for i, t in QUESTIONS)
    names = " || ".join(f"regexp_extract_all(text, '{p}', 1)" for p in (query.BACKTICK, query.CALLED, *query.NAMES))
    phrase = lambda listed: f"len(list_filter({_sql_list(listed)}, lambda p: regexp_matches(lower(text), '\\b' || p || '\\b')))"
    section = r"(?i)-{3,}\s*(input|output|examples?|note|constraints)\s*-{3,}"
    return f"""q AS (SELECT * FROM (VALUES {rows}) t(qid, text) UNION ALL SELECT item_id + 100, text FROM benchmark),
    a AS (SELECT qid, text, list_transform(regexp_extract_all(text, '[A-Za-z]+'), lambda x: lower(x)) AS words, list_distinct(list_filter({names}, lambda n: NOT regexp_full_match(n, '[\\d.]+'))) AS ids,
          list_distinct(regexp_extract_all(text, '{query.TAG}', 1) || regexp_extract_all(lower(text), '{query.SHA}', 1)) AS refs, list_transform(regexp_extract_all(text, '{section}', 1), lambda x: lower(x)) AS sec FROM q),
    f AS (SELECT qid, ln(1 + greatest(len(words), 1)) AS log_len, CAST(len(ids) AS DOUBLE) AS n_identifiers, len(ids) / CAST(greatest(len(words), 1) AS DOUBLE) AS identifier_ratio,
          CAST(len(CASE WHEN len(refs) > 0 THEN refs ELSE list_filter(regexp_extract_all(text, '{query.SEMVER}', 1), lambda v: contains(v, 'v')) END) AS DOUBLE) AS n_version_refs,
          CAST({phrase(query.DEPENDENCY_PHRASES)} AS DOUBLE) AS n_dependency_cues, CAST({phrase(query.EVOLUTION_PHRASES)} AS DOUBLE) AS n_evolution_cues,
          CAST(len(list_distinct(list_filter(words, lambda w: list_contains({_sql_list(query.STRUCTURAL_CUES)}, w)))) AS DOUBLE) AS n_structural_cues,
          CAST(len(list_distinct(list_filter(list_transform(words, lambda w: {_sql_stem()}), lambda w: list_contains({_sql_list(query.ACTIONS)}, w)))) AS DOUBLE) AS n_actions,
          CASE WHEN list_contains(sec, 'input') OR list_contains(sec, 'output') THEN 1e0 ELSE 0e0 END AS has_io_sections,
          CASE WHEN regexp_matches(lower(text), '^\\s*(how|what|where|which|who|why|when)\\b') THEN 1e0 ELSE 0e0 END AS is_question FROM a)"""


def _sql_stem() -> str:
    known, actions = _sql_list(query.ACTIONS + query.ENTITIES), _sql_list(query.ACTIONS)
    out = "CASE"
    for ending in ("ing", "ed", "es", "s"):
        n = len(ending)
        base = f"substr(w, 1, len(w) - {n})"
        fits = f"suffix(w, '{ending}') AND len(w) - {n} >= 3"
        out += f" WHEN {fits} AND list_contains({known}, {base}) THEN {base}"
        if ending == "ed":
            out += f" WHEN {fits} AND list_contains({actions}, {base} || 'e') THEN {base} || 'e'"
    return out + " ELSE w END"


NUMBERS = ["log_len", "n_identifiers", "identifier_ratio", "n_version_refs", "n_dependency_cues", "n_evolution_cues", "n_structural_cues", "n_actions", "has_io_sections", "is_question"]
FEATURES = _sql_features()


@register(f"WITH {FEATURES} SELECT qid, {', '.join(f'round({c}, 6) AS {c}' for c in NUMBERS)} FROM f")
def query_features(spark, sf_dir):
    return query.parse(_all(spark, sf_dir)).select("qid", *[six(c) for c in NUMBERS])


TYPED = f"""{FEATURES}, s AS (SELECT *, 3 * identifier_ratio + CASE WHEN log_len < 26e-1 AND n_identifiers > 0 THEN 8e-1 ELSE 0e0 END AS lexical, 1 + 2e-1 * n_actions AS semantic, 7e-1 * n_structural_cues + 5e-1 * has_io_sections AS structural,
    25e-1 * n_dependency_cues AS dependency, 15e-1 * n_version_refs + 12e-1 * n_evolution_cues AS evolutionary FROM f),
    e AS (SELECT *, exp(lexical) + exp(semantic) + exp(structural) + exp(dependency) + exp(evolutionary) AS total FROM s),
    p AS (SELECT qid, log_len, identifier_ratio, has_io_sections, {", ".join(f"exp({t}) / total AS p_{t}" for t in query.TYPES)}, {" + ".join(f"CAST({t} >= 1 AS INT)" for t in query.TYPES if t != "semantic")} AS strong FROM e),
    o AS (SELECT *, list_reverse_sort([{", ".join(f"p_{t}" for t in query.TYPES)}]) AS l FROM p)"""


@register(f"""WITH {TYPED} SELECT qid, {', '.join(f'round(p_{t}, 6) AS p_{t}' for t in query.TYPES)}, CASE WHEN strong >= 2 AND l[1] - l[2] < 25e-2 THEN 'mixed' {' '.join(f"WHEN abs(p_{t} - l[1]) < 1e-12 THEN '{t}'" for t in query.TYPES)} END AS query_type FROM o""")
def query_type_softmax(spark, sf_dir):
    return query.classify(query.parse(_all(spark, sf_dir))).select("qid", *[six(f"p_{t}") for t in query.TYPES], "query_type")


VIEWS = ["lexical", "semantic", "structural"]


def _sql_weight(view: str) -> str:
    parts = [f"p_{t} * {w!r}e0" for t, each in query.TYPE_PRIORS.items() for v, w in each.items() if v == view and t in query.TYPES]
    extra = {"lexical": "4e-1 * identifier_ratio", "semantic": f"CASE WHEN log_len > {math.log(60)!r} THEN 1e-1 ELSE 0e0 END", "structural": "CASE WHEN has_io_sections > 0 THEN 5e-2 ELSE 0e0 END"}
    return " + ".join([*parts, extra[view]])


@register(f"WITH {TYPED}, w AS (SELECT qid, {', '.join(f'{_sql_weight(v)} AS {v}' for v in VIEWS)} FROM p) SELECT qid, unnest(['{chr(39).join(['lexical', ', ', 'semantic', ', ', 'structural'])}']) AS view, round(unnest([{', '.join(VIEWS)}]) / ({' + '.join(VIEWS)}), 6) AS weight FROM w")
def rule_weights(spark, sf_dir):
    out = query.rule_weights(query.classify(query.parse(_all(spark, sf_dir))), VIEWS)
    return out.select("qid", "view", six("weight"))


def _sql_asked() -> str:
    return FEATURES.split(",\n    a AS (")[0]


def _decompose_sql() -> str:
    """Whole queries; sections of those with input or output; clauses and names of the others.  Conditions are sentences."""
    q = lambda p: p.replace("'", "''")
    section, names = query.SECTION, " || ".join(f"regexp_extract_all(text, '{p}', 1)" for p in (query.BACKTICK, query.CALLED, *query.NAMES))
    strip = lambda c: f"regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"
    part = lambda n: strip(f"array_to_string(list_transform(list_filter(list_zip(sec, bodies[2:]), lambda z: z[1] = '{n}'), lambda z: z[2]), chr(10))")
    words = lambda c: f"len(list_filter(regexp_split_to_array({c}, '\\s+'), lambda w: w <> ''))"
    row = lambda cond, what, facet, order: f"SELECT qid, {order} AS o, 0 AS i, {what} AS text, '{facet}' AS facet FROM d WHERE {cond}"
    return f"""{_sql_asked()}, a AS (SELECT qid, text, regexp_split_to_array(text, '{q(section)}') AS bodies, list_transform(regexp_extract_all(text, '{q(section)}', 1), lambda x: lower(x)) AS sec,
      list_filter({names}, lambda n: NOT regexp_full_match(n, '[\\d.]+')) AS all_ids,
      list_transform(list_filter(regexp_split_to_array(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(10), 'g'), '\n'), lambda s: regexp_matches(s, '{q(query.CONSTRAINT)}') OR regexp_matches(s, '{q(query.CONDITION)}')), lambda s: trim(s)) AS conds FROM q),
    b AS (SELECT *, list_filter(all_ids, lambda x, i: list_position(all_ids, x) = i) AS ids, list_filter(conds, lambda x, i: list_position(conds, x) = i)[1:20] AS cs, list_filter(regexp_split_to_array(text, '{q(query.CLAUSE)}'), lambda c: {words("c")} >= 3) AS clauses FROM a),
    d AS (SELECT *, list_contains(sec, 'input') OR list_contains(sec, 'output') AS io, {strip("bodies[1]")} AS statement, {part("input")} AS inp, {part("output")} AS outp, array_to_string(list_filter(cs, lambda c: len(c) < 300), ' ') AS cond FROM b),
    r AS ({row("true", "text", "full", 0)} UNION ALL {row("io AND statement <> '' AND statement <> text", "statement", "core", 1)} UNION ALL {row("io AND inp <> ''", "inp", "input", 2)} UNION ALL {row("io AND outp <> ''", "outp", "output", 3)}
      UNION ALL {row("io AND cond <> ''", "cond", "constraints", 4)} UNION ALL SELECT qid, 5, unnest(range(len(clauses))), unnest(clauses), 'clause' FROM d WHERE NOT io AND len(clauses) > 1
      UNION ALL {row(f"NOT io AND len(ids) > 0 AND {words('text')} > len(ids) * 3", "array_to_string(ids, ' ')", "identifier", 6)})
    SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY o, i) - 1 AS sub, text, facet, CASE facet {" ".join(f"WHEN '{f}' THEN {w!r}e0" for f, w in query.FACETS.items())} END AS weight FROM r"""


@register("WITH " + _decompose_sql())
def query_decompose(spark, sf_dir):
    """The sub-queries of all passages and of questions of every shape."""
    return query.decompose(query.parse(_all(spark, sf_dir)))


@register(f"""WITH {_sql_asked()}, t AS (SELECT qid, lower(text) AS low, regexp_matches(text, '{graph.INCOMING}') AS inward, regexp_matches(regexp_replace(text, '{graph.INCOMING}', ' ', 'g'), '{graph.OUTGOING}') AS outward FROM q)
SELECT qid, CASE WHEN inward AND NOT outward THEN 'in' WHEN outward AND NOT inward THEN 'out' ELSE 'both' END AS direction,
       CASE WHEN contains(low, 'import') THEN 'imports' WHEN contains(low, 'inherit') OR contains(low, 'subclass') THEN 'inherits' WHEN contains(low, 'call') OR contains(low, 'invok') THEN 'calls' ELSE 'all' END AS kinds FROM t""")
def query_direction_kinds(spark, sf_dir):
    kinds = graph.kinds_for(F.col("text"))
    return _all(spark, sf_dir).select("qid", graph.direction_for(F.col("text")).alias("direction"), F.when(F.size(kinds) == len(graph.EDGE_WEIGHTS), "all").otherwise(F.array_join(kinds, ",")).alias("kinds"))


@register(r"""SELECT doc_id, md5(regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')), '^$', '')) AS key FROM documents""")
def query_key_normal_space(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(normal_space("text")).alias("key"))
