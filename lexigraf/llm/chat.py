"""Chat formatting: tool calls linked to their results, ordered, checked and serialised.

Shapes of a message's text, if it is a JSON object (keys of any order, other fields too):

- it calls tools if its role isn't ``tool`` or it is a result too, and ``tool_calls`` is a
  list of objects, each with a name and arguments of its own or under ``function``;
- it is a result if its role is ``tool`` and it has ``tool_call_id``;
- it defines tools if ``tools`` is a list of objects with a name and ``parameters`` (a JSON
  schema: properties with types, required, additionalProperties), or that under ``function``.

Everything else is plain: text of another shape or that isn't JSON, and objects whose own
``role`` differs from the column's.

Calls and results are hash-joined by (conversation, identifier).  Of calls with the same
identifier in a conversation the first answers for it.  A result that is a call as well
makes chains, so the order is topological over the whole forest: every message stands at
the latest turn among itself and all it follows, then by its depth, then by its turn.
Depths come from pointer doubling, a join for each doubling of the longest chain.  In a
circle there is no such order; its members keep their turns.  Positions count from 0
without gaps.

A call is valid if it has an identifier and its arguments are an object (or a string that
holds one; none count as an empty object) with all required parameters, each of the stated
type, and no other parameter where the schema forbids them.  Schemas are those that the
conversation defines (of several with a name the first), else those given.  Where any
are known, a tool without one is invalid; where none are, any object is valid.

Messages become canonical JSON: keys sorted at every level (variants keep them so), no
white space, numbers in one form, arguments that are JSON in a string as that JSON.
Nothing else is changed or left out: other fields stay, arguments that can't be parsed stay
as the string, and calls without an identifier stay, unlinked and invalid.

Only DataFrame operations are used, and a conversation of any size spreads over tasks.
Null texts leave out the content; null roles and conversations are values like others.
Results without a call are ``orphan`` and keep their turn.  Repeated rows get positions of
their own.  An empty table gives an empty result; other columns don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import prepare, ranks, store, table

#: What ``schema_of_variant`` calls the JSON types of a schema.
TYPES = {
    "string": "STRING",
    "integer": "BIGINT|DECIMAL\\(\\d+,\\s*0\\)",
    "number": "BIGINT|DOUBLE|FLOAT|DECIMAL.*",
    "boolean": "BOOLEAN",
    "array": "ARRAY.*",
    "object": "OBJECT.*",
    "null": "VOID",
}
DEFINED = "tool string, properties map<string,string>, required array<string>, open boolean"


def _get(v: Column, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(v, path, kind)


def _is_object(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))


def _parsed(arguments: Column) -> Column:
    """Arguments, those in a string as the JSON that it holds if it does."""
    held = F.try_parse_json(_get(arguments, "$", "string"))
    return F.when(F.schema_of_variant(arguments) == "STRING", F.coalesce(held, arguments)).otherwise(arguments)


def _fields(v: Column) -> Column:
    return _get(v, "$", "map<string,variant>")


def _canonical(call: Column) -> Column:
    """A call with its arguments parsed, whichever of the two shapes it has."""
    inner = lambda v: F.to_variant_object(F.transform_values(_fields(v), lambda k, x: F.when(k == "arguments", _parsed(x)).otherwise(x)))
    return F.to_variant_object(F.transform_values(_fields(call), lambda k, x: F.when(k == "arguments", _parsed(x)).when((k == "function") & _is_object(x), inner(x)).otherwise(x)))


def _name(call: Column) -> Column:
    return F.coalesce(_get(call, "$.name", "string"), _get(call, "$.function.name", "string"))


def _listed(body: Column, path: str) -> Column:
    """The objects with a name in a list of nothing else, or null."""
    found = _get(body, path, "array<variant>")
    return F.when((F.size(found) > 0) & F.forall(found, lambda c: _is_object(c) & _name(c).isNotNull()), found)


def _defined(tools: DataFrame) -> DataFrame:
    """(conv_id, turn, tool, properties, required, open) of definitions (conv_id, turn, tool), the last a variant."""
    of = F.coalesce(_get(F.col("tool"), "$.parameters"), _get(F.col("tool"), "$.function.parameters"))
    kinds = F.transform_values(_get(of, "$.properties", "map<string,variant>"), lambda k, p: _get(p, "$.type", "string"))
    return tools.select(
        "conv_id", "turn", _name(F.col("tool")).alias("tool"),
        F.coalesce(kinds, F.create_map().cast("map<string,string>")).alias("properties"),
        F.coalesce(_get(of, "$.required", "array<string>"), F.array().cast("array<string>")).alias("required"),
        F.coalesce(_get(of, "$.additionalProperties", "boolean"), F.lit(True)).alias("open"),
    )


def _fits(arguments: Column) -> Column:
    """Whether arguments (JSON or null) fit properties, required and open."""
    given = _fields(F.try_parse_json(F.coalesce(arguments, F.lit("{}"))))
    patterns = F.create_map(*[F.lit(x) for k, v in TYPES.items() for x in (k, f"^({v})$")])

    def entry(e: Column) -> Column:
        wanted = F.element_at(patterns, F.element_at("properties", e["key"]))
        typed = F.coalesce(F.rlike(F.schema_of_variant(e["value"]), wanted), F.lit(True))  # no type, or one that isn't known: any
        return F.when(F.map_contains_key("properties", e["key"]), typed).otherwise(F.col("open"))

    whole = (F.size(F.array_except("required", F.map_keys(given))) == 0) & F.forall(F.map_entries(given), entry)
    return F.coalesce(whole, F.lit(False))


def _valid(calls: DataFrame, defined: DataFrame, schemas: dict[str, dict] | None) -> DataFrame:
    """``calls`` with ``valid``."""
    spark = calls.sparkSession
    given = spark.createDataFrame(
        [(t, {k: str(v) for k, v in s.get("properties", {}).items()}, list(s.get("required", ())), bool(s.get("additionalProperties", False))) for t, s in (schemas or {}).items()], DEFINED
    ).withColumnsRenamed({c: f"_{c}" for c in ("properties", "required", "open")})
    own = defined.groupBy("conv_id", "tool").agg(F.min_by(F.struct("properties", "required", "open"), F.col("turn")).alias("own"))
    any_ = defined.select("conv_id").distinct()
    rows = calls.alias("c").join(own.alias("d"), F.expr("c.conv_id <=> d.conv_id and c.name = d.tool"), "left").select("c.*", "d.own")
    rows = rows.alias("c").join(any_.alias("a"), F.expr("c.conv_id <=> a.conv_id"), "left_semi").select("c.*", F.lit(True).alias("strict")).unionByName(
        rows.alias("c").join(any_.alias("a"), F.expr("c.conv_id <=> a.conv_id"), "left_anti").select("c.*", F.lit(bool(schemas)).alias("strict"))
    )
    rows = rows.join(given.withColumnRenamed("tool", "name"), "name", "left")  # the caller's schemas: Spark broadcasts few
    pick = lambda f: F.coalesce(F.col(f"own.{f}"), F.col(f"_{f}")).alias(f)
    rows = rows.select("_m", "conv_id", "id", "name", "arguments", "strict", *[pick(f) for f in ("properties", "required", "open")])
    is_object = _fields(F.try_parse_json(F.coalesce("arguments", F.lit("{}")))).isNotNull()
    fits = F.when(F.col("properties").isNotNull(), _fits(F.col("arguments"))).otherwise(~F.col("strict"))
    return rows.withColumn("valid", F.col("id").isNotNull() & is_object & fits)


def _placed(links: DataFrame) -> DataFrame:
    """(_m, _at, _depth) of what follows a call, from (_m, _to, _own, _at): its call, its own turn, the later of both turns."""
    now = store(links.select("_m", "_to", "_own", "_at", F.lit(1).cast("long").alias("_depth")), "links")
    for _ in range(now.count().bit_length() + 1):  # what is open after that many doublings stands in a circle
        p = now.select(F.col("_m").alias("pm"), F.col("_to").alias("pt"), F.col("_at").alias("pa"), F.col("_depth").alias("pd"))
        met = now.filter("_to is not null").join(p, F.col("_to") == F.col("pm"))
        if met.isEmpty():
            break
        now = store(
            now.join(p, F.col("_to") == F.col("pm"), "left").select(
                "_m", F.col("pt").alias("_to"), "_own", F.greatest("_at", "pa").alias("_at"), (F.col("_depth") + F.coalesce("pd", F.lit(0))).alias("_depth")
            ),
            "links",
        )
    else:
        circle = F.col("_to").isNotNull()
        return now.select("_m", F.when(circle, F.col("_own")).otherwise(F.col("_at")).alias("_at"), F.when(circle, 0).otherwise(F.col("_depth")).alias("_depth"))
    return now.select("_m", "_at", "_depth")


def format_chats(messages: DataFrame, schemas: dict[str, dict] | None = None, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per message: conv_id, turn, position, role, status, n_calls, n_valid, n_answered, call_id, json.

    schemas: by tool, {"properties": {parameter: type}, "required": [parameter], "additionalProperties": bool (false if not there)}."""
    base = messages.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    body = F.when(F.ltrim("text").startswith("{"), F.try_parse_json("text"))
    told = base.withColumn("body", body).withColumn("fields", _fields(F.col("body")))
    named = _get(F.col("body"), "$.role", "string")
    told = told.withColumn("body", F.when(F.col("fields").isNotNull() & (named.isNull() | named.eqNullSafe(F.col("role"))), F.col("body")))
    told = told.withColumns(
        {
            "call_id": F.when(F.col("role") == "tool", _get(F.col("body"), "$.tool_call_id", "string")),
            "calls": _listed(F.col("body"), "$.tool_calls"),
            "tools": _listed(F.col("body"), "$.tools"),
        }
    )
    told = told.withColumn("calls", F.when((F.col("role") == "tool") & F.col("call_id").isNull(), None).otherwise(F.col("calls")))
    rest = F.map_filter(F.transform_values("fields", lambda k, v: F.when((k == "tool_calls") & F.col("calls").isNotNull(), F.to_variant_object(F.transform("calls", _canonical))).otherwise(v)), lambda k, v: k != "role")
    said = F.map_filter(F.create_map(F.lit("role"), F.col("role").cast("variant")), lambda k, v: F.col("role").isNotNull())
    shaped = F.col("call_id").isNotNull() | F.col("calls").isNotNull() | F.col("tools").isNotNull()
    json = F.when(shaped, F.to_json(F.to_variant_object(F.map_concat(rest, said)))).otherwise(F.to_json(F.struct(F.col("text").alias("content"), "role")))
    arguments = lambda c: F.coalesce(_get(c, "$.arguments"), _get(c, "$.function.arguments"))
    listed = F.transform("calls", lambda c: F.struct(_get(c, "$.id", "string").alias("id"), _name(c).alias("name"), F.to_json(_parsed(arguments(c))).alias("arguments")))
    rows = store(
        told.select(
            F.monotonically_increasing_id().alias("_m"), "conv_id", "turn", "role", "call_id", json.alias("json"),
            F.coalesce(listed, F.array().cast("array<struct<id:string,name:string,arguments:string>>")).alias("calls"),
            F.coalesce(F.transform("tools", lambda t: F.to_json(t)), F.array().cast("array<string>")).alias("tools"),
        ),
        "chat",
    )
    calls = rows.filter(F.size("calls") > 0).select("_m", "conv_id", "turn", F.explode("calls").alias("c")).select("_m", "conv_id", "turn", "c.id", "c.name", "c.arguments")
    defined = _defined(rows.filter(F.size("tools") > 0).select("conv_id", "turn", F.explode("tools").alias("t")).select("conv_id", "turn", F.try_parse_json("t").alias("tool")))
    firsts = calls.filter("id is not null").groupBy("conv_id", "id").agg(F.min(F.struct("turn", "_m")).alias("first"))
    results = rows.filter("call_id is not null").select("_m", "conv_id", F.col("turn").alias("_own"), F.col("call_id").alias("id"))
    met = firsts.alias("f").join(results.alias("r").hint("shuffle_hash"), F.expr("f.conv_id <=> r.conv_id and f.id = r.id")).select("r._m", "r._own", "r.id", F.col("f.first._m").alias("_to"), F.col("f.first.turn").alias("_turn"))
    met = store(met.withColumn("_at", F.greatest("_own", "_turn")), "linked")
    placed = _placed(met)
    answered = met.groupBy(F.col("_to").alias("_m")).agg(F.count_distinct("id").alias("n_answered"))
    valid = _valid(calls, defined, schemas).filter("valid").groupBy("_m").agg(F.count(F.lit(1)).alias("n_valid"))
    out = rows.join(placed, "_m", "left").join(answered, "_m", "left").join(valid, "_m", "left")
    out = out.select(
        "conv_id", "turn", "role",
        F.when(F.col("_depth").isNotNull(), "linked").when(F.col("call_id").isNotNull(), "orphan").when(F.size("calls") > 0, "calls").when(F.size("tools") > 0, "tools").otherwise("plain").alias("status"),
        F.size("calls").cast("long").alias("n_calls"),
        F.coalesce("n_valid", F.lit(0)).cast("long").alias("n_valid"),
        F.coalesce("n_answered", F.lit(0)).cast("long").alias("n_answered"),
        "call_id", "json",
        F.coalesce("_at", "turn").alias("_at"),
        F.coalesce("_depth", F.lit(0)).alias("_depth"),
    )
    return ranks(out, ["conv_id"], ["_at", "_depth", "turn", "json"], "position").select(
        "conv_id", "turn", "position", "role", "status", "n_calls", "n_valid", "n_answered", "call_id", "json"
    )


def op6_chat_format(spark, sf_dir: str) -> DataFrame:
    """Every conversation; schemas are those that the conversations define."""
    prepare(spark)
    return format_chats(table(spark, sf_dir, "conversations"))


#: Calls, results, links, order and validity without schemas, read from the JSON.  DuckDB has no canonical form for nested
#: JSON, so messages of those shapes keep theirs there; chains of results that call are left to the tests.
OP6_SQL = """
WITH b AS (SELECT row_number() OVER () AS m, conv_id, turn, role, text, CASE WHEN ltrim(text) LIKE '{%' AND json_valid(text) THEN CAST(text AS JSON) END AS body FROM conversations),
f AS (SELECT *, CASE WHEN json_type(body, '$.role') IS NULL OR body ->> '$.role' IS NOT DISTINCT FROM role THEN body END AS o FROM b),
p AS (SELECT *, CASE WHEN role = 'tool' THEN o ->> '$.tool_call_id' END AS call_id,
      CASE WHEN role IS DISTINCT FROM 'tool' AND json_type(o, '$.tool_calls') = 'ARRAY' THEN CAST(o -> '$.tool_calls' AS JSON[]) ELSE [] END AS listed FROM f),
s AS (SELECT *, CASE WHEN len(list_filter(listed, lambda c: coalesce(c ->> '$.name', c ->> '$.function.name') IS NULL)) = 0 THEN listed ELSE [] END AS calls FROM p),
c AS (SELECT m, conv_id, turn, unnest(calls) AS c FROM s),
a AS (SELECT m, conv_id, turn, c ->> '$.id' AS id, coalesce(c -> '$.arguments', c -> '$.function.arguments', CAST('{}' AS JSON)) AS arguments FROM c),
v AS (SELECT m, count(*) AS n_valid FROM a WHERE id IS NOT NULL AND (json_type(arguments) = 'OBJECT' OR json_type(arguments) = 'VARCHAR' AND json_valid(arguments ->> '$') AND json_type(arguments ->> '$') = 'OBJECT') GROUP BY 1),
t AS (SELECT conv_id, id, min(turn) AS call_turn, min_by(m, struct_pack(turn := turn, m := m)) AS by_m FROM a WHERE id IS NOT NULL GROUP BY ALL),
l AS (SELECT s.*, t.call_turn, t.by_m FROM s LEFT JOIN t ON s.conv_id IS NOT DISTINCT FROM t.conv_id AND s.call_id = t.id),
w AS (SELECT by_m AS m, count(DISTINCT call_id) AS n_answered FROM l WHERE by_m IS NOT NULL GROUP BY 1),
j AS (SELECT l.*, CASE WHEN call_id IS NULL AND len(calls) = 0 THEN CAST(json_object('content', text, 'role', role) AS VARCHAR) ELSE CAST(o AS VARCHAR) END AS json FROM l)
SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY greatest(turn, coalesce(call_turn, turn)), by_m IS NOT NULL, turn, json) - 1 AS position, role,
       CASE WHEN by_m IS NOT NULL THEN 'linked' WHEN call_id IS NOT NULL THEN 'orphan' WHEN len(calls) > 0 THEN 'calls' ELSE 'plain' END AS status,
       CAST(len(calls) AS BIGINT) AS n_calls, coalesce(n_valid, 0) AS n_valid, coalesce(n_answered, 0) AS n_answered, call_id, json
FROM j LEFT JOIN v USING (m) LEFT JOIN w USING (m)
"""
