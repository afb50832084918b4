"""Chat formatting."""

import json
import random

import pytest
from llm_helpers import CLASHES

from lexigraf.llm import chat

MESSAGES = "conv_id long, turn long, role string, text string"


def canonical(value):
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def loads(text):
    try:
        return json.loads(text)
    except (TypeError, ValueError):
        return None


def named(c):
    inner = c.get("function") if isinstance(c.get("function"), dict) else {}
    return c.get("name") or inner.get("name")


def listed(body, key):
    got = (body or {}).get(key)
    return got if isinstance(got, list) and got and all(isinstance(c, dict) and named(c) for c in got) else []


def unpacked(call):
    """The call with its arguments as JSON, and these."""
    call = json.loads(json.dumps(call))
    places = [call] + ([call["function"]] if isinstance(call.get("function"), dict) else [])
    for p in places:
        if isinstance(p.get("arguments"), str) and loads(p["arguments"]) is not None:
            p["arguments"] = loads(p["arguments"])
    return call, next((p["arguments"] for p in places if "arguments" in p), {})


KINDS = {"string": str, "integer": int, "number": (int, float), "boolean": bool, "array": list, "object": dict}


def fits(arguments, schema):
    if not isinstance(arguments, dict):
        return False
    if any(k not in arguments for k in schema["required"]):
        return False
    for k, v in arguments.items():
        if k not in schema["properties"]:
            if not schema["open"]:
                return False
        elif isinstance(v, bool) != (schema["properties"][k] == "boolean") or not isinstance(v, KINDS[schema["properties"][k]]):
            return False
    return True


def brute(rows, schemas=None):
    """(conv, turn, position, status, n_calls, n_valid, n_answered, call_id, json) by plain Python, conversation by conversation."""
    out = []
    for conv in {r[0] for r in rows}:
        mine = []
        for _, turn, role, text in (r for r in rows if r[0] == conv):
            body = loads(text) if (text or "").lstrip().startswith("{") else None
            body = body if isinstance(body, dict) and body.get("role") in (None, role) else None
            call_id = body.get("tool_call_id") if role == "tool" and body else None
            calls = listed(body, "tool_calls") if role != "tool" or call_id is not None else []
            tools = listed(body, "tools")
            if call_id is not None or calls or tools:
                whole = {**body, **({"role": role} if role is not None else {})}
                if calls:
                    whole["tool_calls"] = [unpacked(c)[0] for c in calls]
                shown = canonical(whole)
            else:
                shown = canonical({k: v for k, v in (("content", text), ("role", role)) if v is not None})
            mine.append({"turn": turn, "role": role, "id": call_id, "calls": calls, "tools": tools, "json": shown})
        own = {}
        for m in sorted(mine, key=lambda m: m["turn"]):
            for t in m["tools"]:
                p = t.get("parameters") or t.get("function", {}).get("parameters") or {}
                own.setdefault(named(t), {"properties": {k: v.get("type") for k, v in p.get("properties", {}).items()}, "required": p.get("required", []), "open": p.get("additionalProperties", True)})
        given = {t: {"properties": s.get("properties", {}), "required": s.get("required", []), "open": s.get("additionalProperties", False)} for t, s in (schemas or {}).items()}
        known = {**given, **own}
        first = {}
        for m in sorted(mine, key=lambda m: m["turn"]):
            for c in m["calls"]:
                if c.get("id") is not None:
                    first.setdefault(c["id"], m)
        for m in mine:
            m["to"] = first.get(m["id"]) if m["id"] is not None else None
        for m in mine:
            chain, at = [m], m["to"]
            while at is not None and not any(at is x for x in chain):
                chain.append(at)
                at = at["to"]
            circle = at is not None
            m["at"], m["depth"] = (m["turn"], 0) if circle else (max(x["turn"] for x in chain), len(chain) - 1)
        for k, m in enumerate(sorted(mine, key=lambda m: (m["at"], m["depth"], m["turn"], m["json"]))):
            valid = 0
            for c in m["calls"]:
                arguments = unpacked(c)[1]
                if c.get("id") is not None and isinstance(arguments, dict):
                    name = named(c)
                    valid += fits(arguments, known[name]) if name in known else not (own or schemas)
            answered = len({x["id"] for x in mine if x["to"] is m})
            status = "linked" if m["to"] else "orphan" if m["id"] is not None else "calls" if m["calls"] else "tools" if m["tools"] else "plain"
            out.append((conv, m["turn"], k, m["role"], status, len(m["calls"]), valid, answered, m["id"], m["json"]))
    return sorted(map(repr, out))


def got(spark, rows, schemas=None, **how):
    return sorted(repr(tuple(r)) for r in chat.format_chats(spark.createDataFrame(rows, MESSAGES), schemas, **how).collect())


SCHEMAS = {"f": {"properties": {"z": "integer", "b": "object"}, "required": ["z"]}, "g": {"properties": {"q": "number"}, "additionalProperties": True}}


def conversation(rng, conv, size):
    """Messages with calls of both shapes, results before and after them, results that call, broken JSON and definitions."""
    ids = [f"c{i}" for i in range(size // 2 + 1)]
    turns = rng.sample(range(size * 3), size)
    out = []
    for turn in turns:
        kind = rng.randrange(9)
        arguments = rng.choice([{"z": 1, "b": {"y": 2, "a": [1, "é"]}}, {"z": "no"}, {"q": 2.5}, {"q": 1, "more": None}, {}, {"z": 3, "x": 1}])
        arguments = rng.choice([arguments, json.dumps(arguments), "{broken", None, [1]])
        call = {"id": rng.choice(ids), "name": rng.choice("fgh"), "arguments": arguments, "note": "kept"}
        if rng.random() < 0.4:
            call = {"id": call["id"], "type": "function", "function": {"name": call["name"], "arguments": arguments}}
        if rng.random() < 0.15:
            del call["id"]
        if arguments is None:
            (call.get("function") or call).pop("arguments")
        if kind < 3:
            out.append((conv, turn, "assistant", json.dumps({"tool_calls": [call] + [{**call, "id": rng.choice(ids)}] * (kind == 1), "content": rng.choice(["x", None, {"b": 1, "a": 2}]), "more": [1]}, ensure_ascii=False)))
        elif kind < 6:
            body = {"tool_call_id": rng.choice(ids + ["zz"]), "content": {"k": [turn, True]}}
            if kind == 5:
                body["tool_calls"] = [call]
            out.append((conv, turn, "tool", json.dumps(body)))
        elif kind == 6:
            out.append((conv, turn, "system", json.dumps({"tools": [{"name": "f", "parameters": {"type": "object", "properties": {"z": {"type": "integer"}, "b": {"type": "object"}}, "required": ["z"], "additionalProperties": False}}]})))
        else:
            out.append((conv, turn, rng.choice(["user", "tool", None]), rng.choice(["hi", "{no json", '{"a": 1}', '{"role": "other", "tool_calls": [{"name": "f"}]}', '{"tool_calls": [{"id": "c0"}]}', None, "", "[1]"])))
    return out


@pytest.mark.parametrize("schemas", [None, SCHEMAS])
def test_random_conversations_against_brute_force(spark, schemas):
    rng = random.Random(12)
    rows = [m for conv in range(40) for m in conversation(rng, conv, rng.randrange(1, 14))]
    want = brute(rows, schemas)
    assert got(spark, rows, schemas) == want
    assert all(any(f"'{s}'" in r for r in want) for s in ("linked", "orphan", "calls", "tools", "plain"))


def test_chains_circles_and_nothing_lost(spark):
    say = lambda **x: json.dumps(x)
    rows = [
        (1, 9, "assistant", say(tool_calls=[{"id": "a", "name": "f", "arguments": "{bad"}, {"name": "g"}])),
        (1, 1, "tool", say(tool_call_id="a", tool_calls=[{"id": "b", "name": "f"}])),
        (1, 2, "tool", say(tool_call_id="b", content=1, extra={"z": 1, "a": 2})),
        (2, 1, "tool", say(tool_call_id="x", tool_calls=[{"id": "y", "name": "f"}])),
        (2, 2, "tool", say(tool_call_id="y", tool_calls=[{"id": "x", "name": "f"}])),
        (2, 3, "user", None),
    ]
    assert got(spark, rows) == brute(rows)
    found = {(r["conv_id"], r["position"]): r for r in chat.format_chats(spark.createDataFrame(rows, MESSAGES)).collect()}
    assert [found[1, i]["turn"] for i in range(3)] == [9, 1, 2] and [found[2, i]["turn"] for i in range(3)] == [1, 2, 3]
    assert (found[1, 0]["n_calls"], found[1, 0]["n_valid"]) == (2, 0) and '"arguments":"{bad"' in found[1, 0]["json"]
    assert found[1, 2]["json"] == '{"content":1,"extra":{"a":2,"z":1},"role":"tool","tool_call_id":"b"}'


def test_awkward_tables(spark):
    rows = [(None, 0, None, None), (2, 0, "assistant", '{"tool_calls":[]}'), (2, 0, "assistant", '{"tool_calls":[]}'), (2, 0, "user", "b"), (2, 0, "user", "a"), (3, 1, "user", "long " * 100_000), (3, 0, "tool", '{"tool_call_id":"q","content":"' + "x" * 300_000 + '"}'), (4, None, "user", "no turn")]
    plain = [r for r in rows if r[1] is not None]
    assert got(spark, plain) == brute(plain)
    assert len(got(spark, rows)) == len(rows)
    frame = spark.createDataFrame(plain, MESSAGES)
    clash = frame
    for c in [*CLASHES, "_m", "_at", "_depth", "calls", "tools", "body", "fields", "json", "valid", "id", "name", "_to"]:
        clash = clash.withColumn(c, frame["turn"])
    assert sorted(repr(tuple(r)) for r in chat.format_chats(clash).collect()) == brute(plain)
    assert chat.format_chats(spark.createDataFrame([], MESSAGES)).count() == 0


def test_sql_reads_the_json_too(spark, tmp_path):
    """The SQL of the query gives the same as the operator on conversations with links, but for canonical JSON."""
    import duckdb

    rng = random.Random(3)
    rows = [m for conv in range(30) for m in conversation(rng, conv, rng.randrange(1, 10)) if '"tools"' not in (m[3] or "") and not (m[2] == "tool" and "tool_calls" in (m[3] or ""))]
    frame = spark.createDataFrame(rows, MESSAGES)
    frame.write.parquet(f"file://{tmp_path}/conversations")
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from read_parquet('{tmp_path}/conversations/*.parquet')")
    got_ = con.execute(f"select conv_id, turn, position, role, status, n_calls, n_valid, n_answered, call_id from ({chat.OP6_SQL})").fetchall()
    want = chat.format_chats(frame).drop("json").collect()
    assert sorted(map(repr, got_)) == sorted(repr(tuple(r)) for r in want)
