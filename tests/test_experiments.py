"""Experiments over a small judged collection, their ladder, and the evaluation commands."""

import json

import pytest

from lexigraf import config, eval_cli, experiments, render, tools
from lexigraf.operators.evaluation import SplitGuardError

DOCS = {f"d{i}": f"def f{i}(x):\n    return {w}(x)" for i, w in enumerate(["sorted", "parse_config", "read_socket", "shuffle", "input", "heappush", "merge", "union", "rotate", "encode"])}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at = tmp_path_factory.mktemp("data")
    write = lambda name, rows: (at / name).write_text("".join(json.dumps(r) + "\n" for r in rows))
    write("corpus.jsonl", [{"id": k, "title": "", "text": v} for k, v in DOCS.items()])
    words = [v.split("return ")[1].split("(")[0] for v in DOCS.values()]
    write("queries.jsonl", [{"qid": f"q{i}", "text": f"please {w.replace('_', ' ')} it", "split": "test" if i == 9 else "train"} for i, w in enumerate(words)])
    write("qrels.jsonl", [{"qid": f"q{i}", "doc_id": f"d{i}", "rel": 1} for i in range(10)])
    (at / "revision.txt").write_text("r7\n")
    return at


def test_splits(spark, folder):
    data = experiments.read_collection(spark, f"file://{folder}")
    ids = lambda name, **how: {r["qid"] for r in data.split(name, **how)[0].collect()}
    fit, dev = ids("fit"), ids("dev")
    assert len(dev) == 1 and fit | dev == {f"q{i}" for i in range(9)} and not fit & dev and ids("dev_stdin") <= dev and data.revision == "r7"
    assert dev == ids("dev") and data.split("fit")[1].count() == 8
    with pytest.raises(SplitGuardError):
        data.split("test")
    assert ids("test", final=True) == {"q9"}


def test_ladder(spark, folder, tmp_path):
    data, out = experiments.read_collection(spark, f"file://{folder}"), str(tmp_path / "out")
    (tmp_path / "plain.json").write_text('{"name": "plain", "stem": false}')
    (tmp_path / "ladder.json").write_text(json.dumps({"splits": ["fit"], "ladder": [{"label": "BM25", "config": "plain.json"}, {"label": "stems", "config": "plain.json", "overrides": ["stem=true", "name=stems"]}, {"label": "far", "config": "plain.json", "overrides": ["name=far"], "service": True}], "not_run": [{"label": "GPU", "reason": "none here"}]}))
    ladder, ran = experiments.Ladder.load(str(tmp_path / "ladder.json")), []

    def one(settings, split):
        ran.append(settings.name)
        return experiments.run_experiment(spark, settings, data, out, split)

    got = experiments.climb(ladder, one, out, without_services=True)
    assert ran == ["plain", "stems"] and got["far", "fit"] == "left out (service)"
    result = got["BM25", "fit"]
    assert result["metrics"]["recall_100"] == 1.0 and result["metrics"]["latency_p50_ms"] > 0
    assert result["meta"]["config_hash"] == ladder.rungs[0].settings.digest() and result["meta"]["dataset_revision"] == "r7" and result["meta"]["n_queries"] == 8
    again = experiments.climb(ladder, one, out, without_services=True)
    assert ran == ["plain", "stems"] and again["BM25", "fit"]["metrics"] == result["metrics"]  # from the files
    text = experiments.rendered(ladder, again)
    assert "| stems |" in text and "(+0.0000)" in text and "| GPU | n/a |" in text and "left out (service)" in text
    # the run file gives the same scores
    run = eval_cli.parser().parse_args(["crosscheck", "--data", f"file://{folder}", "--split", "fit", "--out", f"file://{out}", "--run", f"file://{out}/plain__fit.trec", "--name", "plain"])
    assert "True" in eval_cli.crosscheck(spark, run)
    table = eval_cli.parser().parse_args(["table", "--out", f"file://{out}", "--base", "plain"])
    assert "plain" in eval_cli.table(spark, table)


def test_run_search_and_restriction(spark, folder):
    data = experiments.read_collection(spark, f"file://{folder}")
    queries, qrels = data.split("fit")
    pipe = experiments.Pipeline(config.Settings(stem=False), experiments.runs.corpus_chunks(data.corpus))
    whole, times = experiments.run_search(pipe.search, queries, 5, batch=3)
    assert times.count() == 8 and {r["qid"] for r in whole.collect()} == {r["qid"] for r in queries.collect()}
    some = qrels.filter("qid <> 'q0'").select("qid", "doc_id")
    found = experiments.restricted(pipe.search, some)(queries, 1)
    assert {(r["qid"], r["chunk_hash"]) for r in found.collect()} == {(r["qid"], r["doc_id"]) for r in some.collect()}


def test_questions(tmp_path):
    class Typed(list):
        def isatty(self):
            return True

    (tmp_path / "q").write_text("from a file")
    assert eval_cli.question("given", None, []) == "given" and eval_cli.question(None, str(tmp_path / "q"), []) == "from a file"
    assert eval_cli.question(None, None, Typed(["one\n", "two\n", ".\n", "three\n"])) == "one\ntwo\n"
    assert set(eval_cli.COMMANDS) >= {"run", "sweep", "table", "crosscheck", "ablate", "ask", "submit"} and len(eval_cli.COMMANDS) == 13


def test_tools_answer_requests(monkeypatch):
    import io

    monkeypatch.setattr(tools.service, "find_symbol", lambda store, name, version: [{"symbol_id": f"m::{name}", "text": "x" * 5000, "version": version}])
    server = tools.Server(lambda: None)
    ask = lambda i, method, **params: json.dumps({"jsonrpc": "2.0", "id": i, "method": method, "params": params})
    lines = [
        ask(1, "initialize"), ask(2, "tools/list"), ask(3, "tools/call", name="find_symbol", arguments={"name": "f"}), ask(4, "tools/call", name="search_code", arguments={"query": "x", "limit": 99}),
        ask(5, "tools/call", name="nothing"), json.dumps({"jsonrpc": "2.0", "method": "notifications/initialized"}), "{broken", ask(6, "tools/call", name="find_dependencies", arguments={"name": "f", "direction": "up"}), ask(7, "tools/call", name="find_symbol", arguments={}),
    ]
    out = io.StringIO()
    server.serve(io.StringIO("\n".join(lines) + "\n"), out)
    got = [json.loads(x) for x in out.getvalue().splitlines()]
    assert [r["id"] for r in got] == [1, 2, 3, 4, 5, None, 6, 7]
    assert [t["name"] for t in got[1]["result"]["tools"]] == ["search_code", "search_at_version", "search_history", "find_symbol", "find_dependencies", "compare_versions", "index_repository"]
    found = json.loads(got[2]["result"]["content"][0]["text"])[0]
    assert found["symbol_id"] == "m::f" and len(found["text"]) == 4000 and found["version"] == "HEAD"
    assert got[3]["result"]["isError"] and "limit" in got[3]["result"]["content"][0]["text"] and got[4]["error"]["code"] == -32601
    assert got[6]["result"]["isError"] and "direction" in got[6]["result"]["content"][0]["text"] and "needs name" in got[7]["result"]["content"][0]["text"]


def test_renderers():
    row = {"path": "a.py", "start_line": 1, "end_line": 2, "symbol": "f", "score": 0.5, "snippet": "def f():\n    pass", "versions": ["1234567890"]}
    assert render.search([row]).splitlines() == ["1. a.py:1-2  f  0.5000  [1234567]", "     def f():", "         pass"] and render.search([]) == "nothing found"
    assert render.dependencies([{"symbols": ["a", "b"], "kinds": ["calls"], "score": 1.0}]) == "1.000  a -calls-> b"
    got = {"from": "1" * 40, "to": "2" * 40, "summary": {"renamed": 1}, "symbols": [{"change": "renamed", "old": "m::a", "new": "m::b", "similarity": 0.5, "diff": "-x\n"}], "edges": [{"change": "added", "src": "a", "dst": "b", "kind": "calls"}], "commits": [{"commit": "3" * 40, "subject": "s", "symbols": ["m::b"]}]}
    assert render.comparison(got).splitlines() == ["1111111..2222222  1 renamed", "renamed: m::b (was m::a, 0.50)", "    -x", "+ a -calls-> b", "3333333 s: m::b"]
