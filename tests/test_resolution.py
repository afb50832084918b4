"""References of source files and their edges, rule by rule."""

import pytest

from lexigraf.operators.resolution import resolve_edges
from lexigraf.sources import chunkers
from lexigraf.sources.references import references

DEFS, REFS = "commit_id string, path string, symbol string", "commit_id string, path string, symbol string, kind string, target string, local string, seq int"


def edges(spark, *commits):
    """Edges of file maps, one commit each, resolved together."""
    defs, refs = [], []
    for k, files in enumerate(commits):
        for path, text in files.items():
            found = chunkers.spans(path, text)
            defs += [(f"c{k}", path, s.symbol if s.kind != "file" else None) for s in found]
            refs += [(f"c{k}", path, *r, i) for i, r in enumerate(references(path, text, found))]
    rows = resolve_edges(spark.createDataFrame(defs, DEFS), spark.createDataFrame(refs, REFS)).collect()
    return [{(r["src"], r["dst"], r["kind"]) for r in rows if r["commit_id"] == f"c{k}"} for k in range(len(commits))]


PACKAGE = {
    "pkg/__init__.py": "",
    "pkg/io.py": "def read(path):\n    return open(path).read()\n",
    "pkg/conf.py": "import json\nfrom .io import read\n\n\ndef parse(path):\n    return json.loads(read(path))\n\n\nclass Box:\n    def get(self):\n        return self.get()\n",
    "app.py": "from pkg import conf\nfrom pkg.conf import Box as B\nimport pkg.io\nfrom pkg.io import *\n\n\nclass Base:\n    pass\n\n\nclass App(Base):\n    def run(self):\n        f = conf.parse\n        B.get(1)\n        pkg.io.read('x')\n        return conf.parse('a') or read('b') or missing()\n\n\ndef main():\n    return App().run()\n",
}


def test_python(spark):
    got, none, slim = edges(spark, PACKAGE, {"x.py": "y = 1\n"}, {**PACKAGE, "app.py": "from pkg.conf import parse\n\n\ndef run():\n    return parse('x')\n"})
    calls = {(a, b) for a, b, k in got if k == "calls"}
    assert calls == {
        ("pkg/conf.py::parse", "pkg/io.py::read"), ("app.py::App", "pkg/conf.py::parse"), ("app.py::App", "pkg/conf.py::Box"), ("app.py::App", "pkg/io.py::read"), ("app.py::main", "app.py::App"),
    }
    assert {(a, b) for a, b, k in got if k == "imports"} == {
        ("pkg/conf.py", "pkg/io.py::read"), ("app.py", "pkg/conf.py"), ("app.py", "pkg/conf.py::Box"), ("app.py", "pkg/io.py"),
    }
    assert {(a, b) for a, b, k in got if k == "inherits"} == {("app.py::App", "app.py::Base")}
    assert ("app.py::App", "app.py::Base", "references") in got and not any("json" in b for _, b, _ in got)
    assert none == set()
    assert ("app.py::run", "pkg/conf.py::parse", "calls") in slim and not any(a.startswith("app.py::App") for a, _, _ in slim)


def test_a_dotted_ending_of_many_files_names_none(spark):
    same = {f"{d}/util.py": "def f():\n    return 1\n" for d in "abcd"}
    use = "from util import f\n\n\ndef go():\n    return f()\n"
    many, three = edges(spark, {**same, "m.py": use}, {**{k: v for k, v in same.items() if k[0] != "d"}, "m.py": use})
    assert not {e for e in many if e[2] != "defines"}
    assert {b for _, b, k in three if k == "calls"} == {f"{d}/util.py::f" for d in "abc"}


def test_a_submodule_comes_before_a_name_and_the_last_import_counts(spark):
    files = {"p/__init__.py": "def sub():\n    return 0\n", "p/sub.py": "def f():\n    return 1\n", "q.py": "def f():\n    return 2\n", "m.py": "from p import sub\nfrom q import f\nfrom p.sub import f\n\n\ndef go():\n    return sub.f() + f()\n"}
    (got,) = edges(spark, files)
    assert {b for a, b, k in got if a == "m.py" and k == "imports"} == {"p/sub.py", "q.py::f", "p/sub.py::f"}
    assert {b for a, b, k in got if k == "calls"} == {"p/sub.py::f"}


def test_scripts(spark):
    util = "export function readFile(p: string) {\n  return p;\n}\n"
    run = (
        'import { readFile as rf } from "./util";\nimport * as util from "./util";\nimport lib from "../lib";\n\nexport class Base {\n  x() {\n    return 1;\n  }\n}\n\n'
        "export class Runner extends Base {\n  run(task: string) {\n    return this.prep(rf(task));\n  }\n\n  prep(t: string) {\n    return util.readFile(t);\n  }\n}\n"
    )
    (got,) = edges(spark, {"src/util.ts": util, "src/run.ts": run, "lib/index.js": "function one() {\n  return 1;\n}\n"})
    assert {e for e in got if e[2] in ("calls", "inherits", "imports")} == {
        ("src/run.ts::Runner.run", "src/run.ts::Runner.prep", "calls"), ("src/run.ts::Runner.run", "src/util.ts::readFile", "calls"), ("src/run.ts::Runner.prep", "src/util.ts::readFile", "calls"),
        ("src/run.ts::Runner", "src/run.ts::Base", "inherits"), ("src/run.ts", "src/util.ts::readFile", "imports"), ("src/run.ts", "src/util.ts", "imports"), ("src/run.ts", "lib/index.js", "imports"),
    }


def test_go(spark):
    files = {
        "util/load.go": "package util\n\nfunc Load(p string) string {\n\treturn p\n}\n",
        "main.go": 'package main\n\nimport "example.com/proj/util"\n\ntype Server struct {\n\tn int\n}\n\nfunc (s *Server) Start() error {\n\tutil.Load("x")\n\treturn nil\n}\n\nfunc main() {\n\ts := make()\n\ts.Start()\n\thelper()\n}\n',
        "other.go": "package main\n\nfunc helper() {\n\tmain()\n}\n",
    }
    (got,) = edges(spark, files)
    assert {e for e in got if e[2] in ("calls", "imports")} == {
        ("main.go::Server.Start", "util/load.go::Load", "calls"), ("main.go::main", "main.go::Server.Start", "calls"), ("main.go::main", "other.go::helper", "calls"), ("other.go::helper", "main.go::main", "calls"),
        ("main.go", "util/load.go", "imports"),
    }


@pytest.mark.parametrize("called, found", [("?.stop", {"b.ts::Job.stop"}), ("?.run", set()), ("x.stop", {"b.ts::Job.stop"}), ("stop", set())])
def test_unknown_receivers_resolve_only_to_a_unique_method(spark, called, found):
    defs = [("c", "a.ts", "Runner.run"), ("c", "b.ts", "Job.run"), ("c", "b.ts", "Job.stop"), ("c", "c.ts", "go")]
    refs = [("c", "c.ts", "go", "calls", called, None, 0), ("c", "c.ts", "go", "references", called, None, 1)]
    rows = resolve_edges(spark.createDataFrame(defs, DEFS), spark.createDataFrame(refs, REFS)).filter("kind <> 'defines'").collect()
    assert {(r["src"], r["dst"], r["kind"]) for r in rows} == {("c.ts::go", d, "calls") for d in found}
