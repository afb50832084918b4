"""Chunkers, references, the store, run files, and the driver's entry."""

from lexigraf.cli import commit_files, smoke
from lexigraf.sources import chunkers, runs


def test_python_chunks_start_at_the_decorator_and_fall_back_to_the_file():
    got = chunkers.python_spans("import a\n\n@deco\ndef f():\n    pass\n\nclass C:\n    def m(self):\n        pass\n")
    assert [(s.symbol, s.kind, s.start_line, s.end_line) for s in got] == [("f", "function", 3, 5), ("C", "class", 7, 9)]
    assert chunkers.python_spans("def (:\n")[0].kind == "file"


def test_scanned_chunks():
    got = [(s.symbol, s.kind) for s in chunkers.spans("a.ts", "export const twice = (x) => {\n  return x;\n};\n\ninterface P {\n  a: string;\n}\n\nclass K {\n  one() {\n    return '}';\n  }\n  two() {\n    return 2;\n  }\n}\nconst short = 1;\n")]
    assert got == [("twice", "variable"), ("P", "interface"), ("K", "class"), ("K.one", "method"), ("K.two", "method")]
    go = [(s.symbol, s.kind) for s in chunkers.spans("a.go", "package p\n\ntype S struct {\n\ta int\n}\n\nfunc (s *S) Get() int {\n\treturn s.a\n}\n\nfunc Plain() {\n\tx()\n}\n")]
    assert go == [("S", "type"), ("S.Get", "method"), ("Plain", "function")]


def test_run_files(spark, tmp_path):
    run = spark.createDataFrame([("q1", "a", 1.0), ("q1", "b", 1.0), ("q1", "c", 2.5)], "qid string, doc_id string, score double")
    runs.write_run(run, f"file://{tmp_path}/run")
    back = [(r["doc_id"], r["rank"], r["score"]) for r in runs.read_run(spark, f"file://{tmp_path}/run").orderBy("rank").collect()]
    assert back == [("c", 1, 2.5), ("b", 2, 1.0), ("a", 3, 1.0)]


def test_smoke(spark):
    assert all(smoke(spark).values())


def test_git_source(spark, tmp_path):
    from lexigraf.sources import git

    repo = str(tmp_path / "r")
    commit_files(repo, {"a.py": "x = 1\n", "b.txt": "no\n"}, "first")
    git.register(spark)
    rows = spark.read.format("lexigraf_git").option("path", repo).load()
    assert [(r["path"], r["content"]) for r in rows.collect()] == [("a.py", "x = 1\n")]
    log = spark.read.format("lexigraf_git").option("path", repo).option("table", "log").load().collect()
    assert log[0]["subject"] == "first" and log[0]["files"] == ["a.py"]
