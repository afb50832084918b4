"""The store over Git: reuse, replay, backfill, guards, comparison; stores over frames."""

import shutil

import pytest

from lexigraf import service
from lexigraf.cli import commit_files
from lexigraf.sources import frames, git
from lexigraf.sources.store import VersionedStore

LOAD = "def load(path):\n    with open(path) as f:\n        data = f.read()\n    return data.strip().split(',')\n"


@pytest.fixture(scope="module")
def repo(tmp_path_factory):
    """Four commits: a file, a rename, a move with a new caller, a deletion."""
    at = str(tmp_path_factory.mktemp("git") / "repo")
    one = commit_files(at, {"a/conf.py": LOAD, "a/run.py": "from .conf import load\n\n\ndef main():\n    return load('x')\n"}, "first")
    two = commit_files(at, {"a/conf.py": LOAD.replace("def load", "def read_all"), "a/run.py": "from .conf import read_all\n\n\ndef main():\n    return read_all('x')\n"}, "rename load")
    three = commit_files(at, {"b/conf.py": LOAD.replace("def load", "def read_all"), "a/run.py": "from b.conf import read_all\n\n\ndef main():\n    return read_all('x')\n\n\ndef twice():\n    return main() + main()\n"}, "move", gone=["a/conf.py"])
    four = commit_files(at, {"a/run.py": "def twice():\n    return 2\n"}, "drop main", gone=["b/conf.py"])
    return at, [one, two, three, four]


def store_at(spark, repo, tmp_path):
    return VersionedStore(spark, f"file://{tmp_path}/store", repo)


def lines_of(store):
    return {(r["commit_id"], r["symbol"], r["change_type"]): r["lineage_id"] for r in store.table("lineage").collect()}


def test_a_commit_indexed_after_its_descendants_changes_their_lineage(spark, repo, tmp_path):
    at, (one, two, three, _) = repo
    late, early = store_at(spark, at, tmp_path / "late"), store_at(spark, at, tmp_path / "early")
    for c in (one, three, two):
        late.index_commit(c)
    for c in (one, two, three):
        early.index_commit(c)
    assert lines_of(late) == lines_of(early)
    assert late.lineage_bases() == {one: None, two: one, three: two} and late.commits() == [one, two, three]
    first = lines_of(late)[one, "load", "added"]
    assert lines_of(late)[two, "read_all", "renamed"] == lines_of(late)[three, "read_all", "moved"] == first
    history = service.symbol_history(late, "load", three)
    assert [(r["symbol"], r["change_type"]) for r in history] == [("load", "added"), ("read_all", "renamed"), ("read_all", "moved")]
    assert [r["version_rank"] for r in service.versions(late)] == [0, 1, 2]
    # a symbol through its rename and move, and the commits that touched it
    d = service.diff_symbol(late, "read_all", one, three)
    assert (d["change"], d["old_id"], d["new_id"]) == ("renamed", "a/conf.py::load", "b/conf.py::read_all") and "-def load(path):" in d["diff"] and "+def read_all(path):" in d["diff"]
    assert service.diff_symbol(late, "read_all", two, three)["change"] == "moved"
    assert service.diff_symbol(late, "main", one, two)["change"] == "modified" and service.diff_symbol(late, "nothing", one, two)["change"] == "unchanged"
    found = service.compare_versions(late, one, three)
    assert [c["subject"] for c in found["commits"]] == ["move", "rename load"]
    assert found["commits"][0]["symbols"] == ["a/run.py::main", "a/run.py::twice", "b/conf.py::read_all"] and found["commits"][1]["symbols"] == ["a/run.py::main", "a/run.py::twice"]
    assert found["summary"] == {"renamed": 1, "modified": 1, "added": 1}
    assert {(e["change"], e["src"], e["dst"]) for e in found["edges"] if e["kind"] == "calls"} == {("added", "a/run.py::twice", "a/run.py::main")}
    assert len(service.compare_versions(late, one, three, limit=1)["symbols"]) == 1


def test_refs_are_made_again_where_they_were_lost(spark, repo, tmp_path):
    at, (one, two, *_) = repo
    store = store_at(spark, at, tmp_path)
    store.index_commit(one)
    before = [tuple(r) for r in store.iter_refs(one).collect()]
    assert before and ("a/run.py", "main", "calls", "load") in [(r[0], r[1], r[2], r[3]) for r in before]
    for name in ("refs", "derived"):
        shutil.rmtree(tmp_path / "store" / name)
    assert [tuple(r) for r in store.iter_refs(one).collect()] == before and store.has(one, "refs")
    shutil.rmtree(tmp_path / "store/derived")
    stats = store.index_commit(two)  # its base has no marks, so everything is read again
    assert {r["path"] for r in store.iter_refs(two).collect()} == {"a/conf.py", "a/run.py"} and stats.base == one


def test_lookups_and_guards(spark, repo, tmp_path):
    at, (one, two, *_) = repo
    with store_at(spark, at, tmp_path) as store:
        store.index_commit(one)
        chunk = store.iter_chunks(one).first()
        assert store.get_chunk(chunk["occurrence_id"])["text"] == chunk["text"]
        assert [(r["path"], r["start_line"]) for r in store.iter_chunks(one, history=True).collect()] == [("a/conf.py", 1), ("a/run.py", 4)]
        with pytest.raises(KeyError):
            store.get_chunk("none")
        with pytest.raises(ValueError):
            store.iter_chunks(two)
        assert store.commit_like(one[:7]) == one and {r["lineage_id"] for r in store.lineage_ids(one).collect()} == set(lines_of(store).values())
        with pytest.raises(ValueError):
            store.commit_like("zz")
        assert git.commit_info(at, [two, one]) == {two: (git.log(at, [two], 1)[0][3], "rename load"), one: (git.log(at, [one], 1)[0][3], "first")}
        assert [r["symbol"] for r in service.search_baseline(store, "load path", one, 5)] == ["load", "main"]
    other = str(tmp_path / "other")
    commit_files(other, {"z.py": "def z():\n    return 1\n"}, "other")
    with pytest.raises(ValueError, match="another repository"):
        store_at(spark, other, tmp_path)
    with pytest.raises(ValueError, match="no Git"):
        store_at(spark, str(tmp_path), tmp_path / "x")
    VersionedStore(spark, f"file://{other}/.lexigraf", other)
    assert git.lines(other, "status", "--porcelain") == []


def test_frames(spark):
    chunks = spark.createDataFrame([("h1", "a\n", "v1"), ("h2", "b\n", "v1"), ("h2", "b\n", "v2"), ("h3", "c\n", "v2")], "chunk_hash string, text string, version_id string")
    store = frames.ChunkFrame(chunks)
    assert store.iter("v1").count() == 2 and store.iter().count() == 4 and store.get("h3")["text"] == "c\n"
    with pytest.raises(KeyError):
        store.get("h9")
    assert {(r["chunk_hash"], r["change"]) for r in store.changed_since("v1", "v2").collect()} == {("h1", "removed"), ("h2", "unchanged"), ("h3", "added")}
    nodes = spark.createDataFrame([("L", "m::f", "v2", "h3", "modified"), ("L", "m::f", "v1", "h1", "added"), ("M", "m::g", "v2", "h2", "added")], "lineage_id string, symbol_id string, version_id string, chunk_hash string, change_type string")
    versions = spark.createDataFrame([("v2", None, 9), ("v1", "first", 3)], "version_id string, tag string, timestamp long")
    kept = frames.VersionFrame(versions, nodes, chunks.select("chunk_hash", "text").distinct())
    assert [r["version_id"] for r in kept.versions().collect()] == ["v1", "v2"] and [r["chunk_hash"] for r in kept.lineage("L").collect()] == ["h1", "h3"]
    assert [kept.diff_symbol(s, a, b)["change"] for s, a, b in (("m::f", "v1", "v2"), ("m::g", "v1", "v2"), ("m::g", "v2", "v1"), ("m::g", "v2", "v2"))] == ["modified", "added", "deleted", "unchanged"]
    assert kept.diff_symbol("m::f", "v1", "v2")["diff"] == "--- v1\n+++ v2\n@@ -1 +1 @@\n-a\n+c\n"
    symbols = spark.createDataFrame([("m::f", "h1", 1), ("m::f", "h3", 2), ("m::K.g", "h2", 3)], "symbol_id string, chunk_hash string, seq int")
    g = frames.GraphFrame(symbols, spark.createDataFrame([("m::f", "m::K.g", "calls"), ("m::f", "m::f", "calls"), ("m::f", "m::K.g", "calls")], "src string, dst string, kind string"))
    assert g.chunk_for("m::f") == "h3" and g.symbols_for("h2") == ["m::K.g"] and g.chunk_for("x") is None and g.edges.count() == 1
    assert [r[0] for r in g.resolve("g").collect()] == ["m::K.g"] and [tuple(r) for r in g.neighbors("m::K.g").collect()] == [("m::f", "calls")]
