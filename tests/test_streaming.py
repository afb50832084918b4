"""Streams over files: event-time windows and commits that arrive."""

import json

from lexigraf.cli import commit_files
from lexigraf.sources.store import VersionedStore
from lexigraf.streaming import index_stream, latency_windows


def test_latency_windows_equal_the_batch(spark, tmp_path):
    source = "/root/testdata/sf0.001/events.parquet"
    batch = spark.read.parquet(source)
    batch.write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(batch.schema).parquet(f"file://{tmp_path}/in")
    query = latency_windows(stream).writeStream.outputMode("complete").format("memory").queryName("windows").option("checkpointLocation", f"file://{tmp_path}/ck").start()
    query.processAllAvailable()
    query.stop()
    got = sorted((r["start"], r["event_type"], r["n"], round(r["mean"], 6)) for r in spark.table("windows").collect())
    want = sorted((r["start"], r["event_type"], r["n"], round(r["mean"], 6)) for r in latency_windows(batch).collect())
    assert got == want and want


def test_commits_that_arrive_are_indexed_once(spark, tmp_path):
    repo = str(tmp_path / "repo")
    first = commit_files(repo, {"a.py": "def one():\n    return 1\n"}, "one")
    second = commit_files(repo, {"b.py": "def two():\n    return 2\n"}, "two")
    (tmp_path / "refs").mkdir()
    (tmp_path / "refs/1.json").write_text("\n".join(json.dumps({"ref": r}) for r in (second, first)))
    store = VersionedStore(spark, f"file://{tmp_path}/store", repo)
    for _ in range(2):
        index_stream(spark, f"file://{tmp_path}/refs", store, f"file://{tmp_path}/ck").awaitTermination(120)
    assert store.commits() == [first, second]
    assert store.table("occurrences", second).count() == 2
