"""The pipeline, its settings and the stemmer."""

import pytest

from lexigraf import config, pipeline
from lexigraf.functions.stemmer import stem


@pytest.mark.parametrize("word, root", [
    ("consignment", "consign"), ("knackeries", "knackeri"), ("generate", "generat"), ("skies", "sky"), ("hopping", "hop"), ("hoped", "hope"), ("relational", "relat"),
    ("conditional", "condit"), ("happy", "happi"), ("say", "say"), ("parsing", "pars"), ("cats", "cat"), ("gas", "gas"), ("electricity", "electr"), ("controlling", "control"),
])
def test_stems(word, root):
    assert stem(word) == root


def test_settings_extend_and_override(tmp_path):
    (tmp_path / "base.yaml").write_text('{"rrf_k": 10, "weights": {"lexical": 0.5}}')
    (tmp_path / "own.yaml").write_text('{"extends": "base.yaml", "fusion": "weighted"}')
    s = config.load(str(tmp_path / "own.yaml"), ["weights.semantic=0.1", "stem=false"])
    assert (s.rrf_k, s.fusion, s.stem, s.weights["lexical"], s.weights["semantic"]) == (10, "weighted", False, 0.5, 0.1)
    assert s.digest() != config.load().digest()


@pytest.fixture(scope="module")
def chunks(spark):
    rows = [("a", "def parse_config(path): read json settings"), ("b", "open a network socket and send bytes"), ("c", "sort the list of numbers"), ("d", "parse config settings file")]
    return spark.createDataFrame(rows, "chunk_hash string, text string")


def test_hybrid_search(spark, chunks):
    s = config.Settings(views=["lexical", "semantic"], fusion="adaptive", decompose=True, rerank_depth=3, diversify=True)
    asked = spark.createDataFrame([(1, "parse the config settings"), (2, "   ")], "qid long, text string")
    got = pipeline.Pipeline(s, chunks).search(asked, 3).orderBy("rank").collect()
    assert got[0]["chunk_hash"] in ("a", "d") and {r["qid"] for r in got} == {1}


def test_registry(spark, chunks):
    plain = config.Settings(stem=False)
    pipeline.register("small", pipeline.Pipeline(plain, chunks))
    assert pipeline.registered("small", plain).settings == plain and spark.table("small").count() == 4


def test_all_views_and_word_diversity(spark):
    """Structural, graph and evolution views build on the fused list; settings make the parts that are not given."""
    chunks = spark.createDataFrame(
        [("a", "import heapq\ndef smallest(items):\n    return heapq.nsmallest(3, items)\n", "L1", "v1"), ("b", "def caller(items):\n    return smallest(items)\n", "L2", "v1"), ("c", "def other():\n    return 0\n", "L3", "v1")],
        "chunk_hash string, text string, lineage_id string, version_id string",
    )
    versions = spark.createDataFrame([("v1", "v1.0", 1)], "version_id string, tag string, timestamp long")
    nodes = spark.createDataFrame([("L3", "v1", "modified", "smallest items fixed"), ("L1", "v1", "added", None)], "lineage_id string, version_id string, change_type string, message string")
    symbols = spark.createDataFrame([("a", "m::smallest"), ("b", "m::caller"), ("c", "m::other")], "chunk_hash string, symbol_id string")
    edges = spark.createDataFrame([("m::caller", "m::smallest", "calls"), ("m::other", "m::caller", "calls")], "src string, dst string, kind string")
    s = config.Settings(views=["lexical", "structural", "graph", "evolution"], fusion="rrf", stem=True, dedup=True, diversify=True, rerank_depth=2, rerank_blend=0.5)
    pipe = pipeline.Pipeline(s, chunks, edges=edges, symbols=symbols, versions=versions, nodes=nodes)
    asked = spark.createDataFrame([(1, "smallest items since v1.0")], "qid long, text string")
    weights = spark.createDataFrame([(1, "heapq", 2.0)], "qid long, trait string, weight double")
    got = pipe.search(asked, 5, weights).orderBy("rank").collect()
    assert {r["chunk_hash"] for r in got} == {"a", "b", "c"} and got[0]["chunk_hash"] == "a" and pipe.metadata() == {"reranker": "overlap@1"}
    assert pipe.evolution_view(asked, pipe.analyze(asked), spark.createDataFrame([(1, "c", 1.0, 1)], "qid long, chunk_hash string, score double, rank long")).first()["raw"] == pytest.approx(2 / 7 + 0.5 + 0.1)
