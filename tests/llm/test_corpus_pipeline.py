"""The pipeline's stages."""

from llm_helpers import CLASHES
from test_jaccard_join import brute_join

from lexigraf.llm.common import store


def test_pipeline_stages(spark, empty, tmp_path):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "decontaminate", "mix", "shard"]
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, before = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES:
        out = store(stage(spark, before, sf), "test")
        if name != "shard":
            assert out.columns == columns
        if name == "near_duplicates":
            rows = [(r["doc_id"], r["text"], None, None, None) for r in before.collect()]
            assert {r["doc_id"] for r in out.collect()} == {r[2] for r in brute_join(rows)}
        if name == "decontaminate":
            items = [r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
            assert not any(i in r["text"] for r in out.collect() for i in items)
        before = out
    assert before.count() > 0
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf).count() == 0


def test_stages_on_awkward_rows(spark, tmp_path):
    """Nulls in every column, clashing names, repeated rows and a group that holds a third of all rows go through each stage."""
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    base = spark.read.parquet(f"{sf}/documents.parquet")
    first = base.filter("lang = 'en' and length(text) > 200").orderBy("doc_id").first()
    hot = [(10_000 + i, first["text"], first["lang"], None if i % 2 else first["source"], None) for i in range(100)]
    odd = [(None, None, None, None, None), (20_000, "", None, None, 0), (20_001, None, "en", "src0", 0), (20_002, "  \n", "en", None, 3), (20_002, "  \n", "en", None, 3)]
    docs = base.unionByName(spark.createDataFrame(hot + odd, base.schema))
    wide = docs
    for c in CLASHES:
        wide = wide.withColumn(c, docs["n_chars"])
    for name, stage in corpus_pipeline.STAGES:
        narrow, out = store(stage(spark, docs, sf), "narrow"), store(stage(spark, wide, sf), "wide")
        if name != "shard":
            assert out.columns == wide.columns and sorted(map(repr, (tuple(r) for r in out.select(docs.columns).collect()))) == sorted(map(repr, (tuple(r) for r in narrow.collect())))
        if name == "near_duplicates":
            assert narrow.filter(narrow["text"] == first["text"]).count() == 1
        docs, wide = narrow, out
    assert docs.count() == wide.count() > 50
