"""The registered queries, one callable (spark, sf_dir) each, and their SQL."""

from . import retrieval, versions, graphs, texts, parts  # noqa: I001

QUERIES = {**retrieval.QUERIES, **versions.QUERIES, **graphs.QUERIES, **texts.QUERIES, **parts.QUERIES}
SQL = {**retrieval.SQL, **versions.SQL, **graphs.SQL, **texts.SQL, **parts.SQL}
# the flagship's SQL is put together from that of fusion and of query understanding
SQL["hybrid_pipeline_flagship"] = retrieval._flagship_sql()


def flagship(spark, sf_dir):
    return retrieval.hybrid_pipeline_flagship(spark, sf_dir)
