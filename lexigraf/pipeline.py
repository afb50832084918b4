"""The retrieval pipeline over a batch of queries: one plan from chunks to ranked results.

What ``protocols`` names can be given to the constructor; what is not given is made from
the settings when it is first needed.  The defaults work offline and are deterministic.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .config import Settings
from .functions.stemmer import stemmed_code_tokens
from .functions.text import code_terms, snippet, word_set
from .operators import classify, dense, embedders, fusion, graph, lexical, query, rank, rerankers, structural
from .protocols import Embedder, PairScorer, QueryAnalyzer

#: Views that are searched, and those that build on a fused list.
FIRST, LATER = ("lexical", "semantic"), ("structural", "graph", "evolution")


class Pipeline:
    """``chunks``: chunk_hash and text, and for dedup lineage_id and version_id; ``edges`` and ``symbols`` (chunk_hash,
    symbol_id) for the graph view; ``traits`` (chunk_hash, trait) for the structural view; ``versions`` (version_id, tag,
    timestamp) and ``nodes`` (lineage_id, version_id, change_type, message) for dedup and the evolution view."""

    def __init__(
        self, settings: Settings, chunks: DataFrame, embed: Embedder | None = None, scorer: PairScorer | None = None, edges: DataFrame | None = None, symbols: DataFrame | None = None,
        traits: DataFrame | None = None, versions: DataFrame | None = None, nodes: DataFrame | None = None, analyze: QueryAnalyzer | None = None, complete: Callable | None = None,
    ):
        self.settings, self.chunks, self.edges, self.symbols, self.versions, self.nodes, self.complete = settings, chunks, edges, symbols, versions, nodes, complete
        self.tokens: Callable = stemmed_code_tokens if settings.stem else code_terms
        self.spark = chunks.sparkSession
        for name, value in (("embed", embed), ("scorer", scorer), ("traits", traits), ("analyze", analyze)):
            if value is not None:
                setattr(self, name, value)

    # --- made on first use -------------------------------------------------

    @functools.cached_property
    def embed(self) -> Embedder:
        s = self.settings
        if s.embedder is None:
            return embedders.Embedder(embedders.ModelSpec(f"hash-{s.dim}", dim=s.dim))
        return embedders.load(self.spark, s.embedder, s.cache_dir, s.embedder_fallback, s.allow_local_models, s.keep_query_vectors)

    @functools.cached_property
    def scorer(self) -> PairScorer:
        s = self.settings
        return rerankers.load(self.spark, s.reranker or "overlap", s.cache_dir, s.reranker_fallback, s.allow_local_models)

    @functools.cached_property
    def analyze(self) -> QueryAnalyzer:
        s = self.settings
        learned = classify.Classifier.load(self.spark, s.classifier) if s.analyzer_kind == "learned" and s.classifier else None
        complete = self.complete if s.analyzer_kind == "service" else None
        return lambda asked: classify.analyzed(asked, learned, complete)

    @functools.cached_property
    def weighter(self) -> query.LearnedWeights:
        return query.LearnedWeights.load(self.spark, self.settings.weight_model)

    @functools.cached_property
    def structural_model(self) -> structural.TraitModel | None:
        return structural.TraitModel.load(self.spark, self.settings.structural_model) if self.settings.structural_model else None

    @functools.cached_property
    def traits(self) -> DataFrame:
        return structural.trait_rows(self.chunks).persist()

    @functools.cached_property
    def index(self) -> lexical.LexicalIndex:
        return lexical.index_chunks(self.chunks, tokens=self.tokens)

    @functools.cached_property
    def vectors(self) -> DataFrame:
        return self.embed(self.chunks.select("chunk_hash", "text"), "chunk_hash").persist()

    def metadata(self) -> dict[str, str]:
        """Names and revisions of the models in use."""
        out = {}
        if "semantic" in self.settings.views:
            out["embedder"] = getattr(self.embed, "revision", type(self.embed).__name__)
        if self.settings.rerank_depth:
            out["reranker"] = getattr(self.scorer, "revision", type(self.scorer).__name__)
        return out

    # --- stages --------------------------------------------------------------

    def first_stage(self, asked: DataFrame, depth: int) -> DataFrame:
        s, out = self.settings, None
        for view in s.views:
            if view == "lexical":
                hits = lexical.search(self.index, asked, depth, self.tokens, s.k1, s.b)
            elif view == "semantic":
                hits = dense.search(self.embed(asked.select("qid", "text"), "qid", "query"), self.vectors, depth)
            else:
                continue
            out = hits if out is None else out.unionByName(hits)
        return out

    def retrieve(self, asked: DataFrame, parsed: DataFrame | None, depth: int) -> DataFrame:
        """First-stage hits; with decomposition each query's sub-queries, combined inside each view."""
        if not self.settings.decompose or parsed is None:
            return self.first_stage(asked, depth)
        subs = query.decompose(parsed)
        if "told_subs" in parsed.columns:  # a service's sub-queries come after the rules' own
            told = parsed.select("qid", F.posexplode("told_subs").alias("i", "text"))
            subs = subs.unionByName(told.select("qid", (F.col("i") + 1000).cast("long").alias("sub"), "text", F.lit("told").alias("facet"), F.lit(query.FACETS["clause"]).alias("weight")))
        joint = F.concat_ws("\u0001", F.col("qid").cast("string"), F.col("sub").cast("string"))
        hits = self.first_stage(subs.select(joint.alias("qid"), "text"), depth)
        part = F.split("qid", "\u0001")
        kind = dict(asked.dtypes)["qid"]
        rows = hits.select(part[0].cast(kind).alias("qid"), part[1].cast("long").alias("sub"), "view", "chunk_hash", "rank")
        out = fusion.combine_subqueries(rows, subs.select("qid", "sub", "weight"), depth, self.settings.rrf_k)
        return out.select("qid", "chunk_hash", "view", "raw", "rank")

    def view_weights(self, parsed: DataFrame | None, hits: DataFrame, views: list[str]) -> DataFrame:
        """(qid, view, weight) by rules or a learned model, or (view, weight) by the settings."""
        s = self.settings
        if s.fusion != "adaptive" or parsed is None:
            return fusion.weights_frame(self.spark, {v: float(s.weights.get(v, 0.0)) for v in views})
        if s.adaptive == "learned" and s.weight_model:
            grid = query.simplex_grid(self.spark, views)
            return self.weighter.weights(query.weighting_features(parsed, hits, views), grid)
        return query.rule_weights(parsed, views)

    def evolution_view(self, asked: DataFrame, parsed: DataFrame, fused: DataFrame) -> DataFrame:
        tokens = asked.join(parsed.select("qid", "version_refs"), "qid").select("qid", self.tokens(F.col("text")).alias("tokens"), F.col("version_refs").alias("refs"))
        nodes = self.nodes.select("lineage_id", "version_id", "change_type", self.tokens(F.coalesce("message", F.lit(""))).alias("message_tokens"))
        pool = fused.join(self.chunks.select("chunk_hash", "lineage_id"), "chunk_hash")
        return rank.evolution_view(tokens, pool, nodes, self.versions.select("version_id", "tag"))

    def search(self, asked: DataFrame, k: int = 10, trait_weights: DataFrame | None = None) -> DataFrame:
        """(qid, chunk_hash, score, rank, snippet) for queries (qid, text); blank queries have no results."""
        s = self.settings
        asked = asked.filter(F.trim("text") != "")
        depth = max(k, s.first_stage_k)
        views = [v for v in s.views if v in FIRST + LATER]
        needs = s.analyzer or s.decompose or s.fusion == "adaptive" or "evolution" in views
        parsed = self.analyze(asked).persist() if needs else None
        hits = self.retrieve(asked, parsed, depth).persist()
        weights = self.view_weights(parsed, hits, views)
        here = [v for v in views if v in FIRST]

        def fused() -> DataFrame:
            return fusion.fuse(hits, s.fusion, weights, s.norm, s.rrf_k, len(here))

        for view in [v for v in LATER if v in views]:
            if view == "structural" and (trait_weights is not None or self.structural_model is not None):
                wanted = trait_weights if trait_weights is not None else self.structural_model.weights(asked)
                more = structural.rescore(fused(), self.traits, wanted)
            elif view == "graph" and self.edges is not None:
                more = graph.graph_view(fused().select("qid", "chunk_hash", "score"), self.symbols, self.edges, hops=s.hops, decay=s.decay)
            elif view == "evolution" and self.nodes is not None:
                more = self.evolution_view(asked, parsed, fused())
            else:
                continue
            hits = hits.unionByName(more).persist()
            here.append(view)
        out = fused()
        if s.rerank_depth:
            pool = rank.cut(out, s.rerank_depth).join(self.chunks.select("chunk_hash", F.col("text").alias("chunk_text")), "chunk_hash")
            out = rank.rerank(out, self.scorer(asked, pool), s.rerank_depth, s.rerank_blend)
        if s.dedup and self.versions is not None:
            ranks = rank.version_rank(self.versions)
            out = rank.lineage_dedup(out, self.chunks, ranks, keep_history=s.keep_history)
        if s.diversify:
            by = self.vectors if "semantic" in views else self.chunks.select("chunk_hash", word_set("text").alias("words"))
            out = rank.mmr(out.select("qid", "chunk_hash", "score", "rank"), by, s.mmr_lambda, max(k, 20))
        rows = rank.cut(out, k).select("qid", "chunk_hash", "score", "rank")
        return rows.join(self.chunks.select("chunk_hash", snippet("text").alias("snippet")), "chunk_hash")


_pipelines: dict[tuple[str, str], Pipeline] = {}


def register(name: str, pipeline: Pipeline) -> None:
    """Keep a pipeline under a name and its settings' digest, and its chunks as a view of that name."""
    pipeline.chunks.createOrReplaceTempView(name)
    _pipelines[name, pipeline.settings.digest()] = pipeline


def registered(name: str, settings: Settings) -> Pipeline:
    return _pipelines[name, settings.digest()]


def tune_fusion(hits: DataFrame, qrels: DataFrame, cells: list[dict[str, float]], norms: tuple[str, ...] = ("minmax", "zscore"), ks: tuple[int, ...] = (20, 40, 60, 100)) -> list[dict]:
    """nDCG@10 of every fusion over views that were retrieved once; the best first."""
    from .operators.evaluation import evaluate

    spark, hits, out = hits.sparkSession, hits.persist(), []
    run = lambda f: f.select("qid", F.col("chunk_hash").alias("doc_id"), "score")
    for k in ks:
        out.append({"method": "rrf", "k": k, "ndcg_10": evaluate(run(fusion.rrf(hits, k)), qrels, (10,)).first()["ndcg_10"]})
    for norm in norms:
        for w in cells:
            fused = fusion.weighted(hits, fusion.weights_frame(spark, w), norm)
            out.append({"method": "weighted", "norm": norm, "weights": w, "ndcg_10": evaluate(run(fused), qrels, (10,)).first()["ndcg_10"]})
    return sorted(out, key=lambda r: -(r["ndcg_10"] or 0.0))


def tune_structural(hits: DataFrame, qrels: DataFrame, base: dict[str, float], gammas: tuple[float, ...] = (0.0, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5), norm: str = "minmax") -> list[dict]:
    """nDCG@10 for shares of the structural view, the other weights scaled down to make room; hits hold all views."""
    from .operators.evaluation import evaluate

    hits, out = hits.persist(), []
    for g in gammas:
        weights = {**{v: w * (1 - g) for v, w in base.items() if v != "structural"}, "structural": g}
        fused = fusion.weighted(hits, fusion.weights_frame(hits.sparkSession, weights), norm)
        found = evaluate(fused.select("qid", F.col("chunk_hash").alias("doc_id"), "score"), qrels, (10,)).first()
        out.append({"gamma": g, "ndcg_10": found["ndcg_10"], "mrr_10": found["mrr_10"], "recall_10": found["recall_10"]})
    return out
