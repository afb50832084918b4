"""Structural ranking: traits of code, how likely a query wants each, and log-likelihood ratios."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from .lexical import PLACES

# Names whose call is a trait, and the other traits.
CALL_TRAITS = {
    "sort": ["sorted", "sort"],
    "heapq": ["heappush", "heappop", "heapify", "nlargest", "nsmallest", "heappushpop"],
    "deque": ["deque", "popleft", "appendleft"],
    "bisect": ["bisect", "bisect_left", "bisect_right", "insort"],
    "gcd": ["gcd", "lcm"],
    "counter": ["Counter", "most_common"],
    "defaultdict": ["defaultdict"],
    "memo": ["lru_cache", "cache"],
    "combinatorics": ["permutations", "combinations", "product", "accumulate", "combinations_with_replacement"],
    "string_ops": ["split", "join", "strip", "replace", "find", "count", "startswith", "endswith"],
    "char_codes": ["ord", "chr"],
    "set_ops": ["set", "add", "discard", "union", "intersection"],
    "minmax": ["min", "max"],
    "sum": ["sum"],
    "abs": ["abs"],
    "enumerate_zip": ["enumerate", "zip"],
    "map_int": ["map"],
    "sqrt": ["sqrt", "isqrt", "ceil", "floor", "log", "log2"],
    "pow_mod": ["pow"],
    "setrecursionlimit": ["setrecursionlimit"],
    "regex": ["match", "findall", "sub", "search", "compile", "fullmatch"],
    "stdout_write": ["write"],
    "reversed": ["reversed"],
    "dict_methods": ["items", "keys", "values", "get", "setdefault"],
}
OTHER_TRAITS = [
    "io_input", "io_stdin", "io_multitest", "io_grid", "print", "loop", "loop_nested2", "loop_nested3", "while_loop", "comprehension", "recursion",
    "multi_def", "class_def", "lambda", "try_except", "global", "subscript_2d", "slice_reverse", "bit_ops", "floor_div", "float_div", "mod_const",
    "modulo", "dict_literal", "string_format", "early_exit", "yield",
]
TRAITS = [*OTHER_TRAITS, *CALL_TRAITS]
PATTERNS = {
    "mod_const": r"\b(?:1000000007|998244353|10\s*\*\*\s*9\s*\+\s*7|1e9\s*\+\s*7)\b",
    "io_grid": r"\[\s*(?:list\(|input\(|\w+\(input)[^\]]*for\s+\w+\s+in\s+range",
    "io_multitest": r"for\s+\w+\s+in\s+range\(\s*int\(\s*(?:input|sys\.stdin\.readline)\(\)|"
    r"(?m:^\s*(\w+)\s*=\s*int\(\s*(?:input|sys\.stdin\.readline)\(\)\s*\)\s*$(?=[\s\S]*(?:range\(\s*\1\s*\)|while\s+\1)))",
}
_BY_CALL = {name: trait for trait, names in CALL_TRAITS.items() for name in names}
_BINARY = {ast.BitAnd: "bit_ops", ast.BitOr: "bit_ops", ast.BitXor: "bit_ops", ast.LShift: "bit_ops", ast.RShift: "bit_ops", ast.FloorDiv: "floor_div", ast.Div: "float_div", ast.Mod: "modulo"}
_PLAIN = {
    ast.ListComp: "comprehension", ast.SetComp: "comprehension", ast.DictComp: "comprehension", ast.GeneratorExp: "comprehension", ast.ClassDef: "class_def",
    ast.Lambda: "lambda", ast.Try: "try_except", ast.Global: "global", ast.Yield: "yield", ast.YieldFrom: "yield", ast.Dict: "dict_literal", ast.FormattedValue: "string_format",
}


class _Traits(ast.NodeVisitor):
    def __init__(self) -> None:
        self.found: set[str] = set()
        self.depth, self.inside, self.functions = 0, [], 0

    def generic_visit(self, node: ast.AST) -> None:
        for kind, trait in _PLAIN.items():
            if isinstance(node, kind):
                self.found.add(trait)
        super().generic_visit(node)

    def _loop(self, node: ast.AST) -> None:
        self.depth += 1
        self.found.add("loop")
        self.found |= {f"loop_nested{k}" for k in (2, 3) if self.depth >= k}
        if isinstance(node, ast.While):
            self.found.add("while_loop")
        self.generic_visit(node)
        self.depth -= 1

    visit_For = visit_While = visit_AsyncFor = _loop

    def _function(self, node) -> None:
        self.functions += 1
        self.inside.append(node.name)
        self.generic_visit(node)
        self.inside.pop()

    visit_FunctionDef = visit_AsyncFunctionDef = _function

    def visit_Subscript(self, node: ast.Subscript) -> None:
        if isinstance(node.value, ast.Subscript):
            self.found.add("subscript_2d")
        s = node.slice
        if isinstance(s, ast.Slice) and s.lower is None and s.upper is None and s.step is not None and ast.unparse(s.step) == "-1":
            self.found.add("slice_reverse")
        self.generic_visit(node)

    def _operator(self, node) -> None:
        if type(node.op) in _BINARY:
            self.found.add(_BINARY[type(node.op)])
        self.generic_visit(node)

    visit_BinOp = visit_AugAssign = _operator

    def visit_Import(self, node: ast.Import) -> None:
        self.found |= {f"imp:{a.name.split('.')[0]}" for a in node.names}

    def visit_ImportFrom(self, node: ast.ImportFrom) -> None:
        if node.module:
            self.found.add(f"imp:{node.module.split('.')[0]}")

    def visit_Attribute(self, node: ast.Attribute) -> None:
        if ast.unparse(node).startswith("sys.stdin"):
            self.found.add("io_stdin")
        self.generic_visit(node)

    def visit_Call(self, node: ast.Call) -> None:
        full = ast.unparse(node.func)
        short = full.rsplit(".", 1)[-1]
        named = {"input": "io_input", "print": "print", "exit": "early_exit", "quit": "early_exit", "format": "string_format"}
        if full in ("sys.stdin.readline", "stdin.readline"):
            self.found.add("io_stdin")
        elif short in named:
            self.found.add(named[short])
        if short in _BY_CALL and (short != "write" or "stdout" in full):
            self.found.add(_BY_CALL[short])
        if self.inside and full == self.inside[-1]:
            self.found.add("recursion")
        self.generic_visit(node)


def traits_of(code: str) -> list[str]:
    """The traits of Python code and ``imp:`` entries; code that can't be parsed keeps those found by pattern."""
    found = {name for name, pattern in PATTERNS.items() if re.search(pattern, code)}
    try:
        walk = _Traits()
        walk.visit(ast.parse(code))
        found |= walk.found | ({"multi_def"} if walk.functions >= 2 else set())
    except (SyntaxError, ValueError, RecursionError):
        found |= _by_tokens(code)
    return sorted(found)


_WORDS = {"for": "loop", "while": "loop", "class": "class_def", "lambda": "lambda", "try": "try_except", "global": "global", "yield": "yield"}
_MARKS = {"&": "bit_ops", "|": "bit_ops", "^": "bit_ops", "<<": "bit_ops", ">>": "bit_ops", "//": "floor_div", "/": "float_div", "%": "modulo"}


def _by_tokens(code: str) -> set[str]:
    """What can be told of code that doesn't parse from its tokens alone: keywords, operators, imports and called names."""
    found, before, defs = set(), "", 0
    for m in re.finditer(r"(?P<skip>#[^\n]*|\"\"\".*?\"\"\"|\'\'\'.*?\'\'\'|\"(?:\\.|[^\"\\\n])*\"|\'(?:\\.|[^\'\\\n])*\')|(?P<name>[^\W\d]\w*)|(?P<mark><<|>>|//|[&|^/%])", code, re.S):
        if m["mark"]:
            found.add(_MARKS[m["mark"]])
        elif name := m["name"]:
            found |= {_WORDS[name]} if name in _WORDS else set()
            found |= {"while_loop"} if name == "while" else set()
            defs += name == "def"
            if before in ("import", "from"):
                found.add(f"imp:{name}")
            elif re.match(r"\s*\(", code[m.end() : m.end() + 8]) and before not in ("def", "class"):
                found |= {_BY_CALL[name]} if name in _BY_CALL and name != "write" else set()
                found |= {{"input": "io_input", "print": "print", "exit": "early_exit", "quit": "early_exit", "format": "string_format"}.get(name, "")} - {""}
            before = name
    return found | ({"multi_def"} if defs > 1 else set()) | ({"io_stdin"} if "sys.stdin" in code else set())


@F.pandas_udf(ArrayType(StringType()))
def traits_udf(code: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for part in code:
        yield part.map(lambda c: traits_of(c or ""))


def trait_rows(chunks: DataFrame) -> DataFrame:
    """(chunk_hash, trait), the corpus' traits in long form."""
    return chunks.select("chunk_hash", F.explode(traits_udf("text")).alias("trait"))


def pattern_traits(chunks: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """(chunk_hash, trait) by patterns alone, in the JVM."""
    found = F.array_compact(F.array(*[F.when(F.col("text").rlike(p), F.lit(t)) for t, p in patterns.items()]))
    return chunks.select("chunk_hash", F.explode(found).alias("trait"))


def vocabulary(traits: DataFrame, n: int, share: float = 0.005) -> list[str]:
    """The fixed traits, and imports that enough of the n training chunks have."""
    least = max(2, int(share * n))
    often = traits.filter(F.col("trait").startswith("imp:")).groupBy("trait").agg(F.count_distinct("chunk_hash").alias("c")).filter(F.col("c") >= least)
    return [*TRAITS, *sorted(r["trait"] for r in often.collect())]


def priors(traits: DataFrame, n: int, names: list[str]) -> DataFrame:
    """(trait, prior): shares of the n training chunks, kept within [1e-3, 1 - 1e-3]."""
    spark = traits.sparkSession
    share = traits.groupBy("trait").agg((F.count_distinct("chunk_hash") / float(max(1, n))).alias("share"))
    all_ = spark.createDataFrame([(t,) for t in names], "trait string")
    return all_.join(share, "trait", "left").select("trait", F.greatest(F.lit(1e-3), F.least(F.lit(1 - 1e-3), F.coalesce("share", F.lit(0.0)))).alias("prior"))


def llr(probabilities: DataFrame) -> DataFrame:
    """(…, weight, off): log-likelihood ratios of a trait's presence against its absence from (p, prior)."""
    on, off = F.log(F.col("p") / F.col("prior")), F.log((1 - F.col("p")) / (1 - F.col("prior")))
    return probabilities.withColumn("weight", on - off).withColumn("off", off)


def rescore(pool: DataFrame, traits: DataFrame, weights: DataFrame) -> DataFrame:
    """hits of the view ``structural`` for a pool (qid, chunk_hash, rank): the sum of (qid, trait, weight) over a chunk's
    traits; ties keep the pool's order."""
    summed = pool.join(traits, "chunk_hash").join(weights, ["qid", "trait"]).groupBy("qid", "chunk_hash", F.col("rank").alias("was")).agg(F.sum("weight").alias("raw"))
    window = Window.partitionBy("qid").orderBy(F.round("raw", PLACES).desc(), "was")
    return summed.withColumn("rank", F.row_number().over(window).cast("long")).select("qid", "chunk_hash", F.lit("structural").alias("view"), "raw", "rank")


class TraitModel:
    """One logistic regression per trait from a query's words and word pairs (log-scaled tf-idf of those that two queries
    have, unit length).  Labels stay one long table (qid, trait); each fit reads its trait's rows by a join."""

    def __init__(self, c: float = 1.0, features: int = 1 << 16, least: int = 2):
        self.c, self.features, self.least, self.models, self.prior = c, features, least, {}, {}

    def fit(self, queries: DataFrame, traits: DataFrame, names: list[str]) -> TraitModel:
        """queries (qid, text) with the traits (qid, trait) of what answers them."""
        from pyspark.ml import Pipeline
        from pyspark.ml.classification import LogisticRegression

        from .classify import tfidf_stages

        self.pipe = Pipeline(stages=tfidf_stages("x", self.features, self.least)).fit(queries)
        rows = self.pipe.transform(queries).select("qid", "x").persist()
        n = rows.count()
        labels = traits.filter(F.col("trait").isin(names)).select("qid", "trait").distinct().persist()
        counts = {r["trait"]: r["c"] for r in labels.groupBy("trait").agg(F.count(F.lit(1)).alias("c")).collect()}  # of the vocabulary
        self.prior = {r["trait"]: r["prior"] for r in priors(labels.withColumnRenamed("qid", "chunk_hash"), n, names).collect()}
        for t in names:
            if 0 < counts.get(t, 0) < n:
                have = labels.filter(F.col("trait") == t).select("qid", F.lit(1.0).alias("label"))
                labelled = rows.join(have, "qid", "left").fillna(0.0, ["label"])
                self.models[t] = LogisticRegression(featuresCol="x", regParam=1 / (self.c * n), standardization=False, maxIter=100).fit(labelled)
        labels.unpersist(), rows.unpersist()
        return self

    def predict(self, queries: DataFrame) -> DataFrame:
        """(qid, trait, p, prior); the prior where a trait has no model."""
        from pyspark.ml.functions import vector_to_array

        rows = self.pipe.transform(queries).select("qid", "x").persist()
        out = None
        for t, prior in self.prior.items():
            if t in self.models:
                one = self.models[t].transform(rows).select("qid", vector_to_array("probability")[1].alias("p"))
            else:
                one = rows.select("qid", F.lit(prior).alias("p"))
            one = one.select("qid", F.lit(t).alias("trait"), F.greatest(F.lit(1e-3), F.least(F.lit(1 - 1e-3), F.col("p"))).alias("p"), F.lit(prior).alias("prior"))
            out = one if out is None else out.unionByName(one)
        return out

    def weights(self, queries: DataFrame) -> DataFrame:
        """(qid, trait, weight) for ``rescore``."""
        return llr(self.predict(queries)).select("qid", "trait", "weight")

    def save(self, path: str) -> None:
        from pyspark.sql import SparkSession

        self.pipe.write().overwrite().save(f"{path}/words")
        rows = [(t, p, t in self.models) for t, p in self.prior.items()]
        SparkSession.active().createDataFrame(rows, "trait string, prior double, fitted boolean").coalesce(1).write.mode("overwrite").parquet(f"{path}/traits")
        for t, model in self.models.items():
            model.write().overwrite().save(f"{path}/model-{t.encode().hex()}")

    @classmethod
    def load(cls, spark, path: str) -> TraitModel:
        from pyspark.ml import PipelineModel
        from pyspark.ml.classification import LogisticRegressionModel

        out, rows = cls(), spark.read.parquet(f"{path}/traits").collect()
        out.pipe = PipelineModel.load(f"{path}/words")
        out.prior = {r["trait"]: r["prior"] for r in rows}
        out.models = {r["trait"]: LogisticRegressionModel.load(f"{path}/model-{r['trait'].encode().hex()}") for r in rows if r["fitted"]}
        return out


def train(queries: DataFrame, chunks: DataFrame, qrels: DataFrame, **how) -> TraitModel:
    """A trait model from queries (qid, text), chunks (chunk_hash, text) and judgements (qid, doc_id, rel): a query's traits
    are those of the chunks judged relevant for it that the corpus has.  Queries without any don't count."""
    gold = qrels.filter("rel > 0").select("qid", F.col("doc_id").alias("chunk_hash")).distinct()
    answered = gold.join(chunks.select("chunk_hash", "text"), "chunk_hash").persist()
    mine = trait_rows(answered.select("chunk_hash", "text").dropDuplicates(["chunk_hash"])).persist()
    traits = answered.select("qid", "chunk_hash").join(mine, "chunk_hash").select("qid", "trait").distinct()
    asked = queries.join(answered.select("qid").distinct(), "qid", "left_semi").select("qid", "text").persist()
    names = vocabulary(mine, answered.select("chunk_hash").distinct().count())
    out = TraitModel(**how).fit(asked, traits, names)
    answered.unpersist(), mine.unpersist(), asked.unpersist()
    return out
