"""References to edges of a code graph, as joins.

Definitions (commit_id, path, symbol) and references (commit_id, path, symbol, kind, target,
local, seq) meet in a few equi-joins for all commits at once; no commit is gathered.

- A file answers to module names (``modules``): a Python file to every dotted ending of its
  path, a script to its path without suffix (an index file to its folder as well), a Go file
  to its folder.
- An import asks for module names in order (``_wanted``); the first that is known counts, and
  ties a local name to files.
- A use asks questions in order (``_questions``): is a symbol defined in its own file, in the
  files that a name is tied to, in its folder, in a star import, or is it the only method of
  that name.  Answers are one join with the definitions, and the least question answered
  counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import language_of, symbol_id
from ..session import stored

#: A dotted ending that more files share names none of them.
MOST_FILES = 3
SCRIPT = r"\.(?:ts|tsx|js|jsx)$"


def modules(files: DataFrame) -> DataFrame:
    """(commit_id, family, module, file): the names under which files (commit_id, path) can be imported."""
    told = files.select("commit_id", F.col("path").alias("file"), family(F.col("path")).alias("family"))
    stem = F.regexp_replace("file", r"((^|/)__init__)?\.py$", "")
    parts = F.split(stem, "/")
    endings = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    bare = F.regexp_replace("file", SCRIPT, "")
    names = (
        F.when(F.col("family") == "python", endings)
        .when(F.col("family") == "go", F.array(F.regexp_extract("file", r"^(.*)/[^/]*$", 1)))
        .otherwise(F.array_distinct(F.array(bare, F.regexp_replace(bare, r"/index$", ""))))
    )
    every = told.select("commit_id", "family", F.explode(names).alias("module"), "file").filter("module <> '' or family = 'go'")
    count = every.filter("family = 'python'").groupBy("commit_id", "family", "module").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > MOST_FILES)
    return every.join(count, ["commit_id", "family", "module"], "left_anti")


def family(path: Column) -> Column:
    language = language_of(path)
    return F.when(language.isin("typescript", "javascript"), "script").otherwise(language)


def _wanted(imports: DataFrame) -> DataFrame:
    """(commit_id, path, seq, local, family, try, module, name): the modules that each import may mean, the first try first."""
    module, name = F.split_part("target", F.lit(":"), F.lit(1)), F.split_part("target", F.lit(":"), F.lit(2))
    told = imports.withColumns({"module": module, "name": name, "family": family(F.col("path"))})
    ask = lambda i, m, n: F.struct(i.cast("int").alias("try"), m.alias("module"), n.alias("name"))
    steps = F.split("module", "/")
    tries = (
        F.when((F.col("family") == "python") & ~F.col("name").isin("", "*"), F.array(ask(F.lit(0), F.concat_ws(".", F.when(F.col("module") != "", F.col("module")), "name"), F.lit("")), ask(F.lit(1), F.col("module"), F.col("name"))))
        .when(F.col("family") == "go", F.transform(F.sequence(F.lit(1), F.size(steps)), lambda i: ask(i, F.array_join(F.slice(steps, i, F.size(steps)), "/"), F.col("name"))))
        .otherwise(F.array(ask(F.lit(1), F.col("module"), F.col("name"))))
    )
    return told.select("commit_id", "path", "seq", "local", "family", F.explode(tries).alias("x")).select("commit_id", "path", "seq", "local", "family", "x.*")


def bound(imports: DataFrame, known: DataFrame) -> DataFrame:
    """(commit_id, path, seq, local, name, file): the files of each import that any module answers to."""
    met = _wanted(imports).join(known, ["commit_id", "family", "module"])
    first = met.groupBy("commit_id", "path", "seq").agg(F.min("try").alias("try"))
    return met.join(first, ["commit_id", "path", "seq", "try"]).select("commit_id", "path", "seq", "local", "name", "file").distinct()


def _import_edges(ties: DataFrame, defined: DataFrame) -> DataFrame:
    """An import's edge goes to the symbol that it names, or to the files where none is named or defined."""
    hit = ties.filter("name not in ('', '*', 'default')").join(defined, (ties["commit_id"] == defined["d_commit"]) & (ties["file"] == defined["d_file"]) & (ties["name"] == defined["d_symbol"]))
    hits = hit.select("commit_id", "path", "seq", symbol_id("file", "name").alias("dst"))
    rest = ties.join(hits, ["commit_id", "path", "seq"], "left_anti").select("commit_id", "path", "seq", F.col("file").alias("dst"))
    return hits.unionByName(rest).select("commit_id", F.col("path").alias("src"), "dst", F.lit("imports").alias("kind"))


def _questions(uses: DataFrame, ties: DataFrame) -> DataFrame:
    """(commit_id, path, seq, order, scope, asked, tie): what each use asks, a list in order; ``tie`` is the import it goes by."""
    last = ties.filter("local is not null and name <> '*'").groupBy("commit_id", "path", "local").agg(F.max_by(F.struct(F.col("seq").alias("tie"), "name"), F.col("seq")).alias("to"))
    told = uses.withColumn("parts", F.split("target", r"\."))
    prefix = F.transform(F.sequence(F.lit(1), F.greatest(F.size("parts") - 1, F.lit(1))), lambda i: F.struct(i.alias("i"), F.array_join(F.slice("parts", 1, i), ".").alias("local")))
    tied = told.select("commit_id", "path", "seq", F.explode(prefix).alias("x")).select("commit_id", "path", "seq", "x.*").join(last, ["commit_id", "path", "local"])
    longest = tied.groupBy("commit_id", "path", "seq").agg(F.max_by(F.struct("i", "to"), F.col("i")).alias("by"))
    rows = told.join(longest, ["commit_id", "path", "seq"], "left")

    one, head, second, final = F.size("parts") == 1, F.col("parts")[0], F.get("parts", F.lit(1)), F.element_at("parts", -1)
    owner, name, has = F.split_part(F.coalesce("symbol", F.lit("")), F.lit("."), F.lit(1)), F.col("by.to.name"), F.col("by").isNotNull()
    after = F.get("parts", F.col("by.i"))
    dotted = lambda a, b: F.concat_ws(".", a, b)
    ask = lambda k, scope, what: F.struct(F.lit(k).alias("order"), F.lit(scope).alias("scope"), what.alias("asked"))
    listed = (
        F.when(head.isin("self", "this") & ~one, F.array(ask(1, "own", dotted(owner, second))))
        .when(head == "?", F.array(ask(1, "method", final)))
        .when(~one & has & (name == ""), F.array(ask(1, "tied", after)))
        .when(~one & has, F.array(ask(1, "tied", dotted(name, after)), ask(2, "tied", name)))
        .when(~one, F.array(ask(1, "own", dotted(head, second)), ask(2, "own", head), ask(3, "method", final)))
        .when(has, F.array(ask(1, "own", head), ask(2, "folder", head), ask(3, "tied", F.when(name.isin("", "default"), head).otherwise(name))))
        .otherwise(F.array(ask(1, "own", head), ask(2, "folder", head), ask(3, "star", head)))
    )
    return rows.select("commit_id", "path", "seq", "kind", F.col("by.to.tie").alias("tie"), F.explode(listed).alias("q")).select("commit_id", "path", "seq", "kind", "tie", "q.*")


def resolve_edges(defs: DataFrame, refs: DataFrame) -> DataFrame:
    """(commit_id, src, dst, kind), without loops and repeats, from defs (commit_id, path, symbol) and refs (commit_id, path,
    symbol, kind, target, local, seq)."""
    named = defs.filter("symbol is not null").select(F.col("commit_id").alias("d_commit"), F.col("path").alias("d_file"), F.col("symbol").alias("d_symbol"))
    defined = named.distinct()
    known = modules(defs.select("commit_id", "path").distinct())
    ties = stored(bound(refs.filter("kind = 'imports'"), known), "ties")
    asked = stored(_questions(refs.filter("kind <> 'imports'"), ties), "asked")
    key = ["commit_id", "path", "seq"]
    to = lambda scope: asked.filter(F.col("scope") == scope).drop("scope")
    folder = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    near = known.filter("family = 'go'").select("commit_id", F.col("module").alias("folder"), "file")
    files = lambda rows, k: rows.select(*key, F.struct("order", k.alias("k")).alias("order"), "file", "asked")
    places = files(to("own").withColumn("file", F.col("path")), F.lit(0).cast("long"))
    places = places.unionByName(files(to("tied").join(ties.select("commit_id", "path", F.col("seq").alias("tie"), "file"), ["commit_id", "path", "tie"]), F.lit(0).cast("long")))
    places = places.unionByName(files(to("folder").filter(family(F.col("path")) == "go").withColumn("folder", folder).join(near, ["commit_id", "folder"]), F.lit(0).cast("long")))
    stars = ties.filter("name = '*'").select("commit_id", "path", F.col("seq").alias("k"), "file")
    places = places.unionByName(files(to("star").join(stars, ["commit_id", "path"]), F.col("k").cast("long")))
    hits = places.join(defined, (F.col("commit_id") == F.col("d_commit")) & (F.col("file") == F.col("d_file")) & (F.col("asked") == F.col("d_symbol")))
    hits = hits.select(*key, "order", symbol_id("file", "asked").alias("dst"))
    methods = named.filter(F.contains("d_symbol", F.lit("."))).withColumn("asked", F.element_at(F.split("d_symbol", r"\."), -1))
    only = methods.groupBy(F.col("d_commit").alias("commit_id"), "asked").agg(F.count(F.lit(1)).alias("n"), F.min(symbol_id("d_file", "d_symbol")).alias("dst")).filter("n = 1")
    calls = to("method").filter("kind = 'calls'").join(only, ["commit_id", "asked"])
    hits = hits.unionByName(calls.select(*key, F.struct("order", F.lit(0).cast("long").alias("k")).alias("order"), "dst"))
    best = hits.groupBy(*key).agg(F.min("order").alias("order"))
    found = hits.join(best, [*key, "order"]).join(refs.select(*key, "symbol", "kind"), key)
    used = found.select("commit_id", symbol_id("path", "symbol").alias("src"), "dst", "kind")
    holds = defs.filter("symbol is not null").select("commit_id", F.col("path").alias("src"), symbol_id("path", "symbol").alias("dst"), F.lit("defines").alias("kind"))
    return holds.unionByName(_import_edges(ties, defined)).unionByName(used).filter("src <> dst").distinct()
