"""Text functions as Column expressions; all run in the JVM."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: The words that code tokens leave out.
STOPWORDS = [
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "has", "have", "he", "her", "his", "i", "if", "in", "into", "is", "it", "its",
    "of", "on", "or", "she", "so", "such", "that", "the", "their", "them", "then", "there", "these", "they", "this", "to", "was", "we", "were",
    "which", "while", "who", "will", "with", "you", "your", "our", "can", "do", "does", "not", "no",
]
IDENTIFIER = r"([A-Za-z_][A-Za-z0-9_]*|[0-9]+)"
PIECE = r"([A-Z]+(?=[A-Z][a-z])|[A-Z]?[a-z]+|[A-Z]+|[0-9]+)"
PLAIN = r"([A-Za-z][A-Za-z0-9]*|[0-9]+)"
CODE_TOKEN = r"((?U)\w+|[^\s\w])"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def split_identifier(name: Column | str) -> Column:
    """The lower-case pieces of a camel-case or snake-case name."""
    return F.transform(F.regexp_extract_all(_col(name), F.lit(PIECE), F.lit(1)), F.lower)


def code_tokens(text: Column | str, keep_identifiers: bool = True) -> Column:
    """Names and numbers of a text: a name of several pieces whole and in pieces, stop words left out of the pieces."""
    stop = F.array(*[F.lit(w) for w in STOPWORDS])

    def of(name: Column) -> Column:
        parts = split_identifier(name)
        kept = F.filter(parts, lambda p: ~F.array_contains(stop, p))
        return F.when(F.size(parts) > 1, F.concat(F.array(F.lower(name)), kept)).otherwise(kept) if keep_identifiers else kept

    return F.flatten(F.transform(F.regexp_extract_all(_col(text), F.lit(IDENTIFIER), F.lit(1)), of))


def _stop_pieces() -> str:
    """A pattern of the stop words where they are whole pieces of a name: small or capitalised before anything but a small
    letter, or in capitals where such a piece ends; by their first letters, since most words fail there."""
    by_first: dict[str, list[str]] = {}
    for w in STOPWORDS:
        by_first.setdefault(w[0], []).append(w[1:])
    one_of = lambda rest: "|".join(sorted(rest, key=len, reverse=True))
    longer = [f"[{c.upper()}{c}](?:{one_of(filter(None, rest))})(?![a-z])" for c, rest in by_first.items() if any(rest)]
    small = "|".join([*longer, *(f"{c}(?![a-z])" for c, rest in by_first.items() if "" in rest)])
    large = "|".join(f"{c.upper()}(?:{one_of(r.upper() for r in rest)})" for c, rest in by_first.items())
    return f"(?:{small})|(?:{large})(?:(?![A-Za-z])|(?=[A-Z][a-z]))"


#: A stop word, or in the group a piece that is none.
KEPT_PIECE = f"(?:{_stop_pieces()})|{PIECE}"
#: Where a name has more than one piece.
SEAM = r"[a-z][A-Z0-9]|[0-9][A-Za-z]|[A-Z][0-9]|[A-Z]{2}[a-z]|[A-Za-z0-9]_+[A-Za-z0-9]"


def code_terms(text: Column | str) -> Column:
    """The terms of ``code_tokens`` in another order: pieces of all names first, then the names of several pieces.  One
    pattern reads pieces and stop words, so nothing is looked up for each element."""
    t = _col(text)
    pieces = F.array_remove(F.regexp_extract_all(t, F.lit(KEPT_PIECE), F.lit(1)), "")
    names = F.filter(F.regexp_extract_all(t, F.lit(IDENTIFIER), F.lit(1)), lambda n: n.rlike(SEAM))
    return F.transform(F.concat(pieces, names), F.lower)


def plain_tokens(text: Column | str) -> Column:
    """Lower-case words and numbers, split where a small letter or digit meets a capital."""
    spaced = F.replace(F.regexp_replace(_col(text), r"([a-z0-9])([A-Z])", "$1 $2"), F.lit("_"), F.lit(" "))
    return F.transform(F.regexp_extract_all(spaced, F.lit(PLAIN), F.lit(1)), F.lower)


def shingles(text: Column | str, own_name: Column | str | None = None, k: int = 3) -> Column:
    """The distinct runs of ``k`` code tokens, joined by spaces, the chunk's own name masked; one run if there are fewer."""
    body = _col(text)
    if own_name is not None:
        last = F.element_at(F.split(_col(own_name), r"\."), -1)
        masked = F.regexp_replace(body, F.concat(F.lit(r"(?U)\b\Q"), last, F.lit(r"\E\b")), F.lit("\u0000"))
        body = F.when(last.isNotNull() & (last != ""), masked).otherwise(body)
    tokens = F.regexp_extract_all(body, F.lit(CODE_TOKEN), F.lit(1))

    def runs(t: Column) -> Column:
        each = F.transform(F.sequence(F.lit(1), F.size(t) - (k - 1)), lambda i: F.array_join(F.slice(t, i, k), " "))
        return F.array_distinct(F.when(F.size(t) < k, F.array(F.array_join(t, " "))).otherwise(each))

    # through a one-element array, so that the tokens are made once and not again for each run
    return F.element_at(F.transform(F.array(tokens), runs), 1)


def shingle_hashes(language: Column, text: Column | str, k: int = 3) -> Column:
    """64-bit hashes of a language's ``shingles``, without the strings."""
    tokens = F.regexp_extract_all(_col(text), F.lit(CODE_TOKEN), F.lit(1))

    def runs(t: Column) -> Column:
        each = F.transform(F.sequence(F.lit(1), F.size(t) - (k - 1)), lambda i: F.xxhash64(language, *[F.element_at(t, i + j) for j in range(k)]))
        return F.array_distinct(F.when(F.size(t) < k, F.array(F.xxhash64(language, F.array_join(t, " ")))).otherwise(each))

    return F.element_at(F.transform(F.array(tokens), runs), 1)


def jaccard(a: Column | str, b: Column | str, empty: float = 1.0) -> Column:
    """Share of common elements of two arrays without repeats; ``empty`` if both are empty."""
    union = F.size(F.array_union(_col(a), _col(b)))
    return F.when(union == 0, F.lit(empty)).otherwise(F.size(F.array_intersect(_col(a), _col(b))).cast("double") / union)


def word_set(text: Column | str) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(_col(text)), F.lit(r"((?U)\w+)"), F.lit(1)))


def head_tail(text: Column | str, most: int, head: float = 0.7, marker: str = "\n...\n") -> Column:
    """A long text as its first ``head`` share of ``most`` characters, a marker, and the rest from its end."""
    t, first = _col(text), int(most * head)
    return F.when(F.length(t) <= most, t).otherwise(F.concat(F.substring(t, 1, first), F.lit(marker), F.right(t, F.lit(most - first))))


def snippet(text: Column | str, lines: int = 40) -> Column:
    return F.array_join(F.slice(F.split(_col(text), "\n"), 1, lines), "\n")


def normal_space(text: Column | str) -> Column:
    return F.trim(F.regexp_replace(_col(text), r"\s+", " "))


def json_object_in(text: Column | str) -> Column:
    """From the first opening to the last closing brace."""
    return F.regexp_extract(_col(text), r"(?s)(\{.*\})", 1)


def joined_by_nul(*parts: Column) -> Column:
    """The parts, nulls as empty texts, with a NUL between them."""
    return F.concat_ws("\u0000", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def content_hash(language: Column | str, text: Column | str) -> Column:
    return F.sha2(joined_by_nul(_col(language), _col(text)), 256)


def occurrence_id(commit: Column, path: Column, symbol: Column, start: Column, content: Column) -> Column:
    return F.sha2(joined_by_nul(commit, path, symbol, start, content), 256)


def lineage_id(commit: Column, path: Column, symbol: Column, start: Column) -> Column:
    return F.substring(F.sha2(joined_by_nul(commit, path, symbol, start), 256), 1, 16)


def symbol_id(path: Column | str, symbol: Column | str) -> Column:
    return F.concat(_col(path), F.when(F.coalesce(_col(symbol), F.lit("")) != "", F.concat(F.lit("::"), _col(symbol))).otherwise(""))


def cache_key(*parts: Column) -> Column:
    """sha1 of the parts, each followed by NUL."""
    return F.sha1(F.concat(*[F.concat(F.coalesce(p.cast("string"), F.lit("")), F.lit("\u0000")) for p in parts]))


def language_of(path: Column | str) -> Column:
    names = {"py": "python", "js": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript", "go": "go"}
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.element_at(table, F.lower(F.regexp_extract(_col(path), r"\.([A-Za-z]+)$", 1)))


def unit(vector: Column | str) -> Column:
    """The vector at length 1, as doubles."""

    def of(v: Column) -> Column:
        norm = F.greatest(F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x)), F.lit(1e-12))
        return F.element_at(F.transform(F.array(norm), lambda n: F.transform(v, lambda x: x / n)), 1)

    # through one-element arrays, so that the doubles and the length are made once and not again for each coordinate
    return F.element_at(F.transform(F.array(F.transform(_col(vector), lambda x: x.cast("double"))), of), 1)


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def capped(text: Column | str, most: int = 4000) -> Column:
    """The first ``most`` characters, as tools show texts."""
    return F.substring(_col(text), 1, most)


@F.pandas_udf(StringType())
def unified_diff(old: pd.Series, new: pd.Series, old_name: pd.Series, new_name: pd.Series, most: pd.Series) -> pd.Series:
    """Unified diffs of two texts, nulls as empty; those of more than ``most`` lines are cut, with how many were left out."""
    import difflib

    def one(a, b, x, y, n):
        lines = list(difflib.unified_diff((a or "").splitlines(True), (b or "").splitlines(True), x or "", y or ""))
        most = len(lines) if n is None or n != n else int(n)
        return "".join(lines if len(lines) <= most else [*lines[:most], f"... {len(lines) - most} more\n"])

    return pd.Series([one(*r) for r in zip(old, new, old_name, new_name, most, strict=True)], index=old.index, dtype=object)
