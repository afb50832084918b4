"""Language identification by interpolated Kneser-Ney character models.

Texts are read as lower-case letters with every run of other characters as one space.
For each language the counts of 1- to ``ORDER``-character strings of its training texts
give an interpolated Kneser-Ney model.  All models live in arrays sorted by a hash of the
string: one row of log probabilities (a column per language) for each string seen in any
language, and one row of back-off weights for each context, so a character costs one
binary search whatever the number of languages.

A text takes the language of the lowest cross-entropy per character.  It is rejected if
that is above the language's threshold: the mean over calibration texts (one in
``CALIBRATE`` of the training sample, not used for the counts), plus ``MARGIN`` nats,
plus ``SHORT`` nats divided by the text's length, since short texts vary more.

The sample holds at most about ``SAMPLE`` texts of each language, the least by a hash of
id and text; texts in it are read whole.  Null texts and texts without a letter are ``und``
with score 0, and rejected.  Without any labelled text all are.  Repeated rows are
treated alike; other columns pass.  Languages are no more than ``LANGUAGES``; more raise
an error rather than being dropped.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import codes_of, fold_of, fold_table, folded, give_back, mixed, pieces, prepare, table, texts_of

ORDER, SAMPLE, LANGUAGES, CALIBRATE, MARGIN, SHORT, PIECE = 4, 250, 200, 5, 1.2, 12.0, 1 << 17
BASE = np.uint64(0x9E3779B97F4A7C15)


def _each_hash(codes: np.ndarray, order: int):
    """``_hashes``, one after the other."""
    c = codes.astype(np.uint64) + np.uint64(1)
    h, power = np.zeros(len(c), np.uint64), 1
    yield mixed(h)
    for k in range(min(order, len(c))):
        h[k:] += c[: len(c) - k] * np.uint64(power)
        power = power * int(BASE) & (1 << 64) - 1
        yield mixed(h + np.uint64(k + 1))
    for k in range(min(order, len(c)), order):
        yield mixed(h + np.uint64(k + 1))


def _hashes(codes: np.ndarray, order: int) -> list[np.ndarray]:
    """hashes[k][i]: of the k characters that end before i + 1 (garbage where they cross a text's start)."""
    return list(_each_hash(codes, order))


@dataclass
class Model:
    languages: list[str]
    order: int
    keys: list[np.ndarray]  # by length: sorted hashes of strings
    logs: list[np.ndarray]  # log probabilities of their last characters, a column per language
    contexts: list[np.ndarray]  # by length: sorted hashes of contexts
    backs: list[np.ndarray]  # log weights of backing off from them
    floor: float
    limits: np.ndarray | None = None


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, whether each is there)"""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.searchsorted(keys, wanted)
    at[at == len(keys)] = 0
    return at, keys[at] == wanted


def _grams(texts: list[str], order: int) -> dict[int, tuple]:
    """By length: the strings of the texts, sorted, with their counts, contexts, and themselves without the first character."""
    codes, offs = codes_of(pa.array(texts, pa.string()))
    codes, offs, _ = folded(codes, offs, fold_table(False))
    place = np.arange(len(codes)) - np.repeat(offs[:-1], np.diff(offs))
    seen, shorter = {}, None
    for k, h in enumerate(_each_hash(codes, order)):  # two lengths at a time are held, since the driver fits
        if k:
            ok = np.flatnonzero(place >= k)  # a text's first space is only context
            key, first, count = np.unique(h[ok], return_index=True, return_counts=True)
            where = ok[first]
            # the context is what ends one earlier
            seen[k] = (key, count, np.where(where > 0, shorter[where - 1], np.uint64(0)), shorter[where])
        shorter = h
    return seen


def fit(texts: dict[str, list[str]], order: int = ORDER) -> Model:
    """Interpolated Kneser-Ney models of the texts of each language."""
    languages = sorted(texts)
    grams: list[dict[str, tuple]] = []
    for name in languages:
        grams.append(_grams(texts[name], order))
    alphabet = np.unique(np.concatenate([g[1][0] for g in grams])) if grams else np.zeros(0, np.uint64)
    floor = -math.log(len(alphabet) + 1)
    model = Model(languages, order, [np.zeros(0, np.uint64)], [np.zeros((0, 0))], [], [], floor)
    lower_of = None
    for k in range(1, order + 1):
        every = np.unique(np.concatenate([g[k][0] for g in grams])) if grams else np.zeros(0, np.uint64)
        context = np.zeros(len(every), np.uint64)
        lower = np.zeros(len(every), np.uint64)
        for g in grams:
            at, _ = _find(every, g[k][0])
            context[at], lower[at] = g[k][2], g[k][3]
        contexts = np.unique(context)
        logs = np.zeros((len(every), len(languages)), np.float64)
        backs = np.zeros((len(contexts), len(languages)), np.float64)
        inside, _ = _find(contexts, context)
        for j, g in enumerate(grams):
            count = np.zeros(len(every))
            at, _ = _find(every, g[k][0])
            if k == order:
                count[at] = g[k][1]
            else:  # continuation counts: kinds of characters before the string
                near, there = _find(every, g[k + 1][3])
                np.add.at(count, near[there], 1)
            ones, twos = (count == 1).sum(), (count == 2).sum()
            discount = ones / (ones + 2 * twos) if ones and twos else 0.5
            total = np.bincount(inside, count, len(contexts))
            kinds = np.bincount(inside, count > 0, len(contexts))
            weight = np.where(total > 0, discount * kinds / np.maximum(total, 1), 1.0)
            if k == 1:
                low = np.full(len(every), math.exp(floor))
            else:
                near, _ = _find(model.keys[k - 1], lower)
                low = np.exp(model.logs[k - 1][near, j])
            share = np.where(total[inside] > 0, np.maximum(count - discount, 0) / np.maximum(total[inside], 1), 0)
            logs[:, j] = np.log(np.maximum(share + weight[inside] * low, 1e-12))
            backs[:, j] = np.log(np.maximum(weight, 1e-12))
        model.keys.append(every)
        model.logs.append(logs)
        model.contexts.append(contexts)
        model.backs.append(backs)
    model.logs = [x.astype(np.float32) for x in model.logs]
    model.backs = [x.astype(np.float32) for x in model.backs]
    return model


def entropies(model: Model, codes: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cross-entropy per character of each text in each language, characters); offs as of ``codes_of``."""
    codes, offs, _ = folded(codes, offs, fold_table(False))
    n, width = len(offs) - 1, len(model.languages)
    place = np.arange(len(codes)) - np.repeat(offs[:-1], np.diff(offs))
    hs = _hashes(codes, model.order)
    spent = np.zeros((len(codes), width), np.float32)
    todo = np.flatnonzero(place >= 1)
    longest = np.minimum(place[todo], model.order)
    for k in range(model.order, 0, -1):
        now = todo[longest >= k]
        if not len(now):
            continue
        at, there = _find(model.keys[k], hs[k][now])
        hit = now[there]
        spent[hit] += model.logs[k][at[there]]
        miss = now[~there]
        if len(miss):
            near, known = _find(model.contexts[k - 1], hs[k - 1][miss - 1])
            spent[miss[known]] += model.backs[k - 1][near[known]]
            if k == 1:
                spent[miss] += model.floor
        todo = np.concatenate((todo[longest < k], miss)) if k > 1 else todo[:0]
        todo.sort()
        longest = np.minimum(place[todo], k - 1)
    sums = np.add.reduceat(spent, offs[:-1], axis=0, dtype=np.float64) if n else np.zeros((0, width))
    chars = np.diff(offs) - 1
    return -sums / np.maximum(chars, 1)[:, None], chars


def predict(model: Model, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(language, score, accepted) of each text."""
    texts = texts_of(texts)
    names, scores, accepted = [], np.zeros(len(texts)), np.zeros(len(texts), bool)
    for a, b in pieces(texts, PIECE):
        codes, offs = codes_of(texts.slice(a, b - a))
        letters = np.concatenate(([0], np.cumsum(fold_table(False)[codes] != 32)))[offs]
        some = np.diff(letters) > 0
        if not model.languages:
            names += ["und"] * (b - a)
            continue
        cost, chars = entropies(model, codes, offs)
        best = cost.argmin(1)
        gap = (cost - cost[np.arange(b - a), best][:, None]) * np.minimum(chars, 50)[:, None]
        scores[a:b] = np.where(some, 1 / np.exp(-gap).sum(1), 0)
        accepted[a:b] = some & (cost.min(1) <= model.limits[best] + SHORT / np.maximum(chars, 1))
        names += [model.languages[i] if s else "und" for i, s in zip(best, some, strict=True)]
    return names, scores, accepted


def train(docs: DataFrame, label_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Model:
    """Fit and calibrate on a sample of the rows of ``docs`` whose label is not null."""
    labelled = docs.filter(F.col(label_col).isNotNull() & F.col(text_col).isNotNull())
    counts = labelled.groupBy(label_col).count().limit(LANGUAGES + 1).collect()
    if len(counts) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    span, cut = 1 << 30, F.lit(None).cast("long")
    for r in counts:  # a threshold on a hash keeps about ``sample`` rows of each language
        cut = F.when(F.col(label_col) == r[0], F.lit(min(span, math.ceil(span * sample / r["count"])))).otherwise(cut)
    hashed = F.pmod(F.xxhash64(F.lit(5), F.col(id_col), F.col(text_col)), F.lit(span))
    part = F.pmod(F.xxhash64(F.lit(6), F.col(id_col), F.col(text_col)), F.lit(CALIBRATE))
    rows = labelled.filter(hashed < cut).select(label_col, text_col, (part > 0).alias("fits")).collect()
    by_language: dict[str, tuple[list[str], list[str]]] = {}
    for r in rows:
        by_language.setdefault(r[0], ([], []))[r["fits"]].append(r[1])
    # a language with too few texts for both has all of them fitted, and is calibrated on the same
    model = fit({k: fits or apart for k, (apart, fits) in by_language.items()})
    costs: dict[str, list] = {x: [] for x in model.languages}
    for name, (apart, fits) in by_language.items():
        for text in apart if apart and fits else [*apart, *fits]:
            cost, chars = entropies(model, *codes_of(pa.array([text], pa.string())))
            if chars[0] > 20:
                costs[name].append(cost[0, model.languages.index(name)])
    model.limits = np.array([(np.mean(costs[x]) if costs[x] else -model.floor) + MARGIN for x in model.languages])
    del rows, by_language
    give_back()
    return model


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score and accepted instead of the text."""
    return _apply(docs, model, text_col, False)


def accepted(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that have a language."""
    return _apply(docs, model, text_col, True)


def _apply(docs: DataFrame, model: Model, text_col: str, only: bool) -> DataFrame:
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(model)  # its size is bounded by the sample's
    rest = [c for c in docs.columns if c not in (text_col, *("lang_pred", "score", "accepted"))]  # columns of these names are replaced

    def run(batches):
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col))
            names, scores, kept = predict(held.value, texts)
            if only:
                yield batch.filter(pa.array(kept))
            else:
                columns = [batch.column(batch.schema.get_field_index(c)) for c in rest]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(names, pa.string()), pa.array(scores), pa.array(kept)], [*rest, "lang_pred", "score", "accepted"])

    schema = docs.schema if only else T.StructType([docs.schema[c] for c in rest] + [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("accepted", T.BooleanType())])
    return docs.mapInArrow(run, schema)


def op10_language_id(spark, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = fold_of("doc_id", 4) == 2
    model = train(docs.filter(~F.coalesce(held_out, F.lit(False))))
    return identify(docs.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "text"), model).select("doc_id", "held_out", "lang_pred", "score")
