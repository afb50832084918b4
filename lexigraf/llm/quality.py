"""Quality classifier: a linear support vector machine on naive Bayes features.

A text's features are the indicators of 1- to 3-character strings after characters are
replaced by their classes: lower, upper and other letters, digits, space, line end, and
each ASCII mark on its own; so the model learns how a text is written rather than what
it says.  Each indicator is scaled by the log ratio of its smoothed shares in the two
classes, a hinge-loss model is fitted by dual coordinate descent, and margins become
scores by a logistic curve fitted on ``FOLDS``-fold held-out margins.

The fit takes a bounded sample: at most about ``SAMPLE`` labelled rows of each class, the
least by a hash of the id, whole texts.  Null texts count as empty; an empty text has no
features and scores the curve at the bias.  If one class is missing, all texts score the
other; without labels 0.5.  Repeated rows score alike.  Ids labelled more than once count
each time.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import codes_of, fold_of, pieces, prepare, table, texts_of

SAMPLE, FOLDS, ROUNDS, COST, PIECE, SEED = 3000, 5, 30, 0.3, 1 << 18, 11
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
KINDS = 6 + len(MARKS)
GRAMS = KINDS + KINDS**2 + KINDS**3


def _classes() -> np.ndarray:
    """By code point below 0x250; above, letters count as other letters."""
    out = np.full(0x250, 5, np.int32)
    for i in range(0x250):
        c = chr(i)
        out[i] = 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 4 if c in "\n\r" else 3 if c.isspace() else 6 + MARKS.index(c) if c in MARKS else 5
    return out


CLASSES = _classes()


def indicators(texts: pa.Array):
    """The sorted feature numbers of each text, one array after the other."""
    for a, b in pieces(texts, PIECE):
        codes, offs = codes_of(texts.slice(a, b - a))
        x = np.where(codes < 0x250, CLASSES[np.minimum(codes, 0x24F)], 5)
        two = x[:-1] * KINDS + x[1:]
        three = two[:-1] * KINDS + x[2:]
        seen = np.zeros(KINDS**3, bool)
        for s, e in zip(offs[:-1], offs[1:], strict=True):
            parts = []
            for row, k, shift in ((x, 1, 0), (two, 2, KINDS), (three, 3, KINDS + KINDS**2)):
                if e - s >= k:
                    got = row[s : e - k + 1]
                    seen[got] = True
                    found = np.flatnonzero(seen) if len(got) > 2000 else np.unique(got)
                    seen[found] = False
                    parts.append(found + shift)
            yield np.concatenate(parts) if parts else np.zeros(0, np.int64)


@dataclass
class Model:
    weights: np.ndarray  # of the indicators, scaled by their log ratios
    bias: float
    slope: float
    middle: float

    def margins(self, texts: pa.Array) -> np.ndarray:
        return np.array([self.weights[f].sum() / math.sqrt(max(1, len(f))) + self.bias for f in indicators(texts)])

    def scores(self, texts: pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margins(texts) + self.middle, -30, 30)))


def _descend(rows: list[np.ndarray], y: np.ndarray, ratios: np.ndarray) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the hinge loss; classes count alike."""
    x = [ratios[f] / math.sqrt(max(1, len(f))) for f in rows]
    squares = np.array([v @ v + 1 for v in x])
    share = np.array([COST * len(y) / (2 * max(1, (y == s).sum())) for s in y])
    w, bias, alpha, order = np.zeros(len(ratios)), 0.0, np.zeros(len(y)), np.random.default_rng(SEED)
    for _ in range(ROUNDS):
        moved = 0.0
        for i in order.permutation(len(y)):
            slope = y[i] * (w[rows[i]] @ x[i] + bias) - 1
            new = min(max(alpha[i] - slope / squares[i], 0.0), share[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[rows[i]] += step * x[i]
                bias += step
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-4:
            break
    return w, bias


def _one(rows: list[np.ndarray], y: np.ndarray) -> tuple[np.ndarray, float]:
    counts = np.ones((2, GRAMS))
    for f, s in zip(rows, y, strict=True):
        counts[int(s > 0), f] += 1
    counts /= np.array([[(y < 0).sum() + 2], [(y > 0).sum() + 2]])
    ratios = np.log(counts[1] / counts[0])
    w, bias = _descend(rows, y, ratios)
    return w * ratios, bias


def fit(texts: list[str], labels: list[int], counts: dict[int, int] | None = None) -> Model:
    """counts: how many labelled rows each class has in all, if the texts are a sample; the scores' curve follows them."""
    y = np.where(np.array(labels, int) > 0, 1.0, -1.0)
    if len(set(y)) < 2:
        return Model(np.zeros(GRAMS), 0.0, 1.0, 0.0 if not len(y) else 6.0 * y[0])
    rows = list(indicators(pa.array(texts, pa.string())))
    held = np.zeros(len(y))
    part = np.random.default_rng(SEED).permutation(len(y)) % FOLDS
    for k in range(FOLDS):
        if len(set(y[part != k])) < 2:
            continue
        w, bias = _one([r for r, p in zip(rows, part, strict=True) if p != k], y[part != k])
        for i in np.flatnonzero(part == k):
            held[i] = w[rows[i]].sum() / math.sqrt(max(1, len(rows[i]))) + bias
    ones, zeros = (y > 0).sum(), (y < 0).sum()
    all_ones, all_zeros = (counts or {}).get(1, ones), (counts or {}).get(0, zeros)
    slope, middle, share = 1.0, 0.0, np.where(y > 0, all_ones / ones, all_zeros / zeros) / (all_ones + all_zeros)
    for _ in range(200):  # Newton steps, a little damped, on the logistic loss
        p = 1 / (1 + np.exp(-np.clip(slope * held + middle, -30, 30)))
        g, h = share * (p - (y > 0)), share * p * (1 - p)
        hess = np.array([[(h * held * held).sum() + 1e-4, (h * held).sum()], [(h * held).sum(), h.sum() + 1e-4]])
        step = np.linalg.solve(hess, [(g * held).sum() + 1e-4 * slope, g.sum()])
        slope, middle = slope - 0.5 * step[0], middle - 0.5 * step[1]
    w, bias = _one(rows, y)
    return Model(w, bias, max(slope, 1e-3), middle)


def class_counts(labels: DataFrame, label_col: str) -> dict[int, int]:
    return {r[0]: r[1] for r in labels.filter(F.col(label_col).isin(0, 1)).groupBy(label_col).count().collect()}


def sample_labels(labels: DataFrame, label_col: str, counts: dict[int, int], id_col: str = "doc_id", sample: int = SAMPLE) -> DataFrame:
    """About ``sample`` rows of each class at most, by a hash of the id; a bound that holds for any table."""
    span = 1 << 30
    hashed = F.pmod(F.xxhash64(F.lit(9), F.col(id_col)), F.lit(span))
    keep = F.lit(False)
    for k, n in counts.items():
        keep = keep | ((F.col(label_col) == k) & (hashed < min(span, math.ceil(span * sample / n))))
    return labels.filter(keep)


def train(docs: DataFrame, labels: DataFrame, label_col: str, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Model:
    """Fit on the texts of ``docs`` that a sample of the ``labels`` (0 or 1) names."""
    counts = class_counts(labels, label_col)
    named = sample_labels(labels.select(id_col, label_col), label_col, counts, id_col, sample)
    rows = docs.join(F.broadcast(named), id_col).select(F.coalesce(text_col, F.lit("")).alias("t"), label_col, id_col).collect()
    rows.sort(key=lambda r: (r[2], r[1], r[0]))
    return fit([r[0] for r in rows], [r[1] for r in rows], counts)


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with score instead of the text."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # GRAMS weights
    rest = [c for c in docs.columns if c not in (text_col, *("score",))]  # columns of these names are replaced

    def run(batches):
        for batch in batches:
            texts = texts_of(batch.column(batch.schema.get_field_index(text_col)))
            columns = [batch.column(batch.schema.get_field_index(c)) for c in rest]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(held.value.scores(texts), pa.float64())], [*rest, "score"])

    return docs.mapInArrow(run, T.StructType([docs.schema[c] for c in rest] + [T.StructField("score", T.DoubleType())]))


def op9_quality(spark, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(fold_of("doc_id", 3) == 1, F.lit(False))
    labels = table(spark, sf_dir, "labels").filter(~held_out).select("doc_id", "quality")
    model = train(docs, labels, "quality")
    scored = score(docs.select("doc_id", held_out.alias("held_out"), "text"), model)
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))

