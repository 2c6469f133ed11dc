"""Operator 3. Quality rules with risk-controlled thresholds.

A logistic score over text features is fitted on at most ``FIT_ROWS`` labelled documents of one half of the labels (split
by a hash of doc_id). The other half is the holdout. For each stratum (language) a grid of fixed cutoffs is tested in
ascending order: cutoff c is certified if the exact binomial tail P[Bin(n, alpha) <= k] <= delta / strata, for k of the
stratum's n good holdout documents scoring below c (the upper Clopper-Pearson bound on the false rejection rate is then at
most alpha). Testing stops at the first failure (fixed sequence: no further correction inside a stratum) and delta is
split over the strata (Bonferroni). So with probability 1 - delta no stratum rejects more than alpha of its good
documents. Of the certified cutoffs the one with the most correct less false rejections in the holdout is used; the
smallest of equals. A stratum without enough labels certifies none and rejects nothing. Holdout counts cover all
labels, and every document is scored over its whole text.

Defined cases: a NULL text or one without words is rejected; a NULL language is a stratum of its own; a language that has no
holdout rejects nothing; labels with a NULL id or quality are left out; a document with several labels has the least; labels
without a document are left out; rows that share a doc_id are judged by their own text, and each counts as a labelled
document; other columns take no part and come out unchanged. Without labels of both kinds nothing is rejected but
word-less texts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gristmill.llm.common import likely_rows, packed, small_batches, unpacked, written
from gristmill.llm.grams import _bytes, chunks, words
from gristmill.llm.worker import tidied_stream

ALPHA = 0.05
DELTA = 0.05
#: The bound of the fitting sample; thresholds use every holdout label.
FIT_ROWS = 20_000
CUTOFFS = 200
FEATURES = ("words", "symbols", "exclamations", "capitals", "digits", "bars", "repeats", "distinct", "length", "stops")


def _classes() -> np.ndarray:
    c = np.zeros(256, np.uint8)
    for i, letters in enumerate(("#$%&*@^~<>{}[]\\=+_", "!", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "|", "."), 1):
        c[[ord(x) for x in letters]] = i
    return c


def features(texts: pa.Array) -> np.ndarray:
    """One row of FEATURES for each text; zeros for one without words."""
    out = np.zeros((len(texts), len(FEATURES)))
    classes = _classes()
    for a, z in chunks(texts):
        part = texts.slice(a, z - a)
        data, off = _bytes(part)
        h, bounds, start, end = words(part, lower=False)
        n = np.diff(bounds)
        some = np.flatnonzero(n)
        if not len(some):
            continue
        ink = np.add.reduceat(end - start, bounds[some])
        kind = classes[data]
        at = np.flatnonzero(kind)
        owner = np.searchsorted(off, at, side="right") - 1
        share = np.bincount(owner * 7 + kind[at], minlength=7 * len(n)).reshape(-1, 7)[some, 1:].T / ink
        text = np.repeat(np.arange(len(n)), n)
        same = np.zeros(len(h), np.int64)
        same[1:] = (h[1:] == h[:-1]) & (text[1:] == text[:-1])
        key = np.sort((text.astype(np.uint64) << np.uint64(40)) | (h >> np.uint64(24)))
        distinct = np.bincount((np.unique(key) >> np.uint64(40)).astype(np.int64), minlength=len(n))[some]
        k = n[some]
        out[a + some] = np.column_stack(
            [np.log1p(k), *share[:5], np.add.reduceat(same, bounds[some]) / k, np.log(k / distinct) / np.log(k + 1.0), ink / k / 10, share[5] * ink / k]
        )
    return out


def featured(df: DataFrame, name: str, keep_text: bool) -> DataFrame:
    """``df`` with the features of its column text as the array ``name``, behind its other columns."""
    rest = [c for c in df.columns if keep_text or c != "text"]
    schema = T.StructType([df.schema[c] for c in rest]).add(name, T.ArrayType(T.DoubleType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f = features(b.column("text"))
            lists = pa.ListArray.from_arrays(np.arange(len(f) + 1, dtype=np.int32) * len(FEATURES), pa.array(f.ravel()))
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in rest], lists], [*rest, name])

    return df.mapInArrow(tidied_stream(run), schema)


def _score(f: Column, model: tuple[np.ndarray, np.ndarray, np.ndarray]) -> Column:
    """``score`` as an expression over the array of features."""
    mean, scale, w = model
    z = F.lit(float(w[0]))
    for i in range(len(FEATURES)):
        z = z + (f.getItem(i) - F.lit(float(mean[i]))) / F.lit(float(scale[i])) * F.lit(float(w[i + 1]))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z))))


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, scale, weights with the intercept first) of a ridge logistic regression by Newton steps, classes weighted equally."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.column_stack([np.ones(len(x)), (x - mean) / scale])
    share = np.where(y == 1, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
    w = np.zeros(z.shape[1])
    penalty = ridge * np.eye(len(w))
    penalty[0, 0] = 1e-6
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (share * p * (1 - p))[:, None]).T @ z + penalty, z.T @ (share * (y - p)) - penalty @ w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return mean, scale, w


def score(f: np.ndarray, model: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    mean, scale, w = model
    return 1 / (1 + np.exp(-np.clip(w[0] + ((f - mean) / scale) @ w[1:], -30, 30)))


def binomial_cdf(k: int, n: int, p: float) -> float:
    """P[Bin(n, p) <= k] as the incomplete beta function I(1 - p; n - k, k + 1), by its continued fraction: no sum over k."""
    if k >= n:
        return 1.0
    a, b, x = n - k, k + 1, 1 - p
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return min(1.0, front * _fraction(a, b, x) / a)
    return max(0.0, 1 - front * _fraction(b, a, 1 - x) / b)


def _fraction(a: float, b: float, x: float) -> float:
    tiny = 1e-300
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or tiny)
    out = d
    for m in range(1, 100_000):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 / (1 + num * d or tiny), 1 + num / c or tiny
            out *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return out


def cutoffs(good: dict, bad: dict, alpha: float, delta: float, grid: int = CUTOFFS) -> dict:
    """stratum -> cutoff in [0, 1). good and bad: stratum -> counts of holdout documents in each of ``grid`` score bins."""
    found = {}
    for s, counts in good.items():
        n, below, rejected = int(sum(counts)), 0, 0
        best, gain = 0, 0
        for c in range(1, grid):
            below += int(counts[c - 1])
            rejected += int(bad.get(s, [0] * grid)[c - 1])
            if not n or binomial_cdf(below, n, alpha) > delta / len(good):
                break
            if rejected - below > gain:
                best, gain = c, rejected - below
        found[s] = best / grid
    return found


def calibrate(docs: DataFrame, labels: DataFrame, alpha: float, delta: float):
    """(model, {stratum: cutoff}), or (None, {}) where the labels have not both kinds."""
    small_batches(docs.sparkSession)
    y = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("quality").alias("q")).filter("doc_id IS NOT NULL AND q IS NOT NULL")
    y = written(y.groupBy("doc_id").agg(F.min("q").alias("y")), "quality-labels")
    # features of the labelled documents alone, in their own task: only ids and features are exchanged
    slim = likely_rows(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("lang").alias("s"), "text"), y, "doc_id")
    f = featured(slim, "f", False).join(y, "doc_id").filter("f[0] > 0")
    f = written(f.withColumn("half", F.pmod(F.xxhash64("doc_id"), F.lit(2))), "quality-features")
    sample = f.filter("half = 0").orderBy(F.xxhash64("doc_id", F.lit(7)), "f").limit(FIT_ROWS).select("f", "y").toArrow()
    target = sample["y"].to_numpy().astype(float)
    if len(set(target.tolist())) < 2:
        return None, {}
    model = fit(np.array(sample["f"].combine_chunks().values).reshape(-1, len(FEATURES)), target)

    bin_ = F.least(F.floor(_score(F.col("f"), model) * CUTOFFS), F.lit(CUTOFFS - 1)).cast("int")
    # strata x bins x 2 rows, however many documents there are
    counted = f.filter("half = 1").groupBy("s", bin_.alias("b"), "y").agg(F.count(F.lit(1)).alias("n")).collect()
    good: dict = {}
    bad: dict = {}
    for r in counted:
        good.setdefault(r.s, [0] * CUTOFFS)
        (good if r.y == 1 else bad).setdefault(r.s, [0] * CUTOFFS)[r.b] += r.n
    return model, cutoffs(good, bad, alpha, delta)


def _scored(docs: DataFrame, labels: DataFrame, alpha: float, delta: float, keep_text: bool = True) -> DataFrame:
    """The kept rows (without their text, if it isn't needed) as (row, score, cutoff)."""
    model, limits = calibrate(docs, labels, alpha, delta)
    name = "_features"
    while name in docs.columns:
        name += "_"
    f = F.col(name)
    judged = F.when(f.getItem(0) > 0, _score(f, model) if model is not None else F.lit(1.0)).otherwise(F.lit(-1.0))
    # a row a stratum that has labels
    cut = docs.sparkSession.createDataFrame([(k, float(v)) for k, v in limits.items()], "stratum string, cut double")
    d = packed(featured(docs, name, keep_text), score=judged, lang=F.col("lang").cast("string")).join(cut, F.col("lang").eqNullSafe(F.col("stratum")), "left")
    return d.select("row", "score", F.coalesce("cut", F.lit(0.0)).alias("cutoff")).filter("score >= cutoff")


def passing(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """(doc_id, lang, score, cutoff) of the documents that the rules keep."""
    return _scored(docs.select("doc_id", "lang", "text"), labels, alpha, delta, keep_text=False).select(F.col("row.doc_id").alias("doc_id"), F.col("row.lang").alias("lang"), "score", "cutoff")


def keep_quality(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """``docs`` without the documents that the rules reject."""
    return unpacked(_scored(docs, labels, alpha, delta), docs.columns)
