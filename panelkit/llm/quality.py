"""Quality classifier on document statistics.

Random Fourier features ``sqrt(2 / D) cos(W x + b)`` approximate a Gaussian
kernel over standardised text statistics.  The normal equations are summed
inside the partitions (D x D numbers each, whatever the rows), reduced in a
fixed number of groups and solved as a ridge regression on the driver.  Scores
are calibrated by isotonic regression over score bins that rows outside the
ridge fit fill.

Rows with ``crc32(doc_id) mod 3 = 1`` are held out of everything learned.  Of
the others every fourth (by the same checksum) calibrates, the rest fit.
Inputs of a score are statistics of the text alone.

Defined results: null and empty texts are scored from all-zero counts; rows
without doc_id are scored and never learned from; labels other than 0 and 1 are
ignored; repeated rows count as often as they occur; without labels of both
classes every score is the share of label 1 (0.5 without any); extra columns
are ignored by ``scores`` and kept by ``keep_good``; an empty table gives an
empty result.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelkit.llm.bpe import each_slice
from panelkit.llm.line_rules import measures
from panelkit.llm.spans import Words, mix64
from panelkit.llm.store import stored

FEATURES = 256
RIDGE = 1e-4
BANDWIDTH = 3.0
SEED = 7
BINS = 2048
LOW, HIGH = -0.5, 1.5
CLIP = 5.0
_GROUPS = 16
STATS = ("log_words", "word_len", "upper", "digits", "symbols", "bang", "bars", "signs", "odd_ends", "lines",
         "distinct", "repeats", "dup_lines", "wide", "short", "lost")


def statistics(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """``n x len(STATS)`` statistics of the texts of a slice."""
    m = measures(data, off)
    w = Words(data, off)
    words = np.maximum(m["n_words"], 1)
    chars = np.maximum(m["word_chars"], 1)

    def share(flags: np.ndarray, of: np.ndarray) -> np.ndarray:
        return np.diff(np.append(0, np.cumsum(flags, dtype=np.int64))[off]) / of

    upper = (data >= 65) & (data <= 90)
    sign = ((data > 32) & (data < 48)) | ((data > 57) & (data < 65)) | ((data > 90) & (data < 97)) | (
        (data > 122) & (data < 127))
    lens = w.ends - w.starts
    last = data[w.ends - 1] if len(lens) else np.zeros(0, np.uint8)
    odd = np.isin(last, np.frombuffer(b"!#*$%&|<>", np.uint8))
    lone = (lens == 1) & (last == 0x7C)

    def by_word(flags: np.ndarray) -> np.ndarray:
        return np.diff(np.append(0, np.cumsum(flags, dtype=np.int64))[w.first]) / words

    doc = w.doc_of_word()
    first = np.zeros(len(lens), bool)
    first[np.unique(mix64(w.hashes() + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)),
                    return_index=True)[1]] = True
    lines = np.maximum(share(data == 10, 1.0), 0)
    return np.stack([
        np.log1p(m["n_words"]), m["word_chars"] / words, share(upper, chars), share((data >= 48) & (data <= 57), chars),
        m["n_symbols"] / chars, share(data == 33, chars), by_word(lone), share(sign, chars), by_word(odd),
        np.log1p(lines) - np.log1p(m["n_words"]), by_word(first), m["n_repeat_words"] / words,
        m["n_dup_lines"] / (lines + 1), share(data >= 0xC0, chars), by_word(lens <= 3),
        m["noise_chars"] / chars], 1).astype(np.float64)


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray | None
    edges: np.ndarray
    levels: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        rng = np.random.default_rng(SEED)
        w = rng.normal(0, 1 / BANDWIDTH, (x.shape[1], FEATURES))
        b = rng.uniform(0, 2 * np.pi, FEATURES)
        z = np.clip((x - self.mean) / self.scale, -CLIP, CLIP)
        return np.hstack([np.ones((len(x), 1)), np.sqrt(2 / FEATURES) * np.cos(z @ w + b)])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(x), self.levels[0])
        return np.clip(np.interp(self.raw(x), self.edges, self.levels), 0.0, 1.0)


def _checksum() -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary"))


def held_out() -> Column:
    """Rows (by their ``doc_id``) nothing is learned from."""
    return F.coalesce(_checksum() % 3 == 1, F.lit(False))


def _stats_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i, j, d, o in each_slice(b):
            x = statistics(d, o)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).slice(i, j - i), pa.FixedSizeListArray.from_arrays(x.ravel(), x.shape[1]).cast(
                    pa.list_(pa.float64()))], names=["doc_id", "x"])


def document_statistics(docs: DataFrame) -> DataFrame:
    """``(doc_id, x array<double>)`` for each row."""
    return docs.select("doc_id", "text").mapInArrow(_stats_of, "doc_id long, x array<double>")


def _rows(b: pa.RecordBatch, name: str = "x") -> np.ndarray:
    col = b.column(b.schema.get_field_index(name))
    return np.asarray(col.flatten()).reshape(len(col), -1) if len(col) else np.zeros((0, len(STATS)))


def _summed(rows: DataFrame, part: Callable[[np.ndarray, np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """Sum of ``part(x, y)`` over all batches: one row of ``size`` numbers per
    partition, then ``_GROUPS`` rows, then the driver."""
    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        total = np.zeros(size)
        for b in batches:
            if b.num_rows:
                total += part(_rows(b), np.asarray(b.column(b.schema.get_field_index("y")), float))
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % _GROUPS], pa.int32()),
                                          pa.array([total.tobytes()], pa.binary())], names=["g", "s"])

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for g, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                sums[g] = sums.get(g, 0) + np.frombuffer(s)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()),
                                          pa.array([v.tobytes() for v in sums.values()], pa.binary())],
                                         names=["g", "s"])

    kind = "g int, s binary"
    got = rows.mapInArrow(inside, kind).repartition(_GROUPS, "g").mapInArrow(across, kind).collect()
    return sum((np.frombuffer(r.s) for r in got), np.zeros(size))


def isotonic(weight: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Non-decreasing means of blocks (pool adjacent violators)."""
    level, mass, span = [], [], []
    for w, t in zip(weight, total):
        level.append(t / w)
        mass.append(w)
        span.append(1)
        while len(level) > 1 and level[-2] >= level[-1]:
            w2 = mass[-2] + mass[-1]
            level[-2] = (level[-2] * mass[-2] + level[-1] * mass[-1]) / w2
            mass[-2] = w2
            span[-2] += span[-1]
            level.pop(), mass.pop(), span.pop()
    return np.repeat(level, span)


def fit(stats: DataFrame, labels: DataFrame) -> Model:
    """Learn from ``stats(doc_id, x)`` and ``labels(doc_id, quality)``."""
    known = labels.select("doc_id", F.col("quality").cast("double").alias("y")).where(F.col("y").isin(0.0, 1.0))
    rows = stored(stats.where(~held_out()).join(known.where(~held_out()), "doc_id")
                  .select("x", "y", ((_checksum() / 3).cast("long") % 4 == 0).alias("cal")), "quality-train")
    p = len(STATS)
    s = _summed(rows, lambda x, y: np.concatenate([[len(y), y.sum()], x.sum(0), (x * x).sum(0)]), 2 + 2 * p)
    n, pos = s[0], s[1]
    if not 0 < pos < n:
        return Model(np.zeros(p), np.ones(p), None, np.zeros(1), np.array([pos / n if n else 0.5]))
    mean = s[2:2 + p] / n
    scale = np.sqrt(np.maximum(s[2 + p:] / n - mean ** 2, 1e-12))
    model = Model(mean, scale, None, np.zeros(1), np.zeros(1))
    d = FEATURES + 1

    def normal(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        z = model.features(x)
        return np.concatenate([(z.T @ z).ravel(), z.T @ y, [len(y)]])

    fit_rows = rows.where(~F.col("cal"))
    cal_rows = rows.where(F.col("cal"))
    if fit_rows.isEmpty() or cal_rows.isEmpty():
        fit_rows = cal_rows = rows
    s = _summed(fit_rows, normal, d * d + d + 1)
    a = s[: d * d].reshape(d, d) + RIDGE * s[-1] * np.diag(np.append(0.0, np.ones(FEATURES)))
    weights = np.linalg.lstsq(a, s[d * d: -1], rcond=None)[0]
    model.weights = weights

    def binned(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        k = np.clip(((model.raw(x) - LOW) / (HIGH - LOW) * BINS).astype(int), 0, BINS - 1)
        return np.concatenate([np.bincount(k, minlength=BINS), np.bincount(k, y, minlength=BINS)])

    s = _summed(cal_rows, binned, 2 * BINS)
    seen = np.flatnonzero(s[:BINS])
    model.edges = LOW + (seen + 0.5) / BINS * (HIGH - LOW)
    model.levels = isotonic(s[seen], s[BINS + seen])
    return model


def scores(stats: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for each row of statistics."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = model.score(_rows(b))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(p, pa.float64()), pa.array((p >= 0.5).astype(np.int32))],
                names=["doc_id", "score", "predicted"])
    return (stats.select("doc_id", "x").mapInArrow(run, "doc_id long, score double, predicted int")
            .select("doc_id", held_out().alias("held_out"), "score", "predicted"))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Fit on the labelled rows of ``docs`` and score every row."""
    stats = stored(document_statistics(docs), "quality-stats")
    return scores(stats, fit(stats, labels))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose score is 0.5 or more, all columns kept.  The
    statistics are worked out once: written with the rows, they train the model and are scored."""
    x = f"x_{uuid.uuid4().hex}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, d, o in each_slice(b):
                yield b.slice(i, j - i).append_column(x, pa.array(list(statistics(d, o)), pa.list_(pa.float64())))

    rows = stored(docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(x, T.ArrayType(T.DoubleType()))])),
                  "quality-rows", compression="zstd")
    model = fit(rows.select("doc_id", F.col(x).alias("x")), labels)

    @F.pandas_udf("boolean")
    def good(v: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.stack(v.to_list())) >= 0.5) if len(v) else pd.Series([], dtype=bool)

    return rows.where(good(x)).drop(x)
