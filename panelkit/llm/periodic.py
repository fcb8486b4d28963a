"""Periodic runs of words, and texts with their repetitions collapsed.

A run is a stretch of words with smallest period ``q`` and at least
``max(min_words, exponent * q)`` words that neither neighbour extends.

* *Highly periodic regions.*  Periods up to ``SMALL`` are found directly: places
  where the word ``p`` further on is the same, joined to maximal stretches.
* *String synchronising sets.*  For each scale ``t`` (8, 16, 32, ...) every window
  of ``t`` words gets a hash; place ``i`` is selected if the least hash of the
  windows from ``i`` to ``i + t`` is that of the first or the last of them.
  Windows inside a region found before whose period is at most ``t / 4`` do not
  take part.  The choice depends on the ``2 t`` words from ``i`` on alone, and of
  any ``t`` neighbours one at least is selected unless ``3 t`` words have a
  period of at most ``t / 4``.
* *Proposals.*  A run of period ``q``, ``t <= q < 2 t``, of ``4 q`` words therefore
  holds a selected place whose ``2 t`` words return ``q`` further on, and (as
  ``2 t >= q`` and ``q`` is smallest) nowhere between.  So neighbours in the order
  (context, place) that lie ``t`` to ``2 t - 1`` apart propose all periods; each
  proposal is extended word by word in both directions and kept if it is long
  enough.  Two contexts that overlap so far are a square, so proposals are few.

All texts of a slice are handled together with numpy; a unique mark between
texts keeps runs inside one.  Words are compared by 64-bit hashes within a text.

Defined results: null and empty texts have no words and no runs; a null doc_id is
kept; repeated rows give equal rows; extra columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelkit.llm.spans import Words, mix64, ragged, slide, text_slices, windows

SMALL = 7
MIN_WORDS = 6
EXPONENT = 4
_TOP = np.uint64(0xFFFFFFFFFFFFFFFF)


def _marked(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The words of all texts with a mark of its own after each text."""
    n = len(first) - 1
    a = np.empty(len(h) + n, np.uint64)
    counts = np.diff(first)
    a[np.arange(len(h)) + np.repeat(np.arange(n), counts)] = h
    a[first[1:] + np.arange(n)] = mix64(np.arange(n, dtype=np.uint64) + np.uint64(0x1234567F00000000))
    return a


def _stretches(eq: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """First and past-last places of the stretches of true of at least ``least``."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], eq, [False]]).astype(np.int8)))
    a, z = edge[::2], edge[1::2]
    long = z - a >= least
    return a[long], z[long]


def _extent(a: np.ndarray, s: int, d: int) -> tuple[int, int]:
    """The stretch around ``s`` in which every word equals the one ``d`` further on
    (first place, past the last word of the stretch with period ``d``)."""
    lo, hi, step = s, s, 64
    while lo > 0:
        b = max(0, lo - step)
        diff = np.flatnonzero(a[b:lo] != a[b + d: lo + d])
        if len(diff):
            lo = b + int(diff[-1]) + 1
            break
        lo, step = b, 2 * step
    step, top = 64, len(a) - d
    while hi < top:
        b = min(top, hi + step)
        diff = np.flatnonzero(a[hi:b] != a[hi + d: b + d])
        if len(diff):
            hi += int(diff[0])
            break
        hi, step = b, 2 * step
    return lo, hi + d


def find_runs(h: np.ndarray, first: np.ndarray, exponent: int = EXPONENT) -> np.ndarray:
    """``(text, start, length, period)`` rows, in that order, of all stretches with smallest
    period ``q`` and at least ``exponent * q`` words (``exponent`` is 4 or more)."""
    if exponent < 4:
        raise ValueError("the scales cover runs of four periods or more")
    found = []
    a = _marked(h, first)
    begin = first[:-1] + np.arange(len(first) - 1)
    for p in range(1, SMALL + 1):
        lo, hi = _stretches(a[:-p] == a[p:], (EXPONENT - 1) * p)
        for b, e in zip(lo.tolist(), hi.tolist()):
            unit = a[b: b + p]
            if not any(p % r == 0 and (unit[r:] == unit[:-r]).all() for r in range(1, p)):
                t = int(np.searchsorted(begin, b, "right")) - 1
                found.append((t, b - int(begin[t]), e + p - b, p))
    counts = np.diff(first)
    t = SMALL + 1
    texts = np.arange(len(counts))
    while True:
        stay = counts[texts] >= EXPONENT * t
        if not stay.any():
            break
        if not stay.all():  # texts too short for this scale leave
            texts = texts[stay]
        own = counts[texts]
        b = np.append(0, np.cumsum(own))
        a = _marked(h[ragged(first[texts], own)], b)
        begin = b[:-1] + np.arange(len(own))
        place = np.full(len(counts), -1)
        place[texts] = begin
        found += _at_scale(a, t, begin, texts, [(int(place[x[0]]) + x[1], x[2], x[3]) for x in found if place[x[0]] >= 0])
        t *= 2
    out = np.array(sorted(x for x in found if x[2] >= exponent * x[3]), np.int64).reshape(-1, 4)
    return out[np.lexsort((out[:, 3], out[:, 1], out[:, 0]))]


def _at_scale(a: np.ndarray, t: int, begin: np.ndarray, texts: np.ndarray, known: list) -> list:
    ident = mix64(windows(a, t) ^ np.uint64(0x2545F4914F6CDD1D))
    ident[ident == _TOP] = np.uint64(0)
    periodic = np.zeros(len(ident) + 1, np.int32)
    for s, n, p in known:
        if 4 * p <= t <= n:
            periodic[s] += 1
            periodic[s + n - t + 1] -= 1
    ident[np.cumsum(periodic[:-1]) > 0] = _TOP
    low = slide(ident, t + 1, np.minimum)
    at = np.flatnonzero(((low == ident[: len(low)]) | (low == ident[t: t + len(low)])) & (low != _TOP))
    context = windows(a, 2 * t)
    at = at[at < len(context)]
    context = context[at]
    order = np.argsort(context, kind="stable")
    at, context = at[order], context[order]
    gap = at[1:] - at[:-1]
    pair = np.flatnonzero((context[1:] == context[:-1]) & (gap >= t) & (gap < 2 * t))
    out, end = [], {}
    for s, d in sorted(zip(at[pair].tolist(), gap[pair].tolist())):
        if s < end.get(d, -1) - d:
            continue
        lo, hi = _extent(a, s, d)
        end[d] = hi
        if hi - lo >= EXPONENT * d:
            x = int(np.searchsorted(begin, lo, "right")) - 1
            out.append((int(texts[x]), lo - int(begin[x]), hi - lo, d))
    return out


_OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()),
                  ("runs", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))),
                  ("collapsed", pa.string())])
_OUT_SQL = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


def _joined(w: Words, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The kept words of each text joined by one space, as bytes and offsets."""
    starts = w.starts[keep]
    lens = w.ends[keep] - starts + 1
    data = np.append(w.data, np.uint8(32))[ragged(starts, lens)]
    data[np.cumsum(lens) - 1] = 32
    per = np.append(0, np.cumsum(keep))[w.first]
    edge = np.append(0, np.cumsum(lens))[per]
    some = np.flatnonzero(np.diff(per) > 0)
    drop = np.zeros(len(data), bool)
    drop[edge[some + 1] - 1] = True  # no space after a text's last word
    off = edge - np.append(0, np.cumsum(np.diff(per) > 0))
    return data[~drop], off


def _runs(min_words: int, exponent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, d, o in text_slices(b.column(1)):
                w = Words(d, o)
                r = find_runs(w.hashes(), w.first, exponent)
                r = r[r[:, 2] >= min_words]
                mark = np.zeros(len(w.starts) + 1, np.int64)
                lo = w.first[r[:, 0]] + r[:, 1]
                np.add.at(mark, lo + r[:, 3], 1)
                np.add.at(mark, lo + r[:, 2], -1)
                data, off = _joined(w, np.cumsum(mark[:-1]) == 0)
                n_runs = np.append(0, np.cumsum(np.bincount(r[:, 0], minlength=j - i)))
                flat = pa.StructArray.from_arrays([pa.array(r[:, c]) for c in (1, 2, 3)], ["start", "length", "period"])
                text = pa.LargeStringArray.from_buffers(j - i, pa.py_buffer(off.astype(np.int64)), pa.py_buffer(data))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, j - i), pa.array(w.counts(), pa.int64()),
                     pa.ListArray.from_arrays(pa.array(n_runs, pa.int32()), flat), text.cast(pa.string())], schema=_OUT)
    return run


def periodic_runs(docs: DataFrame, min_words: int = MIN_WORDS, exponent: int = EXPONENT) -> DataFrame:
    """``(doc_id, n_words, runs, collapsed)``: the runs by start, then period, and the text without the
    words that any run holds after its first period."""
    return docs.select("doc_id", "text").mapInArrow(_runs(min_words, exponent), _OUT_SQL)


def plant(docs: DataFrame) -> DataFrame:
    """``(doc_id, text)`` with the contract's repetitions written into every tenth text by hash."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda x: x != "")
    rows = docs.select("doc_id", "text", h.alias("h")).withColumn("w", F.when(F.col("h") % 10 == 0, words))
    g = F.floor(F.col("h") / 10)
    n = F.size("w")
    a = g % n
    p = 1 + F.floor((n - a) / (3 + g % 8))
    changed = F.array_join(F.transform("w", lambda x, i: F.when(i < a, x).otherwise(
        F.get("w", (a + (i - a) % p).cast("int")))), " ")
    return rows.select("doc_id", F.when(n > 0, changed).otherwise(F.col("text")).alias("text"))


def digests(docs: DataFrame) -> DataFrame:
    """One row per document: number of runs, the longest one, and hashes of all runs and of the collapsed text."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(
        r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(
        F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]), F.lit("\n"))), "")
    rows = periodic_runs(docs).withColumn("best", best)
    period = -F.col("best.p")
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.s")).alias("start"),
        F.col("best.length").alias("length"), period.alias("period"),
        F.floor(1000 * F.col("best.length") / period).cast("long").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"))
