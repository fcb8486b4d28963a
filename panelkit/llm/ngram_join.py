"""N-gram Jaccard self-join with a size-aware heavy-light plan.

Sets are the distinct ``k``-word shingles of lower-cased texts; two texts link
when ``100 * |A and B| >= percent * |A or B|``.

1. *Tokens.*  One pass over the texts makes each text's set as 64-bit hashes
   and ships them as sorted blobs by token range: per range a task finds the
   tokens of two or more texts, with their document frequency, and sends only
   those back to the texts they came from.  A token of one text cannot link.
2. *Prefixes.*  Tokens are ordered by (frequency, hash).  Linked sets share a
   token among their first ``n - ceil(t n) + 1`` and two among one more.  A text
   whose prefix holds no shared token is done.
3. *Heavy and light.*  Small sets (up to a boundary ``x``) enumerate the
   2-subsets of their extended prefix; large ones, and those small ones that
   may link with them, enter inverted lists by single token.  ``x`` minimises
   the list entries plus the comparisons that scanning them takes, from a
   table of both by size class.  Lists are split by size band: a set probes the
   bands of smaller partners and is indexed in its own, in both cases only as
   far as its tokens after this one suffice for a link.
4. *Candidates.*  In every list all members are compared with three pivots.
   What links is merged into components.  Then every pair of a list whose
   components still differ is compared, except pairs inside a list's largest
   component, which are connected already.  So a list of n near copies costs
   O(n), and no link between components is missed.
5. *Check.*  Candidates intersect their shared tokens exactly.

Equal texts are one set from the start.  Defined results: texts without words
(null, empty) have 0 shingles and link with nothing, not even with their
copies; fewer than ``k`` words make one shingle; repeated rows are copies; a
component's id is its smallest doc_id, nulls last (null if all are null); extra
columns are ignored by ``near_duplicates`` and kept by ``keep_one``; an empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelkit.llm.bpe import each_slice
from panelkit.llm.components import components
from panelkit.llm.spans import Words, mix64, windows
from panelkit.llm.store import stored

K = 5
PERCENT = 75
RUN_TOKENS = 1 << 19
RUN_DOCS = 1 << 16
MIN_RANGES = 256
RANGE_TOKENS = 1 << 22
PIVOTS = 3
BANDS = 7.0  # size bands per unit of the logarithm: two for each step of 4/3
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_TOKENS = pa.schema([("part", pa.int32()), ("run", pa.int64()), ("tok", pa.binary()), ("top", pa.binary()),
                     ("slot", pa.binary()), ("doc_id", pa.list_(pa.int64())), ("n", pa.list_(pa.int32())),
                     ("h", pa.list_(pa.binary()))])
_TOKENS_SQL = ("part int, run long, tok binary, top binary, slot binary, doc_id array<long>, n array<int>, "
               "h array<binary>")


def shingle_sets(data: np.ndarray, off: np.ndarray, k: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text of a slice."""
    w = Words(_LOWER[data], off)
    h = w.hashes()
    win = windows(h, k)
    out = []
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist()):
        if b - a >= k:
            out.append(np.unique(win[a: b - k + 1]))
        elif b > a:
            out.append(mix64(windows(h[a:b], b - a) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _tokens(k: int, ranges: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        task, seq = TaskContext.get().partitionId(), 0
        sets, ids, size, hs, made = [], [], 0, [], {}

        def close() -> pa.RecordBatch:
            at = (task << 24) + seq
            rows = [{"part": -1 - at % ranges, "run": at, "doc_id": ids, "n": [len(s) for s in sets], "h": hs}]
            fresh = [i for i, x in enumerate(hs) if made.setdefault(x, i) == i]  # copies in one run ship once
            tok = np.concatenate([sets[i] for i in fresh]) if fresh else np.zeros(0, np.uint64)
            slot = np.repeat(np.array(fresh, np.uint16), [len(sets[i]) for i in fresh])
            part = (tok % np.uint64(ranges)).astype(np.int64)
            low = tok >> np.uint64(24)
            order = np.lexsort((low, part))
            part, low, slot = part[order], low[order], slot[order]
            edge = np.searchsorted(part, np.arange(ranges + 1))
            for p in np.flatnonzero(np.diff(edge)).tolist():
                a, b = edge[p], edge[p + 1]
                rows.append({"part": p, "run": at, "tok": low[a:b].astype("<u4").tobytes(),
                             "top": (low[a:b] >> np.uint64(32)).astype(np.uint8).tobytes(),
                             "slot": slot[a:b].astype("<u2").tobytes()})
            return pa.RecordBatch.from_pylist(rows, _TOKENS)

        for b in batches:
            names, texts = b.column(0).to_pylist(), b.column(1)
            for i, j, d, o in each_slice(b):
                raw = d.tobytes()
                for r, s in enumerate(shingle_sets(d, o, k)):
                    sets.append(s)
                    ids.append(names[i + r])
                    hs.append(hashlib.md5(raw[o[r]: o[r + 1]]).digest())
                    size += len(s)
                    if size >= RUN_TOKENS or len(sets) >= RUN_DOCS:
                        yield close()
                        seq, sets, ids, hs, made, size = seq + 1, [], [], [], {}, 0
        if sets:
            yield close()
    return run


_SHARED = pa.schema([("run", pa.int64()), ("slot", pa.binary()), ("tok", pa.binary()), ("df", pa.binary()),
                     ("doc_id", pa.list_(pa.int64())), ("n", pa.list_(pa.int32())), ("h", pa.list_(pa.binary()))])
_SHARED_SQL = "run long, slot binary, tok binary, df binary, doc_id array<long>, n array<int>, h array<binary>"


def _shared(t: pa.Table) -> pa.Table:
    """One token range: the tokens of two or more texts, back to their runs."""
    part = t.column("part")[0].as_py()
    if part < 0:
        none = pa.nulls(t.num_rows, pa.binary())
        return pa.Table.from_arrays([t.column("run"), none, none, none, t.column("doc_id"), t.column("n"),
                                     t.column("h")], schema=_SHARED)
    rows = t.select(["run", "tok", "top", "slot"]).to_pylist()
    tok = np.concatenate([np.frombuffer(r["tok"], "<u4").astype(np.int64)
                          | np.frombuffer(r["top"], np.uint8).astype(np.int64) << 32 for r in rows])
    slot = np.concatenate([np.frombuffer(r["slot"], "<u2") for r in rows])
    run = np.repeat(np.array([r["run"] for r in rows], np.int64), [len(r["slot"]) // 2 for r in rows])
    _, inv, n = np.unique(tok, return_inverse=True, return_counts=True)
    df = n[inv]
    keep = np.flatnonzero(df > 1)
    keep = keep[np.argsort(run[keep], kind="stable")]
    run, slot, df, tok = run[keep], slot[keep], df[keep], tok[keep] | part << 40
    runs, first = np.unique(run, return_index=True)
    edge = np.append(first, len(run))
    out = [{"run": r, "slot": slot[a:b].astype("<u2").tobytes(), "tok": tok[a:b].astype("<i8").tobytes(),
            "df": df[a:b].astype("<u4").tobytes()} for r, a, b in zip(runs.tolist(), edge[:-1], edge[1:])]
    return pa.Table.from_pylist(out, _SHARED)


_SETS = pa.schema([("rid", pa.int64()), ("doc_id", pa.int64()), ("h", pa.binary()), ("n", pa.int32()),
                   ("lead", pa.list_(pa.int64())), ("m1", pa.int32()), ("shared", pa.list_(pa.int64()))])
_SETS_SQL = "rid long, doc_id long, h binary, n int, lead array<long>, m1 int, shared array<long>"


def _needed(n: np.ndarray, percent: int) -> np.ndarray:
    return -(-percent * n // 100)


def _prefixes(percent: int):
    def run(t: pa.Table) -> pa.Table:
        rows = t.to_pylist()
        docs = next(r for r in rows if r["doc_id"] is not None)
        got = [r for r in rows if r["slot"] is not None]
        ids, n = docs["doc_id"], np.array(docs["n"], np.int64)
        base = docs["run"] << 16
        if got:
            slot = np.concatenate([np.frombuffer(r["slot"], "<u2") for r in got]).astype(np.int64)
            tok = np.concatenate([np.frombuffer(r["tok"], "<i8") for r in got])
            df = np.concatenate([np.frombuffer(r["df"], "<u4") for r in got])
            order = np.lexsort((tok, df, slot))
            slot, tok = slot[order], tok[order]
        else:
            slot, tok = np.zeros(0, np.int64), np.zeros(0, np.int64)
        edge = np.searchsorted(slot, np.arange(len(n) + 1))
        n_shared = np.diff(edge)
        m1 = n - _needed(n, percent) + 1 - (n - n_shared)  # shared tokens in the prefix
        lead, shared = [None] * len(n), [None] * len(n)
        for i in np.flatnonzero((m1 > 0) & (n_shared > 0)).tolist():
            own = tok[edge[i]: edge[i + 1]]
            lead[i], shared[i] = own[: m1[i] + 1], own
        return pa.Table.from_arrays(
            [pa.array(base + np.arange(len(n))), pa.array(ids, pa.int64()), pa.array(docs["h"], pa.binary()),
             pa.array(n, pa.int32()), pa.array(lead, pa.list_(pa.int64())), pa.array(np.maximum(m1, 0), pa.int32()),
             pa.array(shared, pa.list_(pa.int64()))], schema=_SETS)
    return run


def token_sets(docs: DataFrame, k: int = K, percent: int = PERCENT) -> DataFrame:
    """One row per text: ``(rid, doc_id, h, n, lead, m1, shared)``.  ``lead`` is the
    shared part of the extended prefix, its first ``m1`` entries that of the
    prefix; both are null where nothing can link."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(MIN_RANGES, min(1 << 22, size // 8 // RANGE_TOKENS))
    tokens = rows.mapInArrow(_tokens(k, ranges), _TOKENS_SQL)
    back = tokens.groupBy("part").applyInArrow(_shared, _SHARED_SQL)
    return stored(back.groupBy("run").applyInArrow(_prefixes(percent), _SETS_SQL), "token-sets")


def _boundary(sets: DataFrame) -> int:
    """The set size up to which 2-subsets cost less than list scans: a subset is
    one list entry; a token is one entry and its comparisons with pivots."""
    prefix = F.slice("lead", F.lit(1), F.col("m1"))
    entries = sets.select("rid", "n", F.explode(prefix).alias("t"))
    lists = entries.groupBy("t").agg(F.count(F.lit(1)).alias("len"))
    m = F.size("lead")
    step = F.ceil(F.log2("n") * 4).cast("int")
    scan = entries.join(lists, "t").groupBy(step.alias("s")).agg(
        F.sum(1 + F.least(F.col("len") - 1, F.lit(PIVOTS))).alias("scan"))
    subsets = sets.groupBy(step.alias("s")).agg(F.sum(m * (m - 1) / 2).alias("subsets"), F.max("n").alias("top"))
    table = sorted(subsets.join(scan, "s").collect(), key=lambda r: r.s)  # one row per size class, at most 4 x 31
    best, x, light = sum(r.scan for r in table), 1, 0.0
    for i, r in enumerate(table):
        light += r.subsets
        cost = light + sum(q.scan for q in table[i + 1:])
        if cost < best:
            best, x = cost, r.top
    return x


def _entries(sets: DataFrame, x: int, percent: int) -> DataFrame:
    """``(key, rid, n, p, cap)``: 2-subset entries of small sets, token entries of
    the others.  ``p`` is the place of the (last) token in the set's order and
    ``cap`` the most tokens the set can share with one it first meets here."""
    before = F.col("n") - F.size("shared")  # tokens of this text alone come first
    pairs = F.flatten(F.transform("lead", lambda a, i: F.transform(
        F.slice("lead", i + 2, F.size("lead")), lambda b, j: F.struct(
            F.xxhash64(a, b, F.lit("pair")).alias("key"), (before + i + j + 2).alias("p")))))
    single = F.transform(F.slice("lead", F.lit(1), F.col("m1")), lambda t, i: F.struct(
        F.xxhash64(t).alias("key"), (before + i + 1).alias("p")))
    small = sets.where((F.col("n") <= x) & (F.col("n") > 1)).select("rid", "n", F.explode(pairs).alias("e"), F.lit(2).alias("k"))
    large = sets.where((F.col("n") * 100 >= percent * (x + 1)) | (F.col("n") == 1)) \
        .select("rid", "n", F.explode(single).alias("e"), F.lit(1).alias("k"))
    return small.unionByName(large).select("e.key", "rid", "n", "e.p", (F.col("n") - F.col("e.p") + F.col("k")).alias("cap"))


def _band(n: Column) -> Column:
    return F.floor(F.log(n.cast("double")) * BANDS).cast("int")


def _lists(sets: DataFrame, x: int, percent: int) -> DataFrame:
    """``(key, band, rid, n, p, cap, idx)``: every entry probes the bands of the
    partners it may link with that are no larger than its own set, and is
    indexed (``idx``) in its own band if it may link with any that are no
    smaller.  A pair that links meets where the larger set probes."""
    low = F.ceil(F.col("n") * percent / 100)
    most = F.floor(F.col("cap") * (100 + percent) / percent) - F.col("n")  # largest partner that cap allows
    high = F.least(F.col("n"), most)
    rows = (_entries(sets, x, percent).withColumn("most", most).where(high >= low)
            .withColumn("band", F.explode(F.sequence(_band(low), _band(high))))
            .withColumn("idx", (F.col("most") >= F.col("n")) & (F.col("band") == _band(F.col("n")))).drop("most"))
    rows = stored(rows.select("key", "band", "rid", "n", "p", "cap", "idx"), "lists")
    many = rows.groupBy("key", "band").agg(F.count(F.lit(1)).alias("len"), F.max("idx").alias("any")) \
        .where((F.col("len") > 1) & F.col("any")).select("key", "band")
    return stored(rows.join(many, ["key", "band"]), "lists")


def _may(a: str, b: str, percent: int) -> Column:
    """Sizes and caps of two entries (structs or prefixes ending in a dot) allow a link."""
    n1, n2, c1, c2 = F.col(f"{a}n"), F.col(f"{b}n"), F.col(f"{a}cap"), F.col(f"{b}cap")
    return ((100 * F.least(n1, n2) >= percent * F.greatest(n1, n2))
            & (percent * (n1 + n2) <= (100 + percent) * F.least(c1, c2)))


def _links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs(u, v)`` that link, by exact intersection."""
    a = sets.select(F.col("rid").alias("u"), F.col("n").alias("nu"), F.col("shared").alias("su"))
    b = sets.select(F.col("rid").alias("v"), F.col("n").alias("nv"), F.col("shared").alias("sv"))
    both = F.size(F.array_intersect("su", "sv"))
    return (stored(pairs, "pairs").join(a, "u").join(b, "v")
            .where(100 * both >= percent * (F.col("nu") + F.col("nv") - both)).select("u", "v"))


def _labels(sets: DataFrame, links: DataFrame) -> DataFrame:
    found = components(links)
    return sets.select("rid").join(found.select(F.col("u").alias("rid"), "v"), "rid", "left") \
        .select("rid", F.coalesce("v", "rid").alias("label"))


def _pair(a: str, b: str) -> list[Column]:
    return [F.greatest(a, b).alias("u"), F.least(a, b).alias("v")]


def link_components(sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``(rid, label)`` for the rows of ``sets`` that may link; rows of one
    component have one label, their smallest rid."""
    lists = _lists(sets, _boundary(sets), percent)
    # pivots: the text with the fewest rarer tokens (in a group of near copies
    # that is the one the others stem from), and two by hash
    one = ["rid", "n", "cap"]
    order = [F.min(F.struct("p", F.xxhash64("rid").alias("o"), *one)).alias("p0")]
    order += [F.min(F.struct(F.lit(0).alias("p"), F.xxhash64("rid", F.lit(s)).alias("o"), *one)).alias(f"p{s}")
              for s in range(1, PIVOTS)]
    pivots = lists.where("idx").groupBy("key", "band").agg(*order).select(
        "key", "band", F.explode(F.array(*[f"p{s}" for s in range(PIVOTS)])).alias("v"))
    pairs = (lists.alias("a").join(pivots, ["key", "band"])
             .where((F.col("a.rid") != F.col("v.rid")) & _may("a.", "v.", percent))
             .select(*_pair("a.rid", "v.rid")).distinct())
    links = stored(_links(pairs, sets, percent), "links")
    labels = stored(_labels(sets, links), "labels")
    # every pair of a list whose labels differ still: what lies outside the
    # list's largest component against everything
    seen = stored(lists.join(labels, "rid"), "labelled-lists")
    sizes = seen.groupBy("key", "band", "label").agg(F.count(F.lit(1)).alias("c"))
    top = sizes.groupBy("key", "band").agg(F.max_by("label", F.struct("c", "label")).alias("top"),
                                           F.count(F.lit(1)).alias("kinds")).where(F.col("kinds") > 1)
    open_ = stored(seen.join(top, ["key", "band"]).withColumn("rest", F.col("label") != F.col("top"))
                   .drop("top", "kinds"), "open-lists")

    def cross(probe: DataFrame, index: DataFrame) -> DataFrame:
        larger = (F.col("x.n") > F.col("y.n")) | ((F.col("x.n") == F.col("y.n")) & (F.col("x.rid") > F.col("y.rid")))
        return (probe.alias("x").join(index.alias("y"), ["key", "band"])
                .where((F.col("x.label") != F.col("y.label")) & larger & _may("x.", "y.", percent))
                .select(*_pair("x.rid", "y.rid")))

    more = cross(open_.where("rest"), open_.where("idx")).unionByName(
        cross(open_.where("not rest"), open_.where("idx and rest"))).distinct()
    links = stored(links.unionByName(_links(more, sets, percent)), "links")
    return _labels(sets, links)


def _classes(docs: DataFrame, k: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """The rows of ``token_sets``, and ``(h, low, label)`` for each distinct text:
    its smallest doc_id and its component."""
    rows = token_sets(docs, k, percent)
    classes = stored(rows.groupBy("h").agg(F.min("rid").alias("rid"), F.min("doc_id").alias("low")), "classes")
    sets = stored(rows.where(F.col("lead").isNotNull()).join(classes.select("h", "rid"), ["h", "rid"], "left_semi")
                  .select("rid", "n", "lead", "m1", "shared"), "sets")
    labels = stored(link_components(sets, percent), "labels")
    return rows, classes.join(labels, "rid", "left").select("h", "low", F.coalesce("label", "rid").alias("label"))


def near_duplicates(docs: DataFrame, k: int = K, percent: int = PERCENT) -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` for each row of ``docs``."""
    rows, named = _classes(docs, k, percent)
    lowest = named.groupBy("label").agg(F.min("low").alias("component_id"))
    named = named.join(lowest, "label").select("h", "component_id")
    return rows.select("doc_id", "h", "n").join(named, "h").select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"),
        F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def keep_one(docs: DataFrame, k: int = K, percent: int = PERCENT) -> DataFrame:
    """One row of each component, all columns kept: the one with the smallest
    doc_id (nulls last), of several texts under that doc_id the one with the
    smallest hash, of rows equal in doc_id and text any one.  Rows without words
    all stay but for those equal in doc_id and text.  Rows without doc_id stay
    only where their whole component has none; doc_ids need not be unique."""
    rows, named = _classes(docs, k, percent)
    first = F.min(F.struct(F.col("low").isNull().alias("none"), F.col("low").alias("doc_id"), "h"))
    best = named.groupBy("label").agg(first.alias("r")).select(
        F.col("r.doc_id").alias("best_id"), F.col("r.h").alias("best_h"), F.lit(True).alias("best"))
    times = rows.groupBy("doc_id", "h").agg(F.count(F.lit(1)).alias("times"), F.max("n").alias("n"))
    keep = stored(times.join(best, (F.col("h") == F.col("best_h")) & F.col("doc_id").eqNullSafe(F.col("best_id")), "left")
                  .where((F.col("n") == 0) | F.col("best")).select("doc_id", "h", "times"), "kept")

    def rows_of(part: DataFrame) -> DataFrame:
        h = F.unhex(F.md5(F.coalesce(docs["text"], F.lit("")).cast("binary")))
        return docs.join(part, (h == part["h"]) & docs["doc_id"].eqNullSafe(part["doc_id"]), "left_semi")

    again = keep.where(F.col("times") > 1)
    if again.isEmpty():
        return rows_of(keep)
    return rows_of(keep.where(F.col("times") == 1)).unionByName(rows_of(again).dropDuplicates(["doc_id", "text"]))
