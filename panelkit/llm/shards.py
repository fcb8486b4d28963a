"""Vector bin packing of documents into shards.

Every group (equal texts) is a vector (bytes, tokens, rows); tokens are counted by a
tokenizer.  The law is
``bytes``: shard sizes come out near equal, and among the shards that still
have room in bytes a group goes where the dot product of its vector with the
residual capacities is highest, so tokens and rows are balanced as well.

What reaches the driver is bounded.  Groups are summed by cells (by hash of the
text; ``cells_per_shard`` a shard, more with the root of the number of groups up to
``MAX_CELLS``), and cells are packed, not single groups: a cell holds whole groups
and is a small part of a shard; a group that is heavier than a shard's
``1 / split`` in any dimension leaves its cell and is cut into pieces by a hash
of the row's number, which is written once with the rows, so rows that share a
doc_id spread too (at most 3 x split x shards such groups exist).  The driver packs
these bounded items; rows then look up their cell's or piece's shard.

Defined results: null or empty text has size ``overhead`` and 0 tokens; null
doc_id and repeated rows are kept, each with a slot of its own; extra columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelkit.llm.bpe import each_slice, encoder
from panelkit.llm.store import stored

CELLS_PER_SHARD = 256
SPLIT = 32
OVERHEAD = 16
MAX_CELLS = 4096
FILE_ROWS, FILES = 1 << 16, 64  # rows of neighbouring slots in one file, and the most files of a shard
#: share of a shard by which levelling may move tokens or rows beyond their present extremes
SLACK = 0.05


def pack(items: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each item; ``items`` is n x 3 (bytes, tokens, rows).

    Heaviest items first.  An item goes to the shard with the highest dot
    product of item and residual capacity (all in shares of one shard) among
    the shards where it fits in every dimension; if there is none, among those
    where its bytes fit; if there is none either, to the shard with most room
    in bytes."""
    total = items.sum(0).astype(float)
    cap = np.where(total > 0, total / shards, 1.0)
    v = items / cap
    left = np.ones((shards, items.shape[1]))
    out = np.zeros(len(items), np.int64)
    for i in np.lexsort((np.arange(len(items)), -v.max(1))):
        fits = (left >= v[i]).all(1)
        if not fits.any():
            fits = left[:, 0] >= min(v[i, 0], left[:, 0].max())
        dot = left @ v[i]
        dot[~fits] = -np.inf
        s = int(np.argmax(dot))
        out[i] = s
        left[s] -= v[i]
    return _level(v, out, shards)


def _level(v: np.ndarray, where: np.ndarray, shards: int) -> np.ndarray:
    """Move an item from the shard with most bytes to the one with least, or swap two, while
    that brings them closer and leaves the spread of tokens and rows as it is (or within
    ``SLACK`` of their mean); the packing leaves little to do.  ``v`` is in shares of a shard."""
    total = np.stack([np.bincount(where, c, shards) for c in v.T], 1)
    for _ in range(40 * shards):
        hi, lo = int(total[:, 0].argmax()), int(total[:, 0].argmin())
        gap = total[hi, 0] - total[lo, 0]
        if gap <= 1e-3:
            break
        mean = total.mean(0)
        top, low = np.maximum(total.max(0), mean + SLACK), np.minimum(total.min(0), mean - SLACK)
        mine, other = np.flatnonzero(where == hi), np.flatnonzero(where == lo)
        # a move is a swap with nothing; of lo's items the one whose size leaves half the gap
        other = np.append(other[np.argsort(v[other, 0], kind="stable")], -1)
        weight = np.vstack([v, np.zeros(v.shape[1])])
        near = np.searchsorted(weight[other[:-1], 0], weight[mine, 0] - gap / 2)
        pairs = [(mine, np.full(len(mine), -1))]
        pairs += [(mine, other[np.clip(near - k, 0, len(other) - 2)]) for k in (0, 1) if len(other) > 1]
        i, j = (np.concatenate(x) for x in zip(*pairs))
        d = weight[i] - weight[j]
        gain = np.minimum(d[:, 0], gap - d[:, 0])
        fair = (total[lo, 1:] + d[:, 1:] <= top[1:]).all(1) & (total[hi, 1:] - d[:, 1:] >= low[1:]).all(1)
        fair &= (total[hi, 1:] - d[:, 1:] <= top[1:]).all(1) & (total[lo, 1:] + d[:, 1:] >= low[1:]).all(1)
        gain[~fair] = -1
        best = int(gain.argmax()) if len(gain) else -1
        if best < 0 or gain[best] <= 0.01 * gap:
            break
        where[i[best]] = lo
        if j[best] >= 0:
            where[j[best]] = hi
        total[hi] -= d[best]
        total[lo] += d[best]
    return where


def _measured(tokenizer: str):
    """``(at, text)`` -> the sizes and hashes of each text; tokens as the library counts them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for b in batches:
            n = [enc.counts(d, o) for _, _, d, o in each_slice(b)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(np.concatenate(n) if n else [], pa.int64())],
                                             names=[*b.schema.names[:-1], "tokens"])
    return run


def shard_plan(docs: DataFrame, shards: int = 40, cells_per_shard: int = CELLS_PER_SHARD, split: int = SPLIT,
               overhead: int = OVERHEAD, tokenizer: str = "byte_bpe_50k.json") -> DataFrame:
    """``(doc_id, size, text_crc32, law, shard, slot, grown_shard)`` for each row."""
    return _plan(docs.select("doc_id", "text", F.monotonically_increasing_id().alias("at")), shards, cells_per_shard, split,
                 overhead, tokenizer).drop("at")


def _plan(docs: DataFrame, shards: int, cells_per_shard: int, split: int, overhead: int, tokenizer: str) -> DataFrame:
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    rows = stored(docs.select(
        "doc_id", (F.octet_length(text) + overhead).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("g"), F.octet_length(text).alias("n"), "at", text.alias("text")).mapInArrow(
        _measured(tokenizer), "doc_id long, size long, text_crc32 long, g long, n int, at long, tokens long"), "shard-rows")
    sums = [F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("rows")]
    groups = stored(rows.groupBy("g", "n").agg(*sums), "shard-groups")
    *total, n_groups = groups.agg(*[F.sum(c) for c in ("size", "tokens", "rows")], F.count(F.lit(1))).first()
    # cells grow with the root of the number of groups, up to MAX_CELLS a shard
    cells = shards * min(MAX_CELLS, max(cells_per_shard, math.isqrt(n_groups) // 4))
    heavy: Column = F.lit(False)
    weight: Column = F.lit(0.0)
    for name, t in zip(("size", "tokens", "rows"), total):
        share = F.col(name) * shards * split / F.lit(float(t or 1))
        heavy = heavy | (share > 1)
        weight = F.greatest(weight, share)
    hot = groups.where(heavy).select("g", "n", F.ceil(weight).cast("int").alias("pieces"))
    cell = F.pmod(F.xxhash64("g", F.lit(1)), F.lit(cells)).cast("int")
    placed = (rows.join(hot, ["g", "n"], "left")
              .withColumn("cell", F.when(F.col("pieces").isNull(), cell))
              .withColumn("piece", F.when(F.col("pieces").isNotNull(),
                                          F.pmod(F.xxhash64("at", F.lit(2)), F.col("pieces")).cast("int")))
              .withColumn("hg", F.when(F.col("pieces").isNotNull(), F.col("g")))
              .withColumn("hn", F.when(F.col("pieces").isNotNull(), F.col("n"))))
    item = ["cell", "hg", "hn", "piece"]
    # at most cells + 3 * split * shards * 2 rows, whatever the corpus holds
    got = placed.groupBy(*item).agg(*sums).orderBy(*item).collect()
    v = np.array([[r["size"], r["tokens"], r["rows"]] for r in got], np.int64).reshape(-1, 3)
    where = pack(v, shards)
    first = np.zeros(len(got), np.int64)
    for s in range(shards):
        at = np.flatnonzero(where == s)
        first[at] = np.cumsum(v[at, 2]) - v[at, 2]
    plan = spark.createDataFrame(
        [(r["cell"], r["hg"], r["hn"], r["piece"], int(s), int(f)) for r, s, f in zip(got, where, first)],
        "c int, h long, m int, p int, shard int, first long")
    w = Window.partitionBy(*item).orderBy("doc_id", "text_crc32", "at")
    numbered = placed.withColumn("rn", F.row_number().over(w) - 1)
    same = (F.col("cell").eqNullSafe(F.col("c")) & F.col("hg").eqNullSafe(F.col("h"))
            & F.col("hn").eqNullSafe(F.col("m")) & F.col("piece").eqNullSafe(F.col("p")))
    return numbered.join(plan, same).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("first") + F.col("rn")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "at")


def write_shards(docs: DataFrame, path: str, shards: int = 40, cells_per_shard: int = CELLS_PER_SHARD, split: int = SPLIT,
                 overhead: int = OVERHEAD, tokenizer: str = "byte_bpe_50k.json") -> None:
    """Write every row of ``docs`` (all its columns) as one folder ``shard=k`` per shard, ordered by slot
    in each file.  Rows are numbered and written once before, so NULL and repeated doc_ids keep
    their own places; ``docs`` must have no column ``shard``."""
    if "shard" in [c.lower() for c in docs.columns]:
        raise ValueError("the folders' column is named shard")
    at, slot = (f"{c}_{uuid.uuid4().hex}" for c in ("at", "slot"))
    rows = stored(docs.withColumn(at, F.monotonically_increasing_id()), "numbered-rows")
    plan = _plan(rows.select("doc_id", "text", F.col(at).alias("at")), shards, cells_per_shard, split, overhead, tokenizer)
    plan = plan.select(F.col("at").alias(at), "shard", F.col("slot").alias(slot))
    (rows.join(plan, at).repartition("shard", F.pmod(F.xxhash64(F.floor(F.col(slot) / FILE_ROWS)), F.lit(FILES)))
     .sortWithinPartitions("shard", slot).drop(at, slot).write.partitionBy("shard").parquet(path))
