"""Ranked lexical search by pipelined term partitioning.

The terms of the query items are dealt to ``stages`` owners: bands of falling
weight with about equal work.  A bundle of items travels with a block of
documents through the owners one after the other; at each, a cogroup brings the
owner's posting lists of that block to the bundle, which adds their integer
contributions to its sparse accumulators.  After the last owner each block
gives its best documents per item, and the best of all blocks are selected.

* A *block* is up to ``BLOCK_DOCS`` documents that one map task read together, so
  a term that stands in every document has one short list per block, and no
  exchange forms the blocks.  Tokens are cut, hashed and counted with numpy; a
  fixed bitmap of the hashes of all query terms (``1 << BITS`` bits, however many
  terms there are) sorts out other words, and the join by term makes it exact.
* A *bundle* is about ``BUNDLE`` items; every (bundle, block) group is bounded.
* Between owners an accumulator goes only if it cannot win: its score and the
  most that the remaining owners can add lie below the score that ``top``
  documents of its block have reached already.  This loses no result.

Defined results: null and empty texts hold no term and count neither for N nor
for df; rows of ``docs`` are documents of their own, whatever their doc_id; an
item is all rows of ``items`` with one item_id (null is one), its terms are those
of all its texts; items without terms or matches return nothing; equal scores
go by doc_id, nulls last; extra columns are ignored; empty tables give an empty
result.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelkit.llm.spans import Words, span_hash, text_slices
from panelkit.llm.store import scratch, stored

TOP = 10
OWNERS = 4
BUNDLE = 256
BLOCK_DOCS = 4096
BLOCK_TOKENS = 1 << 21
BITS = 20
#: no posting adds more than its weight times this
MOST = 1_000_000
TERM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SEP = np.ones(256, bool)
_SEP[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def _bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for _, _, d, o in text_slices(b.column(0)):
            bit = np.unique(span_hash(d, o[:-1]) >> np.uint64(64 - BITS)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(bit)], ["bit"])


_POSTINGS = pa.schema([("block", pa.int64()), ("term", pa.string()), ("slot", pa.binary()), ("tf", pa.binary()),
                       ("doc_id", pa.list_(pa.int64())), ("n", pa.binary()), ("holding", pa.int64()),
                       ("tokens", pa.int64())])
_POSTINGS_SQL = "block long, term string, slot binary, tf binary, doc_id array<long>, n binary, holding long, tokens long"


class _Block:
    """The documents of one block and the query terms they hold."""

    def __init__(self, number: int):
        self.number, self.ids, self.n, self.parts, self.size = number, [], [], [], 0

    def add(self, ids: list, data: np.ndarray, off: np.ndarray, wanted: np.ndarray) -> None:
        w = Words(_LOWER[data], off, _SEP)
        h, check = span_hash(w.data, w.starts, w.inside, twice=True)
        at = np.flatnonzero(wanted[h >> np.uint64(64 - BITS)])
        slot = (w.doc_of_word()[at] + len(self.ids)).astype(np.uint16)
        h, check = h[at], check[at]
        order = np.lexsort((slot, check, h))
        h, check, slot = h[order], check[order], slot[order]
        fresh = np.ones(len(h), bool)
        fresh[1:] = (h[1:] != h[:-1]) | (check[1:] != check[:-1])
        first = np.flatnonzero(fresh)
        group = np.cumsum(fresh) - 1
        new = fresh.copy()
        new[1:] |= slot[1:] != slot[:-1]
        row = np.flatnonzero(new)
        tf = np.diff(np.append(row, len(h)))
        raw, ends = w.data.tobytes(), w.ends
        names = [raw[a:z] for a, z in zip(w.starts[at[order[first]]].tolist(), ends[at[order[first]]].tolist())]
        self.parts.append((names, group[row], slot[row], tf))
        self.ids += ids
        self.n.append(w.counts())
        self.size += len(at)

    def rows(self) -> pa.RecordBatch:
        n = np.concatenate(self.n)
        out = [{"block": self.number, "doc_id": self.ids, "n": n.astype("<i8").tobytes(),
                "holding": int((n > 0).sum()), "tokens": int(n.sum())}]
        lists: dict[bytes, list] = {}
        for names, group, slot, tf in self.parts:
            edge = np.searchsorted(group, np.arange(len(names) + 1))
            for name, a, z in zip(names, edge[:-1].tolist(), edge[1:].tolist()):
                lists.setdefault(name, []).append((slot[a:z], tf[a:z]))
        for name, got in lists.items():
            out.append({"block": self.number, "term": name.decode(),
                        "slot": np.concatenate([s for s, _ in got]).astype("<u2").tobytes(),
                        "tf": np.concatenate([t for _, t in got]).astype("<u4").tobytes()})
        return pa.RecordBatch.from_pylist(out, _POSTINGS)


def _blocks(wanted: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        number = TaskContext.get().partitionId() << 24
        block = _Block(number)
        for b in batches:
            ids = b.column(0).to_pylist()
            for i, j, d, o in text_slices(b.column(1)):
                at = 0
                while at < j - i:  # a block ends at BLOCK_DOCS documents, or after a slice that fills it
                    k = min(j - i, at + BLOCK_DOCS - len(block.ids))
                    block.add(ids[i + at: i + k], d[o[at]: o[k]], o[at: k + 1] - o[at], wanted)
                    at = k
                    if len(block.ids) >= BLOCK_DOCS or block.size >= BLOCK_TOKENS:
                        yield block.rows()
                        number += 1
                        block = _Block(number)
        if block.ids:
            yield block.rows()
    return run


_STATE = pa.schema([("bundle", pa.int32()), ("block", pa.int64()), ("doc_id", pa.list_(pa.int64())), ("n", pa.binary()),
                    ("rest", pa.list_(pa.int64())), ("cell", pa.binary()), ("score", pa.binary())])
_STATE_SQL = "bundle int, block long, doc_id array<long>, n binary, rest array<long>, cell binary, score binary"
_FOUND = pa.schema([("bundle", pa.int32()), ("idx", pa.int32()), ("doc_id", pa.int64()), ("score", pa.int64())])
_FOUND_SQL = "bundle int, idx int, doc_id long, score long"


def _owner(stage: int, owners: int, n_docs: int, n_tokens: int, top: int):
    """One stop of a bundle: add the owner's lists, drop what cannot win; the last stop selects."""
    last = stage == owners - 1

    def run(state: pa.Table, lists: pa.Table) -> pa.Table:
        if not state.num_rows:
            return (_FOUND if last else _STATE).empty_table()
        s = state.to_pylist()[0]
        ids = s["doc_id"]
        rest = np.array(s["rest"], np.int64).reshape(owners, -1)
        m = 10 + (90 * np.frombuffer(s["n"], "<i8") * n_docs) // n_tokens
        score = np.zeros((rest.shape[1], len(ids)), np.int64)
        if s["cell"]:
            score.reshape(-1)[np.frombuffer(s["cell"], "<u4")] = np.frombuffer(s["score"], "<i8")
        cols = [lists.column(c).to_pylist() for c in ("w", "items", "slot", "tf")]
        for w, items, slot, tf in zip(*cols):
            at, tf = np.frombuffer(slot, "<u2").astype(np.int64), np.frombuffer(tf, "<u4").astype(np.int64)
            add = w * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[at]))
            for i in items:
                score[i, at] += add
        bar = np.zeros(len(score), np.int64)
        if len(ids) >= top:
            bar = np.partition(score, len(ids) - top, axis=1)[:, len(ids) - top]
        keep = (score > 0) & (score + MOST * rest[stage][:, None] >= bar[:, None])
        if not last:
            cell = np.flatnonzero(keep.reshape(-1))
            s["cell"], s["score"] = cell.astype("<u4").tobytes(), score.reshape(-1)[cell].astype("<i8").tobytes()
            return pa.Table.from_pylist([s], _STATE)
        idx, slot = np.nonzero(keep)
        got = score[idx, slot]
        none = np.array([x is None for x in ids])[slot]
        name = np.array([x or 0 for x in ids], np.int64)[slot]
        order = np.lexsort((name, none, -got, idx))
        idx, got, none, name = idx[order], got[order], none[order], name[order]
        place = np.arange(len(idx)) - np.searchsorted(idx, idx)
        best = place < top
        return pa.Table.from_arrays(
            [pa.array(np.full(best.sum(), s["bundle"]), pa.int32()), pa.array(idx[best], pa.int32()),
             pa.array(name[best], pa.int64(), mask=none[best]), pa.array(got[best], pa.int64())], schema=_FOUND)
    return run


def _cuts(work: list, owners: int) -> list[int]:
    """Weights below which the next owner begins: bands of about equal work, heaviest first."""
    total, run, cuts = sum(r.work for r in work), 0, []
    for r in sorted(work, key=lambda r: -r.w):
        if len(cuts) < owners - 1 and run >= total * (len(cuts) + 1) / owners:
            cuts.append(r.w + 1)
        run += r.work
    return cuts


def search(docs: DataFrame, items: DataFrame, top: int = TOP, owners: int = OWNERS) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the ``top`` documents of each item."""
    spark = docs.sparkSession
    lower = F.translate(F.coalesce("text", F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    terms = items.select("item_id", F.explode(F.array_distinct(F.regexp_extract_all(lower, F.lit(TERM), F.lit(0)))).alias("term"))
    terms = stored(terms.distinct(), "query-terms")
    known = terms.select("item_id").distinct()
    bundles = max(1, -(-known.count() // BUNDLE))
    known = known.withColumn("bundle", F.pmod(F.xxhash64("item_id"), F.lit(bundles)).cast("int"))
    known = stored(known.withColumn("idx", F.row_number().over(Window.partitionBy("bundle").orderBy("item_id")) - 1), "items")
    bits = terms.select("term").distinct().mapInArrow(_bits, "bit long").distinct().toPandas()["bit"]  # at most 1 << BITS
    wanted = np.zeros(1 << BITS, bool)
    wanted[bits.to_numpy(np.int64)] = True

    postings = stored(docs.select("doc_id", "text").mapInArrow(_blocks(wanted), _POSTINGS_SQL), "postings")
    blocks, lists = postings.where("term is null"), postings.where("term is not null").select("block", "term", "slot", "tf")
    total = blocks.agg(F.sum("holding"), F.sum("tokens")).first()
    n_docs, n_tokens = total[0] or 0, max(total[1] or 0, 1)
    df = lists.groupBy("term").agg(F.sum(F.octet_length("slot") / 2).cast("long").alias("df"))
    w = F.floor(1000 * F.log((2.0 * n_docs + 2) / (2 * F.col("df") + 1)))
    uses = terms.join(known, terms["item_id"].eqNullSafe(known["item_id"])).select("term", "bundle", "idx")
    uses = stored(uses.join(df.select("term", "df", w.alias("w")), "term").where("w > 0"), "uses")
    # a weight is below 1000 * ln(2 N + 2), so this table has at most some 40 000 rows
    cuts = _cuts(uses.groupBy("w").agg(F.sum("df").alias("work")).collect(), owners)
    owner = sum((F.when(F.col("w") < c, 1).otherwise(0) for c in cuts), F.lit(0))
    uses = uses.withColumn("owner", owner.cast("int"))

    own = uses.groupBy("bundle", "term", "w", "owner").agg(F.collect_list("idx").alias("items"))
    path = scratch(spark, "owners")
    lists.join(own, "term").select("bundle", "block", "owner", "w", "items", "slot", "tf") \
        .write.partitionBy("owner").parquet(path)
    mine = spark.read.schema("bundle int, block long, w long, items array<int>, slot binary, tf binary, owner int").parquet(path)
    left = [F.coalesce(F.sum(F.when(F.col("owner") > s, F.col("w"))), F.lit(0)).alias(f"r{s}") for s in range(owners)]
    rest = known.select("bundle", "idx").join(uses.select("bundle", "idx", "owner", "w"), ["bundle", "idx"], "left") \
        .groupBy("bundle", "idx").agg(*left)
    rest = rest.groupBy("bundle").agg(F.sort_array(F.collect_list(F.struct("idx", *[f"r{s}" for s in range(owners)]))).alias("x"))
    rest = stored(rest.select("bundle", F.flatten(F.array(*[F.col(f"x.r{s}") for s in range(owners)])).alias("rest")), "rest")

    state = blocks.select(F.explode(F.sequence(F.lit(0), F.lit(bundles - 1))).alias("bundle"), "block", "doc_id", "n") \
        .join(rest, "bundle").select("bundle", "block", "doc_id", "n", "rest", F.lit(None).cast("binary").alias("cell"),
                                     F.lit(None).cast("binary").alias("score"))
    for s in range(owners):
        part = mine.where(F.col("owner") == s).drop("owner")
        state = state.groupBy("bundle", "block").cogroup(part.groupBy("bundle", "block")).applyInArrow(
            _owner(s, owners, n_docs, n_tokens, top), _FOUND_SQL if s == owners - 1 else _STATE_SQL)
    order = Window.partitionBy("bundle", "idx").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    best = state.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return best.join(known, ["bundle", "idx"]).select("item_id", "rank", "doc_id", "score")
