"""Token counts with overlap resynchronisation for huge documents.

A document of more than ``chunk_bytes`` is cut into chunks that any task may
encode, each reaching ``overlap_bytes`` into its right neighbour.  Both sides of
an overlap report the forced boundaries strictly inside it, with the number of
ids before each and a running checksum of the ids between them.  A boundary
that both report is proven stable: neither the text before the right chunk nor
that after the left one has a say in it.  The documents are spliced at the first
such boundary, and every other common one must agree on ids and checksums.

Where an overlap holds fewer than two common boundaries, or they disagree, only
the two chunks beside it are encoded again, with an overlap eight times as wide;
once that would exceed a chunk, the two become one.

Each distinct long text is encoded once.  Defined results: null or empty text
has 0 bytes and 0 tokens; repeated rows are counted row by row; null doc_id is
kept; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelkit.llm.bpe import each_slice, encoder
from panelkit.llm.spans import mix64, text_slices
from panelkit.llm.store import stored

CHUNK_BYTES = 1 << 16
OVERLAP_BYTES = 1 << 9
WIDER = 8


def _count(tokenizer: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for b in batches:
            n = [enc.counts(d, o) for _, _, d, o in each_slice(b)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(np.concatenate(n) if n else [], pa.int64())],
                names=["doc_id", "n_bytes", "n_tokens"])
    return run


#: one chunk of a text: its bytes ``[start, stop)``, the overlaps at both ends, and once encoded the
#: number of ids and what it reports about each overlap (places, ids before them, running checksums)
_STATE = pa.schema([("h", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("n_text", pa.int64()),
                    ("left", pa.int64()), ("right", pa.int64()), ("n", pa.int64()),
                    *((f"{side}_{c}", pa.list_(pa.int64())) for side in ("l", "r") for c in ("at", "n", "sum")),
                    ("total", pa.int64())])
_STATE_SQL = ("h string, start long, stop long, n_text long, left long, right long, n long, l_at array<long>, "
              "l_n array<long>, l_sum array<long>, r_at array<long>, r_n array<long>, r_sum array<long>, total long")
_PIECE = pa.schema([*list(_STATE)[:6], ("piece", pa.binary())])
_PIECE_SQL = "h string, start long, stop long, n_text long, left long, right long, piece binary"


def _aligned(data: np.ndarray, at: int) -> int:
    """The next place from ``at`` on where a character begins."""
    while at < len(data) and data[at] & 0xC0 == 0x80:
        at += 1
    return min(at, len(data))


def _cut(chunk: int, overlap: int):
    """``(h, text, todo)`` -> the chunks named in ``todo``, or all of a text at first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, todo = b.column(0).to_pylist(), b.column(2).to_pylist()
            for i, _, data, _ in text_slices(b.column(1), 1):
                n, plan = len(data), todo[i]
                if plan is None:
                    cuts = [_aligned(data, c * chunk) for c in range(max(1, n // chunk))] + [n]
                    plan = [{"start": a, "stop": z, "left": overlap, "right": overlap} for a, z in zip(cuts, cuts[1:])]
                for p in plan:
                    piece = data[p["start"]: _aligned(data, p["stop"] + p["right"])]
                    row = {"h": names[i], "n_text": n, **p, "piece": piece.tobytes()}
                    yield pa.RecordBatch.from_pylist([row], _PIECE)
    return run


def _zone(enc, base: int, starts, slots, before, lo: int, hi: int) -> tuple[list, list, list]:
    """The boundaries strictly between ``lo`` and ``hi``, ids before each, and checksums between them."""
    k = np.flatnonzero((starts > lo) & (starts < hi))
    crc = [zlib.crc32(enc.flat[enc.off[s]: enc.off[s] + enc.len[s]].tobytes()) for s in slots[k]]
    at = base + starts[k]
    v = mix64(at.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.array(crc, np.uint64))
    return at.tolist(), before[k].tolist(), (np.cumsum(v) - v).view(np.int64).tolist()


def _encode(tokenizer: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for b in batches:
            out = []
            for row in b.to_pylist():
                data = np.frombuffer(row.pop("piece"), np.uint8)
                starts, slots, _ = enc.pieces(data, np.array([0, len(data)]))
                before = np.append(0, np.cumsum(enc.len[slots]))
                core = row["stop"] - row["start"]
                zones = {"l": (0, row["left"] if row["start"] else 0), "r": (core, len(data))}
                for side, (lo, hi) in zones.items():
                    row[f"{side}_at"], row[f"{side}_n"], row[f"{side}_sum"] = _zone(
                        enc, row["start"], starts, slots, before, lo, hi)
                row["n"] = int(before[-1])
                out.append(row)
            yield pa.RecordBatch.from_pylist(out, _STATE)
    return run


def _agreed(a: dict, b: dict) -> int | None:
    """Ids of ``a`` before the splice less those of ``b`` before it; null where the two do not align."""
    _, i, j = np.intersect1d(a["r_at"], b["l_at"], return_indices=True)
    if len(i) < 2:
        return None
    n = np.array(a["r_n"])[i] - np.array(b["l_n"])[j]
    s = np.array(a["r_sum"])[i] - np.array(b["l_sum"])[j]
    return int(n[0]) if (n == n[0]).all() and (s == s[0]).all() else None


def _splice(chunk: int):
    """All chunks of one text: its total, or the chunks with those to encode again (``n`` null)."""
    def run(t: pa.Table) -> pa.Table:
        rows = sorted(t.to_pylist(), key=lambda r: r["start"])
        edge = [_agreed(a, b) for a, b in zip(rows, rows[1:])]
        if None not in edge:
            done = {"h": rows[0]["h"], "total": sum(edge) + rows[-1]["n"]}
            return pa.Table.from_pylist([done], _STATE)
        out = rows[:1]
        for e, row in zip(edge, rows[1:]):
            prev = out[-1]
            if e is not None:
                out.append(row)
                continue
            wide = prev["right"] * WIDER
            if wide >= chunk:
                prev["stop"], prev["right"] = row["stop"], row["right"]
            else:
                prev["right"] = row["left"] = wide
                row["n"] = None
                out.append(row)
            prev["n"] = None
        return pa.Table.from_pylist(out, _STATE)
    return run


def long_counts(texts: DataFrame, tokenizer: str, chunk: int, overlap: int) -> tuple[DataFrame, int]:
    """``(h, n_tokens)`` for each row of ``texts(h, text)``, and the number of rounds that took."""
    spark, done, rounds = texts.sparkSession, None, 0
    todo = texts.select("h", "text", F.lit(None).cast(
        "array<struct<start: long, stop: long, left: long, right: long>>").alias("todo"))
    kept = None
    while True:
        rounds += 1
        pieces = todo.mapInArrow(_cut(chunk, overlap), _PIECE_SQL).repartition("h", "start")
        state = pieces.mapInArrow(_encode(tokenizer), _STATE_SQL)
        state = state if kept is None else state.unionByName(kept)
        got = stored(state.groupBy("h").applyInArrow(_splice(chunk), _STATE_SQL), "token-counts")
        ready = got.where("total is not null").select("h", F.col("total").alias("n_tokens"))
        done = ready if done is None else done.unionByName(ready)
        again = got.where("total is null")
        if again.isEmpty():
            return done, rounds
        kept = again.where("n is not null")
        plan = again.where("n is null").groupBy("h").agg(F.collect_list(F.struct("start", "stop", "left", "right")).alias("todo"))
        todo = texts.join(plan, "h").select("h", "text", "todo")


def token_counts(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", limit: int = 512,
                 chunk_bytes: int = CHUNK_BYTES, overlap_bytes: int = OVERLAP_BYTES) -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit)`` for each row of ``docs``."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    size = F.octet_length("text").cast("long")
    short = (rows.where(size <= chunk_bytes).select("doc_id", size.alias("n_bytes"), "text")
             .mapInArrow(_count(tokenizer), "doc_id long, n_bytes long, n_tokens long"))
    long = rows.where(size > chunk_bytes).select("doc_id", size.alias("n_bytes"), F.md5("text").alias("h"), "text")
    texts = stored(long.groupBy("h").agg(F.first("text").alias("text")), "long-texts")
    counts, _ = long_counts(texts, tokenizer, chunk_bytes, min(overlap_bytes, chunk_bytes // 2))
    slow = long.select("doc_id", "n_bytes", "h").join(counts, "h").select("doc_id", "n_bytes", "n_tokens")
    return short.unionByName(slow).withColumn("over_limit", F.col("n_tokens") > limit)
