"""Token-id files with Re-Pair grammar compression.

Documents are range-partitioned and sorted by doc_id; each task encodes its
texts, appends the end id and closes a shard whenever ``shard_ids`` ids are
together.  A shard is one record of a Parquet data set (written through Spark's
commit protocol, so lost tasks are simply run again)::

    part, seq          place of the shard in doc_id order
    base               first nonterminal; smaller symbols are token ids
    rules              two u32 per nonterminal: its left and right symbol
    rule_len           one u32 per nonterminal: ids it expands to
    symbols            u16 or u32 (``width`` bytes) symbols of the shard
    skip               i64 per ``SKIP`` symbols: ids before that symbol
    doc_ids, doc_len   the documents and their numbers of ids

All numbers are little-endian.  Re-Pair is run in rounds: every round counts
all adjacent pairs, gives the most frequent ones a nonterminal each, and
replaces them left to right; it ends when no pair occurs ``min_count`` times,
or after ``rounds`` rounds (a parameter of the compression ratio, not of the
result: every round trip is exact).  ``rule_len`` and ``skip`` give random
access: ``read_range`` expands only the symbols that cover the wanted ids.

Defined results: null text is empty (its ids are the end id alone); null doc_id
sorts first and is kept; repeated rows are kept, equal doc_ids are ordered by
text hash; extra columns are ignored; an empty table gives empty files and an
empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelkit.llm.bpe import each_slice, encoder
from panelkit.llm.spans import ragged

SHARD_IDS = 1 << 20
SKIP = 1024
ROUNDS = 6
PAIRS = 1024
MIN_COUNT = 8
SCHEMA = ("part int, seq int, n_ids long, base long, width int, rules binary, rule_len binary, symbols binary, "
          "skip binary, doc_ids array<long>, doc_len array<long>")


def repair(ids: np.ndarray, base: int, rounds: int = ROUNDS, pairs: int = PAIRS, min_count: int = MIN_COUNT):
    """``(symbols, rules, rule_len)`` of a sequence of ids below ``base``."""
    seq = ids.astype(np.uint32)
    rules, lens = [np.zeros((0, 2), np.uint32)], np.ones(0, np.uint32)
    buckets = 1 << 18
    for _ in range(rounds):
        if len(seq) < 2 * min_count:
            break
        a, b = seq[:-1], seq[1:]
        cell = (a * np.uint32(0x9E3779B1) ^ b * np.uint32(0x85EBCA77)) >> np.uint32(14)
        n = np.bincount(cell, minlength=buckets)
        least = max(min_count, int(np.partition(n, buckets - pairs)[buckets - pairs]))
        at = np.flatnonzero((n >= least)[cell])
        if not len(at):
            break
        keys, inv, count = np.unique(a[at].astype(np.uint64) << np.uint64(32) | b[at],
                                     return_inverse=True, return_counts=True)
        often = np.flatnonzero(count >= min_count)
        often = often[np.argsort(-count[often], kind="stable")[:pairs]]
        if not len(often):
            break
        name = np.full(len(keys), -1, np.int64)
        name[often] = np.arange(len(often))
        which = name[inv]
        at, which = at[which >= 0], which[which >= 0]
        # overlapping places: in every run of neighbours take the 1st, 3rd, 5th ...
        fresh = np.append(True, np.diff(at) > 1)
        run0 = np.flatnonzero(fresh)
        odd = (np.arange(len(at)) - np.repeat(run0, np.diff(np.append(run0, len(at))))) & 1
        at, which = at[odd == 0], which[odd == 0]
        used = np.bincount(which, minlength=len(often)) >= 2
        at, which = at[used[which]], which[used[which]]
        if not len(at):
            break
        first = base + len(lens)
        new = np.cumsum(used) - 1
        key = keys[often[used]]
        pair = np.stack([key >> np.uint64(32), key & np.uint64(0xFFFFFFFF)], 1).astype(np.uint32)
        known = np.append(np.ones(1, np.uint32), lens)  # place 0 stands for every token id
        place = np.where(pair >= base, pair.astype(np.int64) - base + 1, 0)
        lens = np.append(lens, known[place].sum(1, dtype=np.uint32))
        rules.append(pair)
        seq[at] = (first + new[which]).astype(np.uint32)
        keep = np.ones(len(seq), bool)
        keep[at + 1] = False
        seq = seq[keep]
    return seq, np.concatenate(rules), lens


def expand(symbols: np.ndarray, rules: np.ndarray, rule_len: np.ndarray, base: int) -> np.ndarray:
    """The ids of a symbol sequence: the nonterminals are expanded once each,
    in order, and the sequence gathers from that dictionary."""
    if not len(rules):
        return symbols.astype(np.uint32)
    lens = rule_len.astype(np.int64)
    off = np.cumsum(lens) - lens
    flat = np.empty(int(lens.sum()), np.uint32)
    for i, (a, b) in enumerate(rules.astype(np.int64).tolist()):
        at = off[i]
        for s in (a, b):
            if s < base:
                flat[at] = s
                at += 1
            else:
                k = s - base
                flat[at: at + lens[k]] = flat[off[k]: off[k] + lens[k]]
                at += lens[k]
    s = symbols.astype(np.int64)
    inner = s >= base
    k = np.where(inner, s - base, 0)
    n = np.where(inner, lens[k], 1)
    out = np.repeat(symbols.astype(np.uint32), n)
    where = np.repeat(inner, n)
    out[where] = flat[ragged(off[k[inner]], lens[k[inner]])]
    return out


def _record(part: int, seq: int, ids: np.ndarray, docs: list, lens: list[int], base: int, rounds: int) -> dict:
    symbols, rules, rule_len = repair(ids, base, rounds)
    width = 2 if base + len(rules) <= 1 << 16 else 4
    n = np.ones(len(symbols), np.int64)
    inner = symbols >= base
    n[inner] = rule_len[symbols[inner] - base]
    before = np.cumsum(n) - n
    return {"part": part, "seq": seq, "n_ids": len(ids), "base": base, "width": width,
            "rules": rules.astype("<u4").tobytes(), "rule_len": rule_len.astype("<u4").tobytes(),
            "symbols": symbols.astype(f"<u{width}").tobytes(), "skip": before[::SKIP].astype("<i8").tobytes(),
            "doc_ids": docs, "doc_len": lens}


def _write(tokenizer: str, end_id: int, shard_ids: int, rounds: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        enc = encoder(tokenizer)
        base = max(enc.tok.get_vocab_size(with_added_tokens=True), end_id + 1)
        part, seq, held, docs, lens, size = TaskContext.get().partitionId(), 0, [], [], [], 0
        schema = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("n_ids", pa.int64()), ("base", pa.int64()),
                            ("width", pa.int32()), ("rules", pa.binary()), ("rule_len", pa.binary()),
                            ("symbols", pa.binary()), ("skip", pa.binary()), ("doc_ids", pa.list_(pa.int64())),
                            ("doc_len", pa.list_(pa.int64()))])

        def close():
            return pa.RecordBatch.from_pylist(
                [_record(part, seq, np.concatenate(held), docs, lens, base, rounds)], schema)

        for b in batches:
            names = b.column(0).to_pylist()
            for i, j, d, o in each_slice(b):
                ids, off = enc.ids(d, o)
                n = np.diff(off)
                at = off[1:]  # the end id comes after each text
                held.append(np.insert(ids, at, end_id).astype(np.uint32))
                docs += names[i:j]
                lens += (n + 1).tolist()
                size += len(held[-1])
                if size >= shard_ids:
                    yield close()
                    seq, held, docs, lens, size = seq + 1, [], [], [], 0
        if docs:
            yield close()
    return run


def write_token_files(docs: DataFrame, path: str, tokenizer: str = "byte_bpe_50k.json", end_id: int = 2,
                      shard_ids: int = SHARD_IDS, rounds: int = ROUNDS) -> None:
    """Encode ``docs(doc_id, text)`` and write the shards in ascending doc_id order."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    key = ["doc_id", F.xxhash64("text")]
    (rows.repartitionByRange(*key).sortWithinPartitions(*key)
     .mapInArrow(_write(tokenizer, end_id, shard_ids, rounds), SCHEMA)
     .write.parquet(path))


def _symbols(r: dict) -> np.ndarray:
    return np.frombuffer(r["symbols"], f"<u{r['width']}")


def read_range(record: dict, start: int, stop: int) -> np.ndarray:
    """Ids ``[start, stop)`` of one shard record, expanding only the symbols
    between the two nearest entries of ``skip``."""
    skip = np.frombuffer(record["skip"], "<i8")
    stop = min(stop, record["n_ids"])
    if start >= stop:
        return np.zeros(0, np.uint32)
    a = int(np.searchsorted(skip, start, "right")) - 1
    z = int(np.searchsorted(skip, stop, "left"))
    ids = expand(_symbols(record)[a * SKIP: z * SKIP], np.frombuffer(record["rules"], "<u4").reshape(-1, 2),
                 np.frombuffer(record["rule_len"], "<u4"), record["base"])
    return ids[start - int(skip[a]): stop - int(skip[a])]


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for r in b.to_pylist():
            ids = expand(_symbols(r), np.frombuffer(r["rules"], "<u4").reshape(-1, 2),
                         np.frombuffer(r["rule_len"], "<u4"), r["base"]).astype("<u4")
            n = np.array(r["doc_len"], np.int64)
            end = np.cumsum(n)
            raw = memoryview(ids.tobytes())
            crc = [zlib.crc32(raw[4 * a: 4 * z]) for a, z in zip((end - n).tolist(), end.tolist())]
            k = len(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array(r["doc_ids"], pa.int64()), pa.array([r["part"]] * k, pa.int32()),
                 pa.array([r["seq"]] * k, pa.int32()), pa.array(end - n, pa.int64()), pa.array(n, pa.int64()),
                 pa.array(crc, pa.int64())], names=["doc_id", "part", "seq", "at", "n_tokens", "ids_crc32"])


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` from the files alone."""
    files = spark.read.schema(SCHEMA).parquet(path)
    size = files.select("part", "seq", "n_ids")
    parts = size.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect()  # one row per write task
    before, starts = 0, []
    for r in parts:
        starts.append((r.part, before))
        before += r.n
    w = Window.partitionBy("part").orderBy("seq")
    first = (size.withColumn("before", F.sum("n_ids").over(w) - F.col("n_ids"))
             .join(spark.createDataFrame(starts, "part int, first long"), "part")
             .select("part", "seq", (F.col("first") + F.col("before")).alias("first")))
    rows = files.mapInArrow(_read, "doc_id long, part int, seq int, at long, n_tokens long, ids_crc32 long")
    return (rows.join(first, ["part", "seq"])
            .select("doc_id", (F.col("first") + F.col("at")).alias("start"), "n_tokens", "ids_crc32"))
