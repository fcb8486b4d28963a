"""Substring dedup: every word inside a window of ``span`` words that starts
anywhere else too (same text included) is removed.

Texts are dealt once into buckets (a bucketed table in the shared checkpoint
folder), so the passes below read a bucket's texts without another shuffle.

1. *Candidates.*  Of the ``gram``-word phrases of a text the winnowed ones
   (minimum hash of every ``span - gram + 1`` neighbours) are counted: each
   bucket ships every distinct one once, with a flag if it holds it twice.
   Two equal windows select the same phrase, so a window whose phrase is not
   recurring cannot recur.
2. *Confirm.*  The windows over recurring phrases are counted likewise, by an
   80-bit hash.  What recurs comes back to the buckets that hold it.
3. *Locate.*  Each bucket cuts the confirmed passages (runs of recurring windows,
   each window taken where the bucket meets it first) into phrases, half a
   window long, so that each window holds one whole phrase.  They are dealt by
   passage to shards and compiled into Aho-Corasick automata; every text of the
   bucket is streamed through all shards.  An automaton names the phrase it
   met, the words around are compared with those of the passage, and what agrees
   over a window or more is covered.  Nothing else marks words: the windows'
   hashes choose the passages, the automata find where they occur.

Only hashes are grouped across buckets, once per bucket however many copies
there are, so no passage or group of copies gathers in one task.

Texts are dealt by the row's number in its input partition, so repeated rows
spread like others; ``docs`` must read its rows in a stable order (files or a
table, as everywhere in this library).

Defined results: null and empty texts have no words; texts of fewer than
``span`` words lose nothing; repeated rows are copies of each other; null doc_id
is kept; extra columns are ignored by ``removals`` and kept by ``remove``; an
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelkit.llm.spans import Words, mix64, ragged, slide, text_slices, windows
from panelkit.llm.store import scratch

SPAN = 35
GRAM = 16
BUCKET_BYTES = 4 << 20
MIN_BUCKETS = 24
EVEN_BUCKETS = 2048
MAX_FILES = 100_000
RANGES = 256
RANGE_BYTES = 128 << 20
SHARD_PHRASES = 1 << 15
PAIRS = 1 << 20
_DIGIT = 32

_PARTS = pa.schema([("part", pa.int32()), ("_bucket", pa.int32()), ("tok", pa.binary()), ("chk", pa.binary()),
                    ("multi", pa.binary())])
_PARTS_SQL = "part int, _bucket int, tok binary, chk binary, multi binary"
_BACK = pa.schema([("_bucket", pa.int32()), ("tok", pa.binary()), ("chk", pa.binary())])
_BACK_SQL = "_bucket int, tok binary, chk binary"


def bucketed(docs: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> tuple[DataFrame, str, int]:
    """``docs`` with a bucket column, written as a table bucketed by it (one file
    per bucket, or per some buckets where there are very many), that column's
    name (no column of ``docs`` has it), and the number of token ranges to use."""
    spark, name = docs.sparkSession, uuid.uuid4().hex
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = max(MIN_BUCKETS, size // bucket_bytes + 1)
    row = F.xxhash64(F.monotonically_increasing_id())
    if groups <= EVEN_BUCKETS:
        # one bucket number per hash partition, so that every file gets one bucket
        files = groups
        place = F.pmod(F.hash(F.col("id").cast("int")), F.lit(files))
        names = [r.b for r in spark.range(16 * files).groupBy(place.alias("p"))
                 .agg(F.min("id").cast("int").alias("b")).orderBy("p").collect()]
        bucket = F.get(F.array(*map(F.lit, names)), F.pmod(row, F.lit(len(names))).cast("int"))
    else:  # many buckets to a file even out by themselves
        files = min(MAX_FILES, max(EVEN_BUCKETS, groups // 16))
        bucket = F.pmod(row, F.lit(groups)).cast("int")
    key, table, path = f"bucket_{name}", f"texts_{name}", scratch(spark, "texts")
    (docs.withColumn(key, bucket).repartition(files, key).write.bucketBy(files, key).option("path", path)
     .format("parquet").saveAsTable(table))
    texts = spark.table(table)
    spark.sql(f"DROP TABLE {table}")  # the catalog's entry; the files stay, and ``texts`` reads them
    return texts, key, max(RANGES, size // RANGE_BYTES)


def _texts(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """All texts of a bucket as one slice."""
    parts = list(text_slices(t.column("text"), 1 << 62))
    return (parts[0][2], parts[0][3]) if parts else (np.zeros(0, np.uint8), np.zeros(1, np.int64))


class _Bucket:
    """Word hashes of a bucket's texts, and which windows lie in one text."""

    def __init__(self, t: pa.Table, span: int):
        self.words = Words(*_texts(t))
        self.h = self.words.hashes()
        n = max(len(self.h) - span + 1, 0)
        doc = self.words.doc_of_word()
        self.ok = doc[:n] == doc[span - 1: span - 1 + n]


def _lowest(b: _Bucket, span: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Phrase hashes, and the winnowed phrase of each window (0 across texts)."""
    phrase = windows(b.h, gram) | np.uint64(1)
    low = slide(phrase, span - gram + 1, np.minimum)
    return phrase, np.where(b.ok, low, np.uint64(0))


def _check(b: _Bucket, span: int) -> np.ndarray:
    return (windows(mix64(b.h ^ np.uint64(0x5851F42D4C957F2D)), span) >> np.uint64(48)).astype(np.uint16)


def _ship(bucket: int, tok: np.ndarray, chk: np.ndarray, ranges: int) -> pa.Table:
    """One row per range: the distinct tokens, and whether the bucket holds them twice."""
    order = np.lexsort((chk, tok))
    tok, chk = tok[order], chk[order]
    fresh = np.ones(len(tok), bool)
    fresh[1:] = (tok[1:] != tok[:-1]) | (chk[1:] != chk[:-1])
    at = np.flatnonzero(fresh)
    multi = np.diff(np.append(at, len(tok))) > 1
    tok, chk = tok[at], chk[at]
    part = (tok % np.uint64(ranges)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    tok, chk, multi = tok[order], chk[order], multi[order]
    edge = np.searchsorted(part[order], np.arange(ranges + 1))
    rows = [{"part": p, "_bucket": bucket, "tok": tok[a:z].astype("<u8").tobytes(),
             "chk": chk[a:z].astype("<u2").tobytes(), "multi": np.packbits(multi[a:z]).tobytes()}
            for p, (a, z) in enumerate(zip(edge[:-1].tolist(), edge[1:].tolist())) if z > a]
    return pa.Table.from_pylist(rows, _PARTS)


def _phrases(span: int, gram: int, ranges: int):
    def run(t: pa.Table) -> pa.Table:
        b = _Bucket(t, span)
        phrase, low = _lowest(b, span, gram)
        reach = span - gram + 1
        best = slide(np.pad(low, (reach - 1, reach - 1)), reach, np.maximum)[: len(phrase)]
        tok = phrase[: len(best)][best == phrase[: len(best)]]
        return _ship(t.column("_bucket")[0].as_py(), tok, np.zeros(len(tok), np.uint16), ranges)
    return run


def _recurring(t: pa.Table) -> pa.Table:
    """One range: the tokens that two buckets or one bucket twice hold, back to their buckets."""
    rows = t.to_pylist()
    tok = [np.frombuffer(r["tok"], "<u8") for r in rows]
    n = [len(x) for x in tok]
    bucket = np.repeat(np.array([r["_bucket"] for r in rows]), n)
    chk = np.concatenate([np.frombuffer(r["chk"], "<u2") for r in rows])
    multi = np.concatenate([np.unpackbits(np.frombuffer(r["multi"], np.uint8), count=k) for r, k in zip(rows, n)])
    tok = np.concatenate(tok)
    order = np.lexsort((chk, tok))
    tok, chk, multi, bucket = tok[order], chk[order], multi[order], bucket[order]
    same = (tok[1:] == tok[:-1]) & (chk[1:] == chk[:-1])
    keep = multi.astype(bool)
    keep[1:] |= same
    keep[:-1] |= same
    tok, chk, bucket = tok[keep], chk[keep], bucket[keep]
    order = np.argsort(bucket, kind="stable")
    tok, chk, bucket = tok[order], chk[order], bucket[order]
    names, first = np.unique(bucket, return_index=True)
    edge = np.append(first, len(bucket))
    return pa.Table.from_pylist(
        [{"_bucket": int(b), "tok": tok[a:z].astype("<u8").tobytes(), "chk": chk[a:z].astype("<u2").tobytes()}
         for b, a, z in zip(names, edge[:-1].tolist(), edge[1:].tolist())], _BACK)


def _got(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    tok = b"".join(t.column("tok").to_pylist())
    chk = b"".join(t.column("chk").to_pylist())
    return np.frombuffer(tok, "<u8"), np.frombuffer(chk, "<u2")


def _key(tok: np.ndarray, chk: np.ndarray) -> np.ndarray:
    """One number for a token and its check, for use inside a bucket."""
    return mix64(tok + chk.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _windows(span: int, gram: int, ranges: int):
    def run(texts: pa.Table, phrases: pa.Table) -> pa.Table:
        if not texts.num_rows or not phrases.num_rows:
            return _PARTS.empty_table()
        b = _Bucket(texts, span)
        _, low = _lowest(b, span, gram)
        at = np.flatnonzero(b.ok & np.isin(low, _got(phrases)[0]))
        return _ship(texts.column("_bucket")[0].as_py(), windows(b.h, span)[at], _check(b, span)[at], ranges)
    return run


def _codes(h: np.ndarray) -> tuple[str, int]:
    """The words as one string with ``width`` characters of a small alphabet
    each: automaton nodes search their edges one by one, so few edges are fast."""
    _, ids = np.unique(h, return_inverse=True)
    width, top = 1, _DIGIT
    while top <= (int(ids.max()) if len(ids) else 0):
        width, top = width + 1, top * _DIGIT
    digits = np.stack([(ids // _DIGIT ** i) % _DIGIT for i in range(width)], 1).astype(np.uint8) + np.uint8(48)
    return digits.tobytes().decode("ascii"), width


def _passages(b: _Bucket, tok: np.ndarray, chk: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """First and past-last words of the passages: recurring windows at their first
    place in the bucket, joined where they are neighbours."""
    key = _key(windows(b.h, span), _check(b, span))
    known = np.sort(_key(tok, chk))
    valid = np.flatnonzero(b.ok)
    place = np.minimum(np.searchsorted(known, key[valid]), len(known) - 1)
    at = valid[known[place] == key[valid]]
    first = np.sort(at[np.unique(key[at], return_index=True)[1]])
    doc = b.words.doc_of_word()
    split = np.flatnonzero((np.diff(first) > 1) | (doc[first[1:]] != doc[first[:-1]])) + 1
    lo = first[np.append(0, split)] if len(first) else first
    return lo, first[np.append(split, len(first)) - 1] + span if len(first) else first


class _Shard:
    """The automaton of some passages' phrases; a phrase's number leads to its places."""

    def __init__(self, text: str, width: int, size: int, place: np.ndarray):
        import ahocorasick
        self.size, self.width, self.auto = size, width, ahocorasick.Automaton(ahocorasick.STORE_INTS)
        number: dict[str, int] = {}
        ids = [number.setdefault(text[p * width: (p + size) * width], len(number)) for p in place.tolist()]
        for phrase, i in number.items():
            self.auto.add_word(phrase, i)
        self.auto.make_automaton()
        order = np.argsort(ids, kind="stable")
        self.place = place[order]  # of each phrase, one after another
        self.first = np.searchsorted(np.array(ids, np.int64)[order], np.arange(len(number) + 1))

    def meet(self, text: str, lo: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Where the phrases occur in a text that starts at word ``lo``: (word there, word in the passage).
        Ends that are not on a word's last character are no words."""
        got = [(e, i) for e, i in self.auto.iter(text) if (e + 1) % self.width == 0]
        if not got:
            return
        end, i = np.array(got, np.int64).T
        word = lo + (end + 1) // self.width - self.size
        n = self.first[i + 1] - self.first[i]
        a = 0
        while a < len(word):  # a phrase may stand in many passages: some pairs at a time
            z = max(a + 1, a + int(np.searchsorted(np.cumsum(n[a:]), PAIRS, "right")))
            yield np.repeat(word[a:z], n[a:z]), self.place[ragged(self.first[i[a:z]], n[a:z])]
            a = z


def covered_words(b: _Bucket, tok: np.ndarray, chk: np.ndarray, span: int) -> np.ndarray:
    """True for the words of the bucket inside an occurrence of a confirmed window."""
    out = np.zeros(len(b.h), bool)
    if not len(tok) or not b.ok.any():
        return out
    start, stop = _passages(b, tok, chk, span)
    half = (span + 1) // 2
    count = (stop - start) // half
    place = np.repeat(start, count) + half * ragged(np.zeros(len(count), np.int64), count)
    own = np.repeat(np.arange(len(count)), count)  # the passage of each phrase
    text, width = _codes(b.h)
    mark = np.zeros(len(b.h) + 1, np.int64)
    bounds = b.words.first.tolist()
    shards = np.append(np.searchsorted(np.cumsum(count), np.arange(0, max(len(place), 1), SHARD_PHRASES), "right"), len(count))
    for s, e in zip(shards[:-1].tolist(), shards[1:].tolist()):
        mine = place[(own >= s) & (own < e)]
        if not len(mine):
            continue
        shard = _Shard(text, width, half, mine)
        for lo, hi in zip(bounds[:-1], bounds[1:]):
            if hi - lo < span:
                continue
            for word, spot in shard.meet(text[lo * width: hi * width], lo):
                # how far the words before and after the phrase agree with the passage's
                p = np.searchsorted(start, spot, "right") - 1
                left = _agree(b.h, word, spot, -1, np.minimum(word - lo, spot - start[p]), span - half)
                right = _agree(b.h, word + half - 1, spot + half - 1, 1,
                               np.minimum(hi - half - word, stop[p] - half - spot), span - half)
                full = left + half + right >= span
                np.add.at(mark, (word - left)[full], 1)
                np.add.at(mark, (word + half + right)[full], -1)
    return np.cumsum(mark[:-1]) > 0


def _agree(h: np.ndarray, a: np.ndarray, b: np.ndarray, step: int, room: np.ndarray, most: int) -> np.ndarray:
    """How many words next to ``a`` equal those next to ``b``, going by ``step``, up to ``room`` and ``most``."""
    n = np.zeros(len(a), np.int64)
    live = np.arange(len(a))
    for k in range(1, most + 1):
        live = live[room[live] >= k]
        live = live[h[a[live] + step * k] == h[b[live] + step * k]]
        if not len(live):
            break
        n[live] = k
    return n


def _kept(b: _Bucket, gone: np.ndarray) -> Iterator[bytes]:
    """The kept words of each text, joined by one space."""
    w = b.words
    raw, starts, ends = w.data.tobytes(), w.starts, w.ends
    for a, z in zip(w.first[:-1].tolist(), w.first[1:].tolist()):
        at = a + np.flatnonzero(~gone[a:z])
        yield b" ".join([raw[x:y] for x, y in zip(starts[at].tolist(), ends[at].tolist())])


def _marked(texts: pa.Table, found: pa.Table, span: int):
    b = _Bucket(texts, span)
    gone = covered_words(b, *_got(found), span) if found.num_rows else np.zeros(len(b.h), bool)
    run = np.append(0, np.cumsum(gone))
    return b, gone, run[b.words.first[1:]] - run[b.words.first[:-1]]


_DIGEST = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()),
                     ("kept_sha256", pa.string())])


def _digest(span: int):
    def run(texts: pa.Table, found: pa.Table) -> pa.Table:
        if not texts.num_rows:
            return _DIGEST.empty_table()
        b, gone, n = _marked(texts, found, span)
        sha = [hashlib.sha256(x).hexdigest() for x in _kept(b, gone)]
        return pa.Table.from_arrays([texts.column("doc_id"), pa.array(b.words.counts()), pa.array(n, pa.int64()),
                                     pa.array(sha, pa.string())], schema=_DIGEST)
    return run


def _rewrite(span: int, columns: list[str], lengths: str | None):
    def run(texts: pa.Table, found: pa.Table) -> pa.Table:
        out = texts.select(columns)
        if not texts.num_rows:
            return out
        b, gone, n = _marked(texts, found, span)
        old = texts.column("text").to_pylist()
        new = [x.decode() if k else t for t, x, k in zip(old, _kept(b, gone), n.tolist())]
        i = columns.index("text")
        out = out.set_column(i, out.schema.field(i), pa.array(new, out.schema.field(i).type))
        if lengths in columns:
            j = columns.index(lengths)
            size = [len(t) if k else s for t, s, k in zip(new, texts.column(lengths).to_pylist(), n.tolist())]
            out = out.set_column(j, out.schema.field(j), pa.array(size, out.schema.field(j).type))
        return out.filter(pa.array([not k or bool(t) for t, k in zip(new, n.tolist())]))
    return run


def _found(texts: DataFrame, key: str, ranges: int, span: int, gram: int) -> DataFrame:
    """``(_bucket, tok, chk)``: the recurring windows of each bucket."""
    small = texts.select(F.col(key).alias("_bucket"), "text").groupBy("_bucket")
    phrases = (small.applyInArrow(_phrases(span, gram, ranges), _PARTS_SQL)
               .groupBy("part").applyInArrow(_recurring, _BACK_SQL))
    return (small.cogroup(phrases.groupBy("_bucket")).applyInArrow(_windows(span, gram, ranges), _PARTS_SQL)
            .groupBy("part").applyInArrow(_recurring, _BACK_SQL))


def removals(docs: DataFrame, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept_sha256)`` for each row of ``docs``."""
    texts, key, ranges = bucketed(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    return texts.groupBy(key).cogroup(_found(texts, key, ranges, span, gram).groupBy("_bucket")).applyInArrow(
        _digest(span), "doc_id long, n_words long, n_removed long, kept_sha256 string")


def remove(docs: DataFrame, span: int = SPAN, gram: int = GRAM, lengths: str | None = "n_chars") -> DataFrame:
    """``docs`` with the recurring words removed, all columns kept.  A text that
    loses words becomes its kept words joined by one space (and ``lengths``, if
    there is such a column, its new length); one that keeps none is dropped;
    other rows stay as they are."""
    texts, key, ranges = bucketed(docs)
    return texts.groupBy(key).cogroup(_found(texts, key, ranges, span, gram).groupBy("_bucket")).applyInArrow(
        _rewrite(span, docs.columns, lengths), docs.schema)
