"""Quality rules, line first.

Each line is judged by punctuation, navigation and boilerplate rules; failing
lines are removed; a document that loses more than ``MAX_LOSS`` of its word
characters to lines at fault by themselves is rejected, and so is one that loses
more than ``MAX_COMMON`` of them to these and to lines that recur across
documents (such a line may be sound prose, so a short text that holds one stays),
and one that fails the document rules (too few words, too much of it repeated).

Line rules (a line is what stands between ``\\n``; lines without a word are
neither judged nor counted):

* punctuation: over ``MAX_SYMBOLS`` of its word characters are one of
  ``#*$%&|<>``; or it has at least ``MIN_SHOUT`` words and over ``MAX_SHOUT`` of
  them hold ``!!``; or it has at most ``FRAGMENT`` words and does not end with an
  end mark (longer lines without one may be wrapped prose and stay);
* navigation: at least ``MIN_BARS`` words are a lone ``|``, or at least that many
  are a lone separator and these are a quarter of its words; or it belongs to a
  run of at least ``MENU_LINES`` lines with a word, each of at most ``MENU_WORDS``
  words and without an end mark (one entry a line);
* boilerplate: it equals an earlier line of its text; or, with at most
  ``NOTICE_WORDS`` words, it holds one of ``NOTICES`` (case of A-Z aside); or, with
  at most that many words, it recurs across documents: it stands between at least
  ``MIN_SPREAD`` different pairs of neighbouring lines, and between one such pair
  for every ``PER_SPREAD`` documents that have a word.  Pairs of neighbours are
  counted, not documents, so the lines of copies and near copies of one document
  do not count as boilerplate; longer shared passages are left to substring dedup.
  Lines that fail an earlier rule are not counted.

The texts are read once: each row is written with its counts and with two hashes
and a size for each short line that passed; the lines that recur are found by a
partial distinct count over (line, neighbours) and joined back, dealt over
``SLOTS`` parts a line so that a line of a third of all rows is spread.

Defined results: null and empty texts have no words and fail the base rule;
repeated rows are judged one by one; null doc_id is kept; extra columns are
ignored by ``judge`` and returned by ``clean``, whatever their names; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelkit.llm.bpe import each_slice
from panelkit.llm.spans import Words, mix64, window_ok, windows
from panelkit.llm.store import stored

SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 10
REPEAT_WINDOW = 5
MAX_REPEAT_PERCENT = 20
MAX_LOSS = 0.5
MAX_COMMON = 0.9
MAX_SYMBOLS = 0.1
MIN_BARS = 3
MIN_SHOUT = 3
MAX_SHOUT = 0.5
FRAGMENT = 3
MENU_LINES = 4
MENU_WORDS = 6
NOTICE_WORDS = 24
MIN_SPREAD = 10
PER_SPREAD = 1000
SLOTS = 32
END_MARKS = (".", "!", "?", ":", ";", '"', "'", ")", "]", "»", "”", "’", "。", "！", "？")
SEPARATORS = ("|", ">", "/", "›", "·", "•", "→")
NOTICES = ("all rights reserved", "licensed under", "terms of use", "terms of service", "privacy policy",
           "cookie policy", "uses cookies", "use of cookies", "enable javascript", "skip to content",
           "subscribe to our newsletter", "back to top")

_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(SYMBOLS)] = True
_NEWLINE = np.zeros(256, bool)
_NEWLINE[10] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_sep = np.frombuffer(" ".join(SEPARATORS).encode(), np.uint8)
_SEPARATORS = Words(_sep, np.array([0, len(_sep)])).hashes()


def _per(run: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums between bounds from a running total that starts with 0."""
    return np.diff(run[bounds])


def _running(flags: np.ndarray) -> np.ndarray:
    return np.append(0, np.cumsum(flags, dtype=np.int64))


def _seen_before(key: np.ndarray) -> np.ndarray:
    """True where the key occurred at a smaller index."""
    out = np.ones(len(key), bool)
    out[np.unique(key, return_index=True)[1]] = False
    return out


def _repeat_words(w: Words, h: np.ndarray, doc: np.ndarray, k: int) -> np.ndarray:
    """Per text: words covered by ``k``-word windows that occur twice or more in it."""
    covered = np.zeros(len(h) + 1, np.int64)
    win = windows(h, k)
    if len(win):
        ok = window_ok(w.first, len(win), k)
        at = np.flatnonzero(ok)
        key = mix64(win[at] + doc[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        _, inv, n = np.unique(key, return_inverse=True, return_counts=True)
        at = at[n[inv] > 1]
        np.add.at(covered, at, 1)
        np.add.at(covered, at + k, -1)
    return _per(_running(np.cumsum(covered[:-1]) > 0), w.first)


def _ends_with(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, marks: tuple[str, ...]) -> np.ndarray:
    """True for spans that end with one of the marks."""
    out = np.zeros(len(ends), bool)
    for mark in marks:
        at = np.ones(len(ends), bool)
        for back, byte in enumerate(reversed(mark.encode()), 1):
            at &= (ends - back >= starts) & (data[np.maximum(ends - back, 0)] == byte)
        out |= at
    return out


def _holds(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, phrases: tuple[str, ...]) -> np.ndarray:
    """True for spans that hold one of the phrases, case of A-Z aside."""
    low = _LOWER[data].tobytes()
    out = np.zeros(len(starts), bool)
    for phrase in phrases:
        word, at = phrase.encode(), []
        i = low.find(word)
        while i >= 0:
            at.append(i)
            i = low.find(word, i + 1)
        if at:
            line = np.searchsorted(starts, at, "right") - 1
            out[line[np.array(at) + len(word) <= ends[line]]] = True
    return out


def _in_runs(flags: np.ndarray, doc: np.ndarray, least: int) -> np.ndarray:
    """True where ``least`` or more consecutive entries of one text are flagged."""
    if not len(flags):
        return flags
    new = np.append(True, (flags[1:] != flags[:-1]) | (doc[1:] != doc[:-1]))
    run = np.cumsum(new) - 1
    return flags & (np.bincount(run) >= least)[run]


def _neighbours(h: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Hash of the lines before and after each line in its text."""
    before, after = np.zeros_like(h), np.zeros_like(h)
    same = doc[1:] == doc[:-1]
    before[1:][same] = h[:-1][same]
    after[:-1][same] = h[1:][same]
    return mix64(mix64(before + np.uint64(0x9E3779B97F4A7C15)) + after)


def measures(data: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    """The base counts of each text of a slice, what its lines lose by the rules
    that need no other text, and the lines themselves."""
    w = Words(data, off)
    doc = w.doc_of_word()
    h = w.hashes()
    char = _running(w.inside & ((data & 0xC0) != 0x80))
    symbol = _running(_IS_SYMBOL[data])
    out = {"n_words": w.counts(), "word_chars": _per(char, off), "n_symbols": _per(symbol, off),
           "n_repeat_words": _repeat_words(w, h, doc, REPEAT_WINDOW)}
    lines = Words(data, off, _NEWLINE)
    starts, ends = lines.starts, lines.ends
    n_words = _running(np.bincount(w.starts, minlength=len(data) + 1)[:-1]) if len(data) else np.zeros(1, np.int64)
    first_word, end_word = n_words[starts], n_words[ends]
    words = end_word - first_word
    line_doc = lines.doc_of_word()
    line_hash = lines.hashes()
    real = np.flatnonzero(words > 0)
    key = mix64(line_hash + line_doc.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    again = np.zeros(len(words), bool)
    again[real] = _seen_before(key[real])
    chars = char[ends] - char[starts]
    signs = symbol[ends] - symbol[starts]

    def of_line(flags: np.ndarray) -> np.ndarray:
        run = _running(flags)
        return run[end_word] - run[first_word]

    loud = np.zeros(len(data), bool)
    if len(data) > 1:
        loud[1:] = (data[1:] == 33) & (data[:-1] == 33)
        loud[off[:-1][off[:-1] < len(data)]] = False
    n_shout = of_line(_per(_running(loud), np.append(w.starts, len(data))) > 0)
    n_bars = of_line((w.ends - w.starts == 1) & (data[w.starts] == 0x7C) if len(h) else np.zeros(0, bool))
    n_seps = of_line(np.isin(h, _SEPARATORS))
    noise = again | (signs > MAX_SYMBOLS * np.maximum(chars, 1)) | (n_bars >= MIN_BARS)
    noise |= (words >= MIN_SHOUT) & (n_shout > MAX_SHOUT * words)
    noise &= words > 0
    last = w.ends[end_word[real] - 1] if len(real) else real
    unclosed = np.zeros(len(words), bool)
    unclosed[real] = ~_ends_with(data, starts[real], last, END_MARKS)
    bad = noise | unclosed & (words <= FRAGMENT) | (n_seps >= MIN_BARS) & (4 * n_seps >= words)
    bad[real] |= _in_runs((unclosed & (words <= MENU_WORDS))[real], line_doc[real], MENU_LINES)
    short = (words > 0) & (words <= NOTICE_WORDS)
    bad |= short & _holds(data, starts, ends, NOTICES)
    around = np.zeros(len(words), np.uint64)
    around[real] = _neighbours(line_hash[real], line_doc[real])
    out["n_dup_lines"] = _per(_running(again), lines.first)
    out["noise_chars"] = _per(_running(np.where(noise, chars, 0)), lines.first)
    out["n_bad_lines"] = _per(_running(bad), lines.first)
    out["lost_chars"] = _per(_running(np.where(bad, chars, 0)), lines.first)
    out["base_failed"] = (out["n_words"] < MIN_WORDS) | (100 * out["n_repeat_words"]
                                                        > MAX_REPEAT_PERCENT * out["n_words"])
    out["_lines"] = {"start": starts, "end": ends, "bad": bad, "asked": short & ~bad, "first": lines.first,
                     "hash": line_hash, "around": around, "chars": chars, "doc": line_doc}
    return out


COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_bad_lines", "lost_chars")
_LINE = pa.list_(pa.struct([("line", pa.int64()), ("around", pa.int64()), ("chars", pa.int64())]))


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i, j, d, o in each_slice(b):
            m = measures(d, o)
            x = m["_lines"]
            asked = np.flatnonzero(x["asked"])
            items = pa.StructArray.from_arrays(
                [pa.array(x["hash"][asked].view(np.int64)), pa.array(x["around"][asked].view(np.int64)),
                 pa.array(x["chars"][asked].astype(np.int64))], fields=list(_LINE.value_type))
            at = _running(x["asked"])[x["first"]]
            yield pa.RecordBatch.from_arrays(
                [b.column(0).slice(i, j - i), b.column(1).slice(i, j - i), *(pa.array(m[c], pa.int64()) for c in COLUMNS),
                 pa.array(m["base_failed"]), pa.ListArray.from_arrays(pa.array(at, pa.int32()), items)],
                names=["row", "doc_id", *COLUMNS, "base_failed", "lines"])


def _measured(docs: DataFrame) -> DataFrame:
    """``docs(row, doc_id, text)`` with its counts and short lines, written."""
    counts = ", ".join(f"{c} long" for c in COLUMNS)
    return stored(docs.mapInArrow(_measure, f"row long, doc_id long, {counts}, base_failed boolean, "
                                  "lines array<struct<line: long, around: long, chars: long>>"), "line-rules")


def _common_lines(rows: DataFrame) -> DataFrame:
    """``(row, line, chars)`` of the lines that recur across documents."""
    n = rows.where("n_words > 0").count()
    lines = rows.select("row", F.inline("lines"))
    least = max(MIN_SPREAD, -(-n // PER_SPREAD))
    common = lines.groupBy("line").agg(F.count_distinct("around").alias("spread")).where(F.col("spread") >= least)
    slots = common.select("line", F.explode(F.sequence(F.lit(0), F.lit(SLOTS - 1))).alias("slot"))
    placed = lines.select("row", "line", "chars", F.pmod(F.xxhash64("row"), F.lit(SLOTS)).cast("int").alias("slot"))
    return placed.join(slots, ["line", "slot"], "left_semi").select("row", "line", "chars")


def judge(docs: DataFrame) -> DataFrame:
    """Counts and verdict of each row of ``docs(doc_id, text)``."""
    rows = _measured(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"))
    common = _common_lines(rows).groupBy("row").agg(F.count("*").alias("n_common_lines"),
                                                    F.sum("chars").alias("common_chars"))
    full = rows.drop("lines").join(common, "row", "left").fillna(0, ["n_common_lines", "common_chars"])
    sound = (F.col("lost_chars") <= MAX_LOSS * F.col("word_chars")) & (
        F.col("lost_chars") + F.col("common_chars") <= MAX_COMMON * F.col("word_chars"))
    return full.select("doc_id", *COLUMNS, "n_common_lines", "common_chars", "base_failed",
                       (~F.col("base_failed") & sound).alias("kept"))


def _clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    salt = np.uint64(0xC2B2AE3D27D4EB4F)
    for b in batches:
        at = b.schema.get_field_index("text")
        for i, j, d, o in each_slice(b):
            m = measures(d, o)
            x = m["_lines"]
            part = b.slice(i, j - i)
            lists = part.column(part.schema.get_field_index("common"))
            common = pa.compute.list_flatten(lists).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            of = pa.compute.list_parent_indices(lists).to_numpy(zero_copy_only=False).astype(np.uint64)
            bad = x["bad"] | x["asked"] & np.isin(mix64(x["hash"] + x["doc"].astype(np.uint64) * salt),
                                                  mix64(common + of * salt))
            gone = _per(_running(np.where(bad, x["chars"], 0)), x["first"])
            kept = ~m["base_failed"] & (m["lost_chars"] <= MAX_LOSS * m["word_chars"]) & (
                gone <= MAX_COMMON * m["word_chars"])
            raw, texts = d.tobytes(), []
            for r in range(j - i):
                good = [raw[x["start"][y]: x["end"][y]].decode() for y in range(x["first"][r], x["first"][r + 1])
                        if not bad[y]]
                texts.append("\n".join(good))
            part = part.set_column(at, b.schema.field(at), pa.array(texts, b.schema.field(at).type))
            yield part.drop_columns(["common"]).filter(pa.array(kept))


def clean(docs: DataFrame) -> DataFrame:
    """The kept documents without their failing lines, all columns kept."""
    rest = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")).alias("doc")
    held = stored(docs.select(F.monotonically_increasing_id().alias("row"), "text", rest), "line-rules-texts", "zstd")
    common = _common_lines(_measured(held.select("row", F.col("doc.doc_id").alias("doc_id"), "text"))).groupBy("row").agg(
        F.collect_list("line").alias("common"))
    full = held.join(common, "row", "left").select(
        "text", "doc", F.coalesce("common", F.array().cast("array<bigint>")).alias("common"))
    out = full.mapInArrow(_clean, full.drop("common").schema)
    return out.select(*(F.col("text") if c == "text" else F.col("doc")[c].alias(c) for c in docs.columns))
