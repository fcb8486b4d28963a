"""Byte-pair encoding of whole Arrow batches through the tokenizers library.

A *forced boundary* is a place where neither the pre-tokenizer nor any merge
can join both sides, so the parts may be encoded apart and concatenated:

* byte pairs that occur inside no vocabulary token (computed from the
  vocabulary) rule out a merge across the cut;
* the cut must also be a pre-token boundary whatever stands to the left and
  right, which holds for the classes in ``_cuts_byte`` / ``_cuts_word``.

Where a special token's string occurs, only white space cuts are used, so the
library meets that string whole.
The pieces between cuts repeat all the time; each distinct piece is encoded
once by the library and kept in a bounded per-worker table.
"""

from __future__ import annotations

import json
import os
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa

from panelkit.llm.spans import SPACE, Words, ragged, span_hash, text_slices

MAX_PIECES = 1_200_000
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True


def tokenizer_path(name: str) -> str:
    """A file name is looked up among the installed public vocabularies; a path stands for itself."""
    if os.path.sep in name:
        return name
    import public_tokenizers
    return public_tokenizers.path(name)


def byte_alphabet() -> dict[str, int]:
    """Printable stand-ins of byte-level vocabularies: printable bytes stand for
    themselves, the others for code points from 256 on."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in keep}
    out.update({chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in keep)})
    return out


def joined_pairs(vocab: dict[str, int], suffix: str | None) -> np.ndarray:
    """256 x 256 table: true where the byte pair occurs inside some token."""
    alpha = byte_alphabet()
    seen = np.zeros((256, 256), bool)
    for token in vocab:
        if suffix and token.endswith(suffix):
            token = token[: -len(suffix)]
        b = [alpha[c] for c in token if c in alpha]
        seen[b[:-1], b[1:]] = True
    return seen


def _letter_cuts(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Between an ASCII letter and an ASCII sign or digit: every letter match ends there."""
    return _LETTER[a] & (b > 32) & (b < 127) & ~_LETTER[b]


def _cuts_byte(data: np.ndarray, off: np.ndarray, joined: np.ndarray, special: bool) -> np.ndarray:
    """Cut before a space after an ASCII letter or sign, or after a multi-byte
    character that is no white space; and at the ends of ASCII letter runs.
    Nothing in the pre-token pattern spans these.  With ``special`` (a special
    token's string may occur) only the cuts at spaces are taken."""
    n = len(data)
    flags = np.zeros(n + 1, bool)
    if n > 1:
        a, b = data[:-1], data[1:]
        prev, prev2 = np.zeros(n - 1, np.uint8), np.zeros(n - 1, np.uint8)
        prev[1:] = data[:-2]
        prev2[2:] = data[:-3][: max(n - 3, 0)]
        wide = a >= 128
        odd = wide & (((prev == 0xC2) & ((a == 0x85) | (a == 0xA0))) | ((prev2 >= 0xE1) & (prev2 <= 0xE3)))
        cut = (b == 32) & (((a > 32) & (a < 127)) | (wide & ~odd))
        if not special:
            cut |= _letter_cuts(a, b)
        flags[1:n] = cut & ~joined[a, b]
    flags[off] = True
    return np.flatnonzero(flags[:n])


class PieceEncoder:
    """Encodes slices of texts; ``kind`` is ``byte`` (white space belongs to
    tokens) or ``word`` (white space is dropped)."""

    def __init__(self, path: str, max_pieces: int = MAX_PIECES):
        self.max_pieces = max_pieces
        from tokenizers import Tokenizer
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        suffix = spec["model"].get("end_of_word_suffix")
        self.joined = joined_pairs(spec["model"]["vocab"], suffix)
        self.special = [t["content"].encode() for t in spec["added_tokens"]]
        self.word = bool(suffix)
        if self.word and (self.joined[SPACE].any() or self.joined[:, SPACE].any()):
            raise ValueError("this vocabulary joins white space; no forced boundary there")
        self._clear()

    def _clear(self) -> None:
        self.known = np.zeros(0, np.uint64)  # sorted hashes of the pieces, and their slots:
        self.place = np.zeros(0, np.int64)   # a quarter of the memory that a dict takes
        self.size = 0
        self.h2 = np.zeros(1 << 14, np.uint64)
        self.off = np.zeros(1 << 14, np.int64)
        self.len = np.zeros(1 << 14, np.int64)
        self.flat = np.zeros(1 << 16, np.uint32)
        self.used = 0

    def direct(self, texts: list[str]) -> list[np.ndarray]:
        """The library on whole texts."""
        return [np.array(e.ids, np.uint32) for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, hashes: np.ndarray, h2: np.ndarray, pieces: list[str]) -> np.ndarray:
        at = self.size
        got = self.direct(pieces)
        lens = np.fromiter(map(len, got), np.int64, len(got))
        need, n = self.used + int(lens.sum()), at + len(got)
        if need > len(self.flat):
            self.flat = np.resize(self.flat, max(need, 2 * len(self.flat)))
        if n > len(self.off):
            size = max(n, 2 * len(self.off))
            self.h2, self.off, self.len = (np.resize(x, size) for x in (self.h2, self.off, self.len))
        if got:
            self.flat[self.used: need] = np.concatenate(got)
        self.off[at:n] = self.used + np.cumsum(lens) - lens
        self.len[at:n], self.h2[at:n] = lens, h2
        slots = np.arange(at, n)
        order = np.argsort(hashes)
        where = np.searchsorted(self.known, hashes[order])
        self.known = np.insert(self.known, where, hashes[order])
        self.place = np.insert(self.place, where, slots[order])
        self.used, self.size = need, n
        return slots

    def _spans(self, data: np.ndarray, off: np.ndarray, special: bool):
        """Starts and ends of the pieces, the pieces of each text, and the bytes that count."""
        if not len(data):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64), None
        if not self.word:
            starts = _cuts_byte(data, off, self.joined, special)
            return starts, np.append(starts[1:], len(data)), np.searchsorted(starts, off), None
        w = Words(data, off)
        starts = w.starts
        if not special and len(data) > 1:
            a, b = data[:-1], data[1:]
            low = a + np.uint8(32) * ((a >= 65) & (a <= 90)).astype(np.uint8)
            cut = np.zeros(len(data), bool)
            cut[1:] = _letter_cuts(a, b) & ~self.joined[low, b]
            cut[off[:-1][off[:-1] < len(data)]] = False
            cut[starts] = True
            starts = np.flatnonzero(cut)
        run = np.append(0, np.cumsum(w.inside, dtype=np.int64))
        ends = starts + run[np.append(starts[1:], len(data))] - run[starts]
        return starts, ends, np.searchsorted(starts, off), w.inside

    def pieces(self, data: np.ndarray, off: np.ndarray):
        """``(starts, slots, first)``: byte starts and table slots of all pieces,
        and the range of pieces of each text."""
        raw = data.tobytes()
        starts, ends, first, inside = self._spans(data, off, any(s in raw for s in self.special))
        if not len(starts):
            return starts, np.zeros(0, np.int64), first
        h, h2 = span_hash(data, starts, inside, twice=True)
        codes, uniq = pd.factorize(h)
        at = np.empty(len(uniq), np.int64)
        at[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
        if self.size + len(uniq) > self.max_pieces:
            self._clear()
        slots = np.full(len(uniq), -1, np.int64)
        if len(self.known):
            i = np.minimum(np.searchsorted(self.known, uniq), len(self.known) - 1)
            hit = self.known[i] == uniq
            slots[hit] = self.place[i[hit]]
        new = np.flatnonzero(slots < 0)
        if len(new):
            s, e = starts[at[new]].tolist(), ends[at[new]].tolist()
            slots[new] = self._learn(uniq[new], h2[at[new]], [raw[x:y].decode() for x, y in zip(s, e)])
        slots = slots[codes]
        if not np.array_equal(self.h2[slots], h2):  # two pieces with one hash: encode each place by itself
            self._clear()
            slots = self._learn(np.arange(len(starts), dtype=np.uint64), h2,
                                [raw[x:y].decode() for x, y in zip(starts.tolist(), ends.tolist())])
            self.known, self.place = self.known[:0], self.place[:0]
        return starts, slots, first

    def counts(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Number of ids of each text."""
        _, slots, first = self.pieces(data, off)
        run = np.append(0, np.cumsum(self.len[slots]))
        return run[first[1:]] - run[first[:-1]]

    def ids(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and the offsets of each text's ids."""
        _, slots, first = self.pieces(data, off)
        lens = self.len[slots]
        flat = self.flat[ragged(self.off[slots], lens)] if len(slots) else np.zeros(0, np.uint32)
        return flat, np.append(0, np.cumsum(lens))[first]


@lru_cache(maxsize=4)
def encoder(name: str, max_pieces: int = MAX_PIECES) -> PieceEncoder:
    """One encoder for each vocabulary and worker process."""
    return PieceEncoder(tokenizer_path(name), max_pieces)


class IdTable:
    """Ragged byte strings by id, to render ids as text without a Python loop."""

    def __init__(self, strings: list[bytes]):
        self.len = np.fromiter(map(len, strings), np.int64, len(strings))
        self.off = np.cumsum(self.len) - self.len
        self.flat = np.frombuffer(b"".join(strings), np.uint8)

    def render(self, ids: np.ndarray, off: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The strings of all ids joined, and the byte offsets of each text."""
        lens = self.len[ids]
        out = self.flat[ragged(self.off[ids], lens)]
        return out.tobytes(), np.append(0, np.cumsum(lens))[off]


def each_slice(batch: pa.RecordBatch, column: str = "text"):
    """``(first_row, last_row, bytes, offsets)`` of the batch's texts."""
    return text_slices(batch.column(batch.schema.get_field_index(column)))
