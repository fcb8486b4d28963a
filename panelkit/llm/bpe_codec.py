"""BPE encoding and decoding with forced-boundary splitting (see ``bpe``).

Defined results: null or empty text has no ids and decodes to the empty text;
repeated rows give repeated results; extra columns are ignored by ``digests``
and kept by ``encode``; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelkit.llm.bpe import IdTable, each_slice, encoder

TOKENIZER = "word_bpe_49k.json"
#: a worker keeps its piece table for later tasks, beside whatever they need
MAX_PIECES = 400_000


@lru_cache(maxsize=4)
def _tables(tokenizer: str) -> tuple[IdTable, IdTable]:
    """Decimal ids and token strings, each followed by one space."""
    enc = encoder(tokenizer, MAX_PIECES)
    if enc.tok.decoder is not None:
        raise ValueError("this decoder does more than join tokens with spaces; use decode() of the library")
    size = enc.tok.get_vocab_size(with_added_tokens=True)
    tokens = [(enc.tok.id_to_token(i) or "").encode() for i in range(size)]
    return IdTable([b"%d " % i for i in range(size)]), IdTable([t + b" " for t in tokens])


def _sha(raw: bytes, off: np.ndarray) -> list[str]:
    """SHA-256 of each text of ``raw`` without its last separator."""
    return [hashlib.sha256(raw[a:max(a, b - 1)]).hexdigest() for a, b in zip(off[:-1].tolist(), off[1:].tolist())]


def _encode(tokenizer: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, MAX_PIECES)
        for b in batches:
            for i, j, d, o in each_slice(b):
                ids, n = enc.ids(d, o)
                col = pa.ListArray.from_arrays(pa.array(n, pa.int32()), pa.array(ids.astype(np.int32)))
                rest = b.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*rest.columns, col], names=[*b.schema.names, "ids"])
    return run


def encode(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """``docs`` with ``ids array<int>`` (an ``ids`` column it had is replaced)."""
    docs = docs.drop("ids")
    ids = T.StructField("ids", T.ArrayType(T.IntegerType()))
    return docs.mapInArrow(_encode(tokenizer), T.StructType([*docs.schema.fields, ids]))


def decode(ids: str | Column, tokenizer: str = TOKENIZER) -> Column:
    """Text of an ``array<int>`` column, as the library's
    ``decode(ids, skip_special_tokens=False)``."""
    @F.pandas_udf("string")
    def run(col):
        tok = encoder(tokenizer, MAX_PIECES).tok
        return col.map(lambda x: tok.decode(list(x), skip_special_tokens=False) if x is not None else None)
    return run(ids)


def _digest(tokenizer: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, MAX_PIECES)
        as_id, as_token = _tables(tokenizer)
        for b in batches:
            n_tokens, id_sha, text_sha = [], [], []
            for _, _, d, o in each_slice(b):
                ids, n = enc.ids(d, o)
                n_tokens.append(np.diff(n))
                id_sha += _sha(*as_id.render(ids, n))
                text_sha += _sha(*as_token.render(ids, n))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(np.concatenate(n_tokens) if n_tokens else [], pa.int64()),
                 pa.array(id_sha, pa.string()), pa.array(text_sha, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
    return run


def digests(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)``: every text is encoded,
    and its ids are decoded again, in one pass that ships no ids."""
    return docs.select("doc_id", "text").mapInArrow(
        _digest(tokenizer), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
