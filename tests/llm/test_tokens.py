"""Tokenizer operators against the library on whole texts, and exact round trips."""

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from panelkit.llm import bpe, bpe_codec, spans, token_counts, token_files
from panelkit.llm.store import scratch
from panelkit.sources.tables import table

SF = "/root/testdata/sf0.001"
ODD = [(None, None), (100, ""), (101, "x" * 30000), (102, "ab " * 5000), (None, "q  w" * 4000), (5, "\n \n" * 3000 + "z"),
       (7, "a <|endoftext|> b<|endoftext|>" * 900), (7, "a <|endoftext|> b<|endoftext|>" * 900),
       (8, "I'm he's  x\t\ty 'S don't 'tis!'s a.b 3-4 x1"), (9, "é à x  y　 z\x1c é ́x ΟΔΟΣ ΣΑΣ Å"),
       (10, "<|startoftext|>HELLO <|endoftext|>")]


@pytest.fixture(scope="module")
def docs(spark):
    frame = table(spark, SF, "documents").select("doc_id", "text").unionByName(
        spark.createDataFrame([(d, t, 3) for d, t in ODD], "doc_id long, text string, n_tokens int"),
        allowMissingColumns=True)
    return frame, [(r.doc_id, r.text or "") for r in frame.collect()]


def library(name):
    return Tokenizer.from_file(bpe.tokenizer_path(name))


def key(row):
    return tuple((x is not None, x if x is not None else 0) for x in row)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("aAzéЖ'stdmrevl .,!?-\n\t\x0b\x1c  ́|<>0٣漢ß") |
                        st.characters(codec="utf-8"), max_size=40), max_size=6))
def test_pieces_are_the_library(name, texts):
    enc = bpe.encoder(name)
    col = pa.array([*texts, "<|endoftext|>x"] if len(texts) % 2 else texts, pa.string())
    for i, j, d, o in spans.text_slices(col, 64):
        ids, n = enc.ids(d, o)
        for k in range(j - i):
            assert ids[n[k]:n[k + 1]].tolist() == enc.tok.encode(col[i + k].as_py(), add_special_tokens=False).ids


def test_counts(docs):
    frame, rows = docs
    tok = library("byte_bpe_50k.json")
    n = [len(tok.encode(t, add_special_tokens=False).ids) for _, t in rows]
    want = sorted(((d, len(t.encode()), k, k > 512) for (d, t), k in zip(rows, n)), key=key)
    for chunk, overlap in ((1 << 16, 1 << 9), (700, 8), (60, 30)):  # short overlaps fail and are widened
        got = token_counts.token_counts(frame, chunk_bytes=chunk, overlap_bytes=overlap)
        assert sorted(map(tuple, got.collect()), key=key) == want


def test_huge_text_splices_in_one_round(spark):
    """Millions of characters align at the first try; a text without boundaries becomes one chunk."""
    tok = library("byte_bpe_50k.json")
    texts = [r.text for r in table(spark, "/root/testdata/sf0.1", "documents").where("length(text) > 1500").orderBy("doc_id").limit(2500).collect()]
    huge = "\n".join(texts)[:5_000_000]
    assert len(huge) > 3_000_000
    n = len(tok.encode(huge, add_special_tokens=False).ids)
    frame = spark.createDataFrame([("a", huge)], "h string, text string")
    for overlap in (512, 4096, 32768):
        got, rounds = token_counts.long_counts(frame, "byte_bpe_50k.json", 1 << 16, overlap)
        assert (rounds, [tuple(r) for r in got.collect()]) == (1, [("a", n)])
    odd = [("b", "é" * 40_000 + huge[:90_000] + "<|endoftext|>" * 9000 + huge[:200_000]), ("c", "x" * 90_000), ("d", huge[:1])]
    odd = [(h, t, len(tok.encode(t, add_special_tokens=False).ids)) for h, t in odd]
    got, rounds = token_counts.long_counts(spark.createDataFrame([x[:2] for x in odd], frame.schema), "byte_bpe_50k.json", 1 << 13, 64)
    assert sorted(map(tuple, got.collect())) == [(h, n) for h, _, n in odd] and rounds > 2


def test_codec(docs):
    frame, rows = docs
    tok = library("word_bpe_49k.json")
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = []
    for d, t in rows:
        ids = tok.encode(t, add_special_tokens=False).ids
        want.append((d, len(ids), sha(" ".join(map(str, ids))), sha(tok.decode(ids, skip_special_tokens=False))))
    assert sorted(map(tuple, bpe_codec.digests(frame).collect()), key=key) == sorted(want, key=key)
    back = bpe_codec.encode(frame).withColumn("back", bpe_codec.decode("ids"))
    assert back.columns == ["doc_id", "text", "n_tokens", "ids", "back"]
    assert sorted(sha(r.back) for r in back.collect()) == sorted(w[3] for w in want)


def test_files(spark, docs):
    frame, rows = docs
    path = scratch(spark, "test-files")
    token_files.write_token_files(frame, path, shard_ids=20000)
    tok = library("byte_bpe_50k.json")
    want = []
    for d, t in rows:
        ids = np.array(tok.encode(t, add_special_tokens=False).ids + [2], "<u4")
        want.append((d, len(ids), zlib.crc32(ids.tobytes())))
    got = sorted(map(tuple, token_files.read_token_files(spark, path).collect()), key=lambda r: r[1])
    assert [r[1] for r in got] == np.append(0, np.cumsum([r[2] for r in got]))[:-1].tolist()
    assert [key(r[:1]) for r in got] == sorted(key(r[:1]) for r in got)
    assert sorted(((d, n, c) for d, _, n, c in got), key=key) == sorted(want, key=key)
    rec = spark.read.parquet(path).orderBy("part", "seq").first().asDict()
    full = token_files.read_range(rec, 0, 1 << 60)
    assert len(full) == rec["n_ids"] and len(rec["rules"])
    for a in range(0, len(full), 1777):
        assert np.array_equal(token_files.read_range(rec, a, a + 900), full[a:a + 900])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 6), max_size=400), st.integers(1, 9))
def test_repair_round_trip(ids, rounds):
    ids = np.array(ids, np.uint32)
    s, rules, lens = token_files.repair(ids, 7, rounds, pairs=5, min_count=2)
    assert np.array_equal(token_files.expand(s, rules, lens, 7), ids)


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    path = scratch(spark, "test-empty")
    token_files.write_token_files(none, path)
    assert token_files.read_token_files(spark, path).count() == 0
    assert token_counts.token_counts(none).count() == bpe_codec.digests(none).count() == 0
