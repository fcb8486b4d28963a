"""Ranked search, periodic runs and embedding near-duplicates against brute force."""

import random

import brute
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from test_texts import ODD, SF, same

from panelkit.llm import lexical, periodic, pq, registry
from panelkit.llm.spans import Words
from panelkit.sources.tables import table


@pytest.fixture(scope="module")
def docs(spark):
    odd = spark.createDataFrame([(d, t, 1, "z", 2) for d, t in ODD], "doc_id long, text string, n int, block string, term int")
    frame = table(spark, SF, "documents").select("doc_id", "text").unionByName(odd, allowMissingColumns=True)
    return frame, [(r.doc_id, r.text) for r in frame.collect()]


def test_search(docs, spark, monkeypatch):
    frame, rows = docs
    items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    items += [(None, "zz w1"), (None, "W2 plain"), (-1, None), (-2, ""), (-3, "!! ??"), (-4, "nosuchterm"), (-5, "word"), (-5, "word foo"),
              (-5, "word foo"), (-6, "q r s t Ünï 7")]
    asked = spark.createDataFrame([(i, t, 1, 2) for i, t in items], "item_id long, text string, bundle int, idx int")
    want = brute.ranking(rows, items)
    assert len(want) > 300
    same(lexical.search(frame, asked).collect(), want)
    same(lexical.search(frame.repartition(3), asked, owners=1).collect(), want)
    monkeypatch.setattr(lexical, "BUNDLE", 3)  # many bundles, short blocks, many owners
    monkeypatch.setattr(lexical, "BLOCK_DOCS", 40)
    same(lexical.search(frame.repartition(2), asked, owners=7).collect(), want)
    same(lexical.search(frame, asked, top=3).collect(), brute.ranking(rows, items, 3))


def test_search_without_rows(docs, spark):
    frame, rows = docs
    none = spark.createDataFrame([], "item_id long, text string")
    asked = spark.createDataFrame([(1, "word zz")], none.schema)
    assert lexical.search(frame, none).collect() == []
    assert lexical.search(frame.limit(0), asked).collect() == []
    assert lexical.search(spark.createDataFrame([(1, None), (2, " ")], "doc_id long, text string"), asked).collect() == []


def _found(texts):
    data = np.frombuffer(" ".join([]).encode() + "".join(texts).encode(), np.uint8)
    off = np.append(0, np.cumsum([len(t.encode()) for t in texts])).astype(np.int64)
    w = Words(data, off)
    out = [[] for _ in texts]
    for t, s, n, q in periodic.find_runs(w.hashes(), w.first).tolist():
        out[t].append((s, n, q))
    return [sorted(x for x in r if x[1] >= 6) for r in out]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=40), st.integers(1, 9)),
                         max_size=4), min_size=1, max_size=4))
def test_runs_of_planted_powers(parts):
    words = [[f"w{x}" for unit, times in text for _ in range(times) for x in unit] for text in parts]
    assert _found([" ".join(w) + " " for w in words]) == [brute.runs(w) for w in words]


def test_runs_nested_at_all_scales():
    rng = random.Random(5)
    texts = []
    for _ in range(60):
        unit = [f"u{rng.randrange(2)}" for _ in range(rng.randrange(1, 5))]
        for _ in range(rng.randrange(1, 4)):  # powers of units that hold powers themselves
            unit = unit * rng.randrange(1, 7) + [f"v{rng.randrange(3)}" for _ in range(rng.randrange(0, 4))]
        texts.append([f"x{rng.randrange(9)}" for _ in range(rng.randrange(9))] + unit * rng.randrange(3, 6) + unit[: rng.randrange(9)])
    assert _found([" ".join(w) + "\n" for w in texts]) == [brute.runs(w) for w in texts]


def test_periodic_query(docs):
    frame, rows = docs
    short = [r for r in rows if len((r[1] or "")) < 40_000]
    same(periodic.digests(periodic.plant(frame.where("coalesce(length(text), 0) < 40000"))).collect(), brute.periodic(short))


def test_periodic_long_and_empty(spark):
    rng = random.Random(3)
    unit = [str(rng.randrange(10 ** 6)) for _ in range(70_000)]
    text = " ".join(unit * 4 + unit[:5])
    frame = spark.createDataFrame([(2, text, 3), (2, "a " * 300_000, 4)], "doc_id long, text string, n_words int")
    got = sorted(periodic.periodic_runs(frame).collect(), key=lambda r: r.n_words)
    assert [tuple(map(tuple, r.runs)) for r in got] == [((0, 280_005, 70_000),), ((0, 300_000, 1),)]
    assert [r.collapsed for r in got] == [" ".join(unit), "a"]
    assert periodic.digests(periodic.plant(frame.limit(0))).collect() == []


def _cloud(rng, n, groups, noise):
    """Random directions, and near copies of some of them by a given angle."""
    x = rng.normal(size=(n, 48))
    for g in range(groups):
        for k in range(rng.integers(2, 12)):
            i = int(rng.integers(n))
            u = x[g] / np.linalg.norm(x[g])
            d = rng.normal(size=48)
            d -= u * (d @ u)
            x[i] = (u + noise * d / np.linalg.norm(d)) * rng.uniform(0.1, 30)
    return x


def test_embeddings_with_odd_rows(spark):
    rng = np.random.default_rng(1)
    x = _cloud(rng, 900, 60, 0.2).astype(np.float32)
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    rows += [(None, rows[3][1]), (5, rows[3][1]), (-1, None), (-2, []), (-3, [0.0] * 48), (-4, [None] + [1.0] * 47), (-4, [1.0, float("nan")]),
             (-5, [float("inf")]), (-6, [1.0]), (-7, [2.0, 0.0]), (-8, [-1.0]), (None, [0.0, 1.0]), (None, [0.0, 1.0]), (-9, [1e-40])]
    rows += [(10_000 + i, rows[7][1]) for i in range(500)]
    frame = spark.createDataFrame([(i, v, 1, "k") for i, v in rows], "vec_id long, embedding array<float>, rid int, h string")
    got = pq.near_duplicates(frame, probes=16)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    want = [(i, [None if x is None else float(np.float32(x)) for x in v] if v is not None else None) for i, v in rows]
    same(got.collect(), brute.vector_links(want))
    assert pq.near_duplicates(frame.limit(0)).collect() == []
    assert [tuple(r) for r in pq.near_duplicates(frame.where("vec_id = -2")).collect()] == [(-2, 0, -2, True)]


def test_embeddings_recall(spark, monkeypatch):
    """Links at the edge of the radius are found by the production number of probes, over many lists and small tiles."""
    rng = np.random.default_rng(2)
    x = _cloud(rng, 12_000, 1500, 0.25)
    monkeypatch.setattr(pq, "LIST_SIZE", 64)  # 256 lists
    monkeypatch.setattr(pq, "ENTRIES", 100)
    monkeypatch.setattr(pq, "PROBERS", 300)
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: r.n_links for r in pq.near_duplicates(frame).collect()}
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    n = np.array([int((unit @ u >= 0.95).sum()) - 1 for u in unit])
    mine = np.array([got[i] for i in range(len(x))])
    assert (mine <= n).all() and n.sum() > 5000
    print("recall", mine.sum() / n.sum())
    assert mine.sum() >= 0.97 * n.sum()


def test_embedding_query_recall(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.vec_id, list(r.embedding)) for r in table(spark, sf, "embeddings").collect()]
    same(registry.op13_pq_dedup(spark, sf).collect(), brute.vector_links(rows))
