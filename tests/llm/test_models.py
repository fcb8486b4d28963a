"""Classifier, packing, tool calls and the pipeline."""

import zlib

import brute
import numpy as np
import pytest

import corpus_pipeline
from panelkit.llm import quality, shards, tool_calls
from panelkit.sources.tables import table

SF = "/root/testdata/sf0.01"


def test_quality(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    rows = quality.classify(docs, labels).collect()
    known = {r.doc_id: r.quality for r in labels.collect()}
    assert len(rows) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    held = [(r.predicted, known[r.doc_id]) for r in rows if r.held_out and r.doc_id in known]
    assert len(held) > 50 and np.mean([p == q for p, q in held]) > 0.97


def test_quality_learns_nothing_from_held_out_rows(spark):
    from pyspark.sql import functions as F
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    flipped = labels.withColumn("quality", F.when(quality.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (sorted(map(tuple, quality.classify(docs, x).collect())) for x in (labels, flipped))
    assert a == b


def test_quality_odd_rows(spark):
    odd = spark.createDataFrame([(None, None, "q"), (1, "", "q"), (1, "", "q"), (2, "x", "q")],
                                "doc_id long, text string, x string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [r.score for r in quality.classify(odd, none).collect()] == [0.5] * 4
    bad = spark.createDataFrame([(None, 1), (2, None), (2, 7), (1, 1), (1, 1)], "doc_id long, quality int")
    assert len(quality.classify(odd, bad).collect()) == 4
    assert quality.classify(odd.limit(0), bad).count() == 0


def _plain_statistics(text):
    """The statistics of one text, word by word."""
    import re
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    (_, n, chars, symbols, dups, repeats, *_), = brute.line_rules([(0, t)])
    lost = 0
    seen = set()
    for line in t.split("\n"):
        x = re.findall(r"[^\x20\x09-\x0D]+", line)
        if x:
            size, signs = sum(map(len, x)), len(re.findall(r"[#*$%&|<>]", line))
            bad = line in seen or signs > 0.1 * max(size, 1) or x.count("|") >= 3
            lost += size if bad or len(x) >= 3 and sum("!!" in y for y in x) > 0.5 * len(x) else 0
            seen.add(line)
    b, nw, nc = t.encode(), max(n, 1), max(chars, 1)
    lines = b.count(b"\n")
    ends = [x.encode()[-1:] in (b"!", *(bytes([c]) for c in b"#*$%&|<>")) for x in w]
    return [np.log1p(n), chars / nw, sum(65 <= c <= 90 for c in b) / nc, sum(48 <= c <= 57 for c in b) / nc, symbols / nc,
            b.count(b"!") / nc, w.count("|") / nw,
            sum(32 < c < 127 and not chr(c).isalnum() for c in b) / nc, sum(ends) / nw, np.log1p(lines) - np.log1p(n),
            len(set(w)) / nw, repeats / nw, dups / (lines + 1), sum(c >= 0xC0 for c in b) / nc,
            sum(len(x.encode()) <= 3 for x in w) / nw, lost / nc]


def test_quality_is_the_plain_computation(spark):
    """Statistics, ridge solution and calibration against numpy on all rows at once; a very long text among them."""
    rows = [tuple(r) for r in table(spark, SF, "documents").select("doc_id", "text").collect()]
    rows += [(10 ** 6, "Long text, 3 words! " * 60_000), (10 ** 6 + 1, None), (10 ** 6 + 2, "é | | | ñ\n!!\n\n!!")]
    labels = {r.doc_id: float(r.quality) for r in table(spark, SF, "labels").collect() if r.quality in (0, 1)}
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    stats = {r.doc_id: np.array(r.x) for r in quality.document_statistics(frame).collect()}
    for d, t in rows:
        np.testing.assert_allclose(stats[d], _plain_statistics(t), rtol=1e-9, atol=1e-12)
    model = quality.fit(quality.document_statistics(frame), table(spark, SF, "labels"))
    crc = {d: zlib.crc32(str(d).encode()) for d, _ in rows}
    use = [d for d, _ in rows if d in labels and crc[d] % 3 != 1]
    x, y = np.stack([stats[d] for d in use]), np.array([labels[d] for d in use])
    np.testing.assert_allclose(model.mean, x.mean(0), rtol=1e-9, atol=1e-12)
    np.testing.assert_allclose(model.scale, np.sqrt(np.maximum(x.var(0), 1e-12)), rtol=1e-6)
    cal = np.array([crc[d] // 3 % 4 == 0 for d in use])
    z = model.features(x[~cal])
    a = z.T @ z + quality.RIDGE * len(z) * np.diag([0.0] + [1.0] * quality.FEATURES)
    w = np.linalg.solve(a, z.T @ y[~cal])
    np.testing.assert_allclose(model.features(x) @ model.weights, model.features(x) @ w, atol=1e-6)
    raw = model.raw(x[cal])
    k = np.clip(((raw - quality.LOW) / (quality.HIGH - quality.LOW) * quality.BINS).astype(int), 0, quality.BINS - 1)
    seen = np.unique(k)
    n, t = np.array([(k == i).sum() for i in seen], float), np.array([y[cal][k == i].sum() for i in seen])
    # the isotonic fit by its min-max formula
    run_n, run_t = np.append(0, np.cumsum(n)), np.append(0, np.cumsum(t))
    level = [max(min((run_t[j + 1] - run_t[i]) / (run_n[j + 1] - run_n[i]) for j in range(q, len(n))) for i in range(q + 1))
             for q in range(len(n))]
    np.testing.assert_allclose(model.levels, level, atol=1e-9)
    got = {r.doc_id: r.score for r in quality.scores(quality.document_statistics(frame), model).collect()}
    want = np.clip(np.interp(model.raw(np.stack([stats[d] for d, _ in rows])), model.edges, model.levels), 0, 1)
    np.testing.assert_allclose([got[d] for d, _ in rows], want, atol=1e-9)
    kept = quality.keep_good(frame.selectExpr("*", "1 as x", "text as x_"), table(spark, SF, "labels"))
    assert kept.columns == ["doc_id", "text", "x", "x_"]
    assert sorted(r.doc_id for r in kept.collect()) == sorted(d for (d, _), v in zip(rows, want) if v >= 0.5)


def test_isotonic():
    w = np.array([1.0, 2, 1, 1, 3])
    t = np.array([0.5, 0.4, 0.9, 0.1, 3])
    out = quality.isotonic(w, t)
    assert (np.diff(out) >= 0).all() and abs((out * w).sum() - t.sum()) < 1e-12


def _plan(frame, n=40, **kw):
    rows = shards.shard_plan(frame, shards=n, **kw).collect()
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r)
    for got in by.values():
        assert sorted(r.slot for r in got) == list(range(len(got)))
    return rows, by


def test_shards(spark):
    frame = table(spark, SF, "documents")
    rows, by = _plan(frame)
    size = {s: sum(r["size"] for r in got) for s, got in by.items()}
    assert len(by) == 40 and max(size.values()) / min(size.values()) < 1.01
    want = sorted((r.doc_id, len(r.text.encode()) + 16, zlib.crc32(r.text.encode())) for r in frame.collect())
    assert sorted((r.doc_id, r["size"], r.text_crc32) for r in rows) == want


def test_shards_balance_tokens_and_rows(spark):
    """The tokens are the library's; no dimension of the plan is far from even."""
    from tokenizers import Tokenizer

    from panelkit.llm import bpe
    tok = Tokenizer.from_file(bpe.tokenizer_path("byte_bpe_50k.json"))
    docs = [tuple(r) for r in table(spark, "/root/testdata/sf0.1", "documents").select("doc_id", "text").collect()]
    rows, by = _plan(table(spark, "/root/testdata/sf0.1", "documents"))
    count = {d: len(e.ids) for (d, _), e in zip(docs, tok.encode_batch([t for _, t in docs], add_special_tokens=False))}
    for measure, bound in ((lambda r: r["size"], 1.01), (lambda r: count[r.doc_id], 1.25), (lambda r: 1, 1.25)):
        total = [sum(map(measure, x)) for x in by.values()]
        assert max(total) / min(total) < bound, (max(total), min(total))


def test_level_keeps_the_other_dimensions():
    rng = np.random.default_rng(3)
    v = rng.lognormal(0, 1, (3000, 3))
    v = v / v.sum(0) * 12
    where = rng.integers(0, 12, 3000)
    before = np.stack([np.bincount(where, c, 12) for c in v.T], 1)
    after = np.stack([np.bincount(shards._level(v, where.copy(), 12), c, 12) for c in v.T], 1)
    assert np.ptp(after[:, 0]) < np.ptp(before[:, 0])
    for d in (1, 2):
        assert after[:, d].max() <= max(before[:, d].max(), 1 + shards.SLACK) + 1e-9
        assert after[:, d].min() >= min(before[:, d].min(), 1 - shards.SLACK) - 1e-9


def test_write_shards(spark, tmp_path):
    """Rows without or with equal doc_ids keep their places; other columns come along."""
    rows = [(None, "a", 1), (None, "a", 2), (None, None, 3), (5, "b", 4), (5, "c", 5), (5, "c", 5), (6, "", 6)] * 30
    frame = spark.createDataFrame(rows, "doc_id long, text string, slot int")
    shards.write_shards(frame, f"file://{tmp_path}/out", shards=4)
    back = spark.read.parquet(f"file://{tmp_path}/out")
    assert sorted(back.columns) == ["doc_id", "shard", "slot", "text"]
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, back.select("doc_id", "text", "slot").collect()), key=key) == sorted(rows, key=key)
    assert {r.shard for r in back.select("shard").distinct().collect()} == {0, 1, 2, 3}


def test_shards_hot_group(spark):
    """A group of copies with a third of all rows is cut; smaller groups stay together."""
    rows = [(i, "hot text " * 9) for i in range(3000)] + [(10000 + i, f"text {i // 2} " * (5 + i % 7)) for i in range(6000)]
    rows += [(None, None), (None, None), (-1, ""), (-1, "")]
    got, by = _plan(spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, size int"))
    assert len(got) == len(rows)
    size = {s: sum(r["size"] for r in x) for s, x in by.items()}
    assert max(size.values()) / min(size.values()) < 1.05
    place = {}
    for r in got:
        place.setdefault((r.text_crc32, r["size"]), set()).add(r.shard)
    assert len(place[zlib.crc32(("hot text " * 9).encode()), 97]) > 5
    assert sum(len(v) > 1 for v in place.values()) == 1
    assert shards.shard_plan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_shards_repeated_rows(spark):
    """A third of all rows is one row over and over, a sixth has neither doc_id nor text."""
    rows = [(7, "hot text " * 9)] * 3000 + [(None, None)] * 1500
    rows += [(10000 + i, f"text {i} " * (5 + i % 7)) for i in range(4500)]
    got, by = _plan(spark.createDataFrame(rows, "doc_id long, text string"))
    assert len(got) == len(rows)
    size = {s: sum(r["size"] for r in x) for s, x in by.items()}
    assert max(size.values()) / min(size.values()) < 1.05
    assert len({r.shard for r in got if r.doc_id == 7}) > 5


def test_pack_balances_every_dimension():
    rng = np.random.default_rng(0)
    v = rng.lognormal(3, 1, (4000, 3))
    where = shards.pack(v, 20)
    sums = np.stack([np.bincount(where, v[:, i], 20) for i in range(3)], 1)
    assert (sums.max(0) / sums.mean(0) < 1.01).all()


def test_tool_calls(spark):
    calls = spark.createDataFrame([
        (1, "a", 0, "f", '{"b":1,"a":"x\\"é\\n/"}', []), (1, "b", 1, "f", '{"a":2}', ["a"]),
        (1, "c", 2, "g", "{}", ["b", "a"]), (1, "d", 3, "f", "[1]", ["zz"]), (2, "p", 0, "f", "not json", ["q"]),
        (2, "q", 1, "f", '{"a":"1","z":{"y":1,"b":[1,2.50]}}', ["p"]), (2, "r", 1, "f", None, ["p"]),
        (None, "a", 0, "f", '{"a":"s"}', []), (1, None, 0, "f", '{"a":null}', None),
        (3, "k", 5, "f", '{"a":"x"}', None), (4, "k", 5, "f", '{"a":"x"}', None), (4, "k", 6, "f", '{"a":"x"}', None)],
        "conv_id long, call_id string, turn long, name string, arguments string, depends_on array<string>")
    results = spark.createDataFrame([(1, "a", 1, "ok"), (1, "b", 2, None), (1, "x", 3, "or"), (None, "a", 1, "n"),
                                     (3, "k", 4, "early"), (4, "k", 7, "z"), (1, "c", 9, "r1"), (1, "c", 8, "r0")],
                                    "conv_id long, call_id string, turn long, content string")
    rules = spark.createDataFrame([("f", "a", "string", True), ("f", "b", "integer", False)],
                                  "name string, field string, type string, required boolean")
    got = {(r.conv_id, r.call_id, r.turn): (r.level, r.status, r.errors) for r in
           tool_calls.link(calls.selectExpr("*", "1 as level"), results, rules).collect()}
    assert got == {
        (1, "a", 0): (0, "linked", []), (1, "b", 1): (1, "linked", ["type:a"]),
        (1, "c", 2): (2, "repeated", ["tool"]), (1, "d", 3): (0, "unanswered", ["dependency", "json"]),
        (2, "p", 0): (None, "cycle", ["json"]), (2, "q", 1): (None, "cycle", ["unknown:z"]),
        (2, "r", 1): (None, "cycle", ["missing:a"]), (None, "a", 0): (None, "unanswered", []),
        (1, None, 0): (None, "unanswered", ["type:a"]), (3, "k", 5): (0, "early", []),
        (4, "k", 5): (0, "repeated", []), (4, "k", 6): (0, "repeated", []),
        (1, "x", 3): (None, "orphan", []), (None, "a", 1): (None, "orphan", [])}
    records = {(r.conv_id, r.call_id): r.record for r in tool_calls.link(calls, results, rules).collect()}
    assert records[1, "a"] == ('{"arguments":{"a":"x\\"é\\n/","b":1},"call_id":"a","level":0,"name":"f",'
                               '"result":"ok","status":"linked"}')
    assert '"z":{"b":[1,2.5],"y":1}' in records[2, "q"]
    assert tool_calls.link(calls.limit(0), results.limit(0), rules).count() == 0


def test_tool_call_levels(spark):
    """Long chains, joins of chains, a cycle, and what stands behind it."""
    deps = {str(i): [str(i - 1)] if i else [] for i in range(70)}
    deps.update(x=["69", "3"], y=["x"], z=["y", "10", "x"], c=["d"], d=["e"], e=["c"], f=["e"], g=["f", "0"], h=["g"])
    calls = spark.createDataFrame([(1, k, 0, "f", "{}", v) for k, v in deps.items()],
                                  "conv_id long, call_id string, turn long, name string, arguments string, "
                                  "depends_on array<string>")
    want = {str(i): i for i in range(70)}
    want.update(x=70, y=71, z=72, c=None, d=None, e=None, f=None, g=None, h=None)
    assert {r.call_id: r.level for r in tool_calls.levels(calls).collect()} == want


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001"])
def test_pipeline(spark, sf):
    import brute
    docs = table(spark, sf, "documents")
    text = {r.doc_id: r.text for r in docs.collect()}
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = [(r.doc_id, r.text) for r in kept.collect()]
        kept = corpus_pipeline.stored(stage(spark, kept, sf), f"test-{name}")
        assert kept.columns == docs.columns
        after = {r.doc_id: r.text for r in kept.collect()}
        if name == "near_duplicates":
            assert set(after) == {c for _, _, c in brute.near_duplicates(before)}
        if name == "substrings":
            want = {d for d, n, k, _ in brute.removals(before) if not n or k < n}
            assert set(after) == want
        if name == "decontamination":
            items = [(r.item_id, r.text) for r in table(spark, sf, "benchmark").collect()]
            assert set(after) == {r[0] for r in brute.contamination(before, items) if not r[-1]}
    out = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id for r in out} == set(after) <= set(text)


def test_pipeline_edges(spark):
    """Odd rows and columns whose names the stages use themselves go through all stages; an empty table gives an empty one."""
    words = " ".join(f"word{i} of a plain sentence," for i in range(40))
    rows = [(None, None), (None, ""), (1, words), (1, words), (2, words + " more"), (3, ""), (3, None), (4, "x" * 100_000),
            (None, "A text of its own. " + " ".join(f"p{i}" for i in range(60))), (5, "T " + " ".join(f"p{i}" for i in range(60)))]
    frame = spark.createDataFrame([(d, t, len(t or ""), "b", 2, "g", 3.0) for d, t in rows],
                                  "doc_id long, text string, n_chars int, _bucket string, _d int, _h string, x double")
    for sf in (SF, "/root/testdata/sf0.001"):
        docs = frame
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = corpus_pipeline.stored(stage(spark, docs, sf), f"edge-{name}")
            assert out.schema == frame.schema
            assert out.count() <= docs.count()
            docs = out
        assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).count() == docs.count()
    docs = frame.limit(0)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.stored(stage(spark, docs, SF), f"none-{name}")
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == 0
