"""Operators on texts against brute force, with odd rows of every kind."""

import brute
import pytest

from panelkit.llm import decontaminate, line_rules, ngram_join, oracles, registry, substrings
from panelkit.sources.tables import table

SF = "/root/testdata/sf0.001"
_A = " ".join(f"w{i}" for i in range(34))
_B = " ".join(f"w{i}" for i in range(60))
ODD = [(None, None), (-1, ""), (-2, " \n "), (-3, "zz Foo"), (-4, "ZZ  foo"), (-5, "zz Foo"), (-5, "zz Foo"),
       (None, "q r s t u v w"), (-6, "Q r s t u v w x"), (-7, _A), (-8, _A), (-9, "x\n" + _B + " y z"),
       (-10, "q " + " ".join(f"w{i}" for i in range(10, 48))), (-11, "r " * 100), (-12, "r " * 34), (None, _B),
       (-13, "a b c d e a b c d e f\nx\n\nx\n"), (-14, "| | |\n|"), (-15, "|"), (-16, "word " * 30000),
       (-17, "HI!! YOU!! THERE!! now ok\nplain words stand here and more"), (-18, "!!"), (-19, "x" * 70000)]


def key(row):
    return tuple((x is not None, x if x is not None else 0) for x in row)


def same(got, want):
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


@pytest.fixture(scope="module")
def docs(spark):
    odd = spark.createDataFrame([(d, t, 1, "z") for d, t in ODD], "doc_id long, text string, n_words int, h string")
    frame = table(spark, SF, "documents").select("doc_id", "text").unionByName(odd, allowMissingColumns=True)
    return frame, [(r.doc_id, r.text) for r in frame.collect()]


def test_ngram_join(docs):
    frame, rows = docs
    same(ngram_join.near_duplicates(frame).collect(), brute.near_duplicates(rows))
    one = ngram_join.keep_one(frame)
    assert one.columns == frame.columns
    want = {c for d, n, c in brute.near_duplicates(rows) if n}
    got = [r.doc_id for r in one.collect() if (r.text or "").strip()]
    assert len(got) == len(set(got)) and set(got) == want


def test_keep_one_with_null_and_equal_ids(spark):
    """One row of each component stays, whatever the doc_ids are; one repeated row does not touch the others."""
    base = [f"w{i}" for i in range(40)]
    near = [" ".join(base[:20] + [f"v{i}"] + base[20:]) for i in range(3)]
    alone = [f"alone {i} " + " ".join(f"x{i}_{j}" for j in range(9)) for i in range(8)]
    rows = [(None, alone[0]), (None, alone[1]), (None, alone[2]), (None, alone[2]), (7, alone[3]), (7, alone[4]),
            (8, alone[5]), (8, alone[5]), (9, alone[6]), (None, alone[6]), (3, near[0]), (5, near[1]), (5, alone[7]),
            (None, near[2]), (6, ""), (6, ""), (6, None), (6, " "), (None, None), (None, "")]
    frame = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, h int")
    want = [(None, alone[0]), (None, alone[1]), (None, alone[2]), (7, alone[3]), (7, alone[4]), (8, alone[5]),
            (9, alone[6]), (3, near[0]), (5, alone[7]), (6, ""), (6, None), (6, " "), (None, None), (None, "")]
    same(ngram_join.keep_one(frame).select("doc_id", "text").collect(), want)
    unrepeated = frame.where("text is not null and text not in ('', ' ')").dropDuplicates(["doc_id", "text"])
    same(ngram_join.keep_one(unrepeated).select("doc_id", "text").collect(), [r for r in want if (r[1] or "").strip()])
    copies = spark.createDataFrame([(4, " ".join(base + [x])) for x in "pqr"], "doc_id long, text string")
    assert ngram_join.keep_one(copies).count() == 1


def test_ngram_join_small_and_large_sets(spark):
    """Chains, a large group of near copies that differ from each other, and both sides of the boundary."""
    base = [f"t{i}" for i in range(120)]
    rows = [(i, " ".join(base[:60] + [f"u{i}"] + base[60:])) for i in range(40)]
    rows += [(100 + i, " ".join(base[i * 4:i * 4 + 60])) for i in range(8)]
    rows += [(200 + i, "k l m n o p" + " q" * i) for i in range(6)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute.near_duplicates(rows)
    same(ngram_join.near_duplicates(frame).collect(), want)
    sets = ngram_join.token_sets(frame)
    for x in (1, 20, 1000):  # any boundary gives the same links
        kept, ngram_join._boundary = ngram_join._boundary, lambda s, x=x: x
        try:
            same(ngram_join.near_duplicates(frame).collect(), want)
        finally:
            ngram_join._boundary = kept
    assert sets.count() == len(rows)


def test_substrings(docs):
    frame, rows = docs
    same(substrings.removals(frame).collect(), brute.removals(rows))
    out = substrings.remove(frame)
    assert out.columns == frame.columns
    gone = sum(1 for _, n, k, _ in brute.removals(rows) if n and n == k)
    assert out.count() == len(rows) - gone


def test_substrings_across_places(spark):
    """A passage that recurs at other offsets, overlapping itself, and windows that recur only in part."""
    p = [f"p{i}" for i in range(50)]
    rows = [(1, " ".join(["a"] * 3 + p)), (2, " ".join(p[5:45] + ["b"])), (3, " ".join(p[:20] + ["c"] + p[20:])),
            (4, " ".join((p[:7] * 12)[:80])), (5, " ".join(p[10:44])), (6, " ".join(p[10:45]))]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    same(substrings.removals(frame).collect(), brute.removals(rows))


class _Broken:
    """Stands in for the library's automaton."""

    def __init__(self, _):
        pass

    def add_word(self, *_):
        pass

    def make_automaton(self):
        pass


class _Silent(_Broken):
    def iter(self, text):
        return iter(())


class _Everywhere(_Broken):
    def iter(self, text):
        return ((e, 0) for e in range(len(text)) if e >= 80)


def test_substrings_come_from_the_automata(monkeypatch):
    """What the automata report decides which words go; shards of any size report the same."""
    import ahocorasick
    import numpy as np
    p = [f"p{i}" for i in range(200)]
    texts = [" ".join(["a"] * 3 + p), " ".join(p[20:140] + ["b"] * 40 + p[:60]), " ".join(["c", "d"] * 50), "e " * 20]
    data = np.frombuffer("".join(t + " " for t in texts).encode(), np.uint8)
    b = substrings._Bucket.__new__(substrings._Bucket)
    b.words = substrings.Words(data, np.append(0, np.cumsum([len(t) + 1 for t in texts])))
    b.h = b.words.hashes()
    doc = b.words.doc_of_word()
    b.ok = doc[: len(b.h) - 34] == doc[34:]
    key = substrings.windows(b.h, 35)
    _, n = np.unique(key, return_counts=True)
    twice = np.unique(key)[n > 1]
    at = np.flatnonzero(b.ok & np.isin(key, twice))
    found = key[at], substrings._check(b, 35)[at]
    got = substrings.covered_words(b, *found, 35)
    want = [x for (_, w, _, _), t in zip(brute.removals(list(enumerate(texts))), texts) for x in [w]]
    assert len(want) == len(texts) and got.sum() == sum(k for _, _, k, _ in brute.removals(list(enumerate(texts))))
    monkeypatch.setattr(substrings, "SHARD_PHRASES", 2)
    monkeypatch.setattr(substrings, "PAIRS", 3)
    assert (substrings.covered_words(b, *found, 35) == got).all()
    monkeypatch.setattr(ahocorasick, "Automaton", _Silent)
    assert not substrings.covered_words(b, *found, 35).any()
    monkeypatch.setattr(ahocorasick, "Automaton", _Everywhere)
    assert (substrings.covered_words(b, *found, 35) != got).any()


def test_substrings_spread_repeated_rows(spark):
    """A third of all rows are one row: it fills no bucket; columns may carry any name."""
    rows = [(7, "same text " * 40, "k", 1) for _ in range(400)] + [(i, f"other {i}", "k", 1) for i in range(800)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, _bucket string, part int")
    texts, key, _ = substrings.bucketed(frame)
    size = [r["count"] for r in texts.where("doc_id = 7 and length(text) > 100").groupBy(key).count().collect()]
    assert len(size) >= 20 and max(size) <= 50
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("texts_")]
    out = substrings.remove(frame)
    assert out.columns == frame.columns and out.count() == 800
    same(substrings.removals(frame).collect(), brute.removals([r[:2] for r in rows]))


def test_decontamination(spark, docs):
    frame, rows = docs
    items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    items += [(900, "foo zz"), (901, None), (902, "!"), (903, "foo"), (None, "hi you"), (903, "q R s t")]
    bench = spark.createDataFrame([(i, t, 5) for i, t in items], "item_id long, text string, len int")
    want = brute.contamination(rows, items)
    same(decontaminate.contamination(frame, bench).collect(), want)
    kept = decontaminate.drop_contaminated(frame, bench)
    assert kept.columns == frame.columns and kept.count() == sum(not r[-1] for r in want)
    same(decontaminate.contamination(frame, bench.limit(0)).select("doc_id", "n_hit").collect(),
         [(d, 0) for d, _ in rows])


def test_line_rules(docs):
    frame, rows = docs
    same(line_rules.judge(frame).collect(), brute.line_rules(rows))
    clean = line_rules.clean(frame)
    assert clean.columns == frame.columns
    assert clean.count() == sum(r[-1] for r in brute.line_rules(rows))
    for r in clean.where("doc_id = -17").collect():
        assert r.text == "plain words stand here and more"


def _prose(seed, lines):
    return [" ".join(f"p{seed}q{i}r{j}" for j in range(9)) + "." for i in range(lines)]


def test_line_rules_across_documents(spark):
    """Lines that recur between different neighbours go; those of copies and near copies stay."""
    common, notice = "please share this page with your friends and family today.", "(c) 2020 ALL Rights reserved by us."
    menu = ["Home page", "About our company today", "Contact the sales people", "Jobs in the team"]
    texts = ["\n".join([*_prose(i, 3), common, *_prose(100 + i, 2)]) for i in range(12)]
    texts += ["\n".join([_prose(50, 1)[0], *([common] * 3), "x y z w"])]
    near = _prose(900, 12)
    texts += ["\n".join(near)] * 30 + ["\n".join([*near[:i], f"changed line {i} stands here now.", *near[i + 1:]])
                                       for i in range(4)]
    texts += ["\n".join([*_prose(60, 2), notice, *menu]), "\n".join(["a few words stand here in one line.", *menu, " "]),
              "Start > Shop > Shoes > Men and\n" + "\n".join(_prose(61, 2)), "all rights", " reserved text",
              "Kapitel eins\n" + "\n".join(_prose(62, 2)) + "\nthe end of « the text »", "\n".join([*menu[:3], *_prose(63, 2)]),
              "\r\n".join([*_prose(64, 2), common]), "„Ja“ sagte er。\n" + " ".join(["wort"] * 3) + " …"]
    rows = [(i if i % 7 else None, t, 5, "r", "c") for i, t in enumerate(texts)]
    rows.append((77, common + "\nSo say we too, now.", 5, "r", "c"))  # mostly common, but something of its own
    rows.append((78, common + "\nYes.", 5, "r", "c"))  # hardly anything of its own
    frame = spark.createDataFrame(rows, "doc_id long, text string, row int, common string, doc string").repartition(5)
    want = brute.line_rules([r[:2] for r in rows])
    same(line_rules.judge(frame).collect(), want)
    assert [w[8] for w in want[:12]] == [1] * 12 and all(w[-1] for w in want[:12]) and not want[12][-1]
    assert all(w[6] == w[8] == 0 and w[-1] for w in want[13:47])
    assert want[47][6] == 5 and not want[48][-1] and want[49][6] == 1
    assert want[-2][-1] and not want[-1][-1]
    clean = line_rules.clean(frame)
    assert clean.columns == frame.columns
    got = {r.text for r in clean.collect()}
    assert clean.count() == sum(w[-1] for w in want) and not any(common in t.split("\n") for t in got)
    assert "\n".join(_prose(60, 2)) in got and "\n".join(near) in got
    assert {(r.row, r.common, r.doc) for r in clean.collect()} == {(5, "r", "c")}


@pytest.mark.parametrize("text", ["x", "é", "\n", ".", "", None, "。", "\na", "| |"])
def test_line_rules_of_one_text(text):
    """A slice that holds a single tiny text."""
    import numpy as np
    data = np.frombuffer((text or "").encode(), np.uint8)
    m = line_rules.measures(data, np.array([0, len(data)]))
    (want,) = brute.line_rules([(0, text)])
    assert [int(m[c][0]) for c in line_rules.COLUMNS] == list(want[1:8]) and bool(m["base_failed"][0])


def test_line_rules_twin(spark, docs):
    """The SQL twin on the same rows, lines across documents included."""
    import duckdb
    frame, rows = docs
    extra = [(10**6 + i, "\n".join([*_prose(i, 2), "one line of them all stands here.", *_prose(300 + i, 1)])) for i in range(11)]
    documents = spark.createDataFrame(rows + extra, "doc_id long, text string").toPandas()  # noqa: F841
    con = duckdb.connect()
    con.register("documents", documents)
    same(con.execute(oracles.OP10).fetchall(), brute.line_rules(rows + extra))


@pytest.mark.parametrize("run", [ngram_join.near_duplicates, ngram_join.keep_one, substrings.removals,
                                 substrings.remove, line_rules.judge, line_rules.clean])
def test_empty(spark, run):
    assert run(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_twins_name_registered_queries():
    assert set(registry.SQL) <= set(registry.QUERIES)
    assert oracles.OP1 and len(registry.QUERIES) == 13
