"""Benchmark decontamination by winnowing, in DataFrame functions only.

Words are lower-cased (A-Z) runs of ASCII letters, digits and non-ASCII
characters.  A text's fingerprints are the minimum ``k``-gram hashes of every
``span - k + 1`` consecutive k-grams, so two texts that share ``span`` words in
a row share a fingerprint.  Fingerprints of documents and items are joined;
only the documents that meet are read again, and there each hit is extended: the
words of every ``span``-word window are compared with the items' windows.

Items shorter than ``span`` (but not empty) are one window as a whole; for each
such length that occurs (at most ``span - 1``) the documents' grams of that
length join directly.

Defined results: null and empty texts have no words and no hits; null doc_id is
kept; items without text match nothing, items without item_id mark words but are
not listed; repeated rows each get the result of their text; extra columns are
ignored by ``contamination`` and kept by ``drop_contaminated``; an empty table
gives an empty result, no items means no hits.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelkit.llm.store import stored

SPAN = 10
K = 5
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    low = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(low, SEPARATORS), "")


def _grams(h: Column, n: Column, k: int) -> Column:
    """Hash of every ``k`` consecutive entries of the array ``h`` of size ``n``."""
    one = lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(k)])
    return F.when(n >= k, F.transform(F.sequence(F.lit(0), n - k), one))


def _word_hashes(rows: DataFrame) -> DataFrame:
    """``rows`` with ``w`` (words) replaced by ``wh`` (their hashes) and ``n_words``."""
    return rows.withColumn("wh", F.transform("w", lambda x: F.xxhash64(x))).drop("w") \
        .withColumn("n_words", F.size("wh"))


def fingerprints(rows: DataFrame, span: int = SPAN, k: int = K) -> DataFrame:
    """``rows`` (with ``wh``, ``n_words``) plus ``fp``, the distinct fingerprints.

    The arrays are named in columns of their own and used twice each, so that
    the optimizer keeps them as columns and does not inline one into the
    lambda of the next."""
    g = rows.withColumn("g", F.when(F.col("n_words") >= span, _grams(F.col("wh"), F.col("n_words"), k)))
    width = span - k + 1
    low = F.transform(F.sequence(F.lit(1), F.size("g") - width + 1), lambda i: F.array_min(F.slice("g", i, width)))
    return g.withColumn("fp", F.when(F.col("g").isNotNull(), F.array_distinct(low))).drop("g")


def _windows(rows: DataFrame, length: Column) -> DataFrame:
    """One row per window: ``pos`` (from 0) and its words as one string (words
    hold no space).  The strings are built before the explode, so that its rows
    do not carry the whole text.  ``w`` must be a stored column: an expression
    would be worked out again for every window."""
    n = F.size("w")
    win = F.when(n >= length, F.transform(F.sequence(F.lit(1), n - length + 1),
                                          lambda i: F.array_join(F.slice("w", i, length), " ")))
    keep = [c for c in rows.columns if c != "w"]
    return (rows.select(*keep, win.alias("all"))
            .select(*keep, F.posexplode_outer("all").alias("pos", "win")).where(F.col("win").isNotNull()))


def _hits(docs: DataFrame, benchmark: DataFrame, span: int, k: int) -> tuple[DataFrame, DataFrame]:
    """``(measured, hits)``: every row's key with ``n_words``, and the windows
    ``(doc_id, h, pos, len, item_id)`` found in documents."""
    cores = docs.sparkSession.sparkContext.defaultParallelism  # a small file is one task otherwise
    items = stored(benchmark.select("item_id", words(F.col("text")).alias("w")).where(F.size("w") > 0)
                   .withColumn("len", F.least(F.size("w"), F.lit(span))).repartition(cores, "item_id", "w"), "benchmark-words")
    item_windows = stored(_windows(items, F.col("len")).select("win", "len", "item_id").distinct(), "benchmark-windows")
    short = sorted(r.len for r in items.where(F.col("len") < span).select("len").distinct().collect())
    # the fingerprints are written as arrays first: an explode on top would work them out for every entry
    whole = fingerprints(_word_hashes(items.where(F.col("len") == span).select("w")), span, k).select("fp")
    for m in short:
        whole = whole.unionByName(_word_hashes(items.where(F.col("len") == m).select("w"))
                                  .select(_grams(F.col("wh"), F.col("n_words"), m).alias("fp")))
    marks = stored(stored(whole, "item-marks").select(F.explode("fp").alias("f")).distinct(), "benchmark-marks")

    key = F.xxhash64("text", F.octet_length("text"))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    seen = _word_hashes(rows.select("doc_id", key.alias("h"), words(F.col("text")).alias("w")))
    seen = fingerprints(seen, span, k)
    keys = [F.coalesce("fp", F.array().cast("array<bigint>"))]
    keys += [F.coalesce(F.array_distinct(_grams(F.col("wh"), F.col("n_words"), m)), F.array().cast("array<bigint>"))
             for m in short]
    measured = stored(seen.select("doc_id", "h", F.col("n_words").cast("long").alias("n_words"),
                                  F.concat(*keys).alias("fp")), "document-marks")
    met = stored(measured.select("doc_id", "h", F.explode("fp").alias("f")).join(marks, "f", "left_semi")
                 .select(F.col("doc_id").alias("d"), F.col("h").alias("g")).distinct(), "documents-met")
    again = rows.withColumn("h", key)
    again = again.join(met, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("g")), "left_semi")
    again = stored(again.select("doc_id", "h", words(F.col("text")).alias("w")), "documents-again")
    found = None
    for m in [*short, span]:
        part = _windows(again, F.lit(m)).withColumn("len", F.lit(m))
        found = part if found is None else found.unionByName(part)
    return measured.select("doc_id", "h", "n_words"), found.join(item_windows, ["win", "len"]) \
        .select("doc_id", "h", "pos", "len", "item_id")


def contamination(docs: DataFrame, benchmark: DataFrame, span: int = SPAN, k: int = K) -> DataFrame:
    """``(doc_id, n_words, n_hit, n_items, items_sha256, contaminated)`` for each row of ``docs``."""
    measured, hits = _hits(docs, benchmark, span, k)
    hits = stored(hits.distinct(), "benchmark-hits")
    before = Window.partitionBy("doc_id", "h").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("pos") + F.col("len")
    covered = (hits.groupBy("doc_id", "h", "pos").agg(F.max("len").alias("len"))
               .withColumn("done", F.coalesce(F.max(end).over(before), F.lit(0)))
               .groupBy("doc_id", "h")
               .agg(F.sum(F.greatest(F.lit(0), end - F.greatest("pos", "done"))).cast("long").alias("n_hit")))
    listed = (hits.where(F.col("item_id").isNotNull()).groupBy("doc_id", "h")
              .agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items")))
    both = covered.join(listed.select(F.col("doc_id").alias("d"), F.col("h").alias("g"), "items"),
                        F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("g")), "left") \
        .select(F.col("doc_id").alias("d1"), F.col("h").alias("g1"), "n_hit", "items")
    out = measured.join(both, F.col("doc_id").eqNullSafe(F.col("d1")) & (F.col("h") == F.col("g1")), "left")
    items = F.coalesce("items", F.array().cast("array<string>"))
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"),
                      F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"),
                      (n_hit > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, span: int = SPAN, k: int = K) -> DataFrame:
    """The rows of ``docs`` whose text holds no benchmark window, all columns kept."""
    _, hits = _hits(docs, benchmark, span, k)
    bad = stored(hits.select("doc_id", "h").distinct(), "contaminated")
    text = F.coalesce(docs["text"], F.lit(""))
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["doc_id"]) & (F.xxhash64(text, F.octet_length(text)) == bad["h"]),
                     "left_anti")
