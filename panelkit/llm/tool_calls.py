"""Tool-call linking, in DataFrame functions only.

Calls and results are hash-joined by (conversation, identifier), ordered
topologically by their dependencies, their arguments are validated against the
tools' schemas, and each pair is serialised as one line of canonical JSON
(sorted keys, no white space, one form per value; numbers as Spark's variant
type prints them).

Inputs: ``calls(conv_id, call_id, turn, name, arguments, depends_on)`` with
``arguments`` a JSON object as text and ``depends_on array<string>`` of call_ids
of the same conversation; ``results(conv_id, call_id, turn, content)``;
``schemas(name, field, type, required)`` with ``type`` one of string, integer,
number, boolean, array, object.

Output, a row per call and per result that no call asked for: ``conv_id,
call_id, turn, level, status, errors, record``.

* ``level``: 0 without dependencies, else one more than the highest of them;
  (level, turn, call_id) is a topological order of a conversation.  Null for
  calls in or behind a cycle, and for orphans.
* ``status``: ``linked``, ``unanswered``, ``early`` (the result stands before
  its call), ``repeated`` (the identifier names two calls or has two results),
  ``cycle``, or ``orphan`` (a result without a call).  The last that holds in
  the order early, repeated, cycle counts.
* ``errors``: sorted ``missing:f``, ``type:f``, ``unknown:f``, ``tool`` (no such
  tool), ``json`` (arguments are no JSON object), ``dependency`` (an unknown one).
* ``record``: ``{"arguments", "call_id", "level", "name", "result", "status"}``;
  arguments that are no JSON stand as text.

Defined results: rows without conv_id or call_id link with nothing (a call is
``unanswered``, a result an ``orphan``); null arguments are an empty object,
null content is null; an identifier with several calls or results gives each
call the result that stands first; extra columns are ignored; empty tables give
an empty result.  Ordering takes a join per power of two of the longest chain
of calls with one dependency, and one per level of calls with several.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelkit.llm.store import stored

_NAMES = {"string": ("STRING",), "integer": ("BIGINT",), "number": ("BIGINT", "DOUBLE", "DECIMAL"),
          "boolean": ("BOOLEAN",), "array": ("ARRAY",), "object": ("OBJECT",)}


def _chains(single: DataFrame) -> DataFrame:
    """``(conv_id, call_id, head, dist)``: from each call with one dependency the
    first call behind it that has none or several, and the steps to it, by
    pointer doubling (a join per power of two).  Calls in or behind a cycle of
    such calls have no head."""
    p = stored(single.select("conv_id", "call_id", F.col("dep").alias("head"), F.lit(1).cast("long").alias("dist")),
               "call-chains")
    own = p.select("conv_id", F.col("call_id").alias("head"), F.lit(True).alias("inner"))
    for _ in range(p.count().bit_length() + 1):
        if p.join(own, ["conv_id", "head"], "left_semi").isEmpty():
            break
        q = p.select("conv_id", F.col("call_id").alias("head"), F.col("head").alias("h2"), F.col("dist").alias("d2"))
        p = stored(p.join(q, ["conv_id", "head"], "left").select(
            "conv_id", "call_id", F.coalesce("h2", "head").alias("head"),
            (F.col("dist") + F.coalesce("d2", F.lit(0))).alias("dist")), "call-chains")
    return p.join(own, ["conv_id", "head"], "left").select(
        "conv_id", "call_id", F.when(F.col("inner").isNull(), F.col("head")).alias("head"), "dist")


def levels(calls: DataFrame) -> DataFrame:
    """``(conv_id, call_id, level, lost)`` per identifier of ``calls``; ``lost``
    if some dependency names no call.  Level is null in or behind a cycle."""
    key = ["conv_id", "call_id"]
    nodes = calls.where(F.col("conv_id").isNotNull() & F.col("call_id").isNotNull())
    ids = nodes.select(*key).distinct()
    wanted = nodes.select(*key, F.explode("depends_on").alias("dep")).distinct()
    known = ids.select("conv_id", F.col("call_id").alias("dep"), F.lit(True).alias("known"))
    edges = stored(wanted.join(known, ["conv_id", "dep"], "left"), "call-edges")
    lost = edges.where(F.col("known").isNull()).select(*key, F.lit(True).alias("lost")).distinct()
    deps = edges.where(F.col("known")).groupBy(*key).agg(F.count(F.lit(1)).alias("deps"), F.first("dep").alias("dep"))
    nodes = stored(ids.join(deps, key, "left"), "call-nodes")
    chains = stored(_chains(nodes.where(F.col("deps") == 1)), "call-chains")
    placed = fresh = nodes.where(F.col("deps").isNull()).select(*key, F.lit(0).cast("long").alias("level"))
    # calls with several dependencies, over the heads of their dependencies' chains
    several = nodes.where(F.col("deps") > 1).select(*key)
    if not several.isEmpty():
        via = chains.select("conv_id", F.col("call_id").alias("dep"), F.lit(True).alias("inner"), "head", "dist")
        open_ = edges.where(F.col("known")).join(several, key, "left_semi").join(via, ["conv_id", "dep"], "left").select(
            *key, F.when(F.col("inner").isNull(), F.col("dep")).otherwise(F.col("head")).alias("head"),
            F.coalesce("dist", F.lit(0)).alias("dist"), F.lit(None).cast("long").alias("far"))
        open_ = stored(open_, "call-open")
        while True:  # a round per level of calls with several dependencies
            at = fresh.select("conv_id", F.col("call_id").alias("head"), "level")
            open_ = stored(open_.join(at, ["conv_id", "head"], "left").select(
                *key, "head", "dist", F.coalesce("far", F.col("level") + F.col("dist")).alias("far")), "call-open")
            done = open_.groupBy(*key).agg((F.max("far") + 1).alias("level"), F.count("far").alias("n"),
                                           F.count(F.lit(1)).alias("of")).where(F.col("n") == F.col("of"))
            fresh = stored(done.select(*key, "level"), "call-level")
            if fresh.isEmpty():
                break
            open_ = open_.join(fresh.select(*key), key, "left_anti")
            placed = placed.unionByName(fresh)
    at = placed.select("conv_id", F.col("call_id").alias("head"), F.col("level").alias("base"))
    inner = chains.join(at, ["conv_id", "head"]).select(*key, (F.col("base") + F.col("dist")).alias("level"))
    found = placed.unionByName(inner)
    return (ids.join(found, key, "left").join(lost, key, "left")
            .select(*key, F.col("level").cast("int").alias("level"), F.coalesce("lost", F.lit(False)).alias("lost")))


def _checked(calls: DataFrame, schemas: DataFrame) -> DataFrame:
    """``calls`` with ``args`` (variant) and ``errors`` of their arguments."""
    rules = schemas.groupBy("name").agg(F.collect_set(F.struct("field", "type", "required")).alias("rules"))
    args = F.try_parse_json(F.coalesce("arguments", F.lit("{}")))
    rows = calls.withColumn("args", args).withColumn(
        "fields", F.when(F.schema_of_variant("args").startswith("OBJECT"),
                         F.expr("map_entries(cast(args as map<string, variant>))")))
    rows = rows.join(rules, "name", "left")

    def bad_type(rule: Column) -> Column:
        have = F.filter("fields", lambda f: f["key"] == rule["field"])
        kind = F.schema_of_variant(F.get(have, F.lit(0))["value"])
        right = F.lit(False)
        for name, kinds in _NAMES.items():
            match = F.lit(False)
            for k in kinds:
                match = match | kind.startswith(k)
            right = right | ((rule["type"] == name) & match)
        return (F.size(have) > 0) & ~F.coalesce(right, F.lit(False))

    named = F.transform("fields", lambda f: f["key"])
    missing = F.transform(F.filter("rules", lambda r: r["required"] & ~F.array_contains(named, r["field"])),
                          lambda r: F.concat(F.lit("missing:"), r["field"]))
    wrong = F.transform(F.filter("rules", bad_type), lambda r: F.concat(F.lit("type:"), r["field"]))
    unknown = F.transform(F.filter(named, lambda k: ~F.exists("rules", lambda r: r["field"] == k)),
                          lambda k: F.concat(F.lit("unknown:"), k))
    one = lambda s: F.array(F.lit(s))
    errors = (F.when(F.col("fields").isNull() & F.col("rules").isNull(), F.array(F.lit("json"), F.lit("tool")))
              .when(F.col("fields").isNull(), one("json")).when(F.col("rules").isNull(), one("tool"))
              .otherwise(F.concat(missing, wrong, unknown)))
    return rows.withColumn("errors", errors).drop("fields", "rules")


def _record(level: Column, status: Column) -> Column:
    """Canonical JSON: the parts are put together with sorted keys, and the
    variant type prints nested objects with sorted keys."""
    def bare(c: Column) -> Column:
        one = F.to_json(F.to_variant_object(F.struct(c.alias("x"))))
        return F.when(c.isNull(), F.lit("null")).otherwise(F.regexp_extract(one, r"(?s)^\{\"x\":(.*)\}$", 1))

    args = F.when(F.col("args").isNotNull(), F.to_json("args")).otherwise(bare(F.coalesce("arguments", F.lit("{}"))))
    return F.concat(F.lit('{"arguments":'), args, F.lit(',"call_id":'), bare(F.col("call_id")),
                    F.lit(',"level":'), F.coalesce(level.cast("string"), F.lit("null")), F.lit(',"name":'),
                    bare(F.col("name")), F.lit(',"result":'), bare(F.col("content")), F.lit(',"status":"'), status,
                    F.lit('"}'))


def link(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """Link, order, validate and serialise; see the module."""
    calls = calls.select("conv_id", "call_id", "turn", "name", "arguments", "depends_on")
    key = ["conv_id", "call_id"]
    first = F.min(F.struct("turn", "content"))
    answers = results.where(F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()).groupBy(*key).agg(
        first.alias("first"), F.count(F.lit(1)).alias("answers"))
    asked = calls.where(F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()).groupBy(*key).agg(
        F.count(F.lit(1)).alias("times"))
    rows = (_checked(calls, schemas).join(levels(calls), key, "left").join(asked, key, "left")
            .join(answers, key, "left"))
    status = (F.when(F.col("call_id").isNull() | F.col("conv_id").isNull(), "unanswered")
              .when(F.col("level").isNull(), "cycle")
              .when((F.col("times") > 1) | (F.col("answers") > 1), "repeated")
              .when(F.col("answers").isNull(), "unanswered")
              .when(F.col("first.turn") < F.col("turn"), "early").otherwise("linked"))
    lost = F.when(F.coalesce("lost", F.lit(False)), F.array(F.lit("dependency"))).otherwise(
        F.array().cast("array<string>"))
    linked = rows.withColumn("content", F.col("first.content")).withColumn("status", status).select(
        *key, "turn", "level", "status", F.sort_array(F.concat("errors", lost)).alias("errors"),
        _record(F.col("level"), F.col("status")).alias("record"))
    orphan = results.join(asked.select(*key), key, "left_anti").select(
        *key, "turn", F.lit(None).cast("int").alias("level"), F.lit("orphan").alias("status"),
        F.array().cast("array<string>").alias("errors"), F.lit(None).cast("string").alias("name"),
        F.lit(None).cast("string").alias("arguments"), F.try_parse_json(F.lit("null")).alias("args"), "content")
    orphan = orphan.select(*key, "turn", "level", "status", "errors",
                           _record(F.col("level"), F.col("status")).alias("record"))
    return linked.unionByName(orphan)


def from_conversations(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results that the turns of ``conversations(conv_id, turn, role,
    text)`` imply: a user's turn calls ``answer`` (``ask`` if it is short) and
    depends on the user's turn two before it, if there is one that far back; the
    assistant's turn is the result of the call one turn before."""
    turns = turns.select("conv_id", "turn", "role", "text")
    name = lambda t: F.concat(F.col("conv_id").cast("string"), F.lit("-"), t.cast("string"))
    words = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))
    calls = turns.where(F.col("role") == "user").select(
        "conv_id", name(F.col("turn")).alias("call_id"), "turn",
        F.when(words < 10, "ask").otherwise("answer").alias("name"),
        F.to_json(F.struct(F.col("text").alias("text"), words.alias("n_words"), F.col("turn").alias("turn")))
        .alias("arguments"),
        F.when(F.col("turn") >= 2, F.array(name(F.col("turn") - 2))).otherwise(F.array().cast("array<string>"))
        .alias("depends_on"))
    results = turns.where(F.col("role") == "assistant").select(
        "conv_id", name(F.col("turn") - 1).alias("call_id"), "turn", F.col("text").alias("content"))
    return calls, results


SCHEMAS = [("answer", "text", "string", True), ("answer", "n_words", "integer", True),
           ("answer", "turn", "integer", False), ("ask", "text", "string", True), ("ask", "turn", "integer", True)]
