"""Gradient-boosted regression trees grown in chunks, with early stopping.

Squared loss, histogram splits, second-order leaf weights with L1 and L2
penalties, row and column subsampling, and a learnt side for missing values.
Trees grow depth-wise; results are checked with quality bands on planted
signals, not bit by bit against another library.

Two forms share the kernels:

* ``fit`` trains one model on any number of rows.  The rows are binned once into
  written blocks of ``BLOCK_ROWS`` rows (codes as bytes).  A level of a tree is one
  job: tasks sum the histograms of their blocks, the exchange carries one row per
  (node, feature) and task, and one best split per (node, feature) comes out; the
  driver sees only the winners of at most ``2 ** depth`` nodes.  After a chunk of
  rounds the predictions of all rows are written with the blocks, so no task
  evaluates more than a chunk's trees again.  Where all rows are one block, its task grows
  the whole chunk, with the same kernels.
* ``fit_groups`` trains one model per group (a walk-forward fold of a series) in a
  grouped task each; a group is bounded by the time steps of its series.

The validation loss of every prefix is kept; growth stops once ``patience`` rounds
brought no better one, and the model is the best prefix (no second fit).
NULL, NaN and infinite features count as missing; rows without a label train nothing.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelkit.operators.rolling import Keys, _keys
from panelkit.plans.written import written

BLOCK_ROWS = 1 << 16
CHUNK = 25
LEAST_GAIN = 1e-6


@dataclass(frozen=True)
class Params:
    rounds: int = 500
    rate: float = 0.05
    depth: int = 5
    rows: float = 0.7
    columns: float = 0.7
    min_child: float = 1.0
    l2: float = 1.0
    l1: float = 0.0
    min_gain: float = 0.0
    patience: int | None = None
    bins: int = 254
    seed: int = 42


#: fixed values: the batch model and the walk-forward model of the inventory (M8, M9)
BATCH = Params()
WALK_FORWARD = Params(rounds=5000, rate=0.08, rows=0.8, columns=0.8, min_child=2.0, l2=5.0, l1=1.0, patience=100)


@dataclass
class Tree:
    """A complete binary tree in heap order; ``feature`` is -1 at leaves."""

    feature: np.ndarray
    bin: np.ndarray
    missing_left: np.ndarray
    value: np.ndarray
    gain: np.ndarray

    @classmethod
    def empty(cls, depth: int) -> "Tree":
        n = 2 ** (depth + 1) - 1
        return cls(np.full(n, -1, np.int32), np.zeros(n, np.int32), np.zeros(n, bool), np.zeros(n), np.zeros(n))

    def leaves(self, codes: np.ndarray, depth: int) -> np.ndarray:
        """The node each column of ``codes`` stops at after ``depth`` levels."""
        node = np.zeros(codes.shape[1], np.int64)
        at = np.arange(codes.shape[1])
        for _ in range(depth):
            f = self.feature[node]
            c = codes[np.maximum(f, 0), at]
            left = np.where(c == 0, self.missing_left[node], c <= self.bin[node])
            node = np.where(f < 0, node, 2 * node + 2 - left)
        return node

    def predict(self, codes: np.ndarray) -> np.ndarray:
        return self.value[self.leaves(codes, int(np.log2(len(self.feature) + 1)) - 1)]


@dataclass
class Model:
    features: list[str]
    edges: list[np.ndarray]
    base: float
    trees: list[Tree] = field(default_factory=list)
    curve: list[float] = field(default_factory=list)

    @property
    def best_iteration(self) -> int:
        """0-based round of the best validation loss (the last one without validation rows)."""
        return int(np.argmin(self.curve)) if self.curve else len(self.trees) - 1

    def best(self) -> "Model":
        return replace(self, trees=self.trees[: self.best_iteration + 1])

    def predict(self, x: np.ndarray) -> np.ndarray:
        codes = encode(self.edges, x)
        out = np.full(len(x), self.base)
        for t in self.trees:
            out += t.predict(codes)
        return out


# ------------------------------------------------------------------- kernels


def encode(edges: list[np.ndarray], x: np.ndarray) -> np.ndarray:
    """Codes by feature: 0 for missing, else 1 + the number of edges below the value."""
    out = np.zeros((len(edges), len(x)), np.uint8)
    for f, e in enumerate(edges):
        v = x[:, f]
        out[f] = np.where(np.isfinite(v), np.searchsorted(e, v) + 1, 0)
    return out


def histograms(codes, node, g, columns, n_nodes: int, bins: int) -> np.ndarray:
    """Sums of gradients and counts by (node, feature, code)."""
    out = np.empty((2, n_nodes, len(columns), bins))
    for j, f in enumerate(columns):
        k = node * bins + codes[f]
        out[0, :, j] = np.bincount(k, g, n_nodes * bins).reshape(n_nodes, bins)
        out[1, :, j] = np.bincount(k, minlength=n_nodes * bins).reshape(n_nodes, bins)
    return out


def _shrunk(g, p: Params):
    return np.sign(g) * np.maximum(np.abs(g) - p.l1, 0)


def _score(g, h, p: Params):
    return _shrunk(g, p) ** 2 / np.maximum(h + p.l2, 1e-12)


def best_splits(hist: np.ndarray, p: Params) -> np.ndarray:
    """Per (node, feature): gain, code, missing goes left (1 or 0); gain is -inf where nothing splits."""
    g, h = hist
    low = np.cumsum(g[..., 1:], -1), np.cumsum(h[..., 1:], -1)
    gm, hm = g[..., :1], h[..., :1]
    gt, ht = low[0][..., -1:] + gm, low[1][..., -1:] + hm
    out = np.full((*g.shape[:2], 3), -np.inf)
    for left in (0, 1):
        gl, hl = low[0] + left * gm, low[1] + left * hm
        gr, hr = gt - gl, ht - hl
        gain = _score(gl, hl, p) + _score(gr, hr, p) - _score(gt, ht, p)
        gain = np.where((hl >= p.min_child) & (hr >= p.min_child) & (hl > 0) & (hr > 0), gain, -np.inf)
        k = gain.argmax(-1)
        top = np.take_along_axis(gain, k[..., None], -1)[..., 0]
        better = top > out[..., 0]
        out[better] = np.stack([top, k + 1.0, np.full(top.shape, float(left))], -1)[better]
    return out


def _sampled(p: Params, round_: int, block: int, n: int) -> np.ndarray:
    if p.rows >= 1:
        return np.arange(n)
    return np.flatnonzero(np.random.default_rng([p.seed, round_, block]).random(n) < p.rows)


def _columns(p: Params, round_: int, n: int) -> np.ndarray:
    k = max(1, int(n * p.columns))
    return np.sort(np.random.default_rng([p.seed, round_]).permutation(n)[:k])


def _set_level(tree: Tree, level: int, splits: dict[int, tuple], totals: np.ndarray, p: Params) -> bool:
    """Write one level's splits and leaf values; false if nothing splits."""
    first, grown = 2 ** level - 1, False
    for i in range(2 ** level):
        g, h = totals[0, i], totals[1, i]
        tree.value[first + i] = -p.rate * _shrunk(g, p) / max(h + p.l2, 1e-12) if h else 0.0
        if level < p.depth and i in splits:
            gain, feature, code, left = splits[i]
            if gain > max(p.min_gain, LEAST_GAIN):
                n = first + i
                tree.feature[n], tree.bin[n], tree.missing_left[n], tree.gain[n] = feature, int(code), bool(left), gain
                grown = True
    return grown


def _level_stats(codes, tree: Tree, level: int, g, rows, columns, bins: int):
    """Histograms and totals of the nodes of one level over the sampled rows."""
    first, n = 2 ** level - 1, 2 ** level
    node = tree.leaves(codes[:, rows], level) - first
    live = node >= 0  # rows that stopped at a leaf above take no part
    node, rows = node[live], rows[live]
    totals = np.stack([np.bincount(node, g[rows], n), np.bincount(node, minlength=n)])
    return histograms(codes[:, rows], node, g[rows], columns, n, bins), totals


def _winners(cand: np.ndarray, columns) -> dict[int, tuple]:
    j = cand[..., 0].argmax(1)
    return {i: (cand[i, k, 0], int(columns[k]), cand[i, k, 1], cand[i, k, 2]) for i, k in enumerate(j)}


def grow_tree(codes, g, rows, columns, bins: int, p: Params) -> Tree:
    tree = Tree.empty(p.depth)
    for level in range(p.depth + 1):
        hist, totals = _level_stats(codes, tree, level, g, rows, columns if level < p.depth else columns[:0], bins)
        cand = best_splits(hist, p) if level < p.depth else None
        if not _set_level(tree, level, _winners(cand, columns) if cand is not None else {}, totals, p):
            break
    return tree


def _stopped(curve: list[float], p: Params) -> bool:
    return bool(p.patience and curve and len(curve) - 1 - int(np.argmin(curve)) >= p.patience)


def grow_chunk(codes, y, f, fit, start: int, rounds: int, bins: int, p: Params, block: int = 0, curve: Sequence[float] = ()):
    """``rounds`` trees on one block from round ``start`` on; stops at patience.  ``f`` moves with them."""
    trees, curve = [], list(curve)
    rows_fit, rows_eval = np.flatnonzero(fit), np.flatnonzero(~fit)
    own = codes[:, rows_fit]
    for r in range(start, start + rounds):
        t = grow_tree(own, (f - y)[rows_fit], _sampled(p, r, block, len(rows_fit)), _columns(p, r, len(codes)), bins, p)
        f += t.predict(codes)
        trees.append(t)
        if len(rows_eval):
            curve.append(float(np.mean((f - y)[rows_eval] ** 2)))
            if _stopped(curve, p):
                break
    return trees, curve


# ------------------------------------------------------- one model, any size


def quantile_edges(rows: DataFrame, width: int, bins: int) -> list[np.ndarray]:
    """Up to ``bins`` distinct values of each feature that part its rows about evenly."""
    at, out = [i / bins for i in range(1, bins + 1)], []
    for i in range(0, width, 200):
        finite = [F.when(F.abs(F.col("_x")[k]) < float("inf"), F.col("_x")[k]) for k in range(i, min(i + 200, width))]
        row = rows.agg(*[F.percentile_approx(c, at, 10_000).alias(f"q{k}") for k, c in enumerate(finite)]).first()
        out += [np.unique(np.array(q or [], float)) for q in row]
    return out


_BLOCKS = pa.schema([("block", pa.int64()), ("n", pa.int64()), ("codes", pa.binary()), ("y", pa.binary()),
                     ("fit", pa.binary()), ("f", pa.binary())])
_BLOCKS_SQL = "block long, n long, codes binary, y binary, fit binary, f binary"
_STEP = _BLOCKS.append(pa.field("grown", pa.binary()))
_STEP_SQL = f"{_BLOCKS_SQL}, grown binary"


def _values(col: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """A column of arrays of ``width`` doubles as a matrix; nulls are NaN."""
    flat = (col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col).flatten()
    return np.array(flat.to_numpy(zero_copy_only=False), float).reshape(-1, width)


def _binned(edges, width: int, base: float, block_rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        block, held, size = TaskContext.get().partitionId() << 24, [], 0

        def rows(t: pa.Table, number: int) -> pa.RecordBatch:
            y = t.column("_y").to_numpy().astype("<f8")
            return pa.RecordBatch.from_pylist([{
                "block": number, "n": len(y), "codes": encode(edges, _values(t.column("_x"), width)).tobytes(), "y": y.tobytes(),
                "fit": t.column("_fit").to_numpy().astype(bool).tobytes(), "f": np.full(len(y), base).tobytes()}], _BLOCKS)

        for b in batches:
            held.append(b)
            size += b.num_rows
            while size >= block_rows:
                t = pa.Table.from_batches(held)
                yield rows(t.slice(0, block_rows), block)
                held, size, block = t.slice(block_rows).to_batches(), size - block_rows, block + 1
        if size:
            yield rows(pa.Table.from_batches(held), block)
    return run


def _unpack(row: dict):
    codes = np.frombuffer(row["codes"], np.uint8).reshape(-1, row["n"])
    return codes, np.frombuffer(row["y"], "<f8"), np.frombuffer(row["fit"], bool), np.frombuffer(row["f"], "<f8").copy()


_STATS = pa.schema([("node", pa.int32()), ("feature", pa.int32()), ("g", pa.list_(pa.float64())), ("h", pa.list_(pa.float64()))])
_STATS_SQL = "node int, feature int, g array<double>, h array<double>"


def _task_stats(trees: list[Tree], tree: Tree, level: int, round_: int, columns, bins: int, p: Params):
    """One task: the level's histograms over its blocks, one row per (node, feature); totals under
    feature -1; squared error and number of the evaluation rows under node -1."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hist = totals = None
        loss = np.zeros(2)
        for b in batches:
            for row in b.to_pylist():
                codes, y, fit, f = _unpack(row)
                for t in trees:
                    f += t.predict(codes)
                if level == 0 and not fit.all():
                    loss += ((f - y)[~fit] ** 2).sum(), (~fit).sum()
                at = np.flatnonzero(fit)
                at = at[_sampled(p, round_, row["block"], len(at))]
                a, c = _level_stats(codes, tree, level, f - y, at, columns, bins)
                hist, totals = (a, c) if hist is None else (hist + a, totals + c)
        if hist is None:
            return
        rows = [{"node": -1, "feature": -1, "g": [loss[0]], "h": [loss[1]]}]
        for i in np.flatnonzero(totals[1]).tolist():
            rows.append({"node": i, "feature": -1, "g": [totals[0, i]], "h": [totals[1, i]]})
            rows += [{"node": i, "feature": int(c), "g": hist[0, i, j], "h": hist[1, i, j]} for j, c in enumerate(columns)]
        yield pa.RecordBatch.from_pylist(rows, _STATS)
    return run


_CAND_SQL = "node int, feature int, gain double, code double, left double, g double, h double"


def _candidates(p: Params):
    def run(t: pa.Table) -> pa.Table:
        g, h = (np.sum(t.column(c).to_pylist(), axis=0) for c in ("g", "h"))
        node, feature = t.column("node")[0].as_py(), t.column("feature")[0].as_py()
        split = [None] * 3 if feature < 0 else [float(x) for x in best_splits(np.stack([g, h])[:, None, None], p)[0, 0]]
        total = [float(g[0]), float(h[0])] if feature < 0 else [None, None]
        return pa.table({n: [v] for n, v in zip(("node", "feature", "gain", "code", "left", "g", "h"),
                                               (node, feature, *split, *total))}, schema=_CAND)
    return run


_CAND = pa.schema([("node", pa.int32()), ("feature", pa.int32()), *((c, pa.float64()) for c in ("gain", "code", "left", "g", "h"))])


def _level_job(blocks: DataFrame, trees, tree, level, round_, columns, bins, p) -> tuple[dict, np.ndarray, list]:
    stats = blocks.mapInArrow(_task_stats(trees, tree, level, round_, columns if level < p.depth else columns[:0], bins, p), _STATS_SQL)
    cand = stats.groupBy("node", "feature").applyInArrow(_candidates(p), _CAND_SQL)
    total = F.col("feature") < 0
    best = cand.groupBy("node").agg(
        F.max_by(F.struct("gain", "feature", "code", "left"), F.struct("gain", -F.col("feature"))).alias("s"),
        F.max(F.when(total, F.col("g"))).alias("g"), F.max(F.when(total, F.col("h"))).alias("h")).collect()
    splits, totals, loss = {}, np.zeros((2, 2 ** level)), [0.0, 0.0]
    for r in best:
        if r.node < 0:
            loss = [r.g, r.h]
            continue
        totals[:, r.node] = r.g, r.h
        if r.s is not None and r.s.gain is not None and np.isfinite(r.s.gain):
            splits[r.node] = tuple(r.s)
    return splits, totals, loss


def _advance(trees: list[Tree]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                codes, _, _, f = _unpack(row)
                for t in trees:
                    f += t.predict(codes)
                yield pa.RecordBatch.from_pylist([{**row, "f": f.tobytes()}], _BLOCKS)
    return run


def _whole(start: int, rounds: int, bins: int, p: Params, curve: list[float]):
    """The only block grows a chunk of rounds by itself."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                codes, y, fit, f = _unpack(row)
                got = grow_chunk(codes, y, f, fit, start, rounds, bins, p, row["block"], curve)
                yield pa.RecordBatch.from_pylist([{**row, "f": f.tobytes(), "grown": pickle.dumps(got)}], _STEP)
    return run


def fit(train: DataFrame, features: Sequence[str], label: str, params: Params = BATCH, valid: DataFrame | None = None,
        chunk: int = CHUNK, block_rows: int = BLOCK_ROWS) -> Model:
    """One model on the rows of ``train``; ``valid`` rows give the validation curve."""
    features, p = list(features), params
    x = F.array(*[F.col(c).cast("double") for c in features]).alias("_x")
    some = lambda df, flag: df.where(F.abs(F.col(label)) < float("inf")).select(
        x, F.col(label).cast("double").alias("_y"), F.lit(flag).alias("_fit"))
    rows = some(train, True)
    rows = rows if valid is None else rows.unionByName(some(valid, False))
    rows = written(rows, "boost-rows")
    base = rows.where("_fit").agg(F.avg("_y")).first()[0]
    if base is None:
        raise ValueError("no row with a label")
    edges = quantile_edges(rows.where("_fit"), len(features), p.bins)
    model = Model(features, edges, base)
    bins = max([len(e) for e in edges] + [0]) + 2
    few = max(1, rows.count() // block_rows)
    blocks = written(rows.coalesce(few).mapInArrow(_binned(edges, len(features), base, block_rows), _BLOCKS_SQL), "boost-blocks")
    one, evaluated = blocks.count() == 1, valid is not None
    while len(model.trees) < p.rounds and not _stopped(model.curve, p):
        start, todo = len(model.trees), min(chunk, p.rounds - len(model.trees))
        if one:
            step = written(blocks.mapInArrow(_whole(start, todo, bins, p, model.curve), _STEP_SQL), "boost-step")
            grown, model.curve = pickle.loads(bytes(step.select("grown").first()[0]))
            blocks = step.drop("grown")
            model.trees += grown
            continue
        grown = []
        for r in range(start, start + todo):
            columns, tree = _columns(p, r, len(features)), Tree.empty(p.depth)
            for level in range(p.depth + 1):
                splits, totals, loss = _level_job(blocks, grown, tree, level, r, columns, bins, p)
                if level == 0 and evaluated and r:
                    model.curve.append(loss[0] / max(loss[1], 1))  # of the trees before this one
                if not _set_level(tree, level, splits, totals, p):
                    break
            if _stopped(model.curve, p):
                break
            grown.append(tree)
        model.trees += grown
        blocks = written(blocks.mapInArrow(_advance(grown), _BLOCKS_SQL), "boost-step")
    if evaluated and len(model.curve) < len(model.trees):
        loss = _level_job(blocks, [], Tree.empty(p.depth), 0, 0, np.zeros(0, int), bins, p)[2]
        model.curve.append(loss[0] / max(loss[1], 1))
    return model.best()


def predict(model: Model, df: DataFrame, out: str = "y_pred") -> DataFrame:
    """``df`` with the model's prediction in ``out``."""
    rows, x = df.drop(out), f"x_{uuid.uuid4().hex}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            y = model.predict(_values(b.column(b.num_columns - 1), len(model.features)))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(y)], names=[*b.schema.names[:-1], out])

    wide = rows.select("*", F.array(*[F.col(c).cast("double") for c in model.features]).alias(x))
    return wide.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(out, T.DoubleType())]))


# ------------------------------------------------------- one model per group


_MODELS = [("model", pa.binary(), "binary"), ("best_iteration", pa.int64(), "long"),
           ("curve", pa.list_(pa.float64()), "array<double>")]


def _group_schema(df: DataFrame, by: list[str], extra: str) -> str:
    return ", ".join([*(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in by), extra])


def fit_groups(rows: DataFrame, features: Sequence[str], label: str, by: Keys, role: str = "role",
               params: Params = WALK_FORWARD) -> DataFrame:
    """``(by, model, best_iteration, curve)``: one model per group, trained on the rows with ``role`` fit and
    stopped by those with ``role`` eval.  Groups without a labelled fit row have no model."""
    ks, features, p = _keys(by), list(features), params

    def run(t: pa.Table) -> pa.Table:
        y = np.array(t.column("_y").to_numpy(), float)
        use = np.isfinite(y)
        fit_rows = use & t.column("_fit").to_numpy().astype(bool)
        model = None
        if fit_rows.any():
            x = _values(t.column("_x"), len(features))
            at = np.arange(1, p.bins + 1) / p.bins
            edges = [np.unique(np.quantile(v, at, method="higher")) if len(v) else v
                     for v in (c[np.isfinite(c)] for c in x[fit_rows].T)]
            model = Model(features, edges, float(y[fit_rows].mean()))
            f = np.full(int(use.sum()), model.base)
            bins = max([len(e) for e in edges] + [0]) + 2
            model.trees, model.curve = grow_chunk(encode(edges, x[use]), y[use], f, fit_rows[use], 0, p.rounds, bins, p)
        found = [None, None, None] if model is None else [pickle.dumps(model.best()), model.best_iteration, model.curve]
        return pa.table([t.column(k).slice(0, 1) for k in ks] + [pa.array([v], a) for v, (_, a, _) in zip(found, _MODELS)],
                        names=[*ks, *(c for c, _, _ in _MODELS)])

    small = rows.where(F.col(role).isin("fit", "eval")).select(
        *ks, F.col(label).cast("double").alias("_y"), (F.col(role) == "fit").alias("_fit"),
        F.array(*[F.col(c).cast("double") for c in features]).alias("_x"))
    extra = ", ".join(f"{c} {t}" for c, _, t in _MODELS)
    return small.groupBy(*ks).applyInArrow(run, _group_schema(rows, ks, extra))


def predict_groups(rows: DataFrame, models: DataFrame, features: Sequence[str], by: Keys, out: str = "y_pred") -> DataFrame:
    """``rows`` with each group's own model's prediction; NULL where the group has no model."""
    ks, features = _keys(by), list(features)
    rows, x = rows.drop(out), f"x_{uuid.uuid4().hex}"

    def run(t: pa.Table, m: pa.Table) -> pa.Table:
        blob = m.column("model")[0].as_py() if m.num_rows else None
        y = pa.nulls(t.num_rows, pa.float64())
        if blob is not None and t.num_rows:
            y = pa.array(pickle.loads(blob).predict(_values(t.column(x), len(features))))
        return t.drop_columns([x]).append_column(out, y)

    wide = rows.select("*", F.array(*[F.col(c).cast("double") for c in features]).alias(x))
    return wide.groupBy(*ks).cogroup(models.select(*ks, "model").groupBy(*ks)).applyInArrow(
        run, T.StructType([*rows.schema.fields, T.StructField(out, T.DoubleType())]))


def importances(spark: SparkSession, model: Model, top: int = 20) -> DataFrame:
    """Average gain (as a share) and number of splits per feature, the ``top`` first."""
    gain, splits = np.zeros(len(model.features)), np.zeros(len(model.features), int)
    for t in model.trees:
        own = t.feature >= 0
        np.add.at(gain, t.feature[own], t.gain[own])
        np.add.at(splits, t.feature[own], 1)
    mean = gain / np.maximum(splits, 1)
    share = mean / (mean.sum() or 1.0)
    rows = [(f, float(s), int(n)) for f, s, n in zip(model.features, share, splits)]
    df = spark.createDataFrame(rows, "feature string, importance double, splits long")
    return df.orderBy(F.col("importance").desc(), "feature").limit(top)
