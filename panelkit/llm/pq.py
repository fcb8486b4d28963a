"""Embedding near-duplicates by product quantisation over coarse inverted lists.

1. *Classes.*  Equal vectors are one class with a count, however many there are.
2. *Fit.*  On a bounded sample (``SAMPLE`` classes by hash) k-means gives the coarse
   centroids, and k-means in each of ``PARTS`` subspaces of the residuals gives
   the codebooks.  Every class is indexed: in the list of its nearest centroid,
   with its residual's code and the code's exact error.
3. *Probes.*  Every class looks into the lists of its ``PROBES`` nearest centroids.
   A table of distances to the codebooks gives its asymmetric distance to every
   code of a list; a partner is a candidate if that distance is at most the link
   radius plus the partner's code error.  By the triangle inequality this loses
   no link; the probes alone decide the recall (measured in the tests).
4. *Rerank.*  Candidates are compared by exact cosine in double precision.

A pair may be met from either side.  The one that probes counts it; it counts
for the other side too unless that one's probes meet it as well, so every link
found counts once at both ends.  Lists are cut into tiles of up to ``ENTRIES``
indexed and ``PROBERS`` probing classes, so a hot list spreads over tasks; a tile
returns one count per class and a spanning forest of its links, never pairs.

Defined results: vectors that are null, empty, zero or hold null or non-finite
components link with nothing, not even their copies; vectors of different
lengths compare as if the shorter ended in zeros; repeated rows are copies, each
a link; a component's id is its smallest vec_id, nulls last; ``kept`` compares
null-safe; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelkit.llm.components import components
from panelkit.llm.store import stored

COSINE = 0.95
SAMPLE = 32_768
PARTS = 8
CODES = 256
LIST_SIZE = 512
MIN_LISTS, MAX_LISTS = 16, 2048
PROBES = 8
ENTRIES = 4096
PROBERS = 8192
ROUNDS = 8
_CHUNK = 64

_ROWS = pa.schema([("vec_id", pa.int64()), ("h", pa.binary()), ("v", pa.binary())])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row's vector scaled to a largest component of 1, as bytes, with a hash; both null if it has no direction."""
    for b in batches:
        hs, vs = [], []
        for x in b.column(1):
            v = None
            if x.is_valid and len(x) and not x.values.null_count:
                raw = x.values.to_numpy(zero_copy_only=False).astype(np.float64)
                if np.isfinite(raw).all() and raw.any():
                    v = np.trim_zeros(raw + 0.0, "b").astype("<f8")
            vs.append(None if v is None else v.tobytes())
            hs.append(None if v is None else hashlib.md5(vs[-1]).digest())
        yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(hs, pa.binary()), pa.array(vs, pa.binary())],
                                         schema=_ROWS)


def _units(blobs: list[bytes], width: int) -> np.ndarray:
    out = np.zeros((len(blobs), width))
    for row, b in zip(out, blobs):
        v = np.frombuffer(b, "<f8")
        v = v / np.abs(v).max()
        row[: len(v)] = v / np.sqrt(v @ v)
    return out


def _nearest(x: np.ndarray, c: np.ndarray, k: int = 1) -> np.ndarray:
    """The ``k`` nearest centroids of each row, nearest first."""
    out = np.empty((len(x), k), np.int32)
    for i in range(0, len(x), 4096):
        d = (c * c).sum(1) - 2 * x[i: i + 4096] @ c.T
        if k == 1:
            out[i: i + 4096, 0] = d.argmin(1)
        else:
            part = np.argpartition(d, k - 1, axis=1)[:, :k]
            out[i: i + 4096] = np.take_along_axis(part, np.take_along_axis(d, part, 1).argsort(1, kind="stable"), 1)
    return out


def _kmeans(x: np.ndarray, k: int) -> np.ndarray:
    """``k`` centroids from evenly spaced rows on, by ``ROUNDS`` rounds of Lloyd's method; empty ones stay."""
    c = x[np.linspace(0, len(x) - 1, k).astype(np.int64)].copy()
    for _ in range(ROUNDS):
        own = _nearest(x, c)[:, 0]
        n = np.bincount(own, minlength=k)
        order = np.argsort(own, kind="stable")
        some = np.flatnonzero(n)
        c[some] = np.add.reduceat(x[order], (np.cumsum(n) - n)[some], axis=0) / n[some, None]
    return c


class Quantiser:
    """Coarse centroids and the codebooks of the residuals' subspaces."""

    def __init__(self, sample: np.ndarray, lists: int, parts: int = PARTS, codes: int = CODES):
        self.centroids = _kmeans(sample, min(lists, len(sample)))
        rest = self.split(sample - self.centroids[_nearest(sample, self.centroids)[:, 0]], parts)
        self.books = [_kmeans(np.ascontiguousarray(r), min(codes, len(sample))) for r in rest]

    @staticmethod
    def split(x: np.ndarray, parts: int) -> list[np.ndarray]:
        return np.array_split(x, min(parts, x.shape[1]), axis=1)

    def encode(self, x: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the residuals, and the distances from what they decode to."""
        rest = self.split(x - self.centroids[home], len(self.books))
        code = np.stack([_nearest(r, b)[:, 0] for r, b in zip(rest, self.books)], 1)
        gap = sum(((r - b[c]) ** 2).sum(1) for r, b, c in zip(rest, self.books, code.T))
        return code.astype(np.uint8), np.sqrt(gap)

    def distances(self, x: np.ndarray, home: int, code: np.ndarray) -> np.ndarray:
        """Asymmetric distances of the rows of ``x`` from the codes of a list, by table lookup."""
        out = np.zeros((len(x), len(code)), np.float32)
        for r, b, c in zip(self.split(x - self.centroids[home], len(self.books)), self.books, code.T):
            table = (r * r).sum(1)[:, None] - 2 * r @ b.T + (b * b).sum(1)
            out += table.astype(np.float32)[:, c]
        return np.sqrt(np.maximum(out, 0))


_INDEX = pa.schema([("rid", pa.int64()), ("times", pa.int64()), ("v", pa.binary()), ("home", pa.int32()),
                    ("probes", pa.list_(pa.int32())), ("code", pa.binary()), ("gap", pa.float64())])
_INDEX_SQL = "rid long, times long, v binary, home int, probes array<int>, code binary, gap double"


def _index(model, width: int, probes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = model.value
        for b in batches:
            x = _units(b.column(2).to_pylist(), width)
            if not len(x):
                continue
            near = _nearest(x, q.centroids, min(probes, len(q.centroids)))
            code, gap = q.encode(x, near[:, 0])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), b.column(2), pa.array(near[:, 0]), pa.array(list(near), pa.list_(pa.int32())),
                 pa.array([c.tobytes() for c in code], pa.binary()), pa.array(gap)], schema=_INDEX)
    return run


_TILE = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("links", pa.int64())])
_TILE_SQL = "u long, v long, links long"


def _tile(model, width: int, cosine: float):
    """The links between the probing and the indexed classes of one tile: ``(u, null, links)``
    per class with links, ``(u, v, 0)`` for a spanning forest."""
    radius = np.sqrt(max(0.0, 2 - 2 * cosine)) + 1e-3

    def run(probing: pa.Table, indexed: pa.Table) -> pa.Table:
        if not probing.num_rows or not indexed.num_rows:
            return _TILE.empty_table()
        q, home = model.value, indexed.column("list")[0].as_py()
        col = lambda t, c: t.column(c).to_numpy()
        ax, ay = col(probing, "rid"), col(indexed, "rid")
        tx, ty = col(probing, "times"), col(indexed, "times")
        hx = col(probing, "home")
        x, y = (_units(t.column("v").to_pylist(), width) for t in (probing, indexed))
        code = np.frombuffer(b"".join(indexed.column("code").to_pylist()), np.uint8).reshape(len(y), -1)
        limit = (radius + col(indexed, "gap")).astype(np.float32)
        looks = np.array(indexed.column("probes").to_pylist(), np.int32)
        nx, ny = np.zeros(len(x), np.int64), np.zeros(len(y), np.int64)
        root, edges = ay.copy(), []
        for a in range(0, len(x), _CHUNK):
            i, j = np.nonzero(q.distances(x[a: a + _CHUNK], home, code) <= limit)
            i += a
            other = ax[i] != ay[j]
            i, j = i[other], j[other]
            links = np.concatenate([np.einsum("ij,ij->i", x[i[s: s + 65536]], y[j[s: s + 65536]]) >= cosine
                                    for s in range(0, len(i), 65536)]) if len(i) else np.zeros(0, bool)
            i, j = i[links], j[links]
            np.add.at(nx, i, ty[j])
            alone = (looks[j] != hx[i][:, None]).all(1)
            np.add.at(ny, j[alone], tx[i[alone]])
            for p, s, n in zip(*np.unique(i, return_index=True, return_counts=True)):
                met = np.unique(root[j[s: s + n]])
                edges += [(int(ax[p]), int(m)) for m in met if m != ax[p]]
                if len(met) > 1:
                    root[np.isin(root, met)] = met[0]
        u = np.concatenate([ax[nx > 0], ay[ny > 0], np.array([e[0] for e in edges], np.int64)])
        v = [None] * (len(u) - len(edges)) + [e[1] for e in edges]
        n = np.concatenate([nx[nx > 0], ny[ny > 0], np.zeros(len(edges), np.int64)])
        return pa.Table.from_arrays([pa.array(u), pa.array(v, pa.int64()), pa.array(n)], schema=_TILE)
    return run


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, probes: int = PROBES,
                    sample: int = SAMPLE) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for each row of ``vectors(vec_id, embedding)``."""
    spark = vectors.sparkSession
    rows = stored(vectors.select(F.col("vec_id").cast("long"), "embedding").mapInArrow(_rows, "vec_id long, h binary, v binary"), "vectors")
    classes = rows.where("h is not null").groupBy("h").agg(
        F.count(F.lit(1)).alias("times"), F.min("vec_id").alias("low"), F.first("v").alias("v"))
    classes = stored(classes.select(F.monotonically_increasing_id().alias("rid"), "*"), "classes")
    size, width = classes.agg(F.count(F.lit(1)), F.max(F.octet_length("v") / 8).cast("int")).first()
    if size:
        # a sample of a fixed size, the same rows on every run
        some = classes.select("h", "v").orderBy(F.xxhash64("h"), "h").limit(sample).toPandas()["v"]
        lists = min(MAX_LISTS, max(MIN_LISTS, 1 << round(np.log2(max(size / LIST_SIZE, 1)))))
        model = spark.sparkContext.broadcast(Quantiser(_units([bytes(v) for v in some], width), lists))
        index = stored(classes.select("rid", "times", "v").mapInArrow(_index(model, width, probes), _INDEX_SQL), "index")
        found = stored(_links(index, model, width, cosine), "links")
    else:
        found = spark.createDataFrame([], _TILE_SQL)
    counts = found.where("v is null").groupBy("u").agg(F.sum("links").alias("links"))
    groups = components(found.where("v is not null").select("u", "v"))
    named = classes.join(counts, F.col("rid") == counts["u"], "left").drop("u") \
        .join(groups.select(F.col("u").alias("rid"), F.col("v").alias("label")), "rid", "left") \
        .select("h", "low", F.coalesce("label", "rid").alias("label"),
                (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("n_links"))
    named = stored(named, "named")
    low = named.groupBy("label").agg(F.min("low").alias("component_id"))
    named = named.join(low, "label").select("h", "n_links", "component_id")
    out = rows.where("h is not null").select("vec_id", "h").join(named, "h").select("vec_id", "n_links", "component_id")
    none = rows.where("h is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(none).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _links(index: DataFrame, model, width: int, cosine: float) -> DataFrame:
    probing = index.select(F.explode("probes").alias("list"), "rid", "times", "v", "home")
    indexed = index.select(F.col("home").alias("list"), *[F.col(c).alias(c) for c in ("rid", "times", "v", "probes", "code", "gap")])
    # one row per list, at most MAX_LISTS
    tiles = indexed.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / ENTRIES).cast("int").alias("parts")).join(
        probing.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / PROBERS).cast("int").alias("shares")), "list")
    tiles = F.broadcast(stored(tiles, "tiles"))
    own = F.xxhash64("rid")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    indexed = indexed.join(tiles, "list").withColumn("part", F.pmod(own, F.col("parts")).cast("int")) \
        .withColumn("share", all_of("shares")).drop("parts", "shares")
    probing = probing.join(tiles, "list").withColumn("share", F.pmod(own, F.col("shares")).cast("int")) \
        .withColumn("part", all_of("parts")).drop("parts", "shares")
    tile = ["list", "part", "share"]
    return probing.groupBy(*tile).cogroup(indexed.groupBy(*tile)).applyInArrow(_tile(model, width, cosine), _TILE_SQL)
