"""Exact nearest neighbours by columnar branch and bound.

The queries are the rows whose id is divisible by ``EVERY``; each is held against
all rows. Vectors are packed in blocks that hold one dimension after another, near
ones together. A sample of rows gives every query a first bound, which a block must
beat: one whose centre is farther off than the bound and its radius is skipped. Else
squared distances are accumulated dimension block by dimension block; what the
dimensions to come can add is at least the squared difference of the two remaining
norms. Pairs whose sum with that bound exceeds the query's k-th best distance are
dropped, and once few are left they are compacted and finished pair by pair.

Vectors of doubles are searched in double precision, others in single; distances are
always taken in double precision of the values given.

Defined results: ids are whole numbers (another type is an error); rows with a null
id, a null vector or element, a value that isn't finite (or whose square isn't), or
another length than most vectors have, take no part; rows with the same
id are no neighbours of each other; ties go to the smaller id, and repeated ids take
a place each; a query has fewer than ``k`` rows where there aren't as many vectors.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise, ship

K, EVERY, BLOCK, QUERIES, DIMENSIONS = 10, 100, 2048, 256, 16
#: rows that give the queries their first bound, and of these the ones around which a task's vectors are gathered in blocks
SAMPLE, PIVOTS = 1024, 64
#: pairs left below this share are compacted
SPARSE = 0.04
_BLOCKS = T.StructType([T.StructField("ids", T.BinaryType()), T.StructField("data", T.BinaryType())])
_FOUND = T.StructType([T.StructField("id", T.LongType()), T.StructField("d2", T.DoubleType()), T.StructField("neighbor_id", T.LongType())])


def vectors_of(vectors: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, int, type]:
    """``id`` and ``v`` of the rows that take part (but for values that aren't finite), the number of dimensions, and numpy's type of a value."""
    if not isinstance(vectors.schema[id_col].dataType, T.IntegralType):
        raise TypeError(f"{id_col} must be a whole number")
    wide = isinstance(vectors.schema[vector_col].dataType.elementType, T.FloatType)
    clean = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<float>" if wide else "array<double>").alias("v")).where("id IS NOT NULL AND v IS NOT NULL AND size(v) > 0")
    most = clean.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    d = most["n"] if most else 0
    return clean.where(F.size("v") == d), d, np.float32 if wide else np.float64


def _rows(batch: pa.RecordBatch, d: int, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of a batch whose squared norms are finite."""
    data = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(-1, d)
    with np.errstate(over="ignore", invalid="ignore"):
        fine = np.isfinite((data * data).sum(axis=1) * 8)
    return batch.column(0).to_numpy()[fine], data[fine]


def pack(clean: DataFrame, d: int, kind: type, pivots: np.ndarray) -> DataFrame:
    """Blocks of ids (8 bytes each) and of values (dimension by dimension); the vectors of a batch are ordered by their nearest pivot."""
    shipped = ship(clean.sparkSession, pivots)

    def block(ids: np.ndarray, data: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([ids.tobytes()], pa.binary()), pa.array([np.ascontiguousarray(data.T).tobytes()], pa.binary())], names=["ids", "data"])

    def ordered(parts: list):
        ids, data = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        near = shipped()
        if len(near):
            order = np.argsort((-2.0 * data @ near.T + (near * near).sum(axis=1)).argmin(axis=1), kind="stable")
            ids, data = ids[order], data[order]
        for lo in range(0, len(ids), BLOCK):
            yield block(ids[lo : lo + BLOCK], data[lo : lo + BLOCK])

    def run(batches):
        held, n = [], 0
        for batch in batches:
            if len(batch):
                held.append(_rows(batch, d, kind))
                n += len(held[-1][0])
            if n >= 16 * BLOCK:
                yield from ordered(held)
                held, n = [], 0
        if n:
            yield from ordered(held)

    return clean.mapInArrow(run, _BLOCKS)


class Best:
    """The k best neighbours so far of a block of queries, none farther than ``limit`` (squared)."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, k: int, limit: np.ndarray | None = None):
        self.ids, self.q, self.k = ids, q, k
        self.limit = np.full(len(ids), np.inf) if limit is None else limit.copy()
        self.row, self.d2, self.near = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
        self.skipped = 0

    def add(self, row: np.ndarray, d2: np.ndarray, near: np.ndarray) -> None:
        row, d2, near = np.concatenate([self.row, row]), np.concatenate([self.d2, d2]), np.concatenate([self.near, near])
        order = np.lexsort((near, d2, row))
        row, d2, near = row[order], d2[order], near[order]
        first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if len(row) else np.zeros(0, np.int64)
        rank = np.arange(len(row)) - np.repeat(first, np.diff(np.concatenate([first, [len(row)]])))
        keep = rank < self.k
        last = rank == self.k - 1
        self.limit[row[last]] = np.minimum(self.limit[row[last]], d2[last])
        self.row, self.d2, self.near = row[keep], d2[keep], near[keep]


def search_block(best: Best, x_ids: np.ndarray, x: np.ndarray) -> None:
    """Show one block of vectors (dimension by dimension) to a block of queries of the same type."""
    d, kind = len(x), x.dtype.type
    edges = [*range(0, d, DIMENSIONS), d]
    x_rest = np.sqrt(np.concatenate([np.cumsum((x**2)[::-1], axis=0)[::-1], np.zeros((1, x.shape[1]), kind)]))
    x_square = [(x[a:b] ** 2).sum(axis=0) for a, b in zip(edges, edges[1:])]
    centre = x.mean(axis=1, dtype=np.float64)
    radius = float(np.sqrt(((x - centre[:, None]) ** 2).sum(axis=0).max())) * (1 + 1e-9)
    for lo in range(0, len(best.ids), QUERIES):
        q = best.q[lo : lo + QUERIES]
        hi = lo + len(q)
        off = np.sqrt(((q - centre) ** 2).sum(axis=1)) * (1 - 1e-9) - radius
        if (np.maximum(off, 0) ** 2 > best.limit[lo:hi]).all():
            best.skipped += 1
            continue
        q_rest = np.sqrt(np.concatenate([np.cumsum((q**2)[:, ::-1], axis=1)[:, ::-1], np.zeros((len(q), 1), kind)], axis=1))
        # sums of so many rounded products are off by less than this; distances that count are computed again in float64
        slack = kind((d + 16) * 2 * np.finfo(kind).eps * (float(q_rest[:, 0].max()) + float(x_rest[0].max())) ** 2 + 1e-30)
        with np.errstate(over="ignore"):
            limit = (best.limit[lo:hi] + float(slack)).astype(kind)[:, None]
        limit = np.nextafter(limit, kind(np.inf))
        other = best.ids[lo:hi, None] != x_ids[None, :]
        d2 = np.zeros((len(q), x.shape[1]), kind)
        pairs = None
        for n, (a, b) in enumerate(zip(edges, edges[1:])):
            if pairs is None:
                part = q[:, a:b] @ x[a:b]
                part *= -2
                part += x_square[n]
                part += (q[:, a:b] ** 2).sum(axis=1)[:, None]
                d2 += part
                if b == d:
                    break
                gap = q_rest[:, b][:, None] - x_rest[b][None, :]
                gap *= gap
                gap += d2
                alive = gap <= limit
                if np.count_nonzero(alive) < SPARSE * alive.size:
                    r, c = np.nonzero(alive & other)
                    pairs = r, c, d2[r, c]
            else:
                r, c, s = pairs
                s = s + ((q[r, a:b] - x[a:b, c].T) ** 2).sum(axis=1)
                keep = s + (q_rest[r, b] - x_rest[b, c]) ** 2 <= limit[r, 0]
                pairs = r[keep], c[keep], s[keep]
        if pairs is None:
            d2[~other] = np.inf
            if d2.shape[1] > best.k:
                limit = np.minimum(limit, np.partition(d2, best.k - 1, axis=1)[:, best.k - 1 : best.k] + 2 * slack)
            r, c = np.nonzero((d2 <= limit) & other)
        else:
            r, c, _ = pairs
        exact = np.empty(len(r))
        for i in range(0, len(r), 1 << 16):
            s = slice(i, i + (1 << 16))
            exact[s] = ((q[r[s]].astype(np.float64) - x[:, c[s]].T.astype(np.float64)) ** 2).sum(axis=1)
        best.add(r + lo, exact, x_ids[c])


def _first_bounds(ids: np.ndarray, q: np.ndarray, sample_ids: np.ndarray, sample: np.ndarray, k: int) -> np.ndarray:
    """Squared distance within which each query has ``k`` neighbours, from a sample of the rows."""
    best = Best(ids, q, k)
    if len(sample_ids):
        search_block(best, sample_ids, np.ascontiguousarray(sample.T))
    return best.limit


def nearest(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, every: int = EVERY) -> DataFrame:
    """For every vector whose id is divisible by ``every`` its ``k`` nearest others: the id, ``rank`` from 1, ``neighbor_id`` and the Euclidean ``distance``.

    Blocks of queries meet blocks of vectors, so that the work is the product of the two.
    """
    clean, d, kind = vectors_of(vectors, id_col, vector_col)
    drawn = clean.orderBy(F.xxhash64("id"), "id", F.xxhash64("v")).limit(SAMPLE).toArrow().to_batches()
    drawn = [_rows(b, d, kind) for b in drawn if len(b)] or [(np.zeros(0, np.int64), np.zeros((0, d), kind))]
    s_ids, s_data = (np.concatenate([p[n] for p in drawn]) for n in (0, 1))
    blocks = materialise(pack(clean, d, kind, s_data[:PIVOTS]))
    queries = materialise(pack(materialise(clean.where(F.col("id") % every == 0)), d, kind, s_data[:PIVOTS]))
    sample = ship(vectors.sparkSession, (s_ids, s_data))

    def run(batches):
        best, held = None, None
        for batch in batches:
            for q_ids, q_data, x_ids, x_data in zip(*[batch.column(i) for i in range(4)]):
                raw = q_ids.as_py()
                if held != raw:
                    if best is not None:
                        yield found(best)
                    ids = np.frombuffer(raw, np.int64)
                    q = np.ascontiguousarray(np.frombuffer(q_data.as_py(), kind).reshape(d, -1).T)
                    best, held = Best(ids, q, k, _first_bounds(ids, q, *sample(), k)), raw
                search_block(best, np.frombuffer(x_ids.as_py(), np.int64), np.frombuffer(x_data.as_py(), kind).reshape(d, -1))
        if best is not None:
            yield found(best)

    def found(best: Best) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(best.ids[best.row]), pa.array(best.d2), pa.array(best.near)], names=["id", "d2", "neighbor_id"])

    partial = queries.select(F.col("ids").alias("q_ids"), F.col("data").alias("q_data")).crossJoin(blocks).mapInArrow(run, _FOUND)
    ranked = partial.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy("d2", "neighbor_id"))).where(F.col("rank") <= k)
    return ranked.select(F.col("id").alias(id_col), F.col("rank").cast("int").alias("rank"), "neighbor_id", F.round(F.sqrt("d2"), 5).alias("distance"))


def oracle(k: int = K, every: int = EVERY) -> str:
    """DuckDB SQL for the rows of :func:`nearest` over ``embeddings``."""
    return f"""
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE embedding IS NOT NULL),
p AS (SELECT a.vec_id, b.vec_id AS neighbor_id, list_distance(a.v, b.v) AS d FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % {every} = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, neighbor_id) AS rank FROM p)
SELECT vec_id, CAST(rank AS INTEGER) AS rank, neighbor_id, round(d, 5) AS distance FROM r WHERE rank <= {k}"""
