"""Near duplicates by a signature-coordinate inverted join over MinHash.

A text's signature has, for each of ``K`` hash functions, the least value over its
word shingles. Documents with equal signatures are one from there on. The others
are posted under each coordinate-value pair. Two that agree in ``T`` of ``K``
coordinates share at least ``T`` posting lists, so a signature that has company in
fewer is dropped, and of its ``s`` shared lists only the ``s - T + 1`` shortest (its
prefix) need be merged: two signatures that agree often enough meet in both
prefixes. Of lists with the very same members all but one are skipped. Within a list all collisions of a pair are counted, but a pair that also
meets in the list of an earlier coordinate is skipped, so that every pair counts
once. Long lists are cut into tiles which meet two by two. No pairs leave a list,
only the number of partners of each member and its connected part.

Defined results: a null text, or one without words, is nobody's copy; texts of any
length are read whole; rows that share an id are one document, which is linked by
each of its texts; a null id is never a copy; of each class the smallest id is the
one that stays and names it; other columns are left alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, fresh, materialise, small_batches
from .textfeat import shingles, words

K, SHINGLE, THRESHOLD = 96, 3, 0.46
#: members of a list that are held against each other at once
TILE = 2048
#: pairs, and rows, that are compared at once
_PAIRS, _ROWS = 1 << 15, 20_000


def _multipliers(k: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20)
    return rng.integers(1, 2**63, k, dtype=np.uint64) | np.uint64(1), rng.integers(0, 2**63, k, dtype=np.uint64)


def signatures_of(column: pa.Array, k: int = K, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Signature (uint32) of each text, and which texts have one."""
    out = np.zeros((len(column), k), np.uint32)
    has = np.zeros(len(column), bool)
    a, b = _multipliers(k)
    for i, _, row, h in words(column):
        row, h = shingles(row, h, n)
        if not len(h):
            continue
        if row[0] == row[-1]:  # one text, of any length
            has[row[0] + i] = True
            for lo in range(0, len(h), 1 << 14):
                x = h[lo : lo + (1 << 14)]
                v = [((x * a[c] + b[c]) >> np.uint64(32)).min() for c in range(k)]
                out[row[0] + i] = np.minimum(out[row[0] + i] if lo else 0xFFFFFFFF, np.array(v).astype(np.uint32))
            continue
        first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        at = row[first] + i
        has[at] = True
        # a block of shingles at a time stays in cache
        step = 1 << 14
        least = np.full((k, len(first)), 0xFFFFFFFF, np.uint32)
        for lo in range(0, len(h), step):
            hi = min(lo + step, len(h))
            x = h[lo:hi]
            f0, f1 = np.searchsorted(first, lo, side="right") - 1, np.searchsorted(first, hi, side="left")
            cuts = np.maximum(first[f0:f1], lo) - lo
            for c in range(k):
                v = ((x * a[c] + b[c]) >> np.uint64(32)).astype(np.uint32)
                np.minimum(least[c, f0:f1], np.minimum.reduceat(v, cuts), out=least[c, f0:f1])
        out[at] = least.T
    return out, has


def signatures(docs: DataFrame, id_col: str, text_col: str, k: int = K, n: int = SHINGLE) -> DataFrame:
    """``id`` and ``sig`` (4 bytes a coordinate) of every document that has words."""
    small_batches(docs.sparkSession)
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("id IS NOT NULL AND text IS NOT NULL")

    def run(batches):
        for batch in batches:
            sig, has = signatures_of(batch.column(1), k, n)
            keep = np.flatnonzero(has)
            data = pa.array([row.tobytes() for row in sig[keep]], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep)), data], names=["id", "sig"])

    return narrow.mapInArrow(run, T.StructType([T.StructField("id", narrow.schema["id"].dataType), T.StructField("sig", T.BinaryType())]))


def _post(sigs: DataFrame, k: int) -> DataFrame:
    """``token`` (a coordinate with its value) and ``node``."""

    def run(batches):
        for batch in batches:
            n = len(batch)
            if not n:
                continue
            sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(n, k)
            token = (np.arange(k, dtype=np.int64) << 32)[None, :] | sig.astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(token.reshape(-1)), pa.array(np.repeat(batch.column(0).to_numpy(), k))], names=["token", "node"])

    return sigs.mapInArrow(run, T.StructType([T.StructField("token", T.LongType()), T.StructField("node", T.LongType())]))


def _binary(rows: np.ndarray) -> pa.Array:
    """Each row's bytes."""
    rows = np.ascontiguousarray(rows)
    width = rows.shape[1] * rows.itemsize
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(np.arange(0, (len(rows) + 1) * width, max(width, 1), dtype=np.int32)[: len(rows) + 1].tobytes()), pa.py_buffer(rows.tobytes())])


_LISTS = T.StructType([T.StructField(n, T.LongType()) for n in ("token", "cell", "tile", "node")] + [T.StructField(n, T.BinaryType()) for n in ("sig", "held")])


def rows_of_lists(near: DataFrame, k: int) -> DataFrame:
    """Rows of the lists that are to be merged, of ``node``, its shared ``lists`` (with their tokens) and those ``merged`` (length and token).

    ``sig`` has the values of shared coordinates and ``held`` says which these are
    (1) and in which the list is merged (3). A long list is a triangle of cells;
    a row goes to those of its own tile. The cell of one tile alone is negative.
    """

    def run(batches):
        for batch in batches:
            if not len(batch):
                continue
            sig, held = np.zeros((len(batch), k), np.uint32), np.zeros((len(batch), k), np.uint8)
            row, token, _ = _flat(batch.column(1))
            sig[row, token >> 32] = token & 0xFFFFFFFF
            held[row, token >> 32] = 1
            row, token, n = _flat(batch.column(2))
            held[row, token >> 32] = 3
            node, tiles = batch.column(0).to_numpy(), -(-n // TILE)
            own = (node[row].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % tiles
            each = np.repeat(np.arange(len(row)), tiles)
            with_tile = np.arange(len(each)) - np.repeat(np.cumsum(tiles) - tiles, tiles)
            cell = np.where(own[each] == with_tile, -1 - with_tile, np.minimum(own[each], with_tile) * tiles[each] + np.maximum(own[each], with_tile))
            for lo in range(0, len(each), 5000):
                e, r = each[lo : lo + 5000], row[each[lo : lo + 5000]]
                yield pa.RecordBatch.from_arrays([pa.array(token[e]), pa.array(cell[lo : lo + 5000]), pa.array(own[e]), pa.array(node[r]), _binary(sig[r]), _binary(held[r])], schema=_ARROW_LISTS)

    return near.mapInArrow(run, _LISTS)


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, token and length of each list in an array of (length, token)."""
    flat = column.flatten()
    return np.repeat(np.arange(len(column)), np.diff(column.offsets.to_numpy())), flat.field(1).to_numpy(), flat.field(0).to_numpy()


_ARROW_LISTS = pa.schema([(n, pa.int64()) for n in ("token", "cell", "tile", "node")] + [(n, pa.binary()) for n in ("sig", "held")])


def _later(sig: np.ndarray, held: np.ndarray, x: np.ndarray, y: np.ndarray, at: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Those of the pairs of rows that agree in ``least`` coordinates, and in the prefixes first in ``at``."""
    found = [np.zeros((2, 0), np.int64)]
    for lo in range(0, len(x), _PAIRS):
        a, b, c = x[lo : lo + _PAIRS], y[lo : lo + _PAIRS], at[lo : lo + _PAIRS]
        same = (sig[a] == sig[b]) & (held[a] & held[b]).astype(bool)
        keep = np.flatnonzero(same.sum(axis=1) >= least)
        a, b, c, same = a[keep], b[keep], c[keep], same[keep]
        keep = (same & ((held[a] & held[b]) > 1)).argmax(axis=1) == c
        found.append(np.stack([a[keep], b[keep]]))
    x, y = np.concatenate(found, axis=1)
    return x, y


def _long_list(sig: np.ndarray, held: np.ndarray, tile: np.ndarray, cross: bool, at: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """:func:`_later` for all pairs of one long list; with ``cross`` those of two tiles."""
    # what isn't in the prefix equals nothing
    left = np.where(held > 1, sig, np.int64(-1)).T.copy()
    right = np.where(held > 1, sig, np.int64(-2)).T.copy()
    n = len(sig)
    found = [np.zeros((2, 0), np.int64)]
    for lo in range(0, n, 256):
        hi = min(lo + 256, n)
        alive = np.arange(n)[None, :] > np.arange(lo, hi)[:, None]
        if cross:
            alive &= tile[None, :] != tile[lo:hi, None]
        c = 0
        while c < at and np.count_nonzero(alive) > 0.05 * alive.size:
            alive &= left[c, lo:hi, None] != right[c][None, :]
            c += 1
        x, y = np.nonzero(alive)
        found.append(np.stack(_later(sig, held, x + lo, y, np.full(len(x), at), least)))
    x, y = np.concatenate(found, axis=1)
    return x, y


def _labels(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The least row that each of ``n`` rows is connected with by pairs."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def merge_lists(token: np.ndarray, cell: np.ndarray, tile: np.ndarray, sig: np.ndarray, held: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Partners of each row in its list, and the row that names its connected part there; rows are sorted by ``token`` and ``cell``."""
    n = len(token)
    first = np.flatnonzero(np.concatenate([[True], (token[1:] != token[:-1]) | (cell[1:] != cell[:-1])]))
    size = np.diff(np.concatenate([first, [n]]))
    parts = [np.zeros((2, 0), np.int64)]
    few = size <= 64
    begin = np.repeat(first, size)
    later = np.where(np.repeat(few, size), begin + np.repeat(size, size) - 1 - np.arange(n), 0)
    x = np.repeat(np.arange(n), later)
    y = np.arange(len(x)) - np.repeat(np.cumsum(later) - later, later) + x + 1
    ok = (cell[x] < 0) | (tile[x] != tile[y])
    parts.append(np.stack(_later(sig, held, x[ok], y[ok], token[x[ok]] >> 32, least)))
    for lo, many in zip(first[~few].tolist(), size[~few].tolist()):
        s = slice(lo, lo + many)
        parts.append(np.stack(_long_list(sig[s], held[s], tile[s], bool(cell[lo] >= 0), int(token[lo] >> 32), least)) + lo)
    x, y = np.concatenate(parts, axis=1)
    return np.bincount(x, minlength=n) + np.bincount(y, minlength=n), _labels(n, x, y)


def _merge(lists: DataFrame, k: int, least: int) -> DataFrame:
    """``node``, its ``links`` in a list and the ``root`` of its connected part there; rows of ``lists`` are sorted by ``token`` and ``cell``."""

    def run(batches):
        held, n = [], 0
        for batch in batches:
            if len(batch):
                held.append(batch)
                n += len(batch)
            if n >= _ROWS:
                table = pa.Table.from_batches(held).combine_chunks()
                token, cell = table.column(0).to_numpy(), table.column(1).to_numpy()
                ends = np.flatnonzero((token != token[-1]) | (cell != cell[-1]))
                if len(ends):
                    yield whole(table.slice(0, int(ends[-1]) + 1))
                    held = table.slice(int(ends[-1]) + 1).to_batches()
                n = sum(map(len, held))
                if n >= _ROWS:  # one cell so far: at most two tiles
                    n = 0
        if held:
            yield whole(pa.Table.from_batches(held).combine_chunks())

    def whole(table: pa.Table) -> pa.RecordBatch:
        token, cell, tile, node = (table.column(c).to_numpy() for c in range(4))
        sig = np.frombuffer(b"".join(table.column(4).to_pylist()), np.uint32).reshape(-1, k)
        held = np.frombuffer(b"".join(table.column(5).to_pylist()), np.uint8).reshape(-1, k)
        links, label = merge_lists(token, cell, tile, sig, held, least)
        at = np.flatnonzero(links)
        return pa.RecordBatch.from_arrays([pa.array(node[at]), pa.array(links[at].astype(np.int64)), pa.array(node[label[at]])], names=["node", "links", "root"])

    return lists.mapInArrow(run, T.StructType([T.StructField(n, T.LongType()) for n in ("node", "links", "root")]))


def partners(sigs: DataFrame, k: int = K, threshold: float = THRESHOLD) -> DataFrame:
    """For ``node`` and ``sig`` of distinct signatures: parts of the number of ``links`` of each node that has any, with a ``root`` each that it is connected with.

    The parts of a node add up to its links, and the roots connect what all links do.
    """
    least = max(int(np.ceil(threshold * k)), 1)
    posts = _post(sigs.select("node", "sig"), k)
    company = posts.groupBy("token").agg(F.count("*").alias("n")).where("n > 1")
    # written, since it is read three times
    hits = materialise(posts.join(company.hint("merge"), "token"))
    shared = hits.groupBy("node").agg(F.collect_list(F.struct("n", "token")).alias("lists")).where(F.size("lists") >= least)
    prefix = F.slice(F.array_sort("lists"), 1, F.size("lists") - (least - 1))
    rows = shared.select("node", F.explode(prefix.getField("token")).alias("token"))
    # lists with the same members have the same number of them and the same fingerprint of 128 bits
    members = rows.groupBy("token").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y")).where("n > 1")
    first = members.groupBy("n", "x", "y").agg(F.min("token").alias("token")).select("n", "token")
    merged = rows.join(first.hint("merge"), "token").groupBy("node").agg(F.collect_list(F.struct("n", "token")).alias("merged"))
    lists = rows_of_lists(shared.join(merged.hint("merge"), "node").select("node", "lists", "merged"), k)
    return _merge(lists.repartition("token", "cell").sortWithinPartitions("token", "cell"), k, least)


def components(pairs: DataFrame) -> DataFrame:
    """``id`` and the smallest ``root`` of its component, for all but the roots: alternating large and small stars.

    The table written for a round goes when the next is there.
    """
    edges = materialise(pairs.where("a < b").distinct())
    while True:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b"), F.col("a")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).where("a < b").distinct()
        low = large.groupBy(F.col("b").alias("u")).agg(F.min("a").alias("m"))
        rest = large.join(low, F.col("b") == F.col("u")).where("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b"))
        after = materialise(rest.union(low.select(F.col("m"), F.col("u"))).where("a < b").distinct())
        discard(edges)
        edges = after
        if edges.groupBy("b").count().where("count > 1").isEmpty() and edges.join(edges.select(F.col("b").alias("a")), "a", "left_semi").isEmpty():
            return edges.select(F.col("b").alias("id"), F.col("a").alias("root"))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, n: int = SHINGLE, threshold: float = THRESHOLD) -> DataFrame:
    """A row for each document that has a copy: its id, ``class_id`` (the smallest id of its class) and ``n_links``.

    ``n_links`` is the number of other signatures that the document's agrees with,
    each standing for all documents that have it; it is 0 where all copies are exact.
    A document without a row is a class of its own.
    """
    sigs = materialise(signatures(docs, id_col, text_col, k, n).withColumn("key", F.unhex(F.md5("sig"))))
    ids = sigs.select("id", "key")
    # numbers are made once, as the table is written
    nodes = materialise(sigs.groupBy("key").agg(F.min("id").alias("least"), F.max("id").alias("most"), F.min("sig").alias("sig")).withColumn("node", F.monotonically_increasing_id()))
    linked = materialise(partners(nodes, k, threshold))
    names = nodes.select("key", "node")
    several = ids.groupBy("id").agg(F.min("key").alias("key_a"), F.max("key").alias("key_b")).where("key_a <> key_b").select("id", "key_a")
    ties = ids.join(several, "id").where("key <> key_a").select("key_a", "key").distinct()
    ties = ties.join(names, "key").select("key_a", F.col("node").alias("b")).join(names, F.col("key_a") == F.col("key")).select(F.col("node").alias("a"), "b")
    pairs = linked.where("root <> node").select(F.col("root").alias("a"), F.col("node").alias("b")).union(ties)
    roots = components(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))).withColumnRenamed("id", "node")
    links = linked.groupBy("node").agg(F.sum("links").alias("links"))
    rooted = nodes.select("key", "node", "least", "most").join(links, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    size = rooted.groupBy("root").agg(F.min("least").alias("class_id"), F.count("*").alias("n"), F.max("most").alias("last"))
    named = rooted.join(size.where("n > 1 OR last <> class_id").select("root", "class_id"), "root").select("key", "class_id", F.coalesce("links", F.lit(0)).alias("links"))
    found = ids.distinct().join(named, "key").groupBy("id").agg(F.min("class_id").alias("class_id"), F.sum("links").alias("n_links"))
    return found.withColumnRenamed("id", id_col)


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **parameters) -> DataFrame:
    """``docs`` with one document of each class; all rows that have its id stay."""
    gone = fresh(docs, "gone")
    found = classes(docs, id_col, text_col, **parameters).where(F.col("class_id") != F.col(id_col))
    found = materialise(found.select(F.col(id_col).alias(gone)))
    return docs.join(found, F.col(id_col) == F.col(gone), "left_anti")
