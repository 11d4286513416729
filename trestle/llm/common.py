"""Pieces that the operators of this subpackage share."""

from __future__ import annotations

import sys
import tempfile
import uuid
from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: rows that go to a Python worker at once, where the session leaves it at Spark's default; texts are long
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of texts small, unless the session says otherwise."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables in ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """This application's folder below the one that all executors share, as ``spark.checkpoint.dir`` names it.

    A local session without that setting (tests, a shell) gets a folder of its own;
    on a cluster it is an error. The folder goes when the driver's file system is closed.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="trestle-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/trestle-{spark.sparkContext.applicationId}"
    if path not in _SCRATCH:
        _SCRATCH.add(path)
        fs, where = _file_system(spark, path)
        fs.mkdirs(where)
        fs.deleteOnExit(where)
    return path


_SCRATCH: set[str] = set()


def _file_system(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again.

    Cuts the lineage: later jobs start from files that outlive executors.
    """
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    again = df.sparkSession.read.schema(df.schema).parquet(path)
    again._trestle_path = path
    return again


def discard(df: DataFrame) -> None:
    """Delete what :func:`materialise` wrote for ``df``; nothing may read it any more."""
    fs, where = _file_system(df.sparkSession, df._trestle_path)
    fs.delete(where, True)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores behind it until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def worker_cache() -> dict:
    """A dictionary that lives as long as the Python worker process."""
    return sys.__dict__.setdefault("_trestle_cache", {})


def ship(spark: SparkSession, value):
    """Broadcast ``value`` and return a function that gives it on a worker, which needs no copy of this package."""
    small_batches(spark)
    data = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    key = uuid.uuid4().hex

    def get():
        kept = worker_cache().setdefault("shipped", {})
        if key not in kept:
            while len(kept) >= 4:
                kept.pop(next(iter(kept)))
            kept[key] = cloudpickle.loads(data.value)
        return kept[key]

    return get


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column without a copy, with start and end of every row.

    A null row starts and ends at 0.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if large else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    starts, ends = at[:-1].copy(), at[1:].copy()
    if column.null_count:
        null = ~np.asarray(column.is_valid())
        starts[null] = ends[null] = 0
    return buf, starts, ends


def row_key(id_col: str, text_col: str):
    """64-bit key of a row made of its content, the same on every recomputation."""
    return F.xxhash64(F.col(id_col), F.col(text_col))


def sample_rows(df: DataFrame, limit: int, files: int = 8) -> DataFrame:
    """At most ``limit`` rows of ``df``; of a bare Parquet scan with several files, as many from each of up to ``files`` evenly spaced ones.

    Pass the scan itself and select afterwards: anything but a scan gives the rows
    that come first.
    """
    names = sorted(df.inputFiles())
    if len(names) < 2 or df._jdf.queryExecution().analyzed().getClass().getSimpleName() != "LogicalRelation":
        return df.limit(limit)
    n = min(files, len(names), limit)
    each = [df.sparkSession.read.schema(df.schema).parquet(names[i * len(names) // n]).limit(limit // n) for i in range(n)]
    return reduce(DataFrame.unionAll, each)


def spread_sample(docs: DataFrame, text_col: str, group: Column, quotas: Callable[[dict[str, int]], dict[str, int]]) -> list[tuple[str, str]]:
    """Different texts of the whole table with their group (a string): of each group as many as ``quotas`` makes of the rows of all groups, those with the least hash.

    Rows without text or group are left out before anything is counted. The texts
    are hashed in one pass, and only those chosen are read in another.
    """
    spark = docs.sparkSession
    keys = materialise(docs.where(F.length(text_col) > 0).select(group.alias("g"), F.xxhash64(F.col(text_col)).alias("k")).where("g IS NOT NULL"))
    quota = quotas({r["g"]: r["count"] for r in keys.groupBy("g").count().collect()})

    def least(batches):
        kept: dict[str, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            names = batch.column(0).dictionary_encode()
            of, k = names.indices.to_numpy(), batch.column(1).to_numpy()
            for i, name in enumerate(names.dictionary.to_pylist()):
                kept[name] = np.unique(np.concatenate([kept.get(name, k[:0]), k[of == i]]))[: quota[name]]
        rows = [(name, k) for name, ks in kept.items() for k in ks.tolist()]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64())], names=["g", "k"])

    chosen = [(r["k"], r["g"]) for r in keys.mapInArrow(least, keys.schema).repartition(1).mapInArrow(least, keys.schema).collect()]
    if not chosen:
        return []
    wanted = F.broadcast(spark.createDataFrame(sorted({(k,) for k, _ in chosen}), "k long"))
    found = docs.where(F.length(text_col) > 0).select(F.xxhash64(F.col(text_col)).alias("k"), F.col(text_col).alias("t")).join(wanted, "k", "left_semi")
    texts = {r["k"]: r["t"] for r in found.groupBy("k").agg(F.min("t").alias("t")).collect()}
    return [(texts[k], g) for k, g in sorted(chosen)]
