"""Web archives: reading, writing, and the resolution of revisit records.

Headers alone are shuffled by payload digest. In each digest the response with the
smallest id (nulls aside) is the original; later responses with the same payload become revisit
records, and revisit records that came without a payload are joined to it. The
archive is then written with fresh headers: a ``warcinfo`` record, then the others,
each a member of gzip of its own, so that a reader can seek. Record ids are made of
content and the date is taken once, so a task that runs again writes the same bytes;
a file gets its name when it is whole.

Defined results: a null payload of a response counts as empty; a null address
becomes ``urn:unknown``; a revisit without an original stays, referring to nothing;
rows that share an id and a payload are one capture and are written alike; a response
without an id stays a response and is nobody's original, a revisit without an id is
joined to the original of its digest; other columns are left alone; an empty table makes an empty archive.
"""

from __future__ import annotations

import gzip
import os
import uuid
import zlib
from datetime import UTC, datetime

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import shared_dir

_END = "\r\n\r\n"
RECORD = T.StructType([T.StructField("record_id", T.StringType()), T.StructField("type", T.StringType()), T.StructField("uri", T.StringType()), T.StructField("digest", T.StringType()), T.StructField("refers_to", T.StringType()), T.StructField("payload", T.StringType())])


def captures(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Pages as captured responses: ``id``, ``kind``, ``uri``, ``digest``, ``payload``."""
    payload = F.coalesce(F.col(html_col), F.lit(""))
    return pages.select(F.col(id_col).alias("id"), F.lit("response").alias("kind"), F.col(url_col).alias("uri"), F.sha2(payload, 256).alias("digest"), payload.alias("payload"))


def resolve(records: DataFrame) -> DataFrame:
    """Headers of ``records`` (as :func:`captures` gives them, with or without revisits) and the original of each.

    Adds ``refers_to`` and ``refers_uri``, null for an original and for a revisit
    that has none, and sets ``kind`` to what the record becomes.
    """
    rows = records.select("id", "kind", "uri", "digest")
    first = rows.where("kind = 'response' AND id IS NOT NULL").groupBy("digest").agg(F.min(F.struct("id", "uri")).alias("first"))
    repeats = (F.col("kind") == "revisit") | (F.col("id") != F.col("first.id"))
    return rows.join(first, "digest", "left").select("id", "uri", "digest", F.when(repeats, "revisit").otherwise("response").alias("kind"), F.when(repeats, F.col("first.id")).alias("refers_to"), F.when(repeats, F.col("first.uri")).alias("refers_uri"))


def _urn(*parts: Column) -> Column:
    h = F.sha2(F.concat_ws("|", *parts), 256)
    return F.concat(F.lit("<urn:uuid:"), *[x for a, n, dash in ((1, 8, "-"), (9, 4, "-"), (14, 3, "-"), (18, 3, "-"), (21, 12, "")) for x in (F.lit({14: "5", 18: "8"}.get(a, "")), F.substring(h, a, n), F.lit(dash))], F.lit(">"))


def _clean(uri: Column) -> Column:
    return F.regexp_replace(F.coalesce(uri, F.lit("urn:unknown")), r"[\x00-\x20]+", "%20")


def record_text(captured: str) -> Column:
    """A whole record, without the two line ends that close it, of a row with ``id kind uri digest refers_to refers_uri payload``."""
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length("payload").cast("string"), F.lit(_END))
    response = F.col("kind") == "response"
    body = F.when(response, F.concat(http, F.col("payload"))).otherwise(F.lit("HTTP/1.1 200 OK" + _END))
    ident = lambda i, u: _urn(i.cast("string"), F.coalesce(u, F.lit("")), F.col("digest"))
    revisit = F.concat(
        F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
        F.when(F.col("refers_to").isNotNull(), F.concat(F.lit("\r\nWARC-Refers-To: "), ident(F.col("refers_to"), F.col("refers_uri")), F.lit("\r\nWARC-Refers-To-Target-URI: "), _clean(F.col("refers_uri")))).otherwise(""),
    )
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "),
        F.col("kind"),
        F.lit("\r\nWARC-Record-ID: "),
        ident(F.coalesce(F.col("id").cast("string"), F.lit("")), F.col("uri")),
        F.lit(f"\r\nWARC-Date: {captured}\r\nWARC-Target-URI: "),
        _clean(F.col("uri")),
        F.lit("\r\nWARC-Payload-Digest: sha256:"),
        F.col("digest"),
        F.when(response, "").otherwise(revisit),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "),
        F.octet_length(body).cast("string"),
        F.lit(_END),
        body,
    )


_WRITTEN = T.StructType([T.StructField("file", T.StringType()), T.StructField("records", T.LongType()), T.StructField("bytes", T.LongType())])


def _info(name: str, captured: str) -> bytes:
    body = b"software: trestle\r\nformat: WARC File Format 1.1\r\n"
    head = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name + captured)}>\r\nWARC-Date: {captured}\r\nWARC-Filename: {name}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(body)}{_END}"
    return head.encode() + body


def _member(raw: bytes) -> bytes:
    """A record as a member of gzip, the same bytes each time."""
    c = zlib.compressobj(6, zlib.DEFLATED, 31)
    return c.compress(raw + _END.encode()) + c.flush()


def _writer(path: str, captured: str):
    """Writes the records of a task as one file; it is renamed when whole, so that a task that is lost leaves no archive behind."""

    def run(batches):
        from pyarrow import fs

        name = f"part-{TaskContext.get().partitionId():05d}.warc.gz"
        where, inner = fs.FileSystem.from_uri(path)
        half = f"{inner}/_{name}.{TaskContext.get().taskAttemptId()}"
        records = size = 0
        out = None
        for batch in batches:
            for raw in batch.column(0):
                if out is None:
                    where.create_dir(inner, recursive=True)
                    out = where.open_output_stream(half, compression=None)
                    out.write(_member(_info(name, captured)))
                size += out.write(_member(raw.as_buffer().to_pybytes()))
                records += 1
        if out is not None:
            out.close()
            where.move(half, f"{inner}/{name}")
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([records], pa.int64()), pa.array([size], pa.int64())], names=_WRITTEN.names)

    return run


def write_archive(records: DataFrame, path: str, captured: str | None = None) -> DataFrame:
    """Resolve ``records`` and write them as gzipped archives below ``path``, dated ``captured`` (now, unless given); returns their headers.

    Payloads stay where they are read unless the repeats outgrow a broadcast: then
    they move once, by record id.
    """
    captured = captured or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    path = path if "://" in path else "file://" + os.path.abspath(path)
    headers = resolve(records)
    repeats = headers.where("kind = 'revisit'").select(F.col("id").alias("_id"), F.col("digest").alias("_digest"), F.lit("revisit").alias("_kind"), "refers_to", "refers_uri").distinct()
    same = (F.col("digest") == F.col("_digest")) & F.col("id").eqNullSafe(F.col("_id")) & (F.col("id").isNotNull() | (F.col("kind") == "revisit"))
    rows = records.join(repeats, same, "left").withColumn("kind", F.coalesce("_kind", F.when(F.col("id").isNull(), F.col("kind")), F.lit("response"))).withColumn("payload", F.coalesce("payload", F.lit("")))
    rows.select(record_text(captured).alias("value")).mapInArrow(_writer(path, captured), _WRITTEN).write.mode("append").json(f"{path}/_written")
    return headers


def _stream(file):
    """Records of one archive, read in one pass and bounded by their stated lengths."""
    while line := file.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("not at the start of a WARC record")
        fields = {}
        while (line := file.readline().rstrip(b"\r\n")):
            name, _, value = line.partition(b":")
            fields[name.lower().decode()] = value.strip().decode("utf-8", "replace")
        body = file.read(int(fields.get("content-length", 0)))
        yield fields, body.partition(_END.encode())[2]


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Records of all archives below ``path``, one task a file; a file is streamed, not loaded."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.gz").load(path).where("length > 0").select("path")
    files = files.repartition(max(1, min(files.count(), 10_000)))

    def run(batches):
        from pyarrow import fs

        for batch in batches:
            for name in batch.column(0).to_pylist():
                where, inner = fs.FileSystem.from_uri(name.replace("file:/", "file:///", 1) if name.startswith("file:/") and not name.startswith("file://") else name)
                with where.open_input_stream(inner, compression=None) as raw:
                    rows = []
                    for fields, payload in _stream(gzip.open(raw) if inner.endswith(".gz") else raw):
                        kind = fields.get("warc-type", "")
                        if kind == "warcinfo":
                            continue
                        rows.append((fields.get("warc-record-id"), kind, fields.get("warc-target-uri"), fields.get("warc-payload-digest", "").removeprefix("sha256:"), fields.get("warc-refers-to"), payload.decode("utf-8", "replace") if kind == "response" else None))
                        if len(rows) >= 200:
                            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], names=RECORD.names)
                            rows = []
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], names=RECORD.names)

    return files.mapInArrow(run, RECORD)


def deduplicated(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write the deduplicated archive of ``pages``; one row a record: page, kind, digest and the page it refers to."""
    path = path or f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    headers = write_archive(captures(pages), path)
    return headers.select(F.col("id").alias("page_id"), F.col("kind").alias("record_type"), "digest", "refers_to")


def oracle() -> str:
    """DuckDB SQL for the rows of :func:`deduplicated` over ``pages``."""
    return """
WITH r AS (SELECT page_id, sha256(coalesce(html, '')) AS digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY digest) AS first FROM r)
SELECT page_id, CASE WHEN page_id <> first THEN 'revisit' ELSE 'response' END AS record_type, digest,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM f"""
