"""WARC archives of web captures: writing them, and assembling transactions.

Writing: each capture becomes a response or revisit, a request and a metadata
record, tied by WARC-Concurrent-To. Of equal payloads from ``MIN_REVISIT`` bytes
on, the one with the largest page id is the response; the others are revisits
that refer to it. Records are strings written with Spark's text writer, so that
files are committed like any table; a file is a stream of records.

Reading: archives are parsed record by record in bounded memory, blocks cut by
their stated length. Request, response or revisit, and metadata records are
joined through their concurrent-to identifiers, in either direction and also
through the request, into one nested row per capture.

Defined results: null html is an empty payload; ids are null where the page id
is; rows equal in page id, url and html are equal records: they come back as
often as they went in; an empty table gives no archive and an empty result;
a capture without request or metadata has null there; other columns are not
written.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobreview.llm.common import written
from jobreview.llm.warc_format import headers_of, hex_digest, inflated, records, split_http

MIN_REVISIT = 1000
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NL = "\r\n"
RECORD = T.StructType(
    [
        T.StructField("record_id", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("concurrent_to", T.ArrayType(T.StringType())),
        T.StructField("refers_to", T.StringType()),
        T.StructField("target_uri", T.StringType()),
        T.StructField("date", T.StringType()),
        T.StructField("payload_digest", T.StringType()),
        T.StructField("digest_holds", T.BooleanType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("fields", T.MapType(T.StringType(), T.StringType())),
        T.StructField("payload", T.BinaryType()),
    ]
)


def _lines(*lines: Column | str) -> Column:
    """Header lines with their line ends; null lines are left out."""
    ends = [F.concat(F.lit(x) if isinstance(x, str) else x, F.lit(NL)) for x in lines]
    return F.concat(*[F.coalesce(line, F.lit("")) for line in ends])


def _field(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value.cast("string"))


def _record(header: Column, block: Column) -> Column:
    """Without the end mark: the writer's line separator is the end mark."""
    length = F.octet_length(block).cast("string")
    return F.concat(F.lit("WARC/1.1" + NL), header, F.lit("Content-Length: "), length, F.lit(NL + NL), block)


def _urn(kind: str, *parts: Column) -> Column:
    digest = F.sha1(F.concat_ws("|", F.lit(kind), *[F.coalesce(p.cast("string"), F.lit("\x00")) for p in parts]))
    parts = [F.substring(digest, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def capture_records(pages: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """One column ``value``: the records of each page, in order. ``pages``:
    page_id, url, html."""
    body = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(
        F.col("page_id"),
        F.coalesce(F.regexp_replace(F.col("url").cast("string"), r"[\s]+", ""), F.lit("")).alias("url"),
        body.alias("html"),
        F.sha1(F.encode(body, "UTF-8")).alias("digest"),
        F.octet_length(body).cast("long").alias("bytes"),
    )
    heads = (
        rows.filter(F.col("bytes") >= min_revisit)
        .groupBy("digest", "bytes")
        .agg(F.max(F.struct("page_id", "url")).alias("head"), F.count("*").alias("n"))
        .filter("n > 1")
        .select(F.col("digest").alias("head_digest"), F.col("bytes").alias("head_bytes"), "head")
    )
    # The heads have one row a payload, so AQE may split a hot payload's pages.
    rows = rows.join(heads, (F.col("digest") == F.col("head_digest")) & (F.col("bytes") == F.col("head_bytes")), "left")
    revisit = F.col("head").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("head.page_id"))
    own = _urn("response", F.col("page_id"), F.col("url"), F.col("digest"))
    head = _urn("response", F.col("head.page_id"), F.col("head.url"), F.col("digest"))
    request, metadata = (_urn(kind, F.col("page_id"), F.col("url"), F.col("digest")) for kind in ("request", "metadata"))
    b32 = F.concat(F.lit("sha1:"), F.col("digest"))
    http = _lines("HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8", _field("Content-Length", F.col("bytes")), "")
    common = [_field("WARC-Target-URI", F.when(F.col("url") != "", F.col("url"))), f"WARC-Date: {DATE}"]
    as_response = _lines("WARC-Type: response", _field("WARC-Record-ID", own), *common, _field("WARC-Payload-Digest", b32), "Content-Type: application/http; msgtype=response")
    as_revisit = _lines(
        "WARC-Type: revisit", _field("WARC-Record-ID", own), *common, _field("WARC-Payload-Digest", b32),
        f"WARC-Profile: {PROFILE}", _field("WARC-Refers-To", head), "Content-Type: application/http; msgtype=response",
    )
    main = F.when(revisit, _record(as_revisit, http)).otherwise(_record(as_response, F.concat(http, F.col("html"))))
    path = F.coalesce(F.nullif(F.regexp_extract("url", r"^[a-z]+://[^/]*(/[^#]*)", 1), F.lit("")), F.lit("/"))
    asked = _lines(F.concat(F.lit("GET "), path, F.lit(" HTTP/1.1")), _field("Host", F.regexp_extract("url", r"^[a-z]+://([^/]*)", 1)), "")
    ask = _lines("WARC-Type: request", _field("WARC-Record-ID", request), *common, _field("WARC-Concurrent-To", own), "Content-Type: application/http; msgtype=request")
    about = _lines(_field("page-id", F.col("page_id")), _field("payload-bytes", F.col("bytes")))
    meta = _lines("WARC-Type: metadata", _field("WARC-Record-ID", metadata), *common, _field("WARC-Concurrent-To", own), "Content-Type: application/warc-fields")
    return rows.select(F.explode(F.array(main, _record(ask, asked), _record(meta, about))).alias("value"))


def write_archives(pages: DataFrame, path: str, min_revisit: int = MIN_REVISIT, max_records: int = 6_000) -> None:
    """Archives below ``path``. ``max_records`` bounds the records of a file."""
    records_ = capture_records(pages, min_revisit)
    records_.write.option("lineSep", NL + NL).option("compression", "gzip").option("maxRecordsPerFile", max_records).text(path)


def _parse(batches: Iterator[pa.RecordBatch], schema: pa.Schema, payloads: bool) -> Iterator[pa.RecordBatch]:
    rows: list[dict] = []
    size = 0
    for batch in batches:
        for content in batch.column(0):
            for fields, block in records(inflated(content.as_py())):
                named = dict(fields)
                kind = named.get("warc-type")
                payload, about, bytes_ = block, headers_of(block) if kind == "metadata" else [], len(block)
                if kind in ("response", "request", "revisit"):
                    about, payload = split_http(block)
                    bytes_ = len(payload)
                if kind == "revisit":  # what the HTTP fields say of the payload left out
                    stated = dict(about).get("content-length", "")
                    bytes_ = int(stated) if stated.isdigit() else None
                digest = hex_digest(named.get("warc-payload-digest"))
                holds = None
                if kind == "response":
                    made = hashlib.sha1(payload).hexdigest()
                    holds, digest = digest in (None, made), digest or made
                rows.append(
                    {
                        "record_id": named.get("warc-record-id"),
                        "type": kind,
                        "concurrent_to": [v for n, v in fields if n == "warc-concurrent-to"],
                        "refers_to": named.get("warc-refers-to"),
                        "target_uri": named.get("warc-target-uri"),
                        "date": named.get("warc-date"),
                        "payload_digest": digest,
                        "digest_holds": holds,
                        "payload_bytes": bytes_,
                        "fields": list(dict(about).items()),
                        "payload": payload if payloads and kind == "response" else None,
                    }
                )
                size += len(block) if payloads else 200
                if size > 8 << 20:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)
                    rows, size = [], 0
    if rows:
        yield pa.RecordBatch.from_pylist(rows, schema=schema)


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """One row per record; ``payloads=False`` leaves response bodies out (their
    length and digest are still taken from all bytes)."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(RECORD)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInArrow(lambda batches: _parse(batches, schema, payloads), RECORD)


def landed_records(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """``read_archives`` as a table in the shared folder: every archive is read
    once, one file at a time in a task."""
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "1")
    try:
        return written(read_archives(spark, path, payloads), "warc-records")
    finally:
        spark.conf.set(setting, before)


def assemble(records_: DataFrame) -> DataFrame:
    """One row per capture: ``response`` (a response or revisit), ``request``,
    ``metadata``, and ``copies``, how many equal captures there were.

    A record belongs to the capture that its concurrent-to names or that names
    it; metadata may name the request instead. A capture is found by a join on
    the named ids; minima of each kind combine before the shuffle.
    """
    is_main = F.col("type").isin("response", "revisit")
    mains = records_.filter(is_main)
    others = records_.filter(F.col("type").isin("request", "metadata"))
    # (record, capture): what each record says itself, and what captures say.
    up = others.select("record_id", F.explode("concurrent_to").alias("capture"))
    down = mains.select(F.explode("concurrent_to").alias("record_id"), F.col("record_id").alias("capture"))
    captures = mains.select(F.col("record_id").alias("main")).distinct()
    links = up.unionByName(down).distinct()
    direct = links.join(captures, F.col("capture") == F.col("main"), "left_semi")
    by_request = (
        links.select("record_id", F.col("capture").alias("via"))
        .join(direct.select(F.col("record_id").alias("via"), "capture"), "via")
        .select("record_id", "capture")
    )
    owner = direct.unionByName(by_request).groupBy("record_id").agg(F.min("capture").alias("capture"))
    parts = others.join(owner, "record_id").select("capture", "type", F.struct("record_id", "target_uri", "date", F.map_entries("fields").alias("fields")).alias("part"))
    parts = parts.groupBy("capture").agg(
        F.min(F.when(F.col("type") == "request", F.col("part"))).alias("request"),
        F.min(F.when(F.col("type") == "metadata", F.col("part"))).alias("metadata"),
    )
    response = F.struct(*[c for c in RECORD.names if c not in ("record_id", "concurrent_to", "fields")])
    rows = mains.groupBy("record_id").agg(F.first(response).alias("response"), F.count("*").alias("copies"))
    rows = rows.join(parts, rows["record_id"] == parts["capture"], "left")
    fields = {k: F.map_from_entries(F.col(f"{k}.fields")) for k in ("request", "metadata")}
    nested = [
        F.when(F.col(k).isNotNull(), F.struct(f"{k}.record_id", f"{k}.target_uri", f"{k}.date", fields[k].alias("fields"))).alias(k)
        for k in ("request", "metadata")
    ]
    return rows.select("record_id", "response", *nested, "copies")


def page_digests(captures: DataFrame) -> DataFrame:
    """Per page: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    page = F.col("metadata.fields")["page-id"].cast("long")
    rows = written(
        captures.select(
            "record_id",
            page.alias("page_id"),
            F.col("response.payload_bytes").alias("payload_bytes"),
            F.col("response.payload_digest").alias("payload_digest"),
            F.col("response.type").alias("record_type"),
            F.col("response.refers_to").alias("target"),
            "copies",
        ),
        "captures",
    )
    heads = rows.filter("record_type = 'response'").select(F.col("record_id").alias("target"), F.col("page_id").alias("refers_to"))
    found = rows.join(heads, "target", "left")
    found = found.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS b, sha1(coalesce(html, '')) AS d FROM pages
), h AS (SELECT d, max(page_id) AS head FROM p WHERE b >= 1000 GROUP BY d)
SELECT page_id, b AS payload_bytes, d AS payload_digest, CASE WHEN head <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN head <> page_id THEN head END AS refers_to
FROM p LEFT JOIN h USING (d)
"""
