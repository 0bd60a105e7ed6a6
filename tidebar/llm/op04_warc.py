"""WARC archives: writing captures, and assembling transactions from their records.

A capture is written as three records, request, response (or revisit) and metadata; the others name the response in
WARC-Concurrent-To. Equal payloads from a least size are stored once, by the capture with the smallest id; the rest are
revisits that refer to it. Reading finds records by their Content-Length. Records are then joined to captures through
concurrent-to identifiers, directly or over another record of the capture, into one nested row.

Archives are text files of Spark with the record end as line end, so they lie in any store that Spark reaches and follow its
commit protocol. A task holds one archive while it reads; archives hold about ARCHIVE_BYTES at most, or a single larger capture.
Identifiers are joined without blocks, which reading again costs less than storing a second copy of all records.

Defined results: a null html has an empty payload; payloads under the least size are all responses; where the smallest page_id
repeats, each of its rows is a response; a null page_id comes after all others; urls keep their text, with control characters,
spaces and percent signs escaped in headers; payloads are stored whole; other columns are ignored, whatever their names; an empty
table gives an empty result.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebar.llm.common import new_path, small, written

LEAST_REVISIT = 100
ARCHIVE_RECORDS, ARCHIVE_BYTES = 3000, 256 << 20
END = "\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"


def classified(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """(row, page_id, url, payload, digest, refers_to): refers_to is null for responses.

    Payloads are summed by digest first, so a hot one is a single row. Digests that several pages share are stored and counted:
    few are broadcast; for many the join moves each payload once and Spark's skew join splits a hot digest.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"bytes": F.octet_length("payload").cast("long"), "digest": F.sha2(F.col("payload").cast("binary"), 256)})
    shared = (rows.filter(F.col("bytes") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
              .filter(F.col("n") > 1).select("digest", "first"))
    shared = small(written(shared, "warc-shared"))
    other = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return (rows.join(shared, "digest", "left")
            .withColumn("refers_to", F.when((F.col("bytes") >= least) & other, F.col("first"))).drop("first"))


def _header(value: Column) -> Column:
    """Percent-encodes what would break a header line."""
    out = F.regexp_replace(value, "%", "%25")
    for c in [" ", "\t", "\r", "\n", "\x0b", "\x0c", "\x00"]:
        out = F.regexp_replace(out, c, f"%{ord(c):02X}")
    return out


def _unheader(value: str | None) -> str | None:
    return None if value is None else re.sub("%(25|20|09|0D|0A|0B|0C|00)", lambda m: chr(int(m[1], 16)), value)


def _record(kind: str, ident: Column, url: Column, extra: Column, media: str, block: Column) -> Column:
    target = F.coalesce(F.concat(F.lit("WARC-Target-URI: "), _header(url), F.lit("\r\n")), F.lit(""))
    return F.concat(F.lit(f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <"), ident, F.lit(f">\r\nWARC-Date: {DATE}\r\n"), target, extra,
                    F.lit(f"Content-Type: {media}\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit(END), block)


def write(pages: DataFrame, folder: str, least: int = LEAST_REVISIT, records: int = ARCHIVE_RECORDS, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write archives; a capture's records follow each other.

    Payloads that would let `records` records pass `archive_bytes` go to archives of their own with fewer records.
    """
    run = uuid.uuid4().hex  # identifiers are unique among all archives
    page, url = F.coalesce(F.col("page_id").cast("string"), F.lit("null")), F.col("url")
    serial = F.col("serial").cast("string")

    def line(name: str, value: Column) -> Column:
        return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))

    def capture(part: str) -> Column:
        def ident(kind: str) -> Column:
            return F.concat(F.lit(f"urn:capture:{run}:{part}"), serial, F.lit(f":{kind}"))

        joint = line("WARC-Concurrent-To", F.concat(F.lit("<"), ident("response"), F.lit(">")))
        digest = line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest")))
        http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit(END))
        request = _record("request", ident("request"), url, joint, "application/http; msgtype=request",
                          F.concat(F.lit("GET "), F.coalesce(_header(url), F.lit("/")), F.lit(" HTTP/1.1" + END)))
        response = _record("response", ident("response"), url, digest, "application/http; msgtype=response", F.concat(http, F.col("payload")))
        refers = line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("refers_to").cast("string"), F.lit(">")))
        revisit = _record("revisit", ident("response"), url, F.concat(
            digest, refers, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n")),
            "application/http; msgtype=response", http)
        metadata = _record("metadata", ident("metadata"), url, joint, "application/warc-fields",
                           F.concat(line("page-id", page), line("payload-bytes", F.col("bytes").cast("string"))))
        main = F.when(F.col("refers_to").isNull(), response).otherwise(revisit)
        return F.concat_ws(END, request, main, metadata)

    rows = classified(pages, least)
    captures = max(records // 3, 1)
    limit = archive_bytes // captures
    largest = pages.agg(F.max(F.octet_length(F.col("html").cast("string")))).first()[0] or 0
    parts = [("a", F.col("bytes") <= limit, captures)]
    if largest > limit:
        parts.append(("b", F.col("bytes") > limit, max(archive_bytes // largest, 1)))
    for part, fits, most in parts:
        (rows.filter(fits).withColumn("serial", F.monotonically_increasing_id()).select(capture(part).alias("value"))
         .write.mode("append").option("lineSep", END).option("maxRecordsPerFile", most).option("compression", "gzip").text(folder))


RECORD = ("record_id string, type string, target_uri string, concurrent_to string, refers_to string, digest string, headers map<string,string>, "
          "block binary")


def _parse(raw: bytes) -> Iterator[tuple]:
    at = 0
    while at < len(raw):
        end = raw.index(b"\r\n\r\n", at)
        lines = raw[at:end].decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        fields = [tuple(x.split(": ", 1)) for x in lines[1:]]
        named = {k.lower(): v for k, v in fields}
        size = int(named["content-length"])
        block = raw[end + 4:end + 4 + size]
        if len(block) < size:
            raise ValueError("a record is cut short")
        yield (named.get("warc-record-id", "").strip("<>"), named.get("warc-type"), _unheader(named.get("warc-target-uri")),
               (named.get("warc-concurrent-to") or "").strip("<>") or None, (named.get("warc-refers-to") or "").strip("<>") or None,
               named.get("warc-payload-digest"), fields, block)
        at = end + 4 + size + 4


def read(spark: SparkSession, folder: str, blocks: bool = True) -> DataFrame:
    """One row per record; without `blocks` these are null."""
    import gzip

    names = [x.split(" ")[0] for x in RECORD.split(", ")]
    types = [pa.string()] * 6 + [pa.map_(pa.string(), pa.string()), pa.binary()]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch["content"]:
                raw = content.as_buffer().to_pybytes()
                raw = gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw
                held, size = [], 0
                for record in _parse(raw):
                    held.append(record if blocks else (*record[:-2], [], None))
                    size += len(record[-1]) if blocks else 1 << 10
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names)

    return spark.read.format("binaryFile").load(folder).select("content").mapInArrow(task, RECORD)


def assemble(records: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """(capture_id, request, response, metadata, n_records): one nested row per capture.

    The response names the capture. Another record belongs to it if either points at the other in concurrent-to, or if it
    points at a record that does. Identifiers are joined first, without the blocks; `links` may give the records without them. Of several records of a type the one with
    the least identifier is shown; records that reach no response form captures of their own.
    """
    main = F.col("type").isin("response", "revisit")
    links = (records if links is None else links).select("record_id", "type", "concurrent_to")
    responses = links.filter(main)
    known = responses.select(F.col("record_id").alias("at"), F.col("record_id").alias("capture")).union(
        responses.filter(F.col("concurrent_to").isNotNull()).select("concurrent_to", "record_id")).groupBy("at").agg(F.min("capture").alias("capture"))
    side = links.filter(~main).select("record_id", "concurrent_to").distinct()
    direct = (side.join(known.select(F.col("at").alias("concurrent_to"), F.col("capture").alias("by_target")), "concurrent_to", "left")
              .join(known.select(F.col("at").alias("record_id"), F.col("capture").alias("by_own")), "record_id", "left")
              .select("record_id", "concurrent_to", F.coalesce("by_target", "by_own").alias("direct")))
    over = direct.filter(F.col("direct").isNotNull()).groupBy(F.col("record_id").alias("concurrent_to")).agg(F.min("direct").alias("over"))
    resolved = (direct.join(over, "concurrent_to", "left").groupBy("record_id")
                .agg(F.min(F.coalesce("direct", "over", "concurrent_to", "record_id")).alias("capture_id")))
    rows = records.filter(main).withColumn("capture_id", F.col("record_id")).unionByName(records.filter(~main).join(resolved, "record_id"))
    body = F.struct("record_id", "type", "target_uri", "refers_to", "digest", "headers", "block")

    def only(kind: Column) -> Column:
        return F.min_by(F.when(kind, body), F.when(kind, F.col("record_id")))

    return rows.groupBy("capture_id").agg(only(F.col("type") == "request").alias("request"), only(main).alias("response"),
                                          only(F.col("type") == "metadata").alias("metadata"), F.count(F.lit(1)).alias("n_records"))


def payload_of(block: Column) -> Column:
    """The body of an HTTP message: what follows the first empty line."""
    at = F.position(F.lit(b"\r\n\r\n"), block)
    return F.when(at > 0, F.substring(block, at + 4, F.octet_length(block))).otherwise(F.lit(b"").cast("binary"))


def page_captures(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """Write new archives in the shared folder, read them back: (page_id, payload_bytes, payload_digest, record_type, refers_to,
    target_uri)."""
    folder = new_path(pages.sparkSession, "warc")
    write(pages, folder, least)
    links = read(pages.sparkSession, folder, blocks=False).select("record_id", "type", "concurrent_to")
    captures = assemble(read(pages.sparkSession, folder), written(links, "warc-links"))
    fields = F.col("metadata.block").cast("string")
    response = F.col("response.type") == "response"
    payload = payload_of(F.col("response.block"))
    page = F.regexp_extract(fields, "page-id: (-?[0-9]+|null)\r\n", 1)
    return captures.select(
        F.when(page != "null", page).cast("long").alias("page_id"),
        F.when(response, F.octet_length(payload).cast("long"))
        .otherwise(F.regexp_extract(fields, "payload-bytes: ([0-9]+)", 1).cast("long")).alias("payload_bytes"),
        F.when(response, F.sha2(payload, 256)).otherwise(F.substring_index("response.digest", ":", -1)).alias("payload_digest"),
        F.col("response.type").alias("record_type"),
        F.regexp_extract("response.refers_to", "urn:page:(-?[0-9]+)", 1).cast("long").alias("refers_to"),
        F.col("response.target_uri").alias("target_uri"))


ORACLE_SQL = f"""
WITH p AS (SELECT page_id, url, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, url, octet_length(encode(h)) AS n, sha256(h) AS g FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY g) AS first FROM d)
SELECT page_id, n AS payload_bytes, g AS payload_digest, CASE WHEN n >= {LEAST_REVISIT} AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= {LEAST_REVISIT} AND page_id <> first THEN first END AS refers_to, url AS target_uri FROM f
"""
