"""WARC archives: writing page captures, reading records back, and assembling transactions.

A capture is three records: the response (or a revisit of an identical payload), the request that fetched
it and a metadata record; the last two name the first through WARC-Concurrent-To. Records are written by
Spark's text sink with the record terminator as line separator (gzip per file), so any file system that
Spark writes to will do, and read by its binary source.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lintlake.plans.lineage import remove, scratch_path, written

RECORD_END = "\r\n\r\n"
#: Captures in a file at most, bytes of the pages that a file is meant to hold, bytes of an archive unpacked at a time.
FILE_CAPTURES = 20_000
FILE_BYTES = 64 << 20
CHUNK = 1 << 20
#: Parts into which the revisits of one response are dealt.
SALTS = 32
#: WARC and HTTP fixed values.
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV"

RECORD_SCHEMA = T.StructType(
    [
        T.StructField("record_id", T.StringType()),
        T.StructField("record_type", T.StringType()),
        T.StructField("target_uri", T.StringType()),
        T.StructField("concurrent_to", T.ArrayType(T.StringType())),
        T.StructField("refers_to", T.StringType()),
        T.StructField("payload_digest", T.StringType()),
        T.StructField("headers", T.MapType(T.StringType(), T.StringType())),
        T.StructField("payload", T.BinaryType()),
    ]
)


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 SHA-1, from five hex digits to four base32 digits at a time."""
    digest = F.sha1(payload)
    parts = [
        F.translate(F.lpad(F.conv(F.substring(digest, 5 * k + 1, 5), 16, 32), 4, "0"), _DIGITS, _BASE32)
        for k in range(8)
    ]
    return F.concat(*parts)


def plan_captures(pages: DataFrame, min_payload_bytes: int = 0) -> DataFrame:
    """Add ``payload, payload_digest, record_type, refers_to_id`` to ``(page_id, url, html)``.

    Of captures with equal payloads of at least ``min_payload_bytes`` bytes the one with the largest page_id
    is the response, the others revisit it; smaller payloads are all responses. A null html is an empty
    payload. Rows that repeat a page_id, or have none, are captures of their own (``occurrence`` tells equal ones
    apart); those with one id and payload share that id's fate, and a null id is never the largest. An empty table
    gives none; other columns are left out. The digests travel without payloads.
    """
    base = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.coalesce("url", F.lit("")).alias("url"),
        F.coalesce("html", F.lit("")).alias("html"),
    ).withColumn("payload_digest", base32_sha1(F.encode("html", "utf-8")))
    keys = ["page_id", "payload_digest"]
    # only digests meet by digest, each once an id and payload; the pages come by id and payload, which no hot payload skews
    digests = written(base.select(*keys, (F.octet_length("html") >= min_payload_bytes).alias("large")), "page-digests")
    times = digests.groupBy(*keys, "large").agg(F.count("*").alias("times"))
    holder = (
        digests.where("large").groupBy(F.col("payload_digest").alias("holder_digest"))
        .agg(F.max("page_id").alias("holder"), F.count("*").alias("copies"))
        .where("copies > 1 and holder is not null")
    )
    holder = holder.withColumn("holder_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salt = F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int")
    met = times.withColumn("salt", salt).join(
        holder,
        (F.col("payload_digest") == F.col("holder_digest")) & (F.col("salt") == F.col("holder_salt"))
        & F.col("large") & ~F.col("page_id").eqNullSafe(F.col("holder")),
        "left",
    )
    fate = met.where("holder is not null or times > 1").select(
        F.col("page_id").alias("__page_id"), F.col("payload_digest").alias("__payload_digest"), "times", "holder"
    )
    same = F.col("page_id").eqNullSafe(F.col("__page_id")) & (F.col("payload_digest") == F.col("__payload_digest"))
    # by merging at every size: the pages are shuffled once, and dealt evenly to the files
    joined = base.join(fate.hint("merge"), same, "left")
    if not times.where("times > 1").isEmpty():
        # of rows that repeat an id and payload, and of these only, the order is found
        number = F.row_number().over(Window.partitionBy(*keys).orderBy("url")).cast("long")
        once = F.coalesce("times", F.lit(1)) == 1
        joined = joined.where(once).withColumn("occurrence", F.lit(1).cast("long")).unionByName(
            joined.where(~once).withColumn("occurrence", number)
        )
    else:
        joined = joined.withColumn("occurrence", F.lit(1).cast("long"))
    return joined.select(
        "page_id", "url", "html", "payload_digest", "occurrence",
        F.when(F.col("holder").isNotNull(), "revisit").otherwise("response").alias("record_type"),
        F.col("holder").alias("refers_to_id"),
    )


def _urn(kind: str, page_id: Column, digest: Column, occurrence: Column) -> Column:
    """A record id that depends on kind and capture only, so that a retried task writes the same ids."""
    which = [F.coalesce(page_id.cast("string"), F.lit("null")), digest, occurrence.cast("string")]
    h = F.md5(F.concat_ws(":", F.lit(kind), *which))
    dash = F.lit("-")
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), cut[0], dash, cut[1], dash, cut[2], dash, cut[3], dash, cut[4], F.lit(">"))


def _record(kind: Column | str, headers: list[tuple[str, Column]], body: Column) -> Column:
    lines = [F.lit(f"{VERSION}\r\nWARC-Type: "), kind if isinstance(kind, Column) else F.lit(kind)]
    for name, value in headers:
        lines += [F.when(value.isNotNull(), F.concat(F.lit(f"\r\n{name}: "), value)).otherwise("")]
    lines += [F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit(RECORD_END), body]
    return F.concat(*lines)


def captures_a_file(pages: DataFrame) -> int:
    """How many captures of pages of this mean size make FILE_BYTES, within 1 and FILE_CAPTURES; one number is collected."""
    mean = pages.agg(F.avg(F.coalesce(F.octet_length("html"), F.lit(0)))).first()[0]
    return max(1, min(FILE_CAPTURES, int(FILE_BYTES / max(mean or 0, 1))))


def write_warc(captures: DataFrame, path: str, date: str = "2020-01-01T00:00:00Z", file_captures: int = FILE_CAPTURES) -> None:
    """Write the planned captures as gzipped WARC files under ``path``, three records a capture.

    A file holds at most ``file_captures``, whatever their size: ``captures_a_file`` fits that to the pages' mean. Every
    capture carries its whole payload, a revisit too, so any record can be digested on its
    own. Control characters in a url are percent-encoded, since a header is one line.
    """
    pid = F.col("page_id")
    url = F.regexp_replace("url", r"[\x00-\x20\x7f]", "%20")
    when = F.lit(date)
    digest, occurrence = F.col("payload_digest"), F.col("occurrence")
    main_id, request_id = (_urn(kind, pid, digest, occurrence) for kind in ("capture", "request"))
    http_ok = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.octet_length("html").cast("string"), F.lit(RECORD_END), F.col("html"),
    )
    http_get = F.concat(F.lit("GET "), url, F.lit(" HTTP/1.1\r\n"), F.lit("\r\n"))
    note = F.concat(F.lit("page-id: "), F.coalesce(pid.cast("string"), F.lit("null")), F.lit("\r\n"))
    common = [("WARC-Date", when), ("WARC-Target-URI", url)]
    revisit = F.col("record_type") == "revisit"
    main = _record(
        F.col("record_type"),
        [("WARC-Record-ID", main_id), *common, ("Content-Type", F.lit("application/http;msgtype=response")),
         ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
         ("WARC-Profile", F.when(revisit, F.lit(REVISIT_PROFILE))),
         ("WARC-Refers-To", F.when(revisit, _urn("capture", F.col("refers_to_id"), digest, F.lit(1))))],
        http_ok,
    )
    request = _record(
        "request",
        [("WARC-Record-ID", request_id), *common, ("WARC-Concurrent-To", main_id),
         ("Content-Type", F.lit("application/http;msgtype=request"))],
        http_get,
    )
    metadata = _record(
        "metadata",
        [("WARC-Record-ID", _urn("metadata", pid, digest, occurrence)), *common, ("WARC-Concurrent-To", request_id),
         ("Content-Type", F.lit("application/warc-fields"))],
        note,
    )
    records = captures.select(F.concat_ws(RECORD_END, main, request, metadata).alias("value"))
    (records.write.option("lineSep", RECORD_END).option("compression", "gzip").option("maxRecordsPerFile", file_captures)
     .option("zlib.compress.level", "BEST_SPEED").text(path))


def _chunks(data: bytes) -> Iterator[bytes]:
    """The content of a plain file or of all members of a gzip file, piece by piece. A torn member ends it."""
    if data[:2] != b"\x1f\x8b":
        yield from (data[i : i + CHUNK] for i in range(0, len(data), CHUNK))
        return
    at, member = 0, zlib.decompressobj(31)
    while at < len(data) or member.unconsumed_tail:
        taken = member.unconsumed_tail or data[at : at + CHUNK]
        at += 0 if member.unconsumed_tail else len(taken)
        piece = member.decompress(taken, CHUNK)
        if piece:
            yield piece
        if member.eof:
            at -= len(member.unused_data)
            if data[at : at + 2] != b"\x1f\x8b":
                return
            member = zlib.decompressobj(31)


def _members(data: bytes) -> bytes:
    return b"".join(_chunks(data))


class _Window:
    """The part of an archive's content from the record that is being read on."""

    def __init__(self, data: bytes):
        self.pieces, self.held, self.at = _chunks(data), bytearray(), 0

    def more(self) -> bool:
        if self.at > CHUNK:
            del self.held[: self.at]
            self.at = 0
        piece = next(self.pieces, None)
        self.held += piece or b""
        return piece is not None

    def find(self, mark: bytes) -> int:
        """Place of the next ``mark`` from here on, -1 if there is none; reads on as needed."""
        seen = 0
        while True:
            k = self.held.find(mark, self.at + seen)
            if k >= 0:
                return k - self.at
            seen = max(0, len(self.held) - self.at - len(mark) + 1)
            if not self.more():
                return -1

    def take(self, n: int) -> bytes | None:
        while len(self.held) - self.at < n:
            if not self.more():
                return None
        out = bytes(self.held[self.at : self.at + n])
        self.at += n
        return out


def parse_records(data: bytes) -> Iterator[dict]:
    """Records of one archive, by Content-Length, so a payload may hold anything. A torn last record ends it.

    Only the record at hand is unpacked, not the archive.
    """
    window = _Window(data)
    while True:
        begin = window.find(b"WARC/")
        if begin < 0:
            return
        window.take(begin)
        stop = window.find(b"\r\n\r\n")
        if stop < 0:
            return
        named: dict[str, list[str]] = {}
        for line in re.split(rb"\r\n(?![ \t])", window.take(stop + 4)[:-4])[1:]:
            name, _, value = line.partition(b":")
            named.setdefault(name.decode("latin-1").strip().lower(), []).append(value.decode("utf-8", "replace").strip())
        length = named.get("content-length", ["0"])[0]
        body = window.take(int(length) if length.isdigit() else 0)
        if body is None:
            return
        payload = body
        if "application/http" in named.get("content-type", [""])[0]:
            head = body.find(b"\r\n\r\n")
            payload = body[head + 4 :] if head >= 0 else b""
        yield {
            "record_id": named.get("warc-record-id", [None])[0],
            "record_type": named.get("warc-type", [None])[0],
            "target_uri": named.get("warc-target-uri", [None])[0],
            "concurrent_to": named.get("warc-concurrent-to", []),
            "refers_to": named.get("warc-refers-to", [None])[0],
            "payload_digest": named.get("warc-payload-digest", [None])[0],
            "headers": [(k, ", ".join(v)) for k, v in named.items()],
            "payload": payload,
        }


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """One row per WARC record below ``path`` (see RECORD_SCHEMA), plain or gzipped; one file is read at a time."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("content")

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(
            [(f, pa.string()) for f in ("record_id", "record_type", "target_uri")]
            + [("concurrent_to", pa.list_(pa.string())), ("refers_to", pa.string()), ("payload_digest", pa.string()),
               ("headers", pa.map_(pa.string(), pa.string())), ("payload", pa.binary())]
        )
        for batch in batches:
            for content in batch.column(0):
                rows, size = [], 0
                for record in parse_records(content.as_py() or b""):
                    rows.append(record)
                    size += len(record["payload"]) + 500
                    if size > 8 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return files.mapInArrow(parse, RECORD_SCHEMA)


def assemble(records: DataFrame, anchors: tuple[str, ...] = ("response", "revisit", "resource")) -> DataFrame:
    """One nested row per capture: ``capture_id, capture, requests, metadata``.

    A request or metadata record belongs to the capture that its WARC-Concurrent-To names, directly or
    through a request. Records that name nothing known are left out; a capture without companions has empty
    lists; records repeated under one id count once. A capture's companions make one row, as the format asks.
    """
    fields = [c for c in records.columns if c not in ("payload", "headers")]
    body = F.struct(*[F.col(c) for c in fields], F.col("payload_bytes"), F.col("payload_sha1"), F.col("page_ref"))
    slim = records.select(
        *fields,
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        base32_sha1(F.col("payload")).alias("payload_sha1"),
        F.when(F.col("record_type") == "metadata", F.regexp_extract(F.col("payload").cast("string"), r"page-id: (-?\d+)", 1))
        .alias("page_ref"),
    ).where("record_id is not null").dropDuplicates(["record_id"])
    slim = written(slim, "warc-records")  # read three times; archives are parsed once
    is_anchor = F.col("record_type").isin(*anchors)
    main = slim.where(is_anchor).select(F.col("record_id").alias("capture_id"), body.alias("capture"))
    near = slim.where(~is_anchor).select(
        "record_id", F.col("record_type").alias("kind"), F.explode("concurrent_to").alias("to"), body.alias("body")
    )
    requests = near.where("kind = 'request'").select(F.col("record_id").alias("via"), F.col("to").alias("via_to"))
    # a companion of a request goes where the request goes
    routed = near.join(requests, F.col("to") == F.col("via"), "left").select(
        "record_id", "kind", F.coalesce("via_to", "to").alias("capture_id"), "body"
    ).dropDuplicates(["record_id", "capture_id"])
    sides = routed.groupBy("capture_id").agg(
        F.collect_list(F.when(F.col("kind") == "request", F.col("body"))).alias("requests"),
        F.collect_list(F.when(F.col("kind") != "request", F.col("body"))).alias("metadata"),
    )
    none = F.array().cast(sides.schema["requests"].dataType)
    return main.join(sides, "capture_id", "left").select(
        "capture_id",
        "capture",
        F.coalesce("requests", none).alias("requests"),
        F.coalesce("metadata", none).alias("metadata"),
    )


def op1_warc_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write every page as a WARC transaction, read the archives back and give one row per capture.

    One row a page: null and repeated ids, null and empty html, and equal rows stay rows of their own.
    """
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    path = scratch_path(spark, f"warc-{uuid.uuid4().hex[:8]}")
    write_warc(plan_captures(pages), path, file_captures=captures_a_file(pages))
    whole = assemble(read_warc(spark, path))
    page = F.nullif(F.col("metadata")[0]["page_ref"], F.lit("")).cast("long")
    named = whole.select(
        page.alias("page_id"),
        F.col("capture.payload_bytes").alias("payload_bytes"),
        F.col("capture.payload_sha1").alias("payload_digest"),
        F.col("capture.record_type").alias("record_type"),
        F.col("capture_id").alias("capture_id"),
        F.col("capture.refers_to").alias("refers_id"),
        F.size("requests").alias("n_requests"),
        F.size("metadata").alias("n_metadata"),
    )
    named = written(named, "captures")
    remove(spark, path)
    # a revisit names its response by record id; the response's own metadata says which page that is. A response that
    # very many revisit is dealt out by salts
    again = named.where("refers_id is not null").withColumn("salt", F.pmod(F.xxhash64("capture_id"), F.lit(SALTS)).cast("int"))
    asked = again.select(F.col("refers_id").alias("held_id")).distinct()
    held = named.where("record_type = 'response'").select(F.col("capture_id").alias("held_id"), F.col("page_id").alias("refers_to"))
    held = held.join(asked, "held_id").withColumn("held_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    joined = again.join(held, (F.col("refers_id") == F.col("held_id")) & (F.col("salt") == F.col("held_salt")), "left")
    alone = named.where("refers_id is null").withColumn("refers_to", F.lit(None).cast("long"))
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "n_requests", "n_metadata"]
    return joined.select(*columns).unionByName(alone.select(*columns))


ORACLE_OP1 = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload, upper(sha1(encode(coalesce(html, '')))) AS h,
         max(page_id) OVER (PARTITION BY sha1(encode(coalesce(html, '')))) AS holder
  FROM pages)
SELECT page_id, CAST(octet_length(payload) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         CAST((CAST(('0x' || substr(h, CAST((i // 4) * 5 + 1 AS BIGINT), 5)) AS INTEGER) >> CAST((3 - i % 4) * 5 AS INTEGER)) & 31 AS BIGINT) + 1, 1)), '') AS payload_digest,
       CASE WHEN page_id = holder THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = holder THEN NULL ELSE holder END AS refers_to,
       CAST(1 AS INTEGER) AS n_requests, CAST(1 AS INTEGER) AS n_metadata
FROM p
"""
