"""Web archives: records written from pages, read back, and assembled into one nested row per capture.

Each page is a capture of three records: ``response`` (or ``revisit``), ``request`` and ``metadata``,
the latter two pointing at the first by ``WARC-Concurrent-To``. The archives are written by the text
sink, whose line separator is the blank line that ends a record, so any shared store and Spark's
commit protocol serve; they are read as whole files of bounded size and cut by ``Content-Length``.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.llm.common import staged

EOL = "\r\n"
END = "\r\n\r\n"
#: Smaller payloads are always written in full.
MIN_REVISIT = 1000
#: Records in a file, so that a file fits a task's memory.
FILE_RECORDS = 6000
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_FIELDS = ("record_id", "type", "concurrent_to", "refers_to", "uri", "date", "digest")
_HEADERS = ("warc-record-id", "warc-type", "warc-concurrent-to", "warc-refers-to", "warc-target-uri", "warc-date", "warc-payload-digest")
RECORD_DDL = ", ".join(f"{f} string" for f in _FIELDS) + ", block binary, head int"
_ARROW = pa.schema([*[(f, pa.string()) for f in _FIELDS], ("block", pa.binary()), ("head", pa.int32())])


def _line(value: Column) -> Column:
    """A value that fits one header line and can be read back."""
    return F.replace(F.replace(F.replace(value, F.lit("%"), F.lit("%25")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))


def _record(kind: str, ident: Column, headers: list[tuple[str, Column]], block: Column) -> Column:
    """One record; a header whose value is null is left out. The sink adds the closing blank line."""
    lines = [F.lit("WARC/1.1"), F.lit(f"WARC-Type: {kind}"), F.concat(F.lit("WARC-Record-ID: "), ident), F.lit(f"WARC-Date: {DATE}")]
    lines += [F.concat(F.lit(f"{name}: "), value) for name, value in headers]
    lines.append(F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")))
    return F.concat(F.concat_ws(EOL, *lines), F.lit(END), block)


def captures(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", least: int = MIN_REVISIT) -> DataFrame:
    """Each page with its record id and, for a payload that another page holds too, the response it revisits.

    Of equal payloads of at least ``least`` bytes the page with the largest id (a null id is the
    smallest; of one id the largest url) is the response. Null html is an empty payload. Only keys
    are grouped; a payload moves once, to meet its decision, and a hot payload's rows can be split.
    """
    source = pages.select(
        F.col(page_id).cast("bigint").alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html")
    ).withColumn("key", F.when(F.octet_length("html") >= least, F.sha2("html", 256)))
    owner = source.filter(F.col("key").isNotNull()).groupBy("key").agg(
        F.max(F.struct("page_id", "url")).alias("owner"), F.count(F.lit(1)).alias("n")
    ).filter("n > 1").drop("n")
    owners = staged(owner, "payload-owners")
    joined = source.join(owners, "key", "left")
    me = F.struct("page_id", "url")
    revisit = F.col("owner").isNotNull() & ~me.eqNullSafe(F.col("owner"))
    return joined.select(
        "page_id", "url", "html", _ident(F.col("page_id"), F.col("url"), F.sha2("html", 256)).alias("id"),
        F.when(revisit, _ident(F.col("owner.page_id"), F.col("owner.url"), F.col("key"))).alias("refers_to"),
    )


def _ident(page_id: Column, url: Column, digest: Column) -> Column:
    """A record id from what the capture is, so that a task run again writes the same one."""
    parts = [F.coalesce(page_id.cast("string"), F.lit("-")), F.coalesce(url, F.lit("-")), digest]
    h = F.sha2(F.concat_ws("\n", *parts), 256)
    cuts = [F.substring(h, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cuts), F.lit(">"))


def write_archives(pages: DataFrame, path: str, file_records: int = FILE_RECORDS, compression: str = "gzip", **options) -> None:
    """Write the three records of every page below ``path``."""
    found = captures(pages, **options)
    digest = F.concat(F.lit("sha1:"), F.sha1("html"))
    uri = _line(F.col("url"))
    answer = F.concat(F.lit(EOL.join(("HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8", "Content-Length: "))), F.octet_length("html").cast("string"), F.lit(END))
    http = ("Content-Type", F.lit("application/http;msgtype=response"))
    first = F.when(F.col("refers_to").isNull(), _record("response", F.col("id"), [
        ("WARC-Target-URI", uri), ("WARC-Payload-Digest", digest), http], F.concat(answer, F.col("html"))
    )).otherwise(_record("revisit", F.col("id"), [
        ("WARC-Target-URI", uri), ("WARC-Payload-Digest", digest), ("WARC-Refers-To", F.col("refers_to")),
        ("WARC-Profile", F.lit(PROFILE)), http], answer))
    part = lambda mark: F.concat(F.substring("id", 1, 42), F.lit(mark), F.lit(">"))  # noqa: E731  # the last digits name the part
    request = _record("request", part("req0"), [
        ("WARC-Target-URI", uri), ("WARC-Concurrent-To", F.col("id")), ("Content-Type", F.lit("application/http;msgtype=request"))],
        F.concat(F.lit("GET "), F.coalesce(uri, F.lit("/")), F.lit(f" HTTP/1.1{END}")))
    metadata = _record("metadata", part("meta"), [
        ("WARC-Target-URI", uri), ("WARC-Concurrent-To", F.col("id")), ("Content-Type", F.lit("application/warc-fields"))],
        F.concat(F.lit("page-id: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(EOL)))
    records = found.select(F.explode(F.array(request, first, metadata)).alias("value"))
    records.write.option("lineSep", END).option("compression", compression).option("maxRecordsPerFile", file_records).text(path)


def _inflated(content: bytes) -> bytes:
    """A plain archive, or all members of a gzip one."""
    if content[:2] != b"\x1f\x8b":
        return content
    parts = []
    while content:
        member = zlib.decompressobj(31)
        parts.append(member.decompress(content))
        content = member.unused_data
    return b"".join(parts)


def records_of(content: bytes) -> Iterator[dict]:
    """The records of one archive, in order, cut by their ``Content-Length``."""
    data, at = _inflated(content), 0
    while (at := data.find(b"WARC/", at)) >= 0:
        stop = data.index(b"\r\n\r\n", at)
        headers = {}
        for line in data[at:stop].decode("utf-8", "replace").split(EOL)[1:]:
            name, _, value = line.partition(":")
            headers[name.strip().lower()] = value.strip()
        size = int(headers["content-length"])
        block = data[stop + 4 : stop + 4 + size]
        http = headers.get("content-type", "").startswith("application/http")
        yield {**{f: headers.get(h) for f, h in zip(_FIELDS, _HEADERS, strict=True)}, "block": block, "head": block.index(b"\r\n\r\n") + 4 if http else 0}
        at = stop + 4 + size


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the archives below ``path``: ids, type, uri, date, digest, block, bytes of its HTTP head."""

    def parse(batches):
        for batch in batches:
            for content in batch.column(0):
                rows, held = [], 0
                for record in records_of(content.as_py()):
                    rows.append(record)
                    held += len(record["block"])
                    if held > 4 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(parse, RECORD_DDL)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: ``capture_id, copies, uri, capture, request, metadata``.

    A request or metadata record belongs to the record its concurrent-to names; a capture without
    either has a null there, and one whose first record is missing has a null ``capture``. Records
    repeated in full (rows given twice to the writer) are one capture with ``copies`` over 1. The
    payload is the block after the HTTP head. Blocks of any size pass through; a capture is a
    bounded group, as its records are.
    """
    payload = F.when(F.col("type") == "response", F.substring("block", F.col("head") + 1, F.octet_length("block")))
    lone = records.select(
        F.coalesce("concurrent_to", "record_id").alias("capture_id"), "uri", "type",
        F.struct("record_id", "type", "uri", "date", "digest", "refers_to", payload.alias("payload")).alias("record"),
        F.when(F.col("type").isin("request", "metadata"), F.struct("record_id", F.decode("block", "utf-8").alias("block"))).alias("side"),
    )
    main = F.col("type").isin("response", "revisit")
    return lone.groupBy("capture_id").agg(
        F.count(F.when(main, 1)).alias("copies"), F.max("uri").alias("uri"),
        F.first(F.when(main, F.col("record")), ignorenulls=True).alias("capture"),
        F.max(F.when(F.col("type") == "request", F.col("side"))).alias("request"),
        F.max(F.when(F.col("type") == "metadata", F.col("side"))).alias("metadata"),
    )


def capture_digests(nested: DataFrame) -> DataFrame:
    """One row per capture written: ``page_id, payload_bytes, payload_digest, record_type, refers_to``.

    A revisit's payload is that of the response it refers to, found by record id; the two digests
    are compared and a revisit whose response is missing keeps its own digest and a null size.
    """
    own = nested.filter(F.col("capture").isNotNull()).select(
        "capture_id", "copies", F.col("capture.type").alias("record_type"), F.col("capture.refers_to").alias("target"),
        F.regexp_extract("metadata.block", r"page-id: (-?\d+)", 1).try_cast("bigint").alias("page_id"),
        F.octet_length("capture.payload").cast("bigint").alias("own_bytes"),
        F.coalesce(F.sha1("capture.payload"), F.replace("capture.digest", F.lit("sha1:"), F.lit(""))).alias("payload_digest"),
    )
    own = staged(own, "captures")
    there = own.filter("record_type = 'response'").select(
        F.col("capture_id").alias("target"), F.col("page_id").alias("refers_to"), F.col("own_bytes").alias("their_bytes"),
        F.col("payload_digest").alias("their_digest"))
    out = own.join(there, "target", "left").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))))
    return out.select(
        "page_id", F.coalesce("own_bytes", F.when(F.col("payload_digest") == F.col("their_digest"), F.col("their_bytes"))).alias("payload_bytes"),
        "payload_digest", "record_type", "refers_to",
    )
