"""WARC archives: write captures as transactions, read archives, assemble transactions.

A capture is three records: a request, a response (or a revisit, when a later page has the
same payload), and a metadata record; request and metadata name the capture's record in
WARC-Concurrent-To. Spark's text sink writes them (a record ends with two line breaks, so
that is the line separator), each file one gzip stream of bounded size. Reading walks every
file record by record by Content-Length, so payloads may hold anything; size and SHA-1 of a
payload are taken there, so that assembly, which joins the records of a transaction on the
identifiers they name, can do without the payloads.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import itertools
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, scratch_dir

CRLF = "\r\n"
#: Payloads below this many bytes are always stored in full.
MIN_REVISIT_BYTES = 1000
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORD = ("record_type string, record_id string, concurrent_to string, refers_to string, target_uri string, payload_digest string, http_header string, "
          "payload_bytes long, payload_sha1 string, payload binary")
#: Payloads of up to so many bytes go into files of so many captures: 256 MiB of payload a file
#: at most, or a single larger capture.
FILE_SIZES = ((1 << 16, 4096), (1 << 20, 256), (1 << 24, 16), (None, 1))
#: Digests of repeated payloads that are broadcast at most (some 100 bytes each); more are joined by shuffle.
BROADCAST_DIGESTS = 200_000
#: What a reader hands out at once, in bytes of payload.
BATCH_BYTES = 8 << 20


# --- writing ----------------------------------------------------------------------------

def _urn(*parts: Column) -> Column:
    """Record id as a function of its parts, in the shape of a UUID."""
    return F.regexp_replace(F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])),
                            "(.{8})(.{4})(.{4})(.{4})(.{12})", "<urn:uuid:$1-$2-$3-$4-$5>")


def _lines(*fields: tuple[str, Column]) -> Column:
    """Header lines; a null value leaves its line out."""
    return F.concat(*[F.when(v.isNull(), "").otherwise(F.concat(F.lit(f"{k}: "), v, F.lit(CRLF))) for k, v in fields])


def _record(kind: Column, rid: Column, content_type: str, block: Column, *fields: tuple[str, Column]) -> Column:
    return F.concat(F.lit(f"WARC/1.1{CRLF}"), _lines(
        ("WARC-Type", kind), ("WARC-Record-ID", rid), ("WARC-Date", F.lit(DATE)), *fields, ("Content-Type", F.lit(content_type)),
        ("Content-Length", F.octet_length(block).cast("string"))), F.lit(CRLF), block)


def mark_revisits(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """(page_id, url, html, digest, refers_to): refers_to is the largest page id among the
    pages of equal payload, null for that page itself and for payloads under ``min_bytes``.
    Null html: empty. Null ids never are the largest; pages of one payload that all lack
    an id are all stored in full, as are repeated rows of the largest id. Digests of repeated
    payloads are counted first; pages cross a shuffle only where they are too many to send."""
    p = pages.select(F.col(id_col).alias("page_id"), F.col("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    p = p.withColumn("digest", F.sha1(F.col("html").cast("binary")))
    same = materialize(p.where(F.octet_length("html") >= min_bytes).groupBy("digest").agg(
        F.max("page_id").alias("largest"), F.count("*").alias("n")).where("n > 1").select("digest", "largest"))
    same = F.broadcast(same) if same.count() <= BROADCAST_DIGESTS else same
    return p.join(same, "digest", "left").select(
        "page_id", "url", "html", "digest", F.when(~F.col("page_id").eqNullSafe(F.col("largest")), F.col("largest")).alias("refers_to"))


def write_warc(marked: DataFrame, path: str, file_sizes=FILE_SIZES) -> None:
    """Write the captures of ``mark_revisits`` as .gz archives below ``path``, one folder for
    each class of payload sizes, so that a file holds a bounded number of bytes."""
    n = F.octet_length("html")
    size_class = F.coalesce(*[F.when(n <= most, k) for k, (most, _) in enumerate(file_sizes) if most], F.lit(len(file_sizes) - 1))
    found = sorted(r[0] for r in marked.select(size_class.alias("k")).distinct().collect())
    for k in found or [0]:
        _write(marked.where(size_class == k), f"{path}/size-{k}", file_sizes[k][1])


def _write(marked: DataFrame, path: str, captures_per_file: int) -> None:
    pid, digest = F.col("page_id"), F.concat(F.lit("sha1:"), "digest")
    # Control characters and spaces cannot stand in a header line.
    uri = F.regexp_replace(F.col("url"), r"[\x00-\x20\x7F]", "%20")
    rid = _urn(F.lit("capture"), pid, F.col("digest"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "),
                    F.octet_length("html").cast("string"), F.lit(CRLF * 2))
    again = F.col("refers_to").isNotNull()
    common = (("WARC-Target-URI", uri), ("WARC-Payload-Digest", digest))
    capture = F.when(again, _record(
        F.lit("revisit"), rid, "application/http;msgtype=response", http, *common, ("WARC-Profile", F.lit(PROFILE)),
        ("WARC-Refers-To", _urn(F.lit("capture"), F.col("refers_to"), F.col("digest"))))).otherwise(
        _record(F.lit("response"), rid, "application/http;msgtype=response", F.concat(http, "html"), *common))
    ask = F.concat(F.lit("GET "), F.coalesce(uri, F.lit("/")), F.lit(f" HTTP/1.1{CRLF}{CRLF}"))
    request = _record(F.lit("request"), _urn(F.lit("request"), pid, F.col("digest")), "application/http;msgtype=request", ask,
                      ("WARC-Target-URI", uri), ("WARC-Concurrent-To", rid))
    metadata = _record(F.lit("metadata"), _urn(F.lit("metadata"), pid, F.col("digest")), "application/warc-fields",
                       _lines(("page-id", pid.cast("string"))), ("WARC-Target-URI", uri), ("WARC-Concurrent-To", rid))
    marked.select(F.explode(F.array(request, capture, metadata)).alias("value")).write.option("lineSep", CRLF * 2).option(
        "maxRecordsPerFile", 3 * captures_per_file).option("compression", "gzip").text(path)


# --- reading ----------------------------------------------------------------------------

def parse_warc(data: bytes):
    """(headers with lower-case names, block) of every record of an archive, plain or as
    gzip members. A record that is cut short is an error."""
    raw = io.BytesIO(data)
    f = io.BufferedReader(gzip.GzipFile(fileobj=raw)) if data[:2] == b"\x1f\x8b" else raw
    while True:
        line = f.readline()
        while line in (b"\r\n", b"\n"):
            line = f.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        headers: dict[str, str] = {}
        while (line := f.readline()) not in (b"\r\n", b"\n", b""):
            name, _, value = line.decode("utf-8", "replace").partition(":")
            headers[name.strip().lower()] = value.strip()
        size = int(headers.get("content-length", "0"))
        block = f.read(size)
        if len(block) < size:
            raise ValueError(f"record {headers.get('warc-record-id')} is cut short: {len(block)} of {size} bytes")
        yield headers, block


def _rows(data: bytes, kinds: frozenset, payload_of: frozenset):
    for h, block in parse_warc(data):
        kind = h.get("warc-type")
        if kind not in kinds:
            continue
        head, payload = "", block
        if h.get("content-type", "").startswith("application/http"):
            first, _, payload = block.partition(b"\r\n\r\n")
            head = first.decode("utf-8", "replace")
        there = kind != "revisit"
        yield (kind, h.get("warc-record-id"), h.get("warc-concurrent-to"), h.get("warc-refers-to"), h.get("warc-target-uri"),
               h.get("warc-payload-digest", "").rpartition(":")[2] or None, head, len(payload) if there else None,
               hashlib.sha1(payload).hexdigest() if there else None, payload if there and kind in payload_of else None)


def read_records(spark: SparkSession, path: str, kinds: tuple[str, ...], payload_of: tuple[str, ...] | None = None) -> DataFrame:
    """The records of the given types of all archives below ``path``, with size and SHA-1 of
    the payload and, for the types in ``payload_of`` (default: all), the payload itself; all
    three are null for revisits. A file is held as it is stored (compressed) by the task that
    walks it; its records go out in small batches."""
    wanted, names = frozenset(kinds), [c.split()[0] for c in RECORD.split(", ")]
    payload_of = wanted if payload_of is None else frozenset(payload_of)

    def walk(batches):
        schema = pa.schema([(n, {"payload": pa.binary(), "payload_bytes": pa.int64()}.get(n, pa.string())) for n in names])
        for batch in batches:
            for content in batch.column(0):
                rows, held = [], 0
                for row in itertools.chain(_rows(content.as_py(), wanted, payload_of), [None]):
                    if row is not None:
                        rows.append(row)
                        held += 200 + len(row[-1] or b"")
                    if rows and (row is None or held >= BATCH_BYTES):
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                        rows, held = [], 0

    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content").mapInArrow(walk, RECORD)


def assemble(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """One nested row per capture: (capture, request, metadata).

    capture: struct of the response or revisit record, with size and SHA-1 of its payload and,
    with ``payloads``, the payload (all three null for a revisit); without, pages cross no
    shuffle. request, metadata: structs of the records that name it in WARC-Concurrent-To, null
    if there is none (of several, the one with the smallest record id). Captures without an id
    are kept alone. A capture id that occurs twice gives two rows."""
    part = F.struct("record_id", "target_uri", "http_header", "payload")
    of = lambda kind: F.min(F.when(F.col("record_type") == kind, part))
    sides = read_records(spark, path, ("request", "metadata")).where("concurrent_to IS NOT NULL").groupBy(
        F.col("concurrent_to").alias("capture_id")).agg(of("request").alias("request"), of("metadata").alias("metadata"))
    main = read_records(spark, path, ("response", "revisit"), None if payloads else ()).select("record_id", F.struct(
        "record_type", "record_id", "refers_to", "target_uri", "payload_digest", "http_header", "payload_bytes", "payload_sha1", "payload").alias("capture"))
    return main.join(sides, F.col("record_id") == F.col("capture_id"), "left").select("capture", "request", "metadata")


def capture_digests(captures: DataFrame) -> DataFrame:
    """(record_id, page_id, record_type, refers_to, payload_bytes, payload_digest) per
    capture, size and digest of the payload as it was read (null for revisits)."""
    page = F.regexp_extract(F.col("metadata.payload").cast("string"), r"(?m)^page-id: (-?\d+)\r?$", 1)
    return captures.select("capture.record_id", F.when(page != "", page.cast("long")).alias("page_id"), "capture.record_type",
                           "capture.refers_to", "capture.payload_bytes", F.col("capture.payload_sha1").alias("payload_digest"))


def resolve_revisits(digests: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to page id): revisits
    take size, digest and page id of the response they name. Pass a written table. The
    responses are written before the join, so AQE can split the many revisits of one of them."""
    full = materialize(digests.where("record_type = 'response'").groupBy(F.col("record_id").alias("of")).agg(
        F.min(F.struct("page_id", "payload_bytes", "payload_digest")).alias("r")))
    joined = digests.join(full, F.col("refers_to") == F.col("of"), "left")
    return joined.select("page_id", F.coalesce("payload_bytes", "r.payload_bytes").alias("payload_bytes"),
                         F.coalesce("payload_digest", "r.payload_digest").alias("payload_digest"), "record_type",
                         F.when(F.col("record_type") == "revisit", F.col("r.page_id")).alias("refers_to"))


def archive_folder(spark: SparkSession) -> str:
    """A new folder for archives below the shared scratch folder."""
    return f"{scratch_dir(spark)}/warc-{uuid.uuid4().hex}"
