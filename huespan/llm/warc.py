"""4. WARC: archives written and read by Spark, and transactions assembled from their records.

Writing: each capture becomes a request, a response (or a revisit of an earlier equal payload) and a metadata record, tied by
concurrent-to identifiers. Every record is a gzip member of its own, so a reader can start at any. Members are gathered to pieces of PIECE_BYTES, rows of
Spark's text writer, whose line separator is an empty member; so files are written by Spark's own committer to whatever store it reaches, and a lost
executor's files are written again. A file holds FILE_BYTES and one capture at most.

Reading: files by Spark's binaryFile source, unpacked step by step and cut into records by their declared lengths alone (payloads may hold blank lines or
whole records); a worker holds one file as it is stored and one record.

Assembly: request and metadata name the response that they are concurrent to; that name, or a record's own,
is the capture's; one aggregation by it gives one nested row for each capture. A revisit names the record that it refers to, whose payload is
its own, and repeats that payload's length in its HTTP header and the other capture's page in its metadata.

Equal payloads of at least min_bytes: the smallest page_id of them is the response, the others revisit it. Rows that share that page_id
are all responses, and revisits name one of them. Null html is an empty payload; a null page_id is written without an id, never the smallest, and comes
back as null. Null urls are written as the empty address; a url that a header line can't hold as it is (line ends, blanks around it) goes into the metadata in base64 as well. Very large payloads
are bounded by Spark's rows (2 GB); other columns, whatever their names, are ignored. An empty table gives an empty archive.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from huespan.llm.common import materialize

#: Bytes of members that one written row holds, and of a file; either may exceed it by one capture.
PIECE_BYTES, FILE_BYTES = 4 << 20, 64 << 20
#: Bytes of one read of an archive at most that are handed over as one batch.
RECORD_BATCH_BYTES = 8 << 20
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"  # fixed value, RFC 4648
_END = "\r\n\r\n"


def sha1_base32(data: Column) -> Column:
    """Bare upper-case base32 SHA-1 of a binary column, without leaving the JVM."""
    hexes = F.sha1(data)
    out = []
    for k in range(4):  # 160 bits are four times 40, and 40 are eight digits
        part = F.conv(F.substring(hexes, 10 * k + 1, 10), 16, 10).cast("long")
        out += [F.substring(F.lit(_BASE32), (F.shiftright(part, 35 - 5 * j).bitwiseAND(F.lit(31)) + 1).cast("int"), F.lit(1)) for j in range(8)]
    return F.concat(*out)


def plan_captures(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, url, payload, payload_bytes, payload_digest, refers_to (null: a response), uid and refers_uid (which name records)."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    known = rows.select("page_id", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("sha1"))
    # Only payloads that more than one row has can make revisits.
    shared = known.where((F.col("payload_bytes") >= min_bytes) & F.col("page_id").isNotNull()).groupBy("sha1", "page_id").agg(F.count(F.lit(1)).alias("c"))
    firsts = shared.groupBy("sha1").agg(F.min("page_id").alias("first_id"), F.min_by("c", "page_id").alias("c"), F.sum("c").alias("n"))
    nameless = known.where((F.col("payload_bytes") >= min_bytes) & F.col("page_id").isNull()).select("sha1").distinct().withColumn("nameless", F.lit(True))
    firsts = materialize(firsts.join(nameless, "sha1", "left").where((F.col("n") > 1) | F.col("nameless")).select("sha1", "first_id", "c"), "firsts")
    full = rows.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("sha1", F.sha1("payload")).withColumn("payload_digest", sha1_base32(F.col("payload")))
    joined = full.join(firsts, "sha1", "left")
    refers = F.when((F.col("payload_bytes") >= min_bytes) & ~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id"))
    # The record that revisits name has a name that they can make, too; all others have random ones.
    made = F.md5(F.concat_ws(" ", F.col("first_id").cast("string"), "sha1").cast("binary"))
    named = F.concat_ws("-", *[F.substring(made, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    main = F.coalesce(F.col("page_id") == F.col("first_id"), F.lit(False))
    captures = joined.withColumns({"refers_to": refers, "main": main})
    if not firsts.where("c > 1").isEmpty():  # rows that repeat such a page: one of them is named
        one = F.row_number().over(Window.partitionBy("sha1").orderBy("payload_bytes")) == 1
        captures = captures.where(~F.col("main") | (F.col("c") == 1)).unionByName(captures.where(F.col("main") & (F.col("c") > 1)).withColumn("main", one))
    return captures.select("page_id", "url", "payload", "payload_bytes", "payload_digest", "refers_to", F.when(F.col("main"), named).otherwise(F.uuid()).alias("uid"), F.when(F.col("refers_to").isNotNull(), named).alias("refers_uid"))


def _record(kind: str, headers: list[tuple[str, Column]], block: Column) -> Column:
    """One record as a string column, without the blank lines that end it. A header whose value is null is left out."""
    lines = [F.lit(f"WARC/1.1\r\nWARC-Type: {kind}\r\n") if kind else F.lit("WARC/1.1\r\n")]
    lines += [F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n")), F.lit("")) for name, value in headers]
    lines += [F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit(_END), block]
    return F.concat(*lines)


def write_archives(captures: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", compression: str = "gzip", piece_bytes: int = PIECE_BYTES, file_bytes: int = FILE_BYTES) -> None:
    """Write the rows of plan_captures() as WARC files below path; compression: gzip or none."""
    shown = F.trim(F.regexp_replace(F.coalesce("url", F.lit("")), "[\\r\\n\\t\\x00\\x0B\\x0C]", "%0A"))
    c = captures.withColumn("uri", shown)
    rid = lambda part: F.concat(F.lit("<urn:uuid:"), F.col("uid"), F.lit(f"{part}>"))
    host = F.regexp_extract("uri", "://([^/?#]*)", 1)
    target = F.regexp_replace("uri", "^.*?://[^/?#]*", "")
    common = [("WARC-Date", F.lit(date)), ("WARC-Target-URI", F.col("uri"))]
    request = _record("request", [("WARC-Record-ID", rid("-q")), ("WARC-Concurrent-To", rid("")), *common, ("Content-Type", F.lit("application/http; msgtype=request"))], F.concat(F.lit("GET "), F.when(F.startswith(target, F.lit("/")), target).otherwise(F.concat(F.lit("/"), target)), F.lit(" HTTP/1.1\r\nHost: "), host, F.lit(_END)))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: "), F.col("payload_bytes").cast("string"), F.lit(_END))
    revisit = F.col("refers_to").isNotNull()
    body = F.when(revisit, http).otherwise(F.concat(http, F.col("payload").cast("string")))
    response = _record(
        "",
        [
            ("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
            ("WARC-Record-ID", rid("")),
            *common,
            ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
            ("WARC-Profile", F.when(revisit, "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
            ("WARC-Refers-To", F.concat(F.lit("<urn:uuid:"), F.col("refers_uid"), F.lit(">"))),
            ("Content-Type", F.lit("application/http; msgtype=response")),
        ],
        body,
    )
    field = lambda name, value: F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))
    fields = F.concat(
        field("page-id", F.col("page_id").cast("string")),
        field("refers-to-page-id", F.col("refers_to").cast("string")),
        field("url-base64", F.when(F.col("uri") != F.col("url"), F.regexp_replace(F.base64(F.col("url").cast("binary")), "\\s", ""))),
        F.lit("fetch: crawl\r\n"),
    )
    metadata = _record("metadata", [("WARC-Record-ID", rid("-m")), ("WARC-Concurrent-To", rid("")), *common, ("Content-Type", F.lit("application/warc-fields"))], fields)
    rows = c.select(*[F.concat(r, F.lit(_END)).cast("binary").alias(n) for n, r in (("request", request), ("response", response), ("metadata", metadata))])
    packed = compression == "gzip"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece: list[bytes] = []
        held = 0
        for batch in batches:
            for records in zip(*batch.columns, strict=True):
                for r in records:
                    data = r.as_buffer()
                    piece.append(member(data) if packed else data.to_pybytes())
                    held += len(piece[-1])
                if held >= piece_bytes:
                    yield _piece(piece, packed)
                    piece, held = [], 0
        if piece:
            yield _piece(piece, packed)

    lines = rows.mapInArrow(work, "piece binary").select(F.col("piece").cast("string").alias("value"))
    # Bytes that are no text pass as they are; only the separator has an encoding.
    end = _EMPTY.decode("latin-1") if packed else _END
    lines.write.option("encoding", "ISO-8859-1").option("lineSep", end).option("maxRecordsPerFile", max(1, file_bytes // piece_bytes)).text(path)


def member(data: bytes | memoryview) -> bytes:
    """One gzip member."""
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(data) + pack.flush()


_EMPTY = member(b"")


def _piece(parts: list[bytes], packed: bool) -> pa.RecordBatch:
    whole = b"".join(parts)
    return pa.RecordBatch.from_arrays([pa.array([whole if packed else whole.removesuffix(_END.encode())], pa.binary())], ["piece"])


RECORD = pa.schema(
    [("warc_type", pa.string()), ("record_id", pa.string()), ("concurrent_to", pa.string()), ("refers_to", pa.string()), ("target_uri", pa.string()), ("date", pa.string()), ("headers", pa.map_(pa.string(), pa.string())), ("http_status", pa.int32()), ("http_length", pa.int64()), ("fields", pa.map_(pa.string(), pa.string())), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())]
)
RECORD_SQL = "warc_type string, record_id string, concurrent_to string, refers_to string, target_uri string, date string, headers map<string,string>, http_status int, http_length long, fields map<string,string>, payload binary, payload_bytes long, payload_digest string"


def _headers(data: bytes) -> list[tuple[str, str]]:
    """Header lines as pairs; a line that begins with a blank continues the one before."""
    out: list[tuple[str, str]] = []
    for line in data.split(b"\r\n"):
        if line[:1] in (b" ", b"\t") and out:
            out[-1] = (out[-1][0], f"{out[-1][1]} {line.strip().decode('utf-8', 'replace')}")
        elif b":" in line:
            name, _, value = line.partition(b":")
            out.append((name.strip().decode("utf-8", "replace").lower(), value.strip().decode("utf-8", "replace")))
    return out


def unpack(data: bytes, step: int = 1 << 20) -> Iterator[bytes]:
    """An archive's bytes in steps; gzip members are unpacked one after the other."""
    rest = memoryview(data).cast("B")
    if rest[:2] != b"\x1f\x8b":
        yield from (bytes(rest[at : at + step]) for at in range(0, len(rest), step))
        return
    at = 0
    while rest[at : at + 2] == b"\x1f\x8b":
        d = zlib.decompressobj(31)
        try:
            while not d.eof and at < len(rest):
                given = rest[at : at + step]
                out = d.decompress(given, step)
                while out:
                    yield out
                    out = b"" if d.eof else d.decompress(d.unconsumed_tail, step)
                at += len(given) - len(d.unused_data)
        except zlib.error:  # damaged: what came out so far is all
            return
        if not d.eof:
            return


def parse_records(parts: Iterable[bytes], payloads: bool = True) -> Iterator[dict]:
    """Records of an archive that comes in parts; one that is cut off at the end is left out. Holds one record at a time."""
    source, held = iter(parts), bytearray()

    def find(sign: bytes, begin: int) -> int:
        """Where sign is at begin or later, reading on as far as needed; -1 if nowhere."""
        while (at := held.find(sign, begin)) < 0:
            begin = max(begin, len(held) - len(sign) + 1)
            more = next(source, None)
            if more is None:
                return -1
            held.extend(more)
        return at

    while (at := find(b"WARC/", 0)) >= 0:
        del held[:at]
        cut = find(b"\r\n\r\n", 0)
        if cut < 0:
            return
        head = _headers(bytes(held[:cut]))
        h = dict(head)
        try:
            n = int(h["content-length"])
        except (KeyError, ValueError):
            del held[: cut + 4]  # damaged: look for the next record
            continue
        while len(held) < cut + 4 + n:
            more = next(source, None)
            if more is None:
                return
            held.extend(more)
        block = bytes(memoryview(held)[cut + 4 : cut + 4 + n])
        del held[: cut + 4 + n]
        row: dict = dict.fromkeys(RECORD.names)
        row |= {"warc_type": h.get("warc-type"), "record_id": h.get("warc-record-id"), "concurrent_to": h.get("warc-concurrent-to"), "refers_to": h.get("warc-refers-to"), "target_uri": h.get("warc-target-uri"), "date": h.get("warc-date"), "headers": list(h.items())}
        kind = h.get("content-type", "")
        if kind.startswith("application/http"):
            body = block.find(b"\r\n\r\n")
            body = n if body < 0 else body + 4
            first, _, rest = block[:body].partition(b"\r\n")
            http = dict(_headers(rest))
            if first.startswith(b"HTTP/"):
                code = first.split(b" ")[1:2]
                row["http_status"] = int(code[0]) if code and code[0].isdigit() else None
            row["http_length"] = int(http["content-length"]) if http.get("content-length", "").isdigit() else None
            payload = memoryview(block)[body:]
        else:
            payload = block
            if kind.startswith("application/warc-fields"):
                row["fields"] = list(dict(_headers(block)).items())
        if row["warc_type"] == "revisit":
            row["payload_bytes"], row["payload_digest"] = row["http_length"], h.get("warc-payload-digest", "").removeprefix("sha1:") or None
        else:
            row["payload_bytes"], row["payload_digest"] = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
            row["payload"] = bytes(payload) if payloads else None
        yield row


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Records of all archives below path. payloads=False leaves out the bytes, not their length and digest."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows, held = [], 0
                for row in parse_records(unpack(content.as_buffer() if content.is_valid else b""), payloads):
                    rows.append(row)
                    held += 400 + len(row["payload"] or b"")
                    if held > RECORD_BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, RECORD)
                        rows, held = [], 0
                yield pa.RecordBatch.from_pylist(rows, RECORD)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("content").mapInArrow(work, RECORD_SQL)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row for each capture: capture_id, page_id, request, response, metadata; a part that is missing is null."""
    is_answer = F.col("warc_type").isin("response", "revisit")
    inner = F.struct(*[c for c in records.columns])
    part = lambda which: F.first(F.when(which, inner), ignorenulls=True)
    tied = records.where(is_answer | F.col("warc_type").isin("request", "metadata")).withColumn("capture_id", F.coalesce("concurrent_to", "record_id"))
    out = tied.groupBy("capture_id").agg(part(F.col("warc_type") == "request").alias("request"), part(is_answer).alias("response"), part(F.col("warc_type") == "metadata").alias("metadata"))
    return out.select("capture_id", F.col("metadata.fields")["page-id"].cast("long").alias("page_id"), "request", "response", "metadata")


def capture_digest(captures: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, url of assembled captures."""
    fields = F.col("metadata.fields")
    url = F.coalesce(F.unbase64(fields["url-base64"]).cast("string"), F.col("response.target_uri"))
    return captures.select("page_id", F.col("response.payload_bytes").alias("payload_bytes"), F.col("response.payload_digest").alias("payload_digest"), F.col("response.warc_type").alias("record_type"), fields["refers-to-page-id"].try_cast("long").alias("refers_to"), url.alias("url"))
