"""WARC archives: records with segments and chunked payloads, written and read back by Spark.

write_archives() writes one record a row, with long blocks in several segments: the first has the record's own type, each
further one is a continuation that names its origin's record identifier and its own segment number, the last also the total
length. read_archives() parses files by Content-Length, groups segments by origin, orders them by number, holds the joined
length against the total, and takes the chunked transfer framing off the payload. Both only use Spark's own readers and
writers, so the folder may be in any store.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm import common

#: Bytes of payload in a file of an archive, by the mean and by the largest payload; records of one at most.
FILE_BYTES, MOST_FILE_BYTES, FILE_RECORDS = 64 << 20, 1 << 30, 8000
#: Payloads of fewer bytes are never revisits.
REVISIT_BYTES = 1000
#: Digests of shared payloads are marked in a table of 2 ** MARK_BITS bits at most, which is broadcast.
MARK_BITS = 24
SEGMENT_BYTES, CHUNK_BYTES = 16_384, 4_096
VERSION = b"WARC/1.1\r\n"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _cuts(data: bytes, size: int) -> Iterator[bytes]:
    """data in parts of about size bytes that do not end within a character."""
    at = 0
    while at < len(data):
        end = min(len(data), at + size)
        while end < len(data) and data[end] & 0xC0 == 0x80:
            end += 1
        yield data[at:end]
        at = end


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    return b"".join(b"%x\r\n%b\r\n" % (len(x), x) for x in _cuts(payload, size)) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    """The payload of a body in chunked transfer coding; extensions and trailers are passed over."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].partition(b";")[0], 16)
        at = end + 2
        if not size:
            return b"".join(out)
        if len(body) < at + size + 2 or body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("a chunk ends too early")
        out.append(body[at : at + size])
        at += size + 2


def payload_of(block: bytes) -> bytes:
    """The payload of an HTTP response block."""
    head, found, body = block.partition(b"\r\n\r\n")
    if not found:
        raise ValueError("the HTTP header has no end")
    return unchunked(body) if b"\r\ntransfer-encoding: chunked" in head.lower() else body


def record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))])
    return VERSION + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def _line(value: str) -> str:
    """A value that fits in a header line."""
    return "".join(c if c >= " " else f"%{ord(c):02X}" for c in value)


def records(row_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, segment_bytes: int = SEGMENT_BYTES) -> bytes:
    """All records of one row."""
    name = f"<urn:uuid:{uuid.uuid4()}>"
    sha = "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()
    fields = [("WARC-Record-ID", name), ("WARC-Date", "2024-01-01T00:00:00Z"), ("WARC-Target-URI", _line(url or "")), ("WARC-Payload-Digest", sha), ("Content-Type", "application/http; msgtype=response")]
    fields += [("X-Payload-Bytes", str(len(payload)))] + ([("X-Row-ID", str(row_id))] if row_id is not None else [])
    if refers_to is not None:
        return record([("WARC-Type", "revisit"), *fields, ("WARC-Profile", PROFILE), ("X-Refers-To-Row-ID", str(refers_to))], HTTP.replace(b"Transfer-Encoding: chunked\r\n", b""))
    block = HTTP + chunked(payload)
    parts = list(_cuts(block, segment_bytes))
    if len(parts) == 1:
        return record([("WARC-Type", "response"), *fields], block)
    out = [record([("WARC-Type", "response"), *fields, ("WARC-Segment-Number", "1")], parts[0])]
    for k, part in enumerate(parts[1:], 2):
        more = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", "2024-01-01T00:00:00Z"), ("WARC-Segment-Origin-ID", name), ("WARC-Segment-Number", str(k))]
        out.append(record(more + [("WARC-Segment-Total-Length", str(len(block)))] * (k == len(parts)), part))
    return b"".join(out)


def parse(content: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (names in lower case) and block of each record of a file that comes in pieces."""
    held = bytearray()
    need = 0
    pieces = iter(content)
    while True:
        end = held.find(b"\r\n\r\n")
        if end >= 0:
            lines = bytes(held[:end]).decode("utf-8", "replace").split("\r\n")
            if not lines[0].startswith("WARC/"):
                raise ValueError(f"no record begins with {lines[0][:40]!r}")
            fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
            need = end + 4 + int(fields["content-length"]) + 4
            if len(held) >= need:
                yield fields, bytes(held[end + 4 : need - 4])
                del held[:need]
                continue
        more = False
        for piece in pieces:
            held += piece
            more = True
            if len(held) >= need:
                break
        if not more:
            if held.strip():
                raise ValueError("the file ends within a record")
            return


def inflated(data: bytes, step: int = 1 << 20) -> Iterator[bytes]:
    """The content of a file of any number of gzip members, or of a plain one, in pieces."""
    if data[:2] != b"\x1f\x8b":
        yield from (data[i : i + step] for i in range(0, len(data), step))
        return
    view = memoryview(data)
    while len(view):
        z = zlib.decompressobj(31)
        at = 0
        while not z.eof and at < len(view):
            yield z.decompress(view[at : at + step])
            at += step
        yield z.flush()
        view = view[max(0, min(at, len(view)) - len(z.unused_data)) :]


def write_archives(df: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = REVISIT_BYTES) -> None:
    """Write a record for each row of df to gzip archives in the folder path.

    The payload is the text in UTF-8; a null one is empty. Of rows with equal payloads of at least `least` bytes, that with
    the largest id is written as response and the others as revisits that name it; all other rows are responses. Repeated
    rows of the response's id are responses too. A row with a null id names no row: it is a revisit if a row with an id has
    its payload. Columns that aren't named are not read. An empty table gives a folder without records. df is computed three
    times and must give the same payloads each time.
    """
    common.ship(df.sparkSession)

    def run(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for start, end in common.pieces(batch.column("payload")):
                rows = batch.slice(start, end - start)
                out = []
                for row_id, url, payload, digest, first in zip(*(rows.column(c).to_pylist() for c in ("id", "url", "payload", "digest", "first")), strict=True):
                    text = records(row_id, url, payload.encode(), digest, first if first is not None and first != row_id else None)
                    out.append(text[:-2].decode())  # the writer ends each row with the last CRLF
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])

    payload = F.coalesce(df[payload_col], F.lit(""))
    rows = df.select(df[id_col].cast("long").alias("id"), df[url_col].cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha1(F.col("payload").cast("binary")))
    large = F.octet_length("payload") >= least
    sized = common.written(rows.select("id", F.octet_length("payload").cast("long").alias("bytes"), F.when(large, F.col("digest")).alias("same")), "payloads")
    firsts = sized.where("same IS NOT NULL").groupBy("same").agg(F.max("id").alias("first"), F.count(F.lit(1)).alias("times")).where("times > 1").select("same", "first")
    firsts = common.written(firsts, "firsts")
    # only rows that share a payload, and those whose digest meets a mark by chance, move to be joined; others are written where they are read
    word = lambda c: F.shiftright(F.xxhash64(c).bitwiseAND((1 << MARK_BITS) - 1), 6)
    bit = lambda c: F.xxhash64(c).bitwiseAND(63).cast("int")
    marks = firsts.groupBy(word("same").alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit("same"))).alias("bits"))
    known = rows.join(F.broadcast(marks), F.when(large, word("digest")) == F.col("word"), "left")
    marked = F.coalesce(F.getbit("bits", bit("digest")) == 1, F.lit(False))
    alone = known.where(~marked).select(*rows.columns, F.lit(None).cast("long").alias("first"))
    moved = known.where(marked).select(*rows.columns).join(firsts, F.col("digest") == F.col("same"), "left").select(*rows.columns, "first")
    rows = alone.unionByName(moved)
    values = rows.select("id", "url", "payload", "digest", "first").mapInArrow(common.lean(run), "value string")
    # readers take a file as a whole, so what is in one is bounded
    mean, most = sized.select(F.coalesce(F.avg("bytes"), F.lit(0.0)), F.coalesce(F.max("bytes"), F.lit(0))).first()
    records_in = max(1, min(FILE_RECORDS, int(FILE_BYTES / (mean + 1)), MOST_FILE_BYTES // (most + 1)))
    values.write.option("lineSep", "\r\n").option("compression", "gzip").option("maxRecordsPerFile", records_in).text(path)
    common.release(sized, firsts)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archives in a folder, gzip or plain and of any name, one row for each origin.

    id, record_type, target_uri, refers_to, payload (binary, null for revisits and damaged records), payload_digest (hex,
    of the payload if there is one, else as recorded), payload_bytes (likewise) and intact: all segments are there, their
    length is the total, the framing can be read and the digest is the recorded one. Segments may be in any order and in
    different files. A file that can't be read to its end gives what stands before the fault, and a row of type damaged
    with the file as target_uri.
    """
    common.ship(spark)

    def split(batches) -> Iterator:
        import pyarrow as pa

        names = ["origin", "number", "total", "id", "type", "uri", "refers_to", "digest", "bytes", "block"]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]

        def found(data, path):
            try:
                for f, block in parse(inflated(data)):
                    number = lambda k, f=f: int(f[k]) if k in f else None
                    digest = f.get("warc-payload-digest", "")
                    hexed = base64.b32decode(digest[5:]).hex() if digest.startswith("sha1:") else None
                    yield f.get("warc-segment-origin-id", f.get("warc-record-id")), number("warc-segment-number") or 1, number("warc-segment-total-length"), number("x-row-id"), f.get("warc-type"), f.get("warc-target-uri"), number("x-refers-to-row-id"), hexed, number("x-payload-bytes"), block
            except (ValueError, KeyError, zlib.error):
                yield f"damaged {path}", 1, None, None, "damaged", path, None, None, None, b""

        for batch in batches:
            for data, path in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                rows, size = [], 0
                for row in found(data.as_py(), path):
                    rows.append(row)
                    size += len(row[-1])
                    if size > 4_000_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    def join(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for start in range(0, batch.num_rows, 200):
                payloads, digests, sizes, intact = [], [], [], []
                for segments, kind, want, size in zip(*(batch.column(c).slice(start, 200).to_pylist() for c in ("segments", "type", "digest", "bytes")), strict=True):
                    block = b"".join(s["block"] for s in segments)
                    total = next((s["total"] for s in segments if s["total"] is not None), None)
                    ok = [s["number"] for s in segments] == list(range(1, len(segments) + 1)) and (total == len(block) if len(segments) > 1 or total is not None else True)
                    payload = None
                    if kind == "response" and ok:
                        try:
                            payload = payload_of(block)
                        except ValueError:
                            ok = False
                    got = hashlib.sha1(payload).hexdigest() if payload is not None else want
                    payloads.append(payload)
                    digests.append(got)
                    sizes.append(len(payload) if payload is not None else size)
                    intact.append(bool(ok and got == want and kind != "damaged"))
                part = batch.slice(start, 200)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("id", "type", "uri", "refers_to")), pa.array(payloads, pa.binary()), pa.array(digests, pa.string()), pa.array(sizes, pa.int64()), pa.array(intact)], ["id", "record_type", "target_uri", "refers_to", "payload", "payload_digest", "payload_bytes", "intact"])

    files = spark.read.format("binaryFile").load(path).select("content", "path")
    rows = files.mapInArrow(common.lean(split), "origin string, number long, total long, id long, type string, uri string, refers_to long, digest string, bytes long, block binary")
    first = lambda c: F.max(F.when(F.col("number") == 1, F.col(c))).alias(c)
    whole = rows.groupBy("origin").agg(F.sort_array(F.collect_list(F.struct("number", "total", "block"))).alias("segments"), *map(first, ("id", "type", "uri", "refers_to", "digest", "bytes")))
    return whole.select("segments", "id", "type", "uri", "refers_to", "digest", "bytes").mapInArrow(common.lean(join), "id long, record_type string, target_uri string, refers_to long, payload binary, payload_digest string, payload_bytes long, intact boolean")


ORACLE = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
f AS (SELECT *, CAST(strlen(html) AS BIGINT) AS payload_bytes, CASE WHEN strlen(html) >= {REVISIT_BYTES} THEN max(page_id) OVER (PARTITION BY html) ELSE page_id END AS first FROM p)
SELECT page_id, payload_bytes, sha1(html) AS payload_digest, CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to FROM f
"""
