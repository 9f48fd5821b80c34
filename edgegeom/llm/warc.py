"""WARC archives: written with an index, read back by coalesced byte ranges.

Every row becomes one record in its own gzip member. While a task writes, it emits an index row per
record: file, offset, length, URL and payload digest. Whoever reads selects index rows, sorts them by
place, merges neighbours up to ``GAP`` bytes apart into ranges of about ``RANGE`` bytes and reads each
range once. Of records with equal payloads of at least ``min_revisit`` bytes the one of the smallest
page_id is a response and the others revisit it.

Defined results: a null payload is empty; a null URL is empty, control characters in one are
percent-encoded; a null page_id is never the smallest unless all are null, and then every record is a
response; repeated rows of the smallest page_id are responses all; very long payloads
are one record, held by one task; other columns are not read; an empty table gives no file and no row.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..staging import stage, staging_path
from .files import Output, new_name, read_range

#: A file is closed when it has so many bytes.
FILE_BYTES = 256 << 20
#: Bytes between records that are read along, and bytes of a range.
GAP, RANGE = 64 << 10, 8 << 20
#: Digest rows that a batch of read records has at most.
BATCH = 64
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NAME = "<urn:x-page:%s>"
INDEX = "file string, offset bigint, length bigint, url string, digest string, page_id bigint, record_type string"
RECORD = "page_id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string, payload binary"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str = DATE) -> bytes:
    """One record, uncompressed. A revisit has the HTTP head but not the payload."""
    address = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {NAME % page_id}", f"WARC-Date: {date}", f"WARC-Target-URI: {address}", f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}",
    ]
    if refers_to is not None:
        head[3:3] = [f"WARC-Refers-To: {NAME % refers_to}", f"WARC-Profile: {PROFILE}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """The fields of one uncompressed record; the digest of a response is checked."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    body = rest[: int(fields["Content-Length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    length = int(re.search(rb"(?i)content-length: (\d+)", http)[1])
    number = lambda name: None if (m := re.search(r"page:(-?\d+)", fields.get(name, ""))) is None else int(m[1])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload) != length or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise ValueError(f"the payload of {fields['WARC-Record-ID']} is damaged")
    return {
        "page_id": number("WARC-Record-ID"), "url": fields["WARC-Target-URI"], "record_type": kind, "refers_to": number("WARC-Refers-To"),
        "payload_bytes": length, "payload_digest": digest, "payload": payload if kind == "response" else None,
    }


def write(pages: DataFrame, folder: str | None = None, min_revisit: int = 0, payload: str = "html") -> DataFrame:
    """Writes all rows of ``page_id, url, <payload>`` as records; the staged index of what was written."""
    folder = folder or staging_path(pages.sparkSession, "warc")
    body = F.coalesce(F.col(payload), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", body.alias("payload"), F.sha1(body).alias("digest"))
    first = pages.select("page_id", F.sha1(body).alias("digest"), F.octet_length(body).alias("size"))
    digests = first.where(F.col("size") >= min_revisit)
    # Only digests met again are looked up, by ids and digests alone; payloads meet their verdict by page.
    first = digests.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 and first is not null")
    revisits = digests.join(first.select("digest", "first"), "digest").where(~F.col("first").eqNullSafe(F.col("page_id")))
    revisits = revisits.groupBy("page_id", "digest").agg(F.min("first").alias("refers_to"))
    revisits = revisits.select(F.col("page_id").alias("again"), F.col("digest").alias("again_digest"), "refers_to")
    same = F.col("page_id").eqNullSafe(F.col("again")) & (F.col("digest") == F.col("again_digest"))
    rows = rows.join(revisits, same, "left").select("page_id", "url", "payload", "digest", "refers_to")

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = None
        for batch in batches:
            made = []
            for x in batch.to_pylist():
                digest = base64.b32encode(bytes.fromhex(x["digest"])).decode()
                pack = zlib.compressobj(6, zlib.DEFLATED, 31)
                raw = record(x["page_id"], x["url"], x["payload"], digest, x["refers_to"])
                data = pack.compress(raw) + pack.flush()
                out = out or Output(new_name(folder, ".warc.gz"))
                kind = "response" if x["refers_to"] is None else "revisit"
                made.append({"file": out.uri, "offset": out.size, "length": len(data), "url": x["url"], "digest": digest, "page_id": x["page_id"], "record_type": kind})
                out.write(data)
                if out.size >= FILE_BYTES:
                    out.close()
                    out = None
            if made:
                yield pa.RecordBatch.from_pylist(made, _INDEX)
        if out:
            out.close()

    return stage(rows.mapInArrow(put, INDEX), "warc-index")


_INDEX = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("url", pa.string()), ("digest", pa.string()), ("page_id", pa.int64()), ("record_type", pa.string())])
_RECORD = pa.schema([
    ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
    ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary()),
])


def ranges(index: DataFrame, gap: int = GAP, size: int = RANGE) -> DataFrame:
    """``file, start, stop, places``: byte ranges that hold the selected records, with these."""
    along = Window.partitionBy("file").orderBy("offset", "length")
    before = F.lag(F.col("offset") + F.col("length")).over(along)
    apart = F.coalesce((F.col("offset") - before > gap) | (F.floor(F.col("offset") / size) != F.floor(F.lag("offset").over(along) / size)), F.lit(True))
    rows = index.select("file", "offset", "length", apart.cast("int").alias("opens"))
    rows = rows.withColumn("range", F.sum("opens").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    place = F.struct("offset", "length")
    return rows.groupBy("file", "range").agg(
        F.min("offset").alias("start"), F.max(F.col("offset") + F.col("length")).alias("stop"), F.sort_array(F.collect_list(place)).alias("places")
    ).select("file", "start", "stop", "places")


def read(index: DataFrame, gap: int = GAP, size: int = RANGE) -> DataFrame:
    """The records that the rows of an index name."""
    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.to_pylist():
                data = read_range(x["file"], x["start"], x["stop"] - x["start"])
                made = []
                for place in x["places"]:
                    at = place["offset"] - x["start"]
                    made.append(parse(zlib.decompress(data[at : at + place["length"]], 31)))
                    if len(made) == BATCH:
                        yield pa.RecordBatch.from_pylist(made, _RECORD)
                        made = []
                if made:
                    yield pa.RecordBatch.from_pylist(made, _RECORD)

    # The index is small and would be one task's; its ranges are dealt over as many as the bytes ask for.
    n_bytes = index.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    spread = ranges(index, gap, size).repartition(max(1, -(-n_bytes // size)), "file", "start")
    return spread.mapInArrow(fetch, RECORD)
