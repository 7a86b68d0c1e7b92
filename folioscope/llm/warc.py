"""WARC archives compressed by Zstandard with a dictionary, written and read through Spark.

An archive starts with a skippable frame (magic 0x184D2A5D) that holds the dictionary; each record is a
frame of its own.  Archives go to any store that Spark can write: its text writer puts rows after one
another with a separator, and the separator here is an empty skippable frame, which readers pass over.

Of records with equal payloads that with the smallest page id is the response and the others are revisits
that refer to it.  Payloads are never gathered by content: only (id, digest) pairs are, and the page
itself is moved once, by its id and digest, into as many partitions as its archives need to stay small.

Defined results: a null payload is an empty one; a null id is never a response if an equal payload has an
id; rows that repeat id and payload have the same type; an empty table gives no archive and no rows; other
columns are ignored.  A damaged frame, header, length or digest raises.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import materialise, new_path

DICTIONARY_MAGIC, SKIPPABLE = 0x184D2A5D, range(0x184D2A50, 0x184D2A60)
EMPTY_FRAME = "P*M\x18\0\0\0\0"
DICTIONARY_BYTES, DICTIONARY_RECORDS, LEVEL = 32 << 10, 200, 3
#: Payload of an archive on average: its whole file is one row when it is read back.
ARCHIVE_BYTES = 64 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _urn(page: int | None) -> str:
    return f"<urn:page:{'none' if page is None else page}>"


def _page(urn: str) -> int | None:
    if not (urn.startswith("<urn:page:") and urn.endswith(">")):
        raise ValueError(f"not a record id: {urn}")
    return None if urn == "<urn:page:none>" else int(urn[10:-1])


def build_record(page: int | None, url: str | None, payload: bytes, first: int | None) -> bytes:
    """A response, or a revisit if ``first`` is another page; that has the HTTP header alone."""
    revisit = first is not None and page != first
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if not revisit:
        block += payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_urn(page)}", f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{payload_digest(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(c if c.isprintable() and c != " " else "".join(f"%{b:02X}" for b in c.encode()) for c in url))
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_urn(first)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(record: bytes) -> dict:
    """The record's fields, with its headers, lengths and digest validated."""
    head, mark, rest = record.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not mark or lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise ValueError("not a WARC record")
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or not name or name != name.strip():
            raise ValueError(f"bad header line: {line!r}")
        fields[name.lower()] = value.strip()
    missing = {"warc-type", "warc-record-id", "warc-date", "content-length"} - fields.keys()
    if missing:
        raise ValueError(f"missing headers: {sorted(missing)}")
    if not fields["content-length"].isdigit():
        raise ValueError("bad Content-Length")
    size = int(fields["content-length"])
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise ValueError(f"the block has {len(rest) - 4} bytes and not {size}")
    http, mark, payload = rest[:size].partition(b"\r\n\r\n")
    length = [x.partition(b":")[2].strip() for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
    if not mark or len(length) != 1 or not length[0].isdigit():
        raise ValueError("bad HTTP header")
    kind, digest = fields["warc-type"], fields.get("warc-payload-digest", "").removeprefix("sha1:")
    if kind == "response":
        if len(payload) != int(length[0]) or payload_digest(payload) != digest:
            raise ValueError("the payload differs from its length or digest")
    elif kind != "revisit" or payload or "warc-refers-to" not in fields or len(digest) != 32:
        raise ValueError(f"bad record of type {kind}")
    return {
        "page_id": _page(fields["warc-record-id"]), "url": fields.get("warc-target-uri"), "payload": payload if kind == "response" else None, "payload_bytes": int(length[0]),
        "payload_digest": digest, "record_type": kind, "refers_to": _page(fields["warc-refers-to"]) if kind == "revisit" else None,
    }


def _dictionary(samples: list[bytes]) -> zstandard.ZstdCompressionDict | None:
    """Trained on an archive's first records; none if they are too few or too alike for that."""
    size = min(DICTIONARY_BYTES, sum(map(len, samples)) // 8)
    if len(samples) < 16 or size < 1024:
        return None
    try:
        return zstandard.train_dictionary(size, samples)
    except zstandard.ZstdError:
        return None


def _frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    packer = None
    for batch in batches:
        page, url, html, first = (c.to_pylist() for c in (batch.column(0), batch.column(1), batch.column(2).cast(pa.binary()), batch.column(3)))
        records = [build_record(p, u, h or b"", f) for p, u, h, f in zip(page, url, html, first, strict=True)]
        if not records:
            continue
        frames = []
        if packer is None:
            trained = _dictionary([r[:16384] for r in records[:DICTIONARY_RECORDS]])
            packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=trained, write_checksum=True)
            if trained is not None:
                data = trained.as_bytes()
                frames.append(struct.pack("<II", DICTIONARY_MAGIC, len(data)) + data)
        frames += [packer.compress(r) for r in records]
        yield pa.RecordBatch.from_arrays([pa.array(frames, pa.binary())], names=["frame"])


def _firsts(pairs: DataFrame) -> DataFrame:
    """``page, digest, first`` of distinct ``pairs``: the smallest page of each digest.

    Totals are combined before the shuffle.  A digest of more than a thousandth of all rows is one of a
    thousand at most, so those are broadcast and their rows are not gathered by digest.
    """
    totals = materialise(pairs.groupBy("digest").agg(F.min("page").alias("first"), F.count("*").alias("n")), "digests")
    rows = totals.agg(F.sum("n")).head()[0] or 0
    large = F.col("n") > max(1000, rows // 1000)
    hot = F.broadcast(totals.where(large).select(F.col("digest").alias("h_digest"), F.col("first").alias("h_first")))  # 1000 rows at most
    rest = totals.where(~large).select("digest", "first")
    tried = pairs.distinct().join(hot, F.col("digest") == F.col("h_digest"), "left")
    cold = tried.where(F.col("h_digest").isNull()).select("page", "digest").join(rest, "digest").select("page", "digest", "first")
    return cold.unionByName(tried.where(F.col("h_digest").isNotNull()).select("page", "digest", F.col("h_first").alias("first")))


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Archives under ``path``, one per partition; partitions get ``archive_bytes`` of payload on average."""
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    key = [F.coalesce("page", F.lit(0)).alias("k_page"), F.isnull("page").alias("k_null")]
    rows = pages.select(F.col(id_col).cast("long").alias("page"), F.col(url_col).alias("url"), payload.alias("payload"), F.sha1(payload).alias("digest"))
    pairs = materialise(rows.select("page", "digest", F.octet_length("payload").alias("bytes")), "pairs")
    total = pairs.agg(F.sum(F.col("bytes").cast("long"))).head()[0] or 0
    archives = max(1, -(-total // archive_bytes))
    known = _firsts(pairs.select("page", "digest")).select(*key, "digest", "first").repartition(archives, "k_page", "k_null", "digest")
    dealt = rows.select("*", *key).repartition(archives, "k_page", "k_null", "digest")
    frames = dealt.join(known, ["k_page", "k_null", "digest"]).select("page", "url", "payload", "first").mapInArrow(_frames, "frame binary")
    frames.select(F.col("frame").cast("string").alias("value")).write.option("lineSep", EMPTY_FRAME).text(path)


def read_archive(data: bytes) -> Iterator[bytes]:
    """The records of an archive, one per frame."""
    view, at, unpacker = memoryview(data), 0, None
    while at < len(data):
        if at + 8 > len(data):
            raise ValueError("the archive ends within a frame")
        magic, size = struct.unpack_from("<II", data, at)
        if magic in SKIPPABLE:
            if at + 8 + size > len(data):
                raise ValueError("the archive ends within a frame")
            if at == 0 and magic == DICTIONARY_MAGIC:
                unpacker = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(view[8 : 8 + size].tobytes()))
            at += 8 + size
            continue
        if unpacker is None:
            unpacker = zstandard.ZstdDecompressor()
        one, out, step = unpacker.decompressobj(), [], 1 << 13
        while not one.eof:
            if at >= len(data):
                raise ValueError("the archive ends within a frame")
            out.append(one.decompress(view[at : at + step]))
            at = min(at + step, len(data))
            step = min(step * 2, 1 << 20)
        at -= len(one.unused_data)
        yield b"".join(out)


_FIELDS = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
_SCHEMA = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _records(with_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                rows: list[dict] = []
                for record in read_archive(data.as_py()):
                    rows.append(parse_record(record))
                    if not with_payload:
                        rows[-1]["payload"] = None
                    if len(rows) >= (256 if with_payload else 4096):
                        yield pa.RecordBatch.from_pylist(rows, schema=_FIELDS)
                        rows = []
                yield pa.RecordBatch.from_pylist(rows, schema=_FIELDS)

    return run


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """One row per record: ``page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path).select("content")
    return files.mapInArrow(_records(with_payload), _SCHEMA)


def archive_round_trip(pages: DataFrame, with_payload: bool = False, **columns: str) -> DataFrame:
    """Write ``pages`` to archives in the shared folder and read them back."""
    path = new_path(pages.sparkSession, "warc")
    write_archives(pages, path, **columns)
    return read_archives(pages.sparkSession, path, with_payload)
