"""Zstandard-compressed WARC archives: one frame for each record, a dictionary in a leading skippable frame.

Archives are written by Spark's own text writer, one record frame a row, with an empty skippable frame
as the line separator: so they get Spark's commit protocol, work in any store and never have to fit in
memory on the way out. Archives are cut by bytes, so that one can be read whole.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.session import durable, new_path

# Fixed values of the Zstandard and WARC formats.
ZSTD_MAGIC = b"\x28\xb5\x2f\xfd"
DICTIONARY_MAGIC = 0x184D2A5D
SKIPPABLE_MAGICS = range(0x184D2A50, 0x184D2A60)
EMPTY_SKIPPABLE = "P*M\x18\x00\x00\x00\x00"
WARC_DATE = "1970-01-01T00:00:00Z"

#: Payload bytes in an archive, about; records of at least so many bytes may be revisits.
ARCHIVE_BYTES = 64 << 20
REVISIT_BYTES = 100
DICTIONARY_BYTES = 32 << 10
SAMPLE_RECORDS, SAMPLE_BYTES = 128, 4 << 20
LEVEL = 3

RECORDS = "archive string, record_id string, record_type string, target_uri string, refers_to string, payload binary, payload_bytes long, payload_digest string, error string"
_ARROW = pa.schema([(n, {"string": pa.string(), "binary": pa.binary(), "long": pa.int64()}[t]) for n, t in (x.split() for x in RECORDS.split(", "))])


def _header(value: str) -> str:
    return re.sub(r"[\r\n\0]", lambda m: f"%{ord(m[0]):02X}", value)


def build_record(record_id: str, uri: str | None, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """A response record, or a revisit record whose block keeps only the HTTP header with the payload's length."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if refers_to is None:
        block += payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {WARC_DATE}"]
    if uri is not None:
        lines.append(f"WARC-Target-URI: {_header(uri)}")
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{refers_to}>"]
    lines += [f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode("utf-8") + b"\r\n\r\n" + block + b"\r\n\r\n"


def _headers(lines: list[bytes]) -> dict[str, str]:
    out = {}
    for line in lines:
        name, colon, value = line.partition(b":")
        if not colon:
            raise ValueError(f"header without a colon: {line[:60]!r}")
        out[name.strip().decode("utf-8", "replace").lower()] = value.strip().decode("utf-8", "replace")
    return out


def parse_record(record: bytes) -> dict:
    """The fields of RECORDS but archive and error; ValueError where a header, a length or a digest is wrong."""
    head, gap, rest = record.partition(b"\r\n\r\n")
    first, *lines = head.split(b"\r\n")
    if not gap or not re.fullmatch(rb"WARC/1\.[01]", first):
        raise ValueError("no WARC header")
    named = _headers(lines)
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in named:
            raise ValueError(f"{name} is missing")
    if not named["content-length"].isdigit() or len(rest) != int(named["content-length"]) + 4 or not rest.endswith(b"\r\n\r\n"):
        raise ValueError("the content's length differs from its header")
    block = rest[:-4]
    if (found := named.get("warc-block-digest", "")).startswith("sha256:") and found[7:] != hashlib.sha256(block).hexdigest():
        raise ValueError("the block's digest differs from its header")
    http, gap, payload = block.partition(b"\r\n\r\n")
    if not gap or not http.startswith(b"HTTP/"):
        raise ValueError("no HTTP header")
    length = _headers(http.split(b"\r\n")[1:]).get("content-length", "")
    digest = named.get("warc-payload-digest", "").removeprefix("sha256:")
    revisit = named["warc-type"] == "revisit"
    if not length.isdigit() or not revisit and len(payload) != int(length) or revisit and payload:
        raise ValueError("the payload's length differs from its header")
    if not revisit and digest and digest != hashlib.sha256(payload).hexdigest():
        raise ValueError("the payload's digest differs from its header")
    if revisit and not digest:
        raise ValueError("a revisit without a payload digest")
    return {
        "record_id": named["warc-record-id"].strip("<>"),
        "record_type": named["warc-type"],
        "target_uri": named.get("warc-target-uri"),
        "refers_to": named["warc-refers-to"].strip("<>") if "warc-refers-to" in named else None,
        "payload": None if revisit else payload,
        "payload_bytes": int(length),
        "payload_digest": digest or hashlib.sha256(payload).hexdigest(),
    }


def _frame_end(data: memoryview, at: int) -> int:
    """Where the Zstandard frame at `at` ends, from its own block headers."""
    head = bytes(data[at : at + 18])
    end = at + zstandard.frame_header_size(head)
    checksum = head[4] & 4
    while True:
        if end + 3 > len(data):
            raise ValueError("a frame is cut off")
        block = int.from_bytes(data[end : end + 3], "little")
        end += 3 + (1 if block >> 1 & 3 == 1 else block >> 3)
        if block & 1:
            break
    end += 4 if checksum else 0
    if end > len(data):
        raise ValueError("a frame is cut off")
    return end


def read_frames(data: bytes) -> Iterator[bytes]:
    """The decoded frames of an archive; the dictionary comes from the leading skippable frame, if there is one."""
    view, at, decoder = memoryview(data), 0, zstandard.ZstdDecompressor()
    while at < len(data):
        if len(data) - at < 8:
            raise ValueError("bytes after the last frame")
        magic, size = struct.unpack_from("<II", data, at)
        if magic in SKIPPABLE_MAGICS:
            if at + 8 + size > len(data):
                raise ValueError("a skippable frame is cut off")
            if at == 0 and magic == DICTIONARY_MAGIC:
                found = bytes(view[8 : 8 + size])
                if found[:4] == ZSTD_MAGIC:
                    found = zstandard.ZstdDecompressor().decompressobj().decompress(found)
                decoder = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(found))
            at += 8 + size
        elif bytes(view[at : at + 4]) == ZSTD_MAGIC:
            end = _frame_end(view, at)
            try:
                yield decoder.decompressobj().decompress(bytes(view[at:end]))
            except zstandard.ZstdError as e:
                raise ValueError(f"a frame can't be decoded: {e}") from None
            at = end
        else:
            raise ValueError("neither a frame nor a skippable frame")


def _train(samples: list[bytes]) -> zstandard.ZstdCompressionDict | None:
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples) if len(samples) >= 16 else None
    except zstandard.ZstdError:  # too few or too uniform samples; the archive goes without
        return None


def _frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Record rows (record_id, uri, payload, digest, refers_to) to frames, the dictionary's first; one archive a partition."""
    held: list[bytes] = []
    encoder = None

    def start() -> Iterator[bytes]:
        nonlocal encoder
        dictionary = _train(held)
        encoder = zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary, write_checksum=True)
        if dictionary is not None:
            packed = zstandard.ZstdCompressor(level=LEVEL).compress(dictionary.as_bytes())
            yield struct.pack("<II", DICTIONARY_MAGIC, len(packed)) + packed
        for record in held:
            yield encoder.compress(record)
        held.clear()

    out = lambda rows: pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], names=["frame"])
    for batch in batches:
        made: list[bytes] = []
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            record = build_record(*row)
            if encoder is None:
                held.append(record)
                if len(held) >= SAMPLE_RECORDS or sum(map(len, held)) >= SAMPLE_BYTES:
                    made += start()
            else:
                made.append(encoder.compress(record))
        if made:
            yield out(made)
    if encoder is None and held:
        yield out(list(start()))


def write_archives(records: DataFrame, path: str) -> None:
    """An archive for each partition of (record_id, uri, payload, digest, refers_to)."""
    records.mapInArrow(_frames, "frame binary").select(F.col("frame").cast("string")).write.option("lineSep", EMPTY_SKIPPABLE).text(path)


def read_archives(spark: SparkSession, path: str, errors: str = "raise") -> DataFrame:
    """The records of every archive under a path. errors: "raise", or "collect" to get a row with `error` for each record or archive that is wrong."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows):
            return pa.RecordBatch.from_pylist([dict.fromkeys(_ARROW.names) | r for r in rows], schema=_ARROW)

        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1)):
                rows, size, name = [], 0, name.as_py()
                try:
                    for record in read_frames(content.as_py()):
                        try:
                            rows.append(parse_record(record) | {"archive": name})
                        except ValueError as e:
                            if errors == "raise":
                                raise
                            rows.append({"archive": name, "error": str(e)})
                        size += len(record)
                        if size > 8 << 20 or len(rows) >= 2048:
                            yield out(rows)
                            rows, size = [], 0
                except ValueError as e:
                    if errors == "raise":
                        raise ValueError(f"{name}: {e}") from None
                    rows.append({"archive": name, "error": str(e)})
                if rows:
                    yield out(rows)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, RECORDS)


def archive_pages(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Write a record for each page; equal payloads of at least 100 bytes are revisits of the one with the smallest identifier.

    Null html is an empty payload, a null url leaves its header out. Rows that share identifier and
    payload are all responses or all revisits; a row without an identifier is a response. An empty
    table leaves no archive. Other columns are ignored.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("uri"), F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    light = durable(rows.select("page_id", "digest", F.octet_length("payload").alias("bytes")), "payload-digests")
    large = light.where(F.col("bytes") >= REVISIT_BYTES)
    heads = large.groupBy("digest").agg(F.min("page_id").alias("head"))
    revisits = large.select("page_id", "digest").distinct().join(heads, "digest").where("page_id <> head")
    total = light.agg(F.sum("bytes")).first()[0] or 0
    spread = min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // (4 << 20)))
    parts = max(1, spread, -(-total // ARCHIVE_BYTES))
    name = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")))
    records = rows.repartition(parts, "page_id", "digest").join(revisits.repartition(parts, "page_id", "digest"), ["page_id", "digest"], "left")
    write_archives(
        records.select(name("page_id").alias("record_id"), "uri", "payload", "digest", F.when(F.col("head").isNotNull(), name("head")).alias("refers_to")), path
    )


def round_trip(pages: DataFrame, **columns: str) -> DataFrame:
    """Archive pages in the shared folder and read the archives back: (page_id, payload_bytes, payload_digest, record_type, refers_to, target_uri)."""
    path = new_path(pages.sparkSession, "warc")
    archive_pages(pages, path, **columns)
    number = lambda c: F.expr(f"try_cast(substring_index({c}, ':', -1) AS bigint)")
    return read_archives(pages.sparkSession, path).select(
        number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"), "target_uri"
    )
