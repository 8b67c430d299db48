"""WARC archives in Zstandard: a writer and a reader.

An archive begins with a skippable frame (magic 0x184D2A5D) that holds the dictionary; then there is one frame for each
record, compressed with that dictionary. Of records with equal payloads one is a response, the others revisit it.

The reader takes the dictionary from the leading frame, decodes one frame at a time, and checks of each record: version
line, required headers, the block's length and the end of the frame, and that a response's block has the digest that its
header states. A record that fails raises ArchiveError with the archive and the offset.

The dictionary is trained on the payloads of about TRAIN_RECORDS pages (a hash of the id picks them evenly) of TRAIN_BYTES at
most, and is part of every archive, so archives stand alone.

Defined cases: a null payload is empty; a null url leaves WARC-Target-URI out; line ends in a url are percent-encoded;
records with a null id are never the response of others if an id is known; an empty table writes no archive and gives an
empty result; further columns are ignored. Rows that share a payload and its largest id are all responses.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ._files import read_file, write_file
from ._store import in_tasks, new_folder, saved

DICTIONARY_MAGIC = 0x184D2A5D
DICTIONARY_BYTES = 64 << 10
TRAIN_RECORDS = 500
TRAIN_BYTES = 64 << 10
ARCHIVE_BYTES = 32 << 20
LEVEL = 3
DATE = "2024-01-01T00:00:00Z"
URN = "urn:page:"


class ArchiveError(ValueError):
    pass


def train(samples: list[bytes]) -> bytes:
    """A dictionary from samples; without enough of them a raw one of their bytes."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:DICTIONARY_BYTES] or b"<!DOCTYPE html><html>"


def _dictionary(data: bytes) -> zstandard.ZstdCompressionDict:
    return zstandard.ZstdCompressionDict(data)


def to_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    name = "null" if page_id is None else page_id
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{URN}{name}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    head += [f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}"]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{URN}{'null' if refers_to is None else refers_to}>"]
    block = b"" if revisit else payload
    return ("\r\n".join([*head, "Content-Type: text/html", f"Content-Length: {len(block)}"]) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def parse_record(data: bytes, where: str) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and block of one decoded record."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not gap or lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise ArchiveError(f"{where}: no WARC version line")
    headers = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            raise ArchiveError(f"{where}: header without a colon")
        headers[name.strip().lower()] = value.strip()
    if missing := {"warc-type", "warc-record-id", "warc-date", "content-length"} - headers.keys():
        raise ArchiveError(f"{where}: headers missing: {sorted(missing)}")
    if not headers["content-length"].isdigit() or len(rest) != int(headers["content-length"]) + 4 or not rest.endswith(b"\r\n\r\n"):
        raise ArchiveError(f"{where}: block length differs from Content-Length")
    return headers, rest[:-4]


def frames(data: bytes, where: str = "archive") -> Iterator[tuple[int, bytes]]:
    """Offset and decoded bytes of each record's frame of an archive, with the dictionary of its leading frame."""
    if len(data) < 8:
        raise ArchiveError(f"{where}: too short")
    magic, size = struct.unpack_from("<II", data)
    if magic != DICTIONARY_MAGIC or 8 + size > len(data):
        raise ArchiveError(f"{where}: no dictionary in a leading skippable frame")
    raw = data[8 : 8 + size]
    if raw[:4] == zstandard.FRAME_HEADER:
        raw = zstandard.ZstdDecompressor().decompress(raw)
    decoder, at = zstandard.ZstdDecompressor(dict_data=_dictionary(raw)), 8 + size
    view = memoryview(data)
    while at < len(data):
        one = decoder.decompressobj()
        out, start, ahead = [], at, 1 << 16
        try:
            while not one.eof:
                if at >= len(data):
                    raise ArchiveError(f"{where}, {start}: frame is cut off")
                out.append(one.decompress(view[at : at + ahead]))
                at += ahead
        except zstandard.ZstdError as e:
            raise ArchiveError(f"{where}, {start}: {e}") from e
        at = min(at, len(data)) - len(one.unused_data)
        yield start, b"".join(out)


def records(data: bytes, where: str = "archive") -> Iterator[dict]:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, url and payload (empty for revisits) of each record, checked."""
    def number(value: str) -> int | None:
        if not value.startswith(f"<{URN}") or not value.endswith(">"):
            raise ArchiveError(f"{where}: not a record id: {value}")
        value = value[len(URN) + 1 : -1]
        return None if value == "null" else int(value)

    for at, raw in frames(data, where):
        headers, block = parse_record(raw, f"{where}, {at}")
        kind, digest, size = headers["warc-type"], headers.get("warc-payload-digest", "").removeprefix("sha1:"), int(headers.get("x-payload-length", -1))
        if kind == "response" and (size != len(block) or base64.b32encode(hashlib.sha1(block).digest()).decode() != digest):
            raise ArchiveError(f"{where}, {at}: payload differs from its digest or length")
        if kind not in ("response", "revisit") or kind == "revisit" and ("warc-refers-to" not in headers or size < 0):
            raise ArchiveError(f"{where}, {at}: not a whole response or revisit")
        yield {"page_id": number(headers["warc-record-id"]), "payload_bytes": size, "payload_digest": digest, "record_type": kind,
               "refers_to": number(headers["warc-refers-to"]) if kind == "revisit" else None, "url": headers.get("warc-target-uri"), "payload": block}


def _rows(columns: dict[str, tuple[list, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in columns.values()], names=list(columns))


def _writer(folder: str, dictionary: bytes):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = zstandard.ZstdCompressor(level=LEVEL, dict_data=_dictionary(dictionary), write_content_size=True, write_checksum=True)
        lead = struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)) + dictionary
        part, done, held, n, size = TaskContext.get().partitionId(), [], [lead], 0, 0

        def flush() -> None:
            nonlocal held, n, size
            if n:
                done.append((write_file(folder, f"pages-{part:06d}-{len(done):06d}.warc.zst", b"".join(held)), n))
            held, n, size = [lead], 0, 0

        for batch in batches:
            for i, url, html, digest, refers, revisit in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.append(coder.compress(to_record(i, url, html.encode(), digest, refers, revisit)))
                n, size = n + 1, size + len(held[-1])
                if size >= ARCHIVE_BYTES:
                    flush()
        flush()
        if done:
            yield _rows({"path": ([p for p, _ in done], pa.string()), "n_records": ([k for _, k in done], pa.int64())})

    return write


def write(pages: DataFrame, id_col: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write the pages' records as archives in the shared folder; the manifest: path and n_records of each archive."""
    spark = pages.sparkSession
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url).alias("url"), F.coalesce(html, F.lit("")).alias("html"))
    rows = rows.withColumns({"hex": F.sha1(F.col("html").cast("binary")), "size": F.octet_length("html")})
    able = rows.where(F.col("size").between(1, TRAIN_BYTES))
    n = able.count()
    if n > TRAIN_RECORDS:
        able = able.where(F.pmod(F.xxhash64("id"), F.lit(1 << 31)) < int((1 << 31) * (TRAIN_RECORDS / n)))
    sample = able.select("html").limit(2 * TRAIN_RECORDS).collect()
    dictionary = train([r.html.encode() for r in sample])
    first = rows.groupBy("hex").agg(F.max("id").alias("top"), F.count("*").alias("copies")).where("copies > 1").select("hex", "top")
    linked = rows.join(first, "hex", "left").withColumns({"revisit": F.col("top").isNotNull() & ~F.col("id").eqNullSafe(F.col("top"))})
    out = linked.select("id", "url", "html", F.expr(_base32("hex")).alias("digest"), F.when(F.col("revisit"), F.col("top")).alias("refers"), "revisit")
    folder = new_folder(spark, "warc")
    return saved(out.mapInArrow(_writer(folder, dictionary), "path string, n_records bigint"), "warc-manifest")


def _base32(column: str) -> str:
    """SQL for the base32 form of 40 hexadecimal digits: 5 digits (20 bits) give 4 letters."""
    letters = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'"
    return "concat(" + ", ".join(f"substr({letters}, int((cast(conv(substr({column}, {5 * g + 1}, 5), 16, 10) as bigint) div {32**k}) % 32) + 1, 1)" for g in range(8) for k in (3, 2, 1, 0)) + ")"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            found = [{k: v for k, v in r.items() if k != "payload"} for r in records(read_file(row["path"]), row["path"])]
            if len(found) != row["n_records"]:
                raise ArchiveError(f"{row['path']}: {len(found)} records, {row['n_records']} in the manifest")
            yield _rows({c: ([r[c] for r in found], t) for c, t in (("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()))})


def read_back(manifest: DataFrame) -> DataFrame:
    """Per record of the archives of a manifest: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    return in_tasks(manifest).mapInArrow(_read, "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint")
