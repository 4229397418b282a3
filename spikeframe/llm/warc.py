"""WARC archives: individually compressed records under an embedded dictionary.

Each archive starts with a skippable frame that holds a Zstandard dictionary built
from the archive's own first records (itself compressed); every record is then one
frame of its own. Tasks write archives of bounded size to the shared folder under a
name of their own; the manifest that Spark commits names those that count, so a
task that is run again leaves at most a file that nobody reads.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, shared_dir, with_defaults
from .exact_dedup import copies_by_id

# Fixed values of the formats.
SKIPPABLE_MAGIC = 0x184D2A5D
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_URN = "urn:x-page:"

#: Payloads below this many bytes are always archived in full.
MIN_REVISIT_BYTES = 100
DICT_BYTES, DICT_RECORDS, DICT_SAMPLE_BYTES = 64 << 10, 512, 4 << 20
#: Where whole records teach too little: the lengths of pieces to learn from, and the bytes that they need together.
DICT_PIECES, DICT_LEAST_BYTES = (256, 64, 32, 16), 512
ARCHIVE_BYTES, LEVEL = 64 << 20, 3


def plan_records(pages: DataFrame, id_col: str = "page_id", text_col: str = "html", url_col: str = "url") -> DataFrame:
    """(page_id, url, payload, digest, keep_id, keeper, revisit): what each record will hold.

    keeper: this record is the one that others with the same payload refer to.
    """
    payload = with_defaults(text_col).cast("binary")
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    fates = materialise(copies_by_id(pages, id_col, text_col, "min"), "page-fates").select(F.col("id").alias("__id"), F.col("digest").alias("__digest"), "keep_id", "rows")
    is_row = F.col("page_id").eqNullSafe(F.col("__id")) & (F.col("digest") == F.col("__digest"))
    first = F.lit(True)
    if not fates.where("rows > 1").isEmpty():
        # rows repeated with id and payload: one of them, by a number that stays with the row
        rows = materialise(rows.withColumn("__row", F.monotonically_increasing_id()), "page-rows")
        ones = rows.groupBy("page_id", "digest").agg(F.min(F.struct("url", "__row")).alias("__one")).select(F.col("page_id").alias("__of"), F.col("digest").alias("__what"), F.col("__one.__row").alias("__first"))
        fates = fates.join(ones, F.col("__id").eqNullSafe(F.col("__of")) & (F.col("__digest") == F.col("__what")))
        first = F.col("__row") == F.col("__first")
    keeper = F.col("page_id").eqNullSafe(F.col("keep_id")) & first
    joined = rows.join(fates, is_row).withColumn("keeper", keeper)
    revisit = (F.octet_length("payload") >= MIN_REVISIT_BYTES) & ~F.col("keeper")
    return joined.select("page_id", "url", "payload", "digest", "keep_id", "keeper", revisit.alias("revisit"))


def _clean(url: str) -> str:
    return "".join(c if " " < c else f"%{ord(c):02X}" for c in url)


def record_name(page_id, digest: str, keeper: bool) -> str:
    """Of a record: page id and digest, and for all but the one that others refer to a number of its own."""
    page = "none" if page_id is None else str(page_id)
    return f"{RECORD_URN}{page}:{digest[:32]}" + ("" if keeper else f":{uuid.uuid4().hex}")


def record_bytes(page_id, url, payload: bytes, digest: str, keep_id, keeper: bool, revisit: bool, date: str) -> bytes:
    """One WARC/1.1 record; a revisit has the HTTP head alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <{record_name(page_id, digest, keeper)}>",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.append(f"WARC-Target-URI: {_clean(url)}")
    if revisit:
        head.append(f"WARC-Profile: {REVISIT_PROFILE}")
        head.append(f"WARC-Refers-To: <{record_name(keep_id, digest, True)}>")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def train_dictionary(records: list[bytes]) -> bytes:
    """A Zstandard dictionary from records; where they are too few to learn from, from pieces of them."""
    whole = b"".join(records)
    whole *= -(-DICT_LEAST_BYTES // len(whole))
    for piece in (0, *DICT_PIECES):
        samples = [whole[i : i + piece] for i in range(0, len(whole), piece)] if piece else records
        size = DICT_BYTES
        while size >= 256:
            try:
                return zstandard.train_dictionary(size, samples).as_bytes()
            except zstandard.ZstdError:  # too little to learn from for this size
                size //= 4
    raise ValueError("no dictionary can be made of these records")


class ArchiveWriter:
    """One archive file: dictionary frame, then a frame for each record."""

    def __init__(self, folder: str, records: list[bytes]):
        self.path = f"{folder}/{uuid.uuid4().hex}.warc.zst"
        where, path = fs.FileSystem.from_uri(self.path)
        self.out = where.open_output_stream(path, compression=None)
        self.records = self.size = 0
        trained = train_dictionary(records)
        packed = zstandard.ZstdCompressor(level=LEVEL).compress(trained)
        self._put(struct.pack("<II", SKIPPABLE_MAGIC, len(packed)) + packed)
        data = zstandard.ZstdCompressionDict(trained, dict_type=zstandard.DICT_TYPE_FULLDICT)
        self.packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=data)
        for record in records:
            self.add(record)

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def add(self, record: bytes) -> None:
        self._put(self.packer.compress(record))
        self.records += 1

    def close(self) -> dict:
        self.out.close()
        return {"path": self.path, "records": self.records, "bytes": self.size}


MANIFEST = pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])


def _write(folder: str, date: str):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, writer, waiting, held = [], None, [], 0
        for batch in batches:
            cols = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
            for page_id, url, payload, digest, keep_id, keeper, revisit in zip(*cols, strict=True):
                record = record_bytes(page_id, url, payload, digest, keep_id, keeper, revisit, date)
                if writer is None:
                    waiting.append(record)
                    held += len(record)
                    if len(waiting) >= DICT_RECORDS or held >= DICT_SAMPLE_BYTES:
                        writer, waiting, held = ArchiveWriter(folder, waiting), [], 0
                else:
                    writer.add(record)
                if writer and writer.size >= ARCHIVE_BYTES:
                    done.append(writer.close())
                    writer = None
        if waiting:
            writer = ArchiveWriter(folder, waiting)
        if writer:
            done.append(writer.close())
        yield pa.RecordBatch.from_pylist(done, MANIFEST)

    return task


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", text_col: str = "html", url_col: str = "url", date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write a record for every row; the manifest (path, records, bytes) of the archives.

    A null payload counts as empty, long ones are one record like any other. Of equal payloads of
    at least MIN_REVISIT_BYTES bytes the smallest page id is a response and the others revisit it
    (of repeated rows one is the response); null ids count as larger than any. Ids are integers;
    every record has a name of its own, also where ids repeat. Other columns are not read. No
    rows make no archives.
    """
    where, path = fs.FileSystem.from_uri(folder)
    where.create_dir(path, recursive=True)
    records = plan_records(pages, id_col, text_col, url_col)
    return materialise(records.mapInArrow(_write(folder, date), "path string, records long, bytes long"), "warc-manifest")


def frames(stream, chunk: int = 1 << 20) -> Iterator[bytes]:
    """The records of an archive in order, read in chunks."""
    buffer, ended = b"", False

    def fill(need: int) -> None:
        nonlocal buffer, ended
        while len(buffer) < need and not ended:
            more = stream.read(chunk)
            ended = not more
            buffer += more

    fill(8)
    unpacker = zstandard.ZstdDecompressor()
    if len(buffer) >= 8 and struct.unpack_from("<I", buffer)[0] == SKIPPABLE_MAGIC:
        size = struct.unpack_from("<I", buffer, 4)[0]
        fill(8 + size)
        trained = zstandard.ZstdDecompressor().decompress(buffer[8 : 8 + size])
        unpacker = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(trained))
        buffer = buffer[8 + size :]
    while True:
        fill(1)
        if not buffer:
            return
        part, pieces = unpacker.decompressobj(), []
        while True:
            pieces.append(part.decompress(buffer))
            if part.eof:
                buffer = part.unused_data
                break
            buffer = b""
            fill(1)
            if not buffer:
                raise ValueError("archive ends inside a record")
        yield b"".join(pieces)


def parse_record(record: bytes) -> dict:
    """Fields of a record; a response's payload is held against its digest."""
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length"))
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} does not match its digest")

    def page_of(name: str) -> int | None:
        page = fields.get(name, f"<{RECORD_URN}none").removeprefix(f"<{RECORD_URN}").partition(":")[0]
        return None if page == "none" else int(page)

    return {
        "page_id": page_of("WARC-Record-ID"),
        "url": fields.get("WARC-Target-URI"),
        "payload_bytes": size,
        "payload_digest": digest,
        "record_type": kind,
        "refers_to": page_of("WARC-Refers-To"),
        "payload": payload if kind == "response" else None,
    }


RECORD = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])


def _read(with_payload: bool, rows: int = 256):
    schema = RECORD if with_payload else pa.schema(list(RECORD)[:-1])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                where, path = fs.FileSystem.from_uri(uri)
                with where.open_input_stream(path, compression=None) as stream:
                    held = []
                    for record in frames(stream):
                        held.append(parse_record(record))
                        if not with_payload:
                            held[-1].pop("payload")
                        if len(held) == rows:
                            yield pa.RecordBatch.from_pylist(held, schema)
                            held = []
                    yield pa.RecordBatch.from_pylist(held, schema)

    return task


def read_archives(manifest: DataFrame, payload: bool = False) -> DataFrame:
    """The records of the manifest's archives, one row each; with payload=True the payload of responses too."""
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * payload
    return manifest.select("path").repartition(max(1, manifest.count())).mapInArrow(_read(payload), schema)


def archive_pages(pages: DataFrame, **columns) -> DataFrame:
    """Write all pages to archives in the shared folder and read them back."""
    folder = f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    if "://" not in folder:
        folder = f"file://{folder}"
    return read_archives(write_archives(pages, folder, **columns))
