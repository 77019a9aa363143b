"""Media columns: payloads in archives, read back by a Python data source that plans byte ranges.

``write_media`` stores each payload as an 8-bit greyscale PNG, 64 samples a row, in ZIP archives in the shared folder;
a manifest, written when all tasks have ended, names the archives of the attempts that succeeded. The data source
``media_archive`` cuts every archive of the manifest into byte ranges; a task opens one range, takes the members whose
headers start in it from the archive's directory and streams them in Arrow batches. A member that can't be read or
fails its checksum is read again from its own offset, through a newly opened file, without touching the others.
"""

from __future__ import annotations

import hashlib
import json
import struct
import time
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from helixmap.llm.common import shared_folder, tidy, whole_text

WIDTH = 64
ARCHIVE_BYTES = 64 << 20
RANGE_BYTES = 8 << 20
BATCH_BYTES = 2 << 20
ATTEMPTS = 4
MANIFEST = "_manifest.json"
PNG_HEAD = b"\x89PNG\r\n\x1a\n"


def payload_of(text: bytes) -> bytes:
    """The bytes, with zeros up to a positive multiple of ``WIDTH``."""
    return text.ljust(max(WIDTH, -(-len(text) // WIDTH) * WIDTH), b"\0")


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode_png(payload: bytes, n_bytes: int) -> bytes:
    """A greyscale picture whose samples are the payload; the length without padding goes into a text chunk."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)  # each line begins with its filter type, 0
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return PNG_HEAD + _chunk(b"IHDR", head) + _chunk(b"tEXt", b"n_bytes\0%d" % n_bytes) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 1)) + _chunk(b"IEND", b"")


def decode_png(data: bytes) -> tuple[bytes, int]:
    """The samples and the length without padding; ValueError if a chunk is damaged."""
    if data[:8] != PNG_HEAD:
        raise ValueError("not a PNG")
    at, width, n_bytes, packed = 8, 0, -1, []
    while at < len(data):
        (size,) = struct.unpack_from(">I", data, at)
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + size]
        if struct.unpack_from(">I", data, at + 8 + size)[0] != zlib.crc32(kind + body):
            raise ValueError(f"damaged chunk {kind!r}")
        if kind == b"IHDR":
            (width,) = struct.unpack_from(">I", body)
        elif kind == b"tEXt" and body.startswith(b"n_bytes\0"):
            n_bytes = int(body[8:])
        elif kind == b"IDAT":
            packed.append(body)
        at += size + 12
    lines = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(-1, width + 1)
    return lines[:, 1:].tobytes(), n_bytes


def feature_of(payload: bytes) -> str:
    """Size, mean, deviation and entropy of the samples, and a 64-bit average hash of an 8 x 8 reduction."""
    x = np.frombuffer(payload, np.uint8)
    share = np.bincount(x, minlength=256) / len(x)
    share = share[share > 0]
    entropy = max(0.0, float(-(share * np.log2(share)).sum()))
    rows = x.reshape(-1, WIDTH)
    edges = np.linspace(0, len(rows), 9).astype(int)
    cells = np.array([rows[a : max(b, a + 1)].reshape(-1, 8, WIDTH // 8).mean(axis=(0, 2)) if a < len(rows) else np.zeros(8) for a, b in zip(edges[:-1], edges[1:], strict=True)]).ravel()
    bits = "".join("1" if c > cells.mean() else "0" for c in cells)
    return f"{WIDTH}x{len(rows)} mean={x.mean():.4f} std={x.std():.4f} entropy={entropy:.4f} ahash={int(bits, 2):016x}"


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri.removeprefix("file:"))


def write_media(docs: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> int:
    """Stores the payload of every row's whole text in archives below ``folder``; returns the number of members.

    ``docs`` has doc_id (may be null or repeat) and text (null: empty); other columns are ignored. Every row is a member.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _filesystem(folder)
        fs.create_dir(root, recursive=True)
        archive = out = name = None
        members = 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if archive is None:
                    name = f"part-{uuid.uuid4().hex}.zip"
                    out = fs.open_output_stream(f"{root}/{name}")
                    archive, members = zipfile.ZipFile(out, "w", zipfile.ZIP_STORED), 0
                raw = text.as_py().encode()
                info = zipfile.ZipInfo(f"{members:08d}.png")
                info.comment = b"" if doc_id is None else b"%d" % doc_id
                archive.writestr(info, encode_png(payload_of(raw), len(raw)))
                members += 1
                if out.tell() >= archive_bytes:
                    archive.close()
                    out.close()
                    archive = None
                    yield pa.RecordBatch.from_pydict({"name": [name], "members": [members]})
        if archive is not None:
            archive.close()
            out.close()
            yield pa.RecordBatch.from_pydict({"name": [name], "members": [members]})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    done = rows.mapInArrow(tidy(run), "name string, members long").collect()
    fs, root = _filesystem(folder)
    fs.create_dir(root, recursive=True)
    with fs.open_output_stream(f"{root}/{MANIFEST}") as f:
        f.write(json.dumps(sorted(r["name"] for r in done)).encode())
    return sum(r["members"] for r in done)


class ByteRange(InputPartition):
    """The members of one archive whose headers start in [start, end)."""

    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


class MediaArchive(DataSource):
    """``spark.read.format("media_archive").load(folder)``: a row for each member of the archives in the folder.

    Options: ``range_bytes`` (how long a planned range is), ``attempts`` (reads of a member before the task fails).
    """

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return "archive string, member string, offset long, doc_id long, media binary"

    def reader(self, schema) -> MediaReader:
        return MediaReader(self.options["path"], int(self.options.get("range_bytes", RANGE_BYTES)), int(self.options.get("attempts", ATTEMPTS)))


class MediaReader(DataSourceReader):
    def __init__(self, folder: str, range_bytes: int, attempts: int):
        self.folder, self.range_bytes, self.attempts = folder, range_bytes, attempts

    def partitions(self) -> list[ByteRange]:
        from pyarrow.fs import FileSelector, FileType

        fs, root = _filesystem(self.folder)
        found = [x for x in fs.get_file_info(FileSelector(root, allow_not_found=True)) if x.type == FileType.File]
        if any(x.base_name == MANIFEST for x in found):
            with fs.open_input_stream(f"{root}/{MANIFEST}") as f:
                named = set(json.loads(f.read()))
            if missing := named - {x.base_name for x in found}:
                raise FileNotFoundError(f"archives of the manifest are missing: {sorted(missing)[:3]}")
            found = [x for x in found if x.base_name in named]
        else:
            found = [x for x in found if x.extension == "zip"]
        ranges = [ByteRange(x.path, a, a + self.range_bytes) for x in sorted(found, key=lambda x: x.path) for a in range(0, x.size, self.range_bytes)]
        return ranges or [ByteRange("", 0, 0)]

    def read_member(self, open_file, info: zipfile.ZipInfo, file):
        """The bytes of one member, and the file they came from; a failed read starts again at the member's offset."""
        for attempt in range(self.attempts):
            try:
                file = file or open_file()
                file.seek(info.header_offset)
                head = file.read(30)
                if head[:4] != b"PK\x03\x04":
                    raise ValueError("no member header")
                name, extra = struct.unpack("<HH", head[26:30])
                file.seek(info.header_offset + 30 + name + extra)
                data = file.read(info.compress_size)
                if info.compress_type == zipfile.ZIP_DEFLATED:
                    data = zlib.decompress(data, -15)
                if len(data) != info.file_size or zlib.crc32(data) != info.CRC:
                    raise ValueError("checksum differs")
                return data, file
            except (OSError, ValueError, zlib.error, struct.error):
                if attempt + 1 == self.attempts:
                    raise
                file = None
                time.sleep(0.05 * 2**attempt)

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        fs, _ = _filesystem(self.folder)
        open_file = lambda: fs.open_input_file(partition.path)
        file = open_file()
        with zipfile.ZipFile(file) as directory:
            infos = sorted((i for i in directory.infolist() if partition.start <= i.header_offset < partition.end), key=lambda i: i.header_offset)
        file, rows, size = None, [], 0
        for info in infos:
            data, file = self.read_member(open_file, info, file)
            rows.append((partition.path, info.filename, info.header_offset, int(info.comment) if info.comment else None, data))
            size += len(data)
            if size >= BATCH_BYTES:
                yield self.batch(rows)
                rows, size = [], 0
        if rows:
            yield self.batch(rows)

    @staticmethod
    def batch(rows: list[tuple]) -> pa.RecordBatch:
        archive, member, offset, doc_id, media = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays(
            [pa.array(archive, pa.string()), pa.array(member, pa.string()), pa.array(offset, pa.int64()), pa.array(doc_id, pa.int64()), pa.array(media, pa.binary())],
            ["archive", "member", "offset", "doc_id", "media"],
        )


def read_media(spark: SparkSession, folder: str) -> DataFrame:
    """The members of the archives in ``folder``; an empty folder gives no rows."""
    spark.dataSource.register(MediaArchive)
    return spark.read.format("media_archive").load(folder)


DIGESTS = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def digests(media: DataFrame) -> DataFrame:
    """Decodes each member and describes payload and stored form; equal payloads give equal values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = data.as_py()
                payload, n_bytes = decode_png(data)
                rows.append((doc_id, n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data), hashlib.sha256(data).hexdigest(), feature_of(payload)))
            if rows:
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in DIGESTS.split(", ")])

    return media.select("doc_id", "media").mapInArrow(tidy(run), DIGESTS)


def store_and_describe(docs: DataFrame) -> DataFrame:
    """Writes every text as a media member, reads all members back and describes them. Empty table: no rows."""
    spark = docs.sparkSession
    folder = shared_folder(spark, "media")
    write_media(docs, folder)
    return digests(read_media(spark, folder))
