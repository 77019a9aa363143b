"""Sequence files as a Spark data source: FASTA, FASTQ and BAM, plain or gzipped.

``spark.read.format("seqfile").load(path)``; options: ``min_len`` (shorter sequences are dropped while parsing),
``keep_qual``, ``tags`` (two-letter names, ``CO`` for the comment of a header line; only those are kept), ``range_bytes``.
The type is told by the first byte. ``ordinal`` is the
record's place: the number of its file above the record's number or, in FASTA, first byte; so it is unique over all files
of a load, and rises with their order. Plain FASTA files are cut into byte ranges, in each of which the records that begin
there are read; other files are one task each. Files are opened through Arrow's file systems.
"""

from __future__ import annotations

import gzip
import io
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from helixmap.functions.codec import PACKED, dna_bases

SCHEMA = "file string, ordinal long, name string, len int, seq string, qual string, comment string, tags map<string,struct<type:string,value:string>>"
RANGE_BYTES = 32 << 20
#: Bits of an ordinal below the number of the file.
FILE_BITS = 40
BATCH_BASES = 4 << 20
PACKED_BASES = "".join(PACKED.get(i, "N") for i in range(16))
COMPLEMENT = str.maketrans("ACGT", "TGCA")


def open_file(path: str):
    """A readable, seekable file of any store Arrow knows, and its size."""
    from pyarrow import fs

    system, name = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))
    return system.open_input_file(name), system.get_file_info(name).size


def list_files(path: str) -> list[str]:
    """The files named by a comma-separated list of files and folders, hidden ones aside."""
    from pyarrow import fs

    out = []
    for part in filter(None, path.split(",")):
        system, name = fs.FileSystem.from_uri(part) if "://" in part else (fs.LocalFileSystem(), part.removeprefix("file:"))
        info = system.get_file_info(name)
        if info.type == fs.FileType.Directory:
            prefix = part.split("://")[0] + "://" if "://" in part else ""
            found = sorted(x.path for x in system.get_file_info(fs.FileSelector(name)) if x.type == fs.FileType.File)
            out += [prefix + f for f in found if not f.rsplit("/", 1)[-1].startswith(("_", "."))]
        elif info.type == fs.FileType.File:
            out.append(part)
        else:
            raise FileNotFoundError(part)
    return out


def sniff(head: bytes) -> str:
    """The type by the first of at most four bytes that tells it."""
    for b in head[:4]:
        if b in b">@B":
            return {">": "fasta", "@": "fastq", "B": "bam"}[chr(b)]
    raise ValueError(f"not a sequence file: it begins with {head[:4]!r}")


class Range(InputPartition):
    def __init__(self, path: str, kind: str, start: int, end: int, number: int = 0):
        self.path, self.kind, self.start, self.end, self.number = path, kind, start, end, number


class SequenceFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "seqfile"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> SequenceReader:
        return SequenceReader(dict(self.options))


def marked(line: bytes, mark: bytes) -> tuple[bytes, int]:
    """A file's first line from its mark on, where stray bytes stand before it, and their number."""
    at = max(0, line[:4].find(mark))
    return line[at:], at


def header_of(line: bytes) -> tuple[str, str]:
    """Name and comment of a header line without its mark: tabs become spaces, spaces at the end of the comment go."""
    name, _, comment = line.strip(b"\r\n").lstrip(b" ").partition(b" ")
    clean = lambda x: x.replace(b"\t", b" ").decode("utf-8", "replace")
    return clean(name).rstrip(" "), clean(comment).strip(" ")


class SequenceReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        flag = lambda k, d: str(options.get(k, d)).lower() == "true"
        self.path, self.min_len, self.keep_qual = options["path"], int(options.get("min_len", 1)), flag("keep_qual", "true")
        self.tags = {t for t in options.get("tags", "").split(",") if t}
        self.range_bytes = int(options.get("range_bytes", RANGE_BYTES))

    def partitions(self) -> list[Range]:
        out = []
        for number, path in enumerate(list_files(self.path)):
            file, size = open_file(path)
            head = file.read(4)
            packed = head[:2] == b"\x1f\x8b"
            kind = sniff(gzip.GzipFile(fileobj=self._again(file)).read(4)) if packed else sniff(head) if head else "fasta"
            if kind == "fasta" and not packed:
                out += [Range(path, kind, a, min(a + self.range_bytes, size), number) for a in range(0, size, self.range_bytes)]
            else:
                out.append(Range(path, kind, 0, -1, number))
        return out or [Range("", "", 0, 0)]

    @staticmethod
    def _again(file):
        file.seek(0)
        return file

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        file, _ = open_file(partition.path)
        magic = file.read(2)
        file.seek(0)
        stream = io.BufferedReader(gzip.GzipFile(fileobj=file) if magic == b"\x1f\x8b" else file, 1 << 20)
        if partition.kind == "bam":
            records = self.bam(stream)
        elif partition.kind == "fastq":
            records = self.fastq(stream)
        else:
            records = self.fasta(stream, partition.start, partition.end)
        rows, size = [], 0
        for ordinal, name, seq, qual, comment, tags in records:
            if len(seq) < self.min_len:
                continue
            kept = {k: v for k, v in tags.items() if k in self.tags}
            rows.append((partition.path, partition.number << FILE_BITS | ordinal, name, len(seq), seq, qual if self.keep_qual else "", comment if "CO" in self.tags and comment else None, kept))
            size += len(seq)
            if size >= BATCH_BASES:
                yield self.batch(rows)
                rows, size = [], 0
        if rows:
            yield self.batch(rows)

    @staticmethod
    def batch(rows: list[tuple]) -> pa.RecordBatch:
        tag = pa.map_(pa.string(), pa.struct([("type", pa.string()), ("value", pa.string())]))
        kinds = [pa.string(), pa.int64(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), tag]
        columns = list(zip(*rows, strict=True))
        columns[7] = [[(k, {"type": t, "value": v}) for k, (t, v) in m.items()] for m in columns[7]]
        names = ["file", "ordinal", "name", "len", "seq", "qual", "comment", "tags"]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    def fasta(self, stream, start: int, end: int) -> Iterator[tuple]:
        """Records whose mark lies in [start, end); all to the end of the file if ``end`` is negative."""
        at = start
        if start:
            stream.seek(start - 1)
            at = start if stream.read(1) == b"\n" else start + len(stream.readline())
        header, parts, begin = None, [], at
        while line := stream.readline():
            if not at:
                line, at = marked(line, b">")
            if line[:1] == b">":
                if header is not None:
                    yield begin, *self._fasta_record(header, parts)
                if 0 <= end <= at:
                    return
                header, parts, begin = line[1:], [], at
            elif header is not None:
                parts.append(line.strip(b"\r\n"))
            at += len(line)
        if header is not None:
            yield begin, *self._fasta_record(header, parts)

    @staticmethod
    def _fasta_record(header: bytes, parts: list[bytes]) -> tuple:
        name, comment = header_of(header)
        return name, dna_bases(b"".join(parts)), "", comment, {}

    @staticmethod
    def fastq(stream) -> Iterator[tuple]:
        """The quality goes on until it is as long as the sequence, so marks within it are no marks."""
        n, line = 0, marked(stream.readline(), b"@")[0]
        while line:
            if line[:1] != b"@":
                line = stream.readline()
                continue
            name, comment = header_of(line[1:])
            seq, qual = b"", b""
            while (line := stream.readline()) and line[:1] != b"+":
                seq += line.strip(b"\r\n")
            while len(qual) < len(seq) and (line := stream.readline()):
                qual += line.strip(b"\r\n")
            yield n, name, dna_bases(seq), qual.decode("latin-1"), comment, {}
            n, line = n + 1, stream.readline()

    @staticmethod
    def bam(stream) -> Iterator[tuple]:
        """Primary records; those on the reverse strand are turned back. Bases other than single ones read as N."""
        if stream.read(4) != b"BAM\1":
            raise ValueError("not a BAM file")
        (size,) = struct.unpack("<i", stream.read(4))
        stream.read(size)
        (targets,) = struct.unpack("<i", stream.read(4))
        for _ in range(targets):
            (size,) = struct.unpack("<i", stream.read(4))
            stream.read(size + 4)
        n = 0
        while len(head := stream.read(4)) == 4:
            body = stream.read(struct.unpack("<i", head)[0])
            _, _, l_name, _, _, n_cigar, flag, l_seq = struct.unpack_from("<iiBBHHHi", body)
            if flag & 0x900:
                continue
            at = 32
            name = body[at : at + l_name - 1].decode("utf-8", "replace")
            at += l_name + 4 * n_cigar
            packed = body[at : at + (l_seq + 1) // 2]
            seq = "".join(PACKED_BASES[b >> 4] + PACKED_BASES[b & 15] for b in packed)[:l_seq]
            at += len(packed)
            raw = body[at : at + l_seq]
            qual = "" if not l_seq or raw[0] == 0xFF else "".join(chr(q + 33) for q in raw)
            if flag & 0x10:
                seq, qual = seq.translate(COMPLEMENT)[::-1], qual[::-1]
            yield n, name, seq, qual, "", parse_tags(body[at + l_seq :])
            n += 1


SIZES = {"A": 1, "c": 1, "C": 1, "s": 2, "S": 2, "i": 4, "I": 4, "f": 4}
LETTERS = {"c": "b", "C": "B", "s": "h", "S": "H", "i": "i", "I": "I", "f": "f"}


def parse_tags(data: bytes) -> dict[str, tuple[str, str]]:
    """Tags as name to (printed type, text); whole numbers print as type i, arrays as type B with their element type first."""
    out, at = {}, 0
    while at + 3 <= len(data):
        name, kind = data[at : at + 2].decode(), chr(data[at + 2])
        at += 3
        if kind in "ZH":
            end = data.index(b"\0", at)
            out[name] = (kind, data[at:end].decode("utf-8", "replace"))
            at = end + 1
        elif kind == "B":
            item, n = chr(data[at]), struct.unpack_from("<I", data, at + 1)[0]
            values = struct.unpack_from(f"<{n}{LETTERS[item]}", data, at + 5)
            out[name] = ("B", ",".join([item, *(f"{v:g}" if item == "f" else str(v) for v in values)]))
            at += 5 + n * SIZES[item]
        elif kind == "A":
            out[name] = ("A", chr(data[at]))
            at += 1
        else:
            (value,) = struct.unpack_from("<" + LETTERS[kind], data, at)
            out[name] = ("f", f"{value:g}") if kind == "f" else ("i", str(value))
            at += SIZES[kind]
    return out


def read_sequences(spark: SparkSession, path: str, **options: object) -> DataFrame:
    """The records of sequence files; an empty file or folder has none."""
    spark.dataSource.register(SequenceFiles)
    reader = spark.read.format("seqfile")
    for k, v in options.items():
        reader = reader.option(k, ",".join(v) if isinstance(v, (list, tuple)) else str(v).lower() if isinstance(v, bool) else str(v))
    return reader.load(path)
