"""(w, k)-minimizers.

The key of a k-mer is (hash, strand, position modulo w); of each window of the last w k-mers the least key is taken, and
a k-mer is emitted when it becomes a window's least or is the newest of its window. The kernel works on all sequences
of an Arrow batch at once, w shifted minima over one array, so a sketch is a narrow map without any shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixmap.functions.codec import codes_of

NONE = np.iinfo(np.int64).max


@lru_cache(maxsize=1)
def _castagnoli() -> np.ndarray:
    """The byte table of the reflected polynomial 0x82F63B78."""
    t = np.arange(256, dtype=np.uint64)
    for _ in range(8):
        t = np.where(t & np.uint64(1), (t >> np.uint64(1)) ^ np.uint64(0x82F63B78), t >> np.uint64(1))
    return t


def mixed(low: np.ndarray, high: np.ndarray, k: int) -> np.ndarray:
    """The hash of k-mers from the lesser and the greater of both strands' values.

    A checksum of the greater one, begun with its own low half, is mixed into the lesser; up to k = 16 it vanishes, so
    the hash is the canonical k-mer itself.
    """
    if k <= 16:
        return low
    table, crc = _castagnoli(), high.astype(np.uint64) & np.uint64(0xFFFFFFFF)
    for i in range(8):
        byte = (high.astype(np.uint64) >> np.uint64(8 * i)) & np.uint64(255)
        crc = table[(crc ^ byte) & np.uint64(255)] ^ (crc >> np.uint64(8))
    return ((crc ^ low.astype(np.uint64)) & np.uint64((1 << (2 * k)) - 1)).astype(np.int64)


def scattered(hashes: np.ndarray, k: int) -> np.ndarray:
    """A bijection of hashes within 2k bits, for sequences with runs of one base."""
    mask = np.uint64((1 << (2 * k)) - 1)
    x = hashes.astype(np.uint64)
    half = np.uint64(k)
    for m in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9):
        x = (x * np.uint64(m)) & mask
        x ^= x >> half
    return x.astype(np.int64)


def kmers(codes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values of the k-mers at each position, forward and reverse complement, and whether they are free of N.

    Values of 2, 4, 8 and 16 bases are made of two of half the length, and k of those by its binary digits.
    """
    n = len(codes) - k + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)
    f, r, bad = (codes & 3).astype(np.int64), (3 - (codes & 3)).astype(np.int64), codes > 3
    fw, rv, wrong, at, size = None, None, None, 0, 1
    while True:
        if k & size:  # the part of this size follows those of smaller sizes
            own = slice(at, at + n)
            if fw is None:
                fw, rv, wrong = f[own].copy(), r[own].copy(), bad[own].copy()
            else:
                fw = (fw << (2 * size)) | f[own]
                rv = rv | (r[own] << (2 * at))
                wrong |= bad[own]
            at += size
        if 2 * size > k:
            return fw, rv, ~wrong
        f, r, bad = (f[:-size] << (2 * size)) | f[size:], r[:-size] | (r[size:] << (2 * size)), bad[:-size] | bad[size:]
        size *= 2


def minimizers(sequences: list[np.ndarray], k: int, w: int, circular: list[bool] | None = None, mixing: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sequence number, hash, position and strand bit of the minimizers of all ``sequences``, in order.

    A circular sequence goes on with its first min(length, w) bases; positions there count on past the end. Sequences
    lie one after the other with a gap of N between them, which no k-mer crosses and in which every window ends.
    """
    rings = circular is not None and any(circular)
    whole = [np.concatenate([s, s[: min(len(s), w)]]) if c else s for s, c in zip(sequences, circular, strict=True)] if rings else sequences
    sizes = np.array([len(s) for s in whole], np.int64)
    empty = np.empty(0, np.int64)
    if not sizes.sum():
        return empty, empty, empty, empty
    gap = np.full(w + k, 4, np.uint8)
    fw, rv, good = kmers(np.concatenate([x for s in whole for x in (s, gap)]), k)
    spans = sizes + len(gap)
    owner = np.repeat(np.arange(len(whole), dtype=np.int32), spans)[: len(fw)]
    begins = np.cumsum(spans) - spans
    pos = np.arange(len(fw)) - begins[owner]
    h = mixed(np.minimum(fw, rv), np.maximum(fw, rv), k)
    if mixing:
        h = scattered(h, k)
    strand = (fw >= rv).astype(np.int64)
    if rings:
        turn = np.array([len(s) for s in sequences], np.int64)[owner] - k + 1
        local = np.where(pos >= turn, pos - turn, pos) % w
    else:
        local = pos % w
    # rank by hash first, then strand, then local index, which take six bits: longer hashes are ranked before
    rank = h if 2 * k + 6 <= 62 else np.unique(np.where(good, h, NONE), return_inverse=True)[1].astype(np.int64)
    key = np.where(good, (rank << 6) | (strand << 5) | local, NONE)
    if rings:
        least, where = _window(key, pos, w)
        newest = where == np.arange(len(key))
    else:
        least = _least(key, w)
        newest = key == least
    before = np.concatenate([[NONE], least[:-1]])
    inside = pos + k <= sizes[owner]
    emit = np.flatnonzero(inside & (least != NONE) & ((least != before) | newest))
    if rings:
        chosen = where[emit]
    else:
        chosen = emit - (pos[emit] - (least[emit] & 31)) % w  # the local index tells how far back the least one lies
    chosen = np.unique(chosen)
    return owner[chosen].astype(np.int64), h[chosen], pos[chosen], strand[chosen]


def _least(key: np.ndarray, w: int) -> np.ndarray:
    """The least of the last w keys, by minima over doubled widths."""
    out, width = key.copy(), 1
    while width < w:
        step = min(width, w - width)
        out[step:] = np.minimum(out[step:], out[:-step].copy())
        width += step
    return out


def _window(key: np.ndarray, pos: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray]:
    """The least key of the last w of the same sequence, and where it is."""
    least, where = key.copy(), np.arange(len(key))
    for j in range(1, w):
        if j >= len(key):
            break
        other = np.where(pos[j:] >= j, key[:-j], NONE)
        better = other < least[j:]
        least[j:] = np.where(better, other, least[j:])
        where[j:] = np.where(better, np.arange(len(key) - j), where[j:])
    return least, where


#: Bases that are sketched at once, and of a part of a longer sequence.
BLOCK_BASES = 1 << 17
PART_BASES = 1 << 20


def parts_of(seq: str, w: int, k: int, size: int) -> Iterator[tuple[int, int, int, str]]:
    """Overlapping parts of a sequence: first position, the range of positions that are the part's own, and its bases.

    A position's choice depends on the windows that it is in and the one before them, so a part goes on for a window and a
    k-mer behind its range, and begins two windows before it, at a multiple of the window as local indexes need it.
    """
    step = max(1, size // w) * w
    for low in range(0, len(seq), step):
        begin = max(0, low - 2 * w)
        yield begin, low, low + step, seq[begin : low + step + w + k]


def sketch(df: DataFrame, id_name: str, k: int, w: int, seq: str = "seq", circular: str | None = None, mixing: bool = False, part_bases: int = PART_BASES) -> DataFrame:
    """(id, hash, pos, strand) of the minimizers of each row's sequence of base characters.

    Null sequences and those shorter than k have none; k-mers with N are left out. Long sequences, unless they are
    circular, are worked on in parts, so memory is bounded by a part and the sequence itself.
    """
    id_type = dict(df.dtypes)[id_name]
    schema = f"`{id_name}` {id_type}, hash long, pos int, strand int"

    def long(id_: pa.Array, seq: str) -> Iterator[pa.RecordBatch]:
        for begin, low, high, part in parts_of(seq, w, k, part_bases):
            _, h, pos, strand = minimizers([codes_of(part)], k, w, None, mixing)
            pos += begin
            own = (pos >= low) & (pos < high)
            yield pa.RecordBatch.from_arrays([id_.take(pa.array(np.zeros(int(own.sum()), np.int64))), pa.array(h[own]), pa.array(pos[own], pa.int32()), pa.array(strand[own], pa.int32())], [id_name, "hash", "pos", "strand"])

    def block(ids: pa.Array, seqs: list, flags: list) -> pa.RecordBatch:
        owner, h, pos, strand = minimizers([codes_of(s or "") for s in seqs], k, w, flags, mixing)
        return pa.RecordBatch.from_arrays([ids.take(pa.array(owner)), pa.array(h), pa.array(pos, pa.int32()), pa.array(strand, pa.int32())], [id_name, "hash", "pos", "strand"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seqs, flags = batch.column(1).to_pylist(), [bool(x) for x in batch.column(2).to_pylist()]
            start, size = 0, 0
            for i, s in enumerate(seqs):
                if s and len(s) > part_bases and not flags[i]:
                    if start < i:
                        yield block(batch.column(0).slice(start, i - start), seqs[start:i], flags[start:i])
                    yield from long(batch.column(0).slice(i, 1), s)
                    start, size = i + 1, 0
                    continue
                size += len(s or "")
                if size >= BLOCK_BASES:
                    yield block(batch.column(0).slice(start, i + 1 - start), seqs[start : i + 1], flags[start : i + 1])
                    start, size = i + 1, 0
            if start < len(seqs):
                yield block(batch.column(0).slice(start), seqs[start:], flags[start:])

    flag = F.lit(False) if circular is None else F.col(circular)
    return df.select(id_name, seq, flag).mapInArrow(run, schema)


def all_kmers(df: DataFrame, id_name: str, k: int, seq: str = "seq") -> DataFrame:
    """(id, pos, fw, rv, hash, strand) of every N-free k-mer."""
    id_type = dict(df.dtypes)[id_name]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seqs = [codes_of(s or "") for s in batch.column(1).to_pylist()]
            sizes = np.array([len(s) for s in seqs], np.int64)
            if not len(sizes) or not sizes.sum():
                continue
            fw, rv, good = kmers(np.concatenate(seqs), k)
            owner = np.repeat(np.arange(len(seqs)), sizes)[: len(fw)]
            pos = np.arange(len(fw)) - (np.cumsum(sizes) - sizes)[owner]
            at = np.flatnonzero(good & (pos + k <= sizes[owner]))
            fw, rv = fw[at], rv[at]
            h = mixed(np.minimum(fw, rv), np.maximum(fw, rv), k)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner[at])), pa.array(pos[at], pa.int32()), pa.array(fw), pa.array(rv), pa.array(h), pa.array((fw >= rv).astype(np.int32))], [id_name, "pos", "fw", "rv", "hash", "strand"])

    return df.select(id_name, seq).mapInArrow(run, f"`{id_name}` {id_type}, pos int, fw long, rv long, hash long, strand int")
