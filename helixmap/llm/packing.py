"""Packing tokenized documents into windows by minimum bin slack.

A document is cut into full windows and one remainder. Full windows stand alone; the remainders are packed: the
histogram of remainder lengths (at most ``capacity - 1`` numbers, whatever the corpus) goes to the driver, where for
each window the longest length left is joined by the multiset of lengths that fills the window closest to capacity.
A bitset subset-sum dynamic program finds that multiset; it is backtracked to counts and applied to as many windows
as the histogram allows at once, so the work depends on the number of distinct lengths and not on the documents.
Pieces find their place by their rank among the pieces of the same length, which is computed in salted blocks.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixmap.llm.common import cut, tidy, whole_text
from helixmap.llm.tokens import VOCABULARY, token_ids

CAPACITY = 2048
END_ID = 1
#: Pieces of a length that are ranked together.
BLOCK_PIECES = 1_000

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def pieces(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY, folder: str | None = None) -> DataFrame:
    """Cuts each document's ids, and the end id after them, into pieces of ``capacity`` and a remainder.

    ``docs`` has doc_id and text; other columns are ignored. A null or empty text is the end id alone. Rows that
    repeat a doc_id are documents of their own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc_ids, starts, lengths, crcs, totals = [], [], [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.append(token_ids(text.as_py(), vocabulary, folder), np.uint32(END_ID)).astype("<u4")
                for start in range(0, len(ids), capacity):
                    part = ids[start : start + capacity]
                    doc_ids.append(doc_id)
                    starts.append(start)
                    lengths.append(len(part))
                    crcs.append(zlib.crc32(part.tobytes()))
                    totals.append(len(ids))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (doc_ids, starts, lengths, crcs, totals)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")).mapInArrow(tidy(run), PIECES)


def fill(counts: dict[int, int], room: int) -> list[tuple[int, int]]:
    """The multiset of lengths, as (length, times), whose sum comes closest to ``room`` without exceeding it.

    Bit s of ``reach`` tells that sum s can be made. Lengths enter from the longest down, each in powers of two of its
    count; the walk back over the kept bitsets gives the counts.
    """
    mask = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for length in sorted((x for x, c in counts.items() if c and x <= room), reverse=True):
        left, take = min(counts[length], room // length), 1
        while left:
            take = min(take, left)
            steps.append((length, take, reach))
            reach |= (reach << (length * take)) & mask
            left -= take
            take *= 2
        if reach >> room & 1:
            break
    at, used = reach.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> at & 1:
            used[length] = used.get(length, 0) + take
            at -= length * take
    return sorted(used.items(), reverse=True)


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Where the pieces of each length go: (length, rank from, rank to, pieces a window, first window, offset).

    The pieces of a length with ranks in [from, to) lie, so many to each window, in consecutive windows, from that
    offset on. The list is bounded by the number of distinct lengths times the doublings of a count.
    """
    left = {k: v for k, v in histogram.items() if v > 0}
    taken = dict.fromkeys(left, 0)
    out, window = [], 0
    while left:
        longest = max(left)
        rest = dict(left)
        rest[longest] -= 1
        chosen = dict(fill(rest, capacity - longest))
        chosen[longest] = chosen.get(longest, 0) + 1
        times = min(left[k] // n for k, n in chosen.items())
        offset = 0
        for length in sorted(chosen, reverse=True):
            n = chosen[length]
            out.append((length, taken[length], taken[length] + n * times, n, window, offset))
            taken[length] += n * times
            offset += n * length
            left[length] -= n * times
            if not left[length]:
                del left[length]
        window += times
    return out


def place(cuts: DataFrame, capacity: int = CAPACITY, block_pieces: int = BLOCK_PIECES) -> DataFrame:
    """Adds sequence_id and offset to pieces; ``cuts`` should be a written table, as it is read three times."""
    histogram = {r["length"]: r["n"] for r in cuts.groupBy("length").agg(F.count("*").alias("n")).collect()}
    blocks = max(1, math.ceil(max(histogram.values(), default=0) / block_pieces))
    rows = sorted(plan(histogram, capacity))
    lengths = np.array([r[0] for r in rows], np.int64)
    table = np.array([r[1:] for r in rows], np.int64).reshape(-1, 5)

    block = F.pmod(F.xxhash64("doc_id", "start"), F.lit(blocks)).cast("int")
    dealt = cuts.withColumn("block", block)
    sums = dealt.groupBy("length", "block").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select("length", "block", F.coalesce(before, F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("length", "block").orderBy("doc_id", "start", "ids_crc32"))
    ranked = dealt.withColumn("rank", within - 1).join(sums, ["length", "block"]).withColumn("rank", F.col("rank") + F.col("before"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = {int(k): int(np.searchsorted(lengths, k)) for k in np.unique(lengths)}
        last = {int(k): int(np.searchsorted(lengths, k, "right")) for k in np.unique(lengths)}
        for batch in batches:
            length, rank = (batch.column(i).to_numpy() for i in (2, 5))
            row = np.empty(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            edges = np.flatnonzero(np.diff(length[order], prepend=-1, append=-1))
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                own, k = order[a:b], int(length[order[a]])
                lo, hi = first[k], last[k]
                row[own] = lo + np.searchsorted(table[lo:hi, 0], rank[own], "right") - 1
            since, each = rank - table[row, 0], table[row, 2]
            sequence, offset = table[row, 3] + since // each, table[row, 4] + since % each * length
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], [*batch.schema.names[:5], "sequence_id", "offset"])

    return ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", F.col("rank").cast("long").alias("rank")).mapInArrow(tidy(run), f"{PIECES}, sequence_id long, offset long")


def pack(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY, folder: str | None = None) -> DataFrame:
    """One row for each piece: its document, span, checksum, sequence and offset there.

    Every id of every document lies in exactly one piece. An empty table gives no pieces; repeated rows are packed as
    often as they occur; extra columns are ignored. Tokenizing runs once: the narrow table of pieces is checkpointed.
    """
    return place(cut(pieces(docs, capacity, vocabulary, folder)), capacity)
