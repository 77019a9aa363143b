"""Scoring texts by a bigram model with deleted interpolation.

P(w | u) = a(u) c(u, w) / c(u) + b(u) c(w) / N + d(u) / (V + 1), where the weights a, b, d depend on the bucket of c(u)
(its power of two) and are learned by expectation-maximisation on held-out counts: one tenth of the training
documents is set aside, the counts of the others give the estimates, and the weights that make the set-aside tokens
likeliest are kept; the final estimates use the counts of all training documents.

Documents are dealt into chunks by a hash. A chunk sends each distinct word and word pair it has once, as a sorted run
of 63-bit hashes with the chunk's own counts, to the part of the hash range it falls in; there the runs of all chunks
are merged and summed, and each chunk gets back the corpus counts in the order of the keys it sent. So what moves is a
key for each distinct pair of a chunk, never one for each token, and no key is hotter than the number of chunks.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixmap.llm.common import cut, tidy, whole_text

CHUNK_BYTES = 10 << 20
#: Chunks whose number this divides hold the documents that are set aside for the weights.
SET_ASIDE = 10
ROUNDS = 100
#: Bins of an octave in which ratios of estimates are summed for expectation-maximisation.
BINS = 4
KEEP_WORDS = 150_000
STEP = 0x9E3779B97F4A7C15
END = xxhash.xxh3_64_intdigest(b"\n")  # no word has a line end in it
ONE = np.uint64(1)


def mix64(x: np.ndarray) -> np.ndarray:
    """Spreads every bit of 64-bit numbers (the splitmix64 finalizer)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words_of(text: str) -> list[bytes]:
    """Runs of characters other than U+0020 and U+0009 to U+000D, with A to Z in lower case."""
    return text.encode().lower().split()


class Chunk:
    """The tokens of some documents: words, then one end each; keys of the tokens and of the pairs with the token before."""

    def __init__(self, texts: list[str]):
        kept: dict[bytes, int] = {}
        parts, self.sizes = [], np.zeros(len(texts), np.int64)
        end = np.array([END], np.uint64)
        for i, text in enumerate(texts):
            words = words_of(text)
            if len(kept) > KEEP_WORDS:
                kept.clear()
            try:
                ids = np.fromiter(map(kept.__getitem__, words), np.uint64, len(words))
            except KeyError:
                for w in set(words).difference(kept):
                    kept[w] = xxhash.xxh3_64_intdigest(w)
                ids = np.fromiter(map(kept.__getitem__, words), np.uint64, len(words))
            parts += [ids, end]
            self.sizes[i] = len(words) + 1
        own = np.concatenate(parts) if parts else np.empty(0, np.uint64)
        self.last = np.cumsum(self.sizes) - 1
        before = np.empty_like(own)
        before[1:] = own[:-1]
        before[self.last - self.sizes + 1] = END
        self.keys = [mix64(own) >> ONE, mix64(mix64(before + np.uint64(STEP)) * np.uint64(STEP) + own) >> ONE]

    def by_token(self, by_doc: np.ndarray) -> np.ndarray:
        return np.repeat(by_doc, self.sizes)


def distinct(keys: np.ndarray, train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and how many training tokens each has."""
    marked = np.sort((keys << ONE) | train.astype(np.uint64))
    keys = marked >> ONE
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    counts = np.add.reduceat((marked & ONE).astype(np.int64), at) if len(at) else at
    return keys[at], counts


def places(keys: np.ndarray) -> np.ndarray:
    """The index of each key among the sorted distinct keys."""
    order = np.argsort(keys)
    sorted_ = keys[order]
    new = np.concatenate([[False], sorted_[1:] != sorted_[:-1]]) if len(keys) else np.empty(0, bool)
    out = np.empty(len(keys), np.int64)
    out[order] = np.cumsum(new)
    return out


def pack(values: np.ndarray) -> bytes:
    """64-bit numbers by byte planes, so that high zero bytes vanish in compression."""
    return zlib.compress(np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def unpack(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(data), np.uint8).reshape(8, -1).T).view("<u8").ravel()


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted keys as differences, byte planes of which only the low ones are sent."""
    gaps = np.diff(keys, prepend=np.uint64(0))
    planes = np.ascontiguousarray(gaps.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    used = 8 - int(np.argmax(planes[::-1].any(axis=1))) if planes.any() else 1
    return bytes([used]) + planes[:used].tobytes()


def unpack_keys(data: bytes) -> np.ndarray:
    used = data[0]
    n = (len(data) - 1) // used
    planes = np.zeros((n, 8), np.uint8)
    planes[:, :used] = np.frombuffer(data, np.uint8, used * n, 1).reshape(used, n).T
    return np.cumsum(planes.view("<u8").ravel(), dtype=np.uint64)


REQUESTS = "target long, kind int, chunk long, keys binary, train binary"
REPLIES = "chunk long, kind int, target long, train binary, aside binary, n_distinct long, n_train long, n_aside long"


def requests(chunked: DataFrame, n_targets: int) -> DataFrame:
    """For each chunk, kind (0 words, 1 pairs) and part of the hash range the distinct keys and the chunk's counts."""

    def run(table: pa.Table) -> pa.Table:
        chunk = Chunk(table.column("text").to_pylist())
        train = chunk.by_token(table.column("train").to_numpy())
        rows = []
        for kind in (0, 1):
            keys, counts = distinct(chunk.keys[kind], train)
            target = ((keys >> np.uint64(31)) * np.uint64(n_targets)) >> np.uint64(32)
            edges = np.flatnonzero(np.diff(target.astype(np.int64), prepend=-1, append=n_targets))
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                rows.append((int(target[a]), kind, table.column("chunk")[0].as_py(), pack_keys(keys[a:b]), pack(counts[a:b])))
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
        return pa.table([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in REQUESTS.split(", ")])

    return chunked.groupBy("chunk").applyInArrow(tidy(run), REQUESTS)


def replies(asked: DataFrame) -> DataFrame:
    """The corpus counts of the keys each chunk sent, in their order; and of each part the totals, on its first row."""

    def run(table: pa.Table) -> pa.Table:
        chunks = table.column("chunk").to_numpy()
        keys = [unpack_keys(x.as_py()) for x in table.column("keys")]
        train = np.concatenate([unpack(x.as_py()) for x in table.column("train")]).astype(np.int64)
        ends = np.cumsum([len(k) for k in keys])
        aside = np.where(np.repeat(chunks % SET_ASIDE == 0, [len(k) for k in keys]), train, 0)
        at = places(np.concatenate(keys))
        n = int(at.max()) + 1
        sums = np.zeros((2, n), np.int64)
        np.add.at(sums[0], at, train)
        np.add.at(sums[1], at, aside)
        rows = []
        for i, (chunk, end) in enumerate(zip(chunks, ends, strict=True)):
            own = at[end - len(keys[i]) : end]
            totals = (int((sums[0] > 0).sum()), int(sums[0].sum()), int(sums[1].sum())) if i == 0 else (0, 0, 0)
            rows.append((int(chunk), table.column("kind")[0].as_py(), table.column("target")[0].as_py(), pack(sums[0][own]), pack(sums[1][own]) if chunk % SET_ASIDE == 0 else None, *totals))
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
        return pa.table([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in REPLIES.split(", ")])

    return asked.groupBy("kind", "target").applyInArrow(tidy(run), REPLIES)


def _counts(reply: pa.Table, column: str) -> list[np.ndarray]:
    """Counts by kind in the order of the chunk's distinct keys."""
    out = []
    for kind in (0, 1):
        rows = sorted((t, i) for i, (t, k) in enumerate(zip(reply.column("target").to_pylist(), reply.column("kind").to_pylist(), strict=True)) if k == kind)
        out.append(np.concatenate([unpack(reply.column(column)[i].as_py()) for _, i in rows]).astype(np.float64))
    return out


def token_counts(chunk: Chunk, by_key: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """c(w), c(u, w) and c(u) of every token."""
    own, pair = (c[places(k)] for c, k in zip(by_key, chunk.keys, strict=True))
    before = np.empty_like(own)
    before[1:] = own[:-1]
    before[chunk.last - chunk.sizes + 1] = own[chunk.last]  # each document begins after an end
    return own, pair, before


def bucket(before: np.ndarray) -> np.ndarray:
    """0 for contexts that were never seen, else 1 + the whole part of the logarithm of their count to base 2."""
    return np.where(before > 0, np.frexp(np.maximum(before, 1))[1], 0)


def estimates(own: np.ndarray, pair: np.ndarray, before: np.ndarray, n: float, v: float) -> tuple[np.ndarray, np.ndarray, float]:
    """The estimates of order two, one and zero."""
    return pair / np.maximum(before, 1), own / max(n, 1), 1.0 / (v + 1)


HISTOGRAM = "bucket int, pairs int, words int, n long"
NONE = -100_000


def histogram(chunked: DataFrame, answers: DataFrame, n: float, v: float) -> DataFrame:
    """How many set-aside tokens have which bucket and which ratios of the estimates to that of order zero."""

    def level(x: np.ndarray) -> np.ndarray:
        return np.where(x > 0, np.rint(np.log2(np.where(x > 0, x, 1)) * BINS), NONE).astype(np.int64)

    def run(table: pa.Table, reply: pa.Table) -> pa.Table:
        chunk = Chunk(table.column("text").to_pylist())
        train = chunk.by_token(table.column("train").to_numpy()).astype(bool)
        total, aside = _counts(reply, "train"), _counts(reply, "aside")
        own, pair, before = token_counts(chunk, [a - b for a, b in zip(total, aside, strict=True)])
        two, one, zero = estimates(own, pair, before, n, v)
        rows, counts = np.unique(np.stack([bucket(before), level(two / zero), level(one / zero)])[:, train], axis=1, return_counts=True)
        return pa.table([pa.array(rows[0], pa.int32()), pa.array(rows[1], pa.int32()), pa.array(rows[2], pa.int32()), pa.array(counts, pa.int64())], ["bucket", "pairs", "words", "n"])

    return chunked.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(tidy(run), HISTOGRAM)


def maximise(rows: list[tuple[int, int, int, int]], rounds: int = ROUNDS) -> dict[int, tuple[float, float, float]]:
    """The weights of orders two, one and zero by bucket, by expectation-maximisation on the histogram.

    Half a token each is added to the expected counts, so no weight of a context that was seen is zero. A bucket
    without set-aside tokens takes the weights of the nearest one that has some.
    """
    data = np.array(rows, np.float64).reshape(-1, 4)
    ratio = lambda x: np.where(x > NONE, 2.0 ** (x / BINS), 0.0)
    found = {}
    for b in np.unique(data[:, 0]).astype(int):
        own = data[data[:, 0] == b]
        parts = np.stack([ratio(own[:, 1]), ratio(own[:, 2]), np.ones(len(own))])
        weight = np.full(3, 1 / 3)
        for _ in range(rounds):
            share = weight[:, None] * parts
            share /= share.sum(axis=0)
            weight = (share * own[:, 3]).sum(axis=1) + 0.5
            weight /= weight.sum()
        found[int(b)] = tuple(float(x) for x in weight)
    found = found or {1: (0.4, 0.4, 0.2)}
    out = {b: found[min(found, key=lambda k: (abs(k - b), k))] for b in range(65)}
    a, b, c = out[0]
    out[0] = (0.0, b / (b + c), c / (b + c))
    return out


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def scores(chunked: DataFrame, answers: DataFrame, n: int, v: int, weights: dict[int, tuple[float, float, float]]) -> DataFrame:
    table_of = np.array([weights[b] for b in range(65)])

    def run(table: pa.Table, reply: pa.Table) -> pa.Table:
        chunk = Chunk(table.column("text").to_pylist())
        own, pair, before = token_counts(chunk, _counts(reply, "train"))
        two, one, zero = estimates(own, pair, before, n, v)
        a, b, c = table_of[bucket(before)].T
        begins = chunk.last - chunk.sizes + 1
        per_doc = lambda x: np.add.reduceat(x, begins)
        score = per_doc(np.log10(a * two + b * one + c * zero))
        base = per_doc(np.log10((own + 0.1) / (n + 0.1 * (v + 1))))
        known = per_doc((own > 0).astype(np.int64))
        columns = [table.column("doc_id").combine_chunks(), table.column("held_out").combine_chunks(), pa.array(chunk.sizes), pa.array(known), pa.array(np.full(len(known), n, np.int64)), pa.array(base), pa.array(score)]
        return pa.table(columns, [x.split()[0] for x in SCORES.split(", ")])

    return chunked.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(tidy(run), SCORES)


def score_corpus(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Scores every whole text; learns from the documents whose crc32(doc_id as text) mod 10 isn't 0.

    Null and empty texts are one end token. Rows without a doc_id are held out; repeated rows count, and are scored, as
    often as they occur. Documents are dealt by id and text, so one id with many texts makes no large chunk; a chunk holds
    whole texts, the longest of any length. Without training documents every probability is that of order zero. An
    empty table gives no rows; extra columns are ignored.
    """
    text = whole_text()
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    n_chunks = max(2 * SET_ASIDE, math.ceil(size / chunk_bytes))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 10, F.lit(0)) == 0
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), text.alias("text"))
    chunk = F.pmod(F.xxhash64(F.lit("chunk"), F.col("doc_id"), F.col("text")), F.lit(n_chunks)).cast("long")
    chunked = rows.withColumn("chunk", chunk).withColumn("train", (~F.col("held_out")).cast("int"))
    answers = cut(replies(requests(chunked, n_chunks)))
    total = answers.where("kind = 0").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_distinct", "n_train", "n_aside")]).first()
    n, v = int(total["n_train"]), int(total["n_distinct"])
    aside = F.col("chunk") % SET_ASIDE == 0
    seen = histogram(chunked.where(aside), answers.where(aside), float(n - int(total["n_aside"])), float(v))
    rows = seen.groupBy("bucket", "pairs", "words").agg(F.sum("n").alias("n")).collect()  # at most the bins of the ratios
    return scores(chunked, answers.select("chunk", "kind", "target", "train"), n, v, maximise([tuple(r) for r in rows]))
