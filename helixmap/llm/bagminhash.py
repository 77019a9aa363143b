"""Near duplicates by BagMinHash.

A text is the multiset of its five-word shingles. Each shingle of weight w takes part in Poisson processes over the
weight axis, which is cut at whole numbers and grouped into dyadic intervals (0, 1], (1, 2], (2, 4], (4, 8] and so on,
each with a process of its own whose rate is the interval's width. A point carries its time, a component of the
signature and, by hashed bits that descend the interval's halves, a weight; it counts where that weight is at most w.
A component keeps the least time of its points, so two texts agree in it with the probability of their weighted
Jaccard similarity, sum of minima over sum of maxima. Processes stop once their time passes all of a text's components.

Signatures are banded. In each bucket every text is held against the bucket's hub, the text that shares most buckets
with others, and the pair is verified exactly by the multisets: copies of one text make a star, never all pairs. A text that fails against its hub, and got into a class with it
by no other bucket, is then held against the bucket's other texts, first by four bits of each signature component inside
the join, where pairs that lie far below the threshold, are linked already or met in an earlier band go no further, then
exactly. Links are joined to groups by alternating large-star and small-star steps, cut by checkpoints.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixmap.llm.common import cut, tidy, whole_text

WORDS = 5
THRESHOLD = 0.8
BANDS, ROWS = 20, 5
#: About how many pairs one copy of a hub's text serves: the hub of a hot bucket has many copies.
COPY_PAIRS = 1_000
#: Components of a signature; the bands use the first of them, the comparison of signatures all.
SIZE = 384
#: Standard deviations below the threshold's expectation at which a comparison of signatures gives up.
DEVIATIONS = 3.5
NIBBLES = 0x1111111111111111
#: Shingles that are worked on at once, and words whose hashes a task keeps.
BLOCK_SHINGLES = 60_000
#: Points of processes that are made at once, where one of each process is fewer.
BLOCK_POINTS = 1 << 13
KEEP_WORDS = 150_000

MIX1, MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
STEP = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the splitmix64 finalizer)."""
    x = (x ^ (x >> np.uint64(30))) * MIX1
    x = (x ^ (x >> np.uint64(27))) * MIX2
    return x ^ (x >> np.uint64(31))


def stride(n: int) -> np.uint64:
    """The n-th multiple of ``STEP`` modulo 2^64."""
    return np.uint64(int(STEP) * n & 0xFFFFFFFFFFFFFFFF)


class WordHashes:
    """64-bit hashes of words, kept for words seen lately."""

    def __init__(self) -> None:
        self.kept: dict[str, int] = {}

    def of(self, words: list[str]) -> np.ndarray:
        if len(self.kept) > KEEP_WORDS:
            self.kept.clear()
        kept = self.kept
        try:
            return np.fromiter(map(kept.__getitem__, words), np.uint64, len(words))
        except KeyError:
            for w in set(words):
                if w not in kept:
                    kept[w] = xxhash.xxh3_64_intdigest(w.encode())
            return np.fromiter(map(kept.__getitem__, words), np.uint64, len(words))


def tokens(text: str) -> list[str]:
    """Words between white space, in lower case."""
    return text.lower().split()


def shingles(words: np.ndarray) -> np.ndarray:
    """Hashes of all runs of ``WORDS`` words; a shorter text has one shingle, all of it; an empty one has none."""
    n = len(words)
    if n == 0:
        return np.empty(0, np.uint64)
    size = min(WORDS, n)
    h = np.full(n - size + 1, np.uint64(size))
    for i in range(size):
        h = mix64(h * STEP + words[i : n - size + 1 + i])
    return h


def signatures(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, n_docs: int, size: int = SIZE) -> np.ndarray:
    """Times by document and component; all infinite for a document without elements.

    ``doc``, ``element``, ``weight``: a row for each distinct element of a document, weights whole and at least 1.
    """
    out = np.full(n_docs * size, np.inf)
    least = np.full(n_docs, np.inf)  # the greatest time of a document's components
    owner, seed, low, width, above = [], [], [], [], []
    level = 0
    while True:  # the dyadic intervals that begin below a weight
        start = 0 if level == 0 else 1 << (level - 1)
        has = weight > start
        if not has.any():
            break
        span = max(1, start)
        owner.append(doc[has])
        seed.append(mix64(element[has] + stride(level + 1)))
        low.append(np.full(int(has.sum()), start))
        width.append(np.full(int(has.sum()), span))
        above.append(weight[has])
        level += 1
    if not owner:
        return out.reshape(n_docs, size)
    owner, seed, low, width, above = (np.concatenate(x) for x in (owner, seed, low, width, above))
    time = np.zeros(len(owner))
    n = 0
    while len(owner):
        # few processes that go on for long, as those of short texts do, make many points at once; points too many change nothing
        steps = min(64, max(1, BLOCK_POINTS // len(owner)))
        first = mix64(seed[:, None] + (np.arange(n + 1, n + steps + 1, dtype=np.uint64) * STEP)[None, :])
        second = mix64(first ^ MIX2)
        n += steps
        points = -(np.log(((first >> np.uint64(11)).astype(np.float64) + 1.0) * 2.0**-53) / width[:, None])
        points[:, 0] += time
        points = np.cumsum(points, axis=1)
        component = ((second >> np.uint64(32)) % np.uint64(size)).astype(np.int64)
        # the low bits choose halves of the interval, from the whole down to one unit of weight
        inside = low[:, None] + ((second & np.uint64(0xFFFFFFFF)) * width.astype(np.uint64)[:, None] >> np.uint64(32)).astype(np.int64) < above[:, None]
        slot = owner[:, None] * size + component
        inside &= points < out[slot]
        np.minimum.at(out, slot[inside], points[inside])
        time = points[:, -1]
        active = np.unique(owner)
        least[active] = out.reshape(n_docs, size)[active].max(axis=1)
        go = time < least[owner]
        owner, seed, low, width, above, time = owner[go], seed[go], low[go], width[go], above[go], time[go]
    return out.reshape(n_docs, size)


def band_keys(times: np.ndarray) -> np.ndarray:
    """Signed 64-bit keys by document and band."""
    bits = np.ascontiguousarray(times[:, : BANDS * ROWS]).view(np.uint64).reshape(len(times), BANDS, ROWS)
    key = np.broadcast_to(mix64(np.arange(1, BANDS + 1, dtype=np.uint64) * STEP), (len(times), BANDS)).copy()
    for i in range(ROWS):
        key = mix64(key * STEP + bits[:, :, i])
    return key.view(np.int64)


def nibbles(times: np.ndarray) -> np.ndarray:
    """Four hashed bits of each component, sixteen components in a signed 64-bit number."""
    four = mix64(np.ascontiguousarray(times).view(np.uint64)) >> np.uint64(60)
    shifted = four.reshape(len(times), -1, 16) << (np.arange(16, dtype=np.uint64) * np.uint64(4))
    return np.bitwise_or.reduce(shifted, axis=2).view(np.int64)


def most_differing(threshold: float) -> int:
    """How many components may differ in their four bits."""
    same = threshold + (1 - threshold) / 16
    return SIZE - math.floor(SIZE * same - DEVIATIONS * math.sqrt(SIZE * same * (1 - same)))


def differing(a: Column, b: Column) -> Column:
    """The number of components whose four bits differ."""
    total = F.lit(0)
    for i in range(SIZE // 16):
        x = a[i].bitwiseXOR(b[i])
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        total = total + F.bit_count(x.bitwiseAND(F.lit(NIBBLES)))
    return total


def met_before(a: Column, b: Column, band: Column) -> Column:
    """Whether two texts share the bucket of a band before this one; ``a`` and ``b`` are their keys by band."""
    mask = F.lit(0)
    for i in range(BANDS):
        mask = mask + F.when(a[i] == b[i], 1 << i).otherwise(0)
    return mask.bitwiseAND(F.call_function("shiftleft", F.lit(1), band) - 1) != 0


def sketch(docs: DataFrame) -> DataFrame:
    """doc_id, digest (of the text), keys (by band) and bits of the signature; both null for a text without words."""

    def block(words: list[np.ndarray]) -> list:
        parts = [shingles(w) for w in words]
        doc = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        element = np.concatenate(parts)
        order = np.lexsort((element, doc))
        doc, element = doc[order], element[order]
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (element[1:] != element[:-1])
        at = np.flatnonzero(new)
        weight = np.diff(np.append(at, len(doc)))
        times = signatures(doc[at], element[at], weight, len(parts))
        return [(k, n) if len(p) else (None, None) for k, n, p in zip(band_keys(times), nibbles(times), parts, strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            keys: list = []
            words: list = []
            size = 0
            for text in batch.column(2):
                words.append(hashes.of(tokens(text.as_py())))
                size += len(words[-1])
                if size >= BLOCK_SHINGLES:
                    keys += block(words)
                    words, size = [], 0
            if words:
                keys += block(words)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array([k[i] for k in keys], pa.list_(pa.int64())) for i in (0, 1)]], ["doc_id", "digest", "keys", "bits"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.md5(whole_text().cast("binary"))).alias("digest"), whole_text().alias("text"))
    return rows.mapInArrow(tidy(run), "doc_id long, digest binary, keys array<long>, bits array<long>")


class Likeness:
    """Weighted Jaccard similarity of the shingle multisets of two texts; the last right text is kept."""

    def __init__(self) -> None:
        self.text, self.bag, self.total = None, Counter(), 0

    @staticmethod
    def of(text: str) -> Counter:
        w = tokens(text)
        size = min(WORDS, len(w))
        return Counter(zip(*[w[i : len(w) - size + 1 + i] for i in range(size)], strict=True)) if w else Counter()

    def __call__(self, a: str, b: str) -> float:
        if b != self.text:
            self.text, self.bag = b, self.of(b)
            self.total = sum(self.bag.values())
        own = self.of(a)
        common = sum(min(n, self.bag[s]) for s, n in own.items() if s in self.bag)
        rest = sum(own.values()) + self.total - common
        return common / rest if rest else 1.0


def verify(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """``pairs`` (a, a_id, b, b_id, n: digests, ids of documents that have them, size of their bucket) with ``similar``.

    ``texts``: doc_id, digest, text; a row of each is used, however often it repeats. The texts of a are joined first, the
    text of b has copies by the size of the bucket; pairs are sorted by b before the likeness.
    """
    pairs = pairs.groupBy("a", "a_id", "b", "b_id").agg(F.ceil(F.max("n") / COPY_PAIRS).cast("int").alias("copies"))
    one = texts.groupBy("doc_id", "digest").agg(F.first("text").alias("text"))
    copies = pairs.groupBy(F.col("b_id").alias("doc_id"), F.col("b").alias("digest")).agg(F.max("copies").alias("copies"))
    other = one.join(copies, ["doc_id", "digest"]).withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    other = other.select(F.col("doc_id").alias("b_id"), F.col("digest").alias("b"), "copy", F.col("text").alias("b_text"))
    own = one.select(F.col("doc_id").alias("a_id"), F.col("digest").alias("a"), F.col("text").alias("a_text"))
    dealt = pairs.withColumn("copy", F.pmod(F.xxhash64("a"), F.col("copies")).cast("int"))
    both = dealt.join(own, ["a_id", "a"]).join(other, ["b_id", "b", "copy"]).select("a", "b", "a_text", "b_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        like = Likeness()
        for batch in batches:
            similar = [like(a.as_py(), b.as_py()) >= threshold for a, b in zip(batch.column(2), batch.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(similar, pa.bool_())], ["a", "b", "similar"])

    return both.mapInArrow(tidy(run), "a binary, b binary, similar boolean").distinct()


def links(sketches: DataFrame, docs: DataFrame, threshold: float) -> DataFrame | None:
    """Verified links (a, b) of digests that join every class; None if no two texts share a bucket."""
    text = whole_text()
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("doc_id"), F.unhex(F.md5(text.cast("binary"))).alias("digest"), text.alias("text"))
    classes = sketches.where("keys is not null").groupBy("digest").agg(F.min(F.coalesce("doc_id", F.lit(-1))).alias("doc_id"), F.first("keys").alias("keys"))
    rows = classes.select("digest", "doc_id", F.posexplode("keys").alias("band", "key"))
    shared = cut(rows.groupBy("band", "key").agg(F.count("*").alias("n")).where("n > 1"))  # sides of their own, so that a hot
    rows = cut(rows.join(shared, ["band", "key"]))  # bucket's rows can be split over tasks
    if rows.isEmpty():
        return None
    degree = rows.groupBy("digest").agg(F.sum("n").alias("degree"))
    hubs = rows.join(degree, "digest").groupBy("band", "key").agg(F.max(F.struct("degree", "digest", "doc_id")).alias("h"))
    hubs = cut(hubs.select("band", "key", F.col("h.digest").alias("b"), F.col("h.doc_id").alias("b_id")))
    spokes = cut(rows.join(hubs, ["band", "key"]).where("digest <> b").select("band", "key", F.col("digest").alias("a"), F.col("doc_id").alias("a_id"), "b", "b_id", "n"))
    done = cut(verify(spokes.select("a", "a_id", "b", "b_id", "n"), texts, threshold))
    good = done.where("similar").select("a", "b")
    failed = done.where(~F.col("similar")).select("a", "b")
    if failed.isEmpty():
        return good

    # lost in a bucket: what failed against its hub and is in no class with it by another bucket either
    label = cut(components(good).withColumnRenamed("node", "digest"))
    of_a, of_b = (label.select(F.col("digest").alias(c), F.col("label").alias(c + "_label")) for c in "ab")
    lost = spokes.join(failed, ["a", "b"]).join(of_a, "a", "left").join(of_b, "b", "left")
    lost = lost.where(F.coalesce("a_label", "a") != F.coalesce("b_label", "b"))
    lost = cut(lost.select("band", "key", F.col("a").alias("digest"), F.col("a_id").alias("doc_id")))
    if lost.isEmpty():
        return good
    near = rows.join(lost.select("band", "key").distinct(), ["band", "key"], "left_semi").select("band", "key", "digest", "doc_id", "n")
    near = near.join(lost.select("band", "key", "digest", F.lit(True).alias("lost")), ["band", "key", "digest"], "left")
    of = near.select("digest").distinct().join(sketches.select("digest", "keys", "bits").dropDuplicates(["digest"]), "digest").join(label, "digest", "left")
    of = of.select("digest", "keys", "bits", F.coalesce("label", "digest").alias("label"))
    near = cut(near.join(of, "digest").withColumn("lost", F.coalesce("lost", F.lit(False))))
    left, right = near.where("lost").alias("l"), near.alias("r")
    col = lambda c: (F.col(f"l.{c}"), F.col(f"r.{c}"))
    same = (F.col("l.band") == F.col("r.band")) & (F.col("l.key") == F.col("r.key"))
    once = (F.col("l.digest") != F.col("r.digest")) & (~F.col("r.lost") | (F.col("l.digest") > F.col("r.digest")))
    a, b = col("label")
    close = (a != b) & (differing(*col("bits")) <= most_differing(threshold)) & ~met_before(*col("keys"), F.col("l.band"))
    pairs = left.join(right, same & once & close).select(F.col("l.digest").alias("a"), F.col("l.doc_id").alias("a_id"), F.col("r.digest").alias("b"), F.col("r.doc_id").alias("b_id"), F.col("l.n").alias("n"))
    pairs = cut(pairs.join(failed, ["a", "b"], "left_anti"))
    more = cut(verify(pairs, texts, threshold)).where("similar").select("a", "b")
    return good.unionByName(more)


def components(edges: DataFrame) -> DataFrame:
    """node, label: the least node of its component, for every node of ``edges`` (a, b)."""
    edges = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        star = large.join(small, "a")
        edges = cut(star.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small.select("a", F.col("m").alias("b"))).distinct())
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(roots)


def groups(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, class_id and class_size of every row.

    Rows whose texts are alike, or linked by a chain of texts each at least ``threshold`` similar to the next, are one
    class; class_id is its least doc_id (null where all its ids are null), class_size its number of rows. Texts of
    fewer than five words have one shingle, all their words; texts without words are a class of their own by their
    characters. A null text is empty. Rows that repeat are rows of one class. An empty table gives no rows; extra
    columns are ignored.
    """
    sketches = cut(sketch(docs))
    classes = sketches.groupBy("digest").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"))
    edges = links(sketches, docs, threshold)
    if edges is not None:
        found = components(edges)
        labelled = classes.join(found.withColumnRenamed("node", "digest"), "digest", "left").withColumn("label", F.coalesce("label", "digest"))
    else:
        labelled = classes.withColumn("label", F.col("digest"))
    sums = labelled.groupBy("label").agg(F.min("least").alias("class_id"), F.sum("n").alias("class_size"))
    of_text = labelled.select("digest", "label").join(sums, "label")
    return sketches.select("doc_id", "digest").join(of_text, "digest").select("doc_id", "class_id", "class_size", "digest", "label")


def dedup(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row of each class, with all columns of ``docs``: that with the least doc_id (then text); null ids count last.

    If rows with that id repeat with equal texts, one of them stays.
    """
    names = docs.columns
    of = groups(docs, threshold)
    order = F.struct(F.col("doc_id").isNull().alias("x"), F.col("doc_id").alias("doc_id"), F.col("digest").alias("digest"))
    keep = cut(of.groupBy("label").agg(F.min(order).alias("k")).select(F.coalesce(F.col("k.doc_id").cast("string"), F.lit("null")).alias("_keep_id"), F.col("k.digest").alias("_keep_digest")))
    rows = docs.select(F.struct(*[f"`{c}`" for c in names]).alias("_row")).withColumn("_keep_id", F.coalesce(F.col("_row.doc_id").cast("long").cast("string"), F.lit("null")))
    rows = rows.withColumn("_keep_digest", F.unhex(F.md5(F.coalesce(F.col("_row.text"), F.lit("")).cast("binary"))))
    kept = rows.join(keep, ["_keep_id", "_keep_digest"])
    nth = F.row_number().over(Window.partitionBy("_keep_id", "_keep_digest").orderBy(F.xxhash64("_row")))
    return kept.withColumn("_nth", nth).where("_nth = 1").select("_row.*")
