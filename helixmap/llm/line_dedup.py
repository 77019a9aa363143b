"""Line dedup by pairwise alignment.

Documents are paired by hashes of runs of whole lines: from each line on, and up to each line, the shortest run of lines
that has ``MIN_WORDS`` words. So that passages within longer lines are found too, all runs of half as many words are hashed,
wherever they start, and those winnowed that are the least of their neighbours, so that each passage of ``MIN_WORDS`` words
has at least one, which depends on nothing else. A hash belongs to the earliest document that has it, its home; every
later one that has it makes a pair with that home. So a rare hash and one that a third of all documents have alike give
a document one pair at most: nothing is squared, nothing capped.

A pair is aligned by patience diff over the hashes that lead from one to the other: places that both have once are matched
along the longest increasing subsequence, the gaps between them in the same way; a place that is left over moved or is
repeated, and is aligned on its own. Each match grows word by word to both sides as far as the documents agree, so a
block ends where the passage ends, and not at a line. Blocks of ``MIN_WORDS`` words or more, each common to the document
and one earlier document, go from the later one. Only hashes and 16-bit words are joined; a text is shuffled once, to
meet the verdict on its words.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixmap.llm.bagminhash import mix64
from helixmap.llm.common import cut, fresh, tidy, whole_text

#: Words of the shortest block that is deleted.
MIN_WORDS = 25
#: Bytes of an Arrow batch, about: Spark's own bound of 64 MB is held several times over, by the JVM and by its Python workers.
BATCH_BYTES = 4 << 20
#: About how many pairs one copy of a home's words serves: a home with more pairs has more copies.
COPY_PAIRS = 1_000

LINES = "doc_id long, digest long, tokens binary, hashes array<long>, places array<int>"

STEP = np.uint64(0x9E3779B97F4A7C15)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Odd multipliers of the bytes of a word, by place; places beyond the table begin anew.
PLACES = 4096
POWERS = np.cumprod(np.full(PLACES, 0x100000001B3, np.uint64))
WORD = re.compile(rb"[^\t-\r ]+")
#: Bytes that are cut at once.
BLOCK_BYTES = 1 << 18
#: Base of sequence hashes, odd, and its inverse modulo 2**64.
BASE = 0xD1342543DE82EF95
INVERSE = pow(BASE, -1, 1 << 64)


def small_batches(run: Callable) -> Callable:
    """``tidy(run)``; from here on batches of the session have about ``BATCH_BYTES`` too, unless it has set a bound."""
    spark = SparkSession.getActiveSession()
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark is not None and spark.conf.get(name, None) is None:
        spark.conf.set(name, str(BATCH_BYTES))
    return tidy(run)


def words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A hash of each word, the number of the line it is in, over all texts, and the number of its text.

    Words lie between ASCII white space, lines between line ends.
    """
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    space = SPACE[data]
    start = ~space
    start[1:] &= space[:-1]
    at = np.flatnonzero(start)
    if not len(at):
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    lengths = np.diff(np.append(at, len(data)))
    place = (np.arange(at[0], len(data)) - np.repeat(at, lengths)) & (PLACES - 1)
    value = np.where(space[at[0] :], np.uint64(0), (data[at[0] :] + np.uint64(1)) * POWERS[place])
    line = np.searchsorted(np.flatnonzero(data == 10), at)
    return mix64(np.add.reduceat(value, at - at[0])), line, np.searchsorted(np.cumsum([len(t) + 1 for t in texts]) - 1, at)


def sequence_hashes(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums and factors for ``run_hashes``."""
    n = len(words) + 1
    sums = np.zeros(n, np.uint64)
    np.cumsum(mix64(words + STEP) * np.cumprod(np.full(n - 1, BASE, np.uint64)), out=sums[1:])
    return sums, np.cumprod(np.full(n, INVERSE, np.uint64))


def run_hashes(sums: np.ndarray, back: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of the words from start to end, for each; equal runs have equal hashes wherever they stand."""
    return mix64((sums[end] - sums[start]) * back[start] + (end - start).astype(np.uint64))


def sliding(values: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """``pick`` over each ``width`` neighbouring values."""
    have = 1
    while have < width:
        step = min(have, width - have)
        values, have = pick(values[:-step], values[step:]), have + step
    return values


def anchors(words: np.ndarray, line: np.ndarray, text: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first word (counted within its text) and text of each run that pairs documents, in the order of texts."""
    n = len(words)
    sums, back = sequence_hashes(words)
    first = np.flatnonzero(np.diff(line, prepend=-1))  # words at which lines start
    last = np.append(first[1:], n)
    forward = np.searchsorted(last, first + min_words)  # the line that ends the shortest run from each line on
    backward = np.searchsorted(first, last - min_words, "right") - 1  # the line that begins the shortest run up to each
    here, there = forward < len(last), backward >= 0
    start = np.concatenate([first[here], first[backward[there]]])
    end = np.concatenate([last[forward[here]], last[there]])
    within = text[start] == text[end - 1]
    start, end = start[within], end[within]
    size = (min_words + 1) // 2
    width = min_words - size + 1
    if n >= min_words:
        at = np.arange(n - size + 1)
        own = text[: len(at)] == text[size - 1 :]
        h = run_hashes(sums, back, at, at + size)
        least = sliding(h, width, np.minimum)
        least = np.where(text[: len(least)] == text[min_words - 1 :], least, np.uint64(0))  # windows that lie in one text
        edge = np.zeros(width - 1, np.uint64)
        chosen = np.flatnonzero(own & (sliding(np.concatenate([edge, least, edge]), width, np.maximum) == h))
        start, end = np.concatenate([start, chosen]), np.concatenate([end, chosen + size])
    order = np.unique((start << 32) | end)  # a long line is found forward and backward
    start, end = order >> 32, order & 0xFFFFFFFF
    of = text[start]
    return run_hashes(sums, back, start, end).view(np.int64), start - np.searchsorted(text, of), of


def line_table(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, digest of the text, 16 bits of each word's hash, and the anchors: their hashes and first words."""

    def block(texts: list[bytes]) -> list[tuple]:
        words, line, text = words_of(texts)
        h, place, of = anchors(words, line, text, min_words)
        short = (words >> np.uint64(48)).astype("<u2")
        (a, b), (c, d) = ((x[:-1], x[1:]) for x in (np.searchsorted(t, np.arange(len(texts) + 1)) for t in (text, of)))
        return [(short[a[i] : b[i]].tobytes(), h[c[i] : d[i]], place[c[i] : d[i]]) for i in range(len(texts))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, texts, size = [], [], 0
            for t in batch.column(2).cast(pa.binary()):
                texts.append(t.as_py())
                size += len(texts[-1])
                if size >= BLOCK_BYTES:
                    found += block(texts)
                    texts, size = [], 0
            found += block(texts) if texts else []
            ends = np.concatenate([[0], np.cumsum([len(f[1]) for f in found])]).astype(np.int32)
            lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate([f[i] for f in found]) if found else np.empty(0, np.int64), kind)) for i, kind in ((1, pa.int64()), (2, pa.int32()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([f[0] for f in found], pa.binary()), *lists], ["doc_id", "digest", "tokens", "hashes", "places"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), _digest().alias("digest"), whole_text().alias("text")).mapInArrow(small_batches(run), LINES)


def _digest():
    return F.xxhash64(whole_text())


def _key(doc_id: str):
    """A document's id, so that null ids can be joined too."""
    return F.coalesce(F.col(doc_id).cast("string"), F.lit("null"))


def homes(lines: DataFrame) -> DataFrame:
    """Pairs of a document and the home of hashes it has, with the ``seeds``: where these runs start in both.

    Columns: key, digest, home_id, home_key, home_digest, seeds (a long each: place shifted by 32 bits, place in the home).
    """
    rows = lines.select("doc_id", "digest", F.explode(F.arrays_zip("hashes", "places")).alias("x")).select(F.col("x.hashes").alias("h"), F.struct("doc_id", "digest").alias("k"), F.col("x.places").alias("place"))
    first = rows.groupBy("h").agg(F.min(F.struct("k", "place")).alias("home"), F.count("*").alias("n")).where("n > 1").drop("n")
    first = cut(first)  # a side of its own, so that a hot hash's rows can be split over tasks
    seed = F.shiftleft(F.col("place").cast("long"), 32).bitwiseOR(F.col("home.place").cast("long"))
    met = rows.join(first, "h").where("k <> home.k").select("k", F.col("home.k").alias("home"), seed.alias("seed"))
    pairs = met.groupBy("k", "home").agg(F.collect_list("seed").alias("seeds"))  # at most a document's own hashes
    return pairs.select(_key("k.doc_id").alias("key"), F.col("k.digest").alias("digest"), F.col("home.doc_id").alias("home_id"), _key("home.doc_id").alias("home_key"), F.col("home.digest").alias("home_digest"), "seeds")


def dealt(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``pairs`` with ``copy``, the copy of its home's words that a pair meets, and ``copies`` of each home.

    There are as many copies as the pairs of a home ask for, however many hashes a pair has and however frequent they are:
    all copies together are no more than the homes and a ``COPY_PAIRS``-th of the pairs.
    """
    home = ["home_key", "home_digest"]
    wanted = cut(pairs.groupBy(*home).agg(F.ceil(F.count("*") / COPY_PAIRS).cast("int").alias("copies")))
    # a side of its own, so that a hot home's pairs can be split over tasks
    rows = pairs.join(wanted.where("copies > 1"), home, "left")
    return rows.withColumn("copy", F.pmod(F.xxhash64("key", "digest"), F.coalesce("copies", F.lit(1))).cast("int")).drop("copies"), wanted


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest subsequence of pairs, sorted by the first member, whose second members increase."""
    tails, at, back = [], [], [-1] * len(pairs)
    for i, (_, b) in enumerate(pairs):
        k = bisect_left(tails, b)
        if k == len(tails):
            tails.append(b)
            at.append(i)
        else:
            tails[k], at[k] = b, i
        back[i] = at[k - 1] if k else -1
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(pairs[i])
        i = back[i]
    return out[::-1]


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Matched positions of ``a`` and ``b``, increasing in both.

    Where a stretch has common members but none that both have once, the k-th occurrence on one side is held against
    the k-th on the other, so repeated ones align without comparing all of them with all.
    """
    matched, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            matched.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            matched.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        n, m = Counter(a[a0:a1]), Counter(b[b0:b1])
        where = {b[j]: j for j in range(b0, b1) if m[b[j]] == 1}
        anchors = _increasing([(i, where[a[i]]) for i in range(a0, a1) if n[a[i]] == 1 and a[i] in where])
        if not anchors:
            seen: Counter = Counter()
            places = {}
            for j in range(b0, b1):
                places[b[j], seen[b[j]]] = j
                seen[b[j]] += 1
            seen.clear()
            pairs = []
            for i in range(a0, a1):
                if (j := places.get((a[i], seen[a[i]]))) is not None:
                    pairs.append((i, j))
                seen[a[i]] += 1
            matched += _increasing(pairs)
            continue
        matched += anchors
        edges = [(a0 - 1, b0 - 1), *anchors, (a1, b1)]
        todo += [(i + 1, k, j + 1, l) for (i, j), (k, l) in zip(edges[:-1], edges[1:], strict=True) if i + 1 < k and j + 1 < l]
    return sorted(matched)


def agreeing(a: np.ndarray, b: np.ndarray) -> int:
    """How many members ``a`` and ``b`` have in common from their start on."""
    n, at, step = min(len(a), len(b)), 0, 64
    while at < n:
        end = min(n, at + step)
        differ = a[at:end] != b[at:end]
        if differ.any():
            return at + int(differ.argmax())
        at, step = end, step * 8
    return n


def common_blocks(home: np.ndarray, own: np.ndarray, seeds: list[tuple[int, int]], min_words: int) -> list[tuple[int, int]]:
    """Spans of ``own`` that are aligned with ``home``, of ``min_words`` or more, in the order they were found.

    ``seeds``: places of own and home where equal runs start, of half as many words at least. Those that patience diff
    matches come first; each of the others that no block has is aligned on its own.
    """
    seeds = sorted(set(seeds))
    chain = patience(sorted({h for _, h in seeds}), [h for _, h in seeds])
    out: list[tuple[int, int]] = []
    covered = np.zeros(len(own), bool)
    size = (min_words + 1) // 2
    for o, h in [*(seeds[j] for _, j in chain), *seeds]:
        if covered[o : o + size].all():
            continue
        a, b = o - agreeing(own[:o][::-1], home[:h][::-1]), o + agreeing(own[o:], home[h:])
        if b - a >= min_words:
            out.append((a, b))
            covered[a:b] = True
    return out


def words_in(spans: list[tuple[int, int]]) -> int:
    """How many words lie in spans, which may overlap."""
    total = end = 0
    for a, b in sorted(spans):
        total += max(0, b - max(a, end))
        end = max(end, b)
    return total


def spans_of(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true values."""
    change = np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))
    return np.flatnonzero(change == 1), np.flatnonzero(change == -1)


def drop_words(text: str, drop: np.ndarray) -> tuple[str, int, int, str]:
    """The text without marked words, how many lines they touch, their number and their text.

    A line of which nothing stays goes with its line end; words go with the white space after them.
    """
    if not drop.any():
        return text, 0, 0, ""
    kept, removed, touched, at = [], [], 0, 0
    for line in text.encode().split(b"\n"):
        n = len(line.split())
        out = drop[at : at + n]
        at += n
        if not out.any():
            kept.append(line)
            continue
        touched += 1
        if out.all():
            removed.append(line)
            continue
        edges = [0, *[m.start() for m in WORD.finditer(line)][1:], len(line)]
        for box, mask in ((kept, ~out), (removed, out)):
            box.append(b"".join(line[edges[a] : edges[b]] for a, b in zip(*spans_of(mask), strict=True)))
    return b"\n".join(kept).decode(), touched, int(drop.sum()), b"\n".join(removed).decode()


def covered_words(docs: DataFrame, min_words: int = MIN_WORDS, copies: float | None = None) -> DataFrame:
    """key, digest, covered, partners: for each document with a pair, its blocks and the earlier documents' ids.

    A block is the number of its first word, shifted by 32 bits, and the number of the first word after it. ``copies``: the
    share of the longer document's words from which on all words of the later one are a block.
    """
    lines = cut(line_table(docs, min_words))
    pairs = cut(homes(lines))
    # dealt once by document for both joins; rows that repeat are one document
    keyed = lines.select(_key("doc_id").alias("key"), "digest", "tokens").groupBy("key", "digest").agg(F.first("tokens").alias("tokens"))
    pairs, wanted = dealt(pairs)
    home = keyed.join(wanted.withColumnsRenamed({"home_key": "key", "home_digest": "digest"}), ["key", "digest"]).withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    home = home.select(F.col("key").alias("home_key"), F.col("digest").alias("home_digest"), "copy", F.col("tokens").alias("home"))
    pairs = pairs.join(home, ["home_key", "home_digest", "copy"])
    pairs = pairs.join(keyed, ["key", "digest"]).select("key", "digest", "home_id", "seeds", "home", "tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            at = batch.column(3).offsets.to_numpy()
            seeds = batch.column(3).values.to_numpy()
            for i, (home, own) in enumerate(zip(batch.column(4), batch.column(5), strict=True)):
                s = seeds[at[i] : at[i + 1]]
                found = common_blocks(np.frombuffer(home.as_buffer(), "<u2"), np.frombuffer(own.as_buffer(), "<u2"), list(zip((s >> 32).tolist(), (s & 0xFFFFFFFF).tolist(), strict=True)), min_words)
                longer = max(len(home.as_buffer()), len(own.as_buffer())) // 2
                if copies is not None and found and words_in(found) >= copies * longer:
                    found = [(0, len(own.as_buffer()) // 2)]
                out.append([a << 32 | b for a, b in found])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(out, pa.list_(pa.int64()))], ["key", "digest", "home_id", "covered"])

    aligned = pairs.mapInArrow(small_batches(run), "key string, digest long, home_id long, covered array<long>")
    return cut(aligned.groupBy("key", "digest").agg(F.array_distinct(F.flatten(F.collect_list("covered"))).alias("covered"), F.sort_array(F.collect_set("home_id")).alias("partners")))


ADDED = ["kept_chars", "removed_lines", "removed_words", "removed_text", "partners"]


def dedup(docs: DataFrame, min_words: int = MIN_WORDS, copies: float | None = None) -> DataFrame:
    """``docs`` with its text cut, and kept_chars, removed_lines, removed_words, removed_text and partners added.

    ``docs`` has doc_id and text; columns with an added name are replaced. Documents are ordered by doc_id (null
    first), then by a digest of the text; rows alike in both are one document, and each such row gets its result. Of
    an exact copy all words go, if it has ``min_words``. Null and empty texts have no words and stay as they are;
    texts may be of any length. removed_text holds the deleted words, by line; partners the ids of the earlier documents
    it was aligned with. An empty table gives no rows. With ``copies`` a document goes whole if its blocks with one earlier
    document are so large a share of the longer one of both: of a near copy else only shreds would stay.

    A passage of ``min_words`` words that an earlier document has goes, unless each of its hashes stood in a still earlier
    document that has fewer of its words. A word at a block's end may go wrongly with a chance of 1 in 65,536, as 16 bits
    of its hash are compared.
    """
    docs = docs.drop(*ADDED)
    key, digest, covered = fresh(docs, "__key", "__digest", "__covered")
    verdict = covered_words(docs.select("doc_id", "text"), min_words, copies).select(F.col("key").alias(key), F.col("digest").alias(digest), F.col("covered").alias(covered), "partners")
    rows = docs.withColumn(key, _key("doc_id")).withColumn(digest, _digest())
    rows = rows.join(verdict, [key, digest], "left").drop(key, digest)
    names = [*docs.columns, *ADDED]
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, sizes, n_lines, n_words, removed = [], [], [], [], []
            for text, marks in zip(batch.column(at), batch.column(len(names) - 5), strict=True):
                text, marks = text.as_py(), marks.as_py()
                out = (text, 0, 0, "")
                if marks:
                    mask = np.zeros(len(text.encode().split()), bool)
                    for m in marks:
                        mask[m >> 32 : m & 0xFFFFFFFF] = True
                    out = drop_words(text, mask)
                for column, value in zip((texts, n_lines, n_words, removed), out, strict=True):
                    column.append(value)
                sizes.append(len(out[0] or ""))
            columns = list(batch.columns[: len(names) - 5])
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sizes, pa.int64()), pa.array(n_lines, pa.int32()), pa.array(n_words, pa.int32()), pa.array(removed, pa.string()), batch.column(len(names) - 4)], names)

    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in docs.columns] + ["kept_chars long", "removed_lines int", "removed_words int", "removed_text string", "partners array<long>"])
    return rows.select(*[f"`{c}`" for c in docs.columns], covered, "partners").mapInArrow(small_batches(run), schema)


def cut_texts(docs: DataFrame, min_words: int = MIN_WORDS, copies: float | None = None) -> DataFrame:
    """``docs`` with its text cut as by ``dedup``, and n_chars, if there is one, following it; all other columns stay,
    whatever their names."""
    own = fresh(docs, *(f"__own_{i}" for i in range(len(ADDED))))
    away = {c: o for c, o in ((c, own[ADDED.index(c.lower())]) for c in docs.columns if c.lower() in ADDED)}
    rows = dedup(docs.withColumnsRenamed(away), min_words, copies)
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(F.col("removed_lines") > 0, F.col("kept_chars")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return rows.drop(*ADDED).withColumnsRenamed({o: c for c, o in away.items()}).select(*[f"`{c}`" for c in docs.columns])
