"""SimHash fingerprints, and all fingerprints within a Hamming radius by permuted block tables.

The terms of a text are its pairs of neighbouring words (and its last word alone); each occurrence votes, with weight
1, for or against each of the 64 bits by the bits of its hash, so a term weighs as much as it occurs. Two bits are
counted in one long, the upper in the high half: a text has less than 2^31 words, so the halves never meet.

Searching: the 64 bits are cut into radius + 3 blocks. Two fingerprints within the radius agree in at least 3 blocks, so
they meet in the table of one choice of 3 blocks; the table of the first 3 blocks they agree in reports the pair, and
only there. Only DataFrame operations are used.
"""

from __future__ import annotations

import math
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixmap.llm.common import cut, whole_text

HALF = 0x0000000100000001
RADIUS = 3
KEEP_BLOCKS = 3
#: Documents of a bucket of neighbours, a bound of the number of buckets, and sampled ids for each.
BUCKET_ROWS = 2_000
MAX_BUCKETS = 1 << 16
SAMPLE = 16
#: How many documents one search query stands for: ids divisible by this are queries against all rows.
QUERY_STEP = 20


def term_pairs(text: Column) -> Column:
    """Array of structs of a word and the next one (null after the last); an empty text has the empty word."""
    words = F.split(text, "[ \\t\\n\\r]+")
    return F.arrays_zip(words.alias("a"), F.slice(words, 2, F.size(words)).alias("b"))


def vote_columns() -> list[Column]:
    """Sums over term hashes in column ``__hash``: votes for bit j in the low, for bit j + 32 in the high half."""
    return [F.sum(F.shiftrightunsigned(F.col("__hash"), j).bitwiseAND(F.lit(HALF))).alias(f"__v{j}") for j in range(32)]


def majority() -> Column:
    """The fingerprint from the votes and the number of terms: bit set where more than half are for it."""
    low = [F.when((F.col(f"__v{j}").bitwiseAND(F.lit(0xFFFFFFFF)) * 2) > F.col("__n"), F.lit(1 << j)).otherwise(F.lit(0)) for j in range(32)]
    high = [F.when((F.shiftrightunsigned(F.col(f"__v{j}"), 32) * 2) > F.col("__n"), F.lit((1 << (j + 32)) - (1 << 64 if j == 31 else 0))).otherwise(F.lit(0)) for j in range(32)]
    return reduce(lambda a, b: a.bitwiseOR(b), [x.cast("long") for x in low + high])


def likeness(a: Column, b: Column) -> Column:
    return F.lit(1.0) - F.bit_count(a.bitwiseXOR(b)) / F.lit(64.0)


def fingerprints(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """``keys`` (one row's identity) with the fingerprint of that row's text.

    The exploded terms are summed where they arise: if the rows are already dealt by some of the keys, nothing is
    shuffled. Rows that agree in all keys are taken for parts of one text.
    """
    terms = df.select(*keys, F.explode(term_pairs(F.col(text))).alias("__term")).select(*keys, F.xxhash64("__term.a", "__term.b").alias("__hash"))
    return terms.groupBy(*keys).agg(F.count("*").alias("__n"), *vote_columns()).select(*keys, majority().alias("fingerprint"))


def _literal(values: list, kind: str) -> Column:
    import json

    return F.from_json(F.lit(json.dumps(values)), f"array<{kind}>")


def _count_up_to(bounds: list[int], value: Column) -> Column:
    """How many of the sorted ``bounds`` are at most ``value``: first by blocks of them, then within one block."""
    width = max(1, math.isqrt(len(bounds)))
    blocks = [bounds[i : i + width] for i in range(0, len(bounds), width)]
    if not blocks:
        return F.lit(0)
    block = F.size(F.filter(_literal([b[0] for b in blocks], "bigint"), lambda x: x <= value))
    inside = F.size(F.filter(F.element_at(_literal(blocks, "array<bigint>"), F.greatest(block, F.lit(1))), lambda x: x <= value))
    return F.when(block > 0, (block - 1) * width + inside).otherwise(0).cast("int")


def _buckets(docs: DataFrame, bucket_rows: int) -> tuple[Column, Column, int]:
    """The bucket of a row (doc_id, text), in the order of rows, whether the row in bucket b is its first, and their number.

    Buckets of ids lie between quantiles of a bounded sample of ids, so outliers and gaps don't matter; rows without an
    id, which come last, are dealt by their hash. The number of buckets is bounded, and so is all that comes to the driver.
    """
    n, low, filled = docs.agg(F.count("*"), F.min("doc_id"), F.count("doc_id")).first()
    of_ids, of_nulls = (min(MAX_BUCKETS // 2, max(1, math.ceil(k / bucket_rows))) for k in (filled, n - filled))
    every = max(1, filled // (SAMPLE * of_ids))
    ids = F.col("doc_id")
    sample = sorted(r[0] for r in docs.where(ids.isNotNull() & (F.pmod(F.xxhash64(ids), F.lit(every)) == 0)).select("doc_id").collect()) if of_ids > 1 else []
    bounds = sorted({sample[len(sample) * i // of_ids] for i in range(1, of_ids)} - {low}) if sample else []
    bucket = F.lit(len(bounds)) - _count_up_to(bounds, ids)
    h = F.xxhash64("text")
    if filled < n:
        upper = F.shiftrightunsigned(h.bitwiseXOR(F.lit(-1 << 63)), 33)  # 31 bits that rise with the hash
        last = F.lit(len(bounds) + 1) + F.shiftright(upper * F.lit(of_nulls), 31)
        bucket = F.when(ids.isNull(), last).otherwise(bucket)
    bucket = bucket.cast("int")
    first = docs.groupBy(bucket.alias("b")).agg(F.max("doc_id"), *([F.min(F.when(ids.isNull(), h))] if filled < n else []))
    found = sorted(tuple(r) for r in first.collect())
    place = {r[0]: i for i, r in enumerate(found)}  # buckets without rows are left out
    dense = F.element_at(_literal([place.get(b, 0) for b in range(max(place, default=0) + 1)], "int"), bucket + 1)
    is_first = ids == F.element_at(_literal([r[1] for r in found], "bigint"), F.col("b") + 1)
    if filled < n:
        is_first = F.when(ids.isNull(), h == F.element_at(_literal([r[2] for r in found], "bigint"), F.col("b") + 1)).otherwise(is_first)
    return dense, F.coalesce(is_first, F.lit(False)), len(found)


def with_next(docs: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """bucket, row, ghost, doc_id, text and next_text: each document beside the one after it, by descending doc_id.

    After the last comes the first; equal ids, and rows without one, which come last, are ordered by a hash of their
    texts. Texts are shuffled once: the first document of each bucket also goes, as a ghost, to the end of the one before.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    bucket, is_first, n = _buckets(rows, bucket_rows)
    before = F.pmod(F.col("b") - 1, F.lit(max(1, n))).cast("int")
    own, ghost = (F.struct(b.alias("bucket"), F.lit(g).alias("ghost")) for b, g in ((F.col("b"), False), (before, True)))
    dealt = rows.withColumn("b", bucket).withColumn("x", F.explode(F.when(is_first, F.array(own, ghost)).otherwise(F.array(own)))).select("x.bucket", "x.ghost", "doc_id", "text")
    order = Window.partitionBy("bucket").orderBy(F.col("ghost"), F.col("doc_id").desc_nulls_last(), F.xxhash64("text"))
    return dealt.withColumn("row", F.row_number().over(order)).withColumn("next_text", F.coalesce(F.lead("text").over(order), F.lit("")))


def describe(docs: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fp, edited_fp, next_fp: see ``edit_and_compare``."""
    rows = with_next(docs, bucket_rows)
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half))
    rows = rows.withColumn("edited", edited).withColumn("n_chars", n.cast("long"))
    rows = rows.withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256))
    both = F.array(F.struct(F.lit(0).alias("kind"), F.col("text").alias("text")), F.struct(F.lit(1).alias("kind"), F.col("edited").alias("text")))
    keys = ["bucket", "row", "ghost", "doc_id", "n_chars", "edited_sha256"]
    two = rows.select(*keys, F.explode(both).alias("x")).select(*keys, F.col("x.kind").alias("kind"), F.col("x.text").alias("text"))
    fps = fingerprints(two, [*keys, "kind"], "text")
    pick = lambda k: F.max(F.when(F.col("kind") == k, F.col("fingerprint")))
    one = fps.groupBy(*keys).agg(pick(0).alias("fp"), pick(1).alias("edited_fp"))
    following = F.lead("fp").over(Window.partitionBy("bucket").orderBy("row"))
    one = one.withColumn("next_fp", F.coalesce(following, F.col("fp")))
    return one.where(~F.col("ghost")).select("doc_id", "n_chars", "edited_sha256", "fp", "edited_fp", "next_fp")


def block_tables(radius: int) -> list[tuple[int, list[int]]]:
    """For each table the mask of its blocks, and the masks of which none may be wholly equal for it to report a pair."""
    n = radius + KEEP_BLOCKS
    edges = [64 * i // n for i in range(n + 1)]
    masks = [((1 << (b - a)) - 1) << a for a, b in zip(edges[:-1], edges[1:], strict=True)]
    out = []
    for chosen in combinations(range(n), KEEP_BLOCKS):
        out.append((sum(masks[i] for i in chosen), [masks[i] for i in range(chosen[-1]) if i not in chosen]))
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def within_radius(queries: DataFrame, fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Pairs (q, fp) of distinct fingerprints of ``queries`` and of ``fps`` that differ in at most ``radius`` bits.

    Both have one column, fp. Every such pair is found, equal ones included, and comes once.
    """
    tables = block_tables(radius)
    most = max(len(m) for _, m in tables)
    spec = _literal([{"t": i, "m": _signed(mask), "no": [_signed(x) for x in no] + [0] * (most - len(no))} for i, (mask, no) in enumerate(tables)], "struct<t:int,m:bigint,no:array<bigint>>")
    tabled = lambda d, name: d.distinct().select(F.col("fp").alias(name), F.explode(spec).alias("x")).select(name, F.col("x.t").alias("t"), F.col(name).bitwiseAND(F.col("x.m")).alias("k"), F.col("x.no").alias("no"))
    left, right = tabled(queries.select("fp"), "q").alias("l"), tabled(fps.select("fp"), "fp").drop("no").alias("r")
    differ = F.col("l.q").bitwiseXOR(F.col("r.fp"))
    first = reduce(lambda a, b: a & b, [(F.col("l.no")[i] == 0) | (differ.bitwiseAND(F.col("l.no")[i]) != 0) for i in range(most)])
    return left.join(right.hint("merge"), (F.col("l.t") == F.col("r.t")) & (F.col("l.k") == F.col("r.k")) & (F.bit_count(differ) <= radius) & first).select("q", "fp")


def edit_and_compare(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Fingerprints of every whole text, of its edited text and of the next document, and who is near.

    Columns: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, and n_near: for
    a document whose id is divisible by ``QUERY_STEP`` the number of documents, itself included, whose fingerprint
    lies within ``radius`` bits of its own; null for the others. Null texts are empty; equal texts have equal
    fingerprints; each repeated row is a row of the result; null ids order last; an empty table gives no rows.
    """
    rows = cut(describe(docs))
    counts = rows.groupBy("fp").agg(F.count("*").alias("n"))
    asked = rows.where(F.pmod("doc_id", F.lit(QUERY_STEP)) == 0).select("fp").distinct()
    pairs = within_radius(asked, counts.select("fp"), radius)
    # a side of its own, one row a query, so that the rows of a hot fingerprint can be split over tasks
    near = cut(pairs.join(counts.select("fp", "n").hint("merge"), "fp").groupBy("q").agg(F.sum("n").alias("n_near")))
    hexed = lambda c: F.lpad(F.lower(F.hex(c)), 16, "0")
    out = rows.join(near.withColumnRenamed("q", "fp").hint("merge"), "fp", "left")  # grows with the queries: never sent to all
    return out.select(
        "doc_id", "n_chars", "edited_sha256", hexed("fp").alias("fingerprint"), hexed("edited_fp").alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
        F.when(F.pmod("doc_id", F.lit(QUERY_STEP)) == 0, F.col("n_near")).alias("n_near"),
    )
