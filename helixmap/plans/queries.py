"""Named queries over the driver's tables, each with the SQL that checks it where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from helixmap.functions import codec
from helixmap.operators import index as ix
from helixmap.operators import ranking, seeds, sketch
from helixmap.plans import sql
from helixmap.plans.params import MapParams, Scoring
from helixmap.sinks import formats

P = MapParams(k=15, w=10, codec="text2bit")
K, W, FREQUENCIES = P.k, P.w, P.frequencies
BIN = 64

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, text: str | None = None):
    def keep(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if text:
            SQL[name] = text
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


#: Tables up to this size may come as one block of one file; they are dealt over all cores before a kernel runs.
SPREAD_BYTES = 256 << 20


def spread(df: DataFrame) -> DataFrame:
    """A small table over as many partitions as there are cores; larger ones have blocks enough and stay as they are."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if size <= SPREAD_BYTES else df


def bases(df: DataFrame, key: str, name: str) -> DataFrame:
    """(name, seq) of a text table."""
    return spread(df.select(F.col(key).alias(name), "text")).select(name, codec.encode(F.col("text")).alias("seq"))


def refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bases(table(spark, sf_dir, "documents"), "doc_id", "rid")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bases(table(spark, sf_dir, "benchmark"), "item_id", "qid")


def ref_minimizers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch.sketch(refs(spark, sf_dir), "rid", K, W)


def item_minimizers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch.sketch(items(spark, sf_dir), "qid", K, W)


def seeded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeds of the benchmark items in the documents, with rounds."""
    mini = ref_minimizers(spark, sf_dir)
    table_ = ix.counts(mini).persist()
    occ = ix.thresholds(table_, FREQUENCIES)
    q = item_minimizers(spark, sf_dir)
    # only keys that the items have matter from here on: rows and counts of the others end before any join of rows
    wanted = q.select("hash").distinct()
    kept = table_.where(F.col("n") <= occ[-1]).join(wanted, "hash", "left_semi")
    return seeds.join_seeds(q, mini.join(kept, "hash"), occ, K)


DOCS, ITEMS = sql.sequences("documents", "doc_id"), sql.sequences("benchmark", "item_id")
INDEX = sql.index("d", DOCS, K, W, FREQUENCIES)
SEEDS = f"{INDEX},\n{sql.minimizers('q', ITEMS, K, W)},\n{sql.seeds('s', 'q', 'd', K)}"


# scans, codecs and filters


@query("encode_bases", f"SELECT doc_id, {codec.encode_sql('text')} AS seq FROM documents")
def encode_bases(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", codec.encode(F.col("text")).alias("seq"))


@query(
    "base_composition",
    f"""SELECT base, CAST(count(*) AS BIGINT) AS n FROM
    (SELECT unnest(string_split(seq, '')) AS base FROM (SELECT {codec.encode_sql("text")} AS seq FROM documents) WHERE length(seq) > 0) GROUP BY base""",
)
def base_composition(spark, sf_dir):
    """Counts by length differences, so that no base becomes a row."""
    one = refs(spark, sf_dir).select("seq")
    sums = one.agg(*[F.sum(F.length("seq") - F.length(F.replace(F.col("seq"), F.lit(b), F.lit("")))).cast("long").alias(b) for b in "ACGT"])
    rows = F.explode(F.array(*[F.struct(F.lit(b).alias("base"), F.col(b).alias("n")) for b in "ACGT"])).alias("x")
    return sums.select(rows).select("x.base", "x.n").where("n > 0")


@query("dna_codes", "SELECT item_id, translate(regexp_replace(text, '[^\\x01-\\x7F]', 'N', 'g'), '{a}', '{b}') AS seq FROM benchmark".replace("{a}", codec.ASCII.replace("'", "''")).replace("{b}", codec.ASCII_BASES))
def dna_codes(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", codec.encode(F.col("text"), "dna").alias("seq"))


@query("reverse_complement", f"SELECT item_id, reverse(translate({codec.encode_sql('text')}, 'ACGT', 'TGCA')) AS seq FROM benchmark")
def reverse_complement(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", codec.reverse_complement(codec.encode(F.col("text"))).alias("seq"))


def fasta_of(doc_id: Column, source: Column, text: Column) -> Column:
    """A record with odd spaces, a comment, blank lines and carriage returns, made of a document."""
    seq = codec.encode(text)
    return F.concat(F.lit("> d"), doc_id.cast("string"), F.lit(" from\t"), source, F.lit("  \r\n"), F.substring(seq, 1, 60), F.lit("\r\n\n"), F.substring(seq, F.lit(61), F.lit(1 << 30)), F.lit("\n"))


@query(
    "fasta_parse_text",
    f"""WITH t AS (SELECT doc_id, '> d' || doc_id || ' from' || chr(9) || source || '  ' || chr(13) || chr(10) || substr(s, 1, 60) || chr(13) || chr(10) || chr(10) || substr(s, 61) || chr(10) AS r
      FROM (SELECT doc_id, source, {codec.encode_sql("text")} AS s FROM documents)),
    h AS (SELECT doc_id, ltrim(substr(r, 2, instr(r, chr(10)) - 2), ' ') AS head, substr(r, instr(r, chr(10)) + 1) AS body FROM t)
    SELECT doc_id, regexp_extract(head, '^[^ ]*') AS name, rtrim(replace(replace(substr(head, instr(head, ' ') + 1), chr(13), ''), chr(9), ' '), ' ') AS comment,
      CAST(length(regexp_replace(body, '[\\r\\n]', '', 'g')) AS BIGINT) AS len, md5(regexp_replace(body, '[\\r\\n]', '', 'g')) AS seq_md5 FROM h""",
)
def fasta_parse_text(spark, sf_dir):
    """Parses records held in a string column: name, comment with tabs as spaces, sequence without line ends."""
    d = table(spark, sf_dir, "documents")
    r = d.select("doc_id", fasta_of(F.col("doc_id"), F.col("source"), F.col("text")).alias("r"))
    head = F.ltrim(F.expr("substr(r, 2, instr(r, '\n') - 2)"))
    h = r.select("doc_id", head.alias("head"), F.expr("substr(r, instr(r, '\n') + 1)").alias("body"))
    seq = F.regexp_replace("body", "[\r\n]", "")
    comment = F.rtrim(F.translate(F.replace(F.expr("substr(head, instr(head, ' ') + 1)"), F.lit("\r"), F.lit("")), "\t", " "))
    return h.select("doc_id", F.regexp_extract("head", "^[^ ]*", 0).alias("name"), comment.alias("comment"), F.length(seq).cast("long").alias("len"), F.md5(seq.cast("binary")).alias("seq_md5"))


@query("tag_filter", "SELECT event_id, event_type, regexp_extract(props, '\"(\\w+)\": *(\\d+)', 1) AS tag, CAST(regexp_extract(props, '\"(\\w+)\": *(\\d+)', 2) AS BIGINT) AS value FROM events WHERE regexp_extract(props, '\"(\\w+)\": *(\\d+)', 1) IN ('k', 'CO') AND event_type IN ('error', 'purchase')")
def tag_filter(spark, sf_dir):
    """Tags of a record as a map, of which the requested ones are kept."""
    e = table(spark, sf_dir, "events").where(F.col("event_type").isin("error", "purchase"))
    pattern = '"(\\w+)": *(\\d+)'
    tags = F.map_filter(F.create_map(F.regexp_extract("props", pattern, 1), F.regexp_extract("props", pattern, 2)), lambda k, _: F.array_contains(F.array(F.lit("k"), F.lit("CO")), k))
    return e.select("event_id", "event_type", F.explode(tags).alias("tag", "value")).withColumn("value", F.col("value").cast("long"))


@query("min_length_filter", f"SELECT doc_id, CAST(length({codec.encode_sql('text')}) AS INTEGER) AS len FROM documents WHERE length({codec.encode_sql('text')}) >= 500")
def min_length_filter(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.length(codec.encode(F.col("text"))).alias("len")).where("len >= 500")


@query("sequence_count", "SELECT CAST(count(*) AS BIGINT) AS n_seq, CAST(sum(length(seq)) AS BIGINT) AS n_bases FROM (" + DOCS + ")")
def sequence_count(spark, sf_dir):
    return refs(spark, sf_dir).agg(F.count("*").alias("n_seq"), F.sum(F.length("seq")).cast("long").alias("n_bases"))


@query("labelled_documents", "SELECT d.doc_id, d.source FROM documents d SEMI JOIN (SELECT doc_id FROM labels WHERE quality = 1) l ON d.doc_id = l.doc_id")
def labelled_documents(spark, sf_dir):
    """A name set as a semi join."""
    return table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels").where("quality = 1"), "doc_id", "left_semi")


@query("circular_membership", "SELECT doc_id, source, source IN ('src1', 'src3') AS circular FROM documents")
def circular_membership(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumn("name", F.col("source"))
    return ix.with_circular(d, ("src1", "src3")).select("doc_id", "source", "circular")


# sketches


@query("kmers_both_strands", f"WITH {sql.kmers('q', ITEMS, K)} SELECT id AS item_id, pos, fw, rv FROM q")
def kmers_both_strands(spark, sf_dir):
    return sketch.all_kmers(items(spark, sf_dir), "qid", K).select(F.col("qid").alias("item_id"), "pos", "fw", "rv")


@query("canonical_hash", f"WITH {sql.kmers('q', ITEMS, K)} SELECT id AS item_id, pos, hash, strand FROM q")
def canonical_hash(spark, sf_dir):
    return sketch.all_kmers(items(spark, sf_dir), "qid", K).select(F.col("qid").alias("item_id"), "pos", "hash", "strand")


@query("minimizers", f"WITH {sql.minimizers('q', ITEMS, K, W)} SELECT id AS item_id, hash, pos, strand FROM q")
def minimizers(spark, sf_dir):
    return item_minimizers(spark, sf_dir).withColumnRenamed("qid", "item_id")


RING = f"SELECT id, seq || substr(seq, 1, least(length(seq), {W})) AS seq, length(seq) AS own FROM ({ITEMS})"


@query("minimizers_circular", f"WITH {sql.minimizers('q', RING, K, W, turn=f'own - {K} + 1')} SELECT id AS item_id, hash, pos, strand FROM q")
def minimizers_circular(spark, sf_dir):
    ring = items(spark, sf_dir).withColumn("circular", F.lit(True))
    return sketch.sketch(ring, "qid", K, W, circular="circular").withColumnRenamed("qid", "item_id")


@query(
    "minimizer_density",
    f"WITH {sql.minimizers('d', DOCS, K, W)}, n AS (SELECT id, count(*) AS n FROM d GROUP BY id) SELECT id AS doc_id, CAST(length(seq) AS INTEGER) AS len, CAST(coalesce(n, 0) AS BIGINT) AS n_minimizers FROM ({DOCS}) x LEFT JOIN n USING (id)",
)
def minimizer_density(spark, sf_dir):
    r = refs(spark, sf_dir)
    n = sketch.sketch(r, "rid", K, W).groupBy("rid").agg(F.count("*").alias("n"))
    return r.select("rid", F.length("seq").alias("len")).join(n, "rid", "left").select(F.col("rid").alias("doc_id"), "len", F.coalesce("n", F.lit(0)).cast("long").alias("n_minimizers"))


# index


@query("index_counts", f"WITH {INDEX} SELECT hash, CAST(n AS BIGINT) AS n FROM d_n")
def index_counts(spark, sf_dir):
    return ix.counts(ref_minimizers(spark, sf_dir))


@query("index_singletons", f"WITH {INDEX} SELECT CAST(count(*) AS BIGINT) AS n_keys, CAST(count(*) FILTER (n = 1) AS BIGINT) AS n_single, CAST(sum(n) AS BIGINT) AS n_minimizers, CAST(max(n) AS BIGINT) AS most FROM d_n")
def index_singletons(spark, sf_dir):
    return ix.counts(ref_minimizers(spark, sf_dir)).agg(F.count("*").alias("n_keys"), F.count_if(F.col("n") == 1).alias("n_single"), F.sum("n").cast("long").alias("n_minimizers"), F.max("n").alias("most"))


@query("occ_thresholds", f"WITH {INDEX} SELECT frequency, occ FROM d_o")
def occ_thresholds(spark, sf_dir):
    """Thresholds as a plan: histogram, running sum, first count beyond the rank."""
    hist = ix.counts(ref_minimizers(spark, sf_dir)).groupBy("n").agg(F.count("*").alias("keys"))
    import numpy as np

    at = F.sum("keys").over(Window.orderBy("n"))  # the histogram alone: a few hundred rows
    ranked = hist.withColumn("cum", at).withColumn("total", F.sum("keys").over(Window.partitionBy(F.lit(1))))
    one = F.explode(F.array(*[F.struct(F.lit(f).alias("frequency"), F.lit(float(np.float32(f))).alias("single")) for f in FREQUENCIES])).alias("f")
    rank = F.least(F.floor((F.lit(1.0) - F.col("f.single")) * F.col("total")), F.col("total") - 1)
    return ranked.select("*", one).where(F.col("cum") > rank).groupBy("f.frequency").agg((F.min("n") + 1).alias("occ"))


@query("index_filtered", f"WITH {INDEX} SELECT hash, id AS rid, pos, strand, CAST(n AS INTEGER) AS n FROM d")
def index_filtered(spark, sf_dir):
    r = refs(spark, sf_dir).withColumn("name", F.col("rid").cast("string"))
    return ix.build_index(r, P).seeds


# seeds


SEED_COLUMNS = "qid, rid, rpos, qpos, CAST(n AS BIGINT) AS n"


@query("seed_join", f"WITH {SEEDS} SELECT {SEED_COLUMNS} FROM s WHERE round IS NOT NULL")
def seed_join(spark, sf_dir):
    return seeded(spark, sf_dir).select("qid", "rid", "rpos", "qpos", "n")


@query("seed_rounds", f"WITH {SEEDS} SELECT qid, round, CAST(count(*) AS BIGINT) AS n_seeds FROM s WHERE round IS NOT NULL GROUP BY qid, round")
def seed_rounds(spark, sf_dir):
    return seeded(spark, sf_dir).groupBy("qid", "round").agg(F.count("*").alias("n_seeds"))


@query("seed_uv_transform", f"WITH {SEEDS} SELECT qid, rid, u, v, CAST((2 * u + v) // 3 AS BIGINT) AS r, CASE WHEN (2 * v + u) >= 0 THEN (2 * v + u) // 3 ELSE -((-(2 * v + u)) // 3) END AS q FROM s WHERE round IS NOT NULL")
def seed_uv_transform(spark, sf_dir):
    r, q = seeds.positions(F.col("u"), F.col("v"))
    return seeded(spark, sf_dir).select("qid", "rid", "u", "v", r.alias("r"), q.alias("q"))


@query("seed_sorted_rank", f"WITH {SEEDS} SELECT qid, rid, u, v, CAST(row_number() OVER (PARTITION BY qid ORDER BY rid, u, v) AS INTEGER) AS rank FROM s WHERE round IS NOT NULL")
def seed_sorted_rank(spark, sf_dir):
    order = Window.partitionBy("qid").orderBy("rid", "u", "v")
    return seeded(spark, sf_dir).select("qid", "rid", "u", "v", F.row_number().over(order).alias("rank"))


BINS = f"""{SEEDS},
b AS (SELECT qid, rid, CAST(qpos < 0 AS INTEGER) AS strand, CAST(floor((rpos - qpos) / {float(BIN)}) AS BIGINT) AS bin, count(*) AS n_seeds,
  min(rpos) AS r0, max(rpos) AS r1, min(CASE WHEN qpos < 0 THEN -qpos - 1 - {K} ELSE qpos END) AS q0, max(CASE WHEN qpos < 0 THEN -qpos - 1 ELSE qpos + {K} END) AS q1
  FROM s WHERE round IS NOT NULL GROUP BY ALL)"""


@query("diagonal_bins", f"WITH {BINS} SELECT qid, rid, strand, bin, CAST(n_seeds AS BIGINT) AS n_seeds FROM b")
def diagonal_bins(spark, sf_dir):
    return seeds.diagonal_bins(seeded(spark, sf_dir), BIN)


@query(
    "chainable_pairs",
    f"""WITH {SEEDS}, c AS (SELECT * FROM s WHERE round IS NOT NULL)
    SELECT a.qid, a.rid, a.u AS u0, a.v AS v0, b.u AS u1, b.v AS v1 FROM c a JOIN c b ON a.qid = b.qid AND a.rid = b.rid AND b.v > a.v AND b.v <= a.v + 50 AND b.u >= a.u AND b.u <= a.u + 50""",
)
def chainable_pairs(spark, sf_dir):
    """The chaining window as a range join: u is cut into cells as wide as the window, and a seed meets its cell and the next."""
    s = seeded(spark, sf_dir).select("qid", "rid", "u", "v").withColumn("cell", F.floor(F.col("u") / 50))
    a = s.select("qid", "rid", F.col("u").alias("u0"), F.col("v").alias("v0"), F.explode(F.array("cell", F.col("cell") + 1)).alias("cell"))
    b = s.select("qid", "rid", F.col("u").alias("u1"), F.col("v").alias("v1"), "cell")
    inside = (F.col("v1") > F.col("v0")) & (F.col("v1") <= F.col("v0") + 50) & (F.col("u1") >= F.col("u0")) & (F.col("u1") <= F.col("u0") + 50)
    return a.join(b, ["qid", "rid", "cell"]).where(inside).drop("cell")


AVA = f"""{INDEX},
{sql.seeds("s", "d_m", "d", K, extra="WHERE r.id > q.id")}"""


@query("self_overlap_ava", f"WITH {AVA} SELECT qid, rid, CAST(count(*) AS BIGINT) AS n_seeds FROM s WHERE round IS NOT NULL GROUP BY qid, rid HAVING count(*) >= 20")
def self_overlap_ava(spark, sf_dir):
    """Documents against themselves, rid > qid: rare minimizers only, so a hash makes at most its threshold's pairs squared."""
    mini = ref_minimizers(spark, sf_dir)
    table_ = ix.counts(mini).persist()
    occ = ix.thresholds(table_, FREQUENCIES)
    kept = mini.join(table_.where((F.col("n") > 1) & (F.col("n") <= occ[-1])), "hash")
    pairs = seeds.join_seeds(kept.withColumnRenamed("rid", "qid").drop("n"), kept, occ, K, lower_triangle=True)
    return pairs.groupBy("qid", "rid").agg(F.count("*").alias("n_seeds")).where("n_seeds >= 20")


@query("unmapped_items", f"WITH {SEEDS} SELECT item_id, CAST(length(text) AS INTEGER) AS n_chars FROM benchmark WHERE item_id NOT IN (SELECT qid FROM s WHERE round IS NOT NULL)")
def unmapped_items(spark, sf_dir):
    s = seeded(spark, sf_dir).select(F.col("qid").alias("item_id")).distinct()
    return table(spark, sf_dir, "benchmark").select("item_id", F.length("text").alias("n_chars")).join(s, "item_id", "left_anti")


# ranking


def binned(spark, sf_dir) -> DataFrame:
    """Bins with their extent, ranked in their item by the number of seeds."""
    s = seeded(spark, sf_dir).withColumn("strand", (F.col("qpos") < 0).cast("int"))
    q0 = F.when(F.col("qpos") < 0, F.bitwise_not("qpos") - K).otherwise(F.col("qpos"))
    bins = s.groupBy("qid", "rid", "strand", F.floor((F.col("rpos") - F.col("qpos")) / float(BIN)).cast("long").alias("bin")).agg(
        F.count("*").alias("n_seeds"), F.min("rpos").alias("r0"), F.max("rpos").alias("r1"), F.min(q0).alias("q0"), F.max(q0 + K).alias("q1")
    )
    return ranking.ranked(bins, "qid", "n_seeds", ["rid", "strand", "bin"])


RANKED = f"""{BINS},
k AS (SELECT *, row_number() OVER o - 1 AS aid, coalesce(nth_value(n_seeds, 2) OVER (PARTITION BY qid ORDER BY n_seeds DESC, rid, strand, bin ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), 0) AS xs,
  max(n_seeds) OVER (PARTITION BY qid) AS best FROM b WINDOW o AS (PARTITION BY qid ORDER BY n_seeds DESC, rid, strand, bin))"""


@query("top_hit_per_item", f"WITH {RANKED} SELECT qid, rid, strand, bin, CAST(n_seeds AS BIGINT) AS n_seeds, CAST(xs AS BIGINT) AS xs FROM k WHERE aid = 0")
def top_hit_per_item(spark, sf_dir):
    return binned(spark, sf_dir).where("aid = 0").select("qid", "rid", "strand", "bin", "n_seeds", "xs")


@query("prune_by_ratio", f"WITH {RANKED} SELECT qid, rid, strand, bin, CAST(n_seeds AS BIGINT) AS n_seeds FROM k WHERE n_seeds >= floor(best * {P.min_ratio!r}::DOUBLE)")
def prune_by_ratio(spark, sf_dir):
    return ranking.pruned(binned(spark, sf_dir), "qid", "n_seeds", P.min_ratio).select("qid", "rid", "strand", "bin", "n_seeds")


@query(
    "mapq_formula",
    f"""WITH {RANKED}, e AS (SELECT *, 2.0::DOUBLE / ((0.5 + n_seeds / 100.0::DOUBLE) * 2.0 - 1.0 + 0.1) * greatest(n_seeds - xs, 0) AS len FROM k WHERE aid = 0)
    SELECT qid, CAST(least(greatest(floor(-160.0 * log10(1.0 / (len * len + 1.0))), 0), 960) AS INTEGER) AS mapq16 FROM e""",
)
def mapq_formula(spark, sf_dir):
    share = F.lit(0.5) + F.col("n_seeds") / F.lit(100.0) + F.lit(0.05)
    return binned(spark, sf_dir).where("aid = 0").select("qid", ranking.quality(F.col("n_seeds"), F.col("xs"), share, 1.0).alias("mapq16"))


# stand-in alignments of the bins, for the formats


def hits(spark, sf_dir) -> DataFrame:
    """The bins as alignment rows: matches by seeds, no gaps, quality by the margin of seeds."""
    b = binned(spark, sf_dir)
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.concat(F.lit("item"), F.col("item_id")).alias("qname"), codec.encode(F.col("text")).alias("qseq")).withColumn("qlen", F.length("qseq"))
    r = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("rid"), F.concat(F.lit("doc"), F.col("doc_id")).alias("rname"), F.length(codec.encode(F.col("text"))).alias("rlen"))
    d = F.least(F.col("r1") - F.col("r0") + K, F.col("q1") - F.col("q0"))
    out = b.join(q, "qid").join(r, "rid").withColumn("dcnt", d).withColumn("identity", F.least(F.lit(1.0), F.col("n_seeds") * F.lit(2.0) * F.lit(float(W)) / F.col("dcnt") / F.lit(2.0)))
    out = out.withColumn("gaps", F.abs((F.col("r1") - F.col("r0") + K) - (F.col("q1") - F.col("q0"))))
    one = F.col("strand") == 1  # on the reverse strand the reference position is that of the k-mer's end
    out = out.withColumn("rs", F.when(one, F.col("r0") - 0).otherwise(F.col("r0"))).withColumn("re", F.col("r1") + K)
    out = out.withColumn("qs", F.col("q0")).withColumn("qe", F.col("q1")).withColumn("score", F.col("n_seeds")).withColumn("is_uniq", F.col("aid") == 0)
    return out.withColumn("mapq16", F.when(F.col("aid") == 0, F.least(F.lit(960), 16 * (F.col("n_seeds") - F.col("xs")))).otherwise(0).cast("int"))


HITS = f"""{RANKED},
i AS (SELECT id AS qid, 'item' || id AS qname, seq AS qseq, length(seq) AS qlen FROM ({ITEMS})),
j AS (SELECT id AS rid, 'doc' || id AS rname, length(seq) AS rlen FROM ({DOCS})),
g AS (SELECT *, least(r1 - r0 + {K}, q1 - q0) AS dcnt, abs((r1 - r0 + {K}) - (q1 - q0)) AS gaps FROM k),
h AS (SELECT *, least(1.0::DOUBLE, n_seeds * 2.0::DOUBLE * {float(W)}::DOUBLE / dcnt / 2.0::DOUBLE) AS identity, r0 AS rs, r1 + {K} AS re, q0 AS qs, q1 AS qe,
  CASE WHEN aid = 0 THEN least(960, 16 * (n_seeds - xs)) ELSE 0 END AS mapq16 FROM g JOIN i USING (qid) JOIN j USING (rid))"""
MATCHES = "CAST(floor(dcnt * identity) AS BIGINT)"


@query(
    "paf_lines",
    f"""WITH {HITS} SELECT qid, CAST(aid AS INTEGER) AS aid, concat_ws(chr(9), qname, qlen, qs, qe, CASE strand WHEN 1 THEN '-' ELSE '+' END, rname, rlen, rs, re, {MATCHES}, dcnt + gaps, mapq16 // 16,
    'AS:i:' || n_seeds, 'NM:i:' || (CAST(floor(dcnt * (1.0::DOUBLE - identity)) AS BIGINT) + gaps)) AS line FROM h""",
)
def paf_lines(spark, sf_dir):
    return hits(spark, sf_dir).select("qid", "aid", formats.paf(MapParams(tags=("AS", "NM"))).alias("line"))


@query(
    "blast6_lines",
    f"""WITH {HITS}, x AS (SELECT *, 1.85::DOUBLE * n_seeds - 0.02::DOUBLE AS bit, CAST(floor(identity * 1000) AS BIGINT) AS mid FROM h),
    y AS (SELECT *, CAST(floor(1000.0::DOUBLE * rlen * qlen * pow(2.0::DOUBLE, -bit)) AS BIGINT) AS ev FROM x)
    SELECT qid, CAST(aid AS INTEGER) AS aid, concat_ws(chr(9), qname, rname, (mid // 1000) || '.' || lpad(CAST(mid % 1000 AS VARCHAR), 3, '0'), dcnt + gaps, dcnt - {MATCHES}, gaps, qs + 1, qe,
    CASE strand WHEN 1 THEN re ELSE rs + 1 END, CASE strand WHEN 1 THEN rs + 1 ELSE re END, (ev // 1000) || '.' || lpad(CAST(ev % 1000 AS VARCHAR), 3, '0'), CAST(floor(bit) AS BIGINT)) AS line FROM y""",
)
def blast6_lines(spark, sf_dir):
    return hits(spark, sf_dir).select("qid", "aid", formats.blast6().alias("line"))


@query(
    "sam_header",
    f"""SELECT CAST(-1 AS BIGINT) AS ordinal, '@HD' || chr(9) || 'VN:1.0' || chr(9) || 'SO:unsorted' AS line
    UNION ALL SELECT id, '@SQ' || chr(9) || 'SN:doc' || id || chr(9) || 'LN:' || length(seq) FROM ({DOCS})
    UNION ALL SELECT {(1 << 62) - 1}, '@RG' || chr(9) || 'ID:1' UNION ALL SELECT {1 << 62}, '@PG' || chr(9) || 'ID:helixmap' || chr(9) || 'PN:helixmap'""",
)
def sam_header(spark, sf_dir):
    r = refs(spark, sf_dir).select("rid", F.concat(F.lit("doc"), F.col("rid")).alias("name"), F.length("seq").alias("len"))
    return formats.sam_header(r, MapParams(tags=("RG",)))


@query("sam_flags", f"WITH {RANKED} SELECT qid, CAST(aid AS INTEGER) AS aid, CAST((CASE WHEN aid = 0 THEN 0 WHEN 2 * n_seeds >= best THEN 2048 ELSE 256 END) + 16 * strand AS INTEGER) AS flag FROM k")
def sam_flags(spark, sf_dir):
    best = F.max("n_seeds").over(Window.partitionBy("qid"))
    return binned(spark, sf_dir).withColumn("is_uniq", 2 * F.col("n_seeds") >= best).select("qid", "aid", formats.flags().alias("flag"))


@query("sam_unmapped", f"WITH {SEEDS} SELECT id AS qid, concat_ws(chr(9), 'item' || id, 4, '*', 0, 0, '*', '*', 0, 0, seq, '*') AS line FROM ({ITEMS}) WHERE id NOT IN (SELECT qid FROM s WHERE round IS NOT NULL)")
def sam_unmapped(spark, sf_dir):
    mapped = seeded(spark, sf_dir).select("qid").distinct()
    q = items(spark, sf_dir).join(mapped, "qid", "left_anti").select("qid", F.concat(F.lit("item"), F.col("qid")).alias("qname"), F.col("seq").alias("qseq"), F.lit(None).cast("string").alias("qual"))
    return q.select("qid", formats.sam_unmapped(MapParams()).alias("line"))


# formulas on stand-in counts


@query(
    "identity_formula",
    """SELECT l_orderkey, l_linenumber, round(((l_quantity * 2 - l_tax * 100 + l_discount * 100) / (l_quantity + 10) + 3.0) / 5.0, 9) AS identity FROM lineitem""",
)
def identity_formula(spark, sf_dir):
    score = F.col("l_quantity") * 2 - F.col("l_tax") * 100
    x = ranking.identity_estimate(score, F.col("l_discount") * 100, F.col("l_quantity") + 10, 2.0, 3.0)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(x, 9).alias("identity"))


@query("nm_formula", "SELECT l_orderkey, l_linenumber, CAST(floor(l_quantity * (1.0::DOUBLE - l_discount)) AS BIGINT) + CAST(l_linenumber AS BIGINT) AS nm FROM lineitem")
def nm_formula(spark, sf_dir):
    nm = ranking.edit_distance(F.col("l_quantity"), F.col("l_discount"), F.col("l_linenumber").cast("long"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", nm.alias("nm"))


@query("length_weighted_identity", "SELECT l_orderkey, round(sum(l_quantity * l_discount) / sum(l_quantity) + 1e-10::DOUBLE, 8) AS identity, round(1 - exp(sum(ln(1 - l_tax))) + 1e-10::DOUBLE, 8) AS combined_error, CAST(count(*) AS BIGINT) AS n_aln FROM lineitem GROUP BY l_orderkey")
def length_weighted_identity(spark, sf_dir):
    """Aggregates of an alignment set: identity weighted by length, combined error, number of alignments.

    A small offset keeps exact halves from rounding by the order of the sum.
    """
    d = table(spark, sf_dir, "lineitem").groupBy("l_orderkey")
    return d.agg(F.round(F.sum(F.col("l_quantity") * F.col("l_discount")) / F.sum("l_quantity") + 1e-10, 8).alias("identity"), F.round(ranking.combined_error(F.col("l_tax")) + 1e-10, 8).alias("combined_error"), F.count("*").alias("n_aln"))


PARAMS = MapParams(k=15, w=10, codec="text2bit", scoring=Scoring(match=2, mismatch=4, gi=4, ge=2, xdrop=50), min_score=50)


# kernels: no SQL, tests hold them against plain versions


def _index(spark, sf_dir) -> ix.Index:
    r = refs(spark, sf_dir).withColumn("name", F.concat(F.lit("doc"), F.col("rid")))
    return ix.build_index(r, PARAMS)


def _queries(spark, sf_dir) -> DataFrame:
    return items(spark, sf_dir).withColumn("name", F.concat(F.lit("item"), F.col("qid")))


@query("chains")
def chains(spark, sf_dir):
    from helixmap.operators.chains import chain_seeds

    return chain_seeds(seeded(spark, sf_dir), len(FREQUENCIES), PARAMS.window)


@query("alignments")
def alignments(spark, sf_dir):
    from helixmap.operators.mapping import map_queries

    return map_queries(_queries(spark, sf_dir), _index(spark, sf_dir))


def _lines(spark, sf_dir, params: MapParams) -> DataFrame:
    from helixmap.operators.mapping import described, map_queries

    from dataclasses import replace

    index, q = _index(spark, sf_dir), _queries(spark, sf_dir)
    rows = described(map_queries(q, index, replace(PARAMS, format=params.format)), q, index)
    return formats.lines_of(rows, params, q)


@query("sam_records")
def sam_records(spark, sf_dir):
    return _lines(spark, sf_dir, MapParams(tags=("AS", "NM", "XS", "SA", "MD", "NH", "IH")))


@query("maf_records")
def maf_records(spark, sf_dir):
    return _lines(spark, sf_dir, MapParams(format="maf"))


@query("paf_records")
def paf_records(spark, sf_dir):
    return _lines(spark, sf_dir, MapParams(format="paf", tags=("AS", "ID", "NM", "CG")))


# the whole way from seeds to text, where SQL can say what must come out: items that lie in a document base by base

OCCURRENCES = f"""i AS ({ITEMS}), j AS ({DOCS}),
o AS (SELECT i.id AS qid, j.id AS rid, 0 AS strand, i.seq AS qseq, i.seq AS hit, j.seq AS rseq FROM i JOIN j ON contains(j.seq, i.seq)
  UNION ALL SELECT qid, rid, 1, qseq, hit, rseq FROM (SELECT i.id AS qid, j.id AS rid, i.seq AS qseq, translate(reverse(i.seq), 'ACGT', 'TGCA') AS hit, j.seq AS rseq FROM i, j) WHERE contains(rseq, hit)),
p AS (SELECT *, unnest(range(length(rseq) - length(qseq) + 1)) AS rs FROM o WHERE length(qseq) * {PARAMS.scoring.match} >= {PARAMS.min_score}),
x AS (SELECT *, length(qseq) AS n, 'item' || qid AS qname, 'doc' || rid AS rname, length(rseq) AS rlen, length(qseq) * {PARAMS.scoring.match} AS score FROM p WHERE substr(rseq, CAST(rs + 1 AS BIGINT), length(qseq)) = hit)"""


def _exact(spark, sf_dir, params: MapParams) -> DataFrame:
    """Alignments of whole items without a mismatch or gap: each place where an item lies in a document, on either strand."""
    from helixmap.operators.mapping import described, map_queries

    index, q = _index(spark, sf_dir), _queries(spark, sf_dir)
    rows = described(map_queries(q, index, params), q, index)
    return rows.where("matches = dcnt and dcnt = qlen and gaps = 0")


@query("exact_alignments", f"WITH {OCCURRENCES} SELECT qid, rid, CAST(strand AS INTEGER) AS strand, CAST(rs AS BIGINT) AS rs, CAST(rs + n AS BIGINT) AS re, 0::BIGINT AS qs, CAST(n AS BIGINT) AS qe, CAST(score AS BIGINT) AS score, 1.0::DOUBLE AS identity, n || 'M' AS cigar, CAST(n AS VARCHAR) AS md FROM x")
def exact_alignments(spark, sf_dir):
    return _exact(spark, sf_dir, PARAMS).select("qid", "rid", "strand", "rs", "re", "qs", "qe", "score", "identity", formats.cigar_text(F.col("cigar")).alias("cigar"), "md")


def _without(line: str, *fields: int) -> Column:
    """A line without some of its fields, which depend on what else was found."""
    cells = F.split(line, "\t")
    return F.concat_ws("\t", F.filter(cells, lambda _, i: ~i.isin(*fields))).alias(line)


@query("exact_sam", f"WITH {OCCURRENCES} SELECT concat_ws(chr(9), qname, rname, CAST(rs + 1 AS VARCHAR), n || 'M', '*', '0', '0', hit, '*', 'AS:i:' || score, 'NM:i:0', 'MD:Z:' || n) AS line FROM x")
def exact_sam(spark, sf_dir):
    """SAM lines of exact alignments, without flag and quality."""
    return formats.lines_of(_exact(spark, sf_dir, PARAMS), MapParams(tags=("AS", "NM", "MD"))).select(_without("line", 1, 4))


@query("exact_paf", f"WITH {OCCURRENCES} SELECT concat_ws(chr(9), qname, CAST(n AS VARCHAR), '0', CAST(n AS VARCHAR), CASE strand WHEN 1 THEN '-' ELSE '+' END, rname, CAST(rlen AS VARCHAR), CAST(rs AS VARCHAR), CAST(rs + n AS VARCHAR), CAST(n AS VARCHAR), CAST(n AS VARCHAR), 'AS:i:' || score, 'ID:f:1.0000', 'NM:i:0', 'CG:Z:' || n || 'M') AS line FROM x")
def exact_paf(spark, sf_dir):
    """PAF lines of exact alignments, without quality."""
    return formats.lines_of(_exact(spark, sf_dir, PARAMS), MapParams(format="paf", tags=("AS", "ID", "NM", "CG"))).select(_without("line", 11))


@query("exact_maf", f"""WITH {OCCURRENCES} SELECT 'a score=' || score || chr(10) || 's ' || rpad(rname, CAST(greatest(length(rname), length(qname)) + 1 AS INTEGER), ' ') || lpad(CAST(rs AS VARCHAR), CAST(greatest(length(CAST(rs AS VARCHAR)), 1) AS INTEGER), ' ') || ' ' || n || ' + ' || lpad(CAST(rlen AS VARCHAR), CAST(greatest(length(CAST(rlen AS VARCHAR)), length(CAST(n AS VARCHAR))) AS INTEGER), ' ') || ' ' || hit || chr(10)
  || 's ' || rpad(qname, CAST(greatest(length(rname), length(qname)) + 1 AS INTEGER), ' ') || lpad('0', CAST(greatest(length(CAST(rs AS VARCHAR)), 1) AS INTEGER), ' ') || ' ' || n || CASE strand WHEN 1 THEN ' - ' ELSE ' + ' END || lpad(CAST(n AS VARCHAR), CAST(greatest(length(CAST(rlen AS VARCHAR)), length(CAST(n AS VARCHAR))) AS INTEGER), ' ') || ' ' || hit || chr(10) AS line FROM x""")
def exact_maf(spark, sf_dir):
    """MAF blocks of exact alignments."""
    from dataclasses import replace

    maf = replace(PARAMS, format="maf")
    return formats.lines_of(_exact(spark, sf_dir, maf), maf).select("line")


@query("primary_lines", "SELECT item_id AS qid, 1::BIGINT AS n_primary FROM benchmark")
def primary_lines(spark, sf_dir):
    """Every item has one line in SAM that is neither secondary nor supplementary, whether it is mapped or not."""
    from helixmap.operators.mapping import described, map_queries

    index, q = _index(spark, sf_dir), _queries(spark, sf_dir)
    lines = formats.lines_of(described(map_queries(q, index), q, index), MapParams(), q)
    flag = F.split("line", "\t")[1].cast("int")
    return lines.groupBy(F.col("ordinal").alias("qid")).agg(F.count_if(flag.bitwiseAND(formats.SECONDARY | formats.SUPPLEMENTARY) == 0).alias("n_primary"))


# files: written to the session's shared folder, read back by the sources


def _folder(spark: SparkSession, name: str) -> str:
    """A new path in ``spark.checkpoint.dir``; only in local mode may a session have none, and a temporary folder serves."""
    import re
    import tempfile
    import uuid

    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="helixmap-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


SCANNED = f"""SELECT 'd' || id AS name, CAST(length(seq) AS INTEGER) AS len, md5(seq) AS seq_md5, {{}} AS qual_len, 'kept' AS comment FROM ({DOCS}) WHERE length(seq) >= 100"""


def _scan(spark, path: str) -> DataFrame:
    from helixmap.sources.seqfile import read_sequences

    rows = read_sequences(spark, path, min_len=100, tags="CO")
    return rows.select("name", "len", F.md5(F.col("seq").cast("binary")).alias("seq_md5"), F.length("qual").alias("qual_len"), "comment")


@query("fasta_scan", SCANNED.format("CAST(0 AS INTEGER)"))
def fasta_scan(spark, sf_dir):
    """All documents as FASTA files with lines of seventy bases, read in byte ranges."""
    path = _folder(spark, "fasta")
    lines = F.regexp_replace("seq", "(.{70})", "$1\n")
    refs(spark, sf_dir).select(F.concat(F.lit(">d"), F.col("rid"), F.lit(" kept \n"), lines).alias("value")).write.text(path)
    return _scan(spark, path)


@query("fastq_scan", SCANNED.format("CAST(length(seq) AS INTEGER)"))
def fastq_scan(spark, sf_dir):
    """All documents as gzipped FASTQ files whose qualities begin with marks."""
    path = _folder(spark, "fastq")
    qual = F.expr("concat(substr('@+', 1, length(seq)), repeat('I', greatest(length(seq) - 2, 0)))")
    refs(spark, sf_dir).where("length(seq) > 0").select(F.concat(F.lit("@d"), F.col("rid"), F.lit(" kept\n"), F.col("seq"), F.lit("\n+\n"), qual).alias("value")).write.option("compression", "gzip").text(path)
    return _scan(spark, path)


@query("index_stored", f"WITH {INDEX} SELECT hash % 64 AS part, CAST(count(*) AS BIGINT) AS n_seeds, CAST(sum(pos) AS BIGINT) AS positions, CAST(max(n) AS INTEGER) AS most FROM d GROUP BY part")
def index_stored(spark, sf_dir):
    """The index written as tables, dealt by ranges of the hash, and read back."""
    path = _folder(spark, "index")
    r = refs(spark, sf_dir).withColumn("name", F.col("rid").cast("string"))
    ix.build_index(r, P).write(path)
    return ix.read_index(spark, path, P).seeds.groupBy((F.col("hash") % 64).alias("part")).agg(F.count("*").alias("n_seeds"), F.sum("pos").cast("long").alias("positions"), F.max("n").alias("most"))


@query("retained_counts", f"WITH {INDEX} SELECT CAST(i AS INTEGER) AS round, occ, CAST((SELECT count(*) FROM d_n WHERE n <= occ) AS BIGINT) AS n_keys FROM d_o")
def retained_counts(spark, sf_dir):
    """Keys that each round may use."""
    table_ = ix.counts(ref_minimizers(spark, sf_dir)).persist()
    occ = ix.thresholds(table_, FREQUENCIES)
    sums = table_.agg(*[F.count_if(F.col("n") <= x).alias(f"k{i}") for i, x in enumerate(occ)])
    rows = F.explode(F.array(*[F.struct(F.lit(i).alias("round"), F.lit(x).cast("long").alias("occ"), F.col(f"k{i}").alias("n_keys")) for i, x in enumerate(occ)])).alias("x")
    return sums.select(rows).select("x.*")


@query("seed_extent", f"WITH {SEEDS} SELECT qid, rid, CAST(min(rpos) AS BIGINT) AS lb, CAST(max(rpos) AS BIGINT) AS ub, CAST(count(*) AS BIGINT) AS n, CAST(floor((1 - 1.0::DOUBLE / count(*)) * (max(u + v) - min(u + v))) AS BIGINT) AS plen FROM s WHERE round IS NOT NULL GROUP BY qid, rid")
def seed_extent(spark, sf_dir):
    """Bounds, number and length, by the formula of chains, of a pair's seeds."""
    span = F.max(F.col("u") + F.col("v")) - F.min(F.col("u") + F.col("v"))
    return seeded(spark, sf_dir).groupBy("qid", "rid").agg(F.min("rpos").alias("lb"), F.max("rpos").alias("ub"), F.count("*").alias("n"), F.floor((1 - F.lit(1.0) / F.count("*")) * span).cast("long").alias("plen"))


@query("secondary_scores", f"WITH {RANKED} SELECT qid, CAST(coalesce(max(n_seeds) FILTER (WHERE aid > 0), 0) AS BIGINT) AS usc, CAST(coalesce(min(n_seeds) FILTER (WHERE aid > 0), 0) AS BIGINT) AS lsc, CAST(coalesce(sum(n_seeds) FILTER (WHERE aid > 0), 0) AS BIGINT) AS tsc FROM k GROUP BY qid")
def secondary_scores(spark, sf_dir):
    """Of each item the greatest, least and summed score of all hits but the best."""
    return ranking.secondary_scores(binned(spark, sf_dir).withColumn("is_uniq", F.col("aid") == 0), "qid", "n_seeds")


@query("all_vs_all_quality", f"WITH {RANKED} SELECT qid, CAST(aid AS INTEGER) AS aid, CAST(least(greatest(floor(-160.0 * log10(1.0 / (greatest(n_seeds - xs, 0) + 1.0::DOUBLE))), 0), 960) AS INTEGER) AS mapq16 FROM k WHERE aid = 0")
def all_vs_all_quality(spark, sf_dir):
    """The quality of table-against-itself mapping: the margin is not squared."""
    margin = F.greatest(F.col("n_seeds") - F.col("xs"), F.lit(0))
    return binned(spark, sf_dir).where("aid = 0").select("qid", "aid", ranking.quality_all_vs_all(margin).alias("mapq16"))
