"""Text formats of alignments, as column expressions.

An alignment row has: qname, qlen, qseq, qual, rname, rlen, strand (1: reverse), rs, re, qs, qe (0-based, half open, on
the query's own strand), score, identity, dcnt (diagonals), gaps, cigar (array of op and len along the reference), aid (rank
in its query from 0), seg (its place in a set of several, from 0; left out where there is one), is_uniq, n_all, xs (second
score) and mapq16. Lines keep the order (ordinal, aid, seg) only where a sink sorts; expressions don't.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixmap.functions.codec import reverse_complement
from helixmap.operators.ranking import QUALITY_BITS, edit_distance
from helixmap.plans.params import MapParams

UNMAPPED, REVERSE, SECONDARY, SUPPLEMENTARY = 0x4, 0x10, 0x100, 0x800


def fixed(value: Column, digits: int) -> Column:
    """A whole number as a decimal fraction with so many digits."""
    n, one = value.cast("long"), 10**digits
    return F.concat(F.floor(n / one).cast("string"), F.lit("."), F.lpad((n % one).cast("string"), digits, "0"))


def matches() -> Column:
    return F.floor(F.col("dcnt") * F.col("identity")).cast("long")


def edits() -> Column:
    return edit_distance(F.col("dcnt"), F.col("identity"), F.col("gaps"))


def tab(*columns: Column) -> Column:
    return F.concat_ws("\t", *[c.cast("string") for c in columns])


def cigar_text(cigar: Column) -> Column:
    return F.array_join(F.transform(cigar, lambda x: F.concat(x["len"].cast("string"), x["op"])), "")


def paf(params: MapParams) -> Column:
    """One PAF line; query coordinates are those of the query's own strand."""
    strand = F.when(F.col("strand") == 1, "-").otherwise("+")
    line = [F.col("qname"), F.col("qlen"), F.col("qs"), F.col("qe"), strand, F.col("rname"), F.col("rlen"), F.col("rs"), F.col("re"), matches(), F.col("dcnt") + F.col("gaps"), F.shiftright("mapq16", QUALITY_BITS)]
    for tag in params.tags:
        if tag == "AS":
            line.append(F.concat(F.lit("AS:i:"), F.col("score")))
        elif tag == "ID":
            line.append(F.concat(F.lit("ID:f:"), fixed(F.floor(F.col("identity") * 10000), 4)))
        elif tag == "NM":
            line.append(F.concat(F.lit("NM:i:"), edits()))
        elif tag == "SQ":
            line.append(F.concat(F.lit("SQ:Z:"), F.col("qseq")))
        elif tag == "CG":
            line.append(F.concat(F.lit("CG:Z:"), cigar_text(F.col("cigar"))))
    return tab(*line)


def blast6() -> Column:
    """One line of BLAST's table: 1-based ends, reference ends swapped on the reverse strand, identity as 0.xxx."""
    bit = F.lit(1.85) * F.col("score") - F.lit(0.02)
    expect = F.floor(F.lit(1000.0) * F.col("rlen") * F.col("qlen") * F.pow(F.lit(2.0), -bit))
    first, last = F.col("rs") + 1, F.col("re")
    reverse = F.col("strand") == 1
    return tab(
        F.col("qname"), F.col("rname"), fixed(F.floor(F.col("identity") * 1000), 3), F.col("dcnt") + F.col("gaps"), F.col("dcnt") - matches(), F.col("gaps"),
        F.col("qs") + 1, F.col("qe"), F.when(reverse, last).otherwise(first), F.when(reverse, first).otherwise(last), fixed(expect, 3), F.floor(bit).cast("long"),
    )


def sam_header(refs: DataFrame, params: MapParams, command: str = "") -> DataFrame:
    """ordinal and line of the header: version, a line for each reference in order, read group, program."""
    spark = refs.sparkSession
    one = spark.range(1)
    head = one.select(F.lit(-1).cast("long").alias("ordinal"), F.lit("@HD\tVN:1.0\tSO:unsorted").alias("line"))
    names = refs.select(F.col("rid").cast("long").alias("ordinal"), F.concat(F.lit("@SQ\tSN:"), F.col("name"), F.lit("\tLN:"), F.col("len").cast("string")).alias("line"))
    last = F.lit((1 << 62)).cast("long")
    tail = one.select(last.alias("ordinal"), F.lit("@PG\tID:helixmap\tPN:helixmap" + (f"\tCL:{command}" if command else "")).alias("line"))
    out = head.unionByName(names)
    if params.read_group or "RG" in params.tags:
        group = params.read_group or "ID:1"
        out = out.unionByName(one.select((last - 1).alias("ordinal"), F.lit(f"@RG\t{group}").alias("line")))
    return out.unionByName(tail)


def read_group_id(params: MapParams) -> str:
    for part in (params.read_group or "ID:1").split("\t"):
        if part.startswith("ID:"):
            return part[3:]
    return "1"


def flags(seg: Column | None = None) -> Column:
    """0 for the first record of a query alone, supplementary for other unique ones, secondary after, and the strand.

    ``seg``: the place of a record in its set, if sets can have several.
    """
    first = (F.col("aid") == 0) & (F.lit(0) if seg is None else seg).eqNullSafe(F.lit(0))
    kind = F.when(first, 0).when(F.col("is_uniq"), SUPPLEMENTARY).otherwise(SECONDARY)
    return kind.bitwiseOR(F.when(F.col("strand") == 1, REVERSE).otherwise(0)).cast("int")


def sam_unmapped(params: MapParams) -> Column:
    """A line for a query without alignments: qname, qseq and qual (null: ``*``)."""
    line = [F.col("qname"), F.lit(UNMAPPED), F.lit("*"), F.lit(0), F.lit(0), F.lit("*"), F.lit("*"), F.lit(0), F.lit(0), F.col("qseq"), F.coalesce(F.nullif(F.col("qual"), F.lit("")), F.lit("*"))]
    return tab(*line)


def clipped_cigar(hard: Column) -> Column:
    """The path with what it leaves of the query at both ends; lengths are those along the reference's strand."""
    reverse = F.col("strand") == 1
    left, right = F.col("qs"), F.col("qlen") - F.col("qe")
    letter = F.when(hard, "H").otherwise("S")
    clip = lambda n: F.when(n > 0, F.concat(n.cast("string"), letter)).otherwise("")
    return F.concat(clip(F.when(reverse, right).otherwise(left)), cigar_text(F.col("cigar")), clip(F.when(reverse, left).otherwise(right)))


def sam(alignments: DataFrame, params: MapParams) -> DataFrame:
    """Adds ``line`` to alignments; queries without any are not among them (see ``sam_unmapped``).

    With tag SA, supplementary records are told by the first one and not printed themselves.
    """
    seg = F.col("seg") if "seg" in alignments.columns else F.lit(0)
    first = (F.col("aid") == 0) & (seg == 0)
    flag = flags(seg)
    hard = flag.bitwiseAND(SECONDARY | SUPPLEMENTARY) != 0
    reverse = F.col("strand") == 1
    start = F.when(hard, F.col("qs")).otherwise(0)
    size = F.when(hard, F.col("qe") - F.col("qs")).otherwise(F.col("qlen"))
    seq, qual = F.substring(F.col("qseq"), start + 1, size), F.substring(F.col("qual"), start + 1, size)
    seq = F.when(reverse, reverse_complement(seq)).otherwise(seq)
    qual = F.coalesce(F.nullif(F.when(reverse, F.reverse(qual)).otherwise(qual), F.lit("")), F.lit("*"))
    line = [F.col("qname"), flag, F.col("rname"), F.col("rs") + 1, F.shiftright("mapq16", QUALITY_BITS), clipped_cigar(hard), F.lit("*"), F.lit(0), F.lit(0), seq, qual]
    tags = {
        "RG": F.lit(f"RG:Z:{read_group_id(params)}"),
        "NH": F.concat(F.lit("NH:i:"), F.col("n_all")),
        "IH": F.concat(F.lit("IH:i:"), F.col("aid")),
        "AS": F.concat(F.lit("AS:i:"), F.col("score")),
        "NM": F.concat(F.lit("NM:i:"), edits()),
        "XS": F.when(first, F.concat(F.lit("XS:i:"), F.col("xs"))),
        "MD": F.concat(F.lit("MD:Z:"), F.col("md")) if "md" in alignments.columns else F.lit(None),
    }
    out = alignments
    if params.omit_secondary:
        out = out.where("is_uniq")
    if "SA" in params.tags:
        element = F.concat_ws(",", F.col("rname"), (F.col("rs") + 1).cast("string"), F.when(reverse, "-").otherwise("+"), clipped_cigar(F.lit(True)), F.shiftright("mapq16", QUALITY_BITS).cast("string"), edits().cast("string"))
        others = F.collect_list(F.when(F.col("is_uniq") & ~first, F.struct(F.col("aid"), seg.alias("seg"), F.concat(element, F.lit(";")).alias("e")))).over(Window.partitionBy("qid"))
        out = out.withColumn("__sa", F.array_join(F.transform(F.sort_array(others), lambda x: x["e"]), "")).where(flag.bitwiseAND(SUPPLEMENTARY) == 0)
        tags["SA"] = F.when(first & (F.col("__sa") != ""), F.concat(F.lit("SA:Z:"), F.col("__sa")))
    line += [tags[t] for t in params.tags if t in tags]
    if "tags" in alignments.columns:
        copied = F.map_filter("tags", lambda k, _: k.isin(*params.tags) if params.tags else F.lit(False))
        own = F.array_join(F.transform(F.array_sort(F.map_entries(copied)), lambda e: F.concat(e["key"], F.lit(":"), e["value"]["type"], F.lit(":"), e["value"]["value"])), "\t")
        line.append(F.when(first & (own != ""), own))
    return out.withColumn("line", tab(*line)).drop("__sa")


def gapped(side: str) -> Column:
    """The aligned part of the reference or query with dashes: columns rpart and qpart hold the bases of the path."""
    skip, seq = ("I", "rpart") if side == "r" else ("D", "qpart")
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("text"))
    step = lambda a, x: F.when(x["op"] == skip, F.struct(a["at"].alias("at"), F.concat(a["text"], F.repeat(F.lit("-"), x["len"])).alias("text"))).otherwise(
        F.struct((a["at"] + x["len"]).alias("at"), F.concat(a["text"], F.substring(F.col(seq), a["at"] + 1, x["len"])).alias("text"))
    )
    return F.aggregate("cigar", start, step, lambda a: a["text"])


def maf() -> Column:
    """A block of three lines and a blank one; the query's start is counted on the strand that is aligned."""
    wide = F.greatest(F.length("rname"), F.length("qname")) + 1
    qstart = F.when(F.col("strand") == 1, F.col("qlen") - F.col("qe")).otherwise(F.col("qs"))
    rows = []
    numbers = [(F.col("rs"), qstart), (F.col("re") - F.col("rs"), F.col("qe") - F.col("qs")), (F.col("rlen"), F.col("qlen"))]
    for i, (name, strand, text) in enumerate((("rname", F.lit("+"), gapped("r")), ("qname", F.when(F.col("strand") == 1, "-").otherwise("+"), gapped("q")))):
        pad = [F.lpad(n[i].cast("string"), F.greatest(F.length(n[0].cast("string")), F.length(n[1].cast("string"))), F.lit(" ")) for n in numbers]
        rows.append(F.concat(F.lit("s "), F.rpad(F.col(name), wide, F.lit(" ")), pad[0], F.lit(" "), pad[1], F.lit(" "), strand, F.lit(" "), pad[2], F.lit(" "), text))
    return F.concat(F.lit("a score="), F.col("score").cast("string"), F.lit("\n"), rows[0], F.lit("\n"), rows[1], F.lit("\n"))


def lines_of(alignments: DataFrame, params: MapParams, queries: DataFrame | None = None) -> DataFrame:
    """ordinal, aid, seg and line of alignments in the format that the parameters choose.

    With ``queries`` (qid, seq, name and qual if they have them), SAM has a line for those without alignments too.
    """
    seg = F.col("seg") if "seg" in alignments.columns else F.lit(0)
    place = ["ordinal", "aid", seg.alias("seg")]
    if params.format != "sam":
        shown = alignments.where("is_uniq") if params.omit_secondary else alignments
        line = {"paf": paf(params), "blast6": blast6(), "maf": maf() if params.format == "maf" else None}[params.format]
        return shown.select(*place, line.alias("line"))
    lines = sam(alignments, params).select(*place, "line")
    if queries is None:
        return lines
    qid, has = F.col("qid").cast("long"), set(queries.columns)
    asked = queries.select(qid.alias("qid"), (F.col("name") if "name" in has else qid.cast("string")).alias("qname"), F.col("seq").alias("qseq"), (F.col("qual") if "qual" in has else F.lit(None).cast("string")).alias("qual"))
    left = asked.join(alignments.select("qid").distinct(), "qid", "left_anti")
    return lines.unionByName(left.select(F.col("qid").alias("ordinal"), F.lit(0).alias("aid"), F.lit(0).alias("seg"), sam_unmapped(params).alias("line")))


def write_lines(lines: DataFrame, path: str, header: DataFrame | None = None) -> None:
    """Writes lines in order, range by range; a header goes into files of its own that sort first."""
    lines.orderBy("ordinal", "aid", *(["seg"] if "seg" in lines.columns else [])).select("line").write.mode("overwrite").text(f"{path}/body")
    if header is not None:
        header.orderBy("ordinal").select("line").coalesce(1).write.mode("overwrite").text(f"{path}/_head")
