"""Sources, index, mapping and formats on small made-up genomes, and the driver's contract."""

import gzip
import random
import re
import struct

import pytest
from pyspark.sql import functions as F

from helixmap.functions.codec import codes_of
from helixmap.operators import dp
from helixmap.operators.index import build_index, read_index, thresholds
from helixmap.operators.mapping import described, map_queries, tiles, uniques
from helixmap.operators.sketch import sketch
from helixmap.plans.params import MapParams, Scoring
from helixmap.sinks import formats
from helixmap.sources.seqfile import read_sequences, sniff
from helixmap.streaming.mapping import map_stream, seed_stream

# Inputs of the parsers.
FASTA = b">test0\nAAAA\n> test1\nATAT\nCGCG\r\n\r\n>  test2\n\nAAAA\n>test3 comment\tcomment  \nACGT\n\n"
FASTQ = b"@test0\nAAAA\n+test0\nNNNN\n@ test1\nATAT\nCGCG\n+ test1\n12+3\n+123\r\n@  test2\n\nAAAA\n+  test2\n\n\n12@3\n\n@test3  comment comment   \nACGT\n\n+ test3\n@123"
P = MapParams(k=15, w=10, scoring=Scoring(2, 4, 4, 2, xdrop=80), min_score=60)


@pytest.mark.parametrize("packed", [False, True])
def test_text_formats(spark, tmp_path, packed):
    for name, data in (("a.fa", FASTA), ("a.fq", FASTQ)):
        path = tmp_path / (name + ".gz" * packed)
        path.write_bytes(gzip.compress(data) if packed else data)
        rows = read_sequences(spark, str(path), tags="CO", keep_qual=True).orderBy("ordinal").collect()
        assert [(r.name, r.len, codes_of(r.seq).tolist()) for r in rows] == [("test0", 4, [0] * 4), ("test1", 8, [0, 3, 0, 3, 1, 2, 1, 2]), ("test2", 4, [0] * 4), ("test3", 4, [0, 1, 2, 3])]
        assert [r.comment for r in rows] == [None, None, None, "comment comment"]
        assert [r.qual for r in rows] == (["NNNN", "12+3+123", "12@3", "@123"] if "fq" in name else [""] * 4)
    assert {r.qual for r in read_sequences(spark, str(tmp_path), keep_qual=False).collect()} == {""}
    assert read_sequences(spark, str(tmp_path), min_len=8).count() == 2


def test_fasta_ranges(spark, tmp_path):
    r = random.Random(1)
    text = "".join(f">s{i} c\n" + "\n".join("".join(r.choice("ACGT") for _ in range(r.randint(0, 30))) for _ in range(r.randint(1, 4))) + "\n" for i in range(60))
    (tmp_path / "x.fa").write_text(text)
    whole = [(x.name, x.seq) for x in read_sequences(spark, str(tmp_path / "x.fa"), min_len=0).orderBy("ordinal").collect()]
    assert [n for n, _ in whole] == [f"s{i}" for i in range(60)]
    for size in (1, 7, 50, 333):
        if size > 5:
            assert [(x.name, x.seq) for x in read_sequences(spark, str(tmp_path / "x.fa"), min_len=0, range_bytes=size).orderBy("ordinal").collect()] == whole


def bam_record(name, seq, qual, flag, tags=b""):
    codes = ["=ACMGRSVTWYHKDBN".index(c) for c in seq] + [0] * (len(seq) % 2)
    body = struct.pack("<iiBBHHHiiii", -1, -1, len(name) + 1, 0, 0, 0, flag, len(seq), -1, -1, 0) + name.encode() + b"\0"
    body += bytes(a << 4 | b for a, b in zip(codes[::2], codes[1::2], strict=True)) + bytes(qual) + tags
    return struct.pack("<i", len(body)) + body


def test_bam(spark, tmp_path):
    tags = b"RGZgroup\0" + b"NMi" + struct.pack("<i", -3) + b"ZBBS" + struct.pack("<I2H", 2, 7, 9) + b"XCAq" + b"XFf" + struct.pack("<f", 1.5)
    head = b"BAM\1" + struct.pack("<i", 4) + b"@HD\n" + struct.pack("<i", 1) + struct.pack("<i", 3) + b"r1\0" + struct.pack("<i", 100)
    data = head + bam_record("a", "ACGTN", [1, 2, 3, 4, 5], 0, tags) + bam_record("b", "AACG", [9] * 4, 0x10) + bam_record("c", "ACGT", [9] * 4, 0x100)
    (tmp_path / "x.bam").write_bytes(gzip.compress(data[:40]) + gzip.compress(data[40:]))
    a, b = read_sequences(spark, str(tmp_path / "x.bam"), tags="RG,ZB,XF").orderBy("ordinal").collect()
    assert (a.name, a.seq, a.qual) == ("a", "ACGTN", "\"#$%&") and (b.seq, b.qual) == ("CGTT", "****")
    assert {k: tuple(v) for k, v in a.tags.items()} == {"RG": ("Z", "group"), "ZB": ("B", "S,7,9"), "XF": ("f", "1.5")}
    with pytest.raises(ValueError):
        sniff(b"zzzz")


def genome(n, seed):
    r = random.Random(seed)
    return "".join(r.choice("ACGT") for _ in range(n))


def noisy(seq, rate, r):
    return "".join(c if (x := r.random()) > rate else r.choice("ACGT") if x < rate / 2 else c + r.choice("ACGT") if x < rate * 0.75 else "" for c in seq)


def turned(seq):
    return seq[::-1].translate(str.maketrans("ACGT", "TGCA"))


@pytest.fixture(scope="module")
def world(spark):
    r = random.Random(5)
    chromosomes = [genome(20_000, 1), genome(8_000, 2)]
    truth, reads = [], []
    for i in range(40):
        c = r.randrange(2)
        start = r.randrange(len(chromosomes[c]) - 1500)
        read = noisy(chromosomes[c][start : start + 1200], 0.1, r)
        reverse = r.random() < 0.5
        truth.append((i, c, start, start + 1200, int(reverse)))
        reads.append((i, f"read{i}", turned(read) if reverse else read))
    reads += [(100, "random", genome(1200, 99)), (101, "short", "ACGT"), (102, "empty", ""), (103, "n", "N" * 500)]
    refs = spark.createDataFrame([(0, "chr1", chromosomes[0]), (1, "chr2", chromosomes[1])], "rid long, name string, seq string")
    index = build_index(refs, P)
    queries = spark.createDataFrame(reads, "qid long, name string, seq string")
    return index, queries, truth, chromosomes, dict((i, s) for i, _, s in reads)


def test_planted_reads_are_found(spark, world):
    index, queries, truth, chromosomes, reads = world
    rows = map_queries(queries, index).collect()
    first = {x.qid: x for x in rows if x.aid == 0}
    hits = [i for i, c, a, b, s in truth if i in first and first[i].rid == c and first[i].strand == s and first[i].rs < b and first[i].re > a]
    assert len(hits) >= 39 and not set(first) & {100, 101, 102, 103}
    for x in rows:
        n = {op: sum(c["len"] for c in x.cigar if c["op"] == op) for op in "MID"}
        assert n["M"] + n["D"] == x.re - x.rs and n["M"] + n["I"] == x.qe - x.qs and x.dcnt == n["M"] and (x.gaps_r, x.gaps_q) == (n["D"], n["I"])
        q = reads[x.qid] if not x.strand else turned(reads[x.qid])
        qs = x.qs if not x.strand else len(q) - x.qe
        a, b = codes_of(chromosomes[x.rid][x.rs : x.re]), codes_of(q[qs : qs + x.qe - x.qs])
        assert dp.rescore("".join(c["op"] * c["len"] for c in x.cigar), a, b, P.scoring)["score"] == x.score
        assert 0.85 < x.identity <= 1 and 0 <= x.mapq16 <= 960 and not x.clipped
    assert sum(x.qe - x.qs > 1000 for x in first.values()) >= 35
    turned_rows = map_queries(queries.withColumn("seq", F.reverse(F.translate("seq", "ACGT", "TGCA"))), index).where("aid = 0").collect()
    same = {x.qid: x for x in turned_rows}
    assert sum(same[i].strand != first[i].strand and abs(same[i].rs - first[i].rs) < 30 for i in hits) >= len(hits) - 1


def test_results_do_not_depend_on_partitions(spark, world):
    index, queries, *_ = world
    before = spark.conf.get("spark.sql.shuffle.partitions")
    found = []
    for n in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        found.append(sorted(map(str, map_queries(queries.repartition(int(n)), index).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found[0] == found[1]


def test_index_round_trip_and_thresholds(spark, world, tmp_path):
    index, *_ = world
    index.write(str(tmp_path / "index"))
    again = read_index(spark, str(tmp_path / "index"))
    assert sorted(map(tuple, again.seeds.collect())) == sorted(map(tuple, index.seeds.collect())) and again.occ == index.occ and again.params.k == 15
    with pytest.raises(ValueError):
        read_index(spark, str(tmp_path / "index"), MapParams(k=13))
    counts = spark.createDataFrame([(i, n) for i, n in enumerate([1] * 90 + list(range(2, 12)))], "hash long, n long")
    ordered = sorted([1] * 90 + list(range(2, 12)))
    import numpy as np

    for f in (0.05, 0.01, 0.001):
        assert thresholds(counts, (f,)) == [ordered[int((1.0 - float(np.float32(f))) * 100)] + 1]
    assert thresholds(counts.limit(0), (0.1, 0.0)) == [2**31 - 1] * 2


def test_repeats_are_secondary_and_split_reads_supplementary(spark):
    a, b, unit = genome(6000, 11), genome(6000, 12), genome(2000, 13)
    refs = spark.createDataFrame([(0, "x", a + unit + b), (1, "y", b[:1000] + unit + a[:1000]), (2, "z", genome(5000, 14))], "rid long, name string, seq string")
    index = build_index(refs, P)
    queries = spark.createDataFrame([(0, unit[300:1700]), (1, a[1000:2000] + b[3000:4200])], "qid long, seq string")
    rows = map_queries(queries, index).collect()
    repeat, split = ([x for x in rows if x.qid == i] for i in (0, 1))
    assert {(x.rid, x.is_uniq) for x in repeat} in ({(0, True), (1, False)}, {(1, True), (0, False)}) and all(x.mapq16 == 0 for x in repeat)
    assert [x.is_uniq for x in sorted(split, key=lambda x: x.aid)][:2] == [True, True] and {x.rid for x in split if x.aid < 2} == {0}
    lines = formats.sam(described(map_queries(queries, index), queries, index), MapParams(tags=("AS", "NM", "XS", "SA", "NH", "MD"))).orderBy("ordinal", "aid").select("line").collect()
    cells = [x.line.split("\t") for x in lines]
    flags = [(c[0], int(c[1])) for c in cells]
    assert ("0", 0) in flags and ("0", 256) in flags and all(f & 0x800 == 0 for _, f in flags)
    (main,) = [c for c in cells if c[0] == "1" and int(c[1]) & 0x900 == 0]
    assert any(x.startswith("SA:Z:x,") for x in main) and sum(int(n) for n, op in re.findall(r"(\d+)([MIS])", main[5])) == len(main[9]) == 2200


def test_circular_reference(spark):
    ring = genome(5000, 21)
    refs = spark.createDataFrame([(0, "ring", ring)], "rid long, name string, seq string")
    read = spark.createDataFrame([(0, ring[4200:] + ring[:900])], "qid long, seq string")
    from dataclasses import replace

    straight = map_queries(read, build_index(refs, P)).collect()
    turned_ = map_queries(read, build_index(refs, replace(P, circular=("*",)))).where("aid = 0").collect()
    assert max(x.qe - x.qs for x in turned_) == 1700 and max(x.qe - x.qs for x in straight) < 1000
    assert turned_[0].rs == 4200 and turned_[0].re == 5900


def test_formats(spark, tmp_path):
    row = {"qid": 1, "ordinal": 1, "qname": "q", "qlen": 10, "qseq": "ACGTACGTAC", "qual": "0123456789", "rname": "ref", "rlen": 100, "strand": 1, "rs": 20, "re": 28, "qs": 1, "qe": 8, "score": 40, "identity": 0.875, "dcnt": 7, "gaps": 1, "cigar": [("M", 3), ("D", 1), ("M", 4)], "aid": 0, "is_uniq": True, "n_all": 1, "xs": 3, "mapq16": 333, "rpart": "GTACGTAC", "qpart": "ACGTACG", "md": "3^C4"}
    schema = "qid long, ordinal long, qname string, qlen int, qseq string, qual string, rname string, rlen int, strand int, rs long, re long, qs long, qe long, score long, identity double, dcnt long, gaps long, cigar array<struct<op:string,len:int>>, aid int, is_uniq boolean, n_all int, xs long, mapq16 int, rpart string, qpart string, md string"
    df = spark.createDataFrame([tuple(row.values())], schema)
    line = lambda p: formats.lines_of(df, p).first().line.split("\t")
    assert line(MapParams(format="paf", tags=("AS", "ID", "NM", "CG"))) == ["q", "10", "1", "8", "-", "ref", "100", "20", "28", "6", "8", "20", "AS:i:40", "ID:f:0.8750", "NM:i:1", "CG:Z:3M1D4M"]
    assert line(MapParams(format="blast6"))[:10] == ["q", "ref", "0.875", "8", "1", "1", "2", "8", "28", "21"]
    sam = line(MapParams(tags=("RG", "NM", "XS", "MD"), read_group="ID:g1"))
    assert sam == ["q", "16", "ref", "21", "20", "2S3M1D4M1S", "*", "0", "0", "GTACGTACGT", "9876543210", "RG:Z:g1", "NM:i:1", "XS:i:3", "MD:Z:3^C4"]
    maf = "\t".join(line(MapParams(format="maf"))).split("\n")
    assert maf[0] == "a score=40" and maf[1] == "s ref 20 8 + 100 GTACGTAC" and maf[2] == "s q    2 7 -  10 ACG-TACG" and maf[3] == ""
    out = str(tmp_path / "out")
    header = formats.sam_header(spark.createDataFrame([(0, "ref", 100)], "rid long, name string, len int"), MapParams(read_group="ID:g1"))
    formats.write_lines(formats.lines_of(df, MapParams()), out, header)
    assert [r.value.split("\t")[0] for r in spark.read.text(out + "/_head").collect()] == ["@HD", "@SQ", "@RG", "@PG"] and spark.read.text(out + "/body").count() == 1


def test_greedy_choice_of_unique_sets():
    assert uniques([(0, 100)]) == [0] and uniques([(0, 100), (0, 100)]) == [0]
    assert uniques([(0, 100), (90, 300), (100, 180)]) == [0, 1] and uniques([(0, 100), (10, 90), (120, 200)]) == [0, 2]


def test_unique_sets_match_counting_by_base():
    r = random.Random(4)
    for _ in range(300):
        spans = [(a := r.randrange(60), a + r.randrange(1, 40)) for _ in range(r.randrange(1, 9))]
        left, chosen, taken = list(range(1, len(spans))), [0], set(range(*spans[0]))
        while True:
            new = {i: len(set(range(*spans[i])) - taken) for i in left}
            left = [i for i in left if new[i] and not 1.2 * new[i] < spans[i][1] - spans[i][0] - 1e-9]
            if not left:
                break
            best = max(left, key=lambda i: (new[i], -i))
            chosen.append(best)
            taken |= set(range(*spans[best]))
            left.remove(best)
        assert uniques(spans) == chosen


def test_reads_with_many_deletions_are_not_cut_short(spark):
    whole = genome(6000, 51)
    read = whole[1000:1100] + "".join(whole[i : i + 25] for i in range(1100, 4000, 36)) + whole[4000:4100]
    index = build_index(spark.createDataFrame([(0, "x", whole)], "rid long, name string, seq string"), P)
    for text in (read, turned(read)):
        (x,) = map_queries(spark.createDataFrame([(0, text)], "qid long, seq string"), index).collect()
        assert (x.rs, x.re) == (1000, 4100) and x.qe - x.qs == len(read) and not x.clipped


def test_long_sequences_are_sketched_in_parts(spark):
    r = random.Random(6)
    seqs = [(0, genome(3000, 41)), (1, "A" * 500), (2, "AC" * 300 + "N" * 40 + genome(400, 42)), (3, genome(20, 43)), (4, None), (5, "".join(r.choice("ACGTN") for _ in range(900))), (6, "ACGTTA" * 120)]
    df = spark.createDataFrame(seqs, "rid long, seq string").coalesce(1)
    for k, w in ((15, 10), (5, 4), (28, 31)):
        whole = sorted(map(tuple, sketch(df, "rid", k, w).collect()))
        for size in (1, 64, 333):
            assert sorted(map(tuple, sketch(df, "rid", k, w, part_bases=size).collect())) == whole


def test_tiles_give_back_the_references(spark):
    refs = [(0, False, genome(1000, 31)), (1, True, genome(130, 32)), (2, None, ""), (3, False, genome(64, 33))]
    rows = tiles(spark.createDataFrame(refs, "rid long, circular boolean, seq string"), 64).orderBy("rid", "tile").collect()
    for rid, ring, seq in refs:
        assert "".join(x.bases for x in rows if x.rid == rid) == seq * (2 if ring else 1)
    assert all(len(x.bases) <= 64 for x in rows)


def test_streaming(spark, world, tmp_path):
    index, queries, *_ = world
    queries.select("qid", "seq").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("qid long, seq string").parquet(str(tmp_path / "in"))
    assert seed_stream(stream, index).isStreaming
    map_stream(stream, index, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).drop("batch")
    assert sorted(map(str, got.collect())) == sorted(map(str, map_queries(queries, index).collect()))


def test_registered_queries_have_matching_sql(spark):
    import os

    import duckdb

    import __spark_entry__ as entry

    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no test data")
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and entry.entry(spark).count() > 0
    con = duckdb.connect()
    for f in os.listdir(folder):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{folder}/{f}'")
    for name in ("minimizers", "secondary_scores", "chainable_pairs", "index_filtered", "seed_join", "paf_lines", "sam_flags", "fasta_parse_text"):
        mine = queries[name](spark, folder)
        theirs = con.execute(sql[name])
        order = [d[0] for d in theirs.description]
        key = lambda r: tuple(map(str, r))
        assert sorted(map(key, mine.select(*order).collect())) == sorted(map(key, theirs.fetchall())), name


def test_stray_bytes_and_ordinals_over_files(spark, tmp_path):
    (tmp_path / "a.fa").write_bytes(b"x>a\nACGT\n>b\nAACC\n")
    (tmp_path / "b.fa").write_bytes(b">c\nGGGG\n")
    (tmp_path / "c.fq").write_bytes(b"\n@d\nAC\n+\nII\n")
    rows = read_sequences(spark, str(tmp_path), min_len=0).orderBy("ordinal").collect()
    assert [(x.name, x.seq) for x in rows] == [("a", "ACGT"), ("b", "AACC"), ("c", "GGGG"), ("d", "AC")] and len({x.ordinal for x in rows}) == 4


def test_from_files_to_sam(spark, tmp_path):
    r = random.Random(8)
    chromosomes = [genome(6_000, 11), genome(5_000, 12)]
    (tmp_path / "one.fa").write_text(f">c1\n{chromosomes[0]}\n")
    (tmp_path / "two.fa").write_text(f">c2\n{chromosomes[1]}\n")
    reads = {f"r{i}": noisy(chromosomes[i % 2][300 * i : 300 * i + 1000], 0.05, r) for i in range(8)}
    reads["split"] = chromosomes[0][500:1500] + genome(1500, 13) + chromosomes[0][1500:2500]
    reads["lost"] = genome(900, 14)
    (tmp_path / "q1.fq").write_text("".join(f"@{k}\n{v}\n+\n{'I' * len(v)}\n" for k, v in list(reads.items())[:5]))
    (tmp_path / "q2.fa").write_text("".join(f">{k} note\n{v}\n" for k, v in list(reads.items())[5:]))
    from helixmap.plans.run import run

    refs = f"{tmp_path}/one.fa,{tmp_path}/two.fa"
    run(spark, f"-t4 -xpacbio -TAS,NM,CO {refs} {tmp_path}/q1.fq {tmp_path}/q2.fa", f"{tmp_path}/out")
    head = [x.value for x in spark.read.text(f"{tmp_path}/out/_head/part*").collect()]
    assert [x.split("\t")[1] for x in head if x.startswith("@SQ")] == ["SN:c1", "SN:c2"]
    lines = [x.value.split("\t") for x in spark.read.text(f"{tmp_path}/out/body").collect()]
    assert {x[0] for x in lines} == set(reads)
    primary = [x[0] for x in lines if not int(x[1]) & 0x900]
    assert sorted(primary) == sorted(reads) and [x[1] for x in lines if x[0] == "lost"] == ["4"]
    for x in lines:
        if x[0] in reads and x[0][1:].isdigit():
            assert x[2] == f"c{int(x[0][1:]) % 2 + 1}"
    assert sum(int(x[1]) & 0x800 > 0 for x in lines if x[0] == "split") >= 1 and all("H" in x[5] for x in lines if int(x[1]) & 0x800)
    run(spark, f"-xpacbio -d {tmp_path}/index {tmp_path}/one.fa {tmp_path}/two.fa")
    run(spark, f"-xpacbio -TSA {tmp_path}/index {tmp_path}/q1.fq {tmp_path}/q2.fa", f"{tmp_path}/again")
    again = [x.value.split("\t") for x in spark.read.text(f"{tmp_path}/again/body").collect()]
    assert sorted(x[:5] for x in again if not int(x[1]) & 0x100) == sorted(x[:5] for x in lines if not int(x[1]) & 0x900)
    assert [x[11].startswith("SA:Z:c1,") for x in again if x[0] == "split"] == [True]
    for bad in ("-xpacbio", f"-xpacbio {tmp_path}/one.fa"):
        with pytest.raises(ValueError):
            run(spark, bad)
