"""op1, op2 and op7: exact round trips and properties on small tables with odd rows."""

import hashlib
import math
import zipfile
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from helixmap.llm import media, packing, queries, sharding
from helixmap.llm.common import shared_folder
from helixmap.llm.tokens import token_ids, vocabulary_path

ODD = [(1, "short text"), (2, None), (3, ""), (4, "x" * 5000), (5, "ümläut 日本語 \U0001f600 end\n\ttabs"), (6, "short text"), (6, "short text"), (None, "no id"), (7, "word " * 9000), (8, "\0\0"), (9, "one<|endoftext|>two <|endoftext|>")]
SCHEMA = "doc_id long, text string"
PLAIN = Tokenizer.from_file(vocabulary_path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "a", 1, 2) for i, t in ODD], SCHEMA + ", `row` string, __block int, payload int")


def test_media_round_trip(spark, odd):
    got = media.store_and_describe(odd).collect()
    want = Counter()
    for i, t in ODD:
        raw = (t or "").encode()
        p = raw + b"\0" * ((-len(raw)) % 64 or (0 if raw else 64))
        want[i, len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])] += 1
    assert Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got) == want
    by_text = defaultdict(set)
    for r in got:
        by_text[r.payload_sha256, r.n_bytes].add((r.media_bytes, r.media_sha256, r.feature))
    assert all(len(v) == 1 for v in by_text.values())


def test_media_empty_table(spark):
    assert media.store_and_describe(spark.createDataFrame([], SCHEMA)).count() == 0


def test_ranges_cover_each_member_once_and_members_are_retried(spark, odd):
    folder = shared_folder(spark, "media-test")
    assert media.write_media(odd, folder, archive_bytes=1000) == len(ODD)
    reader = media.MediaReader(folder, 300, 3)
    ranges = reader.partitions()
    assert len(ranges) > len({r.path for r in ranges}) > 1
    rows = [row for r in ranges for b in reader.read(r) for row in b.to_pylist()]
    assert Counter(r["doc_id"] for r in rows) == Counter(i for i, _ in ODD)

    fs, _ = media._filesystem(folder)
    with zipfile.ZipFile(fs.open_input_file(rows[0]["archive"])) as z:
        info = z.infolist()[0]
    calls = []

    class Broken:
        def seek(self, at):
            raise OSError("lost")

    def open_file():
        calls.append(1)
        return Broken() if len(calls) < 3 else fs.open_input_file(rows[0]["archive"])

    data, _ = reader.read_member(open_file, info, None)
    assert media.decode_png(data)[0] and len(calls) == 3
    with pytest.raises(OSError):
        reader.read_member(Broken, info, None)


def test_damaged_member_is_noticed():
    png = bytearray(media.encode_png(media.payload_of(b"abc"), 3))
    assert media.decode_png(bytes(png)) == (media.payload_of(b"abc"), 3)
    png[60] ^= 1
    with pytest.raises((ValueError, zlib.error)):
        media.decode_png(bytes(png))


@pytest.mark.parametrize("n", [0, 1, 39, 1003])
def test_sharding_is_exact(spark, n):
    df = spark.createDataFrame([(i % 50 if i else None, f"t{i % 7}" if i % 3 else None, i, i) for i in range(n)], SCHEMA + ", shard int, __rank int")
    rows = sharding.shard(df, 40, block_rows=10).collect()
    assert len(rows) == n
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    sizes = [len(slots[s]) for s in range(40)]
    assert max(sizes) - min(sizes) <= 1 and set(slots) <= set(range(40))
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert Counter(r["__rank"] for r in rows) == Counter(range(n))
    assert sorted(map(tuple, rows), key=repr) == sorted(map(tuple, sharding.shard(df.repartition(3), 40, block_rows=10).collect()), key=repr)


def test_communication_matrix_sums_and_law():
    m = sharding.communication_matrix([5, 0, 17, 100], 40, 1)
    assert m.sum(axis=1).tolist() == [5, 0, 17, 100] and m.sum(axis=0).max() - m.sum(axis=0).min() <= 1
    first = [sharding.communication_matrix([10, 30], 2, s)[0, 0] for s in range(4000)]
    assert abs(np.mean(first) - 5) < 0.1 and abs(np.var(first) - 20 * (10 / 40) * (30 / 40) * (20 / 39)) < 0.15


def test_inversion_is_the_hypergeometric_law():
    for good, bad, n in [(5, 7, 6), (3, 40, 10), (30, 2, 9), (4, 4, 8), (9, 0, 4), (0, 9, 4)]:
        total = math.comb(good + bad, n)
        p = [math.comb(good, k) * math.comb(bad, n - k) / total if n - k <= bad else 0.0 for k in range(min(n, good) + 1)]
        edges = np.cumsum(p)
        for k, x in enumerate(p):
            if x > 1e-9:
                assert sharding.inverted(edges[k] - x / 2, good, bad, n) == k
        assert sharding.inverted(0.0, good, bad, n) == next(k for k, x in enumerate(p) if x > 0) and sharding.inverted(1 - 1e-16, good, bad, n) == max(k for k, x in enumerate(p) if x > 0)


def test_communication_matrix_of_a_huge_table():
    blocks = [2_500_000_000, 4_000, 0, 7_500_000_001]
    m = sharding.communication_matrix(blocks, 40, 3)
    assert m.sum(axis=1).tolist() == blocks and m.sum(axis=0).max() - m.sum(axis=0).min() <= 1
    n, good, bad = 4_000, 250_000_000, 9_750_000_000
    draw = np.random.default_rng(5)
    got = [sharding._draw(draw, good, bad, n) for _ in range(4000)]
    mean, var = n * good / (good + bad), n * good / (good + bad) * bad / (good + bad)
    assert abs(np.mean(got) - mean) < 5 * (var / 4000) ** 0.5 and abs(np.var(got) / var - 1) < 0.12


def test_sharding_query_columns(spark, odd, tmp_path):
    odd.write.parquet(str(tmp_path / "documents.parquet"))
    rows = queries.op2_sharding(spark, str(tmp_path)).collect()
    want = Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in ODD)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == want
    assert {r.law for r in rows} == {"rows"} and {r.grown_shard for r in rows} == {None}
    assert len({(r.shard, r.slot) for r in rows}) == len(ODD) and all(0 <= r.shard < 40 and r.slot == 0 for r in rows)


def test_packing_covers_every_id_once(spark, odd):
    rows = packing.pack(odd).collect()
    want = Counter()
    for i, t in ODD:
        ids = np.append(np.array(PLAIN.encode(t or "", add_special_tokens=False).ids, "<u4"), np.uint32(1)).astype("<u4")
        for a in range(0, len(ids), 2048):
            want[i, a, len(ids[a : a + 2048]), zlib.crc32(ids[a : a + 2048].tobytes()), len(ids)] += 1
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows) == want
    check_sequences(rows)


def check_sequences(rows):
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for spans in by.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 2048
    return by


def test_packing_many_blocks(spark):
    df = spark.createDataFrame([(i, "a b c " * (i % 40)) for i in range(600)], SCHEMA)
    cuts = packing.pieces(df)
    rows = packing.place(cuts, block_pieces=3).collect()
    assert len(rows) == 600
    by = check_sequences(rows)
    total = sum(r.length for r in rows)
    assert len(by) == -(-total // 2048)
    assert packing.pack(spark.createDataFrame([], SCHEMA)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 4), max_size=8), st.integers(0, 60))
def test_fill_is_optimal(counts, room):
    best = {0}
    for length, n in counts.items():
        best |= {s + length * k for s in best for k in range(1, n + 1) if s + length * k <= room}
    got = packing.fill(counts, room)
    assert sum(a * n for a, n in got) == max(best) and all(0 < n <= counts[a] for a, n in got)


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 50), max_size=12))
def test_plan_uses_every_piece_once(histogram):
    used = defaultdict(list)
    for length, a, b, n, _, _ in packing.plan(histogram, 64):
        assert (b - a) % n == 0
        used[length] += range(a, b)
    assert {k: sorted(v) for k, v in used.items()} == {k: list(range(n)) for k, n in histogram.items()}


def test_both_tokenizers_agree():
    for text in ["", " ", "a", "don't  stop\n\n12 %% é", "<|endoftext|> plain", " <|endoftext|><|endoftext|>", "<|endoftext |>", "日本語" * 50, "x" * 3000, " " * 500 + "y"]:
        assert token_ids(text).tolist() == PLAIN.encode(text, add_special_tokens=False).ids
