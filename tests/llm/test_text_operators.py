"""op3, op4, op5, op6, op8, op9, op10 against plain versions, on small tables with odd rows."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash

from helixmap.llm import bagminhash, line_dedup, mixing, ngram_lm, rollups, simhash, toxicity
from helixmap.llm.common import shared_folder

SCHEMA = "doc_id long, text string"
FULL = "doc_id long, text string, lang string, source string, n_chars long"
R = random.Random(4)
VOCABULARY = ["".join(R.choice("abcdefghij") for _ in range(R.randint(2, 7))) for _ in range(300)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(VOCABULARY) for _ in range(n))


def lines(n, seed):
    return "\n".join(prose(12, (seed, i).__hash__()) for i in range(n))


ODD = [(1, prose(80, 1)), (2, None), (3, ""), (4, prose(80, 1)), (None, prose(30, 2)), (5, "one"), (5, "one"), (6, " \t\n "), (7, "A b\x0bC  d"), (8, prose(4000, 3)), (9, "word " * 300), (None, None)]


def full(spark, rows):
    return spark.createDataFrame([(i, t, ["en", "fr", None][k % 3], f"src{k % 4}" if k % 5 else None, len(t or ""), "x", 1) for k, (i, t) in enumerate(rows)], FULL + ", kept string, __key int")


def empty(spark):
    return spark.createDataFrame([], FULL)


def test_language_model(spark):
    rows = ODD + [(i, prose(60 + i, i)) for i in range(20, 120)]
    got = sorted(ngram_lm.score_corpus(full(spark, rows), chunk_bytes=2000).collect(), key=repr)
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    tokens = [[*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low)), "\n"] for _, t in rows]
    crc = [zlib.crc32(str(i).encode()) % 10 if i is not None else 0 for i, _ in rows]
    seen = Counter(w for k, t in zip(crc, tokens, strict=True) if k for w in t)
    n, v = sum(seen.values()), len(seen)
    want = []
    for (i, _), k, t in zip(rows, crc, tokens, strict=True):
        base = sum(math.log10((seen[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t)
        want.append((i, k == 0, len(t), sum(seen[w] > 0 for w in t), n, round(base, 6)))
    assert sorted([(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got], key=repr) == sorted(want, key=repr)
    held = [r for r in got if r.held_out and r.doc_id is not None]
    assert held and all(r.score <= 0 for r in got) and sum(r.score for r in held) > 0.8 * sum(r.base_score for r in held) * 2
    assert ngram_lm.score_corpus(empty(spark)).count() == 0


def test_language_model_scores_match_a_plain_model(spark):
    rows = [(i, prose(3 + i % 40, 300 + i % 90) + (" Rare%d" % i if i % 3 == 0 else "")) for i in range(200)] + [(None, "no id"), (500, None), (501, ""), (7, "seven again"), (7, "seven again")]
    docs = spark.createDataFrame(rows, SCHEMA)
    f = bagminhash.F
    dealt = docs.select("doc_id", f.coalesce("text", f.lit("")).alias("text")).withColumn("aside", f.pmod(f.xxhash64(f.lit("chunk"), "doc_id", "text"), f.lit(20)) % 10 == 0).collect()
    docs_of = []
    for r in dealt:
        words = [w for w in re.split("[\\x20\\x09-\\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in r.text)) if w]
        held = r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 10 == 0
        docs_of.append((r.doc_id, r.text, ["", *words, ""], held, r.aside))

    def counted(which):
        one, two = Counter(), Counter()
        for _, _, words, held, aside in docs_of:
            if not held and which(aside):
                one.update(words[1:])
                two.update(zip(words[:-1], words[1:], strict=True))
        return one, two

    one, two = counted(lambda aside: True)
    n, v = sum(one.values()), len(one)
    level = lambda x: round(math.log2(x) * 4) if x > 0 else None
    of = lambda c: c.bit_length()
    rest_one, rest_two = counted(lambda aside: not aside)
    left = sum(rest_one.values())
    seen = defaultdict(Counter)
    for _, _, words, held, aside in docs_of:
        if not held and aside:
            for u, w in zip(words[:-1], words[1:], strict=True):
                c = rest_one[u]
                seen[of(c)][level(rest_two[u, w] / max(c, 1) * (v + 1)), level(rest_one[w] / left * (v + 1))] += 1
    weights = {}
    for b, table in seen.items():
        x = [1 / 3] * 3
        for _ in range(100):
            sums = [0.5] * 3
            for (p, q), k in table.items():
                parts = [x[0] * 2 ** (p / 4) if p is not None else 0, x[1] * 2 ** (q / 4) if q is not None else 0, x[2]]
                for i in range(3):
                    sums[i] += k * parts[i] / sum(parts)
            x = [y / sum(sums) for y in sums]
        weights[b] = x
    nearest = {b: weights[min(weights, key=lambda k: (abs(k - b), k))] for b in range(20)}
    nearest[0] = [0, nearest[0][1] / sum(nearest[0][1:]), nearest[0][2] / sum(nearest[0][1:])]
    want = Counter()
    for i, text, words, held, _ in docs_of:
        score = 0.0
        for u, w in zip(words[:-1], words[1:], strict=True):
            a, b, c = nearest[of(one[u])]
            score += math.log10(a * two[u, w] / max(one[u], 1) + b * one[w] / n + c / (v + 1))
        base = sum(math.log10((one[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words[1:])
        want[i, held, len(words) - 1, sum(one[w] > 0 for w in words[1:]), n, round(base, 6), round(score, 5)] += 1
    got = ngram_lm.score_corpus(docs).collect()
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 5)) for r in got) == want


def test_language_model_probabilities_sum_to_one():
    own, pair, before = np.array([3.0, 1, 0]), np.array([2.0, 1, 0]), np.array([3.0, 3, 3])
    two, one, zero = ngram_lm.estimates(own, pair, before, 4, 2)  # a vocabulary of two words and the unknown one
    a, b, c = ngram_lm.maximise([(2, 3, 2, 10), (2, ngram_lm.NONE, 1, 4), (2, ngram_lm.NONE, ngram_lm.NONE, 1)])[2]
    assert abs((a * two + b * one + c * zero).sum() - 1) < 1e-12 and min(a, b, c) > 0


def test_em_raises_the_likelihood_and_packing_of_keys():
    rows = [(3, 8, 4, 50), (3, ngram_lm.NONE, 6, 30), (3, ngram_lm.NONE, ngram_lm.NONE, 5), (3, 2, 1, 9)]

    def likelihood(w):
        return sum(n * math.log(w[0] * (2 ** (p / 4) if p > ngram_lm.NONE else 0) + w[1] * (2 ** (o / 4) if o > ngram_lm.NONE else 0) + w[2]) for _, p, o, n in rows)

    best = ngram_lm.maximise(rows)[3]
    assert all(likelihood(best) >= likelihood(w) - 0.5 for w in [(0.3, 0.3, 0.4), (0.5, 0.4, 0.1), (0.1, 0.8, 0.1), (0.8, 0.1, 0.1)])
    keys = np.sort(np.random.default_rng(1).integers(0, 1 << 63, 1000).astype(np.uint64))
    assert (ngram_lm.unpack_keys(ngram_lm.pack_keys(keys)) == keys).all()
    assert ngram_lm.unpack_keys(ngram_lm.pack_keys(np.array([0], np.uint64))).tolist() == [0]
    assert (ngram_lm.unpack(ngram_lm.pack(keys)) == keys).all()


def test_line_dedup(spark):
    passage, other = lines(5, 77), lines(4, 78)
    rows = [(1, lines(3, 1) + "\n" + passage), (2, lines(3, 2) + "\n" + passage + "\n\n" + lines(2, 3)), (3, passage), (4, lines(3, 4) + "\nshort line\n" + other), (5, "short line\n" + lines(2, 5)), (6, other + "\n" + passage), (7, None), (8, ""), (None, lines(2, 6)), (9, "a a a\n" * 50), (10, "a a a\n" * 40), (11, lines(3, 11)), (11, lines(3, 11))]
    got = defaultdict(list)
    for r in line_dedup.dedup(full(spark, rows)).collect():
        got[r.doc_id].append(r)
    one = {k: v[0] for k, v in got.items()}
    assert one[1].text == rows[0][1] and one[1].removed_lines == 0
    assert one[2].text == lines(3, 2) + "\n\n" + lines(2, 3) and one[2].removed_text == passage and one[2].partners == [1]
    assert one[3].text == "" and one[6].text == "" and one[6].partners == [1, 4]
    assert one[4].text == rows[3][1] and one[5].text == rows[4][1]  # a short line alone stays
    assert one[7].text is None and one[8].text == "" and one[None].text == lines(2, 6)
    assert one[9].removed_lines == 0 and one[10].removed_words == 120
    assert len(got[11]) == 2 and {r.text for r in got[11]} == {lines(3, 11)}
    assert line_dedup.dedup(empty(spark)).count() == 0


def test_passages_within_long_lines(spark):
    passage = prose(90, 4321)
    rows = [(1, prose(200, 1) + " " + passage + " " + prose(150, 2)), (2, prose(100, 3) + " " + passage + " " + prose(60, 4) + "\n" + prose(40, 5)), (3, prose(300, 6)), (4, passage)]
    got = {r.doc_id: r for r in line_dedup.dedup(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[1].text == rows[0][1] and got[3].text == rows[2][1]
    for i in (2, 4):  # all but the ends, which hang together with what stands around them
        left = [w for w in got[i].removed_text.split()]
        assert len(left) >= 40 and " ".join(left) in passage
    assert got[2].text.startswith(prose(80, 3)[:200]) and got[2].text.endswith(prose(40, 5)) and got[2].removed_words + len(got[2].text.split()) == 290


def seeds_of(home, own, size):
    first = {tuple(home[i : i + size]): i for i in reversed(range(len(home) - size + 1))}
    return [(j, first[tuple(own[j : j + size])]) for j in range(len(own) - size + 1) if tuple(own[j : j + size]) in first]


def blocks(home, own, min_words):
    found = line_dedup.common_blocks(np.array(home, "<u2"), np.array(own, "<u2"), seeds_of(home, own, (min_words + 1) // 2), min_words)
    assert all(b - a >= min_words for a, b in found)
    return sorted({j for a, b in found for j in range(a, b)})


def test_blocks_that_changed_places_are_aligned():
    a, b = list(range(1, 31)), list(range(31, 61))
    assert blocks(a + [99] + b, b + [50] + a, 25) == [*range(30), *range(31, 61)]
    assert blocks(a, [0, *a, 0, *a], 25) == [*range(1, 31), *range(32, 62)]
    assert blocks(a[:24] + b[:24], a[:24] + [0] + b[:24], 25) == []


def test_words_and_anchors_of_a_text_do_not_depend_on_its_neighbours():
    texts = ["", "\n", "a", "a b\n\n c ", prose(500, 8), lines(7, 9) + "\n" + prose(77, 10), "x " * 400, "é\u00a0ü " * 50 + "y" * 9000, prose(24, 11), prose(25, 12)]
    words, line, text = line_dedup.words_of([t.encode() for t in texts])
    h, place, of = line_dedup.anchors(words, line, text, 25)
    for i, t in enumerate(texts):
        assert (text == i).sum() == len(t.encode().split())
        own, own_line, own_text = line_dedup.words_of([t.encode()])
        assert (own == words[text == i]).all()
        got = line_dedup.anchors(own, own_line, own_text, 25) if len(own) else ([], [], [])
        assert list(got[0]) == h[of == i].tolist() and list(got[1]) == place[of == i].tolist()
        assert bool(len(got[0])) == (len(own) >= 25)


def test_every_passage_has_an_anchor_of_its_own():
    passage = prose(25, 70)
    alone = set(line_dedup.anchors(*line_dedup.words_of([passage.encode()]), 25)[0].tolist())
    for k in range(40):
        text = prose(k, 71 + k) + " " + passage + " " + prose(50, 200 + k)
        assert alone & set(line_dedup.anchors(*line_dedup.words_of([text.encode()]), 25)[0].tolist())


def test_homes_have_copies_by_their_pairs_and_not_by_their_hashes(spark, monkeypatch):
    long = prose(4000, 60)
    rows = [(i, long + " " + prose(30, 61 + i)) for i in range(10)] + [(20 + i, prose(30, 80 + i)) for i in range(3)]
    lines = line_dedup.line_table(spark.createDataFrame(rows, SCHEMA).select("doc_id", "text")).localCheckpoint()
    pairs = line_dedup.homes(lines).localCheckpoint()  # nine pairs of one home, by hundreds of hashes that ten documents have
    for size, copies in ((1000, 1), (9, 1), (4, 3)):
        monkeypatch.setattr(line_dedup, "COPY_PAIRS", size)
        met, wanted = line_dedup.dealt(pairs)
        assert [x.copies for x in wanted.collect()] == [copies]
        got = [(x.home_id, x.copy) for x in met.collect()]
        assert len(got) == 9 and {i for i, _ in got} == {0} and {c for _, c in got} <= set(range(copies))
        words = {x.doc_id: x.removed_words for x in line_dedup.dedup(spark.createDataFrame(rows, SCHEMA)).collect()}
        assert all(words[i] == (4000 if 0 < i < 10 else 0) for i, _ in rows)


def test_batches_of_long_texts_are_small(spark):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"])

    rows = spark.range(0, 300, 1, 1).selectExpr("repeat('word ', 20000) AS text")
    got = [x.n for x in rows.mapInArrow(line_dedup.small_batches(sizes), "n long").collect()]
    assert sum(got) > 30_000_000 and max(got) < line_dedup.BATCH_BYTES + 1_000_000


def test_lines_of_different_documents_make_no_block(spark):
    parts = [prose(8, 800 + i) for i in range(5)]
    rows = [(i, prose(40, 810 + i) + "\n" + p + "\n" + prose(40, 820 + i)) for i, p in enumerate(parts)] + [(9, prose(30, 830) + "\n" + "\n".join(parts))]
    got = {x.doc_id: x for x in line_dedup.dedup(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(got[i].text == t and got[i].removed_words == 0 for i, t in rows)


def test_dropped_words_and_kept_words_make_the_text():
    for i, text in enumerate(["a", "a b\n\n c ", prose(500, 8), lines(7, 9) + "\n" + prose(77, 10), "é\u00a0ü " * 50 + "y" * 900]):
        r, n = random.Random(i), len(text.encode().split())
        mask = np.array([r.random() < 0.4 for _ in range(n)], bool)
        kept, _, k, removed = line_dedup.drop_words(text, mask)
        words = text.encode().split()
        assert kept.encode().split() == [w for w, m in zip(words, mask, strict=True) if not m] and k == mask.sum()
        assert removed.encode().split() == [w for w, m in zip(words, mask, strict=True) if m]
        assert line_dedup.drop_words(text, np.ones(n, bool))[0].split() == [] and line_dedup.drop_words(text, np.zeros(n, bool))[0] == text


def test_patience_is_a_common_subsequence():
    r = random.Random(2)
    for _ in range(300):
        a, b = ([r.randint(0, 8) for _ in range(r.randint(0, 20))] for _ in range(2))
        got = line_dedup.patience(a, b)
        assert all(a[i] == b[j] for i, j in got)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(got[:-1], got[1:], strict=True))
        assert not set(a) & set(b) or got
    assert line_dedup.patience([1, 2, 3, 4, 5], [9, 2, 3, 8, 5]) == [(1, 1), (2, 2), (4, 4)]


def bag(text):
    w = (text or "").lower().split()
    n = min(5, len(w))
    return Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if w else Counter()


def test_bagminhash_classes_match_brute_force(spark):
    rows, r = list(ODD), random.Random(9)
    for k in range(40):  # copies with edits around the threshold, and copies of copies
        base = prose(150, 1000 + k % 8).split()
        for _ in range(r.randint(0, 6)):
            base[r.randrange(len(base))] = "edited"
        rows.append((100 + k, " ".join(base)))
    rows += [(300, "a b c d e " * 30), (301, "a b c d e " * 33), (302, "a b c d e " * 12)]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    bags = [bag(t) for _, t in rows]
    for i in range(len(rows)):
        for j in range(i):
            union = sum((bags[i] | bags[j]).values())
            if (rows[i][1] or "") == (rows[j][1] or "") or union and sum((bags[i] & bags[j]).values()) >= 0.8 * union:
                parent[find(i)] = find(j)
    classes = defaultdict(list)
    for i in range(len(rows)):
        classes[find(i)].append(rows[i][0])
    want = Counter()
    for ids in classes.values():
        least = min((x for x in ids if x is not None), default=None)
        for x in ids:
            want[x, least, len(ids)] += 1
    got = bagminhash.groups(full(spark, rows)).collect()
    assert Counter((r.doc_id, r.class_id, r.class_size) for r in got) == want
    kept = bagminhash.dedup(full(spark, rows))
    assert kept.columns == full(spark, rows).columns and kept.count() == len(classes)
    assert bagminhash.groups(empty(spark)).count() == 0 and bagminhash.dedup(empty(spark)).count() == 0


def test_bagminhash_verifies_a_pair_once_however_often_its_rows_repeat(spark):
    rows = [(1, prose(200, 1)), (2, prose(200, 1) + " end")] * 300 + [(None, prose(60, 5))] * 40
    docs = spark.createDataFrame(rows, SCHEMA)
    text = bagminhash.whole_text()
    texts = docs.select("doc_id", bagminhash.F.md5(text.cast("binary")).alias("digest"), text.alias("text"))
    ids = {r.doc_id: r.digest for r in texts.distinct().collect()}
    pairs = spark.createDataFrame([(ids[1], 1, ids[2], 2, 5_000), (ids[1], 1, ids[2], 2, 2)], "a string, a_id long, b string, b_id long, n long")
    pairs = pairs.withColumn("a", pairs.a.cast("binary")).withColumn("b", pairs.b.cast("binary"))
    done = bagminhash.verify(pairs, texts.withColumn("digest", texts.digest.cast("binary")), 0.8)
    assert [r.similar for r in done.collect()] == [True]
    got = Counter((r.doc_id, r.class_id, r.class_size) for r in bagminhash.groups(docs).collect())
    assert got == Counter({(1, 1, 600): 300, (2, 1, 600): 300, (None, None, 40): 40})
    assert bagminhash.dedup(docs).count() == 2


def test_bagminhash_hot_bucket(spark):
    r, base = random.Random(2), prose(120, 9).split()
    rows = []
    for i in range(400):  # near copies of one text, each with one edit of its own
        w = list(base)
        w[r.randrange(len(w))] = f"edit{i}"
        rows.append((i, " ".join(w)))
    got = bagminhash.groups(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {(x.class_id, x.class_size) for x in got} == {(0, 400)}


def test_bagminhash_estimates_weighted_jaccard():
    r = np.random.default_rng(3)
    element = r.integers(0, 1 << 63, 60).astype(np.uint64)
    a, b = r.integers(1, 9, 60), r.integers(1, 9, 60)
    true = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    doc = np.repeat([0, 1], 60)
    s = bagminhash.signatures(doc, np.tile(element, 2), np.concatenate([a, b]), 3, size=4096)
    assert abs((s[0] == s[1]).mean() - true) < 4 * (true * (1 - true) / 4096) ** 0.5
    assert np.isfinite(s[:2]).all() and np.isinf(s[2]).all()


def test_components(spark):
    edges = [(f"{a:03d}".encode(), f"{b:03d}".encode()) for a, b in [*[(i, i + 1) for i in range(40)], (50, 52), (52, 51), (60, 61)]]
    got = {bytes(r.node): bytes(r.label) for r in bagminhash.components(spark.createDataFrame(edges, "a binary, b binary")).collect()}
    assert all(got[f"{i:03d}".encode()] == b"000" for i in range(41)) and got[b"051"] == got[b"052"] == b"050" and got[b"061"] == b"060"


def test_toxicity(spark):
    r = random.Random(5)
    rows, labels = [], []
    for i in range(400):
        words, bad = prose(r.randint(20, 120), 5000 + i).split(), i % 4 == 0
        for _ in range(2 + len(words) // 20 if bad else 0):
            words[r.randrange(len(words))] = "vile" + r.choice(["", "ness", "ly", "st", "ster"])
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    docs = full(spark, rows + [(1000, None), (1001, ""), (None, "x"), (1002, "vile " * 5000), (1002, "vile " * 5000)])
    marks = spark.createDataFrame([*labels, (None, 1), (3, None), (4, 1)], "doc_id long, toxic int")
    network = toxicity.fit(docs, marks)
    got = toxicity.score(docs, network).collect()
    assert len(got) == 405 and all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.5) for x in got)
    truth = dict(labels)
    held = [x for x in got if x.held_out and x.doc_id is not None and x.doc_id < 400]
    assert {x.doc_id for x in held} == {i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0}
    assert np.mean([x.predicted == truth[x.doc_id] for x in held]) > 0.9
    assert all(x.predicted == 1 for x in got if x.doc_id == 1002)
    kept = toxicity.keep_clean(docs, network)
    assert kept.columns == docs.columns and kept.count() == sum(1 - x.predicted for x in got)
    assert toxicity.score(empty(spark), network).count() == 0
    nothing = toxicity.fit(docs, marks.limit(0))
    assert {x.score for x in toxicity.score(docs, nothing).collect()} == {0.5}


def plain_score(network, text):
    """One word, one window, one step at a time, in double precision."""
    p = {k: v.astype(np.float64) for k, v in network.p.items()}
    mask, times = (1 << 64) - 1, 0x9E3779B97F4A7C15

    def vector(word):
        marked = b"<" + toxicity.core(word).encode() + b">"
        grams = []
        for size in (3, 4, 5):
            for i in range(len(marked) - size + 1):
                h = size
                for c in marked[i : i + size]:
                    h = (h * times + c + 1) & mask
                h = ((h ^ (h >> 29)) * times) & mask
                grams.append(p["char"][(h >> 40) % toxicity.CHAR_ROWS])
        return np.concatenate([p["word"][xxhash.xxh3_64_intdigest(marked) % toxicity.WORD_ROWS], np.mean(grams, axis=0)])

    words = toxicity.words_of(text)
    best = -np.inf
    for at in range(0, max(1, len(words) - toxicity.WINDOW + toxicity.STRIDE), toxicity.STRIDE):
        inputs = [vector(w) for w in words[at : at + toxicity.WINDOW]]
        att, out = np.zeros(toxicity.WINDOW), np.zeros(toxicity.WINDOW)
        for side in "fb":
            h = np.zeros(toxicity.HIDDEN)
            for t in range(toxicity.WINDOW) if side == "f" else reversed(range(toxicity.WINDOW)):
                gate = lambda g: (inputs[t] @ p[f"{side}x{g}"] if t < len(inputs) else 0) + p[f"{side}c{g}"]  # noqa: E731, B023
                z, r = (1 / (1 + np.exp(-(gate(g) + h @ p[f"{side}h{g}"]))) for g in "zr")
                c = np.tanh(gate("n") + r * (h @ p[f"{side}hn"]))
                h = z * h + (1 - z) * c
                att[t] += h @ p[f"{side}_att"]
                out[t] += h @ p[f"{side}_out"]
        n = len(inputs) or toxicity.WINDOW
        share = np.exp(att[:n] - att[:n].max())
        best = max(best, share @ out[:n] / share.sum() + p["out_b"][0])
    return 1 / (1 + np.exp(-(network.scale * best + network.shift)))


def test_toxicity_scores_match_plain_windows():
    network = toxicity.Network.fresh(4)
    network.scale, network.shift = 1.7, -0.3
    r = np.random.default_rng(8)
    for k in network.p:
        if k[1] == "c":
            network.p[k] = r.standard_normal(network.p[k].shape).astype(np.float32)
    texts = ["one", prose(32, 1), prose(33, 2), prose(48, 3), prose(49, 4), prose(200, 5), "\u65e5\u672c\u8a9e" * 40, "a_b" * 60 + " end", "!!! ... x", prose(31, 6) + " \n"]
    got = toxicity.Reader(network).score(texts)
    assert np.abs(got - [plain_score(network, t) for t in texts]).max() < 2e-5


def test_toxicity_labels_that_conflict_and_the_bound_of_bytes(spark):
    docs = spark.createDataFrame([(i, f"word{i} " * 50) for i in range(60)], SCHEMA)
    labels = [(i, int(i % 2)) for i in range(60)]
    marks = spark.createDataFrame(labels + [(i, 0) for i in range(60)], "doc_id long, toxic int")
    seen = {}
    original = toxicity.train
    try:
        toxicity.train = lambda texts, own, weights: seen.update(texts=texts, labels=own, weights=weights) or original(texts, own, weights)
        toxicity.fit(docs, marks.repartition(5), sample_bytes=10_000)
    finally:
        toxicity.train = original
    learnt = [int(t.split()[0].removeprefix("word")) for t in seen["texts"]]
    assert 0 < sum(map(len, seen["texts"])) <= 10_000 and [i % 2 for i in learnt] == seen["labels"]
    assert all(zlib.crc32(str(i).encode()) % 5 for i in learnt)


def test_toxicity_gradients():
    n = toxicity.Network.fresh(1)
    n.p = {k: v.astype(np.float64) for k, v in n.p.items()}
    r = np.random.default_rng(2)
    gates = {s + g: r.standard_normal((6, toxicity.HIDDEN)) for s in "fb" for g in "zrn"}
    w, y = r.integers(1, 6, (4, 7)), np.array([0, 1, 1, 0.0])
    w[0, 4:] = 0
    grad, d_gates, _ = n.backward(gates, w, y)
    for box, name, d in [(n.p, "fhz", grad["fhz"]), (n.p, "b_att", grad["b_att"]), (gates, "bn", d_gates["bn"]), (gates, "fr", d_gates["fr"])]:
        at = tuple(r.integers(0, k) for k in box[name].shape)
        if name in gates:
            at = (int(w[1, 2]), at[1])
        x, e = box[name][at], 5e-3
        box[name][at] = x + e
        up = n.backward(gates, w, y)[2]
        box[name][at] = x - e
        down = n.backward(gates, w, y)[2]
        box[name][at] = x
        assert abs((up - down) / (2 * e) - d[at]) < 2e-4
    f32 = {k: v.astype(np.float32) for k, v in gates.items()}
    n.p = {k: v.astype(np.float32) for k, v in n.p.items()}
    logit = n.logits(f32, w)
    assert abs(np.mean(np.logaddexp(0, logit) - y * logit) - n.backward(f32, w, y)[2]) < 1e-5


def test_windows_cover_every_word():
    for n in [0, 1, 31, 32, 33, 48, 49, 500]:
        at, text = toxicity.windows_of(np.array([n, 3]))
        assert set(at[text == 0].ravel()) - {-1} == set(range(n)) and set(at[text == 1].ravel()) - {-1} == {n, n + 1, n + 2}


def test_rollups(spark):
    from tokenizers import Tokenizer

    from helixmap.llm.tokens import vocabulary_path

    docs = full(spark, ODD)
    t = Tokenizer.from_file(vocabulary_path("byte_bpe_50k.json"))
    rows = [(r.doc_id, r.text or "", r.source, r.lang) for r in docs.collect()]
    first = {}
    for i, text, source, lang in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[2] is not None, r[2] or "", r[3] is not None, r[3] or "")):
        first.setdefault(text, (source, lang))
    want = defaultdict(lambda: [0, 0, 0])
    for text, (source, lang) in first.items():
        x = want[source, lang]
        for k, v in enumerate((1, len(t.encode(text, add_special_tokens=False).ids) + 1, len(text.encode()))):
            x[k] += v
    got = rollups.corpus_history(docs, ["byte_bpe_50k"]).collect()
    assert {(r.source, r.lang): [r.docs, r.tokens, r.n_bytes] for r in got} == dict(want)


def test_rollup_commits_are_idempotent_and_survive_a_dead_batch(spark):
    store = rollups.Rollup(spark, shared_folder(spark, "rollup-test"))
    assert store.totals().count() == 0
    e = spark.createDataFrame([("s", "en", "v1", 10, 5, "x"), ("s", "en", "v1", 7, None, "y"), (None, "en", "v1", 1, 1, "z")], "source string, lang string, tokenizer_version string, tokens long, n_bytes long, extra string")
    assert store.commit("a", rollups.inserts(e)) and not store.commit("a", rollups.inserts(e))
    store._fs()[0].delete(store.spark._jvm.org.apache.hadoop.fs.Path(store.path + "/batch-a/_SUCCESS"), False)
    assert store.committed() == [] and store.commit("a", rollups.inserts(e))
    assert store.commit("b", rollups.deletes(e.where("source is null")))
    assert store.commit("c", rollups.revisions(e.where("tokens = 10"), e.where("tokens = 10").selectExpr("source", "lang", "'v2' tokenizer_version", "9 tokens", "n_bytes")))
    assert sorted(tuple(r) for r in store.totals().collect()) == [("s", "en", "v1", 1, 7, 0), ("s", "en", "v2", 1, 9, 5)]
    assert store.commit("empty", rollups.inserts(e.limit(0)))


def plain_fingerprint(text):
    """Votes of word pairs, each hashed by xxhash64 with seed 42 and the first word's hash as the second's seed."""
    words = re.split("[ \\t\\n\\r]+", text)
    hashes = []
    for a, b in zip(words, [*words[1:], None], strict=True):
        h = xxhash.xxh64_intdigest(a.encode(), 42)
        hashes.append(h if b is None else xxhash.xxh64_intdigest(b.encode(), h))
    return sum(1 << j for j in range(64) if 2 * sum(h >> j & 1 for h in hashes) > len(hashes))


def test_simhash(spark):
    rows = ODD + [(i, prose(40, i % 37)) for i in range(20, 140)]
    docs = full(spark, rows)
    got = simhash.edit_and_compare(docs)
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    got = got.collect()
    assert len(got) == len(rows)
    unique = [k for k, (i, _) in enumerate(order) if i is not None and sum(1 for j, _ in rows if j == i) == 1 and 0 < k < len(order) - 1]
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    import hashlib

    fps = {t or "": plain_fingerprint(t or "") for _, t in rows}
    same = lambda a, b: 1 - bin((a ^ b) & (2**64 - 1)).count("1") / 64
    for k in unique:
        i, text, after = order[k][0], order[k][1] or "", order[k + 1][1] or ""
        if order[k + 1][0] in (None, 5):
            continue
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        r = by[i]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest(), i
        assert r.fingerprint == f"{fps[text] & (2**64 - 1):016x}" and r.near_next == same(fps[text], fps[after])
        assert r.edited_fingerprint == f"{plain_fingerprint(edited):016x}" and r.near_edited == same(fps[text], plain_fingerprint(edited))
    every = [fps[t or ""] for _, t in rows]
    for r in got:
        want = None if r.doc_id is None or r.doc_id % 20 else sum(same(fps[dict(rows)[r.doc_id] or ""], f) >= 1 - 3 / 64 for f in every)
        assert r.n_near == want
    assert simhash.edit_and_compare(empty(spark)).count() == 0
    alone = simhash.edit_and_compare(spark.createDataFrame([(1, "abcd")], SCHEMA)).first()
    assert alone.near_next == 1.0 and alone.edited_sha256 == hashlib.sha256(b"abab").hexdigest()


def test_radius_search_finds_all_pairs_once(spark):
    r = random.Random(8)
    fps = set()
    for _ in range(30):
        f = r.getrandbits(64)
        for _ in range(6):
            g = f
            for b in r.sample(range(64), r.randint(0, 6)):
                g ^= 1 << b
            fps.add(g - (1 << 64) if g >> 63 else g)
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    for radius in (1, 3, 5):
        got = [(x.q, x.fp) for x in simhash.within_radius(df, df, radius).collect()]
        want = {(a, b) for a in fps for b in fps if bin((a ^ b) & (2**64 - 1)).count("1") <= radius}
        assert len(got) == len(set(got)) and set(got) == want


def test_simhash_buckets(spark):
    rows = [(i * i, f"text {i} " * 5) for i in range(300)] + [(None, "nothing")]
    got = {r.doc_id: r.next_text for r in simhash.with_next(spark.createDataFrame(rows, SCHEMA), bucket_rows=20).where("not ghost").collect()}
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    assert got == {a[0]: b[1] for a, b in zip(order, order[1:] + order[:1], strict=True)}


def test_simhash_buckets_of_outliers_and_missing_ids(spark):
    r = random.Random(3)
    ids = [*range(1000, 1400), -(1 << 63), (1 << 63) - 1, 10**15, *[77] * 40]
    rows = [(i, f"text {k} {r.random()}") for k, i in enumerate(ids)] + [(None, f"none {k}") for k in range(300)]
    r.shuffle(rows)
    rows_of = simhash.with_next(spark.createDataFrame(rows, SCHEMA), bucket_rows=20).where("not ghost")
    got = Counter((x.doc_id, x.text, x.next_text) for x in rows_of.collect())
    signed = lambda t: (h := xxhash.xxh64_intdigest(t.encode(), 42)) - (1 << 64) * (h >> 63)
    order = sorted(rows, key=lambda x: (x[0] is None, -(x[0] or 0), signed(x[1])))
    assert got == Counter((*a, b[1]) for a, b in zip(order, order[1:] + order[:1], strict=True))
    assert max(x["count"] for x in rows_of.groupBy("bucket").count().collect()) <= 100


def test_mixing_matches_sql_and_meets_the_targets(spark):
    rows = ODD + [(i, ("x | y " if i % 7 == 0 else "") + prose(20 + i % 30, i) + (" License" if i % 11 == 0 else "")) for i in range(100, 900)]
    docs = full(spark, rows)
    targets = mixing.Targets(source={"src0": 0.5, "src1": 0.2}, lang={"en": 0.4}, topic={"prose": 0.6, "table": 0.3})
    got = mixing.mix(docs, targets)
    assert got.columns == [c for c in docs.columns if c != "kept"] + ["topic", "tokens", "probability", "draw", "kept"]
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text", "lang", "source").toPandas().astype({"doc_id": "Int64"}))
    key = lambda r: (repr(r[0]), *map(repr, r[1:]))
    mine = sorted([tuple(r) for r in got.selectExpr("doc_id", "source", "lang", "topic", "tokens", "round(probability, 6)", "round(draw, 9)", "kept").collect()], key=key)
    assert mine == sorted(con.execute(mixing.mix_sql(targets)).fetchall(), key=key)
    weight = Counter()
    for r in got.collect():
        weight[r.source if r.source in targets.source else "other"] += r.tokens * r.probability
    total = sum(weight.values())
    assert abs(weight["src0"] / total - 0.5) < 1e-6 and abs(weight["src1"] / total - 0.2) < 1e-6
    assert mixing.mix(empty(spark), targets).count() == 0


def test_raking_of_missing_labels():
    f = mixing.rake({("a", "x", "t"): 10.0, ("other", "x", "t"): 30.0, ("a", "y", "t"): 0.0}, mixing.Targets(source={"a": 1.0}, lang={"x": 1.0, "z": 0.5}))
    assert f["a", "y", "t"] == 1.0 and f["a", "x", "t"] > f["other", "x", "t"]
    assert mixing.rake({("a", "x", "t"): 0.0}, mixing.Targets()) == {("a", "x", "t"): 1.0}


def test_passages_at_random_offsets_go_to_the_word(spark):
    r, rows, want = random.Random(31), [], {}
    fill = lambda k: "\n".join(" ".join(f"{k}w{r.randrange(9999)}" for _ in range(r.choice([7, 30, 90]))) for _ in range(3))
    for k in range(60):
        passage = [f"p{k}x{j}" for j in range(r.choice([25, 32, 50, 55, 60]))]
        at = r.randrange(5, 20)
        wrapped = " ".join(passage) if k % 2 else " ".join(passage[:at]) + "\n" + " ".join(passage[at:])
        rows += [(k, f"{fill('a')} {' '.join(passage)} {fill('b')}"), (1000 + k, f"{fill('c')} {wrapped} {fill('d')}")]
        want[1000 + k] = passage
    for x in line_dedup.dedup(spark.createDataFrame(rows, SCHEMA)).collect():
        assert x.removed_text.split() == want.get(x.doc_id, []), x.doc_id
        assert x.text.split() == [w for w in dict(rows)[x.doc_id].split() if w not in want.get(x.doc_id, [])]


def test_common_blocks_match_brute_force():
    r = random.Random(6)
    for _ in range(300):
        a, b = ([r.randint(0, 2) for _ in range(r.randint(0, 30))] for _ in range(2))
        runs = {tuple(a[i : i + 9]) for i in range(len(a) - 8)}
        want = {j for i in range(len(b) - 8) if tuple(b[i : i + 9]) in runs for j in range(i, i + 9)}
        got = blocks(a, b, 9)  # each block is common, and all that has a run's first place in the home is found
        assert set(got) <= want and (not want or got)
    for k in range(60):  # without repeats within a document nothing is lost
        a = r.sample(range(1000), 60)
        b = [x for i in range(0, 60, 10) for x in (a[i : i + 10] if r.random() < 0.7 else r.sample(range(1000, 2000), 10))]
        if k % 2:
            b = b[30:] + b[:30]
        runs = {tuple(a[i : i + 9]) for i in range(len(a) - 8)}
        assert blocks(a, b, 9) == sorted({j for i in range(len(b) - 8) if tuple(b[i : i + 9]) in runs for j in range(i, i + 9)})


def test_a_sequence_whose_lines_stood_apart_before(spark):
    one, two, three = (prose(18, 600 + i) for i in range(3))
    rows = [(1, "\n".join([three, prose(30, 610), two, prose(31, 611), one])), (2, "\n".join([prose(20, 612), one, two, three])), (3, "\n".join([one, two, three, prose(20, 613)]))]
    got = {x.doc_id: x for x in line_dedup.dedup(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[3].removed_text == "\n".join([one, two, three]) and got[3].text == prose(20, 613) and got[3].partners == [1, 2]
    assert got[2].text == rows[1][1]


def test_toxic_terms_late_in_a_run_without_spaces():
    r = random.Random(15)
    texts, labels = [], []
    for i in range(400):
        words = prose(r.randint(20, 120), 7000 + i).split()
        for _ in range(2 + len(words) // 20 if i % 4 == 0 else 0):
            words[r.randrange(len(words))] = "vile" + r.choice(["", "ness", "ly", "st", "ster"])
        texts.append(" ".join(words))
        labels.append(int(i % 4 == 0))
    reader = toxicity.Reader(toxicity.train(texts, labels))
    for joint in ("_", ",", "\u3002"):
        clean = prose(60, 8001).replace(" ", joint)
        late = clean + joint + joint.join(["vile", "vileness", "vilely"] * 4)
        assert clean[:64] == late[:64] and (reader.score([clean, late]) >= 0.5).tolist() == [False, True]
    clean = prose(60, 8002).replace(" ", "")
    a, b = reader.worst([clean + prose(9, 8003).replace(" ", ""), clean + "vilenessvilelyvilest" * 4])
    assert b > a


def test_pieces_have_every_character():
    for n in [17, 24, 25, 64, 65, 200, 5000]:
        for mark in ("", "_", "\u3002"):
            word = mark.join(chr(0x4E00 + i) for i in range(n))  # each letter once, three bytes
            got = toxicity.words_of("one " + word + " two")
            assert got[0] == "one" and got[-1] == "two" and set("".join(got[1:-1])) == set(word)
            assert len(got) == 3 if len(word.encode()) <= 64 else all(len(p) <= toxicity.PIECE for p in got)
            assert mark or all(any(word[i : i + 5] in p for p in got) for i in range(0, n - 4, 7))
    assert toxicity.words_of("x" * 64 + " " + "-" * 70)[0] == "x" * 64 and toxicity.words_of("(" * 70 + "x")[0] == "(" * 70 + "x"


def test_raking_meets_the_target_of_a_rare_source():
    cells = {(s, c, "t"): n * (2.0 if c == "x" else 1.0) for s, n in (("rare", 1), ("a", 600), ("b", 399)) for c in "xy"}
    f = mixing.rake(cells, mixing.Targets(source={"rare": 0.05, "a": 0.05, "b": 0.9}, lang={"x": 0.5, "y": 0.5}))
    weight = {k: v * f[k] for k, v in cells.items()}
    for label, share in (("rare", 0.05), ("a", 0.05), ("x", 0.5)):
        assert abs(sum(v for k, v in weight.items() if label in k) / sum(weight.values()) - share) < 1e-9
