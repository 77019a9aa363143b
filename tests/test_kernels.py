"""Chaining, extension, paths and parameters against golden values and plain versions."""

import random

import numpy as np
import pytest

from helixmap.functions.codec import bases_of, codes_of, complement_codes, dna_bases
from helixmap.operators import chains, dp, sketch
from helixmap.plans.params import MapParams, Scoring, parse_command, parse_options, preset


def naive(a, b, s, matrix=None):
    """Score and path of the best extension, by the full recurrence."""
    m, low = s.matrix(), -(10**9)
    n, k = len(a), len(b)
    S, E, F = ([[low] * (k + 1) for _ in range(n + 1)] for _ in range(3))
    best = (0, 0, 0)
    S[0][0] = 0
    for i in range(n + 1):
        for j in range(k + 1):
            if i:
                E[i][j] = max(S[i - 1][j] - s.gi - s.ge, E[i - 1][j] - s.ge)
            if j:
                F[i][j] = max(S[i][j - 1] - s.gi - s.ge, F[i][j - 1] - s.ge)
            if i or j:
                S[i][j] = max(
                    S[i - 1][j - 1] + int(m[a[i - 1], b[j - 1]]) if i and j else low, E[i][j], F[i][j],
                    S[i - 1][j] - s.gfb if i and s.gfb else low, S[i][j - 1] - s.gfa if j and s.gfa else low,
                )
            if S[i][j] > best[0] or (S[i][j] == best[0] and best[0] and i + j < best[1] + best[2]):
                best = (S[i][j], i, j)
    return best


LINEAR, AFFINE, COMBINED = Scoring(2, 3, 0, 6, xdrop=80), Scoring(2, 3, 5, 1, xdrop=80), Scoring(2, 3, 5, 1, 2, 2, xdrop=80)
# Both texts, and for each model the score and the path, a letter for a step along either (R the first, D the second).
GOLDEN = [
    ("AAAA", "AAAA", (8, 8, 8), ("DR" * 4,) * 3),
    ("AAAAAAAA", "TAAAAAAAA", (11, 11, 14), ("DR" * 8, "DR" * 8, "D" + "DR" * 8)),
    ("GTTTTTTTT", "TTTTTTTT", (11, 11, 14), ("DR" * 8, "DR" * 8, "R" + "DR" * 8)),
    ("TTTTACGTACGT", "TTACGTACGT", (8, 13, 16), ("DRDRRRDRDRDRDRDRDRDRDR",) * 3),
    ("TTACGTACGT", "TTTTACGTACGT", (8, 13, 16), ("DRDRDDDRDRDRDRDRDRDRDR",) * 3),
    ("ATGAAGCTGCGAGGC", "TGATGGCTTGCGAGGC", (None, 6, 17), (None, "DDDRDRDRRRDRDRDRDDRDRDRDRDRDRDR", "RDRDRDRDRDRDDRDRDDRDRDRDRDRDRDR")),
]


@pytest.mark.parametrize("a,b,want,paths", GOLDEN)
def test_golden_scores(a, b, want, paths):
    for scoring, score, path in zip((LINEAR, AFFINE, COMBINED), want, paths, strict=True):
        if score is None:
            continue
        x, y = codes_of(a), codes_of(b)
        assert naive(x, y, scoring)[0] == score
        got, i, j, way = dp.extend([(x, y)], scoring)[0]
        assert got == score and dp.rescore(way, x[:i], y[:j], scoring)["score"] == score
        assert "".join({"M": "DR", "D": "R", "I": "D"}[c] for c in way) == path


def test_wrapper_scores():
    a, b = codes_of("GGAAAAAAAA"), codes_of("AAAAAAAA")
    assert dp.extend([(a, b)], Scoring(1, 1, 0, 1))[0][0] == 6 and dp.extend([(a, b)], Scoring(1, 1, 1, 1))[0][0] == 5


# Bits of paths, low bit first, their offset and length, and both texts.
PATHS = [
    ("55555555", 0, 32, "16M", "16M"), ("55550000 55555555 55555555 55555555", 16, 112, "56M", "56M"), ("55", 0, 8, "4M", "4M"),
    ("55550555", 0, 32, "6M4D8M", "8M4D6M"), ("5555f555", 0, 32, "6M4I8M", "8M4I6M"), ("aaaa0555", 0, 33, "6M5D8M", "8M5D6M"),
    ("aaabf555", 0, 33, "6M5I8M", "8M5I6M"), ("aaabf555 aaaa0556", 0, 65, "6M5I8M1I5M5D8M", "8M5D5M1I8M5I6M"),
    ("aaabf554 aaaa0556 aaaaaaaa", 0, 65, "2D5M5I8M1I5M5D8M", "8M5D5M1I8M5I5M2D"),
]


@pytest.mark.parametrize("words,offset,length,forward,reverse", PATHS)
def test_path_bits(words, offset, length, forward, reverse):
    bits = [(int(w, 16) >> i) & 1 for w in words.split() for i in range(32)] + [0] * 64
    assert dp.cigar_of_bits(bits[offset : offset + length]) == forward
    assert dp.cigar_of_bits(bits[offset : offset + length], reverse=True) == reverse


def mutated(r, seq, rate):
    out = []
    for c in seq:
        x = r.random()
        if x < rate / 2:
            out.append(r.randrange(4))
        elif x < rate * 0.75:
            out += [c, r.randrange(4)]
        elif x >= rate:
            out.append(c)
    return np.array(out, np.uint8)


@pytest.mark.parametrize("scoring", [LINEAR, AFFINE, COMBINED, Scoring(1, 2, 2, 1, xdrop=80), Scoring(4, 5, 8, 2, 3, 3, xdrop=80), Scoring(2, 4, 0, 3, xdrop=80)])
def test_band_matches_full_recurrence(scoring):
    r = random.Random(7)
    pairs = []
    for _ in range(40):
        a = np.array([r.randrange(4) for _ in range(r.randint(0, 90))], np.uint8)
        pairs.append((a, mutated(r, a, 0.2)))
    for (a, b), (score, i, j, path) in zip(pairs, dp.extend(pairs, scoring), strict=True):
        want = naive(a, b, scoring)
        assert score == want[0] and i + j == want[1] + want[2]
        assert path.count("M") + path.count("D") == i and path.count("M") + path.count("I") == j
        assert dp.rescore(path, a[:i], b[:j], scoring)["score"] == score


def test_long_similar_pair_stays_in_the_band():
    r = random.Random(3)
    a = np.array([r.randrange(4) for _ in range(3000)], np.uint8)
    b = mutated(r, a, 0.15)
    score, i, j, path = dp.extend([(a, b)], Scoring(2, 4, 4, 2, xdrop=80))[0]
    assert i > 2900 and dp.rescore(path, a[:i], b[:j], Scoring(2, 4, 4, 2))["score"] == score > 2000


def test_mismatch_text_and_exact_paths():
    a, b = codes_of("ACGTACGT"), codes_of("ACCTCGTT")
    assert dp.mismatch_text("MMMMDMMM", a, b[:7]) == "2G1^A3"
    assert dp.cigar(dp.extend([(a, a)], AFFINE)[0][3]) == "8M"
    assert dp.exact_cigar("MMMM", a, b) == [("=", 2), ("X", 1), ("=", 1)]


def chained(seeds, window=2000, compat=False):
    s = sorted((rid, 2 * r - q, 2 * q - r) for rid, r, q in seeds)
    rid, u, v = (np.array(x) for x in zip(*s, strict=True))
    return chains.chain(rid, u, v, window, compat)


def test_chains():
    line = [(0, 100 + 50 * i, 10 + 50 * i) for i in range(10)]
    ((length, members),) = chained(line)
    assert len(members) >= 2 and length == int((1 - 1 / len(members)) * 2 * 450)
    assert chained([(0, 5, 5)]) == [] and len(chained(line + [(1, r, q) for _, r, q in line])) == 2
    far = [(0, 50_000 + 50 * i, 10 + 50 * i) for i in range(10)]
    assert len(chained(line + far)) == 2
    other = [(0, 100 + 50 * i, 400 + 50 * i) for i in range(10)]
    found = chained(line + other)
    assert len(found) == 2 and len(chained(line + other, compat=True)) <= 2
    r, q = np.array([10, 60, 1900, 1950]), np.array([560, 610, 450, 500])  # the tail meets the head past position 2000
    linked = chains.link_circular([(10, [0, 1]), (10, [2, 3])], np.zeros(4, int), 2 * r - q, 2 * q - r, 500, {0: 2000})
    assert linked == [(20, [2, 3, 0, 1], 2)]


def plain_minimizers(codes, k, w, ring=False):
    own = len(codes)
    codes = np.concatenate([codes, codes[: min(own, w)]]) if ring else codes
    keys = []
    for p in range(len(codes) - k + 1):
        x = codes[p : p + k]
        if (x > 3).any():
            keys.append(None)
            continue
        f = int("".join(map(str, x)), 4)
        g = int("".join(str(3 - c) for c in x[::-1]), 4)
        turn = own - k + 1
        low, high = min(f, g), max(f, g)
        keys.append((int(sketch.mixed(np.array([low]), np.array([high]), k)[0]), int(f >= g), (p - turn if p >= turn else p) % w, -p))
    out, before = set(), None
    for p in range(len(keys)):
        inside = [x for x in keys[max(0, p - w + 1) : p + 1] if x]
        if not inside:
            before = None
            continue
        m = min(inside)
        if before is None or m[:3] != before[:3] or -m[3] == p:
            out.add((m[0], -m[3], m[1]))
        before = m
    return out


@pytest.mark.parametrize("k,w", [(3, 2), (5, 4), (15, 10), (21, 11), (31, 20)])
def test_minimizers_match_plain_windows(k, w):
    r = np.random.default_rng(k)
    seqs = [r.choice([0, 1, 2, 3, 4] if i % 3 == 0 else [0, 3], size=int(n)).astype(np.uint8) for i, n in enumerate(r.integers(0, 120, 30))]
    if w:
        seqs = [np.where(s == 4, 0, s).astype(np.uint8) if i % 2 else s for i, s in enumerate(seqs)]
    for ring in (False, True):
        owner, h, pos, strand = sketch.minimizers(seqs, k, w, [ring] * len(seqs))
        for i, s in enumerate(seqs):
            own = owner == i
            assert set(zip(h[own].tolist(), pos[own].tolist(), strand[own].tolist(), strict=True)) == plain_minimizers(s, k, w, ring), (i, ring)


def test_checksum_vanishes_for_short_kmers():
    x = np.random.default_rng(1).integers(0, 1 << 32, 1000)
    table = sketch._castagnoli()
    crc = x.astype(np.uint64)
    for i in range(8):
        crc = table[(crc ^ (x.astype(np.uint64) >> np.uint64(8 * i))) & np.uint64(255)] ^ (crc >> np.uint64(8))
    assert not crc.any()
    assert (sketch.mixed(x, x, 15) == x).all() and (sketch.mixed(x << 2, (x << 4) + 1, 20) != x << 2).any()
    y = sketch.scattered(np.arange(4**7), 7)
    assert len(set(y.tolist())) == 4**7


def test_codecs():
    assert dna_bases(b"ACGTUacgtn-") == "ACGTTACGTNA"[:5] + "ACGTN" + dna_bases(b"-") and bases_of(codes_of("ACGTN")) == "ACGTN"
    assert bases_of(complement_codes(codes_of("AACGN"))) == "NCGTT"


def test_parameters():
    assert MapParams().w == 10 and preset("pacbio.ccs").scoring.gi == 2 and preset("ont.r9.4.1").scoring.match == 2 and preset("ava").w == 5
    p = parse_options("-xpacbio -k13 -f0.1,0.01 -a1 -b2 -eGA+3 -r2,4 -Opaf -TAS,NM -s30 # note\n-m0.5")
    assert (p.k, p.frequencies, p.scoring.match, p.format, p.tags, p.min_score, p.min_ratio) == (13, (0.1, 0.01), 1, "paf", ("AS", "NM"), 30, 0.5)
    assert p.scoring.matrix()[2, 0] == 1 and p.scoring.model == "combined" and Scoring(gi=0).model == "linear" and Scoring().model == "affine"
    for bad in (dict(k=1), dict(w=40), dict(frequencies=(0.1, 0.2)), dict(format="x"), dict(scoring=Scoring(match=9)), dict(min_ratio=2)):
        with pytest.raises(ValueError):
            MapParams(**bad)
    for bad in ("nothing", "ont.r9.anything", "pacbio.clr.more"):
        with pytest.raises(ValueError):
            preset(bad)


# Match, mismatch, gap open and short-gap cost of the presets.
PRESETS = {
    "pacbio": (2, 4, 4, 3), "pacbio.clr": (2, 4, 4, 3), "pacbio:ccs": (2, 5, 2, 3),
    "ont": (3, 5, 6, 3), "ont.r7": (3, 4, 6, 3), "ont.r7.1d": (3, 4, 6, 3), "ont.r7.2d": (3, 4, 6, 3), "ont.r9": (3, 5, 6, 3), "ont.r9.1d": (3, 5, 6, 3), "ont.r9.1dsq": (3, 6, 6, 4), "ont.r9.2d": (3, 6, 6, 4),
    "ont.r9.4": (2, 5, 6, 3), "ont.r9.4.1": (2, 5, 6, 3), "ont.r9.4.1.1d": (2, 5, 6, 3), "ont.r9.4.1.1dsq": (2, 6, 6, 4), "ont.r9.4.1.2d": (2, 6, 6, 4), "ont.r9.4.1d": (2, 5, 6, 3), "ont.r9.5.2d": (2, 6, 6, 4), "ont.r9.5.1.1dsq": (2, 6, 6, 4),
    "ont.1d": (2, 5, 6, 3), "ont.1dsq": (2, 6, 6, 4), "ont.2d": (2, 6, 6, 4), "ava": (2, 3, 0, 0),
}


@pytest.mark.parametrize("name", PRESETS)
def test_presets(name):
    p = preset(name)
    assert (p.scoring.match, p.scoring.mismatch, p.scoring.gi, p.scoring.gfa) == PRESETS[name] and p.scoring.gfa == p.scoring.gfb
    assert (p.w, p.min_score, p.min_ratio) == ((5, 30, 0.05) if name == "ava" else (10, 50, 0.3))


def test_command_lines(tmp_path):
    c = parse_command("-t4 -xpacbio ref.fa reads.fq more.fq")
    assert c.files == ("ref.fa", "reads.fq", "more.fq") and c.params == preset("pacbio")
    c = parse_command("-XP -k 13 -d out.idx -C5,7 -v3 -1 1000 -2 512 -h -A ref.fa -c chrM,chr2")
    assert (c.params.k, c.params.w, c.index_path, c.files, c.params.circular) == (13, 9, "out.idx", ("ref.fa",), ("chrM", "chr2"))
    assert c.params.all_vs_all and c.params.omit_secondary and (c.params.base_rid, c.params.base_qid) == (5, 7)
    assert parse_command("-k13 -w 5").params.w == 5 and parse_command("-xpacbio -k13").params.w == 10 and parse_command("-c -k13").params.circular == ("*",)
    (tmp_path / "own.conf").write_text("-a 2\t-b3 # costs\n-s 77")
    p = parse_options(f"-x {tmp_path}/own.conf -s78")
    assert (p.scoring.match, p.scoring.mismatch, p.min_score) == (2, 3, 78) and preset(f"pacbio.{tmp_path}/own.conf").scoring.ge == 2
    for bad in ("-z", "-k", "-R nothing", "-k x"):
        with pytest.raises(ValueError):
            parse_command(bad)
