"""Banded extension with affine gaps, many pairs at once.

The band is a vector of cells on one anti-diagonal, cell t at (i0 - t, j0 + t); all pairs of a batch step together in
arrays of pairs by cells. A pair's band moves along the reference or the query, whichever end of the band scores more.
A pair ends when its band has left both sequences or its middle has dropped too far below the best score.
"""

from __future__ import annotations

import numpy as np

from helixmap.plans.params import Scoring

LOW = -(1 << 28)
#: What a cell came from, in the order in which ties are broken on the way back; two bits more tell whether the long
#: gaps that end here go on.
SHORT_B, LONG_B, SHORT_A, LONG_A, DIAGONAL = range(5)
EXTEND_A, EXTEND_B = 8, 16
CHECK_STEPS = 32


def extend(pairs: list[tuple[np.ndarray, np.ndarray]], scoring: Scoring, band: int = 64, trace: bool = True) -> list[tuple[int, int, int, str]]:
    """For each (reference codes, query codes) the best score, its end in both and the path to it.

    The alignment starts at both heads; the path's letters are M, D (a reference base alone) and I (a query base alone). Of
    equal scores the one with the least i + j wins. A best score of 0 is the empty path. Without ``trace`` paths are
    left empty and nothing is kept for them.
    """
    n = len(pairs)
    if not n:
        return []
    la, lb = (np.array([len(p[k]) for p in pairs], np.int32) for k in (0, 1))
    codes_a, codes_b = np.full((n, int(la.max()) + 2), 4, np.uint8), np.full((n, int(lb.max()) + 2), 4, np.uint8)
    for k, (a, b) in enumerate(pairs):
        codes_a[k, : len(a)], codes_b[k, : len(b)] = a, b
    rows, cell, half = np.arange(n), np.arange(band, dtype=np.int32), band // 2
    matrix = scoring.matrix()
    uniform = not scoring.bonus
    award, cost = np.int32(scoring.match + scoring.mismatch), np.int32(scoring.mismatch)
    first, each, short_a, short_b = (np.int32(x) for x in (scoring.gi + scoring.ge, scoring.ge, scoring.gfb, scoring.gfa))
    i0, j0 = np.full(n, half, np.int32), np.full(n, -half, np.int32)
    padded = lambda: np.full((n, band + 2), LOW, np.int32)
    s, e, f = padded(), padded(), padded()
    s[:, 1 + half] = 0
    base = np.full((n, band + 1), LOW, np.int32)  # two steps before, as the vector before lies
    # the codes that face each other in the cells; cell t holds (i0 - t, j0 + t)
    own_a, own_b = (np.full((n, band), 4, np.uint8) for _ in range(2))
    for t in range(half):
        own_a[:, t] = codes_a[rows, np.minimum(half - t - 1, la)]
    for t in range(half + 1, band):
        own_b[:, t] = codes_b[rows, np.minimum(t - half - 1, lb)]
    best, best_step, best_j = np.zeros(n, np.int32), np.zeros(n, np.int64), np.zeros(n, np.int64)
    alive = np.ones(n, bool)
    ways, begins = [], [j0.copy()]
    for step in range(1, int((la + lb).max()) + 1):
        head, tail = s[:, 1], s[:, band]
        known = (i0 <= la) & (j0 >= 0) & (i0 - band + 1 >= 0) & (j0 + band - 1 <= lb)  # both ends inside: else keep straight on
        down = np.where(known & (head != tail), head < tail, step % 2 == 0)
        down = np.where(i0 - band + 1 >= la, True, np.where(j0 >= lb, False, down))
        i0, j0 = i0 + ~down, j0 + down
        d = down[:, None]
        right, lower = np.flatnonzero(~down), np.flatnonzero(down)
        own_a[right, 1:] = own_a[right, :-1]
        own_a[right, 0] = codes_a[right, np.minimum(i0[right] - 1, la[right])]
        own_b[lower, :-1] = own_b[lower, 1:]
        at = j0[lower] + band - 2
        own_b[lower, -1] = np.where(at >= 0, codes_b[lower, np.clip(at, 0, lb[lower])], 4)
        s_a, s_b = np.where(d, s[:, 2:], s[:, 1:-1]) - first, np.where(d, s[:, 1:-1], s[:, :-2]) - first
        ext_a, ext_b = np.where(d, e[:, 2:], e[:, 1:-1]) - each, np.where(d, f[:, 1:-1], f[:, :-2]) - each
        new_e, new_f = np.maximum(s_a, ext_a), np.maximum(s_b, ext_b)
        score = ((own_a == own_b) & (own_a < 4)) * award - cost if uniform else matrix[own_a, own_b]
        diagonal = np.where(d, base[:, 1:], base[:, :-1]) + score
        new_s = np.maximum(np.maximum(new_f, new_e), diagonal)
        if short_a:
            jump_a = s_a + (first - short_a)
            new_s = np.maximum(new_s, jump_a)
        if short_b:
            jump_b = s_b + (first - short_b)
            new_s = np.maximum(new_s, jump_b)
        if trace:
            way = np.where(new_e == new_s, np.uint8(LONG_A), np.uint8(DIAGONAL))
            if short_a:
                way[jump_a == new_s] = SHORT_A
            way[new_f == new_s] = LONG_B
            if short_b:
                way[jump_b == new_s] = SHORT_B
            way |= (ext_a > s_a).view(np.uint8) * np.uint8(EXTEND_A) | (ext_b > s_b).view(np.uint8) * np.uint8(EXTEND_B)
            ways.append(way)
            begins.append(j0)
        low = np.maximum(np.maximum(i0 - la, -j0), 0)
        high = np.where(alive, np.minimum(np.minimum(i0, lb - j0), band - 1), -1)
        new_s = np.where((cell >= low[:, None]) & (cell <= high[:, None]), new_s, LOW)
        base = np.where(d, s[:, 1:], s[:, :-1])
        s, e, f = padded(), padded(), padded()
        s[:, 1:-1], e[:, 1:-1], f[:, 1:-1] = new_s, new_e, new_f
        top = new_s.argmax(axis=1)
        value = new_s[rows, top]
        more = value > best
        if more.any():
            best, best_step, best_j = np.where(more, value, best), np.where(more, step, best_step), np.where(more, j0 + top, best_j)
        if step % CHECK_STEPS == 0:
            middle = np.where((half >= low) & (half <= high), new_s[:, half], value)
            alive &= (middle >= best - scoring.xdrop) & (value > LOW // 2)
            if not alive.any():
                break
    out = []
    for k in range(n):
        if best[k] <= 0:
            out.append((0, 0, 0, ""))
            continue
        j = int(best_j[k])
        i = int(best_step[k]) - j
        out.append((int(best[k]), i, j, _back(i, j, k, ways, begins) if trace else ""))
    return out


def _back(i: int, j: int, k: int, ways: list[np.ndarray], begins: list[np.ndarray]) -> str:
    path, state = [], None
    while i + j > 0:
        step = i + j
        way = int(ways[step - 1][k, j - int(begins[step][k])])
        if state is None:
            kind = way & 7
            if kind == DIAGONAL:
                path.append("M")
                i, j = i - 1, j - 1
                continue
            if kind in (SHORT_A, SHORT_B):
                path.append("D" if kind == SHORT_A else "I")
                i, j = (i - 1, j) if kind == SHORT_A else (i, j - 1)
                continue
            state = kind
        if state == LONG_A:
            path.append("D")
            state = LONG_A if way & EXTEND_A else None
            i -= 1
        else:
            path.append("I")
            state = LONG_B if way & EXTEND_B else None
            j -= 1
    return "".join(reversed(path))


def runs(path: str) -> list[tuple[str, int]]:
    """Equal neighbouring letters as (letter, length)."""
    out: list[tuple[str, int]] = []
    for letter in path:
        if out and out[-1][0] == letter:
            out[-1] = (letter, out[-1][1] + 1)
        else:
            out.append((letter, 1))
    return out


def cigar(path: str) -> str:
    return "".join(f"{n}{op}" for op, n in runs(path))


def cigar_of_bits(bits: list[int], reverse: bool = False) -> str:
    """The text of a path of bits, 1 a step along the query and 0 one along the reference.

    Forward, a run of ones is an insertion but for its last, which begins a diagonal; a run of zeros is a deletion; then
    pairs of one and zero are matches. In reverse, from the tail, a run of zeros keeps its last for a diagonal.
    """
    seq = bits[::-1] if reverse else bits
    lends, other = (0, 1) if reverse else (1, 0)
    names = {1: "I", 0: "D"}

    def run(at: int, bit: int) -> int:
        end = at
        while end < len(seq) and seq[end] == bit:
            end += 1
        return end - at

    out, at = "", 0
    while at < len(seq):
        before = at
        n = run(at, lends)
        n -= n > 0 and at + n < len(seq)  # at the very end no diagonal follows
        out += f"{n}{names[lends]}" if n else ""
        at += n
        n = run(at, other)
        out += f"{n}{names[other]}" if n else ""
        at += n
        n = 0
        while seq[at : at + 2] == [lends, other]:
            n, at = n + 1, at + 2
        out += f"{n}M" if n else ""
        if at == before:
            break
    return out


def exact_cigar(path: str, a: np.ndarray, b: np.ndarray) -> list[tuple[str, int]]:
    """The path with matches told as = and X."""
    i = j = 0
    out = []
    for op in path:
        if op == "M":
            out.append("=" if a[i] == b[j] and a[i] < 4 else "X")
            i, j = i + 1, j + 1
        else:
            out.append(op)
            i, j = (i + 1, j) if op == "D" else (i, j + 1)
    return runs("".join(out))


def rescore(path: str, a: np.ndarray, b: np.ndarray, scoring: Scoring) -> dict[str, int]:
    """Score, matches, mismatches and gap bases of a path over two sequences from their heads."""
    matrix = scoring.matrix()
    i = j = 0
    total = {"score": 0, "match": 0, "mismatch": 0, "gap_a": 0, "gap_b": 0}
    for op, n in runs(path):
        if op == "M":
            x, y = a[i : i + n], b[j : j + n]
            total["score"] += int(matrix[x, y].sum())
            same = int(((x == y) & (x < 4)).sum())
            total["match"] += same
            total["mismatch"] += n - same
            i, j = i + n, j + n
        else:
            short = scoring.gfb if op == "D" else scoring.gfa
            cost = scoring.gi + scoring.ge * n
            total["score"] -= min(cost, short * n) if short else cost
            total["gap_a" if op == "D" else "gap_b"] += n
            i, j = (i + n, j) if op == "D" else (i, j + n)
    return total


def mismatch_text(path: str, a: np.ndarray, b: np.ndarray) -> str:
    """The MD tag: run lengths of matches, reference bases at mismatches, and deleted bases after a caret."""
    i = j = run = 0
    out = []
    for op, n in runs(path):
        if op == "M":
            for k in range(n):
                if a[i + k] == b[j + k] and a[i + k] < 4:
                    run += 1
                else:
                    out.append(f"{run}{'ACGTN'[a[i + k]]}")
                    run = 0
            i, j = i + n, j + n
        elif op == "D":
            out.append(f"{run}^{''.join('ACGTN'[x] for x in a[i : i + n])}")
            run = 0
            i += n
        else:
            j += n
    return "".join(out) + str(run)
