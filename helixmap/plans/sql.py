"""The relational stages in SQL, by which the DataFrame plans are checked."""

from __future__ import annotations

import numpy as np

from helixmap.functions.codec import encode_sql


def sequences(table: str, key: str) -> str:
    return f"SELECT {key} AS id, {encode_sql('text')} AS seq FROM {table}"


def kmers(name: str, source: str, k: int) -> str:
    """CTEs whose last, ``name``, has id, pos, fw, rv, hash and strand; k at most 15.

    Values of 2, 4 and 8 bases are made of two of half the length, and k of those by its binary digits.
    """
    out = [f"{name}_s AS ({source})"]
    out.append(f"{name}_b AS (SELECT id, length(seq) AS len, unnest(range(length(seq))) AS pos, unnest(string_split(seq, '')) AS b FROM {name}_s WHERE length(seq) > 0)")
    out.append(f"{name}_1 AS (SELECT id, len, pos, instr('ACGT', b) - 1 AS f1, 4 - instr('ACGT', b) AS r1 FROM {name}_b)")
    over = "OVER (PARTITION BY id ORDER BY pos)"
    have = [1]
    for size in (2, 4, 8):
        if size > k:
            break
        h = size // 2
        out.append(f"{name}_{size} AS (SELECT *, f{h} * {4**h} + lead(f{h}, {h}) {over} AS f{size}, r{h} + {4**h} * lead(r{h}, {h}) {over} AS r{size} FROM {name}_{h})")
        have.append(size)
    fw, rv, at = "0", "0", 0
    for size in reversed(have):
        if k & size:
            shift = f"lead({{}}{size}, {at}) {over}" if at else f"{{}}{size}"
            fw = f"({fw}) * {4**size} + {shift.format('f')}"
            rv = f"({rv}) + {4**at} * {shift.format('r')}"
            at += size
    out.append(f"{name}_v AS (SELECT id, len, pos, CAST({fw} AS BIGINT) AS fw, CAST({rv} AS BIGINT) AS rv FROM {name}_{have[-1]})")
    out.append(f"{name} AS (SELECT id, CAST(pos AS INTEGER) AS pos, fw, rv, least(fw, rv) AS hash, CAST(fw >= rv AS INTEGER) AS strand FROM {name}_v WHERE pos <= len - {k})")
    return ",\n".join(out)


def minimizers(name: str, source: str, k: int, w: int, turn: str = "") -> str:
    """CTEs whose last, ``name``, has id, hash, pos and strand.

    ``turn``: for circular sequences an expression of the position at which local indexes begin anew.
    """
    out = [kmers(f"{name}_k", source, k)]
    local = f"CASE WHEN pos >= {turn} THEN pos - ({turn}) ELSE pos END" if turn else "pos"
    joined = f"{name}_k JOIN {name}_k_s USING (id)" if turn else f"{name}_k"
    over = "OVER (PARTITION BY id ORDER BY pos)"
    out.append(f"{name}_e AS (SELECT id, pos, hash * 64 + strand * 32 + ({local}) % {w} AS e FROM {joined})")
    out.append(f"{name}_w AS (SELECT id, pos, e, min(struct_pack(e := e, back := -pos)) OVER (PARTITION BY id ORDER BY pos ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW) AS m FROM {name}_e)")
    out.append(f"{name}_c AS (SELECT id, pos, e, m, lag(m.e) {over} AS p FROM {name}_w)")
    out.append(f"{name} AS (SELECT DISTINCT id, m.e // 64 AS hash, CAST(-m.back AS INTEGER) AS pos, CAST((m.e // 32) % 2 AS INTEGER) AS strand FROM {name}_c WHERE p IS NULL OR p <> m.e OR -m.back = pos)")
    return ",\n".join(out)


def thresholds(name: str, count_table: str, frequencies: tuple[float, ...]) -> str:
    """CTEs whose last, ``name``, has i, frequency and occ."""
    singles = ", ".join(f"({i}, CAST({f!r} AS DOUBLE), CAST({float(np.float32(f))!r} AS DOUBLE))" for i, f in enumerate(frequencies))
    return f"""{name}_h AS (SELECT n, sum(count(*)) OVER (ORDER BY n) AS cum FROM {count_table} GROUP BY n),
{name}_t AS (SELECT max(cum) AS total FROM {name}_h),
{name} AS (SELECT i, frequency, CAST(min(n) + 1 AS BIGINT) AS occ FROM (VALUES {singles}) v(i, frequency, single), {name}_t, {name}_h
  WHERE cum > least(floor((1.0::DOUBLE - single) * total), total - 1) GROUP BY i, frequency)"""


def index(name: str, source: str, k: int, w: int, frequencies: tuple[float, ...]) -> str:
    """CTEs ``name_m`` (minimizers), ``name_n`` (hash, n), ``name_o`` (thresholds) and ``name`` (those within the last)."""
    return ",\n".join([
        minimizers(f"{name}_m", source, k, w),
        f"{name}_n AS (SELECT hash, count(*) AS n FROM {name}_m GROUP BY hash)",
        thresholds(f"{name}_o", f"{name}_n", frequencies),
        f"{name} AS (SELECT m.*, n FROM {name}_m m JOIN {name}_n USING (hash) WHERE n <= (SELECT occ FROM {name}_o ORDER BY i DESC LIMIT 1))",
    ])


def seeds(name: str, queries: str, refs: str, k: int, extra: str = "") -> str:
    """CTE ``name``: qid, rid, hash, n, rpos, qpos, u, v, round from minimizers ``queries`` and the index ``refs``."""
    return f"""{name}_j AS (
  SELECT q.id AS qid, r.id AS rid, q.hash, r.n, CAST(q.pos AS BIGINT) AS qp, q.strand AS qs, CAST(r.pos AS BIGINT) AS rp, r.strand AS rs
  FROM {queries} q JOIN {refs} r USING (hash) {extra}),
{name}_p AS (SELECT qid, rid, hash, n, rp + rs * {k} AS rpos, CASE WHEN qs = 1 THEN -(qp + {k}) - 1 ELSE qp END AS s, rs FROM {name}_j),
{name}_q AS (SELECT qid, rid, hash, n, rpos, CASE WHEN rs = 1 THEN -s - 1 ELSE s END AS qpos FROM {name}_p),
{name} AS (SELECT qid, rid, hash, n, rpos, qpos, 2 * rpos - qpos AS u, 2 * qpos - rpos AS v,
  CAST((SELECT min(i) FROM {refs}_o o WHERE {name}_q.n <= o.occ) AS INTEGER) AS round FROM {name}_q)"""
