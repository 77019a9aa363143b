"""Chaining of seeds: a small state machine over the seeds of one query, sorted by reference and u."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHAINS = (
    "qid long, round int, cid int, rid long, plen long, n_seeds int, r_first long, q_first long, r_last long, q_last long, seeds array<struct<r:long,q:long>>"
)


def chain(rid: np.ndarray, u: np.ndarray, v: np.ndarray, window: int, compat: bool = False) -> list[tuple[int, list[int]]]:
    """Chains as (length, seed indexes), longest first, of seeds sorted by (rid, u, v).

    From a seed, seeds on the same reference with v beyond its own and both coordinates within the window are accepted
    in order of u; each accepted one narrows the window, so that only seeds nearer to it follow. The last accepted seed
    is the next of the leaf. A leaf ends when nothing is accepted or a seed of an earlier chain is met, which it then
    belongs to; a chain keeps its longest leaf. The next leaf starts at the first seed in no chain; with ``compat`` only
    at one behind the finished leaf's end. A single seed is no chain.
    """
    n = len(u)
    of = np.full(n, -1, np.int64)
    best: dict[int, tuple[int, list[int]]] = {}
    start, n_chains = 0, 0
    rid_, u_, v_ = rid.tolist(), u.tolist(), v.tolist()
    while start < n:
        if of[start] >= 0:
            start += 1
            continue
        base, leaf, cid = start, [start], -1
        while True:
            low, top_u, top_v, last = v_[base], u_[base] + window, v_[base] + window, -1
            for j in range(base + 1, n):
                if rid_[j] != rid_[base] or u_[j] > top_u:
                    break
                if low < v_[j] <= top_v:
                    last = j
                    top_u, top_v = top_u - (top_v - v_[j]), top_v - (top_u - u_[j])
            if last < 0:
                break
            if of[last] >= 0:
                cid = int(of[last])
                break
            leaf.append(last)
            base = last
        if len(leaf) > 1 or cid >= 0:
            if cid < 0:
                cid, n_chains = n_chains, n_chains + 1
            of[leaf] = cid
            span = u_[leaf[-1]] + v_[leaf[-1]] - u_[leaf[0]] - v_[leaf[0]]
            length = int((1 - 1 / len(leaf)) * span)
            if length > best.get(cid, (-1, []))[0]:
                best[cid] = (length, leaf)
        start = max(leaf) + 1 if compat else start + 1
    return sorted(((p, s) for p, s in best.values() if len(s) > 1), key=lambda x: (-x[0], rid_[x[1][0]], u_[x[1][0]], v_[x[1][0]]))


def link_circular(chains: list[tuple[int, list[int]]], rid: np.ndarray, u: np.ndarray, v: np.ndarray, gap: int, lengths: dict[int, int]) -> list[tuple[int, list[int], int]]:
    """Joins a chain that ends near the end of a circular reference to one that begins near its start.

    A turn adds the reference's length to r, so twice that to u and takes it from v. The third member of a result tells
    how many of its seeds lie before the turn.
    """
    after: dict[int, int] = {}
    for i, (_, s) in enumerate(chains):
        size, tail = lengths.get(int(rid[s[0]])), s[-1]
        for j, (_, t) in enumerate(chains) if size else ():
            if j != i and j not in after.values() and rid[t[0]] == rid[s[0]]:
                du, dv = u[t[0]] + 2 * size - u[tail], v[t[0]] - size - v[tail]
                if 0 <= du <= gap and 0 < dv <= gap:
                    after[i] = j
                    break
    out = []
    for i, (p, s) in enumerate(chains):
        if i in after and i not in after.values():
            q, t = chains[after[i]]
            out.append((p + q, s + t, len(s)))
        elif i not in after.values() or i in after:
            out.append((p, s, len(s)))
    return sorted(out, key=lambda x: -x[0])


def by_query(rows: DataFrame, *order: str) -> DataFrame:
    """Rows dealt by qid and sorted by it, then by ``order``: over as many tasks as shuffles have, however few bytes they are.

    What follows costs far more than its bytes tell, so partitions are not merged by size.
    """
    spark = rows.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return rows.repartition(n, "qid").sortWithinPartitions("qid", *order)


def whole_queries(batches):
    """Tables of batches that are sorted by qid, so that none ends within a query."""
    kept = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = table if kept is None else pa.concat_tables([kept, table])
        qid = table.column("qid").to_numpy()
        end = int(np.searchsorted(qid, qid[-1]))
        if end:
            yield table.slice(0, end)
        kept = table.slice(end)
    if kept is not None:
        yield kept


def chain_seeds(seeds: DataFrame, n_rounds: int, window: int, gap: int = 0, compat: bool = False) -> DataFrame:
    """The chains of every query and round; round i uses the seeds whose own round is at most i.

    ``seeds`` may have a column turn: the length of a circular reference, 0 for others. Chains that meet over its end
    within ``gap`` are joined; the seeds behind the turn then have positions past the end.

    A query's seeds are few once over-frequent hashes are gone, and are worked on together; rounds that add no seed
    to the one before are left out.
    """

    names = ["qid", "round", "cid", "rid", "plen", "n_seeds", "r_first", "q_first", "r_last", "q_last", "seeds"]
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), *[pa.int64()] * 4, pa.list_(pa.struct([("r", pa.int64()), ("q", pa.int64())]))]

    def of_query(qid: int, rid, r, q, u, v, own, turn) -> list[tuple]:
        order = np.lexsort((v, u, rid))
        turns = {int(k): int(n) for k, n in zip(rid, turn, strict=True) if n} if turn.any() else {}
        rid, r, q, u, v, own = (x[order] for x in (rid, r, q, u, v, own))
        rows = []
        for i in range(n_rounds):
            if i and not (own == i).any():
                continue
            at = np.flatnonzero(own <= i)
            found = chain(rid[at], u[at], v[at], window, compat)
            found = link_circular(found, rid[at], u[at], v[at], gap, turns) if turns else [(p, s, len(s)) for p, s in found]
            for cid, (length, members, straight) in enumerate(found):
                s = at[members]
                here = r[s] + np.where(np.arange(len(s)) < straight, 0, turns.get(int(rid[s[0]]), 0))
                rows.append((qid, i, cid, int(rid[s[0]]), length, len(s), int(here[0]), int(q[s[0]]), int(here[-1]), int(q[s[-1]]), [{"r": int(a), "q": int(b)} for a, b in zip(here, q[s], strict=True)]))
        return rows

    def run(batches):
        for table in whole_queries(batches):
            qid, *rest = (table.column(c).to_numpy() for c in ("qid", "rid", "rpos", "qpos", "u", "v", "round", "turn"))
            edges = np.flatnonzero(np.diff(qid, prepend=qid[0] - 1, append=qid[-1] + 1))
            rows = [row for a, b in zip(edges[:-1], edges[1:], strict=True) for row in of_query(int(qid[a]), *(x[a:b] for x in rest))]
            columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    rows = seeds.select(F.col("qid").cast("long").alias("qid"), F.col("rid").cast("long").alias("rid"), "rpos", "qpos", "u", "v", "round", (F.col("turn").cast("long") if "turn" in seeds.columns else F.lit(0).cast("long")).alias("turn"))
    return by_query(rows).mapInArrow(run, CHAINS)
