"""Mapping of queries onto an index: seeds, chains, extension, ranking.

Seeds and chains are joined by hash and grouped by query. References are cut into tiles; each chain meets the tiles that
its query can reach, cut to that slice, so no row holds a whole reference. Queries and slices are dealt and sorted by query and
streamed: batches of a bounded number of bases are extended side by side. Only alignments leave.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from helixmap.functions.codec import bases_of, codes_of, complement_codes
from helixmap.operators.chains import by_query, chain_seeds
from helixmap.operators.dp import extend, mismatch_text, rescore, runs
from helixmap.operators.index import Index
from helixmap.operators.seeds import join_seeds
from helixmap.operators.sketch import sketch
from helixmap.plans.params import MapParams

#: Bases that a slice has beyond what an alignment can reach: a band's width.
MARGIN = 64
#: Band widths of the first try and of those after a known end point, and seeds that are tried for a chain.
BANDS, TRIALS = (64, 32, 16), 8
#: Bases of a tile of a reference, and of queries and slices that are extended together.
TILE, BATCH_BASES = 1 << 16, 1 << 22
#: Chains without a result, one after the other, that end a query.
FAILURES = 50_000
#: Pairs times steps of a batch of extensions; a step keeps a byte for each cell of the band.
BATCH_STEPS = 1 << 20

ALIGNMENTS = (
    "qid long, rid long, aid int, seg int, strand int, rs long, re long, qs long, qe long, score long, identity double, dcnt long, matches long, gaps_r long, gaps_q long, "
    "cigar array<struct<op:string,len:int>>, md string, set_score long, is_uniq boolean, n_all int, n_uniq int, mapq16 int, clipped boolean, "
    "rpart string, qpart string"
)


@dataclass
class Alignment:
    rid: int
    reverse: bool
    rs: int
    re: int
    qs: int  # on the query as aligned
    qe: int
    score: int
    path: str
    matches: int
    gaps_r: int
    gaps_q: int
    md: str
    clipped: bool

    @property
    def diagonals(self) -> int:
        return self.path.count("M")

    @property
    def identity(self) -> float:
        return self.matches / self.diagonals if self.diagonals else 0.0


@dataclass
class Search:
    """One chain on its way: what is left of it, which seed comes next, and its alignments."""

    rid: int
    left: int
    seeds: list[tuple[int, int]]
    slice_codes: np.ndarray
    slice_start: int
    ref_len: int
    trials: int = TRIALS
    narrow: int = 0
    found: list[Alignment] = field(default_factory=list)
    score: int = 0
    low: int = 1 << 60
    high: int = -1

    def take(self, before: int | None) -> tuple[int, int] | None:
        """The next seed to try: the last one that lies before ``before`` on the reference."""
        while self.seeds and self.trials > 0:
            seed = self.seeds.pop()
            if before is None or seed[0] < before:
                self.trials -= 1
                return seed
        return None


def extend_chains(query: np.ndarray, searches: list[Search], params: MapParams):
    """Runs all chains of one query, longest first; returns those with an alignment of the least score.

    A generator: it yields (reference codes, query codes, band, whether a path is wanted) and is sent the extension.
    """
    other = complement_codes(query)
    ends: set[tuple[int, bool, int, int]] = set()
    starts: dict[tuple[int, bool, int, int], Alignment] = {}
    failed = 0
    for s in searches:
        if failed >= FAILURES:
            break
        before = None
        while s.left > 0 and (seed := s.take(before)) is not None:
            r, q = seed
            reverse = q < 0
            oriented = other if reverse else query
            q = q + 1 + len(query) if reverse else q
            for back in (0, params.k):
                a0, b0 = r - s.slice_start - back, q - back
                if not (0 <= a0 <= len(s.slice_codes) and 0 <= b0 <= len(oriented)):
                    continue
                score, i, j, _ = yield s.slice_codes[a0:], oriented[b0:], BANDS[s.narrow], False
                if score > 0:
                    break
            else:
                continue
            if score <= 0:
                continue
            a1, b1 = a0 + i, b0 + j
            end = (s.rid, reverse, s.slice_start + a1, b1)
            if end in ends:
                s.narrow = min(s.narrow + 1, 2)
                continue
            ends.add(end)
            score, i, j, path = yield s.slice_codes[:a1][::-1], oriented[:b1][::-1], BANDS[s.narrow], True
            if score < params.min_score:
                continue
            path = path[::-1]
            a, b = s.slice_codes[a1 - i : a1], oriented[b1 - j : b1]
            count = rescore(path, a, b, params.scoring)
            rs = s.slice_start + a1 - i
            touched = (a1 - i == 0 and s.slice_start > 0) or (a1 == len(s.slice_codes) and s.slice_start + a1 < s.ref_len)
            own = Alignment(s.rid, reverse, rs, s.slice_start + a1, b1 - j, b1, score, path, count["match"], count["gap_a"], count["gap_b"], mismatch_text(path, a, b), touched)
            before = rs
            s.left -= len(path) + own.diagonals  # a chain's length counts both coordinates
            key = (s.rid, reverse, rs, b1 - j)
            known = starts.get(key)
            covered = max(0, own.qe - own.qs) if s.high < 0 else max(0, s.low - own.qs) + max(0, own.qe - s.high)
            s.score += score + int(2 * covered * own.identity)
            s.low, s.high = min(s.low, own.qs), max(s.high, own.qe)
            if known is not None:
                if known.score <= score and known in s.found:
                    s.found[s.found.index(known)] = own
                    starts[key] = own
                break
            starts[key] = own
            s.found.append(own)
            s.trials, s.narrow = TRIALS, 0
        failed = 0 if s.found and s.score >= params.min_score else failed + 1
    return [s for s in searches if s.found and s.score >= params.min_score]


def left_over(span: tuple[int, int], taken: list[tuple[int, int]]) -> int:
    """How much of ``span`` none of the spans taken covers."""
    at, left = span[0], 0
    for low, high in sorted(taken):
        left += max(0, min(low, span[1]) - at)
        at = max(at, high)
    return left + max(0, span[1] - at)


def uniques(spans: list[tuple[int, int]]) -> list[int]:
    """The first span and those that add to it, in the order of choice.

    Again and again the span with the most that no chosen one covers is taken, the earlier one of equals. Of a span that
    may be taken all but a sixth is left over.
    """
    chosen, rest = [0], list(range(1, len(spans)))
    while rest:
        left = {i: left_over(spans[i], [spans[j] for j in chosen]) for i in rest}
        rest = [i for i in rest if left[i] > 0 and 6 * left[i] >= 5 * (spans[i][1] - spans[i][0])]
        if rest:
            chosen.append(max(rest, key=lambda i: (left[i], -i)))
            rest.remove(chosen[-1])
    return chosen


def classify(sets: list[Search], params: MapParams) -> tuple[list[Search], int, list[int]]:
    """Sets in order of output, how many are unique, and qualities times 16.

    Sets within the ratio of the best stay. The best is primary; of the others again and again the one that covers most
    of the query anew is supplementary, and what is mostly covered is secondary, with quality 0.
    """
    sets = sorted(sets, key=lambda s: (-s.score, s.rid, s.low, s.found[0].rs))
    least = math.floor(sets[0].score * params.min_ratio)
    sets = [s for s in sets if s.score >= least]
    # spans of reverse alignments are turned to the query's own strand by the caller
    order = uniques([(s.low, s.high) for s in sets])
    secondary = [i for i in range(len(sets)) if i not in set(order)]
    other = max([sets[i].score for i in secondary], default=0)
    c, quality = params.coefficient, []
    for i in order:
        length = sum(len(a.path) for a in sets[i].found)
        identity = sum(len(a.path) * a.identity for a in sets[i].found) / length
        gain = 2.0 / max(identity * 2 * c - c, 1e-9)
        alone = gain * max(sets[i].score - other, 0)
        quality.append(int(min(max(-160.0 * math.log10(1.0 / (alone * alone + 1.0)), 0), 960)))
    return [sets[i] for i in [*order, *secondary]], len(order), quality + [0] * len(secondary)


def map_query(query: np.ndarray, by_round: dict[int, list[Search]], params: MapParams):
    """Rounds one after the other until one has a result; a generator as ``extend_chains`` is."""
    for i in sorted(by_round):
        searches = [s for s in by_round[i] if s.left * params.coefficient >= 2.0 * params.min_score]
        sets = yield from extend_chains(query, searches, params)
        if sets:
            for s in sets:
                if s.found[0].reverse:
                    s.low, s.high = len(query) - s.high, len(query) - s.low
            return classify(sets, params)
    return [], 0, []


def together(searches: dict[int, object], params: MapParams) -> dict[int, object]:
    """Runs generators side by side: the pairs that all of them wait for are extended in batches of like lengths."""
    done, waiting = {}, {}

    def step(key, value):
        try:
            waiting[key] = searches[key].send(value)
        except StopIteration as end:
            done[key] = end.value

    for key in searches:
        step(key, None)
    while waiting:
        pairs = sorted(((band, trace, 2 * min(len(a), len(b)), key, a, b) for key, (a, b, band, trace) in waiting.items()), key=lambda x: x[:4])
        waiting.clear()
        while pairs:
            kind, n = pairs[0][:2], 1
            while n < len(pairs) and pairs[n][:2] == kind and (n + 1) * pairs[n][2] <= BATCH_STEPS:
                n += 1
            now, pairs = pairs[:n], pairs[n:]
            for one, result in zip(now, extend([x[4:] for x in now], params.scoring, *kind), strict=True):
                step(one[3], result)
    return done


def _aligned(batch: dict[int, tuple[str, dict[tuple[int, int], dict]]], params: MapParams, schema: pa.Schema) -> pa.RecordBatch:
    """The alignments of some queries; for each its sequence and, by round and number, its chains with their slices."""
    codes, running = {}, {}
    for qid, (seq, chains) in batch.items():
        by_round: dict[int, list[Search]] = {}
        for (i, _), c in sorted(chains.items()):
            seeds = [(x["r"], x["q"]) for x in c["seeds"]]
            by_round.setdefault(i, []).append(Search(c["rid"], c["plen"], seeds, codes_of("".join(c["parts"])), c["slice_start"], c["ref_end"]))
        codes[qid] = codes_of(seq)
        running[qid] = map_query(codes[qid], by_round, params)
    rows = []
    shown = params.format == "maf"
    for qid, (sets, n_uniq, quality) in sorted(together(running, params).items()):
        query = codes[qid]
        for aid, (s, mapq) in enumerate(zip(sets, quality, strict=True)):
            for seg, a in enumerate(s.found):
                qs, qe = (len(query) - a.qe, len(query) - a.qs) if a.reverse else (a.qs, a.qe)
                parts = (None, None)
                if shown:
                    oriented = complement_codes(query) if a.reverse else query
                    parts = bases_of(s.slice_codes[a.rs - s.slice_start : a.re - s.slice_start]), bases_of(oriented[a.qs : a.qe])
                rows.append((
                    qid, a.rid, aid, seg, int(a.reverse), a.rs, a.re, qs, qe, a.score, a.identity, a.diagonals, a.matches, a.gaps_r, a.gaps_q,
                    [{"op": op, "len": n} for op, n in runs(a.path)], a.md, s.score, aid < n_uniq, len(sets), n_uniq, mapq, a.clipped, *parts,
                ))
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema.names)


def tiles(refs: DataFrame, size: int = TILE) -> DataFrame:
    """rid, tile (its number) and bases of references (rid, circular, seq); a circular one goes round twice."""

    def run(batches):
        for batch in batches:
            rids, numbers, texts, n = [], [], [], 0
            for rid, ring, seq in zip(*(batch.column(i) for i in range(3)), strict=True):
                text = seq.as_py() * (2 if ring.as_py() else 1)
                for at in range(0, len(text), size):
                    rids.append(rid.as_py())
                    numbers.append(at // size)
                    texts.append(text[at : at + size])
                    n += size
                    if n >= BATCH_BASES:
                        yield pa.RecordBatch.from_arrays([pa.array(rids, pa.int64()), pa.array(numbers, pa.int64()), pa.array(texts, pa.string())], ["rid", "tile", "bases"])
                        rids, numbers, texts, n = [], [], [], 0
            yield pa.RecordBatch.from_arrays([pa.array(rids, pa.int64()), pa.array(numbers, pa.int64()), pa.array(texts, pa.string())], ["rid", "tile", "bases"])

    return refs.select(F.col("rid").cast("long").alias("rid"), F.coalesce("circular", F.lit(False)).alias("circular"), "seq").mapInArrow(run, "rid long, tile long, bases string")


def map_queries(queries: DataFrame, index: Index, params: MapParams | None = None) -> DataFrame:
    """Alignments of ``queries`` (qid, seq) on the index's references: columns as in ``ALIGNMENTS``.

    Queries shorter than k, or too short to reach the least score, have none. Slices reach as far as any alignment of their
    chain can, so none ends at a slice's border (``clipped`` would tell). On a circular reference positions count
    on past the end by less than one turn; a slice never holds more than one turn and the query's reach.
    """
    params = params or index.params
    q = queries.select(F.col("qid").cast("long").alias("qid"), "seq").where((F.length("seq") >= params.k) & (F.length("seq") * F.lit(params.coefficient) >= params.min_score) & (F.length("seq") >= params.min_len))
    mini = sketch(q, "qid", params.k, params.w, mixing=params.mixing_hash)
    seeds = join_seeds(mini, index.matching(mini.select("hash").distinct()), index.occ, params.k, lower_triangle=params.all_vs_all)
    if params.circular:
        turns = index.refs.where("circular").select("rid", F.col("len").alias("turn"))
        seeds = seeds.join(turns, "rid", "left").withColumn("turn", F.coalesce("turn", F.lit(0)))
    chains = chain_seeds(seeds, len(index.occ), params.window, params.gap)
    chains = chains.where(F.col("plen") * F.lit(params.coefficient) >= 2.0 * params.min_score)
    r = index.refs.select(F.col("rid").cast("long").alias("rid"), "circular", F.col("len").cast("long").alias("ref_len"))
    size = F.col("size")
    # each reference base without a partner costs an extension; all of them together no more than the query can win and a drop
    margin = F.ceil((size * params.scoring.match + params.scoring.xdrop) / params.scoring.ge) + MARGIN
    place = lambda x: F.when(x < 0, x + 1 + size).otherwise(x)  # noqa: E731  on the query as aligned
    low = F.col("r_first") - place(F.col("q_first")) - margin
    high = F.col("r_last") + (size - place(F.col("q_last"))) + margin
    spans = chains.join(q.select("qid", F.length("seq").cast("long").alias("size")), "qid").join(r, "rid")
    end = F.when(F.col("circular"), F.col("ref_len") * 2).otherwise(F.col("ref_len"))
    spans = spans.select("qid", "round", "cid", "rid", "plen", "seeds", F.greatest(low, F.lit(0)).alias("slice_start"), F.least(high, end).alias("slice_end"), end.alias("ref_end"))
    first, last = F.floor(F.col("slice_start") / TILE), F.floor((F.col("slice_end") - 1) / TILE)
    pieces = spans.withColumn("tile", F.explode(F.sequence(first, last))).join(tiles(index.refs), ["rid", "tile"])
    begin = F.greatest(F.col("slice_start") - F.col("tile") * TILE, F.lit(0))
    stop = F.least(F.col("slice_end") - F.col("tile") * TILE, F.lit(TILE))
    text = F.substring("bases", (begin + 1).cast("int"), (stop - begin).cast("int")).alias("text")
    seeds_once = F.when(F.col("tile") == first, F.col("seeds")).alias("seeds")  # a chain's first piece brings them
    pieces = pieces.select("qid", "round", "cid", "tile", "rid", "plen", seeds_once, "slice_start", "ref_end", text)
    own = q.select("qid", F.lit(-1).alias("round"), F.col("seq").alias("text"))
    rows = by_query(pieces.unionByName(own, allowMissingColumns=True), "round", "cid", "tile")
    schema = to_arrow_schema(StructType.fromDDL(ALIGNMENTS))

    def run(batches):
        waiting, n, now = {}, 0, None
        for batch in batches:
            for row in batch.to_pylist():
                if row["qid"] != now:
                    if n >= BATCH_BASES:
                        yield _aligned(waiting, params, schema)
                        waiting, n = {}, 0
                    now, seq, chains = row["qid"], None, {}
                n += len(row["text"])
                if row["round"] < 0:
                    seq = row["text"]
                    continue
                if not chains:
                    waiting[now] = (seq, chains)
                known = chains.setdefault((row["round"], row["cid"]), row)
                known.setdefault("parts", []).append(row["text"])
        if waiting:
            yield _aligned(waiting, params, schema)

    return rows.select("qid", "round", "cid", "rid", "plen", "seeds", "slice_start", "ref_end", "text").mapInArrow(run, ALIGNMENTS)


def described(alignments: DataFrame, queries: DataFrame, index: Index) -> DataFrame:
    """Alignment rows with the names and lengths that the text formats need, and the query; ordinal is the query's place.

    The aligned parts of both (rpart, qpart), which MAF needs, come with the alignments if their parameters name that format.
    """
    has = set(queries.columns)
    q = queries.select(F.col("qid").cast("long").alias("qid"), (F.col("name") if "name" in has else F.col("qid").cast("string")).alias("qname"), F.col("seq").alias("qseq"), F.length("seq").alias("qlen"), (F.col("qual") if "qual" in has else F.lit(None).cast("string")).alias("qual"), *(["tags"] if "tags" in has else []))
    r = index.refs.select(F.col("rid").cast("long").alias("rid"), F.col("name").alias("rname"), F.col("len").alias("rlen"))
    out = alignments.join(q, "qid").join(r, "rid").withColumn("ordinal", F.col("qid")).withColumn("gaps", F.col("gaps_r") + F.col("gaps_q"))
    second = F.max(F.when(F.col("aid") == 1, F.col("score"))).over(Window.partitionBy("qid"))
    return out.withColumn("xs", F.coalesce(second, F.lit(0)))
