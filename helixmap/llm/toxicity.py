"""Toxicity by a small bidirectional gated recurrent network, trained and run in numpy.

A word enters as its own hashed embedding beside the mean of its hashed character n-grams' embeddings, so a word that
was never seen is read by its parts. A word of more than 64 bytes, as in writing without spaces, enters in pieces. Two
gated recurrent layers run over a window, forward and backward; attention pools their states to one logit. A text is read whole in windows that overlap by half; its logit is that of its worst
window, mapped to a probability by a logistic fit on labelled documents that training didn't use.

Labels hold for documents, not for windows: training begins with windows at random and goes on with each document's
worst window, chosen anew each round. What the network adds to a gate for a word is computed once for each word of a
task, so that a step of the recurrence is a look-up and a product with the small state matrix.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixmap.llm.common import inline, release, tidy, whole_text

WINDOW, STRIDE = 32, 16
#: Training uses at most so many labelled documents of each label, least hash of the doc_id first.
SAMPLE_DOCS = 1_500
#: And at most so many bytes of text, in the same order; a document counts whole or not at all.
SAMPLE_BYTES = 64 << 20
WORD_ROWS, CHAR_ROWS, WORD_DIM, CHAR_DIM, HIDDEN = 8_192, 16_384, 8, 8, 8
NGRAMS = (3, 4, 5)
ROUNDS, FIRST_ROUNDS, BATCH, RATE = 14, 4, 64, 0.01
#: Words whose gate inputs a task keeps, and words that are read at once.
KEEP_WORDS, CHUNK_WORDS = 100_000, 40_000
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
EDGES = ".,;:!?\"'()[]{}<>|*_-"
#: A word of more UTF-8 bytes is read in pieces: its runs of letters and digits, those of more characters than PIECE in
#: overlapping pieces of that length.
LONG_BYTES, PIECE, PIECE_STEP = 64, 16, 8
RUN = re.compile(r"[^\W_]+|[\W_]+")


def words_of(text: str) -> list[str]:
    """The words of a text in lower case; the long ones in pieces that together have all their characters."""
    words = text.lower().split()
    if max(map(len, words), default=0) * 4 <= LONG_BYTES:
        return words
    return [p for w in words for p in ([w] if len(w) * 4 <= LONG_BYTES or len(core(w).encode()) <= LONG_BYTES else pieces(w))]


def pieces(word: str) -> list[str]:
    out = []
    for run in RUN.findall(word):
        out += [run[i : i + PIECE] for i in range(0, max(1, len(run) - PIECE_STEP), PIECE_STEP)]
    return out


def core(word: str) -> str:
    """The word without punctuation at its edges; a word that is nothing else stays as it is."""
    return word.strip(EDGES) or word


def features(cores: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The row of each word, the rows of all words' n-grams (of UTF-8 bytes, edges marked) and where each word's start."""
    marked = [b"<%b>" % c.encode() for c in cores]
    sizes = np.array([len(m) for m in marked])
    text = np.frombuffer(b"".join(marked) + b"\0" * max(NGRAMS), np.uint8).astype(np.uint64) + np.uint64(1)
    n = int(sizes.sum())
    begins = np.cumsum(sizes) - sizes
    left = np.repeat(begins + sizes, sizes) - np.arange(n)  # bytes from here to the word's end
    grams, valid = np.empty((n, len(NGRAMS)), np.int64), np.empty((n, len(NGRAMS)), bool)
    for k, size in enumerate(NGRAMS):
        h = np.full(n, np.uint64(size))
        for i in range(size):
            h = h * MULTIPLIER + text[i : n + i]
        h ^= h >> np.uint64(29)
        h *= MULTIPLIER
        grams[:, k] = (h >> np.uint64(40)) % np.uint64(CHAR_ROWS)
        valid[:, k] = left >= size
    counts = np.add.reduceat(valid.sum(axis=1), begins)
    rows = np.array([xxhash.xxh3_64_intdigest(m) % WORD_ROWS for m in marked])
    return rows, grams[valid], np.cumsum(counts) - counts


@dataclass
class Network:
    """The parameters by name; ``scale`` and ``shift`` map a document's logit to its probability."""

    p: dict[str, np.ndarray] = field(default_factory=dict)
    scale: float = 1.0
    shift: float = 0.0

    @classmethod
    def fresh(cls, seed: int = 3) -> Network:
        r = np.random.default_rng(seed)
        normal = lambda *shape, by: (r.standard_normal(shape) * by).astype(np.float32)
        d = WORD_DIM + CHAR_DIM
        p = {"word": normal(WORD_ROWS, WORD_DIM, by=0.01), "char": normal(CHAR_ROWS, CHAR_DIM, by=0.3), "out_b": np.zeros(1, np.float32)}
        for side in "fb":
            for gate in "zrn":
                p[f"{side}x{gate}"] = normal(d, HIDDEN, by=d**-0.5)
                p[f"{side}h{gate}"] = normal(HIDDEN, HIDDEN, by=HIDDEN**-0.5)
                p[f"{side}c{gate}"] = np.zeros(HIDDEN, np.float32)
            p[f"{side}_att"], p[f"{side}_out"] = normal(HIDDEN, by=0.3), normal(HIDDEN, by=0.3)
        return cls(p)

    def embed(self, word_rows: np.ndarray, grams: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Inputs of words: row of each, rows of all n-grams in a row, and where each word's n-grams start."""
        sums = np.add.reduceat(self.p["char"][grams], starts, axis=0)
        n = np.diff(np.append(starts, len(grams)))[:, None]
        return np.concatenate([self.p["word"][word_rows], sums / n], axis=1).astype(np.float32)

    def gates(self, x: np.ndarray) -> dict[str, np.ndarray]:
        """What each word adds to the gates, by side and gate; row 0 stands for no word."""
        out = {}
        for side in "fb":
            for gate in "zrn":
                rows = np.zeros((len(x) + 1, HIDDEN), np.float32)
                rows[1:] = x @ self.p[f"{side}x{gate}"]
                out[side + gate] = rows + self.p[f"{side}c{gate}"]
        return out

    def logits(self, gates: dict[str, np.ndarray], windows: np.ndarray) -> np.ndarray:
        """The logit of each window; ``windows`` has rows of ``gates``, 0 beyond a text's end."""
        n, t = windows.shape
        att, out = np.zeros((t, n), np.float32), np.zeros((t, n), np.float32)
        half = np.float32(0.5)
        by_step = np.ascontiguousarray(windows.T, np.int64)
        for side in "fb":
            hz, hr, hn = (self.p[f"{side}h{g}"] for g in "zrn")
            gz, gr, gn = (gates[side + g] for g in "zrn")
            heads = np.stack([self.p[f"{side}_att"], self.p[f"{side}_out"]], axis=1)
            h = np.zeros((n, HIDDEN), np.float32)
            z, r, c, x = (np.empty_like(h) for _ in range(4))
            for i in range(t) if side == "f" else reversed(range(t)):
                ids = by_step[i]
                np.matmul(h, hz, out=z)
                z += np.take(gz, ids, axis=0, out=x, mode="clip")
                z *= half
                np.tanh(z, out=z)
                z *= half
                z += half
                np.matmul(h, hr, out=r)
                r += np.take(gr, ids, axis=0, out=x, mode="clip")
                r *= half
                np.tanh(r, out=r)
                r *= half
                r += half
                np.matmul(h, hn, out=c)
                c *= r
                c += np.take(gn, ids, axis=0, out=x, mode="clip")
                np.tanh(c, out=c)
                h -= c
                h *= z
                h += c
                both = h @ heads
                att[i] += both[:, 0]
                out[i] += both[:, 1]
        att = np.where(by_step > 0, att, np.float32(-1e9))
        att -= att.max(axis=0)
        np.exp(att, out=att)
        return (att * out).sum(axis=0) / att.sum(axis=0) + self.p["out_b"][0]

    def backward(self, gates: dict[str, np.ndarray], windows: np.ndarray, label: np.ndarray) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray], float]:
        """Gradients of the mean log loss: of the parameters after the inputs, and of ``gates``."""
        gates = {side: np.concatenate([gates[side + g] for g in "zrn"], axis=1) for side in "fb"}
        n, t = windows.shape
        kept: dict[str, list] = {}
        att, out = np.zeros((t, n), np.float32), np.zeros((t, n), np.float32)
        sigmoid = lambda x: 0.5 * np.tanh(0.5 * x) + 0.5
        first = slice(0, 2 * HIDDEN)  # z and r
        last = slice(2 * HIDDEN, None)  # n
        by_step = np.ascontiguousarray(windows.T)
        weights = {side: np.concatenate([self.p[f"{side}h{g}"] for g in "zrn"], axis=1) for side in "fb"}
        for side in "fb":
            h = np.zeros((n, HIDDEN), np.float32)
            kept[side] = [None] * t
            for i in range(t) if side == "f" else reversed(range(t)):
                x, a = gates[side][by_step[i]], h @ weights[side]
                zr = sigmoid(a[:, first] + x[:, first])
                z, r, g = zr[:, :HIDDEN], zr[:, HIDDEN:], a[:, last]
                c = np.tanh(x[:, last] + r * g)
                new = c + z * (h - c)
                kept[side][i] = (h, z, r, g, c, new)
                att[i] += new @ self.p[f"{side}_att"]
                out[i] += new @ self.p[f"{side}_out"]
                h = new
        att = np.where(by_step > 0, att, np.float32(-1e9))
        share = np.exp(att - att.max(axis=0))
        share /= share.sum(axis=0)
        pooled = (share * out).sum(axis=0)
        logit = pooled + self.p["out_b"][0]
        loss = float(np.mean(np.logaddexp(0, logit) - label * logit))
        d = (sigmoid(logit) - label) / n
        grad = {"out_b": np.array([d.sum()], np.float32)}
        d_out = share * d
        d_att = share * (out - pooled) * d * (by_step > 0)
        d_gates = {}
        for side in "fb":
            p_att, p_out, w = self.p[f"{side}_att"], self.p[f"{side}_out"], weights[side]
            grad[f"{side}_att"], grad[f"{side}_out"], d_w = np.zeros_like(p_att), np.zeros_like(p_out), np.zeros_like(w)
            dh = np.zeros((n, HIDDEN), np.float32)
            inputs = np.empty((t, n, 3 * HIDDEN), w.dtype)
            back = np.empty((n, 3 * HIDDEN), w.dtype)
            for i in reversed(range(t)) if side == "f" else range(t):
                h, z, r, g, c, new = kept[side][i]
                grad[f"{side}_att"] += d_att[i] @ new
                grad[f"{side}_out"] += d_out[i] @ new
                dh = dh + d_att[i][:, None] * p_att + d_out[i][:, None] * p_out
                dc = dh * (1 - z) * (1 - c * c)
                back[:, :HIDDEN] = dh * (h - c) * z * (1 - z)
                back[:, HIDDEN : 2 * HIDDEN] = dc * g * r * (1 - r)
                inputs[i, :, first] = back[:, first]
                inputs[i, :, last] = dc
                back[:, last] = dc * r
                d_w += h.T @ back
                dh = dh * z + back @ w.T
            d_gates[side] = summed(by_step.ravel(), inputs.reshape(-1, 3 * HIDDEN), len(gates[side]))
            for k, gate in enumerate("zrn"):
                grad[f"{side}h{gate}"] = d_w[:, k * HIDDEN : (k + 1) * HIDDEN]
        return grad, {side + gate: d_gates[side][:, k * HIDDEN : (k + 1) * HIDDEN] for side in "fb" for k, gate in enumerate("zrn")}, loss


def summed(places: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """``n`` rows: at each place the sum of the rows that belong there."""
    order = np.argsort(places, kind="stable")
    own = places[order]
    starts = np.flatnonzero(np.diff(own, prepend=-1))
    out = np.zeros((n, rows.shape[1]), rows.dtype)
    out[own[starts]] = np.add.reduceat(rows[order], starts, axis=0)
    return out


def windows_of(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows over texts that lie one after the other: positions (-1 beyond a text's end) and the text of each."""
    counts = np.maximum(1, -(-(lengths - WINDOW) // STRIDE) + 1)
    text = np.repeat(np.arange(len(lengths)), counts)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)
    inside = nth[:, None] * STRIDE + np.arange(WINDOW)
    begins = np.cumsum(lengths) - lengths
    return np.where(inside < lengths[text][:, None], begins[text][:, None] + inside, -1), text


class Reader:
    """Scores texts with one network; keeps the gate inputs of words seen lately."""

    def __init__(self, network: Network):
        self.network = network
        self.reset()

    def reset(self) -> None:
        self.rows: dict[str, int] = {}
        self.cores: dict[str, int] = {}
        self.gates = self.network.gates(np.zeros((0, WORD_DIM + CHAR_DIM), np.float32))
        self.used = 1

    def learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.rows]
        of = {w: core(w) for w in new}
        cores = [c for c in dict.fromkeys(of.values()) if c not in self.cores]
        if cores:
            need = self.used + len(cores)
            for k, rows in self.network.gates(self.network.embed(*features(cores))).items():
                if need > len(self.gates[k]):
                    grown = np.zeros((need * 3 // 2, HIDDEN), np.float32)
                    grown[: self.used] = self.gates[k][: self.used]
                    self.gates[k] = grown
                self.gates[k][self.used : need] = rows[1:]
                self.gates[k][0] = rows[0]
            self.cores.update(zip(cores, range(self.used, need), strict=True))
            self.used = need
        self.rows.update((w, self.cores[c]) for w, c in of.items())

    def ids(self, words: list[str]) -> np.ndarray:
        try:
            return np.fromiter(map(self.rows.__getitem__, words), np.int32, len(words))
        except KeyError:
            self.learn(set(words))
            return np.fromiter(map(self.rows.__getitem__, words), np.int32, len(words))

    def worst(self, texts: list[str]) -> np.ndarray:
        """The greatest window logit of each text."""
        out, words, sizes = [], [], []
        for text in texts:
            own = words_of(text)
            words += own
            sizes.append(len(own))
            if len(words) >= CHUNK_WORDS:
                out.append(self._most(words, sizes))
                words, sizes = [], []
        if sizes:
            out.append(self._most(words, sizes))
        return np.concatenate(out) if out else np.empty(0, np.float32)

    def _most(self, words: list[str], sizes: list[int]) -> np.ndarray:
        flat = np.append(self.ids(words), np.int32(0))
        at, text = windows_of(np.array(sizes))
        windows = flat[at]
        logit = np.concatenate([self.network.logits(self.gates, windows[i : i + 4096]) for i in range(0, len(windows), 4096)])
        if len(self.rows) > KEEP_WORDS:
            self.reset()
        return np.maximum.reduceat(logit, np.flatnonzero(np.diff(text, prepend=-1)))

    def score(self, texts: list[str]) -> np.ndarray:
        x = self.network.scale * self.worst(texts).astype(np.float64) + self.network.shift
        return 0.5 * np.tanh(0.5 * x) + 0.5


class Adam:
    """Adam over arrays; rows of the embeddings that had no gradient stay as they are."""

    def __init__(self, p: dict[str, np.ndarray], rate: float):
        self.p, self.rate, self.n = p, rate, 0
        self.m, self.v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))

    def step(self, grad: dict[str, np.ndarray], rows: dict[str, np.ndarray]) -> None:
        self.n += 1
        fix = np.float32((1 - 0.999**self.n) ** 0.5 / (1 - 0.9**self.n))
        for k, g in grad.items():
            at = rows.get(k, slice(None))
            m, v = self.m[k][at] * np.float32(0.9) + np.float32(0.1) * g, self.v[k][at] * np.float32(0.999) + np.float32(0.001) * g * g
            self.m[k][at], self.v[k][at] = m, v
            self.p[k][at] -= np.float32(self.rate) * fix * m / (np.sqrt(v) + np.float32(1e-8))


def train(texts: list[str], labels: list[int], weights: tuple[float, float] = (1.0, 1.0), seed: int = 5) -> Network:
    """Fits a network to documents' labels; every fifth document is kept for the logistic fit of the scores.

    ``weights``: how many documents each sampled one of label 0 and 1 stands for, in that fit. Without both labels the
    score is the share of label 1, the same for all texts.
    """
    network = Network.fresh(seed)
    y = np.array(labels, np.float32)
    if len(set(labels)) < 2:
        network.scale, network.shift = 0.0, 0.0 if not len(y) else 4.0 * (2 * float(y[0]) - 1)
        return network
    r = np.random.default_rng(seed)
    vocabulary: dict[str, int] = {}
    docs = [np.array([vocabulary.setdefault(core(w), len(vocabulary) + 1) for w in words_of(t)], np.int32) for t in texts]
    word_rows, grams, starts = features(list(vocabulary) or ["-"])
    sizes = np.diff(np.append(starts, len(grams)))
    kept = np.arange(len(docs)) % 5 == 4
    flat = np.concatenate([*docs, np.zeros(1, np.int32)])
    at, text = windows_of(np.array([len(d) for d in docs]))
    windows = flat[at]
    first = np.flatnonzero(np.diff(text, prepend=-1))
    counts = np.diff(np.append(first, len(text)))
    fit = np.flatnonzero(~kept)
    adam = Adam(network.p, RATE)

    def all_logits() -> np.ndarray:
        parts = []
        for i in range(0, len(starts), CHUNK_WORDS // 2):  # the n-grams of all words at once would take hundreds of megabytes
            own = starts[i : i + CHUNK_WORDS // 2]
            end = starts[i + len(own)] if i + len(own) < len(starts) else len(grams)
            parts.append(network.gates(network.embed(word_rows[i : i + len(own)], grams[own[0] : end], own - own[0])))
        gates = {k: np.concatenate([parts[0][k][:1], *(part[k][1:] for part in parts)]) for k in parts[0]}
        return np.concatenate([network.logits(gates, windows[i : i + 4096]) for i in range(0, len(windows), 4096)])

    for round_ in range(ROUNDS):
        adam.rate = RATE * (1.0 if round_ < ROUNDS * 2 // 3 else 0.3)
        random = lambda: first[fit] + (r.random(len(fit)) * counts[fit]).astype(np.int64)
        if round_ < FIRST_ROUNDS:
            chosen = np.concatenate([random() for _ in range(3)])
        else:
            logit = all_logits()
            order = np.lexsort((-logit, text))
            worst = order[first]
            second = order[first + np.minimum(1, counts - 1)]
            clean = fit[y[fit] == 0]
            chosen = np.concatenate([worst[fit], second[clean], random()[y[fit] == 0]])
        r.shuffle(chosen)
        for i in range(0, len(chosen), BATCH):
            own = chosen[i : i + BATCH]
            used, local = np.unique(windows[own], return_inverse=True)
            local = local.reshape(len(own), WINDOW)
            if used[0] != 0:
                used, local = np.concatenate([[0], used]), local + 1
            ids = used[1:] - 1
            if not len(ids):
                continue
            n = sizes[ids]
            flat_at = np.repeat(starts[ids], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            own_grams, own_starts = grams[flat_at], np.cumsum(n) - n
            x = network.embed(word_rows[ids], own_grams, own_starts)
            grad, d_gates, _ = network.backward(network.gates(x), local, y[text[own]])
            dx = np.zeros_like(x)
            for side in "fb":
                for gate in "zrn":
                    d = d_gates[side + gate]
                    grad[f"{side}x{gate}"] = x.T @ d[1:]
                    grad[f"{side}c{gate}"] = d.sum(axis=0)
                    dx += d[1:] @ network.p[f"{side}x{gate}"].T
            rows, back = np.unique(word_rows[ids], return_inverse=True)
            grad["word"] = summed(back, dx[:, :WORD_DIM], len(rows))
            char_rows, back = np.unique(own_grams, return_inverse=True)
            grad["char"] = summed(back, np.repeat(dx[:, WORD_DIM:] / n[:, None], n, axis=0), len(char_rows))
            adam.step(grad, {"word": rows, "char": char_rows})
    worst = np.maximum.reduceat(all_logits(), first)
    part = np.flatnonzero(kept) if len(set(y[kept])) == 2 else np.arange(len(y))
    network.scale, network.shift = logistic(worst[part], y[part], np.where(y[part] > 0, weights[1], weights[0]))
    return network


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Scale and shift of a weighted logistic fit with a light penalty, by Newton steps; the scale is positive."""
    x, w = x.astype(np.float64), np.zeros(2)
    design = np.stack([x, np.ones_like(x)], axis=1)
    target = np.where(y > 0, 0.99, 0.01)
    for _ in range(50):
        q = 0.5 * np.tanh(0.5 * design @ w) + 0.5
        g = design.T @ (weight * (q - target)) + 1e-2 * w
        h = (design * (weight * q * (1 - q))[:, None]).T @ design + 1e-2 * np.eye(2)
        step = np.linalg.solve(h, g)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return max(float(w[0]), 1e-3), float(w[1])


def held_out(doc_id="doc_id"):
    """Rows whose labels may not be learnt: remainder 0, and rows without an id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5, F.lit(0)) == 0


def fit(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_bytes: int = SAMPLE_BYTES) -> Network:
    """Trains on at most ``sample_docs`` labelled documents of each label, and ``sample_bytes``, that aren't held out.

    A document that any of its labels calls toxic is toxic. Rows without an id or a label are left aside; of rows that
    repeat an id each different text counts. Sizes come to the driver first, then the texts that are chosen.
    """
    order = F.md5(F.col("doc_id").cast("string"))
    rows = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    counts = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    sample = rows.where("toxic = 1").orderBy(order).limit(sample_docs).unionByName(rows.where("toxic = 0").orderBy(order).limit(sample_docs))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"), F.xxhash64(whole_text()).alias("digest"))
    found = texts.join(F.broadcast(sample), "doc_id").groupBy("doc_id", "digest").agg(F.max(F.octet_length("text")).alias("size"), F.max("toxic").alias("toxic"))
    chosen, size = {}, 0
    for r in sorted(found.orderBy(order, "digest").limit(2 * sample_docs).collect(), key=lambda r: (xxhash.xxh3_64_intdigest(str(r["doc_id"]).encode()), r["digest"])):
        if size + r["size"] <= sample_bytes:
            chosen[r["doc_id"], r["digest"]] = r["toxic"]
            size += r["size"]
    few = inline(docs.sparkSession, [{"doc_id": i, "digest": d} for i, d in chosen], "doc_id long, digest long")
    text_of = {(r["doc_id"], r["digest"]): r["text"] for r in texts.join(F.broadcast(few), ["doc_id", "digest"]).groupBy("doc_id", "digest").agg(F.first("text").alias("text")).collect()}
    share = {k: counts.get(k, 0) / max(1, min(counts.get(k, 0), sample_docs)) for k in (0, 1)}
    network = train([text_of.pop(k) for k in chosen], list(chosen.values()), (share[0] or 1.0, share[1] or 1.0))
    release()
    return network


def score(docs: DataFrame, network: Network) -> DataFrame:
    """doc_id, held_out, score and predicted of every row, from its whole text alone.

    A null or empty text is one window without words; it has a score too. Texts may be of any length, as may words. Repeated
    rows are scored as often as they occur, equal texts alike; an empty table gives no rows; extra columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(network)
        for batch in batches:
            s = reader.score(batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32), pa.int32())], ["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), whole_text().alias("text")).mapInArrow(tidy(run), "doc_id long, held_out boolean, score double, predicted int")


def keep_clean(docs: DataFrame, network: Network) -> DataFrame:
    """The rows of ``docs``, all columns, whose score is below one half; null texts count as empty, repeated rows each."""
    names = docs.columns
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(network)
        for batch in batches:
            s = reader.score([t or "" for t in batch.column(at).to_pylist()])
            yield batch.filter(pa.array(s < 0.5))

    return docs.mapInArrow(tidy(run), docs.schema)
