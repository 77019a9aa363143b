"""The pipeline against a plain version of each stage, over the whole of a small made-up corpus."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from helixmap.llm import mixing, toxicity
from helixmap.llm.tokens import vocabulary_path

R = random.Random(12)
WORDS = ["".join(R.choice("abcdefghijkl") for _ in range(R.randint(2, 8))) for _ in range(400)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


def corpus():
    r = random.Random(3)
    rows, labels = [], []
    passage = "\n".join(prose(14, 900 + i) for i in range(5))
    for i in range(260):
        text = "\n".join(prose(r.randint(8, 28), 10_000 + 40 * i + j) for j in range(r.randint(2, 9)))
        toxic = i % 5 == 1
        if toxic:
            w = text.split(" ")
            for k in range(0, len(w), 9):
                w[k] = r.choice(["vileness", "vilely", "vile", "vilest"])
            text = " ".join(w)
        elif i % 13 == 0:
            text += "\n" + passage
        elif i % 17 == 0:
            text = rows[i - 3][1]
        elif i % 23 == 0:  # a near copy of which all but a tenth is shared
            w = rows[i - 2][1].split(" ")
            text = " ".join(w[: len(w) - len(w) // 10] + [f"own{i}"])
        elif i % 19 == 0:  # a near copy, an edit in each line so that the lines don't go before it does
            text = "\n".join(x.rsplit(" ", 1)[0] + " edited" for x in rows[0][1].split("\n"))
        rows.append((i, text, ["en", "fr", "de"][i % 3], f"src{i % 6}", len(text)))
        labels.append((i, int(i % 3 > 0), int(toxic)))
    rows += [(300, None, "en", "src1", None), (301, "", "en", None, 0), (302, "", None, "src2", 0)]
    return rows, labels


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("corpus"))
    rows, labels = corpus()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(path + "/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(path + "/labels.parquet")
    return path


def plain_line_dedup(rows, n=25):
    """Every run of so many words that an earlier document has goes; lines of which nothing is left go too.

    All of a document goes that shares four fifths of the longer one's words with one earlier document.
    """
    runs, out = [], []
    for r in sorted(rows):
        words = (r[1] or "").split()
        own = [tuple(words[i : i + n]) for i in range(len(words) - n + 1)]
        drop = set()
        for other, length in runs:
            shared = {j for i, x in enumerate(own) if x in other for j in range(i, i + n)}
            drop |= set(range(len(words))) if shared and len(shared) >= 0.8 * max(length, len(words)) else shared
        kept, at = [], 0
        for line in (r[1] or "").split("\n"):
            had = line.split()
            left = [w for j, w in enumerate(had, at) if j not in drop]
            at += len(had)
            if left or not had:
                tail = " " if left and len(left) < len(had) and at - 1 in drop else ""
                kept.append(" ".join(left) + tail)
        text = "\n".join(kept) if drop else r[1]
        runs.append((set(own), len(words)))
        out.append((r[0], text, r[2], r[3], len(text) if drop else r[4]))
    return out


def bag(text):
    w = (text or "").lower().split()
    n = min(5, len(w))
    return Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if w else Counter()


def plain_near_duplicates(rows):
    bags, parent = [bag(r[1]) for r in rows], list(range(len(rows)))

    def find(x):
        return x if parent[x] == x else find(parent[x])

    for i in range(len(rows)):
        for j in range(i):
            union = sum((bags[i] | bags[j]).values())
            if (rows[i][1] or "") == (rows[j][1] or "") or union and sum((bags[i] & bags[j]).values()) >= 0.8 * union:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return [r for i, r in enumerate(rows) if find(i) == i]


def plain_mix(rows, targets):
    named = (targets.source, targets.lang, targets.topic)
    cells, of = defaultdict(float), {}
    for r in rows:
        text = r[1] or ""
        topic = next((name for name, mark in mixing.TOPICS if mark in text), "prose")
        of[r[0]] = tuple(v if v in n else mixing.OTHER for v, n in zip((r[3], r[2], topic), named, strict=True))
        cells[of[r[0]]] += len([w for w in text.replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if w])
    factor = mixing.rake(dict(cells), targets)
    top = max(factor.values())
    draw = lambda i: int(hashlib.md5(f"{i}:11".encode()).hexdigest()[:12], 16) / 2**48
    return [r for r in rows if draw(r[0]) < factor[of[r[0]]] / top]


def test_pipeline_matches_plain_stages(spark, folder):
    rows, labels = corpus()
    docs = spark.read.parquet(folder + "/documents.parquet")
    network = toxicity.fit(docs, spark.read.parquet(folder + "/labels.parquet"))
    score = toxicity.Reader(network).score([r[1] or "" for r in rows])
    clean = [r for r, s in zip(rows, score, strict=True) if s < 0.5]
    truth = {i: t for i, _, t in labels}
    wrong = [r[0] for r, s in zip(rows, score, strict=True) if r[0] in truth and (s >= 0.5) != truth[r[0]]]
    assert len(wrong) <= 8
    kept = plain_mix(plain_near_duplicates(plain_line_dedup(clean)), mixing.PRODUCTION)
    want = Counter()
    plain = Tokenizer.from_file(vocabulary_path("byte_bpe_50k.json"))
    for r in kept:
        ids = np.append(np.array(plain.encode(r[1] or "", add_special_tokens=False).ids, "<u4"), np.uint32(1)).astype("<u4")
        for a in range(0, len(ids), 2048):
            want[r[0], a, len(ids[a : a + 2048]), zlib.crc32(ids[a : a + 2048].tobytes()), len(ids)] += 1
    got = corpus_pipeline.run(spark, folder).collect()
    assert Counter((x.doc_id, x.start, x.length, x.ids_crc32, x.doc_tokens) for x in got) == want and len(want) > 20


def test_stages_keep_the_columns_of_documents(spark, folder):
    docs = spark.read.parquet(folder + "/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, folder)
        assert after.columns == docs.columns and 0 < after.count() <= docs.count(), name
        docs = after
    assert docs.where("text is not null and n_chars <> length(text)").count() == 0


def test_stages_keep_columns_whose_names_they_use(spark, folder):
    names = ["topic", "Tokens", "draw", "kept", "kept_chars", "partners", "removed_text", "digest", "_row", "__own_0", "bucket"]
    docs = spark.read.parquet(folder + "/documents.parquet").where("doc_id < 60")
    docs = docs.select("*", *[F.concat(F.lit(f"{c}-"), F.col("doc_id").cast("string")).alias(c) for c in names])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, folder)
        assert after.columns == docs.columns and after.dtypes == docs.dtypes, name
        for r in after.collect():
            assert [r[c] for c in names] == [f"{c}-{r.doc_id}" for c in names], name
        docs = after
    assert corpus_pipeline.STAGES[-1][1](spark, docs, folder).count() > 0


def test_empty_corpus(spark, folder, tmp_path):
    spark.read.parquet(folder + "/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(folder + "/labels.parquet").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
