"""Mixing sources to target weights by iterative proportional fitting.

Token weights are summed by cell, a cell being a source, a language and a topic that the targets name, or ``other``.
The cell table is thus bounded by the targets, whatever the corpus. Raking scales the cells' weights to each marginal
in turn until all hold; a document is kept when a hash of its id, uniform on [0, 1), lies below its cell's factor,
scaled so that the largest probability is 1. Only DataFrame operations touch documents.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixmap.llm.common import fresh, inline

OTHER = "other"
#: Topics by the form of a text; the first rule that holds gives the topic, else it is prose.
TOPICS = [("table", " | "), ("legal", "License"), ("contact", "@")]


@dataclass(frozen=True)
class Targets:
    """Shares of tokens by label. A label that isn't named falls into ``other``, whose share is what is left.

    Where the named shares reach 1 and other labels occur all the same, they keep the share they have.
    """

    source: dict[str, float] = field(default_factory=dict)
    lang: dict[str, float] = field(default_factory=dict)
    topic: dict[str, float] = field(default_factory=dict)
    rounds: int = 50


def token_count(text: Column) -> Column:
    """Runs of characters other than space, tab, newline and carriage return; null or empty text: none."""
    return F.coalesce(F.size(F.filter(F.split(text, "[ \\t\\n\\r]+"), lambda w: w != "")), F.lit(0)).cast("long")


def topic_of(text: Column) -> Column:
    """The topic of a text by the rules of ``TOPICS``."""
    out = F.lit("prose")
    for name, mark in reversed(TOPICS):
        out = F.when(F.contains(text, F.lit(mark)), name).otherwise(out)
    return out


def _label(value: Column, named: dict[str, float]) -> Column:
    return F.when(value.isin(*named), value).otherwise(F.lit(OTHER)) if named else F.lit(OTHER)


def rake(cells: dict[tuple[str, str, str], float], targets: Targets) -> dict[tuple[str, str, str], float]:
    """The factor of each cell, by proportional fitting of its weight to the three marginals in turn.

    Labels without weight can't be raised: their shares go to the other labels of the marginal in proportion.
    """
    total = float(sum(cells.values()))
    if total <= 0:
        return dict.fromkeys(cells, 1.0)
    weight = {k: v / total for k, v in sorted(cells.items())}
    wanted = []
    for axis, named in enumerate((targets.source, targets.lang, targets.topic)):
        have: dict[str, float] = {}
        for k, v in weight.items():
            have[k[axis]] = have.get(k[axis], 0.0) + v
        goal = {k: named.get(k, 0.0) for k in have if have[k] > 0}
        if OTHER in goal:
            goal[OTHER] = max(0.0, 1.0 - sum(named.values())) or have[OTHER]
        norm = sum(goal.values())
        wanted.append({k: v / norm for k, v in goal.items()} if norm > 0 else have)
    for _ in range(targets.rounds):
        for axis, goal in enumerate(wanted):
            have = dict.fromkeys(goal, 0.0)
            for k, v in weight.items():
                if k[axis] in have:
                    have[k[axis]] += v
            weight = {k: v * goal[k[axis]] / have[k[axis]] if have.get(k[axis]) else v for k, v in weight.items()}
    return {k: weight[k] / (v / total) if v else 1.0 for k, v in cells.items()}


ADDED = ["topic", "tokens", "probability", "draw", "kept"]


def mix(docs: DataFrame, targets: Targets, seed: int = 11) -> DataFrame:
    """``docs`` with topic, tokens, probability, draw and kept of each row (in this order, after its own columns).

    ``docs`` has doc_id, text, source and lang; columns that bear one of the added names are replaced. Null sources
    and languages count as other; null and empty texts have no tokens and keep their cell's probability; texts may be of
    any length; a null doc_id draws by the text. Rows that repeat a doc_id and a text are kept or dropped together. Factors
    that tie give equal probabilities. An empty table gives no rows.
    """
    docs = docs.drop(*ADDED)
    s, c, t, p = fresh(docs, "__source", "__lang", "__topic", "__factor")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.withColumn("topic", topic_of(text)).withColumn("tokens", token_count(text))
    rows = rows.withColumn(s, _label(F.col("source"), targets.source)).withColumn(c, _label(F.col("lang"), targets.lang)).withColumn(t, _label(F.col("topic"), targets.topic))
    sums = rows.groupBy(s, c, t).agg(F.sum("tokens").alias("n")).collect()  # bounded by the labels of the targets
    factors = rake({(r[0], r[1], r[2]): float(r[3] or 0) for r in sums}, targets)
    top = max(factors.values(), default=1.0)
    table = inline(docs.sparkSession, [{"s": k[0], "c": k[1], "t": k[2], "p": round(v / top, 12)} for k, v in factors.items()], "s string, c string, t string, p double")
    table = F.broadcast(table.select(F.col("s").alias(s), F.col("c").alias(c), F.col("t").alias(t), F.col("p").alias(p)))
    key = F.when(F.col("doc_id").isNull(), text).otherwise(F.concat(F.col("doc_id").cast("string"), F.lit(f":{seed}")))
    draw = F.conv(F.substring(F.md5(key.cast("binary")), 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))
    out = rows.join(table, [s, c, t], "left").withColumn("probability", F.coalesce(F.col(p), F.lit(1.0))).withColumn("draw", draw).withColumn("kept", F.col("draw") < F.col("probability"))
    return out.select(*[f"`{x}`" for x in docs.columns], *ADDED)


def sample(docs: DataFrame, targets: Targets, seed: int = 11) -> DataFrame:
    """The rows of ``docs`` that ``mix`` keeps, with all their own columns, whatever their names."""
    own = fresh(docs, *(f"__own_{i}" for i in range(len(ADDED))))
    away = {c: o for c, o in ((c, own[ADDED.index(c.lower())]) for c in docs.columns if c.lower() in ADDED)}
    rows = mix(docs.withColumnsRenamed(away), targets, seed).where("kept").drop(*ADDED)
    return rows.withColumnsRenamed({o: c for c, o in away.items()}).select(*[f"`{c}`" for c in docs.columns])


#: Production targets: every source of the corpus alike, languages and topics near their natural shares.
PRODUCTION = Targets(
    source={f"src{i}": 0.05 for i in range(20)},
    lang={"en": 0.6, "fr": 0.147, "de": 0.147, "es": 0.106},
    topic={"prose": 0.906, "legal": 0.036, "table": 0.029, "contact": 0.029},
)


def mix_sql(targets: Targets, seed: int = 11) -> str:
    """The same in SQL over ``documents``: one recursion step fits one marginal of the cell table."""
    named = {"source": targets.source, "lang": targets.lang, "topic": targets.topic}
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    label = {k: f"CASE WHEN {k} IN ({', '.join(map(quoted, v))}) THEN {k} ELSE '{OTHER}' END" if v else f"'{OTHER}'" for k, v in named.items()}
    rules = " ".join(f"WHEN contains(coalesce(text, ''), {quoted(mark)}) THEN '{name}'" for name, mark in TOPICS)
    goals = ", ".join(f"({i}, {quoted(k)}, CAST({v!r} AS DOUBLE))" for i, m in enumerate(named.values()) for k, v in m.items())
    left = ", ".join(f"({i}, CAST({max(0.0, 1.0 - sum(m.values()))!r} AS DOUBLE))" for i, m in enumerate(named.values()))
    return f"""
WITH RECURSIVE rows AS (
  SELECT *, CASE {rules} ELSE 'prose' END AS topic,
    len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\r]+')) AS tokens
  FROM documents
), labelled AS (
  SELECT *, {label["source"]} AS s, {label["lang"]} AS l, {label["topic"]} AS t FROM rows
), cells AS (
  SELECT s, l, t, CAST(sum(tokens) AS DOUBLE) AS n FROM labelled GROUP BY s, l, t
), shares AS (
  SELECT s, l, t, n / (SELECT sum(n) FROM cells) AS w FROM cells
), have AS (
  SELECT 0 AS axis, s AS label, sum(w) AS w FROM shares GROUP BY s HAVING sum(w) > 0
  UNION ALL SELECT 1, l, sum(w) FROM shares GROUP BY l HAVING sum(w) > 0
  UNION ALL SELECT 2, t, sum(w) FROM shares GROUP BY t HAVING sum(w) > 0
), given AS (
  SELECT h.axis, h.label, CASE WHEN h.label = '{OTHER}' THEN CASE WHEN r.share > 0 THEN r.share ELSE h.w END ELSE coalesce(g.share, 0) END AS share
  FROM have h JOIN (VALUES {left}) r(axis, share) ON h.axis = r.axis
  LEFT JOIN (VALUES {goals}) g(axis, label, share) ON h.axis = g.axis AND h.label = g.label
), goal AS (
  SELECT axis, label, share / sum(share) OVER (PARTITION BY axis) AS share FROM given
), fit AS (
  SELECT 0 AS step, s, l, t, w FROM shares WHERE w > 0
  UNION ALL
  SELECT step + 1, s, l, t, w * share / sum(w) OVER (PARTITION BY CASE step % 3 WHEN 0 THEN s WHEN 1 THEN l ELSE t END)
  FROM fit JOIN goal ON axis = step % 3 AND label = CASE step % 3 WHEN 0 THEN s WHEN 1 THEN l ELSE t END
  WHERE step < {3 * targets.rounds}
), factors AS (
  SELECT c.s, c.l, c.t, coalesce(f.w / o.w, 1.0) AS factor
  FROM cells c LEFT JOIN (SELECT * FROM fit WHERE step = {3 * targets.rounds}) f USING (s, l, t) LEFT JOIN shares o USING (s, l, t)
), chances AS (
  SELECT s, l, t, round(factor / (SELECT max(factor) FROM factors), 12) AS p FROM factors
), drawn AS (
  SELECT doc_id, source, lang, topic, CAST(tokens AS BIGINT) AS tokens, p,
    CAST(CAST('0x' || substr(md5(CASE WHEN doc_id IS NULL THEN coalesce(text, '') ELSE CAST(doc_id AS VARCHAR) || ':{seed}' END), 1, 12) AS BIGINT) AS DOUBLE) / {float(1 << 48)!r} AS draw
  FROM labelled JOIN chances USING (s, l, t)
)
SELECT doc_id, source, lang, topic, tokens, round(p, 6) AS probability, round(draw, 9) AS draw, draw < p AS kept FROM drawn
"""
