"""Mixing sources to target weights by iterative proportional fitting.

Token weights are summed per cell of source, language and topic; only the cells
are raked. Each round scales them to the targets of one margin after another,
until no margin's relative residual exceeds ``CLOSE`` or ``ROUNDS`` are done.
Sampling probabilities are then calibrated: the ratio of raked to present tokens
times one factor, at most 1, with which the tokens to keep are ``RATE`` of all.
A document is kept if the hash of its key lies below its cell's probability.
``report`` receives the rounds, the residual and the factor. Cells up to
``LOCAL`` are raked in the driver; beyond, the same rounds run on the table of
cells (sums can differ in their last bits).

Token weights are bytes of UTF-8 in units of ``BYTES``, rounded up, so that
languages without spaces weigh as others do, unless ``tokens`` names a column
with counts. Targets are given per margin, or are the margin's own shares to the power
``ALPHA`` (flattened). A margin's value without a target gets none; targets
of absent values are left out and the rest scaled up. Null source, language or
topic is a value of its own. Null and empty texts have no tokens and their cell's
probability. A ``topic`` column is used where there is one; otherwise topics are
kinds of text (see ``topic_of``). Equal rows share their key's decision.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, small_table, table

MARGINS = ("source", "lang", "topic")
ALPHA = 0.5
RATE = 0.5
ROUNDS = 30
CLOSE = 1e-10
BYTES = 4
LOCAL = 1 << 17
NONE = "\x00null"


def tokens_of(text: str) -> Column:
    return F.ceil(F.octet_length(F.coalesce(F.col(text), F.lit(""))) / F.lit(BYTES)).cast("long")


def topic_of(text: str) -> Column:
    """A text's kind: terms, contact, tabular, shouting, or prose."""
    t = F.coalesce(F.col(text), F.lit(""))
    return (
        F.when(t.contains("icense") | t.contains("ights reserved"), "terms")
        .when(t.contains("://") | t.contains("@"), "contact")
        .when(t.contains(" | "), "tabular")
        .when(t.contains("!! "), "shouting")
        .otherwise("prose")
    )


def _rows(docs: DataFrame, key: str, text: str, tokens: str | None) -> DataFrame:
    topic = F.col("topic").cast("string") if "topic" in docs.columns else topic_of(text)
    name = lambda c: F.coalesce(c, F.lit(NONE))
    weight = F.coalesce(F.col(tokens).cast("long"), F.lit(0)) if tokens else tokens_of(text)
    return docs.select(key, name(F.col("source")).alias("source"), name(F.col("lang")).alias("lang"), name(topic).alias("topic"), weight.alias("n_tokens"))


def _targets(cells: DataFrame, given: dict[str, dict[str, float]] | None, alpha: float, rate: float) -> dict[str, DataFrame]:
    """For each margin (value, target): tokens to reach."""
    total = cells.agg(F.coalesce(F.sum("t"), F.lit(0))).first()[0]
    out = {}
    for m in MARGINS:
        present = cells.groupBy(m).agg(F.sum("t").alias("t")).where("t > 0")
        if given and m in given:
            wanted = small_table(cells.sparkSession, [(k, float(v)) for k, v in given[m].items()], f"`{m}` string, w double")
            share = present.join(wanted, m).select(m, "w")
        else:
            share = present.select(m, F.pow(F.col("t").cast("double"), F.lit(alpha)).alias("w"))
        whole = share.agg(F.sum("w")).first()[0] or 1.0
        out[m] = share.select(m, (F.col("w") / F.lit(whole) * rate * total).alias("target"))
    return out


def _rake_local(cells: DataFrame, targets: dict[str, DataFrame], rounds: int, goal_sum: float, report: dict) -> DataFrame:
    rows = [(r["source"], r["lang"], r["topic"], float(r["t"])) for r in cells.orderBy(*MARGINS).collect()]
    goal = [{r[m]: r["target"] for r in targets[m].collect()} for m in MARGINS]
    x = [r[3] for r in rows]

    def sums(k: int) -> dict[str, float]:
        out: dict[str, float] = {}
        for r, v in zip(rows, x):
            out[r[k]] = out.get(r[k], 0.0) + v
        return out

    residual, done = 0.0, 0
    while done < rounds:
        for k in range(3):
            now = sums(k)
            x = [v * goal[k].get(r[k], 0.0) / now[r[k]] if now[r[k]] > 0 else 0.0 for r, v in zip(rows, x)]
        done += 1
        residual = max((abs(now.get(v, 0.0) / g - 1) for k in range(2) for now in [sums(k)] for v, g in goal[k].items() if g > 0), default=0.0)
        if residual <= CLOSE:
            break
    # cells that are taken whole, those that are raked up most first
    order = sorted((i for i, r in enumerate(rows) if r[3] > 0), key=lambda i: -x[i] / rows[i][3])
    whole, rest, factor = 0.0, sum(x), 1.0
    for i in order:
        factor = (goal_sum - whole) / rest if rest > 0 else 0.0
        if x[i] * factor <= rows[i][3]:
            break
        whole, rest = whole + rows[i][3], rest - x[i]
    report |= {"rounds": done, "residual": residual, "factor": factor}
    made = [(*r[:3], min(1.0, v * factor / r[3]) if r[3] > 0 else 1.0) for r, v in zip(rows, x)]
    return small_table(cells.sparkSession, made, "source string, lang string, topic string, probability double")


def _rake_table(cells: DataFrame, targets: dict[str, DataFrame], rounds: int, goal_sum: float, report: dict) -> DataFrame:
    x = cells.select(*MARGINS, F.col("t").cast("double").alias("t"), F.col("t").cast("double").alias("x"))
    residual, done = 0.0, 0
    while done < rounds:
        for m in MARGINS:
            factor = x.groupBy(m).agg(F.sum("x").alias("_s")).join(targets[m], m, "left")
            factor = factor.select(m, F.when(F.col("_s") > 0, F.coalesce("target", F.lit(0.0)) / F.col("_s")).otherwise(0.0).alias("_f"))
            x = x.join(factor, m).select(*MARGINS, "t", (F.col("x") * F.col("_f")).alias("x"))
        x = durable(x)
        done += 1
        far = [x.groupBy(m).agg(F.sum("x").alias("_s")).join(targets[m].where("target > 0"), m).agg(F.max(F.abs(F.col("_s") / F.col("target") - 1))).first()[0] for m in MARGINS[:2]]
        residual = max([v or 0.0 for v in far])
        if residual <= CLOSE:
            break
    factor = 1.0
    while True:  # cells taken whole only grow, so this ends
        whole, rest = x.where("t > 0").agg(
            F.sum(F.when(F.col("x") * factor > F.col("t"), F.col("t")).otherwise(0.0)), F.sum(F.when(F.col("x") * factor > F.col("t"), 0.0).otherwise(F.col("x")))
        ).first()
        last, factor = factor, (goal_sum - (whole or 0.0)) / rest if rest else 0.0
        if factor <= last * (1 + 1e-12):
            factor = last if rest else float("inf") if whole else 0.0
            break
    report |= {"rounds": done, "residual": residual, "factor": factor}
    share = F.when(F.col("x") > 0, F.least(F.lit(1.0), F.col("x") * factor / F.col("t"))).otherwise(0.0)
    return x.select(*MARGINS, F.when(F.col("t") > 0, share).otherwise(1.0).alias("probability"))


def mixture(
    docs: DataFrame, *, key: str = "doc_id", text: str = "text", tokens: str | None = None, targets: dict[str, dict[str, float]] | None = None,
    alpha: float = ALPHA, rate: float = RATE, rounds: int = ROUNDS, local: int = LOCAL, report: dict | None = None,
) -> DataFrame:
    """(key, source, lang, topic, n_tokens, probability, kept) of every row."""
    report = {} if report is None else report
    rows = durable(_rows(docs, key, text, tokens))
    cells = durable(rows.groupBy(*MARGINS).agg(F.sum("n_tokens").alias("t")))
    wanted = {m: durable(t) for m, t in _targets(cells, targets, alpha, rate).items()}
    goal = rate * (cells.agg(F.sum("t")).first()[0] or 0)
    if cells.count() <= local:
        raked = _rake_local(cells, wanted, rounds, goal, report)
    else:
        raked = durable(_rake_table(cells, wanted, rounds, goal, report))
    draw = F.conv(F.substring(F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))
    return rows.join(raked, list(MARGINS)).select(
        key, *(F.when(F.col(m) != NONE, F.col(m)).alias(m) for m in MARGINS), "n_tokens", "probability", (draw < F.col("probability")).alias("kept")
    )


def op10_mixing_to_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixture(table(spark, sf_dir, "documents"))
    return found.withColumn("probability", F.round("probability", 6))


def _sql() -> str:
    """The same rounds in SQL, one query after another; then the cells taken whole, those raked up most first."""
    steps = []
    last = "cells"
    for i in range(ROUNDS):
        for m in MARGINS:
            x = "t" if last == "cells" else "x"
            name = f"x{i}_{m}"
            steps.append(
                f"{name} AS MATERIALIZED (SELECT c.source, c.lang, c.topic, c.t, c.{x} * g.target / s.s AS x FROM {last} c "
                f"JOIN (SELECT {m} AS k, sum({x}) AS s FROM {last} GROUP BY 1) s ON s.k = c.{m} JOIN g_{m} g ON g.k = c.{m})"
            )
            last = name
    goals = [
        f"g_{m} AS MATERIALIZED (SELECT k, pow(t, {ALPHA}) / sum(pow(t, {ALPHA})) OVER () * {RATE} * (SELECT sum(t) FROM cells) AS target "
        f"FROM (SELECT {m} AS k, sum(t) AS t FROM cells GROUP BY 1))"
        for m in MARGINS
    ]
    return f"""
WITH r AS MATERIALIZED (
  SELECT doc_id, source, lang, CASE WHEN contains(text, 'icense') OR contains(text, 'ights reserved') THEN 'terms'
    WHEN contains(text, '://') OR contains(text, '@') THEN 'contact' WHEN contains(text, ' | ') THEN 'tabular'
    WHEN contains(text, '!! ') THEN 'shouting' ELSE 'prose' END AS topic,
    CAST(ceil(strlen(coalesce(text, '')) / {BYTES}.0) AS BIGINT) AS n_tokens FROM documents),
cells AS MATERIALIZED (SELECT source, lang, topic, CAST(sum(n_tokens) AS DOUBLE) AS t FROM r GROUP BY ALL),
{", ".join(goals)},
{", ".join(steps)},
ranked AS (SELECT *, ({RATE} * (SELECT sum(t) FROM cells) - coalesce(sum(t) OVER up, 0)) / (sum(x) OVER () - coalesce(sum(x) OVER up, 0)) AS f
  FROM {last} WINDOW up AS (ORDER BY x / t DESC, source, lang, topic ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
factor AS (SELECT f FROM ranked WHERE x * f <= t ORDER BY x / t DESC, source, lang, topic LIMIT 1),
p AS (SELECT source, lang, topic, least(1.0, x * (SELECT f FROM factor) / t) AS p FROM {last})
SELECT r.*, round(p, 6) AS probability,
  CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) / 4503599627370496.0 < p AS kept
FROM r JOIN p USING (source, lang, topic)
"""


SQL = _sql()
