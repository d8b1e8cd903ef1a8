"""Sampling documents to target weights of sources, languages and topics by iterative proportional fitting.

Main path: DataFrame functions only. Tokens are summed by cell (source, language, topic); the cells' weights are raked to
the three target marginals in turn; a document is then kept with probability min(1, scale * weight / tokens of its cell),
scale being such that the kept tokens come to KEEP of all. Everything but the last join works on the cells.

A topic is the form of a text, the first that holds: empty (no word), table (a bar in 40 characters or more often), symbols
(one of #$%&* in 20), capitals (more than a third A-Z), long (1000 words), short (under 100 words), prose.

Targets: a value's share of the tokens to the power TEMPER, so rare values gain. Nulls and edges: null source or lang is the
value `none`; null text is empty; tokens are words, an empty text's cell has no tokens and its documents are kept with
probability 1; equal doc_ids share a draw, a null one too; an empty table gives an empty result. Only doc_id, text, source and
lang are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written

SWEEPS, KEEP, TEMPER = 8, 0.6, 0.7
MARGINALS = ("m_source", "m_lang", "topic")
WORD = r"[^ \t\n\x0B\f\r]+"
CAPITALS, SYMBOLS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "#$%&*"


def described(docs: DataFrame) -> DataFrame:
    """docs with n_tokens, topic, m_source, m_lang."""
    text = F.coalesce("text", F.lit(""))
    n, words = F.length(text), F.col("n_tokens")

    def share(chars: str) -> Column:
        return n - F.length(F.translate(text, chars, ""))

    topic = (
        F.when(words == 0, "empty").when(share("|") * 40 >= n, "table").when(share(SYMBOLS) * 20 >= n, "symbols")
        .when(share(CAPITALS) * 3 > n, "capitals").when(words >= 1000, "long").when(words < 100, "short").otherwise("prose")
    )
    docs = docs.withColumn("n_tokens", F.regexp_count(text, F.lit(WORD)).cast("long")).withColumn("topic", topic)
    return docs.withColumn("m_source", F.coalesce(F.col("source").cast("string"), F.lit("none"))).withColumn("m_lang", F.coalesce(F.col("lang").cast("string"), F.lit("none")))


def raked(described_docs: DataFrame, temper: float = TEMPER, keep: float = KEEP) -> DataFrame:
    """prob by cell (m_source, m_lang, topic)."""
    cells = described_docs.groupBy(*MARGINALS).agg(F.sum("n_tokens").cast("double").alias("tokens"))
    every = Window.partitionBy()
    cells = cells.withColumn("all_tokens", F.sum("tokens").over(every))
    for m in MARGINALS:
        own = Window.partitionBy(m)
        mass = F.pow(F.sum("tokens").over(own), F.lit(temper))
        cells = cells.withColumn(f"t_{m}", mass).withColumn(f"n_{m}", F.count("*").over(own))
    for m in MARGINALS:
        cells = cells.withColumn(f"t_{m}", F.col(f"t_{m}") / F.sum(F.col(f"t_{m}") / F.col(f"n_{m}")).over(every) * F.col("all_tokens"))
    cells = written(cells.withColumn("weight", F.col("tokens")), "mix-cells")
    for _ in range(SWEEPS):
        for m in MARGINALS:
            have = F.sum("weight").over(Window.partitionBy(m))
            cells = cells.withColumn("weight", F.when(have > 0, F.col("weight") * F.col(f"t_{m}") / have).otherwise(0.0))
    cells = written(cells.where("tokens > 0").withColumn("ratio", F.col("weight") / F.col("tokens")), "mix-raked")
    # cells kept whole are those of highest ratio; scale is what the others then need
    upto = Window.orderBy(F.desc("ratio"), *MARGINALS).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cells = cells.withColumn("scale", (keep * F.col("all_tokens") - F.sum("tokens").over(upto) + F.col("tokens")) / (F.sum("weight").over(every) - F.sum("weight").over(upto) + F.col("weight")))
    fit = F.col("scale") * F.col("ratio") <= 1
    scale = F.coalesce(F.max_by(F.when(fit, F.col("scale")), F.when(fit, F.col("ratio"))).over(every), F.lit(float("inf")))
    return cells.withColumn("prob", F.round(F.least(F.lit(1.0), scale * F.col("ratio")), 9)).select(*MARGINALS, "prob")


def draw(doc_id: Column) -> Column:
    """A number from 0 to 1 fixed by the doc_id."""
    return F.conv(F.substring(F.md5(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")), 1, 8), 16, 10).cast("double") / 4294967296.0


def drawn(docs: DataFrame) -> DataFrame:
    """Described documents with prob and kept."""
    probs = raked(docs.select(*MARGINALS, "n_tokens")).select(*[F.col(m).alias(f"_{m}") for m in MARGINALS], "prob")
    on = [F.col(m) == F.col(f"_{m}") for m in MARGINALS]
    out = docs.join(probs, on, "left").withColumn("prob", F.coalesce("prob", F.lit(1.0)))
    return out.withColumn("kept", draw(F.col("doc_id")) < F.col("prob")).drop(*[f"_{m}" for m in MARGINALS])


def sample(docs: DataFrame) -> DataFrame:
    """docs with n_tokens, topic, prob and kept. Texts are described twice rather than copied."""
    return drawn(described(docs))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its probability and whether it is drawn."""
    docs = described(table(spark, sf_dir, "documents")).select("doc_id", "n_tokens", *MARGINALS)
    return drawn(written(docs, "described")).select("doc_id", "n_tokens", "topic", "prob", "kept")


def oracle() -> str:
    count = lambda s: " + ".join(f"(length(t) - length(replace(t, '{c}', '')))" for c in s)
    steps = []
    last = "w0"
    for i in range(SWEEPS):
        for m in MARGINALS:
            name = f"w_{i}_{m}"
            steps.append(f"{name} AS (SELECT * REPLACE (CASE WHEN sum(weight) OVER (PARTITION BY {m}) > 0 THEN weight * t_{m} / sum(weight) OVER (PARTITION BY {m}) ELSE 0 END AS weight) FROM {last})")
            last = name
    goal = ", ".join(f"t_{m} / sum(t_{m} / n_{m}) OVER () * all_tokens AS t_{m}" for m in MARGINALS)
    mass = ", ".join(f"pow(sum(tokens) OVER (PARTITION BY {m}), {TEMPER}) AS t_{m}, count(*) OVER (PARTITION BY {m}) AS n_{m}" for m in MARGINALS)
    keys = ", ".join(MARGINALS)
    upto = f"OVER (ORDER BY ratio DESC, {keys} ROWS UNBOUNDED PRECEDING)"
    using = " AND ".join(f"d.{m} = c.{m}" for m in MARGINALS)
    return f"""
WITH a AS MATERIALIZED (SELECT doc_id, coalesce(text, '') AS t, coalesce(source, 'none') AS m_source, coalesce(lang, 'none') AS m_lang,
  CAST(len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\v\\f\\r]+')) AS BIGINT) AS n_tokens FROM documents),
d AS MATERIALIZED (SELECT doc_id, m_source, m_lang, n_tokens, CASE WHEN n_tokens = 0 THEN 'empty' WHEN ({count("|")}) * 40 >= length(t) THEN 'table'
  WHEN ({count(SYMBOLS)}) * 20 >= length(t) THEN 'symbols' WHEN ({count(CAPITALS)}) * 3 > length(t) THEN 'capitals'
  WHEN n_tokens >= 1000 THEN 'long' WHEN n_tokens < 100 THEN 'short' ELSE 'prose' END AS topic FROM a),
c0 AS (SELECT {keys}, CAST(sum(n_tokens) AS DOUBLE) AS tokens FROM d GROUP BY {keys}),
c1 AS (SELECT *, sum(tokens) OVER () AS all_tokens, {mass} FROM c0),
w0 AS MATERIALIZED (SELECT {keys}, tokens, all_tokens, {goal}, tokens AS weight FROM c1),
{", ".join(s.replace(" AS (", " AS MATERIALIZED (", 1) for s in steps)},
r AS (SELECT *, weight / tokens AS ratio FROM {last} WHERE tokens > 0),
s AS (SELECT *, ({KEEP} * all_tokens - sum(tokens) {upto} + tokens) / (sum(weight) OVER () - sum(weight) {upto} + weight) AS scale FROM r),
z AS (SELECT coalesce(max_by(scale, ratio) FILTER (WHERE scale * ratio <= 1), 'inf'::DOUBLE) AS scale FROM s),
c AS (SELECT {keys}, round(least(1.0, z.scale * ratio), 9) AS prob FROM s, z)
SELECT doc_id, n_tokens, topic, coalesce(prob, 1.0) AS prob,
  ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8))::BIGINT / 4294967296.0::DOUBLE < coalesce(prob, 1.0) AS kept
FROM (SELECT d.*, c.prob FROM d LEFT JOIN c ON {using}) x
""".replace("SELECT doc_id, n_tokens, topic, coalesce", "SELECT doc_id, n_tokens, topic, coalesce")
