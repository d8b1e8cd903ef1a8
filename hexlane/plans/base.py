"""The registry of queries, each with its SQL where there is any, and the SQL of the shared tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..cluster import compiled_methods_only
from ..functions.scalars import round_to
from ..operators import scoring
from ..operators.reports import profit_and_loss
from ..sources import panel
from ..sources.tables import parquet

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        @wraps(f)
        def run(spark: SparkSession, d: str) -> DataFrame:
            compiled_methods_only(spark)
            return f(spark, d)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return f

    return put


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """All doubles rounded, and -0.0 made 0.0, so results compare across engines."""
    return df.select(*[(round_to(c, digits) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def runners(spark: SparkSession, d: str) -> DataFrame:
    return panel.runners_from_orders(parquet(spark, d, "lineitem"), parquet(spark, d, "orders"))


def races(spark: SparkSession, d: str) -> DataFrame:
    return panel.races(runners(spark, d))


def combos(spark: SparkSession, d: str) -> DataFrame:
    return panel.expand(races(spark, d))


def scored(spark: SparkSession, d: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """race, date, venue, class_id, combo, a, b, c, is_hit, score, prob, odds, payout, and what of the race's columns is to be kept."""
    t = scoring.venue_temperature()
    wide = scoring.with_softmax_parts(races(spark, d), scoring.linear_score, t)
    df = panel.labelled(panel.expand(wide)).withColumn("score", scoring.linear_score())
    df = df.withColumn("prob", F.exp((F.col("score") - F.col("_max")) / t) / F.col("_sum"))
    df = df.select("race", "date", "venue", "class_id", "combo", "a", "b", "c", "is_hit", "score", "prob", *keep)
    return df.withColumn("odds", scoring.synthetic_odds()).withColumn("payout", F.round(F.col("odds") * 100).cast("long"))


def valued(spark: SparkSession, d: str) -> DataFrame:
    return scoring.expected_value(scored(spark, d))


def ranked(spark: SparkSession, d: str) -> DataFrame:
    return scoring.prob_rank(valued(spark, d))


def betting_log(spark: SparkSession, d: str) -> DataFrame:
    """A merged log: the first five of each race by probability are selected."""
    df = ranked(spark, d).withColumn("is_selected", (F.col("rank_prob") <= 5).cast("int")).withColumn("race_no", (F.col("race") % 12 + 1).cast("int"))
    return profit_and_loss(df)


def as_long(*columns: str) -> list[Column]:
    return [F.col(c).cast("long").alias(c) for c in columns]


RUNNERS = """
WITH base AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS lane,
         count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem),
six AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, lane) AS finish FROM base WHERE n >= 6 AND lane <= 6),
runners AS (SELECT l_orderkey AS race, CAST(lane AS INTEGER) AS lane, l_suppkey AS racer_no, CAST(l_partkey % 100 AS INTEGER) AS motor, CAST(l_suppkey % 100 AS INTEGER) AS boat,
  l_tax + 6.5::DOUBLE AS exhibit, CAST(least(l_linenumber, 6) AS INTEGER) AS course, l_tax + 0.0::DOUBLE AS st, CAST(l_quantity AS DOUBLE) AS win_rate, l_discount + 0.0::DOUBLE AS place_rate,
  l_extendedprice AS price, CAST(finish AS INTEGER) AS finish, strftime(o_orderdate, '%Y%m%d') AS date, (['15', '02', '16', '12', '99'])[CAST(o_orderpriority[1] AS INTEGER)] AS venue
  FROM six JOIN orders ON o_orderkey = l_orderkey)"""

RACES = RUNNERS + """,
races AS MATERIALIZED (SELECT race, min(date) AS date, min(venue) AS venue, list(win_rate ORDER BY lane) AS win_rate, list(place_rate ORDER BY lane) AS place_rate, list(st ORDER BY lane) AS st,
  list(exhibit ORDER BY lane) AS exhibit, list(CAST(motor AS DOUBLE) ORDER BY lane) AS motor, list(CAST(boat AS DOUBLE) ORDER BY lane) AS boat, list(CAST(course AS DOUBLE) ORDER BY lane) AS course,
  max(CASE WHEN finish = 1 THEN lane END) AS w1, max(CASE WHEN finish = 2 THEN lane END) AS w2, max(CASE WHEN finish = 3 THEN lane END) AS w3 FROM runners GROUP BY race HAVING count(DISTINCT lane) = 6)"""

COMBOS = RACES + """,
lanes AS (SELECT CAST(unnest(range(1, 7)) AS INTEGER) AS x),
outcomes AS (SELECT CAST(row_number() OVER (ORDER BY p.x, q.x, r.x) - 1 AS INTEGER) AS class_id, p.x || '-' || q.x || '-' || r.x AS combo, p.x AS a, q.x AS b, r.x AS c
  FROM lanes p, lanes q, lanes r WHERE p.x <> q.x AND p.x <> r.x AND q.x <> r.x),
combos AS (SELECT * FROM races, outcomes)"""

SCORED = COMBOS + """,
s0 AS (SELECT race, date, venue, class_id, combo, a, b, c, CAST(a = w1 AND b = w2 AND c = w3 AS INTEGER) AS is_hit,
  win_rate[a] * 0.05::DOUBLE + win_rate[b] * 0.03::DOUBLE + win_rate[c] * 0.02::DOUBLE + place_rate[a] * 10.0::DOUBLE + place_rate[b] * 6.0::DOUBLE + place_rate[c] * 3.0::DOUBLE
    - st[a] * 8.0::DOUBLE - st[b] * 4.0::DOUBLE - st[c] * 2.0::DOUBLE AS score,
  CASE venue WHEN '15' THEN 0.88::DOUBLE WHEN '02' THEN 0.92::DOUBLE WHEN '16' THEN 0.90::DOUBLE WHEN '12' THEN 0.91::DOUBLE ELSE 0.90::DOUBLE END AS t FROM combos),
s1 AS (SELECT *, exp((score - max(score) OVER (PARTITION BY race)) / t) AS e FROM s0),
s2 AS (SELECT * EXCLUDE (e, t), e / sum(e) OVER (PARTITION BY race) AS prob, race * 37 + (a * 100 + b * 10 + c) * 17 AS n FROM s1),
s3 AS (SELECT *, CASE WHEN n % 11 <> 0 THEN 5.0::DOUBLE + (n % 400) / 4.0::DOUBLE END AS odds FROM s2),
scored AS MATERIALIZED (SELECT * EXCLUDE (n), CAST(round(odds * 100) AS BIGINT) AS payout FROM s3)"""

VALUED = SCORED + """,
v0 AS (SELECT *, CASE WHEN odds >= 1 THEN prob * odds END AS ev FROM scored),
valued AS MATERIALIZED (SELECT *, ev - 1 AS edge, CASE WHEN ev IS NOT NULL THEN CAST(row_number() OVER (PARTITION BY race ORDER BY round(ev, 9) DESC NULLS LAST, class_id) AS INTEGER) END AS ev_rank,
  CAST(row_number() OVER (PARTITION BY race ORDER BY round(prob, 9) DESC, class_id) AS INTEGER) AS rank_prob FROM v0)"""

LOG = VALUED + """,
l0 AS (SELECT *, CAST(rank_prob <= 5 AS INTEGER) AS is_selected, CAST(race % 12 + 1 AS INTEGER) AS race_no FROM valued),
l1 AS (SELECT *, CAST(is_selected * 100 AS BIGINT) AS bet_cost_yen, CASE WHEN is_selected = 1 AND is_hit = 1 THEN coalesce(payout, 0) ELSE 0 END AS return_yen FROM l0),
log AS MATERIALIZED (SELECT *, return_yen - bet_cost_yen AS profit_yen FROM l1)"""


def rd(expression: str, name: str, digits: int = 6) -> str:
    return f"round({expression}, {digits}) + 0.0 AS {name}"
