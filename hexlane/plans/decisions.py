"""Selection and staking queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import round_to
from ..operators import kelly, selection
from .base import VALUED, query, rd, rounded, valued
from .relational import CONFIG
from .relational import _values as tuple_values


def s_steps(odds: str, table: dict, kind: str) -> str:
    out = []
    for venue in ("15", "16", "02", "default"):
        if kind == "high":
            body = " ".join(f"WHEN {odds} <= {b} THEN {f}" for b, f in table[venue] if b is not None) + f" ELSE {table[venue][-1][1]}"
        elif kind == "low":
            body = " ".join(f"WHEN {odds} < {b} THEN {f}" for b, f in zip((4, 6, 8), table[venue], strict=True)) + " ELSE 1.0"
        else:
            start, *bands = table[venue]
            body = f"WHEN {odds} < {start} THEN 1.0 " + " ".join(f"WHEN {odds} <= {b} THEN {f}" for b, f in bands) + " ELSE 1.0"
        case = f"CASE WHEN {odds} <= 0 THEN 0.0 {body} END::DOUBLE"
        out.append(f"WHEN venue = '{venue}' THEN {case}" if venue != "default" else f"ELSE {case}")
    return f"CASE {' '.join(out)} END"


def s_scale(m: str) -> str:
    return f"CASE WHEN max({m}) OVER w > min({m}) OVER w THEN ({m} - min({m}) OVER w) / (max({m}) OVER w - min({m}) OVER w) ELSE 0.0 END"


BOUGHT = CONFIG + ", " + VALUED.split("WITH", 1)[1] + f""",
x1 AS (SELECT v.*, c.* EXCLUDE (venue) FROM valued v JOIN conf c ON c.venue = CASE WHEN v.venue IN (SELECT venue FROM conf) THEN v.venue ELSE 'default' END),
x2 AS (SELECT *, max(CAST(prob >= min_prob AS INTEGER)) OVER (PARTITION BY race) AS likely FROM x1 WHERE odds > 0 AND ev > 0),
x3 AS (SELECT *, least(ev, ev_cap) AS ec, least(odds, odds_cap) AS oc FROM x2 WHERE prob >= min_prob OR likely = 0),
x4 AS (SELECT *, {s_scale('prob')} AS pn, {s_scale('ec')} AS en, {s_scale('oc')} AS onn FROM x3 WINDOW w AS (PARTITION BY race)),
cand AS MATERIALIZED (SELECT *, pow(greatest(pn, 1e-9), prob_exp) * pow(greatest(en, 1e-9), ev_exp) * (base_bonus + w_prob * pn + w_ev * en + w_odds * onn)
  * {s_steps('odds', selection.ZONE, 'zone')} * {s_steps('odds', selection.HIGH, 'high')} * {s_steps('odds', selection.LOW, 'low')} AS buy_score FROM x4)"""

POINTS = BOUGHT + """,
t0 AS (SELECT race, min(venue) AS venue, min(min_points) AS lo, min(max_points) AS hi, list(prob ORDER BY prob DESC)[1:10] AS p FROM cand GROUP BY race),
t1 AS (SELECT *, p[1] AS t1, coalesce(p[2], 0.0) AS t2, list_sum(p[1:3]) AS s3, list_sum(p[1:5]) AS s5,
  CASE WHEN len(p) <= 1 THEN 0.0 ELSE least(greatest(list_sum(list_transform(p, lambda v: -(v / list_sum(p)) * ln(v / list_sum(p) + 1e-12))) / ln(len(p) + 1e-12), 0.0), 1.0) END AS entropy FROM t0),
t2 AS (SELECT *, greatest(0.0, t1 - t2) AS gap FROM t1),
t3 AS (SELECT *, least(greatest(((0.12 - least(t1, 0.12)) / 0.12 * 0.42 + (0.24 - least(s3, 0.24)) / 0.24 * 0.22 + (0.36 - least(s5, 0.36)) / 0.36 * 0.14 + (0.03 - least(gap, 0.03)) / 0.03 * 0.08 + entropy * 0.28)
  * CASE venue WHEN '15' THEN 0.82 WHEN '02' THEN 1.08 ELSE 1.0 END, 0.0), 1.0)::DOUBLE AS need FROM t2),
t4 AS (SELECT *, lo + CAST(round_even((hi - lo) * need, 0) AS INTEGER) AS n0 FROM t3),
t5 AS (SELECT *, CASE WHEN t1 >= 0.10 AND s3 >= 0.23 THEN least(n0, 3) WHEN t1 >= 0.08 AND s5 >= 0.34 THEN least(n0, greatest(4, lo)) ELSE n0 END AS n1 FROM t4),
points AS (SELECT race, entropy, CAST(least(greatest(CASE WHEN entropy >= 0.88 AND t1 <= 0.05 THEN least(hi, n1 + 1) ELSE n1 END, 3), 12) AS INTEGER) AS points FROM t5)"""

BETS = POINTS + """,
k0 AS (SELECT *, row_number() OVER (PARTITION BY race ORDER BY round(buy_score, 9) DESC, round(prob, 9) DESC, round(ev, 9) DESC, class_id) AS r FROM cand),
k1 AS MATERIALIZED (SELECT k0.*, greatest(3, least(12, points)) AS final_n FROM k0 JOIN points USING (race) WHERE r <= greatest(3, least(12, points))),
k2 AS (SELECT race, count(*) AS have, min(final_n) AS final_n FROM k1 GROUP BY race HAVING count(*) < min(final_n)),
k3 AS (SELECT v.*, row_number() OVER (PARTITION BY race ORDER BY round(prob, 9) DESC, class_id) AS r, final_n - have AS miss FROM valued v JOIN k2 USING (race) WHERE odds > 0 AND NOT EXISTS (SELECT 1 FROM k1 WHERE k1.race = v.race AND k1.class_id = v.class_id)),
k4 AS (SELECT race, venue, class_id, combo, prob, odds, ev, buy_score, 0 AS is_backfill FROM k1 UNION ALL SELECT race, venue, class_id, combo, prob, odds, ev, prob, 1 FROM k3 WHERE r <= miss),
bets AS MATERIALIZED (SELECT *, CAST(row_number() OVER (PARTITION BY race ORDER BY round(buy_score, 9) DESC, round(prob, 9) DESC, round(ev, 9) DESC, class_id) AS INTEGER) AS rank FROM k4)"""


def bets_sql(overlay: list[tuple]) -> str:
    """BETS under another overlay; an empty one as a row of a venue that no race has."""
    return BETS.replace(tuple_values(selection.TUNED), tuple_values(overlay or [("none", *selection.BASE[-1][1:])]))


def bought(spark, d):
    return selection.buy_score(selection.with_settings(valued(spark, d), selection.settings(spark)))


def chosen(spark, d):
    return selection.best_bets(valued(spark, d), selection.settings(spark))


@query("odds_steps", VALUED + f" SELECT race, class_id, {s_steps('odds', selection.HIGH, 'high')} AS high, {s_steps('odds', selection.LOW, 'low')} AS low, {s_steps('odds', selection.ZONE, 'zone')} AS zone FROM valued WHERE odds IS NOT NULL")
def odds_steps(spark, d):
    df = valued(spark, d).where("odds is not null")
    odds = F.col("odds")
    return df.select("race", "class_id", selection.high_penalty(odds).alias("high"), selection.low_penalty(odds).alias("low"), selection.zone_bonus(odds).alias("zone"))


@query("buy_score", BOUGHT + f" SELECT race, class_id, {rd('pn', 'pn')}, {rd('en', 'en')}, {rd('buy_score', 'buy_score', 7)} FROM cand")
def buy_score(spark, d):
    out = bought(spark, d).where("is_candidate")
    return out.select("race", "class_id", (round_to("pn", 6) + 0.0).alias("pn"), (round_to("en", 6) + 0.0).alias("en"), (round_to("buy_score", 7) + 0.0).alias("buy_score"))


@query("dynamic_points", POINTS + f" SELECT race, {rd('entropy', 'entropy')}, points FROM points")
def dynamic_points(spark, d):
    out = selection.dynamic_points(bought(spark, d)).where("is_candidate")
    return rounded(out.groupBy("race").agg(F.min("entropy").alias("entropy"), F.min("points").alias("points")))


@query("best_bets", BETS + f" SELECT race, class_id, combo, rank, is_backfill, {rd('buy_score', 'buy_score', 7)} FROM bets")
def best_bets(spark, d):
    return chosen(spark, d).select("race", "class_id", "combo", "rank", "is_backfill", (round_to("buy_score", 7) + 0.0).alias("buy_score"))


@query("race_signal", BETS + f""" , p AS (SELECT race, list(prob ORDER BY prob DESC)[1:2] AS p FROM valued GROUP BY race), q AS (SELECT race, count(*) AS n_bets, max(coalesce(ev, 0.0)) AS top_ev FROM bets GROUP BY race),
r AS (SELECT race, p[1] AS t1, p[1] - p[2] AS gap, coalesce(top_ev, 0.0) AS top_ev, coalesce(n_bets, 0) AS n_bets FROM p LEFT JOIN q USING (race))
SELECT race, {rd('t1', 't1')}, {rd('gap', 'gap')}, {rd('top_ev', 'top_ev')}, n_bets, {rd('0.42 * 100 * t1 + 0.33 * 100 * gap + 0.17 * 10 * least(top_ev, 2.0) + 0.18 * greatest(0, 7 - n_bets)', 'score')},
  CASE WHEN t1 >= 0.11 AND gap >= 0.020 AND top_ev >= 0.85 THEN 'A' WHEN t1 >= 0.08 AND gap >= 0.012 AND top_ev >= 0.65 THEN 'B' WHEN t1 >= 0.055 AND top_ev >= 0.50 THEN 'C' ELSE 'D' END AS signal FROM r""")
def race_signal(spark, d):
    return rounded(selection.race_signal(valued(spark, d), chosen(spark, d)))


@query("kelly")
def kelly_stakes(spark, d):
    """Stakes of every race; iterative, so without SQL."""
    return rounded(kelly.allocate(valued(spark, d)))
