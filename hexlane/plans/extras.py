"""Smaller operators: weights, bands, recovery of codes, samples, whole-table ranks, trained scorers."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..dims import VENUES
from ..functions.scalars import round_to
from ..operators import models, race_boosting, reports
from ..operators.features import binary_lanes
from ..sources.tables import parquet
from .base import LOG, RUNNERS, VALUED, betting_log, query, races, ranked, rd, rounded, runners, valued

WEIGHTS = [("lane", 0.5), ("motor", -1.0), ("st", 1.5), ("grade", float("nan")), ("other", 0.0)]
_W = ", ".join(f"('{g}', {'NULL' if w != w else w}::DOUBLE)" for g, w in WEIGHTS)


@query("weight_normalize", f"WITH w(grp, w) AS (VALUES {_W}) SELECT grp, {rd('greatest(coalesce(w, 0.0), 0.0) / sum(greatest(coalesce(w, 0.0), 0.0)) OVER ()', 'weight')} FROM w")
def weight_normalize(spark, d):
    """Negative and missing weights count as 0; all zero would be uniform."""
    w = spark.createDataFrame(WEIGHTS, "grp string, w double")
    good = F.when(F.col("w").isNull() | F.isnan("w") | (F.col("w") < 0), 0.0).otherwise(F.col("w"))
    every = F.sum("g").over(Window.partitionBy())
    out = w.withColumn("g", good).withColumn("weight", F.when(every > 0, F.try_divide(F.col("g"), every)).otherwise(1.0 / F.count("*").over(Window.partitionBy())))
    return rounded(out.select("grp", "weight"))


@query("roi_simulation", LOG + f""" , t AS (SELECT venue, race, count(*) * 100 AS invest, sum(CASE WHEN is_hit = 1 THEN coalesce(payout, 0) * 100 // 100 ELSE 0 END) AS back FROM log WHERE rank_prob <= 3 GROUP BY venue, race)
SELECT venue, count(*) AS races, CAST(sum(invest) AS BIGINT) AS invest, CAST(sum(back) AS BIGINT) AS back, count(*) FILTER (WHERE back > 0) AS hits, {rd('sum(back) / CAST(sum(invest) AS DOUBLE)', 'roi')} FROM t GROUP BY venue""")
def roi_simulation(spark, d):
    """Three bets of one unit a race."""
    back = F.when(F.col("is_hit") == 1, F.floor(F.coalesce("payout", F.lit(0)) * 100 / 100)).otherwise(0)
    t = betting_log(spark, d).where("rank_prob <= 3").groupBy("venue", "race").agg((F.count("*") * 100).alias("invest"), F.sum(back).cast("long").alias("back"))
    out = t.groupBy("venue").agg(F.count("*").alias("races"), F.sum("invest").alias("invest"), F.sum("back").alias("back"), F.sum((F.col("back") > 0).cast("long")).alias("hits"))
    return rounded(out.withColumn("roi", reports.ratio(F.col("back"), F.col("invest"))))


@query("display_bands", VALUED + f""" , x AS (SELECT *, min(odds) OVER (PARTITION BY race) AS lo, max(odds) OVER (PARTITION BY race) AS hi FROM valued)
SELECT race, class_id, CASE WHEN ev >= 2.0 THEN 'hot' WHEN ev >= 1.2 THEN 'good' ELSE '' END AS ev_band, CASE WHEN rank_prob = 1 THEN 'top1' WHEN rank_prob <= 3 THEN 'top3' WHEN rank_prob <= 10 THEN 'top10' ELSE '' END AS prob_band,
  {rd('CASE WHEN hi > lo THEN (odds - lo) / (hi - lo) END', 'odds_position')}, {rd('least(1.0 / greatest(prob, 1e-6), 100.0)', 'pseudo_odds', 4)} FROM x""")
def display_bands(spark, d):
    """Value and probability bands, place of the odds in the race's range, odds implied by the probability."""
    w = Window.partitionBy("race")
    lo, hi = F.min("odds").over(w), F.max("odds").over(w)
    ev = F.when(F.col("ev") >= 2.0, "hot").when(F.col("ev") >= 1.2, "good").otherwise("")
    p = F.when(F.col("rank_prob") == 1, "top1").when(F.col("rank_prob") <= 3, "top3").when(F.col("rank_prob") <= 10, "top10").otherwise("")
    return ranked(spark, d).select("race", "class_id", ev.alias("ev_band"), p.alias("prob_band"), (round_to(F.when(hi > lo, F.try_divide(F.col("odds") - lo, hi - lo)), 6) + 0.0).alias("odds_position"), (round_to(F.least(1.0 / F.greatest("prob", F.lit(1e-6)), F.lit(100.0)), 4) + 0.0).alias("pseudo_odds"))


@query("top_gap", VALUED + f" SELECT race, {rd('max(CASE WHEN rank_prob = 1 THEN prob END) - max(CASE WHEN rank_prob = 2 THEN prob END)', 'gap', 8)} FROM valued GROUP BY race")
def top_gap(spark, d):
    p = lambda k: F.max(F.when(F.col("rank_prob") == k, F.col("prob")))
    return rounded(ranked(spark, d).groupBy("race").agg((p(1) - p(2)).alias("gap")), 8)


@query("sampled_races", VALUED + " SELECT race FROM races ORDER BY md5('7-' || race), race LIMIT 100")
def sampled_races(spark, d):
    """A hundred races drawn by a seeded hash."""
    return races(spark, d).select("race").orderBy(F.md5(F.encode(F.concat(F.lit("7-"), F.col("race").cast("string")), "UTF-8")), "race").limit(100)


@query("global_rank", RUNNERS + " SELECT race, lane, rank() OVER (ORDER BY win_rate DESC)::INTEGER AS whole_rank, CAST(rank() OVER (PARTITION BY race ORDER BY win_rate DESC) AS INTEGER) AS race_rank FROM runners")
def global_rank(spark, d):
    """Shared ranks over the whole table, by counts of values rather than one sorted partition, and in the race."""
    df = runners(spark, d)
    counts = df.groupBy("win_rate").agg(F.count("*").alias("n"))
    above = F.sum("n").over(Window.orderBy(F.desc("win_rate")).rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("win_rate", (F.coalesce(above, F.lit(0)) + 1).cast("int").alias("whole_rank"))
    race = F.rank().over(Window.partitionBy("race").orderBy(F.desc("win_rate")))
    return df.withColumn("race_rank", race).join(counts, "win_rate").select("race", "lane", "whole_rank", "race_rank")


_V = ", ".join(f"('{c}', '{n}')" for c, n in VENUES.items())


@query("venue_recovery", f"""WITH v(code, name) AS (VALUES {_V}), r AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE lpad(CAST(o_orderkey % 26 AS VARCHAR), 2, '0') END AS code0, o_orderkey % 24 + 1 AS k FROM orders),
s AS (SELECT o_orderkey, code0, CASE WHEN o_orderkey % 3 = 0 THEN (SELECT name FROM v WHERE code = lpad(CAST(k AS VARCHAR), 2, '0')) END AS name0 FROM r)
SELECT o_orderkey, coalesce(s.code0, b.code, '00') AS venue_code, coalesce(s.name0, a.name, 'UNKNOWN') AS venue FROM s LEFT JOIN v a ON a.code = s.code0 LEFT JOIN v b ON b.name = s.name0""")
def venue_recovery(spark, d):
    """Venue codes from names and names from codes."""
    v = F.broadcast(spark.createDataFrame(list(VENUES.items()), "code string, name string"))
    o = parquet(spark, d, "orders").select("o_orderkey")
    named = F.col("o_orderkey") % 3 == 0
    code = F.when(~named, F.lpad((F.col("o_orderkey") % 26).cast("string"), 2, "0"))
    name = F.when(named, F.element_at(F.array(*map(F.lit, VENUES.values())), (F.col("o_orderkey") % 24 + 1).cast("int")))
    o = o.select("o_orderkey", code.alias("code0"), name.alias("name0"))
    o = o.join(v.select(F.col("code").alias("code0"), F.col("name").alias("name1")), "code0", "left").join(v.select(F.col("name").alias("name0"), F.col("code").alias("code1")), "name0", "left")
    return o.select("o_orderkey", F.coalesce("code0", "code1", F.lit("00")).alias("venue_code"), F.coalesce("name0", "name1", F.lit("UNKNOWN")).alias("venue"))


@query("label_priority", "SELECT o_orderkey, coalesce(nullif(CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE o_orderstatus END, ''), o_orderpriority) AS label, coalesce(c_acctbal, 0.0) AS payout FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_nationkey < 12")
def label_priority(spark, d):
    """A label of one source where it has any, else of another."""
    c = parquet(spark, d, "customer").where("c_nationkey < 12").select(F.col("c_custkey").alias("o_custkey"), "c_acctbal")
    own = F.when(F.col("o_orderkey") % 2 == 0, "").otherwise(F.col("o_orderstatus"))
    return parquet(spark, d, "orders").join(c, "o_custkey", "left").select("o_orderkey", F.coalesce(F.nullif(own, F.lit("")), F.col("o_orderpriority")).alias("label"), F.coalesce("c_acctbal", F.lit(0.0)).alias("payout"))


@query("best_ev_by_venue", VALUED + f" SELECT venue, {rd('max(ev)', 'most')}, count(*) FILTER (WHERE ev >= 2) AS hot FROM valued GROUP BY venue")
def best_ev_by_venue(spark, d):
    return rounded(valued(spark, d).groupBy("venue").agg(F.max("ev").alias("most"), F.sum((F.col("ev") >= 2).cast("long")).alias("hot"))).na.fill(0, ["hot"])


@query("trained_topk")
def trained_topk(spark, d):
    """A boosted scorer trained on the earlier races and evaluated by venue on the later ones; without SQL."""
    rows = binary_lanes(races(spark, d), ("date", "venue", "y_class"))
    lanes = race_boosting.Lanes(["st_inv", "exhibit_inv", "course_diff", "motor", "boat"], ["st_inv", "exhibit_inv", "motor", "boat"])
    model = models.train_binary(rows.where("date <= '19991231'"), lanes, "y_class", trees=5, depth=3)
    return reports.topk_by_venue(race_boosting.hit_ranks(model, rows.where("date > '19991231'"), "y_class", ["race", "venue"]))
