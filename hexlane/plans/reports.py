"""Report queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..dims import LIVE_VENUES
from ..operators import reports
from ..sources.tables import parquet
from .base import LOG, VALUED, as_long, betting_log, query, ranked, rd, rounded, valued


def s_ratio(a: str, b: str, name: str) -> str:
    return rd(f"coalesce(CAST({a} AS DOUBLE) / nullif({b}, 0), 0.0)", name)


@query("ev_summary", VALUED + ", n AS (SELECT count(DISTINCT race) AS races FROM valued) SELECT races, " + ", ".join(f"{rd(f'count(DISTINCT CASE WHEN ev_rank <= {k} AND is_hit = 1 THEN race END) / CAST(races AS DOUBLE)', f'top{k}_hit_rate')}" for k in (1, 3, 5, 10)) + f", {rd('avg(CASE WHEN ev_rank = 1 THEN prob END)', 'top1_prob')}, {rd('avg(CASE WHEN ev_rank = 1 THEN odds END)', 'top1_odds')}, {rd('avg(CASE WHEN ev_rank = 1 THEN ev END)', 'top1_ev')}, {rd('avg(CASE WHEN ev_rank <= 5 THEN ev END)', 'top5_ev')} FROM valued, n GROUP BY races")
def ev_summary(spark, d):
    return rounded(reports.ev_summary(valued(spark, d)))


@query("ev_top5", VALUED + f" SELECT race, class_id, ev_rank, {rd('ev', 'ev')} FROM valued WHERE ev_rank <= 5 AND ev >= 1.0")
def ev_top5(spark, d):
    """At most five outcomes of each race by value, of value 1 at least."""
    return rounded(valued(spark, d).where("ev_rank <= 5 and ev >= 1.0").select("race", "class_id", "ev_rank", "ev"))


@query("hit_summary", VALUED + " SELECT count(*) AS hits, " + ", ".join(rd(f"avg(CAST(rank_prob <= {k} AS DOUBLE))", f"top{k}_rate") for k in (1, 3, 5, 10)) + f", {rd('avg(rank_prob)', 'mean_rank')}, {rd('median(rank_prob)', 'median_rank')} FROM valued WHERE is_hit = 1")
def hit_summary(spark, d):
    return rounded(reports.hit_summary(ranked(spark, d)))


@query("top1_bias", VALUED + f""" , g AS (SELECT combo, count(*) FILTER (WHERE rank_prob = 1) AS pred, CAST(sum(is_hit) AS BIGINT) AS actual, count(*) FILTER (WHERE rank_prob = 1 AND is_hit = 1) AS agreed FROM valued GROUP BY combo)
SELECT combo, pred, actual, agreed, {rd('CAST(pred AS DOUBLE) / sum(pred) OVER ()', 'share')}, {rd('CAST(pred AS DOUBLE) / nullif(actual, 0)', 'per_true')} FROM g""")
def top1_bias(spark, d):
    return rounded(reports.top1_bias(ranked(spark, d)))


@query("most_common", VALUED + " SELECT combo, count(*) AS n FROM valued WHERE rank_prob = 1 GROUP BY combo ORDER BY n DESC, combo LIMIT 20")
def most_common(spark, d):
    """The 20 outcomes most often predicted first."""
    return ranked(spark, d).where("rank_prob = 1").groupBy("combo").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "combo").limit(20)


@query("best_hits", VALUED + f" SELECT race, combo, rank_prob, {rd('prob', 'prob')} FROM valued WHERE is_hit = 1 ORDER BY rank_prob, race LIMIT 100")
def best_hits(spark, d):
    """The hundred hits ranked best."""
    return rounded(ranked(spark, d).where("is_hit = 1").select("race", "combo", "rank_prob", "prob").orderBy("rank_prob", "race").limit(100))


@query("hit_combo_stats", VALUED + f" SELECT combo, count(*) AS hits, {rd('avg(rank_prob)', 'avg_rank')}, {rd('avg(CAST(rank_prob <= 1 AS DOUBLE))', 'top1_rate')}, {rd('avg(CAST(rank_prob <= 3 AS DOUBLE))', 'top3_rate')} FROM valued WHERE is_hit = 1 GROUP BY combo")
def hit_combo_stats(spark, d):
    return rounded(reports.hit_combo_stats(ranked(spark, d)))


@query("topk_eval_by_venue", VALUED + f""" , h AS (SELECT venue, race, coalesce(min(CASE WHEN is_hit = 1 THEN rank_prob END), 999999) AS r FROM valued GROUP BY ALL)
SELECT coalesce(venue, 'ALL') AS venue, count(*) AS races, count(*) FILTER (WHERE r <= 1) AS top1, count(*) FILTER (WHERE r <= 3) AS top3, count(*) FILTER (WHERE r <= 5) AS top5, {rd('avg(r)', 'mean_rank')}, CAST(max(r) AS INTEGER) AS worst_rank,
  {rd('count(*) FILTER (WHERE r <= 1) / CAST(count(*) AS DOUBLE)', 'top1_rate')} FROM h GROUP BY ROLLUP (venue)""")
def topk_eval_by_venue(spark, d):
    return rounded(reports.topk_by_venue(ranked(spark, d)))


@query("venue_stats", LOG + f""" , v(venue) AS (VALUES ('15'), ('02'), ('16'), ('12'), ('00')),
g AS (SELECT venue, count(DISTINCT (date, race_no)) AS race_count, count(*) AS buy_count, sum(is_hit) AS hit_count, sum(bet_cost_yen) AS total_bet, sum(return_yen) AS total_return FROM log WHERE is_selected = 1 GROUP BY venue),
z AS (SELECT venue, CAST(coalesce(race_count, 0) AS BIGINT) AS race_count, CAST(coalesce(buy_count, 0) AS BIGINT) AS buy_count, CAST(coalesce(hit_count, 0) AS BIGINT) AS hit_count, CAST(coalesce(total_bet, 0) AS BIGINT) AS total_bet, CAST(coalesce(total_return, 0) AS BIGINT) AS total_return FROM v LEFT JOIN g USING (venue))
SELECT venue, race_count, buy_count, hit_count, {s_ratio('hit_count', 'buy_count', 'hit_rate')}, {s_ratio('buy_count', 'race_count', 'avg_points')}, total_bet, total_return, total_return - total_bet AS profit, {s_ratio('total_return', 'total_bet', 'roi')} FROM z""")
def venue_stats(spark, d):
    return rounded(reports.venue_stats(betting_log(spark, d), [*LIVE_VENUES, "00"]))


@query("ev_bins", LOG + f""" , b AS (SELECT *, CASE WHEN ev >= 3.0 THEN 'EV>=3.0' WHEN ev >= 2.0 THEN 'EV 2.0-3.0' WHEN ev >= 1.5 THEN 'EV 1.5-2.0' WHEN ev >= 1.2 THEN 'EV 1.2-1.5' WHEN ev >= 1.0 THEN 'EV 1.0-1.2' ELSE 'EV<1.0' END AS band FROM log)
SELECT band, count(*) AS bets, CAST(sum(bet_cost_yen) AS BIGINT) AS total_bet, CAST(sum(return_yen) AS BIGINT) AS total_return, CAST(sum(is_hit) AS BIGINT) AS hits, {s_ratio('sum(return_yen)', 'sum(bet_cost_yen)', 'roi')}, {s_ratio('sum(is_hit)', 'count(*)', 'hit_rate')} FROM b GROUP BY band""")
def ev_bins(spark, d):
    return rounded(reports.ev_bands(betting_log(spark, d)))


@query("roi_rollup", LOG + f""" SELECT coalesce(venue, 'ALL') AS venue, count(DISTINCT race) AS races, CAST(sum(bet_cost_yen) AS BIGINT) AS invest, CAST(sum(return_yen) AS BIGINT) AS returned, count(DISTINCT CASE WHEN return_yen > 0 THEN race END) AS hit_races,
  CAST(sum(return_yen) - sum(bet_cost_yen) AS BIGINT) AS profit, {s_ratio('sum(return_yen)', 'sum(bet_cost_yen)', 'roi')}, {s_ratio('count(DISTINCT CASE WHEN return_yen > 0 THEN race END)', 'count(DISTINCT race)', 'hit_rate')} FROM log GROUP BY ROLLUP (venue)""")
def roi_rollup(spark, d):
    return rounded(reports.roi_rollup(betting_log(spark, d)))


@query("event_counters", "SELECT event_type, count(*) AS total, count(*) FILTER (WHERE value > 50) AS kept, count(DISTINCT user_id) AS users FROM events GROUP BY event_type")
def event_counters(spark, d):
    """Counters of an append log by kind."""
    return parquet(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("total"), F.sum((F.col("value") > 50).cast("long")).alias("kept"), F.countDistinct("user_id").alias("users"))


@query("log_races", LOG + " SELECT venue, date, CAST(count(*) AS BIGINT) AS n, CAST(sum(profit_yen) AS BIGINT) AS profit FROM log WHERE is_selected = 1 GROUP BY venue, date")
def log_races(spark, d):
    return betting_log(spark, d).where("is_selected = 1").groupBy("venue", "date").agg(F.count("*").alias("n"), F.sum("profit_yen").alias("profit")).select("venue", "date", *as_long("n", "profit"))
