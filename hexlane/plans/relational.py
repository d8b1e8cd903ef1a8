"""Panel, expansion, joins, reshaping, sets, splits and scalar functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..dims import GRADES, LANES, LIVE_VENUES, class_id, code_map, outcomes
from ..functions import scalars
from ..functions.scalars import round_to
from ..operators import reports, scoring, selection
from ..sources import panel
from ..sources.tables import first_alias, parquet
from .base import COMBOS, LOG, RACES, RUNNERS, SCORED, VALUED, betting_log, combos, query, races, ranked, rd, rounded, runners, scored, valued


@query("race_panel", RUNNERS + f" SELECT race, lane, racer_no, motor, boat, {rd('exhibit', 'exhibit')}, course, {rd('st', 'st')}, win_rate, {rd('place_rate', 'place_rate')}, finish, date, venue FROM runners")
def race_panel(spark, d):
    return rounded(runners(spark, d).drop("price"))


@query("combo_expand", COMBOS + " SELECT race, class_id, combo, a, b, c FROM combos")
def combo_expand(spark, d):
    return combos(spark, d).select("race", "class_id", "combo", "a", "b", "c")


@query("class_ids", COMBOS + " SELECT class_id, combo, CAST(class_id % 20 * 6 + class_id // 20 AS INTEGER) AS fixed_pos, class_id AS computed FROM outcomes")
def class_ids(spark, d):
    return outcomes(spark).select("class_id", "combo", "fixed_pos", class_id(F.col("a"), F.col("b"), F.col("c")).alias("computed"))


@query("softmax_temp", SCORED + f" SELECT race, class_id, {rd('score', 'score')}, {rd('prob', 'prob', 9)} FROM scored")
def softmax_temp(spark, d):
    return scored(spark, d).select("race", "class_id", (round_to("score", 6) + 0.0).alias("score"), (round_to("prob", 9) + 0.0).alias("prob"))


@query("odds_join", SCORED + f" SELECT race, class_id, coalesce(odds, 0.0) AS odds, {rd('prob * coalesce(odds, 0.0)', 'ev')} FROM scored")
def odds_join(spark, d):
    """Probabilities with odds of another table, 0 where it has none."""
    odds = combos(spark, d).select("race", "class_id", scoring.synthetic_odds().alias("odds")).where("odds is not null")
    out = scored(spark, d).drop("odds").join(odds, ["race", "class_id"], "left").withColumn("odds", F.coalesce("odds", F.lit(0.0)))
    return rounded(out.select("race", "class_id", "odds", (F.col("prob") * F.col("odds")).alias("ev")))


@query("minmax_norm", SCORED + f""" , m AS (SELECT *, min(score) OVER w AS lo, max(score) OVER w AS hi FROM scored WINDOW w AS (PARTITION BY race))
SELECT race, class_id, {rd('CASE WHEN hi > lo THEN (score - lo) / (hi - lo) ELSE 0.0 END', 'scaled')} FROM m""")
def minmax_norm(spark, d):
    df = scored(spark, d)
    return rounded(df.select("race", "class_id", scoring.minmax(F.col("score"), scoring.by_race()).alias("scaled")))


@query("blend", SCORED + f""" , x AS (SELECT *, prob * (1 - 0.11199::DOUBLE) + (1.0::DOUBLE / 120) * 0.11199::DOUBLE AS m FROM scored)
SELECT race, class_id, {rd('m / sum(m) OVER (PARTITION BY race)', 'blended', 9)} FROM x""")
def blend(spark, d):
    df = scored(spark, d).withColumn("even", F.lit(1.0) / 120)
    return rounded(scoring.blend(df, "prob", "even", 0.11199, "blended").select("race", "class_id", "blended"), 9)


def _scale(m: str, sign: str = "") -> str:
    return f"CASE WHEN max({sign}{m}) OVER w > min({sign}{m}) OVER w THEN ({sign}{m} - min({sign}{m}) OVER w) / (max({sign}{m}) OVER w - min({sign}{m}) OVER w) ELSE 0.0 END"


@query("manual_prob", COMBOS + f""" , f AS (SELECT race, class_id, win_rate[a] AS first_win_rate, st[a] AS first_st, exhibit[a] AS first_exhibit, motor[b] AS second_motor FROM combos),
g AS (SELECT race, class_id, {_scale('first_win_rate')} * 0.4::DOUBLE + {_scale('first_st', '-')} * 0.3::DOUBLE + {_scale('first_exhibit', '-')} * 0.2::DOUBLE + {_scale('second_motor')} * 0.1::DOUBLE AS manual_score
  FROM f WINDOW w AS (PARTITION BY race)),
h AS (SELECT *, exp(manual_score - max(manual_score) OVER (PARTITION BY race)) AS e FROM g)
SELECT race, class_id, {rd('manual_score', 'manual_score', 9)}, {rd('e / sum(e) OVER (PARTITION BY race)', 'manual_prob', 9)} FROM h""")
def manual_prob(spark, d):
    df = combos(spark, d).select("race", "class_id", panel.at("a", "win_rate").alias("first_win_rate"), panel.at("a", "st").alias("first_st"), panel.at("a", "exhibit").alias("first_exhibit"), panel.at("b", "motor").cast("double").alias("second_motor"))
    out = scoring.manual_probability(df, {"first_win_rate": 0.4, "first_st": 0.3, "first_exhibit": 0.2, "second_motor": 0.1})
    return out.select("race", "class_id", (round_to("manual_score", 9) + 0.0).alias("manual_score"), (round_to("manual_prob", 9) + 0.0).alias("manual_prob"))


@query("ensemble", SCORED + f""" , p AS (SELECT race, class_id, prob * 0.6::DOUBLE AS p FROM scored UNION ALL SELECT race, class_id, (1.0::DOUBLE / 60) * 0.4::DOUBLE FROM scored WHERE odds IS NOT NULL),
q AS (SELECT race, class_id, sum(p) AS p FROM p GROUP BY ALL)
SELECT race, class_id, {rd('p / sum(p) OVER (PARTITION BY race)', 'prob', 9)} FROM q""")
def ensemble(spark, d):
    df = scored(spark, d)
    other = df.where("odds is not null").select("race", "class_id", (F.lit(1.0) / 60).alias("prob"))
    return rounded(scoring.ensemble([(df, 0.6), (other, 0.4)]).select("race", "class_id", "prob"), 9)


PRIORS = SCORED + """ , win AS (SELECT venue, a, b FROM scored WHERE is_hit = 1), tot AS (SELECT venue, count(*) AS n FROM win GROUP BY venue), ven AS (SELECT DISTINCT venue FROM scored),
f1 AS (SELECT v.venue, l.x AS a, (coalesce(k, 0) + 1) / CAST(coalesce(n, 0) + 6 AS DOUBLE) AS first_prior FROM ven v CROSS JOIN lanes l LEFT JOIN (SELECT venue, a, count(*) AS k FROM win GROUP BY ALL) g ON g.venue = v.venue AND g.a = l.x LEFT JOIN tot ON tot.venue = v.venue),
f2 AS (SELECT v.venue, l.x AS a, m.x AS b, (coalesce(k, 0) + 1) / CAST(coalesce(n, 0) + 30 AS DOUBLE) AS pair_prior FROM ven v CROSS JOIN lanes l JOIN lanes m ON l.x <> m.x
  LEFT JOIN (SELECT venue, a, b, count(*) AS k FROM win GROUP BY ALL) g ON g.venue = v.venue AND g.a = l.x AND g.b = m.x LEFT JOIN tot ON tot.venue = v.venue)"""


def priors(spark, d):
    # a race has one winning outcome, so its own row tells the first two lanes
    df = races(spark, d).select("venue", F.col("w1").alias("a"), F.col("w2").alias("b"))
    return reports.lane_priors(df, df.select("venue").distinct())


@query("lane_priors", PRIORS + f" SELECT venue, 'first' AS kind, CAST(a AS VARCHAR) AS key, {rd('first_prior', 'prior')} FROM f1 UNION ALL SELECT venue, 'pair', a || '-' || b, round(pair_prior, 6) + 0.0 FROM f2")
def lane_priors(spark, d):
    first, pair = priors(spark, d)
    out = first.select("venue", F.lit("first").alias("kind"), F.col("a").cast("string").alias("key"), F.col("first_prior").alias("prior"))
    return rounded(out.union(pair.select("venue", F.lit("pair"), F.concat_ws("-", "a", "b"), "pair_prior")))


@query("lane_bias", PRIORS + f""" , j AS (SELECT race, class_id, prob * pow(coalesce(first_prior, 1.0), 0.55) * pow(coalesce(pair_prior, 1.0), 0.25) AS p FROM scored LEFT JOIN f1 USING (venue, a) LEFT JOIN f2 USING (venue, a, b))
SELECT race, class_id, {rd('p / sum(p) OVER (PARTITION BY race)', 'adjusted', 8)} FROM j""")
def lane_bias(spark, d):
    first, pair = priors(spark, d)
    return rounded(scoring.lane_bias(scored(spark, d), first, pair).select("race", "class_id", "adjusted"), 8)


@query("ev_table", VALUED + f" SELECT race, class_id, odds, {rd('ev', 'ev')}, {rd('edge', 'edge')}, is_hit, ev_rank FROM valued")
def ev_table(spark, d):
    return rounded(valued(spark, d).select("race", "class_id", "odds", "ev", "edge", "is_hit", "ev_rank"))


@query("complete_races", "SELECT l_orderkey AS race, CAST(l_linenumber AS BIGINT) AS line FROM lineitem WHERE l_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING count(*) = 6)")
def complete_races(spark, d):
    """Lines of orders that have exactly six."""
    lines = parquet(spark, d, "lineitem").select(F.col("l_orderkey").alias("race"), F.col("l_linenumber").cast("long").alias("line"))
    return reports.complete_races(lines, 6)


@query("unlisted_candidates", VALUED + " SELECT race, class_id FROM valued WHERE odds > 0 AND (ev_rank IS NULL OR ev_rank > 100)")
def unlisted_candidates(spark, d):
    """Anti join: priced outcomes that aren't among the first hundred by value."""
    df = valued(spark, d)
    return df.where("odds > 0").select("race", "class_id").join(df.where("ev_rank <= 100").select("race", "class_id"), ["race", "class_id"], "left_anti")


@query("pivot_lanes", RUNNERS + " SELECT race, " + ", ".join(f"max(CASE WHEN lane = {i} THEN {m} END) AS lane{i}_{m}" for i in LANES for m in ("racer_no", "motor", "finish")) + " FROM runners GROUP BY race")
def pivot_lanes(spark, d):
    wide = runners(spark, d).groupBy("race").pivot("lane", list(LANES)).agg(F.max("racer_no").alias("racer_no"), F.max("motor").alias("motor"), F.max("finish").alias("finish"))
    return wide.select("race", *[F.col(f"{i}_{m}").alias(f"lane{i}_{m}") for i in LANES for m in ("racer_no", "motor", "finish")])


@query("unpivot_lanes", RUNNERS + " SELECT race, lane, 'motor' AS metric, CAST(motor AS BIGINT) AS value FROM runners UNION ALL SELECT race, lane, 'boat', CAST(boat AS BIGINT) FROM runners")
def unpivot_lanes(spark, d):
    long = runners(spark, d).select("race", "lane", F.col("motor").cast("long").alias("motor"), F.col("boat").cast("long").alias("boat"))
    return long.unpivot(["race", "lane"], ["motor", "boat"], "metric", "value")


@query("densify", SCORED + """ , few AS (SELECT race, class_id, payout FROM scored WHERE odds > 90), r AS (SELECT DISTINCT race FROM few)
SELECT r.race, o.class_id, coalesce(payout, 0) AS payout FROM r CROSS JOIN outcomes o LEFT JOIN few USING (race, class_id)""")
def densify(spark, d):
    few = scored(spark, d).where("odds > 90").select("race", "class_id", "payout")
    every = few.select("race").distinct().crossJoin(F.broadcast(outcomes(spark).select("class_id")))
    return every.join(few, ["race", "class_id"], "left").na.fill(0, ["payout"])


@query("grouped_odds", SCORED + f" SELECT race, a, count(odds) AS priced, {rd('min(odds)', 'least')}, {rd('max(odds)', 'most')} FROM scored GROUP BY race, a")
def grouped_odds(spark, d):
    """Odds grouped by the first lane as a map, and what comes of it."""
    got = scored(spark, d).where("odds is not null").groupBy("race", "a").agg(F.map_from_entries(F.collect_list(F.struct(F.struct("b", "c"), "odds"))).alias("odds"))
    values = F.map_values("odds")
    return rounded(got.select("race", "a", F.size("odds").cast("long").alias("priced"), F.array_min(values).alias("least"), F.array_max(values).alias("most")))


@query("set_diff_classes", SCORED + " SELECT class_id FROM outcomes EXCEPT SELECT class_id FROM scored WHERE is_hit = 1")
def set_diff_classes(spark, d):
    """Classes that never won."""
    return outcomes(spark).select("class_id").subtract(scored(spark, d).where("is_hit = 1").select("class_id"))


@query("set_union_keys", "SELECT CAST(l_suppkey AS BIGINT) AS k FROM lineitem UNION SELECT CAST(s_suppkey AS BIGINT) FROM supplier")
def set_union_keys(spark, d):
    return parquet(spark, d, "lineitem").select(F.col("l_suppkey").alias("k")).union(parquet(spark, d, "supplier").select("s_suppkey")).distinct()


@query("set_intersect", "SELECT o_custkey AS k FROM orders INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal > 0")
def set_intersect(spark, d):
    return parquet(spark, d, "orders").select(F.col("o_custkey").alias("k")).intersect(parquet(spark, d, "customer").where("c_acctbal > 0").select("c_custkey"))


STATS = """ , stats AS (SELECT s_suppkey AS racer_no, s_nationkey AS ability, CASE WHEN s_suppkey % 3 = 0 THEN '-' ELSE s_name END AS s_grade FROM supplier)"""


@query("stats_fill", RUNNERS + STATS + """ SELECT race, lane, r.racer_no, CASE WHEN r.racer_no % 2 = 0 THEN coalesce(s_grade, '-') ELSE 'own' END AS grade, coalesce(ability, 0) AS ability FROM runners r LEFT JOIN stats USING (racer_no)""")
def stats_fill(spark, d):
    """Racer statistics joined by number: blank cells are filled, ability always taken."""
    stats = parquet(spark, d, "supplier").select(F.col("s_suppkey").alias("racer_no"), F.col("s_nationkey").alias("ability"), F.when(F.col("s_suppkey") % 3 == 0, "-").otherwise(F.col("s_name")).alias("s_grade"))
    df = runners(spark, d).select("race", "lane", "racer_no", F.when(F.col("racer_no") % 2 == 0, "-").otherwise("own").alias("grade")).join(stats, "racer_no", "left")
    grade = F.when(scalars.blank(F.col("grade")), F.coalesce("s_grade", F.lit("-"))).otherwise(F.col("grade"))
    return df.select("race", "lane", "racer_no", grade.alias("grade"), F.coalesce("ability", F.lit(0)).alias("ability"))


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(repr(x) for x in r) + ")" for r in rows)


CONFIG = f"""WITH b(venue, {', '.join(selection.FIELDS)}) AS (VALUES {_values(selection.BASE)}), o(venue, {', '.join(selection.FIELDS)}) AS (VALUES {_values(selection.TUNED)}),
k AS (SELECT venue FROM b UNION SELECT venue FROM o), x AS (SELECT k.venue, {', '.join(f'CAST(coalesce(o.{f}, b.{f}, d.{f}) AS {"INTEGER" if "points" in f else "DOUBLE"}) AS {f}' for f in selection.FIELDS)}
  FROM k LEFT JOIN b USING (venue) LEFT JOIN o ON o.venue = k.venue CROSS JOIN (SELECT * FROM b WHERE venue = 'default') d),
conf AS (SELECT * REPLACE (least(greatest(min_points, 3), 12) AS min_points, greatest(least(greatest(max_points, 3), 12), least(greatest(min_points, 3), 12)) AS max_points) FROM x)"""


@query("config_overlay", CONFIG + " SELECT * FROM conf")
def config_overlay(spark, d):
    return selection.settings(spark)


@query("split_by_date", SCORED + " SELECT race, CASE WHEN date <= '19981231' THEN 'train' WHEN date <= '20000630' THEN 'valid' ELSE 'test' END AS part FROM races")
def split_by_date(spark, d):
    return races(spark, d).select("race", reports.time_split(F.col("date"), "19981231", "20000630").alias("part"))


@query("split_by_rank", RACES + """ , p AS (SELECT race, CAST(row_number() OVER (ORDER BY date, race) AS BIGINT) AS place, count(*) OVER () AS n FROM races)
SELECT race, place, CASE WHEN place <= floor(n * 0.70::DOUBLE) THEN 'train' WHEN place <= floor(n * 0.85::DOUBLE) THEN 'valid' ELSE 'test' END AS part,
  CASE WHEN place <= floor(n * 0.70::DOUBLE) THEN 'train' WHEN place <= floor(n * 0.70::DOUBLE) + floor(n * 0.15::DOUBLE) THEN 'valid' ELSE 'test' END AS part_b FROM p""")
def split_by_rank(spark, d):
    base = races(spark, d).select("race", "date")
    one, two = reports.share_split(base), reports.share_split(base, separate=True)
    return one.select("race", F.col("place").cast("long").alias("place"), "part").join(two.select("race", F.col("part").alias("part_b")), "race")


@query("last_races", RACES + " SELECT race, date FROM races ORDER BY date DESC, race DESC LIMIT 100")
def last_races(spark, d):
    """The last hundred races by date."""
    return races(spark, d).select("race", "date").orderBy(F.desc("date"), F.desc("race")).limit(100)


@query("dedupe_first", "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events) WHERE r = 1")
def dedupe_first(spark, d):
    return reports.latest(parquet(spark, d, "events"), ["user_id"], [F.asc("ts"), F.asc("event_id")]).select("user_id", "event_id", "event_type")


@query("dedupe_last", "SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def dedupe_last(spark, d):
    return reports.latest(parquet(spark, d, "events"), ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_type", "event_id", "value")


@query("combo_normalize", """WITH t AS (SELECT l_orderkey, l_linenumber, l_partkey || '－' || l_suppkey || '=' || l_linenumber AS raw FROM lineitem),
n AS (SELECT *, regexp_extract_all(translate(raw, '０１２３４５６７８９－＝', '0123456789-='), '[1-6]') AS g FROM t)
SELECT raw, CASE WHEN len(g) >= 3 THEN g[1] || '-' || g[2] || '-' || g[3] ELSE '' END AS combo, count(*) AS n FROM n GROUP BY ALL""")
def combo_normalize(spark, d):
    raw = parquet(spark, d, "lineitem").select(F.concat(F.col("l_partkey"), F.lit("－"), F.col("l_suppkey"), F.lit("="), F.col("l_linenumber")).alias("raw"))
    return raw.select("raw", scalars.combo_normalize(F.col("raw")).alias("combo")).groupBy("raw", "combo").agg(F.count("*").alias("n"))


@query("safe_double", """WITH t AS (SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'F.' || lpad(CAST(p_size AS VARCHAR), 2, '0') WHEN 1 THEN p_size || 'CM' WHEN 2 THEN p_size || '.5M' WHEN 3 THEN '1,' || lpad(CAST(p_size AS VARCHAR), 3, '0') WHEN 4 THEN '-' ELSE '.' || p_size END AS raw FROM part)
SELECT p_partkey, raw, CASE p_partkey % 6 WHEN 0 THEN p_size / 100.0 WHEN 1 THEN p_size WHEN 2 THEN p_size + 0.5 WHEN 3 THEN 1000 + p_size WHEN 4 THEN 0 ELSE CAST('0.' || p_size AS DOUBLE) END::DOUBLE AS value FROM t JOIN part USING (p_partkey)""")
def safe_double(spark, d):
    size, two = F.col("p_size").cast("string"), F.lpad(F.col("p_size").cast("string"), 2, "0")
    k = F.col("p_partkey") % 6
    raw = F.when(k == 0, F.concat(F.lit("F."), two)).when(k == 1, F.concat(size, F.lit("CM"))).when(k == 2, F.concat(size, F.lit(".5M"))).when(k == 3, F.concat(F.lit("1,"), F.lpad(size, 3, "0"))).when(k == 4, "-").otherwise(F.concat(F.lit("."), size))
    return parquet(spark, d, "part").select("p_partkey", raw.alias("raw")).withColumn("value", scalars.safe_double(F.col("raw")))


@query("scalar_codes", f"""SELECT o_orderkey, lpad(CAST(o_orderkey AS VARCHAR), CAST(greatest(8, length(CAST(o_orderkey AS VARCHAR))) AS INTEGER), '0') AS padded, strftime(o_orderdate, '%Y-%m-%d') AS day,
  CASE o_orderkey % 4 WHEN 0 THEN 4 WHEN 1 THEN 3 WHEN 2 THEN 2 ELSE 1 END AS grade, {rd('CASE WHEN o_orderkey % 3 = 0 THEN 0.0 ELSE o_totalprice / (o_orderkey % 3) END', 'ratio', 4)},
  CASE WHEN o_orderpriority[1] IN ('1', '2', '3', '4') THEN (['15', '02', '16', '12'])[CAST(o_orderpriority[1] AS INTEGER)] ELSE 'default' END AS venue FROM orders""")
def scalar_codes(spark, d):
    o = parquet(spark, d, "orders")
    grade = F.element_at(F.array(*map(F.lit, ("A1", "A2", "B1", "B2"))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    venue = F.element_at(F.array(*map(F.lit, (*LIVE_VENUES.values(), "?"))), F.substring("o_orderpriority", 1, 1).cast("int"))
    return rounded(o.select("o_orderkey", scalars.zfill(F.col("o_orderkey").cast("string"), 8).alias("padded"), scalars.dashed(F.date_format("o_orderdate", "yyyyMMdd")).alias("day"), code_map(GRADES, grade, 0).alias("grade"), scalars.safe_divide(F.col("o_totalprice"), (F.col("o_orderkey") % 3).cast("double")).alias("ratio"), scalars.venue_code(venue).alias("venue")), 4)


@query("alias_columns", "SELECT race_key, combo, pred_proba FROM (SELECT l_orderkey AS race_key, l_linenumber AS combo, l_tax + 0.0 AS pred_proba FROM lineitem)")
def alias_columns(spark, d):
    df = parquet(spark, d, "lineitem").select(F.col("l_orderkey").alias("race_key"), F.col("l_linenumber").alias("combo"), (F.col("l_tax") + 0.0).alias("score"), F.col("l_discount").alias("prob"))
    return first_alias(df, {"pred_proba": ["score", "prob", "prediction"]}).select("race_key", "combo", "pred_proba")


@query("merge_results", LOG + """ , res AS (SELECT race, w1 || '-' || w2 || '-' || w3 AS actual, row_number() OVER (PARTITION BY race ORDER BY k DESC) AS r FROM races, (VALUES (0), (1)) t(k))
SELECT race, class_id, is_selected, CAST(combo = actual AS INTEGER) AS is_hit, bet_cost_yen, return_yen, profit_yen FROM log JOIN res USING (race) WHERE r = 1""")
def merge_results(spark, d):
    """Predictions with the latest result of their race, and the realised profit."""
    won = races(spark, d).select("race", F.concat_ws("-", "w1", "w2", "w3").alias("actual"))
    results = won.crossJoin(spark.createDataFrame([(0,), (1,)], "logged_at int"))
    last = reports.latest(results, ["race"], [F.desc("logged_at")])
    df = ranked(spark, d).select("race", "class_id", "combo", "payout", (F.col("rank_prob") <= 5).cast("int").alias("is_selected")).join(last, "race", "left")
    df = df.withColumn("is_hit", F.coalesce((F.col("combo") == F.col("actual")).cast("int"), F.lit(0)))
    return reports.profit_and_loss(df).select("race", "class_id", "is_selected", "is_hit", "bet_cost_yen", "return_yen", "profit_yen")


@query("top_orders", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def top_orders(spark, d):
    """A plain global head of 100."""
    return parquet(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(100)


@query("distinct_counts", SCORED + " SELECT count(DISTINCT race) AS races, count(DISTINCT combo) AS combos, count(DISTINCT venue) AS venues, count(*) AS n, sum(is_hit) AS hits FROM scored")
def distinct_counts(spark, d):
    return scored(spark, d).agg(F.countDistinct("race").alias("races"), F.countDistinct("combo").alias("combos"), F.countDistinct("venue").alias("venues"), F.count("*").alias("n"), F.sum("is_hit").alias("hits"))


@query("sanitized", "SELECT event_id, CASE WHEN event_type = 'error' THEN 0.0 ELSE value END AS value FROM events")
def sanitized(spark, d):
    """Non-finite and missing numbers as 0."""
    v = F.when(F.col("event_type") == "error", F.when(F.col("event_id") % 2 == 0, F.lit(float("nan"))).otherwise(F.lit(float("inf")))).otherwise(F.col("value"))
    return parquet(spark, d, "events").select("event_id", scalars.finite(v).alias("value"))


@query("ttl_lookup", """SELECT event_id, coalesce(event_id - (SELECT max(p.event_id) FROM events p WHERE p.user_id = e.user_id AND p.ts < e.ts AND p.ts >= e.ts - INTERVAL 30 MINUTE), -1) AS step FROM events e""")
def ttl_lookup(spark, d):
    """What a cache of 1800 seconds would have held: the user's last earlier event within the time."""
    w = Window.partitionBy("user_id").orderBy(F.unix_micros(F.col("ts").cast("timestamp"))).rangeBetween(-1_800_000_000, -1)
    return parquet(spark, d, "events").select("event_id", F.coalesce(F.col("event_id") - F.max("event_id").over(w), F.lit(-1)).alias("step"))


@query("log_dates", LOG + " SELECT min(date) AS first_day, max(date) AS last_day, count(*) AS n FROM log WHERE date BETWEEN '19960101' AND '19991231'")
def log_dates(spark, d):
    return betting_log(spark, d).where(F.col("date").between("19960101", "19991231")).agg(F.min("date").alias("first_day"), F.max("date").alias("last_day"), F.count("*").alias("n"))
