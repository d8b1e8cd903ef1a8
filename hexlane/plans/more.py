"""Statistics lines, fallback picks, raw scores, setting search, grades by alias, pre-race fill, worst hits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..dims import LANES, WEATHER_CURRENT, WEATHER_MODEL, WEATHER_TRAIN, WEATHER_TRIPLE, code_map
from ..functions.scalars import combo_lane, round_to
from ..operators import features, reports, serving
from ..sources import web_text
from ..sources.tables import parquet
from .base import COMBOS, RUNNERS, VALUED, betting_log, combos, query, ranked, rd, rounded, runners, valued

_STATS = "avg_st nat_win nat_2 nat_3 loc_win loc_2 loc_3 motor_no motor_2 motor_3 boat_no boat_2 boat_3".split()


@query("stats_lines", "SELECT s_suppkey, " + ", ".join(f"CASE WHEN s_suppkey % 9 = {i} THEN NULL ELSE CAST(s_suppkey % {30 + i} AS DOUBLE){'' if n.endswith('_no') else ' + 0.25'} END AS {n}" for i, n in enumerate(_STATS)) + " FROM supplier")
def stats_lines(spark, d):
    """Thirteen numbers of a runner's statistics line, '-' for none."""
    key = F.col("s_suppkey")
    parts = [F.when(key % 9 == i, "-").otherwise(F.concat((key % (30 + i)).cast("string"), F.lit("" if n.endswith("_no") else ".25"))) for i, n in enumerate(_STATS)]
    text = F.concat(F.lit("3 name x "), F.concat_ws("  ", *parts), F.lit(" end"))
    return parquet(spark, d, "supplier").select("s_suppkey", *web_text.statistics(text))


@query("fallback_pick", VALUED + """ , w AS (SELECT race, class_id, rank_prob, ev, coalesce(odds > 104 AND prob > 0.02, false) AS wanted FROM valued),
p AS (SELECT *, bool_or(wanted) OVER (PARTITION BY race) AS has, CAST(row_number() OVER (PARTITION BY race ORDER BY wanted DESC, round(ev, 9) DESC NULLS LAST, class_id) AS INTEGER) AS place FROM w)
SELECT race, class_id, CASE WHEN has THEN place ELSE rank_prob END AS rank, CAST(NOT has AS INTEGER) AS is_fallback FROM p WHERE (wanted AND place <= 5) OR (NOT has AND rank_prob <= 5)""")
def fallback_pick(spark, d):
    """The likeliest outcomes of races for which nothing is chosen."""
    return serving.with_fallback(ranked(spark, d), F.expr("odds > 104 and prob > 0.02"), [round_to("ev", 9).desc_nulls_last(), F.col("class_id")], 5)


_RAW = {"motor": 0.4, "boat": 0.1, "st": 1.5, "exhibit": 0.8, "course": 0.2}
_COLUMNS = {"first_motor": "motor[a]", "second_motor": "motor[b]", "first_boat": "boat[a]", "first_st": "st[a]", "second_st": "st[b]", "first_exhibit": "exhibit[a]", "first_course": "course[a]"}
_SIGNED = " + ".join(f"{e} * {-_RAW[n.split('_')[1]] if 'st' in n else _RAW[n.split('_')[1]] * (-1 if 'exhibit' in n else 1)}::DOUBLE" for n, e in _COLUMNS.items())


@query("raw_manual_score", COMBOS + f" SELECT race, class_id, {rd(_SIGNED, 'score')} FROM combos")
def raw_manual_score(spark, d):
    """Weighted sum of columns by their groups; a name with st or exhibit in it counts against (so does first_, as in the source)."""
    df = combos(spark, d)
    at = features.at
    table = df.select("race", "class_id", *[at("a" if n.startswith("first") else "b", n.split("_")[1]).cast("double").alias(n) for n in _COLUMNS])
    return rounded(serving.raw_score(table, {n: _RAW[n.split("_")[1]] for n in _COLUMNS}))


@query("grade_aliases", RUNNERS + " SELECT race, " + ", ".join(f"max(CASE WHEN lane = {i} THEN CASE racer_no % 5 WHEN 0 THEN 4 WHEN 1 THEN 3 WHEN 2 THEN 2 WHEN 3 THEN 1 ELSE 0 END END) AS lane{i}_grade_num" for i in LANES) + " FROM runners GROUP BY race")
def grade_aliases(spark, d):
    """Numbers of grades under whichever of six column names they come."""
    grade = F.element_at(F.array(*map(F.lit, ("A1", "A2", "B1", "B2", "?"))), (F.col("racer_no") % 5 + 1).cast("int"))
    names = ("lane1_grade", "lane2_class", "grade3", "class4", "grade_5", "class_6")
    wide = runners(spark, d).groupBy("race").agg(*[F.max(F.when(F.col("lane") == i, grade)).alias(names[i - 1]) for i in LANES])
    return serving.grade_numbers(wide).select("race", *[f"lane{i}_grade_num" for i in LANES])


@query("whitelisted", RUNNERS + " SELECT " + ", ".join(f"max(CASE WHEN lane = {i} THEN motor END) AS lane{i}_motor" for i in LANES) + ", CAST(race % 7 AS BIGINT) AS wave_cm FROM runners GROUP BY race")
def whitelisted(spark, d):
    """Columns of the allowed prefixes alone."""
    wide = runners(spark, d).groupBy("race").agg(*[F.max(F.when(F.col("lane") == i, F.col("motor"))).alias(f"lane{i}_motor") for i in LANES])
    return serving.whitelist(wide.withColumn("wave_cm", (F.col("race") % 7).cast("long")).withColumn("y_class", F.lit(1)).withColumn("other", F.lit(2)))


@query("odds_from_payout", VALUED + f" SELECT race, class_id, {rd('payout / 100.0', 'odds_back')} FROM valued WHERE is_hit = 1 AND payout IS NOT NULL")
def odds_from_payout(spark, d):
    """The winner's odds from what it paid."""
    return rounded(serving.odds_of_payout(valued(spark, d).where("is_hit = 1"), "payout").select("race", "class_id", "odds_back"))


@query("prerace_fill", RUNNERS + f""" , e AS (SELECT race, lane, CASE WHEN l.lane % 2 = 0 THEN NULL WHEN l.lane = 3 THEN 0.0 ELSE exhibit END AS exhibit, CASE WHEN lane = 5 THEN 0.0 ELSE st END AS st, course FROM runners l),
i AS (SELECT race, lane, exhibit + 1 AS exhibit, st + 1 AS st, course FROM runners WHERE motor >= 20)
SELECT e.race, e.lane, {rd('CASE WHEN coalesce(e.exhibit, 0) = 0 AND coalesce(i.exhibit, 0) <> 0 THEN i.exhibit ELSE coalesce(e.exhibit, 0) END', 'exhibit')},
  {rd('CASE WHEN coalesce(e.st, 0) = 0 AND coalesce(i.st, 0) <> 0 THEN i.st ELSE coalesce(e.st, 0) END', 'st')}, e.course FROM e LEFT JOIN i USING (race, lane)""")
def prerace_fill(spark, d):
    """Entries with exhibit, start timing and course of the pre-race page where they have none or 0."""
    r = runners(spark, d)
    entries = r.select("race", "lane", F.when(F.col("lane") % 2 == 0, None).when(F.col("lane") == 3, 0.0).otherwise(F.col("exhibit")).alias("exhibit"), F.when(F.col("lane") == 5, 0.0).otherwise(F.col("st")).alias("st"), "course")
    info = r.where("motor >= 20").select("race", "lane", (F.col("exhibit") + 1).alias("exhibit"), (F.col("st") + 1).alias("st"), "course")
    return rounded(serving.prerace_filled(entries, info))


@query("worst_hits", VALUED + f" SELECT race, class_id, {rd('prob', 'prob', 9)}, rank_prob FROM valued WHERE is_hit = 1 ORDER BY rank_prob DESC, race LIMIT 20")
def worst_hits(spark, d):
    """The twenty winners that were ranked lowest."""
    got = ranked(spark, d).where("is_hit = 1").select("race", "class_id", "prob", "rank_prob").orderBy(F.desc("rank_prob"), "race").limit(20)
    return rounded(got, 9)


@query("log_roi", VALUED + f""" , s AS (SELECT venue, race, sum(CASE WHEN rank_prob <= 5 THEN 100 ELSE 0 END) AS cost, sum(CASE WHEN rank_prob <= 5 AND is_hit = 1 THEN coalesce(payout, 0) ELSE 0 END) AS back FROM valued GROUP BY venue, race)
SELECT venue, CAST(sum(cost) AS BIGINT) AS cost, CAST(sum(back) AS BIGINT) AS back, CASE WHEN sum(back) / CAST(sum(cost) AS DOUBLE) >= 1.2 THEN 'high' WHEN sum(back) / CAST(sum(cost) AS DOUBLE) >= 1.0 THEN 'plus' ELSE 'minus' END AS roi_band FROM s GROUP BY venue""")
def log_roi(spark, d):
    """Return on stakes by venue in bands."""
    got = betting_log(spark, d).groupBy("venue").agg(F.sum("bet_cost_yen").alias("cost"), F.sum("return_yen").alias("back"))
    roi = reports.ratio(F.col("back"), F.col("cost"))
    return got.withColumn("roi_band", F.when(roi >= 1.2, "high").when(roi >= 1.0, "plus").otherwise("minus"))


SERVED = {f"lane{i}_{m}": e for i in LANES for m, e in {
    "boat": f"CASE WHEN race % 5 = 0 AND {i} = 2 THEN 0 ELSE boat[{i}] END", "course": f"CASE WHEN race % 3 = 0 THEN {i} ELSE course[{i}] END", "exhibit": f"CASE WHEN race % 4 = 0 THEN exhibit[{i}] + 1 ELSE exhibit[{i}] END",
    "motor": f"motor[{i}]", "racer_no": f"racers[{i}]", "st": f"CASE WHEN {i} = 6 THEN 0.0 ELSE st[{i}] END",
}.items()}


@query("serving_rows", COMBOS + f""" , r AS (SELECT race, list(racer_no ORDER BY lane) AS racers FROM runners GROUP BY race), s AS (SELECT combos.*, racers FROM combos JOIN r USING (race) WHERE race % 11 <> 0),
x AS (SELECT class_id, a AS combo_first_lane, b AS combo_second_lane, c AS combo_third_lane, race % 12 + 1 AS race_no, CASE WHEN race % 2 = 0 THEN 0.0 ELSE (race % 9) / 2.0::DOUBLE END AS wind_speed_mps, {', '.join(f'{e} AS {n}' for n, e in SERVED.items())} FROM s)
SELECT class_id, count(*) AS races, {', '.join(rd(f'avg({n})', n) for n in ('combo_first_lane', 'combo_second_lane', 'combo_third_lane', 'race_no', 'wind_speed_mps', *SERVED))} FROM x GROUP BY class_id""")
def serving_rows(spark, d):
    """Scorer inputs of all races from entries under other names, filled from pre-race rows; as means by outcome."""
    r = runners(spark, d).withColumn("pos", F.col("lane"))
    text = lambda c: F.col(c).cast("string")
    race, lane = F.col("race"), F.col("lane")
    entries = r.where((race % 11 != 0) | (lane != 4)).select(
        "race", "pos", text("lane").alias("艇番"), text("racer_no").alias("登番"), text("motor").alias("motor_no"), F.when((race % 5 == 0) & (lane == 2), "").otherwise(text("boat")).alias("boat"),
        F.when(race % 4 == 0, " ").otherwise(text("exhibit")).alias("展示タイム"), F.when(lane == 6, "-").otherwise(text("st")).alias("平均ST"), F.when(race % 3 == 0, None).otherwise(text("course")).alias("course"),
    )
    entries = entries.unionByName(entries.withColumn("pos", F.col("pos") + 100).withColumn("motor_no", F.lit("1")))
    before = r.select("race", "lane", (F.col("exhibit") + 1).alias("exhibit"), F.lit(None).cast("double").alias("st"), F.lit(None).cast("int").alias("course"))
    conditions = r.groupBy("race").agg(F.min("date").alias("date"), F.min("venue").alias("venue")).select(
        "race", "date", "venue", F.col("venue").alias("venue_code"), (race % 12 + 1).alias("race_no"), F.lit(None).cast("string").alias("weather"), F.lit("北").alias("wind_dir"),
        F.when(race % 2 == 0, None).otherwise((race % 9) / 2.0).alias("wind_speed_mps"), F.lit(1.0).alias("wave_cm"),
    )
    rows = serving.serving_rows(entries, before, conditions)
    names = ("combo_first_lane", "combo_second_lane", "combo_third_lane", "race_no", "wind_speed_mps", *SERVED)
    return rounded(rows.groupBy("class_id").agg(F.count("*").alias("races"), *[F.avg(n).alias(n) for n in names]))


@query("lane_stats_fill", RUNNERS + f""" , e AS (SELECT race, lane, CASE WHEN lane % 2 = 0 THEN NULL ELSE motor END AS motor, CASE WHEN lane = 3 THEN 0 ELSE boat END AS boat, win_rate, place_rate FROM runners),
t AS (SELECT race, lane, motor + 1 AS motor, boat + 1 AS boat, win_rate + 1 AS win_rate, CASE WHEN lane = 5 THEN NULL ELSE place_rate + 1 END AS place_rate FROM runners WHERE finish <= 4)
SELECT e.race, e.lane, CASE WHEN coalesce(e.motor, 0) = 0 THEN coalesce(t.motor, e.motor) ELSE e.motor END AS motor, CASE WHEN coalesce(e.boat, 0) = 0 THEN coalesce(t.boat, e.boat) ELSE e.boat END AS boat,
  {rd('CASE WHEN t.race IS NULL THEN e.win_rate ELSE t.win_rate END', 'win_rate')}, {rd('CASE WHEN t.race IS NULL THEN e.place_rate ELSE t.place_rate END', 'place_rate')} FROM e LEFT JOIN t USING (race, lane)""")
def lane_stats_fill(spark, d):
    """Entries joined with the statistics of their lane: motor and boat filled, rates overwritten where the lane has any."""
    r = runners(spark, d)
    entries = r.select("race", "lane", F.when(F.col("lane") % 2 == 0, None).otherwise(F.col("motor")).alias("motor"), F.when(F.col("lane") == 3, 0).otherwise(F.col("boat")).alias("boat"), "win_rate", "place_rate")
    stats = r.where("finish <= 4").select("race", "lane", *[(F.col(c) + 1).alias(c) for c in ("motor", "boat", "win_rate")], F.when(F.col("lane") == 5, None).otherwise(F.col("place_rate") + 1).alias("place_rate"))
    return rounded(serving.lane_stats_filled(entries, stats))


@query("first_races", RUNNERS + " SELECT race, lane, motor FROM runners WHERE race IN (SELECT DISTINCT race FROM runners ORDER BY race LIMIT 300)")
def first_races(spark, d):
    """All rows of the first 300 races."""
    return serving.first_races(runners(spark, d), 300).select("race", "lane", "motor")


@query("first_rows", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice FROM lineitem ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice LIMIT 1000")
def first_rows(spark, d):
    """The first thousand lines in order."""
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    return serving.first_rows(parquet(spark, d, "lineitem").select(*order), order, 1000)


_KINDS = {"train": WEATHER_TRAIN, "model": WEATHER_MODEL, "current": WEATHER_CURRENT, "triple": WEATHER_TRIPLE}
_SEEN = ("晴", "晴れ", "曇", "曇り", "くもり", "雨", "雪", "霧", "")
_WORDS = {n: " ".join(f"WHEN '{k}' THEN {v}" for k, v in m.items()) for n, m in _KINDS.items()}


@query("weather_dialects", f"WITH w AS (SELECT event_id, ({list(_SEEN)})[event_id % {len(_SEEN)} + 1] AS w FROM events) SELECT event_id, " + ", ".join(f"CASE w {m} ELSE 0 END AS {n}" for n, m in _WORDS.items()) + " FROM w")
def weather_dialects(spark, d):
    """Codes of a weather word in each of the four builders."""
    word = F.element_at(F.array(*map(F.lit, _SEEN)), (F.col("event_id") % len(_SEEN) + 1).cast("int"))
    return parquet(spark, d, "events").select("event_id", *[code_map(m, word, 0).alias(n) for n, m in _KINDS.items()])


@query("combo_lanes", """WITH t AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE l_partkey % 4 WHEN 0 THEN 'bad' WHEN 1 THEN l_linenumber || '-x-' || l_suppkey % 6 ELSE l_linenumber || '-' || l_partkey % 6 || '-' || l_suppkey % 6 END AS combo FROM lineitem)
SELECT DISTINCT combo, CASE WHEN len(p) = 3 THEN coalesce(TRY_CAST(p[1] AS INTEGER), 0) ELSE 0 END AS first, CASE WHEN len(p) = 3 THEN coalesce(TRY_CAST(p[2] AS INTEGER), 0) ELSE 0 END AS second, CASE WHEN len(p) = 3 THEN coalesce(TRY_CAST(p[3] AS INTEGER), 0) ELSE 0 END AS third FROM (SELECT combo, string_split(combo, '-') AS p FROM t)""")
def combo_lanes(spark, d):
    """The three lanes of a combo, 0 where they can't be read."""
    line, part, supp = F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")
    text = lambda c: c.cast("string")
    combo = F.when(part % 4 == 0, "bad").when(part % 4 == 1, F.concat(text(line), F.lit("-x-"), text(supp % 6))).otherwise(F.concat_ws("-", text(line), text(part % 6), text(supp % 6)))
    t = parquet(spark, d, "lineitem").select(combo.alias("combo")).distinct()
    return t.select("combo", *[combo_lane(F.col("combo"), i).alias(n) for i, n in enumerate(("first", "second", "third"))])
