"""What serving needs around the scorers: fallback picks, raw scores, grades by alias, column whitelists, pre-race fill."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..dims import GRADES, LANES, code_map, outcomes
from .scoring import by_race

# fixed values: prefixes of the columns that a venue's trainer takes, and the names it never does
PREFIXES = ("lane1_", "lane2_", "lane3_", "lane4_", "lane5_", "lane6_", "race_", "inside_", "outside_", "inside_outside_", "combo_", "weather_", "wind_", "wave_")
EXCLUDED = frozenset(("date", "venue", "race_key", "race_no", "combo", "y_combo", "y_class"))


def with_fallback(df: DataFrame, wanted: Column, order: list[Column], top_n: int) -> DataFrame:
    """race, class_id, rank, is_fallback: of each race the first top_n wanted outcomes in an order; without any, the first top_n by rank_prob."""
    w = by_race()
    df = df.withColumn("_wanted", F.coalesce(wanted, F.lit(False)))
    df = df.withColumn("_some", F.max("_wanted").over(w)).withColumn("_place", F.row_number().over(w.orderBy(F.desc("_wanted"), *order)))
    own, spare = F.col("_wanted") & (F.col("_place") <= top_n), ~F.col("_some") & (F.col("rank_prob") <= top_n)
    return df.where(own | spare).select("race", "class_id", F.when(F.col("_some"), F.col("_place")).otherwise(F.col("rank_prob")).alias("rank"), (~F.col("_some")).cast("int").alias("is_fallback"))


def raw_score(table: DataFrame, weights: dict[str, float]) -> DataFrame:
    """race, class_id, score: weighted sum of columns (missing as 0), negative where the name holds st or exhibit."""
    total = F.lit(0.0)
    for name, w in weights.items():
        total = total + F.coalesce(F.col(name), F.lit(0.0)) * (-w if "st" in name or "exhibit" in name else w)
    return table.select("race", "class_id", total.alias("score"))


def grade_numbers(wide: DataFrame) -> DataFrame:
    """Add lane<i>_grade_num from the first column present of the names a grade comes under; unknown grades are 0."""
    cols = []
    for i in LANES:
        found = next((n for n in (f"lane{i}_grade", f"lane{i}_class", f"grade{i}", f"class{i}", f"grade_{i}", f"class_{i}") if n in wide.columns), None)
        if found:
            cols.append(F.coalesce(code_map(GRADES, F.col(found)), F.lit(0)).alias(f"lane{i}_grade_num"))
    return wide.select("*", *cols)


def whitelist(df: DataFrame) -> DataFrame:
    return df.select(*[c for c in df.columns if c.startswith(PREFIXES) and c not in EXCLUDED])


def odds_of_payout(df: DataFrame, payout: str) -> DataFrame:
    """Add odds_back, the payout for one hundred as a multiple; rows without a payout go."""
    return df.where(F.col(payout).isNotNull()).withColumn("odds_back", F.col(payout) / 100.0)


def prerace_filled(entries: DataFrame, info: DataFrame, columns: tuple[str, ...] = ("exhibit", "st", "course")) -> DataFrame:
    """Entries (race, lane) with the columns of the pre-race page where their own are missing or 0."""
    page = info.select("race", "lane", *[F.col(c).alias(f"_{c}") for c in columns])
    joined = entries.join(page, ["race", "lane"], "left")
    empty = lambda c: F.coalesce(F.col(c) == 0, F.lit(True))
    filled = {c: F.coalesce(F.when(empty(c) & ~empty(f"_{c}"), F.col(f"_{c}")).otherwise(F.col(c)), F.lit(0)) for c in columns}
    return joined.select(*[filled[c].cast(entries.schema[c].dataType).alias(c) if c in filled else c for c in entries.columns])


# fixed values: names under which an entry's columns come, in order of preference
ENTRY_NAMES = {
    "lane": ("lane", "艇番", "枠"), "racer_no": ("racer_no", "register_no", "登番", "登録番号"), "motor": ("motor", "motor_no", "モーター", "モーター番号"), "boat": ("boat", "boat_no", "ボート", "ボート番号"),
    "exhibit": ("exhibit", "tenji_time", "展示タイム"), "st": ("st", "avg_st", "ST", "平均ST", "start_timing"), "course": ("course", "進入", "course_no"),
}
TIMES = ("exhibit", "st")


def picked(df: DataFrame, names: tuple[str, ...]) -> Column:
    """The first of the columns, in order, whose text isn't empty; null where there is none."""
    found = [F.nullif(F.trim(F.col(f"`{n}`").cast("string")), F.lit("")) for n in names if n in df.columns]
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def serving_rows(entries: DataFrame, before: DataFrame, conditions: DataFrame) -> DataFrame:
    """The rows that a scorer is given: 120 a race, with race_key, date, venue, venue_code, race_no, combo and its three lanes, the
    conditions, and boat, course, exhibit, motor, racer_no and st of all six lanes.

    entries (race and a column under any of ENTRY_NAMES) are one row a lane, the first by pos if a lane is there twice; what they lack
    is filled from before (race, lane, exhibit, st, course), a course that neither has is the lane, other numbers 0. conditions has
    race, date, venue, venue_code, race_no, weather, wind_dir, wind_speed_mps, wave_cm. Races without six lanes give no rows.
    """
    text = {n: picked(entries, names) for n, names in ENTRY_NAMES.items()}
    kind = lambda n: "double" if n in TIMES else "int"
    own = entries.select("race", "pos", *[(c.try_cast("double").cast("int") if kind(n) == "int" else c.try_cast("double")).alias(n) for n, c in text.items()]).where("lane between 1 and 6")
    first = own.groupBy("race", "lane").agg(F.min_by(F.struct("racer_no", "motor", "boat", "exhibit", "st", "course"), "pos").alias("e")).select("race", "lane", "e.*")
    page = before.select("race", "lane", *[F.col(c).alias(f"_{c}") for c in ("exhibit", "st", "course")])
    rows = first.join(page, ["race", "lane"], "left").select(
        "race", "lane", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("racer_no", "motor", "boat")], *[F.coalesce(c, f"_{c}", F.lit(0.0)).alias(c) for c in TIMES], F.coalesce("course", "_course", "lane").cast("int").alias("course")
    )
    fields = ("boat", "course", "exhibit", "motor", "racer_no", "st")
    wide = rows.groupBy("race").agg(F.count("*").alias("_n"), *[F.max(F.when(F.col("lane") == i, F.col(c))).alias(f"lane{i}_{c}") for i in LANES for c in fields]).where("_n = 6").drop("_n")
    head = conditions.select(
        "race", F.concat_ws("_", "venue", "date", F.col("race_no").cast("string")).alias("race_key"), "date", "venue", "venue_code", "race_no",
        *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("wave_cm", "wind_speed_mps")], *[F.coalesce(c, F.lit("")).alias(c) for c in ("weather", "wind_dir")],
    )
    dims = outcomes(entries.sparkSession).select("class_id", "combo", F.col("a").alias("combo_first_lane"), F.col("b").alias("combo_second_lane"), F.col("c").alias("combo_third_lane"))
    return head.join(wide, "race").crossJoin(F.broadcast(dims))


def lane_stats_filled(entries: DataFrame, stats: DataFrame, numbers: tuple[str, ...] = ("motor", "boat"), rates: tuple[str, ...] = ("win_rate", "place_rate")) -> DataFrame:
    """Entries (race, lane) with the statistics of their lane: numbers where their own are missing or 0, rates always, if there is such a lane."""
    page = stats.select("race", "lane", F.lit(True).alias("_found"), *[F.col(c).alias(f"_{c}") for c in (*numbers, *rates)])
    joined = entries.join(page, ["race", "lane"], "left")
    put = {c: F.when(F.coalesce(F.col(c) == 0, F.lit(True)), F.coalesce(f"_{c}", c)).otherwise(F.col(c)) for c in numbers}
    put |= {c: F.when(F.col("_found"), F.col(f"_{c}")).otherwise(F.col(c)) for c in rates}
    return joined.select(*[put[c].alias(c) if c in put else c for c in entries.columns])


def first_rows(df: DataFrame, order: list[str], rows: int) -> DataFrame:
    """The first rows in an order; each task keeps so many at most, so nothing is sorted whole."""
    return df.orderBy(*order).limit(rows)


def first_races(df: DataFrame, races: int) -> DataFrame:
    """All rows of the first races by number: only the numbers are sorted, so many at most in a task."""
    few = df.select("race").distinct().orderBy("race").limit(races)
    last = few.agg(F.max("race").alias("_last"))
    return df.join(F.broadcast(last), F.col("race") <= F.col("_last"), "left_semi")  # one row
