"""Scores to probabilities, blends, odds and expected value. Windows all partition by race, so one exchange serves them."""

from __future__ import annotations

from collections.abc import Callable
from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..dims import LANES
from ..functions.scalars import round_to
from ..sources.panel import at

# ranks are by values of so many digits, so that the last bit of a sum doesn't decide
DIGITS = 9
# fixed values: softmax temperatures by venue code
TEMPERATURES = {"15": 0.88, "02": 0.92, "16": 0.90, "12": 0.91}


def by_race() -> Window:
    return Window.partitionBy("race")


def linear_score(pick: Callable[[str, str], Column] = at) -> Column:
    """A fixed linear scorer over the three runners of an outcome; any trained scorer may stand in its place."""
    return (
        pick("a", "win_rate") * 0.05 + pick("b", "win_rate") * 0.03 + pick("c", "win_rate") * 0.02
        + pick("a", "place_rate") * 10.0 + pick("b", "place_rate") * 6.0 + pick("c", "place_rate") * 3.0
        - pick("a", "st") * 8.0 - pick("b", "st") * 4.0 - pick("c", "st") * 2.0
    )


def with_softmax_parts(races: DataFrame, score: Callable[[Callable[[str, str], Column]], Column], temperature: Column) -> DataFrame:
    """Races with _max and _sum, the largest score of their outcomes and the sum of exp((score - _max) / t), in one pass over the outcomes.

    On the race's row they cost no window: the 120 rows that follow need neither a sort nor a second look. The sum is carried
    on when a larger score comes up, so each outcome is scored once and nothing overflows.
    """
    # one text instead of a thousand calls to the JVM
    lanes = F.expr("array(" + ", ".join(f"named_struct('a', {a}, 'b', {b}, 'c', {c})" for a, b, c in permutations(LANES, 3)) + ")")

    def step(acc: Column, x: Column) -> Column:
        most = F.greatest(acc["m"], x)
        return F.struct(most.alias("m"), (acc["s"] * F.exp((acc["m"] - most) / temperature) + F.exp((x - most) / temperature)).alias("s"))

    scores = F.transform(lanes, lambda o: score(lambda lane, metric: F.element_at(F.col(metric), o[lane])))
    folded = F.reduce(scores, F.struct(F.lit(-1e300).alias("m"), F.lit(0.0).alias("s")), step)
    return races.withColumn("_fold", folded).select("*", F.col("_fold.m").alias("_max"), F.col("_fold.s").alias("_sum")).drop("_fold")


def softmax(df: DataFrame, score: str = "score", out: str = "prob", temperature: Column | float = 1.0) -> DataFrame:
    """exp((x - max) / t) over its sum in the race."""
    t = temperature if isinstance(temperature, Column) else F.lit(temperature)
    df = df.withColumn("_e", F.exp((F.col(score) - F.max(score).over(by_race())) / t))
    return df.withColumn(out, F.col("_e") / F.sum("_e").over(by_race())).drop("_e")


def venue_temperature() -> Column:
    out = F.lit(0.90)
    for code, t in TEMPERATURES.items():
        out = F.when(F.col("venue") == code, F.lit(t)).otherwise(out)
    return out


def normalize(df: DataFrame, value: str, out: str) -> DataFrame:
    """Value over its sum in the race; uniform where the sum isn't positive."""
    total = F.sum(value).over(by_race())
    return df.withColumn(out, F.when(total > 0, F.try_divide(F.col(value), total)).otherwise(1.0 / F.count("*").over(by_race())))


def minmax(value: Column, window: Window) -> Column:
    """Scaled to 0..1 in a window; 0 where all are equal."""
    low, high = F.min(value).over(window), F.max(value).over(window)
    return F.when(high > low, F.try_divide(value - low, high - low)).otherwise(0.0)


def synthetic_odds(race: str = "race") -> Column:
    """Odds as a fixed function of race and outcome, null for one race in eleven positions."""
    n = F.col(race) * 37 + (F.col("a") * 100 + F.col("b") * 10 + F.col("c")) * 17
    return F.when(n % 11 != 0, 5.0 + (n % 400) / 4.0)


def expected_value(df: DataFrame, least_odds: float = 1.0) -> DataFrame:
    """ev, edge and ev_rank (ties by class_id); null where the odds are missing or too low."""
    ok = F.col("odds").isNotNull() & (F.col("odds") >= least_odds)
    df = df.withColumn("ev", F.when(ok, F.col("prob") * F.col("odds"))).withColumn("edge", F.col("ev") - 1)
    rank = F.row_number().over(by_race().orderBy(round_to("ev", DIGITS).desc_nulls_last(), "class_id"))
    return df.withColumn("ev_rank", F.when(F.col("ev").isNotNull(), rank))


def prob_rank(df: DataFrame, out: str = "rank_prob") -> DataFrame:
    return df.withColumn(out, F.row_number().over(by_race().orderBy(F.desc(round_to("prob", DIGITS)), "class_id")))


def blend(df: DataFrame, base: str, other: str, ratio: float, out: str) -> DataFrame:
    """(1 - r) base + r other, renormalised in the race."""
    r = min(max(ratio, 0.0), 1.0)
    return normalize(df.withColumn("_b", F.col(base) * (1 - r) + F.col(other) * r), "_b", out).drop("_b")


def manual_probability(df: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Columns scaled to 0..1 in the race, falling ones (a start timing or exhibit token) reversed, weighted and soft-maxed."""
    total = F.lit(0.0)
    for column, w in weights.items():
        falling = any(token in ("st", "exhibit") for token in column.split("_"))
        scaled = minmax(-F.col(column) if falling else F.col(column), by_race())
        total = total + scaled * w
    return softmax(df.withColumn("manual_score", total), "manual_score", "manual_prob")


def ensemble(parts: list[tuple[DataFrame, float]]) -> DataFrame:
    """Weighted average of probability tables (race, class_id, prob), absent rows as 0, renormalised."""
    total = None
    for df, w in parts:
        part = df.select("race", "class_id", (F.col("prob") * w).alias("_p"))
        total = part if total is None else total.unionByName(part)
    return normalize(total.groupBy("race", "class_id").agg(F.sum("_p").alias("_p")), "_p", "prob").drop("_p")


def lane_bias(df: DataFrame, first: DataFrame, pair: DataFrame, first_power: float = 0.55, pair_power: float = 0.25) -> DataFrame:
    """Probabilities times powers of the venue's lane priors (1 where absent), renormalised. Priors are a few rows a venue."""
    df = df.join(F.broadcast(first), ["venue", "a"], "left").join(F.broadcast(pair), ["venue", "a", "b"], "left")
    raised = F.col("prob") * F.pow(F.coalesce("first_prior", F.lit(1.0)), F.lit(first_power)) * F.pow(F.coalesce("pair_prior", F.lit(1.0)), F.lit(pair_power))
    return normalize(df.withColumn("_p", raised), "_p", "adjusted").drop("_p")
