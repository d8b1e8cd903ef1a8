"""Bet selection: venue settings, step functions, buy score, number of points, selection with backfill, race signal."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import round_to
from .scoring import by_race, minmax

# fixed values: venue, min_prob, odds_cap, ev_cap, w_prob, w_ev, w_odds, prob_exp, ev_exp, base_bonus, min_points, max_points
BASE = [
    ("15", 0.018, 55.0, 2.2, 0.68, 0.22, 0.10, 1.45, 0.70, 0.66, 1, 12),
    ("16", 0.015, 80.0, 2.8, 0.58, 0.28, 0.14, 1.28, 0.82, 0.64, 1, 12),
    ("02", 0.014, 90.0, 3.0, 0.56, 0.29, 0.15, 1.24, 0.86, 0.63, 1, 12),
    ("default", 0.015, 80.0, 2.5, 0.62, 0.26, 0.12, 1.35, 0.75, 0.65, 1, 12),
]
TUNED = [
    ("15", 0.0164, 42.4, 2.4, 0.599, 0.27, 0.131, 1.358, 0.68, 0.704, 5, 7),
    ("02", 0.0213, 71.1, 2.92, 0.494, 0.233, 0.273, 1.091, 0.707, 0.638, 4, 8),
    ("16", 0.0135, 73.7, 3.08, 0.597, 0.261, 0.142, 1.11, 0.83, 0.641, 5, 10),
    ("12", 0.02, 68.0, 2.8, 0.52, 0.24, 0.24, 1.08, 0.72, 0.65, 4, 8),
]
FIELDS = ("min_prob", "odds_cap", "ev_cap", "w_prob", "w_ev", "w_odds", "prob_exp", "ev_exp", "base_bonus", "min_points", "max_points")
SCHEMA = "venue string, " + ", ".join(f"{f} {'int' if 'points' in f else 'double'}" for f in FIELDS)
# fixed values: upper bounds and factors of the odds steps by venue
HIGH = {
    "15": ((15, 1.00), (30, 0.95), (50, 0.86), (80, 0.70), (120, 0.54), (None, 0.38)),
    "16": ((20, 1.00), (40, 0.97), (70, 0.90), (120, 0.78), (200, 0.63), (None, 0.48)),
    "02": ((20, 1.00), (45, 0.98), (80, 0.91), (130, 0.80), (220, 0.66), (None, 0.50)),
    "default": ((20, 1.00), (40, 0.96), (80, 0.88), (120, 0.76), (200, 0.62), (None, 0.45)),
}
LOW = {"15": (0.75, 0.86, 0.94), "16": (0.82, 0.90, 0.96), "02": (0.86, 0.93, 0.97), "default": (0.78, 0.88, 0.95)}
ZONE = {
    "15": (8, (14, 1.08), (24, 1.10), (35, 1.04)),
    "16": (10, (18, 1.07), (35, 1.12), (60, 1.08)),
    "02": (10, (20, 1.05), (45, 1.12), (70, 1.10)),
    "default": (8, (15, 1.08), (30, 1.12), (50, 1.06)),
}
# fixed values: factor of the number of points by venue
POINT_FACTOR = {"15": 0.82, "02": 1.08}
# orders are by values of so many digits, so that the last bit of a sum doesn't decide
DIGITS = 9


def settings(spark: SparkSession, overlay: list[tuple] | None = TUNED, fixed_points: int | None = None) -> DataFrame:
    """One row a venue: the overlay where it has a value, else the venue's base, else the default; points in 3..12."""
    base = spark.createDataFrame(BASE, SCHEMA)
    over = spark.createDataFrame(overlay or [], SCHEMA)
    keys = base.select("venue").union(over.select("venue")).distinct()
    fallback = base.where("venue = 'default'").select(*[F.col(f).alias(f"d_{f}") for f in FIELDS])
    out = keys.join(base.select("venue", *[F.col(f).alias(f"b_{f}") for f in FIELDS]), "venue", "left")
    out = out.join(over.select("venue", *[F.col(f).alias(f"o_{f}") for f in FIELDS]), "venue", "left").crossJoin(F.broadcast(fallback))
    out = out.select("venue", *[F.coalesce(f"o_{f}", f"b_{f}", f"d_{f}").alias(f) for f in FIELDS])
    low = F.lit(fixed_points) if fixed_points else F.col("min_points")
    high = F.lit(fixed_points) if fixed_points else F.col("max_points")
    low = F.least(F.greatest(low, F.lit(3)), F.lit(12))
    return out.withColumn("max_points", F.greatest(F.least(F.greatest(high, F.lit(3)), F.lit(12)), low)).withColumn("min_points", low)


def with_settings(df: DataFrame, conf: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """Add the settings of each row's venue, or the default's; conf is a few rows."""
    own = conf.select("venue", *[F.col(f).alias(f"own_{f}") for f in fields])
    other = conf.where("venue = 'default'").select(*[F.col(f).alias(f"any_{f}") for f in fields])
    df = df.join(F.broadcast(own), "venue", "left").crossJoin(F.broadcast(other))
    return df.select(*[c for c in df.columns if not c.startswith(("own_", "any_"))], *[F.coalesce(f"own_{f}", f"any_{f}").alias(f) for f in fields])


def _by_venue(build) -> Column:
    out = None
    for venue in ("15", "16", "02"):
        out = F.when(F.col("venue") == venue, build(venue)) if out is None else out.when(F.col("venue") == venue, build(venue))
    return out.otherwise(build("default"))


def high_penalty(odds: Column) -> Column:
    def steps(venue: str) -> Column:
        out = F.when(odds <= 0, 0.0)
        for bound, factor in HIGH[venue]:
            out = out.otherwise(factor) if bound is None else out.when(odds <= bound, factor)
        return out

    return _by_venue(steps)


def low_penalty(odds: Column) -> Column:
    def steps(venue: str) -> Column:
        out = F.when(odds <= 0, 0.0)
        for bound, factor in zip((4, 6, 8), LOW[venue], strict=True):
            out = out.when(odds < bound, factor)
        return out.otherwise(1.0)

    return _by_venue(steps)


def zone_bonus(odds: Column) -> Column:
    def steps(venue: str) -> Column:
        start, *bands = ZONE[venue]
        out = F.when(odds <= 0, 0.0).when(odds < start, 1.0)
        for bound, factor in bands:
            out = out.when(odds <= bound, factor)
        return out.otherwise(1.0)

    return _by_venue(steps)


def buy_score(df: DataFrame) -> DataFrame:
    """Add is_candidate, and for candidates pn, en, on and buy_score: powers of the in-race scales, a weighted bonus, the odds steps.

    Candidates have positive odds and value and at least the venue's probability; where a race has none such, all its
    priced outcomes are.
    """
    w = by_race()
    priced = F.coalesce((F.col("odds") > 0) & (F.col("ev") > 0), F.lit(False))
    likely = priced & (F.col("prob") >= F.col("min_prob"))
    df = df.withColumn("is_candidate", priced & (likely | (F.max(likely.cast("int")).over(w) == 0)))
    own = lambda x: F.when(F.col("is_candidate"), x)
    for name, value in (("pn", F.col("prob")), ("en", F.least("ev", "ev_cap")), ("on", F.least("odds", "odds_cap"))):
        df = df.withColumn(name, own(minmax(own(value), w)))
    power = F.pow(F.greatest("pn", F.lit(1e-9)), "prob_exp") * F.pow(F.greatest("en", F.lit(1e-9)), "ev_exp")
    mix = F.col("base_bonus") + F.col("w_prob") * F.col("pn") + F.col("w_ev") * F.col("en") + F.col("w_odds") * F.col("on")
    odds = F.col("odds")
    return df.withColumn("buy_score", own(power * mix * zone_bonus(odds) * high_penalty(odds) * low_penalty(odds)))


def point_factor() -> Column:
    factor = F.lit(1.0)
    for venue, f in POINT_FACTOR.items():
        factor = F.when(F.col("venue") == venue, f).otherwise(factor)
    return factor


def dynamic_points(df: DataFrame) -> DataFrame:
    """Add entropy and points to all rows of a race: how many bets it deserves, by shortfalls of its leading candidates.

    All of it are windows over the race, so it needs no exchange of its own. entropy is that of the ten leading
    probabilities, as a share of what it could be.
    """
    w, p = by_race(), F.col("prob")
    df = df.withColumn("_k", F.row_number().over(w.orderBy(F.desc("is_candidate"), F.desc(round_to("prob", DIGITS)), "class_id")))
    top = lambda n: F.coalesce(F.sum(F.when(F.col("is_candidate") & (F.col("_k") <= n), p)).over(w), F.lit(0.0))
    df = df.withColumn("_s1", top(1)).withColumn("_s2", top(2)).withColumn("_s3", top(3)).withColumn("_s5", top(5)).withColumn("_s10", top(10))
    leading = F.col("is_candidate") & (F.col("_k") <= 10)
    q = F.try_divide(p, F.col("_s10"))
    df = df.withColumn("_h", F.sum(F.when(leading, -q * F.ln(q + 1e-12))).over(w)).withColumn("_n", F.sum(leading.cast("int")).over(w))
    ratio = F.when((F.col("_n") == 0) | (F.col("_s10") <= 0), 1.0).when(F.col("_n") == 1, 0.0).otherwise(F.try_divide(F.col("_h"), F.ln(F.col("_n") + F.lit(1e-12))))
    df = df.withColumn("entropy", F.least(F.greatest(ratio, F.lit(0.0)), F.lit(1.0)))

    def short(limit: float, have: Column, weight: float) -> Column:
        return (limit - F.least(have, F.lit(limit))) / limit * weight

    factor = point_factor()
    t1, lo, hi = F.col("_s1"), F.col("min_points"), F.col("max_points")
    gap = F.greatest(F.lit(0.0), t1 - (F.col("_s2") - t1))
    need = short(0.12, t1, 0.42) + short(0.24, F.col("_s3"), 0.22) + short(0.36, F.col("_s5"), 0.14) + short(0.03, gap, 0.08) + F.col("entropy") * 0.28
    need = F.least(F.greatest(need * factor, F.lit(0.0)), F.lit(1.0))
    n = (lo + F.bround((hi - lo) * need, 0)).cast("int")
    n = F.when((t1 >= 0.10) & (F.col("_s3") >= 0.23), F.least(n, F.lit(3))).when((t1 >= 0.08) & (F.col("_s5") >= 0.34), F.least(n, F.greatest(F.lit(4), lo))).otherwise(n)
    df = df.withColumn("_p", n)
    n = F.when((F.col("entropy") >= 0.88) & (t1 <= 0.05), F.least(hi, F.col("_p") + 1)).otherwise(F.col("_p"))
    return df.withColumn("points", F.least(F.greatest(n, F.lit(3)), F.lit(12))).drop("_k", "_s1", "_s2", "_s3", "_s5", "_s10", "_h", "_n", "_p")


def leading(df: DataFrame, most: int = 12) -> DataFrame:
    """The rows of each race that a selection of `most` bets can come to: its candidates, and as many again as may be filled up.

    Bets are candidates or, in order of probability, priced outcomes that aren't picked; so twice `most` of these suffice.
    """
    w = by_race()
    odds = F.coalesce(F.col("odds") > 0, F.lit(False))
    priced = odds & F.coalesce(F.col("ev") > 0, F.lit(False))
    likely = priced & (F.col("prob") >= F.col("min_prob"))
    df = df.withColumn("_place", F.row_number().over(w.orderBy(F.desc(odds), F.desc(round_to("prob", DIGITS)), "class_id"))).withColumn("_any", F.max(likely).over(w))
    return df.where((odds & (F.col("_place") <= 2 * most)) | likely | (priced & ~F.col("_any"))).drop("_place", "_any")


def best_bets(df: DataFrame, conf: DataFrame, top_n: int = 12) -> DataFrame:
    """Chosen outcomes of each race with their rank.

    Candidates go in order of buy score; a race short of its points is filled up by probability from its other priced
    outcomes, whose score is their probability, and all are sorted once more (so a filled row may lead).
    """
    w = by_race()
    df = leading(with_settings(df.where("combo <> ''"), conf, ("min_prob",))).drop("min_prob")
    df = dynamic_points(buy_score(with_settings(df, conf)))
    n = F.greatest(F.lit(3), F.least(F.lit(12), F.lit(top_n), F.col("points")))
    order = (*[F.desc(round_to(c, DIGITS)) for c in ("buy_score", "prob", "ev")], "class_id")
    df = df.withColumn("_r", F.row_number().over(w.orderBy(F.desc("is_candidate"), *order)))
    df = df.withColumn("_picked", F.col("is_candidate") & (F.col("_r") <= n)).withColumn("_have", F.sum(F.col("_picked").cast("int")).over(w))
    spare = ~F.col("_picked") & F.coalesce(F.col("odds") > 0, F.lit(False)) & (F.col("_have") > 0)
    df = df.withColumn("_spare", spare).withColumn("_f", F.row_number().over(w.orderBy(F.desc("_spare"), F.desc(round_to("prob", DIGITS)), "class_id")))
    fill = F.col("_spare") & (F.col("_f") <= n - F.col("_have"))
    df = df.withColumn("is_backfill", fill.cast("int")).where(F.col("_picked") | (F.col("is_backfill") == 1))
    df = df.withColumn("buy_score", F.when(F.col("is_backfill") == 1, F.col("prob")).otherwise(F.col("buy_score")))
    return df.select("race", "venue", "class_id", "combo", "prob", "odds", "ev", "buy_score", "is_backfill").withColumn("rank", F.row_number().over(w.orderBy(*order)))


def race_signal(df: DataFrame, bets: DataFrame) -> DataFrame:
    """race, t1, gap, top_ev, n_bets, score, signal (A to D)."""
    tops = df.groupBy("race").agg(F.slice(F.reverse(F.array_sort(F.collect_list("prob"))), 1, 2).alias("p"))
    chosen = bets.groupBy("race").agg(F.count("*").alias("n_bets"), F.max(F.coalesce("ev", F.lit(0.0))).alias("top_ev"))
    out = tops.join(chosen, "race", "left").select(
        "race", F.get("p", F.lit(0)).alias("t1"), (F.get("p", F.lit(0)) - F.coalesce(F.get("p", F.lit(1)), F.lit(0.0))).alias("gap"),
        F.coalesce("top_ev", F.lit(0.0)).alias("top_ev"), F.coalesce("n_bets", F.lit(0)).alias("n_bets"),
    )
    score = 0.42 * 100 * F.col("t1") + 0.33 * 100 * F.col("gap") + 0.17 * 10 * F.least("top_ev", F.lit(2.0)) + 0.18 * F.greatest(F.lit(0), 7 - F.col("n_bets"))
    signal = F.when((F.col("t1") >= 0.11) & (F.col("gap") >= 0.020) & (F.col("top_ev") >= 0.85), "A").when((F.col("t1") >= 0.08) & (F.col("gap") >= 0.012) & (F.col("top_ev") >= 0.65), "B").when((F.col("t1") >= 0.055) & (F.col("top_ev") >= 0.50), "C").otherwise("D")
    return out.withColumn("score", score).withColumn("signal", signal)


# fixed values: weights of a setting's score
SCORE = {"roi": 0.62, "hit_rate": 0.18, "top3": 0.10, "top5": 0.10}
PENALTY_FROM, PENALTY = 10, 0.01


def drawn_settings(trials: int, seed: int = 7, spread: float = 0.15) -> list[list[tuple]]:
    """Overlays of settings: the tuned ones first, then each number of theirs drawn within a share of itself, weights summing to 1."""
    rng, out = random.Random(seed), [TUNED]
    for _ in range(1, trials):
        rows = []
        for venue, *numbers in TUNED:
            drawn = [round(x * rng.uniform(1 - spread, 1 + spread), 4) for x in numbers[:9]]
            total = sum(drawn[3:6])
            drawn[3:6] = [round(x / total, 4) for x in drawn[3:6]]
            low = rng.randint(3, numbers[9] + 1)
            rows.append((venue, *drawn, low, rng.randint(low, low + 6)))
        out.append(rows)
    return out


def setting_score(df: DataFrame, bets: DataFrame) -> DataFrame:
    """Races with bets, hits, points, return on stakes, hits among the first 1, 3 and 5 bets, and their weighted score."""
    hits = df.where("is_hit = 1").select("race", "class_id", "payout")
    races = bets.join(hits.withColumn("hit", F.lit(1)), ["race", "class_id"], "left").groupBy("race").agg(
        F.count("*").alias("n"), F.sum(F.coalesce("hit", F.lit(0))).alias("hit"), F.sum(F.when(F.col("hit") == 1, F.coalesce("payout", F.lit(0))).otherwise(0)).alias("back"), F.min(F.when(F.col("hit") == 1, F.col("rank"))).alias("at")
    )
    share = lambda c: F.coalesce(F.avg(F.coalesce(c, F.lit(False)).cast("double")), F.lit(0.0))
    out = races.agg(
        F.count("*").alias("races"), F.coalesce(F.sum("hit"), F.lit(0)).alias("hits"), share(F.col("hit") > 0).alias("hit_rate"), F.coalesce(F.avg("n"), F.lit(0.0)).alias("avg_points"),
        F.coalesce(F.try_divide(F.sum("back").cast("double"), F.sum("n") * 100.0), F.lit(0.0)).alias("roi"), *[share(F.col("at") <= k).alias(f"top{k}") for k in (1, 3, 5)],
    )
    return with_score(out)


def with_score(out: DataFrame) -> DataFrame:
    score = sum((F.col(c) * w for c, w in SCORE.items()), F.lit(0.0)) - F.greatest(F.col("avg_points") - PENALTY_FROM, F.lit(0.0)) * PENALTY
    return out.withColumn("score", score)
