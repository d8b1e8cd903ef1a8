"""Reports: hit rates, bias, value bands, venue statistics, returns, priors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..dims import LANES
from .scoring import by_race


def ratio(a: Column, b: Column) -> Column:
    """a / b as double, 0 where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def venue_stats(log: DataFrame, venues: list[str]) -> DataFrame:
    """Selected bets by venue: races, bets, hits, rates (hits per bet), stake, return, profit, roi; zero rows for venues without."""
    spark = log.sparkSession
    races = log.where("is_selected = 1").groupBy("venue", "date", "race_no").agg(F.count("*").alias("buy_count"), F.sum("is_hit").alias("hit_count"), F.sum("bet_cost_yen").alias("total_bet"), F.sum("return_yen").alias("total_return"))
    got = races.groupBy("venue").agg(F.count("*").alias("race_count"), *[F.sum(c).alias(c) for c in ("buy_count", "hit_count", "total_bet", "total_return")])
    out = spark.createDataFrame([(v,) for v in venues], "venue string").join(got, "venue", "left").na.fill(0)
    return out.select(
        "venue", "race_count", "buy_count", "hit_count", ratio(F.col("hit_count"), F.col("buy_count")).alias("hit_rate"), ratio(F.col("buy_count"), F.col("race_count")).alias("avg_points"),
        "total_bet", "total_return", (F.col("total_return") - F.col("total_bet")).alias("profit"), ratio(F.col("total_return"), F.col("total_bet")).alias("roi"),
    )


def ev_band(ev: Column) -> Column:
    out = F.when(ev >= 3.0, "EV>=3.0")
    for low, high in ((2.0, 3.0), (1.5, 2.0), (1.2, 1.5), (1.0, 1.2)):
        out = out.when(ev >= low, f"EV {low}-{high}")
    return out.otherwise("EV<1.0")


def ev_bands(log: DataFrame) -> DataFrame:
    """Bets, stake, return, hits, roi and hit rate by value band."""
    got = log.withColumn("band", ev_band(F.col("ev"))).groupBy("band").agg(F.count("*").alias("bets"), F.sum("bet_cost_yen").alias("total_bet"), F.sum("return_yen").alias("total_return"), F.sum("is_hit").alias("hits"))
    return got.withColumn("roi", ratio(F.col("total_return"), F.col("total_bet"))).withColumn("hit_rate", ratio(F.col("hits"), F.col("bets")))


def profit_and_loss(df: DataFrame) -> DataFrame:
    """Realised cost, return and profit of rows with is_selected, is_hit, payout."""
    cost = F.col("is_selected") * 100
    back = F.when((F.col("is_selected") == 1) & (F.col("is_hit") == 1), F.coalesce("payout", F.lit(0))).otherwise(0)
    return df.withColumn("bet_cost_yen", cost.cast("long")).withColumn("return_yen", back.cast("long")).withColumn("profit_yen", F.col("return_yen") - F.col("bet_cost_yen"))


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key in an order that must be total."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")


def ev_summary(df: DataFrame) -> DataFrame:
    """Races, top-k hit rates over all races, and means at the top, in one aggregation."""
    top, five, hit = F.col("ev_rank") == 1, F.col("ev_rank") <= 5, F.col("is_hit") == 1
    firsts = [(f"top1_{c}", top, c) for c in ("prob", "odds", "ev")] + [("top5_ev", five, "ev")]
    # by race first: it is partitioned so already, and a race counts once
    races = df.groupBy("race").agg(F.min(F.when(hit, F.col("ev_rank"))).alias("_rank"), *[f(F.when(w, F.col(c))).alias(f"{name}_{kind}") for name, w, c in firsts for kind, f in (("sum", F.sum), ("n", F.count))])
    out = races.agg(F.count("*").alias("races"), *[F.count_if(F.col("_rank") <= k).alias(f"hits_{k}") for k in (1, 3, 5, 10)], *[F.try_divide(F.sum(f"{name}_sum"), F.sum(f"{name}_n")).alias(name) for name, _, _ in firsts])
    return out.select("races", *[ratio(F.col(f"hits_{k}"), F.col("races")).alias(f"top{k}_hit_rate") for k in (1, 3, 5, 10)], "top1_prob", "top1_odds", "top1_ev", "top5_ev")


def hit_summary(df: DataFrame, rank: str = "rank_prob") -> DataFrame:
    """Over the hit rows alone: races with a hit, share ranked in the top k, mean and median rank."""
    r = F.col(rank)
    return df.where("is_hit = 1").agg(F.count("*").alias("hits"), *[F.avg((r <= k).cast("double")).alias(f"top{k}_rate") for k in (1, 3, 5, 10)], F.avg(r.cast("double")).alias("mean_rank"), F.median(r.cast("double")).alias("median_rank"))


def top1_bias(df: DataFrame) -> DataFrame:
    """By combo: times predicted first, times true, times both, share of predictions, predictions per true."""
    got = df.groupBy("combo").agg(F.sum((F.col("rank_prob") == 1).cast("long")).alias("pred"), F.sum("is_hit").alias("actual"), F.sum(((F.col("rank_prob") == 1) & (F.col("is_hit") == 1)).cast("long")).alias("agreed"))
    every = F.sum("pred").over(Window.partitionBy())
    return got.withColumn("share", ratio(F.col("pred"), every)).withColumn("per_true", F.try_divide(F.col("pred").cast("double"), F.col("actual").cast("double")))


def hit_combo_stats(df: DataFrame) -> DataFrame:
    r = F.col("rank_prob")
    return df.where("is_hit = 1").groupBy("combo").agg(F.count("*").alias("hits"), F.avg(r.cast("double")).alias("avg_rank"), F.avg((r <= 1).cast("double")).alias("top1_rate"), F.avg((r <= 3).cast("double")).alias("top3_rate"))


def topk_by_venue(df: DataFrame) -> DataFrame:
    """Races, top-1/3/5 hits and rates, mean and worst rank of the winner, by venue and in total (venue 'ALL')."""
    r = F.col("rank_prob")
    races = df.groupBy("venue", "race").agg(F.min(F.when(F.col("is_hit") == 1, r)).alias("hit_rank"))
    races = races.withColumn("hit_rank", F.coalesce("hit_rank", F.lit(999999)))
    got = races.rollup("venue").agg(F.grouping("venue").alias("_g"), F.count("*").alias("races"), *[F.sum((F.col("hit_rank") <= k).cast("long")).alias(f"top{k}") for k in (1, 3, 5)], F.avg(F.col("hit_rank").cast("double")).alias("mean_rank"), F.max("hit_rank").alias("worst_rank"))
    return got.withColumn("venue", F.when(F.col("_g") == 1, "ALL").otherwise(F.col("venue"))).drop("_g").withColumn("top1_rate", ratio(F.col("top1"), F.col("races")))


def roi_rollup(df: DataFrame, by: str = "venue") -> DataFrame:
    """Races, investment, return, profit, roi and hit rate per race, by venue and in total."""
    races = df.groupBy("race", by).agg(F.sum("bet_cost_yen").alias("invest"), F.sum("return_yen").alias("returned"), F.max("return_yen").alias("_best"))
    got = races.rollup(by).agg(F.grouping(by).alias("_g"), F.count("*").alias("races"), F.sum("invest").alias("invest"), F.sum("returned").alias("returned"), F.count_if(F.col("_best") > 0).alias("hit_races"))
    out = got.withColumn(by, F.when(F.col("_g") == 1, "ALL").otherwise(F.col(by))).drop("_g")
    return out.withColumn("profit", F.col("returned") - F.col("invest")).withColumn("roi", ratio(F.col("returned"), F.col("invest"))).withColumn("hit_rate", ratio(F.col("hit_races"), F.col("races")))


def lane_priors(winners: DataFrame, venues: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Laplace-smoothed shares of the first lane (6 keys) and ordered first pair (30 keys) by venue, all keys present."""
    spark: SparkSession = winners.sparkSession
    total = winners.groupBy("venue").agg(F.count("*").alias("n"))
    lanes = spark.createDataFrame([(a,) for a in LANES], "a int")
    pairs = spark.createDataFrame([(a, b) for a in LANES for b in LANES if a != b], "a int, b int")

    def share(keys: DataFrame, columns: list[str], out: str) -> DataFrame:
        got = winners.groupBy("venue", *columns).agg(F.count("*").alias("k"))
        dense = venues.crossJoin(F.broadcast(keys)).join(got, ["venue", *columns], "left").join(total, "venue", "left").na.fill(0, ["k", "n"])
        size = 6 if len(columns) == 1 else 30
        return dense.select("venue", *columns, ((F.col("k") + 1) / (F.col("n") + size)).alias(out))

    return share(lanes, ["a"], "first_prior"), share(pairs, ["a", "b"], "pair_prior")


def complete_races(df: DataFrame, rows: int = 120) -> DataFrame:
    """Rows of races that have exactly so many."""
    ok = df.groupBy("race").count().where(F.col("count") == rows).select("race")
    return df.join(ok, "race", "left_semi")


def time_split(date: Column, train_to: str, valid_to: str) -> Column:
    """Part of a date string: train up to one day, valid up to another, test after."""
    return F.when(date <= train_to, "train").when(date <= valid_to, "valid").otherwise("test")


def share_split(races: DataFrame, separate: bool = False) -> DataFrame:
    """70/15/15 of races in order of date and race. Cuts are int(.70 n) and int(.85 n), or int(.70 n) + int(.15 n) if separate.

    The order number comes from counts by date, so no task holds all races.
    """
    per_day = races.groupBy("date").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("date").rowsBetween(Window.unboundedPreceding, -1))
    per_day = per_day.withColumn("_before", F.coalesce(before, F.lit(0))).withColumn("n", F.sum("_n").over(Window.partitionBy())).drop("_n")
    place = F.row_number().over(Window.partitionBy("date").orderBy("race")) + F.col("_before")
    out = races.join(F.broadcast(per_day), "date").withColumn("place", place)
    first = F.floor(F.col("n") * 0.70)
    second = first + F.floor(F.col("n") * 0.15) if separate else F.floor(F.col("n") * 0.85)
    return out.withColumn("part", F.when(F.col("place") <= first, "train").when(F.col("place") <= second, "valid").otherwise("test")).drop("_before")


def field_ranks(runners: DataFrame, metrics: dict[str, bool]) -> DataFrame:
    """rank_<metric> 1..6 in the race, descending where True, ties to the lower lane."""
    for m, falling in metrics.items():
        order = F.desc(m) if falling else F.asc(m)
        runners = runners.withColumn(f"rank_{m}", F.row_number().over(by_race().orderBy(order, "lane")))
    return runners
