"""Race panels: one row a runner, one row a race, one row an outcome.

`runners` has race, lane, racer_no, motor, boat, exhibit, course, st, win_rate, place_rate, price, finish, date, venue.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..dims import class_id, outcomes

METRICS = ("win_rate", "place_rate", "st", "exhibit", "motor", "boat", "course")


def runners_from_orders(lineitem: DataFrame, orders: DataFrame) -> DataFrame:
    """Orders of six lines or more as races: the first six lines are lanes, the dearest line wins."""
    by_race = Window.partitionBy("l_orderkey")
    place = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    lines = lineitem.withColumn("lane", F.row_number().over(place)).withColumn("_n", F.count("*").over(by_race)).where("_n >= 6 and lane <= 6")
    finish = Window.partitionBy("l_orderkey").orderBy(F.desc("l_extendedprice"), "lane")
    lines = lines.withColumn("finish", F.row_number().over(finish))
    head = orders.select(
        F.col("o_orderkey").alias("l_orderkey"),
        F.date_format("o_orderdate", "yyyyMMdd").alias("date"),
        F.element_at(F.array(*map(F.lit, ("15", "02", "16", "12", "99"))), F.substring("o_orderpriority", 1, 1).cast("int")).alias("venue"),
    )
    return lines.join(head, "l_orderkey").select(
        F.col("l_orderkey").alias("race"), "lane", F.col("l_suppkey").alias("racer_no"), (F.col("l_partkey") % 100).cast("int").alias("motor"),
        (F.col("l_suppkey") % 100).cast("int").alias("boat"), (F.col("l_tax") + 6.5).alias("exhibit"), F.least("l_linenumber", F.lit(6)).alias("course"),
        (F.col("l_tax") + 0.0).alias("st"), F.col("l_quantity").cast("double").alias("win_rate"), (F.col("l_discount") + 0.0).alias("place_rate"), F.col("l_extendedprice").alias("price"), "finish", "date", "venue",
    )


def races(runners: DataFrame) -> DataFrame:
    """One row a race with its six runners in an array by lane and the winning class; races without six distinct lanes go."""
    fields = [c for c in runners.columns if c not in ("race", "date", "venue")]
    wide = runners.groupBy("race").agg(F.min("date").alias("date"), F.min("venue").alias("venue"), F.array_sort(F.collect_list(F.struct("lane", *[c for c in fields if c != "lane"]))).alias("runners"))
    wide = wide.where((F.size("runners") == 6) & (F.size(F.array_distinct("runners.lane")) == 6))
    # flat arrays, so that the 120 outcomes of a race don't each take them out of the structs
    flat = [F.col(f"runners.{c}").alias(c) for c in fields if c not in ("lane", "finish")]
    wide = wide.select("race", "date", "venue", "runners", *flat, *[finisher(place).alias(f"w{place}") for place in (1, 2, 3)])
    return wide.withColumn("y_class", class_id(F.col("w1"), F.col("w2"), F.col("w3")))


def finisher(place: int) -> Column:
    """Lane of the runner that came in at a place."""
    return F.get(F.filter("runners", lambda r: r["finish"] == place), F.lit(0))["lane"]


def at(lane: Column | str, metric: str) -> Column:
    """A metric of the runner in a lane (1 to 6)."""
    return F.element_at(F.col(metric), F.col(lane) if isinstance(lane, str) else lane)


def expand(wide: DataFrame) -> DataFrame:
    """120 rows a race. The outcomes are a fixed 120 rows, so broadcasting them is safe at any size."""
    return wide.crossJoin(F.broadcast(outcomes(wide.sparkSession)))


def labelled(combos: DataFrame) -> DataFrame:
    return combos.withColumn("is_hit", (F.col("class_id") == F.col("y_class")).cast("int"))
