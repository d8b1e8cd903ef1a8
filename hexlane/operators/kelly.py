"""Kelly stakes over the mutually exclusive outcomes of a race.

The best outcomes of a race are gathered into arrays with built-in functions; concave maximisation with caps needs iteration,
which runs in numpy on Arrow batches of races, all races of a batch at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..cluster import ship
from .scoring import by_race

# fixed values: caps a bet and in all, share staked, steps and their size, outcomes a race, unit of a stake
CAP, TOTAL, FRACTION, STEPS, RATE, TOP, UNIT, HALVINGS = 0.02, 0.05, 0.25, 200, 0.3, 30, 100, 60
# a change that counts as none: the last bits of a stake of a few hundredths
SMALLEST = 1e-15


def capped(x: np.ndarray, cap: float = CAP, total: float = TOTAL) -> np.ndarray:
    """Nearest rows with 0 <= f <= cap and sum f <= total: each row's shift is where its sum, straight between the places where an
    entry leaves 0 or the cap, comes down to the total. Halvings find the stretch, a line in it the shift."""
    f = np.clip(x, 0, cap)
    over = f.sum(axis=1) > total
    if not over.any():
        return f
    y = x[over]
    low, high = y.min(axis=1) - cap, y.max(axis=1)
    shift = (low + high) / 2
    for i in range(2 * HALVINGS):
        z = y - shift[:, None]
        n, gap = ((z > 0) & (z < cap)).sum(axis=1), np.clip(z, 0, cap).sum(axis=1) - total
        step = gap / np.maximum(n, 1)
        done = (n > 0) & (np.abs(step) <= SMALLEST)
        if done.all():
            break
        much = gap > 0
        low, high = np.where(much, shift, low), np.where(much, high, shift)
        # Newton's step where it stays between the bounds; every other one is a halving, as Newton's may go round in a circle
        newton = (n > 0) & (shift + step > low) & (shift + step < high) & (i % 2 == 0)
        shift = np.where(done, shift, np.where(newton, shift + step, (low + high) / 2))
    f[over] = np.clip(y - shift[:, None], 0, cap)
    return f


def fractions(p: np.ndarray, odds: np.ndarray) -> np.ndarray:
    """Projected gradient on expected log growth, a row a race; places without an outcome have p 0 and get nothing.

    Most rows soon go to and fro between two places, or stay; such a row is done, as the steps left only tell at which it ends.
    """
    real = p > 0
    start = np.where(real, np.maximum((p * odds - 1) / np.maximum(odds - 1, 1e-12), 0), -1.0)
    f, outside = capped(start), np.maximum(0.0, 1 - p.sum(axis=1))
    out, at, before = f.copy(), np.arange(len(p)), np.full_like(f, np.inf)
    for left in range(STEPS - 1, -1, -1):
        base = np.maximum(1 - f.sum(axis=1), 1e-12)
        win = np.maximum(base[:, None] + f * odds, 1e-12)
        pull = p * odds / win - ((p / win).sum(axis=1) + outside / base)[:, None]
        new = capped(np.where(real, f + RATE * pull, -1.0))
        out[at] = f if left % 2 else new  # where a row done now ends; others come again
        on = np.abs(new - before).max(axis=1, initial=0.0) > SMALLEST
        if not on.all():
            at, p, odds, real, outside, f, new = (x[on] for x in (at, p, odds, real, outside, f, new))
        before, f = f, new
        if not len(at):
            break
    return out


def stakes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        if pdf.empty:
            continue
        p, odds = np.zeros((len(pdf), TOP)), np.ones((len(pdf), TOP))
        for i, (a, b) in enumerate(zip(pdf.p, pdf.odds, strict=True)):
            p[i, : len(a)], odds[i, : len(b)] = a, b
        yield pdf.assign(f=list(fractions(p, odds) * FRACTION))


def allocate(df: DataFrame, bankroll: float = 100_000.0) -> DataFrame:
    """race, combo, frac, amount, p, odds, edge of the stakes of at least one unit, for rows race, combo, prob, odds."""
    ship(df.sparkSession)
    df = df.where("prob > 0 and odds > 0").select("race", "combo", "odds", (F.col("prob") / F.sum("prob").over(by_race())).alias("p"))
    df = df.withColumn("edge", F.col("p") * F.col("odds") - 1).where("edge > 0")
    df = df.withColumn("k", F.row_number().over(by_race().orderBy(F.desc("edge"), "combo"))).where(F.col("k") <= TOP)
    # a race's stakes come back beside its outcomes, so these are neither worked out twice nor joined
    best = df.groupBy("race").agg(F.array_sort(F.collect_list(F.struct("k", "p", "odds", "combo", "edge"))).alias("o"))
    best = best.select("race", F.col("o.p").alias("p"), F.col("o.odds").alias("odds"), F.col("o.combo").alias("combo"), F.col("o.edge").alias("edge"))
    found = best.mapInPandas(stakes, "race long, p array<double>, odds array<double>, combo array<string>, edge array<double>, f array<double>")
    rows = found.select("race", F.inline(F.arrays_zip("p", "odds", "combo", "edge", "f")))
    rows = rows.where("p is not null").withColumn("amount", (F.floor(F.col("f") * bankroll / UNIT) * UNIT).cast("long"))
    return rows.where(F.col("amount") >= UNIT).select("race", "combo", (F.col("amount") / bankroll).alias("frac"), "amount", "p", "odds", "edge")
