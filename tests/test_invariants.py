from __future__ import annotations

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from hexlane.functions.scalars import round_to
from hexlane.operators import features, kelly, reports, selection
from hexlane.plans import base
from hexlane.plans.base import rounded
from hexlane.plans.decisions import chosen
from hexlane.sources import tables


def test_probabilities_and_ranks(spark, sf):
    r = base.ranked(spark, sf).groupBy("race").agg(F.count("*").alias("n"), F.sum("prob").alias("p"), F.countDistinct("rank_prob").alias("k"), F.max("rank_prob").alias("m"), F.sum("is_hit").alias("hits")).agg(F.min("n"), F.max("n"), F.min("p"), F.max("p"), F.min("k"), F.max("m"), F.min("hits"), F.max("hits")).first()
    assert r[:2] == (120, 120) and abs(r[2] - 1) < 1e-9 and abs(r[3] - 1) < 1e-9 and r[4:] == (120, 120, 1, 1)


def test_selection_sizes(spark, sf):
    r = chosen(spark, sf).groupBy("race").count().agg(F.min("count"), F.max("count")).first()
    assert 3 <= r[0] and r[1] <= 12


def test_kelly_caps(spark, sf):
    out = kelly.allocate(base.valued(spark, sf))
    r = out.groupBy("race").agg(F.sum("frac").alias("f"), F.max("frac").alias("m"), F.min("amount").alias("a"), F.min("edge").alias("e")).agg(F.max("f"), F.max("m"), F.min("a"), F.min("e")).first()
    assert r[0] <= kelly.TOTAL * kelly.FRACTION + 1e-9 and r[1] <= kelly.CAP * kelly.FRACTION + 1e-9 and r[2] >= 100 and r[3] > 0


def test_kelly_without_edge(spark):
    df = spark.createDataFrame([(1, "1-2-3", 0.5, 1.5), (1, "1-3-2", 0.5, 1.2)], "race long, combo string, prob double, odds double")
    assert kelly.allocate(df).count() == 0


def test_capped_simplex():
    x = np.array([[0.5, 0.01, -1.0], [0.001, 0.0, 0.0]])
    f = kelly.capped(x)
    assert f[0].sum() <= kelly.TOTAL + 1e-9 and f.max() <= kelly.CAP and f.min() >= 0 and f[1, 0] == 0.001


@pytest.mark.parametrize(("odds", "high", "low", "zone"), [(3.99, 1.0, 0.78, 1.0), (4.0, 1.0, 0.88, 1.0), (6.0, 1.0, 0.95, 1.0), (8.0, 1.0, 1.0, 1.08), (15.1, 1.0, 1.0, 1.12), (40.0, 0.96, 1.0, 1.06), (50.1, 0.88, 1.0, 1.0), (201.0, 0.45, 1.0, 1.0), (0.0, 0.0, 0.0, 0.0)])
def test_odds_steps(spark, odds, high, low, zone):
    df = spark.createDataFrame([("99", odds)], "venue string, odds double")
    o = F.col("odds")
    assert tuple(df.select(selection.high_penalty(o), selection.low_penalty(o), selection.zone_bonus(o)).first()) == (high, low, zone)


def test_split_cuts(spark):
    df = spark.createDataFrame([(i, f"2025{i:04d}") for i in range(13)], "race long, date string")
    count = lambda sep: {r.part: r["count"] for r in reports.share_split(df, sep).groupBy("part").count().collect()}
    assert count(False) == {"train": 9, "valid": 2, "test": 2} and count(True) == {"train": 9, "valid": 1, "test": 3}


def test_laplace(spark):
    first, pair = reports.lane_priors(spark.createDataFrame([("x", 1, 2)], "venue string, a int, b int"), spark.createDataFrame([("x",), ("y",)], "venue string"))
    assert first.where("venue = 'x' and a = 1").first().first_prior == 2 / 7 and first.count() == 12
    assert pair.where("venue = 'x' and a = 1 and b = 2").first().pair_prior == 2 / 31 and pair.count() == 60


def test_leak_columns():
    names = ["race", "ability_index", "y", "y_class", "is_hit", "lane1_finish", "trifecta_payout", "payout", "first_st"]
    kept = [c for c in names if c not in features.LEAKS and not c.startswith(features.LEAK_PREFIXES) and not c.endswith(features.LEAK_ENDINGS)]
    assert kept == ["race", "ability_index", "first_st"]


def test_tables(spark, tmp_path):
    df = spark.createDataFrame([("20250330", 1, 0.5), ("20250331", 2, 0.25)], "date string, n int, score double")
    tables.append_log(df, str(tmp_path / "log"))
    tables.append_log(df, str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 4
    tables.write_csv(df, str(tmp_path / "csv"))
    assert tables.read_csv(spark, str(tmp_path / "csv"), "date string, n int, score double").orderBy("n").collect() == df.collect()
    assert tables.read_json(str(tmp_path / "none.json"), {}) == {}
    with pytest.raises(ValueError, match="missing"):
        tables.require(df, ["date", "odds"])
    with pytest.raises(ValueError, match="unique"):
        tables.one_row_a_key(df.union(df), ["n"])
    assert "pred_proba" in tables.first_alias(df, {"pred_proba": ["prob", "score"]}).columns


def test_ev_rows(spark):
    from hexlane.operators.scoring import expected_value

    df = spark.createDataFrame([(1, 0, 0.1, 20.0), (1, 1, 0.1, None), (1, 2, 0.1, 0.5)], "race long, class_id int, prob double, odds double")
    got = {r.class_id: (r.ev, r.edge, r.ev_rank) for r in expected_value(df).collect()}
    assert got == {0: (2.0, 1.0, 1), 1: (None, None, None), 2: (None, None, None)}


def test_cached_values(spark, tmp_path):
    from hexlane.streaming import logs

    spark.createDataFrame([(1, 2.0), (1, 3.0), (2, 4.0)], "k long, v double").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k long, v double").parquet(str(tmp_path / "in"))
    held = logs.cached_values(stream, "k", "v", 3_600_000)
    query = held.writeStream.outputMode("append").format("memory").queryName("cache_test").option("checkpointLocation", str(tmp_path / "ck")).start()
    try:
        # timeouts keep the query running empty batches, so it is never idle
        until = time.time() + 60
        while time.time() < until and spark.table("cache_test").count() < 2:
            time.sleep(0.5)
        assert sorted(r.k for r in spark.table("cache_test").collect()) == [1, 2]
    finally:
        query.stop()


def test_kelly_shift_is_exact_and_rows_stop_when_done():
    """The shift against plain halvings, and stakes against all steps taken; before, every row took 200 times 60 rounds."""
    rng = np.random.default_rng(3)
    x = rng.normal(0, 0.05, (500, kelly.TOP))
    low, high = x.min(axis=1) - kelly.CAP, x.max(axis=1)
    for _ in range(100):
        shift = (low + high) / 2
        much = np.clip(x - shift[:, None], 0, kelly.CAP).sum(axis=1) > kelly.TOTAL
        low, high = np.where(much, shift, low), np.where(much, high, shift)
    plain = np.where((np.clip(x, 0, kelly.CAP).sum(axis=1) > kelly.TOTAL)[:, None], np.clip(x - high[:, None], 0, kelly.CAP), np.clip(x, 0, kelly.CAP))
    assert np.abs(kelly.capped(x) - plain).max() < 1e-13
    rounds, capped = [], kelly.capped
    kelly.capped = lambda y: (rounds.append(len(y)), capped(y))[1]
    try:
        f = kelly.fractions(np.tile([0.4, 0.3, 0.2, 0.0], (50, 1)), np.tile([5.0, 6.0, 9.0, 1.0], (50, 1)))
    finally:
        kelly.capped = capped
    assert len(rounds) < kelly.STEPS / 4 and (f[:, 3] == 0).all()
    kept, kelly.SMALLEST = kelly.SMALLEST, -1.0  # no row is ever done
    try:
        assert np.abs(f - kelly.fractions(np.tile([0.4, 0.3, 0.2, 0.0], (50, 1)), np.tile([5.0, 6.0, 9.0, 1.0], (50, 1)))).max() < 1e-13
    finally:
        kelly.SMALLEST = kept


def test_rounding_takes_the_side_that_the_sql_takes(spark):
    """Short decimals that end in a 5: the buy score of a race's leading bet on six-fold tables, and others."""
    import duckdb

    for digits in (4, 6, 7, 9):
        values = [1.44366125, *[sign * (i * 10 + 5) / 10.0 ** (digits + 1) for i in range(1, 4000, 7) for sign in (1, -1)], 0.0, 2.5]
        got = [r.x for r in spark.createDataFrame([(v,) for v in values], "x double").coalesce(1).select(round_to("x", digits).alias("x")).collect()]
        want = duckdb.execute(f"SELECT list_transform($x::DOUBLE[], lambda v: round(v, {digits}))", {"x": values}).fetchone()[0]
        assert got == want
    assert spark.sql("SELECT 1.44366125D AS x, CAST(NULL AS DOUBLE) AS y").select(round_to("x", 7), round_to("y", 7)).first()[:] == (1.4436612, None)
    assert spark.sql("SELECT 1.44366125D AS x").transform(lambda df: rounded(df, 7)).first().x == 1.4436612
