"""Boosting of many classes against a plain numpy version, and audits of features."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from hexlane.operators import boosting
from hexlane.operators.boosting import Params
from hexlane.plans import learned


def rows_of(n=900, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 5)).round(3)
    y = np.where(x[:, 0] + 0.5 * x[:, 1] + 0.3 * rng.normal(size=n) > 0.4, 2, np.where(x[:, 1] > 0.2, 1, 0)) * 10
    return x, y


@pytest.fixture(scope="module")
def table(spark):
    x, y = rows_of()
    data = [(i, int(c), *map(float, v)) for i, (v, c) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(data, "race long, y long, lane1_motor double, lane2_motor double, x_st double, boat_a double, wind double").repartition(5).cache()


NAMES = ["lane1_motor", "lane2_motor", "x_st", "boat_a", "wind"]


def plain(x, y, edges, p):
    """The same trees one class and node at a time."""
    classes = sorted(set(y.tolist()))
    k, bins = len(classes), np.stack([np.searchsorted(e, x[:, i], side="left") for i, e in enumerate(edges)], axis=1)
    t = np.array([classes.index(v) for v in y])
    m = np.tile(np.log(np.array([(y == c).mean() for c in classes])), (len(y), 1))
    losses = []
    for _ in range(p.rounds):
        q = np.exp(m - m.max(axis=1, keepdims=True))
        q /= q.sum(axis=1, keepdims=True)
        losses.append(-np.log(q[np.arange(len(y)), t]).mean())
        step = np.zeros_like(m)
        for c in range(k):
            g, h = q[:, c] - (t == c), q[:, c] * (1 - q[:, c])

            def grow(rows, depth, c=c, g=g, h=h):
                best = (p.least_gain, None, None)
                for f in range(x.shape[1]):
                    for b in range(p.bins):
                        left = rows[bins[rows, f] <= b]
                        right = rows[bins[rows, f] > b]
                        if len(left) < p.least_rows or len(right) < p.least_rows:
                            continue
                        score = lambda r: g[r].sum() ** 2 / (h[r].sum() + p.l2)
                        gain = round(score(left) + score(right) - score(rows), 9)
                        if gain > best[0]:
                            best = (gain, left, right)
                if depth == p.depth or best[1] is None:
                    step[rows, c] = -p.rate * g[rows].sum() / (h[rows].sum() + p.l2)
                else:
                    grow(best[1], depth + 1)
                    grow(best[2], depth + 1)

            grow(np.arange(len(y)), 0)
        m += step
    q = np.exp(m - m.max(axis=1, keepdims=True))
    q /= q.sum(axis=1, keepdims=True)
    return q, [*losses, -np.log(q[np.arange(len(y)), t]).mean()]


def test_trees_are_those_of_a_plain_version(table, monkeypatch):
    monkeypatch.setattr(boosting, "FAN", 2)  # sums of tasks merge over levels
    p = Params(rounds=4, rate=0.3, depth=3, bins=8, row_share=1.0, column_share=1.0, least_rows=20)
    model = boosting.fit(table, NAMES, "y", "race", p)
    x, y = rows_of()
    want, losses = plain(x, y, model.edges, p)
    assert model.classes == [0, 10, 20]
    assert np.allclose(model.losses, losses, rtol=1e-9) and all(a > b for a, b in zip(model.losses, model.losses[1:]))
    assert np.allclose(model.probabilities(x), want, rtol=1e-9)
    rows = {(r.race, r.class_id): r.prob for r in boosting.class_rows(model, table, "race").collect()}
    assert len(rows) == 3 * len(y) and all(abs(rows[i, c] - want[i, j]) < 1e-9 for i in range(50) for j, c in enumerate(model.classes))


def test_shares_of_rows_and_columns(table):
    keys = np.arange(-50_000, 50_000)
    a, b = (boosting.chosen_rows(keys, 1, i, 0.8) for i in (0, 1))
    assert 0.79 < a.mean() < 0.81 and 0.62 < (a & b).mean() < 0.66 and boosting.chosen_rows(keys, 1, 0, 1.0).all()
    p = Params(rounds=6, rate=0.3, depth=2, bins=16)
    one, two = (boosting.fit(table, NAMES, "y", "race", p) for _ in range(2))
    assert np.allclose(one.losses, two.losses) and one.losses[-1] < one.losses[0]
    x, y = rows_of(600, seed=8)
    own = one.probabilities(x)[np.arange(len(y)), (y // 10)]
    assert -np.log(own).mean() < 0.9 * -np.log(np.exp(one.base)[y // 10]).mean()  # better than the prior on rows it hasn't seen


def test_permuted_groups_lose_what_they_are_worth(spark, table, monkeypatch):
    monkeypatch.setattr(boosting, "BUCKET_ROWS", 200)
    model = boosting.fit(table, NAMES, "y", "race", Params(rounds=6, rate=0.3, depth=3, bins=16))
    got = {r.feature_group: r for r in boosting.permutation_importance(model, table, "y", "race").collect()}
    assert set(got) == {"none", "motor", "st", "boat", "weather"} or set(got) == {"none", "motor", "st", "boat", "other", "weather"}
    assert got["none"].n == 900 and abs(got["none"].loss - model.losses[-1]) < 1e-9 and got["motor"].features == 2
    assert got["motor"].loss_more > 0.3 and got["motor"].top1_less > 0.2
    assert all(abs(got[g].loss_more) < 0.05 for g in got if g != "motor") and got["none"].loss_more == 0
    again = {r.feature_group: r.loss for r in boosting.permutation_importance(model, table.repartition(2), "y", "race").collect()}
    assert all(abs(again[g] - got[g].loss) < 1e-9 for g in got)
    gains = {r.feature: r for r in boosting.gain_importance(spark, model).collect()}
    assert abs(sum(r.share for r in gains.values()) - 1) < 1e-9 and gains["lane1_motor"].share > 0.3


def test_variants_and_unseen_classes(table):
    parts = table.withColumn("part", F.when(F.col("race") % 4 == 0, "test").otherwise("train")).withColumn("y", F.when((F.col("part") == "test") & (F.col("race") == 0), 99).otherwise(F.col("y")))
    got = {(r.variant, r.part): r for r in boosting.variants(parts, "part", {"all": NAMES, "no motor": NAMES[2:]}, "y", "race", Params(rounds=4, rate=0.3, depth=2, bins=8)).collect()}
    assert got["all", "test"].n == 225 and got["all", "test"].top1 > got["no motor", "test"].top1 + 0.1 and got["no motor", "train"].features == 3
    assert got["all", "test"].top3 < 1  # the class it never saw


def test_missing_numbers_and_one_class(spark):
    rows = spark.createDataFrame([(i, i % 2, None if i % 3 else float(i % 2), float("nan") if i % 5 else float("inf")) for i in range(200)], "k long, y int, a double, b double")
    model = boosting.fit(rows, ["a", "b"], "y", "k", Params(rounds=2, depth=2, bins=4, least_rows=5, row_share=1.0, column_share=1.0))
    assert model.losses[-1] < model.losses[0] and boosting.predict(model, rows, ["k"]).count() == 200
    with pytest.raises(ValueError, match="two classes"):
        boosting.fit(rows.where("y = 0"), ["a"], "y", "k")


def test_rows_are_worked_out_once(spark, table, sf):
    """Counts, quantiles and bins don't each go back to where the rows come from."""
    seen = spark.sparkContext.accumulator(0)

    def look(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rows = table.mapInArrow(look, table.schema)
    model = boosting.fit(rows, NAMES, "y", "race", Params(rounds=1, depth=1, bins=4))
    assert len(model.trees) == 1 and seen.value == table.count()
    assert not any("lineitem" in f or "orders" in f for f in learned.rows(spark, sf).inputFiles())
