"""Boosting on races' own rows against pyspark.ml on their 120 outcomes."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Window
from pyspark.sql import functions as F

from hexlane.operators import models, race_boosting
from hexlane.operators.features import binary_block, binary_lanes
from hexlane.plans import base, registry
from hexlane.sources import panel

LANES = race_boosting.Lanes(["st_inv", "motor"], ["motor"])


def test_trees_are_those_of_pyspark_on_the_outcomes(spark):
    rng = random.Random(8)
    data = [(i, [rng.choice((0.0, 0.25, 0.5, 0.75)) for _ in range(6)], [float(rng.randrange(4)) for _ in range(6)]) for i in range(70)]
    # the winner follows the numbers in part, so that there is something to learn
    data = [(*r, max(range(120), key=lambda k: 2 * r[1][race_boosting.OUTCOMES[k][0]] + r[2][race_boosting.OUTCOMES[k][1]] - r[2][race_boosting.OUTCOMES[k][2]] + 2 * rng.random())) for r in data]
    races = spark.createDataFrame(data, "race long, st_inv array<double>, motor array<double>, y_class int").repartition(3).cache()
    model = models.train_binary(races, LANES, "y_class", trees=5, depth=3)
    assert len(model.trees) == 5
    rows = races.collect()
    wide = panel.expand(races)
    pick = lambda metric, lane: F.element_at(F.col(metric), F.col(lane))
    columns = [pick(m, lane).alias(f"{lane}_{m}") for lane in "abc" for m in LANES.metrics] + [(pick("motor", "a") - pick("motor", "b")).alias("fs_motor")]
    wide = wide.select("race", "class_id", (F.col("class_id") == F.col("y_class")).cast("int").alias("is_hit"), *columns).cache()
    theirs = models.train_binary(wide, wide.columns[3:], trees=5, depth=3)
    want = {(r.race, r.class_id): r.m for r in theirs.transform(wide.withColumn("_w", F.lit(1.0)).withColumn("_y", F.lit(0.0))).select("race", "class_id", vector_to_array("rawPrediction")[1].alias("m")).collect()}
    batch = pa.RecordBatch.from_arrays([pa.array([r.st_inv for r in rows]), pa.array([r.motor for r in rows])], ["st_inv", "motor"])
    margins = model.margins(LANES.binned(batch, model.edges))
    got = {(r.race, k): margins[i, k] for i, r in enumerate(rows) for k in range(120)}
    assert got.keys() == want.keys() and len(set(np.round(margins.ravel(), 9))) > 20
    assert max(abs(got[k] - want[k]) for k in got) < 1e-9
    ranked = models.score_binary(theirs, wide).withColumn("r", F.row_number().over(Window.partitionBy("race").orderBy(F.desc(F.round("score", 9)), "class_id")))
    places = {r.race: r.r for r in ranked.where("is_hit = 1").collect()}
    found = race_boosting.hit_ranks(model, races, "y_class", ["race"]).collect()
    assert {r.race: r.rank_prob for r in found if r.is_hit == 1} == places


def test_lanes_give_the_columns_of_the_outcomes(spark, sf):
    races = base.races(spark, sf).limit(40).cache()
    rows = {(r.race, r.class_id): r for r in binary_block(panel.expand(races)).collect()}
    names = ["st_inv", "exhibit_inv", "course_diff", "motor", "boat"]
    for r in binary_lanes(races).collect():
        for k, lanes in enumerate(race_boosting.OUTCOMES):
            own = rows[r.race, k]
            assert [own[f"{role}_{m}"] for role in ("first", "second", "third") for m in names] == [r[m][lanes[i]] for i in range(3) for m in names]
            assert [own[f"fs_{m}"] for m in ("st_inv", "exhibit_inv", "motor", "boat")] == [r[m][lanes[0]] - r[m][lanes[1]] for m in ("st_inv", "exhibit_inv", "motor", "boat")]


def test_no_race_is_spread_over_its_outcomes(spark, sf, monkeypatch):
    given = []
    fit = models.train_binary
    monkeypatch.setattr(models, "train_binary", lambda rows, *a, **k: (given.append(rows), fit(rows, *a, **k))[1])
    assert registry.QUERIES["trained_topk"](spark, sf).count() == 6
    assert given[0].count() == given[0].select("race").distinct().count()  # 120 rows a race before
