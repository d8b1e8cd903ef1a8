from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from hexlane import cluster
from hexlane.operators import models, scoring, selection, serving
from hexlane.plans import base
from hexlane.sources import fixed_width, tables, web_text


@pytest.mark.parametrize(
    ("name", "group"),
    [("lane1_motor", "motor"), ("first_boat", "boat"), ("a_exhibit", "exhibit"), ("x_avg_st", "st"), ("win_rate", "win_rate"), ("quinella", "place_rate"), ("grade_num", "grade"), ("ability_index", "ability"), ("course_diff", "course_fit"), ("wind_code", "weather"), ("lane_sum", "lane"), ("combo_mean", "other"), ("first_st", "st")],
)
def test_feature_groups(name, group):
    assert models.feature_group(name) == group


def test_drawn_settings_and_their_score(spark, sf):
    draws = selection.drawn_settings(3)
    assert draws == selection.drawn_settings(3) and draws[0] == selection.TUNED and draws[1] != draws[2]
    assert all(abs(sum(r[4:7]) - 1) < 1e-3 and 3 <= r[10] <= r[11] for d in draws[1:] for r in d)
    df = scoring.expected_value(base.scored(spark, sf))
    bets = selection.best_bets(df, selection.settings(spark, draws[1])).cache()
    got = selection.setting_score(df, bets).first()
    rows = bets.join(df.select("race", "class_id", "is_hit", "payout"), ["race", "class_id"]).collect()
    races = {r.race for r in rows}
    hits = [r for r in rows if r.is_hit]
    back = sum(r.payout or 0 for r in hits)
    assert got.races == len(races) and got.hits == len(hits) and abs(got.roi - back / (100 * len(rows))) < 1e-9 and abs(got.avg_points - len(rows) / len(races)) < 1e-9
    assert abs(got.top3 - sum(r["rank"] <= 3 for r in hits) / len(races)) < 1e-9
    assert selection.setting_score(df, bets.where("false")).first().score == 0


def test_raw_score_signs(spark):
    df = spark.createDataFrame([(1, 0, 2.0, 3.0, None)], "race long, class_id int, a_motor double, lane1_exhibit double, x_st double")
    assert serving.raw_score(df, {"a_motor": 0.5, "lane1_exhibit": 2.0, "x_st": 1.0}).first().score == -5.0


def test_statistics_without_a_line(spark):
    rows = spark.createDataFrame([("nothing",), (None,), ("1 ０.15 5.50 30.10 - - 31.00 45.20 62 33.33 50.00 7 - 40.10",)], "t string")
    got = rows.select(*web_text.statistics(F.col("t"))).collect()
    assert all(v is None for v in got[0]) and all(v is None for v in got[1])
    assert tuple(got[2]) == (0.15, 5.5, 30.1, None, None, 31.0, 45.2, 62.0, 33.33, 50.0, 7.0, None, 40.1)


def test_sinks(spark, tmp_path):
    a, b = spark.createDataFrame([(1, "x")], "n int, s string"), spark.createDataFrame([(2, 0.5)], "n int, v double")
    tables.write_union([a, b], str(tmp_path / "union"))
    got = tables.read_csv(spark, str(tmp_path / "union"), "n int, s string, v double").orderBy("n").collect()
    assert [tuple(r) for r in got] == [(1, "x", None), (2, None, 0.5)]
    tables.write_report(a, str(tmp_path / "report"))
    files = list((tmp_path / "report").glob("*.json"))
    assert len(files) == 1 and json.loads(files[0].read_text()) == {"n": 1, "s": "x"}
    rows = spark.createDataFrame([(float(i), i % 2) for i in range(20)], "x double, is_hit int")
    tables.save_model(models.train_binary(rows, ["x"], trees=1, depth=1), ["x"], ["0", "1"], str(tmp_path / "model"), spark)
    from pyspark.ml import PipelineModel

    assert PipelineModel.load(str(tmp_path / "model/model")).transform(rows.withColumn("_y", F.lit(0.0))).count() == 20
    assert spark.read.json(str(tmp_path / "model/meta")).first().features == ["x"]


def test_quality_gate_and_lanes(spark):
    df = spark.createDataFrame([("1-2-3", "UNKNOWN", "00"), ("bad", "x", "01")], "combo string, venue string, venue_code string")
    assert tuple(tables.quality_gate(df).first()) == (2, 1, 1, 1)
    rows = spark.createDataFrame([(1, 2, 5, "later"), (1, 2, 3, "first"), (1, 4, 9, "only")], "page_id long, lane int, pos int, x string")
    assert {r.x for r in web_text.first_by_lane(rows).collect()} == {"first", "only"}


def test_last_racer_record_is_kept(spark, tmp_path):
    def record(age: bytes) -> bytes:
        out = bytearray(b" " * 204)
        out[0:4], out[49:51] = b"4321", age
        return bytes(out)

    (tmp_path / "a").write_bytes(record(b"30") + b"\n" + record(b"31") + b"\n")
    (tmp_path / "b").write_bytes(record(b"32") + b"\r\n" + record(b"29") + b"\n")
    got = fixed_width.read_racers(spark, str(tmp_path)).collect()
    assert len(got) == 1 and got[0].age == 29


def test_shared_folder(spark):
    assert cluster.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")
