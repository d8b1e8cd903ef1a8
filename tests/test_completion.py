"""Groups completed over batches, and latest-wins merging that can be replayed."""

from __future__ import annotations

import random
import time

import pytest
from pyspark.sql import functions as F

from hexlane.streaming import completion, logs, upsert

ROWS = "race long, place int, at timestamp, value double, name string"


def files(spark, tmp_path, batches):
    """A stream of one batch a list of rows."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, ROWS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(0.02 if i + 1 < len(batches) else 0)  # files are read in order of their times
    return spark.readStream.schema(ROWS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def row(race, place, day=1, value=0.5):
    import datetime as dt

    return race, place, dt.datetime(2025, 1, day), value, None if place == 2 else f"r{race}"


def test_groups_cut_over_batches_come_out_whole(spark, tmp_path):
    rng = random.Random(4)
    rows = [row(r, p) for r in range(40) for p in range(120) if r % 5 or p != r % 120]  # every fifth race lacks a row
    rng.shuffle(rows)
    cut = [rows[i::7] for i in range(7)]
    stream = completion.complete_groups(files(spark, tmp_path, cut), "race", "place", 120)
    got = logs.drain(stream, "append", f"file://{tmp_path}/out").collect()
    assert len(got) == 32 * 120 and all(r.is_complete for r in got)
    assert {(r.race, r.place, r.name) for r in got} == {(r[0], r[1], r[4]) for r in rows if r[0] % 5}


def test_repeats_and_null_keys(spark, tmp_path):
    first = [row(1, 1, value=1.0), row(1, 1, value=2.0), row(1, 2), row(2, 1), row(2, 1), (None, 1, None, 0.0, ""), (3, None, None, 0.0, "")]
    second = [row(1, 1, value=0.1), row(1, 3), row(2, 2)]
    third = [row(1, 2, value=9.0), row(2, 1), (None, 2, None, 0.0, ""), (None, 3, None, 0.0, "")]
    stream = completion.complete_groups(files(spark, tmp_path, [first, second, third]), "race", "place", 3)
    got = logs.drain(stream, "append", f"file://{tmp_path}/out").orderBy("race", "place").collect()
    assert [(r.race, r.place, r.value) for r in got] == [(1, 1, 1.0), (1, 2, 0.5), (1, 3, 0.5)]


@pytest.mark.parametrize("keep", [True, False])
def test_short_groups_lapse_by_the_watermark(spark, tmp_path, keep):
    batches = [[row(1, 1, 1), row(1, 2, 1), row(2, 1, 1)], [row(3, 1, 10)], [row(4, 1, 20)], [row(2, 2, 20), row(2, 3, 20)], [row(5, p, 28) for p in (1, 2, 3)]]
    stream = files(spark, tmp_path, batches).withWatermark("at", "1 hour")
    stream = completion.complete_groups(stream, "race", "place", 3, hold_ms=86_400_000, event_time="at", keep_incomplete=keep)
    got = {(r.race, r.place, r.is_complete) for r in logs.drain(stream, "append", f"file://{tmp_path}/out").collect()}
    whole = {(5, p, True) for p in (1, 2, 3)}
    assert whole <= got and not any(c and r != 5 for r, _, c in got)
    if keep:
        assert {(1, 1, False), (1, 2, False), (2, 1, False), (3, 1, False)} <= got
    else:
        assert got == whole


def test_many_groups_share_their_state(spark, tmp_path):
    batches = [[row(r, p) for r in range(3000)] for p in (1, 2)]
    stream = completion.complete_groups(files(spark, tmp_path, batches).where("place = 1 or race % 2 = 0"), "race", "place", 2)
    query = stream.writeStream.format("memory").queryName("many_groups").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("many_groups").count() == 3000
    assert max(o["numRowsTotal"] for p in query.recentProgress for o in p["stateOperators"]) <= completion.LOTS


def table(spark, tmp_path):
    stream = spark.createDataFrame([], "race long, date string, logged_at long, combo string, payout double")
    return upsert.VersionedTable(spark, f"file://{tmp_path}/results", stream.schema, ["race", "date"], "logged_at", "date"), stream.schema


def test_merging_is_latest_wins_and_replay_safe(spark, tmp_path):
    target, schema = table(spark, tmp_path)
    make = lambda rows: spark.createDataFrame(rows, schema)
    assert target.read().count() == 0
    one = make([(1, "d1", 5, "1-2-3", 1.0), (1, "d1", 7, "1-2-4", 2.0), (2, "d1", 1, "2-1-3", None), (3, "d2", 1, "a", 1.0), (4, None, 1, "n", 1.0)])
    two = make([(1, "d1", 6, "late", 9.0), (2, "d1", 2, "2-1-4", 3.0), (5, "d3", 1, "x", 0.0), (4, None, 3, "m", 1.0)])
    assert target.merge(one, 0) and target.merge(two, 1)
    want = {(1, "d1", 7, "1-2-4", 2.0), (2, "d1", 2, "2-1-4", 3.0), (3, "d2", 1, "a", 1.0), (4, None, 3, "m", 1.0), (5, "d3", 1, "x", 0.0)}
    assert {tuple(r) for r in target.read().collect()} == want
    before = target.manifest()
    assert not target.merge(two, 1) and not target.merge(one, 0) and target.manifest() == before
    assert {r.race for r in target.read(0).collect()} == {1, 2, 3, 4}  # the version before can still be read
    assert before['"d2"'] == target.manifest(0)['"d2"']  # untouched partitions aren't rewritten
    gone = target.vacuum(keep=1)
    assert target.versions() == [1] and {tuple(r) for r in target.read().collect()} == want and gone == []


def test_a_batch_that_died_before_its_commit_can_be_run_again(spark, tmp_path, monkeypatch):
    target, schema = table(spark, tmp_path)
    rows = spark.createDataFrame([(1, "d1", 5, "a", 1.0)], schema)
    monkeypatch.setattr(target, "_commit", lambda *a: (_ for _ in ()).throw(OSError("died")))
    with pytest.raises(OSError, match="died"):
        target.merge(rows, 0)
    monkeypatch.undo()
    assert target.read().count() == 0 and target.merge(rows, 0) and target.read().count() == 1
    assert len(target.vacuum(keep=1)) == 1 and target.read().count() == 1


def test_stream_merges_like_a_batch(spark, tmp_path):
    rng = random.Random(2)
    rows = [(rng.randrange(30), f"d{rng.randrange(3)}", i, f"c{i}", float(i)) for i in range(300)]
    _, schema = table(spark, tmp_path)
    for i in range(5):
        spark.createDataFrame(rows[i::5], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    target, _ = table(spark, tmp_path)
    upsert.run(stream, target, f"file://{tmp_path}/ck")
    want = {}
    for r in rows:
        want[r[:2]] = max(want.get(r[:2], r), r, key=lambda x: x[2])
    assert {tuple(r) for r in target.read().collect()} == set(want.values()) and len(target.versions()) == 5
    upsert.run(stream, target, f"file://{tmp_path}/ck-lost")  # the checkpoint was lost: all batches come again
    assert {tuple(r) for r in target.read().collect()} == set(want.values()) and len(target.versions()) == 5


def test_one_day_is_replaced_alone(spark, tmp_path):
    path = str(tmp_path / "days")
    make = lambda rows: spark.createDataFrame(rows, "date string, n int")
    upsert.replace_parts(make([("d1", 1), ("d1", 2), ("d2", 3)]), path, "date")
    upsert.replace_parts(make([("d1", 9)]), path, "date")
    upsert.replace_parts(make([("d1", 9)]), path, "date")
    assert sorted((r.date, r.n) for r in spark.read.parquet(path).select("date", F.col("n")).collect()) == [("d1", 9), ("d2", 3)]


def test_bounded_cache_is_a_plain_one(spark, tmp_path):
    import datetime as dt

    rng = random.Random(7)
    start = dt.datetime(2025, 1, 1)
    events = sorted((start + dt.timedelta(seconds=rng.randrange(7200)), rng.randrange(40)) for _ in range(600))
    rows = [(None if k == 39 else k, 1, t, 0.0, "") for t, k in events]
    stream = files(spark, tmp_path, [rows[i : i + 150] for i in range(0, 600, 150)]).withWatermark("at", "1 hour")
    for buckets, size, n in ((1, 10, 0), (1, 1000, 1), (4, 20, 2)):
        got = logs.drain(logs.bounded_cache(stream, "race", "at", 600_000, size, buckets), "append", f"file://{tmp_path}/out{n}").collect()
        bucket = {r.k: r.b for r in spark.range(40).select(F.col("id").alias("k"), F.pmod(F.xxhash64("id"), F.lit(buckets)).alias("b")).collect()}
        held, want = {}, set()
        for t, k in events:
            if k == 39:
                continue
            own = held.setdefault(bucket[k], {})
            if k in own and (t - own[k]).total_seconds() <= 600:
                continue
            own[k] = t
            want.add((k, t))
            if len(own) > size // buckets:
                held[bucket[k]] = own = {x: y for x, y in own.items() if (t - y).total_seconds() <= 1200}
                for x in sorted(own, key=own.get)[: max(0, len(own) - size // buckets)]:
                    del own[x]
        assert {(r.key, r.at) for r in got} == want and len(got) == len(want)


def test_files_follow_the_rows_and_not_the_partitions(spark, tmp_path):
    """Partitions share a batch's files, and rows of partitions that a later batch rewrote aren't read from there."""
    schema = "race long, day int, logged_at long, name string"
    make = lambda rows: spark.createDataFrame(rows, schema)
    target = upsert.VersionedTable(spark, f"file://{tmp_path}/days", make([]).schema, ["race", "day"], "logged_at", "day")
    first = [(i, i % 200 or None, 5, f"n{i}") for i in range(400)]
    assert target.merge(make(first), 0)
    assert len(target.manifest()) == 200 and len(list((tmp_path / "days" / "data").rglob("*.parquet"))) <= 8
    second = [(0, None, 9, "late"), (7, 7, 1, "old"), (207, 7, 6, "new"), (999, 300, 1, "more")]
    assert target.merge(make(second), 1)
    want = {r[:2]: r for r in first} | {(0, None): second[0], (207, 7): second[2], (999, 300): second[3]}
    got = [tuple(r) for r in target.read().collect()]
    assert len(got) == len(want) and set(got) == set(want.values())
    assert {tuple(r) for r in target.read(0).collect()} == set(first)
    assert target.vacuum(keep=1) == [] and target.read().count() == len(want)
