"""Append-only prediction and result logs as streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import round_to


def join_logs(predictions: DataFrame, results: DataFrame, keys: list[str], delay: str = "10 minutes", within: str = "1 hour") -> DataFrame:
    """Predictions with results logged within a time of them, by event time; unmatched predictions come out once it has passed."""
    p = predictions.withWatermark("logged_at", delay).alias("p")
    r = results.select(*[F.col(k).alias(f"r_{k}") for k in keys], F.col("logged_at").alias("r_logged_at"), "actual_combo", "payout").withWatermark("r_logged_at", delay)
    same = None
    for k in keys:
        same = (F.col(k) == F.col(f"r_{k}")) if same is None else same & (F.col(k) == F.col(f"r_{k}"))
    window = (F.col("r_logged_at") >= F.col("logged_at")) & (F.col("r_logged_at") <= F.col("logged_at") + F.expr(f"INTERVAL {within}"))
    return p.join(r, same & window, "leftOuter").drop(*[f"r_{k}" for k in keys])


def without_refreshes(predictions: DataFrame, keys: list[str], delay: str = "10 minutes") -> DataFrame:
    """Each key once, however often a page view logs it again within the delay."""
    return predictions.withWatermark("logged_at", delay).dropDuplicatesWithinWatermark(keys)


def running_totals(stream: DataFrame, keys: list[str]) -> DataFrame:
    return stream.groupBy(*keys).agg(F.count("*").alias("n"), round_to(F.sum("value"), 4).alias("total"), F.max("ts").alias("last_ts"))


def cached_values(stream: DataFrame, key: str, value: str, ttl_ms: int) -> DataFrame:
    """Emit each value of a key that isn't already held: a held one lapses ttl_ms of processing time after it came."""

    def step(keys: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        for pdf in batches:
            if not state.exists and len(pdf):
                state.update((float(pdf[value].iloc[0]),))
                state.setTimeoutDuration(ttl_ms)
                yield pd.DataFrame({key: [keys[0]], value: [float(pdf[value].iloc[0])]})

    return stream.groupBy(key).applyInPandasWithState(step, f"{key} long, {value} double", f"{value} double", "append", "ProcessingTimeTimeout")


def bounded_cache(stream: DataFrame, key: str, at: str, ttl_ms: int, size: int, buckets: int = 64) -> DataFrame:
    """Rows (key, at) that a cache would have had to fetch: whose key it doesn't hold, or holds for longer than ttl_ms of event time.

    Keys are dealt to buckets by hash, each a cache of its own with room for size / buckets keys: a sweep after each row that makes
    it larger drops what lapsed twice ttl_ms ago and then the oldest beyond the room, so state is bounded. A timer at twice ttl_ms
    empties buckets that get no more rows. The stream must have a watermark on `at`; within a batch rows go by time, then key. Rows
    without a key or time are left out.
    """
    room = max(1, size // buckets)
    zone = stream.sparkSession.conf.get("spark.sql.session.timeZone")
    usable = stream.where(F.col(key).isNotNull() & F.col(at).isNotNull()).select(F.pmod(F.xxhash64(key), F.lit(buckets)).alias("bucket"), F.col(key).alias("key"), F.col(at).alias("at"))

    def step(_: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = dict(zip(*state.get, strict=True)) if state.exists else {}
        now, fetched = state.getCurrentWatermarkMs(), []
        if not state.hasTimedOut:
            rows = pd.concat(list(batches), ignore_index=True).sort_values(["at", "key"], ignore_index=True)
            ms = [int(t.timestamp() * 1000) for t in rows["at"].dt.tz_localize(zone, ambiguous=True, nonexistent="shift_forward")]
            for i, (k, t) in enumerate(zip(rows["key"], ms, strict=True)):
                now = max(now, t)
                if k in held and t - held[k] <= ttl_ms:
                    continue
                held.pop(k, None)
                held[k] = t  # last in the order of insertion, which is that of fetching
                fetched.append(i)
                if len(held) > room:
                    held = {x: y for x, y in held.items() if t - y <= 2 * ttl_ms}
                    for x in sorted(held, key=held.get)[: max(0, len(held) - room)]:
                        del held[x]
        held = {x: y for x, y in held.items() if now - y <= 2 * ttl_ms}
        if held:
            state.update((list(held), list(held.values())))
            state.setTimeoutTimestamp(max(max(held.values()) + 2 * ttl_ms, state.getCurrentWatermarkMs()) + 1)
        elif state.exists:
            state.remove()
        if fetched:
            yield rows.loc[fetched, ["key", "at"]]

    kind = stream.schema[key].dataType.simpleString()
    return usable.groupBy("bucket").applyInPandasWithState(step, f"key {kind}, at timestamp", f"keys array<{kind}>, times array<long>", "append", "EventTimeTimeout")


def drain(stream: DataFrame, mode: str, folder: str) -> DataFrame:
    """Run a stream over what is there now and return its rows, which it writes below a fresh shared folder.

    complete: each batch replaces the last one, in a folder of its own.
    """
    path = f"{folder}/rows"
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").option("path", path).start()
        query.awaitTermination()
        return stream.sparkSession.read.schema(stream.schema).parquet(path)
    done: list[str] = []

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}-{number}")
        done.append(f"{path}-{number}")

    writer.foreachBatch(put).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(done[-1]) if done else stream.sparkSession.createDataFrame([], stream.schema)


def with_pending(joined: DataFrame, predictions: DataFrame, results: DataFrame, keys: list[str], row_key: str, within: str = "1 hour") -> DataFrame:
    """The rows of join_logs so far with those of predictions (by row_key) that still wait for the watermark, joined as they stand."""
    pending = predictions.join(joined.select(row_key), row_key, "left_anti")
    r = results.select(*[F.col(k).alias(f"r_{k}") for k in keys], F.col("logged_at").alias("r_logged_at"), "actual_combo", "payout")
    same = (F.col("r_logged_at") >= F.col("logged_at")) & (F.col("r_logged_at") <= F.col("logged_at") + F.expr(f"INTERVAL {within}"))
    for k in keys:
        same = same & (F.col(k) == F.col(f"r_{k}"))
    return joined.unionByName(pending.join(r, same, "left").select(joined.columns))
