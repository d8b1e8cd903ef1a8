"""Groups that arrive in parts: rows are held in state until a group is whole, and come out together.

A file or a batch may end in the middle of a race. A batch query sees all rows and only filters; a stream has to carry the rest of
the race over to the next batch, whatever their distance, and to forget races that never become whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming.state import GroupState

from ..cluster import ship

LOTS, UNTIL = 1024, "_until"


def _packed(rows: pd.DataFrame, schema: pa.Schema) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, schema) as out:
        out.write_table(pa.Table.from_pandas(rows, schema=schema, preserve_index=False))
    return sink.getvalue().to_pybytes()


def _unpacked(held: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(held).read_all().to_pandas()


def complete_groups(stream: DataFrame, key: str, place: str, size: int, hold_ms: int | None = None, event_time: str | None = None, keep_incomplete: bool = False) -> DataFrame:
    """Rows of groups with `size` different places, each group whole and once, in order of place, with is_complete.

    Of rows with the same key and place the first that came counts (within a batch, the first by all columns); what comes for a
    group that is already out is dropped while its mark is held. A group that stays short for hold_ms after its last new row is
    forgotten, or comes out as it is with is_complete false if keep_incomplete. Time is the clock's (a query with such timers runs
    on until it is stopped, also with the trigger availableNow), or with event_time the watermark of that column, which the stream
    must have; rows behind the watermark are dropped by Spark before they come here. Without hold_ms nothing is ever forgotten.
    Groups are held in LOTS lots by the hash of their key, and a lot's state is read and written whole in each batch that brings rows
    for it: a call of Python costs milliseconds, too much for each group of a batch.
    State holds at most size - 1 rows a group, and one mark a finished group until its time is over. Rows whose key or place is
    null belong to no group and are left out.
    """
    if size < 1:
        raise ValueError("size must be 1 or more")
    ship(stream.sparkSession)
    columns = list(stream.columns)
    # pandas has timestamps in the session's zone, without naming it; they are held the same way
    held_schema = pa.schema([*[pa.field(f.name, pa.timestamp("us") if pa.types.is_timestamp(f.type) else f.type) for f in to_arrow_schema(stream.schema)], pa.field(UNTIL, pa.int64())])
    mark_schema = pa.schema([held_schema.field(key), held_schema.field(UNTIL)])
    zone = stream.sparkSession.conf.get("spark.sql.session.timeZone")
    out_schema = T.StructType([*stream.schema.fields, T.StructField("is_complete", T.BooleanType())])
    state_schema = T.StructType([T.StructField("rows", T.BinaryType()), T.StructField("marks", T.BinaryType())])

    def ends(rows: pd.DataFrame, state: GroupState) -> pd.Series:
        """Until when the group of each key is held, by key, from the rows that came or are held."""
        if hold_ms is None:
            return rows.groupby(key, sort=False).size() * 0
        if event_time is None:
            return rows.groupby(key, sort=False).size() * 0 + state.getCurrentProcessingTimeMs() + hold_ms
        latest = rows.groupby(key, sort=False)[event_time].max()
        at = latest.dt.tz_localize(zone, ambiguous=np.ones(len(latest), bool), nonexistent="shift_forward").dt.tz_convert("UTC").dt.tz_localize(None)
        ms = pd.Series(np.where(at.isna(), 0, at.astype("datetime64[ms]").astype("int64")), index=latest.index)
        return ms.clip(lower=state.getCurrentWatermarkMs()) + hold_ms

    def step(_: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        packed, marked = state.get if state.exists else (None, None)
        held = _unpacked(packed) if packed is not None else held_schema.empty_table().to_pandas()
        marks = _unpacked(marked) if marked is not None else mark_schema.empty_table().to_pandas()
        if not state.hasTimedOut:
            new = pd.concat(list(batches), ignore_index=True)[columns]
            late = new[key].isin(marks[key])
            if late.any():
                again = ends(new[late], state)
                marks[UNTIL] = marks[key].map(again).fillna(marks[UNTIL]).astype("int64")
                new = new[~late]
            if len(new):
                new = new.sort_values(columns, kind="stable", ignore_index=True)
                met = held[key].isin(new[key])
                rows = pd.concat([held[met][columns], new], ignore_index=True) if met.any() else new
                rows = rows.drop_duplicates([key, place], ignore_index=True)
                rows = rows.assign(**{UNTIL: rows[key].map(ends(rows, state)).astype("int64")})
                whole = rows.groupby(key, sort=False)[place].transform("size") >= size
                if whole.any():
                    done = rows[whole]
                    yield done.sort_values([key, place], kind="stable")[columns].assign(is_complete=True)
                    done = done.drop_duplicates(key)[[key, UNTIL]]
                    marks = pd.concat([marks, done], ignore_index=True) if len(marks) else done
                    rows = rows[~whole]
                held = pd.concat([held[~met], rows], ignore_index=True) if len(rows) and not met.all() else rows if len(rows) else held[~met]
        if hold_ms is not None:
            now = state.getCurrentProcessingTimeMs() if event_time is None else state.getCurrentWatermarkMs()
            over = held[UNTIL] <= now
            if keep_incomplete and over.any():
                yield held[over].sort_values([key, place], kind="stable")[columns].assign(is_complete=False)
            held, marks = held[~over], marks[marks[UNTIL] > now]
        if not len(held) and not len(marks):
            if state.exists:
                state.remove()
            return
        state.update((_packed(held, held_schema) if len(held) else None, _packed(marks, mark_schema) if len(marks) else None))
        if hold_ms is not None:
            first = int(min(t[UNTIL].min() for t in (held, marks) if len(t)))
            if event_time is None:
                state.setTimeoutDuration(max(1, first - now))
            else:
                state.setTimeoutTimestamp(first)

    usable = stream.where(stream[key].isNotNull() & stream[place].isNotNull())
    kind = "NoTimeout" if hold_ms is None else "ProcessingTimeTimeout" if event_time is None else "EventTimeTimeout"
    return usable.withColumn("_lot", F.pmod(F.xxhash64(key), F.lit(LOTS))).groupBy("_lot").applyInPandasWithState(step, out_schema, state_schema, "append", kind)
