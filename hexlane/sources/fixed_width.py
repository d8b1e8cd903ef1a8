"""Fixed-width Shift-JIS racer records, by byte offsets.

Decoding must skip broken bytes, which the built-in decode doesn't, so the bytes of a field go through a small pandas UDF; all
cutting and scaling is built-in.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..cluster import ship

LEAST_BYTES = 198
# fixed values: first byte, length, scale (0: text)
FIELDS = {
    "racer_no": (0, 4, 1), "name": (4, 16, 0), "kana": (20, 15, 0), "branch": (35, 4, 0), "grade": (39, 2, 0), "era": (41, 1, 0),
    "birth_ymd": (42, 6, 0), "sex": (48, 1, 0), "age": (49, 2, 1), "height": (51, 3, 1), "weight": (54, 2, 1), "blood": (56, 2, 0),
    "win_rate": (58, 4, 100), "place_rate": (62, 4, 10), "avg_st": (79, 3, 100), "prev_grade": (160, 2, 0), "prev2_grade": (162, 2, 0),
    "prev3_grade": (164, 2, 0), "prev_ability_index": (166, 4, 100), "ability_index": (170, 4, 100), "year": (174, 4, 1), "season": (178, 1, 1),
    "period_from": (179, 8, 0), "period_to": (187, 8, 0), "training_term": (195, 3, 1),
}
COURSE_START, COURSE_BYTES = 82, 13
COURSE_FIELDS = {"entry_count": (0, 3, 1), "place_rate": (3, 4, 10), "avg_st": (7, 3, 100), "avg_st_rank": (10, 3, 100)}


@F.pandas_udf(T.StringType())
def sjis(raw: pd.Series) -> pd.Series:
    return raw.map(lambda b: None if b is None else bytes(b).decode("shift_jis", errors="ignore").strip(" 　"))


def field(record: Column, start: int, length: int, scale: int) -> Column:
    raw = F.substring(record, start + 1, length)
    if scale == 0:
        return sjis(raw)
    number = F.coalesce(F.trim(F.decode(raw, "ISO-8859-1")).try_cast("int"), F.lit(0))
    return number if scale == 1 else number / float(scale)


def parse_records(records: DataFrame, column: str = "record", keep: tuple[str, ...] = ()) -> DataFrame:
    """Racer rows of binary records; short ones and those without a numeric id are left out."""
    ship(records.sparkSession)
    r = F.col(column)
    rows = records.where((F.octet_length(r) >= LEAST_BYTES) & F.decode(F.substring(r, 1, 4), "ISO-8859-1").rlike(r"^\d{4}$"))
    out = [field(r, *spec).alias(name) for name, spec in FIELDS.items()]
    for course in range(1, 7):
        base = COURSE_START + (course - 1) * COURSE_BYTES
        out += [field(r, base + s, n, scale).alias(f"course{course}_{name}") for name, (s, n, scale) in COURSE_FIELDS.items()]
    return rows.select(*keep, *out, sjis(F.substring(r, -6, 6)).alias("birthplace"))


def read_racers(spark: SparkSession, path: str) -> DataFrame:
    """Racer rows of files of newline-separated records, last of an id kept by file and position."""
    files = spark.read.format("binaryFile").load(path)
    text = F.decode("content", "ISO-8859-1")  # one character a byte
    lines = files.select("path", F.posexplode(F.split(text, "\r?\n")).alias("pos", "line"))
    rows = parse_records(lines.select("path", "pos", F.encode("line", "ISO-8859-1").alias("record")), keep=("path", "pos"))
    columns = [c for c in rows.columns if c not in ("path", "pos")]
    return rows.groupBy("racer_no").agg(F.max_by(F.struct(*columns), F.struct("path", "pos")).alias("last")).select("last.*")
