"""Small fixed dimensions: 120 ordered outcomes of three of six lanes, venues, code maps and bands."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LANES = range(1, 7)
OUTCOMES = 120

# fixed values: venue codes and names of the four venues with tuned selection, 99 any other
LIVE_VENUES = {"15": "丸亀", "02": "戸田", "16": "児島", "12": "住之江"}
# fixed values: all venue codes
VENUES = {
    "01": "桐生", "02": "戸田", "03": "江戸川", "04": "平和島", "05": "多摩川", "06": "浜名湖", "07": "蒲郡", "08": "常滑",
    "09": "津", "10": "三国", "11": "びわこ", "12": "住之江", "13": "尼崎", "14": "鳴門", "15": "丸亀", "16": "児島",
    "17": "宮島", "18": "徳山", "19": "下関", "20": "若松", "21": "芦屋", "22": "福岡", "23": "唐津", "24": "大村",
}
# fixed values: grades, weather and wind codes
GRADES = {"A1": 4, "A2": 3, "B1": 2, "B2": 1}
WEATHER = {"晴": 1, "晴れ": 1, "曇": 2, "曇り": 2, "くもり": 2, "雨": 3, "雪": 4, "霧": 5}
# the weather codes of the four builders: training features, the binary model, the current race, the triple block
WEATHER_TRAIN = {"晴": 1, "晴れ": 1, "曇": 2, "曇り": 2, "くもり": 2, "雨": 3, "雪": 4}
WEATHER_MODEL = {"晴": 1, "晴れ": 1, "曇": 2, "曇り": 2, "雨": 3, "雪": 4}
WEATHER_CURRENT = {"晴": 1, "晴れ": 1, "曇": 2, "くもり": 2, "雨": 3, "雪": 4}
WEATHER_TRIPLE = {"晴れ": 1, "くもり": 2, "曇り": 2, "雨": 3, "雪": 4}
WINDS = {"無風": 0, "北": 1, "北東": 2, "東": 3, "南東": 4, "南": 5, "南西": 6, "西": 7, "北西": 8}


def outcomes(spark: SparkSession) -> DataFrame:
    """class_id, combo, a, b, c, fixed_pos: the 120 ordered triples in lexicographic order."""
    rows = [(i, f"{a}-{b}-{c}", a, b, c, i % 20 * 6 + i // 20) for i, (a, b, c) in enumerate(permutations(LANES, 3))]
    return spark.createDataFrame(rows, "class_id int, combo string, a int, b int, c int, fixed_pos int")


def class_id(a: Column, b: Column, c: Column) -> Column:
    """Position of a triple of distinct lanes among the 120: lanes passed over at each place."""
    second = b - 1 - (b > a).cast("int")
    third = c - 1 - (c > a).cast("int") - (c > b).cast("int")
    return ((a - 1) * 20 + second * 4 + third).cast("int")


def code_map(values: dict[str, int], key: Column, default: int | None = None) -> Column:
    out = F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), key)
    return out if default is None else F.coalesce(out, F.lit(default))
