"""Parsing stages of scraped pages; fetching is left to whoever fills the table of pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..dims import outcomes
from ..functions.scalars import narrow

# fixed values: entities replaced in cleaned text
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))


def clean(html: Column) -> Column:
    """Text without tags, with the common entities and single spaces."""
    out = F.regexp_replace(html, "<[^>]*>", "")
    for name, char in ENTITIES:
        out = F.replace(out, F.lit(name), F.lit(char))
    return F.trim(F.regexp_replace(out, r"[ \t\n\r\f]+", " "))


def odds_cells(pages: DataFrame, pattern: str) -> DataFrame:
    """page_id, class_id, cell: the pattern's matches in page order laid on the fixed order of outcomes; '' where they run out, surplus dropped."""
    cells = pages.select("page_id", F.regexp_extract_all("html", F.lit(pattern), F.lit(1)).alias("cells"))
    dims = outcomes(pages.sparkSession).select("class_id", "fixed_pos")
    return cells.crossJoin(F.broadcast(dims)).select("page_id", "class_id", F.coalesce(F.get("cells", F.col("fixed_pos")), F.lit("")).alias("cell"))


def entry(text: Column) -> list[Column]:
    """lane, racer_no, grade, F and L counts, win_rate (first decimal in 2.5..10.5), quinella (first in 10..100) of an entry line."""
    t = narrow(text)
    numbers = F.transform(F.regexp_extract_all(t, F.lit(r"\d+\.\d+"), F.lit(0)), lambda x: x.cast("double"))
    got = lambda p: F.regexp_extract(t, p, 1)
    return [
        got(r"^\s*([1-6])\b").try_cast("int").alias("lane"), got(r"\b(\d{4})\b").try_cast("int").alias("racer_no"), F.nullif(got(r"\b([AB][12])\b"), F.lit("")).alias("grade"),
        F.coalesce(got(r"F(\d)").try_cast("int"), F.lit(0)).alias("f_count"), F.coalesce(got(r"L(\d)").try_cast("int"), F.lit(0)).alias("l_count"),
        F.get(F.filter(numbers, lambda x: x.between(2.5, 10.5)), F.lit(0)).alias("win_rate"), F.get(F.filter(numbers, lambda x: x.between(10.0, 100.0)), F.lit(0)).alias("quinella"),
    ]


# fixed values: the numbers of a statistics line, in order
STATISTICS = ("avg_st", "nat_win", "nat_2", "nat_3", "loc_win", "loc_2", "loc_3", "motor_no", "motor_2", "motor_3", "boat_no", "boat_2", "boat_3")


def statistics(text: Column) -> list[Column]:
    """The thirteen numbers of the first statistics line in a text; '-' is null, and all are where there is no such line."""
    pattern = r"\s+".join(r"(\d{1,3}|-)" if n.endswith("_no") else r"(\d+\.\d+|-)" for n in STATISTICS)
    return [F.regexp_extract(narrow(text), pattern, i).try_cast("double").alias(n) for i, n in enumerate(STATISTICS, start=1)]


def best_table(tables: DataFrame) -> DataFrame:
    """The table (page_id, table_no, lane, racer_no rows) with most distinct lanes, then lane rows, then ids; the earlier on ties."""
    score = tables.groupBy("page_id", "table_no").agg(F.countDistinct("lane").alias("u"), F.count("lane").alias("n"), F.count("racer_no").alias("i"))
    best = score.groupBy("page_id").agg(F.max_by("table_no", F.struct("u", "n", "i", (-F.col("table_no")).alias("t"))).alias("table_no"))
    return tables.join(best, ["page_id", "table_no"], "left_semi")


def first_by_lane(rows: DataFrame) -> DataFrame:
    """One row a lane, the first."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy("page_id", "lane").orderBy("pos"))).where("_r = 1").drop("_r")


def prerace(text: Column) -> list[Column]:
    """weather, wind_dir, wind_speed, wave of a page's text; absent is null."""
    t = narrow(text)
    number = lambda p: F.nullif(F.regexp_extract(t, p, 1), F.lit("")).try_cast("double")
    return [
        F.nullif(F.regexp_extract(t, r"天候\s*(晴れ|晴|曇り|くもり|曇|雨|雪|霧)", 1), F.lit("")).alias("weather"),
        F.nullif(F.regexp_extract(t, r"風向\s*(無風|北東|北西|南東|南西|北|東|南|西)", 1), F.lit("")).alias("wind_dir"),
        number(r"風速\s*(\d+(?:\.\d+)?)\s*m").alias("wind_speed"), number(r"波高\s*(\d+(?:\.\d+)?)\s*cm").alias("wave"),
    ]


def archive_plan(spark, start: str, end: str, url: str) -> DataFrame:
    """day, file, url: a row a day of the archives to fetch. url may hold {yyyymm} and {yymmdd}."""
    days = spark.sql(f"SELECT explode(sequence(date'{start}', date'{end}', interval 1 day)) AS day")
    put = lambda name, form, c: F.replace(c, F.lit("{" + name + "}"), F.date_format("day", form))
    return days.select("day", F.concat(F.lit("k"), F.date_format("day", "yyMMdd"), F.lit(".lzh")).alias("file"), put("yymmdd", "yyMMdd", put("yyyymm", "yyyyMM", F.lit(url))).alias("url"))
