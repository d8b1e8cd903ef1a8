"""Reading and writing tables with explicit schemas."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PREDICTION_LOG = "logged_at string, date string, venue string, race_no int, combo string, rank_prob int, prob double, prob_pct double, odds double, expected_return_yen double, is_selected int, model_name string"
RESULT_LOG = "logged_at string, date string, venue string, race_no int, actual_combo string, payout double, source string"


def parquet(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_csv(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """CSV with a header, a byte-order mark allowed; the schema is always given."""
    return spark.read.schema(schema).option("header", True).option("encoding", "UTF-8").option("enforceSchema", True).csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.select(*sorted(df.columns)).write.mode("overwrite").option("header", True).csv(path)


def write_union(tables: list[DataFrame], path: str) -> None:
    """Rows of several tables as one CSV with the union of their columns, absent ones empty."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    write_csv(out, path)


def write_report(report: DataFrame, path: str) -> None:
    """A report of a few rows as one JSON-lines file."""
    report.coalesce(1).write.mode("overwrite").json(path)


def save_model(model, features: list[str], labels: list[str], path: str, spark: SparkSession) -> None:
    """A fitted pipeline with its features and labels beside it."""
    model.write().overwrite().save(f"{path}/model")
    spark.createDataFrame([(features, labels)], "features array<string>, labels array<string>").coalesce(1).write.mode("overwrite").json(f"{path}/meta")


def append_log(df: DataFrame, path: str) -> None:
    """Append to a date-partitioned log."""
    df.write.mode("append").partitionBy("date").parquet(path)


def read_json(path: str, default: object = None) -> object:
    """A small configuration file; the default if it is missing or broken."""
    try:
        return json.loads(Path(path).read_text(encoding="utf-8"))
    except (OSError, ValueError):
        return default


def require(df: DataFrame, columns: list[str]) -> DataFrame:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def first_alias(df: DataFrame, aliases: dict[str, list[str]]) -> DataFrame:
    """Rename the first present alias of each wanted name."""
    for name, others in aliases.items():
        if name not in df.columns:
            found = next((o for o in others if o in df.columns), None)
            if found:
                df = df.withColumnRenamed(found, name)
    return df


def one_row_a_key(df: DataFrame, keys: list[str]) -> DataFrame:
    """df, failing at run time if a key occurs twice."""
    bad = df.groupBy(*keys).count().where("count > 1").limit(1).count()
    if bad:
        raise ValueError(f"keys {keys} are not unique")
    return df


def quality_gate(df: DataFrame) -> DataFrame:
    """Counts of rows, labelled rows, unknown venues and zero codes."""
    return df.agg(F.count("*").alias("total"), F.sum(F.col("combo").rlike("^[1-6]-[1-6]-[1-6]$").cast("long")).alias("labelled"), F.sum((F.col("venue") == "UNKNOWN").cast("long")).alias("unknown"), F.sum((F.col("venue_code") == "00").cast("long")).alias("zero_code"))
