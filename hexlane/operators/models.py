"""Trained scorers from pyspark.ml behind the same columns as the linear one, and the inference of feature groups."""

from __future__ import annotations

import re

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import race_boosting
from .scoring import softmax

# fixed values: group and what a feature's name must hold; the first that fits counts
GROUPS = (
    ("motor", "motor"), ("boat", "boat"), ("exhibit", "exhibit"), ("st", r"_st$|avg_st|_st_"), ("win_rate", "win_rate"), ("place_rate", "place_rate|quinella|two_rate"),
    ("grade", "grade"), ("ability", "ability"), ("course_fit", "course|lane_fit"), ("weather", "weather|wind|wave"), ("lane", "lane"),
)


def feature_group(name: str) -> str:
    return next((group for group, pattern in GROUPS if re.search(pattern, name)), "other")


def train_binary(rows: DataFrame, features: list[str] | race_boosting.Lanes, label: str = "is_hit", hit_weight: float = 10.0, trees: int = 20, depth: int = 4) -> PipelineModel | race_boosting.Trees:
    """Boosted trees on hit or miss, hits weighted. Label columns must not be among the features.

    With features of lanes, rows are races, label is the class that won, and the same kind of trees is grown without 120 rows a race.
    """
    if isinstance(features, race_boosting.Lanes):
        return race_boosting.fit(rows, features, label, hit_weight, trees, depth)
    rows = rows.withColumn("_w", F.when(F.col(label) == 1, hit_weight).otherwise(1.0)).withColumn("_y", F.col(label).cast("double"))
    boost = GBTClassifier(labelCol="_y", featuresCol="_x", weightCol="_w", maxIter=trees, maxDepth=depth, seed=7)
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="_x", handleInvalid="keep"), boost]).fit(rows)


def train_classes(races: DataFrame, features: list[str], label: str = "y_class", trees: int = 60, depth: int = 10) -> PipelineModel:
    """A forest on the winning class. Labels are indexed first: raw ones of 100 and more are refused."""
    index = StringIndexer(inputCol=label, outputCol="_y", handleInvalid="skip")
    forest = RandomForestClassifier(labelCol="_y", featuresCol="_x", numTrees=trees, maxDepth=depth, minInstancesPerNode=10, seed=7)
    return Pipeline(stages=[index, VectorAssembler(inputCols=features, outputCol="_x", handleInvalid="keep"), forest]).fit(races)


def score_binary(model: PipelineModel, rows: DataFrame, temperature: float = 0.9) -> DataFrame:
    """rows with score (raw margin) and prob (in-race softmax)."""
    out = model.transform(rows.withColumn("_w", F.lit(1.0)).withColumn("_y", F.lit(0.0)))
    out = out.withColumn("score", vector_to_array("rawPrediction")[1]).drop("rawPrediction", "probability", "prediction", "_x", "_w", "_y")
    return softmax(out, temperature=temperature)


def class_probabilities(model: PipelineModel, races: DataFrame) -> DataFrame:
    """race, class_id, prob: each of the forest's classes by its own label; classes it never saw are absent."""
    labels = model.stages[0].labels
    p = model.transform(races).select("race", F.posexplode(vector_to_array("probability")).alias("_i", "prob"))
    return p.select("race", F.element_at(F.array(*[F.lit(int(float(x))) for x in labels]), F.col("_i") + 1).alias("class_id"), "prob")
