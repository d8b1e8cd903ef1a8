"""Trained models of many classes and audits of their features; iterative, so without SQL (tests compare with plain versions)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..cluster import written
from ..dims import LANES, class_id
from ..operators import boosting, models, reports
from .base import query, races, rounded

METRICS = ("win_rate", "place_rate", "st", "exhibit", "motor", "course")
FEATURES = [f"lane{i}_{m}" for i in LANES for m in METRICS]
SMALL = boosting.Params(rounds=6, rate=0.3, depth=3, bins=16)


def rows(spark, d):
    """One row a race: features by lane, the winner's lane w1, the winning class and the part (train, valid, test) by time."""
    wide = races(spark, d)
    wide = wide.select("race", "date", "w1", class_id(F.col("w1"), F.col("w2"), F.col("w3")).alias("y_class"), *[F.element_at(m, i).cast("double").alias(f"lane{i}_{m}") for i in LANES for m in METRICS])
    wide = reports.share_split(written(wide, "races"))  # which counts the races by date before it goes over them
    return wide.select("race", "date", "part", "w1", "y_class", *FEATURES)


@query("boosted_winner")
def boosted_winner(spark, d):
    """The winner's lane by boosted trees of six classes, trained on the earlier races: loss and hits of each part, and the loss of the class shares alone."""
    df = rows(spark, d).cache()
    model = boosting.fit(df.where("part = 'train'"), FEATURES, "w1", "race", SMALL)
    prior = boosting.Boosted(model.features, model.edges, model.classes, model.base, model.depth)
    plain = boosting.evaluate(prior, df, "w1", ["part"]).select("part", F.col("loss").alias("prior_loss"))
    return rounded(boosting.evaluate(model, df, "w1", ["part"]).join(plain, "part"))


@query("boosted_outcomes")
def boosted_outcomes(spark, d):
    """Probabilities of all 120 outcomes by boosted trees of 120 classes, ranked: hits by part."""
    df = rows(spark, d).cache()
    model = boosting.fit(df.where("part = 'train'"), FEATURES, "y_class", "race", boosting.Params(rounds=3, rate=0.3, depth=3, bins=16))
    return rounded(boosting.evaluate(model, df, "y_class", ["part"]))


@query("forest_outcomes")
def forest_outcomes(spark, d):
    """A forest on the winning class, its classes gathered back to outcomes by label: races, sum of probabilities and outcomes known."""
    df = rows(spark, d).cache()
    model = models.train_classes(df.where("part = 'train'"), FEATURES, trees=10, depth=5)
    p = models.class_probabilities(model, df.where("part = 'test'"))
    by_race = p.groupBy("race").agg(F.sum("prob").alias("total"), F.count("*").alias("classes"), F.max_by("class_id", F.struct("prob", -F.col("class_id"))).alias("first_class"))
    return rounded(by_race)


@query("feature_groups")
def feature_groups(spark, d):
    """Importance by inferred feature group of a trained model: gains of its splits."""
    model = boosting.fit(rows(spark, d).where("part = 'train'"), FEATURES, "w1", "race", SMALL)
    gains = boosting.gain_importance(spark, model)
    return rounded(gains.groupBy(F.col("feature_group").alias("grp")).agg(F.sum("share").alias("total"), F.avg("share").alias("mean"), F.count("*").alias("n")))


@query("feature_audit")
def feature_audit(spark, d):
    """What a trained model loses on later races when a group of features is permuted among races, beside the gains of the group's splits."""
    df = rows(spark, d).cache()
    model = boosting.fit(df.where("part = 'train'"), FEATURES, "w1", "race", SMALL)
    moved = boosting.permutation_importance(model, df.where("part <> 'train'"), "w1", "race")
    gains = boosting.gain_importance(spark, model).groupBy("feature_group").agg(F.sum("share").alias("gain_share"))
    return rounded(moved.join(F.broadcast(gains), "feature_group", "left"))


@query("feature_variants")
def feature_variants(spark, d):
    """Two models, with and without the start timings, compared on the parts by time."""
    kinds = {"all": FEATURES, "without_st": [c for c in FEATURES if models.feature_group(c) != "st"]}
    return rounded(boosting.variants(rows(spark, d).cache(), "part", kinds, "w1", "race", boosting.Params(rounds=3, rate=0.3, depth=3, bins=16)))
