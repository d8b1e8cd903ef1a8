from __future__ import annotations

from hexlane.operators import models
from hexlane.plans import learned, registry


def test_forest_gives_each_class_by_its_label(spark, sf):
    df = learned.rows(spark, sf).cache()
    model = models.train_classes(df, learned.FEATURES, trees=3, depth=3)
    got = models.class_probabilities(model, df).collect()
    seen = {r.y_class for r in df.select("y_class").distinct().collect()}
    assert {r.class_id for r in got} == seen
    raw = {r.race: r.probability for r in model.transform(df).select("race", "probability").collect()}
    labels = [int(float(x)) for x in model.stages[0].labels]
    assert all(abs(r.prob - raw[r.race][labels.index(r.class_id)]) < 1e-12 for r in got)


def test_learned_queries(spark, sf):
    forest = registry.QUERIES["forest_outcomes"](spark, sf).toPandas()
    assert len(forest) and (forest.total - 1).abs().max() < 1e-5
    won = registry.QUERIES["boosted_winner"](spark, sf).toPandas().set_index("part")
    assert won.loc["train", "loss"] < won.loc["train", "prior_loss"] and set(won.index) == {"train", "valid", "test"}
    audit = registry.QUERIES["feature_audit"](spark, sf).toPandas().set_index("feature_group")
    assert audit.loc["none", "loss_more"] == 0 and audit.features.sum() == len(learned.FEATURES) and abs(audit.gain_share.sum() - 1) < 1e-5
