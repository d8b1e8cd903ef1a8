from __future__ import annotations

from hexlane.operators import models
from hexlane.plans import registry


def test_training_rows_need_no_join_of_outcomes(spark, sf, monkeypatch):
    """The rows of the 120 outcomes carry their race's columns; joined with themselves they went through two exchanges."""
    plans = []
    fit = models.train_binary
    monkeypatch.setattr(models, "train_binary", lambda rows, *a, **k: (plans.append(rows._jdf.queryExecution().optimizedPlan().toString()), fit(rows, *a, **k))[1])
    assert registry.QUERIES["trained_topk"](spark, sf).count() > 0
    assert plans[0].count("Relation [") == 2  # lineitem and orders, once each
