"""Searches over settings against one run a setting."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from hexlane.operators import search, selection
from hexlane.plans import base


def test_settings_resolve_as_the_table_does(spark):
    for overlay in ([], selection.TUNED, *search.ranged_settings(4)[1:]):
        want = {r.venue: tuple(r)[1:] for r in selection.settings(spark, overlay).select("venue", *selection.FIELDS).collect()}
        assert search.resolved(overlay) == want


def test_drawn_settings_keep_their_ranges():
    draws = search.ranged_settings(30)
    assert draws == search.ranged_settings(30) and draws[0] == []
    for rows in draws[1:]:
        for venue, min_prob, odds_cap, _, w_prob, w_ev, w_odds, *_, low, high in rows:
            r = search.RANGES[venue]
            assert r["min_prob"][0] <= min_prob <= r["min_prob"][1] and r["odds_cap"][0] <= odds_cap <= r["odds_cap"][1]
            assert abs(w_prob + w_ev + w_odds - 1) < 1e-9 and low <= high and r["points"][0] <= low <= r["points"][1] and high <= r["points"][4]
    weights = search.drawn_weights(10)
    assert all(abs(sum(w) - 1) < 1e-9 and 0.02 <= ratio <= 0.12 for t in weights for ratio, w in t.values())


def test_choices_are_those_of_the_selection(spark, sf):
    df = base.valued(spark, sf).cache()
    odds = F.col("odds")
    steps = selection.zone_bonus(odds) * selection.high_penalty(odds) * selection.low_penalty(odds)
    columns = {c: F.col(c) for c in ("prob", "odds", "ev")} | {"steps": steps, "factor": selection.point_factor()}
    table = search.race_arrays(df, columns).toArrow()
    batch = table.combine_chunks().to_batches()[0]
    races, venues = batch.column(0).to_pylist(), batch.column(1).to_pylist()
    for overlay in (selection.TUNED, search.ranged_settings(3)[2]):
        own = search.resolved(overlay)
        rank, _ = search.Races(batch).chosen(np.array([own.get(v, own["default"]) for v in venues], float))
        got = {(races[i], int(c), int(rank[i, c])) for i, c in zip(*np.nonzero(rank), strict=True)}
        assert got == {(r.race, r.class_id, r["rank"]) for r in selection.best_bets(df, selection.settings(spark, overlay)).collect()}


def test_setting_scores_are_those_of_single_runs(spark, sf):
    df = base.valued(spark, sf).cache()
    overlays = selection.drawn_settings(3)
    got = {r.trial: r for r in search.setting_scores(search.setting_trials(df, overlays), "trial").collect()}
    for i, overlay in enumerate(overlays):
        want = selection.setting_score(df, selection.best_bets(df, selection.settings(spark, overlay))).first()
        assert all(abs(got[i][c] - want[c]) < 1e-9 for c in ("races", "hits", "hit_rate", "avg_points", "roi", "top1", "top3", "top5", "score"))
    best = {r.venue: r for r in search.best_settings(search.setting_trials(df, overlays)).collect()}
    scores = search.setting_scores(search.setting_trials(df, overlays), "trial", "venue").collect()
    for venue, r in best.items():
        own = {s.trial: s.score for s in scores if s.venue == venue}
        assert r.best_trial == min(own, key=lambda t: (-own[t], t)) and r.score >= r.base_score == own[0]


def race_rows(prices):
    """Two races of 120 outcomes: the first without a price, the second with few."""
    rows = [(1, "99", c, 1 / 120, None, None, int(c == 3), 100) for c in range(120)]
    rows += [(2, "99", c, 0.5 / (c + 1), prices.get(c), prices[c] * 0.5 / (c + 1) if c in prices else None, int(c == 0), 250) for c in range(120)]
    return rows + [(3, "99", 0, 1.0, 2.0, 2.0, 1, 200)]  # an incomplete race


def test_races_without_prices_and_incomplete_races(spark):
    schema = "race long, venue string, class_id int, prob double, odds double, ev double, is_hit int, payout long"
    df = spark.createDataFrame(race_rows({0: 2.5, 5: 30.0}), schema)
    (r,) = search.setting_trials(df, [[]]).collect()
    assert (r.races, r.n, r.hits, r.back, r.top1) == (1, 2, 1, 250.0, 1)
    assert search.setting_trials(df.where("race = 9"), [[]]).collect() == []


def test_weight_trials_against_plain_loops(spark):
    rng = np.random.default_rng(5)
    data, plain = [], {}
    for race, venue in ((1, "15"), (2, "02"), (3, "77"), (4, "15")):
        p = rng.random(120)
        sums = rng.normal(size=(120, 12)).round(2)
        plain[race] = (venue, p / p.sum(), sums, race * 7)
        data += [(race, venue, c, int(c == race * 7 and race != 4), float(p[c] / p.sum()), *map(float, sums[c])) for c in range(120)]
    df = spark.createDataFrame(data, "race long, venue string, class_id int, is_hit int, prob double, " + ", ".join(f"sum_{g} double" for g in search.WEIGHT_GROUPS))
    settings = search.drawn_weights(7)
    got = {(r.trial, r.venue): (r.races, r.top1, r.top3, r.top5) for r in search.weight_trials(df, settings).collect()}
    want = {}
    for t, s in enumerate(settings):
        for race, (venue, p, sums, hit) in plain.items():
            ratio, w = s.get(venue, s[""])
            score = sums @ np.array(w)
            e = np.exp(score - score.max())
            blend = (1 - ratio) * p + ratio * e / e.sum()
            rank = sorted(range(120), key=lambda c: (-round(blend[c] / blend.sum(), 12), c)).index(hit)
            own = want.setdefault((t, venue), [0, 0, 0, 0])
            own[0] += 1
            for i, k in enumerate((1, 3, 5)):
                own[i + 1] += int(rank < k and race != 4)
    assert got == {k: tuple(v) for k, v in want.items()}
    best = search.best_weights(search.weight_trials(df, settings), 3).collect()
    assert len(best) == 3 and [r.score for r in best] == sorted((r.score for r in best), reverse=True)


def test_group_sums_by_name(spark):
    block = spark.createDataFrame([(2.0, 3.0, None, 5.0, 7)], "a_motor double, a_exhibit double, x_st double, first_boat double, odd int")
    row = block.select(*search.group_sums(block, block.columns)).first()
    assert row.sum_motor == 2 and row.sum_exhibit == -3 and row.sum_st == 0 and row.sum_boat == -5 and row.sum_other == 7


def test_weight_search_joins_no_outcomes(spark, sf):
    """The scored rows carry their features: only lines with orders, and races with the 120 outcomes; before, five joins."""
    from hexlane.plans import registry

    plan = registry.QUERIES["weight_search"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 2


def test_order_keys_and_orders_that_no_setting_changes():
    """ranks is the order by four keys that sorting them one by one gives."""
    rng = np.random.default_rng(5)
    n, many = 40, search.OUTCOMES
    values = {"prob": rng.integers(1, 5, (n, many)) / 100.0, "odds": rng.integers(5, 9, (n, many)) * 1.0, "ev": rng.integers(1, 3, (n, many)) / 2.0, "steps": np.ones((n, many)), "factor": np.ones((n, many))}
    offsets = pa.array(np.arange(n + 1) * many, pa.int32())
    races = search.Races(pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(offsets, pa.array(v.ravel())) for v in values.values()], list(values)))
    own, score = rng.random((n, many)) < 0.7, rng.integers(0, 4, (n, many)) / 3.0
    order = np.lexsort((-races.ev, -np.round(races.prob, 9), -np.round(score, 9), ~own), axis=1)
    plain = np.argsort(order, axis=1)
    assert (races.ranks(own, score) == plain)[own].all()
    assert not hasattr(races, "by")
