"""Searches over many settings, each in one pass over the scored races."""

from __future__ import annotations

from ..operators import search, selection
from ..operators.features import binary_block
from .base import VALUED, query, rd, rounded, scored, valued
from .decisions import bets_sql
from .features import ROLES, s_inv

TRIALS, FEW = 20, 3
WEIGHT_TRIALS, FEW_WEIGHTS = 120, 6


def sql_score(of: str, keys: str) -> str:
    """Scores of the counters of `of` (races, n, hits, back, top1, top3, top5), grouped by keys."""
    rates = f"SELECT {keys}, sum(races) AS races, sum(hits) AS hits, coalesce(sum(hits) / nullif(CAST(sum(races) AS DOUBLE), 0), 0.0) AS hit_rate, coalesce(sum(n) / nullif(CAST(sum(races) AS DOUBLE), 0), 0.0) AS avg_points, coalesce(sum(back) / nullif(sum(n) * 100.0::DOUBLE, 0), 0.0) AS roi, " + ", ".join(f"coalesce(sum(top{k}) / nullif(CAST(sum(races) AS DOUBLE), 0), 0.0) AS top{k}" for k in (1, 3, 5)) + f" FROM {of} GROUP BY {keys}"
    score = " + ".join(f"{w}::DOUBLE * {c}" for c, w in selection.SCORE.items()) + f" - greatest(avg_points - {selection.PENALTY_FROM}, 0.0) * {selection.PENALTY}::DOUBLE"
    return f"SELECT {keys}, CAST(races AS BIGINT) AS races, CAST(hits AS BIGINT) AS hits, " + ", ".join(rd(c, c) for c in ("hit_rate", "avg_points", "roi", "top1", "top3", "top5")) + f", {rd(score, 'score')} FROM ({rates})"


def counters_sql(trial: int, overlay: list[tuple]) -> str:
    by_race = "SELECT b.race, v.venue, count(*) AS n, sum(v.is_hit) AS hits, sum(CASE WHEN v.is_hit = 1 THEN coalesce(v.payout, 0) ELSE 0 END) AS back, min(CASE WHEN v.is_hit = 1 THEN b.rank END) AS first FROM bets b JOIN valued v ON v.race = b.race AND v.class_id = b.class_id GROUP BY b.race, v.venue"
    counts = f"SELECT {trial} AS trial, venue, count(*) AS races, sum(n) AS n, sum(hits) AS hits, sum(back) AS back, " + ", ".join(f"count(*) FILTER (WHERE first <= {k}) AS top{k}" for k in (1, 3, 5)) + f" FROM ({by_race}) GROUP BY venue"
    return f"({bets_sql(overlay)} {counts})"


def trials(spark, d, count: int):
    return search.setting_trials(valued(spark, d), search.ranged_settings(count))


@query("setting_search", "WITH t AS (" + " UNION ALL ".join(f"SELECT * FROM {counters_sql(i, o)}" for i, o in enumerate(search.ranged_settings(FEW))) + f") {sql_score('t', 'trial')}")
def setting_search(spark, d):
    """The base settings and two drawn ones, each run through the whole selection, in one pass over the races."""
    return rounded(search.setting_scores(trials(spark, d, FEW), "trial"))


@query("setting_search_best")
def setting_search_best(spark, d):
    """The best of 20 settings for each venue; its first three are those of setting_search, which has SQL."""
    return rounded(search.best_settings(trials(spark, d, TRIALS)))


@query("strategy_score", "WITH t AS (" + " UNION ALL ".join(f"SELECT * FROM {counters_sql(i, o)}" for i, o in enumerate([[], selection.TUNED])) + f") {sql_score('t', 'trial, venue')}")
def strategy_score(spark, d):
    """The base and the tuned settings by venue, scored by return, hits and number of bets."""
    return rounded(search.setting_scores(search.setting_trials(valued(spark, d), [[], selection.TUNED]), "trial", "venue"))


# columns of the binary block and their expressions in SQL
COLUMNS = {f"{r}_{n}": e for r, x in ROLES.items() for n, e in (("st_inv", s_inv("st", x)), ("exhibit_inv", s_inv("exhibit", x)), ("course_diff", f"course[{x}] - {x}"), ("motor", f"motor[{x}]"), ("boat", f"boat[{x}]"))} | {
    "fs_st_inv": f"{s_inv('st', 'a')} - {s_inv('st', 'b')}", "fs_exhibit_inv": f"{s_inv('exhibit', 'a')} - {s_inv('exhibit', 'b')}", "fs_motor": "motor[a] - motor[b]", "fs_boat": "boat[a] - boat[b]",
}


def sums_sql() -> str:
    out = []
    for g in search.WEIGHT_GROUPS:
        terms = [f"{'-' if search.falls(c) else '+'} ({e})" for c, e in COLUMNS.items() if search.feature_group(c) == g]
        out.append(f"0.0::DOUBLE {' '.join(terms)} AS sum_{g}")
    return ", ".join(out)


def weights_sql(settings: list[dict]) -> str:
    rows = ", ".join("(" + ", ".join([str(t), f"'{v}'", f"{r!r}::DOUBLE", *[f"{w!r}::DOUBLE" for w in ws]]) + ")" for t, s in enumerate(settings) for v, (r, ws) in s.items())
    dot = " + ".join(f"sum_{g} * w_{g}" for g in search.WEIGHT_GROUPS)
    return VALUED + f""" , cfg(trial, venue, ratio, {', '.join(f'w_{g}' for g in search.WEIGHT_GROUPS)}) AS (VALUES {rows}),
gs AS (SELECT race, class_id, {sums_sql()} FROM combos),
x0 AS (SELECT v.race, v.class_id, v.is_hit, v.prob, trial, ratio, {dot} AS manual FROM valued v JOIN gs USING (race, class_id) JOIN cfg ON cfg.venue = CASE WHEN v.venue IN (SELECT venue FROM cfg) THEN v.venue ELSE '' END),
x1 AS (SELECT *, exp(manual - max(manual) OVER (PARTITION BY trial, race)) AS e FROM x0),
x2 AS (SELECT *, (1 - ratio) * prob + ratio * e / sum(e) OVER (PARTITION BY trial, race) AS mixed FROM x1),
x3 AS (SELECT trial, race, is_hit, row_number() OVER (PARTITION BY trial, race ORDER BY round(mixed, 12) DESC, class_id) AS r FROM x2),
y AS (SELECT trial, count(*) AS races, {', '.join(f"avg(CAST(r <= {k} AS DOUBLE)) AS top{k}" for k in search.TOP_SCORE)} FROM x3 WHERE is_hit = 1 GROUP BY trial)
SELECT trial, races, {', '.join(rd(f'top{k}', f'top{k}') for k in search.TOP_SCORE)}, {rd(' + '.join(f'top{k} * {w}::DOUBLE' for k, w in search.TOP_SCORE.items()), 'score')} FROM y ORDER BY score DESC, trial LIMIT 20"""


def weight_settings(count: int) -> list[dict]:
    return search.drawn_weights(count)


def weighted(spark, d, count: int):
    # the scored rows keep their race's arrays, so the features need no join, and all of a race is where it was scored
    kept = ("venue", "is_hit", "prob")
    block = binary_block(scored(spark, d, ("st", "exhibit", "course", "motor", "boat")), kept)
    df = block.select("race", "class_id", *kept, *search.group_sums(block, [c for c in block.columns if c not in ("race", "class_id", *kept)]))
    return search.best_weights(search.weight_trials(df, weight_settings(count)))


@query("weight_search", weights_sql(weight_settings(FEW_WEIGHTS)))
def weight_search(spark, d):
    """Six drawn settings of group weights over the features of every race, blended into the probabilities and ranked."""
    return rounded(weighted(spark, d, FEW_WEIGHTS))


@query("weight_search_best")
def weight_search_best(spark, d):
    """The best 20 of 120 drawn settings; the first six drawn are those of weight_search, which has SQL."""
    return rounded(weighted(spark, d, WEIGHT_TRIALS))
