"""Feature families as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import features, reports
from .base import COMBOS, RUNNERS, combos, query, races, rd, rounded, runners

METRICS = ("win_rate", "place_rate", "st", "exhibit", "motor", "boat", "course")
SIDES = ("exhibit", "st", "win_rate")
FALLING = {"win_rate": True, "place_rate": True, "st": False, "exhibit": False, "motor": True}
ROLES = {"first": "a", "second": "b", "third": "c"}
PAIRS = (("f_s", "a", "b"), ("f_t", "a", "c"), ("s_t", "b", "c"))


def s_mean(m: str) -> str:
    return f"list_sum({m}) / 6.0"


def s_std(m: str, n: int = 6, less: int = 0) -> str:
    return f"sqrt(list_sum(list_transform({m}, lambda x: (x - list_sum({m}) / {n}.0) * (x - list_sum({m}) / {n}.0))) / {n - less}.0)"


@query("combo_structure", COMBOS + f""" SELECT race, class_id, a AS combo_first, b AS combo_second, c AS combo_third, a + b + c AS combo_sum, greatest(a, b, c) - least(a, b, c) AS combo_range,
  round((a + b + c) / 3.0::DOUBLE, 6) AS combo_mean, {', '.join(f"CAST(a BETWEEN {lo} AND {hi} AS INTEGER) + CAST(b BETWEEN {lo} AND {hi} AS INTEGER) + CAST(c BETWEEN {lo} AND {hi} AS INTEGER) AS combo_{n}" for n, lo, hi in (("inside", 1, 2), ("center", 3, 4), ("outside", 5, 6)))},
  CAST(a < b AND b < c AS INTEGER) AS combo_forward, CAST(a > b AND b > c AS INTEGER) AS combo_reverse, CAST(a <= 2 AS INTEGER) AS combo_first_inner, CAST(b <= 3 AS INTEGER) AS combo_second_inner, CAST(c >= 4 AS INTEGER) AS combo_third_outer FROM combos""")
def combo_structure(spark, d):
    return features.structure(combos(spark, d))


@query("label_block", COMBOS + """ , y AS (SELECT w1, w2, w3, class_id AS y_class FROM races JOIN outcomes ON a = w1 AND b = w2 AND c = w3 GROUP BY ALL)
SELECT race, class_id, w1 || '-' || w2 || '-' || w3 AS y_combo, y_class, CAST(class_id = y_class AS INTEGER) AS is_hit, CAST(a = w1 AND b <> w2 AS INTEGER) AS first_only_hit, CAST(a = w1 AND b = w2 AS INTEGER) AS first2_hit
FROM combos JOIN y USING (w1, w2, w3)""")
def label_block(spark, d):
    return features.labels(combos(spark, d))


@query("race_stats", COMBOS + " SELECT race, " + ", ".join(f"{rd(s_mean(m), f'mean_{m}')}, {rd(s_std(m), f'std_{m}')}" for m in METRICS) + ", " + ", ".join(f"{rd(f'list_sum({m}[1:3]) / 3.0', f'inside_{m}')}, {rd(f'list_sum({m}[4:6]) / 3.0', f'outside_{m}')}" for m in SIDES) + f", CAST({' + '.join(f'abs(course[{i}] - {i})' for i in range(1, 7))} AS INTEGER) AS course_moves, {rd('(' + ' + '.join(f'abs(course[{i}] - {i})' for i in range(1, 7)) + ') / 6.0', 'course_move_mean')} FROM races")
def race_stats(spark, d):
    return rounded(features.race_stats(races(spark, d), METRICS, SIDES))


@query("lane_ranks", RUNNERS + " SELECT race, lane, " + ", ".join(f"CAST(row_number() OVER (PARTITION BY race ORDER BY {m} {'DESC' if down else 'ASC'}, lane) AS INTEGER) AS rank_{m}" for m, down in FALLING.items()) + " FROM runners")
def lane_ranks(spark, d):
    return reports.field_ranks(runners(spark, d), FALLING).select("race", "lane", *[f"rank_{m}" for m in FALLING])


@query("rel_features", RUNNERS + " SELECT race, lane, " + ", ".join(f"{rd(f'{m} - avg({m}) OVER w', f'rel_{m}')}, {rd(f'CASE WHEN stddev_samp({m}) OVER w > 1e-9 THEN ({m} - avg({m}) OVER w) / (stddev_samp({m}) OVER w) ELSE 0.0 END', f'z_{m}')}" for m in ("win_rate", "st", "motor")) + " FROM runners WINDOW w AS (PARTITION BY race)")
def rel_features(spark, d):
    return rounded(features.relative(runners(spark, d), ("win_rate", "st", "motor")))


def s_rank(m: str, lane: str, down: bool) -> str:
    sign = ">" if down else "<"
    return f"CAST(1 + len(list_filter(range(1, 7), lambda i: {m}[i] {sign} {m}[{lane}] OR ({m}[i] = {m}[{lane}] AND i < {lane}))) AS INTEGER)"


@query("main_first_second_third", COMBOS + " SELECT race, class_id, " + ", ".join([f"{rd(f'{m}[{x}]', f'{r}_{m}')}, {rd(f'{m}[{x}] - {s_mean(m)}', f'{r}_rel_{m}')}" for r, x in ROLES.items() for m in ("win_rate", "place_rate", "st", "exhibit")] + [f"{s_rank(m, x, down)} AS {r}_rank_{m}" for r, x in ROLES.items() for m, down in (("win_rate", True), ("st", False))]) + " FROM combos")
def main_first_second_third(spark, d):
    return rounded(features.main_roles(races(spark, d), ("win_rate", "place_rate", "st", "exhibit"), {"win_rate": True, "st": False}))


_FLAGS = [f"CAST(win_rate[{x}] > win_rate[{y}] AS INTEGER) AS {n}_stronger" for n, x, y in PAIRS] + [
    f"CAST({m}[{x}] < {m}[{o[0]}] AND {m}[{x}] < {m}[{o[1]}] AS INTEGER) AS {r}_{f}" for r, x in ROLES.items() for o in [[y for y in "abc" if y != x]] for m, f in (("st", "fastest_st"), ("exhibit", "best_exhibit"))
]


@query("main_diffs_flags", COMBOS + " SELECT race, class_id, " + ", ".join([", ".join([rd(f"{m}[a] + {m}[b] + {m}[c]", f"top3_{m}_sum"), rd(f"({m}[a] + {m}[b] + {m}[c]) / 3.0", f"top3_{m}_mean"), rd(s_std(f"[{m}[a], {m}[b], {m}[c]]", 3), f"top3_{m}_std"), *[rd(f"{m}[{x}] - {m}[{y}]", f"{n}_{m}_diff") for n, x, y in PAIRS], *[rd(f"{m}[{x}] - {s_mean(m)}", f"{r}_{m}_vs_field") for r, x in ROLES.items()]]) for m in ("win_rate", "st")] + _FLAGS) + ", CAST(abs(course[a] - a) + abs(course[b] - b) + abs(course[c] - c) AS INTEGER) AS course_move_top3 FROM combos")
def main_diffs_flags(spark, d):
    return rounded(features.main_pairs(races(spark, d), ("win_rate", "st")))


def s_v3(m: str) -> str:
    s, x = f"({m}[a] + {m}[b] + {m}[c])", {"first": f"{m}[a]", "second": f"{m}[b]", "third": f"{m}[c]"}
    hi, lo = f"greatest({', '.join(x.values())})", f"least({', '.join(x.values())})"
    cols = [rd(s, "sum"), rd(f"{s} / 3.0", "mean"), rd(hi, "max"), rd(lo, "min"), rd(f"{hi} - {lo}", "range")]
    for p, q in (("first", "second"), ("first", "third"), ("second", "third")):
        cols += [rd(f"{x[p]} - {x[q]}", f"diff_{p}_{q}"), rd(f"abs({x[p]} - {x[q]})", f"absdiff_{p}_{q}")]
    gap = f"({s} / 3.0 - {s_mean(m)})"
    cols += [rd(gap, "vs_race_diff"), rd(f"CASE WHEN {s_std(m, 6, 1)} > 1e-12 THEN {gap} / {s_std(m, 6, 1)} ELSE 0.0 END", "vs_race_z"), rd(f"{s} / 3.0 - (list_sum({m}) - {s}) / 3.0", "vs_others_diff")]
    return COMBOS + f" SELECT race, class_id, {', '.join(cols)} FROM combos"


@query("v3_block_exhibit", s_v3("exhibit"))
def v3_block_exhibit(spark, d):
    return rounded(features.v3_block(races(spark, d), "exhibit"))


@query("v3_block_motor", s_v3("motor"))
def v3_block_motor(spark, d):
    return rounded(features.v3_block(races(spark, d), "motor"))


EX, ST = s_mean("exhibit"), s_mean("st")


@query("v3_scores", COMBOS + f""" SELECT race, class_id, {rd(f'motor[a] * 0.2 + boat[a] * 0.1 + ({EX} - exhibit[a]) * 3 + ({ST} - st[a]) * 3 + (6 - course[a]) * 0.1', 'push')},
  {rd(f'(motor[b] + motor[c]) * 0.15 + (boat[b] + boat[c]) * 0.10 + (({EX} - exhibit[b]) + ({EX} - exhibit[c])) * 2.5 + (({ST} - st[b]) + ({ST} - st[c])) * 2.5 + ((6 - course[b]) + (6 - course[c])) * 0.15', 'follow')},
  {rd(' + '.join(f'abs({m}[{x}] - {m}[{y}])' for m in ('exhibit', 'st') for _, x, y in PAIRS), 'balance')} FROM combos""")
def v3_scores(spark, d):
    return rounded(features.v3_scores(combos(spark, d)))


def s_three(m: str) -> str:
    return f"(({m}[a] + {m}[b] + {m}[c]) / 3.0)"


def s_lead(m: str) -> str:
    return f"(({s_mean(m)} * 6 - {s_three(m)} * 3) / 3.0 - {s_three(m)})"


@query("v2_scores", COMBOS + f""" SELECT race, class_id, {rd(f"{s_three('place_rate')} * 0.35 + {s_three('win_rate')} * 0.20 + {s_three('place_rate')} * 0.15 + {s_three('motor')} * 0.10 + {s_three('boat')} * 0.05 + {s_lead('exhibit')} * 0.75 + {s_lead('st')} * 0.75", 'strength')},
  {rd(f'place_rate[a] * 0.35 + win_rate[a] * 0.20 + place_rate[a] * 0.10 + motor[a] * 0.10 + boat[a] * 0.05 + ({ST} - st[a]) + ({EX} - exhibit[a])', 'push')},
  {rd(f'place_rate[b] * 0.30 + place_rate[c] * 0.25 + win_rate[b] * 0.20 + win_rate[c] * 0.15 + ({ST} - st[b]) * 0.5 + ({ST} - st[c]) * 0.5', 'follow')} FROM combos""")
def v2_scores(spark, d):
    return rounded(features.v2_scores(combos(spark, d)))


def s_inv(m: str, x: str) -> str:
    return f"least(greatest(0.3 - st[{x}], -1.0), 1.0)" if m == "st" else f"least(greatest(7.5 - exhibit[{x}], -2.0), 2.0)"


@query("binary_block", COMBOS + " SELECT race, class_id, " + ", ".join(f"{rd(s_inv('st', x), f'{r}_st_inv')}, {rd(s_inv('exhibit', x), f'{r}_exhibit_inv')}, CAST(course[{x}] - {x} AS INTEGER) AS {r}_course_diff, CAST(motor[{x}] AS INTEGER) AS {r}_motor, CAST(boat[{x}] AS INTEGER) AS {r}_boat" for r, x in ROLES.items()) + f", {rd(s_inv('st', 'a') + ' - ' + s_inv('st', 'b'), 'fs_st_inv')}, {rd(s_inv('exhibit', 'a') + ' - ' + s_inv('exhibit', 'b'), 'fs_exhibit_inv')}, CAST(motor[a] - motor[b] AS INTEGER) AS fs_motor, CAST(boat[a] - boat[b] AS INTEGER) AS fs_boat FROM combos")
def binary_block(spark, d):
    return rounded(features.binary_block(combos(spark, d)))


ADV, BIAS = f"({list(features.ADVANTAGE)}::DOUBLE[])", f"({list(features.BIAS)}::DOUBLE[])"


def s_power(x: str) -> str:
    return f"({ADV}[{x}] * 1.8 + win_rate[{x}] * 0.55 + place_rate[{x}] * 0.08 - st[{x}] * 6.0 - exhibit[{x}] * 0.8)"


def s_head(x: str) -> str:
    return f"({BIAS}[{x}] * 1.3 + win_rate[{x}] * 0.45 + place_rate[{x}] * 0.08 + motor[{x}] * 0.015 - st[{x}] * 2.8 - exhibit[{x}] * 0.6)"


@query("pack_powers", COMBOS + " SELECT race, class_id, " + ", ".join(f"{rd(s_power(x), f'{r}_lane_power')}, {rd(s_head(x), f'{r}_head_score')}, {rd(f'CASE WHEN abs(win_rate[a] + win_rate[b] + win_rate[c]) < 1e-12 THEN 0.0 ELSE win_rate[{x}] / (win_rate[a] + win_rate[b] + win_rate[c]) END', f'{r}_share')}" for r, x in ROLES.items()) + ", " + ", ".join(rd(f"{s_power(x)} - {s_power(y)}", f"{n}_power_diff") for n, x, y in PAIRS) + ", CAST(win_rate[a] >= greatest(win_rate[b], win_rate[c]) AS INTEGER) AS head_best_win_rate, CAST(st[a] <= least(st[b], st[c]) AS INTEGER) AS head_best_st FROM combos")
def pack_powers(spark, d):
    return rounded(features.pack_powers(combos(spark, d)))


@query("render_block", COMBOS + " SELECT race, class_id, " + ", ".join(f"CAST(1 + len(list_filter({m}, lambda v: v {s} {m}[a])) AS INTEGER) AS first_rank_{m}" for m, s in (("win_rate", ">"), ("st", "<"), ("exhibit", "<"))) + ", " + ", ".join(f"{rd(f'win_rate[{i}] - win_rate[1]', f'gap{i}_win_rate')}, {rd(f'st[1] - st[{i}]', f'gap{i}_st')}" for i in range(2, 7)) + ", " + ", ".join(rd(f"list_sum({m}[1:3]) / 3.0 - list_sum({m}[4:6]) / 3.0", f"inout_{m}") for m in ("win_rate", "motor")) + " FROM combos")
def render_block(spark, d):
    return rounded(features.render_block(combos(spark, d)))


@query("without_leaks", COMBOS + " SELECT race, class_id, 1 AS ability_index FROM combos")
def without_leaks(spark, d):
    """A feature table without label columns; ability_index stays."""
    df = features.labels(combos(spark, d)).withColumn("ability_index", F.lit(1)).withColumn("lane1_finish", F.lit(0)).withColumn("trifecta_payout", F.lit(0))
    return features.without_leaks(df)
