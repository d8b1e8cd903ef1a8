"""Feature families of races and outcomes. Race statistics are computed once a race, before the 120-fold expansion."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..dims import LANES
from ..sources.panel import at, expand

ROLES = {"first": "a", "second": "b", "third": "c"}
PAIRS = (("f_s", "a", "b"), ("f_t", "a", "c"), ("s_t", "b", "c"))


def values(metric: str) -> Column:
    return F.col(metric)


def total(items: list[Column]) -> Column:
    out = items[0].cast("double")
    for x in items[1:]:
        out = out + x
    return out


def lanes(array: Column, start: int = 1, n: int = 6) -> list[Column]:
    return [F.element_at(array, F.lit(i)) for i in range(start, start + n)]


def mean(items: list[Column] | Column) -> Column:
    items = lanes(items) if isinstance(items, Column) else items
    return total(items) / len(items)


def std(items: list[Column] | Column, sample: bool = False) -> Column:
    items = lanes(items) if isinstance(items, Column) else items
    m = mean(items)
    return F.sqrt(total([(x - m) * (x - m) for x in items]) / (len(items) - sample))


def rank_in(array: Column, lane: Column | str, falling: bool) -> Column:
    """Place of a lane's value, 1 to 6, ties to the lower lane."""
    lane = F.col(lane) if isinstance(lane, str) else lane
    mine = F.element_at(array, lane)
    ahead = F.filter(array, lambda x, i: ((x > mine) if falling else (x < mine)) | ((x == mine) & (i + 1 < lane)))
    return (F.size(ahead) + 1).cast("int")


def structure(df: DataFrame) -> DataFrame:
    """Fourteen columns of the outcome's own shape."""
    a, b, c = (F.col(x) for x in "abc")
    among = lambda low, high: sum(x.between(low, high).cast("int") for x in (b, c)) + a.between(low, high).cast("int")
    return df.select(
        "race", "class_id", a.alias("combo_first"), b.alias("combo_second"), c.alias("combo_third"), (a + b + c).alias("combo_sum"),
        (F.greatest(a, b, c) - F.least(a, b, c)).alias("combo_range"), F.round((a + b + c) / 3, 6).alias("combo_mean"),
        among(1, 2).alias("combo_inside"), among(3, 4).alias("combo_center"), among(5, 6).alias("combo_outside"),
        ((a < b) & (b < c)).cast("int").alias("combo_forward"), ((a > b) & (b > c)).cast("int").alias("combo_reverse"),
        a.isin(1, 2).cast("int").alias("combo_first_inner"), b.isin(1, 2, 3).cast("int").alias("combo_second_inner"), c.isin(4, 5, 6).cast("int").alias("combo_third_outer"),
    )


def labels(df: DataFrame) -> DataFrame:
    """Winning combo, hit flags, and whether the first one or two lanes are right."""
    winner, runner_up, third = F.col("w1"), F.col("w2"), F.col("w3")
    first = (F.col("a") == winner).cast("int")
    second = (F.col("b") == runner_up).cast("int")
    hit = (F.col("class_id") == F.col("y_class")).cast("int")
    return df.select("race", "class_id", F.concat_ws("-", winner, runner_up, third).alias("y_combo"), F.coalesce("y_class", F.lit(-1)).alias("y_class"), hit.alias("is_hit"), (first * (1 - second)).alias("first_only_hit"), (first * second).alias("first2_hit"))


def race_stats(wide: DataFrame, metrics: tuple[str, ...], sides: tuple[str, ...]) -> DataFrame:
    """Mean and population deviation of metrics, inner and outer lane means, and moves from lane to course."""
    cols = []
    for m in metrics:
        cols += [mean(values(m)).alias(f"mean_{m}"), std(values(m)).alias(f"std_{m}")]
    for m in sides:
        cols += [mean(lanes(values(m), 1, 3)).alias(f"inside_{m}"), mean(lanes(values(m), 4, 3)).alias(f"outside_{m}")]
    moves = sum((F.abs(F.element_at("course", F.lit(i)) - i) for i in LANES[1:]), F.abs(F.element_at("course", F.lit(1)) - 1))
    return wide.select("race", *cols, moves.alias("course_moves"), (moves / 6.0).alias("course_move_mean"))


def relative(runners: DataFrame, metrics: tuple[str, ...]) -> DataFrame:
    """rel_<metric>: a runner's value less the race's mean; z_<metric>: over the sample deviation, 0 where that is 0."""
    from .scoring import by_race

    cols = []
    for m in metrics:
        gap = F.col(m) - F.avg(m).over(by_race())
        spread = F.stddev_samp(F.col(m).cast("double")).over(by_race())
        cols += [gap.alias(f"rel_{m}"), F.when(spread > 0, F.try_divide(gap, spread)).otherwise(0.0).alias(f"z_{m}")]
    return runners.select("race", "lane", *cols)


def with_race_means(wide: DataFrame, metrics: tuple[str, ...], spread: bool = False) -> DataFrame:
    """mean_<metric>, and where asked spread_<metric> (sample deviation), once a race."""
    cols = [mean(values(m)).alias(f"mean_{m}") for m in metrics] + [std(values(m), sample=True).alias(f"spread_{m}") for m in metrics if spread]
    return wide.select("*", *cols)


def with_means(wide: DataFrame, metrics: tuple[str, ...], spread: bool = False) -> DataFrame:
    """with_race_means, then the race's 120 outcomes."""
    return expand(with_race_means(wide, metrics, spread))


def main_roles(wide: DataFrame, metrics: tuple[str, ...], falling: dict[str, bool]) -> DataFrame:
    """Base value, rank and deviation of each role's runner."""
    cols = []
    for role, lane in ROLES.items():
        for m in metrics:
            cols += [at(lane, m).cast("double").alias(f"{role}_{m}"), (at(lane, m) - F.col(f"mean_{m}")).alias(f"{role}_rel_{m}")]
        for m in falling:
            cols.append(at(lane, f"rank_{m}").alias(f"{role}_rank_{m}"))
    ranks = [F.array(*[rank_in(values(m), F.lit(i), down) for i in LANES]).alias(f"rank_{m}") for m, down in falling.items()]
    return with_means(wide.select("*", *ranks), metrics).select("race", "class_id", *cols)


def main_pairs(wide: DataFrame, metrics: tuple[str, ...]) -> DataFrame:
    """Sums, means and deviations over the three, pairwise differences, differences from the field, and strict flags."""
    cols = []
    for m in metrics:
        three = [at(lane, m) for lane in "abc"]
        s = three[0] + three[1] + three[2]
        cols += [s.alias(f"top3_{m}_sum"), (s / 3.0).alias(f"top3_{m}_mean"), std(three).alias(f"top3_{m}_std")]
        cols += [(at(x, m) - at(y, m)).alias(f"{name}_{m}_diff") for name, x, y in PAIRS]
        cols += [(at(lane, m) - F.col(f"mean_{m}")).alias(f"{role}_{m}_vs_field") for role, lane in ROLES.items()]
    for name, x, y in PAIRS:
        cols.append((at(x, "win_rate") > at(y, "win_rate")).cast("int").alias(f"{name}_stronger"))
    for role, lane in ROLES.items():
        others = [o for o in "abc" if o != lane]
        for m, flag in (("st", "fastest_st"), ("exhibit", "best_exhibit")):
            cols.append(((at(lane, m) < at(others[0], m)) & (at(lane, m) < at(others[1], m))).cast("int").alias(f"{role}_{flag}"))
    moves = sum((F.abs(at(x, "course") - F.col(x)) for x in "bc"), F.abs(at("a", "course") - F.col("a")))
    return with_means(wide, metrics).select("race", "class_id", *cols, moves.alias("course_move_top3"))


def triple_parts(metric: str) -> dict[str, tuple[Callable[..., Column], str, bool]]:
    """Sum, mean, extremes, range and differences of the three, and their mean against the race's and the other three's: each as a
    function of lanes, the places of these, and whether their order doesn't matter."""
    of = lambda x: at(x, metric).cast("double")
    total3 = lambda x, y, z: of(x) + of(y) + of(z)
    high, low = (lambda x, y, z: F.greatest(of(x), of(y), of(z))), (lambda x, y, z: F.least(of(x), of(y), of(z)))
    field, spread = F.col(f"mean_{metric}"), F.col(f"spread_{metric}")
    gap = lambda *x: total3(*x) / 3.0 - field
    all3 = {"sum": total3, "mean": lambda *x: total3(*x) / 3.0, "max": high, "min": low, "range": lambda *x: high(*x) - low(*x)}
    out = {n: (f, "abc", True) for n, f in all3.items()}
    diff, apart = (lambda x, y: of(x) - of(y)), (lambda x, y: F.abs(of(x) - of(y)))
    for name, pair in (("first_second", "ab"), ("first_third", "ac"), ("second_third", "bc")):
        out |= {f"diff_{name}": (diff, pair, False), f"absdiff_{name}": (apart, pair, True)}
    z = lambda *x: F.when(spread > 1e-12, F.try_divide(gap(*x), spread)).otherwise(0.0)
    return out | {"vs_race_diff": (gap, "abc", True), "vs_race_z": (z, "abc", True), "vs_others_diff": (lambda *x: total3(*x) / 3.0 - (field * 6 - total3(*x)) / 3.0, "abc", True)}


def triple_of(metric: str) -> dict[str, Column]:
    """triple_parts of an outcome's row."""
    return {n: f(*[F.col(x) for x in places]) for n, (f, places, _) in triple_parts(metric).items()}


def v3_block(wide: DataFrame, metric: str) -> DataFrame:
    return with_means(wide, (metric,), spread=True).select("race", "class_id", *[c.alias(name) for name, c in triple_of(metric).items()])


# fixed values: the weights and bounds of the formulas below
def v3_scores(combos: DataFrame) -> DataFrame:
    """Push of the first, follow of the other two, and how level the three are."""
    ex, st = mean(values("exhibit")), mean(values("st"))
    g = lambda lane, m: at(lane, m)
    push = g("a", "motor") * 0.2 + g("a", "boat") * 0.1 + (ex - g("a", "exhibit")) * 3 + (st - g("a", "st")) * 3 + (6 - g("a", "course")) * 0.1
    follow = (
        (g("b", "motor") + g("c", "motor")) * 0.15 + (g("b", "boat") + g("c", "boat")) * 0.10
        + ((ex - g("b", "exhibit")) + (ex - g("c", "exhibit"))) * 2.5 + ((st - g("b", "st")) + (st - g("c", "st"))) * 2.5
        + ((6 - g("b", "course")) + (6 - g("c", "course"))) * 0.15
    )
    level = F.lit(0.0)
    for m in ("exhibit", "st"):
        for _, x, y in PAIRS:
            level = level + F.abs(g(x, m) - g(y, m))
    return combos.select("race", "class_id", push.alias("push"), follow.alias("follow"), level.alias("balance"))


# fixed values: the weights and bounds of the formulas below
def v2_scores(combos: DataFrame) -> DataFrame:
    """Strength, push and follow with falling metrics turned round; place_rate stands for ability where there is none."""
    three = lambda m: (at("a", m) + at("b", m) + at("c", m)) / 3.0
    lead = lambda m: (mean(values(m)) * 6 - three(m) * 3) / 3.0 - three(m)
    strength = three("place_rate") * 0.35 + three("win_rate") * 0.20 + three("place_rate") * 0.15 + three("motor") * 0.10 + three("boat") * 0.05 + lead("exhibit") * 0.75 + lead("st") * 0.75
    f = lambda m: at("a", m)
    gap = lambda lane, m: mean(values(m)) - at(lane, m)
    push = f("place_rate") * 0.35 + f("win_rate") * 0.20 + f("place_rate") * 0.10 + f("motor") * 0.10 + f("boat") * 0.05 + gap("a", "st") + gap("a", "exhibit")
    follow = at("b", "place_rate") * 0.30 + at("c", "place_rate") * 0.25 + at("b", "win_rate") * 0.20 + at("c", "win_rate") * 0.15 + gap("b", "st") * 0.5 + gap("c", "st") * 0.5
    return combos.select("race", "class_id", strength.alias("strength"), push.alias("push"), follow.alias("follow"))


# fixed values: the weights and bounds of the formulas below
def inverted_st(lane: Column | str) -> Column:
    return F.least(F.greatest(0.3 - at(lane, "st"), F.lit(-1.0)), F.lit(1.0))


def inverted_exhibit(lane: Column | str) -> Column:
    return F.least(F.greatest(7.5 - at(lane, "exhibit"), F.lit(-2.0)), F.lit(2.0))


def binary_lanes(races: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """What binary_block takes of each lane, as arrays by lane on the race's row: an outcome's columns are of its lanes, or differences."""
    by_lane = {"st_inv": inverted_st, "exhibit_inv": inverted_exhibit, "course_diff": lambda x: (at(x, "course") - x).cast("int").cast("double"), "motor": lambda x: at(x, "motor").cast("double"), "boat": lambda x: at(x, "boat").cast("double")}
    return races.select("race", *keep, *[F.array(*[f(F.lit(i)) for i in LANES]).alias(name) for name, f in by_lane.items()])


def binary_block(combos: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Inverted timings, course move, picks by role and four differences; columns to keep stand before them."""
    inv_st, inv_ex = inverted_st, inverted_exhibit
    cols = []
    for role, lane in ROLES.items():
        cols += [inv_st(lane).alias(f"{role}_st_inv"), inv_ex(lane).alias(f"{role}_exhibit_inv"), (at(lane, "course") - F.col(lane)).cast("int").alias(f"{role}_course_diff"), at(lane, "motor").alias(f"{role}_motor"), at(lane, "boat").alias(f"{role}_boat")]
    cols += [(inv_st("a") - inv_st("b")).alias("fs_st_inv"), (inv_ex("a") - inv_ex("b")).alias("fs_exhibit_inv"), (at("a", "motor") - at("b", "motor")).alias("fs_motor"), (at("a", "boat") - at("b", "boat")).alias("fs_boat")]
    return combos.select("race", "class_id", *keep, *cols)


# fixed values: lane advantage and inner bias by lane
ADVANTAGE, BIAS = (3.0, 2.0, 1.0, 0.0, -1.0, -2.0), (1.0, 0.8, 0.55, 0.25, 0.1, 0.0)


def pack_powers(combos: DataFrame) -> DataFrame:
    """Linear lane powers of the three, their differences and shares, and whether the first is the best of the three (ties count)."""
    by_lane = lambda table, lane: F.element_at(F.array(*map(F.lit, table)), F.col(lane))
    power = lambda x: by_lane(ADVANTAGE, x) * 1.8 + at(x, "win_rate") * 0.55 + at(x, "place_rate") * 0.08 - at(x, "st") * 6.0 - at(x, "exhibit") * 0.8
    head = lambda x: by_lane(BIAS, x) * 1.3 + at(x, "win_rate") * 0.45 + at(x, "place_rate") * 0.08 + at(x, "motor") * 0.015 - at(x, "st") * 2.8 - at(x, "exhibit") * 0.6
    cols = []
    for role, lane in ROLES.items():
        cols += [power(lane).alias(f"{role}_lane_power"), head(lane).alias(f"{role}_head_score")]
    cols += [(power(x) - power(y)).alias(f"{name}_power_diff") for name, x, y in PAIRS]
    s = at("a", "win_rate") + at("b", "win_rate") + at("c", "win_rate")
    cols += [F.when(F.abs(s) < 1e-12, 0.0).otherwise(F.try_divide(at(x, "win_rate"), s)).alias(f"{role}_share") for role, x in ROLES.items()]
    cols.append((at("a", "win_rate") >= F.greatest(at("b", "win_rate"), at("c", "win_rate"))).cast("int").alias("head_best_win_rate"))
    cols.append((at("a", "st") <= F.least(at("b", "st"), at("c", "st"))).cast("int").alias("head_best_st"))
    return combos.select("race", "class_id", *cols)


def render_block(combos: DataFrame) -> DataFrame:
    """In-race shared ranks of the first runner, gaps to lane 1 and between inner and outer lanes, smaller-is-better turned round."""
    shared = lambda m, down: (F.size(F.filter(values(m), lambda v: (v > at("a", m)) if down else (v < at("a", m)))) + 1).cast("int")
    cols = [shared("win_rate", True).alias("first_rank_win_rate"), shared("st", False).alias("first_rank_st"), shared("exhibit", False).alias("first_rank_exhibit")]
    cols += [(at(F.lit(lane), "win_rate") - at(F.lit(1), "win_rate")).alias(f"gap{lane}_win_rate") for lane in LANES if lane > 1]
    cols += [(at(F.lit(1), "st") - at(F.lit(lane), "st")).alias(f"gap{lane}_st") for lane in LANES if lane > 1]
    cols += [(mean(lanes(values(m), 1, 3)) - mean(lanes(values(m), 4, 3))).alias(f"inout_{m}") for m in ("win_rate", "motor")]
    return combos.select("race", "class_id", *cols)


# fixed values: columns that tell the result, by exact name, prefix and ending
LEAKS, LEAK_PREFIXES, LEAK_ENDINGS = frozenset(("y", "is_hit", "trifecta", "finish", "rank", "result", "order")), ("y_", "first_only_hit", "first2_hit", "trifecta_", "payout"), ("_finish", "_payout", "_hit")


def without_leaks(df: DataFrame) -> DataFrame:
    """Columns that don't tell the result; names are matched whole or anchored, so ability_index stays."""
    return df.select(*[c for c in df.columns if c not in LEAKS and not c.startswith(LEAK_PREFIXES) and not c.endswith(LEAK_ENDINGS)])
