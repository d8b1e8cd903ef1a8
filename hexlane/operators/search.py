"""Searches over many settings in one pass: each race comes once, as arrays of its 120 outcomes, and all settings are tried on it.

The scored table is computed and shuffled once however many settings there are; a task holds a few races times all settings, and
gives counters alone: one row a setting and venue.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..cluster import ship
from ..dims import OUTCOMES
from . import selection
from .models import feature_group

FEW_RACES = 64

# fixed values: share of the manual score and weights by group, in the order of WEIGHT_GROUPS, by venue ("" any other)
WEIGHT_GROUPS = ("lane", "motor", "boat", "st", "exhibit", "win_rate", "place_rate", "grade", "ability", "course_fit", "weather", "other")
BASE_WEIGHTS = {
    "": (0.08, (0.23, 0.09, 0.05, 0.02, 0.05, 0.10, 0.10, 0.03, 0.10, 0.18, 0.01, 0.04)),
    "15": (0.08, (0.26, 0.08, 0.04, 0.02, 0.05, 0.10, 0.09, 0.03, 0.09, 0.19, 0.01, 0.04)),
    "16": (0.08, (0.18, 0.10, 0.06, 0.03, 0.07, 0.10, 0.10, 0.03, 0.11, 0.15, 0.03, 0.04)),
    "02": (0.08, (0.21, 0.09, 0.05, 0.03, 0.06, 0.10, 0.10, 0.03, 0.10, 0.17, 0.02, 0.04)),
}
RATIO_SPREAD, WEIGHT_SPREAD, LEAST_RATIO, MOST_RATIO = 0.4, 0.4, 0.02, 0.12
# fixed values: what hits among the first one, three and five count
TOP_SCORE = {1: 3.0, 3: 1.0, 5: 0.4}


def race_arrays(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """race, venue and one array a column in order of class_id, of races with all 120 outcomes."""
    rows = F.array_sort(F.collect_list(F.struct("class_id", *[c.alias(n) for n, c in columns.items()])))
    out = df.groupBy("race", "venue").agg(rows.alias("_o")).where(F.size("_o") == OUTCOMES)
    return out.select("race", "venue", *[F.col(f"_o.{n}").alias(n) for n in columns])


def block_of(batch: pa.RecordBatch, name: str) -> np.ndarray:
    """races x 120 doubles, null as nan."""
    return batch.column(batch.schema.get_field_index(name)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, OUTCOMES)


def pieces(batches: Iterator[pa.RecordBatch], size: int = FEW_RACES) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(0, b.num_rows, size):
            yield b.slice(i, size)


# weights of feature groups


def drawn_weights(trials: int, seed: int = 42) -> list[dict[str, tuple[float, tuple[float, ...]]]]:
    """By trial and venue: the share and the weights (of WEIGHT_GROUPS), each drawn within a share of its base, weights summing to 1."""
    rng, out = random.Random(seed), []
    for _ in range(trials):
        trial = {}
        for venue, (ratio, weights) in BASE_WEIGHTS.items():
            low, high = max(LEAST_RATIO, ratio * (1 - RATIO_SPREAD)), min(MOST_RATIO, ratio * (1 + RATIO_SPREAD))
            drawn = [rng.uniform(max(0.001, w * (1 - WEIGHT_SPREAD)), max(0.001, w * (1 + WEIGHT_SPREAD))) for w in weights]
            trial[venue] = (rng.uniform(low, max(low, high)), tuple(w / sum(drawn) for w in drawn))
        out.append(trial)
    return out


def falls(name: str) -> bool:
    """Whether less of a column is better, by its name alone (so first_ counts as falling, as in the source)."""
    return "st" in name.lower() or "exhibit" in name.lower()


def group_sums(block: DataFrame, features: list[str]) -> list[Column]:
    """One column a group of WEIGHT_GROUPS: the sum of its features, falling ones negative, missing ones 0."""
    out = []
    for g in WEIGHT_GROUPS:
        total = F.lit(0.0)
        for c in features:
            if feature_group(c) == g:
                value = F.coalesce(F.col(c).cast("double"), F.lit(0.0))
                total = total + (-value if falls(c) else value)
        out.append(total.alias(f"sum_{g}"))
    return out


def weight_trials(df: DataFrame, settings: list[dict[str, tuple[float, tuple[float, ...]]]]) -> DataFrame:
    """trial, venue, races, top1, top3, top5 (counts) for df with race, venue, class_id, is_hit, prob and the group sums.

    A trial's score of an outcome is the dot product of its weights with the group sums; its softmax in the race is blended into
    prob. Ranks are by the blend rounded to 12 digits, ties to the lesser class. Races without a hit count with no hit.
    """
    ship(df.sparkSession)
    n, names = len(settings), [f"sum_{g}" for g in WEIGHT_GROUPS]
    venues = sorted({v for s in settings for v in s})
    weights = {v: np.array([s.get(v, s[""])[1] for s in settings]).T for v in venues}
    ratios = {v: np.array([s.get(v, s[""])[0] for s in settings]) for v in venues}

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for b in pieces(batches):
            venue = np.array(b.column(b.schema.get_field_index("venue")).to_pylist(), object)
            prob, hit = block_of(b, "prob"), block_of(b, "is_hit") == 1
            sums = np.stack([block_of(b, c) for c in names], axis=2)
            for v in set(venue.tolist()):
                at = np.flatnonzero(venue == v)
                key = v if v in weights else ""
                score = sums[at] @ weights[key]  # races x 120 x trials
                e = np.exp(score - score.max(axis=1, keepdims=True))
                blend = (1 - ratios[key]) * prob[at][:, :, None] + ratios[key] * e / e.sum(axis=1, keepdims=True)
                blend = np.round(blend / blend.sum(axis=1, keepdims=True), 12)
                some, own = hit[at].any(axis=1), hit[at].argmax(axis=1)
                mine = blend[np.arange(len(at)), own][:, None, :]
                earlier = (np.arange(OUTCOMES) < own[:, None])[:, :, None]
                better = ((blend > mine) | ((blend == mine) & earlier)).sum(axis=1)
                counts = total.setdefault(v, np.zeros((4, n), np.int64))
                counts[0] += len(at)
                for i, t in enumerate(TOP_SCORE):
                    counts[i + 1] += ((better < t) & some[:, None]).sum(axis=0)
        for v, counts in total.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(n, dtype=np.int32)), pa.array([v] * n, pa.string()), *map(pa.array, counts)], ["trial", "venue", "races", *[f"top{t}" for t in TOP_SCORE]])

    arrays = race_arrays(df, {c: F.col(c) for c in ("prob", "is_hit", *names)})
    got = arrays.mapInArrow(task, "trial int, venue string, races long, " + ", ".join(f"top{t} long" for t in TOP_SCORE))
    return got.groupBy("trial", "venue").agg(*[F.sum(c).alias(c) for c in ("races", *[f"top{t}" for t in TOP_SCORE])])


def best_weights(trials: DataFrame, count: int = 20) -> DataFrame:
    """trial, races, rates and score over all venues, the best first."""
    out = trials.groupBy("trial").agg(*[F.sum(c).alias(c) for c in ("races", *[f"top{t}" for t in TOP_SCORE])])
    out = out.select("trial", "races", *[(F.col(f"top{t}") / F.col("races")).alias(f"top{t}") for t in TOP_SCORE])
    score = sum((F.col(f"top{t}") * w for t, w in TOP_SCORE.items()), F.lit(0.0))
    return out.withColumn("score", score).orderBy(F.desc("score"), "trial").limit(count)


# settings of the selection


# fixed values: by venue, from and to and digits of each number of a setting, least numbers of points, and how far the most may go
RANGES = {
    "15": {"min_prob": (0.016, 0.030, 4), "prob_exp": (1.20, 1.70, 3), "ev_exp": (0.60, 0.90, 3), "w_prob": (0.55, 0.78, 3), "w_ev": (0.10, 0.28, 3), "odds_cap": (35, 70, 1), "ev_cap": (1.8, 3.0, 2), "base_bonus": (0.58, 0.72, 3), "points": (3, 5, 0, 5, 8), "least_odds": 0.05},
    "02": {"min_prob": (0.011, 0.024, 4), "prob_exp": (1.00, 1.40, 3), "ev_exp": (0.70, 1.00, 3), "w_prob": (0.45, 0.68, 3), "w_ev": (0.18, 0.34, 3), "odds_cap": (50, 110, 1), "ev_cap": (2.0, 3.8, 2), "base_bonus": (0.55, 0.68, 3), "points": (4, 7, 1, 6, 10), "least_odds": 0.08},
    "16": {"min_prob": (0.012, 0.024, 4), "prob_exp": (1.05, 1.50, 3), "ev_exp": (0.70, 0.98, 3), "w_prob": (0.48, 0.70, 3), "w_ev": (0.16, 0.34, 3), "odds_cap": (40, 95, 1), "ev_cap": (2.0, 3.5, 2), "base_bonus": (0.58, 0.70, 3), "points": (4, 6, 1, 7, 11), "least_odds": 0.05},
}


def ranged_settings(trials: int, seed: int = 42) -> list[list[tuple]]:
    """Overlays of settings: none first (the base), then each venue's numbers drawn from its ranges, weights summing to 1."""
    rng, out = random.Random(seed), [[]]
    for _ in range(1, trials):
        rows = []
        for venue, r in RANGES.items():
            d = {name: round(rng.uniform(low, high), digits) for name, (low, high, digits) in ((k, v) for k, v in r.items() if k not in ("points", "least_odds"))}
            w_odds = round(max(r["least_odds"], 1 - d["w_prob"] - d["w_ev"]), 3)
            total = d["w_prob"] + d["w_ev"] + w_odds
            w_prob, w_ev = round(d["w_prob"] / total, 3), round(d["w_ev"] / total, 3)
            low, high, more, least, most = r["points"]
            points = rng.randint(low, high)
            rows.append((venue, d["min_prob"], d["odds_cap"], d["ev_cap"], w_prob, w_ev, round(1 - w_prob - w_ev, 3), d["prob_exp"], d["ev_exp"], d["base_bonus"], points, rng.randint(max(points + more, least), most)))
        out.append(rows)
    return out


def resolved(overlay: list[tuple]) -> dict[str, tuple]:
    """What selection.settings gives for an overlay, by venue."""
    base, over = {r[0]: r[1:] for r in selection.BASE}, {r[0]: r[1:] for r in overlay}
    out = {}
    for venue in base | over:
        first, second = over.get(venue, (None,) * len(selection.FIELDS)), base.get(venue, base["default"])
        *numbers, low, high = (a if a is not None else b for a, b in zip(first, second, strict=True))
        low = min(max(low, 3), 12)
        out[venue] = (*numbers, low, max(min(max(high, 3), 12), low))
    return out


def scale(x: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Own values scaled to 0..1 in each race, 0 where all are equal."""
    low = np.where(own, x, np.inf).min(axis=1, keepdims=True)
    high = np.where(own, x, -np.inf).max(axis=1, keepdims=True)
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(high > low, (x - low) / (high - low), 0.0)


LAST = 2.0**45  # beyond any score in units of the rounding; times 120 still a whole number of doubles


class Races:
    """Races as arrays, and what of the selection doesn't depend on a setting."""

    def __init__(self, batch: pa.RecordBatch):
        self.prob, self.odds, self.ev, self.steps, self.factor = (np.nan_to_num(block_of(batch, c)) for c in ("prob", "odds", "ev", "steps", "factor"))
        self.priced = (self.odds > 0) & (self.ev > 0)
        # priced outcomes in order of probability, ties to the lesser class
        key = np.where(self.priced, -np.round(self.prob, selection.DIGITS), np.inf)
        order = np.argsort(key, axis=1, kind="stable")
        self.sorted = np.where(np.take_along_axis(self.priced, order, 1), np.take_along_axis(self.prob, order, 1), 0.0)
        # orders that no setting changes: by probability, and by probability and value, both then by class
        prob, ev = (-np.round(x, selection.DIGITS) for x in (self.prob, self.ev))
        self.by_prob = np.argsort(prob, axis=1, kind="stable")
        self.ties = np.argsort(np.lexsort((ev, prob), axis=1), axis=1)

    def points(self, m: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Number of bets of races whose first m priced outcomes are candidates."""
        p = np.where(np.arange(OUTCOMES) < m[:, None], self.sorted, 0.0)
        total = np.cumsum(p[:, :10], axis=1)
        s1, s2, s3, s5, s10 = (total[:, i] for i in (0, 1, 2, 4, 9))
        n = np.minimum(m, 10)
        with np.errstate(invalid="ignore", divide="ignore"):
            q = p[:, :10] / s10[:, None]
            h = np.where(np.arange(10) < n[:, None], -q * np.log(q + 1e-12), 0.0).sum(axis=1) / np.log(n + 1e-12)
        entropy = np.clip(np.where((n == 0) | (s10 <= 0), 1.0, np.where(n == 1, 0.0, h)), 0.0, 1.0)
        short = lambda limit, have, w: (limit - np.minimum(have, limit)) / limit * w
        gap = np.maximum(0.0, s1 - (s2 - s1))
        need = short(0.12, s1, 0.42) + short(0.24, s3, 0.22) + short(0.36, s5, 0.14) + short(0.03, gap, 0.08) + entropy * 0.28
        need = np.clip(need * self.factor[:, 0], 0.0, 1.0)
        k = (low + np.rint((high - low) * need)).astype(np.int64)
        k = np.where((s1 >= 0.10) & (s3 >= 0.23), np.minimum(k, 3), np.where((s1 >= 0.08) & (s5 >= 0.34), np.minimum(k, np.maximum(4, low)), k))
        k = np.where((entropy >= 0.88) & (s1 <= 0.05), np.minimum(high, k + 1), k)
        return np.clip(k, 3, 12).astype(np.int64)

    def chosen(self, c: np.ndarray, top_n: int = 12) -> tuple[np.ndarray, np.ndarray]:
        """(races x 120 ranks from 1, 0 for what isn't chosen; scores) under the settings of each race (races x FIELDS)."""
        min_prob, odds_cap, ev_cap, w_prob, w_ev, w_odds, prob_exp, ev_exp, bonus = (c[:, i : i + 1] for i in range(9))
        likely = self.priced & (self.prob >= min_prob)
        own = np.where(likely.any(axis=1, keepdims=True), likely, self.priced)
        pn, en, on = scale(self.prob, own), scale(np.minimum(self.ev, ev_cap), own), scale(np.minimum(self.odds, odds_cap), own)
        buy = np.maximum(pn, 1e-9) ** prob_exp * np.maximum(en, 1e-9) ** ev_exp * (bonus + w_prob * pn + w_ev * en + w_odds * on) * self.steps
        m = own.sum(axis=1)
        n = np.clip(np.minimum(top_n, self.points(m, c[:, 9], c[:, 10])), 3, 12)
        picked = own & (self.ranks(own, buy) < n[:, None])
        have = picked.sum(axis=1)
        spare = ~picked & (self.odds > 0) & (have > 0)[:, None]
        place = np.empty_like(self.by_prob)
        np.put_along_axis(place, self.by_prob, np.cumsum(np.take_along_axis(spare, self.by_prob, 1), axis=1) - 1, 1)
        fill = spare & (place < (n - have)[:, None])
        score = np.where(fill, self.prob, buy)
        taken = picked | fill
        return np.where(taken, self.ranks(taken, score) + 1, 0), score

    def ranks(self, own: np.ndarray, score: np.ndarray) -> np.ndarray:
        """Place from 0 of own outcomes by rounded score, probability and value, then class; others after them."""
        # one whole number an outcome: its score in units of the rounding, then its place in the order that no setting changes
        key = np.where(own, -np.rint(score * 10.0**selection.DIGITS), LAST) * OUTCOMES + self.ties
        place = np.empty(key.shape, np.int64)
        np.put_along_axis(place, np.argsort(key, axis=1), np.arange(OUTCOMES)[None, :], 1)
        return place


TRIAL = "trial int, venue string, races long, n long, hits long, back double, top1 long, top3 long, top5 long"


def setting_trials(df: DataFrame, overlays: list[list[tuple]]) -> DataFrame:
    """Counters of each overlay's selection by venue, for df with race, venue, class_id, prob, odds, ev, is_hit, payout."""
    ship(df.sparkSession)
    trials = [resolved(o) for o in overlays]
    names = ["races", "n", "hits", "back", "top1", "top3", "top5"]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, str], np.ndarray] = {}
        for b in pieces(batches, 512):
            venue = b.column(b.schema.get_field_index("venue")).to_pylist()
            races, hit, payout = Races(b), block_of(b, "is_hit") == 1, np.nan_to_num(block_of(b, "payout"))
            kinds = sorted(set(venue), key=str)
            at = np.array([kinds.index(v) for v in venue])
            for t, by_venue in enumerate(trials):
                rank, _ = races.chosen(np.array([by_venue.get(v, by_venue["default"]) for v in venue], float))
                won = (rank > 0) & hit
                n = (rank > 0).sum(axis=1)
                first = np.where(won, rank, 999).min(axis=1)
                # in each race: has bets, bets, hits, return, best rank of a hit among the first 1, 3, 5
                columns = np.stack([n > 0, n, won.sum(axis=1), np.where(won, payout, 0).sum(axis=1), first <= 1, first <= 3, first <= 5], axis=1).astype(float)
                for i, v in enumerate(kinds):
                    total[t, v] = total.get((t, v), 0.0) + columns[at == i].sum(axis=0)
        if total:
            rows = np.stack(list(total.values()))
            yield pa.RecordBatch.from_arrays(
                [pa.array([t for t, _ in total], pa.int32()), pa.array([v for _, v in total], pa.string()), *[pa.array(rows[:, i] if c == "back" else rows[:, i].astype(np.int64)) for i, c in enumerate(names)]],
                ["trial", "venue", *names],
            )

    odds = F.col("odds")
    steps = selection.zone_bonus(odds) * selection.high_penalty(odds) * selection.low_penalty(odds)
    columns = {c: F.col(c) for c in ("prob", "odds", "ev", "is_hit", "payout")} | {"steps": steps, "factor": selection.point_factor()}
    got = race_arrays(df, columns).mapInArrow(task, TRIAL)
    return got.groupBy("trial", "venue").agg(*[F.sum(c).alias(c) for c in names])


def setting_scores(trials: DataFrame, *by: str) -> DataFrame:
    """by, races with bets, hits, rates, return on stakes and the weighted score."""
    sums = trials.groupBy(*by).agg(*[F.sum(c).alias(c) for c in ("races", "n", "hits", "back", "top1", "top3", "top5")])
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))
    out = sums.select(*by, "races", "hits", share("hits", "races").alias("hit_rate"), share("n", "races").alias("avg_points"), (share("back", "n") / 100.0).alias("roi"), *[share(f"top{t}", "races").alias(f"top{t}") for t in (1, 3, 5)])
    return selection.with_score(out)


def best_settings(trials: DataFrame) -> DataFrame:
    """For each venue its best trial by score (ties to the first drawn, so the base stays unless one is better), with the base's score."""
    scores = setting_scores(trials, "trial", "venue")
    best = scores.groupBy("venue").agg(F.max_by("trial", F.struct("score", -F.col("trial"))).alias("best_trial"), F.max("score").alias("score"), F.max(F.when(F.col("trial") == 0, F.col("score"))).alias("base_score"), F.count("*").alias("trials"))
    return best
