"""Boosted trees on hit or miss of the 120 outcomes of a race, grown on the race's own row.

The trees are those of pyspark.ml's GBTClassifier (logistic loss, variance splits, first tree whole and the others shrunk), but
an outcome's features are numbers of one of its lanes or differences of its first two. So a race is 30 numbers of its lanes and
120 of its ordered pairs, as bins of a byte each; the 120 outcomes exist in a task alone, a batch of races at a time, where their
margins come from the trees grown so far. A level of a tree is one pass that adds up weights and residuals by node, feature and bin
(a fixed number of rows); nothing but the races is written, once. Borders of bins are quantiles over all lanes and pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..cluster import ship, written

OUTCOMES = np.array(list(permutations(range(6), 3)))
PAIRS = list(permutations(range(6), 2))
RATE, BINS = 0.1, 32


@dataclass
class Lanes:
    """metrics: names of arrays by lane that the three roles have as features; pairs: those whose differences of the first two are."""

    metrics: list[str]
    pairs: list[str]

    def places(self) -> np.ndarray:
        """For each feature (metrics by role, then pairs) and outcome, the place of its bin in a race's row."""
        m = len(self.metrics)
        roles = [i * 6 + OUTCOMES[:, r] for r in range(3) for i in range(m)]
        return np.array([*roles, *[m * 6 + j * 30 + np.arange(120) // 4 for j in range(len(self.pairs))]])

    def edges(self, races: DataFrame, bins: int) -> list[np.ndarray]:
        """Inner borders of the bins of each metric and pair."""
        shares = [i / bins for i in range(1, bins)]
        several = lambda rows, columns: rows.agg(*[F.percentile_approx(c, shares, 10_000).alias(f"q{i}") for i, c in enumerate(columns)]).first()
        lane = several(races.select(*self.metrics, F.explode(F.array(*map(F.lit, range(6)))).alias("_i")), [self.value(c, "_i") for c in self.metrics])
        pairs = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in PAIRS]))
        pair = several(races.select(*self.pairs, pairs.alias("_p")), [self.value(c, "_p.a") - self.value(c, "_p.b") for c in self.pairs])
        return [np.unique(np.array(q if q is not None else [], float)) for q in (*lane, *pair)]

    def value(self, name: str, place: str) -> Column:
        return F.get(name, F.col(place))

    def binned(self, batch: pa.RecordBatch, edges: list[np.ndarray]) -> np.ndarray:
        """Races x bins, from the arrays of a batch."""
        x = {c: batch.column(batch.schema.get_field_index(c)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, 6) for c in dict.fromkeys((*self.metrics, *self.pairs))}
        a, b = np.array(PAIRS).T
        given = [*[x[c] for c in self.metrics], *[x[c][:, a] - x[c][:, b] for c in self.pairs]]
        return np.concatenate([np.searchsorted(e, v, side="left") for e, v in zip(edges, given, strict=True)], axis=1).astype(np.uint8)


@dataclass
class Trees:
    """trees: (feature, bin, leaf) in heap order, feature -1 where a node isn't split; a row goes right where its bin is greater."""

    lanes: Lanes
    edges: list[np.ndarray]
    depth: int
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def nodes(self, feature: np.ndarray, cut: np.ndarray, bins: np.ndarray, levels: int) -> np.ndarray:
        """Races x 120: the node (from 0) of its level after so many levels."""
        places, node = self.lanes.places(), np.zeros((len(bins), 120), np.uint8)
        for level in range(levels):
            right = np.zeros(node.shape, bool)
            for n in range(1 << level):
                at = (1 << level) - 1 + n
                if feature[at] >= 0:
                    right |= (node == n) & (bins[:, places[feature[at]]] > cut[at])
            node = 2 * node + right
        return node

    def margins(self, bins: np.ndarray) -> np.ndarray:
        out = np.zeros((len(bins), 120))
        for i, (feature, cut, leaf) in enumerate(self.trees):
            out += (RATE if i else 1.0) * leaf[self.nodes(feature, cut, bins, self.depth)]
        return out


def residuals(margins: np.ndarray | None, hit: np.ndarray) -> np.ndarray:
    """What the next tree is grown on: 1 or -1 at first, then the falling gradient of the logistic loss."""
    y = np.where(hit, 1.0, -1.0)
    return y if margins is None else 4 * y / (1 + np.exp(2 * y * margins))


def sums(model: Trees, bins: np.ndarray, hit: np.ndarray, tree: tuple, level: int, hit_weight: float) -> np.ndarray:
    """nodes x features x BINS x (weight, weight * residual, rows)."""
    residual = residuals(model.margins(bins) if model.trees else None, hit)
    node, weight = model.nodes(*tree, bins, level), np.where(hit, hit_weight, 1.0)
    m, out = len(model.lanes.metrics), np.zeros((1 << level, len(model.lanes.places()), BINS, 3))
    to_lane = [np.equal.outer(OUTCOMES[:, r], np.arange(6)).astype(float) for r in range(3)]
    for n in range(1 << level):
        mine = node == n
        w = weight * mine
        for s, x in enumerate((w, w * residual, mine.astype(float))):
            for r in range(3):
                by_lane = (x @ to_lane[r]).ravel()
                for i in range(m):
                    out[n, r * m + i, :, s] = np.bincount(bins[:, i * 6 : i * 6 + 6].ravel(), by_lane, BINS)
            by_pair = x.reshape(len(bins), 30, 4).sum(axis=2).ravel()
            for j in range(len(model.lanes.pairs)):
                at = m * 6 + j * 30
                out[n, 3 * m + j, :, s] = np.bincount(bins[:, at : at + 30].ravel(), by_pair, BINS)
    return out


def best(total: np.ndarray) -> tuple[int, int, float, float]:
    """Feature, bin and means of both sides of a node's best split (features x BINS x 3); feature -1 where none gains."""
    left = total.cumsum(axis=1)
    whole = left[0, -1]
    right = whole - left
    mean = lambda s: s[..., 1] / np.maximum(s[..., 0], 1e-300)
    gain = (left[..., 1] * mean(left) + right[..., 1] * mean(right) - whole[1] * mean(whole)) / max(whole[0], 1e-300)
    gain[(left[..., 2] < 0.5) | (right[..., 2] < 0.5)] = -np.inf
    gain = np.round(gain, 12)  # sums in another order don't change the choice; ties to the first feature and bin
    f, b = divmod(int(gain.argmax()), gain.shape[1])
    return (f, b, float(mean(left[f, b])), float(mean(right[f, b]))) if gain[f, b] > 0 else (-1, 0, float(mean(whole)), float(mean(whole)))


def fit(races: DataFrame, lanes: Lanes, label: str, hit_weight: float, trees: int, depth: int) -> Trees:
    """Trees on races of arrays by lane and the class that won (label)."""
    ship(races.sparkSession)
    columns = list(dict.fromkeys((*lanes.metrics, *lanes.pairs)))
    races = written(races.select(F.coalesce(F.col(label), F.lit(-1)).cast("int").alias("y"), *columns), "race-boosting/given")
    model = Trees(lanes, lanes.edges(races, BINS), depth)

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x.tobytes() for x in lanes.binned(b, model.edges)], pa.binary())], ["y", "x"])

    rows = written(races.mapInArrow(start, "y int, x binary"), "race-boosting/rows")
    for _ in range(trees):
        size = (1 << depth) - 1
        feature, cut, leaf = np.full(size, -1), np.zeros(size, np.int64), np.zeros(1 << depth)
        for level in range(depth):
            total = added(rows, model, (feature, cut), level, hit_weight)
            for n in range(1 << level):
                at, below = (1 << level) - 1 + n, 1 << (depth - level - 1)
                feature[at], cut[at], low, high = best(total[n])
                # what is not split further keeps its mean in all leaves below it
                leaf[2 * n * below : (2 * n + 1) * below], leaf[(2 * n + 1) * below : (2 * n + 2) * below] = low, high
        model.trees.append((feature, cut, leaf))
    return model


def added(rows: DataFrame, model: Trees, tree: tuple, level: int, hit_weight: float) -> np.ndarray:
    """The sums of a level over all races (y, x)."""
    shape = (1 << level, len(model.lanes.places()), BINS, 3)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(shape)
        for b in batches:
            if b.num_rows:
                bins = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint8).reshape(b.num_rows, -1)
                out += sums(model, bins, b.column(0).to_numpy()[:, None] == np.arange(120), tree, level, hit_weight)
        out = out.reshape(-1, 3)
        some = np.flatnonzero(out[:, 2])
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), *[pa.array(out[some, i]) for i in range(3)]], ["cell", "w", "wr", "n"])

    got = rows.mapInArrow(task, "cell int, w double, wr double, n double").groupBy("cell").agg(*[F.sum(c).alias(c) for c in ("w", "wr", "n")]).toArrow()
    out = np.zeros((int(np.prod(shape[:3])), 3))  # nodes * features * bins
    out[got.column("cell").to_numpy()] = np.stack([got.column(c).to_numpy() for c in ("w", "wr", "n")], axis=1)
    return out.reshape(shape)


def hit_ranks(model: Trees, races: DataFrame, label: str, carry: list[str]) -> DataFrame:
    """carry, is_hit and rank_prob: the outcome that won and its rank by margin (ties to the smaller class), a row a race; the rank is
    null where none did."""
    ship(races.sparkSession)
    source = races.select(*carry, F.coalesce(F.col(label), F.lit(-1)).cast("int").alias("_y"), *dict.fromkeys((*model.lanes.metrics, *model.lanes.pairs)))
    kinds = "".join(f"`{c}` {source.schema[c].dataType.simpleString()}, " for c in carry)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            y, margins = b.column(len(carry)).to_numpy(), model.margins(model.lanes.binned(b, model.edges))
            own = margins[np.arange(len(y)), np.maximum(y, 0)][:, None]
            rank = 1 + ((margins > own) | ((margins == own) & (np.arange(120) < y[:, None]))).sum(axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(carry)], pa.array((y >= 0).astype(np.int32)), pa.array(rank.astype(np.int32), mask=y < 0)], [*carry, "is_hit", "rank_prob"])

    return source.mapInArrow(task, f"{kinds}is_hit int, rank_prob int")
