"""Boosted trees of many classes by distributed histograms, second order, and audits of what their features are worth.

Each round grows one tree a class, all classes and all nodes of a level at once: a pass over the rows adds up gradients, hessians
and counts by class, node, feature and bin; the sums of all tasks are merged FAN at a time by class, and the best split of each
node is chosen where its class is merged, so that only splits reach the driver (classes * nodes rows). Margins are written once a
round. Work is rows * classes * features a level; memory in a task is classes * nodes * features * bins numbers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..cluster import ship, written
from .models import feature_group

FAN, BUCKET_ROWS = 64, 1000


@dataclass
class Params:
    # fixed values: rate, depth, least rows of a leaf, shares of rows and columns as the source trains with
    rounds: int = 120
    rate: float = 0.05
    depth: int = 5
    bins: int = 32
    l2: float = 1.0
    least_rows: int = 30
    least_gain: float = 1e-9
    row_share: float = 0.8
    column_share: float = 0.8
    seed: int = 42


@dataclass
class Boosted:
    """features, edges (inner bin borders by feature), classes (labels), base margins, and by round the trees of all classes.

    trees: (feature, bin, leaf): arrays of classes x (2**depth - 1) nodes in heap order, and classes x 2**depth leaves. A row goes
    right where its bin is greater. losses: training loss before each round and after the last; gains by feature.
    """

    features: list[str]
    edges: list[np.ndarray]
    classes: list
    base: np.ndarray
    depth: int
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)
    losses: list[float] = field(default_factory=list)
    gains: np.ndarray | None = None

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, i], side="left") for i, e in enumerate(self.edges)], axis=1).astype(np.uint8)

    def margins(self, x: np.ndarray, rounds: int | None = None) -> np.ndarray:
        """Margins of rows of features (missing as 0)."""
        bins = self.binned(np.nan_to_num(x))
        out = np.tile(self.base, (len(x), 1))
        for tree in self.trees[:rounds]:
            out += values(tree, bins, self.depth)
        return out

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return softmax(self.margins(x))


def softmax(m: np.ndarray) -> np.ndarray:
    e = np.exp(m - m.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def descend(feature: np.ndarray, cut: np.ndarray, bins: np.ndarray, levels: int) -> np.ndarray:
    """For each row and class, the node (from 0) of its level after so many levels."""
    k = np.arange(len(feature))
    node = np.zeros((len(bins), len(feature)), np.int64)
    for level in range(levels):
        at = (1 << level) - 1 + node
        f = feature[k, at]
        node = 2 * node + (bins[np.arange(len(bins))[:, None], f] > cut[k, at])
    return node


def values(tree: tuple[np.ndarray, np.ndarray, np.ndarray], bins: np.ndarray, depth: int) -> np.ndarray:
    feature, cut, leaf = tree
    return leaf[np.arange(len(leaf)), descend(feature, cut, bins, depth)]


def chosen_rows(keys: np.ndarray, seed: int, number: int, share: float) -> np.ndarray:
    """The rows of a round, by a hash of their key, so that a lost task draws the same ones again."""
    x = keys.astype(np.uint64) ^ np.uint64((seed * 1_000_003 + number * 7919 + 1) & 0xFFFFFFFFFFFFFFFF)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return (x ^ (x >> np.uint64(31))) < np.uint64(min(share, 1.0) * (2**64 - 2048))


def histograms(y: np.ndarray, bins: np.ndarray, margins: np.ndarray, node: np.ndarray, nodes: int, n_bins: int) -> np.ndarray:
    """classes x nodes x features x bins x (gradient, hessian, rows)."""
    k, f = margins.shape[1], bins.shape[1]
    p = softmax(margins)
    h = p * (1 - p)
    p[np.arange(len(y)), y] -= 1
    out = np.zeros((3, k * nodes, f, n_bins))
    at = (np.arange(k) * nodes + node).astype(np.int64)
    for j in range(f):
        cell = (at * n_bins + bins[:, j : j + 1]).ravel()
        for i, w in enumerate((p.ravel(), h.ravel(), None)):
            out[i, :, j] = np.bincount(cell, w, k * nodes * n_bins).reshape(k * nodes, n_bins)
    return np.moveaxis(out, 0, -1).reshape(k, nodes, f, n_bins, 3)


def best_splits(hist: np.ndarray, allowed: np.ndarray, p: Params) -> pd.DataFrame:
    """For each node of one class (nodes x features x bins x 3): the best split and the sums of its sides; feature -1 where none gains."""
    left = hist.cumsum(axis=2)
    total = left[:, :1, -1:, :]
    right = total - left
    score = lambda s: s[..., 0] ** 2 / (s[..., 1] + p.l2)
    gain = score(left) + score(right) - score(total)
    gain[(left[..., 2] < p.least_rows) | (right[..., 2] < p.least_rows)] = -np.inf
    gain[:, ~allowed] = -np.inf
    flat = np.round(gain, 9).reshape(len(gain), -1)  # sums in another order don't change the choice; ties to the first feature and bin
    at = flat.argmax(axis=1)
    best = flat[np.arange(len(flat)), at]
    f, b = np.divmod(at, hist.shape[2])
    has = best > p.least_gain
    n = np.arange(len(gain))
    l = np.where(has[:, None], left[n, f, b], total[:, 0, 0])
    r = np.where(has[:, None], right[n, f, b], 0.0)
    return pd.DataFrame({"node": n, "feature": np.where(has, f, -1), "bin": b, "gain": np.where(has, best, 0.0), "gl": l[:, 0], "hl": l[:, 1], "gr": r[:, 0], "hr": r[:, 1]})


SPLIT = "class int, node int, feature int, bin int, gain double, gl double, hl double, gr double, hr double"


def _matrix(b: pa.RecordBatch, name: str, kind: type, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(b.column(b.schema.get_field_index(name)).to_pylist()), kind).reshape(-1, width)


def _packed(x: np.ndarray) -> pa.Array:
    return pa.array([row.tobytes() for row in np.ascontiguousarray(x)], pa.binary())


def feature_array(features: list[str]) -> Column:
    """All features as doubles, missing and non-finite as 0."""
    number = lambda c: F.col(c).cast("double")
    usable = lambda x: F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(x)
    return F.array(*[usable(number(c)) for c in features])


def fit(rows: DataFrame, features: list[str], label: str, key: str, params: Params = Params()) -> Boosted:
    """Trees on rows of a label (its values are the classes; null ones are left out) and a key that tells rows apart."""
    spark, p = rows.sparkSession, params
    ship(spark)
    # the rows are worked out once: counts, quantiles and bins are three passes over what is written here
    x = rows.where(F.col(label).isNotNull()).select(feature_array(features).alias("x"), F.col(label).alias("y"), F.xxhash64(key).alias("key"))
    x = written(x, "boosting/given")
    counts = {r["y"]: r["count"] for r in x.groupBy("y").count().collect()}  # a row a class
    classes = sorted(counts)
    total = sum(counts.values())
    if len(classes) < 2:
        raise ValueError("boosting needs rows of two classes or more")
    base = np.log(np.array([counts[c] / total for c in classes]))
    shares = [i / p.bins for i in range(1, p.bins)]
    quantiles = x.agg(*[F.percentile_approx(F.col("x")[i], shares, 10_000).alias(f"q{i}") for i in range(len(features))]).first()
    model = Boosted(features, [np.unique(q) for q in quantiles], classes, base, p.depth, gains=np.zeros(len(features)))
    place = {c: i for i, c in enumerate(classes)}
    k, f, schema = len(classes), len(features), "key long, y int, x binary, m binary"

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            bins = model.binned(b.column(0).flatten().to_numpy().reshape(n, f))
            y = pa.array([place[v] for v in b.column(1).to_pylist()], pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(2), y, _packed(bins), _packed(np.tile(base, (n, 1)))], ["key", "y", "x", "m"])

    at = written(x.mapInArrow(start, schema), "boosting/rows")
    rng = np.random.default_rng(p.seed)
    for number in range(p.rounds):
        allowed = np.zeros(f, bool)
        allowed[rng.choice(f, max(1, round(p.column_share * f)), replace=False)] = True
        feature, cut = np.zeros((k, (1 << p.depth) - 1), np.int64), np.full((k, (1 << p.depth) - 1), 255, np.int64)
        leaf = np.zeros((k, 1 << p.depth))
        for level in range(p.depth):
            for r in level_splits(at, feature, cut, level, number, allowed, k, f, p):
                node = (1 << level) - 1 + r["node"]
                if r["feature"] >= 0:
                    feature[r["class"], node], cut[r["class"], node] = r["feature"], r["bin"]
                    model.gains[r["feature"]] += r["gain"]
                if level == p.depth - 1:
                    leaf[r["class"], 2 * r["node"]] = -p.rate * r["gl"] / (r["hl"] + p.l2)
                    leaf[r["class"], 2 * r["node"] + 1] = -p.rate * r["gr"] / (r["hr"] + p.l2)
        tree = (feature, cut, leaf)
        at, loss = advanced(at, tree, k, f, p.depth)
        model.losses.append(loss)
        model.trees.append(tree)
    model.losses.append(advanced(at, None, k, f, p.depth)[1])
    return model


def level_splits(at: DataFrame, feature: np.ndarray, cut: np.ndarray, level: int, number: int, allowed: np.ndarray, k: int, f: int, p: Params) -> list:
    """The best split of every node of a level of all classes' trees."""
    nodes, shape = 1 << level, (1 << level, f, p.bins, 3)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = np.zeros((k, *shape))
        for b in batches:
            keep = chosen_rows(b.column(0).to_numpy(), p.seed, number, p.row_share)
            if keep.any():
                bins = _matrix(b, "x", np.uint8, f)[keep]
                node = descend(feature, cut, bins, level)
                total += histograms(b.column(1).to_numpy()[keep], bins, _matrix(b, "m", np.float64, k)[keep], node, nodes, p.bins)
        part = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k, dtype=np.int32)), pa.array(np.full(k, part, np.int32)), _packed(total.reshape(k, -1))], ["class", "part", "h"])

    def summed(pdf: pd.DataFrame) -> np.ndarray:
        return sum(np.frombuffer(h, np.float64) for h in pdf.sort_values("part")["h"])

    def merged(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"class": pdf["class"].iloc[:1], "part": pdf["part"].iloc[:1] // FAN, "h": [summed(pdf).tobytes()]})

    def split(pdf: pd.DataFrame) -> pd.DataFrame:
        return best_splits(summed(pdf).reshape(shape), allowed, p).assign(**{"class": pdf["class"].iloc[0]})[[c.split()[0] for c in SPLIT.split(", ")]]

    parts = at.mapInArrow(local, "class int, part int, h binary")
    tasks = at.rdd.getNumPartitions()
    while tasks > FAN:
        parts = parts.groupBy("class", F.floor(F.col("part") / FAN)).applyInPandas(merged, "class int, part int, h binary")
        tasks = -(-tasks // FAN)
    return parts.groupBy("class").applyInPandas(split, SPLIT).collect()  # classes * nodes rows


def advanced(at: DataFrame, tree, k: int, f: int, depth: int) -> tuple[DataFrame, float]:
    """Rows with the margins after a tree (written), and the mean loss before it; without a tree the loss alone."""

    def lost(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                m = _matrix(b, "m", np.float64, k)
                e = np.log(np.exp(m - m.max(axis=1, keepdims=True)).sum(axis=1)) + m.max(axis=1) - m[np.arange(len(m)), b.column(1).to_numpy()]
                yield pa.RecordBatch.from_arrays([pa.array([float(e.sum())]), pa.array([len(m)], pa.int64())], ["loss", "n"])

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                m = _matrix(b, "m", np.float64, k) + values(tree, _matrix(b, "x", np.uint8, f), depth)
                yield pa.RecordBatch.from_arrays([*b.columns[:3], _packed(m)], b.schema.names)

    got = at.mapInArrow(lost, "loss double, n long").agg(F.sum("loss") / F.sum("n")).first()[0]
    return (at if tree is None else written(at.mapInArrow(move, at.schema), "boosting/rows")), got


def predict(model: Boosted, rows: DataFrame, carry: list[str]) -> DataFrame:
    """carry and probs (an array in the order of model.classes)."""
    ship(rows.sparkSession)
    share = rows.sparkSession.sparkContext.broadcast(model)
    k, f = len(model.classes), len(model.features)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(b.num_columns - 1).flatten().to_numpy().reshape(b.num_rows, f)
            probs = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * k), pa.array(share.value.probabilities(x).ravel()))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], probs], [*b.schema.names[:-1], "probs"])

    source = rows.select(*carry, feature_array(model.features).alias("_x"))
    fields = "".join(f"`{c.name}` {c.dataType.simpleString()}, " for c in source.schema.fields[:-1])
    return source.mapInArrow(task, f"{fields}probs array<double>")


def class_rows(model: Boosted, rows: DataFrame, key: str) -> DataFrame:
    """key, class_id, prob: one row a class, as the other scorers give it; classes never seen are absent."""
    names = F.array(*[F.lit(c) for c in model.classes])
    return predict(model, rows, [key]).select(key, F.posexplode("probs").alias("_i", "prob")).select(key, F.element_at(names, F.col("_i") + 1).alias("class_id"), "prob")


TOPS = (1, 3, 5)


def measures(probs: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Sum of losses and hits among the first 1, 3 and 5 classes (ties to the earlier class); y is -1 for a class never seen."""
    rows, seen = np.arange(len(y)), y >= 0
    own = np.where(seen, probs[rows, np.maximum(y, 0)], 0.0)
    better = (probs > own[:, None]).sum(axis=1) + ((probs == own[:, None]) & (np.arange(probs.shape[1]) < y[:, None])).sum(axis=1)
    return (float(-np.log(np.maximum(own, 1e-15)).sum()), *[float(((better < t) & seen).sum()) for t in TOPS])


MEASURED = "name string, n long, loss double, " + ", ".join(f"top{t} double" for t in TOPS)


def as_rates(sums: DataFrame, *by: str) -> DataFrame:
    out = sums.groupBy(*by).agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in ("loss", *[f"top{t}" for t in TOPS])])
    return out.select(*by, "n", *[(F.col(c) / F.col("n")).alias(c) for c in ("loss", *[f"top{t}" for t in TOPS])])


def permutation_importance(model: Boosted, rows: DataFrame, label: str, key: str, groups: dict[str, str] | None = None, seed: int = 1) -> DataFrame:
    """group, features, n, loss, top1, top3, top5 and what they lose against the group `none`, when the columns of a group are permuted.

    Rows meet in buckets of about BUCKET_ROWS by a hash of their key, which is as good as drawn at random; in each the columns of
    one group after the other change rows together and all rows are scored, so all groups take one pass and one exchange.
    """
    spark = rows.sparkSession
    ship(spark)
    groups = groups or {c: feature_group(c) for c in model.features}
    names = sorted(set(groups.values()))
    place = {c: i for i, c in enumerate(model.classes)}
    share = spark.sparkContext.broadcast(model)
    source = rows.where(F.col(label).isNotNull()).select(F.xxhash64(key).alias("key"), F.col(label).alias("y"), feature_array(model.features).alias("x"))
    buckets = max(1, source.count() // BUCKET_ROWS)

    def score(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["key", "y"], kind="stable")
        x, y = np.stack(pdf["x"].to_numpy()), np.array([place.get(v, -1) for v in pdf["y"]])
        rng = np.random.default_rng([seed, int(pdf["key"].iloc[0]) & 0x7FFFFFFF])
        out = [("none", len(y), *measures(share.value.probabilities(x), y))]
        for g in names:
            columns = [i for i, c in enumerate(model.features) if groups[c] == g]
            moved = x.copy()
            moved[:, columns] = x[rng.permutation(len(y))][:, columns]
            out.append((g, len(y), *measures(share.value.probabilities(moved), y)))
        return pd.DataFrame(out, columns=[c.split()[0] for c in MEASURED.split(", ")])

    bucket = F.pmod(F.xxhash64("key", F.lit(seed)), F.lit(buckets))
    rates = as_rates(source.groupBy(bucket.alias("_bucket")).applyInPandas(score, MEASURED), "name")
    whole = rates.where("name = 'none'").select(*[F.col(c).alias(f"_{c}") for c in ("loss", *[f"top{t}" for t in TOPS])])  # one row
    sizes = spark.createDataFrame([("none", 0), *[(g, sum(groups[c] == g for c in model.features)) for g in names]], "name string, features int")
    joined = rates.crossJoin(F.broadcast(whole)).join(F.broadcast(sizes), "name")
    drops = [(F.col("loss") - F.col("_loss")).alias("loss_more"), *[(F.col(f"_top{t}") - F.col(f"top{t}")).alias(f"top{t}_less") for t in TOPS]]
    return joined.select(F.col("name").alias("feature_group"), "features", "n", "loss", *[f"top{t}" for t in TOPS], *drops)


def gain_importance(spark: SparkSession, model: Boosted) -> DataFrame:
    """feature, feature_group, gain, share: a row a feature."""
    total = float(model.gains.sum()) or 1.0
    return spark.createDataFrame([(c, feature_group(c), float(g), float(g) / total) for c, g in zip(model.features, model.gains, strict=True)], "feature string, feature_group string, gain double, share double")


def evaluate(model: Boosted, rows: DataFrame, label: str, by: list[str]) -> DataFrame:
    """by, n, mean loss and top-k rates of rows."""
    place = {c: i for i, c in enumerate(model.classes)}
    scored = predict(model, rows.where(F.col(label).isNotNull()), [*by, label])
    kinds = "".join(f"`{c}` {scored.schema[c].dataType.simpleString()}, " for c in by)

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for values_of, part in pdf.groupby(by, dropna=False) if by else [((), pdf)]:
                y = np.array([place.get(v, -1) for v in part[label]])
                yield pd.DataFrame([(*values_of, len(y), *measures(np.stack(part["probs"].to_numpy()), y))], columns=[*by, "n", "loss", *[f"top{t}" for t in TOPS]])

    return as_rates(scored.mapInPandas(task, kinds + MEASURED.split(", ", 1)[1]), *by)


def variants(rows: DataFrame, part: str, kinds: dict[str, list[str]], label: str, key: str, params: Params) -> DataFrame:
    """A model a list of features, trained on the rows whose part is train: variant, part, features, n, loss and top-k rates of each part."""
    out = None
    for name, features in kinds.items():  # a few models
        model = fit(rows.where(F.col(part) == "train"), features, label, key, params)
        got = evaluate(model, rows, label, [part]).select(F.lit(name).alias("variant"), part, F.lit(len(features)).alias("features"), "n", "loss", *[f"top{t}" for t in TOPS])
        out = got if out is None else out.unionByName(got)
    return out
