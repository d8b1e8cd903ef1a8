"""Nearest neighbours by inner product: inverted lists scanned dimension block by dimension block.

Centroids are fitted on a sample of at most SAMPLE vectors; every vector is filed in its nearest centroid's list. ASKED queries are
compared with every vector first, and so many lists are probed as give these a recall of TARGET. In a probed list, randomly rotated
vectors are compared block by block: of an inner product s, the blocks that hold the share u of |q|^2 show s * u, with a spread of
sqrt((|q|^2|x|^2 - s^2) u(1 - u) / (dimensions - 1)); a candidate is abandoned when it shows less than the query's twentieth best so
far would, by more than EPSILON spreads. Survivors are scored exactly, in double precision, on the original vectors.

Nulls and edges: null vectors and ids, zero vectors, vectors with null or non-finite components, and those not of the most
frequent length take no part; a query is never its own answer, also where its id is repeated; equal scores go to the smaller
id; lists are cut into lots of bounded size, so a third of all vectors in one list is spread over tasks; fewer candidates
than k are all returned; empty tables give empty results. Only vec_id and embedding are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import released, small_batches, table, written

SAMPLE, LOT_VECTORS, LOT_QUERIES, EPSILON, STEP, SLACK = 20_000, 4096, 1024, 3.5, 16, 1e-5
ASKED, TARGET = 256, 0.96  # queries compared with every row, from which the number of probed lists is set, and the recall it must reach for them


def usable(vectors: DataFrame) -> DataFrame:
    ok = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("embedding", lambda x: x != 0)
    return vectors.select("vec_id", "embedding").where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ok)


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)


def fit(sample: np.ndarray, lists: int, rounds: int = 8) -> np.ndarray:
    rng = np.random.default_rng(7)
    centres = sample[rng.choice(len(sample), lists, replace=False)]
    for _ in range(rounds):
        own = nearest(sample, centres)
        for i in range(lists):
            if (own == i).any():
                centres[i] = sample[own == i].mean(axis=0)
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (x @ centres.T - (centres**2).sum(axis=1) / 2).argmax(axis=1)


def nearest_lists(filed: DataFrame, asked: np.ndarray, asked_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(query's place in asked, list) of the k truly nearest of each asked query, by comparison with every filed row."""
    share = filed.sparkSession.sparkContext.broadcast((asked, asked_ids))

    def best(batches):
        queries, query_ids = share.value
        n = len(queries)
        score, ids, own = np.empty((n, 0)), np.empty((n, 0), np.int64), np.empty((n, 0), np.int32)
        for b in batches:
            new = b.column(0).to_numpy()
            with np.errstate(over="ignore", invalid="ignore"):
                dot = queries @ matrix(b.column(1)).T
            dot[query_ids[:, None] == new[None, :]] = -np.inf
            score = np.concatenate([score, dot], axis=1)
            ids = np.concatenate([ids, np.broadcast_to(new, (n, len(new)))], axis=1)
            own = np.concatenate([own, np.broadcast_to(b.column(2).to_numpy(), (n, len(new)))], axis=1)
            if score.shape[1] > k:
                top = np.argpartition(-score, k - 1, axis=1)[:, :k]
                score, ids, own = (np.take_along_axis(v, top, axis=1) for v in (score, ids, own))
        at, place = np.nonzero(score > -np.inf)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(score[at, place]), pa.array(ids[at, place]), pa.array(own[at, place])], ["q", "score", "vec_id", "list"])

    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))
    found = filed.mapInArrow(best, "q int, score double, vec_id long, list int").withColumn("rank", rank).where(F.col("rank") <= k)
    got = found.select("q", "list").toArrow()  # k rows an asked query
    released(share)
    return got.column("q").to_numpy(), got.column("list").to_numpy()


def probes_needed(asked: np.ndarray, centres: np.ndarray, true: tuple[np.ndarray, np.ndarray]) -> int:
    """Lists to probe so that the asked queries find TARGET of their truly nearest."""
    order = np.argsort(-(asked @ centres.T), axis=1, kind="stable")
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.broadcast_to(np.arange(len(centres)), order.shape), axis=1)
    rank = place[true]
    found = np.cumsum(np.bincount(rank, minlength=len(centres))) / max(1, rank.size)
    return min(len(centres), int((found < TARGET).sum()) + 1)


def scan(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, ids: np.ndarray, turn: np.ndarray, k: int) -> tuple[list, list, list]:
    """Best k of the rows for each query, by partial products with early abandonment; queries and rows are in double precision."""
    dim = rows.shape[1]
    # single precision is for pruning alone, and scaled, so that no product overflows
    unit = lambda v, axis: v / np.maximum(np.abs(v).max(axis=axis, keepdims=True, initial=0), 1e-300)
    q, x = unit(queries, 1), unit(rows, None)
    q /= np.sqrt((q**2).sum(axis=1, keepdims=True))
    length = np.sqrt((x**2).sum(axis=1)).astype(np.float32)
    q, x = q.astype(np.float32) @ turn, x.astype(np.float32) @ turn
    ends = list(range(STEP, dim, STEP)) + [dim]
    share = [np.minimum((q[:, :e] ** 2).sum(axis=1), 1) for e in ends]
    head = min(len(rows), max(8 * k, 256))
    first = q @ x[:head].T
    first[query_ids[:, None] == ids[None, :head]] = -np.inf
    bar = np.partition(first, head - min(k, head), axis=1)[:, head - min(k, head)] if head >= k else np.full(len(q), -np.inf)
    bar = np.where(np.isfinite(bar), bar, -1e30).astype(np.float32)

    def stays(i: int, at_q, at_x, value: np.ndarray) -> np.ndarray:
        """False where a product as high as the bar would have shown more in the blocks so far, by more than EPSILON spreads."""
        least, size = bar[at_q], length[at_x]
        spread = np.sqrt(np.maximum(size**2 - np.maximum(least, 0) ** 2, 0)) * np.sqrt(share[i] * (1 - share[i]) / max(dim - 1, 1))[at_q]
        return value + EPSILON * spread + SLACK * size + 1e-30 >= least * share[i][at_q]

    part = q[:, : ends[0]] @ x[:, : ends[0]].T
    every_q, every_x = np.arange(len(q))[:, None], np.arange(len(x))[None, :]
    at_q, at_x = np.nonzero(stays(0, every_q, every_x, part) & (query_ids[:, None] != ids[None, :]))
    value = part[at_q, at_x]
    for i in range(1, len(ends)):
        value = value + np.einsum("ij,ij->i", q[at_q, ends[i - 1] : ends[i]], x[at_x, ends[i - 1] : ends[i]])
        stay = stays(i, at_q, at_x, value)
        at_q, at_x, value = at_q[stay], at_x[stay], value[stay]
    score = (queries[at_q] * rows[at_x]).sum(axis=1)
    order = np.lexsort((ids[at_x], -score, at_q))
    at_q, at_x, score = at_q[order], at_x[order], score[order]
    place = np.arange(len(at_q)) - np.searchsorted(at_q, at_q)
    top = place < k
    return query_ids[at_q[top]], ids[at_x[top]], score[top]


def search(vectors: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each query (vec_id, embedding) among vectors."""
    spark = vectors.sparkSession
    small_batches(spark, 4000)
    vectors, queries = usable(vectors), usable(queries)
    dims = vectors.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    schema = "query_id long, rank int, vec_id long, score double"
    kind, asked_kind = (d.schema["embedding"].dataType.simpleString() for d in (vectors, queries))
    if not dims:
        return spark.createDataFrame([], schema)
    dim, rows = dims[0]["d"], dims[0]["count"]
    vectors, queries = vectors.where(F.size("embedding") == dim), queries.where(F.size("embedding") == dim)
    sample = matrix(vectors.orderBy(F.xxhash64("vec_id", "embedding")).limit(SAMPLE).select("embedding").toArrow().column(0))
    lists = max(1, min(len(sample), int(rows**0.5 / 2)))
    centres = fit(sample, lists)
    turn = np.linalg.qr(np.random.default_rng(11).normal(size=(dim, dim)))[0].astype(np.float32)
    model = spark.sparkContext.broadcast((centres, turn))

    def file(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(nearest(matrix(b.column(1)), model.value[0]).astype(np.int32))], ["vec_id", "embedding", "list"])

    asked = queries.orderBy(F.xxhash64("vec_id", "embedding")).limit(ASKED).toArrow()
    filed = written(vectors.mapInArrow(file, f"vec_id long, embedding {kind}, list int"), "vector-lists")
    sizes = np.zeros(lists, np.int64)
    for r in filed.groupBy("list").count().collect():  # a row a list
        sizes[r["list"]] = r["count"]
    asked_ids, asked = asked.column(0).to_numpy(), matrix(asked.column(1)) if len(asked) else np.empty((0, dim))
    probes = probes_needed(asked, centres, nearest_lists(filed, asked, asked_ids, k))

    def probe(batches):
        for b in batches:
            order = np.argsort(-(matrix(b.column(1)) @ model.value[0].T), axis=1, kind="stable")
            enough = (np.cumsum(sizes[order], axis=1) <= 4 * k).sum(axis=1) + 1
            count = np.minimum(np.maximum(probes, enough), lists)
            chosen = [o[:c] for o, c in zip(order, count, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(chosen, pa.list_(pa.int32()))], ["vec_id", "embedding", "lists"])

    asked = queries.mapInArrow(probe, f"vec_id long, embedding {asked_kind}, lists array<int>").withColumn("list", F.explode("lists")).drop("lists")
    asked = written(asked, "vector-queries")
    ask = np.zeros(lists, np.int64)
    for r in asked.groupBy("list").count().collect():  # a row a list
        ask[r["list"]] = r["count"]
    x_lots, q_lots = -(-sizes // LOT_VECTORS), -(-ask // LOT_QUERIES)
    lots = spark.createDataFrame([(i, int(max(1, x_lots[i])), int(max(1, q_lots[i]))) for i in range(lists)], "list int, xs int, qs int")
    salt = lambda n: F.pmod(F.xxhash64("vec_id", "embedding"), F.col(n)).cast("int")
    one = filed.join(F.broadcast(lots), "list").withColumn("x", salt("xs")).withColumn("q", F.explode(F.sequence(F.lit(0), F.col("qs") - 1)))
    two = asked.join(F.broadcast(lots), "list").withColumn("q", salt("qs")).withColumn("x", F.explode(F.sequence(F.lit(0), F.col("xs") - 1)))
    both = one.select("list", "x", "q", F.lit(False).alias("asks"), "vec_id", "embedding").union(two.select("list", "x", "q", F.lit(True), "vec_id", "embedding"))

    def work(lot: pa.Table) -> pa.Table:
        asks = lot.column("asks").to_numpy()
        ids, x = lot.column("vec_id").to_numpy(), matrix(lot.column("embedding"))
        if asks.all() or not asks.any():
            out = ([], [], [])
        else:
            out = scan(x[asks], ids[asks], x[~asks], ids[~asks], model.value[1], k)
        return pa.table({"query_id": pa.array(out[0], pa.int64()), "vec_id": pa.array(out[1], pa.int64()), "score": pa.array(out[2], pa.float64())})

    found = both.groupBy("list", "x", "q").applyInArrow(work, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every vector whose id is divisible by 20."""
    vectors = table(spark, sf_dir, "embeddings")
    return search(vectors, vectors.where(F.col("vec_id") % 20 == 0))
