"""Shared pieces: tables, the shared folder, written cuts of the lineage, key filters and components."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..cluster import shared_dir, ship


HEAVY, SPARSE, FEW = 10_000, 32, 20_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/hexlane/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write to the shared folder and read back, so a lost executor costs no recomputation."""
    path = fresh_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of this many rows, so that a batch of long texts fits in a Python worker; the package goes along."""
    ship(spark)
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def byte_batches(spark: SparkSession, size: int = 4 << 20) -> None:
    """Arrow batches of this many bytes and a thousand rows at most; the package goes along."""
    small_batches(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def released(share: Broadcast) -> None:
    """Free a broadcast value on all machines; nothing that still has to run may use it."""
    share.destroy()


def row_key(*columns: str) -> Column:
    """A 64-bit key of a row's content; equal rows share it."""
    return F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\0null")) for c in columns])


def row_id(*columns: str) -> Column:
    """A 128-bit key of a row's content, of two differently seeded 64-bit hashes; equal rows share it."""
    content = [F.coalesce(F.col(c).cast("string"), F.lit("\0null")) for c in columns]
    half = lambda seed: F.lpad(F.hex(F.xxhash64(F.lit(seed), *content)), 16, "0")
    return F.unhex(F.concat(half(1), half(2)))


def skew_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """left joined with right, which has a key once at most, where some keys may have a large share of left's rows.

    Keys with a HEAVY-th of the rows or more, HEAVY at most, are joined by broadcast; the others are all small.
    """
    rows = left.count()
    least = max(1000, rows // HEAVY)
    keys = left.where(F.col(key).isNotNull()).groupBy(key).count().where(F.col("count") >= least).select(key).collect() if rows >= least else []
    if not keys:
        return left.join(right, key, how)
    heavy = F.broadcast(left.sparkSession.createDataFrame(keys, left.select(key).schema))
    flagged = left.join(heavy.withColumn("_heavy", F.lit(True)), key, "left")
    few = F.broadcast(right.join(heavy, key, "left_semi"))
    return flagged.where("_heavy").drop("_heavy").join(few, key, how).unionByName(flagged.where("_heavy is null").drop("_heavy").join(right, key, how))


class KeyFilter:
    """One-hash Bloom filter over 64-bit hashes: SPARSE bits a key, but at most 2**most bits (16 MB), so it may be broadcast.

    False positives only cost work: every user of the filter joins or counts exactly afterwards.
    """

    def __init__(self, keys: DataFrame, column: str, most: int = 27):
        keys = written(keys.select(column), "filter-keys")
        bits = min(most, max(12, (SPARSE * keys.count()).bit_length()))
        slot = F.shiftrightunsigned(F.col(column), 64 - bits)
        words = (
            keys.select(slot.alias("slot"))
            .groupBy(F.shiftrightunsigned("slot", 6).cast("int").alias("word"))
            .agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("mask"))
        )
        got = words.toArrow()  # at most 2**(bits - 6) rows
        table = np.zeros(1 << (bits - 6), np.uint64)
        table[got.column("word").to_numpy()] = got.column("mask").to_numpy().view(np.uint64)
        self.bits, self.table = bits, keys.sparkSession.sparkContext.broadcast(table)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        slot = keys.view(np.uint64) >> np.uint64(64 - self.bits)
        return ((self.table.value[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1)).astype(bool)

    def release(self) -> None:
        released(self.table)


def settled(pdf: pd.DataFrame) -> pd.DataFrame:
    """(node, far): a node of its component for each node of FEW edges (a, b) at most."""
    codes, ids = pd.factorize(np.concatenate([pdf["a"].to_numpy(), pdf["b"].to_numpy()]))
    parent = list(range(len(ids)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for x, y in zip(codes[: len(pdf)].tolist(), codes[len(pdf) :].tolist(), strict=True):
        parent[find(x)] = find(y)
    return pd.DataFrame({"node": ids, "far": ids[[find(x) for x in range(len(ids))]]})


def components(edges: DataFrame, a: str, b: str, rounds: int = 60) -> DataFrame:
    """(node, component): the least node of each connected component of an undirected edge table.

    Contraction: each node points to the least of itself and its neighbours, in an order by hash, and on to where that
    one points; edges are then drawn between the nodes so reached. What has no edge left is finished and takes no part
    in later rounds, so the rounds shrink; the last FEW edges are settled in one task. The pointers of all rounds are followed
    back to front at the end. Null nodes and loops are left out. Each round is written out; raises if edges remain after the last.
    """
    ranked = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("id"))
    left = edges.select(F.col(a).alias("_a"), F.col(b).alias("_b")).where("_a is not null and _b is not null and _a <> _b")
    left = written(left.select(ranked("_a").alias("a"), ranked("_b").alias("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    pointers = []
    while count := left.count():
        if count <= FEW:
            kind = edges.select(a).schema[0].dataType.simpleString()
            last = left.select(F.col("a.id").alias("a"), F.col("b.id").alias("b"), F.lit(0).alias("all")).groupBy("all").applyInPandas(settled, f"node {kind}, far {kind}")
            pointers.append(written(last.select(ranked("node").alias("node"), ranked("far").alias("far")), "pointers"))
            break
        if len(pointers) == rounds:
            raise RuntimeError("components have not settled")
        both = left.select(F.col("a").alias("node"), F.col("b").alias("to")).union(left.select("b", "a"))
        near = written(both.groupBy("node").agg(F.least("node", F.min("to")).alias("next")), "pointers")
        far = near.join(near.select(F.col("node").alias("next"), F.col("next").alias("far")), "next").select("node", "far")
        far = written(far, "pointers")
        pointers.append(far)
        ends = left.join(far.select(F.col("node").alias("a"), F.col("far").alias("x")), "a").join(far.select(F.col("node").alias("b"), F.col("far").alias("y")), "b")
        left = written(ends.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
    if not pointers:
        return edges.sparkSession.createDataFrame([], edges.select(F.col(a).alias("node"), F.col(a).alias("component")).schema)
    root = pointers.pop()
    while pointers:
        onward = root.select(F.col("node").alias("far"), F.col("far").alias("root"))
        root = written(pointers.pop().join(onward, "far", "left").select("node", F.coalesce("root", "far").alias("far")), "pointers")
    least = root.groupBy("far").agg(F.min("node.id").alias("component"))
    return written(root.join(least, "far").select(F.col("node.id").alias("node"), "component"), "components")
