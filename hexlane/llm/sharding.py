"""Balanced label propagation: documents move to the shard where most of their neighbours are, under exact quotas.

Main path: DataFrame functions only. Links are given as hubs: two documents with the same hub are neighbours, so a
group of copies costs one row a member and no pair is ever listed.

Each round joins every linked document with its hub's fullest shard, to which those elsewhere ask to move. Counts must not
change, so moves go round in cycles: through shards whose documents ask in turn, or that hold documents without neighbours,
which may go anywhere. Where no cycle is left for half of those who ask, the groups still cut are dealt anew as wholes into the
places that their members and the documents without neighbours hold, the largest first, wherever they fit; the rest one
after another into the places left, where at most one group a boundary between shards is cut; and the rounds go on with those.
It ends when none asks or none can move, or the number who ask has not fallen for STALE rounds.

Per-shard counts (rows a pair of shards, and SIZES different sizes of cut groups at most) go through the driver. Hubs of at least a
HEAVY-th of all rows are at most HEAVY, and are joined by broadcast; all others are small.

Nulls and edges: a null text has no bytes (size 8, CRC 0) and no hub; an empty text is a text; a null doc_id is kept;
equal rows are separate documents; a group larger than a shard is cut, with as few shards as fit round it; an empty table
gives an empty result. Only doc_id and text are read, so extra columns don't matter.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written

ROWS_A_BUCKET, HEAVY, STALE, DEALS, SIZES = 100_000, 10_000, 3, 2, 10_000


def bucketed(df: DataFrame, group: str, order: str, buckets: int) -> DataFrame:
    """Add _b, the bucket of a random 64-bit column's value, and _o, how many rows of the group are in buckets before it."""
    bucket = F.shiftrightunsigned(F.col(order), 33) * buckets / F.lit(1 << 31)
    df = df.withColumn("_b", F.floor(bucket).cast("int"))
    before = Window.partitionBy(group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    counts = df.groupBy(group, "_b").count().select(group, "_b", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_o"))
    return df.join(counts, [group, "_b"])


def ranked(df: DataFrame, group: str, order: str, buckets: int, name: str, ties: str = "doc_id") -> DataFrame:
    """Add the gapless 0-based rank of each row in its group, in the order of a random 64-bit column.

    Rows are ranked inside (group, bucket), a bucket being a range of the order; buckets are then offset by the counts of
    those before them. No task holds a whole group.
    """
    inside = Window.partitionBy(group, "_b").orderBy(order, ties)
    return bucketed(df, group, order, buckets).withColumn(name, F.col("_o") + F.row_number().over(inside) - 1).drop("_b", "_o")


def lookup(values: list[int], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(int(v)).cast("long") for v in values]), index.cast("int") + 1)


def place_in(sizes: list[int], place: Column) -> Column:
    """Index of the range, of these sizes one after another, in which a place lies."""
    ends, total = [], 0
    for s in sizes:
        total += s
        ends.append(total)
    return F.size(F.filter(F.array(*[F.lit(x).cast("long") for x in ends]), lambda x: x <= place))


def cycles(asks: list[list[int]], free: list[int]) -> tuple[list[list[int]], list[list[int]]]:
    """Moves of those who ask and of the free, shard to shard, that leave all counts as they are: shortest cycles first."""
    n = len(free)
    asks, free = [row[:] for row in asks], free[:]
    moves, freed = [[0] * n for _ in free], [[0] * n for _ in free]

    def way(a: int, b: int) -> list[tuple[int, int]] | None:
        """Shortest way from a to b through shards that have someone to pass on."""
        came, queue = {a: a}, [a]
        for x in queue:
            if x == b:
                out = []
                while x != a:
                    out.append((came[x], x))
                    x = came[x]
                return out
            for y in range(n):
                if y not in came and (free[x] or asks[x][y]):
                    came[y] = x
                    queue.append(y)
        return None

    for longest in (2, n):
        for a in range(n):
            for b in range(n):
                while asks[a][b] and (back := way(b, a)) is not None and len(back) < longest:
                    steps = [(a, b, False)] + [(x, y, not asks[x][y]) for x, y in back]
                    uses = Counter(x if is_free else (x, y) for x, y, is_free in steps)
                    k = min((free[u] if isinstance(u, int) else asks[u[0]][u[1]]) // c for u, c in uses.items())
                    for x, y, is_free in steps:
                        (freed if is_free else moves)[x][y] += k
                        if is_free:
                            free[x] -= k
                        else:
                            asks[x][y] -= k
    return moves, freed


def by_hub(rows: DataFrame, facts: DataFrame) -> DataFrame:
    """rows with the facts of their hubs; both have `heavy`."""
    heavy = rows.where("heavy").join(F.broadcast(facts.where("heavy").drop("heavy")), "hub")
    return heavy.unionByName(rows.where("not heavy").join(facts.where("not heavy").drop("heavy"), "hub"))


def moved(asks: DataFrame, moves: list[list[int]], freed: list[list[int]], buckets: int) -> DataFrame:
    """The documents with their shards after the moves: of each kind those first in a random order."""
    shards = len(freed)
    kind = F.when(F.col("hub").isNull(), F.col("shard")).when(F.col("goal") != F.col("shard"), (F.col("shard") + 1) * shards + F.col("goal")).otherwise(-1)
    wanted = [sum(row) for row in freed] + [x for row in moves for x in row]
    rows = asks.withColumn("_g", kind).withColumn("_n", F.when(kind >= 0, lookup(wanted, F.greatest(kind, F.lit(0)))).otherwise(0))
    some = bucketed(rows.where("_n > 0"), "_g", "u", buckets)
    inside = Window.partitionBy("_g", "_b").orderBy("u", "doc_id")
    first = some.where("_o < _n").withColumn("_k", F.col("_o") + F.row_number().over(inside) - 1)
    to = F.lit(None).cast("int")
    for s in range(shards):
        to = F.when(F.col("shard") == s, place_in(freed[s], F.col("_k"))).otherwise(to) if sum(freed[s]) else to
    first = first.withColumn("shard", F.when(F.col("_k") >= F.col("_n"), F.col("shard")).when(F.col("hub").isNotNull(), F.col("goal")).otherwise(to))
    keep = [c for c in asks.columns if c not in ("goal", "n", "cut")]
    return rows.where("_n = 0").select(keep).unionByName(some.where("_o >= _n").select(keep)).unionByName(first.select(keep))


def fitted(sizes: list[tuple[int, int]], room: list[int]) -> tuple[list[tuple[int, int, int, int]], list[int]]:
    """Whole groups into shards with so much room, the largest first: (size, shard, from, to) by rank among those of a size,
    and the room left. sizes: (size, groups of it)."""
    plan, room = [], room[:]
    for n, count in sorted(sizes, reverse=True):
        first = 0
        for s in sorted(range(len(room)), key=lambda s: (-room[s], s)):
            k = min(count - first, room[s] // n)
            if k:
                plan.append((n, s, first, first + k))
                first, room[s] = first + k, room[s] - k * n
    return plan, room


def dealt(asks: DataFrame, places: list[int], free: list[int], buckets: int) -> DataFrame:
    """Members of cut groups dealt anew into the places that such members and free documents hold."""
    spark, shards = asks.sparkSession, len(places)
    keep = [c for c in asks.columns if c not in ("goal", "n", "cut")]
    groups = asks.where("cut").groupBy("hub").agg(F.first("n").alias("n"), F.first("heavy").alias("heavy")).withColumn("_h", F.xxhash64("hub", F.lit("deal")))
    groups = written(groups, "cut-groups")
    sizes = [(r["n"], r["count"]) for r in groups.groupBy("n").count().limit(SIZES + 1).collect()]
    plan, room = fitted(sizes if len(sizes) <= SIZES else [], [p + f for p, f in zip(places, free, strict=True)])
    # the rest fills shard after shard; documents without neighbours take what remains
    rest = sum(places) - sum(n * (to - first) for n, _, first, to in plan)
    filled = [0] * shards
    for s in sorted(range(shards), key=lambda s: (-room[s], s)):
        filled[s] = min(room[s], rest)
        rest -= filled[s]
    more = [f - (r - x) for f, r, x in zip(free, room, filled, strict=True)]  # free documents that must leave a shard
    freed = [[0] * shards for _ in free]
    for a in range(shards):
        for b in range(shards):
            k = max(0, min(more[a], -more[b]))
            freed[a][b], more[a], more[b] = k, more[a] - k, more[b] + k
    goals = F.broadcast(spark.createDataFrame(plan, "n long, _to int, _low long, _high long"))
    planned = ranked(groups, "n", "_h", buckets, "_k", "hub").join(goals, "n", "left").where("_k >= _low and _k < _high").select("hub", "heavy", "_to")
    planned = written(planned, "planned-groups")
    others = groups.join(planned.select("hub"), "hub", "left_anti")
    # ranges of groups: by size class, then by hash; each is summed by itself
    others = others.withColumn("_c", -F.floor(F.log2("n")).cast("int")).withColumn("_b", F.floor(F.shiftrightunsigned("_h", 33) * buckets / F.lit(1 << 31)).cast("int"))
    before = Window.partitionBy(F.lit(0)).orderBy("_c", "_b").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    ranges = others.groupBy("_c", "_b").agg(F.sum("n").alias("_s")).select("_c", "_b", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_o"))
    inside = Window.partitionBy("_c", "_b").orderBy(F.desc("n"), "_h", "hub").rowsBetween(Window.unboundedPreceding, -1)
    others = others.join(ranges, ["_c", "_b"]).select("hub", "heavy", (F.col("_o") + F.coalesce(F.sum("n").over(inside), F.lit(0))).alias("_first"))
    facts = planned.select("hub", "heavy", "_to", F.lit(None).cast("long").alias("_first")).unionByName(others.withColumn("_to", F.lit(None).cast("int")))
    rows = by_hub(asks.where("cut").select(keep), facts)
    whole = rows.where("_to is not null").withColumn("shard", F.col("_to"))
    split = ranked(rows.where("_to is null"), "hub", "u", buckets, "_k").withColumn("shard", place_in(filled, F.col("_first") + F.col("_k")))
    return moved(asks.where("not cut"), [[0] * shards for _ in free], freed, buckets).unionByName(whole.select(keep)).unionByName(split.select(keep))


def assign(docs: DataFrame, shards: int = 24, rounds: int = 24) -> DataFrame:
    """doc_id, size, text_crc32, hub, heavy, u, shard: counts of shards differ by one at most."""
    text = F.col("text")
    base = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.encode(F.coalesce(text, F.lit("")), "UTF-8")).alias("text_crc32"),
        F.when(text.isNotNull(), F.unhex(F.md5(F.encode(text, "UTF-8")))).alias("hub"),
    )
    base = written(base, "shard-base")
    total = base.count()
    buckets = max(4, total // (ROWS_A_BUCKET * shards) + 1)
    hubs = written(base.where("hub is not null").groupBy("hub").agg(F.count("*").alias("n")).where("n > 1").withColumn("heavy", F.col("n") >= max(1000, total // HEAVY)), "shard-hubs")
    heavy = F.broadcast(hubs.where("heavy").select("hub", F.lit(True).alias("heavy")))
    base = base.join(heavy, "hub", "left").withColumn("heavy", F.coalesce("heavy", F.lit(False)))
    light = base.where("not heavy").join(hubs.where("not heavy").select("hub", F.lit(True).alias("_linked")), "hub", "left")
    state = light.withColumn("hub", F.when(F.col("_linked"), F.col("hub"))).drop("_linked").unionByName(base.where("heavy"))
    state = written(state.withColumn("u", F.xxhash64(F.monotonically_increasing_id(), F.lit("shard"))).withColumn("_g", F.lit(0)), "shard-linked")
    state = ranked(state, "_g", "u", buckets * shards, "_k").withColumn("shard", (F.col("_k") % shards).cast("int")).drop("_g", "_k")
    least, stale, deals = None, 0, 0
    for turn in range(rounds):
        state = written(state, "shard-state")
        here = state.where("hub is not null").groupBy("hub", "heavy", "shard").count()
        best = F.max_by("shard", F.struct("count", F.xxhash64("hub", "shard", F.lit(turn)))).alias("goal")
        facts = here.groupBy("hub", "heavy").agg(best, F.sum("count").alias("n"), (F.count("*") > 1).alias("cut"))
        lone = state.where("hub is null").select("*", F.lit(None).cast("int").alias("goal"), F.lit(1).cast("long").alias("n"), F.lit(False).alias("cut"))
        asks = written(by_hub(state.where("hub is not null"), facts).unionByName(lone), "shard-asks")
        want, free, places = [[0] * shards for _ in range(shards)], [0] * shards, [0] * shards
        for r in asks.where("hub is null or cut").groupBy("shard", "goal").count().collect():  # a row a pair of shards
            if r["goal"] is None:
                free[r["shard"]] = r["count"]
                continue
            places[r["shard"]] += r["count"]
            if r["goal"] != r["shard"]:
                want[r["shard"]][r["goal"]] = r["count"]
        asking = sum(map(sum, want))
        stale = stale + 1 if least is not None and asking >= least else 0
        least = asking if least is None else min(least, asking)
        moves, freed = cycles(want, free)
        can = sum(map(sum, moves))
        if not asking or stale > STALE or (not can and deals == DEALS):
            break
        if 2 * can < asking and deals < DEALS:
            deals += 1
            state = dealt(asks, places, free, buckets)
        else:
            state = moved(asks, moves, freed, buckets)
    return state


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents into shards 0 to 23 under the law `rows`."""
    docs = table(spark, sf_dir, "documents")
    state = written(assign(docs), "shards")
    buckets = max(4, state.count() // (ROWS_A_BUCKET * 24) + 1)
    return ranked(state, "shard", "u", buckets, "slot").select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
