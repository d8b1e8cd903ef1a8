"""Exact counts, and no group cut that exchanges could join."""

from __future__ import annotations

from collections import Counter, defaultdict

import pytest

from hexlane.llm import sharding


def groups(spark, sizes, shards, lone=0):
    texts = [f"group {g}" for g, n in enumerate(sizes) for _ in range(n)] + [f"alone {i}" for i in range(lone)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, shard string")
    rows = sharding.assign(docs, shards).collect()
    counts, where = Counter(r.shard for r in rows), defaultdict(set)
    assert sorted(r.doc_id for r in rows) == list(range(len(texts))) and max(counts.values()) - min(counts.values()) <= 1 and len(counts) == shards
    for r in rows:
        where[texts[r.doc_id]].add(r.shard)
    return [len(where[f"group {g}"]) for g in range(len(sizes))]


@pytest.mark.parametrize(("sizes", "lone"), [([2] * 240, 0), ([4] * 120, 48), ([4] * 120, 0), ([2, 3, 5, 8] * 20, 300)])
def test_no_group_that_fits_is_cut(spark, sizes, lone):
    assert set(groups(spark, sizes, 24, lone)) == {1}


def test_as_few_cuts_as_shards_where_sizes_do_not_fit(spark):
    got = groups(spark, [3] * 160, 24)
    assert sum(n > 1 for n in got) <= 23


def test_a_group_larger_than_shards(spark):
    got = groups(spark, [150] + [2] * 40, 8, lone=90)  # 40 a shard
    assert got[0] <= 6 and all(n == 1 for n in got[1:])


def test_cycles_keep_counts():
    asks, free = [[0, 3, 0], [0, 0, 2], [1, 0, 0]], [0, 0, 1]
    moves, freed = sharding.cycles(asks, free)
    for s in range(3):
        out = sum(moves[s]) + sum(freed[s])
        into = sum(row[s] for row in moves) + sum(row[s] for row in freed)
        assert out == into and sum(freed[s]) <= free[s] and all(m <= a for m, a in zip(moves[s], asks[s], strict=True))
    assert sum(map(sum, moves)) == 4
