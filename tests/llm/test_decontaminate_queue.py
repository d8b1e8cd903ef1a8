"""Passages that no latent space holds must come to an end, and be judged like any others."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from hexlane.llm import decontaminate

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def tables(spark, extra=()):
    rng = random.Random(1)
    common = [f"c{i}" for i in range(30)]
    items = []
    for k in range(3):
        shared = rng.sample(common, 24)
        items.append((k, shared, [f"rare{k}x{i}" for i in range(24)]))
    texts = [" ".join(rng.choices(common, k=12)) for _ in range(1500)]
    # the common words of one item before the whole of another
    texts.append(" ".join(items[1][1] + items[2][1] + items[2][2]))
    texts += extra
    bench = spark.createDataFrame([(k, " ".join(a + b)) for k, a, b in items], "item_id long, text string")
    return spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], DOCS), bench, items


def spaces(monkeypatch):
    calls, real = [], decontaminate.latent_space

    def counted(*args):
        calls.append(args[2])
        if len(calls) > 60:
            raise AssertionError("the queue doesn't end")
        return real(*args)

    monkeypatch.setattr(decontaminate, "latent_space", counted)
    return calls


def test_common_words_of_one_item_beside_another_end(spark, monkeypatch):
    calls = spaces(monkeypatch)
    docs, bench, _ = tables(spark)
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, bench).collect()}
    assert (1500, 2) in got and not any(d < 1500 for d, _ in got) and (1500, 1) not in got
    assert calls


def test_many_equal_and_different_passages_without_room_end(spark, monkeypatch):
    calls = spaces(monkeypatch)
    monkeypatch.setattr(decontaminate, "RANK", 24)
    docs, bench, items = tables(spark)
    same = " ".join(items[1][1] + items[2][1] + items[2][2])
    more = spark.range(2000, 2040).select(F.col("id").alias("doc_id"), F.lit(same).alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(0).cast("long").alias("n_chars"))
    equal = more.where("doc_id = 2000").crossJoin(spark.range(50).select()).select(docs.columns)  # one row fifty times
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs.union(more).union(equal), bench).collect()}
    assert {(i, 2) for i in range(2000, 2040)} <= got and (1500, 2) in got and not any(d < 1500 for d, _ in got)
    assert calls
