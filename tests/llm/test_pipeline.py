"""The pipeline against its stages' guarantees."""

from __future__ import annotations

import corpus_pipeline
from hexlane.llm.common import table


def test_stages(spark, sf):
    docs = table(spark, sf, "documents")
    everything = docs.count()
    kept = [everything]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        if name != "sharding":
            assert out.columns == list(corpus_pipeline.COLUMNS)
        docs = spark.createDataFrame(out.toPandas(), out.schema)
        kept.append(docs.count())
    language, near, clean, mixed, sharded = kept[1:]
    assert language >= 0.98 * everything and near < language and clean <= near and 0 < mixed < clean and sharded == mixed
    counts = [r["count"] for r in docs.groupBy("shard").count().collect()]
    assert max(counts) - min(counts) <= 1 or len(counts) < 24


def test_near_duplicates_by_row(spark, sf):
    say = lambda name: " ".join(f"{name}{i}" for i in range(40))
    rows = [(1, "a"), (1, "a"), (None, "b"), (None, "b"), (2, "c"), (5, "c"), (5, "d"), (None, "e"), (9, "e"), (7, None), (7, None), (8, "f")]
    docs = spark.createDataFrame([(i, n and say(n), "en", "s", 0) for i, n in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r.doc_id, r.text and r.text[0]) for r in corpus_pipeline.near_duplicates(spark, docs, sf).collect()]
    want = [(1, "a"), (None, "b"), (2, "c"), (5, "d"), (9, "e"), (7, None), (7, None), (8, "f")]
    assert sorted(got, key=str) == sorted(want, key=str)


ODD = "doc_id long, text string, lang string, source string, n_chars long, rk string, row string, shard int, component string"


def odd_documents(spark, rows):
    return spark.createDataFrame([(i, t, lang, src, 0, "a", "b", 1, "c") for i, t, lang, src in rows], ODD)


def test_odd_rows_in_every_stage(spark, sf):
    say = lambda name, n: " ".join(f"{name}{i % 90} lorem" for i in range(n))
    rows = [(1, say("a", 40), "en", "s"), (1, say("a", 40), "en", "t"), (1, say("b", 40), None, None), (None, say("c", 40), "en", None), (None, say("c", 40), "en", "s"), (None, None, None, None), (7, None, "en", "s"), (8, "", "fr", "s"), (9, "12 34", "en", "s"), (10, say("d", 30000), "en", "s")]
    rows += [(20 + i, say("efgh"[i % 4] * (i + 1), 30), "en", "s") for i in range(12)]
    docs = odd_documents(spark, rows)
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        got = out.toPandas()
        kept[name] = len(got)
        if name != "sharding":
            assert out.columns == list(corpus_pipeline.COLUMNS)
            docs = spark.createDataFrame([(*r, "a", "b", 1, "c") for r in out.collect()], ODD)
    assert kept["language_id"] == len(rows) - 4  # without a letter: null, null, empty, digits
    assert kept["jaccard_join"] == kept["language_id"] - 2  # two groups of equal rows
    assert kept["decontaminate"] == kept["jaccard_join"] and kept["sharding"] == kept["mixing"] <= kept["decontaminate"]


def test_empty_table_in_every_stage(spark, sf):
    docs = odd_documents(spark, [(1, "x", "en", "s")]).where("false")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        assert out.count() == 0, name
