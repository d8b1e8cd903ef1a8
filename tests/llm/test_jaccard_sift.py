"""The sift and the lists of the similarity join keep their share of the sets, however many parts and shingles are counted."""

from __future__ import annotations

import os
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from hexlane.llm import common, jaccard_join

WORDS = 80


def prose(rng):
    return [f"w{rng.randrange(1 << 40)}" for _ in range(WORDS)]


def test_a_full_filter_lets_no_unlinked_sets_go_on(spark, monkeypatch):
    monkeypatch.setattr(common.KeyFilter.__init__, "__defaults__", (12,))  # a filter of 4096 bits, as if the table were huge
    rng = random.Random(4)
    texts = [prose(rng) for _ in range(240)]
    linked = [" ".join(t) for t in texts] + [" ".join([*t[:-1], "other"]) for t in texts]
    alone = [" ".join(prose(rng)) for _ in range(1500)]
    written = {}

    def noted(df, name, real=jaccard_join.written):
        out = real(df, name)
        written[name] = sum(os.path.getsize(p.removeprefix("file://")) for p in out.inputFiles())
        return out

    monkeypatch.setattr(jaccard_join, "written", noted)
    sizes = []
    for docs in (linked, linked + alone):
        written.clear()
        df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").repartition(4)
        got = Counter(r.component_id for r in jaccard_join.join_sets(df).collect())
        assert got == Counter({i: 2 if i < len(texts) else 1 for i in range(len(docs)) if not len(texts) <= i < len(linked)})
        sizes.append(written["join-sets"])
    assert sizes[1] < 1.6 * sizes[0]


def test_sizes_come_back_in_the_order_of_the_hashes(spark):
    rng = np.random.default_rng(3)
    pool = rng.integers(0, 1 << 63, 400, dtype=np.uint64) * np.uint64(2)
    lots = {(i << 32) + 1: rng.choice(pool, 300 + i, replace=False) for i in range(1, 5)}
    lots[7] = np.append(np.repeat(pool[:1], 9), rng.integers(0, 1 << 63, 50, dtype=np.uint64))
    count = Counter(h for x in lots.values() for h in x.tolist())
    rows = spark.createDataFrame([(k, bytearray(x.tobytes())) for k, x in lots.items()], "lot long, tok binary").repartition(3)
    blobs = rows.mapInArrow(jaccard_join.shingle_blobs, "lot long, bucket int, blob binary")

    def told(batches):
        import pyarrow as pa

        for tok, sizes in jaccard_join.gathered(batches, "tok"):
            yield pa.RecordBatch.from_arrays([pa.array([tok.tobytes()]), pa.array([sizes.tobytes()])], ["tok", "sizes"])

    got = jaccard_join.with_sizes(rows, blobs).mapInArrow(told, "tok binary, sizes binary").collect()
    assert len(got) == len(lots)
    for r in got:
        hashes, sizes = np.sort(np.frombuffer(r.tok, np.uint64)), np.frombuffer(r.sizes, np.uint8)
        assert sizes.tolist() == [int(8 * np.log2(count[h])) for h in hashes.tolist()]


def test_copies_of_a_text_do_not_list_its_shingles(spark, monkeypatch):
    rng = random.Random(6)
    texts = [" ".join(prose(rng)) for _ in range(50)]
    counted = {}

    def noted(df, name, real=jaccard_join.written):
        out = real(df, name)
        counted[name] = out.count() if name == "join-lists" else 0
        return out

    monkeypatch.setattr(jaccard_join, "written", noted)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts * 3)], "doc_id long, text string").repartitionByRange(3, F.col("doc_id"))
    got = jaccard_join.join_sets(df).collect()
    assert all(r.component_id == r.doc_id % 50 for r in got) and len(got) == 150
    assert counted["join-lists"] == 0
