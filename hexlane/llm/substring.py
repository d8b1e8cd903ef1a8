"""Repeated word windows, found through a log-structured index of window fingerprints.

Every window of `window` words is filed under one anchor: the least hash among its `anchor`-word grams (leftmost on ties).
Equal windows have equal anchors, and neighbouring windows mostly share one, so a run holds about a tenth as many hashes as
there are windows. A batch becomes an immutable run sorted by hash; it is merge-joined with each older run, and windows
whose anchor occurs more than once are counted by a 96-bit fingerprint of the whole window. A window counted once cannot
repeat, belongs to one document and is sent back there; all other candidates repeat. Runs are compacted by levels as they add
up, and a manifest lets a later job open the index and go on.

Nulls and edges: a null or empty text has no words; rows with equal doc_id and text are separate documents, so all their
windows repeat; a null doc_id is kept; texts shorter than a window lose nothing; an empty table gives an empty result.
Only doc_id and text are read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import KeyFilter, fresh_path, row_key, small_batches, table, written
from .words import CHECK_BASE, Words, mix, slices

WINDOW, ANCHOR, FANOUT = 35, 16, 4


def anchors(words: Words, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of whole windows, the position of each one's anchor, and the hash at every position."""
    starts = words.whole(window)
    grams = words.grams(anchor)
    if not len(starts):
        return starts, starts, grams
    low = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
    span, have = window - anchor + 1, 1
    while have * 2 <= span:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    if have < span:
        low = np.minimum(low[: len(low) - (span - have)], low[span - have :])
    return starts, (low[starts] & np.uint64(0xFFFFFFFF)).astype(np.int64), grams


def anchor_rows(window: int, anchor: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in slices(batch.column(0)):
                _, at, grams = anchors(Words(data, offsets), window, anchor)
                hashes, n = np.unique(grams[np.unique(at)] if len(at) else np.zeros(0, np.uint64), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(n.astype(np.int64))], ["h", "n"])

    return task


class FingerprintIndex:
    """Sorted immutable runs (h, n) in the shared folder; `repeated` gathers hashes seen more than once.

    Runs are tiered: `fanout` runs of a level are merged into one of the next, so a hash is rewritten as often as there are
    levels. Each append or merge adds a version to the manifest, a small table beside the runs, by which a later job opens
    the index again; runs that a version no longer names stay for readers of older ones.
    """

    MANIFEST = "version int, kind string, level int, path string, window int, anchor int, fanout int"

    def __init__(self, spark: SparkSession, window: int = WINDOW, anchor: int = ANCHOR, fanout: int = FANOUT, root: str | None = None):
        self.spark, self.window, self.anchor, self.fanout = spark, window, anchor, max(2, fanout)
        self.root, self.version = root or fresh_path(spark, "index"), 0
        self.runs: list[tuple[int, str]] = []
        self.found: list[str] = []

    @classmethod
    def open(cls, spark: SparkSession, root: str) -> FingerprintIndex:
        """The index as its last version left it."""
        versions = spark.read.schema(cls.MANIFEST).parquet(f"{root}/manifest")
        last = versions.where(F.col("version") == versions.agg(F.max("version")).first()[0]).collect()  # a row a run
        index = cls(spark, last[0]["window"], last[0]["anchor"], last[0]["fanout"], root)
        index.version = last[0]["version"]
        index.runs = sorted(((r["level"], r["path"]) for r in last if r["kind"] == "run"), key=lambda r: (-r[0], r[1]))
        index.found = sorted(r["path"] for r in last if r["kind"] == "hits")
        return index

    def _write(self, df: DataFrame, name: str) -> str:
        path = f"{self.root}/{name}-{self.version + 1:06d}-{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(path)
        return path

    def _read(self, *paths: str) -> DataFrame:
        return self.spark.read.schema("h long, n long").parquet(*paths)

    def _commit(self) -> None:
        self.version += 1
        rows = [("run", level, path) for level, path in self.runs] + [("hits", 0, path) for path in self.found]
        rows = [(self.version, kind, level, path, self.window, self.anchor, self.fanout) for kind, level, path in rows]
        self.spark.createDataFrame(rows, self.MANIFEST).coalesce(1).write.mode("append").parquet(f"{self.root}/manifest")

    def append(self, docs: DataFrame) -> DataFrame:
        """Add a batch's run; return the hashes (h) that it repeats, of older runs or its own."""
        counted = docs.select("text").mapInArrow(anchor_rows(self.window, self.anchor), "h long, n long")
        run = self._write(counted.groupBy("h").agg(F.sum("n").alias("n")).sortWithinPartitions("h"), "run")
        new = self._read(run)
        hits = new.where("n > 1").select("h")
        for _, old in self.runs:
            hits = hits.union(new.hint("merge").join(self._read(old), "h", "left_semi").select("h"))
        self.runs.append((0, run))
        hit = self._write(hits.distinct().withColumn("n", F.lit(2).cast("long")), "hits")
        self.found.append(hit)
        self._commit()
        self.compact()
        return self._read(hit).select("h")

    def compact(self) -> None:
        """Merge the runs of every level that has `fanout` of them, and hits of as many batches; old files stay for their readers."""
        changed = False
        level = 0
        while level <= max((lv for lv, _ in self.runs), default=-1):
            same = [path for lv, path in self.runs if lv == level]
            if len(same) >= self.fanout:
                merged = self._write(self._read(*same).groupBy("h").agg(F.sum("n").alias("n")).sortWithinPartitions("h"), "run")
                self.runs = [r for r in self.runs if r[0] > level] + [(level + 1, merged)] + [r for r in self.runs if r[0] < level]
                changed = True
            level += 1
        if len(self.found) > self.fanout:
            self.found = [self._write(self._read(*self.found).select("h").distinct().withColumn("n", F.lit(2).cast("long")), "hits")]
            changed = True
        if changed:
            self._commit()

    def repeated(self) -> DataFrame:
        """All hashes seen more than once in any batches so far."""
        return self._read(*self.found).select("h").distinct()


def candidate_windows(window: int, anchor: int, known: KeyFilter):
    """(w1, w2, n, rk, pos): candidate windows, counted within a slice of texts."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy()
            for first, _, data, offsets in slices(batch.column(1)):
                words = Words(data, offsets)
                starts, at, grams = anchors(words, window, anchor)
                if not len(starts):
                    continue
                starts = starts[known(grams[at])]
                full, check = words.grams(window)[starts], words.grams(window, CHECK_BASE)[starts] >> np.uint64(32)
                _, one, n = np.unique(full ^ mix(check), return_index=True, return_counts=True)
                starts, full, check = starts[one], full[one], check[one]
                doc = words.doc[starts]
                columns = [full.view(np.int64), check.astype(np.uint32).view(np.int32), n.astype(np.int32), keys[first + doc], (starts - words.first[doc]).astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["w1", "w2", "n", "rk", "pos"])

    return task


def strip_windows(window: int, anchor: int, known: KeyFilter):
    """doc_id, n_words, n_removed, kept for rows (doc_id, text, positions of candidate windows that occur once)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            single = batch.column(2)
            counts = single.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            single_doc, single_at = np.repeat(np.arange(len(counts)), counts), single.flatten().to_numpy()
            for first, to, data, offsets in slices(batch.column(1)):
                words = Words(data, offsets)
                n = len(words)
                starts, at, grams = anchors(words, window, anchor)
                gone = np.zeros(n + window + 1, np.int32)
                if len(starts):
                    hit = np.zeros(n, bool)
                    hit[starts[known(grams[at])]] = True
                    here = slice(*np.searchsorted(single_doc, [first, to]))
                    hit[words.first[single_doc[here] - first] + single_at[here]] = False
                    starts = np.flatnonzero(hit)
                    gone[starts] += 1
                    gone[starts + window] -= 1
                keep = np.flatnonzero(np.cumsum(gone[:n]) == 0)
                doc = words.doc[keep]
                kept_count = np.bincount(doc, minlength=words.n_docs)
                last = np.ones(len(keep), bool)
                last[:-1] = doc[1:] != doc[:-1]
                edge = np.zeros(len(data) + 2, np.int8)
                edge[words.start[keep]] += 1
                np.subtract.at(edge, words.end[keep] + ~last, 1)
                inside = np.cumsum(edge[: len(data)], dtype=np.int8).astype(bool)
                text = data.copy()
                text[words.end[keep[~last]]] = 32
                size = np.bincount(doc, weights=words.end[keep] - words.start[keep] + ~last, minlength=words.n_docs).astype(np.int64)
                kept = pa.LargeStringArray.from_buffers(words.n_docs, pa.py_buffer(np.concatenate(([0], np.cumsum(size)))), pa.py_buffer(text[inside]))
                yield pa.RecordBatch.from_arrays([batch.column(0)[first:to], pa.array(words.count.astype(np.int64)), pa.array((words.count - kept_count).astype(np.int64)), kept.cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    return task


def remove_repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, batches: int = 2) -> DataFrame:
    """doc_id, n_words, n_removed, kept: every word in a window that occurs anywhere else removed, all rows judged alike.

    The documents enter the index in `batches` batches by a hash of the row.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select("doc_id", "text", row_key("doc_id", "text").alias("rk"))
    index = FingerprintIndex(spark, window, anchor, fanout=batches)
    for b in range(batches):
        index.append(docs.where(F.pmod("rk", F.lit(batches)) == b))
    known = KeyFilter(index.repeated(), "h")
    windows = docs.select("rk", "text").mapInArrow(candidate_windows(window, anchor, known), "w1 long, w2 int, n int, rk long, pos int")
    counted = windows.groupBy("w1", "w2").agg(F.sum("n").alias("n"), F.min("rk").alias("rk"), F.min("pos").alias("pos"))
    single = written(counted.where("n = 1").groupBy("rk").agg(F.collect_list("pos").alias("single")), "single-windows")
    return docs.join(single, "rk", "left").select("doc_id", "text", "single").mapInArrow(strip_windows(window, anchor, known), "doc_id long, n_words long, n_removed long, kept string")


def op4_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the words of repeated 35-word windows."""
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
