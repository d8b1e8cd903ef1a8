"""Collocations: frequent phrases of each language, scored by how much more often their parts meet than chance, subsumed by longer ones.

Two passes over the texts. The first fills count-min sketches: each task counts the n-grams of 1 to LONGEST words of its texts into
DEPTH rows of 2**BITS counters, which stop at the support (only "at least so often" is asked). The sketches of all tasks are merged
by chunks of counters, FAN tasks at a time, so that no group grows with the number of tasks. A counter is never below the true
count of an n-gram in it, so what stays below the support in any row is out, and nothing frequent is lost. What is broadcast is one
bit a counter, DEPTH * 2**BITS / 8 bytes, whatever the input. The second pass sends on only n-grams whose counters all reach the
support and counts them exactly, by their text; within a slice of texts words get numbers whose bytes are compared, so no hash
decides. On corpora of many times 2**BITS rare n-grams the rows fill up and more n-grams are counted exactly than needed: work
grows to at most that of counting all of them, the result stays; `bits` raises the room.

Parts of a frequent phrase are frequent, so all that the score needs is among the counted ones; it is in decimals of 38 digits.

Nulls and edges: a null or empty text has no words; a null lang is `und`, and shares the counts of texts whose lang is that string;
a word may be of any length; repeated rows count each; ids aren't read, nor are other columns; ties of the score end with a and
then the bytes of the phrase; an empty table, or one without a frequent phrase, gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import byte_batches, released, skew_join, table, written
from .words import U, Words, mix, slices

LONGEST, SUPPORT, TOP, COVER = 5, 100, 2000, 100
BITS, DEPTH, CHUNK_BITS, FAN = 25, 2, 16, 64
SLICE = 1 << 20
STOPS = np.zeros(256, bool)
STOPS[[*b".,;:!?\n\x0b\x0c\r"]] = True


class Phrases:
    """N-grams of a slice of texts: words, and for each word its piece (a run between stops) and language number."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lang: np.ndarray):
        stop = STOPS[data]
        self.words = Words(np.where(stop, np.uint8(10), data), offsets, lower=True)
        self.piece = np.concatenate(([0], np.cumsum(stop)))[self.words.start] + self.words.doc
        self.lang = lang[self.words.doc]

    def starts(self, k: int) -> np.ndarray:
        """Positions of the words whose next k lie in one piece."""
        n = len(self.words)
        return np.flatnonzero(self.piece[k - 1 :] == self.piece[: n - k + 1]) if n >= k else np.zeros(0, np.int64)

    def numbers(self) -> tuple[np.ndarray, list[str]]:
        """A number for each word, equal where the bytes are, and the words by number."""
        w = self.words
        _, rep, number = np.unique(w.hash, return_index=True, return_inverse=True)
        length, other = w.end - w.start, rep[number]
        if np.array_equal(length, length[other]):
            within = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
            if np.array_equal(w.data[np.repeat(w.start, length) + within], w.data[np.repeat(w.start[other], length) + within]):
                return number, [w.data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(w.start[rep].tolist(), w.end[rep].tolist(), strict=True)]
        seen: dict[bytes, int] = {}  # two words share a hash: number them by their bytes
        number = np.array([seen.setdefault(w.data[a:b].tobytes(), len(seen)) for a, b in zip(w.start.tolist(), w.end.tolist(), strict=True)], np.int64)
        return number, [x.decode("utf-8", "replace") for x in seen]


def languages(column: pa.Array) -> tuple[np.ndarray, list[str]]:
    """The languages of a slice as numbers, and their names."""
    coded = column.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary.to_pylist()


def keys(p: Phrases, k: int, at: np.ndarray, names: list[str]) -> np.ndarray:
    """64-bit keys of the k words and the language at each of these positions."""
    seeds = np.array([xxhash.xxh64_intdigest(x, 1) for x in names], U)
    return mix(p.words.grams(k)[at] ^ seeds[p.lang[at]])


def slot(key: np.ndarray, row: int, bits: int) -> np.ndarray:
    return (mix(key + U(0x9E3779B97F4A7C15 * row & 0xFFFFFFFFFFFFFFFF)) >> U(64 - bits)).astype(np.uint32)


def counter_type(support: int) -> type:
    return np.uint8 if support < 256 else np.uint16 if support < 65536 else np.uint32


def sketch(longest: int, support: int, bits: int):
    """lang, text to the chunks of this task's counters that aren't all zero."""
    kind, chunk = counter_type(support), 1 << min(CHUNK_BITS, bits)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        counters = np.zeros((DEPTH, 1 << bits), kind)
        for batch in batches:
            for first, to, data, offsets in slices(batch.column(1), SLICE):
                lang, names = languages(batch.column(0)[first:to])
                p = Phrases(data, offsets, lang)
                for k in range(1, longest + 1):
                    key = keys(p, k, p.starts(k), names)
                    for row in range(DEPTH):
                        at, n = np.unique(slot(key, row, bits), return_counts=True)
                        counters[row, at] = np.minimum(counters[row, at] + n, support)
        part = TaskContext.get().partitionId()
        for row in range(DEPTH):
            for c in range(len(counters[row]) // chunk):
                part_of = counters[row, c * chunk : (c + 1) * chunk]
                if part_of.any():
                    yield pa.RecordBatch.from_arrays([pa.array([row], pa.int32()), pa.array([c], pa.int32()), pa.array([part], pa.int32()), pa.array([zlib.compress(part_of.tobytes(), 1)])], ["row", "chunk", "part", "counts"])

    return task


def merge(support: int):
    """The counters of FAN tasks at most of one chunk, added."""
    kind = counter_type(support)

    def group(pdf: pd.DataFrame) -> pd.DataFrame:
        total: np.ndarray | None = None
        for counts in pdf["counts"]:
            here = np.frombuffer(zlib.decompress(counts), kind).astype(np.uint64)
            total = here if total is None else total + here
        merged = np.minimum(total, support).astype(kind)
        return pd.DataFrame({"row": pdf["row"].iloc[:1], "chunk": pdf["chunk"].iloc[:1], "part": pdf["part"].iloc[:1] // FAN, "counts": [zlib.compress(merged.tobytes(), 1)]})

    return group


def frequent_slots(texts: DataFrame, longest: int, support: int, bits: int) -> np.ndarray:
    """Bits of the counters that reach the support in the merged sketch of all texts: DEPTH rows of 2**bits / 8 bytes."""
    schema = "row int, chunk int, part int, counts binary"
    parts = written(texts.select("lang", "text").mapInArrow(sketch(longest, support, bits), schema), "sketches")
    tasks = (parts.agg(F.max("part")).first()[0] or 0) + 1
    while True:
        parts = parts.groupBy("row", "chunk", F.floor(F.col("part") / FAN)).applyInPandas(merge(support), schema)
        tasks = -(-tasks // FAN)
        if tasks == 1:
            break
    chunk, kind = 1 << min(CHUNK_BITS, bits), counter_type(support)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            full = [np.packbits(np.frombuffer(zlib.decompress(x), kind) >= support, bitorder="little").tobytes() for x in b.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(full, pa.binary())], ["row", "chunk", "bits"])

    out = np.zeros((DEPTH, (1 << bits) // 8), np.uint8)
    got = parts.mapInArrow(packed, "row int, chunk int, bits binary").toArrow()  # DEPTH * 2**bits / 8 bytes at most
    for row, c, full in zip(got.column("row").to_pylist(), got.column("chunk").to_pylist(), got.column("bits").to_pylist(), strict=True):
        out[row, c * chunk // 8 : (c + 1) * chunk // 8] = np.frombuffer(full, np.uint8)
    return out


def survivors(share, longest: int, bits: int):
    """lang, text to (lang, phrase, k, n): exact counts of a slice's n-grams that the sketch lets through, and its words as k = 0."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        full = share.value
        for batch in batches:
            for first, to, data, offsets in slices(batch.column(1), SLICE):
                lang, names = languages(batch.column(0)[first:to])
                p = Phrases(data, offsets, lang)
                number, words = p.numbers()
                vocabulary = np.array(words, object)
                total = np.bincount(p.lang, minlength=len(names))
                yield counted([names, [""] * len(names), [0] * len(names), total.tolist()])
                for k in range(1, longest + 1):
                    at = p.starts(k)
                    key = keys(p, k, at, names)
                    for row in range(DEPTH):
                        s = slot(key, row, bits)
                        stay = (full[row, s >> np.uint32(3)] >> (s & np.uint32(7)).astype(np.uint8)) & 1 == 1
                        at, key = at[stay], key[stay]
                    if not len(at):
                        continue
                    # the words' numbers as digits of one number, made small again before it could pass 64 bits
                    code, room = p.lang[at], len(names)
                    for j in range(k):
                        if room * len(words) >= 1 << 62:
                            code = np.unique(code, return_inverse=True)[1]
                            room = len(at)
                        code, room = code * len(words) + number[at + j], room * len(words)
                    _, rep, n = np.unique(code, return_index=True, return_counts=True)
                    columns = [vocabulary[number[at[rep] + j]].tolist() for j in range(k)]
                    phrase = columns[0] if k == 1 else [" ".join(x) for x in zip(*columns, strict=True)]
                    yield counted([[names[x] for x in p.lang[at[rep]].tolist()], phrase, [k] * len(rep), n.tolist()])

    return task


def counted(columns: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int32(), pa.int64()), strict=True)], ["lang", "phrase", "k", "f"])


def phrase_counts(docs: DataFrame, longest: int = LONGEST, support: int = SUPPORT, bits: int = BITS) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, k, f) of all n-grams of k words with f >= support, exact, and (lang, n): all words of each language."""
    spark = docs.sparkSession
    byte_batches(spark)
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text").where("text is not null")
    share = spark.sparkContext.broadcast(frequent_slots(texts, longest, support, bits))
    found = texts.mapInArrow(survivors(share, longest, bits), "lang string, phrase string, k int, f long")
    found = written(found.groupBy("lang", "phrase", "k").agg(F.sum("f").alias("f")).where((F.col("k") == 0) | (F.col("f") >= support)), "phrase-counts")
    released(share)
    return found.where("k > 0"), found.where("k = 0").select("lang", F.col("f").alias("n"))


def part(words: Column, start: Column, length: Column) -> Column:
    return F.array_join(F.slice(words, start, length), " ")


def scored(counts: DataFrame, totals: DataFrame, longest: int = LONGEST) -> DataFrame:
    """lang, phrase, k, a, l, r, n, score of all phrases of two words and more, at their weakest cut."""
    words = F.split("phrase", " ")
    cuts = counts.where("k > 1").select("lang", "phrase", "k", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    sides = F.explode(F.array(F.lit(0), F.lit(1))).alias("side")
    piece = F.when(F.col("side") == 0, part(words, F.lit(1), F.col("cut"))).otherwise(part(words, F.col("cut") + 1, F.col("k") - F.col("cut")))
    cuts = written(cuts.select("*", sides).withColumn("_part", F.struct("lang", piece.alias("phrase"))), "phrase-cuts")
    # a word may begin a great share of all phrases
    joined = skew_join(cuts, counts.select(F.struct("lang", "phrase").alias("_part"), "f"), "_part")
    count_at = lambda cut, side: F.max(F.when((F.col("cut") == cut) & (F.col("side") == side), F.col("f")))
    wide = joined.groupBy("lang", "phrase", "k", "a").agg(*[count_at(c, s).alias(f"_{'lr'[s]}{c}") for c in range(1, longest) for s in (0, 1)])
    wide = skew_join(written(wide, "phrase-parts"), totals, "lang")
    score = "(CAST(a AS DECIMAL(18,0)) * CAST(n AS DECIMAL(16,0)) * CAST(1000 AS DECIMAL(4,0))) div (CAST(_l{0} AS DECIMAL(18,0)) * CAST(_r{0} AS DECIMAL(18,0)))"
    cut = lambda c: F.when(F.col("k") > c, F.struct(F.expr(score.format(c)).alias("score"), F.lit(c).alias("cut"), F.col(f"_l{c}").alias("l"), F.col(f"_r{c}").alias("r")))
    least = F.array_min(F.array(*[cut(c) for c in range(1, longest)]))
    return wide.withColumn("_least", least).select("lang", "phrase", "k", "a", "_least.l", "_least.r", "n", "_least.score")


def subsumed(candidates: DataFrame, cover: int = COVER) -> DataFrame:
    """Candidates (lang, phrase, k, a, ...) without those inside a longer one that has `cover` percent of their count or more."""
    words = F.split("phrase", " ")
    inner = candidates.where("k > 2").select("lang", words.alias("_words"), "k", "a", F.explode(F.sequence(F.lit(2), F.col("k") - 1)).alias("_size"))
    inner = inner.select("*", F.explode(F.sequence(F.lit(1), F.col("k") - F.col("_size") + 1)).alias("_start"))
    longer = inner.groupBy("lang", part(F.col("_words"), F.col("_start"), F.col("_size")).alias("phrase")).agg(F.max("a").alias("_longer"))
    joined = candidates.join(longer, ["lang", "phrase"], "left")  # once a key on both sides
    return joined.where(F.col("_longer").isNull() | (F.col("_longer").cast("decimal(20,0)") * 100 < F.col("a").cast("decimal(20,0)") * cover)).drop("_longer")


def collocations(docs: DataFrame, longest: int = LONGEST, support: int = SUPPORT, top: int = TOP, cover: int = COVER, bits: int = BITS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first `top` phrases of each language."""
    counts, totals = phrase_counts(docs, longest, support, bits)
    kept = subsumed(written(scored(counts, totals, longest), "phrase-scores"), cover)
    # a limit by rank is applied in each task before the exchange
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    return kept.withColumn("rank", rank).where(F.col("rank") <= top).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collocations of all documents, by language."""
    return collocations(table(spark, sf_dir, "documents"))


def oracle(support: int = SUPPORT, top: int = TOP, longest: int = LONGEST) -> str:
    grams = " UNION ALL ".join(f"SELECT lang, {k} AS k, unnest([array_to_string(w[i:i+{k - 1}], ' ') FOR i IN range(1, len(w) - {k - 2})]) AS phrase FROM p" for k in range(1, longest + 1))
    return rf"""
WITH t AS (SELECT coalesce(lang, 'und') AS lang, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents WHERE text IS NOT NULL),
s AS (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM t),
p AS MATERIALIZED (SELECT lang, list_filter(regexp_split_to_array(piece, '[ \t]+'), lambda x: x <> '') AS w FROM s),
tot AS MATERIALIZED (SELECT lang, sum(len(w)) AS n FROM p GROUP BY lang),
c AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS f FROM ({grams}) GROUP BY lang, k, phrase HAVING count(*) >= {support}),
cut AS (SELECT lang, phrase, k, f AS a, string_split(phrase, ' ') AS w, unnest(range(1, k)) AS j FROM c WHERE k > 1),
sc AS (SELECT cut.lang, cut.phrase, cut.k, a, j, x.f AS l, y.f AS r, n, CAST(1000 AS HUGEINT) * a * n // (CAST(x.f AS HUGEINT) * y.f) AS score
  FROM cut JOIN c x ON x.lang = cut.lang AND x.phrase = array_to_string(w[:j], ' ') JOIN c y ON y.lang = cut.lang AND y.phrase = array_to_string(w[j + 1:], ' ') JOIN tot ON tot.lang = cut.lang),
best AS MATERIALIZED (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
sub AS (SELECT lang, a, unnest(flatten([[array_to_string(string_split(phrase, ' ')[i:i+m-1], ' ') FOR i IN range(1, k - m + 2)] FOR m IN range(2, k)])) AS phrase FROM best WHERE k > 2),
big AS (SELECT lang, phrase, max(a) AS longer FROM sub GROUP BY lang, phrase),
kept AS (SELECT best.* FROM best LEFT JOIN big USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 100 * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM kept QUALIFY rank <= {top}
"""
