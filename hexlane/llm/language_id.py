"""Language identification by interpolated Kneser-Ney character models.

Texts are folded to lower-case letters and gaps. Character 4-gram counts of the training documents are summed in Spark by
language; from them come discounted continuation probabilities of every order, kept as sorted arrays of n-gram keys with a
column a language, in units of 2**-UNIT bits. A text gets the language of least cross-entropy a character.

Everything a position needs, of every order, has the same letter before the predicted one. So the n-grams are dealt into
lots by that letter, of LOT_VALUES values at most (one letter's n-grams stay together), and lots are broadcast one at a
time, each in a pass over the texts; units are whole numbers, so the sums do not depend on the lots. Most models are one lot.

Rejection is calibrated on one in CALIBRATE of the training texts (by a hash of the text), with a model that has not seen them.
For each predicted language and length class (whole log2 of the characters) the limit is the bits a character that at most
FALSE_RATE of them exceed, plus MARGIN; where a class has fewer than ENOUGH of them, FEW times the most seen in the language.
A language without any rejects nothing.

Nulls and edges: null text or one without a letter is `und` with score 0 and rejected; a null lang never trains; a null
doc_id counts as an empty string for the held-out rule; with nothing to learn from, all are `und`; an empty table gives an
empty result; equal rows get equal results; ties go to the first language by name. Only doc_id, text and lang are read, the
last for training alone. The columns `carry` may have any names but those added.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import released, small_batches, table, written
from .words import slices

ORDER, BITS, GAP = 4, 15, 0
OWN_POINTS = 0x3000  # code points below have a class of their own
UNIT = 16
LOT_VALUES = 1 << 24
CERTAIN_CHARS = 20
CALIBRATE, FALSE_RATE, MARGIN, ENOUGH, FEW = 10, 0.001, 0.5, 200, 1.5
FOLDED_BYTES = 1 << 19


@lru_cache(maxsize=1)
def fold_table() -> np.ndarray:
    """Class of each code point: its lower-case letter's own below OWN_POINTS, a shared one above, GAP for no letter."""
    out = np.zeros(0x110000, np.uint16)
    shared = (1 << BITS) - OWN_POINTS - 1
    for point in range(0x110000):
        if chr(point).isalpha():
            low = ord(chr(point).lower()[0])
            out[point] = low if low < OWN_POINTS else OWN_POINTS + low % shared
    return out


class Folded:
    """Codes of the last `order` characters at each position of folded texts; position 0 of a text is its leading gap."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, order: int):
        n_docs = len(offsets) - 1
        points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
        heads = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
        doc = np.repeat(np.arange(n_docs), np.diff(heads[offsets]))
        out, owner = np.zeros(len(points) + n_docs, np.uint16), np.zeros(len(points) + n_docs, np.int64)
        lead = heads[offsets[:-1]] + np.arange(n_docs)
        at = np.arange(len(points)) + doc + 1
        out[at], owner[at], owner[lead] = fold_table()[points], doc, np.arange(n_docs)
        keep = np.ones(len(out), bool)
        keep[1:] = (out[1:] != GAP) | (out[:-1] != GAP)
        keep[lead] = True
        chars, self.doc = out[keep], owner[keep]
        self.length = np.bincount(self.doc, minlength=n_docs)
        self.first = np.concatenate(([0], np.cumsum(self.length)))
        at = np.arange(len(chars)) - self.first[self.doc]
        self.scored = at > 0
        self.letters = np.bincount(self.doc, weights=chars != GAP, minlength=n_docs)
        self.code = chars.astype(np.int64)
        for back in range(1, order):
            before = np.zeros(len(chars), np.int64)
            before[back:] = chars[:-back]
            self.code |= np.where(at >= back, before, GAP) << (BITS * back)


def count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, aside, code, n) of (lang, aside, text)."""
    held: dict[tuple[str, bool], list[tuple[np.ndarray, np.ndarray]]] = {}

    def pack(parts: list) -> tuple[np.ndarray, np.ndarray]:
        code, back = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        return code, np.bincount(back, weights=np.concatenate([p[1] for p in parts])).astype(np.int64)

    for batch in batches:
        langs, aside = np.array(batch.column(0).to_pylist(), object), batch.column(1).to_numpy(zero_copy_only=False)
        for first, to, data, offsets in slices(batch.column(2), FOLDED_BYTES):
            text = Folded(data, offsets, ORDER)
            for lang, apart in set(zip(langs[first:to], aside[first:to].tolist(), strict=True)):
                own = (langs[first:to] == lang) & (aside[first:to] == apart)
                parts = held.setdefault((lang, apart), [])
                parts.append(np.unique(text.code[text.scored & own[text.doc]], return_counts=True))
                if len(parts) > 8:
                    parts[:] = [pack(parts)]
    for (lang, apart), parts in held.items():
        code, n = pack(parts)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(code), pa.string()), pa.array([apart] * len(code), pa.bool_()), pa.array(code), pa.array(n)], ["lang", "aside", "code", "n"])


def tail(code, order: int):
    """The last characters of a code; for arrays and Columns."""
    return code.bitwiseAND(F.lit((1 << (BITS * order)) - 1)) if isinstance(code, Column) else code & ((1 << (BITS * order)) - 1)


def find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the wanted in sorted keys, and whether they are there."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


class Lot:
    """Units (2**-UNIT bits) of the n-grams whose last letter but one is in a lot of letters: for each order from the highest
    to 2 the sorted keys with their probabilities and the sorted contexts with their back-off weights, and those of single
    letters. discount has a row an order from 1 up; single is the probability of each letter."""

    def __init__(self, lang: np.ndarray, code: np.ndarray, n: np.ndarray, discount: np.ndarray, letters: np.ndarray, single: np.ndarray):
        langs, levels = single.shape[1], []
        for k in range(ORDER, 1, -1):
            keys, at = np.unique(code, return_inverse=True)
            contexts, of = np.unique(keys >> BITS, return_inverse=True)
            count = np.zeros((len(keys), langs))
            np.add.at(count, (at, lang), n)
            total, kinds = np.zeros((len(contexts), langs)), np.zeros((len(contexts), langs))
            np.add.at(total, of, count)
            np.add.at(kinds, of, count > 0)
            own = np.maximum(count - discount[k - 1], 0) / np.maximum(total[of], 1)
            levels.append((keys, own, contexts, np.where(total > 0, discount[k - 1] * kinds / np.maximum(total, 1), 1.0), of))
            # the next lower order counts how many n-grams each shorter one completes
            short = np.unique(at * langs + lang)
            lang, code = short % langs, tail(keys[short // langs], k - 1)
            pairs, n = np.unique(np.stack((code, lang)), axis=1, return_counts=True)
            code, lang = pairs[0], pairs[1]
        self.letters, self.single, self.levels = letters, self.units(single), []
        shorter, lower = letters, single[:-1]
        for k, (keys, own, contexts, weight, of) in enumerate(reversed(levels), start=2):
            at, _ = find(shorter, tail(keys, k - 1))
            shorter, lower = keys, own + weight[of] * lower[at]
            self.levels.insert(0, (keys, self.units(lower), contexts, self.units(weight)))

    @staticmethod
    def units(p: np.ndarray) -> np.ndarray:
        return np.rint(-np.log2(p) * (1 << UNIT)).astype(np.int32)

    def __call__(self, code: np.ndarray) -> np.ndarray:
        """Units of each code, a column a language."""
        keys, values, _, _ = self.levels[0]
        at, seen = find(keys, code)
        out = values[at] if len(keys) else np.zeros((len(code), self.single.shape[1]), np.int32)
        new = np.flatnonzero(~seen)
        if len(new):
            some, back = np.unique(code[new], return_inverse=True)
            out[new] = self.unseen(some)[back]
        return out

    def unseen(self, code: np.ndarray) -> np.ndarray:
        """Units of codes that are no key of the highest order: weights down to the first order that has the shorter code."""
        out, left = np.zeros((len(code), self.single.shape[1]), np.int32), np.arange(len(code))
        for k, (keys, values, contexts, weights) in zip(range(ORDER, 1, -1), self.levels, strict=True):
            part = tail(code[left], k)
            at, seen = find(keys, part)
            out[left[seen]] += values[at[seen]]
            left, part = left[~seen], part[~seen]
            at, seen = find(contexts, part >> BITS)
            out[left[seen]] += weights[at[seen]]
        at, seen = find(self.letters, tail(code[left], 1))
        out[left] += self.single[np.where(seen, at, len(self.letters))]
        return out


class Grams:
    """What is learnt of counts (lang, code, n): the names of the languages and the lots of their n-grams."""

    def __init__(self, counts: DataFrame):
        self.counts = counts.groupBy("lang", "code").agg(F.sum("n").alias("n"))
        shorter = lambda d, k: d.select("lang", tail(F.col("code"), k).alias("code")).groupBy("lang", "code").agg(F.count("*").alias("n"))
        levels = [self.counts, written(shorter(self.counts, ORDER - 1), "shorter-grams")]
        while len(levels) < ORDER:
            levels.append(shorter(levels[-1], ORDER - len(levels)))
        levels.reverse()
        rare = None
        for k, level in enumerate(levels):
            part = level.groupBy("lang").agg(F.count_if(F.col("n") == 1).alias("once"), F.count_if(F.col("n") == 2).alias("twice"), F.lit(k).alias("k"))
            rare = part if rare is None else rare.union(part)
        rows = rare.collect()  # a row a language and order
        self.langs, self.lots = sorted({r["lang"] for r in rows}), []
        if not rows:
            return
        place = {lang: i for i, lang in enumerate(self.langs)}
        self.discount = np.full((ORDER, len(self.langs)), 0.5)
        for r in rows:
            if r["once"]:
                self.discount[r["k"], place[r["lang"]]] = min(max(r["once"] / (r["once"] + 2 * r["twice"]), 0.1), 0.9)
        got = levels[0].toArrow()  # a row a language and letter
        letter = got.column("code").to_numpy()
        self.letters, at = np.unique(letter, return_inverse=True)
        count = np.zeros((len(self.letters) + 1, len(self.langs)))
        lang = np.array([place[x] for x in got.column("lang").to_pylist()], np.int64)
        np.add.at(count, (at, lang), got.column("n").to_numpy())
        total = np.maximum(count.sum(axis=0), 1)
        spare = np.where(count.sum(axis=0) > 0, self.discount[0] * (count > 0).sum(axis=0) / total, 1.0)
        self.single = np.maximum(count - self.discount[0], 0) / total + spare / (1 << BITS)
        # a row a letter
        sizes = self.counts.groupBy(tail(F.shiftright("code", BITS), 1).alias("before")).count().orderBy("before").collect()
        starts, room = [], 0
        for r in sizes:
            need = r["count"] * len(self.langs)
            if need > room:
                starts.append(r["before"] if starts else 0)
                room = LOT_VALUES
            room -= need
        self.lots = [(low, high - 1) for low, high in zip(starts, [*starts[1:], 1 << BITS], strict=True)]

    def lot(self, low: int, high: int) -> Lot:
        got = self.counts.where(tail(F.shiftright("code", BITS), 1).between(low, high)).toArrow()  # LOT_VALUES values at most, or one letter's
        lang = pc.index_in(got.column("lang"), pa.array(self.langs)).to_numpy().astype(np.int64)
        return Lot(lang, got.column("code").to_numpy(), got.column("n").to_numpy(), self.discount, self.letters, self.single)


def counted(docs: DataFrame) -> DataFrame:
    """(lang, aside, code, n): n-grams of docs (text, lang, aside), written."""
    rows = docs.where("lang is not null and text is not null").select("lang", "aside", "text").mapInArrow(count_grams, "lang string, aside boolean, code long, n long")
    return written(rows.groupBy("lang", "aside", "code").agg(F.sum("n").alias("n")), "grams")


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")) % 4 == 2


def sum_units(share):
    """The columns after the first with units (a language), chars and letters of the text in the first column."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = share.value
        for batch in batches:
            for first, to, data, offsets in slices(batch.column(0), FOLDED_BYTES):
                text = Folded(data, offsets, ORDER)
                units = np.zeros((len(text.length), m.langs), np.int64)
                before = tail(text.code >> BITS, 1)
                use = text.scored & (before >= m.low) & (before <= m.high)
                if m.low == 0 and m.high == (1 << BITS) - 1:
                    values = m.lot(text.code)
                    values[~use] = 0
                    units[:] = np.add.reduceat(values, text.first[:-1], axis=0, dtype=np.int64)
                else:
                    np.add.at(units, text.doc[use], m.lot(text.code[use]))
                sums = pa.ListArray.from_arrays(pa.array(np.arange(len(units) + 1, dtype=np.int32) * m.langs), pa.array(units.ravel()))
                yield pa.RecordBatch.from_arrays([*(c[first:to] for c in batch.columns[1:]), sums, pa.array(text.length.astype(np.int64)), pa.array(text.letters.astype(np.int64))], [*batch.schema.names[1:], "_units", "_chars", "_letters"])

    return task


def scored(docs: DataFrame, grams: Grams, carry: list[str], name: str) -> DataFrame:
    """carry, lang_pred (null without a letter), score, bits (a character), chars."""
    spark, one = docs.sparkSession, len(grams.lots) == 1
    kept, found = docs.select(F.col("text").alias("_text"), *carry), []
    if not one:
        kept = written(kept.withColumn("_row", F.monotonically_increasing_id()), f"{name}-texts")
    for low, high in grams.lots:
        share = spark.sparkContext.broadcast(SimpleNamespace(lot=grams.lot(low, high), langs=len(grams.langs), low=low, high=high))
        source = kept if one else kept.select("_text", "_row")
        fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in source.schema.fields[1:])
        found.append(written(source.mapInArrow(sum_units(share), f"{fields}_units array<long>, _chars long, _letters long"), f"{name}-units"))
        released(share)
    units = found[0]
    if not one:
        for part in found[1:]:
            units = units.union(part)
        units = units.groupBy("_row").agg(F.collect_list("_units").alias("_lists"), F.max("_chars").alias("_chars"), F.max("_letters").alias("_letters"))
        total = F.reduce(F.slice("_lists", 2, len(found)), F.get("_lists", F.lit(0)), lambda a, b: F.zip_with(a, b, lambda x, y: x + y))
        units = kept.drop("_text").join(units.withColumn("_units", total).drop("_lists"), "_row")
    steps = F.greatest(F.col("_chars") - 1, F.lit(1)) * float(1 << UNIT)
    least = F.array_min("_units")
    share = 1 / F.reduce("_units", F.lit(0.0), lambda s, x: s + F.pow(F.lit(2.0), (least - x) / steps * F.least("_chars", F.lit(CERTAIN_CHARS))))
    lang = F.element_at(F.array(*map(F.lit, grams.langs)), F.array_position("_units", least).cast("int"))
    some = F.col("_letters") > 0
    return units.select(*carry, F.when(some, lang).alias("lang_pred"), F.when(some, share).otherwise(0.0).alias("score"), F.when(some, least / steps).alias("bits"), F.col("_chars").alias("chars"))


def length_class(chars: Column) -> Column:
    return F.floor(F.log2(chars)).cast("int")


def limits(calibration: DataFrame) -> DataFrame:
    """(lang_pred, length, limit): bits a character beyond which a text is rejected, and by length -1 for other lengths."""
    seen = calibration.where("lang_pred is not null")
    bins = seen.groupBy("lang_pred", length_class(F.col("chars")).alias("length"), F.ceil(F.col("bits") * 64).alias("bin")).count()
    over = Window.partitionBy("lang_pred", "length").orderBy(F.desc("bin"))
    total = Window.partitionBy("lang_pred", "length")
    bins = bins.withColumn("above", F.sum("count").over(over) - F.col("count")).withColumn("n", F.sum("count").over(total))
    by_class = bins.where(F.col("above") <= F.col("n") * FALSE_RATE).groupBy("lang_pred", "length").agg(F.max("n").alias("n"), (F.min("bin") / 64 + MARGIN).alias("limit"))
    any_length = bins.groupBy("lang_pred").agg(F.lit(-1).alias("length"), (F.max("bin") / 64 * FEW).alias("limit"))
    return by_class.where(F.col("n") >= ENOUGH).select("lang_pred", "length", "limit").union(any_length)


def identify(docs: DataFrame, train_on: DataFrame, carry: list[str]) -> DataFrame:
    """The columns `carry` of docs with lang_pred, score, bits (a character), rejected. train_on has text and lang."""
    small_batches(docs.sparkSession)
    train_on = train_on.select("text", "lang", (F.pmod(F.xxhash64("text"), F.lit(CALIBRATE)) == 0).alias("aside"))
    counts = counted(train_on)
    grams = Grams(counts)
    if not grams.langs:
        return docs.select(*carry, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(None).cast("double").alias("bits"), F.lit(True).alias("rejected"))
    without = Grams(counts.where(~F.col("aside")))
    asked = train_on.where(F.col("aside") & F.col("lang").isNotNull() & F.col("text").isNotNull())
    calibration = scored(asked if without.langs else asked.where("false"), without if without.langs else grams, [], "language-calibration")
    # rows a language and length class: no more than the model, which is broadcast too
    limit = written(limits(calibration), "language-limits")
    out = scored(docs, grams, carry, "language-scores")
    exact = F.broadcast(limit.where("length >= 0").select("lang_pred", F.col("length").alias("_length"), F.col("limit").alias("_exact")))
    rest = F.broadcast(limit.where("length < 0").select("lang_pred", F.col("limit").alias("_rest")))
    out = out.withColumn("_length", length_class(F.col("chars"))).join(exact, ["lang_pred", "_length"], "left").join(rest, "lang_pred", "left")
    rejected = F.col("lang_pred").isNull() | F.coalesce(F.col("bits") > F.coalesce("_exact", "_rest"), F.lit(False))
    return out.select(*carry, F.coalesce("lang_pred", F.lit("und")).alias("lang_pred"), "score", "bits", rejected.alias("rejected"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learnt from those not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", held_out(F.col("doc_id")).alias("held_out"))
    return identify(docs, docs.where(~F.col("held_out") & F.col("lang").isNotNull()), ["doc_id", "held_out"])
