"""Numbers of tokens of texts, by the library of a public tokenizer, in Arrow batches that give back lengths only.

A text is cut at safe boundaries, where the tokenizer's own splitting always cuts too, so that the lengths of the pieces add up to
the length of the text; each different piece of a worker is encoded once (KEPT of them are remembered at most). Boundaries are known for byte-level tokenizers with the
usual split pattern: a lone space between two characters that are no white space, and, in pieces that stay long, between ASCII
letters and digits or between a CJK letter and CJK punctuation. For other tokenizers each text is one piece. Pieces go to the library in batches of
about BATCH_BYTES. Texts beyond `long_bytes` are cut in the first pass and their parts dealt to all tasks, so that one text of any
length isn't one task's work (a text without a safe boundary stays whole).

Nulls and edges: a null or empty text has 0 bytes and 0 tokens; the string of a special token inside a text is that token, as the
library has it by default; null, repeated and shared ids are rows like others (one row out for each row in); columns other than id
and text aren't read; an empty table gives an empty result.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_batches, table, written

TOKENIZER = "byte_bpe_50k.json"
BATCH_BYTES, LONG_BYTES, PART_BYTES = 1 << 20, 1 << 20, 1 << 18
KEPT, KEPT_CHARS = 600_000, 32
LIMIT = 1024

# white space of Python's and the tokenizer's tables together
SAFE = re.compile("(?<=[^\\s᠎]) (?=[^\\s᠎])")
UNSAFE = re.compile("(?<![^\\s᠎]) | (?![^\\s᠎])")
CJK, CJK_STOPS = "ぁ-ゖァ-ヺ一-龥가-힣", "、。，！？：；"
INNER = re.compile(f"(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])|(?<=[{CJK}])(?=[{CJK_STOPS}])")


def parts(text: str, pattern: re.Pattern, size: int) -> Iterator[str]:
    """Cut text at the first boundary after each `size` characters."""
    at = 0
    while len(text) - at > size and (m := pattern.search(text, at + size)):
        yield text[at : m.start()]
        at = m.start()
    yield text[at:]


def safe_parts(text: str, size: int) -> Iterator[str]:
    for part in parts(text, SAFE, size):
        yield from parts(part, INNER, size) if len(part) > 2 * size else (part,)


class Counter:
    """Counts tokens of texts with one tokenizer file; made once in each task."""

    def __init__(self, name: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has the cores
        path = public_tokenizers.path(name)
        if name.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.lengths: Callable[[list[str]], list[int]] = lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
            self.splits = False
        else:
            from tokenizers import Tokenizer

            model = Tokenizer.from_file(path)
            model.no_truncation()
            model.no_padding()
            self.lengths = lambda texts: [len(x) for x in model.encode_batch_fast(texts, add_special_tokens=False)]
            added = model.get_added_tokens_decoder().values()
            plain = all(not (t.lstrip or t.rstrip or t.single_word or INNER.search(t.content) or re.search("\\s", t.content)) for t in added)
            self.splits = plain and model.normalizer is None and "ByteLevel(add_prefix_space=False" in str(model.pre_tokenizer) and "use_regex=True" in str(model.pre_tokenizer)
        self.heads: dict[str, int] = {}
        self.known: dict[str, int] = {}

    def encoded(self, texts: list[str]) -> list[int]:
        """Lengths of texts, in batches of about BATCH_BYTES (of characters, which are a byte or more)."""
        out, batch, size = [], [], 0
        for t in texts:
            batch.append(t)
            size += len(t)
            if size >= BATCH_BYTES:
                out += self.lengths(batch)
                batch, size = [], 0
        return out + self.lengths(batch) if batch else out

    def learn(self, known: dict[str, int], pieces: Iterator[str], space: str) -> list[str]:
        """Counts of all pieces into known; gives those too long to be kept there."""
        new = list(set(pieces).difference(known))
        known.update(zip(new, self.encoded([space + x for x in new]), strict=True))
        return [x for x in new if len(x) > KEPT_CHARS]

    def count(self, texts: list[str]) -> list[int]:
        if not self.splits:
            return self.encoded(texts)
        if len(self.known) + len(self.heads) > KEPT:
            self.known.clear()
            self.heads.clear()
        plain = [i for i, t in enumerate(texts) if t and not UNSAFE.search(t)]
        out = [0] * len(texts)
        if plain:
            # words of a batch as a dictionary, so that Python sees each different one once
            lists = pc.split_pattern(pa.array([texts[i] for i in plain], pa.large_string()), " ")
            words, starts = lists.flatten().dictionary_encode(), lists.offsets.to_numpy()[:-1]
            names = words.dictionary.to_pylist()
            large = {x for x in names if len(x) > PART_BYTES}
            index = words.indices.to_numpy().copy()
            heads = [names[j] for j in index[starts]]
            drop = self.learn(self.heads, (y for x in set(heads) for y in parts(x, INNER, PART_BYTES)), "")
            drop_rest = self.learn(self.known, (x for x in names if x not in large), " ")
            wide = {x: sum(self.encoded([*parts(" " + x, INNER, PART_BYTES)])) for x in large}
            length = np.array([wide[x] if x in wide else self.known[x] for x in names], np.int64)[index]
            length[starts] = [sum(self.heads[y] for y in parts(x, INNER, PART_BYTES)) for x in heads]
            for i, n in zip(plain, np.add.reduceat(length, starts).tolist(), strict=True):
                out[i] = n
            self.forget(drop, drop_rest)
        odd = [i for i, t in enumerate(texts) if t and not out[i]]
        if odd:
            cuts = [SAFE.split(texts[i]) for i in odd]
            found = [[y for j, x in enumerate(c) for y in parts(" " + x if j else x, INNER, PART_BYTES)] for c in cuts]
            drop = self.learn(self.heads, chain.from_iterable(found), "")
            for i, pieces in zip(odd, found, strict=True):
                out[i] = sum(map(self.heads.__getitem__, pieces))
            self.forget(drop, [])
        return out

    def forget(self, heads: list[str], rest: list[str]) -> None:
        for x in heads:
            del self.heads[x]
        for x in rest:
            del self.known[x]


def by_bytes(values: list[str | None], size: int) -> Iterator[tuple[int, int]]:
    """(from, to) of runs of about so many characters."""
    first = total = 0
    for i, v in enumerate(values):
        total += len(v or "")
        if total >= size:
            yield first, i + 1
            first, total = i + 1, 0
    if first < len(values):
        yield first, len(values)


def first_pass(name: str, long_bytes: int):
    """id, n_bytes, text to id, n_bytes, n_tokens, row, part: short texts with their tokens, long ones as parts of one row."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        counter, row = Counter(name), TaskContext.get().partitionId() << 33
        for batch in batches:
            ids, sizes, texts = batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist()
            short = [i for i, n in enumerate(sizes) if n <= long_bytes]
            for first, to in by_bytes([texts[i] for i in short], BATCH_BYTES):
                at = short[first:to]
                counts = counter.count([texts[i] or "" for i in at])
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(at)), pa.array([sizes[i] for i in at], pa.int64()), pa.array(counts, pa.int64()), pa.nulls(len(at), pa.int64()), pa.nulls(len(at), pa.string())],
                    ["id", "n_bytes", "n_tokens", "row", "part"],
                )
            for i in (i for i, n in enumerate(sizes) if n > long_bytes):
                row += 1
                cut = safe_parts(texts[i], PART_BYTES) if counter.splits else [texts[i]]
                for x in cut:
                    yield pa.RecordBatch.from_arrays(
                        [ids.slice(i, 1), pa.array([sizes[i]], pa.int64()), pa.nulls(1, pa.int64()), pa.array([row], pa.int64()), pa.array([x])],
                        ["id", "n_bytes", "n_tokens", "row", "part"],
                    )

    return task


def second_pass(name: str):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(name)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            counts = [n for first, to in by_bytes(texts, BATCH_BYTES) for n in counter.count(texts[first:to])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(counts, pa.int64())], [*batch.schema.names[:-1], "n_tokens"])

    return task


def count_tokens(docs: DataFrame, tokenizer: str = TOKENIZER, id: str = "doc_id", text: str = "text", long_bytes: int = LONG_BYTES) -> DataFrame:
    """id, n_bytes, n_tokens of every row of docs."""
    byte_batches(docs.sparkSession)
    kind = docs.schema[id].dataType.simpleString()
    asked = docs.select(F.col(id).alias("id"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), F.col(text).alias("text"))
    first = asked.mapInArrow(first_pass(tokenizer, long_bytes), f"id {kind}, n_bytes long, n_tokens long, row long, part string")
    # written once, with the texts of long rows alone, so that rows of a lost task keep their numbers
    first = written(first, "token-counts")
    long = first.where("row is not null").select("id", "n_bytes", "row", "part")
    tasks = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))
    dealt = long.repartition(tasks, F.xxhash64("part")).mapInArrow(second_pass(tokenizer), f"id {kind}, n_bytes long, row long, n_tokens long")
    whole = dealt.groupBy("row").agg(F.first("id").alias("id"), F.first("n_bytes").alias("n_bytes"), F.sum("n_tokens").alias("n_tokens"))
    return first.where("row is null").select(F.col("id").alias(id), "n_bytes", "n_tokens").unionByName(whole.select(F.col("id").alias(id), "n_bytes", "n_tokens"))


def op11_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of tokens of all documents, and whether they pass a context of LIMIT tokens."""
    counted = count_tokens(table(spark, sf_dir, "documents"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))
