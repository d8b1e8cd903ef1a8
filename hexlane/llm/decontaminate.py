"""Benchmark passages in documents, also paraphrased: latent semantic retrieval, then word-by-word checks.

Words are lower-cased runs without ASCII punctuation; terms are word hashes in 2**FEATURE_BITS slots. A term's squared weight
is 1 + ln((documents + 1) / (frequency + 1)) over all documents, so that no term is left out, however frequent. Items are cut
into pieces of at most PIECE_WORDS words, and taken PIECES pieces at a time: one pass over the corpus finds the passages
(windows of two HALF-word blocks, each benchmark term once) that hold POOL of a piece's weight, or as many of its words and as
much of its weight as any run of the piece's length with PARAPHRASE of its words must have in its best window (needs(); such
a passage is `sure`). A piece's rarest terms lead to it: those without which neither can be.

Those passages, LOT pieces' at a time, are a TF-IDF matrix, and its randomised singular value decomposition (one distributed
sketch and POWER more passes) spans the latent space of RANK dimensions. A passage is a candidate by its product with the
piece there, as a share of the piece's own; words around an item do not lower it. Passages that are sure but that the space
has no room for (they fail there) get a space of their own, with fewer of them each time, so none is lost to truncation.
A candidate is a leak if the longest common subsequence of the piece and the words around the passage has LCS of the piece's
words; or PARAPHRASE of them and LCS of its last quarter, which holds the answer; or only LOOSE of them and all of the answer,
where the cosine in the latent space is NEAR: what replaced the other words then stands for them in other passages as well.

Nulls and edges: null and empty texts have no passage; items without words and null items leak nowhere; null ids are kept;
equal rows leak alike; empty tables give an empty result. Only doc_id, text, item_id and the item's text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import released, row_id, small_batches, table, written
from .words import Words, slices

FEATURE_BITS, HALF, PIECES, PIECE_WORDS = 18, 32, 50_000, 48
RANK, SPARE, POWER, LOT, SKETCH_ROWS, SPLITS = 160, 8, 1, 100, 50_000, 40
LCS, PARAPHRASE, LOOSE, POOL, SHARE, NEAR, PRESENT = 0.8, 0.6, 0.45, 0.35, 0.5, 0.8, 0.1
PLAIN = np.arange(256, dtype=np.uint8)
for _c in range(128):
    if not chr(_c).isalnum():
        PLAIN[_c] = 32
    elif chr(_c).isupper():
        PLAIN[_c] = _c + 32


def plain_words(data: np.ndarray, offsets: np.ndarray) -> Words:
    return Words(PLAIN[data], offsets)


def slot(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - FEATURE_BITS)).astype(np.int64)


def document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(slot, documents with a word of it); slot -1 has the number of documents."""
    total, docs = np.zeros(1 << FEATURE_BITS, np.int64), 0
    for batch in batches:
        docs += batch.num_rows
        for _, _, data, offsets in slices(batch.column(0)):
            words = plain_words(data, offsets)
            total += np.bincount(np.unique((words.doc << FEATURE_BITS) | slot(words.hash)) & ((1 << FEATURE_BITS) - 1), minlength=len(total))
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1).astype(np.int32)), pa.array(np.append(total[some], docs))], ["slot", "n"])


def weights(docs: DataFrame) -> np.ndarray:
    """Squared weight of each slot, its smoothed IDF: at most 2**FEATURE_BITS rows reach the driver."""
    got = docs.select("text").mapInArrow(document_counts, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    at, n = got.column("slot").to_numpy(), got.column("n").to_numpy()
    total = n[at < 0].sum()
    df = np.zeros(1 << FEATURE_BITS)
    df[at[at >= 0]] = n[at >= 0]
    return 1 + np.log((total + 1) / (df + 1))


def pieces(items: list[tuple]) -> list[SimpleNamespace]:
    """Pieces of at most PIECE_WORDS words of the benchmark items (id, text)."""
    out = []
    texts = pa.array([t for _, t in items], pa.string())
    for first, _, data, offsets in slices(texts):
        words = plain_words(data, offsets)
        for i in range(words.n_docs):
            own = words.hash[words.first[i] : words.first[i + 1]]
            cuts = max(1, -(-len(own) // PIECE_WORDS))
            out += [SimpleNamespace(item=items[first + i][0], words=part) for part in np.array_split(own, cuts) if len(part)]
    return out


def piece_blocks(items: Iterator[tuple]) -> Iterator[list[SimpleNamespace]]:
    """Pieces of all items, PIECES at a time, whatever the length of the items."""
    block: list[SimpleNamespace] = []
    for item in items:
        block += pieces([item])
        while len(block) >= PIECES:
            yield block[:PIECES]
            block = block[PIECES:]
    if block:
        yield block


def needs(squared: np.ndarray, piece: np.ndarray) -> tuple[float, int]:
    """Least weight and number of the piece's terms in the best window of a run of its length with PARAPHRASE of its words."""
    n = len(piece)
    inside = min(max(min(at + n, w + 2 * HALF) - max(at, w) for w in range(0, n + HALF, HALF)) for at in range(HALF))
    words = max(1, int(np.ceil(PARAPHRASE * n - 1e-9)) - (n - inside))
    return float(np.sort(squared[slot(piece)])[:words].sum()) * (1 - 1e-6), max(1, words - (n - len(np.unique(slot(piece)))))


class Postings:
    """The terms of a block of pieces, and the pieces that each term leads to."""

    def __init__(self, squared: np.ndarray, block: list[SimpleNamespace]):
        self.items, self.words = [p.item for p in block], [p.words for p in block]
        terms = [np.unique(slot(p.words)) for p in block]
        self.terms, self.first = np.concatenate(terms), np.concatenate(([0], np.cumsum([len(t) for t in terms])))
        self.weight = squared[self.terms]
        self.total = np.add.reduceat(self.weight, self.first[:-1])
        least = [needs(squared, p.words) for p in block]
        self.need, self.need_words = np.array([x[0] for x in least]), np.array([x[1] for x in least])
        leads, to = [], []
        for i, t in enumerate(terms):
            t = t[np.argsort(squared[t], kind="stable")]
            # without any of these no passage has what it takes
            leads.append(t[np.cumsum(squared[t]) >= min(self.need[i], POOL * self.total[i]) * (1 - 1e-6)])
            to.append(np.full(len(leads[-1]), i))
        lead, to = np.concatenate(leads), np.concatenate(to)
        order = np.argsort(lead, kind="stable")
        self.to = to[order]
        self.start = np.searchsorted(lead[order], np.arange((1 << FEATURE_BITS) + 1))
        self.known = np.zeros(1 << FEATURE_BITS, bool)
        self.known[self.terms] = True

    def passages(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """half-block starts of passages that hold enough of a piece: (document, first half-block, piece, sure), and sorted keys
        (half-block, term) of all benchmark terms in the texts and the half-blocks' documents."""
        blocks = -(-words.count // HALF)
        first = np.concatenate(([0], np.cumsum(blocks)))
        half = first[words.doc] + (np.arange(len(words)) - words.first[words.doc]) // HALF
        owner = np.repeat(np.arange(words.n_docs), blocks)
        at = slot(words.hash)
        use = self.known[at]
        keys = np.unique(half[use] << FEATURE_BITS | at[use])
        h, t = keys >> FEATURE_BITS, keys & ((1 << FEATURE_BITS) - 1)
        n = self.start[t + 1] - self.start[t]
        hit = np.repeat(h, n)
        piece = self.to[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.start[t], n)]
        joined = np.append(owner[1:] == owner[:-1], False)
        before = np.flatnonzero((hit > 0) & joined[np.maximum(hit - 1, 0)])
        pairs = np.unique(np.concatenate((hit * len(self.items) + piece, (hit[before] - 1) * len(self.items) + piece[before])))
        window, piece = pairs // len(self.items), pairs % len(self.items)
        if not len(pairs):
            return owner[:0], window, piece, np.zeros(0, bool), keys, owner
        n = self.first[piece + 1] - self.first[piece]
        start = np.cumsum(n) - n
        at = np.repeat(self.first[piece], n) + np.arange(n.sum()) - np.repeat(start, n)
        place = np.repeat(window, n)

        def holds(half: np.ndarray) -> np.ndarray:
            wanted = half << FEATURE_BITS | self.terms[at]
            return keys[np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)] == wanted

        held = holds(place) | (joined[place] & holds(place + 1))
        weight, count = np.add.reduceat(held * self.weight[at], start), np.add.reduceat(held, start, dtype=np.int64)
        sure = (weight >= self.need[piece]) & (count >= self.need_words[piece])
        some = sure | (weight >= POOL * self.total[piece])
        return owner[window[some]], window[some], piece[some], sure[some], keys, owner


def sift(share):
    """(rk, doc_id, piece, sure, terms, region): passages that hold enough of a piece, and the words around them."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Postings = share.value
        for batch in batches:
            rows, terms, regions, found, certain = [], [], [], [], []
            for first, _, data, offsets in slices(batch.column(2)):
                words = plain_words(data, offsets)
                if not len(words):
                    continue
                doc, window, piece, sure, keys, owner = m.passages(words)
                heads = np.searchsorted(owner, np.arange(words.n_docs))
                for d, w, p in zip(doc.tolist(), window.tolist(), piece.tolist(), strict=True):
                    both = 1 + (w + 1 < len(owner) and owner[w + 1] == d)
                    own = keys[np.searchsorted(keys, w << FEATURE_BITS) : np.searchsorted(keys, (w + both) << FEATURE_BITS)]
                    terms.append(np.unique(own & ((1 << FEATURE_BITS) - 1)).astype(np.int32).tobytes())
                    start, n = words.first[d] + (w - heads[d]) * HALF, len(m.words[p])
                    regions.append(words.hash[max(words.first[d], start - n) : min(words.first[d + 1], start + 2 * HALF + n)].tobytes())
                rows.append(doc + first)
                found.append(piece)
                certain.append(sure)
            if terms:
                at = pa.array(np.concatenate(rows))
                columns = [batch.column(0).take(at), batch.column(1).take(at), pa.array(np.concatenate(found).astype(np.int32)), pa.array(np.concatenate(certain)), pa.array(terms, pa.binary()), pa.array(regions, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["rk", "doc_id", "piece", "sure", "terms", "region"])

    return task


def group_sum(rows: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of rows by sorted keys."""
    at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[at], np.add.reduceat(rows, at, axis=0) if len(at) else rows[:0]


class Space:
    """The terms of a lot of pieces with their weights, and a matrix with a row a term."""

    def __init__(self, terms: np.ndarray, weight: np.ndarray, rows: np.ndarray):
        self.terms, self.weight, self.rows = terms, weight, rows.astype(np.float32)

    def products(self, terms: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Owner, term and weight of each entry of the passages with these terms, and a row a passage: its product with the matrix."""
        at = [np.frombuffer(t, np.int32) for t in terms]
        owner, at = np.repeat(np.arange(len(at)), [len(a) for a in at]), np.concatenate([*at, np.zeros(0, np.int32)])
        place = np.minimum(np.searchsorted(self.terms, at), len(self.terms) - 1)
        use = self.terms[place] == at
        owner, place = owner[use], place[use]
        w = self.weight[place].astype(np.float32)
        keys, sums = group_sum(self.rows[place] * w[:, None], owner)
        out = np.zeros((len(terms), self.rows.shape[1]), np.float32)
        out[keys] = sums
        return owner, place, w, out


def sketch(share):
    """Rows of A'A times the space's matrix, summed over a task: (term, row)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Space = share.value
        total = np.zeros(m.rows.shape, np.float32)
        for batch in batches:
            owner, place, w, product = m.products(batch.column(0).to_pylist())
            order = np.argsort(place, kind="stable")
            terms, values = group_sum((product[owner] * w[:, None])[order], place[order])
            total[terms] += values
        some = np.flatnonzero(np.any(total, axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array([total[i].tobytes() for i in some], pa.binary())], ["term", "row"])

    return task


def add_rows(pdf: pd.DataFrame) -> pd.DataFrame:
    out = {}
    for term, rows in pdf.groupby("term")["row"]:
        out[term] = np.sum([np.frombuffer(r, np.float32) for r in rows], axis=0, dtype=np.float64).astype(np.float32).tobytes()
    return pd.DataFrame({"term": list(out), "row": list(out.values())})


def common_subsequence(piece: np.ndarray, region: np.ndarray) -> int:
    """Length of the longest common subsequence, bit-parallel over the piece."""
    masks: dict[int, int] = {}
    for i, w in enumerate(piece.tolist()):
        masks[w] = masks.get(w, 0) | 1 << i
    full = (1 << len(piece)) - 1
    row = full
    for w in region.tolist():
        if w in masks:
            hit = row & masks[w]
            row = ((row + hit) | (row - hit)) & full
    return len(piece) - row.bit_count()


def judge(share):
    """(rk, doc_id, piece, sure, terms, region, item_id, cosine, lcs) of leaks; of sure passages that are no candidates, without
    an item_id."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = share.value
        for batch in batches:
            keep, items, cosines, parts = [], [], [], []
            if batch.num_rows:
                _, _, _, latent = m.space.products(batch.column(4).to_pylist())
                piece, sure = batch.column(2).to_numpy() - m.low, batch.column(3).to_numpy(zero_copy_only=False)
                dot, norm = np.einsum("ij,ij->i", latent, m.latent[piece]), np.einsum("ij,ij->i", m.latent, m.latent)
                there = norm[piece] >= PRESENT * m.total[piece]
                candidate = there & (dot >= m.least[piece] * norm[piece])
                length = norm[piece]
                if m.last:
                    # no space of fewer passages would hold more of them: what must be looked at is, by its plain cosine
                    candidate |= sure
                    length = np.where(there, length, m.total[piece])
                cosine = dot / np.sqrt(np.maximum(length * np.einsum("ij,ij->i", latent, latent), 1e-9))
            for i in range(batch.num_rows):
                if not candidate[i]:
                    if sure[i]:
                        keep.append(i)
                        items.append(None)
                        cosines.append(None)
                        parts.append(None)
                    continue
                words, region = m.words[piece[i]], np.frombuffer(batch.column(5)[i].as_buffer(), np.uint64)
                lcs = common_subsequence(words, region) / len(words)
                if lcs < (LOOSE if cosine[i] >= NEAR else PARAPHRASE):
                    continue
                answer = words[-max(3, len(words) // 4) :]
                if lcs >= LCS or common_subsequence(answer, region) >= (LCS if lcs >= PARAPHRASE else 1) * len(answer):
                    keep.append(i)
                    items.append(m.items[piece[i]])
                    cosines.append(float(cosine[i]))
                    parts.append(lcs)
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([*(c.take(at) for c in batch.columns), pa.array(items, pa.int64()), pa.array(cosines, pa.float64()), pa.array(parts, pa.float64())], [*batch.schema.names, "item_id", "cosine", "lcs"])

    return task


PASSAGE = "rk binary, doc_id long, piece int, sure boolean, terms binary, region binary"


def latent_space(passages: DataFrame, space: Space, count: int) -> Space:
    """The leading singular directions of the passages, from a random matrix in `space`."""
    spark = passages.sparkSession
    if passages.rdd.getNumPartitions() > count // SKETCH_ROWS + 1:
        passages = passages.coalesce(count // SKETCH_ROWS + 1)
    for last in (*[False] * POWER, True):
        share = spark.sparkContext.broadcast(space)
        got = passages.select("terms").mapInArrow(sketch(share), "term int, row binary")
        got = got.withColumn("lot", F.pmod("term", F.lit(64))).groupBy("lot").applyInPandas(add_rows, "term int, row binary").toArrow()
        released(share)
        total = np.zeros(space.rows.shape, np.float64)
        for term, row in zip(got.column("term").to_pylist(), got.column("row").to_pylist(), strict=True):
            total[term] = np.frombuffer(row, np.float32)
        if not last:
            space = Space(space.terms, space.weight, np.linalg.qr(total)[0])
    left, size, _ = np.linalg.svd(total, full_matrices=False)
    return Space(space.terms, space.weight, left[:, : max(1, int((size > 1e-6 * max(size[0], 1e-30)).sum()))][:, :RANK])


def lot_leaks(passages: DataFrame, index: Postings, low: int, high: int, squared: np.ndarray) -> list[DataFrame]:
    """Leaks among passages of the pieces from low to high - 1.

    Passages that must be candidates but that a space has no room for get a space of fewer passages. That ends: RANK passages or
    fewer fit whole into their space, where all of them are judged, as at SPLITS rounds; other rounds halve the rows, or deal
    different rows in two.
    """
    spark, found, rng = passages.sparkSession, [], np.random.default_rng(5)
    terms = np.unique(index.terms[index.first[low] : index.first[high]])
    weight = np.sqrt(squared[terms])
    queue = [(passages, passages.count(), 0)]
    while queue:
        rows, count, depth = queue.pop()
        if not count:
            continue
        start = Space(terms, weight, rng.normal(size=(len(terms), min(RANK, len(terms)) + SPARE)))
        space = latent_space(rows, start, count)
        latent = space.products([index.terms[index.first[p] : index.first[p + 1]].astype(np.int32).tobytes() for p in range(low, high)])[3]
        total = index.total[low:high]
        share = spark.sparkContext.broadcast(SimpleNamespace(
            space=space, latent=latent, total=total, low=low, last=count <= RANK or depth >= SPLITS, words=index.words[low:high], items=index.items[low:high], least=np.minimum(SHARE, 0.9 * index.need[low:high] / total)
        ))
        judged = written(rows.mapInArrow(judge(share), f"{PASSAGE}, item_id long, cosine double, lcs double"), "judged-passages")
        released(share)
        found.append(judged.where("item_id is not null").select("rk", "doc_id", "item_id", "cosine", "lcs"))
        left = judged.where("item_id is null").select(rows.columns)
        n = left.count()
        if 2 * n <= count:
            queue.append((left, n, depth + 1))
        else:
            different = ["rk", "piece", "terms", "region"]
            half = F.pmod(F.xxhash64(*different, F.lit(depth)), F.lit(2))
            left = written(left.dropDuplicates(different).withColumn("half", half), "split-passages")
            parts = [left.where(F.col("half") == i).drop("half") for i in range(2)]
            queue += [(p, p.count(), depth + 1) for p in parts]
    return found


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """rk (row id of doc_id and text), doc_id, item_id, cosine, lcs: one row a document and leaked item."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select("doc_id", "text", row_id("doc_id", "text").alias("rk"))
    squared, found = None, None
    rows = benchmark.where("text is not null").select("item_id", "text").toLocalIterator()
    for block in piece_blocks((r["item_id"], r["text"]) for r in rows):
        squared = weights(docs) if squared is None else squared
        index = Postings(squared, block)
        share = spark.sparkContext.broadcast(index)
        passages = written(docs.select("rk", "doc_id", "text").mapInArrow(sift(share), PASSAGE), "sifted-passages")
        released(share)
        for low in range(0, len(block), LOT):
            high = min(low + LOT, len(block))
            for part in lot_leaks(passages.where(F.col("piece").between(low, high - 1)), index, low, high, squared):
                found = part if found is None else found.union(part)
    if found is None:
        return spark.createDataFrame([], "rk binary, doc_id long, item_id long, cosine double, lcs double")
    return found.groupBy("rk", "doc_id", "item_id").agg(F.max("cosine").alias("cosine"), F.max("lcs").alias("lcs"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaked benchmark items: one row a document and item."""
    out = leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "item_id", F.round("cosine", 4).alias("cosine"), F.round("lcs", 4).alias("lcs"))
