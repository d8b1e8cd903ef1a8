"""Exact Jaccard self-join of shingle sets: size-aware, heavy-light.

Light (small) sets: enumerate all subsets of the sizes an overlap must have; sets that share such a subset overlap by its
size, so no further check is needed. The boundary is the largest size at which enumerating subsets is no dearer than listing.

Heavy (large) sets are first sifted: the hash space is cut into P parts, and as two linked sets differ in at most K shingles,
at least P - K parts agree entirely. A set goes on only if as many of its parts are repeated as a partner would need. Those
left are put on inverted lists of shingles: each on the lists of its rarest n - ceil(t * n) + 1 shingles, of which linked sets
share one, whatever the order; shingles of one set alone need no list. A list is sent as pointers to its head, a lot of sets
at a time, so that a shingle that a third of all documents have makes no long list. Sets that lists connect are
compared in lots. In a component of more than BLOCK sets, each block is first compared with a pivot and in itself; then only
sets that are not yet connected with most of the component meet those of all its blocks.

How often parts and shingles occur is counted, not looked up in a table of fixed size, which fills up as the input grows: the
sorted hashes of a lot go by bucket to where all lots' hashes of that bucket meet, and come back as a byte each.

Documents with equal sets form one class and are joined once. Nulls and edges: null, empty or blank text is an empty set
linked with nothing; a null doc_id links like any other, and its component is the least doc_id that is not null; an empty
table gives an empty result; equal rows are one class. Only doc_id, of any type that has an order, and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import KeyFilter, byte_batches, components, skew_join, table, written
from .words import Words, mix, slices

U = np.uint64
STRONG, BLOCK, MAP_BITS, LOT_SHINGLES, BROADCAST_CLASSES = 2, 2000, 1024, 1 << 16, 500_000
LIST_COST = 3  # a part is counted, looked up and its sets compared; a subset is only grouped


class Rule:
    """Similarity num / den, the size levels, the parts of each level, and the light-heavy boundary."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        bounds = [1]
        while bounds[-1] < 1 << 40:
            bounds.append(bounds[-1] * den // num + 1)
        self.bounds = np.array(bounds, np.int64)
        top = np.append(self.bounds[2:], [1 << 41, 1 << 42]) - 1
        self.top = top
        differ = 2 * top * (den - num) // (den + num)
        self.parts = (differ * 5) // 4 + 4
        self.light = 1
        while self.subsets(self.light + 1) <= LIST_COST * self.listed(self.light + 1):
            self.light += 1
        self.least_listed = -(-num * (self.light + 1) // den)

    def level(self, n: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.bounds, n, "right") - 1

    def deletions(self, n: int) -> int:
        return n - -(-self.num * n // self.den)

    def subsets(self, n: int) -> int:
        return sum(comb(n, d) for d in range(self.deletions(n) + 1))

    def listed(self, n: int) -> int:
        at = int(self.level(np.array([n]))[0])
        return int(self.parts[at] + (self.parts[at - 1] if at else 0))

    def differ(self, total: np.ndarray) -> np.ndarray:
        """Most shingles in which linked sets of these total sizes may differ."""
        return total * (self.den - self.num) // (self.den + self.num)


class Sets:
    """Sorted distinct shingle hashes of the texts of a slice: tok, first (offsets), n, and the 16-byte class of each."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, k: int):
        words = Words(data, offsets, lower=True)
        at = words.whole(k)
        doc, tok = words.doc[at], words.grams(k)[at] if len(at) else np.zeros(0, U)
        for c in range(1, k):
            short = np.flatnonzero(words.count == c)
            if len(short):
                doc, tok = np.concatenate((doc, short)), np.concatenate((tok, words.grams(c)[words.first[short]]))
        order = np.lexsort((tok, doc))
        doc, tok = doc[order], tok[order]
        new = np.ones(len(tok), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (tok[1:] != tok[:-1])
        self.doc, self.tok = doc[new], tok[new]
        self.n = np.bincount(self.doc, minlength=words.n_docs).astype(np.int64)
        self.first = np.concatenate(([0], np.cumsum(self.n)))
        self.cls = np.zeros((words.n_docs, 2), U)
        some = np.flatnonzero(self.n)
        if len(some):
            for i, salt in enumerate((0x5851F42D4C957F2D, 0x14057B7EF767814F)):
                self.cls[some, i] = mix(np.add.reduceat(mix(self.tok ^ U(salt)), self.first[some]) + self.n[some].astype(U))

    def one_a_class(self) -> np.ndarray:
        """First text of each class with a non-empty set."""
        some = np.flatnonzero(self.n)
        _, first = np.unique(self.cls[some].view("V16").ravel(), return_index=True)
        return some[np.sort(first)]


def part_hashes(sets: Sets, docs: np.ndarray, rule: Rule) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For the own and the lower level: (hashes, document of each, repeated parts that a partner needs by document).

    Parts of fewer than STRONG shingles are left out where the others suffice; a document for which they do not
    has all its parts, empty ones included.
    """
    out = []
    for below in (0, 1):
        level = rule.level(sets.n[docs]) - below
        ok = docs[level >= 0]
        level = level[level >= 0]
        if not len(ok):
            continue
        parts = np.zeros(len(sets.n), np.int64)
        parts[ok] = rule.parts[level]
        chosen = np.zeros(len(sets.n), bool)
        chosen[ok] = True
        pick = chosen[sets.doc]
        doc, tok = sets.doc[pick], sets.tok[pick]
        levels = np.zeros(len(sets.n), np.int64)
        levels[ok] = level
        part = ((tok >> U(32)) * parts[doc].astype(U)) >> U(32)
        new = np.ones(len(tok), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (part[1:] != part[:-1])
        at = np.flatnonzero(new)
        sums, size, owner, part = np.add.reduceat(mix(tok), at), np.diff(np.append(at, len(tok))), doc[at], part[at].astype(np.int64)
        partner = np.minimum(rule.top[level], sets.n[ok] * rule.den // rule.num)
        agree = np.zeros(len(sets.n), np.int64)
        agree[ok] = rule.parts[level] - rule.differ(sets.n[ok] + partner)
        strong = np.bincount(owner[size >= STRONG], minlength=len(sets.n))
        need = agree - (parts - strong)
        poor = chosen & (need < 1)
        use = (size >= STRONG) | poor[owner]
        sums, owner_used, part_used = sums[use], owner[use], part[use]
        if poor.any():
            blank = [(d, p) for d in np.flatnonzero(poor) for p in np.setdiff1d(np.arange(parts[d]), part[owner == d])]
            if blank:
                extra = np.array(blank, np.int64)
                sums, owner_used, part_used = np.append(sums, np.zeros(len(extra), U)), np.append(owner_used, extra[:, 0]), np.append(part_used, extra[:, 1])
        need[poor] = 1
        key = (levels[owner_used].astype(U) << U(48)) + part_used.astype(U)
        out.append((mix(sums + mix(key)), owner_used, need))
    return out


@lru_cache(maxsize=256)
def index_subsets(n: int, d: int) -> np.ndarray:
    return np.array(list(combinations(range(n), d)), np.int64).reshape(comb(n, d), d)


def subset_rows(sets: Sets, docs: np.ndarray, rule: Rule) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, size, document) of the subsets of each light set: its sum less those of the shingles left out."""
    keys, sizes, owner = [], [], []
    for n in np.unique(sets.n[docs]):
        rows = docs[sets.n[docs] == n]
        tok = mix(sets.tok[sets.first[rows][:, None] + np.arange(n)])
        total = tok.sum(axis=1, dtype=U)
        for d in range(rule.deletions(int(n)) + 1):
            if n == d:
                continue
            without = index_subsets(int(n), d)
            part = total[:, None] - tok[:, without].sum(axis=2, dtype=U)
            keys.append(mix(part + U(int(n) - d)).ravel())
            sizes.append(np.full(part.size, n - d))
            owner.append(np.repeat(rows, part.shape[1]))
    empty = np.zeros(0, np.int64)
    return (np.concatenate(keys), np.concatenate(sizes), np.concatenate(owner)) if keys else (np.zeros(0, U), empty, empty)


def binary(rows: np.ndarray) -> pa.Array:
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(rows), [None, pa.py_buffer(np.ascontiguousarray(rows))]).cast(pa.binary())


def in_buckets(hashes: np.ndarray) -> tuple[np.ndarray, pa.Array, pa.Array]:
    """The order that sorts hashes, and by bucket (their upper 10 bits) the next 32 bits of the sorted ones: a chance match only costs a look."""
    order = np.argsort(hashes, kind="stable")
    hashes = hashes[order]
    bucket = (hashes >> U(54)).astype(np.int32)
    at = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
    low = ((hashes >> U(22)) & U(0xFFFFFFFF)).astype(np.uint32)
    blob = pa.BinaryArray.from_buffers(pa.binary(), len(at), [None, pa.py_buffer((np.append(at, len(hashes)) * 4).astype(np.int32)), pa.py_buffer(low)])
    return order, pa.array(bucket[at]), blob


def size_classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lot, bucket, sizes) of (lot, bucket, blob): a byte a hash, 0 where it occurs once, else the size class of its count; all blobs of a
    bucket are in one partition."""
    got: dict[int, tuple[list, list[np.ndarray]]] = {}
    for batch in batches:
        for lot, bucket, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            lots, blobs = got.setdefault(bucket, ([], []))
            lots.append(lot)
            blobs.append(np.frombuffer(blob.as_buffer(), np.uint32))
    for bucket in list(got):
        lots, blobs = got.pop(bucket)
        to = np.append(0, np.cumsum([len(b) for b in blobs])).astype(np.int32)
        hashes = np.concatenate(blobs)
        order = np.argsort(hashes, kind="stable")
        hashes = hashes[order]
        at = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1]))
        count = np.diff(np.append(at, len(hashes)))
        sizes = np.empty(len(hashes), np.uint8)
        sizes[order] = np.repeat(np.minimum(8 * np.log2(count), 255).astype(np.uint8), count)
        blob = pa.BinaryArray.from_buffers(pa.binary(), len(lots), [None, pa.py_buffer(to), pa.py_buffer(sizes)])
        yield pa.RecordBatch.from_arrays([pa.array(lots, pa.int64()), pa.array([bucket] * len(lots), pa.int32()), blob], ["lot", "bucket", "sizes"])


def with_sizes(lots: DataFrame, blobs: DataFrame) -> DataFrame:
    """The rows of lots (lot and binary columns, a row a lot) and those of their sizes (lot, bucket, sizes), a lot in one partition."""
    sizes = blobs.repartition("bucket").mapInArrow(size_classes, "lot long, bucket int, sizes binary")
    return lots.unionByName(sizes, allowMissingColumns=True).repartition("lot")


def gathered(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[list[np.ndarray]]:
    """For each lot of a partition: the bytes of its columns and the sizes of its hashes in sorted order."""
    given: dict[int, list] = {}
    sizes: dict[int, dict[int, np.ndarray]] = {}
    for batch in batches:
        at = {c: batch.column(batch.schema.get_field_index(c)) for c in ("lot", "bucket", "sizes", *columns)}
        for i, (lot, bucket) in enumerate(zip(at["lot"].to_pylist(), at["bucket"].to_pylist(), strict=True)):
            if bucket is None:
                given[lot] = [np.frombuffer(at[c][i].as_buffer(), np.uint8) for c in columns]
            else:
                sizes.setdefault(lot, {})[bucket] = np.frombuffer(at["sizes"][i].as_buffer(), np.uint8)
    for lot in list(given):
        yield [*given.pop(lot), np.concatenate([np.zeros(0, np.uint8), *[x for _, x in sorted(sizes.pop(lot, {}).items())]])]


class Lots:
    """Numbers of a task's lots, the same whenever the task runs again."""

    def __init__(self):
        from pyspark import TaskContext

        self.next = TaskContext.get().partitionId() << 32

    def __call__(self) -> int:
        self.next += 1
        return self.next


def survey(k: int, rule: Rule):
    """One row a document (doc_id, n, cls); subsets of light sets (cls, n, key, size); for the texts of a slice, a lot, their parts as
    sorted blobs (lot, bucket, blob) and a row (lot, classes, need, owner): repeated parts that are needed and each part's text."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, lots = ["doc_id", "n", "cls", "key", "size", "lot", "bucket", "blob", "classes", "need", "owner"], Lots()

        def rows(count: int, **columns: pa.Array) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([columns.get(c, pa.nulls(count, t)) for c, t in zip(names, types, strict=True)], names)

        for batch in batches:
            types = [batch.column(0).type, pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), *[pa.binary()] * 4]
            for first, to, data, offsets in slices(batch.column(1)):
                sets = Sets(data, offsets, k)
                yield rows(to - first, doc_id=batch.column(0)[first:to], n=pa.array(sets.n), cls=binary(sets.cls))
                docs = sets.one_a_class()
                key, size, owner = subset_rows(sets, docs[sets.n[docs] <= rule.light], rule)
                if len(key):
                    yield rows(len(key), n=pa.array(sets.n[owner]), cls=binary(sets.cls[owner]), key=pa.array(key.view(np.int64)), size=pa.array(size.astype(np.int32)))
                docs = docs[sets.n[docs] >= rule.least_listed]
                found = part_hashes(sets, docs, rule)
                if found:
                    place = np.zeros(len(sets.n), np.int64)
                    place[docs] = np.arange(len(docs))
                    owner = np.concatenate([place[doc] + i * len(docs) for i, (_, doc, _) in enumerate(found)])
                    need = np.concatenate([np.maximum(need[docs], 1) for _, _, need in found])
                    order, bucket, blob = in_buckets(np.concatenate([h for h, _, _ in found]))
                    lot = lots()
                    yield rows(len(bucket), lot=pa.array(np.full(len(bucket), lot)), bucket=bucket, blob=blob)
                    packed = {"classes": sets.cls[docs], "need": need.astype(np.int32), "owner": owner[order].astype(owner_type(len(need)))}
                    yield rows(1, lot=pa.array([lot]), **{c: pa.array([x.tobytes()], pa.binary()) for c, x in packed.items()})

    return task


def owner_type(owners: int) -> type:
    return np.uint16 if owners <= 1 << 16 else np.uint32


def sifted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The upper half of the class of each set that has as many repeated parts as a partner needs."""
    for classes, need, owner, sizes in gathered(batches, "classes", "need", "owner"):
        classes, need = classes.view(U).reshape(-1, 2), need.view(np.int32)
        repeated = np.bincount(owner.view(owner_type(len(need)))[sizes > 0], minlength=len(need))
        passed = (repeated >= need).reshape(-1, len(classes)).any(axis=0)  # by the parts of either level
        yield pa.RecordBatch.from_arrays([pa.array(classes[passed, 0].view(np.int64))], ["h"])


def candidates(k: int, rule: Rule, known: KeyFilter):
    """(lot, classes, n, tok): the sets whose class is known, many a row, each class once there, their shingles one after the other."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lots, held, cls = Lots(), [], []

        def lot() -> pa.RecordBatch:
            classes = np.concatenate(cls)
            once = np.unique(classes.view("V16").ravel(), return_index=True)[1]
            columns = classes[once].tobytes(), np.array([len(held[i]) for i in once], np.int64).tobytes(), np.concatenate([held[i] for i in once]).tobytes()
            held.clear()
            cls.clear()
            return pa.RecordBatch.from_arrays([pa.array([lots()], pa.int64()), *[pa.array([x], pa.binary()) for x in columns]], ["lot", "classes", "n", "tok"])

        shingles = 0
        for batch in batches:
            for _, _, data, offsets in slices(batch.column(0)):
                sets = Sets(data, offsets, k)
                docs = sets.one_a_class()
                docs = docs[sets.n[docs] >= rule.least_listed]
                docs = docs[known(sets.cls[docs, 0])]
                held += [sets.tok[sets.first[d] : sets.first[d + 1]] for d in docs]
                cls.append(sets.cls[docs])
                shingles += int(sets.n[docs].sum())
                if shingles >= LOT_SHINGLES:
                    yield lot()
                    shingles = 0
        if held:
            yield lot()

    return task


def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lot, cls) of the sets of lots (lot, classes)."""
    for batch in batches:
        for lot, classes in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            classes = np.frombuffer(classes.as_buffer(), U).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(classes), lot)), binary(classes)], ["lot", "cls"])


def without_spare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lots (lot, classes, n, tok, spare) without the sets of their spare classes."""
    for batch in batches:
        for i, spare in enumerate(batch.column(4).to_pylist()):
            classes, n, tok = (np.frombuffer(batch.column(c)[i].as_buffer(), kind) for c, kind in ((1, "V16"), (2, np.int64), (3, U)))
            keep = ~np.isin(classes, np.array(spare or [], "V16"))
            if not keep.any():
                continue
            columns = classes[keep].tobytes(), n[keep].tobytes(), tok[np.repeat(keep, n)].tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0)[i : i + 1], *[pa.array([x], pa.binary()) for x in columns]], ["lot", "classes", "n", "tok"])


def with_spare(lots: DataFrame) -> DataFrame:
    """Lots with the classes that an earlier lot has (spare), so that copies of a text are no reason to list its shingles."""
    by_class = Window.partitionBy("cls").orderBy("lot")  # as many rows as there are lots at most
    again = lots.select("lot", "classes").mapInArrow(placed, "lot long, cls binary").withColumn("_place", F.row_number().over(by_class)).where("_place > 1")
    spare = written(again.groupBy("lot").agg(F.collect_list("cls").alias("spare")), "join-spare")
    few = (spare.agg(F.sum(F.size("spare"))).first()[0] or 0) <= BROADCAST_CLASSES
    return lots.join(F.broadcast(spare) if few else spare, "lot", "left")


def shingle_blobs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lot, bucket, blob): the shingles of the sets of each lot (lot, tok)."""
    for batch in batches:
        for lot, tok in zip(batch.column("lot").to_pylist(), batch.column("tok"), strict=True):
            _, bucket, blob = in_buckets(np.frombuffer(tok.as_buffer(), U))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(bucket), lot)), bucket, blob], ["lot", "bucket", "blob"])


def list_rows(rule: Rule):
    """A lot's sets on the lists of their rarest shingles that other sets have: each list as its least node (key, node), and (head,
    node) where a node points to another head of a list; then the sets themselves (node, cls, n, tok). A node is half of the class."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "node", "head", "cls", "n", "tok"]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.binary()]

        def rows(count: int, **columns: pa.Array) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([columns.get(c, pa.nulls(count, t)) for c, t in zip(names, types, strict=True)], names)

        for classes, counts, every, sizes in gathered(batches, "classes", "n", "tok"):
            classes, counts, every = classes.view(U).reshape(-1, 2), counts.view(np.int64), every.view(U)
            size = np.empty(len(every), np.uint8)
            size[np.argsort(every, kind="stable")] = sizes
            keys, nodes, listed, to = [np.zeros(0, U)], [np.zeros(0, np.int64)], [], np.append(0, np.cumsum(counts))
            for i, node in enumerate(classes[:, 0].view(np.int64)):
                tok, own = every[to[i] : to[i + 1]], size[to[i] : to[i + 1]]
                n = len(tok) - -(-rule.num * len(tok) // rule.den) + 1
                rare = own.astype(U) << U(56) | tok >> U(8)
                pick = np.argpartition(rare, n - 1)[:n] if n < len(tok) else np.arange(len(tok))
                pick = pick[own[pick] > 0]
                if len(pick):
                    listed.append(i)
                    keys.append(tok[pick])
                    nodes.append(np.full(len(pick), node, np.int64))
            key, node = np.concatenate(keys), np.concatenate(nodes)
            order = np.lexsort((node, key))
            key, node = key[order], node[order]
            new = np.ones(len(key), bool)
            new[1:] = key[1:] != key[:-1]
            head = node[np.flatnonzero(new)][np.cumsum(new) - 1] if len(key) else node
            edges = np.unique(np.stack((head, node), axis=1)[head != node], axis=0)
            yield rows(int(new.sum()), key=pa.array(key[new].view(np.int64)), node=pa.array(node[new]))
            yield rows(len(edges), node=pa.array(edges[:, 1]), head=pa.array(edges[:, 0]))
            chosen = classes[np.array(listed, np.int64)]
            yield rows(len(listed), node=pa.array(chosen[:, 0].view(np.int64)), cls=binary(chosen), n=pa.array(counts[listed]), tok=pa.array([every[to[i] : to[i + 1]].tobytes() for i in listed], pa.binary()))

    return task


def linked(n: np.ndarray, tok: list[np.ndarray], rule: Rule, group: np.ndarray | None = None, side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Edges that connect all linked sets among these: exact, though pairs already connected are passed over.

    group: sets known to be connected; side: only sets of different sides are compared.
    """
    order = np.argsort(n, kind="stable")
    size = n[order]
    maps = np.zeros((len(n), MAP_BITS // 64), U)
    for row, i in enumerate(order):
        bit = np.bincount((tok[i] & U(MAP_BITS - 1)).astype(np.int64), minlength=MAP_BITS) & 1
        maps[row] = np.packbits(bit.astype(np.uint8), bitorder="little").view(U)
    group = np.arange(len(n)) if group is None else np.unique(group, return_inverse=True)[1][order]
    side = None if side is None else side[order]
    out = []
    for row in range(len(n) - 1):
        to = int(np.searchsorted(size, size[row] * rule.den // rule.num, "right"))
        apart = group[row + 1 : to] != group[row]
        if side is not None:
            apart &= side[row + 1 : to] != side[row]
        others = row + 1 + np.flatnonzero(apart)
        if not len(others):
            continue
        # the parity maps of two sets differ in no more bits than the sets differ in shingles
        apart = np.bitwise_count(maps[others] ^ maps[row]).sum(axis=1, dtype=np.int64)
        mine = tok[order[row]]
        for other in others[apart <= rule.differ(size[row] + size[others])]:
            if group[other] == group[row]:
                continue
            theirs = tok[order[other]]
            at = np.searchsorted(theirs, mine)
            both = int((theirs[np.minimum(at, len(theirs) - 1)] == mine).sum())
            if rule.den * both >= rule.num * (len(mine) + len(theirs) - both):
                out.append((int(order[row]), int(order[other])))
                group[group == group[other]] = group[row]
    return out


def verify(rule: Rule):
    """Edges (a, b) of lots of whole components, or of a block with its component's pivot, or of two blocks with known groups."""

    def task(pdf: pd.DataFrame) -> pd.DataFrame:
        cls, n, edges = pdf["cls"].to_numpy(), pdf["n"].to_numpy(), []
        tok = [np.frombuffer(x, U) for x in pdf["tok"]]
        known, side = "known" in pdf, pdf["side"].to_numpy() if "side" in pdf else None
        for rows in pdf.groupby("component", sort=False).indices.values():
            if len(rows) > 1:
                group = pdf["known"].iloc[rows].to_numpy() if known else None
                edges += [(cls[rows[i]], cls[rows[j]]) for i, j in linked(n[rows], [tok[r] for r in rows], rule, group, side[rows] if side is not None else None)]
        return pd.DataFrame(edges, columns=["a", "b"])

    return task


def large_components(sets: DataFrame, rule: Rule) -> DataFrame:
    """Edges (a, b) of components of more than BLOCK sets; sets (component, blocks, cls, n, tok) have each class once."""
    sets = written(sets.withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int")), "large-sets")
    chosen = sets.groupBy("component").agg(F.min("cls").alias("cls"))
    pivots = sets.join(chosen, ["component", "cls"], "left_semi").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).where("other <> block")
    first = sets.unionByName(pivots.withColumn("block", F.col("other")).drop("other"))
    edges = written(first.select("component", "block", "cls", "n", "tok").groupBy("component", "block").applyInPandas(verify(rule), "a binary, b binary"), "block-links")
    # what most of a component is connected with needs no more comparing in itself
    label = components(edges, "a", "b").withColumnRenamed("node", "cls").withColumnRenamed("component", "known")
    sets = sets.join(label, "cls", "left").withColumn("known", F.coalesce("known", "cls"))
    sizes = sets.groupBy("component", "known").count()
    most = written(sizes.groupBy("component").agg(F.max_by("known", F.struct("count", "known")).alias("main"), F.sum("count").alias("all"), F.max("count").alias("main_count")), "large-groups")
    most = most.where("all > main_count").withColumn("minors", F.ceil((F.col("all") - F.col("main_count")) / BLOCK).cast("int"))
    sets = written(sets.join(F.broadcast(most.select("component", "main", "minors")), "component"), "large-left")  # one row for BLOCK sets at least
    minor = sets.where("known <> main").withColumn("part", F.pmod(F.xxhash64("cls", F.lit("minor")), F.col("minors")).cast("int"))
    own = sets.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("minors") - 1))).withColumn("side", F.lit(0))
    met = minor.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("side", F.lit(1))
    lots = own.unionByName(met).select("component", "block", "part", "side", "known", "cls", "n", "tok")
    return edges.union(lots.groupBy("component", "block", "part").applyInPandas(verify(rule), "a binary, b binary"))


def join_sets(docs: DataFrame, k: int = 4, num: int = 85, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id: documents linked when den * intersection >= num * union, and their components."""
    spark, rule = docs.sparkSession, Rule(num, den)
    byte_batches(spark)
    ids = docs.schema["doc_id"].dataType.simpleString()
    found = docs.select("doc_id", "text").mapInArrow(survey(k, rule), f"doc_id {ids}, n long, cls binary, key long, size int, lot long, bucket int, blob binary, classes binary, need binary, owner binary")
    found = written(found, "join-survey")
    every = found.where("key is null and lot is null").select("doc_id", "n", "cls")

    light = found.where("key is not null").select("key", "size", "n", "cls").distinct()
    light = written(light, "join-subsets")
    least = light.groupBy("key", "size").agg(F.min(F.struct("n", "cls")).alias("least"))
    near = (F.col("n") + F.col("least.n") - F.col("size")) * num <= F.col("size") * den
    edges = light.join(least, ["key", "size"]).where(near & (F.col("cls") != F.col("least.cls"))).select(F.col("least.cls").alias("a"), F.col("cls").alias("b"))

    parts = with_sizes(found.where("owner is not null").select("lot", "classes", "need", "owner"), found.where("bucket is not null").select("lot", "bucket", "blob"))
    known = KeyFilter(parts.mapInArrow(sifted, "h long"), "h")
    lots = written(docs.select("text").mapInArrow(candidates(k, rule, known), "lot long, classes binary, n binary, tok binary"), "join-sets")
    known.release()
    spared = with_spare(lots)
    # one function a stage: each would keep a Python worker of its own
    blobs = spared.mapInArrow(lambda batches: shingle_blobs(without_spare(batches)), "lot long, bucket int, blob binary")
    rows = with_sizes(spared.mapInArrow(without_spare, lots.schema), blobs)
    rows = written(rows.mapInArrow(list_rows(rule), "key long, node long, head long, cls binary, n long, tok binary"), "join-lists")
    sets = rows.where("cls is not null").select("node", "cls", "n", "tok")
    lists = rows.where("key is not null").select("key", "node").repartition("key")
    heads = lists.groupBy("key").agg(F.min("node").alias("head"), F.max("node").alias("last")).where("head <> last").select("key", "head")
    stars = lists.join(heads, "key").where("node <> head").select("head", "node").union(rows.where("head is not null").select("head", "node")).distinct()
    member = components(stars, "head", "node")
    sizes = member.groupBy("component").count()
    member = written(skew_join(member, sizes, "component").withColumn("blocks", F.ceil(F.col("count") / BLOCK).cast("int")), "join-members")
    total = member.count()
    compared = written(sets.join(member.select("node", "component", "blocks"), "node").dropDuplicates(["node", "cls"]), "join-compared")
    small = compared.where("blocks = 1").withColumn("lot", F.pmod(F.xxhash64("component"), F.lit(total // 500 + 1)))
    checked = small.select("lot", "component", "cls", "n", "tok").groupBy("lot").applyInPandas(verify(rule), "a binary, b binary")
    edges = edges.union(checked)
    large = compared.where("blocks > 1").drop("node")
    if large.take(1):
        edges = edges.union(large_components(large, rule))

    label = components(edges, "a", "b").withColumnRenamed("node", "cls")
    labelled = skew_join(every, label, "cls", "left").withColumn("component", F.when(F.col("n") > 0, F.coalesce("component", "cls")))
    labelled = written(labelled, "join-labelled")
    least = labelled.where("component is not null").groupBy("component").agg(F.min("doc_id").alias("least"))
    return skew_join(labelled, least, "component", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"))


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their component of 4-word shingle sets similar by 0.85 or more."""
    return join_sets(table(spark, sf_dir, "documents"))
