"""Token counts, whitening and collocations against the library, a dense eigen solver, brute force and SQL."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from oracle import connect, same
from pyspark.sql import functions as F

from hexlane.llm import collocations, token_counts, whitening

DOCS = "doc_id long, text string, lang string, part string, phrase string, n long, row long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, l, "x", "y", 1, 2) for i, t, l in rows], DOCS)


def odd_texts():
    rng = random.Random(5)
    letters = [*"ab1 2  'sd.,|<>\n\t　\xa0᠎\x1c\x85​é字。あ\U0001f600", "<|endoftext|>", " <|endoftext|> ", "'ll", " the"]
    odd = ["".join(rng.choice(letters) for _ in range(rng.randrange(80))) for _ in range(800)]
    return [None, "", " ", "\n", "one", " one", *odd, "word " * 9000, "x" * 30000, "ab12" * 9000, "字。" * 9000, " ".join(odd), "two  spaces " * 5000]


def library(name, texts):
    path = public_tokenizers.path(name)
    if name.endswith(".model"):
        import sentencepiece

        return [len(x) for x in sentencepiece.SentencePieceProcessor(model_file=path).encode(texts)]
    from tokenizers import Tokenizer

    return [len(x.ids) for x in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
@pytest.mark.parametrize("long_bytes", [1000, 1 << 20])
def test_token_counts_are_the_librarys(spark, name, long_bytes, monkeypatch):
    texts = odd_texts()
    ids = [None if i == 7 else i // 2 for i in range(len(texts))]
    got = token_counts.count_tokens(docs(spark, zip(ids, texts, [None] * len(texts))).repartition(3), name, long_bytes=long_bytes)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens"]
    want = Counter((i, len((t or "").encode()), n) for i, t, n in zip(ids, texts, library(name, [t or "" for t in texts])))
    assert Counter(map(tuple, got.collect())) == want


def test_pieces_of_all_sizes_add_up():
    texts = [t for t in odd_texts() if t]
    whole = library(token_counts.TOKENIZER, texts)
    count = token_counts.Counter(token_counts.TOKENIZER)
    assert count.splits and count.count(texts) == whole
    for size in (1, 7, 100):
        cut = [[*token_counts.safe_parts(t, size)] for t in texts]
        assert ["".join(x) for x in cut] == texts
        assert [sum(count.count(x)) for x in cut] == whole
    assert len([*token_counts.safe_parts("ab12" * 9000, 100)]) > 100


def test_the_memory_of_known_pieces_is_bounded(monkeypatch):
    monkeypatch.setattr(token_counts, "KEPT", 50)
    count = token_counts.Counter(token_counts.TOKENIZER)
    for i in range(20):
        texts = [f"word{i}x{j} and more" for j in range(30)]
        assert count.count(texts) == library(token_counts.TOKENIZER, texts)
        assert len(count.known) + len(count.heads) <= 50 + 3 * 30 + 2


def test_token_counts_of_an_empty_table(spark):
    assert token_counts.count_tokens(docs(spark, [])).collect() == []


def dense(vectors, k=4):
    x = np.array([[int(np.floor(256 * float(c))) for c in v] for v in vectors])
    fit = np.unique(x, axis=0)
    n, total = len(fit), fit.sum(axis=0)
    c = (n * fit - total) / n
    v = c.T @ c / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    deviation = [sum(int(y) ** 2 for y in n * row - total) for row in x]
    return n, deviation, (n * x - total) / n @ u, e, e / np.trace(v)


def check_whitening(got, model, vectors, k=4, digits=1e-9):
    n, deviation, projected, e, explained = dense(vectors, k)
    assert model.n == n and model.identity_error < 1e-9
    assert np.allclose(model.values, e, rtol=1e-10) and np.allclose(model.values / model.trace, explained, rtol=1e-9)
    rows = defaultdict(dict)
    for r in got.collect():
        rows[r.vec_id][r.component] = r
    assert len(rows) == len(vectors)
    for i in range(len(vectors)):
        assert {int(r.deviation) for r in rows[i].values()} == {deviation[i]}
    w = np.array([[rows[i][j + 1].whitened for j in range(k)] for i in range(len(vectors))])
    want = projected / np.sqrt(e)
    want = want * np.sign((w * want).sum(axis=0))
    assert np.abs(w - want).max() < digits


VECTORS = "vec_id long, embedding array<{}>, label int, x int, id string"


def vectors(spark, rows, kind="double"):
    return spark.createDataFrame([(i, v, 0, 0, "z") for i, v in rows], VECTORS.format(kind)).repartition(3)


def test_whitening_is_that_of_a_dense_solver(spark):
    rng = np.random.default_rng(1)
    for dim, scale in ((7, 1.0), (40, 3.0), (120, np.concatenate([[9, 7, 5, 4], 0.2 * np.ones(116)]))):
        x = (rng.normal(size=(300, dim)) * scale).astype(np.float32)
        x[200:] = x[:100]  # repeated vectors count once
        got, model = whitening.whitened(vectors(spark, [(i, [float(c) for c in v]) for i, v in enumerate(x)], "float"))
        check_whitening(got, model, x)
        assert model.spanned <= dim
    assert model.spanned < 120  # converged before it spans the space


def test_whitening_finds_all_of_a_multiple_eigenvalue_and_restarts(spark):
    # one vector along each direction: a covariance with one eigenvalue, where the first block is invariant at once
    x = np.vstack([np.eye(30), -np.eye(30)])
    got, model = whitening.whitened(vectors(spark, [(i, v.tolist()) for i, v in enumerate(x)]))
    assert model.identity_error < 1e-9 and np.allclose(model.values, model.values[0]) and model.n == 60
    wide = np.vstack([x, 5 * np.eye(30)[:3], -5 * np.eye(30)[:3]])
    got, model = whitening.whitened(vectors(spark, [(i, v.tolist()) for i, v in enumerate(wide)]))
    assert np.allclose(model.values, dense(wide)[3]) and model.identity_error < 1e-9
    fit = whitening.written(spark.createDataFrame([(np.floor(256 * v).astype("<i8").tobytes(),) for v in wide], "x binary"), "fit")
    model = whitening.fit_whitening(fit, 30, block=4)
    assert model.restarts > 0 and np.allclose(model.values, dense(wide)[3]) and model.identity_error < 1e-9


def test_whitening_of_large_numbers_is_exact(spark):
    rng = np.random.default_rng(2)
    x = np.floor(rng.normal(size=(50, 6)) * 2.0**36)
    got, model = whitening.whitened(vectors(spark, [(i, v.tolist()) for i, v in enumerate(x)]))
    assert not model.small
    n, deviation = len(x), {}
    whole = [[int(c) * 256 for c in v] for v in x.tolist()]
    sums = [sum(c) for c in zip(*whole, strict=True)]
    assert model.sums == sums
    for i, v in enumerate(whole):
        deviation[i] = sum((n * a - s) ** 2 for a, s in zip(v, sums, strict=True))
    assert {r.vec_id: int(r.deviation) for r in got.collect()} == deviation and model.identity_error < 1e-9


def test_whitening_edges(spark):
    nan, inf = float("nan"), float("inf")
    rng = np.random.default_rng(3)
    good = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(40, 5)))]
    bad = [(90, None), (91, []), (92, [1.0, None, 1.0, 1.0, 1.0]), (93, [nan] * 5), (94, [inf] * 5), (95, [1.0] * 4), (96, [2.0**52] * 5)]
    got, model = whitening.whitened(vectors(spark, good + bad + [(None, good[0][1])]))
    assert sorted({r.vec_id for r in got.collect()} - {None}) == list(range(40)) and got.where("vec_id is null").count() == 4 and model.n == 40
    for rows in ([], bad[:5], [(1, [1.0, 2.0])] * 3):
        out, model = whitening.whitened(vectors(spark, rows))
        assert out.collect() == [] and out.columns == ["vec_id", "component", "deviation", "whitened"]
    # two distinct vectors have one component
    out, model = whitening.whitened(vectors(spark, [(1, [1.0, 2.0, 0.0]), (2, [0.0, 2.0, 3.0]), (3, [0.0, 2.0, 3.0])]))
    assert sorted((r.vec_id, r.component, abs(round(r.whitened, 9))) for r in out.collect()) == [(1, 1, 1.0), (2, 1, 1.0), (3, 1, 1.0)]


def brute(rows, support, top, longest=5, cover=100):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    f, n = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate(low)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            for k in range(1, longest + 1):
                f[lang or "und"].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        cand = {}
        for p, a in c.items():
            if len(p) > 1 and a >= support:
                cand[p] = (a, *min((1000 * a * n[lang] // (c[p[:k]] * c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p))))
        inside = {}
        for p, v in cand.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    inside[p[i : i + m]] = max(inside.get(p[i : i + m], 0), v[0])
        kept = [(-v[1], -v[0], " ".join(p).encode(), v) for p, v in cand.items() if 100 * inside.get(p, 0) < cover * v[0] or p not in inside]
        out += [(lang, i + 1, p.decode(), v[0], v[3], v[4], n[lang], v[1]) for i, (_, _, p, v) in enumerate(sorted(kept)[:top])]
    return sorted(out)


def phrase_rows():
    rng = random.Random(9)
    vocab = [*"abcdefgh", "Köln", "é", "<|x|>", "\U0001f600", "W" * 300, "A", "B"]
    weights = [1 / (i + 1) for i in range(len(vocab))]
    gap = lambda: rng.choice([" ", " ", " ", "  ", "\t", " \t ", ". ", ", ", "\n", "!?"])
    say = lambda n: "".join(w + gap() for w in rng.choices(vocab, weights, k=n))
    rows = [(i, say(rng.randrange(0, 60)), rng.choice(["en", "en", "de", None, "und"])) for i in range(250)]
    return rows + [(1, None, "en"), (2, "", None), (3, " \t\n.,", "fr"), (3, "new york city hall is new york city hall " * 30, "en"), (4, say(20000), "de"), (None, rows[0][1], "en"), *[(5, "hot page to all. ", "en")] * 40]


@pytest.mark.parametrize(("support", "top", "bits", "cover"), [(20, 2000, 20, 100), (20, 7, 12, 80), (300, 50, 10, 100)])
def test_collocations_are_those_of_brute_force(spark, support, top, bits, cover, monkeypatch):
    monkeypatch.setattr(collocations, "SLICE", 5000)
    rows = phrase_rows()
    got = collocations.collocations(docs(spark, rows).repartition(5), support=support, top=top, bits=bits, cover=cover)
    assert sorted(map(tuple, got.collect())) == brute(rows, support, top, cover=cover)


def test_sketches_merge_over_levels_and_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(collocations, "FAN", 3)
    rows = phrase_rows()
    texts = docs(spark, rows).repartition(11).select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    for support in (20, 400):
        full = collocations.frequent_slots(texts, 5, support, 12)
        assert full.shape == (2, 512) and full.any()
        counts, _ = collocations.phrase_counts(docs(spark, rows), support=support, bits=12)
        want = brute_counts(rows, support)
        assert {(r.lang, r.phrase): r.f for r in counts.collect()} == want


def brute_counts(rows, support):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    c = Counter()
    for _, text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate(low)):
            w = re.findall(r"[^\x20\x09]+", piece)
            c.update((lang or "und", " ".join(w[i : i + k])) for k in range(1, 6) for i in range(len(w) - k + 1))
    return {p: n for p, n in c.items() if n >= support}


def test_words_of_one_hash_are_told_apart(monkeypatch):
    import pyarrow as pa

    from hexlane.llm.words import slices

    _, _, data, offsets = next(slices(pa.array(["aa bb aa", "bb cc"]), 1000))
    p = collocations.Phrases(data, offsets, np.zeros(2, np.int64))
    p.words.hash[:] = 7
    number, words = p.numbers()
    assert [words[i] for i in number] == ["aa", "bb", "aa", "bb", "cc"]


def test_large_scores_are_exact(spark):
    counts = spark.createDataFrame([("en", "x y", 2, 10**12), ("en", "x", 1, 10**13 + 7), ("en", "y", 1, 3 * 10**12)], "lang string, phrase string, k int, f long")
    totals = spark.createDataFrame([("en", 9 * 10**15)], "lang string, n long")
    (r,) = collocations.scored(counts, totals).collect()
    assert r.score == 1000 * 10**12 * 9 * 10**15 // ((10**13 + 7) * 3 * 10**12)


def test_collocations_of_empty_tables(spark):
    for rows in ([], [(1, None, None)], [(1, "a b c", "en")]):
        out = collocations.collocations(docs(spark, rows), bits=10)
        assert out.collect() == [] and out.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def test_collocations_match_sql(spark, sf):
    got = collocations.collocations(spark.read.parquet(f"{sf}/documents.parquet"), support=20, bits=18)
    same(got.toPandas(), connect(sf).execute(collocations.oracle(support=20)).df())
