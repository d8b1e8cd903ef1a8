"""Operators against brute force and SQL, with nulls, empty and long texts, ties, repeated rows, empty tables and extra columns."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from oracle import connect, same
from pyspark.sql import functions as F

from hexlane.llm import ann, common, decontaminate, html_extract, jaccard_join, language_id, line_dedup, mixing, registry, sharding, substring, warc_zip
from hexlane.llm.common import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long, shard string, hub string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def make(spark, texts):
    return spark.createDataFrame([(i, t, "en" if i is None or i % 5 else None, None if i is not None and i % 7 == 0 else "s", 0, "x", "y") for i, t in texts], DOCS)


@pytest.fixture(scope="module")
def odd_texts():
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(300)]
    say = lambda n: [rng.choice(vocab) for _ in range(n)]
    base, passage = say(120), say(50)
    texts = [None, "", " \n\t ", "one", "one two three", "one two three", " ".join(base), " ".join(base), " ".join(["a"] * 90), " ".join(say(30000))]
    for _ in range(12):
        w = list(base)
        for _ in range(rng.randrange(1, 6)):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        texts.append(" ".join(w))
    for _ in range(8):
        texts.append(" ".join(say(40) + passage + say(rng.randrange(0, 60))))
    for n in range(4, 24):
        w = say(n)
        texts += [" ".join(w), " ".join(w + say(1)), " ".join(w[1:])]
    rows = list(enumerate(texts)) + [(None, "no id here"), (6, " ".join(base)), (6, "another text of the same id")]
    return rows


def test_substring(spark, odd_texts):
    got = Counter((r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in substring.remove_repeats(make(spark, odd_texts)).collect())
    words = [(i, WORD.findall(t or "")) for i, t in odd_texts]
    seen = Counter(tuple(w[j : j + 35]) for _, w in words for j in range(len(w) - 34))
    want = Counter()
    for i, w in words:
        keep = [True] * len(w)
        for j in range(len(w) - 34):
            if seen[tuple(w[j : j + 35])] > 1:
                keep[j : j + 35] = [False] * 35
        want[i, len(w), len(w) - sum(keep), hashlib.sha256(" ".join(x for x, k in zip(w, keep, strict=True) if k).encode()).hexdigest()] += 1
    assert got == want


def test_substring_index_is_incremental(spark):
    say = lambda n: " ".join(f"t{n}x{i}" for i in range(60))
    index = substring.FingerprintIndex(spark, fanout=2)
    assert index.append(make(spark, [(1, say(1))])).count() == 0
    assert index.append(make(spark, [(2, "x " + say(1))])).count() > 0
    assert [level for level, _ in index.runs] == [1]  # two runs merged
    again = substring.FingerprintIndex.open(spark, index.root)  # a later job
    assert (again.runs, again.found, again.version, again.fanout) == (index.runs, index.found, index.version, 2)
    assert again.append(make(spark, [(3, say(3))])).count() == 0 and [level for level, _ in again.runs] == [1, 0]
    assert again.append(make(spark, [(4, say(3)), (5, say(1))])).count() > 0 and [level for level, _ in again.runs] == [2]
    assert again.repeated().count() > 0 and len(again.found) <= 2
    assert again.append(make(spark, [(6, None)])).count() == 0


@pytest.mark.parametrize(("k", "num", "den", "block"), [(4, 85, 100, 2000), (5, 80, 100, 2000), (4, 85, 100, 5)])
def test_jaccard(spark, odd_texts, k, num, den, block, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", block)  # 5: the copies of the base text are a large component
    odd_texts = odd_texts[:-2] + [(None, odd_texts[6][1] + " more")] + odd_texts[-2:] if block == 5 else odd_texts
    docs = [(i, t) for n, (i, t) in enumerate(odd_texts) if n < len(odd_texts) - 1]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.join_sets(make(spark, docs), k, num, den).collect()}
    sets = {}
    for i, t in docs:
        w = WORD.findall((t or "").lower())
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = [i for i in sets if sets[i]]
    for n, a in enumerate(ids):
        for b in ids[:n]:
            both = len(sets[a] & sets[b])
            if den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)), key=lambda i: (i is None, i or 0))
                parent[y] = x
    assert got == {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize(("few", "kind"), [(0, "long"), (20_000, "long"), (5, "string")])
def test_components(spark, few, kind, monkeypatch):
    monkeypatch.setattr(common, "FEW", few)
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (101, 100), (7, 7), (None, 3)]
    df = spark.createDataFrame(edges, "a long, b long").select(*[F.lpad(F.col(c).cast("string"), 3, "0").alias(c) if kind == "string" else c for c in "ab"])
    got = {int(r.node): int(r.component) for r in components(df, "a", "b").collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 100: 100, 101: 100}


def test_sharding(spark, odd_texts):
    df = sharding.assign(make(spark, odd_texts), shards=4)
    rows = df.collect()
    sizes = Counter(r.shard for r in rows)
    assert len(rows) == len(odd_texts) and max(sizes.values()) - min(sizes.values()) <= 1 and set(sizes) == {0, 1, 2, 3}
    assert {r["size"] for r in rows if r.doc_id == 0} == {8}
    together = Counter((r.text_crc32, r["size"]) for r in rows if r["size"] > 8)
    cut = sum(1 for key, n in together.items() if 1 < n <= 4 and len({r.shard for r in rows if (r.text_crc32, r["size"]) == key}) > 1)
    assert cut == 0


def test_sharding_splits_a_group_larger_than_a_shard(spark):
    rows = sharding.assign(make(spark, [(i, "same" if i < 60 else f"text {i}") for i in range(100)]), shards=4).collect()
    assert sorted(Counter(r.shard for r in rows).values()) == [25] * 4


def test_lines_and_mixing_equal_sql(spark, sf):
    con = connect(sf)
    for name in ("op2_lines", "op9_mixing", "op8_warc"):
        same(registry.QUERIES[name](spark, sf).toPandas(), con.execute(registry.ORACLES[name]).df())


def test_lines_odd(spark, odd_texts):
    rows = {(r.doc_id, r.n_lines, r.n_dropped): r.kept for r in line_dedup.drop_templates(make(spark, odd_texts)).collect()}
    assert rows[0, 0, 0] == "" and rows[1, 1, 0] == "" and rows[2, 2, 0] == " \n\t "
    logs = [(i, f"clean text number {'abcdefgh'[i]}\nuser {i}17 logged in from 10.0.0.{i} today") for i in range(6)]
    got = line_dedup.drop_templates(make(spark, logs)).collect()
    assert all(r.n_dropped >= 1 and "logged" not in r.kept for r in got)
    letters = "abcdefgh"
    pages = [(i, f"own text {letters[i] * 5}\nPage {i} of 12\nTel: 555-{i}100\nCopyright 20{i}4\n| {i} | {i}2 |\n{i}\n2024-01-0{i} 12:33:1{i} INFO started") for i in range(6)]
    got = line_dedup.drop_templates(make(spark, pages)).collect()
    assert all(r.kept == f"own text {letters[r.doc_id] * 5}\n| {r.doc_id} | {r.doc_id}2 |\n{r.doc_id}" for r in got)


def test_mixing_odd(spark, odd_texts):
    out = mixing.sample(make(spark, odd_texts)).collect()
    assert len(out) == len(odd_texts) and all(0 <= r.prob <= 1 for r in out) and all(r.kept for r in out if r.n_tokens == 0)


def test_language(spark, sf):
    docs = registry.QUERIES["op5_language"](spark, sf)
    labelled = docs.join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out")
    right, n = labelled.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.count("*")).first()
    assert n > 20 and right >= 0.95


def test_language_odd(spark, odd_texts):
    docs = make(spark, odd_texts + [(900, "1234 !!")])
    rows = {r.doc_id: r for r in language_id.identify(docs, docs, ["doc_id", "lang"]).collect()}
    assert rows[0].lang_pred == rows[1].lang_pred == rows[900].lang_pred == "und" and rows[0].rejected and rows[0].score == 0
    assert rows[3].lang_pred == "en" and not rows[3].rejected
    untaught = language_id.identify(docs, docs.where("false"), ["doc_id"]).collect()
    assert {r.lang_pred for r in untaught} == {"und"}


PAGE = """<html><body><header>Site</header><nav><a href=/>Home</a></nav><div class="cookie-notice">We use cookies</div>
<div class="post-12"><h1>T&amp;T</h1><p>First <b>bold</b>word,&nbsp;yes.<p>Second<br>line<aside>Related</aside></p><form>Search</form><!-- x --><script>var a="</p>";</script></div>
<div class="comments"><p>I disagree, strongly, with all of this, and more so with the rest of it</p></div><footer>Foot</footer></body></html>"""


def test_html(spark):
    pages = [(1, "http://a.example/1", PAGE), (2, "http://a.example/2", PAGE.replace("post-12", "post-9")), (3, None, None), (4, "odd", ""), (5, "http://b.example", "plain text &lt;only")]
    got = {r.page_id: r.text for r in html_extract.main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got[1] == got[2] == "T&T First boldword, yes. Second line"
    assert got[3] == got[4] == "" and got[5] == "plain text <only"


def test_html_attributes_and_odd_pages(spark):
    say = lambda n: f"<p>Part {n} of it is here, with enough words, and commas, to count as a paragraph of text.</p>"
    plain = lambda n: say(n)[3:-4]
    html = {
        1: "<p title=it's>Hello don't stop</p><p>Second para</p>",
        2: """<div data-x="a > b" class='text' title=5">""" + say(1) + """</div>""",
        3: f'<body><section class="part">{say(1)}</section><section class="part">{say(2)}</section></body>',
        4: "<article>" + "".join(say(n) for n in range(3000)) + "</article>",
        5: "<p>a &lt; b &zzz; &amp;amp; x &#",
        6: "<div class=text>" + say(1) + "<script src=a>if (a > 'b') {</script>" + say(2) + "<!-- c > d --></div>",
    }
    rows = [(i, "http://h.example/p", h, "x", 0, "y") for i, h in html.items()] + [(3, "http://h.example/p", html[3], "x", 0, "y"), (None, None, html[6], "x", 0, "y")]
    got = [(r.page_id, r.text) for r in html_extract.main_text(spark.createDataFrame(rows, "page_id long, url string, html string, path string, score int, host string")).collect()]
    want = {1: "Hello don't stop Second para", 2: plain(1), 3: f"{plain(1)} {plain(2)}", 4: " ".join(plain(n) for n in range(3000)), 5: "a < b &zzz; &amp; x &#", 6: f"{plain(1)} {plain(2)}", None: f"{plain(1)} {plain(2)}"}
    assert sorted(got, key=str) == sorted([*want.items(), (3, want[3])], key=str)


def test_html_on_pages(spark, sf):
    from html import unescape

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = {r.page_id: r.text for r in registry.QUERIES["op6_html"](spark, sf).collect()}
    for i, h in pages.items():
        body = re.search(r"<article>(.*?)</article>", h, re.S)[1]
        assert got[i] == " ".join(unescape(re.sub(r"<[^>]*>", "", re.sub(r"</?(h1|p|br)>", "\n", body))).split())


def test_ann(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas()
    x, ids = np.stack(rows.embedding).astype(float), rows.vec_id.to_numpy()
    found = registry.QUERIES["op7_ann"](spark, sf).toPandas()
    hit = total = 0
    for q, group in found.groupby("query_id"):
        score = (x * x[ids == q][0]).sum(axis=1)
        score[ids == q] = -np.inf
        best = np.lexsort((ids, -score))[:20]
        hit += len(set(ids[best]) & set(group.vec_id))
        total += 20
        got = group.sort_values("rank")
        assert list(got["rank"]) == list(range(1, 21)) and np.allclose(got.score, [score[ids == v][0] for v in got.vec_id])
    assert found.query_id.nunique() == (ids % 20 == 0).sum() and hit / total >= 0.9


def test_ann_odd(spark):
    vectors = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [None, 1.0]), (7, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (20, [0.5, -1.0])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>")
    got = [(r.query_id, r.rank, r.vec_id) for r in ann.search(df, df.where("vec_id % 20 = 0")).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1), (0, 2, 2), (0, 3, 20), (20, 1, 0), (20, 2, 1), (20, 3, 2)]
    assert ann.search(df.where("false"), df).count() == 0


@pytest.mark.parametrize("size", [1.0, 1e20])
def test_ann_doubles_with_clashing_columns(spark, size):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 8)) * size
    rows = [(i, v.tolist(), "a", 1, 2) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, list string, rank int, x int")
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in ann.search(df, df.where("vec_id % 20 = 0"), k=5).collect()}
    hit = 0
    for q in range(0, 300, 20):
        score = (x * x[q]).sum(axis=1)
        score[q] = -np.inf
        best = set(np.argsort(-score)[:5].tolist())
        for rank in range(1, 6):
            vec, value = got[q, rank]
            hit += vec in best
            assert value == score[vec]
    assert hit >= 0.9 * 75


def test_warc_odd(spark, tmp_path):
    big = "é" * 600
    pages = [(1, "http://x/1", big), (2, "http://x/a b\r\n", big), (2, "u", big), (3, None, None), (None, "u", big), (4, "u", "small"), (5, "u", "small")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    manifest = warc_zip.write_packages(warc_zip.marked(df), f"file://{tmp_path}/packages").cache()
    rows = warc_zip.read_packages(manifest).collect()
    assert Counter((r.page_id, r.record_type, r.refers_to) for r in rows) == Counter({(1, "revisit", 2): 1, (2, "response", None): 2, (3, "response", None): 1, (None, "revisit", 2): 1, (4, "response", None): 1, (5, "response", None): 1})
    assert {r.payload_bytes for r in rows if r.page_id in (1, 2)} == {1200} and all(bytes(r.payload) == big.encode() for r in rows if r.page_id == 2)
    assert all(r.payload_digest == hashlib.sha1(b"").hexdigest() for r in rows if r.page_id == 3)


def test_zip64_directory(tmp_path):
    import zipfile

    path = tmp_path / "many.zip"
    with zipfile.ZipFile(path, "w") as z:
        for i in range(70_000):
            z.writestr(f"m/{i}", b"%d" % i)
        z.writestr("packed", b"x" * 1000, compress_type=zipfile.ZIP_DEFLATED)
    with warc_zip.open_uri(f"file://{path}") as f:
        got = warc_zip.members(f)
        assert len(got) == 70_000 and "packed" not in got and warc_zip.read_at(f, *got["m/69999"]) == b"69999"


def test_leaks(spark):
    rng = random.Random(9)
    say = lambda n: [f"k{rng.randrange(4000)}" for _ in range(n)]
    items = [(i, " ".join(say(30))) for i in range(12)] + [(50, None), (51, ""), (52, "...")]
    docs, want = [(0, None), (1, "")], set()
    for i in range(2, 60):
        w = say(200)
        if i % 5 == 0:
            item, words = rng.choice(items[:12]), None
            words = item[1].split()
            if i % 10 == 0:  # a paraphrase: every eighth word another, the answer unchanged
                words = [x if j % 8 or j > 20 else "other" for j, x in enumerate(words)]
            w[70:70] = words
            want.add((i, item[0]))
        docs.append((i, " ".join(w)))
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(make(spark, docs), benchmark).collect()}
    assert got == want
    assert decontaminate.leaks(make(spark, docs), benchmark.where("false")).count() == 0


def test_empty_tables(spark):
    docs = make(spark, [(1, "x")]).where("false")
    for df in (substring.remove_repeats(docs), jaccard_join.join_sets(docs), sharding.assign(docs), line_dedup.drop_templates(docs), mixing.sample(docs), language_id.identify(docs, docs, ["doc_id"])):
        assert df.count() == 0
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert html_extract.main_text(pages).count() == 0
    assert decontaminate.leaks(docs, spark.createDataFrame([(1, "a b c d")], "item_id long, text string")).count() == 0


def test_leaks_of_frequent_and_surrounded_items(spark):
    rng = random.Random(11)
    common = [f"c{i}" for i in range(40)]
    items = [(i, " ".join(f"{n}{j}" for j in range(15))) for i, n in enumerate(("third", "every", "alone"))] + [(3, " ".join(rng.sample(common, 20)))]
    docs, want = [], set()
    for i in range(90):
        w = [f"r{i}x{j}" for j in range(200)]  # words of no other document
        held = [1] + [0] * (i % 3 == 0) + [2] * (i == 7) + [3] * (i == 8)
        for n, item in enumerate(held):
            w[20 + 50 * n : 20 + 50 * n] = items[item][1].split()
            want.add((i, item))
        docs.append((i, " ".join(w + rng.sample(common, 30))))
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(make(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == want


def test_leaks_of_long_items(spark, monkeypatch):
    rng = random.Random(12)
    monkeypatch.setattr(decontaminate, "PIECES", 30)
    monkeypatch.setattr(decontaminate, "LOT", 8)
    sizes, blocks = [], decontaminate.piece_blocks

    def counted(items):
        for block in blocks(items):
            sizes.append(len(block))
            yield block

    monkeypatch.setattr(decontaminate, "piece_blocks", counted)
    items = [(i, " ".join(f"q{rng.randrange(3000)}" for _ in range(300))) for i in range(12)]
    docs = [(i, " ".join([f"q{rng.randrange(3000)}" for _ in range(100)] + text.split()[60 * (i % 5) : 60 * (i % 5) + 90])) for i, text in items] + [(99, " ".join(f"q{rng.randrange(3000)}" for _ in range(200)))]
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(make(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(i, i) for i, _ in items} and sizes == [30, 30, 24]


def test_leaks_beyond_the_rank(spark, monkeypatch):
    """More leaked pieces than the space has directions: what it has no room for gets a space of its own."""
    monkeypatch.setattr(decontaminate, "RANK", 3)
    monkeypatch.setattr(decontaminate, "SPARE", 1)
    items = [(i, " ".join(f"i{i}w{j}" for j in range(20))) for i in range(25)]
    docs = [(100 * i + k, f"a b c {text} d e") for i, text in items for k in range(1 + i % 3)]
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(make(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(d, d // 100) for d, _ in docs}


def test_leaks_equal_brute_force(spark):
    """Documents that lie within one region: the rule itself, word by word, decides all pairs."""
    rng = random.Random(14)
    vocab = [f"v{i}" for i in range(800)]
    items = [(i, rng.choices(vocab, k=rng.randrange(12, 40))) for i in range(15)]
    docs = []
    for i in range(120):
        words = rng.choices(vocab, k=10)
        run = list(rng.choice(items)[1])
        for at in rng.sample(range(len(run)), int(len(run) * rng.choice((0, 0.1, 0.3, 0.38, 0.5, 0.6)))):
            run[at] = rng.choice(vocab)
        docs.append((i, (words[:5] + run + words[5:])[:60]))

    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last = row[:]
            for j, y in enumerate(b):
                row[j + 1] = last[j] + 1 if x == y else max(row[j], last[j + 1])
        return row[-1]

    want = set()
    for d, w in docs:
        for i, p in items:
            end = p[-max(3, len(p) // 4) :]
            if lcs(p, w) >= 0.8 * len(p) or lcs(p, w) >= 0.6 * len(p) and lcs(end, w) >= 0.8 * len(end):
                want.add((d, i))
    got = {(r.doc_id, r.item_id): r for r in decontaminate.leaks(make(spark, [(d, " ".join(w)) for d, w in docs]), spark.createDataFrame([(i, " ".join(p)) for i, p in items], "item_id long, text string")).collect()}
    assert want <= set(got) and len(want) > 50
    assert all(r.lcs >= decontaminate.LOOSE and r.cosine >= decontaminate.NEAR for key, r in got.items() if key not in want)


def test_the_latent_space_decides_on_paraphrases(spark, monkeypatch):
    """Passages that share few words with an item, and with each other other ones: found by their cosine in the space."""
    rng = random.Random(15)
    items, docs = [(i, [f"i{i}w{j}" for j in range(24)]) for i in range(6)], []
    filler = [f"f{j}" for j in range(3000)]
    for i, words in items:
        for k in range(6):  # half of the words before the answer replaced, in each document others
            gone = set(rng.sample(range(18), 11))
            docs.append((100 * i + k, rng.choices(filler, k=40) + [f"s{i}w{j}" if j in gone else w for j, w in enumerate(words)] + rng.choices(filler, k=40)))
    docs += [(900 + k, rng.choices(filler, k=120)) for k in range(40)]
    table = make(spark, [(d, " ".join(w)) for d, w in docs])
    benchmark = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontaminate.leaks(table, benchmark).collect()}
    want = {(d, d // 100) for d, _ in docs if d < 900}
    monkeypatch.setattr(decontaminate, "NEAR", 2.0)  # no cosine reaches it
    without = {(r.doc_id, r.item_id) for r in decontaminate.leaks(table, benchmark).collect()}
    assert not without & want and len(found & want) >= 0.9 * len(want) and found <= want


def test_html_of_split_articles(spark):
    first, second, third = ("<p>" + f"The {n} part of the article, which has several words, goes on for a while here. " * 3 + "</p>" for n in ("first", "second", "third"))
    same = f'<body><div id=x><div class="text">{first}</div><div class="advert"><p>Buy this now, it is very cheap today</p></div><div class="text">{second}</div><div class="text"><p>End.</p></div></div></body>'
    apart = f'<body><div id=x><div class="text">{first}</div><figure><img src=a></figure><div class="content">{second}</div></div></body>'
    deep = f'<body><div><div class="row"><div class="body">{first}</div></div><div class="row"><div class="body">{third}</div></div></div></body>'
    pages = [(1, "http://a.example/1", same), (2, "http://b.example/1", apart), (3, "http://c.example/1", deep)]
    got = {r.page_id: r.text for r in html_extract.main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    plain = lambda *parts: " ".join(re.sub(r"<[^>]*>", "", p).strip() for p in parts)
    assert got == {1: plain(first, second, "End."), 2: plain(first, second), 3: plain(first, third)}


@pytest.mark.parametrize("kind", ["groups", "lengths", "few"])
def test_ann_of_other_rows(spark, kind):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(4000, 64))
    if kind == "groups":  # forty near vectors in each of a hundred places
        x = rng.normal(size=(100, 64))[np.arange(4000) % 100] + 0.15 * x
    elif kind == "lengths":
        x *= rng.lognormal(0, 1, size=(4000, 1))
    else:  # queries differ from the other rows
        x[::20] = np.abs(x[::20]) + 1
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = ann.search(df, df.where("vec_id % 20 = 0")).toPandas().groupby("query_id").vec_id.agg(set)
    score = x[::20] @ x.T
    score[np.arange(200), np.arange(0, 4000, 20)] = -np.inf
    best = np.argsort(-score, axis=1)[:, :20]
    assert sum(len(found[20 * i] & set(b.tolist())) for i, b in enumerate(best)) >= 0.93 * 4000
