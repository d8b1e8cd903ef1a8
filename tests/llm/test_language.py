"""Language models against a plain Kneser-Ney, and rejection on texts of known kinds."""

from __future__ import annotations

import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from hexlane.llm import language_id

SYLLABLES = {"aa": "an the ing her tion ed on st re".split(), "bb": "ung ein sch er ge ich ver keit".split(), "cc": "ko ma ri tu ne shi ya wo".split()}


def say(rng, lang, words):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(words))


def make(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def folded(text):
    out = [" "]
    for c in text:
        c = c.lower()[0] if c.isalpha() else " "
        if c != " " or out[-1] != " ":
            out.append(c)
    return "".join(out)


class Plain:
    """Interpolated Kneser-Ney of one language, straight from the definition."""

    def __init__(self, texts, order=4):
        self.counts = {order: Counter()}
        for t in texts:
            t = folded(t)
            for i in range(1, len(t)):
                self.counts[order][t[max(0, i - order + 1) : i + 1].rjust(order)] += 1
        for k in range(order - 1, 0, -1):
            self.counts[k] = Counter(g[1:] for g in self.counts[k + 1])
        self.order, self.d, self.total, self.kinds = order, {}, {}, {}
        for k, c in self.counts.items():
            one, two = sum(v == 1 for v in c.values()), sum(v == 2 for v in c.values())
            self.d[k] = min(max(one / (one + 2 * two), 0.1), 0.9) if one else 0.5
            self.total[k], self.kinds[k] = defaultdict(int), defaultdict(int)
            for g, v in c.items():
                self.total[k][g[:-1]] += v
                self.kinds[k][g[:-1]] += 1

    def p(self, gram):
        k = len(gram)
        if k == 0:
            return 1 / (1 << language_id.BITS)
        total = self.total[k].get(gram[:-1], 0)
        if not total:
            return self.p(gram[1:])
        return max(self.counts[k].get(gram, 0) - self.d[k], 0) / total + self.d[k] * self.kinds[k][gram[:-1]] / total * self.p(gram[1:])

    def bits(self, text):
        t = folded(text)
        return sum(-math.log2(self.p(t[max(0, i - self.order + 1) : i + 1].rjust(self.order))) for i in range(1, len(t))) / max(1, len(t) - 1)


@pytest.fixture(scope="module")
def labelled():
    rng = random.Random(4)
    return [(i, say(rng, lang, rng.choice((3, 20, 80))), lang) for i in range(400) for lang in ("aa", "bb")]


@pytest.mark.parametrize("lot", [1 << 24, 300])
def test_equals_plain_kneser_ney(spark, labelled, lot, monkeypatch):
    monkeypatch.setattr(language_id, "LOT_VALUES", lot)
    rows = labelled[:60]
    language_id.small_batches(spark)
    grams = language_id.Grams(language_id.counted(make(spark, rows).withColumn("aside", F.lit(False))))
    assert (len(grams.lots) > 1) == (lot == 300)
    models = {lang: Plain([t for _, t, name in rows if name == lang]) for lang in ("aa", "bb")}
    asked = labelled[60:70] + [(900, "Qué 日本 x 12 z", None), (901, "An", None), (902, "-- 7", None), (903, None, None)]
    for r in language_id.scored(make(spark, asked), grams, ["text"], "plain").collect():
        if r.lang_pred is None:
            assert r.text in (None, "-- 7") and r.bits is None
            continue
        want = {lang: m.bits(r.text) for lang, m in models.items()}
        assert r.lang_pred == min(want, key=want.get) and abs(r.bits - min(want.values())) < 1e-3


def test_rejects_what_was_not_learnt_and_keeps_the_rest(spark, labelled):
    rng = random.Random(5)
    shuffled = lambda t: "".join(rng.sample(t, len(t)))
    asked = [(i, say(rng, lang, n), "clean") for i in range(150) for lang in ("aa", "bb") for n in (20, 80)]
    asked += [(i, say(rng, "cc", n), "other") for i in range(50) for n in (20, 80)]
    asked += [(i, shuffled(say(rng, lang, n)), "shuffled") for i in range(50) for lang in ("aa", "bb") for n in (20, 80)]
    docs = make(spark, asked).withColumnRenamed("lang", "kind").withColumn("_train", F.lit(1)).withColumn("limit", F.lit(2))
    got = language_id.identify(docs, make(spark, labelled), ["kind", "_train", "limit"])
    share = {r.kind: r.share for r in got.groupBy("kind").agg(F.avg(F.col("rejected").cast("double")).alias("share")).collect()}
    assert share["clean"] <= 0.005 and share["other"] >= 0.95 and share["shuffled"] >= 0.95


def test_repeated_rows_and_untrained(spark, labelled):
    rows = [*labelled, labelled[0], labelled[0], (None, "the", None), (None, "the", None)]
    got = [tuple(r) for r in language_id.identify(make(spark, rows), make(spark, rows), ["doc_id", "text"]).collect()]
    assert len(got) == len(rows) and len({r for r in got if r[1] == labelled[0][1]}) == len({r[0] for r in got if r[1] == labelled[0][1]})
    none = language_id.identify(make(spark, rows), make(spark, rows).where("false"), ["doc_id"]).collect()
    assert {(r.lang_pred, r.score, r.rejected) for r in none} == {("und", 0.0, True)}
    assert language_id.identify(make(spark, rows).where("false"), make(spark, rows), ["doc_id"]).count() == 0
