import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import langid_kn as k
from tidemark.llm import queries

from .conftest import SF


@pytest.fixture(scope="module")
def model(spark):
    return k.fit(spark.read.parquet(f"{SF}/documents.parquet"))


def test_probabilities_add_up(spark):
    """Over the next characters that a context may have, each language's probabilities come to about one."""
    docs = spark.createDataFrame([("the cat sat on the mat", "x"), ("das ist der hut der katze", "y")], "text string, lang string")
    m = k.fit(docs.withColumn("doc_id", F.lit(1))).model
    for context in (" th", "cat", "ist", "der", "zzz"):
        packed = np.uint64(sum(ord(c) << 16 * (2 - i) for i, c in enumerate(context)))
        every = (packed << np.uint64(16)) | np.arange(1 << 12, dtype=np.uint64)
        total = m.probability(every, 4).sum(axis=0)
        # the rest is the share of the characters beyond, by the uniform distribution at the bottom
        assert (total > 0.05).all() and (total < 1.05).all()
        if context.strip() == "th":
            assert total[0] > 0.5 and m.probability((packed << np.uint64(16)) | np.array([ord("e")], np.uint64), 4)[0, 0] > 0.3


def test_counts_against_brute_force(spark):
    docs = spark.createDataFrame([("Abc abd", "x"), ("abc", "x"), ("abc", "y"), (None, "y"), ("abc", None)], "text string, lang string")
    got = {(r["lang"], r["gram"]): r["n"] for r in k.gram_counts(docs, "text", "lang").collect()}
    want: dict = {}
    for text, lang in (("abc abd", "x"), ("abc", "x"), ("abc", "y")):
        padded = f" {text} "
        for i in range(len(padded) - 3):
            key = 0
            for ch in padded[i : i + 4]:
                key = key << 16 | ord(ch)
            want[lang, key] = want.get((lang, key), 0) + 1
    assert got == want


def test_continuation_counts(spark):
    docs = spark.createDataFrame([("abcx dbcx abcx", "x")], "text string, lang string")
    table = k.folded_counts(k.gram_counts(docs, "text", "lang")).where("ord = 3 and kind").collect()
    key = np.array([ord("b") << 32 | ord("c") << 16 | ord("x")], np.uint64)
    (n,) = [r["n"] for r in table if r["slot"] == int(k.slot(key)[0])]
    assert n == 2  # abcx and dbcx, though abcx comes twice


def test_held_out_accuracy(spark):
    truth = dict(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").collect())
    rows = [r for r in queries.op8_langid_kn(spark, "/root/testdata/sf0.01").collect()]
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == len(truth) and held
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) / len(held) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_rejection(model):
    rnd = random.Random(1)
    noise = ["".join(rnd.choice("qxzjkvwpQXZJ") for _ in range(60)), "Привет как дела сегодня вечером", None, "", "123 !!", "x", "\u0301"]
    langs, scores = model.predict(noise)
    assert scores[0] < k.REJECT and scores[1] < k.REJECT
    assert langs[2:5] == ["und"] * 3 and langs[5] != "und" and langs[6] == "und"


def test_operator_on_odd_rows(spark, model, odd_docs, no_docs):
    out = k.identify(odd_docs, model).collect()
    assert len(out) == odd_docs.count() and all(0 <= r["score"] <= 1 and not math.isnan(r["score"]) for r in out)
    assert {r["doc_id"] for r in out if r["lang_pred"] == "und"} == {2, 3, 5, 6, None}
    assert k.accepted(odd_docs, model).columns == odd_docs.columns
    assert k.identify(no_docs, model).count() == 0
    empty = k.fit(no_docs)
    assert {r["lang_pred"] for r in k.identify(odd_docs, empty).collect()} == {"und"}


def test_unseen_grams_have_no_counts():
    """A million n-grams that the model has not seen find nothing beside a million that it has."""
    rnd = np.random.default_rng(2)
    keys = np.unique(rnd.integers(1, 1 << 62, 2_000_000, dtype=np.uint64))
    seen, unseen = keys[::2], keys[1::2]
    slots = np.unique(k.slot(seen))
    assert len(slots) == len(seen) and not np.isin(k.slot(unseen), slots).any()


def test_calibration_is_on_all_rows(spark):
    """5,000 rows of one language and 7 of another: the threshold of each is that of all its rows."""
    rnd = random.Random(4)
    words = {"x": "stone water light under garden river often seldom".split(), "y": "haus baum wolke nicht garten immer fluss selten".split()}
    rows = [(i, " ".join(rnd.choices(words[lang], k=rnd.randint(1, 12))), lang) for i, lang in enumerate("x" * 5_000 + "y" * 7)]
    found = k.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    for place, lang in enumerate("xy"):
        ce = found.model.cross_entropies([k.symbols(t) for _, t, x in rows if x == lang])[:, place]
        assert abs(found.mean[place] - np.median(ce)) < 0.002
        assert abs(found.spread[place] - max(0.1, np.percentile(ce, 95) - np.median(ce))) < 0.003


class Naive:
    """Interpolated Kneser-Ney by the definition, in dictionaries."""

    def __init__(self, texts):
        counts: dict = {}
        for text in texts:
            syms = tuple(k.symbols(text).tolist())
            for i in range(len(syms) - 3):
                counts[syms[i : i + 4]] = counts.get(syms[i : i + 4], 0) + 1
        self.n = {4: counts}
        for order in (3, 2, 1):
            self.n[order] = {}
            for g in self.n[order + 1]:
                self.n[order][g[1:]] = self.n[order].get(g[1:], 0) + 1
        self.d, self.total, self.kinds = {}, {}, {}
        for order, table in self.n.items():
            once, twice = (sum(v == x for v in table.values()) for x in (1, 2))
            self.d[order] = min(0.9, max(0.1, once / max(once + 2 * twice, 1)))
            for g, v in table.items():
                self.total[g[:-1], order] = self.total.get((g[:-1], order), 0) + v
                self.kinds[g[:-1], order] = self.kinds.get((g[:-1], order), 0) + 1

    def p(self, g):
        if not g:
            return 1 / (1 << 16)
        lower, order = self.p(g[1:]), len(g)
        total = self.total.get((g[:-1], order), 0)
        if not total:
            return lower
        back = self.d[order] * self.kinds[g[:-1], order] / total
        return max(self.n[order].get(g, 0) - self.d[order], 0) / total + back * lower

    def cross_entropy(self, text):
        syms = tuple(k.symbols(text).tolist())
        if len(syms) < 4:
            return -math.log(self.p(syms))
        return -sum(math.log(self.p(syms[i : i + 4])) for i in range(len(syms) - 3)) / (len(syms) - 3)


def test_query_against_a_naive_model(spark):
    """Cross-entropies and the language told, of every document, by dictionaries and recursion."""
    from tidemark.llm.common import held_out

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = k.fit(docs.where(~held_out("doc_id", 4, 2)))
    train: dict = {}
    for r in docs.where(~held_out("doc_id", 4, 2)).collect():
        if r["lang"] is not None and r["text"] is not None:
            train.setdefault(r["lang"], []).append(r["text"])
    naive = {lang: Naive(texts) for lang, texts in train.items()}
    texts = dict(docs.select("doc_id", "text").collect())
    told = {r["doc_id"]: r["lang_pred"] for r in queries.op8_langid_kn(spark, SF).collect()}
    for doc_id, text in texts.items():
        if not len(k.symbols(text)):
            assert told[doc_id] == k.UND
            continue
        text = text[:3000] if len(text) > 3000 else text
        want = {lang: m.cross_entropy(text) for lang, m in naive.items()}
        got = dict(zip(found.model.langs, found.model.cross_entropies([k.symbols(text)])[0]))
        assert all(abs(got[x] - want[x]) < 1e-3 for x in want)
        if len(text) < 3000:
            assert told[doc_id] == min(want, key=want.get)


def test_groups_of_languages_give_the_same(spark, odd_docs):
    """A pass for each language, or for two, or for each shard of one, tells what one pass for all tells."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    one = k.fit(docs)
    key = lambda r: (str(r["doc_id"]), r["lang_pred"], round(r["score"], 9))
    want = sorted(map(key, k.identify(docs, one).collect()))
    odd = sorted(map(key, k.identify(odd_docs, one).collect()))
    size = max(len(v[0]) + len(one.model.contexts[key][0]) for key, v in one.model.grams.items())
    for entries, shards in ((5 * size, 1), (size // 2, 3)):
        many = k.fit(docs, group_entries=entries)
        assert len(many.groups) > 1 and max(g.shards for g in many.groups) >= shards and many.langs == one.langs and np.allclose(many.mean, one.mean) and np.allclose(many.spread, one.spread)
        assert sorted(map(key, k.identify(docs, many).collect())) == want
        assert sorted(map(key, k.identify(odd_docs, many).collect())) == odd
        assert sorted(str(r["doc_id"]) for r in k.accepted(docs, many).collect()) == sorted(str(r["doc_id"]) for r in k.accepted(docs, one).collect())


def test_symbols_beyond_the_first_plane_stay_apart():
    assert len({tuple(k.symbols(c).tolist()) for c in "\U00020000\U00010400\u0400\u0001x"}) >= 4


def test_a_column_of_something_else_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(k, "MOST_LANGS", 3)
    docs = spark.createDataFrame([(i, "some words", f"lang{i}") for i in range(9)], "doc_id long, text string, lang string")
    with pytest.raises(ValueError, match="languages"):
        k.fit(docs)
