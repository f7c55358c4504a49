import random

from tidemark.llm import queries
from tidemark.llm import toxicity as t


def test_folding():
    assert t.fold("ІDІ0T уou ѕtuріd Ｃlown pathétic tr4$h") == "idiot you stupid clown pathetic trash"
    assert t.fold("in 2024 we paid $5 for 100 of 3 items") == "in 2024 we paid $5 for 100 of 3 items"
    assert t.fold(None) == ""


def test_words_stems_and_exceptions():
    lexicon = t.Lexicon({"trash": 4.0, "idio*": 3.0}, ["trash can"])
    assert lexicon.hits("trash and trashy idiots, idio trash") == [4.0, 3.0, 4.0]
    assert lexicon.hits("a trash can is no trash") == [4.0]
    assert lexicon.hits("untrash xidiot") == []


def test_length_normalises():
    lexicon = t.Lexicon({"bad": 4.0}, [])
    lexicon.fit_ = (-5.0, 2.0, 0.5)
    assert lexicon.score("bad") > lexicon.score("bad " + "fine " * 3000) > lexicon.score("fine")


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    labels = dict(spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic").collect())
    rows = queries.op9_toxicity(spark, sf).collect()
    held = [r for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in rows)
    assert sum(r["predicted"] == labels[r["doc_id"]] for r in held) / len(held) > 0.97


def test_learning_and_odd_rows(spark, odd_docs, no_docs):
    rnd = random.Random(1)

    def prose():
        return " ".join("".join(rnd.choice("abcdefghij") for _ in range(7)) for _ in range(6))

    rows = [(f"{prose()} vile{'abc'[i % 3]} {prose()}", 1) for i in range(60)] + [(f"{prose()} fine {prose()}", 0) for _ in range(300)]
    train = spark.createDataFrame([*rows, (None, 1), ("", 0), ("vile", None)], "text string, toxic int")
    lexicon = t.fit(train)
    assert any(w.startswith("vile") for w in lexicon.weights)
    assert lexicon.score("you vilea thing") > 0.5 > lexicon.score("a fine day")
    out = t.score(odd_docs, lexicon).collect()
    assert len(out) == odd_docs.count() and all(0 <= r["score"] <= 1 for r in out)
    assert t.score(no_docs, lexicon).count() == 0
    blank = t.fit(train.where("toxic = 0"))
    assert {r["predicted"] for r in t.score(odd_docs, blank).collect()} == {0}


def naive_hits(lexicon, folded):
    """Every entry and exception at every place, every hit against every exception."""
    spans = {False: [], True: []}
    for exempt, entries in ((False, lexicon.weights), (True, lexicon.exceptions)):
        for entry in entries:
            bare, stem = entry.rstrip("*"), entry[-1] == "*"
            for a in range(len(folded) - len(bare) + 1):
                b = a + len(bare)
                if folded[a:b] == bare and not (a and folded[a - 1].isalpha()) and (b < len(folded) and folded[b].isalpha()) == stem:
                    spans[exempt].append((a, b, 0.0 if exempt else lexicon.weights[entry]))
    return sorted(x for a, b, x in spans[False] if not any(c <= a and b <= d for c, d, _ in spans[True]))


def test_sweep_against_a_naive_matcher():
    rnd = random.Random(5)
    for _ in range(400):
        bare = {"".join(rnd.choice("ab") for _ in range(rnd.randint(1, 3))) for _ in range(4)}
        entries = {w + rnd.choice(["", "*"]): rnd.random() for w in sorted(bare)}
        phrases = [" ".join("".join(rnd.choice("ab") for _ in range(rnd.randint(1, 3))) for _ in range(2)) for _ in range(3)]
        lexicon = t.Lexicon(entries, phrases)
        folded = "".join(rnd.choice("ab  ") for _ in range(60))
        assert sorted(lexicon.hits(folded)) == naive_hits(lexicon, folded)


def test_many_hits_and_exceptions_take_linear_time():
    import time

    lexicon = t.Lexicon({"trash": 4.0}, ["trash can"])
    began = time.process_time()
    assert len(lexicon.hits("trash can trash " * 100_000)) == 100_000
    assert time.process_time() - began < 5


def test_query_against_a_refit(spark):
    """The query's scores are those of the fitted lexicon, by the naive matcher and the logistic, for every document."""
    import math

    from tidemark.llm.common import held_out

    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{n}.parquet") for n in ("documents", "labels"))
    lexicon = t.fit(t.labelled(docs, labels.where(~held_out("doc_id", 3, 1))))
    texts = dict(docs.select("doc_id", "text").collect())
    bias, a, b = lexicon.fit_
    for r in queries.op9_toxicity(spark, sf).collect():
        folded = t.fold(texts[r["doc_id"]])
        hits = sum(naive_hits(lexicon, folded)) if any(w.rstrip("*") in folded for w in lexicon.weights) else 0
        x = math.log1p(t.PER_WORDS * hits / max(t.SHORT_TEXT, folded.count(" ") + folded.count("\n") + 1)) if hits else 0.0
        assert abs(r["score"] - 1 / (1 + math.exp(-max(-50.0, min(50.0, bias + a * x + b * math.log1p(hits)))))) < 1e-9


def test_exceptions_by_rate_and_families(spark):
    """A harmless phrase stays an exception with a toxic row among many; one of copies of one text is none."""
    rnd = random.Random(3)

    def prose(n=8):
        return " ".join("".join(rnd.choice("abcdefghij") for _ in range(7)) for _ in range(n))

    rows = [(f"{prose()} trash {prose()}", 1) for _ in range(300)] + [(f"{prose()} {prose()}", 0) for _ in range(600)]
    rows += [(f"{prose()} trash bin {prose()}", 0) for _ in range(120)] + [(f"{prose()} trash bin {prose()} trash", 1)] * 2
    copied = prose()
    rows += [(f"{copied} trash heap {copied}", 0) for _ in range(20)]
    lexicon = t.fit(spark.createDataFrame(rows, "text string, toxic int"))
    assert "trash" in lexicon.weights and "trash bin" in lexicon.exceptions and "trash heap" not in lexicon.exceptions


def test_format_characters_hide_no_word():
    assert t.fold("idi\u200bot i\u00addiot \ufeffid\u2060iot") == "idiot idiot idiot"
