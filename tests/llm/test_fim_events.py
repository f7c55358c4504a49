import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from tidemark.llm import fim_events as f
from tidemark.llm import queries

from .conftest import SF

UNITS = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def brute(doc_id, text):
    """(n, form, prefix, middle, output) by splitting the text into its units."""
    text = text or ""
    units = UNITS.findall(text)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[k : k + 8], 16) for k in (0, 8, 16, 24))
    n = len(units)
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return n, "plain", None, None, text
    prefix, middle, suffix = ("".join(units[a:b]) for a, b in ((0, low), (low, high), (high, n)))
    if h4 % 100 < 80:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def test_units_of_texts_by_their_events():
    rnd = random.Random(3)
    texts = ["".join(rnd.choice("ab \t\n\r\v\f<>PSM😀é \x00\x85") for _ in range(rnd.randint(0, 30))) for _ in range(5000)]
    for text in [*texts, "", " ", "a", " a", "a ", "\n" * 5000, "x" * 5000]:
        want = UNITS.findall(text)
        units = f.Units(text)
        assert [units.end(k) for k in range(len(units) + 1)] == [len("".join(want[:k])) for k in range(len(want) + 1)]
        assert units.marked == any(s in text for s in (f.PREFIX, f.SUFFIX, f.MIDDLE))


def test_query_against_brute_force(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries.op11_fim_events(spark, SF).collect()
    assert len(got) == len(docs) and len({r["form"] for r in got}) == 3

    def sha(text):
        return hashlib.sha256(text.encode()).hexdigest()

    for r in got:
        n, form, prefix, middle, output = brute(r["doc_id"], docs[r["doc_id"]])
        assert tuple(r)[1:] == (n, form, prefix, middle, sha(output), sha(docs[r["doc_id"]] or ""))


def test_odd_rows_and_texts_made_of_marks(spark, odd_docs, no_docs):
    rnd = random.Random(4)
    made = [(k, "".join(rnd.choice(["<", ">", "P", "S", "M", " ", "<S", "M>", "a\n"]) for _ in range(rnd.randint(0, 40)))) for k in range(2000)]
    docs = odd_docs.select("doc_id", "text").union(spark.createDataFrame(made, "doc_id long, text string"))
    out = f.rewrite(docs.withColumn("form", F.lit("clash")))
    rows = out.select("*", f.restored("output", "form").alias("back")).collect()
    want = sorted(repr((r["doc_id"], *brute(r["doc_id"], r["text"]), r["text"] or "")) for r in docs.collect())
    assert sorted(repr(tuple(r)) for r in rows) == want
    assert f.rewrite(no_docs).count() == 0
    with pytest.raises(ValueError):
        f.rewrite(docs.withColumnRenamed("doc_id", "n"), "n")


def test_shares_and_seed(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("one two three four five").alias("text"))
    shares = {r["form"]: r["count"] / 4000 for r in f.rewrite(docs).groupBy("form").count().collect()}
    assert abs(shares["plain"] - 0.5) < 0.04 and abs(shares["spm"] - 0.4) < 0.04 and abs(shares["psm"] - 0.1) < 0.03
    assert f.rewrite(docs, rewritten=0).where("form != 'plain'").count() == 0
    every = f.rewrite(docs, rewritten=100, suffix_first=100)
    assert every.where("form = 'spm'").count() == 4000
    assert every.join(f.rewrite(docs, seed=7, rewritten=100, suffix_first=100), ["doc_id", "output"]).count() < 2000
