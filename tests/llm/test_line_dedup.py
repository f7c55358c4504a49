import hashlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import line_dedup as d
from tidemark.llm import queries

from .conftest import SF

WHITE = " \t\n\v\f\r"
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def keys(text):
    return [line.strip(WHITE).translate(LOWER) for line in (text or "").split("\n")]


def brute(texts, least=10, shortest=1):
    """(lines, dropped, kept) of each text, by counting keys themselves."""
    found = Counter(k for t in texts for k in {*keys(t)})
    out = []
    for t in texts:
        gone = [found[k] >= least and len(k) >= shortest for k in keys(t)]
        out.append((len(gone), sum(gone), "\n".join(line for line, g in zip((t or "").split("\n"), gone) if not g)))
    return out


def test_perfect_hash():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 63, 1000, 60_000):
        high, low = (rng.integers(0, 2**64, n, dtype=np.uint64) for _ in range(2))
        counts = rng.integers(1, 2**31, n)
        shard = d.Shard.unpacked(d.Shard.built(high, low, counts).packed())
        assert sorted(shard.index(high, low).tolist()) == list(range(n))
        assert (shard.count(high, low) == counts).all()
        other = rng.integers(0, 2**64, 5000, dtype=np.uint64)
        assert not shard.count(other, other).any() and not (n and shard.count(high ^ np.uint64(1), low).any())
    size = 8 * len(d.Shard.built(high, low, counts).packed()) / n
    assert size < 64 + 32 + 6  # fingerprint, count, and some bits of the hash


def test_equal_lower_halves_are_told_apart():
    low = np.array([5, 5, 5, 9, 9, 1], np.uint64)
    high = np.array([1, 2, 3, 1, 2, 1], np.uint64)
    shard = d.Shard.unpacked(d.Shard.built(high, low, np.arange(10, 16)).packed())
    assert shard.count(high, low).tolist() == list(range(10, 16)) and shard.count(np.array([4], np.uint64), np.array([5], np.uint64)).tolist() == [0]


def test_query_against_brute_force(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    want = {i: (n, gone, hashlib.sha256(kept.encode()).hexdigest()) for i, (n, gone, kept) in zip(docs, brute([*docs.values()]))}
    got = {r["doc_id"]: tuple(r)[1:] for r in queries.op13_line_dedup(spark, SF).collect()}
    assert got == want and any(r[1] for r in got.values())


@pytest.mark.parametrize(
    ("bounds", "least", "shortest"),
    [({}, 2, 1), ({}, 10, 4), ({"shard_keys": 2}, 3, 0), ({"shard_keys": 2, "sent_bytes": 0, "slice_hashes": 7}, 3, 0), ({"sent_bytes": 0}, 2, 1), ({"sent_bytes": 0}, 10**6, 1)],
)
def test_ways_agree_on_odd_documents(spark, odd_docs, bounds, least, shortest):
    """Arrays sent to every task, and shards that stay in place, in slices of a few hashes."""
    lines = ["Hot line", " hot LINE\t", "", "  ", "ÄÖ", "äö", "Ünï 　", "x\r", "😀", "rare {}", "\x1cnot white\x1c", "K"]
    made = [(k, "\n".join(lines[(k * 7 + j * j) % len(lines)].format(k) for j in range(k % 9))) for k in range(60)]
    docs = odd_docs.select("doc_id", "text").union(spark.createDataFrame(made, "doc_id long, text string"))
    found = d.drop_frequent(docs.withColumn("line", F.lit(1)).withColumn("kept", F.lit("clash")), least=least, shortest=shortest, **bounds).collect()
    rows = [tuple(r) for r in docs.collect()]
    want = sorted(repr((i, *w)) for (i, _), w in zip(rows, brute([t for _, t in rows], least, shortest)))
    assert sorted(repr((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept"] or "")) for r in found) == want


@pytest.mark.parametrize("sent", [d.SENT_BYTES, 0])
def test_other_columns_stay(spark, odd_docs, no_docs, sent):
    docs = odd_docs.withColumn("a.b", F.lit(3)).withColumn("shard", F.array(F.lit(1)))
    out = d.cleaned(docs, least=2, sent_bytes=sent)
    assert out.dtypes == docs.dtypes
    assert sorted(map(repr, (tuple(r) for r in out.drop("text").collect()))) == sorted(map(repr, (tuple(r) for r in docs.drop("text").collect())))
    assert out.where("text is null").count() == docs.where("text is null").count()
    assert d.cleaned(no_docs, sent_bytes=sent).count() == 0 and d.drop_frequent(no_docs, sent_bytes=sent).count() == 0
