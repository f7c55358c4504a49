import random

import numpy as np
import pandas as pd
import pytest
import xxhash

from tidemark.llm import simhash_golay as s
from tidemark.llm.components import components

from .conftest import SF


def brute_print(text):
    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
    hs = [xxhash.xxh64_intdigest(x, 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_classes(fps):
    u = np.unique(np.array(list(fps), np.uint64))
    root = list(range(len(u)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x, y in zip(*np.nonzero(np.bitwise_count(u[:, None] ^ u[None, :]) <= 3)):
        x, y = find(x), find(y)
        root[max(x, y)] = min(x, y)
    return {int(f): find(k) for k, f in enumerate(u)}


def test_any_three_errors_share_a_key():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 63, 600, dtype=np.uint64)
    for errors in range(4):
        b = a.copy()
        for i in range(len(b)):
            for bit in rng.choice(64, errors, replace=False):
                b[i] ^= np.uint64(1 << int(bit))
        key, row, role = s.keys_of(np.concatenate([a, b]))
        heads = {(int(k), int(r)) for k, r, o in zip(key, row, role) if o & s.HEAD}
        tails: dict = {}
        for k, r, o in zip(key, row, role):
            if o & s.TAIL:
                tails.setdefault(int(r), set()).add(int(k))
        for i in range(len(a)):
            j = i + len(a)
            assert any((k, i) in heads for k in tails.get(j, ())) or any((k, j) in heads for k in tails.get(i, ()))


def check(out, rows):
    want = brute_classes([f for _, f in rows])
    groups: dict = {}
    for i, f in rows:
        groups.setdefault(want[f], []).append(i)
    assert {(r["doc_id"], r["component_id"]) for r in out} == {(i, min(groups[want[f]])) for i, f in rows}


def test_query_against_brute_force(spark):
    from tidemark.llm import queries

    out = queries.op4_simhash_golay(spark, SF).collect()
    texts = dict(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    assert {r["doc_id"]: int(r["fingerprint"], 16) for r in out} == {i: brute_print(t) for i, t in texts.items()}
    check(out, [(r["doc_id"], int(r["fingerprint"], 16)) for r in out])


def test_dense_and_hot_groups(spark, monkeypatch):
    monkeypatch.setattr(s, "FEW", 4)
    rng = random.Random(3)
    fps = []
    for centre in (rng.getrandbits(63) for _ in range(3)):
        for _ in range(400):
            f = centre
            for bit in rng.sample(range(64), rng.randint(0, 5)):
                f ^= 1 << bit
            fps.append(f)
    fps += [rng.getrandbits(63) for _ in range(100)]
    rows = list(enumerate(fps))
    table = spark.createDataFrame(pd.DataFrame({"doc_id": range(len(fps)), "fp": np.array(fps, np.uint64).view(np.int64)}))
    for refined in (64, 2048):  # by refined keys and by blocks alone
        monkeypatch.setattr(s.links, "__defaults__", (s.MAX_BITS, 64, refined))
        found = {r["fp"] & (2**64 - 1): r["component_id"] for r in s.classes(table).collect()}
        check([{"doc_id": i, "component_id": found[f]} for i, f in rows], rows)


def test_three_errors_leave_two_parts():
    """The parts cover all bits once, and any three errors leave two of them alone."""
    assert sorted(b for low, size in s.PARTS for b in range(low, low + size)) == list(range(64))
    assert len(s.PARTS) - s.MAX_BITS >= 2


def test_hot_components_can_be_split(spark):
    """Joins with what a component has in common read written tables on both sides, so that a hot root is split."""
    near = spark.range(20_000).selectExpr("id fp", "id % 3 - 3 root")
    from tidemark.llm.common import saved

    tops = saved(near.groupBy("root").agg({"fp": "min"}))
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2", "spark.sql.shuffle.partitions": "12"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        joined = saved(near.repartition(4)).join(tops, "root")
        joined.write.format("noop").mode("overwrite").save()
        joined.collect()
        assert "skew=true" in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


@pytest.mark.parametrize("last", [0, 30, 100_000])
def test_components_of_paths_and_stars(spark, monkeypatch, last):
    """In rounds to the end, in rounds until few edges are left, and in one task."""
    from tidemark.llm import components as c

    monkeypatch.setattr(c, "LAST_EDGES", last)
    edges = [(k, k + 1) for k in range(60)] + [(100, k) for k in range(101, 160)] + [(200, 201), (7, 7)]
    out = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long").repartition(5)).collect()}
    assert out == {k: 0 for k in range(61)} | {k: 100 for k in range(100, 160)} | {200: 200, 201: 200}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_odd_rows(spark, odd_docs, no_docs):
    out = s.near_duplicates(odd_docs).collect()
    assert len(out) == odd_docs.count()
    empties = [r for r in out if r["fp"] == 0]
    assert {r["doc_id"] for r in empties} == {2, 3, 5, None} and {r["component_id"] for r in empties} == {2}
    assert {r["component_id"] for r in out if r["doc_id"] == 1} == {1}
    kept = s.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted({r["component_id"] for r in out}) and ids.count(None) == 2
    assert s.near_duplicates(no_docs).count() == 0 and s.keep_one(no_docs).count() == 0


def test_one_id_with_two_texts_keeps_the_same_row(spark):
    rows = [(1, "some words of one text here"), (1, "quite another text by the same id"), (2, "a third one alone")]
    kept = set()
    for order in (rows, rows[::-1]):
        out = s.keep_one(spark.createDataFrame(order, "doc_id long, text string").repartition(2)).collect()
        assert sorted(r["doc_id"] for r in out) == [1, 2]
        kept.add(next(r["text"] for r in out if r["doc_id"] == 1))
    assert len(kept) == 1


def test_the_same_row_of_an_id_stays_in_any_order(spark):
    """Rows of one id and text that differ in other columns, nulls and maps among them."""
    rows = [(1, "a b c d", 3, "x", {"k": 1}), (1, "a b c d", 2, "x", {"k": 1}), (1, "a b c d", None, "y", {"k": 2}), (1, "a b c d", 2, None, None), (1, "a b c d", 2, "x", {"k": 1})]
    kept = set()
    for k in range(len(rows)):
        for parts in (1, 3):
            docs = spark.createDataFrame(rows[k:] + rows[:k], "doc_id long, text string, n long, s string, m map<string, int>").repartition(parts)
            kept.add(repr(s.keep_one(docs).collect()))
    assert len(kept) == 1


def test_ids_that_are_no_whole_numbers_are_refused(spark):
    docs = spark.createDataFrame([("a", "x")], "doc_id string, text string")
    for run in (s.keep_one, s.near_duplicates):
        with pytest.raises(ValueError, match="whole numbers"):
            run(docs)
