import hashlib
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tidemark.llm import merkle_manifest as m
from tidemark.llm import queries

from .conftest import SF


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(values):
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def climbed(nodes):
    """The levels of a tree, its leaves first."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([sha(*below[k : k + 2]) for k in range(0, len(below), 2)])
    return levels


def brute(rows):
    """[(doc_id, leaf, subroot, root, siblings, folded root)] of rows (doc_id, source, lang, n_chars, text)."""
    groups = defaultdict(list)
    for r in rows:
        groups[r[2]].append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in order:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        trees[g] = climbed([leaf_of(r) for r in groups[g]])
    top = climbed([trees[g][-1][0] for g in order])
    out = []
    for k, g in enumerate(order):
        for at, r in enumerate(groups[g]):
            touched = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            h = leaf_of((*r[:3], r[3] + 1, r[4]) if touched and r[3] is not None else r)
            found = []
            for levels, place in ((trees[g], at), (top, k)):
                for level in levels[:-1]:
                    other = level[place ^ 1] if place ^ 1 < len(level) else ""
                    found.append(other)
                    h = sha(h, other) if place % 2 == 0 else sha(other, h)
                    place //= 2
            out.append((r[0], trees[g][0][at], trees[g][-1][0], top[-1][0], found, h))
    return out


def asked(docs):
    touched = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.lit(False))
    found = m.manifest(docs, claimed=[F.col("n_chars") + touched.cast("int") if c == "n_chars" else c for c in m.FIELDS])
    return found.select("doc_id", "leaf", "subroot", "root", m.siblings("path").alias("siblings"), m.folded("claim", "path").alias("folded")).collect()


def same(got, rows):
    assert sorted(map(repr, ((r["doc_id"], r["leaf"], r["subroot"], r["root"], list(r["siblings"]), r["folded"]) for r in got))) == sorted(map(repr, brute(rows)))


def test_query_against_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select(*m.FIELDS).collect()]
    got = sorted((tuple(r) for r in queries.op12_merkle_manifest(spark, SF).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()))
    assert got == sorted((i, a, s, root, sha(*found), h, h == root) for i, a, s, root, found, h in brute(rows))
    assert {r[-1] for r in got} == {True, False}


@pytest.mark.parametrize("height", [1, 2])
def test_many_heights(spark, monkeypatch, height):
    """Blocks of two and of four nodes; groups of 1 to 70 rows, a hot one among them."""
    monkeypatch.setattr(m, "HEIGHT", height)
    monkeypatch.setattr(m, "BLOCK", 1 << height)
    monkeypatch.setattr(m, "RANGE_ROWS", 9)
    sizes = {None: 3, "": 1, "hot": 70, "de": 16, "é": 5, "z": 17}
    rows = [(k * 31 % 997, "s" * (k % 3) or None, lang, None if k % 5 == 0 else k, f"text {k}") for lang, n in sizes.items() for k in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(3)
    same(asked(docs), rows)


def test_odd_rows(spark, odd_docs, no_docs):
    same(asked(odd_docs.withColumn("path", F.lit(1)).withColumn("tree", F.lit("x"))), [tuple(r[c] for c in m.FIELDS) for r in odd_docs.collect()])
    assert m.manifest(no_docs).count() == 0
    one = odd_docs.where("doc_id = 4")
    got = m.manifest(one).collect()[0]
    assert got["leaf"] == got["subroot"] == got["root"] == got["claim"] and got["path"] == []


def test_preimages_are_the_manifest(spark):
    """Stored preimages alone rebuild every digest above the leaves."""
    leaves = spark.range(600).select(F.lit("t").alias("tree"), F.sha2(F.col("id").cast("string"), 256).alias("digest"), "id")
    heights = m.grown(m.placed(leaves, "id"), "id")
    stored = {(r["level"], r["node"]): r["preimage"] for r in m.preimages(heights).collect()}
    levels = climbed([sha(str(k)) for k in range(600)])
    assert stored == {(k, i): "".join(levels[k - 1][2 * i : 2 * i + 2]) for k in range(1, len(levels)) for i in range(len(levels[k]))}
    assert [tuple(r) for r in m.roots(heights).collect()] == [("t", levels[-1][0])]
