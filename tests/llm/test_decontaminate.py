import random
import re

import numpy as np
import pytest

from tidemark.llm import decontaminate as d
from tidemark.llm import queries

from .conftest import SF

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text, items):
    doc, hit, found = words(text), set(), set()
    for item_id, item in items:
        w = words(item)
        for k in range(max(1, len(w) - 12) if w else 0):
            p = w[k : k + 13]
            for i in range(len(doc) - len(p) + 1):
                if doc[i : i + len(p)] == p:
                    hit |= set(range(i, i + len(p)))
                    found.add(str(item_id))
    return len(doc), len(hit), sorted(found)


def test_search_against_brute_force():
    rnd = random.Random(2)
    for case in range(150):
        alphabet = "a b c D é".split()
        items = [(k, " ".join(rnd.choice(alphabet) for _ in range(rnd.choice((0, 1, 2, 3, 13, 15))))) for k in range(4)]
        text = " ".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 60))) + " - " + rnd.choice(items)[1]
        ws = d.words_of(text)
        hit, found = d.Scanner(items).scan(ws)
        assert (len(ws), hit.count(1) if hit else 0, sorted(found)) == brute(text, items), case


def test_query_against_brute_force(spark):
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    texts = dict(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    rows = queries.op10_decontaminate(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        n, hit, found = brute(texts[r["doc_id"]], items)
        assert (r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) == (n, hit, len(found), hit > 0 and 20 * hit >= n)


KEY = lambda r: (str(r["doc_id"]), r["n_words"], r["n_hit"], tuple(r["items"]), r["contaminated"])


def test_either_search_and_odd_rows(spark, odd_docs, no_docs):
    bench = spark.createDataFrame(
        [(1, "the quick brown fox"), (1, "the quick brown fox"), (2, "jumps over the lazy dog"), (None, "naïve"), (3, None), (4, "")], "item_id long, text string"
    )
    one = sorted(map(KEY, d.scan_documents(odd_docs, bench).collect()))
    for size in (0, 100):
        assert one == sorted(map(KEY, d.scan_documents(odd_docs, bench, part_bytes=size).collect()))
    assert len(one) == odd_docs.count() and ("8", 4, 1, ("null",), True) in one
    assert d.scan_documents(no_docs, bench).count() == 0
    none = spark.createDataFrame([], "item_id long, text string")
    assert all(r["n_hit"] == 0 for r in d.scan_documents(odd_docs, none).collect())
    for size in (100, 1 << 20):
        kept = d.drop_contaminated(odd_docs, bench, part_bytes=size)
        assert kept.columns == odd_docs.columns and sorted(r["doc_id"] for r in kept.where("doc_id is not null").collect()) == [2, 3, 4, 5, 6, 7]
        assert kept.where("doc_id is null").count() == 1


def test_rows_are_judged_by_themselves(spark):
    """Rows without an id, and rows that share one, go or stay by their own texts, in either search."""
    item = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    docs = spark.createDataFrame(
        [(1, f"x {item}", "a"), (None, f"{item} y", "b"), (2, "nothing of it", "c"), (2, f"{item}", "d"), (None, "clean", "e"), (3, None, "f")], "n long, body string, found string"
    )
    bench = spark.createDataFrame([(5, item), (6, "something else that is not there")], "key long, passage string")
    for size in (60, 1 << 20):
        kept = d.drop_contaminated(docs, bench, text_col="body", item_col="key", item_text_col="passage", part_bytes=size)
        assert kept.columns == docs.columns and sorted(r["found"] for r in kept.collect()) == ["c", "e", "f"]
        short = d.drop_contaminated(docs, bench, text_col="body", item_col="key", item_text_col="passage", window=3, part_bytes=size)
        assert sorted(r["found"] for r in short.collect()) == ["c", "e", "f"]


@pytest.mark.parametrize("bounds", [{}, {"MOST_BLOCKS": 0}, {"MOST_BITS": 8}])
def test_long_items_are_searched_alike_by_hashes(spark, monkeypatch, bounds):
    """With the shift table and the bitmap, without the table, and with a bitmap that rules out next to nothing."""
    rnd = random.Random(6)
    words_ = [f"w{rnd.randint(0, 400)}" for _ in range(900)]
    bench = spark.createDataFrame([(1, " ".join(words_)), (2, "same " * 300), (3, " ".join(words_[100:140]))], "item_id long, text string")
    texts = [" ".join(words_[k : k + 40]) for k in range(0, 860, 13)] + ["same " * 60, "w1 w2"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    items = [tuple(r) for r in bench.collect()]
    whole = d.Scanner(items)
    want = []
    for k, t in enumerate(texts):
        hit, found = whole.scan(d.words_of(t))
        want.append((str(k), len(words(t)), hit.count(1) if hit else 0, tuple(sorted(found))))
    for bound, value in bounds.items():
        monkeypatch.setattr(d, bound, value)
    for size in (9000,) if bounds else (1 << 20, 9000):
        assert sorted(want) == sorted(KEY(r)[:4] for r in d.scan_documents(docs, bench, part_bytes=size).collect())
    n, hit, found = brute(texts[3], items)
    assert want[3][1:] == (n, hit, tuple(found))


def test_skips_lose_no_candidate():
    """Whatever windows a text has, the shift table leaves their places; short patterns and single words too."""
    rnd = random.Random(9)
    for _ in range(300):
        alphabet = "a b c d e f".split()[: rnd.randint(2, 6)]
        items = [[rnd.choice(alphabet).encode() for _ in range(rnd.choice((1, 2, 3, 5, 8)))] for _ in range(3)]
        windows = [(m := min(len(w), 4), w[k : k + m], w) for w in items for k in range(len(w) - min(len(w), 4) + 1)]
        shifts = {}
        for m, _, w in windows:
            for j, b in enumerate(d._blocks(d._hashes(w), m).tolist()):
                if j >= min(1, m - 1):
                    shifts[b] = min(shifts.get(b, 99), max(0, m - 1 - j))
        table = np.array(sorted(shifts), np.uint64)
        skip = d.Skipper(sorted({m for m, *_ in windows}), table, np.array([shifts[b] for b in table.tolist()]), np.full(1, 255, np.uint8))
        text = [rnd.choice([*alphabet, "x"]).encode() for _ in range(rnd.randint(0, 40))]
        found = {(start, m): words for start, m, _, words in skip.candidates(text)}
        for m, pattern, _ in windows:
            for k in range(len(text) - m + 1):
                assert text[k : k + m] != pattern or found[k, m] == b" ".join(pattern)


def test_compiled_size_is_bounded():
    """A benchmark takes less than fifty times its text here, where words repeat."""
    import tracemalloc

    rnd = random.Random(8)
    vocabulary = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 9))) for _ in range(20_000)]
    items = [(k, " ".join(rnd.choice(vocabulary) for _ in range(200))) for k in range(400)]
    size = sum(len(t) for _, t in items)
    tracemalloc.start()
    held = d.Scanner(items)
    used = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert held.searchers and used < 50 * size, used / size
