import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tidemark.llm import queries
from tidemark.llm import wavelet_store as w

from .conftest import SF

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_matrix_against_a_list():
    rng = np.random.default_rng(0)
    for n, top in ((1, 1), (7, 3), (600, 2), (5000, 49_000)):
        ids = (rng.zipf(1.3, n) % top).astype(np.uint16)
        m = w.unpack(w.pack([1], np.array([n]), ids))[2]
        assert (m.decode() == ids).all() and [m.access(i) for i in range(0, n, 7)] == ids[::7].tolist()
        for v in {*ids[:20].tolist(), 0, 1, 40_000}:
            at = np.nonzero(ids == v)[0]
            assert m.count(v) == len(at) and m.count(v, n // 4, n // 2) == ((at >= n // 4) & (at < n // 2)).sum()
            assert [m.find(v, k) for k in range(min(30, len(at)))] == at[:30].tolist()
            assert m.find_all(v).tolist() == at.tolist()
        rare = ids.copy()
        rare[::97] = min(n + 50_000, 65_000)
        assert w.unpack(w.pack([1], np.array([n]), rare))[2].find_all(int(rare[0])).tolist() == list(range(0, n, 97))


def test_encoder_like_the_library():
    rnd = random.Random(1)
    texts = ["".join(rnd.choice("aB'sé \n\t\x01\x85 ﬁ1!~İΣ́a<|endoftext|>À×÷ÿß.,-µ") for _ in range(rnd.randint(0, 60))) for _ in range(2000)]
    texts += [f"{a}<|endoftext|>{b}<|startoftext|> {a}" for a, b in zip(texts[:200], texts[200:400])] + ["<|endoftext|>", "x <|ENDOFTEXT|> y", "a" * 200]
    library = Tokenizer.from_file(PATH)
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, "<u4").tolist() for x in w.WordEncoder(PATH).encode_texts(texts)] == want


def test_query_against_the_library(spark):
    library, start = Tokenizer.from_file(PATH), 0
    got = {r["doc_id"]: r for r in queries.op6_wavelet_store(spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").select("doc_id", "text").collect():
        ids = np.array([*library.encode(r["text"], add_special_tokens=False).ids, 1], "<u4")
        row = got.pop(r["doc_id"])
        assert (row["start"], row["n_tokens"], row["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert not got


def test_many_shards_and_odd_rows(spark, odd_docs, no_docs, tmp_path):
    shards = w.write_shards(odd_docs, PATH, 1, str(tmp_path / "s"), part_bytes=100_000, shard_bytes=50)
    assert shards.count() > 2
    rows = sorted(w.read_documents(shards).collect(), key=lambda r: r["start"])
    assert len(rows) == odd_docs.count()
    assert [r["doc_id"] for r in rows] == sorted([r["doc_id"] for r in odd_docs.collect()], key=lambda d: (d is not None, d or 0))
    assert [r["start"] for r in rows] == [sum(x["n_tokens"] for x in rows[:k]) for k in range(len(rows))]
    assert [r["n_tokens"] for r in rows if r["doc_id"] in (2, 3, 5)] == [1, 1, 1]
    counted = {r["doc_id"]: r["n"] for r in w.occurrences(shards, 1).collect() if r["doc_id"] in (2, 4)}
    assert counted == {2: 1, 4: 1}
    assert w.read_documents(w.write_shards(no_docs, PATH, 1)).count() == 0
