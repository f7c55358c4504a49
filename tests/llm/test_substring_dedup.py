import random

from tidemark.llm import substring_dedup as s


def prose(rnd, n):
    return " ".join("".join(rnd.choice("th er on in re an st ti en".split()) for _ in range(rnd.randint(1, 4))) for _ in range(n))


def test_long_passages_meet_whatever_stands_around():
    rnd, missed = random.Random(4), 0
    for _ in range(400):
        p = prose(rnd, 52)
        one, two = (f"{prose(rnd, rnd.randint(0, 60))} {p}\n{prose(rnd, rnd.randint(0, 60))}" for _ in range(2))
        missed += not {tuple(x) for x in s.chunks(one)[2].tolist()} & {tuple(x) for x in s.chunks(two)[2].tolist()}
    assert missed <= 2


def test_an_insertion_moves_few_chunks():
    rnd = random.Random(5)
    text = prose(rnd, 2000).split()
    other = [*text[:700], "inserted", "words", *text[700:]]
    a, b = ({tuple(x) for x in s.chunks(" ".join(t))[2].tolist()} for t in (text, other))
    assert len(a - b) < 0.05 * len(a)


def test_spans_hold_the_same_words(spark):
    rnd = random.Random(6)
    p, q = prose(rnd, 60), prose(rnd, 80)
    texts = {1: f"{prose(rnd, 50)} {p}", 2: f"{p} {prose(rnd, 40)} {q}", 3: f"{prose(rnd, 30)} {q}", 4: prose(rnd, 300), 5: f"{prose(rnd, 20)} {p} {prose(rnd, 9)} {p}"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows = s.repeated_spans(docs).collect()
    assert {r["doc_id"] for r in rows} == {1, 2, 3, 5}
    for r in rows:
        words = " ".join(texts[r["doc_id"]].split()[r["start"] : r["stop"]])
        assert words in " ".join(texts[r["first_doc"]].split()) or r["keep"]
        assert words in p or words in q
        assert r["n_words"] >= s.SPAN
    sizes = sorted((r["doc_id"], r["n_words"]) for r in rows)
    for (doc, n), want in zip(sizes, [(1, 60), (2, 60), (2, 80), (3, 80), (5, 60), (5, 60)], strict=True):
        assert doc == want[0] and want[1] - 2 * (s.NEIGHBOURS - 1) <= n <= want[1]  # edges are within six words
    clean = {r["doc_id"]: r["text"] for r in s.without_repeats(docs).collect()}
    assert clean[1] == texts[1] and clean[4] == texts[4]
    assert len(clean[2].split()) < len(texts[2].split()) and len(clean[3].split()) < 60


def brute(docs, span):
    """For each document the words that lie in a run of ``span`` words or more that another document has."""
    runs: dict = {}
    for doc, text in docs:
        w = text.split()
        for k in range(len(w) - span + 1):
            runs.setdefault(tuple(w[k : k + span]), []).append((doc, k))
    out: dict = {}
    for places in runs.values():
        if len({d for d, _ in places}) > 1:
            for d, k in places:
                out.setdefault(d, set()).update(range(k, k + span))
    return out


def test_query_against_brute_force(spark):
    """Every word that the query reports is in a run that others have; all but a few in a thousand of those are reported."""
    from tidemark.llm import queries

    from .conftest import SF

    texts = dict(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    sure, most, got = brute(texts.items(), s.SPAN + s.NEIGHBOURS - 1), brute(texts.items(), s.SPAN), {}
    rows = queries.op1_substring_dedup(spark, SF).collect()
    for r in rows:
        assert r["stop"] - r["start"] == r["n_words"] >= s.SPAN
        got.setdefault(r["doc_id"], set()).update(range(r["start"], r["stop"]))
    assert sure and set(sure) <= set(got) <= set(most)
    assert sum(len(got[d] - most[d]) for d in got) < 0.002 * sum(map(len, got.values()))
    assert sum(len(got[d] & sure[d]) for d in sure) > 0.98 * sum(map(len, sure.values()))
    for r in rows:
        assert r["first_doc"] == r["doc_id"] if r["keep"] else r["first_doc"] < r["doc_id"]


def test_shared_runs_below_the_shortest_span_are_left_alone(spark):
    rnd = random.Random(9)
    p, q = prose(rnd, s.SPAN - 1), prose(rnd, 51)
    docs = spark.createDataFrame([(k, f"{prose(rnd, 60)} {p if k < 5 else q} {prose(rnd, 60)}") for k in range(10)], "doc_id long, text string")
    rows = s.repeated_spans(docs).collect()
    assert {r["doc_id"] for r in rows} == set(range(5, 10)) and all(s.SPAN <= r["n_words"] <= 51 for r in rows)


def test_every_run_of_51_words_keeps_a_window(spark):
    """Whatever stands around it, all of 300 passages of 51 words are found in both their documents."""
    rnd = random.Random(12)
    passages = [prose(rnd, 51) for _ in range(300)]
    docs = spark.createDataFrame([(k, f"{prose(rnd, rnd.randint(0, 70))} {passages[k // 2]} {prose(rnd, rnd.randint(0, 70))}") for k in range(600)], "doc_id long, text string")
    assert {r["doc_id"] for r in s.repeated_spans(docs).collect()} == set(range(600))


def test_runs_of_few_words_are_cut_too(spark):
    docs = spark.createDataFrame([(1, "a b c " * 100), (2, "x y " + "a b c " * 90), (3, "same " * 80), (4, "same " * 70)], "doc_id long, text string")
    assert {r["doc_id"] for r in s.repeated_spans(docs).collect()} == {1, 2, 3, 4}


def test_texts_of_one_id_and_clashing_columns(spark):
    """One id with several texts: positions do not mix, and a text that shares nothing stays as it is."""
    rnd = random.Random(10)
    shared, apart = prose(rnd, 80), prose(rnd, 120)
    rows = [(1, f"{shared} {prose(rnd, 30)}"), (2, f"{prose(rnd, 10)} {shared}"), (2, apart), (3, f"{prose(rnd, 20)} {shared}"), (3, f"{shared} {prose(rnd, 5)}"), (None, f"{shared} x")]
    docs = spark.createDataFrame([(k, t, "_id", "t", 1) for k, t in rows], "number long, body string, _id string, t string, start int")
    out = s.without_repeats(docs, id_col="number", text_col="body")
    assert out.columns == docs.columns and out.dtypes == docs.dtypes
    texts = [(r["number"], r["body"]) for r in out.collect()]
    assert (2, apart) in texts and rows[0] in texts and rows[-1] in texts
    sizes = sorted(len(t.split()) for k, t in texts if k == 3)
    assert 5 <= sizes[0] <= 17 and 20 <= sizes[1] <= 32 and any(k == 2 and len(t.split()) <= 22 for k, t in texts)
    one = spark.createDataFrame([(7, f"{shared} {prose(rnd, 9)}"), (7, f"{prose(rnd, 9)} {shared}")], "doc_id long, text string")
    assert len(s.repeated_spans(one).collect()) == 2


def test_both_joins_agree_and_odd_rows(spark, odd_docs, no_docs, monkeypatch):
    rnd = random.Random(7)
    hot = prose(rnd, 90)
    docs = spark.createDataFrame([(k, f"{prose(rnd, 10)} {hot if k % 3 == 0 else prose(rnd, 90)}") for k in range(200)], "doc_id long, text string")
    one = sorted(map(tuple, s.repeated_spans(docs).collect()))
    monkeypatch.setattr(s, "SENT_DIGESTS", -1)
    monkeypatch.setattr(s, "SENT_STRETCHES", -1)
    assert one == sorted(map(tuple, s.repeated_spans(docs).collect()))
    assert {r[0] for r in one} == set(range(0, 200, 3))
    assert s.repeated_spans(odd_docs).count() == 0 and s.repeated_spans(no_docs).count() == 0
    assert s.without_repeats(odd_docs).count() == odd_docs.count()


def made_of(rnd, alphabet, n):
    return "".join(rnd.choice(alphabet) for _ in range(n))


def test_scripts_without_spaces_and_runs_of_letters(spark):
    """Shared runs in Chinese, Japanese and Thai, apart by wide spaces, and in text without any white space."""
    rnd = random.Random(8)
    han, kana, thai = [chr(c) for c in range(0x4E00, 0x4E00 + 900)], [chr(c) for c in range(0x3041, 0x3090)], [chr(c) for c in range(0x0E01, 0x0E2F)]
    letters = "abcdefghijklmnopqrstuvwxyz0123456789"
    wide = "\u3000".join(prose(rnd, 70).split())
    shared = {"han": made_of(rnd, han, 2000), "kana": made_of(rnd, kana, 300), "thai": made_of(rnd, thai, 300), "wide": wide, "letters": made_of(rnd, letters, 3000)}
    rows, k = [], 0
    for name, passage in shared.items():
        for _ in range(2):
            source = {"han": han, "kana": kana, "thai": thai}.get(name, letters)
            around = [made_of(rnd, source, rnd.randint(50, 400)) for _ in range(2)] if name != "wide" else [prose(rnd, 30) for _ in range(2)]
            rows.append((k, around[0] + ("\u3000" if name == "wide" else "") + passage + ("\u3000" if name == "wide" else "") + around[1]))
            k += 1
    rows += [(k, made_of(rnd, han, 500)), (k + 1, made_of(rnd, letters, 5000)), (k + 2, "x" * 5000), (k + 3, "中"), (k + 4, "\u3000\xa0")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = s.repeated_spans(docs).collect()
    assert {r["doc_id"] for r in found} == set(range(10))
    for r in found:
        text = rows[r["doc_id"]][1]
        words, _ = s.words_of(text)
        other = s.words_of(rows[r["first_doc"]][1])[0]
        mine = words[r["start"] : r["stop"]]
        assert any(other[j : j + len(mine)] == mine for j in range(len(other))) and len(mine) >= s.SPAN
        passage = [*shared.values()][r["doc_id"] // 2]
        assert len(b"".join(mine)) > 0.8 * len(passage.replace("\u3000", "").encode())
    clean = {r["doc_id"]: r["text"] for r in s.without_repeats(docs).collect()}
    for i, text in rows:
        if i % 2 == 0 or i >= 10:
            assert clean[i] == text
        else:
            assert len(clean[i]) < len(text) - 0.7 * len([*shared.values()][i // 2])
    assert " " not in clean[1].strip().replace(" ", "", 1)  # one cut, and no spaces between its characters otherwise


def test_words_of_mixed_text():
    assert s.words_of("ab\u3000c中文d e")[0] == [x.encode() for x in ("ab", "c", "中", "文", "d", "e")]
    assert s.words_of("ab\u3000c中文d e")[1] == [False, False, True, True, True, False]
    assert s.words_of("naïve café") == ([x.encode() for x in ("naïve", "café")], None)
    long = "é1" * 500
    words, glued = s.words_of(f"a {long}")
    assert b"".join(words[1:]) == long.encode() and glued[:2] == [False, False] and all(glued[2:]) and [w.decode() for w in words]
    assert s.words_of("a\x1cb \x0b c")[0] == [b"a\x1cb", b"c"]
