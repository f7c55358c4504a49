"""Toxicity by a weighted lexicon matched with an Aho-Corasick automaton over folded text.

Folding lower-cases, strips accents, maps homoglyphs of other scripts and full-width forms to the Latin
letter they look like, and reads digits and symbols inside words as the letters they stand for. The
lexicon is learnt: words and stems (beginnings of longer words) whose document frequency in toxic
training rows is far above that in the others get their shrunken log-odds as weight; of a stem and its
extensions the one that tells most is taken. Rows must come from several families of copies, so that what
merely stands in one much copied text is no entry. Exception phrases are learnt beside it: a lexicon word with
its neighbour, from several families too, whose rows are toxic far less often than the lexicon's cancels the
hit. A text's weighted hits, as they are
and normalised by its length, go through a logistic fitted to the training rows.

Training reads every labelled training row: words are counted by Spark, and the logistic is fitted on
counts of (features, label), never on rows held by the driver.

Defined results: null or empty text has no hits and the score of such a text; ties and repeated rows
score alike; rows without a label do not train; without both labels in training every score is 0.
Extra columns are ignored.
"""

from __future__ import annotations

import math
import unicodedata
import zlib

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .common import arrow_map, map_docs, saved, schema_of, slices

#: A word enters the lexicon with so many toxic training rows, so unlikely by chance that among all words
#: tried exp(-MIN_GAIN) such are to be expected,
MIN_TOXIC_ROWS = 5
MIN_GAIN = 3.0
#: and this share of its training rows toxic.
MIN_SHARE = 0.5
#: Toxic rows must come from many families of copies: a quarter of the rows, within these limits.
MIN_FAMILIES, ENOUGH_FAMILIES = 5, 24
#: An exception's share of toxic rows is at most this part of the lexicon's own, by this z-score at least.
EXEMPT_SHARE, EXEMPT_Z = 0.25, 3.0
#: A lexicon and its exceptions pass the driver (1 kB an entry) and go to every worker (200 bytes). No entry is dropped: beyond so
#: many, which no labelled corpus should come to, fitting stops with an error.
MOST_ENTRIES = 500_000
THRESHOLD = 0.7
#: Hits count by this many words of text; texts shorter than the second number count as that long.
PER_WORDS, SHORT_TEXT = 200, 60
#: Lengths of stems.
STEMS = range(4, 9)
#: Labels of 16 bytes that are broadcast at most; more are joined by a shuffle.
SENT_LABELS = 2_000_000

# Letters of other scripts by the Latin letter that they look like, and digits and
# symbols by the letter that they stand for inside a word.
HOMOGLYPHS = {
    "а": "a", "α": "a", "е": "e", "ε": "e", "о": "o", "ο": "o", "σ": "o", "р": "p", "ρ": "p", "с": "c", "ϲ": "c",
    "у": "y", "γ": "y", "х": "x", "χ": "x", "і": "i", "ι": "i", "ı": "i", "ј": "j", "ѕ": "s", "т": "t", "τ": "t",
    "в": "b", "β": "b", "н": "h", "к": "k", "κ": "k", "м": "m", "п": "n", "η": "n", "ν": "v", "ԁ": "d", "ɡ": "g",
    "ԝ": "w", "ω": "w", "ø": "o", "ł": "l", "ß": "ss",
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i"}

_SUBSTITUTED = regex.compile(r"(?<=\p{L})[\d@$!]+(?=\p{L})|(?<![\w@$!])[\d@$]{1,2}(?=\p{L})")
_DIGIT_TABLE = str.maketrans(DIGITS)
_WORDS = regex.compile(r"[a-z\p{L}]+")


def _plain(ch: str) -> str:
    low = ch.lower()
    if unicodedata.category(ch) == "Cf":  # a format character, such as a space without width, would cut a word in two
        return ""
    if low in HOMOGLYPHS:
        return HOMOGLYPHS[low]
    parts = [c for c in unicodedata.normalize("NFKD", low) if not unicodedata.combining(c)]
    return "".join(HOMOGLYPHS.get(c, c) for c in parts)


class _Fold(dict):
    """Translation of any non-ASCII character, worked out once for each character seen."""

    def __missing__(self, code: int) -> str | int:
        if code < 128:
            self[code] = code
        else:
            self[code] = _plain(chr(code))
        return self[code]


_FOLD = _Fold()


def fold(text: str | None) -> str:
    if not text:
        return ""
    text = text.lower()
    if not text.isascii():
        text = text.translate(_FOLD)
    if "@" in text or "$" in text or "!" in text or any(d in text for d in "0134578"):
        text = _SUBSTITUTED.sub(lambda m: m[0].translate(_DIGIT_TABLE), text)
    return text


def words(text: str | None) -> list[str]:
    return _WORDS.findall(fold(text))


def terms(text: str | None) -> set[str]:
    """Words, and stems with a star behind."""
    out = set(words(text))
    return out | {w[:k] + "*" for w in out for k in STEMS if k < len(w)}


class Lexicon:
    """Weights of words and exception phrases, matched in one pass."""

    def __init__(self, weights: dict[str, float], exceptions: list[str]):
        self.weights, self.exceptions = weights, exceptions
        self.fit_: tuple[float, float, float] = (-20.0, 0.0, 0.0)

    def __getstate__(self):
        return self.weights, self.exceptions, self.fit_

    def __setstate__(self, state):
        self.weights, self.exceptions, self.fit_ = state

    @property
    def automaton(self):
        if "_automaton" not in self.__dict__:
            found = ahocorasick.Automaton()
            for w, x in self.weights.items():
                found.add_word(w.rstrip("*"), (len(w.rstrip("*")), x, w[-1] == "*", False))
            for w in self.exceptions:
                found.add_word(w, (len(w), 0.0, False, True))
            if len(found):
                found.make_automaton()
            self._automaton = found
        return self._automaton

    def hits(self, folded: str) -> list[float]:
        """Weights of the matches at word edges that no exception phrase covers, found in one sweep."""
        if not len(self.automaton):
            return []
        found, spared, n = [], [], len(folded)
        for end, (size, weight, stem, exempt) in self.automaton.iter(folded):
            start = end - size + 1
            if (start == 0 or not folded[start - 1].isalpha()) and (end + 1 < n and folded[end + 1].isalpha()) == stem:
                (spared if exempt else found).append((start, end, weight))
        if spared:
            # a match is covered if of the exceptions that begin at or before it the farthest end is not before its own
            spared.sort()
            found.sort()
            kept, at, reach = [], 0, -1
            for match in found:
                while at < len(spared) and spared[at][0] <= match[0]:
                    reach = max(reach, spared[at][1])
                    at += 1
                if match[1] > reach:
                    kept.append(match)
            found = kept
        return [x for _, _, x in found]

    def evidence(self, text: str | None) -> tuple[float, float]:
        """Weighted hits normalised by length, and as they are, both on a log scale."""
        folded = fold(text)
        hits = sum(self.hits(folded))
        if not hits:
            return 0.0, 0.0
        length = folded.count(" ") + folded.count("\n") + 1
        return math.log1p(PER_WORDS * hits / max(SHORT_TEXT, length)), math.log1p(hits)

    def score(self, text: str | None) -> float:
        bias, a, b = self.fit_
        x, y = self.evidence(text)
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, bias + a * x + b * y))))


def _word_rows(train: DataFrame, text_col: str, label_col: str, terms_of) -> DataFrame:
    """(term, toxic, clean, families, clean_families): training rows of either label that hold each term, and
    about how many families of copies they are, up to 63. Shares are pre-added."""
    schema = schema_of("term string, clean long, toxic long, clean_family long, family long")
    arrow = to_arrow_schema(schema)

    def run(batches):
        counts: dict[str, list[int]] = {}

        def rows():
            cols = list(zip(*counts.values())) or [()] * 4
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), *(pa.array(c, pa.int64()) for c in cols)], schema=arrow)

        for part in slices(batches):
            for text, label in zip(*(c.to_pylist() for c in part.columns)):
                family = _family(text)
                for term in set(terms_of(text)):
                    held = counts.setdefault(term, [0, 0, 0, 0])
                    held[label] += 1
                    held[2 + label] |= family
            if len(counts) > 500_000:
                yield rows()
                counts.clear()
        yield rows()

    found = arrow_map(train.select(text_col, F.col(label_col).cast("int")), run, schema)
    return found.groupBy("term").agg(
        F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"), F.bit_count(F.expr("bit_or(family)")).alias("families"),
        F.bit_count(F.expr("bit_or(clean_family)")).alias("clean_families"),
    )


def _family(text: str | None) -> int:
    """One of 63 bits by the least hash of a text's longer words, which near copies mostly share."""
    found = words(text)
    least = min((zlib.crc32(w.encode()) for w in found if len(w) > 5), default=len(found))
    return 1 << (least % 63)


def _z(toxic: str, clean: str, n_toxic: int, n_clean: int):
    odds = F.log((F.col(toxic) + 0.5) / (n_toxic + 1.0)) - F.log((F.col(clean) + 0.5) / (n_clean + 1.0))
    return odds, odds / F.sqrt(1 / (F.col(toxic) + 0.5) + 1 / (F.col(clean) + 0.5))


def _gathered(rows: DataFrame) -> list:
    """All rows of a lexicon table; none is left out."""
    out = rows.limit(MOST_ENTRIES + 1).collect()
    if len(out) > MOST_ENTRIES:
        raise ValueError(f"more than {MOST_ENTRIES} lexicon entries")
    return out


def _pruned(chosen: list) -> list:
    """Of a stem and its extensions the one that tells most, strongest first."""
    kept, taken, begun = [], set(), set()
    for r in sorted(chosen, key=lambda r: (-r["gain"], r["term"][-1] == "*", -len(r["term"]), r["term"])):
        bare = r["term"].rstrip("*")
        begins = {bare[:k] for k in range(1, len(bare) + 1)}
        if bare not in taken and not begins & begun:
            kept.append(r)
            begun.add(bare)
            taken |= begins
    return kept


def fit(train: DataFrame, text_col: str = "text", label_col: str = "toxic") -> Lexicon:
    """Learn lexicon, exceptions and logistic from all labelled rows of ``train``."""
    train = train.where(F.col(label_col).isin(0, 1))
    sizes = {r[0]: r[1] for r in train.groupBy(label_col).count().collect()}
    n_toxic, n_clean = sizes.get(1, 0), sizes.get(0, 0)
    if not n_toxic or not n_clean:
        return Lexicon({}, [])

    counted = saved(_word_rows(train, text_col, label_col, terms))
    k, n, base = F.col("toxic"), F.col("toxic") + F.col("clean"), n_toxic / (n_toxic + n_clean)
    families = F.greatest(F.lit(MIN_FAMILIES), F.least(F.lit(ENOUGH_FAMILIES), k / 4))
    enough = (k >= MIN_TOXIC_ROWS) & (F.col("families") >= families) & (k >= MIN_SHARE * n) & (k > base * n)
    # Chernoff's bound on the chance of so many toxic rows among so many: -log of it, as nats
    gain = k * F.log(k / n / base) + F.when(F.col("clean") > 0, F.col("clean") * F.log(F.col("clean") / n / (1 - base))).otherwise(0.0)
    odds, z = _z("toxic", "clean", n_toxic, n_clean)
    telling = counted.where(enough).withColumn("gain", gain).where(F.col("gain") >= math.log(max(1, counted.count())) + MIN_GAIN)
    chosen = _pruned(_gathered(telling.withColumn("odds", odds).withColumn("z", z)))
    # a log-odds is shrunk by its own uncertainty
    weights = {r["term"]: float(max(0.1, r["odds"] - 2 * r["odds"] / r["z"])) for r in chosen}
    lexicon = Lexicon(weights, _exceptions(train, text_col, label_col, weights.keys()))
    _fit_logistic(lexicon, train, text_col, label_col)
    return lexicon


def _exceptions(train, text_col, label_col, lexicon) -> list[str]:
    """Phrases of a lexicon word and a neighbour whose rows are toxic far less often than the lexicon's."""
    whole, stems = {w for w in lexicon if w[-1] != "*"}, {w[:-1] for w in lexicon if w[-1] == "*"}

    def phrases(text):
        """The entries' pairs with their neighbours, and the empty phrase of every text with an entry."""
        ws = words(text)
        listed = [w in whole or any(w[:k] in stems for k in STEMS if k < len(w)) for w in ws]
        pairs = {f"{a} {b}" for a, b, x, y in zip(ws, ws[1:], listed, listed[1:]) if x or y}
        return pairs | {""} if any(listed) else pairs

    found = saved(_word_rows(train, text_col, label_col, phrases))
    every = found.where("term = ''").first()
    if not every:
        return []
    rows = F.col("toxic") + F.col("clean")
    usual = every["toxic"] / (every["toxic"] + every["clean"])
    below = (usual - F.col("toxic") / rows) / F.sqrt(F.lit(max(usual * (1 - usual), 0.01)) / rows)
    harmless = found.where((F.col("term") != "") & (F.col("clean_families") >= MIN_FAMILIES) & (F.col("toxic") <= EXEMPT_SHARE * usual * rows) & (below >= EXEMPT_Z))
    return sorted(r["term"] for r in _gathered(harmless))


def labelled(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """(text, label) of the documents with a label; texts are not shuffled unless there are many labels."""
    labels = labels.select(id_col, label_col)
    few = labels.count() <= SENT_LABELS
    return docs.select(id_col, text_col).join(F.broadcast(labels) if few else labels, id_col).select(text_col, label_col)


def _fit_logistic(lexicon: Lexicon, train: DataFrame, text_col: str, label_col: str) -> None:
    """Newton steps on counts of rounded features; logarithms to one digit, so a few thousand at most."""

    def run(texts, labels):
        found = [lexicon.evidence(t) for t in texts]
        return {"x": [round(a, 1) for a, _ in found], "y": [round(b, 1) for _, b in found], "label": labels}

    cells = map_docs(train, [text_col, F.col(label_col).cast("int").alias("label")], run, "x double, y double, label int")
    rows = cells.groupBy("x", "y", "label").count().collect()
    x = np.array([[1.0, r["x"], r["y"]] for r in rows])
    label, n = np.array([r["label"] for r in rows], float), np.array([r["count"] for r in rows], float)
    beta = np.zeros(3)
    ridge = np.diag([1e-3, 1e-2, 1e-2])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        grad = x.T @ (n * (label - p)) - ridge @ beta
        hess = (x * (n * p * (1 - p))[:, None]).T @ x + ridge
        step = np.linalg.solve(hess, grad)
        beta = beta + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    lexicon.fit_ = tuple(float(b) for b in beta)


def score(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, score, predicted) of every row."""

    def run(ids, texts):
        return {"doc_id": ids, "score": [lexicon.score(t) for t in texts]}

    found = map_docs(docs, [F.col(id_col).alias("doc_id"), text_col], run, "doc_id long, score double")
    return found.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
