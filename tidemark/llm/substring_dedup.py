"""Substring dedup by content-defined chunking with a gear rolling hash.

Words of a text are joined by single spaces. A gear hash rolls over the bytes; its value after a word
depends on the last 16 bytes alone. A cut is made before every word whose hash is the smallest among
itself and ``REACH`` words on either side (a local minimum), so cuts depend on nearby content only and
come back into step right after an insertion. From every cut a chunk runs to the first cut that is at least
``MIN_WORDS`` words further; chunks are variable and overlap, so that a passage of over 50 words holds a
whole one wherever its edges fall. Chunks are deduplicated by a 128-bit digest of their words.

Chunks that other documents hold too are merged into stretches, those with the same first holder by
themselves. Chunks end inside what is shared, so the edges are found by comparison of windows of ``SPAN``
words that overlap the first or the last words of a stretch, or in the first holder any part of it; of
NEIGHBOURS windows in a row the one of least digest is kept. Windows that another document holds widen a
stretch, and a stretch without one is no repeat. So a run of 51 words or more that two documents share is found,
if it holds a whole chunk, and none of less than 45. Each span has the smallest doc_id that holds one of its
parts, which keeps its copy; the others may drop theirs.

A document is an id with a text: rows with the same id and other texts are other documents, rows with equal
id and text are one. Where the smallest id that holds something has several texts with it, all of them keep
their copy if other ids hold it too, else the one whose text hashes lowest.

Words are runs without white space, that of other scripts included. In scripts that put no spaces between words (Chinese,
Japanese, Thai, Lao, Khmer, Burmese) each character counts as a word, and a run of more than LONG_WORD bytes is cut into
words where its own gear hash says, some 16 bytes each, so that text without any white space is compared as well.

Defined results: null or empty text has no spans; repeats inside one document alone are not reported; rows
with a null id are not compared. Extra columns are ignored, and stay where rows are returned.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .common import SLICE_ROWS, arrow_map, saved, schema_of, slices

MIN_WORDS = 12
REACH = 4
#: Words of a window, which is the shortest span; of NEIGHBOURS windows in a row the least digest is kept, so
#: every run of SPAN + NEIGHBOURS - 1 = 51 words has a kept window, and the same one wherever it stands.
SPAN, NEIGHBOURS = 45, 7
#: Stretches, of some 30 bytes, that are broadcast at most to the texts; more are joined by a shuffle.
SENT_STRETCHES = 1_000_000
#: Digests of 40 bytes that are broadcast at most; more are joined by a shuffle.
SENT_DIGESTS = 20_000
WINDOW = 16
#: Bytes of a run above which it is cut into words by its content, and the mask of the hash that cuts it.
LONG_WORD, LONG_MASK = 200, 15
# White space beyond ASCII, and the letters of scripts that are written without it.
_SPACES = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_UNSPACED = "\u0e01-\u0eff\u1000-\u109f\u1780-\u17ff\u3005-\u3007\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
_OTHER = re.compile(f"[{_UNSPACED}{_SPACES[4:]}]")
_WORD = re.compile(f"[{_UNSPACED}]|[^{_UNSPACED}{_SPACES}]+")
_GEAR_SEED = 20_240_607

CHUNKS = "doc_id long, t long, start int, stop int, d1 long, d2 long"


def _gear() -> np.ndarray:
    """A random number for each byte."""
    return np.random.default_rng(_GEAR_SEED).integers(0, 1 << 32, 256, dtype=np.uint64).astype(np.uint32)


_GEAR = _gear()


def gear_hash(data: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """h(i) = sum of gear[byte i-k] << k over the window, by doubling it; early bytes have what there is."""
    h, width = _GEAR[data], 1
    while width < window:
        shifted = np.zeros_like(h)
        shifted[width:] = h[:-width] << np.uint32(width)
        h = h + shifted
        width *= 2
    return h


def cuts(hashes: np.ndarray, reach: int = REACH) -> np.ndarray:
    """Positions whose hash is not above any within reach, so that runs of few different words are cut too."""
    n = len(hashes)
    ok = np.ones(n, bool)
    for k in range(1, reach + 1):
        ok[k:] &= hashes[k:] <= hashes[:-k]
        ok[:-k] &= hashes[:-k] <= hashes[k:]
    ok[:reach] = False  # what stands before decides, so nothing near the edges is cut
    ok[n - reach :] = False
    return np.nonzero(ok)[0]


def _cut_long(word: bytes) -> list[bytes]:
    """A long run cut behind bytes whose hash ends in zeros, between characters: where depends on the 16 bytes before."""
    data = np.frombuffer(word, np.uint8)
    last = (gear_hash(data) & np.uint32(LONG_MASK)) == 0
    last[:-1] &= (data[1:] & 0xC0) != 0x80
    last[-1] = True
    stops = (np.nonzero(last)[0] + 1).tolist()
    return [word[a:b] for a, b in zip([0, *stops], stops)]


def words_of(text: str | None) -> tuple[list[bytes], list[bool] | None]:
    """The words of a text, and whether each follows the one before without white space; None if none does."""
    if not text:
        return [], None
    if text.isascii() or not _OTHER.search(text):
        words, glued = text.encode().split(), None
    else:
        found = list(_WORD.finditer(text))
        words, ends = [m[0].encode() for m in found], [-1, *(m.end() for m in found)]
        glued = [m.start() == e for m, e in zip(found, ends)]
    if words and max(map(len, words)) > LONG_WORD:
        out, more = [], []
        for k, word in enumerate(words):
            parts = _cut_long(word) if len(word) > LONG_WORD else [word]
            out += parts
            more += [bool(glued and glued[k])] + [True] * (len(parts) - 1)
        words, glued = out, more
    return words, glued


def _laid(text: str | None) -> tuple[bytes, np.ndarray, np.ndarray]:
    """Words joined by single spaces, and where each begins and ends."""
    words, _ = words_of(text)
    size = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1) - 1
    return b" ".join(words), ends - size, ends


def _digests(joined: bytes, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    digest = xxhash.xxh3_128_digest
    found = b"".join(digest(joined[a:b]) for a, b in zip(starts[first].tolist(), ends[last - 1].tolist()))
    return np.frombuffer(found, "<i8").reshape(-1, 2)


def chunks(text: str | None, min_words: int = MIN_WORDS, reach: int = REACH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, word behind the last, 16-byte digests) of the chunks of a text; its edges are cuts too."""
    joined, starts, ends = _laid(text)
    n = len(starts)
    if n < min_words:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros((0, 2), np.int64)
    # the hash before a word is that of the bytes up to the space in front of it
    inner = cuts(gear_hash(np.frombuffer(joined, np.uint8))[starts[1:] - 1], reach) + 1
    at = np.concatenate([[0], inner, [n]])
    to = np.searchsorted(at, at + min_words)
    first, last = at[to < len(at)], at[to[to < len(at)]]
    return first, last, _digests(joined, starts, ends, first, last)


def least_of(digests: np.ndarray, neighbours: int = NEIGHBOURS) -> np.ndarray:
    """Places that are the least of some ``neighbours`` in a row, all of them where they tie; of fewer the least."""
    n = len(digests) - neighbours + 1
    if n < 1:
        return np.nonzero(digests == digests.min())[0] if len(digests) else np.zeros(0, np.int64)
    least = np.lib.stride_tricks.sliding_window_view(digests, neighbours).min(axis=1)
    ok = np.zeros(len(digests), bool)
    for k in range(neighbours):
        ok[k : k + n] |= digests[k : k + n] == least
    return np.nonzero(ok)[0]


def windows(text: str | None, stretches: list[tuple[int, int, bool]], min_words: int = MIN_WORDS, span: int = SPAN):
    """(first word, word behind the last, digests) of kept windows of ``span`` words: of a stretch (first word,
    word behind the last, whether all) those that overlap its first or last ``min_words`` words, or any."""
    joined, starts, ends = _laid(text)
    n, ranges = len(starts), []
    for a, b, every in stretches:
        for x, y in ((a, b),) if every or b - a < span else ((a, a + min_words), (b - min_words, b)):
            ranges.append((max(0, x + 1 - span), min(y - 1, n - span) + 1))
    runs: list[list[int]] = []
    for x, y in sorted(r for r in ranges if r[0] < r[1]):
        if runs and x <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], y)
        else:
            runs.append([x, y])
    digest = xxhash.xxh3_64_intdigest  # within what is shared already, so half the bytes are enough
    first, found = [], []
    for x, y in runs:
        d = np.array([digest(joined[a:b]) for a, b in zip(starts[x:y].tolist(), ends[x + span - 1 : y + span - 1].tolist())], np.uint64)
        kept = least_of(d)
        first.append(kept + x)
        found.append(d[kept])
    first, half = (np.concatenate(v) if v else np.zeros(0, t) for v, t in ((first, np.int64), (found, np.uint64)))
    half = half.view(np.int64)
    return first, first + span, np.stack([half, np.zeros_like(half)], axis=1)


def _digested(rows: DataFrame, find) -> DataFrame:
    """CHUNKS of (doc_id, t, text, ...) rows; ``find`` gets the text and what else there is."""
    schema = schema_of(CHUNKS)
    arrow = to_arrow_schema(schema)

    def run(batches):
        for part in slices(batches, SLICE_ROWS):
            names, out = [], []
            for doc_id, t, *rest in zip(*(c.to_pylist() for c in part.columns)):
                found = find(*rest)
                if len(found[0]):
                    names.append(np.broadcast_to(np.array([[doc_id], [t]], np.int64), (2, len(found[0]))))
                    out.append(found)
            if out:
                ids, texts = np.concatenate(names, axis=1)
                first, last, digests = (np.concatenate(x) for x in zip(*out))
                cols = [ids, texts, first.astype(np.int32), last.astype(np.int32), *np.ascontiguousarray(digests.T)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], schema=arrow)

    return arrow_map(rows, run, schema)


def _named(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("t"), F.col(text_col).alias("text"))
    return rows.where("doc_id is not null and text is not null")


def chunk_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, reach: int = REACH) -> DataFrame:
    """(doc_id, t, start, stop, d1, d2) of every chunk of every document with an id; words are counted from 0.

    ``t`` is a hash of the whole text, which tells apart the documents of one id.
    """
    return _digested(_named(docs, id_col, text_col), lambda text: chunks(text, min_words, reach))


def _pieces(rows: DataFrame, whole: bool) -> DataFrame:
    """(doc_id, t, start, stop, first_doc, keep, partner, whole) of the rows whose digest another document has too."""
    # written, so that the join below has two shuffles of its own and can split a hot digest
    shared = saved(
        rows.groupBy("d1", "d2").agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last"), F.min("t").alias("least"), F.max("t").alias("most"))
        .where("first_doc < last or least < most")
        .select("d1", "d2", "first_doc", F.when(F.col("first_doc") == F.col("last"), F.col("least")).alias("only"))
    )
    if shared.count() <= SENT_DIGESTS:
        shared = F.broadcast(shared)
    keep = (F.col("doc_id") == F.col("first_doc")) & F.coalesce(F.col("t") == F.col("only"), F.lit(True))
    return rows.join(shared, ["d1", "d2"]).select(
        "doc_id", "t", "start", "stop", "first_doc", keep.alias("keep"), F.when(~keep, F.col("first_doc")).alias("partner"), F.lit(whole).alias("whole")
    )


def _merged(pieces: DataFrame, *of: str) -> DataFrame:
    """Pieces of a document that touch become one, those of each kind and of each value of ``of`` by themselves."""
    w = W.partitionBy("doc_id", "t", "keep", *of).orderBy("start", "stop")
    apart = F.col("start") > F.coalesce(F.max("stop").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(-1))
    islands = pieces.withColumn("apart", apart.cast("int")).withColumn("island", F.sum("apart").over(w))
    return islands.groupBy("doc_id", "t", "keep", *of, "island").agg(
        F.min("start").alias("start"), F.max("stop").alias("stop"), F.min("first_doc").alias("first_doc"), F.max("whole").alias("whole")
    ).drop("island", *of)


def _widened(docs: DataFrame, stretches: DataFrame, min_words: int, span: int) -> DataFrame:
    """CHUNKS of the windows around the ends of each document's stretches; texts are shuffled only if many have some."""
    ends = saved(stretches.groupBy("doc_id", "t").agg(F.collect_set(F.struct("start", "stop", "keep")).alias("ends")))
    rows = docs.join(F.broadcast(ends) if stretches.count() <= SENT_STRETCHES else ends, ["doc_id", "t"])
    return _digested(rows, lambda text, ends: windows(text, [(e["start"], e["stop"], e["keep"]) for e in ends], min_words, span))


def repeated_spans(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, reach: int = REACH, span: int = SPAN
) -> DataFrame:
    """(doc_id, t, start, stop, n_words, first_doc, keep): spans that other documents hold too.

    ``keep`` is true where the document is the first holder of every part of the span.
    """
    rows = _named(docs, id_col, text_col)
    stretches = saved(_merged(_pieces(chunk_table(docs, id_col, text_col, min_words, reach), False), "partner"))
    around = saved(_widened(rows, stretches, min_words, span))
    certain = stretches.where(F.col("stop") - F.col("start") >= span)
    # a stretch may hold the parts of what its partner has in another order, each of them too short: it needs a whole window
    spans = _merged(certain.unionByName(_pieces(around, True).drop("partner"))).where("whole")
    # windows are made near the ends of stretches alone, so one may seem first-held inside what an earlier document has
    w = W.partitionBy("doc_id", "t").orderBy("start", "keep").rowsBetween(W.unboundedPreceding, 0)
    held = F.max(F.when(~F.col("keep"), F.col("stop"))).over(w)
    spans = spans.withColumn("held", held).where(~F.col("keep") | F.col("held").isNull() | (F.col("held") < F.col("stop")))
    return spans.select("doc_id", "t", "start", "stop", (F.col("stop") - F.col("start")).cast("long").alias("n_words"), "first_doc", "keep")


def _joined(words: list[bytes], glued: list[bool] | None, keep: np.ndarray) -> bytes:
    """Words that stay, with single spaces where there was white space between them or a cut."""
    if glued is None:
        return b" ".join(w for w, k in zip(words, keep) if k)
    parts, before = [], -2
    for k in np.nonzero(keep)[0].tolist():
        parts += [words[k]] if not parts or glued[k] and before == k - 1 else [b" ", words[k]]
        before = k
    return b"".join(parts)


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Documents with the spans cut that an earlier document holds; all columns kept.

    Cut texts have single spaces between words; a text without such a span is untouched, as is a row without id.
    """
    spans = repeated_spans(docs, id_col, text_col, **options).where("not keep")
    cut = saved(spans.groupBy("doc_id", "t").agg(F.collect_set(F.struct("start", "stop")).alias("spans")))
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("t"))
    few = (cut.agg(F.sum(F.size("spans"))).first()[0] or 0) <= SENT_STRETCHES
    joined = rows.join(F.broadcast(cut) if few else cut, ["doc_id", "t"], "left").select("row.*", F.col("spans").alias("_"))
    at = docs.columns.index(text_col)
    arrow = to_arrow_schema(docs.schema)

    def run(batches):
        for part in slices(batches):
            cols, out = list(part.columns), []
            for text, spans_ in zip(cols[at].to_pylist(), cols[-1].to_pylist()):
                if spans_:
                    words, glued = words_of(text)
                    keep = np.ones(len(words), bool)
                    for s in spans_:
                        keep[s["start"] : s["stop"]] = False
                    text = _joined(words, glued, keep).decode()
                out.append(text)
            cols[at] = pa.array(out, cols[at].type)
            yield pa.RecordBatch.from_arrays(cols[:-1], names=arrow.names)

    return arrow_map(joined, run, docs.schema)
