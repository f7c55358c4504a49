"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

A pattern is a window of 13 consecutive benchmark words (an item of 1 to 12 words is one window).
Words are the symbols: a block is two words, the shift table says how far the search may jump when
a block ends at the current word, a block with shift zero picks a bucket by suffix block, and every
candidate of the bucket is compared word by word.

A benchmark of up to ``PART_BYTES`` of text is compiled once a process: patterns are places in its text, not copies.

A larger one is searched in one pass too, whatever its size. The same blocks, hashed to 64 bits, have their shifts in one
sorted table (nine bytes for each different pair of words), and a bitmap of window hashes stands for the buckets. What these
do not rule out is a candidate: its hash and its words go to the pattern windows by a join, where the words themselves
are compared. Occurrences come back by a hash of the text, since a text's verdict is that of all its copies. Table and
bitmap are bounded: beyond ``MOST_BLOCKS`` the search goes on without skipping, beyond ``MOST_BITS`` more candidates are
joined, and results stay the same.

Defined results: null or empty text has no words (all counts 0, digest of the empty string);
repeated documents give one row each; repeated item ids count once; a null item_id is listed as
``null``; an empty benchmark hits nothing. Extra columns are ignored, and stay where rows are returned.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import arrow_map, map_docs, saved, schema_of, slices

WINDOW = 13
#: Benchmark text that is compiled in each worker, where it takes some ninety times as much: 3.5 MB took 323 MB.
PART_BYTES = 2 << 20
#: Pairs of words of nine bytes in the shift table that goes to every task, and bits of the bitmap of windows.
MOST_BLOCKS, MOST_BITS = 6_000_000, 1 << 29
#: Bits of the bitmap for each window.
BITS = 16
#: Compiled benchmarks that a worker holds.
HELD = 1

_FOLD = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(_FOLD).split() if text else []


def windows_of(words: list[bytes], window: int = WINDOW):
    if 0 < len(words) <= window:
        return [tuple(words)]
    return [tuple(words[i : i + window]) for i in range(len(words) - window + 1)]


class WuManber:
    """Search for patterns that all have ``length`` words, given as first places in ``text``."""

    def __init__(self, text: list[bytes], places: list[int], length: int):
        self.text, self.m = text, length
        self.block = min(2, length)
        self.jump = length - self.block + 1
        #: A block's shift, or the places of the patterns that it ends.
        self.table: dict = {}
        table, ends = self.table, defaultdict(list)
        for p in places:
            if self.block == 1:
                ends[text[p]].append(p)
                continue
            for k in range(1, length - 1):
                key = text[p + k - 1], text[p + k]
                if table.get(key, self.jump) > length - 1 - k:
                    table[key] = length - 1 - k
            ends[text[p + length - 2], text[p + length - 1]].append(p)
        for key, found in ends.items():
            # a block that ends many patterns picks by their first word too
            by_first = defaultdict(list)
            for p in found:
                by_first[text[p]].append(p)
            table[key] = {w: tuple(ps) for w, ps in by_first.items()} if len(by_first) > 4 else tuple(found)

    def search(self, words: list[bytes]):
        """Yield (start, place of the pattern) of every occurrence."""
        m, jump, get, text, n = self.m, self.jump, self.table.get, self.text, len(words)
        two, i = self.block == 2, self.m - 1
        while i < n:
            found = get((words[i - 1], words[i]) if two else words[i], jump)
            if type(found) is int:
                i += found
                continue
            start = i - m + 1
            if type(found) is dict:
                found = found.get(words[start], ())
            for p in found:
                if text[p] == words[start] and text[p : p + m] == words[start : i + 1]:
                    yield start, p
            i += 1


class Scanner:
    """Benchmark items compiled into one searcher for each window length; equal windows are one pattern."""

    def __init__(self, items: list[tuple], window: int = WINDOW):
        intern: dict[bytes, bytes] = {}
        text: list[bytes] = []
        by_length, self.items_of = defaultdict(list), {}
        known: dict[tuple, list[int]] = defaultdict(list)
        for item_id, item_text in items:
            name = "null" if item_id is None else str(item_id)
            words = [intern.setdefault(w, w) for w in words_of(item_text)]
            base, m = len(text), min(len(words), window)
            text += words
            for k in range(len(words) - m + 1 if words else 0):
                pattern = words[k : k + m]
                same = known[m, hash(tuple(pattern))]
                place = next((p for p in same if text[p : p + m] == pattern), None)
                if place is None:
                    place = base + k
                    same.append(place)
                    by_length[m].append(place)
                    self.items_of[place] = name
                elif isinstance(held := self.items_of[place], set):
                    held.add(name)
                elif held != name:
                    self.items_of[place] = {held, name}
        self.searchers = [WuManber(text, places, m) for m, places in sorted(by_length.items())]

    def scan(self, words: list[bytes]) -> tuple[bytearray | None, set]:
        """(a byte for each word, 1 where it is hit, or None; names of the items with occurring windows)."""
        hit, found = None, set()
        for s in self.searchers:
            seen = set()
            for start, p in s.search(words):
                hit = bytearray(len(words)) if hit is None else hit
                hit[start : start + s.m] = b"\1" * s.m
                seen.add(p)
            for p in seen:
                names = self.items_of[p]
                found |= {names} if isinstance(names, str) else names
        return hit, found


_BUILT: dict[str, Scanner] = {}


def _compiled(name: str, items: list[tuple], window: int) -> Scanner:
    """The searcher of a part, built once a process; HELD parts at once."""
    if name not in _BUILT:
        while len(_BUILT) >= HELD:
            _BUILT.pop(next(iter(_BUILT)))
        _BUILT[name] = Scanner(items, window)
    return _BUILT[name]


_KIND = "struct<n_words: long, n_hit: long, spans: array<int>, items: array<string>, contaminated: boolean>"


def _verdict(n: int, spans: list[int], items) -> dict:
    n_hit = sum(spans[1::2]) - sum(spans[::2])
    return {"n_words": n, "n_hit": n_hit, "spans": spans, "items": sorted(items), "contaminated": n_hit > 0 and 20 * n_hit >= n}


def _searched(
    rows: DataFrame, text_at: int, benchmark: DataFrame, item_col: str, item_text_col: str, window: int, part_bytes: int, texts: bool = True
) -> tuple[DataFrame, str]:
    """``rows``, without their texts if ``texts`` is false, with a last column of what is found, and its name.

    The column has n_words, n_hit, the spans of hit words (firsts and behind the lasts in turn), the sorted items
    and whether that is contamination.
    """
    spark, width, name = rows.sparkSession, len(rows.columns), "found"
    while name in rows.columns:
        name += "_"
    kept = [c for c in range(width) if texts or c != text_at]
    schema = StructType([*(rows.schema.fields[c] for c in kept), *schema_of(f"{name} {_KIND}").fields])
    arrow = to_arrow_schema(schema)
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).alias("text"))
    if (items.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0) > part_bytes:
        return _searched_by_hashes(rows, text_at, saved(_windows(items, window)), name, kept, schema), name
    sent = [tuple(r) for r in items.where("text is not null").collect()]  # part_bytes at most
    digest = hashlib.sha256(repr((window, sorted(map(repr, sent)))).encode()).hexdigest()
    shared = spark.sparkContext.broadcast(sent)

    def run(batches):
        for batch in slices(batches):
            scanner, out = _compiled(digest, shared.value, window), []
            for text in batch.column(text_at).to_pylist():
                words = words_of(text)
                hit, found = scanner.scan(words)
                out.append(_verdict(len(words), _spans(hit), found))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(out, arrow[len(kept)].type)], names=arrow.names)

    return arrow_map(rows, run, schema), name


def _hashes(words: list[bytes]) -> np.ndarray:
    digest = xxhash.xxh3_64_intdigest
    return np.array([digest(w) for w in words], np.uint64)


def _blocks(hashes: np.ndarray, m: int) -> np.ndarray:
    """The block that ends at each word, for patterns of ``m`` words: the word, or the pair with the one before."""
    if m > 1:
        hashes = np.concatenate([hashes[:1], hashes[1:] ^ (hashes[:-1] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x7F4A7C15))])
    return hashes + np.uint64(m * 0xD6E8FEB86659FD93 % 2**64)  # each length has blocks of its own


def _windows(items: DataFrame, window: int) -> DataFrame:
    """(item, m, words, hash, block, shift): each window of each item, and the block that ends at the same word with its shift.

    Blocks before the first window's end have a row of their own, without words.
    """

    def cut(names, texts):
        out: dict[str, list] = {c: [] for c in ("item", "m", "words", "hash", "block", "shift")}
        for name, text in zip(names, texts):
            words = words_of(text)
            m = min(len(words), window)
            if not m:
                continue
            blocks = _blocks(_hashes(words), m).view(np.int64).tolist()
            for j in range(min(1, m - 1), len(words)):
                whole = j >= m - 1
                pattern = b" ".join(words[j - m + 1 : j + 1]) if whole else None
                row = "null" if name is None else name, m, pattern, xxhash.xxh3_64_intdigest(pattern) - 2**63 if whole else None, blocks[j], max(0, m - 1 - j)
                for c, v in zip(out, row):
                    out[c].append(v)
        return out

    return map_docs(items, ["item", "text"], cut, "item string, m int, words binary, hash long, block long, shift int")


class Skipper:
    """The shift table of all blocks and the bitmap of all windows, of any number of patterns."""

    def __init__(self, lengths: list[int], blocks: np.ndarray | None, shifts: np.ndarray | None, bitmap: np.ndarray):
        self.lengths, self.blocks, self.shifts, self.bitmap = lengths, blocks, shifts, bitmap
        self.bits = np.uint64(8 * len(bitmap))

    def candidates(self, words: list[bytes]):
        """Yield (start, pattern length, window hash, words) of what neither rules out."""
        n, hashes = len(words), _hashes(words)
        joined, size = b" ".join(words), np.fromiter(map(len, words), np.int64, n)
        stops = np.cumsum(size + 1) - 1
        starts = stops - size
        for m in self.lengths:
            if m > n:
                break
            ends = self._ends(_blocks(hashes, m), m)
            found = [(i - m + 1, xxhash.xxh3_64_intdigest(joined[starts[i - m + 1] : stops[i]])) for i in ends]
            at = np.array([h for _, h in found], np.uint64) % self.bits
            known = self.bitmap[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1
            for (start, h), ok in zip(found, known.tolist()):
                if ok:
                    yield start, m, h - 2**63, joined[starts[start] : stops[start + m - 1]]

    def _ends(self, blocks: np.ndarray, m: int) -> list[int]:
        """Last words of windows that the shifts do not skip."""
        n = len(blocks)
        if self.blocks is None:
            return list(range(m - 1, n))
        at = np.minimum(np.searchsorted(self.blocks, blocks), len(self.blocks) - 1)
        jump = m - min(2, m) + 1
        shift = np.where(self.blocks[at] == blocks, self.shifts[at], jump).tolist()
        out, i = [], m - 1
        while i < n:
            if shift[i]:
                i += shift[i]
            else:
                out.append(i)
                i += 1
        return out


def _skipper(windows: DataFrame) -> Skipper:
    """Table and bitmap of written windows; the driver holds MOST_BLOCKS pairs and MOST_BITS bits at most."""
    lengths = sorted(r.m for r in windows.select("m").distinct().collect())
    shifts = saved(windows.groupBy("block").agg(F.min("shift").cast("byte").alias("shift")))
    blocks = steps = None
    if shifts.count() <= MOST_BLOCKS:
        table = shifts.toArrow()
        blocks, steps = table.column("block").to_numpy().view(np.uint64), table.column("shift").to_numpy()
        order = np.argsort(blocks)
        blocks, steps = blocks[order], steps[order]
    whole = windows.where("words is not null")
    bits = 1 << 15
    while bits < min(BITS * whole.count(), MOST_BITS):
        bits *= 2
    # the hash is stored less 2**63, and bits divides 2**63, so the remainder is that of the hash itself
    place = F.pmod(F.col("hash"), F.lit(bits))
    rows = whole.groupBy(F.floor(place / 32_768).alias("part")).agg(F.bitmap_construct_agg(F.pmod(place, F.lit(32_768))).alias("bits")).collect()
    bitmap = np.zeros(bits // 8, np.uint8)
    for r in rows:
        bitmap[r["part"] * 4096 : (r["part"] + 1) * 4096] = np.frombuffer(r["bits"], np.uint8)
    return Skipper(lengths, blocks, steps, bitmap)


def _searched_by_hashes(rows: DataFrame, text_at: int, windows: DataFrame, name: str, kept: list[int], schema: StructType) -> DataFrame:
    """``_searched`` of a benchmark of any size: one pass for candidates, a join that compares words, one more for verdicts."""
    spark, text = rows.sparkSession, F.col(f"`{rows.columns[text_at]}`")
    shared = spark.sparkContext.broadcast(_skipper(windows))
    keys = [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2")]

    def look(k1s, k2s, texts):
        out: dict[str, list] = {c: [] for c in ("k1", "k2", "start", "m", "hash", "words")}
        for (k1, k2), body in {(a, b): t for a, b, t in zip(k1s, k2s, texts)}.items():
            for row in shared.value.candidates(words_of(body)):
                for c, v in zip(out, (k1, k2, *row)):
                    out[c].append(v)
        return out

    asked = map_docs(rows.where(text.isNotNull()), [*keys, text.alias("t")], look, "k1 long, k2 long, start int, m int, hash long, words binary")
    patterns = windows.where("words is not null").select("hash", F.col("words").alias("same"), "item").distinct()
    met = saved(asked).join(saved(patterns), "hash").where("words = same")
    arrow, width = to_arrow_schema(schema), len(rows.columns)
    one, two, own = "k1", "k2", "hits"
    while {one, two, own} & set(rows.columns):
        one, two, own = one + "_", two + "_", own + "_"
    held = F.struct(F.collect_set(F.struct("start", "m")).alias("hits"), F.collect_set("item").alias("items"))
    # written, so that the join has two shuffles of its own and copies of one text can be split
    found = saved(met.groupBy(F.col("k1").alias(one), F.col("k2").alias(two)).agg(held.alias(own)))
    told = rows.select("*", keys[0].alias(one), keys[1].alias(two)).join(found, [one, two], "left").drop(one, two)

    def judge(batches):
        for batch in slices(batches):
            out = []
            for body, held in zip(batch.column(text_at).to_pylist(), batch.column(width).to_pylist()):
                n, hit = len(words_of(body)), None
                for h in held["hits"] if held else ():
                    hit = bytearray(n) if hit is None else hit
                    hit[h["start"] : h["start"] + h["m"]] = b"\1" * h["m"]
                out.append(_verdict(n, _spans(hit), held["items"] if held else ()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(out, arrow[len(kept)].type)], names=arrow.names)

    return arrow_map(told, judge, schema)


def _spans(hit: bytearray | None) -> list[int]:
    """Starts and ends of the runs of hit words."""
    if hit is None:
        return []
    edges = np.flatnonzero(np.diff(np.frombuffer(bytes(1) + bytes(hit) + bytes(1), np.int8)))
    return edges.tolist()


def scan_documents(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    part_bytes: int = PART_BYTES,
) -> DataFrame:
    """Per document: words, hit words, the items hit (sorted array) and the contamination verdict."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    out, found = _searched(rows, 1, benchmark, item_col, item_text_col, window, part_bytes, texts=False)
    return out.select("doc_id", *(f"{found}.{c}" for c in ("n_words", "n_hit", "items", "contaminated")))


def drop_contaminated(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    window: int = WINDOW, part_bytes: int = PART_BYTES,
) -> DataFrame:
    """Rows that the benchmark does not contaminate, each judged by its own text, all columns kept."""
    out, found = _searched(docs, docs.columns.index(text_col), benchmark, item_col, item_text_col, window, part_bytes)
    return out.where(~F.col(f"{found}.contaminated")).select(docs.columns)
