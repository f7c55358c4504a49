"""Corpus-wide removal of frequent lines by a sharded minimal perfect hash.

A line's key is the line without ASCII white space at its ends, A-Z in lower case. Each document sends the 128-bit
hashes of its distinct keys; they are counted by document with partial sums. Hashes found in enough documents are dealt
to shards by their first bits, and a task builds a shard at a time: a minimal perfect hash of levels of bits (a hash
that falls on a slot alone takes it, the others go on to the next, smaller level), whose rank is the index into two
arrays, one of 64-bit fingerprints and one of counts. Documents probe these arrays: no line is joined, and no line
leaves its document. A hash that is in no shard meets a foreign fingerprint; shard, slot and fingerprint are taken from
128 bits, so that it is taken for another by chance alone (less than one in 2**64 for each line asked).

The arrays hold 13 bytes or so for each frequent line. Up to ``SENT_BYTES`` they go to every task. Beyond that shards
stay where they are: texts send their hashes to the shards in slices (``slices`` many for a shard that is asked more
than others, so a hot line is no single task), and the flagged lines alone come back to their texts.

Defined results: a null or empty text is one empty line, whose key is too short to be dropped unless ``shortest`` is 0;
each row is a document of its own, repeated rows and ids count as often as they come; a row with a null id is treated
like any other; a text of which all lines go becomes empty; an empty table gives an empty one. ``drop_frequent`` takes
no notice of further columns, ``cleaned`` keeps them all as they are, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import arrow_map, map_docs, parts, saved, slices

#: A line goes if its key is found in so many documents and has so many code points.
LEAST_DOCS, SHORTEST = 10, 1
#: Keys of a shard on average; its arrays, and what builds them, are held by one task.
SHARD_KEYS = 500_000
#: Bytes of all shards that are sent to every task.
SENT_BYTES = 48 << 20
#: Slots of a level for each key that comes to it, and levels before the few that are left are put in order.
SLOTS, LEVELS = 2, 24
#: Hashes that one slice of a shard is asked, where shards stay in place.
SLICE_HASHES = 2_000_000
_U = np.uint64


def _mixed(low: np.ndarray, level: int) -> np.ndarray:
    """Another 64 bits of a hash for each level."""
    x = low + _U((0x9E3779B97F4A7C15 * (level + 1)) & (2**64 - 1))
    x ^= x >> _U(31)
    x *= _U(0xBF58476D1CE4E5B9)
    return x ^ (x >> _U(29))


def _ranks(bits: np.ndarray) -> np.ndarray:
    """Ones before each byte of a bit array."""
    ones = np.bitwise_count(bits).astype(np.int64)
    return np.cumsum(ones) - ones


class Shard:
    """A minimal perfect hash over 64-bit numbers ``low``, with a fingerprint and a count at each index."""

    def __init__(self, levels: list[tuple[int, np.ndarray]], rest: np.ndarray, prints: np.ndarray, counts: np.ndarray):
        self.levels, self.rest, self.prints, self.counts = levels, rest, prints, counts
        self.starts, n = [], 0
        for _, bits in levels:
            ranks = _ranks(bits)
            self.starts.append((n, ranks))
            n += int(np.bitwise_count(bits).sum())
        self.placed = n

    @classmethod
    def built(cls, high: np.ndarray, low: np.ndarray, counts: np.ndarray) -> Shard:
        """``high`` and ``low`` are the halves of distinct hashes; those with an equal ``low`` are told apart by the rest."""
        levels, at = [], np.arange(len(low))
        order = []
        while len(at) and len(levels) < LEVELS:
            size = max(64, SLOTS * len(at))
            slots = (_mixed(low[at], len(levels)) % _U(size)).astype(np.int64)
            alone = np.bincount(slots, minlength=size) == 1
            taken = alone[slots]
            bits = np.packbits(alone, bitorder="little")
            levels.append((size, bits))
            mine = at[taken]
            order.append(mine[np.argsort(slots[taken])])
            at = at[~taken]
        left = at[np.lexsort((high[at], low[at]))]
        order = np.concatenate([*order, left]) if len(low) else left
        # what no level has placed, an equal ``low`` among them, is found by its order
        rest = np.stack([low[left], high[left]], axis=1)
        return cls(levels, rest, high[order], counts[order].astype(np.uint32))

    def index(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        """The index of each hash; for one that was not put in, any index, or -1."""
        out, open_ = np.full(len(low), -1, np.int64), np.arange(len(low))
        for k, ((size, bits), (first, ranks)) in enumerate(zip(self.levels, self.starts)):
            if not len(open_):
                return out
            slots = (_mixed(low[open_], k) % _U(size)).astype(np.int64)
            byte, bit = slots >> 3, slots & 7
            here = bits[byte]
            hit = (here >> bit.astype(np.uint8)) & 1 == 1
            before = np.bitwise_count(here & ((1 << bit) - 1).astype(np.uint8))
            out[open_[hit]] = first + ranks[byte[hit]] + before[hit]
            open_ = open_[~hit]
        for i in open_ if len(self.rest) else ():
            same = np.nonzero((self.rest[:, 0] == low[i]) & (self.rest[:, 1] == high[i]))[0]
            if len(same):
                out[i] = self.placed + same[0]
        return out

    def count(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        """Documents that have each hash; 0 for one that is not in the shard."""
        at = self.index(high, low)
        known = at >= 0
        known[known] = self.prints[at[known]] == high[known]
        return np.where(known, self.counts[np.where(known, at, 0)], 0) if len(self.counts) else np.zeros(len(low), np.uint32)

    def packed(self) -> bytes:
        head = np.array([len(self.levels), len(self.rest), len(self.counts), *(size for size, _ in self.levels)], "<i8")
        return b"".join([head.tobytes(), *(bits.tobytes() for _, bits in self.levels), self.rest.astype("<u8").tobytes(), self.prints.astype("<u8").tobytes(), self.counts.astype("<u4").tobytes()])

    @classmethod
    def unpacked(cls, data: bytes) -> Shard:
        n, rest, keys = np.frombuffer(data, "<i8", 3).tolist()
        sizes = np.frombuffer(data, "<i8", n, 24).tolist()
        at, levels = 24 + 8 * n, []
        for size in sizes:
            levels.append((size, np.frombuffer(data, np.uint8, -(-size // 8), at)))
            at += -(-size // 8)
        left = np.frombuffer(data, "<u8", 2 * rest, at).reshape(rest, 2)
        prints = np.frombuffer(data, "<u8", keys, at + 16 * rest)
        return cls(levels, left, prints, np.frombuffer(data, "<u4", keys, at + 16 * rest + 8 * keys))


def line_hashes(text: str | None, shortest: int = SHORTEST) -> list[int | None]:
    """The 128-bit hash of each line's key, None where the key is too short."""
    digest, out = xxhash.xxh3_128_intdigest, []
    for line in (text or "").encode("utf-8", "surrogatepass").lower().split(b"\n"):  # bytes: A-Z and ASCII white space alone
        key = line.strip()
        long = len(key) >= shortest and (len(key) >= 4 * shortest or len(key.decode("utf-8", "surrogatepass")) >= shortest)
        out.append(digest(key) if long else None)
    return out


def halves(hashes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The first and the last 64 bits of hashes."""
    return np.array([h >> 64 for h in hashes], _U), np.array([h & 0xFFFF_FFFF_FFFF_FFFF for h in hashes], _U)


def shard_of(low: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each hash, by the first 32 bits of its lower half."""
    return ((low >> _U(32)) * _U(shards) >> _U(32)).astype(np.int64)


def document_counts(docs: DataFrame, text_col: str = "text", shortest: int = SHORTEST) -> DataFrame:
    """(high, low, n): the documents that have each line key, as signed halves of its hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            found = [h for text in part.column(0).to_pylist() for h in {*line_hashes(text, shortest)} - {None}]
            hashes, counts = _tallied(*halves(found))
            yield pa.RecordBatch.from_arrays([pa.array(hashes[0].view(np.int64)), pa.array(hashes[1].view(np.int64)), pa.array(counts)], names=["high", "low", "n"])

    sent = arrow_map(docs.select(text_col), run, "high long, low long, n long")
    return sent.groupBy("high", "low").agg(F.sum("n").alias("n"))


def _tallied(high: np.ndarray, low: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray]:
    """Distinct hashes of a slice and how often they come, so that a hot line leaves a slice once."""
    if not len(high):
        return (high, low), np.empty(0, np.int64)
    order = np.lexsort((high, low))
    high, low = high[order], low[order]
    first = np.nonzero(np.concatenate(([True], (high[1:] != high[:-1]) | (low[1:] != low[:-1]))))[0]
    return (high[first], low[first]), np.diff(np.append(first, len(high)))


def index(docs: DataFrame, text_col: str = "text", least: int = LEAST_DOCS, shortest: int = SHORTEST, shard_keys: int = SHARD_KEYS) -> tuple[DataFrame, int]:
    """(shard, keys, data) of all lines found in ``least`` documents or more, and the number of shards.

    All distinct lines are counted; those below ``least`` stay out, so the arrays follow the frequent lines alone.
    """
    frequent = saved(document_counts(docs, text_col, shortest).where(F.col("n") >= least))
    shards = parts(frequent.count(), shard_keys)

    def number(batches):
        for batch in batches:
            low = batch.column("low").to_numpy().view(_U)
            yield pa.RecordBatch.from_arrays([pa.array(shard_of(low, shards).astype(np.int32)), *batch.columns], names=["shard", "high", "low", "n"])

    def build(batches):
        """Rows come shard by shard; one shard is held at a time."""
        now, held = None, []

        def done():
            high, low, n = (np.concatenate([b.column(c).to_numpy() for b in held]) for c in ("high", "low", "n"))
            data = Shard.built(high.view(_U), low.view(_U), np.minimum(n, 2**32 - 1)).packed()
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([len(n)], pa.int64()), pa.array([data], pa.binary())], names=["shard", "keys", "data"])

        for batch in batches:
            numbers = batch.column("shard").to_numpy()
            edges = np.concatenate(([0], np.nonzero(np.diff(numbers))[0] + 1, [len(numbers)])) if len(numbers) else []
            for a, b in zip(edges[:-1], edges[1:]):
                if held and numbers[a] != now:
                    yield done()
                    held = []
                now = int(numbers[a])
                held.append(batch.slice(a, b - a))
        if held:
            yield done()

    numbered = arrow_map(frequent, number, "shard int, high long, low long, n long")
    dealt = numbered.repartition(shards, "shard").sortWithinPartitions("shard")
    return saved(arrow_map(dealt, build, "shard int, keys long, data binary")), shards


class Probe:
    """All shards in one process, to ask many hashes at once."""

    def __init__(self, data: dict[int, bytes], shards: int):
        self.data, self.shards = {k: Shard.unpacked(v) for k, v in data.items()}, shards

    def counts(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        out, at = np.zeros(len(low), np.int64), shard_of(low, self.shards)
        for k in np.unique(at).tolist():
            if k in self.data:
                mine = at == k
                out[mine] = self.data[k].count(high[mine], low[mine])
        return out


def _flags(texts: list, shortest: int, least: int, counts: Callable) -> list[np.ndarray]:
    """For each text, whether each of its lines goes."""
    hashes = [line_hashes(t, shortest) for t in texts]
    asked = [[h is not None for h in each] for each in hashes]
    high, low = halves([h for each in hashes for h in each if h is not None])
    gone, out, at = counts(high, low) >= least, [], 0
    for each in asked:
        mask = np.array(each)
        n = int(mask.sum())
        flags = np.zeros(len(each), bool)
        flags[mask] = gone[at : at + n]
        out.append(flags)
        at += n
    return out


def _without(text: str | None, flags: np.ndarray) -> str | None:
    if not flags.any():
        return text
    return "\n".join(line for line, gone in zip((text or "").split("\n"), flags) if not gone)


def _routed(docs: DataFrame, text_col: str, shards: DataFrame, n_shards: int, least: int, shortest: int, slice_hashes: int) -> DataFrame:
    """(k, gone): the numbers of the lines that go, for each distinct text (by hash) that has one.

    Hashes go to their shard's slices, each of which gets the shard before them and streams.
    """

    def send(batches):
        for part in slices(batches):
            rows = {}
            for k1, k2, text in zip(*(c.to_pylist() for c in part.columns)):
                rows.setdefault((k1, k2), text)
            keys, hashes, numbers = [], [], []
            for key, text in rows.items():
                for i, h in enumerate(line_hashes(text, shortest)):
                    if h is not None:
                        keys.append(key), hashes.append(h), numbers.append(i)
            high, low = halves(hashes)
            yield pa.RecordBatch.from_arrays(
                [pa.array(shard_of(low, n_shards).astype(np.int32)), pa.array([a for a, _ in keys], pa.int64()), pa.array([b for _, b in keys], pa.int64()),
                 pa.array(numbers, pa.int32()), pa.array(high.view(np.int64)), pa.array(low.view(np.int64))], names=["shard", "k1", "k2", "line", "high", "low"])

    asked = saved(arrow_map(docs.select(*_text_key(text_col), text_col), send, "shard int, k1 long, k2 long, line int, high long, low long"))
    wide = asked.groupBy("shard").count().select("shard", F.ceil(F.col("count") / slice_hashes).cast("int").alias("wide"))
    wide = F.broadcast(saved(wide))  # a row a shard, of which there are MOST_PARTS at most
    kinds = "shard int, slice int, k1 long, k2 long, line int, high long, low long, data binary"
    questions = asked.join(wide, "shard").select("shard", F.pmod(F.xxhash64("k1", "k2", "line"), "wide").cast("int").alias("slice"), "k1", "k2", "line", "high", "low", F.lit(None).cast("binary").alias("data"))
    copies = shards.join(wide, "shard").select("shard", F.explode(F.sequence(F.lit(0), F.col("wide") - 1)).alias("slice"), "data")
    copies = copies.select("shard", "slice", *(F.lit(None).cast(t).alias(c) for c, t in (("k1", "long"), ("k2", "long"), ("line", "int"), ("high", "long"), ("low", "long"))), "data")

    def answer(batches):
        shard, now = None, None
        for batch in batches:
            where, data = batch.column("shard").to_numpy(), batch.column("data")
            heads = np.nonzero(data.is_valid().to_numpy(zero_copy_only=False))[0]
            edges = np.unique(np.concatenate(([0], heads, np.nonzero(np.diff(where))[0] + 1, [len(where)])))
            for a, b in zip(edges[:-1], edges[1:]):
                if data[int(a)].is_valid:
                    shard, now = Shard.unpacked(data[int(a)].as_py()), where[a]
                    a += 1
                rows = batch.slice(a, b - a)
                if shard is None or not rows.num_rows or where[a] != now:  # a shard without a frequent line
                    continue
                high, low = (rows.column(c).to_numpy(zero_copy_only=False).astype(np.int64).view(_U) for c in ("high", "low"))
                hit = pa.array(shard.count(high, low) >= least)
                yield rows.select(["k1", "k2", "line"]).filter(hit)

    dealt = questions.unionByName(copies).select(*(c.split()[0] for c in kinds.split(", ")))
    dealt = dealt.repartition(parts(asked.count(), slice_hashes), "shard", "slice").sortWithinPartitions("shard", "slice", F.col("data").isNull())
    found = arrow_map(dealt, answer, "k1 long, k2 long, line int")
    return saved(found.groupBy("k1", "k2").agg(F.collect_set("line").alias("_gone")))


def _text_key(text_col: str) -> list:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2")]


def probed(
    docs: DataFrame, shards: DataFrame, n_shards: int, run: Callable[[list, list[np.ndarray]], dict], columns: list[str], ddl: str | StructType, text_col: str = "text", least: int = LEAST_DOCS,
    shortest: int = SHORTEST, sent_bytes: int = SENT_BYTES, slice_hashes: int = SLICE_HASHES,
) -> DataFrame:
    """A row of ``run(columns, flags)`` for each document, ``flags`` being whether each line of its text goes."""
    size = shards.agg(F.coalesce(F.sum(F.octet_length("data")), F.lit(0))).first()[0]
    if size <= sent_bytes:
        sent = docs.sparkSession.sparkContext.broadcast(({r["shard"]: bytes(r["data"]) for r in shards.select("shard", "data").collect()}, n_shards))
        probes: dict = {}

        def flagged(texts, *rest):
            if not probes:
                probes[0] = Probe(*sent.value)
            return run([texts, *rest], _flags(texts, shortest, least, probes[0].counts))

        return map_docs(docs, [F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate((text_col, *columns))], flagged, ddl)
    gone = _routed(docs, text_col, shards, n_shards, least, shortest, slice_hashes)
    keyed = docs.select(F.col(text_col).alias("_t"), *(F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(columns)), *_text_key(text_col))
    met = keyed.join(gone, ["k1", "k2"], "left")

    def told(texts, numbers, *rest):
        flags = []
        for text, mine in zip(texts, numbers):
            each = np.zeros((text or "").count("\n") + 1, bool)
            each[mine or []] = True
            flags.append(each)
        return run([texts, *rest], flags)

    return map_docs(met, ["_t", "_gone", *(f"_c{i}" for i in range(len(columns)))], told, ddl)


def drop_frequent(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_DOCS, shortest: int = SHORTEST, **bounds: int) -> DataFrame:
    """(id, n_lines, n_dropped, kept) of every row: ``kept`` is the text without its frequent lines, null stays null."""
    shards, n = index(docs, text_col, least, shortest, bounds.pop("shard_keys", SHARD_KEYS))

    def run(columns, flags):
        texts, ids = columns
        return {id_col: ids, "n_lines": [len(f) for f in flags], "n_dropped": [int(f.sum()) for f in flags], "kept": [_without(t, f) for t, f in zip(texts, flags)]}

    ddl = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, n_lines long, n_dropped long, kept string"
    return probed(docs, shards, n, run, [id_col], ddl, text_col, least, shortest, **bounds)


def cleaned(docs: DataFrame, text_col: str = "text", least: int = LEAST_DOCS, shortest: int = SHORTEST, **bounds: int) -> DataFrame:
    """The same rows and columns, the text without its frequent lines."""
    shards, n = index(docs, text_col, least, shortest, bounds.pop("shard_keys", SHARD_KEYS))
    others = [c for c in docs.columns if c != text_col]

    def run(columns, flags):
        texts, *rest = columns
        return {text_col: [_without(t, f) for t, f in zip(texts, flags)]} | dict(zip(others, rest))

    return probed(docs, shards, n, run, others, docs.schema, text_col, least, shortest, **bounds)
