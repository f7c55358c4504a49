"""Token ids in wavelet matrices: one compressed, searchable file for each shard.

A shard holds the ids of a range of documents in ascending doc_id order. Its payload is a header, the
documents' ids and lengths, and for each bit of the alphabet (highest first) a plane of bits with a
rank directory. Access, counting and finding occurrences work on the planes alone; no id array is
rebuilt for them. Payloads are rows of a Parquet table, one row a shard, so they can live in any
store that Spark writes to and be read back from wherever they lie.

Payload, little-endian: magic ``WVM2``; counts of tokens, documents and planes (three uint64); length of
the compressed part (uint64); zstd of (doc ids int64, id-is-null uint8, lengths uint32, planes as packed
bits, highest first, then for each plane its rank directory: uint32 ones before each 512 bits and in all).

Ids are those of the tokenizer as its file has it: the text of a special token is that token.

Defined results: null or empty text has the end id alone; rows come in ascending doc_id order, null ids
first, repeated ids in the order of their texts. Extra columns are ignored.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .common import SLICE_ROWS, arrow_map, parts, saved, schema_of, slices

MAGIC = b"WVM2"
_HEAD = struct.Struct("<4sQQQQ")
_BLOCK = 512
#: Text bytes after which a shard is closed, and that a task's range is meant to hold.
SHARD_BYTES = 2 << 20
PART_BYTES = 16 << 20
#: Shards, of 16 bytes, whose starts are broadcast at most; more are joined by a shuffle.
SENT_SHARDS = 500_000
#: Words whose ids a worker remembers, and the bytes of one at most; beyond them the memo starts afresh, and
#: longer words are not remembered. Words are 7 bytes on average, so a memo has some 300 MB at most.
MEMO_WORDS, MEMO_WORD = 1_500_000, 64


class WaveletMatrix:
    def __init__(self, planes: list[np.ndarray], n: int, ranks: list[np.ndarray] | None = None):
        """``planes``: packed bits of each level, highest bit first; ``ranks``: their directories, counted if not given."""
        self.n, self.planes = n, planes
        self.bits = len(planes)
        self.ranks = [self.directory(p) for p in planes] if ranks is None else ranks
        self.zeros = [n - int(r[-1]) for r in self.ranks]

    @staticmethod
    def directory(plane: np.ndarray) -> np.ndarray:
        """Ones before each block of a plane, and at last in all."""
        ones = np.bitwise_count(plane)
        padded = np.zeros(-(-len(ones) // (_BLOCK // 8)) * (_BLOCK // 8), np.uint8)
        padded[: len(ones)] = ones
        return np.append(0, np.cumsum(padded.reshape(-1, _BLOCK // 8).sum(axis=1, dtype=np.int64)))

    @classmethod
    def build(cls, ids: np.ndarray, bits: int | None = None) -> WaveletMatrix:
        bits = bits or max(1, int(ids.max()).bit_length() if len(ids) else 1)
        planes, now = [], ids
        for b in range(bits - 1, -1, -1):
            one = (now & now.dtype.type(1 << b)) != 0
            planes.append(np.packbits(one, bitorder="little"))
            now = np.concatenate([now[np.flatnonzero(~one)], now[np.flatnonzero(one)]])
        return cls(planes, len(ids))

    def _bit(self, level: int, i: int) -> int:
        return int(self.planes[level][i >> 3]) >> (i & 7) & 1

    def rank1(self, level: int, i: int) -> int:
        """Ones among the first ``i`` bits of a plane."""
        block = i // _BLOCK
        first, last = block * (_BLOCK // 8), i >> 3
        n = int(self.ranks[level][block]) + int(np.bitwise_count(self.planes[level][first:last]).sum())
        return n + (int(self.planes[level][last]) & ((1 << (i & 7)) - 1)).bit_count() if i & 7 else n

    def _select(self, level: int, bit: int, k: int) -> int:
        """Position of the k-th (from 0) bit of that value, by search over the rank directory."""
        counts = self.ranks[level] if bit else np.minimum(np.arange(len(self.ranks[level])) * _BLOCK, self.n) - self.ranks[level]
        block = int(np.searchsorted(counts, k, side="right")) - 1
        low = block * (_BLOCK // 8)
        part = np.unpackbits(self.planes[level][low : low + _BLOCK // 8], bitorder="little")[: self.n - block * _BLOCK]
        return block * _BLOCK + int(np.nonzero(part == bit)[0][k - int(counts[block])])

    def access(self, i: int) -> int:
        value = 0
        for level in range(self.bits):
            bit = self._bit(level, i)
            ones = self.rank1(level, i)
            i = self.zeros[level] + ones if bit else i - ones
            value = value << 1 | bit
        return value

    def _range(self, value: int, low: int, high: int) -> tuple[int, int]:
        for level in range(self.bits):
            a, b = self.rank1(level, low), self.rank1(level, high)
            if value >> (self.bits - 1 - level) & 1:
                low, high = self.zeros[level] + a, self.zeros[level] + b
            else:
                low, high = low - a, high - b
        return low, high

    def count(self, value: int, low: int = 0, high: int | None = None) -> int:
        """Occurrences of a value among positions [low, high)."""
        if value >> self.bits:
            return 0
        a, b = self._range(value, low, self.n if high is None else high)
        return b - a

    def find(self, value: int, k: int) -> int:
        """Position of the k-th (from 0) occurrence of a value."""
        if value >> self.bits:
            raise IndexError(k)
        a, b = self._range(value, 0, self.n)
        if not 0 <= k < b - a:
            raise IndexError(k)
        i = a + k
        for level in range(self.bits - 1, -1, -1):
            bit = value >> (self.bits - 1 - level) & 1
            i = self._select(level, 1, i - self.zeros[level]) if bit else self._select(level, 0, i)
        return i

    def find_all(self, value: int) -> np.ndarray:
        """Positions of all occurrences of a value, ascending: each level is gone up for all of them at once."""
        if value >> self.bits:
            return np.zeros(0, np.int64)
        at = np.arange(*self._range(value, 0, self.n), dtype=np.int64)
        for level in range(self.bits - 1, -1, -1):
            bit = value >> (self.bits - 1 - level) & 1
            at = self._select_all(level, bit, at - self.zeros[level] if bit else at)
        return np.sort(at)

    def _select_all(self, level: int, bit: int, ks: np.ndarray) -> np.ndarray:
        plane, ranks = self.planes[level], self.ranks[level]
        if len(ks) * _BLOCK > self.n:  # so many that the whole plane is read but once
            return np.flatnonzero(np.unpackbits(plane, count=self.n, bitorder="little") == bit)[ks]
        counts = ranks if bit else np.minimum(np.arange(len(ranks)) * _BLOCK, self.n) - ranks
        block = np.searchsorted(counts, ks, side="right") - 1
        width = _BLOCK // 8
        cells = np.pad(plane, (0, width))[(block * width)[:, None] + np.arange(width)]
        same = np.unpackbits(cells, axis=1, bitorder="little") == bit
        order = np.cumsum(same, axis=1, dtype=np.int32) == (ks - counts[block] + 1)[:, None]
        return block * _BLOCK + (order & same).argmax(axis=1)

    def decode(self) -> np.ndarray:
        """All values in order: each level's partition is undone, the lowest first."""
        value = np.zeros(self.n, np.uint16 if self.bits <= 16 else np.uint32)
        for level in range(self.bits - 1, -1, -1):
            one = np.unpackbits(self.planes[level], count=self.n, bitorder="little").view(bool)
            zeros = self.zeros[level]
            value[zeros:] |= value.dtype.type(1 << (self.bits - 1 - level))
            before = np.empty_like(value)
            before[np.flatnonzero(~one)] = value[:zeros]
            before[np.flatnonzero(one)] = value[zeros:]
            value = before
        return value


def pack(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray) -> bytes:
    matrix = WaveletMatrix.build(ids)
    body = zstandard.ZstdCompressor(level=1).compress(
        b"".join(
            [np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes(), np.array([d is None for d in doc_ids], np.uint8).tobytes(),
             lengths.astype("<u4").tobytes(), *(p.tobytes() for p in matrix.planes), *(r.astype("<u4").tobytes() for r in matrix.ranks)]
        )
    )
    return _HEAD.pack(MAGIC, len(ids), len(doc_ids), matrix.bits, len(body)) + body


def unpack(payload: bytes) -> tuple[list[int | None], np.ndarray, WaveletMatrix]:
    """(doc ids, lengths, matrix) of a shard."""
    magic, n, docs, bits, size = _HEAD.unpack_from(payload)
    if magic != MAGIC:
        raise ValueError("not a shard payload")
    body = zstandard.ZstdDecompressor().decompress(payload[_HEAD.size : _HEAD.size + size])
    ids = np.frombuffer(body, "<i8", docs)
    null = np.frombuffer(body, np.uint8, docs, 8 * docs)
    lengths = np.frombuffer(body, "<u4", docs, 9 * docs)
    at, width = 13 * docs, -(-n // 8)
    planes = [np.frombuffer(body, np.uint8, width, at + k * width) for k in range(bits)]
    at, entries = at + bits * width, -(-width // (_BLOCK // 8)) + 1
    ranks = [np.frombuffer(body, "<u4", entries, at + 4 * entries * k).astype(np.int64) for k in range(bits)]
    return [None if x else int(d) for d, x in zip(ids, null)], lengths, WaveletMatrix(planes, n, ranks)


#: Words that the tokenizer's normaliser and splitter leave as they are but for case, and marks behind
#: them that its splitter cuts off.
_SIMPLE = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([-.,;:!?|#$%&*()]*)")


class WordEncoder(dict):
    """The library's encoding of a text, word by word with a bounded memo: a dict of words' ids.

    The tokenizer drops white space and never joins across it, so a text's ids are those of its parts
    between ASCII white space in turn; and its splitter cuts letters from the marks behind them, so a
    word's ids are those of its letters and of its marks. Latin letters alone go straight to the library's
    model, in the byte symbols that its steps before the model would make of them.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.library = Tokenizer.from_file(path)
        self.tokenize = self.library.model.tokenize
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.symbols = {c: level.pre_tokenize_str(chr(c))[0][0] for c in range(0xDF, 0x100)}
        self.tails: dict[str, bytes] = {}

    def encode_texts(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        if len(self) > MEMO_WORDS:
            self.clear()
        get = self.__getitem__
        return [b"".join(map(get, t.encode().split())) if t else b"" for t in texts]

    def __missing__(self, word: bytes) -> bytes:
        if word.isalpha():  # ASCII letters alone, as most words are
            ids = struct_ids([t.id for t in self.tokenize(word.lower().decode())])
            if len(word) <= MEMO_WORD:
                self[word] = ids
            return ids
        text = word.decode()
        m = _SIMPLE.fullmatch(text)
        if m:
            letters = m[1].lower()
            ids = struct_ids([t.id for t in self.tokenize(letters if letters.isascii() else letters.translate(self.symbols))])
            if m[2]:
                ids += self._tail(m[2])
        else:
            ids = self._whole(text)
        if len(word) <= MEMO_WORD:
            self[word] = ids
        return ids

    def _whole(self, text: str) -> bytes:
        return struct_ids(self.library.encode(text, add_special_tokens=False).ids)

    def _tail(self, marks: str) -> bytes:
        if marks not in self.tails:
            if len(self.tails) > 10_000:
                self.tails.clear()
            self.tails[marks] = self._whole(marks)
        return self.tails[marks]


_PACKERS = [struct.Struct(f"<{n}I").pack for n in range(64)]


def struct_ids(ids: list[int]) -> bytes:
    return _PACKERS[len(ids)](*ids) if len(ids) < 64 else struct.pack(f"<{len(ids)}I", *ids)


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder a process; the file is installed on every node."""
    if path not in _ENCODERS:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def write_shards(
    docs: DataFrame, tokenizer_path: str, end_id: int, path: str | None = None, id_col: str = "doc_id", text_col: str = "text",
    part_bytes: int = PART_BYTES, shard_bytes: int = SHARD_BYTES,
) -> DataFrame:
    """Write (part, seq, n_tokens, payload) and return the table read back.

    One range shuffle puts documents in ascending doc_id order; a task sorts its range, encodes it and
    closes a shard whenever ``shard_bytes`` of text have come by, so no range has to fit in memory.
    """
    schema = schema_of("part int, seq int, n_tokens long, payload binary")
    arrow = to_arrow_schema(schema)
    end = int(end_id).to_bytes(4, "little")

    def run(batches):
        part, held, size, seq = TaskContext.get().partitionId(), [], 0, 0

        def shard():
            flat = np.frombuffer(b"".join(x for _, x in held), "<u4")
            flat = flat.astype(np.uint16) if flat.max() < 1 << 16 else flat
            payload = pack([d for d, _ in held], np.array([len(x) // 4 for _, x in held]), flat)
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([len(flat)], pa.int64()), pa.array([payload], pa.binary())],
                schema=arrow,
            )

        for batch in slices(batches):
            ids, texts = (c.to_pylist() for c in batch.columns)
            held += zip(ids, (x + end for x in encoder(tokenizer_path).encode_texts(texts)))
            size += batch.nbytes
            if size >= shard_bytes:
                yield shard()
                held, size, seq = [], 0, seq + 1
        if held:
            yield shard()

    total = docs.agg(F.sum(F.octet_length(text_col) + 16)).first()[0] or 0
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    ordered = rows.repartitionByRange(parts(total, part_bytes), "doc_id").sortWithinPartitions("doc_id", "text")
    return saved(arrow_map(ordered, run, schema), path)


def shard_starts(shards: DataFrame) -> DataFrame:
    """(part, seq, first): ids in all shards before each. One task adds up one row a part."""
    counts = shards.select("part", "seq", "n_tokens")
    before = W.rowsBetween(W.unboundedPreceding, -1)
    sums = counts.groupBy("part").agg(F.sum("n_tokens").alias("n")).select(
        "part", F.coalesce(F.sum("n").over(before.orderBy("part")), F.lit(0)).alias("base")
    )
    inner = F.coalesce(F.sum("n_tokens").over(W.partitionBy("part").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return counts.select("part", "seq", inner.alias("first")).join(sums, "part").select("part", "seq", (F.col("base") + F.col("first")).alias("first"))


def read_documents(shards: DataFrame, value: Callable[[bytes], object] = bytes, name: str = "ids", kind: str = "binary") -> DataFrame:
    """(doc_id, start, n_tokens, value) of every document, from the payloads alone.

    ``value`` is made of a document's ids as little-endian unsigned 32-bit integers, by default these
    bytes; ``start`` counts from the first shard.
    """
    schema = schema_of(f"doc_id long, start long, n_tokens long, {name} {kind}")
    arrow = to_arrow_schema(schema)

    def run(batches):
        for part in slices(batches, 1):
            payload, first = (c[0].as_py() for c in part.columns)
            doc_ids, lengths, matrix = unpack(payload)
            flat, ends = memoryview(matrix.decode().astype("<u4").tobytes()), np.cumsum(lengths.astype(np.int64))
            starts = ends - lengths
            for low in range(0, len(doc_ids), SLICE_ROWS):
                cut = slice(low, low + SLICE_ROWS)
                values = [value(flat[4 * a : 4 * b]) for a, b in zip(starts[cut].tolist(), ends[cut].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc_ids[cut], pa.int64()), pa.array(starts[cut] + first), pa.array(lengths[cut].astype(np.int64)), pa.array(values, arrow[3].type)],
                    schema=arrow,
                )

    starts = saved(shard_starts(shards))
    few = starts.count() <= SENT_SHARDS
    return arrow_map(shards.join(F.broadcast(starts) if few else starts, ["part", "seq"]).select("payload", "first"), run, schema)


def occurrences(shards: DataFrame, token_id: int) -> DataFrame:
    """(doc_id, n): documents that hold a token id, found on the planes alone."""
    schema = schema_of("doc_id long, n long")
    arrow = to_arrow_schema(schema)

    def run(batches):
        for part in slices(batches, 1):
            doc_ids, lengths, matrix = unpack(part.column(0)[0].as_py())
            ends = np.cumsum(lengths.astype(np.int64))
            per = np.bincount(np.searchsorted(ends, matrix.find_all(token_id), side="right"), minlength=len(doc_ids))
            keep = np.nonzero(per)[0]
            yield pa.RecordBatch.from_arrays(
                [pa.array([doc_ids[k] for k in keep], pa.int64()), pa.array(per[keep].astype(np.int64))], schema=arrow
            )

    return arrow_map(shards.select("payload"), run, schema)
