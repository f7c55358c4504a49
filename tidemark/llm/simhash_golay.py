"""SimHash near-duplicates found with Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into segments of 22, 21 and 21 bits, each padded to a word of the
perfect [23,12,7] Golay code. A word decodes to the one codeword within distance 3; a word at
distance exactly 3 also has five codewords at distance 4. If two words differ in at most one bit, the
codeword of either is among the nearby codewords of the other.

At most three differing bits fall on three segments in one of two ways (pigeonhole). Either a segment
is free of errors and one of the others has one at most: the key is the exact segment with a nearby
codeword of the other. Or each segment has exactly one: the key is a nearby codeword of all three.
One error flips a segment's parity, so parity tells which of the two fingerprints gives its own
codeword and which the nearby ones. Keys have 33 bits and more, about 36 for a fingerprint. Every
candidate is verified on the full 64 bits, and links are closed to components.

Identical fingerprints are collapsed before anything is joined. A key that many fingerprints share is
refined: of five parts of the 64 bits at most three hold errors, so a pair agrees on two parts at least, and
each pair of parts is a key by its values. What is large even then is cut into blocks; a pair of blocks is
compared in one bounded task that emits a spanning forest.

Defined results: null or empty text has fingerprint zero and links like any other; repeated rows give
one row each; a row with a null id gets its fingerprint and the component of its fingerprint, whose id
is the smallest non-null one. A document that is kept is an id: of rows with the same id the one whose text hashes
lowest stays, then the one whose columns do. Ids that are no whole numbers are refused. Extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations, permutations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import AtomicType, IntegralType

from .common import arrow_map, map_docs, parts, saved, schema_of
from .components import components, forest

SEGMENTS = ((0, 22), (22, 21), (43, 21))
MAX_BITS = 3
#: Fingerprints of one side of a key that are compared in one block.
BLOCK = 2048
#: Keys with more fingerprints on a side are refined before they are cut into blocks.
REFINED = 2048
#: Parts of a fingerprint by which large keys are refined.
PARTS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
#: Keys with up to so many fingerprints on a side emit their verified pairs by a plain join.
FEW = 16
#: Fingerprints whose keys one task makes.
KEYED_ROWS = 20_000
#: Keys of 16 bytes that are broadcast at most; more are joined by a shuffle.
SENT_KEYS = 100_000
#: Ids of 8 bytes that are broadcast at most; more are joined by a shuffle.
SENT_IDS = 2_000_000
SHINGLE = 3
SEED = 42


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """A bit is 1 if it is set in over half of the shingles' XXH64; 0 without words."""
    words = text.encode().lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, seed)
    hash64, ends, at = xxhash.xxh64_intdigest, [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    starts = [0] + [e + 1 for e in ends]
    n, counts = len(words) - shingle + 1, np.zeros(64, np.int64)
    for low in range(0, n, 65_536):
        high = min(n, low + 65_536)
        h = np.array([hash64(joined[a:b], seed) for a, b in zip(starts[low:high], ends[low + shingle - 1 :])], "<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n, bitorder="little").tobytes(), "little")


class Golay:
    """Syndrome decoding of the perfect [23,12,7] code, built from its generator polynomial."""

    def __init__(self):
        gen = 0b101011100011  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1
        self.unit = np.zeros(23, np.int64)
        for i in range(23):
            r = 1 << i
            for b in range(22, 10, -1):
                if r >> b & 1:
                    r ^= gen << (b - 11)
            self.unit[i] = r
        self.leader = np.zeros(2048, np.int64)
        weight = np.full(2048, 9)
        near: list[list[int]] = [[] for _ in range(2048)]
        for k in range(5):
            for bits in combinations(range(23), k):
                s = int(np.bitwise_xor.reduce(self.unit[list(bits)])) if bits else 0
                e = sum(1 << b for b in bits)
                if k < 4:
                    self.leader[s], weight[s] = e, k
                elif weight[s] == 3:
                    near[s].append(e)
        # the error patterns that lead to a nearby codeword; -1 where there is none
        self.near = np.full((2048, 6), -1, np.int64)
        self.near[:, 0] = self.leader
        for s, found in enumerate(near):
            self.near[s, 1 : 1 + len(found)] = found

    def syndrome(self, words: np.ndarray) -> np.ndarray:
        out = np.zeros_like(words)
        for i in range(23):
            out ^= np.where(words >> i & 1, self.unit[i], 0)
        return out

    def decode(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the codeword (its 12 systematic bits), and of all nearby codewords, -1 where none."""
        s = self.syndrome(words)
        errors = self.near[s]
        near = np.where(errors < 0, -1, (words[:, None] ^ errors) >> 11)
        return (words ^ self.leader[s]) >> 11, near


_GOLAY: list[Golay] = []

KEYS = "key long, fp long, role byte"
HEAD, TAIL = 1, 2


def keys_of(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys (key, position in fps, role) of unsigned 64-bit fingerprints; heads meet tails."""
    if not _GOLAY:
        _GOLAY.append(Golay())
    segs = [((fps >> np.uint64(low)) & np.uint64((1 << size) - 1)).astype(np.int64) for low, size in SEGMENTS]
    odd = [np.bitwise_count(s) & 1 for s in segs]
    codes = [_GOLAY[0].decode(s) for s in segs]
    out, every = [], np.arange(len(fps))
    for c, (x, y) in enumerate(permutations(range(3), 2)):
        own, near = codes[y]
        head = (c << 40) | (segs[x] << 12)
        out.append((head | own, every, np.full(len(fps), HEAD | TAIL, np.int8)))
        # words whose codewords differ have one error between them: the one of odd parity gives the others
        row, col = np.nonzero((near >= 0) & (near != own[:, None]) & (odd[y] == 1)[:, None])
        out.append((head[row] | near[row, col], row, np.full(len(row), TAIL, np.int8)))
    (own_a, near_a), (own_b, near_b), (own_c, near_c) = codes
    base = (6 << 40) | ((odd[1] ^ odd[0]).astype(np.int64) << 37) | ((odd[2] ^ odd[0]).astype(np.int64) << 36)
    at = np.nonzero(odd[0] == 0)[0]
    row, col = np.nonzero(near_b[at] >= 0)
    row = at[row]
    out.append((base[row] | own_a[row] << 24 | near_b[row, col] << 12 | own_c[row], row, np.full(len(row), HEAD, np.int8)))
    at = np.nonzero(odd[0] == 1)[0]
    row, i, j = np.nonzero((near_a[at] >= 0)[:, :, None] & (near_c[at] >= 0)[:, None, :])
    row = at[row]
    out.append((base[row] | near_a[row, i] << 24 | own_b[row] << 12 | near_c[row, j], row, np.full(len(row), TAIL, np.int8)))
    return tuple(map(np.concatenate, zip(*out)))


def _keys(fps: DataFrame) -> DataFrame:
    schema = schema_of(KEYS)
    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False)
            if len(fp):
                key, row, role = keys_of(fp.astype(np.int64).view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp[row]), pa.array(role)], schema=arrow)

    return arrow_map(fps.select("fp"), run, schema)


def block_forest(left: np.ndarray, right: np.ndarray, bits: int = MAX_BITS) -> list[tuple[int, int]]:
    """A spanning forest of the links between two blocks; at most BLOCK x BLOCK comparisons, 256 rows at once."""
    tree: list[tuple[int, int]] = []
    for at in range(0, len(left), 256):
        rows = left[at : at + 256]
        a, b = np.nonzero(np.bitwise_count((rows[:, None] ^ right[None, :]).view(np.uint64)) <= bits)
        tree = forest([*tree, *zip(rows[a].tolist(), right[b].tolist())])
    return tree


def _sized(keys: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(links of the keys with two fingerprints, rows of larger keys with their ``size`` or None if there are none)."""
    shared = saved(
        keys.groupBy("key").agg(F.count("*").alias("size"), F.min("fp").alias("u"), F.max("fp").alias("v")).where("u <> v")
    )
    pairs = shared.where("size = 2").select("u", "v")
    large = shared.where("size > 2").select("key", "size")
    found = large.count()
    return pairs, saved(keys.join(F.broadcast(large) if found <= SENT_KEYS else large, "key")) if found else None


def _refined(rows: DataFrame) -> DataFrame:
    """Rows of large keys under keys of their own: the old key with the values of two of the five parts.

    Keys are hashed, so unlike ones may meet by chance; every pair is verified anyway.
    """
    values = [F.shiftrightunsigned("fp", low).bitwiseAND((1 << size) - 1) for low, size in PARTS]
    named = F.array(*(F.xxhash64(F.col("key"), F.lit(i), F.lit(j), values[i], values[j]) for i, j in combinations(range(len(PARTS)), 2)))
    return rows.select(F.explode(named).alias("key"), "fp", "role")


def links(fps: DataFrame, bits: int = MAX_BITS, block: int = BLOCK, refined: int = REFINED) -> DataFrame:
    """(u, v) links between distinct fingerprints whose closure is that of all links within ``bits`` (up to MAX_BITS)."""
    close = F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= bits
    heads, tails = F.col("role").bitwiseAND(HEAD) > 0, F.col("role").bitwiseAND(TAIL) > 0
    found, rows = _sized(_keys(fps.repartition(parts(fps.count(), KEYED_ROWS))))
    found = [found.where(close)]

    def compare(group: pa.Table) -> pa.Table:
        fp, head = group.column("fp").to_numpy(), group.column("head").to_numpy()
        tree = block_forest(fp[head], fp[~head], bits)
        return pa.table({"u": pa.array([a for a, _ in tree], pa.int64()), "v": pa.array([b for _, b in tree], pa.int64())})

    for last in (False, True):
        if rows is None:
            break
        few = rows.where(F.col("size") <= FEW)
        near = few.where(heads).select("key", F.col("fp").alias("u")).join(few.where(tails).select("key", F.col("fp").alias("v")), "key")
        found.append(near.where((F.col("u") != F.col("v")) & close).select("u", "v"))
        # a side of a larger key is cut into blocks, each of which meets every block of the other side
        many = rows.where((F.col("size") > FEW) & (F.lit(last) | (F.col("size") <= refined)))
        many = many.withColumn("blocks", F.ceil(F.col("size") / block).cast("int"))
        own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
        other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
        met = many.where(heads).select("key", own.alias("i"), other.alias("j"), "fp", F.lit(True).alias("head")).unionByName(
            many.where(tails).select("key", other.alias("i"), own.alias("j"), "fp", F.lit(False).alias("head"))
        )
        found.append(met.groupBy("key", "i", "j").applyInArrow(compare, "u long, v long"))
        if not last:
            large = rows.where(F.col("size") > refined)
            if large.isEmpty():
                break
            pairs, rows = _sized(_refined(large))
            found.append(pairs.where(close))
    return reduce(DataFrame.unionByName, found)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp signed 64-bit) of every row."""

    def run(ids, texts):
        fps = np.array([fingerprint(t) for t in texts], "<u8").view("<i8")
        return {"doc_id": ids, "fp": pa.array(fps)}

    return map_docs(docs, [F.col(id_col).alias("doc_id"), text_col], run, "doc_id long, fp long")


def classes(prints: DataFrame, bits: int = MAX_BITS) -> DataFrame:
    """(fp, component_id, members) of every distinct fingerprint of (doc_id, fp) rows."""
    distinct = saved(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows")))
    roots = components(links(distinct, bits))
    rooted = distinct.join(roots, distinct.fp == roots.node, "left").select(
        "fp", "least", "rows", F.coalesce("root", "fp").alias("root")
    )
    rooted = saved(rooted)
    # written, so that the join has two shuffles of its own and a large component can be split
    tops = saved(rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.sum("rows").alias("members")))
    return rooted.select("fp", "root").join(tops, "root").select("fp", "component_id", "members")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, fp, component_id, members) of every row."""
    _whole_ids(docs, id_col)
    prints = saved(fingerprints(docs, id_col, text_col))
    return prints.join(saved(classes(prints, bits)), "fp").select("doc_id", "fp", "component_id", "members")


def _order(docs: DataFrame, text_col: str) -> Column:
    """What tells rows of one id apart: hashes of the text and of all columns, and then the columns themselves.

    Columns that cannot be compared, such as maps, are taken as JSON, which holds all that they hold.
    """
    plain = [f.name for f in docs.schema if isinstance(f.dataType, AtomicType)]
    rest = [F.to_json(F.struct(F.col(f"`{f.name}`").alias("c"))) for f in docs.schema if f.name not in plain]
    # nulls have to be told from what hashes alike, and a struct with a null is still compared
    columns = [*(F.col(f"`{c}`") for c in plain), *rest]
    return F.struct(F.xxhash64(text_col).alias("t"), F.xxhash64(*columns).alias("h"), *(c.isNull().alias(f"n{i}") for i, c in enumerate(columns)), *(c.alias(f"c{i}") for i, c in enumerate(columns)))


def _whole_ids(docs: DataFrame, id_col: str) -> None:
    """Components are named by their smallest id, a whole number; other ids are refused before anything runs."""
    if not isinstance(docs.schema[id_col].dataType, IntegralType):
        raise ValueError(f"{id_col} has to be of whole numbers, it is {docs.schema[id_col].dataType.simpleString()}")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = MAX_BITS) -> DataFrame:
    """One document of each group of near copies, all columns kept: the one with the smallest id.

    Rows with the same id count as one document, of which one row stays: the one whose text hashes lowest, of those the
    one whose columns do, so it is the same in any order; rows that are equal in all are one. Rows with a null id stay. Texts are not shuffled unless there are many documents to drop, or ids that repeat.
    """
    rows = near_duplicates(docs, id_col, text_col, bits).where("doc_id is not null")
    found = saved(rows.groupBy("doc_id").agg(F.max(F.col("doc_id") == F.col("component_id")).alias("leads"), F.count("*").alias("n")))
    ids = F.col("doc_id").alias(id_col)
    gone, again = found.where("not leads").select(ids), found.where("leads and n > 1").select(ids)
    out = docs.join(F.broadcast(gone) if gone.count() <= SENT_IDS else gone, id_col, "left_anti")
    if again.count():
        repeated = out.join(again, id_col, "left_semi").select(F.col(id_col).alias("key"), F.struct(*docs.columns).alias("row"), _order(docs, text_col).alias("order"))
        once = repeated.groupBy("key").agg(F.min_by("row", "order").alias("row")).select("row.*")
        out = out.join(again, id_col, "left_anti").unionByName(once)
    return out.select(docs.columns)
