"""Byte-level BPE by corpus-level merge replay, and its decoding.

All distinct pieces of a slice of the corpus are laid out as one linked list of byte symbols. An
inverted index holds, for every merge rank, the positions whose two neighbouring symbols join into
that token. Ranks are replayed lowest first; a merge touches its two neighbours only, whose new
pairs enter the index. Pieces already encoded by this worker come from bounded memos, so a distinct piece
is replayed once in a while, not once an occurrence.

Defined results: null text is empty; an empty text has no ids; ids decode to the exact bytes of
the text; repeated rows give one row each. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_docs

#: Pairs of ids whose rank a worker remembers.
PAIRS = 500_000
#: Pieces that a worker remembers afresh, and the characters of one at most. A memo that is full becomes the
#: old one, of which pieces that come again are taken over, and longer pieces are forgotten after their slice.
#: So the two memos have at most some 600 bytes a piece, as measured in the check.
MEMO_PIECES, MEMO_PIECE = 250_000, 128


class MergeReplay:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.pieces = regex.compile(pattern).findall
        self.byte_id = [ranks.get(bytes([b])) for b in range(256)]
        if None in self.byte_id:
            raise ValueError("a byte has no rank")
        self.token = {i: t for t, i in ranks.items()}
        self.memo: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.pair_rank: dict[int, int] = {}

    def rank(self, key: int) -> int:
        """Rank of the token that two neighbours join into, -1 if there is none; key packs their ids."""
        known = self.pair_rank
        if len(known) > PAIRS:
            known.clear()
        r = known[key] = self.ranks.get(self.token[key >> 32] + self.token[key & 0xFFFFFFFF], -1)
        return r

    def replay(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Ids of each piece, by replaying every merge in rank order over all of them at once."""
        rank, get = self.rank, self.pair_rank.get
        data = b"\0".join(pieces) + b"\0"
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces)) + 1
        ends = np.cumsum(sizes) - 1  # the gap after each piece, which no pair crosses
        n = len(data)
        gap = np.zeros(n, bool)
        gap[ends] = True
        codes = np.array(self.byte_id)[np.frombuffer(data, np.uint8)]
        codes[gap] = -1
        piece_of = np.repeat(np.arange(len(pieces)), sizes).tolist()
        at = np.arange(n)
        after = np.where(gap | np.append(gap[1:], True), -1, at + 1)
        nxt = after.tolist()
        prv = np.where(gap | np.append(True, gap[:-1]), -1, at - 1).tolist()
        sym = codes.tolist()
        # the first pairs of neighbours, sorted by rank into the inverted index
        left = at[after >= 0]
        pairs, which = np.unique(codes[left] << 32 | codes[left + 1], return_inverse=True)
        first = np.array([rank(k) if (r := get(k)) is None else r for k in pairs.tolist()], np.int64)[which] if len(left) else np.zeros(0, np.int64)
        left, first = left[first >= 0], first[first >= 0]
        order = np.argsort(first, kind="stable")
        found, starts = np.unique(first[order], return_index=True)
        index = dict(zip(found.tolist(), (x.tolist() for x in np.split(left[order], starts[1:])))) if len(found) else {}
        heap = list(index)
        heapify(heap)
        while heap:
            r = heappop(heap)
            spots = index.pop(r, None)
            if spots is None:
                continue
            spots.sort()
            waiting: set[int] = set()
            back: list[int] = []
            shifted = r << 32
            for p in spots:
                a = sym[p]
                q = nxt[p]
                if a < 0 or q < 0:
                    continue
                k = a << 32 | sym[q]
                known = get(k)
                if (rank(k) if known is None else known) != r:
                    continue
                if waiting and piece_of[p] in waiting:
                    back.append(p)
                    continue
                sym[p] = r
                sym[q] = -1
                after = nxt[p] = nxt[q]
                before = prv[p]
                low = False
                if before >= 0:
                    k = sym[before] << 32 | r
                    new = get(k)
                    if new is None:
                        new = rank(k)
                    if new >= 0:
                        low = new < r
                        if new in index:
                            index[new].append(before)
                        else:
                            index[new] = [before]
                            heappush(heap, new)
                if after >= 0:
                    prv[after] = p
                    k = shifted | sym[after]
                    new = get(k)
                    if new is None:
                        new = rank(k)
                    if new >= 0:
                        low = low or new < r
                        if new in index:
                            index[new].append(p)
                        else:
                            index[new] = [p]
                            heappush(heap, new)
                if low:  # this piece has an earlier merge to do first
                    waiting.add(piece_of[p])
            if back:
                index.setdefault(r, []).extend(back)
                heappush(heap, r)
        out = np.array(sym, np.int64)
        ids = out[out >= 0]
        counts = np.add.reduceat(out >= 0, ends + 1 - sizes) if len(pieces) else np.zeros(0, np.int64)
        return np.split(ids, np.cumsum(counts)[:-1]) if len(pieces) else []

    def encode_texts(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        ranks = self.ranks
        split = [self.pieces(t) if t else [] for t in texts]
        new = {p for ps in split for p in ps}
        if len(self.memo) + len(new) > MEMO_PIECES:
            self.old, self.memo = self.memo, {}
        memo, known = self.memo, self.old.get
        todo = []
        for p in new:
            if p in memo:
                continue
            ids = known(p)
            if ids is not None:
                memo[p] = ids
                continue
            whole = ranks.get(p.encode())
            if whole is None:
                todo.append(p)
            else:
                memo[p] = whole.to_bytes(4, "little")
        for p, ids in zip(todo, self.replay([p.encode() for p in todo])):
            memo[p] = ids.astype("<u4").tobytes()
        get = memo.__getitem__
        out = [b"".join(map(get, ps)) for ps in split]
        for p in new:
            if len(p) > MEMO_PIECE:
                memo.pop(p, None)
        return out

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.token.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def decoded(self, ids: list | None) -> bytes | None:
        """The bytes of a list of ids; None where it holds a null or an id of no token, which stand for no text."""
        found = [self.token.get(i) for i in ids or ()]
        return None if None in found else b"".join(found)


_COMPILED: dict[tuple, MergeReplay] = {}


def compiled(path: str, pattern: str) -> MergeReplay:
    """The replayer of a rank file, read once a process; the file is installed on every node."""
    if (path, pattern) not in _COMPILED:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _COMPILED[path, pattern] = MergeReplay(ranks, pattern)
    return _COMPILED[path, pattern]


def _kind(rows: DataFrame, id_col: str) -> str:
    """Ids keep their type."""
    return rows.schema[id_col].dataType.simpleString()


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, token_ids array<int>) of every document."""

    def run(ids, texts):
        out = compiled(path, pattern).encode_texts(texts)
        ends = np.cumsum([0] + [len(x) // 4 for x in out])
        flat = pa.array(np.frombuffer(b"".join(out), "<i4"))
        return {
            "doc_id": ids,
            "n_tokens": [len(x) // 4 for x in out],
            "token_ids": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat),
        }

    return map_docs(docs, [F.col(id_col).alias("doc_id"), text_col], run, f"doc_id {_kind(docs, id_col)}, n_tokens long, token_ids array<int>")


def decode(tokens: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "token_ids") -> DataFrame:
    """(doc_id, decoded binary) of every array of ids; null where one of them is null or has no token. A null or empty
    array decodes to nothing."""

    def run(ids, arrays):
        model = compiled(path, pattern)
        return {"doc_id": ids, "decoded": [model.decoded(a) for a in arrays]}

    return map_docs(tokens, [F.col(id_col).alias("doc_id"), ids_col], run, f"doc_id {_kind(tokens, id_col)}, decoded binary")


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode, then decode what was encoded: digests of both, a row for each document."""

    def run(ids, texts):
        model = compiled(path, pattern)
        out = model.encode_texts(texts)
        return {
            "doc_id": ids,
            "n_tokens": [len(x) // 4 for x in out],
            "ids_sha256": [hashlib.sha256(x).hexdigest() for x in out],
            "decoded_sha256": [hashlib.sha256(model.decode(x)).hexdigest() for x in out],
        }

    return map_docs(
        docs, [F.col(id_col).alias("doc_id"), text_col], run,
        f"doc_id {_kind(docs, id_col)}, n_tokens long, ids_sha256 string, decoded_sha256 string",
    )
