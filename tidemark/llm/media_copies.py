"""Copies of pictures, cropped or edited, found by local image descriptors.

Pictures (PGM, PPM or PNG bytes in a binary column) become grey pyramids. Corners are all maxima of the
Harris response over a floor of noise, at five scales, small pictures at two larger ones too; each gets an orientation from the centroid of its
neighbourhood and 128 binary tests of smoothed pixels, turned by exactly that orientation and read between pixels. A corner and each of its
nearest corners of the same level make a doublet. Doublets meet in Hamming tables: a key is a choice of bits of
both descriptors, so that one which flips few bits is met in some of its doublets, and descriptors that are
common in pictures that have nothing else in common rarely meet. Two doublets match if the growth and turn
of the line between their corners are those of the corners themselves. A pair of pictures is linked by geometric
consensus: matched doublets vote for growth, turn and shift, and enough different corners must agree. Links
are closed to classes.

In a bucket every picture is first compared with the one of smallest number, which joins most copies at linear
cost. Then every pair of pictures of a bucket that are not joined yet is compared and votes anew with all its matches, in
tasks of at most two blocks. Most pairs meet by chance in one bucket and could have no consensus: where more than RARE entries
meet, matches are made only of pictures whose lists of further entries have enough in common, which leaves out no link. So the
classes are those of all pairs that meet in a bucket; comparisons in a bucket of pictures that stay apart are the square of its size.

Defined results: null or unreadable content (JPEG bytes among them, see from_files) has no corners and is a
class of its own, as is a picture without corners; equal pictures are one class even so; repeated ids count as
one picture for each content; rows with a null id are left out. Extra columns are ignored.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .common import arrow_map, dropped, map_docs, saved, schema_of, slices
from .components import components

#: Sizes of the pyramid's levels by that of the picture.
SCALES = (1.0, 0.8409, 0.7071, 0.5946, 0.5)
#: Further levels of pictures with a side below SMALL, whose margins would leave few corners.
ENLARGED, SMALL = (1.4142, 1.1892), 128
RADIUS = 9
MARGIN = 3
#: Harris response, in grey levels to the fourth power, below which nothing is a corner but noise.
FLOOR = 4.0
#: Pixels of a side of the tiles in which a level is searched.
TILE = 1024
#: Corners that a corner is paired with, and the pixels of its level that they are apart at least and at most.
NEIGHBOURS, NEAREST, FARTHEST = 3, 5, 96
#: Bits of each of the two descriptors in a key, and ways to choose them.
KEY_BITS, TABLES = 40, 1
#: Contents, of some 100 bytes, that are broadcast at most; more are joined by a shuffle.
SENT_CONTENTS = 100_000
#: Keys of 16 bytes, of those that pictures share, that are broadcast at most; more are joined by a shuffle.
SENT_KEYS = 1_000_000
#: Differences of growth (log2) and turn (radians) of a doublet and its corners up to which they agree.
MAX_GROW, MAX_TURN = 0.3, 0.15
#: Matched corners that must agree on growth, turn and shift.
MIN_VOTES = 5
#: Pixels within which the shifts of agreeing corners lie, or half of it; cells of a whole turn.
CELL, TURN_CELLS = 12, 16
#: Cells of a whole turn in which doublets of large buckets meet; each is wider than MAX_TURN.
AGREE_CELLS = 20
#: Buckets of more entries than FEW are compared in blocks of rows, those of more than BLOCK by cells, and cells of more than that dealt to blocks of about so many.
FEW, BLOCK = 64, 2048
#: Entries of a rare bucket at most, all of whose matches are made: in proportion to its entries.
RARE = 16
#: Entries in frequent buckets of a picture that are listed at most; matches of a picture with more are made without a look at lists.
MOST_LISTED = 256
_SEED = 31


def _key_weights(bits: int = KEY_BITS, tables: int = TABLES) -> np.ndarray:
    """For each table and each descriptor of a doublet a random number of 64 bits for each bit in the key, 0 for others."""
    out = np.zeros((tables, 2, 128), np.uint64)
    for t in range(tables):
        rng = np.random.default_rng(_SEED + t)
        places = rng.permutation(128)[: 2 * bits].reshape(2, bits)
        for k in range(2):
            out[t, k, places[k]] = rng.integers(0, 2**64, bits, dtype=np.uint64)
    return out


_KEY_WEIGHTS = _key_weights()


def read_picture(content: bytes | None) -> np.ndarray | None:
    """Grey levels of PGM (P5), PPM (P6) or 8-bit PNG bytes; None if they cannot be read."""
    try:
        if content[:2] in (b"P5", b"P6"):
            fields, at = [], 2
            while len(fields) < 3:
                while content[at : at + 1].isspace():
                    at += 1
                if content[at : at + 1] == b"#":
                    at = content.index(b"\n", at)
                    continue
                end = at
                while content[end : end + 1].isdigit():
                    end += 1
                fields.append(int(content[at:end]))
                at = end
            width, height, depth = fields
            channels = 1 if content[:2] == b"P5" else 3
            if not 0 < depth < 256:
                return None
            data = np.frombuffer(content, np.uint8, width * height * channels, at + 1).reshape(height, width, channels)
        elif content[:8] == b"\x89PNG\r\n\x1a\n":
            data = _png(content)
        else:
            return None
        return data.astype(np.float32).mean(axis=2) if data is not None and data.size else None
    except (TypeError, ValueError, IndexError, struct.error, zlib.error):
        return None


def _png(content: bytes) -> np.ndarray | None:
    at, packed, head, palette = 8, [], None, None
    while at + 8 <= len(content):
        size, kind = struct.unpack_from(">I4s", content, at)
        body = content[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            packed.append(body)
        at += 12 + size
    width, height, depth, colour, _, _, interlace = head
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}.get(colour)
    if interlace or channels is None or depth not in (8, 16) and not (channels == 1 and depth in (1, 2, 4)) or (colour == 3) != (palette is not None and colour == 3):
        return None
    step = max(1, channels * depth // 8)  # bytes from a pixel to the next
    row = -(-width * channels * depth // 8)
    raw = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8)[: height * (1 + row)].reshape(height, 1 + row)
    cells = -(-row // step)
    lines = np.zeros((height, cells * step), np.uint8)
    lines[:, :row] = raw[:, 1:]
    out = _unfiltered(lines.reshape(height, cells, step), raw[:, 0]).reshape(height, -1)[:, :row]
    if depth == 16:
        out = out[:, ::2]  # the high bytes
    elif depth < 8:
        out = np.unpackbits(out, axis=1).reshape(height, -1, depth) @ (1 << np.arange(depth - 1, -1, -1))
        out = out[:, :width] * (1 if colour == 3 else 255 // ((1 << depth) - 1))
    if colour == 3:
        return palette[out[:, :width]]
    return out.reshape(height, width, channels)[:, :, : 1 if channels < 3 else 3].astype(np.uint8)


def _unfiltered(lines: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Bytes of a PNG before its filters. Rows without a filter of two directions are undone at once, others along
    diagonals: all pixels of one need only the two diagonals before it."""
    height, width, step = lines.shape
    out = np.zeros((height + 1, width + 1, step), np.int16)  # a row above and a column to the left of zeros
    if not (kinds > 2).any():
        for y in range(height):
            line = lines[y].astype(np.int64)
            if kinds[y] == 1:
                line = np.cumsum(line, axis=0)
            elif kinds[y] == 2:
                line = line + out[y, 1:]
            out[y + 1, 1:] = line & 255
        return out[1:, 1:].astype(np.uint8)
    kind = kinds[:, None]
    for d in range(height + width - 1):
        y = np.arange(max(0, d - width + 1), min(height, d + 1))
        x = d - y
        left, above, corner = out[y + 1, x], out[y, x + 1], out[y, x]
        k = kind[y]
        p = left + above - corner
        to_left, to_above, to_corner = abs(p - left), abs(p - above), abs(p - corner)
        paeth = np.where((to_left <= to_above) & (to_left <= to_corner), left, np.where(to_above <= to_corner, above, corner))
        guess = np.where(k == 1, left, np.where(k == 2, above, np.where(k == 3, (left + above) >> 1, np.where(k == 4, paeth, 0))))
        out[y + 1, x + 1] = (lines[y, x] + guess) & 255
    return out[1:, 1:].astype(np.uint8)


def _box(a: np.ndarray, r: int) -> np.ndarray:
    """Mean over (2r+1) x (2r+1) of a stack of pictures, edges repeated; sums run along one line only, in doubles."""
    n = 2 * r + 1
    for axis in (1, 2):
        pad = [(0, 0)] * 3
        pad[axis] = (r + 1, r)
        p = np.pad(a, pad, mode="edge").cumsum(axis=axis, dtype=np.float64)
        high, low = [slice(None)] * 3, [slice(None)] * 3
        high[axis], low[axis] = slice(n, None), slice(None, -n)
        a = ((p[tuple(high)] - p[tuple(low)]) / n).astype(np.float32)
    return a


def _resize(a: np.ndarray, height: int, width: int) -> np.ndarray:
    """Bilinear, on a stack of pictures."""

    def places(n, m):
        at = np.clip((np.arange(m) + 0.5) * n / m - 0.5, 0, n - 1)
        low = np.minimum(at.astype(int), max(n - 2, 0))
        return low, np.minimum(low + 1, n - 1), (at - low).astype(np.float32)

    y0, y1, fy = places(a.shape[1], height)
    x0, x1, fx = places(a.shape[2], width)
    rows = a[:, y0] * (1 - fy)[None, :, None] + a[:, y1] * fy[None, :, None]
    return rows[:, :, x0] * (1 - fx) + rows[:, :, x1] * fx


def _tests() -> np.ndarray:
    """Pairs of points for the binary tests: (test, two ends, x and y)."""
    rng = np.random.default_rng(_SEED)
    pts = np.clip(rng.normal(0, RADIUS / 2, (128, 2, 2)), -RADIUS * 0.9, RADIUS * 0.9)
    return (pts * np.minimum(1, RADIUS / np.hypot(pts[..., :1], pts[..., 1:]))).astype(np.float32)  # so that no turn leaves the margin


_TESTS = _tests()
_DISC = np.array([(y, x) for y in range(-7, 8) for x in range(-7, 8) if x * x + y * y <= 49])


def _corners(level: np.ndarray, core: tuple[int, int, int, int]) -> tuple[np.ndarray, ...]:
    """(which picture, y, x, turn, code) of the corners of a stack of smoothed pictures, within ``core`` alone."""
    h, w = level.shape[1:]
    edge = RADIUS + 1
    gy, gx = np.gradient(level, axis=(1, 2))
    a, b, c = _box(gx * gx, 2), _box(gy * gy, 2), _box(gx * gy, 2)
    strength = a * b - c * c - 0.05 * (a + b) ** 2
    inner = strength[:, edge:-edge, edge:-edge]
    peak = inner > FLOOR
    for dy in range(-MARGIN, MARGIN + 1):
        for dx in range(-MARGIN, MARGIN + 1):
            if dy or dx:
                other = strength[:, edge + dy : h - edge + dy, edge + dx : w - edge + dx]
                peak &= inner > other if (dy, dx) < (0, 0) else inner >= other
    which, ys, xs = np.nonzero(peak)
    ys, xs = ys + edge, xs + edge
    y0, y1, x0, x1 = core
    own = (ys >= y0) & (ys < y1) & (xs >= x0) & (xs < x1)
    which, ys, xs = which[own], ys[own], xs[own]
    around = level[which[:, None], ys[:, None] + _DISC[:, 0], xs[:, None] + _DISC[:, 1]]
    turn = np.arctan2(around @ _DISC[:, 0], around @ _DISC[:, 1])
    return which, ys, xs, turn, _codes(_box(level, 1), which, ys, xs, turn)


def _codes(soft: np.ndarray, which: np.ndarray, ys: np.ndarray, xs: np.ndarray, turn: np.ndarray, room: int = 2048) -> np.ndarray:
    """Descriptors of corners: the tests turned by each corner's own angle, between pixels."""
    out = [np.zeros((0, 16), np.uint8)]
    for low in range(0, len(which), room):
        k, y, x, a = (v[low : low + room, None, None] for v in (which, ys, xs, turn))
        cos, sin = np.cos(a).astype(np.float32), np.sin(a).astype(np.float32)
        px, py = x + cos * _TESTS[..., 0] - sin * _TESTS[..., 1], y + sin * _TESTS[..., 0] + cos * _TESTS[..., 1]
        x0, y0 = np.floor(px).astype(np.int64), np.floor(py).astype(np.int64)
        fx, fy = px - x0, py - y0
        above = soft[k, y0, x0] * (1 - fx) + soft[k, y0, x0 + 1] * fx
        below = soft[k, y0 + 1, x0] * (1 - fx) + soft[k, y0 + 1, x0 + 1] * fx
        value = above * (1 - fy) + below * fy
        out.append(np.packbits(value[:, :, 0] < value[:, :, 1], axis=1))
    return np.concatenate(out)


def describe(stack: np.ndarray, tile: int = TILE) -> list[list[tuple[np.ndarray, ...]]]:
    """Corners of pictures of one size: for each picture and level, arrays x, y (in the picture's pixels), turn and
    16 descriptor bytes, and the level's scale. Large levels are gone through in tiles, so memory is bounded by the
    picture itself."""
    n, height, width = stack.shape
    out: list[list] = [[] for _ in range(n)]
    for scale in (*(ENLARGED if min(height, width) < SMALL else ()), *SCALES):
        h, w = round(height * scale), round(width * scale)
        edge = RADIUS + 1
        if min(h, w) < 2 * edge + 4:
            continue
        level = _box(_resize(stack, h, w) if scale != 1 else stack, 1)
        halo = edge + MARGIN + 4
        parts = []
        for y in range(0, h, tile):
            for x in range(0, w, tile):
                y0, x0 = max(0, y - halo), max(0, x - halo)
                y1, x1 = min(h, y + tile + halo), min(w, x + tile + halo)
                if min(y1 - y0, x1 - x0) > 2 * edge + 2:
                    which, ys, xs, turn, code = _corners(level[:, y0:y1, x0:x1], (y - y0, y + tile - y0, x - x0, x + tile - x0))
                    parts.append((which, ys + y0, xs + x0, turn, code))
        if parts:
            which, ys, xs, turn, code = (np.concatenate(v) for v in zip(*parts))
            for k in range(n):
                own = which == k
                if own.any():
                    out[k].append((xs[own] / scale, ys[own] / scale, turn[own], code[own], 1 / scale))
    return out


def nearest(x: np.ndarray, y: np.ndarray, k: int = NEIGHBOURS, low: float = NEAREST, high: float = FARTHEST) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) of each place with the ``k`` nearest ones from ``low`` to ``high`` away; time grows with the area.

    Places are gone through in bands of height ``high``, in which what may be near is a stretch of three bands.
    """
    band = np.floor(y / high).astype(np.int64)
    by_band = np.argsort(band, kind="stable")
    edges = np.searchsorted(band[by_band], [np.arange(band.max() + 2) + d for d in (-1, 0, 1, 2)]) if len(x) else np.zeros((4, 0), int)
    first, second = [], []
    for b in range(max(0, edges.shape[1] - 1)):
        own, around = by_band[edges[1, b] : edges[2, b]], by_band[edges[0, b] : edges[3, b]]
        own, around = own[np.argsort(x[own], kind="stable")], around[np.argsort(x[around], kind="stable")]
        for at in range(0, len(own), 128):
            some = own[at : at + 128]
            a, z = np.searchsorted(x[around], [x[some[0]] - high, x[some[-1]] + high + 1])
            there = around[a:z]
            apart = (x[some][:, None] - x[there]) ** 2 + (y[some][:, None] - y[there]) ** 2
            apart[(apart < low * low) | (apart > high * high)] = np.inf
            many = min(k, len(there))
            best = np.argpartition(apart, many - 1, axis=1)[:, :many]
            row, col = np.nonzero(np.take_along_axis(apart, best, axis=1) < np.inf)
            first.append(some[row])
            second.append(there[best[row, col]])
    return tuple(np.concatenate(v) if v else np.zeros(0, np.int64) for v in (first, second))


def doublets(levels: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(keys, first corner, second corner, number of corners) of a picture: each corner with its nearest ones of the same level.

    A key holds some bits of both descriptors, in TABLES ways; corners are packed places, scales and turns.
    """
    keys, first, second, count = [], [], [], 0
    for x, y, turn, code, scale in levels:
        n = len(x)
        count += n
        if n < 2:
            continue
        i, j = nearest(x / scale, y / scale)
        packed = _pack(x, y, scale, turn)
        bits = np.unpackbits(code, axis=1)
        for weights in _KEY_WEIGHTS:
            # bits that are not in the key weigh nothing; others add up to a number of 64 bits that tells them apart
            keys.append((bits @ weights[0])[i].view(np.int64) + (bits @ weights[1])[j].view(np.int64))
            first.append(packed[i])
            second.append(packed[j])
    if not keys:
        none = np.zeros(0, np.int64)
        return none, none, none, count
    return np.concatenate(keys), np.concatenate(first), np.concatenate(second), count


def _pack(x: np.ndarray, y: np.ndarray, scale: float, turn: np.ndarray) -> np.ndarray:
    """Place in quarter pixels (20 bits each), log2 of the scale in eighths, turn in 256ths."""
    t = np.rint(turn / (2 * np.pi) * 256).astype(np.int64) % 256
    return (x * 4).astype(np.int64) << 36 | (y * 4).astype(np.int64) << 16 | (int(round(np.log2(scale) * 8)) & 0xFF) << 8 | t


ENTRY = "id long, key long, ga long, gb long"


def corners(pictures: DataFrame, id_col: str = "id", content_col: str = "content") -> DataFrame:
    """(id, key, ga, gb) of each picture's doublets, and one row with a null key whose ``ga`` counts its corners."""
    schema = schema_of(ENTRY)
    arrow = to_arrow_schema(schema)

    def run(batches):
        for part in slices(batches, 256):
            by_size: dict = {}
            for name, content in zip(*(c.to_pylist() for c in part.columns)):
                grey = read_picture(content)
                if grey is not None:
                    by_size.setdefault(grey.shape, []).append((name, grey))
            for same in by_size.values():
                room = max(1, (1 << 20) // same[0][1].size)
                for at in range(0, len(same), room):
                    cut = same[at : at + room]
                    for (name, _), levels in zip(cut, describe(np.stack([g for _, g in cut]))):
                        keys, ga, gb, count = doublets(levels)
                        for low in range(0, len(keys) + 1, 100_000):
                            cols = [v[low : low + 100_000] for v in (keys, ga, gb)]
                            if not low:
                                cols = [np.append(v, x) for v, x in zip(cols, (0, count, 0))]
                            null = np.zeros(len(cols[0]), bool)
                            null[len(null) - 1 :] = not low
                            yield pa.RecordBatch.from_arrays(
                                [pa.array(np.full(len(null), name)), pa.array(cols[0], pa.int64(), mask=null), pa.array(cols[1]), pa.array(cols[2])], schema=arrow
                            )

    kept = pictures.where(F.col(id_col).isNotNull() & F.col(content_col).isNotNull())
    return arrow_map(kept.select(F.col(id_col).alias("id"), content_col), run, schema)


def unpacked(g: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """x, y, log2 of the scale and turn (in radians) of packed corners."""
    octaves = (g >> 8 & 0xFF).astype(np.int8)
    return (g >> 36) / 4.0, (g >> 16 & 0xFFFFF) / 4.0, octaves / 8.0, (g & 0xFF) * (2 * np.pi / 256)


def agreeing(ga: np.ndarray, gb: np.ndarray, ha: np.ndarray, hb: np.ndarray) -> tuple[np.ndarray, ...]:
    """(whether they agree, log2 of the growth, turn, shift x, shift y) of doublets (ga, gb) and (ha, hb).

    The line between the corners gives growth and turn; both corners' own scales and turns have to say the same.
    """
    (xa, ya, sa, ta), (xb, yb, sb, tb) = unpacked(ga), unpacked(gb)
    (ua, va, ra, pa_), (ub, vb, rb, pb) = unpacked(ha), unpacked(hb)
    dx, dy, ex, ey = xb - xa, yb - ya, ub - ua, vb - va
    with np.errstate(divide="ignore", invalid="ignore"):
        grow = np.log2(np.hypot(dx, dy) / np.hypot(ex, ey))
    turn = np.arctan2(dy, dx) - np.arctan2(ey, ex)

    def off(angle):
        return np.abs((angle + np.pi) % (2 * np.pi) - np.pi)

    ok = (np.abs(grow - (sa - ra)) <= MAX_GROW) & (off(turn - (ta - pa_)) <= MAX_TURN) & (off(turn - (tb - pb)) <= MAX_TURN)
    ratio = np.exp2(np.where(ok, grow, 0))
    mx, my, nx, ny = (xa + xb) / 2, (ya + yb) / 2, (ua + ub) / 2, (va + vb) / 2
    shift_x = mx - ratio * (np.cos(turn) * nx - np.sin(turn) * ny)
    shift_y = my - ratio * (np.sin(turn) * nx + np.cos(turn) * ny)
    return ok, grow, turn, shift_x, shift_y


MATCH = "a long, b long, ga long, gb long, grow float, turn float, sx float, sy float"
_MATCH = pa.schema([(n, pa.int64()) for n in ("a", "b", "ga", "gb")] + [(n, pa.float32()) for n in ("grow", "turn", "sx", "sy")])


def _matches(a, b, ga, gb, ha, hb) -> pa.Table:
    """MATCH rows of candidate doublets of pictures a and b that agree."""
    ok, *found = agreeing(ga, gb, ha, hb)
    cols = [c[ok] for c in (a, b, ga, gb)] + [f[ok].astype(np.float32) for f in found]
    return pa.table([pa.array(c, f.type) for c, f in zip(cols, _MATCH)], schema=_MATCH)


def _grouped(rows: DataFrame, keys: list[str], run, schema: str) -> DataFrame:
    """``run`` of tables that hold whole groups of equal keys, in order; a task holds a batch and the group at its end."""

    def stream(batches):
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            cols = [held.column(k).to_numpy() for k in keys]
            edges = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) if held.num_rows > 1 else []
            if len(edges):
                cut = int(edges[-1]) + 1
                yield from run(held.slice(0, cut)).to_batches()
                held = held.slice(cut)
        if held is not None and held.num_rows:
            yield from run(held).to_batches()

    return arrow_map(rows.repartition(*keys).sortWithinPartitions(*keys), stream, schema)


def _agreed(table: pa.Table) -> pa.Table:
    """(a, b) of the pairs of pictures, whose matches are whole and in order, of which MIN_VOTES corners agree."""
    a, b, ga, gb, grow, turn, sx, sy = (table.column(n).to_numpy() for n in _MATCH.names)
    pair = np.cumsum(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))[: len(a)]) - 1
    some = np.bincount(pair)[pair] >= -(-MIN_VOTES // 2) if len(a) else np.zeros(0, bool)  # a doublet has two corners
    pair, ga, gb, grow, turn, sx, sy = (v[some] for v in (pair, ga, gb, grow, turn, sx, sy))
    found = np.zeros(0, np.int64)
    corner, of = np.concatenate([ga >> 16, gb >> 16]), np.concatenate([pair, pair])
    turns = turn / (2 * np.pi) % 1.0 * TURN_CELLS
    # two grids for each number, half a cell apart, so that no cell border splits an agreement
    for bits in range(16):
        up, t, i, j = (bits >> k & 1 for k in range(4))
        cells = np.floor(grow * 2 + up / 2), np.floor(turns + t / 2) % TURN_CELLS, np.floor(sx / CELL + i / 2), np.floor(sy / CELL + j / 2)
        cols = [corner, *(np.concatenate([c, c]) for c in cells), of]
        order = np.lexsort(cols)
        cols = [c[order] for c in cols]
        if not len(order):
            break
        fresh = np.append(True, np.any([c[1:] != c[:-1] for c in cols[1:]], axis=0))  # the first of its cell
        other = fresh | np.append(True, cols[0][1:] != cols[0][:-1])  # a corner that its cell has not had
        votes = np.bincount(np.cumsum(fresh) - 1, other)
        found = np.union1d(found, cols[-1][fresh][votes >= MIN_VOTES])
    first = np.searchsorted(np.cumsum(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))[: len(a)]) - 1, found)
    return pa.table({"a": pa.array(a[first], pa.int64()), "b": pa.array(b[first], pa.int64())})


def _votes(matches: DataFrame) -> DataFrame:
    """(a, b) pairs of pictures of which MIN_VOTES corners agree on growth, turn and shift."""
    return _grouped(matches, ["a", "b"], _agreed, "a long, b long")


def _agreeing(candidates: DataFrame) -> DataFrame:
    """MATCH rows of the candidates (a, b and two doublets) that agree; a narrow map."""

    def run(batches):
        for batch in batches:
            yield from _matches(*(c.to_numpy(zero_copy_only=False) for c in batch.columns)).to_batches()

    return arrow_map(candidates, run, MATCH)


def _celled(rows: DataFrame) -> DataFrame:
    """Rows of buckets in the cells where doublets that can agree meet: a row for its own cell and each it is a guest of.

    Doublets agree if three numbers of theirs do: the line's length by the scale, and its direction by the turn of either
    corner. Cells are twice as wide as those may differ. A doublet is in the cell of its number, and if it lies near the lower
    border a guest (a bit of ``guest`` for each number) of the one below too; two of which one is no guest meet in one cell.
    """
    tails = "tail" in rows.columns
    made = schema_of("key long, cell int, guest int, id long, root long, ga long, gb long" + ", tail binary" * tails)
    arrow = to_arrow_schema(made)

    def run(batches):
        for batch in batches:
            key, name, root, ga, gb = (batch.column(n).to_numpy() for n in ("key", "id", "root", "ga", "gb"))
            (xa, ya, scale, ta), (xb, yb, _, tb) = unpacked(ga), unpacked(gb)
            with np.errstate(divide="ignore"):
                length = np.log2(np.hypot(xb - xa, yb - ya)) - scale
            line = np.arctan2(yb - ya, xb - xa)
            fit = np.isfinite(length)  # others agree with none
            places = [np.where(fit, length, 0) / (2 * MAX_GROW), *((line - t) % (2 * np.pi) / (2 * np.pi) * AGREE_CELLS for t in (ta, tb))]
            near = [0.5, MAX_TURN * AGREE_CELLS / (2 * np.pi), MAX_TURN * AGREE_CELLS / (2 * np.pi)]
            for guest in range(8):
                here, cell = fit.copy(), np.zeros(len(key), np.int64)
                for k, (place, width) in enumerate(zip(places, near)):
                    own = np.floor(place).astype(np.int64)
                    if guest >> k & 1:
                        here &= place - own <= width + 1e-6
                        own = own - 1
                    cell = cell * AGREE_CELLS + (own % AGREE_CELLS if k else own + 64)
                cols = [key, cell.astype(np.int32), np.full(len(key), guest, np.int32), name, root, ga, gb]
                tail = [batch.column("tail").filter(pa.array(here))] if tails else []
                yield pa.RecordBatch.from_arrays([pa.array(c[here]) for c in cols] + tail, schema=arrow)

    return arrow_map(rows, run, made)


def _numbers(ga: np.ndarray, gb: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The three numbers of doublets that agree if these do: the line's length by the scale, its direction by either corner's turn."""
    (xa, ya, scale, ta), (xb, yb, _, tb) = unpacked(ga), unpacked(gb)
    with np.errstate(divide="ignore"):
        length = np.log2(np.hypot(xb - xa, yb - ya)) - scale
    line = np.arctan2(yb - ya, xb - xa)
    return length.astype(np.float32), ((line - ta) % (2 * np.pi)).astype(np.float32), ((line - tb) % (2 * np.pi)).astype(np.float32)


def _tails(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, tokens) of a binary column of tokens; the length of a null is -1."""
    column = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) and column.num_chunks else column
    null = column.is_null().to_numpy(**({} if isinstance(column, pa.ChunkedArray) else {"zero_copy_only": False}))
    data = None if isinstance(column, pa.ChunkedArray) else column.buffers()[2]
    if data is None or not data.size:
        none = np.zeros(len(column), np.int64)
        return none, none - null, np.zeros(1, np.uint32)
    edges = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) // 4
    return edges[:-1], np.where(null, -1, np.diff(edges)), np.frombuffer(data, np.uint32, data.size // 4)


def _tokens(keys: np.ndarray, ga: np.ndarray, gb: np.ndarray) -> np.ndarray:
    """32 bits of each entry: 14 of its key, then the numbers that have to agree by cells of which agreeing ones are two apart at most."""
    length, one, two = _numbers(ga, gb)
    length = np.clip(np.nan_to_num(np.floor(length / 0.16), neginf=0).astype(np.int64) + 16, 0, 63)
    one, two = (np.minimum(n * (64 / (2 * np.pi)), 63).astype(np.int64) for n in (one, two))
    return ((keys.view(np.uint64) % np.uint64(16382)).astype(np.int64) << 18 | length << 12 | one << 6 | two).astype(np.uint32)


def _in_common(one: tuple, other: tuple, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many entries of row x of ``one`` may agree with some of row y of ``other``, by the tokens that _tails gave;
    MOST_LISTED where either is null."""
    out = np.full(len(x), MOST_LISTED, np.int64)
    width = np.maximum(one[1][x], other[1][y])
    order = np.flatnonzero((one[1][x] >= 0) & (other[1][y] >= 0))
    order = order[np.argsort(width[order], kind="stable")]
    at = 0
    while at < len(order):
        # rows of about the same width, of some millions of comparisons in all
        some = order[at : at + max(1, (1 << 21) // max(1, int(width[order[at]]) ** 2))]
        some = some[width[some] <= max(8, width[some[0]] * 5 // 4)]
        at += len(some)
        wide = np.arange(max(1, int(width[some].max())))
        cols = []
        for (start, size, tokens), rows, rest in ((one, x[some], 16382), (other, y[some], 16383)):
            got = tokens[np.minimum(start[rows][:, None] + wide, len(tokens) - 1)]
            cols.append((got, np.where(wide < size[rows][:, None], got >> 18, rest).astype(np.uint16)))  # the rest is no token
        (p, kp), (q, kq) = cols
        row, i, j = np.unravel_index(np.flatnonzero(kp[:, :, None] == kq[:, None, :]), (len(some), len(wide), len(wide)))
        p, q = p[row, i].astype(np.int32), q[row, j].astype(np.int32)
        turns = [np.abs((p >> k & 63) - (q >> k & 63)) for k in (6, 0)]
        ok = (np.abs((p >> 12 & 63) - (q >> 12 & 63)) <= 2) & (np.minimum(turns[0], 64 - turns[0]) <= 2) & (np.minimum(turns[1], 64 - turns[1]) <= 2)
        out[some] = np.bincount(np.unique(row[ok] * len(wide) + i[ok]) // len(wide), minlength=len(some))
    return out


def _block_matches(group: pa.Table, enough: int = 1) -> pa.Table:
    """Matches between two blocks of a bucket or cell, or within one, of pictures that are not linked yet and can have ``enough``."""
    name, root, guest, ga, gb, i, j, own = (group.column(n).to_numpy() for n in ("id", "root", "guest", "ga", "gb", "i", "j", "own"))
    u, v = np.nonzero(own == i)[0], np.nonzero(own == j)[0]
    numbers = _numbers(ga, gb)
    tails = _tails(group.column("tail")) if enough > 1 else None
    out = [_MATCH.empty_table()]
    for low in range(0, len(u), 64):
        some = u[low : low + 64]
        with np.errstate(invalid="ignore"):
            meets = np.abs(numbers[0][some][:, None] - numbers[0][v]) <= MAX_GROW + 1e-4
            for n in numbers[1:]:
                apart = np.abs(n[some][:, None] - n[v])
                meets &= np.minimum(apart, np.float32(2 * np.pi) - apart) <= MAX_TURN + 1e-4
        meets &= (root[some][:, None] != root[v][None, :]) & (guest[some][:, None] & guest[v][None, :] == 0)
        # blocks meet once, so both orders of ids are due; within a block each pair has both
        meets &= (name[some][:, None] < name[v][None, :]) if i[0] == j[0] else (name[some][:, None] != name[v][None, :])
        x, y = np.nonzero(meets)
        x, y = u[low + x], v[y]
        x, y = np.where(name[x] < name[y], x, y), np.where(name[x] < name[y], y, x)
        out.append(_hopeful(name, ga, gb, tails, x, y, enough))
    return pa.concat_tables(out)


def _hopeful(name, ga, gb, tails, x, y, enough: int) -> pa.Table:
    """Matches of rows x and y, without those of two pictures that cannot have ``enough`` from their tails."""
    if enough > 1 and len(x):
        ok = agreeing(ga[x], gb[x], ga[y], gb[y])[0]
        x, y = x[ok], y[ok]
        ok = _in_common(tails, tails, x, y) >= enough
        x, y = x[ok], y[ok]
    return _matches(name[x], name[y], ga[x], gb[x], ga[y], gb[y])


PACKED = "id long, root long, closed boolean, tokens binary, keys binary, sizes binary, ga binary, gb binary"


def _packed(rows: DataFrame) -> DataFrame:
    """One row for each picture with its entries in order of the size and key of their buckets; several that are not ``closed``
    for a picture of more than MOST_LISTED."""
    arrow = to_arrow_schema(schema_of(PACKED))

    def run(table: pa.Table) -> pa.Table:
        cols = [table.column(n).to_numpy() for n in ("id", "size", "key", "root", "ga", "gb")]
        order = np.lexsort(cols[2::-1])
        name, size, key, root, ga, gb = (c[order] for c in cols)
        token, out = _tokens(key, ga, gb), []
        edges = np.flatnonzero(np.append(True, name[1:] != name[:-1])[: len(name)])
        for a, z in zip(edges.tolist(), [*edges[1:].tolist(), len(name)]):
            for at in range(a, z, MOST_LISTED):
                part = slice(at, min(z, at + MOST_LISTED))
                out.append((name[a], root[a], z - a <= MOST_LISTED, *(c[part].tobytes() for c in (token, key, size, ga, gb))))
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*out), arrow)], schema=arrow) if out else arrow.empty_table()

    return _grouped(rows, ["id"], run, PACKED)


def _spread(packed: DataFrame) -> DataFrame:
    """The entries of pictures again, each with its ``tail``: tokens of those of its picture from its own bucket on in their order."""
    made = schema_of("key long, size long, id long, root long, ga long, gb long, tail binary")
    arrow = to_arrow_schema(made)

    def run(batches):
        for part in slices(batches):
            names, roots, closed, tokens, *packs = (c.to_pylist() for c in part.columns)
            keys, sizes, ga, gb = (np.frombuffer(b"".join(p), np.int64) for p in packs)
            counts = [len(k) // 8 for k in packs[0]]
            tails, at = [], 0
            for n, whole, token in zip(counts, closed, tokens):
                own = keys[at : at + n]
                first = np.maximum.accumulate(np.where(np.append(True, own[1:] != own[:-1]), np.arange(n), 0)).tolist()
                tails += [token[4 * k :] for k in first] if whole else [None] * n
                at += n
            cols = [keys, sizes, np.repeat(names, counts), np.repeat(roots, counts), ga, gb, tails]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, arrow)], schema=arrow)

    return arrow_map(packed.select("id", "root", "closed", "tokens", "keys", "sizes", "ga", "gb"), run, made)


def _completed(found: DataFrame, packed: DataFrame, enough: int) -> DataFrame:
    """``found`` and the matches in frequent buckets of its pairs of pictures that can have ``enough`` with them."""
    listed = packed.where("closed")
    small = listed.count() <= SENT_CONTENTS
    tokens = listed.select("id", "tokens")
    sent = F.broadcast(tokens) if small else tokens
    one, two = (sent.select(F.col("id").alias(c), F.col("tokens").alias(f"of_{c}")) for c in ("a", "b"))

    def can(batches):
        for batch in batches:
            x = np.arange(batch.num_rows)
            shared = _in_common(_tails(batch.column(3)), _tails(batch.column(4)), x, x)
            ok = pa.array((shared > 0) & (shared + batch.column(2).to_numpy() >= enough))
            yield batch.select([0, 1]).filter(ok)

    pairs = saved(found.groupBy("a", "b").agg(F.count("*").alias("n")))
    able = saved(arrow_map(pairs.join(one, "a").join(two, "b").select("a", "b", "n", "of_a", "of_b"), can, "a long, b long"))
    dropped(pairs)
    whole = listed.select("id", "keys", "ga", "gb")
    one, two = (whole.select(F.col("id").alias(c), *(F.col(n).alias(f"{n}_{c}") for n in ("keys", "ga", "gb"))) for c in ("a", "b"))

    def meet(batches):
        for part in slices(batches):
            out = [[] for _ in range(6)]
            for a, b, *packs in zip(*(c.to_pylist() for c in part.columns)):
                keys, ga, gb, others, ha, hb = (np.frombuffer(p, np.int64) for p in packs)
                x, y = np.nonzero(keys[:, None] == others)
                for held, more in zip(out, (np.full(len(x), a), np.full(len(x), b), ga[x], gb[x], ha[y], hb[y])):
                    held.append(more)
            if out[0]:
                yield from _matches(*(np.concatenate(v) for v in out)).to_batches()

    joined = able.join(one, "a").join(two, "b").select("a", "b", "keys_a", "ga_a", "gb_a", "keys_b", "ga_b", "gb_b")
    return found.unionByName(arrow_map(joined, meet, MATCH))


def _rest_matches(entries: DataFrame, roots: DataFrame, block: int, enough: int = 1) -> DataFrame:
    """MATCH rows of every pair in a bucket whose pictures ``roots`` does not join already; ``entries`` are used up.

    Pairs of pictures that have fewer than ``enough`` matches may be left out, and matches may come twice if it is above 1.
    Most pairs meet by chance in one bucket alone, and they grow with the square of the pictures: so matches in
    frequent buckets are given only where what their pictures have in common from that bucket on, in the order of size, is
    enough; those of rare buckets are given all, and complete each other's pairs.
    """
    small = F.broadcast(roots) if roots.count() <= SENT_CONTENTS else roots
    rooted = saved(entries.join(small, F.col("id") == F.col("node"), "left").select("key", "id", "ga", "gb", F.coalesce("root", "id").alias("root")))
    dropped(entries)  # nothing reads them any more
    shared = saved(rooted.groupBy("key").agg(F.count("*").alias("size"), F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("key", "size"))
    sized = saved(rooted.join(F.broadcast(shared) if shared.count() <= SENT_KEYS else shared, "key"))
    dropped(rooted)
    packed = None
    rows = sized.withColumn("tail", F.lit(None).cast("binary"))
    if enough > 1:
        packed = saved(_packed(sized.where(F.col("size") > RARE)))
        rows = rows.where(F.col("size") <= RARE).unionByName(_spread(packed))

    def compare_few(table: pa.Table) -> pa.Table:
        key, name, root, ga, gb = (table.column(n).to_numpy() for n in ("key", "id", "root", "ga", "gb"))
        tails = _tails(table.column("tail")) if enough > 1 else None
        out = [_MATCH.empty_table()]
        for step in range(1, FEW):  # each row with the one so many places behind it
            x = np.flatnonzero((key[:-step] == key[step:]) & (root[:-step] != root[step:])) if step < len(key) else []
            if len(x):
                low, high = np.where(name[x] < name[x + step], x, x + step), np.where(name[x] < name[x + step], x + step, x)
                out.append(_hopeful(name, ga, gb, tails, low, high, enough))
        return pa.concat_tables(out)

    def in_blocks(table: pa.Table) -> pa.Table:
        key, cell = (table.column(n).to_numpy() for n in ("key", "cell"))
        edges = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (cell[1:] != cell[:-1]))[: len(key)])
        return pa.concat_tables([_MATCH.empty_table(), *(_block_matches(table.slice(a, z - a), enough) for a, z in zip(edges, [*edges[1:], len(key)]))])

    def compare(table: pa.Table) -> pa.Table:
        few = table.column("size").to_numpy() <= FEW
        large = table.filter(pa.array(~few))
        for name in ("cell", "guest", "i", "j", "own"):
            large = large.append_column(name, pa.array(np.zeros(large.num_rows, np.int64)))
        return pa.concat_tables([compare_few(table.filter(pa.array(few))), in_blocks(large)])

    whole = _grouped(rows.where(F.col("size") <= max(FEW, block)), ["key"], compare, MATCH)
    # a bucket that is too large for a task is cut into cells of doublets that can agree, and a cell that is large even then into
    # blocks, each of which meets itself and every other block once
    celled = saved(_celled(rows.where(F.col("size") > max(FEW, block)).select("key", "id", "root", "ga", "gb", "tail")))
    cells = celled.groupBy("key", "cell").agg(F.count("*").alias("size"), F.min("root").alias("low"), F.max("root").alias("high"))
    met = saved(cells.where("low < high").select(F.col("key").alias("of"), F.col("cell").alias("at"), "size"))
    small = F.broadcast(met) if met.count() <= SENT_KEYS else met
    celled = celled.join(small, (F.col("key") == F.col("of")) & (F.col("cell") == F.col("at"))).drop("of", "at")
    entry = ["guest", "id", "root", "ga", "gb", "tail"]
    alone = celled.where(F.col("size") <= block).select("key", "cell", F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("own"), *entry)
    many = celled.where(F.col("size") > block).withColumn("blocks", F.ceil(F.col("size") / block).cast("int"))
    many = many.withColumn("own", F.pmod(F.xxhash64("id", "ga", "gb"), F.col("blocks")).cast("int"))
    dealt = many.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "key", "cell", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", *entry
    )
    met = _grouped(alone, ["key", "cell"], in_blocks, MATCH)
    dealt = dealt.groupBy("key", "cell", "i", "j").applyInArrow(lambda group: _block_matches(group, enough), MATCH)
    found = whole.unionByName(met).unionByName(dealt)
    return found if packed is None else _completed(saved(found), packed, enough)


def links(found: DataFrame, block: int = BLOCK, spent: bool = False) -> DataFrame:
    """(u, v) links whose closure is that of all pairs of pictures with geometric consensus.

    ``spent`` tells that the table ``found`` may be deleted as soon as it is not needed here.
    """
    shared = saved(
        found.where("key is not null").groupBy("key").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least < most").select("key", "least")
    )
    # few shared keys go to the entries, most of which need no shuffle then; else two written tables, so a hot key is split
    entries = saved(found.join(F.broadcast(shared) if shared.count() <= SENT_KEYS else shared, "key"))
    if spent:
        dropped(found)
    # first every picture with the first one of its buckets: some of all links, at linear cost
    firsts = entries.where("id = least").select("key", F.col("id").alias("a"), F.col("ga").alias("ra"), F.col("gb").alias("rb"))
    met = entries.where("id > least").join(firsts, "key").select("a", "id", "ra", "rb", "ga", "gb")
    linked = saved(_votes(saved(_agreeing(met))))
    roots = saved(components(linked.select(F.col("a").alias("u"), F.col("b").alias("v"))))
    rest = _votes(saved(_rest_matches(entries, roots, block, -(-MIN_VOTES // 2))))  # a doublet has two corners
    return linked.unionByName(rest).select(F.col("a").alias("u"), F.col("b").alias("v"))


def classes(pictures: DataFrame, id_col: str = "id", content_col: str = "content") -> DataFrame:
    """(id, class_id, members, n_corners) of every picture with an id; class_id is the smallest id linked."""
    rows = pictures.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(content_col).alias("content"))
    rows = rows.withColumn("digest", F.unhex(F.coalesce(F.sha2("content", 256), F.sha2(F.concat(F.lit("null:"), F.col("id").cast("string")).cast("binary"), 256))))
    digests = saved(rows.select("id", "digest"))
    # each content is a node, whatever ids it has; its number comes from its digest, so that a pair is compared the same way round
    # in every run, and a task that is run again makes the same rows
    nodes = saved(digests.groupBy("digest").agg(F.min("id").alias("rep")).withColumn("node", F.xxhash64("digest")))
    small = nodes.count() <= SENT_CONTENTS
    first = (F.broadcast(nodes) if small else nodes).withColumnRenamed("digest", "of")
    found = saved(corners(rows.join(first, (F.col("digest") == F.col("of")) & (F.col("id") == F.col("rep"))).select("node", "content"), "node"))
    counts = saved(found.where("key is null").select(F.col("id").alias("counted"), F.col("ga").alias("n_corners")).distinct())
    roots = saved(components(links(found, spent=True)).withColumnRenamed("node", "member"))
    known = nodes.join(roots, F.col("node") == F.col("member"), "left").join(counts, F.col("node") == F.col("counted"), "left")
    known = saved(known.select("digest", F.coalesce("root", "node").alias("root"), F.coalesce("n_corners", F.lit(0)).cast("long").alias("n_corners")))
    whole = saved(digests.join(known, "digest").select("id", "root", "n_corners"))
    sizes = saved(whole.groupBy("root").agg(F.min("id").alias("class_id"), F.count("*").alias("members")))
    return whole.join(sizes, "root").select("id", "class_id", "members", "n_corners")


def from_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of picture files that the JVM reads (JPEG, PNG, GIF, BMP), as PPM or PGM bytes."""
    schema = schema_of("path string, content binary")

    def run(paths, heights, widths, channels, data):
        out = []
        for h, w, n, raw in zip(heights, widths, channels, data):
            px = np.frombuffer(raw, np.uint8).reshape(h, w, n)
            out.append(b"P5 %d %d 255\n" % (w, h) + px[:, :, 0].tobytes() if n == 1 else b"P6 %d %d 255\n" % (w, h) + px[:, :, 2::-1].tobytes())
        return {"path": paths, "content": out}

    image = spark.read.format("image").option("dropInvalid", True).load(path)
    return map_docs(image, ["image.origin", "image.height", "image.width", "image.nChannels", "image.data"], run, schema)


def draw_vector(vector, side: int = 64) -> bytes | None:
    """A vector as a PGM picture: its numbers as a square of grey levels, enlarged smoothly."""
    if not vector or any(v is None for v in vector):
        return None
    a = np.asarray(vector, np.float32)
    n = int(np.ceil(np.sqrt(len(a))))
    a = np.resize(np.nan_to_num(a), n * n).reshape(1, n, n)
    low, high = float(a.min()), float(a.max())
    grey = _resize((a - low) * (255 / (high - low)) if high > low else a * 0, side, side)[0]
    return b"P5 %d %d 255\n" % (side, side) + np.uint8(np.clip(grey, 0, 255)).tobytes()


def cropped_copy(content: bytes | None, left: int = 6, top: int = 4, keep: float = 0.85, gain: float = 0.8, lift: float = 30.0) -> bytes | None:
    """An edited copy of a picture: a part of it, with other brightness and contrast."""
    grey = read_picture(content)
    if grey is None:
        return None
    h, w = int(grey.shape[0] * keep), int(grey.shape[1] * keep)
    part = np.uint8(np.clip(grey[top : top + h, left : left + w] * gain + lift, 0, 255))
    return b"P5 %d %d 255\n" % (part.shape[1], part.shape[0]) + part.tobytes()
