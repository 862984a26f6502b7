"""Chunk windows as arrays: symbols of a whole batch of chunks, and their entropy coder in lanes.

A batch holds the runs of many windows of ``SIDE`` x ``SIDE`` columns in flat arrays. Symbols come from
comparisons of shifted planes, for all chunks of the batch at once. The coder keeps one state a chunk and
steps all of them together, so Python's cost is that of the longest chunk, not of their sum.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

SIDE = 34
COLUMNS = SIDE * SIDE
# Fixed values of the format.
#: Patterns by their classes from the floor up; everything else is the last.
PATTERNS = {(): 0, (1,): 1, (1, 2): 2, (1, 3): 3, (1, 4, 5): 4, (1, 8): 5, (1, 4): 6, (1, 5): 7}
EXOTIC, OUTSIDE = 8, 9
#: Symbol tables: contexts and alphabet.
PATTERN_T, SURFACE_T, SAME_T, WALL_T, RUNS_T, CLASS_T, LENGTH_T = range(7)
TABLES = [(400, 9), (175, 25), (16, 4), (1, 25), (1, 25), (14, 13), (13, 25)]
GROUP_OF_LEVEL = [0, 1, 2, 3, 4, 4, 4]
PROB_BITS = 12
PROB = 1 << PROB_BITS
LOW = 1 << 23
VERSION = 3
FIRST_CLASS = 13
#: Values below this are symbols of their own; above, there is a symbol for each power of two.
DIRECT, DIRECT_BITS = 12, 3

GROUPS = 5
_ALPHABET = np.array([a for _, a in TABLES])
#: Where a table begins in a group's numbers, and their count.
_BASE = np.concatenate(([0], np.cumsum([n * a for n, a in TABLES])))
_UP_TO_THREE = np.array([len(k) << 12 | sum(v << 4 * i for i, v in enumerate(k)) for k in PATTERNS])


@dataclass
class Runs:
    """Runs of ``n`` windows: place (window * COLUMNS + column), class and length, from the floor up."""

    n: int
    place: np.ndarray
    cls: np.ndarray
    size: np.ndarray

    def first(self) -> np.ndarray:
        """Where each place's runs begin, and their end."""
        return np.concatenate(([0], np.cumsum(np.bincount(self.place, minlength=self.n * COLUMNS))))


def _planes(flat: np.ndarray, n: int, edge: int) -> tuple[np.ndarray, ...]:
    """A value of each column: itself and its neighbours left, above, above left, above right."""
    p = np.full((n, SIDE + 1, SIDE + 2), edge, dtype=np.int64)
    p[:, 1:, 1:-1] = flat.reshape(n, SIDE, SIDE)
    return p[:, 1:, 1:-1], p[:, 1:, :-2], p[:, :-1, 1:-1], p[:, :-1, :-2], p[:, :-1, 2:]


def patterns(r: Runs) -> np.ndarray:
    """The pattern of each place; a surface or roof thicker than one cell is of the rest."""
    first = r.first()
    count = np.diff(first)
    code = np.minimum(count, 4) << 12
    top = np.ones(len(count), dtype=np.int64)
    for i in range(3):
        has = np.flatnonzero(count > i)
        code[has] |= r.cls[first[has] + i] << 4 * i
        top[has] = r.size[first[has] + i]
    order = np.argsort(_UP_TO_THREE)
    at = np.minimum(np.searchsorted(_UP_TO_THREE, code, sorter=order), len(order) - 1)
    out = np.where(_UP_TO_THREE[order[at]] == code, np.array(list(PATTERNS.values()))[order[at]], EXOTIC)
    return np.where(np.isin(out, (2, 3, 4, 5, 7)) & (top != 1), EXOTIC, out)


def median_edge(left: np.ndarray, up: np.ndarray, diag: np.ndarray) -> np.ndarray:
    return np.clip(left + up - diag, np.minimum(left, up), np.maximum(left, up))


def surface_neighbours(s: np.ndarray, z: int | None = None, x: int | None = None) -> tuple[np.ndarray, ...]:
    """Left, upper and diagonal surfaces in padded planes ``s`` (n, SIDE + 1, SIDE + 2), of one column or
    of all. In the first row and column, what is outside takes the value of the neighbour there is."""
    if z is not None:
        left, up, diag = s[:, z + 1, x], s[:, z, x + 1], s[:, z, x]
        return (left, left, left) if z == 0 else (up, up, up) if x == 0 else (left, up, diag)
    left, up, diag = s[:, 1:, :-2].copy(), s[:, :-1, 1:-1].copy(), s[:, :-1, :-2].copy()
    left[:, :, 0] = diag[:, :, 0] = up[:, :, 0]
    up[:, 0], diag[:, 0] = left[:, 0], left[:, 0]
    return left, up, diag


def surface_context(left, up, diag, pattern):
    return (np.clip(left - diag, -2, 2) + 2) * 35 + (np.clip(up - diag, -2, 2) + 2) * 7 + pattern - 1


def roof_context(left, up, pattern, pattern_left, pattern_up):
    return (left > 0) * 8 + (up > 0) * 4 + (pattern_left == pattern) * 2 + (pattern_up == pattern)


def pattern_context(left, up, diag, ahead):
    return left * 40 + up * 4 + (diag == up) * 2 + (ahead == up)


class _Steps:
    """Symbols and plain bits under sort keys: a place, then an order within its column."""

    def __init__(self) -> None:
        self.rows: list[tuple[np.ndarray, ...]] = []

    def symbol(self, place, order, table, context, sym) -> None:
        self.rows.append(np.broadcast_arrays(place, order, table, context, sym))

    def value(self, place, order, table, context, v) -> None:
        """A number: its symbol, then the bits below its leading one, the high ones apart."""
        k = np.frexp(np.maximum(v, 1).astype(np.float64))[1].astype(np.int64) - 1
        long = v >= DIRECT
        self.symbol(place, order, table, context, np.where(long, k + DIRECT - DIRECT_BITS, v))
        place, order = np.broadcast_to(place, v.shape)[long], np.broadcast_to(order, v.shape)[long]
        k, rest = k[long], v[long] - (1 << k[long])
        high = k > PROB_BITS
        self.symbol(place[high], order[high] + 1, -1, k[high] - PROB_BITS, rest[high] >> PROB_BITS)
        self.symbol(place, order + 2, -1, np.minimum(k, PROB_BITS), rest & (PROB - 1))

    def sorted(self) -> tuple[np.ndarray, ...]:
        place, order, table, context, sym = (np.concatenate([np.asarray(r[i], dtype=np.int64) for r in self.rows]) for i in range(5))
        by = np.lexsort((order, place))
        return place[by], table[by], context[by], sym[by]


def steps(r: Runs) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(place, table, context, symbol) of all windows in coding order; table -1: ``context`` plain bits
    that hold ``symbol``."""
    out, first, p = _Steps(), r.first(), patterns(r)
    count = np.diff(first)
    here, left, up, diag, ahead = _planes(p, r.n, OUTSIDE)
    places = np.arange(r.n * COLUMNS)
    out.symbol(places, 0, PATTERN_T, pattern_context(left, up, diag, ahead).ravel(), p)
    # surfaces: the ground's run; an exotic column without one has what is predicted, in raster order
    ground = np.zeros(len(p), dtype=np.int64)
    some = np.flatnonzero(count)
    ground[some] = np.where(r.cls[first[some]] == 1, r.size[first[some]], 0)
    s = np.zeros((r.n, SIDE + 1, SIDE + 2), dtype=np.int64)
    s[:, 1:, 1:-1] = ground.reshape(r.n, SIDE, SIDE)
    bare = np.flatnonzero((p == EXOTIC) & (ground == 0))
    for at in np.unique(bare % COLUMNS).tolist():
        rows, (z, x) = bare[bare % COLUMNS == at] // COLUMNS, divmod(at, SIDE)
        s[rows, z + 1, x + 1] = median_edge(*surface_neighbours(s[rows], z, x))
    sl, su, sd = surface_neighbours(s)
    known = np.flatnonzero((p > 0) & (p < EXOTIC))
    off = (s[:, 1:, 1:-1] - median_edge(sl, su, sd)).ravel()[known]
    out.value(known, 1, SURFACE_T, surface_context(sl, su, sd, here).ravel()[known], (off << 1) ^ (off >> 63))
    # roofs by the neighbours' roofs
    built = np.flatnonzero(np.isin(p, (4, 6)))
    wall = r.size[first[built] + 1]
    tops = np.zeros(len(p), dtype=np.int64)
    tops[built] = ground[built] + wall
    _, tl, tu, _, ta = _planes(tops, r.n, 0)
    near = np.stack([v.ravel()[built] for v in (tl, tu, ta)] + [tops[built]])
    pick = (near == tops[built]).argmax(axis=0)  # a column's own top is the last choice
    out.symbol(built, 4, SAME_T, roof_context(tl, tu, here, left, up).ravel()[built], pick)
    fresh = pick == 3
    out.value(built[fresh], 5, WALL_T, 0, wall[fresh] - 1)
    # the rest: plain lists of runs
    odd = np.flatnonzero(p == EXOTIC)
    out.value(odd, 1, RUNS_T, 0, count[odd] - 1)
    run = np.flatnonzero((p == EXOTIC)[r.place])
    nth = run - first[r.place[run]]
    before = np.where(nth == 0, FIRST_CLASS, r.cls[run - 1])
    out.symbol(r.place[run], 4 + 4 * nth, CLASS_T, before, r.cls[run])
    out.value(r.place[run], 5 + 4 * nth, LENGTH_T, r.cls[run], r.size[run] - 1)
    return out.sorted()


# --- tables -----------------------------------------------------------------------------------------------


def scaled(counts: np.ndarray) -> np.ndarray:
    """Rows of counts to frequencies of sum PROB, each at least 1: smoothed by a quarter and rounded half to
    even. What is over or under goes round in order of falling frequency (ties by symbol), one at a time
    and never below 1; how many rounds that takes is counted, not walked."""
    counts = np.atleast_2d(np.asarray(counts, dtype=np.float64)) + 0.25
    f = np.maximum(1, np.rint(counts / counts.sum(axis=1, keepdims=True) * PROB)).astype(np.int64)
    rank = np.argsort(np.argsort(-f, axis=1, kind="stable"), axis=1)
    rest = PROB - f.sum(axis=1, keepdims=True)
    each, more = np.divmod(np.maximum(rest, 0), f.shape[1])
    f = f + each + (rank < more)
    over = np.flatnonzero(rest[:, 0] < 0)
    for i in over.tolist():
        spare, owed = f[i] - 1, -int(rest[i, 0])
        rounds = np.arange(int(spare.max()) + 1)
        paid = np.minimum(spare[None, :], rounds[:, None]).sum(axis=1)
        full = int(np.searchsorted(paid, owed, "right")) - 1
        gives = np.minimum(spare, full)
        can = np.flatnonzero(spare > full)
        last = can[np.argsort(rank[i, can])][: owed - int(paid[full])]
        gives[last] += 1
        f[i] -= gives
    return f


class Model:
    """Frequencies and their running sums: an array (GROUPS, numbers), table after table, context after
    context; a context that was never met is uniform."""

    def __init__(self, freq: np.ndarray | None = None):
        if freq is None:
            freq = np.tile(np.concatenate([np.tile(scaled(np.zeros(a))[0], n) for n, a in TABLES]), (GROUPS, 1))
        self.freq = freq.astype(np.int64)
        self.cum = np.empty_like(self.freq)
        for (n, a), b in zip(TABLES, _BASE.tolist(), strict=False):
            part = self.freq[:, b : b + n * a].reshape(GROUPS, n, a)
            self.cum[:, b : b + n * a] = (np.cumsum(part, axis=2) - part).reshape(GROUPS, -1)

    @classmethod
    def of(cls, rows) -> Model:
        """From (grp, tid, ctx, sym, freq) of the contexts that occur: five sequences."""
        grp, tid, ctx, sym, freq = (np.asarray(v, dtype=np.int64) for v in rows)
        out = cls().freq
        out[grp, _BASE[tid] + ctx * _ALPHABET[tid] + sym] = freq
        return cls(out)

    def to_bytes(self) -> bytes:
        """All tables of all groups in order, as unsigned 16-bit numbers."""
        return self.freq.astype("<u2").tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> Model:
        return cls(np.frombuffer(raw, dtype="<u2").reshape(GROUPS, -1))


# --- coder --------------------------------------------------------------------------------------------------


def encode(r: Runs, heights: np.ndarray, groups: np.ndarray, model: Model) -> list[bytes]:
    """Each window's bytes: version, height, state, stream. All windows take their steps together, from the
    last back; what a step gives off goes to the front of the window's stream."""
    if not r.n:
        return []
    place, table, context, sym = steps(r)
    lane = place // COLUMNS
    plain = table < 0
    at = _BASE[table] + context * _ALPHABET[table] + sym
    at[plain] = 0
    f, start = model.freq[groups[lane], at], model.cum[groups[lane], at]
    f = np.where(plain, PROB >> np.where(plain, context, 0), f)
    start = np.where(plain, sym << (PROB_BITS - np.where(plain, context, 0)), start)
    end = np.searchsorted(lane, np.arange(r.n), "right")
    begin = np.searchsorted(lane, np.arange(r.n), "left")
    state = np.full(r.n, LOW, dtype=np.int64)
    given: list[tuple[np.ndarray, np.ndarray]] = []
    for back in range(1, int((end - begin).max(initial=0)) + 1):
        go = np.flatnonzero(end - back >= begin)
        i = end[go] - back
        x = state[go]
        while len(full := np.flatnonzero(x >> 8 + 23 - PROB_BITS >= f[i])):
            given.append((go[full], x[full] & 255))
            x[full] >>= 8
        q, low = np.divmod(x, f[i])
        state[go] = (q << PROB_BITS) + low + start[i]
    owner, data = (np.concatenate(v) if given else np.empty(0, np.int64) for v in (zip(*given, strict=True) if given else ((), ())))
    by = np.argsort(owner, kind="stable")
    streams = np.split(data[by].astype(np.uint8), np.cumsum(np.bincount(owner, minlength=r.n))[:-1])
    return [bytes((VERSION,)) + int(h).to_bytes(2, "little") + int(x).to_bytes(4, "little") + s[::-1].tobytes() for h, x, s in zip(heights, state, streams, strict=True)]


class _Lanes:
    """The decoder's states, one a window, and the streams that feed them."""

    def __init__(self, blobs: list[bytes], groups: np.ndarray, model: Model):
        head = np.frombuffer(b"".join(b[:7] for b in blobs), dtype=np.uint8).reshape(-1, 7).astype(np.int64)
        for v in np.unique(head[:, 0]).tolist():
            if v != VERSION:
                raise ValueError(f"chunk version {v}")
        self.heights = head[:, 1] + (head[:, 2] << 8)
        self.state = head[:, 3:] @ (1 << 8 * np.arange(4))
        self.data = np.frombuffer(b"".join(blobs) + bytes(8), dtype=np.uint8).astype(np.int64)
        size = np.array([len(b) for b in blobs])
        self.at = np.cumsum(size) - size + 7
        self.groups, self.model = groups, model

    def _advance(self, lanes: np.ndarray, f: np.ndarray, start: np.ndarray) -> None:
        x = f * (self.state[lanes] >> PROB_BITS) + (self.state[lanes] & (PROB - 1)) - start
        while len(low := np.flatnonzero(x < LOW)):
            x[low] = (x[low] << 8) + self.data[self.at[lanes[low]]]
            self.at[lanes[low]] += 1
        self.state[lanes] = x

    def symbol(self, lanes: np.ndarray, table: int, context) -> np.ndarray:
        base = _BASE[table] + np.broadcast_to(context, lanes.shape) * TABLES[table][1]
        g = self.groups[lanes]
        sums = self.model.cum[g[:, None], base[:, None] + np.arange(TABLES[table][1])]
        s = (sums <= (self.state[lanes] & (PROB - 1))[:, None]).sum(axis=1) - 1
        self._advance(lanes, self.model.freq[g, base + s], sums[np.arange(len(lanes)), s])
        return s

    def plain(self, lanes: np.ndarray, bits: np.ndarray) -> np.ndarray:
        v = (self.state[lanes] & (PROB - 1)) >> PROB_BITS - bits
        self._advance(lanes, PROB >> bits, v << PROB_BITS - bits)
        return v

    def value(self, lanes: np.ndarray, table: int, context) -> np.ndarray:
        out = self.symbol(lanes, table, context)
        long = np.flatnonzero(out >= DIRECT)
        if len(long):
            k = out[long] - DIRECT + DIRECT_BITS
            v = np.ones(len(long), dtype=np.int64)
            high = np.flatnonzero(k > PROB_BITS)
            if len(high):
                more = k[high] - PROB_BITS
                v[high] = (v[high] << more) + self.plain(lanes[long[high]], more)
            low = np.minimum(k, PROB_BITS)
            out[long] = (v << low) + self.plain(lanes[long], low)
        return out


_CLASSES = [*PATTERNS]


def decode(blobs: list[bytes], groups: np.ndarray, model: Model) -> tuple[np.ndarray, Runs]:
    """Heights and runs of the windows: column after column, all windows together."""
    n = len(blobs)
    lanes = _Lanes(blobs, groups, model)
    p = np.full((n, SIDE + 1, SIDE + 2), OUTSIDE, dtype=np.int64)
    s, tops = np.zeros_like(p), np.zeros_like(p)
    found: list[tuple[np.ndarray, ...]] = []

    def keep(rows, at, nth, cls, size):
        found.append(tuple(np.broadcast_arrays(rows * COLUMNS + at, nth, cls, size)))

    everyone = np.arange(n)
    for at in range(COLUMNS if n else 0):
        z, x = divmod(at, SIDE)
        now = lanes.symbol(everyone, PATTERN_T, pattern_context(p[:, z + 1, x], p[:, z, x + 1], p[:, z, x], p[:, z, x + 2]))
        p[:, z + 1, x + 1] = now
        near = surface_neighbours(s, z, x)
        guess = median_edge(*near)
        rows = np.flatnonzero((now > 0) & (now < EXOTIC))
        if len(rows):
            kind = now[rows]
            d = lanes.value(rows, SURFACE_T, surface_context(*(v[rows] for v in near), kind))
            s[rows, z + 1, x + 1] = guess[rows] + ((d >> 1) ^ -(d & 1))
            keep(rows, at, 0, 1, s[rows, z + 1, x + 1])
            built = rows[(kind == 4) | (kind == 6)]
            if len(built):
                choice = np.stack((tops[built, z + 1, x], tops[built, z, x + 1], tops[built, z, x + 2], np.zeros(len(built), np.int64)))
                pick = lanes.symbol(built, SAME_T, roof_context(choice[0], choice[1], now[built], p[built, z + 1, x], p[built, z, x + 1]))
                top = choice[pick, np.arange(len(built))]
                fresh = np.flatnonzero(pick == 3)
                if len(fresh):
                    top[fresh] = s[built[fresh], z + 1, x + 1] + 1 + lanes.value(built[fresh], WALL_T, 0)
                tops[built, z + 1, x + 1] = top
                keep(built, at, 1, 4, top - s[built, z + 1, x + 1])
            for v in np.unique(kind).tolist():  # the one cell on top
                if v not in (1, 6):
                    keep(rows[kind == v], at, 2, _CLASSES[v][-1], 1)
        rows = np.flatnonzero(now == EXOTIC)
        if len(rows):
            left = 1 + lanes.value(rows, RUNS_T, 0)
            before, nth = np.full(len(rows), FIRST_CLASS), 0
            while len(rows):
                cls = lanes.symbol(rows, CLASS_T, before)
                size = 1 + lanes.value(rows, LENGTH_T, cls)
                keep(rows, at, nth, cls, size)
                if nth == 0:
                    s[rows, z + 1, x + 1] = np.where(cls == 1, size, guess[rows])
                nth, go = nth + 1, left > nth + 1
                rows, before, left = rows[go], cls[go], left[go]
    place, nth, cls, size = (np.concatenate([np.asarray(f[i], dtype=np.int64) for f in found]) if found else np.empty(0, np.int64) for i in range(4))
    by = np.lexsort((nth, place))
    return lanes.heights, Runs(n, place[by], cls[by], size[by])


def cells(r: Runs) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, y, class) of the solid cells."""
    ends = np.cumsum(r.size)
    base = np.concatenate(([0], ends))[r.first()[r.place]] if len(r.place) else ends
    solid = np.flatnonzero(r.cls > 0)
    n = r.size[solid]
    y0 = (ends - r.size - base)[solid]
    inside = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    return np.repeat(r.place[solid], n), np.repeat(y0, n) + inside, np.repeat(r.cls[solid], n)
