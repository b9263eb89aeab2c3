"""An adaptive context-mixing range coder for token ids, in independent blocks.

Every block starts from a reset model. Its head lists its distinct ids; an id is
coded by its rank among them. Three models predict the next rank: order 0, the
counts of the ranks so far; order 1, the rank that followed the last one; order
2, the one that followed the last two. Order 1 and 2 keep for each context a
rank and how sure it is; how often ranks of that sureness have been right is
the model's belief in it, and the rest of its belief is order 0's. The three are
mixed with weights, P(x) = w0 P0(x) + w1 P1(x) + w2 P2(x), which follow each model's
share in the probability of the ids that came (expectation and maximisation),
apart for when the two ranks agree and when they do not. The contexts' ranks
change after every stretch of ids; beliefs, weights and order 0 are renewed from
the counts less often, the first times sooner. The mixture is coded as nested
shares of one interval.

The range coder works in 63 bits and puts out digits of 32 bits, at most one an
id; carries are settled once, at a block's end. Blocks are coded in lockstep: a
step takes the next id of all blocks with array operations. Writing and reading
run the same model steps, whose floating-point operations are elementwise and so
the same everywhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

BLOCK = 4096
#: Shares of the outcomes, and of the ranks in order 0, in bits.
OUT_BITS, RANK_BITS = 16, 13
SCALE = OUT_BITS + RANK_BITS
_ONE = 1 << OUT_BITS
#: The coder's whole range, and the least that leaves each share a part of it: both as 64 bits without sign, like all its arrays.
U = np.uint64
_WHOLE, _LEAST, _SCALE = (np.array(x, U) for x in (1 << 63, 1 << 31, SCALE))
_LOW31, _LOW32, _BITS31, _BITS32 = (np.array(x, U) for x in ((1 << 31) - 1, (1 << 32) - 1, 31, 32))
#: Contexts of order 2 in a block, and degrees of sureness.
SLOTS, SURE = 1024, 4
#: An entry is a rank in its low bits, and the sureness above. Constants of the steps are arrays, which numpy need not convert each time.
_ENTRY = np.array(BLOCK.bit_length() - 1, np.int16)
_RANK, _STEP, _TOP = (np.array(x, np.int16) for x in ((1 << _ENTRY) - 1, 1 << _ENTRY, SURE - 1 << _ENTRY))
#: Factors of a context's last two ranks; only the slot's bits of the products count, which 16 bits hold.
_MIX1, _MIX2, _SLOT = (np.array(x, np.int16) for x in (40503 % SLOTS, 30029 % SLOTS, SLOTS - 1))
_SURE1, _SURE2 = (np.array(x, np.int16) for x in (2 * SURE, 2))
#: Parts of the list of a block's distinct ids, each with its own number of low bits.
_PARTS = 8
#: Ids under this are looked up in a table of all of them.
_WIDE = 1 << 22
#: Ids after which the contexts' ranks change, and places in a block at which beliefs and weights, and order 0, are renewed.
STRETCH = 32
SHARES_EARLY, SHARES_EVERY = (32, 64, 128), 256
ORDER0_EARLY, ORDER0_EVERY = (16, 64, 128, 256), 512
_CELLS = 2 * SURE * SURE


def _stretches(steps: int, short: int) -> Iterator[tuple[int, int, bool, bool]]:
    """Stretches of steps (also parted where the last block ends), and whether order 0 and the shares are renewed after them."""
    order0 = {*ORDER0_EARLY, *range(ORDER0_EVERY, steps, ORDER0_EVERY)}
    shares = {*SHARES_EARLY, *range(SHARES_EVERY, steps, SHARES_EVERY)}
    at = sorted(t for t in {*range(STRETCH, steps, STRETCH), *order0, *shares, short, steps} if t <= steps)
    for begin, end in zip([0, *at], at, strict=False):
        yield begin, end, end in order0, end in shares


class Model:
    """n blocks; ranks: how many each has."""

    def __init__(self, ranks: np.ndarray):
        n = len(ranks)
        self.n, self.ranks, self.width = n, ranks, int(ranks.max(initial=1)) + 1
        rows = np.arange(n)
        # Narrow tables, touched at random in every step: order 1's contexts, then order 2's.
        self.table = np.zeros(n * (self.width + SLOTS), np.int16)
        self.one, self.two = self.table[: n * self.width], self.table[n * self.width :]
        self.row0, self.row2, self.row_c = rows * self.width, n * self.width + rows * SLOTS, rows * _CELLS
        # Where each block's ends in order 0, and its counts, begin.
        self.first = rows * (self.width + 1)
        self.new_cells: list[np.ndarray] = []
        self.new_ranks: list[np.ndarray] = []
        self.counts = np.zeros((n, self.width + 1), np.int32)
        self.counts[np.arange(self.width + 1)[None, :] < ranks[:, None]] = 1
        # How often: by cell (sureness of order 1 and 2, agreement) and outcome (neither, order 1, order 2); the blocks come last, next to each other.
        self.came = np.zeros((SURE, SURE, 2, 3, n))
        self.weights = np.full((3, 2, n), 1 / 3)
        self.renew_shares()
        self.renew_order0(np.zeros(0, np.int64))

    def renew_shares(self, cells: np.ndarray | None = None) -> None:
        """Beliefs and weights from what came since, and from them the shares of the two ranks in each cell."""
        if cells is not None:
            self.came += np.bincount(cells, minlength=self.n * _CELLS * 3).reshape(self.n, -1).T.reshape(self.came.shape)
        came, apart = self.came, self.came[:, :, 0]
        both = came[:, :, 1, 2]  # the ranks agree, and were right
        prior = np.array([0.1, 1.0, 1.6, 1.9])[:, None]
        every = came.sum((2, 3))
        q1 = ((apart[:, :, 1] + both).sum(1) + prior) / (every.sum(1) + 2.0)
        q2 = ((apart[:, :, 2] + both).sum(0) + prior) / (every.sum(0) + 2.0)
        q1, q2 = q1[:, None, None], q2[None, :, None]
        w0, w1, w2 = self.weights
        if cells is not None:
            e1, e2, h1, h2 = w1 * (1 - q1), w2 * (1 - q2), w1 * q1, w2 * q2
            none = came[:, :, :, 0] / (e1 + e2 + w0)
            hit = came[:, :, :, 2] / (h1 + h2)
            hit[:, :, 0] = 0
            right1, right2 = came[:, :, :, 1].sum((0, 1)), came[:, :, :, 2].sum((0, 1))
            right2[1] = 0
            new = np.stack((1 + (none * w0).sum((0, 1)), 1 + (none * e1 + hit * h1).sum((0, 1)) + right1, 1 + (none * e2 + hit * h2).sum((0, 1)) + right2))
            self.weights = new / (new[0] + new[1] + new[2])
            w0, w1, w2 = self.weights
        s1, s2 = ((w * q * (_ONE - 1024)).astype(U) + U(8) for w, q in ((w1, q1), (w2, q2)))
        both = s1 + s2
        s2 = np.broadcast_to(s2, both.shape).copy()
        s2[:, :, 1] = both[:, :, 1]  # the one rank has both shares
        # One entry a cell: order 2's share, and above it both together.
        pair = (both << U(32 + RANK_BITS)) | (s2 << U(RANK_BITS))
        self.pair = np.ascontiguousarray(pair.reshape(_CELLS, -1).T).ravel()

    def renew_order0(self, new: np.ndarray) -> None:
        """Order 0's shares from the counts, with the places (first + rank) that came: ends of the ranks' shares, each at least one."""
        np.add.at(self.counts.reshape(-1), new, np.int32(16))
        ends = np.zeros((self.n, self.width + 1), np.int16)
        upto = np.arange(1, self.width + 1)
        for i in range(0, self.n, 64):  # some blocks at a time
            own = self.ranks[i : i + 64]
            sums = np.cumsum(self.counts[i : i + 64, :-1], axis=1, dtype=np.int32)
            free = ((1 << RANK_BITS) - own) / sums[:, -1]
            ends[i : i + 64, 1:] = (sums * free[:, None]).astype(np.int16) + np.minimum(upto, own[:, None])
        ends[np.arange(self.n), self.ranks] = 1 << RANK_BITS
        self.ends, self.inverse = ends.reshape(-1), None

    def _invert(self) -> None:
        """The rank whose share holds each second place."""
        self.inverse = np.empty((self.n, 1 << RANK_BITS - 1), np.int16)
        ends, every = self.ends.reshape(self.n, -1), np.arange(self.width, dtype=np.int16)
        for i in range(0, self.n, 64):
            half = ends[i : i + 64] + np.int16(1) >> 1
            widths = half[:, 1:] - half[:, :-1]
            widths[every >= self.ranks[i : i + 64, None]] = 0
            self.inverse[i : i + 64] = np.repeat(np.tile(every, len(widths)), widths.reshape(-1)).reshape(len(widths), -1)
        self.inverse = self.inverse.reshape(-1)

    def find(self, rows: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Where (first + rank) the shares are that hold the places."""
        if self.inverse is None:
            self._invert()
        at = self.first.take(rows) + self.inverse.take((rows << RANK_BITS - 1) + (place >> 1))
        at += self.ends.take(at + 1) <= place  # each share has at least one place
        return at

    def look(self, x1: np.ndarray, x2: np.ndarray, m: int) -> tuple[np.ndarray, ...]:
        """Of the first m blocks (each a row, if there are several steps), after x1 and x2: the places of order 1's and 2's entries, the entries, their ranks, and the cell."""
        at = np.empty((2, *x1.shape), np.int64)
        v, g, cell = self.look_into(at, x1, x2, m)
        return *at, *v, *g, cell

    def look_into(self, at: np.ndarray, x1: np.ndarray, x2: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same with order 1 and 2 in one array each: fills the places, and gives entries, ranks and cell."""
        own = (slice(m), None) if x1.ndim > 1 else slice(m)
        np.add(self.row0[own], x1, out=at[0])
        np.add(self.row2[own], x1 * _MIX1 + x2 * _MIX2 & _SLOT, out=at[1])
        v = self.table.take(at)
        sure = v >> _ENTRY
        g = v & _RANK
        cell = sure[0] * _SURE1
        cell += sure[1] * _SURE2
        cell += g[0] == g[1]
        return v, g, self.row_c[own] + cell

    def after(self, x: np.ndarray, at: np.ndarray, v: np.ndarray, right: np.ndarray, right1: np.ndarray, right2: np.ndarray, cells: np.ndarray, new: np.ndarray, order0: bool, shares: bool) -> None:
        """A stretch came; right: whether order 1 and 2 had the rank, right1 and right2 its halves; new: the places (first + rank) of what neither had. Renew what is due."""
        self.learn(x, at, v, right)
        outcomes = (right1 > right2) + cells * 3
        outcomes += right2 * np.int16(2)
        self.new_cells.append(outcomes.reshape(-1))
        self.new_ranks.append(new)
        if shares:
            self.renew_shares(np.concatenate(self.new_cells))
            self.new_cells = []
        if order0:
            self.renew_order0(np.concatenate(self.new_ranks))
            self.new_ranks = []

    def learn(self, x: np.ndarray, at: np.ndarray, v: np.ndarray, right: np.ndarray) -> None:
        """The ids of a stretch came: a step surer where right, else one less sure, and from the least on another rank; of several changes of one entry the last counts, whether the arrays go by blocks or by steps."""
        step = (v < _TOP) & right
        new = (step.view(np.int8) + (right.view(np.int8) - np.int8(1))) * _STEP
        new += v
        other = new ^ x
        other &= new >> np.int16(15)  # all bits, if negative
        new ^= other
        self.table[at.reshape(-1)] = new.reshape(-1)


def _alphabets(grid: np.ndarray, short: int) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """For blocks as rows: the coded lists of their distinct ids, their numbers, and the ids as ranks."""
    heads, sizes, ranks = [], np.zeros(len(grid), np.int64), np.zeros(grid.shape, np.int16)
    most = int(grid.max()) + 1
    found, place = np.zeros(most if most <= _WIDE else 0, bool), np.zeros(most if most <= _WIDE else 0, np.int16)
    numbers = np.arange(grid.shape[1], dtype=np.int16)
    for i in range(0, len(grid), _LISTS):
        some = grid[i : i + _LISTS].astype(np.int64)
        lists = []
        for j, row in enumerate(some, i):
            row = row if j < len(grid) - 1 else row[:short]
            if len(found):
                found[row] = True
                own = found.nonzero()[0]
                found[own] = False
                place[own] = numbers[: len(own)]
                back = place.take(row)
            else:
                own, back = np.unique(row, return_inverse=True)
            lists.append(own)
            sizes[j], ranks[j, : len(row)] = len(own), back
        heads += _listed(np.concatenate(lists), sizes[i : i + _LISTS])
    return heads, sizes, ranks


#: Blocks whose lists are coded at once.
_LISTS = 64


def _parts(sizes: np.ndarray) -> np.ndarray:
    """How many ids of each block's list (a row) are in each part."""
    return np.diff(-(-sizes[:, None] * np.arange(_PARTS + 1) // _PARTS), axis=1)


def _places(bits: np.ndarray, sizes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where entries of so many bits begin, if each block's (so many entries) begin at its start."""
    ends = np.cumsum(bits)
    before = np.concatenate(([0], ends))[np.cumsum(sizes) - sizes]
    return ends - bits + np.repeat(starts - before, sizes)


def _listed(ids: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """Golomb-Rice code of the gaps between each block's distinct ids, in _PARTS parts: each part's low bits, all low bits, then the rest in unary.

    ids: those of some blocks, one block after another; sizes: how many each has.
    """
    firsts, parts = np.cumsum(sizes) - sizes, _parts(sizes)
    gaps = np.diff(ids, prepend=0) - 1
    gaps[firsts] = ids[firsts]
    ends = np.cumsum(parts.reshape(-1))
    sums = np.diff(np.concatenate(([0], np.cumsum(gaps)))[ends], prepend=0).reshape(parts.shape)
    low = np.floor(np.log2(np.maximum(sums / np.maximum(parts, 1) * 0.7, 1))).astype(np.int64)
    k = np.repeat(low.reshape(-1), parts.reshape(-1))
    # All blocks' low bits in one array and the rest in another, each block's from a whole byte on.
    n_low = -(-(low * parts).sum(1) // 8)
    at_low = np.cumsum(n_low) - n_low
    bits = np.zeros(8 * int(n_low.sum()), bool)
    place = _places(k, sizes, 8 * at_low)
    within = np.arange(int(k.sum())) - np.repeat(np.cumsum(k) - k, k)
    bits[np.repeat(place, k) + within] = np.repeat(gaps, k) >> np.repeat(k - 1, k) - within & 1
    rest = (gaps >> k) + 1
    n_rest = -(-np.add.reduceat(rest, firsts) // 8)
    at_rest = np.cumsum(n_rest) - n_rest
    unary = np.zeros(8 * int(n_rest.sum()), bool)
    unary[_places(rest, sizes, 8 * at_rest) + rest - 1] = True
    b, u = np.packbits(bits).tobytes(), np.packbits(unary).tobytes()
    return [bytes(h) + b[i : i + n] + u[j : j + o] for h, i, n, j, o in zip(low.tolist(), at_low.tolist(), n_low.tolist(), at_rest.tolist(), n_rest.tolist(), strict=True)]


def _unlisted(heads: list[bytes], sizes: np.ndarray) -> np.ndarray:
    """The ids of the lists, one block after another; ValueError if they are not as many as said."""
    low, parts = np.array([[*h[:_PARTS]] for h in heads]), _parts(sizes)
    k = np.repeat(low.reshape(-1), parts.reshape(-1))
    n_low = -(-(low * parts).sum(1) // 8)
    lens = np.array([len(h) for h in heads])
    place = _places(k, sizes, 8 * (np.cumsum(lens) - lens + _PARTS))
    words = np.frombuffer(b"".join([*heads, bytes(8)]), np.uint8)
    words = np.ndarray((len(words) - 7,), ">u8", words, strides=(1,))[place >> 3].astype(U)
    gaps = (words << (place & 7).astype(U) >> U(1) >> (63 - k).astype(U)).astype(np.int64)
    rests = [h[_PARTS + n :] for h, n in zip(heads, n_low.tolist(), strict=True)]
    lens = np.array([len(r) for r in rests])
    ends = np.unpackbits(np.frombuffer(b"".join(rests), np.uint8)).view(bool).nonzero()[0]
    if len(ends) != len(k):
        raise ValueError("a list is damaged")
    firsts = np.cumsum(sizes) - sizes
    rest = np.diff(ends, prepend=-1) - 1
    rest[firsts] = ends[firsts] - 8 * (np.cumsum(lens) - lens)
    gaps += rest << k
    return _places(gaps + 1, sizes, np.zeros(len(sizes), np.int64)) + gaps


def encode(ids: np.ndarray) -> list[tuple[int, bytes, bytes]]:
    """Each BLOCK ids to (number of distinct ids, their list, code); the last block may be shorter."""
    n = -(-len(ids) // BLOCK)
    if not n:
        return []
    grid = np.zeros(n * BLOCK, np.uint32)
    grid[: len(ids)] = ids
    short = len(ids) - (n - 1) * BLOCK
    heads, sizes, ranks = _alphabets(grid.reshape(n, BLOCK), short)
    ranks = np.pad(ranks, ((0, 0), (2, 0)))  # two ranks 0 before a block's first
    model = Model(sizes)
    rows = np.arange(n)
    low, rng, used = np.zeros(n, U), np.full(n, _WHOLE), np.zeros(n, np.int64)
    room = BLOCK * 3 // 8
    out = np.zeros((n, room), U)
    base = rows * room
    steps = BLOCK if n > 1 else short
    for begin, end, order0, shares_too in _stretches(steps, short):
        m = n if begin < short else n - 1
        every = ranks[:m, begin : end + 2]
        xs = every[:, 2:]
        at = np.empty((2, *xs.shape), np.int64)
        v, g, cells = model.look_into(at, every[:, 1:-1], every[:, :-2], m)
        right = xs == g
        hit1, hit2 = right
        pair = model.pair.take(cells)
        s2, s12 = pair & _LOW32, pair >> _BITS32
        starts, shares = s2 * ~hit2, np.where(hit2, s2, s12 - s2)
        new = np.flatnonzero(~(hit1 | hit2))
        places = (xs + model.first[:m, None]).take(new)
        c0 = model.ends.take(places)
        f0 = model.ends.take(places + 1) - c0
        s12 = s12.take(new)
        q = U(_ONE) - (s12 >> U(RANK_BITS))
        starts.reshape(-1)[new] = s12 + q * c0.astype(U)
        shares.reshape(-1)[new] = q * f0.astype(U)
        if int(used.max()) + STRETCH + 2 > room:  # a digit an id at most
            out = np.concatenate((out, np.zeros_like(out)), axis=1)
            room *= 2
            base = rows * room
        lo, ra, flat = low[:m], rng[:m], out.reshape(-1)
        for start, share in zip(np.ascontiguousarray(starts.T), np.ascontiguousarray(shares.T), strict=True):
            r = ra >> _SCALE
            np.multiply(r, share, out=ra)
            r *= start
            lo += r
            small = (ra < _LEAST).nonzero()[0]
            digit, to = lo.take(small), used.take(small)
            flat[base.take(small) + to] = digit >> _BITS31
            used[small] = to + 1
            lo[small] = (digit & _LOW31) << _BITS32
            ra[small] = ra.take(small) << _BITS32
        model.after(xs, at, v, right, hit1, hit2, cells, places, order0, shares_too)
    # The last digit is the first that lies in the range with zeros after it.
    out[rows, used] = (low + _LOW31) >> _BITS31
    used += 1
    code = []
    for i in range(0, n, 256):  # carries, some blocks at a time
        digits = np.ascontiguousarray(out[i : i + 256, : int(used[i : i + 256].max())].T)
        for k in range(len(digits) - 1, 0, -1):
            digits[k - 1] += digits[k] >> _BITS32
        packed = np.ascontiguousarray((digits & _LOW32).astype("<u4").T)
        code += [row[:k].tobytes() for row, k in zip(packed, used[i : i + 256], strict=True)]
    return [(int(k), h, c) for k, h, c in zip(sizes, heads, code, strict=True)]


def decode(blocks: list[tuple[int, bytes, bytes]], total: int) -> np.ndarray:
    """The ``total`` ids of blocks that hold BLOCK ids each, the last one the rest."""
    n = len(blocks)
    if not n:
        return np.zeros(0, np.uint32)
    short = total - (n - 1) * BLOCK
    sizes = np.array([b[0] for b in blocks], np.int64)
    model = Model(sizes)
    digits = np.zeros((n, max(len(b[2]) for b in blocks) // 4 + 4), np.uint32)
    for i, b in enumerate(blocks):
        digits[i, : len(b[2]) // 4] = np.frombuffer(b[2], "<u4")
    # The range has 63 bits: what follows its first two digits is off by a bit.
    off = (digits[:, 0].astype(U) << U(31)) | (digits[:, 1] >> 1)
    data = (digits[:, 1:-1] << 31) | (digits[:, 2:] >> 1)
    rows = np.arange(n)
    used, rng = rows * data.shape[1], np.full(n, _WHOLE)
    data = data.ravel()
    grid = np.zeros((BLOCK, n), np.int16)
    steps = BLOCK if n > 1 else short
    x1, x2 = np.zeros(n, np.int16), np.zeros(n, np.int16)
    for begin, end, order0, shares_too in _stretches(steps, short):
        m = n if begin < short else n - 1
        size = end - begin
        at, cells = np.empty((size, 2, m), np.int64), np.empty((size, m), np.int64)
        v, right, xs = np.empty((size, 2, m), np.int16), np.empty((size, 2, m), bool), np.empty((size, m), np.int16)
        came = []
        of, ra, x1, x2 = off[:m], rng[:m], x1[:m], x2[:m]
        for t in range(size):
            v[t], g, cell = model.look_into(at[t], x1, x2, m)
            cells[t] = cell
            r = ra >> _SCALE
            # The ends of order 2's and order 1's parts of the interval: a quotient is needed only beyond them.
            pair = model.pair.take(cell)
            end2, end1 = (pair & _LOW32) * r, (pair >> _BITS32) * r
            two = of < end2
            new = (of >= end1).nonzero()[0]
            x = np.where(two, g[1], g[0])
            end1 -= end2
            ra[:] = np.where(two, end2, end1)
            end2 *= ~two
            of -= end2
            if len(new):
                unit = (U(_ONE) - (pair.take(new) >> U(32 + RANK_BITS))) * r.take(new)
                beyond = of.take(new) - end1.take(new)
                places = model.find(new, (beyond // unit).view(np.int64))
                came.append(places)
                c0 = model.ends.take(places)
                x[new] = places - model.first.take(new)
                of[new] = beyond - unit * c0.astype(U)
                ra[new] = unit * (model.ends.take(places + 1) - c0).astype(U)
            np.equal(x, g, out=right[t])
            small = (ra < _LEAST).nonzero()[0]
            to = used.take(small)
            of[small] = (of.take(small) << _BITS32) | data.take(to)
            used[small] = to + 1
            ra[small] = ra.take(small) << _BITS32
            xs[t] = x
            x1, x2 = x, x1
        grid[begin:end, :m] = xs
        model.after(xs[:, None], at, v, right, right[:, 0], right[:, 1], cells, np.concatenate([np.zeros(0, np.int64), *came]), order0, shares_too)
    out = np.empty((n, BLOCK), np.uint32)
    for i in range(0, n, _LISTS):
        own, ranks = sizes[i : i + _LISTS], np.ascontiguousarray(grid[:, i : i + _LISTS].T)
        ids = _unlisted([b[1] for b in blocks[i : i + _LISTS]], own).astype(np.uint32)
        out[i : i + _LISTS] = ids.take(ranks + (np.cumsum(own) - own)[:, None])
    return out.ravel()[:total]
