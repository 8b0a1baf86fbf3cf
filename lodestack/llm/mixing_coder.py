"""Adaptive context mixing and range coding of ids, many independent blocks at once.

A block starts from its segment's prior and learns as it goes: order 0 is a table of counts, orders 1 and 2 each remember the id that last followed
their context and how often it was right. The three are mixed, in the logistic domain and with weights learned on the way, into the chance of
either remembered id; other ids are coded by the counts. State is in integers, so every machine decodes alike.

A block is dealt out to lanes, stretches of one length that share its model and have range coders of their own, and numpy steps through the
lanes of several blocks side by side: one id of every lane per step. Lanes learn from each other in every step; what is the same for many of
them (counts as cells of a table, chances of what is remembered) is worked out anew from time to time and only looked up in between.
"""

from __future__ import annotations

import numpy as np

#: Lanes and blocks side by side, cells of the order-0 table that they may take together, and ids of a lane at most.
LANES, BLOCKS, CELLS, RUN = 8_192, 64, 6_000_000, 512
#: Contexts of order 2 that a block tells apart, steps between two tables of the counts and between two lessons (all of the first EARLY are lessons), and what an id adds to its count.
SLOTS, EPOCH, LESSON, EARLY, GAIN = 1 << 15, 128, 16, 32, 16
#: Lanes that a lesson's mean counts for, at most, and how many ids a chance is worth when it meets a lesson's.
WEIGHT, WORTH = 64, 48
#: Bits of a probability and of a word. The range has up to TOP bits; while it has BOTTOM or fewer, a word is shifted out.
BITS, WORD, TOP = 16, 24, 62
BOTTOM = TOP - WORD
ONE = 1 << BITS
#: Counts of a segment's prior sum to about this.
PRIOR = 1 << 15

#: ln(p / (1 - p)) of probabilities in 1/4096, in 1/256; and back, from -EDGE on, with 0 for what cannot be. Natural logarithms from 1 to 8192 in 1/256.
_P = (np.arange(4096) + 0.5) / 4096
STRETCH = np.clip(np.rint(np.log(_P / (1 - _P)) * 256), -2047, 2047).astype(np.int64)
EDGE, NEVER = 10_240, -8_192
SQUASH = np.clip(np.rint(ONE / (1 + np.exp(-np.clip(np.arange(-EDGE, EDGE), -2047, 2047) / 256))), 32, ONE - 2048).astype(np.int64)
SQUASH[: EDGE + NEVER + 2048] = 0
LOGS = np.rint(np.log(np.maximum(np.arange(8193), 1)) * 256).astype(np.int64)
#: What is added to a memory of some sureness (its lower four bits) when it was wrong or right: right, surer; wrong, half as sure.
LEARN = np.array([[(s >> 1) - s, s < 15] for s in range(16)], np.int64).ravel()


def prior_of(ids: np.ndarray, n: int) -> np.ndarray:
    """Counts to begin with, at least 1 each, from how often each of ``n`` ids occurs."""
    f = np.bincount(ids, minlength=n).astype(np.int64)
    return np.maximum(1, f * PRIOR // max(1, int(f.sum())))


class Model:
    """State of blocks of so many ``lanes`` each over ids 0 to len(prior) - 1."""

    def __init__(self, prior: np.ndarray, lanes: np.ndarray) -> None:
        self.d, self.blocks, self.at = len(prior), len(lanes), 0
        b = self.blocks
        self.bits = min(max(BITS, self.d.bit_length() + 3), TOP - WORD - BITS + 5)
        self.counts = np.tile(prior.astype(np.int64), (b, 1))
        self.seen: list[np.ndarray] = []
        # memories of order 2, then of order 1: an id and in the lower four bits how sure it is
        self.slots = np.zeros(b * (SLOTS + self.d), np.int32)
        sure = np.arange(16)
        self.right = np.tile((ONE * (2 * sure + 1) // (2 * sure + 8)).astype(np.int64), (2, b, 1))
        self.weights = np.empty((3, 2, b), np.int64)
        self.weights[:] = np.array([40_000, 20_000, 10_000])[:, None, None]
        self._lanes(np.asarray(lanes, np.int64))
        self.mixed = np.zeros(self.n, np.int64)
        self.slot = np.stack([self.slot_base, self.first_base])
        self._table()
        self._mix()

    def _lanes(self, lanes: np.ndarray) -> None:
        self.lanes, self.n = lanes, int(lanes.sum())
        block = np.repeat(np.arange(len(lanes)), lanes)
        self.starts = np.cumsum(lanes) - lanes
        self.base, self.slot_base, self.first_base = block * self.d, block * SLOTS, self.blocks * SLOTS + block * self.d
        self.share_base = np.stack([self.base, self.base + self.blocks * self.d])
        self.edge_base, self.cell_base, self.mix_base = block * (self.d + 1), block << self.bits, block * 512
        self.right_base = np.stack([block * 16, (self.blocks + block) * 16])

    def shrink(self, lanes: np.ndarray) -> None:
        """Go on with the first blocks; those after them have ended."""
        if len(lanes) < len(self.lanes):
            self._count()
            self._lanes(lanes)
            self.mixed, self.slot = self.mixed[: self.n], self.slot[:, : self.n]

    def _count(self) -> None:
        if self.seen:
            self.counts += GAIN * np.bincount(np.concatenate(self.seen), minlength=self.counts.size).reshape(self.counts.shape)
        self.seen = []

    def _table(self) -> None:
        """The counts as stretches of 2 ** bits cells, at least one each, and the logarithm of each id's share times its weight."""
        self._count()
        upto = np.cumsum(self.counts, axis=1)
        self.edges = np.zeros((self.blocks, self.d + 1), np.int64)
        self.edges[:, 1:] = upto * ((1 << self.bits) - self.d) // upto[:, -1:] + np.arange(1, self.d + 1)
        width = np.diff(self.edges, axis=1)
        self.cells = np.repeat(np.tile(np.arange(self.d, dtype=np.int32), self.blocks), width.ravel())
        self.edges = self.edges.ravel()
        self.logs = (LOGS[np.minimum(width, 8192)] - int(LOGS[1 << 12]) - round(np.log(2) * 256 * (self.bits - 12))).ravel()
        share = self.weights[2][:, :, None] * self.logs.reshape(self.blocks, self.d)
        self.share = np.clip(share >> 16, -2047, 2047).ravel()

    def _mix(self) -> None:
        """What orders 2 and 1 add to the mix for every pair of their sureness, if they remember different ids or the same one."""
        own = STRETCH[self.right >> 4]
        self.own = own.ravel()
        a, b = own[0][:, :, None, None], own[1][:, None, :, None]
        same = np.arange(2)
        w = self.weights[:2, :, :, None, None, None]
        mix = np.stack([w[0, 0] * a + w[1, 0] * (b * same), w[0, 1] * b + w[1, 1] * (a * same)])
        mix = np.clip(mix >> 16, -4095, 4095)
        mix[0, :, 0] = NEVER
        mix[1, :, :, 0] = NEVER
        mix[1, :, 1:, :, 1] = NEVER
        self.mix = (mix + EDGE).reshape(2, -1)

    def predict(self) -> tuple[np.ndarray, np.ndarray]:
        """What orders 2 and 1 remember (2, n), and the mixed chance of either in 1/ONE; 0 where it remembers nothing or the same."""
        if self.at % EPOCH == 0 and self.at:
            self._table()
        self.held = held = self.slots.take(self.slot).astype(np.int64)
        self.known = known = held >> 4
        self.sure = sure = held & 15
        self.same = known[0] == known[1]
        at = sure[0] << 5
        at += sure[1] << 1
        at += self.same
        at += self.mix_base
        dot = self.share.take(known + self.share_base)
        dot[0] += self.mix[0].take(at)
        dot[1] += self.mix[1].take(at)
        self.p = SQUASH.take(dot)
        return known, self.p

    def update(self, ids: np.ndarray) -> None:
        """Learn the ids of this step."""
        true = self.known == ids
        if self.at < EARLY or self.at % LESSON == 0:
            self._lesson(true)
        k = self.sure << 1
        k += true
        held = self.held
        held += LEARN.take(k)
        # what is not sure at all is forgotten for what came
        k &= 29
        np.copyto(held, (ids << 4) | 1, where=k == 0)
        self.slots[self.slot] = held
        self.seen.append(ids + self.base)
        slot = np.empty_like(self.slot)
        slot[0] = (ids * 0x9E3779B1 + self.mixed) >> 15
        slot[0] &= SLOTS - 1
        slot[0] += self.slot_base
        slot[1] = ids + self.first_base
        self.slot, self.mixed = slot, ids * 0x85EBCA77
        self.at += 1

    def _lesson(self, true: np.ndarray) -> None:
        """Chances and weights learn from this step, by block."""
        key = self.right_base + self.sure
        n = np.bincount(key.ravel(), minlength=self.right.size).reshape(self.right.shape)
        hits = np.bincount(key[true], minlength=self.right.size).reshape(self.right.shape)
        own = self.own.take(key)
        error = (true * ONE - self.p) * (self.p > 0)
        here = len(self.lanes)
        part = np.minimum(self.lanes, WEIGHT)
        for w, x in zip(self.weights, (own, own[::-1] * self.same, self.logs.take(self.known + self.base)), strict=True):
            w[:, :here] += (np.add.reduceat(x * error, self.starts, axis=1) * part // self.lanes + (1 << 16)) >> 17
        self.right = (self.right * WORTH + ONE * hits) // (WORTH + n)
        np.clip(self.right, 0, ONE - 1, out=self.right)
        self._mix()


def _shapes(lengths: np.ndarray, run: int) -> np.ndarray:
    """Lanes of blocks of these lengths."""
    return np.maximum(1, -(-np.asarray(lengths, np.int64) // run))


def _groups(lanes: np.ndarray, steps: np.ndarray, d: int) -> list[tuple[int, int]]:
    """Stretches of blocks that go side by side; none has more steps than the one before it."""
    most = max(1, min(BLOCKS, CELLS // max(1, 8 * d)))
    out, i = [], 0
    for j in range(1, len(lanes) + 1):
        if j == len(lanes) or j - i == most or steps[j] > steps[j - 1] or int(lanes[i : j + 1].sum()) > LANES:
            out.append((i, j))
            i = j
    return out


def _phases(lanes: np.ndarray, steps: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(steps, lanes of the blocks that have so many)."""
    return [(int(s), lanes[steps >= s]) for s in np.unique(steps)]


def encode(ids: np.ndarray, lengths: np.ndarray, prior: np.ndarray) -> list[bytes]:
    """A byte string per block of ``lengths`` ids each, the last one at most as long as the others."""
    if not len(lengths):
        return []
    starts = np.cumsum(lengths) - lengths
    # the last block has as many steps as the others, or fewer
    steps = -(-int(lengths[0]) // int(_shapes(lengths[:1], RUN)[0]))
    lanes = _shapes(lengths, max(1, steps))
    steps = -(-np.asarray(lengths, np.int64) // lanes)
    out: list[bytes] = []
    for i, j in _groups(lanes, steps, len(prior)):
        rows = []
        for k in range(i, j):
            own = np.zeros((int(lanes[k]), int(steps[i])), np.int32)
            flat = np.zeros(int(lanes[k] * steps[k]), np.int32)
            flat[: lengths[k]] = ids[starts[k] : starts[k] + lengths[k]]
            own[:, : steps[k]] = flat.reshape(int(lanes[k]), -1)
            rows.append(own)
        out += _encode(np.ascontiguousarray(np.concatenate(rows).T), lanes[i:j], steps[i:j], prior)
    return out


def _encode(rows: np.ndarray, lanes: np.ndarray, steps: np.ndarray, prior: np.ndarray) -> list[bytes]:
    n = rows.shape[1]
    m = Model(prior, lanes)
    low, span = np.zeros(n, np.int64), np.full(n, 1 << TOP, np.int64)
    words, used = np.zeros((len(rows) // 2 + 2 * EPOCH, n), np.int32), np.zeros(n, np.int64)
    t = 0
    for upto, left in _phases(lanes, steps):
        m.shrink(left)
        lo, sp = low[: m.n], span[: m.n]
        while t < upto:
            if t % EPOCH == 0 and int(used.max()) + 2 * EPOCH > len(words):
                words = np.concatenate([words, np.zeros_like(words)])
            now = rows[t, : m.n].astype(np.int64)
            known, p = m.predict()
            hit = known == now
            hit &= p > 0
            first, either = p[0], hit[0] | hit[1]
            second = ((ONE - first) * p[1]) >> BITS
            both = first + second
            r = sp >> BITS
            # the rest of the range is for ids by their counts
            lo += r * np.where(either, hit[1] * first, both)
            np.multiply(r, np.where(either, np.where(hit[0], first, second), ONE - both), out=sp)
            k = np.flatnonzero(~either)
            unit, cell = sp[k] >> m.bits, (now + m.edge_base)[k]
            below = m.edges.take(cell)
            sp[k] = unit * (m.edges.take(cell + 1) - below)
            lo[k] += unit * below
            while len(at := np.flatnonzero(sp < 1 << BOTTOM)):
                part = lo[at]
                words[used[at], at] = part >> BOTTOM  # bit 24 is a carry into the word before
                used[at] += 1
                lo[at] = (part & ((1 << BOTTOM) - 1)) << WORD
                sp[at] <<= WORD
            m.update(now)
            t += 1
    for _ in range(3):
        words[used, np.arange(n)] = low >> BOTTOM
        used += 1
        low = (low & ((1 << BOTTOM) - 1)) << WORD
    for k in range(int(used.max()) - 1, 0, -1):  # carries run towards the front
        words[k - 1] += words[k] >> WORD
    flat = np.ascontiguousarray(words.T).astype("<u4").view(np.uint8).reshape(n, len(words), 4)[:, :, :3]
    taken = np.arange(len(words)) < used[:, None]
    out, i = [], 0
    for j in np.cumsum(lanes).tolist():
        out.append(np.concatenate([[j - i], used[i:j]]).astype("<u4").tobytes() + flat[i:j][taken[i:j]].tobytes())
        i = j
    return out


def _parsed(block: bytes, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Words of each lane, and these."""
    n = int.from_bytes(block[:4], "little")
    if len(block) < 4 or not 0 < n <= max(1, length) or len(block) < 4 * n + 4:
        raise ValueError("a damaged block of ids")
    sizes = np.frombuffer(block, "<u4", n, 4).astype(np.int64)
    raw = np.frombuffer(block, np.uint8, offset=4 * n + 4)
    if 3 * int(sizes.sum()) != len(raw) or int(sizes.min()) < 3:
        raise ValueError("a damaged block of ids")
    raw = raw.reshape(-1, 3).astype(np.int64)
    return sizes, raw[:, 0] | (raw[:, 1] << 8) | (raw[:, 2] << 16)


def decode(blocks: list[bytes], lengths: np.ndarray, prior: np.ndarray) -> np.ndarray:
    """The ids of the blocks, one after the other."""
    if not len(blocks):
        return np.empty(0, np.int64)
    parsed = [_parsed(b, int(n)) for b, n in zip(blocks, lengths, strict=True)]
    lanes = np.array([len(sizes) for sizes, _ in parsed], np.int64)
    steps = -(-np.asarray(lengths, np.int64) // lanes)
    out = []
    for i, j in _groups(lanes, steps, len(prior)):
        rows, at = _decode(parsed[i:j], lanes[i:j], steps[i:j], prior), 0
        for k in range(i, j):
            out.append(rows[at : at + lanes[k], : steps[k]].ravel()[: lengths[k]])
            at += int(lanes[k])
    return np.concatenate(out)


def _decode(parsed: list[tuple[np.ndarray, np.ndarray]], lanes: np.ndarray, steps: np.ndarray, prior: np.ndarray) -> np.ndarray:
    m = Model(prior, lanes)
    sizes = np.concatenate([s for s, _ in parsed])
    words = np.concatenate([*(w for _, w in parsed), np.zeros(4, np.int64)])
    at = np.cumsum(sizes) - sizes
    spare = 3 * WORD - TOP
    code = (words[at] << BOTTOM) | (words[at + 1] << (BOTTOM - WORD)) | (words[at + 2] >> spare)
    at += 2
    # TOP is no multiple of WORD: what is shifted in lies across two words
    words = ((words[:-1] & ((1 << spare) - 1)) << (WORD - spare)) | (words[1:] >> spare)
    most = len(words) - 1
    span = np.full(m.n, 1 << TOP, np.int64)
    rows = np.zeros((int(steps[0]), m.n), np.int32)
    t = 0
    for upto, left in _phases(lanes, steps):
        m.shrink(left)
        co, sp = code[: m.n], span[: m.n]
        mask = (1 << m.bits) - 1
        while t < upto:
            known, p = m.predict()
            first = p[0]
            both = first + (((ONE - first) * p[1]) >> BITS)
            r = sp >> BITS
            a, b = r * first, r * both
            hit, either = co < a, co < b
            co -= np.where(either, ~hit * a, b)
            np.copyto(sp, np.where(hit, a, np.where(either, b - a, r * (ONE - both))))
            now = np.where(hit, known[0], known[1])
            # the others by their counts
            k = np.flatnonzero(~either)
            rest = co[k]
            unit = sp[k] >> m.bits
            want = rest // unit
            want &= mask
            ids = m.cells.take(want + m.cell_base[k])
            cell = ids + m.edge_base[k]
            low = m.edges.take(cell)
            sp[k] = unit * (m.edges.take(cell + 1) - low)
            co[k] = rest - unit * low
            now[k] = ids
            while len(k := np.flatnonzero(sp < 1 << BOTTOM)):
                co[k] = (co[k] << WORD) | words.take(np.minimum(at[k], most))
                at[k] += 1
                sp[k] <<= WORD
            rows[t, : m.n] = now
            m.update(now)
            t += 1
    return np.ascontiguousarray(rows.T)
