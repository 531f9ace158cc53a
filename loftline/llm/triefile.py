"""An n-gram trie in flat arrays: Elias-Fano sequences, quantised log-probabilities, one buffer that is read in place.

Level k holds the k-grams, sorted by their first k - 1 words.  A k-gram stands below the node of these words, and is
numbered there relative to its context: by its place among the followers of words 2 to k - 1, which level k - 1 already
has, so that numbers stay small.  Numbers plus the base of their parent rise over the whole level; they, the bases and
the pointers to first children are Elias-Fano coded.  A lookup is a successor search for base + number.
"""

from __future__ import annotations

import mmap

import numpy as np

#: Parts of a decade that a log-probability is rounded to; 16 bits reach 16 decades.
STEPS = 4096
_KINDS = (np.uint64, np.uint32, np.uint16, np.int64)


def quantised(log10: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(-log10 * STEPS), 0, 65535).astype(np.uint16)


def joined(arrays: list[np.ndarray]) -> bytes:
    """Arrays in one buffer, each at a multiple of eight bytes."""
    head = np.array([len(arrays)] + [x for a in arrays for x in (_KINDS.index(a.dtype.type), len(a))], np.int64)
    return b"".join([head.tobytes()] + [a.tobytes() + bytes(-a.nbytes % 8) for a in arrays])


def views(buffer) -> list[np.ndarray]:
    """The arrays of ``joined``, without a copy."""
    n = int(np.frombuffer(buffer, np.int64, 1)[0])
    head = np.frombuffer(buffer, np.int64, 2 * n, 8)
    at, out = 8 * (2 * n + 1), []
    for kind, size in head.reshape(n, 2).tolist():
        out.append(np.frombuffer(buffer, _KINDS[kind], size, at))
        at += -(-size * out[-1].itemsize // 8) * 8
    return out


def _packed(bits: np.ndarray) -> np.ndarray:
    b = np.packbits(bits, bitorder="little")
    return np.pad(b, (0, -len(b) % 8 + 8)).view(np.uint64)


def _nth(word: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Place of one number r (from 0) in each word."""
    at = np.zeros(len(word), np.int64)
    for s in (32, 16, 8, 4, 2, 1):
        c = np.bitwise_count(word & np.uint64((1 << s) - 1)).astype(np.int64)
        up = r >= c
        r = r - c * up
        word = np.where(up, word >> np.uint64(s), word)
        at += s * up
    return at


class EliasFano:
    """A rising sequence: low bits as they are, high bits in unary with a count of the ones before each word."""

    def __init__(self, arrays: list[np.ndarray]):
        (self.n, self.l), self.low, self.high, self.ones = arrays[0].tolist(), *arrays[1:]

    @staticmethod
    def build(values: np.ndarray, universe: int) -> list[np.ndarray]:
        n = len(values)
        low_bits = max(0, (universe // max(n, 1)).bit_length() - 1)
        v = values.astype(np.uint64)
        bits = (v[:, None] >> np.arange(low_bits, dtype=np.uint64)).astype(np.uint8) & 1
        high = np.zeros(n + (universe >> low_bits) + 2, np.uint8)
        high[(v >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)] = 1
        words = _packed(high)
        ones = np.cumsum(np.bitwise_count(words), dtype=np.uint32)
        return [np.array([n, low_bits], np.int64), _packed(bits), words, np.r_[np.uint32(0), ones[:-1]]]

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.l:
            return np.zeros(len(i), np.int64)
        bit = i * self.l
        w, s = bit >> 6, (bit & 63).astype(np.uint64)
        two = (self.low[w] >> s) | np.where(s > 0, self.low[w + 1] << (np.uint64(64) - s & np.uint64(63)), np.uint64(0))
        return (two & np.uint64((1 << self.l) - 1)).astype(np.int64)

    def get(self, i: np.ndarray) -> np.ndarray:
        w = np.searchsorted(self.ones, i, "right") - 1
        at = _nth(self.high[w], i - self.ones[w].astype(np.int64))
        return ((w * 64 + at - i) << self.l) | self._low(i)

    def _before(self, h: np.ndarray) -> np.ndarray:
        """Values whose high part is under h: the ones before zero number h - 1."""
        z = np.maximum(h - 1, 0)
        zeros = np.arange(len(self.ones), dtype=np.int64) * 64 - self.ones
        w = np.searchsorted(zeros, z, "right") - 1
        at = _nth(~self.high[w], z - zeros[w])
        return np.where(h > 0, w * 64 + at - z, 0)

    def successor(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of the first value that is x or more, and whether it is x."""
        h, own = x >> self.l, x & ((1 << self.l) - 1)
        lo, hi = self._before(h), self._before(h + 1)
        end = hi.copy()
        while (open_ := np.flatnonzero(lo < hi)).size:
            mid = (lo[open_] + hi[open_]) >> 1
            less = self._low(mid) < own[open_]
            lo[open_] = np.where(less, mid + 1, lo[open_])
            hi[open_] = np.where(less, hi[open_], mid)
        same = lo < end
        same[same] = self._low(lo[same]) == own[same]
        return lo, same


class Trie:
    """Words are 0 to n - 1; grams of k words are found by the nodes of their first and last k - 1 words."""

    def __init__(self, buffer):
        arrays = views(buffer)
        self.words, self.order = arrays[0].tolist()
        self.prob, self.back, at = [arrays[1]], [arrays[2]], 3
        self.numbers, self.bases, self.first = [], [], []
        for _ in range(self.order - 1):
            for kind in (self.numbers, self.bases, self.first):
                kind.append(EliasFano(arrays[at:at + 4]))
                at += 4
            self.prob.append(arrays[at])
            self.back.append(arrays[at + 1])
            at += 2

    @staticmethod
    def open(path: str) -> Trie:
        """The trie of a file, mapped into memory."""
        with open(path, "rb") as f:
            return Trie(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))

    @staticmethod
    def build(words: int, levels: list[tuple[np.ndarray, ...]]) -> tuple[bytes, list[np.ndarray]]:
        """(buffer, for each level the node of each gram given).

        ``levels`` has for each k (log10 probability, log10 back-off), and from k = 2 on where in the level before its first
        k - 1 words and its last k - 1 words were given.
        """
        prob, back = levels[0][:2]
        out = [np.array([words, len(levels)], np.int64), quantised(prob), quantised(back)]
        nodes, starts, wide, tail = [np.arange(words)], None, None, None   # of nodes two levels up: first child, children; of the level before: node of its words but the first
        for k, (prob, back, prefix, suffix) in enumerate(levels[1:], 2):
            parent, number, above = nodes[-1][prefix], nodes[-1][suffix], len(nodes[-1])
            last = number
            room = np.full(above, words) if k == 2 else wide[tail]   # all nodes, also those without children: a search there finds nothing of others
            if k > 2:
                number = number - starts[tail[parent]]
            base = np.r_[0, np.cumsum(room)]
            value = base[parent] + number
            rank = np.argsort(value)
            wide = np.bincount(parent, minlength=above)
            starts = np.r_[0, np.cumsum(wide)]
            out += [*EliasFano.build(value[rank], int(base[-1])), *EliasFano.build(base, int(base[-1])), *EliasFano.build(starts, len(value)), quantised(prob[rank]), quantised(back[rank])]
            tail = last[rank]
            own = np.empty(len(value), np.int64)
            own[rank] = np.arange(len(value))
            nodes.append(own)
        return joined(out), nodes

    def child(self, k: int, parent: np.ndarray, suffix: np.ndarray, middle: np.ndarray | None) -> np.ndarray:
        """Nodes of k-grams, -1 where there is none; -1 among the nodes given means none as well."""
        ok = np.flatnonzero((parent >= 0) & (suffix >= 0))
        out = np.full(len(parent), -1, np.int64)
        number = suffix[ok] if k == 2 else suffix[ok] - self.first[k - 3].get(middle[ok])
        if len(ok) and self.numbers[k - 2].n:
            at, same = self.numbers[k - 2].successor(self.bases[k - 2].get(parent[ok]) + number)
            out[ok[same]] = at[same]
        return out
