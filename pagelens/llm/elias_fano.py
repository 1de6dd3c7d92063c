"""Elias-Fano lists, and a level of an n-gram trie over them, kept in one memory map."""

from __future__ import annotations

import mmap

import numpy as np

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")
_ONES = _BITS.sum(axis=1).astype(np.int64)
#: place of the r-th set bit of a byte
_SELECT = np.full((256, 8), 8, np.int64)
for _byte in range(256):
    _at = np.flatnonzero(_BITS[_byte])
    _SELECT[_byte, : len(_at)] = _at
_SELECT = _SELECT.ravel()
#: for sums over all bytes of a 64-bit word at once
_EACH, _TOP, _EIGHTS = (np.uint64(x) for x in (0x0101010101010101, 0x8080808080808080, 0x4038302820181008))


class EliasFano:
    """A non-decreasing list of integers under 2**62: low bits packed, high bits in unary, with a rank directory."""

    def __init__(self, size: int, low_bits: int, low: np.ndarray, high: np.ndarray, ones: np.ndarray):
        self.size, self.low_bits, self.low, self.high, self.ones = size, low_bits, low, high, ones
        self.zeros = np.arange(len(ones), dtype=np.int64) * 64 - ones
        self.words = high.view("<u8")
        self.high_words = np.lib.stride_tricks.as_strided(self.words, (len(high) - 7,), (1,))
        self.most = len(high) * 8 - size  # zeros
        #: of each word, in byte i the ones of its bytes up to i
        self.sums = _ONES[high].astype(np.uint8).view("<u8") * _EACH
        self.low_words = np.lib.stride_tricks.as_strided(low[:8].view("<u8"), (max(1, len(low) - 7),), (1,))

    @classmethod
    def parts(cls, values: np.ndarray) -> list[np.ndarray]:
        """[size and low bits, low bytes, high bytes, ones before each 64-bit word of high]."""
        n = len(values)
        top = int(values[-1]) + 1 if n else 1
        low_bits = max(0, (top // max(1, n)).bit_length() - 1)
        fields = np.zeros((n, low_bits), np.uint8)
        for b in range(low_bits):
            fields[:, b] = (values >> b) & 1
        low = np.concatenate((np.packbits(fields.ravel(), bitorder="little"), np.zeros(8, np.uint8)))
        places = (values >> low_bits) + np.arange(n)
        bits = np.zeros(-(-(int(places[-1]) + 2 if n else 1) // 64) * 64, np.uint8)
        bits[places] = 1
        high = np.packbits(bits, bitorder="little")
        per_word = _ONES[high].reshape(-1, 8).sum(axis=1)
        return [np.array([n, low_bits], np.int64), low, high, np.concatenate(([0], np.cumsum(per_word)))[:-1].astype(np.int64)]

    def _select(self, r: np.ndarray, directory: np.ndarray, flip: int) -> np.ndarray:
        """Place of the r-th one (flip 0) or zero (flip 255)."""
        word = np.searchsorted(directory, r, "right") - 1
        left = (r - directory[word]).astype(np.uint64)
        bits, sums = self.words[word], self.sums[word]
        if flip:
            bits, sums = ~bits, _EIGHTS - sums
        byte = ((((left * _EACH | _TOP) - sums & _TOP) >> np.uint64(7)) * _EACH) >> np.uint64(56)  # bytes whose sums are not over left
        shift = np.minimum(byte, np.uint64(7)) << np.uint64(3)
        left -= (sums << np.uint64(8)) >> shift & np.uint64(255)
        cell = ((bits >> shift & np.uint64(255)) << np.uint64(3)) + np.minimum(left, np.uint64(7))
        return word * 64 + shift.astype(np.int64) + _SELECT[cell.astype(np.int64)]

    def low_of(self, at: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(at), np.int64)
        bit = at * self.low_bits
        words = self.low_words[bit >> 3] >> (bit & 7).astype(np.uint64)
        return (words & np.uint64((1 << self.low_bits) - 1)).astype(np.int64)

    def __getitem__(self, at: np.ndarray) -> np.ndarray:
        return ((self._select(at, self.ones, 0) - at) << self.low_bits) | self.low_of(at)

    def find(self, x: np.ndarray) -> np.ndarray:
        """Place of the first value not under x (size, if none), for sorted or unsorted x: a successor search."""
        return self.search(x)[0]

    def search(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As find, and whether the value at the place is x."""
        bucket = x >> self.low_bits
        most = self.most
        begin = np.where(bucket > 0, self._select(np.clip(bucket - 1, 0, most - 1), self.zeros, 255) - bucket + 1, 0)
        begin = np.where(bucket > most, self.size, begin)
        at = np.minimum(begin + bucket, len(self.high) * 8 - 1)  # the first bit of the bucket
        from_ = np.minimum(at >> 3, len(self.high) - 8)
        shift = at - (from_ << 3)
        bits = self.high_words[from_] >> shift.astype(np.uint64)
        run = np.bitwise_count(bits & ~(bits + np.uint64(1))).astype(np.int64)  # ones up to the next zero
        end = begin + run
        far = np.flatnonzero(run + shift >= 64)  # which may be beyond what was read
        end[far] = np.where(bucket[far] < most, self._select(np.clip(bucket[far], 0, most - 1), self.zeros, 255) - bucket[far], self.size)
        end = np.where(bucket >= most, self.size, end)
        last = end.copy()
        low = x & ((1 << self.low_bits) - 1)
        active = np.flatnonzero(begin < end)
        while len(active):  # halves each bucket's range
            middle = (begin[active] + end[active]) >> 1
            under = self.low_of(middle) < low[active]
            begin[active] = np.where(under, middle + 1, begin[active])
            end[active] = np.where(under, end[active], middle)
            active = active[begin[active] < end[active]]
        there = np.flatnonzero(begin < last)  # a value of the same high bits
        found = np.zeros(len(x), bool)
        found[there] = self.low_of(begin[there]) == low[there]
        return begin, found


class Trie:
    """A level of an n-gram trie: contexts, monotone pointers to their successors, and quantised probabilities of those.

    Contexts and successors are whole ids under 2**62 in all, no hashes. A successor is stored relative to its context:
    the context's place and the successor make one rising list, and a search stays within the context's range of it.
    Successors' counts, which are the next level's context counts, stand beside the probabilities.
    """

    def __init__(self, contexts: np.ndarray, successors: np.ndarray, codes: np.ndarray, counts: np.ndarray):
        """Distinct pairs in ascending order of context and then successor; two bytes of code and a count for each."""
        new = np.diff(contexts, prepend=-1) != 0
        first, place = np.flatnonzero(new), np.cumsum(new) - 1
        self.bits = int(successors.max()).bit_length() if len(successors) else 0
        if len(first) and int(place[-1]).bit_length() + self.bits > 62:
            raise ValueError("too many contexts in a level")
        lists = (contexts[first], np.append(first, len(contexts)), (place << self.bits) | successors)
        pieces = [p for values in lists for p in EliasFano.parts(values)] + [codes.astype(np.uint16), counts.astype(np.int64)]
        ends = np.cumsum([p.nbytes + -p.nbytes % 8 for p in pieces]).tolist()
        self.map = mmap.mmap(-1, ends[-1] + 8)  # no file: a machine's own folders are not for jobs
        for start, p in zip([0, *ends], pieces):
            self.map[start : start + p.nbytes] = p.tobytes()
        whole = np.frombuffer(self.map, np.uint8)
        views = [whole[start : start + p.nbytes].view(p.dtype) for start, p in zip([0, *ends], pieces)]
        lists = [EliasFano(int(views[i][0]), int(views[i][1]), *views[i + 1 : i + 4]) for i in (0, 4, 8)]
        self.contexts, self.pointers, self.successors, self.codes, self.counts = *lists, views[12], views[13]

    def __call__(self, contexts: np.ndarray, successors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the pairs, in any order, and whether they are there (0 and False for others)."""
        if not self.successors.size or not len(contexts):
            return np.zeros(len(contexts), np.int64), np.zeros(len(contexts), bool)
        new = np.diff(contexts, prepend=-1) != 0
        if (np.diff(contexts) >= 0).all():
            context, which = contexts[new], np.cumsum(new) - 1
        else:
            context, which = np.unique(contexts, return_inverse=True)
        place, same = self.contexts.search(context)
        place = np.minimum(place, self.contexts.size - 1)
        known = same[which] & (successors < 1 << self.bits)
        begin, end = self.pointers[place], self.pointers[place + 1]
        target = (place[which] << self.bits) | np.where(known, successors, 0)
        at, same = self.successors.search(target)
        inside = known & (at >= begin[which]) & (at < end[which])
        there = inside & same
        return np.where(there, at, 0), there
