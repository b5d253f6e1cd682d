"""A counting quotient filter over 64-bit fingerprints, built and merged with numpy."""

from __future__ import annotations

import numpy as np

FINGERPRINT_BITS = 64


class CountingQuotientFilter:
    """Fingerprints with their counts, without loss.

    A fingerprint's high bits, its quotient, name a home slot; its low bits, the remainder, are stored at or
    after it, in a run of that quotient's sorted remainders. `occupieds` marks quotients that have a run,
    `runends` the last slot of each run. A count above one follows its remainder in slots of its own, marked in
    `counters`, 32 bits of the count in each. As runs stand in quotient order and are sorted, the slots read
    from left to right give all fingerprints in order; two filters merge by one pass over their remainders.
    """

    def __init__(self, quotient_bits: int, occupieds, runends, counters, slots):
        self.quotient_bits = quotient_bits
        self.occupieds, self.runends, self.counters, self.slots = occupieds, runends, counters, slots

    @classmethod
    def build(cls, fingerprints: np.ndarray, counts: np.ndarray | None = None) -> CountingQuotientFilter:
        """Of unsorted fingerprints (uint64), each with its count (1 where none is given)."""
        if counts is None:
            found, total = np.unique(fingerprints, return_counts=True)
        else:
            order = np.argsort(fingerprints, kind="stable")
            found, at = np.unique(fingerprints[order], return_index=True)
            total = np.add.reduceat(counts[order], at) if len(at) else np.zeros(0, np.int64)
        return cls._of_sorted(found, total.astype(np.uint64))

    @classmethod
    def _of_sorted(cls, found: np.ndarray, total: np.ndarray) -> CountingQuotientFilter:
        extra = np.where(total > 1, 1 + (total >> np.uint64(32) > 0), 0)
        bits = max(4, int(np.ceil(np.log2(max(1, len(found)) / 0.75))))
        quotient = (found >> np.uint64(FINGERPRINT_BITS - bits)).astype(np.int64)
        # each entry stands in its home slot or right after the one before it, whichever is later
        before = np.concatenate(([0], np.cumsum(1 + extra)))[:-1] if len(found) else np.zeros(0, np.int64)
        at = np.maximum.accumulate(quotient - before) + before if len(found) else before
        width = max(1 << bits, int(at[-1] + 1 + extra[-1]) if len(found) else 0)
        occupieds, runends, counters = (np.zeros(width, bool) for _ in range(3))
        slots = np.zeros(width, np.uint64)
        slots[at] = found & np.uint64((1 << (FINGERPRINT_BITS - bits)) - 1)
        occupieds[quotient] = True
        last = np.append(quotient[1:] != quotient[:-1], True) if len(found) else np.zeros(0, bool)
        runends[(at + extra)[last]] = True
        for digit in (1, 2):
            has = extra >= digit
            counters[at[has] + digit] = True
            slots[at[has] + digit] = (total[has] >> np.uint64(32 * (digit - 1))) & np.uint64(0xFFFFFFFF)
        used = np.zeros(width, bool)
        used[at] = True
        out = cls(bits, occupieds, runends, counters, slots)
        out.used = used | counters
        return out

    def entries(self) -> tuple[np.ndarray, np.ndarray]:
        """All fingerprints in ascending order, and their counts, read back from the slots."""
        at = np.flatnonzero(self.used & ~self.counters)
        run = np.cumsum(self.runends) - self.runends  # the run, counted from the left, that a slot belongs to
        quotient = np.flatnonzero(self.occupieds)[run[at]].astype(np.uint64)
        found = (quotient << np.uint64(FINGERPRINT_BITS - self.quotient_bits)) | self.slots[at]
        padded = np.append(self.counters, [False, False])
        low, high = padded[at + 1], padded[at + 1] & padded[np.minimum(at + 2, len(padded) - 1)]
        values = np.append(self.slots, np.zeros(2, np.uint64))
        count = np.where(low, values[at + 1], np.uint64(1)) + (np.where(high, values[at + 2], np.uint64(0)) << np.uint64(32))
        return found, count

    def merge(self, other: CountingQuotientFilter) -> CountingQuotientFilter:
        """The filter of both multisets: their sorted entries are merged and equal ones added, none lost."""
        (a, n), (b, m) = self.entries(), other.entries()
        at = np.searchsorted(a, b) + np.arange(len(b))
        found, count = np.empty(len(a) + len(b), np.uint64), np.empty(len(a) + len(b), np.uint64)
        mine = np.ones(len(found), bool)
        mine[at] = False
        found[at], count[at], found[mine], count[mine] = b, m, a, n
        if not len(found):
            return self
        head = np.flatnonzero(np.append(True, found[1:] != found[:-1]))
        return self._of_sorted(found[head], np.add.reduceat(count, head))

    def to_bytes(self) -> bytes:
        """Only what is used is written: bit vectors packed, and the slots in use."""
        bits = [np.packbits(x).tobytes() for x in (self.occupieds, self.runends, self.counters, self.used)]
        head = np.array([self.quotient_bits, len(self.slots), int(self.used.sum())], np.int64).tobytes()
        return head + b"".join(bits) + self.slots[self.used].tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> CountingQuotientFilter:
        bits, width, n = (int(x) for x in np.frombuffer(raw, np.int64, 3))
        size, vectors = (width + 7) // 8, []
        for k in range(4):
            vectors.append(np.unpackbits(np.frombuffer(raw, np.uint8, size, 24 + k * size), count=width).astype(bool))
        slots = np.zeros(width, np.uint64)
        slots[vectors[3]] = np.frombuffer(raw, np.uint64, n, 24 + 4 * size)
        out = cls(bits, *vectors[:3], slots)
        out.used = vectors[3]
        return out
