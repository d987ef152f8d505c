"""A run-length index of repetitive byte strings, and the matches it shows between them."""

import numpy as np

#: Symbols packed into one number, each of so many bits; bytes are 1 to 256, 0 ends a string.
_PACKED, _BITS = 7, 9
#: What stands after the end of the text: larger than any symbol.
_END = (1 << _BITS) - 1


def joined(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All strings one after another as symbols, a 0 after each, and where each begins; the
    last place is the end."""
    starts = np.cumsum([0, *(len(s) + 1 for s in strings)])
    symbols = np.frombuffer(b"\0".join([*strings, b""]), np.uint8).astype(np.uint16) + 1
    symbols[starts[1:] - 1] = 0
    return symbols, starts


def _packed(symbols: np.ndarray) -> np.ndarray:
    padded = np.concatenate([symbols.astype(np.int64), np.full(_PACKED, _END)])
    out = np.zeros(len(symbols), np.int64)
    for j in range(_PACKED):
        out <<= _BITS
        out |= padded[j : j + len(symbols)]
    return out


def suffix_array(symbols: np.ndarray, packed: np.ndarray) -> np.ndarray:
    """Places of all suffixes in order: sorted by packed symbols, then by ranks of twice the
    length, of suffixes that are not told apart yet."""
    n = len(symbols)
    order = np.argsort(packed, kind="stable")
    ranks, open_ = np.empty(n, np.int64), np.arange(n)
    keys, length = packed[order], _PACKED
    while True:
        new = np.ones(len(keys), bool)
        new[1:] = keys[1:] != keys[:-1]
        group = open_[np.maximum.accumulate(np.where(new, np.arange(len(keys)), 0))]
        ranks[order[open_]] = group
        alone = new & np.append(new[1:], True)
        open_, group = open_[~alone], group[~alone]
        if not len(open_):
            return order
        suffixes = order[open_]
        after = suffixes + length
        keys = group * (n + 1) + np.where(after < n, ranks[np.minimum(after, n - 1)], n)
        by = np.argsort(keys, kind="stable")
        order[open_], keys = suffixes[by], keys[by]
        length *= 2


class RunIndex:
    """Runs of the Burrows-Wheeler transform of joined strings: the symbol and length of
    every run, and the places of the suffixes at its first and last row."""

    def __init__(self, symbols: np.ndarray):
        packed = _packed(symbols)
        order = suffix_array(symbols, packed)
        before = symbols[order - 1].astype(np.int32)
        before[order == 0] = _END
        head = np.flatnonzero(np.r_[True, before[1:] != before[:-1]])
        tail = np.append(head[1:], len(order)) - 1
        self.symbols, self.packed = symbols, packed
        self.runs, self.lengths = before[head], tail - head + 1
        self.first, self.last = order[head], order[tail]

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Symbols that the suffixes at ``a`` and ``b`` share from their start."""
        n, length, on = len(self.symbols), np.zeros(len(a), np.int64), np.arange(len(a))
        for step, values in ((_PACKED, self.packed), (1, self.symbols)):
            on = np.arange(len(a))
            while len(on):
                i, j = a[on] + length[on], b[on] + length[on]
                inside = np.maximum(i, j) < n
                on, i, j = on[inside], i[inside], j[inside]
                on = on[values[i] == values[j]]
                length[on] += step
        return length

    def matching_statistics(self) -> np.ndarray:
        """For every place, the length of the longest match of what starts there with what
        starts at any other place, ends of strings included.

        The longest match is with the suffix in the row above or below. Inside a run both
        rows go on with the same symbol, so the match at the next place is shorter by
        one; lengths are measured at the borders of runs only, between the last row of
        one and the first of the next, and streamed from these samples over the text."""
        n = len(self.symbols)
        border = self.common(self.first[1:], self.last[:-1])
        out = np.zeros(n, np.int64)
        for places, lengths in ((self.first, np.r_[0, border]), (self.last, np.r_[border, 0])):
            # A match of length l at place p reaches up to p + l, until the next sample.
            reach, sampled = np.zeros(n, np.int64), np.full(n, -1)
            reach[places], sampled[places] = places + lengths, places
            nearest = np.maximum.accumulate(sampled)
            np.maximum(out, reach[nearest] - np.arange(n), out=out)
        return out


def repeated_starts(strings: list[bytes], length: int) -> list[np.ndarray]:
    """For each of different strings, the starts of what is also at another place, in this
    string or another, for at least ``length`` bytes."""
    symbols, starts = joined(strings)
    matches = RunIndex(symbols).matching_statistics()
    ends = np.repeat(starts[1:] - 1, np.diff(starts))
    found = np.flatnonzero(np.minimum(matches, ends - np.arange(len(symbols))) >= length)
    which = np.searchsorted(starts, found, "right") - 1
    return np.split(found - starts[which], np.searchsorted(which, np.arange(1, len(strings))))
