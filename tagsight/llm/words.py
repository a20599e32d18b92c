"""Words of UTF-8 texts and their 64-bit hashes, a whole slice of texts at a time."""

from __future__ import annotations

from functools import cached_property

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
#: bytes of a block; powers are kept for one block only
_STEP = 1 << 16
#: two polynomials over the numbers modulo 2^31 - 1, where products fit 64 bits and no byte pattern cancels itself out
_SHIFT = np.uint64(31)
_PRIME = np.uint64((1 << 31) - 1)
_BASES = (1_482_170_971, 862_048_943)

#: Fixed values: [\x20\x09-\x0D] end a word.
BLANK = np.zeros(256, bool)
BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: every ASCII character but letters and digits ends a word
PUNCTUATED = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
KEEP = np.arange(256, dtype=np.uint8)
#: A-Z to a-z
LOWER = KEEP.copy()
LOWER[65:91] += 32


def _rest(x: np.ndarray) -> np.ndarray:
    """x modulo 2^31 - 1 for x below 2^62, up to the two forms of 0."""
    x = (x & _PRIME) + (x >> _SHIFT)
    return (x & _PRIME) + (x >> _SHIFT)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(1, np.uint64)
    while len(out) < n:
        out = np.concatenate([out, _rest(out * np.uint64(pow(base, len(out), int(_PRIME))))])
    return out[:n]


_UP = [_powers(b, _STEP) for b in _BASES]
_DOWN = [_powers(pow(b, -1, int(_PRIME)), _STEP) for b in _BASES]


class _Sums:
    """Prefix sums of one polynomial over a byte string: block by block, each block with a factor of its own."""

    def __init__(self, folded: np.ndarray, which: int):
        blocks, self.down = len(folded) // _STEP, _DOWN[which]
        step = pow(_BASES[which], _STEP, int(_PRIME))
        terms = folded.reshape(blocks, _STEP) * _UP[which]
        self.sums = np.cumsum(terms, 1)
        last = _rest(self.sums[:, -1])
        self.sums -= terms  # those before a place, at most 2^55
        self.sums = self.sums.reshape(-1)
        self.up, self.back = _powers(step, blocks), _powers(pow(step, -1, int(_PRIME)), blocks)
        before, at = [], 0
        for x in _rest(last * self.up).tolist():
            before.append(at)
            at = (at + x) % int(_PRIME)
        self.before = np.array(before, np.uint64)

    def _to(self, place: np.ndarray) -> np.ndarray:
        block = place >> 16
        return _rest(_rest(_rest(self.sums[place]) * self.up[block]) + self.before[block])

    def between(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = _rest(self._to(end) + (_PRIME + _PRIME) - self._to(start))
        h = _rest(_rest(h * self.back[start >> 16]) * self.down[start & (_STEP - 1)])
        return np.where(h == _PRIME, np.uint64(0), h)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (one-to-one)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class _Places:
    """One polynomial modulo 2^64: enough to give words places in a table, where other words may have the same."""

    def __init__(self, folded: np.ndarray):
        up, down = (np.full(_STEP, b, np.uint64) for b in (_BASE, pow(_BASE, -1, 1 << 64)))
        up[0] = down[0] = 1
        up, self.down = np.multiply.accumulate(up), np.multiply.accumulate(down)
        blocks = len(folded) // _STEP
        factors = [np.array([pow(b, k * _STEP, 1 << 64) for k in range(blocks)], np.uint64) for b in (_BASE, pow(_BASE, -1, 1 << 64))]
        self.back = factors[1]
        self.sums = np.zeros(len(folded) + 1, np.uint64)
        np.cumsum((folded.reshape(blocks, _STEP) * up * factors[0][:, None]).reshape(-1), out=self.sums[1:])

    def between(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.down[start & (_STEP - 1)] * self.back[start >> 16]


def short_hashes(data: np.ndarray, width: int) -> np.ndarray:
    """Hash of the `width` bytes (16 at most) from each place on: they are read as one or two numbers, without a polynomial."""
    n = len(data) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    room = np.concatenate([data, np.zeros(8, np.uint8)])
    low = np.ndarray((n,), "<u8", room, strides=(1,))
    if width < 8:
        return mix((low & np.uint64((1 << 8 * width) - 1)) + np.uint64(_BASE))
    high = np.ndarray((n,), "<u8", room, offset=width - 8, strides=(1,))
    return mix(mix(low + np.uint64(_BASE)) + high)


class Words:
    """Words of several texts: byte bounds and hashes; first[i] to first[i + 1] are those of text i.

    With `places` the hashes only serve as places in a table: they cost less, and words that cancel out share one.
    Bounds and prefix sums are made when they are first asked for.
    """

    def __init__(self, texts: list[str | None], ends: np.ndarray = BLANK, fold: np.ndarray = KEEP, places: bool = False):
        raw = [(t or "").encode() for t in texts]
        self.data = np.frombuffer(b" ".join([*raw, b""]) if raw else b"", np.uint8)
        sizes = np.fromiter((len(r) for r in raw), np.int64, len(raw))
        self.text_start = np.concatenate([[0], np.cumsum(sizes + 1)])
        self.ends, self.fold, self.places = ends, fold, places

    @cached_property
    def _bounds(self) -> tuple[np.ndarray, np.ndarray]:
        inside = ~self.ends[self.data]
        edge = np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0))
        return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)

    @property
    def start(self) -> np.ndarray:
        return self._bounds[0]

    @property
    def end(self) -> np.ndarray:
        return self._bounds[1]

    @cached_property
    def first(self) -> np.ndarray:
        return np.searchsorted(self.start, self.text_start)

    @cached_property
    def sums(self) -> list:
        padded = np.zeros((len(self.data) // _STEP + 1) * _STEP, np.uint64)
        padded[: len(self.data)] = self.fold[self.data]
        padded[: len(self.data)] += np.uint64(1)
        return [_Places(padded)] if self.places else [_Sums(padded, which) for which in range(len(_BASES))]

    @cached_property
    def hash(self) -> np.ndarray:
        return self.between(self.start, self.end)

    def between(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of each byte range; equal bytes give equal hashes wherever they lie."""
        one, *other = (sums.between(start, end) for sums in self.sums)
        return mix(one << _SHIFT | other[0] if other else one)


def shingles(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of `width` words, in order; position counts, so a run and its reverse differ."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:n].copy()
    for k in range(1, width):
        out = out * np.uint64(_BASE) + hashes[k : k + n]
    return mix(out)
