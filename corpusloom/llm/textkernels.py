"""Vectorised text kernels on numpy arrays: rolling hashes, minimizers, words, codes."""

from __future__ import annotations

import numpy as np

U64 = np.uint64
#: Base of the polynomial hash; odd, so that it has an inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
BASE_INV = pow(BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser that spreads every bit of a 64-bit word."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


class Powers:
    """Powers of the base and its inverse, grown on demand."""

    def __init__(self) -> None:
        self.up = self._powers(BASE, 1 << 16)
        self.down = self._powers(BASE_INV, 1 << 16)

    @staticmethod
    def _powers(base: int, n: int) -> np.ndarray:
        out = np.full(n, base, dtype=U64)
        out[0] = 1
        return np.multiply.accumulate(out)

    def need(self, n: int) -> None:
        if n > len(self.up):
            size = 1 << (n - 1).bit_length()
            self.up, self.down = self._powers(BASE, size), self._powers(BASE_INV, size)


_POWERS: Powers | None = None


def powers(n: int) -> Powers:
    global _POWERS
    if _POWERS is None:
        _POWERS = Powers()
    _POWERS.need(n)
    return _POWERS


def prefix_sums(codes: np.ndarray) -> np.ndarray:
    """S with S[j] - S[i] = sum of codes[t] * BASE**t for i <= t < j, modulo 2**64."""
    p = powers(len(codes) + 1)
    out = np.zeros(len(codes) + 1, dtype=U64)
    np.cumsum((codes.astype(U64) + U64(1)) * p.up[: len(codes)], out=out[1:])
    return out


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of codes[start:end] for each pair, independent of the position."""
    p = powers(len(sums))
    return mix((sums[ends] - sums[starts]) * p.down[starts])


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each window of ``width`` values (van Herk's two sweeps over blocks)."""
    n = len(values)
    pad = -n % width
    filled = np.concatenate([values, np.full(pad, values.max(), dtype=values.dtype)]).reshape(-1, width)
    forward = np.minimum.accumulate(filled, axis=1).ravel()
    backward = np.minimum.accumulate(filled[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(backward[: n - width + 1], forward[width - 1 : n])


def minimizers(text: str, gram: int, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of ``gram``-character passages such that two texts with a
    common span of ``span`` characters have a passage of that span in common.

    Of each ``span - gram + 1`` successive passages the one with the least hash is taken;
    equal hashes are all taken, so the choice depends on the content alone.
    """
    codes = code_points(text)
    if len(codes) < span:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=U64)
    sums = prefix_sums(codes)
    p = powers(len(sums))
    starts = len(codes) - gram + 1
    hashes = mix((sums[gram:] - sums[:starts]) * p.down[:starts])
    width = span - gram + 1
    least = sliding_min(hashes, width)
    # a passage is chosen if it equals the minimum of some window that covers it
    n = len(least)
    low = np.concatenate([np.zeros(width - 1, dtype=U64), least, np.zeros(width - 1, dtype=U64)])
    # the largest of the window minima over windows covering position i
    top = ~sliding_min(~low, width)
    chosen = np.flatnonzero(hashes == top[: n + width - 1])
    return chosen, hashes[chosen]


_WORD_BYTES = np.zeros(256, dtype=bool)
for _c in b"abcdefghijklmnopqrstuvwxyz0123456789_":
    _WORD_BYTES[_c] = True


def word_hashes(text: str) -> np.ndarray:
    """Hash of every run of a-z, 0-9 and _ in the lower-cased text, in order."""
    raw = np.frombuffer(text.lower().encode("ascii", "replace").replace(b"?", b" "), dtype=np.uint8)
    if not len(raw):
        return np.zeros(0, dtype=U64)
    inside = np.zeros(len(raw) + 2, dtype=np.int8)
    inside[1:-1] = _WORD_BYTES[raw]
    turn = np.diff(inside)
    starts, ends = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
    return span_hashes(prefix_sums(raw), starts, ends)


def shingle_set(text: str, size: int = 3) -> np.ndarray:
    """Sorted distinct hashes of all sequences of ``size`` successive words."""
    words = word_hashes(text)
    if len(words) < size:
        return np.zeros(0, dtype=U64)
    out = words[: len(words) - size + 1].copy()
    for k in range(1, size):
        out = mix(out * U64(0x9E3779B97F4A7C15) + words[k : len(words) - size + 1 + k])
    return np.unique(out)


class BitFingerprint:
    """A similarity-hash fingerprint of ``lanes`` lanes of 8 bits.

    Every lane keeps 8 bits of the least permuted hash of the set, so two sets with
    similarity s agree in a lane with probability s + (1 - s) / 256; the number of
    differing lanes estimates 1 - s.  ``segments`` are the lanes packed by fours into
    32-bit blocks that can be joined on.
    """

    def __init__(self, lanes: int = 128, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.lanes = lanes
        self.mul = (rng.integers(0, 1 << 62, lanes, dtype=np.int64).astype(U64) << U64(1)) | U64(1)
        self.add = rng.integers(0, 1 << 62, lanes, dtype=np.int64).astype(U64)

    def code(self, items: np.ndarray) -> np.ndarray:
        least = np.empty(self.lanes, dtype=U64)
        for k in range(0, self.lanes, 16):
            h = items[None, :] * self.mul[k : k + 16, None] + self.add[k : k + 16, None]
            h ^= h >> U64(29)
            h *= U64(0xBF58476D1CE4E5B9)
            least[k : k + 16] = h.min(axis=1)
        return (mix(least) & U64(255)).astype(np.uint8)

    @staticmethod
    def segments(code: np.ndarray) -> np.ndarray:
        return code.view(np.uint32).astype(np.int64)
