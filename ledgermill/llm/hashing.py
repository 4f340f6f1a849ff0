"""Vectorised hashes: of byte spans, of words, and of runs of words."""

from __future__ import annotations

import numpy as np

#: Odd constants; the finisher is the 64-bit one of MurmurHash3.
BASE = 0x9E3779B97F4A7C15 | 1
MIX_A, MIX_B = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
S33 = np.uint64(33)
#: Texts are hashed in pieces of about this many characters, cut at white space, so memory does not follow the longest text.
PIECE = 1 << 20


def mix64(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> S33)
    x = x * MIX_A
    x ^= x >> S33
    x = x * MIX_B
    x ^= x >> S33
    return x


def seeds(n: int, seed: int) -> np.ndarray:
    """n fixed random 64-bit numbers."""
    return mix64(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(BASE) + np.uint64(seed))


BYTE = seeds(256, 11)


class _Powers:
    def __init__(self):
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """BASE**i and its inverse modulo 2**64, for i < n."""
        if len(self.up) < n:
            m = max(n, 2 * len(self.up), 1 << 14)
            step = np.full(m, BASE, dtype=np.uint64)
            step[0] = 1
            self.up = np.multiply.accumulate(step)
            step[1:] = pow(BASE, -1, 1 << 64)
            self.down = np.multiply.accumulate(step)
        return self.up[:n], self.down[:n]


POWERS = _Powers()


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each data[start:end] (uint8): equal spans hash alike wherever they stand."""
    up, down = POWERS.upto(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(BYTE[data] * up[:-1], out=sums[1:])
    h = (sums[ends] - sums[starts]) * down[starts]
    return mix64(h ^ ((ends - starts).astype(np.uint64) * MIX_B))


SPACE = np.zeros(256, dtype=bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs without ASCII white space."""
    solid = np.ones(len(data) + 2, dtype=np.int8)
    solid[0] = solid[-1] = 0
    solid[1:-1] -= SPACE[data]
    edge = np.flatnonzero(np.diff(solid))
    return edge[::2], edge[1::2]


def pieces(raw: bytes, size: int = PIECE):
    """raw in pieces of about ``size`` bytes that end at ASCII white space; a longer run without any stays whole."""
    at = 0
    while len(raw) - at > size:
        cut = max(raw.rfind(c, at, at + size) for c in (b" ", b"\n", b"\t", b"\r"))
        if cut <= at:
            later = [k for k in (raw.find(c, at + size) for c in (b" ", b"\n", b"\t", b"\r")) if k >= 0]
            if not later:
                break
            cut = min(later)
        yield raw[at : cut + 1]
        at = cut + 1
    yield raw[at:]


def word_hashes(text: str) -> np.ndarray:
    """Hash of every word of a text, in order."""
    out = []
    for raw in pieces(text.encode("utf-8", "surrogatepass")):
        data = np.frombuffer(raw, dtype=np.uint8)
        starts, ends = word_spans(data)
        if len(starts):
            out.append(span_hashes(data, starts, ends))
    return np.concatenate(out) if len(out) > 1 else out[0] if out else np.empty(0, dtype=np.uint64)


RUN = seeds(64, 29) | np.uint64(1)


def run_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of n words; of a shorter text's words together; of none, nothing."""
    if not len(words):
        return words
    n = min(n, len(words))
    m = len(words) - n + 1
    h = words[:m] * RUN[0]
    for k in range(1, n):
        h = h + words[k : k + m] * RUN[k]
    return mix64(h + np.uint64(n))


def shingles(text: str, n: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of n words."""
    return np.unique(run_hashes(word_hashes(text), n))
