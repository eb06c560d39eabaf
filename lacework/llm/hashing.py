"""Vectorised hashes of the words and word runs of many texts at once."""

from __future__ import annotations

import numpy as np

U = np.uint64
_BASE = U(0x9E3779B97F4A7C15 | 1)
_INVERSE = U(pow(int(_BASE), -1, 1 << 64))
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


#: A random number for each byte, so that a text's hash is no plain polynomial of its bytes.
_BYTE = mix(np.arange(1, 257, dtype=U) * U(0xD1342543DE82EF95))


class Powers:
    """Powers of the base and of its inverse, kept as long as they have been asked for."""

    up = np.ones(1, U)
    down = np.ones(1, U)

    @classmethod
    def to(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, 1 << 16)
            for name, base in (("up", _BASE), ("down", _INVERSE)):
                powers = np.full(size, base, U)
                powers[0] = 1
                setattr(cls, name, np.cumprod(powers, dtype=U))
        return cls.up[:n], cls.down[:n]


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """s, one longer than the bytes: the hash of data[i:j] is (s[j] - s[i]) * inverse base ^ i."""
    up, _ = Powers.to(len(data) + 1)
    out = np.zeros(len(data) + 1, U)
    np.cumsum(_BYTE[data] * up[:-1], out=out[1:])
    return out


def word_hashes(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Of all words between ASCII white space, A-Z lower-cased: 64-bit hashes, and each text's first word's number (and the end)."""
    data = _LOWER[np.frombuffer(b" ".join([t or b"" for t in texts]) + b" ", np.uint8)]
    space = _SPACE[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], space]).astype(np.int8)))
    starts, ends = edge[0::2], edge[1::2]
    sums = prefix_sums(data)
    _, down = Powers.to(len(data) + 1)
    hashes = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U))
    sizes = np.array([len(t or b"") + 1 for t in texts])
    return hashes, np.searchsorted(starts, np.concatenate([[0], np.cumsum(sizes)]))


def shingle_sets(texts: list[bytes | None], k: int, seed: int = 0) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's runs of k words; fewer words are one run; without words there is none."""
    words, first = word_hashes(texts)
    rng = mix(np.arange(1, k + 2, dtype=U) + U(seed * 1000 + 1)) | U(1)
    runs = np.zeros(max(len(words) - k + 1, 0), U)
    for j in range(k):
        runs += words[j : j + len(runs)] * rng[j]
    runs = mix(runs)
    out = []
    for lo, hi in zip(first, first[1:], strict=False):
        if hi - lo >= k:
            out.append(np.unique(runs[lo : hi - k + 1]))
        elif hi > lo:
            out.append(mix((words[lo:hi] * rng[: hi - lo]).sum(keepdims=True, dtype=U) + rng[k : k + 1] * U(hi - lo)))
        else:
            out.append(np.zeros(0, U))
    return out
