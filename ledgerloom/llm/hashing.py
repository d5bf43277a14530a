"""Vectorised hashing of word sequences, used inside Python workers."""

from __future__ import annotations

import numpy as np
import xxhash

#: Entries that a worker's cache of word hashes holds before it starts afresh.
CACHE = 1 << 16
_MIX = np.uint64(0x9E3779B97F4A7C15)
_A, _B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_hashes = _Hashes()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))


#: Bytes of a text that are hashed at once, whatever its length; a longer word is one piece.
CHUNK = 1 << 20
_ODD = 0x9E3779B97F4A7C15
_space = np.zeros(256, bool)
_space[[9, 10, 11, 12, 13, 32]] = True
_powers = _inverses = np.ones(1, np.uint64)


def _geometric(ratio: int, n: int) -> np.ndarray:
    """``ratio ** i`` modulo 2**64 for i below ``n``."""
    out, step = np.ones(1, np.uint64), np.uint64(ratio)
    while len(out) < n:
        out = np.concatenate([out, out * step])
        step = step * step
    return out


def text_hashes(raw: bytes, cased: bool = False) -> np.ndarray:
    """Hashes of the words of a text: runs of other than ASCII white space, A-Z as a-z unless ``cased``.

    Sums of byte values times powers of an odd number run over the whole text; a word's
    hash is a difference of two of them, moved back to the word's start by an inverse power.
    """
    global _powers, _inverses
    found, at = [], 0
    values = _cased if cased else _values
    with np.errstate(over="ignore"):
        while at < len(raw):
            end = len(raw)
            if end - at > CHUNK:
                piece = np.frombuffer(raw, np.uint8, end - at, at)
                gap = np.flatnonzero(_space[piece[:CHUNK]])
                if len(gap):
                    end = at + int(gap[-1]) + 1
                else:
                    gap = next((k for k in range(CHUNK, len(piece)) if _space[piece[k]]), None)
                    end = len(raw) if gap is None else at + gap + 1
            b = np.frombuffer(raw, np.uint8, end - at, at)
            if len(_powers) <= len(b):
                _powers = _geometric(_ODD, len(b) + 1)
                _inverses = _geometric(pow(_ODD, -1, 1 << 64), len(b) + 1)
            space = np.ones(len(b) + 2, bool)
            space[1:-1] = _space[b]
            edges = np.flatnonzero(space[1:] != space[:-1])
            run = np.zeros(len(b) + 1, np.uint64)
            np.cumsum(values[b] * _powers[: len(b)], out=run[1:])
            first, last = edges[::2], edges[1::2]
            found.append(scramble((run[last] - run[first]) * _inverses[first] ^ (last - first).astype(np.uint64)))
            at = end
    return found[0] if len(found) == 1 else np.concatenate([np.empty(0, np.uint64), *found])


def scramble(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * _A
    x = (x ^ (x >> np.uint64(27))) * _B
    return x ^ (x >> np.uint64(31))


def mix(x: np.ndarray, bits: int) -> np.ndarray:
    """``scramble`` within ``bits`` bits; no two numbers become one."""
    low = np.uint64((1 << bits) - 1)
    x = (x ^ (x >> np.uint64(30))) * _A & low
    x = (x ^ (x >> np.uint64(27))) * _B & low
    return x ^ (x >> np.uint64(31))


def unmix(x: np.ndarray, bits: int) -> np.ndarray:
    """The inverse of ``mix``."""
    low = np.uint64((1 << bits) - 1)
    for shift, factor in ((31, _B), (27, _A)):
        x = x ^ (x >> np.uint64(shift)) ^ (x >> np.uint64(2 * shift))
        x = x * np.uint64(pow(int(factor), -1, 1 << bits)) & low
    return x ^ (x >> np.uint64(30)) ^ (x >> np.uint64(60))


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` consecutive word hashes."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    m = len(h) - n + 1
    out, factor = np.full(m, n, np.uint64), 1
    for j in range(n):
        factor = factor * _ODD % (1 << 64)
        out += h[j : j + m] * np.uint64(factor)
    return scramble(out)


def distinct(x: np.ndarray) -> np.ndarray:
    """The distinct values in order."""
    x = np.sort(x)
    first = np.ones(len(x), bool)
    np.not_equal(x[1:], x[:-1], out=first[1:])
    return x[first]


# A value for each byte, the same for an upper-case letter and its lower case.
_cased = scramble(np.arange(1, 257, dtype=np.uint64) * _MIX)
_values = _cased.copy()
_values[65:91] = _values[97:123]
