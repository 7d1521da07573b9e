"""Vectorised word and shingle hashes over UTF-8 bytes.

A word's hash is the polynomial sum of random byte values, taken from one running sum over
the whole buffer (the difference of two prefix sums, scaled back by the inverse power of the
start), then mixed. So a batch of documents costs a few numpy passes instead of a Python call
per word. Hashes have 64 bits: two different shingles of a pair of documents with n shingles
each fall together with a probability of about n * n / 2**64.
"""

from __future__ import annotations

import numpy as np

#: Bytes of text hashed at a time; a longer buffer is cut at white space.
PIECE = 1 << 19

_GOLDEN = 0x9E3779B97F4A7C15
_BASE = 0xD1342543DE82EF95
_WRAP = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finalizer."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _series(n: int, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(_GOLDEN) + np.uint64(seed))


_BYTE = _series(256, 11)
_PLACE = _series(64, 29) | np.uint64(1)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Separators: white space (space and 9 to 13), or all ASCII but digits and letters.
WHITE = np.zeros(256, bool)
WHITE[[32, 9, 10, 11, 12, 13]] = True
NO_ALNUM = np.zeros(256, bool)
NO_ALNUM[:128] = [not chr(i).isalnum() for i in range(128)]

_powers = np.ones(1, np.uint64)
_inverse = np.ones(1, np.uint64)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverse
    if len(_powers) < n:
        n = max(n, PIECE + 1)
        with np.errstate(over="ignore"):
            step = np.full(n, _BASE, np.uint64)
            step[0] = 1
            _powers = np.cumprod(step)
            step[1:] = pow(_BASE, -1, 1 << 64)
            _inverse = np.cumprod(step)
    return _powers, _inverse


def _cuts(data: np.ndarray, separator: np.ndarray) -> list[int]:
    """Ends of pieces of about PIECE bytes; none divides a word."""
    cuts, at = [], 0
    while len(data) - at > PIECE:
        near = np.flatnonzero(separator[data[at : at + PIECE]])
        if len(near):
            at += int(near[-1]) + 1
        else:
            step = at + PIECE
            while step < len(data):
                near = np.flatnonzero(separator[data[step : step + PIECE]])
                if len(near):
                    break
                step += PIECE
            at = min(len(data), step + (int(near[0]) + 1 if len(near) else PIECE))
        cuts.append(at)
    if at < len(data):
        cuts.append(len(data))
    return cuts


def word_hashes(data: np.ndarray, bounds: np.ndarray, separator: np.ndarray = WHITE, most: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words, A-Z in lower case, and for each bound the number of words before it.

    bounds: offsets of the documents in `data`, the end included; words end at them.
    most: hash only so many bytes from a word's start.
    """
    found, starts, at = [], [], 0
    with np.errstate(over="ignore"):
        for end in _cuts(data, separator):
            text = LOWER[data[at:end]]
            n = len(text)
            word = ~separator[text]
            before = np.zeros(n, bool)
            before[1:] = word[:-1]
            after = np.zeros(n, bool)
            after[:-1] = word[1:]
            inner = bounds[np.searchsorted(bounds, at, "right") : np.searchsorted(bounds, end, "left")] - at
            before[inner] = False
            after[inner - 1] = False
            first, last = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1
            if most is not None:
                last = np.minimum(last, first + most)
            power, inverse = _power_tables(n)
            total = np.zeros(n + 1, np.uint64)
            np.cumsum(_BYTE[text] * power[:n], out=total[1:])
            h = (total[last] - total[first]) * inverse[first]
            found.append(mix(h + (last - first).astype(np.uint64) * np.uint64(_GOLDEN)))
            starts.append(first + at)
            at = end
    hashes = np.concatenate(found) if found else np.zeros(0, np.uint64)
    begin = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    return hashes, np.searchsorted(begin, bounds, "left")


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """The hash of the `width` words from each word on; the last `width - 1` have none."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        total = np.zeros(n, np.uint64)
        for j in range(width):
            total += words[j : j + n] * _PLACE[j]
        return mix(total + np.uint64(width * _GOLDEN & _WRAP))


def shingle_sets(data: np.ndarray, bounds: np.ndarray, width: int):
    """For each document its distinct shingles, sorted; one of all words if it has under `width`."""
    words, first = word_hashes(data, bounds)
    rolled = shingle_hashes(words, width)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= width:
            own = np.sort(rolled[a : b - width + 1])
            fresh = np.empty(len(own), bool)
            fresh[0] = True
            np.not_equal(own[1:], own[:-1], out=fresh[1:])
            yield own[fresh]
        elif b > a:
            yield shingle_hashes(words[a:b], b - a)
        else:
            yield words[:0]


def batches(bounds: np.ndarray, most: int = PIECE):
    """Slices of documents with about `most` bytes together, or one longer document."""
    at, n = 0, len(bounds) - 1
    while at < n:
        end = max(at + 1, int(np.searchsorted(bounds, bounds[at] + most, "right")) - 1)
        yield at, min(end, n)
        at = min(end, n)
