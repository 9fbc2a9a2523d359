"""Sets of word shingles as arrays of 64-bit hashes, of many texts at once."""

from __future__ import annotations

import numpy as np

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
#: A random odd-ish 64-bit value for each byte, from a fixed seed.
_VALUES = np.random.Generator(np.random.PCG64(20)).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE, _INVERSE = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    done = 1
    while done < n:
        step = np.uint64(pow(int(base), done, 2**64))
        out[done : 2 * done] = out[: min(done, n - done)] * step
        done *= 2
    return out


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that leaves none of their order."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_sets(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text, by text and then by hash, and how many each text has.

    Words are what white space (0x20, 0x09 to 0x0D) leaves, in lower-case ASCII. A text of fewer words than ``width`` has its whole
    sequence as one shingle; one without a word has none. A shingle is hashed over its words joined by one space each.
    """
    data = np.frombuffer(b" ".join([b"", *texts, b""]), np.uint8)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    starts = np.cumsum(sizes + 1) - sizes
    space = _SPACE[data]
    keep = ~space
    keep[1:] |= ~space[:-1]  # one space stays behind each word
    keep[0] = False
    text_of = np.searchsorted(starts, np.flatnonzero(keep & ~space & np.concatenate([[True], space[:-1]])), "right") - 1
    data = _LOWER[data[keep]]
    space = _SPACE[data]
    data[space] = 0x20
    end = np.flatnonzero(space)
    begin = np.concatenate([[0], end[:-1] + 1]) if len(end) else end
    if not len(end):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUES[data] * _powers(_BASE, len(data)), out=total[1:])
    words = np.bincount(text_of, minlength=len(texts))
    first = np.cumsum(words) - words
    count = np.where(words >= width, words - width + 1, (words > 0).astype(np.int64))
    span = np.minimum(words, width)
    text = np.repeat(np.arange(len(texts)), count)
    at = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)
    b, e = begin[at], end[at + span[text] - 1]
    length = (e - b).astype(np.uint64)
    hashes = mixed((total[e] - total[b]) * _powers(_INVERSE, len(data))[b] + length * np.uint64(0xD6E8FEB86659FD93))
    order = np.lexsort((hashes, text))
    hashes, text = hashes[order], text[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
    return hashes[new], np.bincount(text[new], minlength=len(texts))
