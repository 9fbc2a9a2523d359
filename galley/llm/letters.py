"""Code points, letters, scripts and words of many texts at once, as numpy arrays."""

from __future__ import annotations

from functools import cache

import numpy as np

#: Script ranges: first and last code point. Letters outside them are of script 0. Fixed values.
SCRIPT_RANGES = {
    "Latin": ((0x0041, 0x024F), (0x0250, 0x02AF), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xFF21, 0xFF5A)),
    "Greek": ((0x0370, 0x03FF), (0x1F00, 0x1FFF)),
    "Cyrillic": ((0x0400, 0x052F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)),
    "Armenian": ((0x0530, 0x058F),),
    "Hebrew": ((0x0590, 0x05FF),),
    "Arabic": ((0x0600, 0x06FF), (0x0750, 0x077F), (0x08A0, 0x08FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)),
    "Devanagari": ((0x0900, 0x097F),),
    "Bengali": ((0x0980, 0x09FF),),
    "Gurmukhi": ((0x0A00, 0x0A7F),),
    "Gujarati": ((0x0A80, 0x0AFF),),
    "Tamil": ((0x0B80, 0x0BFF),),
    "Telugu": ((0x0C00, 0x0C7F),),
    "Kannada": ((0x0C80, 0x0CFF),),
    "Malayalam": ((0x0D00, 0x0D7F),),
    "Thai": ((0x0E00, 0x0E7F),),
    "Georgian": ((0x10A0, 0x10FF), (0x1C90, 0x1CBF)),
    "Hangul": ((0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF)),
    "Ethiopic": ((0x1200, 0x137F),),
    "Khmer": ((0x1780, 0x17FF),),
    "Kana": ((0x3040, 0x30FF), (0x31F0, 0x31FF)),
    "Han": ((0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF)),
}
N_SCRIPTS = len(SCRIPT_RANGES) + 1


@cache
def tables() -> tuple[np.ndarray, np.ndarray]:
    """For each code point: its lower-case form where it is a letter, else 0; and its script, a number from 0."""
    lower = np.zeros(0x110000, np.uint32)
    for k in range(0x110000):
        c = chr(k)
        if c.isalpha():
            small = c.lower()
            lower[k] = ord(small) if len(small) == 1 else k
    script = np.zeros(0x110000, np.uint8)
    for number, ranges in enumerate(SCRIPT_RANGES.values(), 1):
        for first, last in ranges:
            script[first : last + 1] = number
    return lower, script


def joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all texts with a 0 before, between and behind them, and where each text starts."""
    points = np.frombuffer(("\0" + "\0".join(texts) + "\0\0\0").encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    starts = np.ones(len(texts), np.int64)
    np.cumsum(lengths[:-1] + 1, out=starts[1:])
    starts[1:] += 1
    return points, starts
