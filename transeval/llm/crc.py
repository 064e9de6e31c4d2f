"""crc32 of many pieces of text at once, each between two characters of a joined text."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1)
    return t


CRC_TABLE = _crc_table()


class Joined:
    """``words`` end to end, each between two marks of one character; ``raw``: as UTF-8;
    ``ends``: where characters start in it, and the end; ``size``: characters of each word with
    its marks; ``first``: number of its first mark."""

    def __init__(self, words: Sequence[str], left: str, right: str):
        text = left + f"{right}{left}".join(words) + right if words else ""
        self.raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
        self.ends = np.append(np.flatnonzero((self.raw & 0xC0) != 0x80), len(self.raw))
        self.size = np.fromiter(map(len, words), np.int64, len(words)) + 2
        self.first = np.cumsum(self.size) - self.size

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each run of ``n`` characters inside a word and its marks, in order: the word's
        number, the run's number in it, and the number of its first character."""
        many = np.maximum(self.size - n + 1, 0)
        word = np.repeat(np.arange(len(many)), many)
        nth = np.arange(len(word)) - np.repeat(np.cumsum(many) - many, many)
        return word, nth, self.first[word] + nth

    def crc(self, start: np.ndarray, stop: np.ndarray, before: int = 0) -> np.ndarray:
        """``zlib.crc32(text[start:stop], before)`` for each pair of character numbers."""
        return spans_crc(self.raw, self.ends[start], self.ends[stop], before)


def spans_crc(raw: np.ndarray, a: np.ndarray, z: np.ndarray, before: int = 0) -> np.ndarray:
    """``zlib.crc32(raw[a:z], before)`` for each pair of byte positions."""
    crc = np.full(len(a), before ^ 0xFFFFFFFF, np.uint32)
    if len(a):
        size = z - a
        least = int(size.min())
        for k in range(least):
            crc = CRC_TABLE[(crc ^ raw[a + k]) & 0xFF] ^ (crc >> 8)
        for k in range(least, int(size.max())):
            i = np.flatnonzero(size > k)
            crc[i] = CRC_TABLE[(crc[i] ^ raw[a[i] + k]) & 0xFF] ^ (crc[i] >> 8)
    return crc ^ np.uint32(0xFFFFFFFF)
