"""Words and hashes of words, over bytes. Everything here runs inside tasks."""

from __future__ import annotations

import numpy as np
import xxhash

UPPER_TO_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
#: A-Z become lower case; every other ASCII byte that is neither digit nor letter becomes a blank.
ALNUM_OR_BLANK = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)
MIX_1, MIX_2, STEP = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), np.uint64(0x9E3779B97F4A7C15)
SHIFT = np.uint64(33)


def blank_words(text: bytes | None) -> list[bytes]:
    """Words between ASCII white space, as they are."""
    return text.split() if text else []


def lower_words(text: bytes | None) -> list[bytes]:
    """Words between ASCII white space, A-Z in lower case."""
    return text.translate(UPPER_TO_LOWER).split() if text else []


def alnum_words(text: bytes | None) -> list[bytes]:
    """Runs of ASCII letters, digits and non-ASCII characters, A-Z in lower case."""
    return text.translate(ALNUM_OR_BLANK).split() if text else []


class WordHashes(dict):
    """Word -> 64-bit hash, remembered for at most `limit` words."""

    def __init__(self, limit: int = 250_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> SHIFT)) * MIX_1
    values = (values ^ (values >> SHIFT)) * MIX_2
    return values ^ (values >> SHIFT)


def window_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash for each run of `size` consecutive words; none where there are fewer."""
    count = len(hashes) - size + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    total = hashes[:count].copy()
    for at in range(1, size):
        total *= STEP
        total += hashes[at : at + count]
    return mixed(total)


def shingle_set(hashes: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct shingle hashes; of fewer words than `size`, the whole sequence is one."""
    if not len(hashes):
        return np.empty(0, np.uint64)
    return np.unique(window_hashes(hashes, min(size, len(hashes))))


def covered(starts: np.ndarray, size, length: int) -> np.ndarray:
    """Mask over `length` words: those inside a window that begins at one of `starts`."""
    change = np.zeros(length + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, np.minimum(starts + size, length), -1)
    return np.cumsum(change[:-1]) > 0
