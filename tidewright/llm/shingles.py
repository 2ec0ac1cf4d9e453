"""Word shingles of whole texts as sorted 64-bit sets."""

from __future__ import annotations

import numpy as np
import xxhash

WORDS = 5
#: Odd multipliers, one for each place of a shingle.
MULTIPLIERS = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63))


class WordHashes:
    """64-bit hashes of words. None is kept: to hash a word anew takes no longer than to look it up, and texts with many rare words would turn a store of them over again and again."""

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, words)), ">u8").astype(np.uint64)


def shingle_set(text: str | None, known: WordHashes) -> np.ndarray:
    """The sorted distinct hashes of the text's five-word shingles, A-Z in lower case; of fewer words, one hash of them all; else empty."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    hashes = known.of(words)
    n = max(1, len(words) - WORDS + 1)
    mixed = np.full(n, len(words) if len(words) < WORDS else WORDS, np.uint64)
    for place in range(min(len(words), WORDS)):
        mixed ^= hashes[place : place + n]
        mixed *= MULTIPLIERS[place]
        mixed ^= mixed >> np.uint64(31)
    mixed.sort()
    first = np.ones(n, bool)
    np.not_equal(mixed[1:], mixed[:-1], out=first[1:])
    return mixed[first]


def set_digest(shingles: np.ndarray) -> tuple[int, int]:
    """A name of the set: both halves of 128 bits, signed."""
    whole = xxhash.xxh3_128_intdigest(shingles.tobytes())
    return (whole & (1 << 64) - 1) - 2**63, (whole >> 64) - 2**63
