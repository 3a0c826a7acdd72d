"""Word shingles as 64-bit hashes, made for many texts at once."""

from __future__ import annotations

import numpy as np
import xxhash

_multiplier = np.uint64(0x9E3779B97F4A7C15)
_bytes = np.array([xxhash.xxh64_intdigest(bytes([b])) for b in range(256)], dtype="u8")
_powers = np.cumprod(np.full(1 << 16, 0x9E3779B97F4A7C15 | 1, dtype="u8"))
#: A-Z in lower case, ASCII white space as a space, all other bytes as they are.
_plain = bytes(b + 32 if 65 <= b <= 90 else 32 if 9 <= b <= 13 else b for b in range(256))
#: Bytes of text that are hashed together.
PART_BYTES = 1 << 20


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _multiplier
    return h ^ (h >> np.uint64(29))


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word between spaces, and where it starts: sums over its bytes, weighted
    by place."""
    a = np.frombuffer(data, dtype="u1")
    letter = a != 32
    edge = np.flatnonzero(np.diff(letter.astype("i1"), prepend=0, append=0))
    starts, lengths = edge[0::2], edge[1::2] - edge[0::2]
    if not len(starts):
        return np.empty(0, dtype="u8"), starts
    first = np.cumsum(lengths) - lengths
    place = np.arange(int(lengths.sum())) - np.repeat(first, lengths)
    return mixed(np.add.reduceat(_bytes[a[letter]] * _powers[place & 0xFFFF], first)), starts


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of size word hashes, in order."""
    n = len(words) - size + 1
    if n <= 0:
        return np.empty(0, dtype="u8")
    h = np.zeros(n, dtype="u8")
    for k in range(size):
        h = h * _multiplier + words[k : k + n]
    return mixed(h)


def shingle_lists(texts: list[str | None], size: int) -> list[np.ndarray]:
    """The shingle hashes of each text, repeats included; fewer words than size: one of all.
    Words are lower-cased (A-Z) and stand between ASCII white space."""
    out: list[np.ndarray] = []
    data, held = [], 0
    for k, text in enumerate(texts):
        data.append((text or "").encode("utf-8", "replace").translate(_plain))
        held += len(data[-1]) + 1
        if held >= PART_BYTES or k + 1 == len(texts):
            words, starts = word_hashes(b" ".join(data))
            ends = np.searchsorted(starts, np.cumsum([len(x) + 1 for x in data]))
            runs, first = shingles(words, size), 0
            for end in ends.tolist():
                n = end - first
                out.append(runs[first : end - size + 1] if n >= size else shingles(words[first:end], n) if n else runs[:0])
                first = end
            data, held = [], 0
    return out
