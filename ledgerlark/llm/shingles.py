"""Word shingles of many texts at once, as sorted 64-bit hashes."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

SHINGLE_WORDS = 5
#: Texts are hashed in slices of about so many bytes.
SLICE_BYTES = 2 << 20
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> np.ndarray:
    out = np.full(n, ODD, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64))
#: A number for each letter at each of a word's first places.
PLACES = 64
AT_PLACE = mix(np.arange(1, PLACES * 256 + 1, dtype=np.uint64) * ODD)


def placed(letters: np.ndarray, place: np.ndarray) -> np.ndarray:
    """A number for each letter and its place, unlike those of all others in every bit; sums of them tell words apart.

    A polynomial modulo a power of two doesn't: it is the same for long words whose halves are exchanged again and again.
    """
    at = place << 8 | letters
    if not len(at) or int(place.max()) < PLACES:
        return AT_PLACE[at]
    out = AT_PLACE[np.minimum(at, PLACES * 256 - 1)]
    far = np.flatnonzero(place >= PLACES)
    out[far] = mix((at[far] + 1).astype(np.uint64) * ODD)
    return out


@dataclass
class Slice:
    """Distinct shingles of some texts: those of text i are hashes[starts[i]:starts[i + 1]], ascending."""

    hashes: np.ndarray
    starts: np.ndarray

    @property
    def sizes(self) -> np.ndarray:
        return np.diff(self.starts)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and where each text's words start."""
    joined = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    text_ends = np.cumsum([len(t) + 1 for t in texts])
    inside = np.concatenate([[False], ~IS_SPACE[joined]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    lengths = ends - starts
    if not len(starts):
        return np.empty(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    total = np.cumsum(lengths)
    place = np.arange(total[-1]) - np.repeat(total - lengths, lengths)
    letters = LOWER[joined[inside[1:]]]
    values = placed(letters, place)
    hashes = mix(np.add.reduceat(values, total - lengths) + lengths.astype(np.uint64) * ODD)
    return hashes, np.concatenate([[0], np.searchsorted(starts, text_ends)])


def shingle_slice(texts: list[bytes], width: int = SHINGLE_WORDS) -> Slice:
    """The distinct shingles of each text; of fewer words than ``width``, the whole sequence is the only one."""
    words, starts = word_hashes(texts)
    counts = np.diff(starts)
    n = np.where(counts >= width, counts - width + 1, (counts > 0).astype(np.int64))
    out_starts = np.concatenate([[0], np.cumsum(n)])
    first = np.arange(out_starts[-1]) - np.repeat(out_starts[:-1], n) + np.repeat(starts[:-1], n)
    padded = np.concatenate([words, np.zeros(width, np.uint64)])
    owner_words = np.repeat(np.minimum(counts, width), n)
    value = owner_words.astype(np.uint64) * ODD
    for k in range(width):
        value += np.where(k < owner_words, padded[first + k], np.uint64(0)) * powers(k + 2)[k + 1]
    hashes = mix(value)
    for a, b in zip(out_starts[:-1].tolist(), out_starts[1:].tolist(), strict=True):
        hashes[a:b].sort()
    fresh = np.ones(len(hashes), bool)
    fresh[1:] = hashes[1:] != hashes[:-1]
    heads = out_starts[:-1][n > 0]
    fresh[heads] = True
    return Slice(hashes[fresh], np.concatenate([[0], np.cumsum(fresh)])[out_starts])


def slices(texts: list[bytes], limit: int = SLICE_BYTES):
    """(first, last) of runs of texts with about ``limit`` bytes."""
    first, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t)
        if held >= limit:
            yield first, i + 1
            first, held = i + 1, 0
    if first < len(texts):
        yield first, len(texts)


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two ascending arrays of distinct numbers."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int(np.count_nonzero(b[at] == a)) if len(b) else 0
