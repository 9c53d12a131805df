"""Words and shingle sets of many texts at once, as numpy arrays over the texts' bytes.

Words are runs of bytes other than ASCII white space; A-Z count as a-z. A word is known by a 64-bit hash of its bytes, a
shingle by a 64-bit hash of its words in order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_RANDOM = np.random.default_rng(20240521)
_BYTE = _RANDOM.integers(0, 1 << 64, 256, dtype=np.uint64, endpoint=False)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_STEP = np.uint64(0x9E3779B97F4A7C15)
_ONE = np.uint64(0xBF58476D1CE4E5B9)
_TWO = np.uint64(0x94D049BB133111EB)
_WINDOW = 1 << 20  # bytes hashed at a time


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * _ONE
    x = (x ^ (x >> np.uint64(27))) * _TWO
    return x ^ (x >> np.uint64(31))


class _Powers:
    table = np.ones(1, dtype=np.uint64)

    @classmethod
    def up_to(cls, n: int) -> np.ndarray:
        if len(cls.table) < n:
            powers = np.full(max(n, 256), _STEP | np.uint64(1), dtype=np.uint64)
            powers[0] = 1
            cls.table = np.cumprod(powers)
        return cls.table


def _hash_window(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of each word of a piece that cuts no word."""
    letters = ~_SPACE[data]
    edges = np.diff(np.concatenate(([False], letters, [False])).astype(np.int8))
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    if not len(starts):
        return starts, np.zeros(0, dtype=np.uint64)
    at = np.flatnonzero(letters)
    lengths = ends - starts
    first = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    inside = np.arange(len(at)) - np.repeat(first, lengths)
    terms = _BYTE[_LOWER[data[at]]] * _Powers.up_to(int(lengths.max()))[inside]
    return starts, mixed(np.add.reduceat(terms, first) + lengths.astype(np.uint64) * _ONE)


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of every word, window by window; a window ends at white space."""
    whole = np.frombuffer(data, dtype=np.uint8)
    starts, hashes, begin = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.uint64)], 0
    while begin < len(whole):
        end = min(begin + _WINDOW, len(whole))
        while end < len(whole):  # on to the next white space
            ahead = np.flatnonzero(_SPACE[whole[end : end + _WINDOW]])
            end = end + int(ahead[0]) if len(ahead) else min(end + _WINDOW, len(whole))
            if len(ahead):
                break
        s, h = _hash_window(whole[begin:end])
        starts.append(s + begin)
        hashes.append(h)
        begin = end
    return np.concatenate(starts), np.concatenate(hashes)


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """The sorted distinct shingle hashes of one text's word hashes; a text of fewer words is one shingle, if it has any."""
    n = min(size, len(words))
    if not n:
        return np.zeros(0, dtype=np.uint64)
    total = np.full(len(words) - n + 1, n, dtype=np.uint64)
    for i in range(n):
        total = mixed(total * _STEP + words[i : len(words) - n + 1 + i])
    return np.unique(total)


def shingle_sets(texts: list[str | None], size: int) -> Iterator[np.ndarray]:
    """The shingle set of each text, in order; about a window of bytes is worked on at a time."""
    group: list[bytes] = []
    held = 0

    def flush():
        offsets = np.concatenate(([0], np.cumsum([len(g) + 1 for g in group])))
        starts, hashes = word_hashes(b" ".join(group))
        cuts = np.searchsorted(starts, offsets)
        for a, b in zip(cuts[:-1], cuts[1:]):
            yield shingles(hashes[a:b], size)

    for text in texts:
        group.append(b"" if text is None else text.encode("utf-8", "surrogatepass"))
        held += len(group[-1])
        if held >= _WINDOW:
            yield from flush()
            group, held = [], 0
    if group:
        yield from flush()
