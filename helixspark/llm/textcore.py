"""Vectorised word work on UTF-8 bytes, for the operators that run in Python workers.

Words are maximal runs of bytes outside a separator table. A batch of texts is
handled as one byte buffer: word limits come from one comparison, word hashes
from eight bytes of every word at a time, so nothing loops over words in Python.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import xxhash

_U = np.uint64
_LANE_STEP = _U(0xD1342543DE82EF95)
_LONG_WORD = 256

#: ASCII white space: \x20 and \x09-\x0D.
SPACES = np.zeros(256, dtype=bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True

#: A-Z to a-z, every other byte to itself.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit over the output."""
    h = h ^ (h >> _U(30))
    h = h * _U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> _U(27))
    h = h * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def word_limits(data: np.ndarray, separators: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in ``data`` (uint8)."""
    inside = np.zeros(len(data) + 2, dtype=np.int8)
    inside[1:-1] = ~separators[data]
    step = np.diff(inside)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, the same wherever the word stands.

    Every eight bytes are mixed into the state by a bijection, so words of one
    length that differ in one such lane alone can't share a hash, and no regular
    pattern cancels out as in a polynomial. Words over 256 bytes take xxh3.
    """
    sizes = ends - starts
    out = mix(sizes.astype(np.uint64) * _LANE_STEP + _U(1))
    if not len(starts):
        return out
    padded = np.concatenate((data, np.zeros(8, dtype=np.uint8)))
    lanes = np.ndarray((len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    long = sizes > _LONG_WORD
    open_, at, left = (np.flatnonzero(~long), starts[~long], sizes[~long]) if long.any() else (np.arange(len(starts)), starts, sizes)
    while len(open_):
        lane = lanes[at]
        short = left < 8
        lane[short] &= (_U(1) << (left[short].astype(np.uint64) * _U(8))) - _U(1)
        out[open_] = mix((out[open_] + _LANE_STEP) ^ mix(lane + _LANE_STEP))
        more = left > 8
        open_, at, left = open_[more], at[more] + 8, left[more] - 8
    for i in np.flatnonzero(long):
        out[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]].tobytes(), 1)
    return out


def pair_hashes(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hashes of ordered pairs of hashes."""
    return mix(left * _U(0xA0761D6478BD642F) + (right ^ (right >> _U(29))) * _U(0xE7037ED1A0B428DB) + _U(0x8EBC6AF09C88C6E3))


def text_groups(texts: Iterable[str | None], limit: int = 2 << 20) -> Iterator[list[bytes]]:
    """The texts as UTF-8, in groups of about ``limit`` bytes; null becomes empty."""
    group: list[bytes] = []
    held = 0
    for text in texts:
        raw = b"" if text is None else text.encode("utf-8", "surrogatepass")
        if group and held + len(raw) > limit:
            yield group
            group, held = [], 0
        group.append(raw)
        held += len(raw) + 1
    if group:
        yield group


def group_words(group: list[bytes], lower: bool = False, separators: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For texts joined by one separator byte: data, text offsets, word starts, ends, and each text's first word.

    ``first`` has one entry more than there are texts. The separator is a blank,
    which every table here treats as one.
    """
    data = np.frombuffer(b" ".join(group), dtype=np.uint8)
    if lower:
        data = LOWER[data]
    sizes = np.fromiter((len(x) + 1 for x in group), dtype=np.int64, count=len(group))
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    starts, ends = word_limits(data, separators)
    first = np.searchsorted(starts, offsets)
    first[-1] = len(starts)
    return data, offsets, starts, ends, first
