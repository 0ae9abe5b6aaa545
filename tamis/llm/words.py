"""Words of many texts at once, as 64-bit hashes taken from the bytes of an Arrow column."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
SLICE = 1 << 20  # bytes looked at once; a longer text is a slice of its own
#: Odd and 5 modulo 8, so that its powers differ from each other in the low bits as late as possible.
BASE = np.uint64(0x9E3779B97F4A7C15)
DROPPED, KEPT, BLANK = 0, 1, 2


@lru_cache(maxsize=2)
def _classes(digits: bool) -> np.ndarray:
    table = np.full(256, KEPT, np.uint8)
    table[[ord(c) for c in PUNCTUATION + ("" if digits else "0123456789")]] = DROPPED
    table[[ord(c) for c in " \t\r\n"]] = BLANK
    return table


@lru_cache(maxsize=1)
def _values() -> np.ndarray:
    return np.random.default_rng(5).integers(0, 1 << 64, 256, np.uint64)


def lowered(column: pa.Array) -> pa.Array:
    """Lower case, null as empty. Two letters whose lower case depends on what stands around, or is two letters, go by Python."""
    column = column.cast(pa.large_string()).fill_null("")
    try:
        special = pc.match_substring_regex(column, "[İΣ]")
        out = pc.utf8_lower(column)
    except pa.ArrowInvalid:  # broken UTF-8
        column = pa.array([x.decode("utf-8", "replace") for x in column.cast(pa.large_binary()).to_pylist()], pa.large_string())
        return lowered(column)
    if special.true_count:
        by_hand = pa.array([x.lower() for x in column.filter(special).to_pylist()], pa.large_string())
        out = pc.replace_with_mask(out, special, by_hand)
    return out


def _hashes(data: np.ndarray, starts: np.ndarray, digits: bool) -> tuple[np.ndarray, np.ndarray]:
    kind = _classes(digits)[data]
    mark = (kind == BLANK).astype(np.int32)
    np.add.at(mark, starts[starts < len(data)], 1)
    kept = np.flatnonzero(kind == KEPT)
    if not len(kept):
        return np.empty(0, np.uint64), np.zeros(len(starts), np.int64)
    gap = np.cumsum(mark, dtype=np.int32)[kept]
    first = np.flatnonzero(np.concatenate([[True], gap[1:] != gap[:-1]]))
    size = np.diff(np.concatenate([first, [len(kept)]]))
    place = np.arange(len(kept)) - np.repeat(first, size)
    powers = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(int(size.max()), BASE)]))
    value = np.add.reduceat(_values()[data[kept]] * powers[place], first)
    value ^= value >> np.uint64(31)
    value = value * np.uint64(0xBF58476D1CE4E5B9) + size.astype(np.uint64)
    row = np.searchsorted(starts, kept[first], side="right") - 1
    return value, np.bincount(row, minlength=len(starts))


def word_hashes(column: pa.Array, digits: bool = False) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, word hashes, words of each row) of slices of the column: lower-cased words without ASCII punctuation
    (and, unless ``digits``, ASCII digits), split at blanks, tabs, CR and LF. Null texts have no words."""
    column = lowered(column)
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.empty(0, np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE, side="right")) - 1)
        part = offsets[at : to + 1]
        with np.errstate(over="ignore"):
            value, count = _hashes(data[part[0] : part[-1]], part[:-1] - part[0], digits)
        yield at, value, count
        at = to
