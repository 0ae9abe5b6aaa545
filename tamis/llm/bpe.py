"""Problem 7: byte-level BPE of a whole corpus in batched numpy merge rounds.

A batch of texts is one UTF-8 buffer. Its code points are classified by a table, the pre-token starts follow from
the classes by array arithmetic (no per-word regex), Arrow dictionary-encodes the pre-tokens, and only the distinct
ones are merged: the symbols of all of them lie in one flat array, each round finds the rank of every changed pair
by binary search over the sorted pair keys, and merges the lowest-ranked pair of every word at once.

Results: null and empty texts give an empty list (or 0 tokens); strings that look like special tokens are text.
"""

from __future__ import annotations

import json
import os
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

TOKENIZER_DIR = "/opt/tokenizers"
CHUNK_BYTES = 4 << 20  # text handled at once by a worker; bounds its memory
CACHE_WORDS = 400_000
SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3
# The code points with the White_Space property.
WHITE_SPACE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def tokenizer_path(name: str = "byte_bpe_50k.json", folder: str = TOKENIZER_DIR) -> str:
    return os.path.join(folder, name)


@lru_cache(1)
def class_table() -> np.ndarray:
    """Class of every code point: white space, letter, number or other."""
    kinds = {"L": LETTER, "N": NUMBER}
    table = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(sys.maxunicode + 1)), np.uint8, sys.maxunicode + 1)
    table[WHITE_SPACE] = SPACE
    return table


def printable_bytes() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies write for the 256 bytes."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(rest)}


def read_merges(path: str) -> dict[str, np.ndarray]:
    """Sorted pair keys with their ranks and merged ids, and the id of each byte. Size bounded by the vocabulary."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    vocab, merges = model["vocab"], [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    left, right, made = (np.array(x, np.int64) for x in zip(*((vocab[a], vocab[b], vocab[a + b]) for a, b in merges)))
    keys = left << 32 | right
    order = np.argsort(keys, kind="stable")
    first = np.r_[True, np.diff(keys[order]) != 0]
    byte_ids = np.zeros(256, np.int32)
    for shown, b in printable_bytes().items():
        byte_ids[b] = vocab[shown]
    return {"keys": keys[order][first], "ranks": order[first].astype(np.int32), "made": made[order][first].astype(np.int32), "bytes": byte_ids}


def pretoken_starts(points: np.ndarray, kinds: np.ndarray, doc_start: np.ndarray) -> np.ndarray:
    """Mask of the code points at which a pre-token starts. ``doc_start`` has one more entry than ``points``, the last True."""
    n = len(points)
    start = doc_start[:n].copy()
    start[1:] |= kinds[1:] != kinds[:-1]
    # the last blank of a run goes with what follows if it is U+0020, and stands alone otherwise
    last = np.flatnonzero((kinds[:-1] == SPACE) & (kinds[1:] != SPACE) & ~doc_start[1:n])
    start[last] = True
    start[last[points[last] == 32] + 1] = False
    quote = np.flatnonzero((points[:-1] == 39) & start[:-1] & (kinds[1:] == LETTER) & ~doc_start[1:n])
    if len(quote):
        padded, pk = np.append(points, [0, 0, 0]), np.append(kinds, [OTHER] * 3)
        ends = np.append(doc_start, [True, True, True])
        a, b = padded[quote + 1], np.where(ends[quote + 2], 0, padded[quote + 2])
        one = np.isin(a, [ord(c) for c in "stmd"])
        two = ((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
        start[quote[one | two] + 1] = False
        after = np.concatenate([quote[one] + 2, quote[two] + 3])
        after = after[(pk[after] == LETTER) & ~ends[after]]
        start[after] = True
    return start


def merge_words(words: list[bytes], t: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words, one after the other, and the number of ids of each."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    sym = t["bytes"][np.frombuffer(b"".join(words), np.uint8)]
    word = np.repeat(np.arange(len(words), dtype=np.int32), lengths)
    keys, top, far = t["keys"], len(t["keys"]) - 1, np.iinfo(np.int32).max

    def look(at: np.ndarray) -> np.ndarray:
        """Places in the pair table of the pairs that begin at ``at``; -1 where there is none."""
        nxt = np.minimum(at + 1, len(sym) - 1)
        key = sym[at].astype(np.int64) << 32 | sym[nxt]
        place = np.minimum(np.searchsorted(keys, key), top)
        return np.where((keys[place] == key) & (word[at] == word[nxt]) & (nxt != at), place, -1)

    place = look(np.arange(len(sym))) if len(sym) else np.empty(0, np.int64)
    done: list[tuple[np.ndarray, np.ndarray]] = []
    while len(sym):
        rank = np.where(place >= 0, t["ranks"][place], far)
        begins = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        lowest = np.minimum.reduceat(rank, begins)
        size = np.diff(np.r_[begins, len(sym)])
        if (over := lowest == far).any():
            gone = np.repeat(over, size)
            done.append((word[gone], sym[gone]))
            word, sym, place, rank = word[~gone], sym[~gone], place[~gone], rank[~gone]
            lowest, size = lowest[~over], size[~over]
            if not len(sym):
                break
        hit = np.flatnonzero(rank == np.repeat(lowest, size))
        if len(hit) > 1 and (np.diff(hit) == 1).any():  # of overlapping hits (a a a) every other one counts
            run = np.maximum.accumulate(np.where(np.r_[True, np.diff(hit) != 1], np.arange(len(hit)), 0))
            hit = hit[(np.arange(len(hit)) - run) % 2 == 0]
        sym[hit] = t["made"][place[hit]]
        keep = np.ones(len(sym), bool)
        keep[hit + 1] = False
        moved = hit - np.arange(len(hit))
        sym, word, place = sym[keep], word[keep], place[keep]
        again = np.unique(np.concatenate([moved, moved[moved > 0] - 1]))
        place[again] = look(again)
    if not done:
        return np.empty(0, np.int32), lengths
    word, sym = (np.concatenate(x) for x in zip(*done))
    return sym[np.argsort(word, kind="stable")].astype(np.int32), np.bincount(word, minlength=len(words))


class Encoder:
    """Keeps the ids of the words met so far, up to CACHE_WORDS, for one Python worker."""

    def __init__(self, tables: dict[str, np.ndarray]):
        self.tables = tables
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.begin = np.empty(0, np.int32), np.zeros(1, np.int64)

    def words(self, distinct: list[str]) -> np.ndarray:
        if len(self.known) > CACHE_WORDS:
            self.clear()
        known = self.known
        new = [w for w in distinct if w not in known]
        if new:
            ids, size = merge_words([w.encode() for w in new], self.tables)
            known.update(zip(new, range(len(known), len(known) + len(new))))
            self.flat = np.concatenate([self.flat, ids])
            self.begin = np.concatenate([self.begin, self.begin[-1] + np.cumsum(size)])
        return np.fromiter(map(known.__getitem__, distinct), np.int64, len(distinct))

    def chunk(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For texts without nulls: the word of each pre-token, and the pre-tokens and ids of each text."""
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        if offsets[-1] == offsets[0]:
            return np.empty(0, np.int64), np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        lead = np.flatnonzero((data & 0xC0) != 0x80)  # the byte at which each code point starts
        doc_start = np.zeros(len(points) + 1, bool)
        doc_start[np.searchsorted(lead, offsets)] = True
        doc_start[-1] = True
        at = lead[pretoken_starts(points, class_table()[points], doc_start)]
        tokens = pa.StringArray.from_buffers(len(at), pa.py_buffer(np.append(at, len(data)).astype(np.int32)), pa.py_buffer(data))
        coded = tokens.dictionary_encode()
        of = self.words(coded.dictionary.to_pylist())[coded.indices.to_numpy(zero_copy_only=False)]
        bounds = np.searchsorted(at, offsets)
        size = (self.begin[1:] - self.begin[:-1])[of]
        total = np.concatenate([[0], np.cumsum(size)])
        return of, np.diff(bounds), np.diff(total[bounds])

    def counts(self, texts: pa.StringArray) -> np.ndarray:
        return self.chunk(texts)[2]

    def ids(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        of, _, n = self.chunk(texts)
        size = self.begin[of + 1] - self.begin[of]
        ends = np.cumsum(size)
        if not len(ends):
            return np.empty(0, np.int32), n
        return self.flat[np.arange(ends[-1]) + np.repeat(self.begin[of] - (ends - size), size)], n


def chunks(texts: pa.Array) -> Iterator[pa.StringArray]:
    """Slices of about CHUNK_BYTES, nulls as empty texts. A longer single text is a slice of its own."""
    texts = texts.cast(pa.string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK_BYTES, side="right")) - 1)
        yield texts.slice(at, end - at)
        at = end


def _shared(spark: SparkSession, path: str):
    return spark.sparkContext.broadcast(read_merges(path))  # at most the vocabulary, about 1 MB


def token_ids(spark: SparkSession, text: Column, path: str | None = None) -> Column:
    """array<int> of the token ids of ``text``; an empty array for null and empty texts."""
    tables = _shared(spark, path or tokenizer_path())

    @F.arrow_udf("array<int>")
    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = Encoder(tables.value)
        for batch in batches:
            parts = [encoder.ids(x) for x in chunks(batch)] or [(np.empty(0, np.int32), np.empty(0, np.int64))]
            sizes = np.concatenate([n for _, n in parts])
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            yield pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([x for x, _ in parts])))

    return ids(text)


def token_count(spark: SparkSession, text: Column, path: str | None = None) -> Column:
    """bigint number of tokens of ``text``; 0 for null and empty texts."""
    tables = _shared(spark, path or tokenizer_path())

    @F.arrow_udf("bigint")
    def counts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = Encoder(tables.value)
        for batch in batches:
            yield pa.array(np.concatenate([encoder.counts(x) for x in chunks(batch)] or [np.empty(0, np.int64)]), pa.int64())

    return counts(text)
