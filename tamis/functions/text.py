"""Text and byte expressions that stay in the JVM, and the two functions that it lacks (Arrow UDFs)."""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from tamis.patterns import STEALTH


STRIPPED = rf"[{STEALTH}\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"
#: The same and a few more, in few ranges: quick to rule out.
MAYBE_STRIPPED = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{2069}\x{FEFF}]"


def strip_stealth(text: Column) -> Column:
    """Without zero-width and bidi characters, and without C0 controls but tab, LF and CR."""
    return F.when(text.rlike(MAYBE_STRIPPED), F.regexp_replace(text, STRIPPED, "")).otherwise(text)


def nfkc(text: Column) -> Column:
    @F.arrow_udf("string")
    def run(batch: pa.Array) -> pa.Array:
        return pa.array([t if t is None or t.isascii() else unicodedata.normalize("NFKC", t) for t in batch.to_pylist()], pa.string())

    return run(text)


def count_of(text: Column, piece: str) -> Column:
    """Occurrences of a literal."""
    return F.floor((F.length(text) - F.length(F.replace(text, F.lit(piece), F.lit("")))) / len(piece)).cast("int")


def count_chars(text: Column, chars: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, chars, ""))).cast("int")


def matches(text: Column, pattern: str) -> Column:
    """All matches as an array; [] for null."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.array().cast("array<string>"))


def latin1(content: Column) -> Column:
    """Bytes as characters of the same numbers, for patterns over bytes."""
    return F.decode(content, "ISO-8859-1")


def byte_entropy(content: Column) -> Column:
    """Shannon entropy in bits over bytes; 0 for empty and null values."""

    @F.arrow_udf("double")
    def run(batch: pa.Array) -> pa.Array:
        counts = (np.bincount(np.frombuffer(x.as_buffer(), np.uint8), minlength=256) if x.is_valid else np.zeros(256, np.int64) for x in batch)
        return pa.array([_of_counts(c) for c in counts])

    return run(content)


def _of_counts(counts: np.ndarray) -> float:
    p = counts[counts > 0] / max(int(counts.sum()), 1)
    return float(-(p * np.log2(p)).sum() + 0.0)


def entropies_of(strings: list[str | None]) -> np.ndarray:
    """Shannon entropy in bits over the characters of each string, counted together; 0 for empty and null ones."""
    sizes = np.fromiter((len(s or "") for s in strings), np.int64, len(strings))
    if not sizes.sum():
        return np.zeros(len(strings))
    codes = np.frombuffer("".join(s or "" for s in strings).encode("utf-32-le", "surrogatepass"), np.uint32)
    keys, counts = np.unique(np.repeat(np.arange(len(strings)), sizes) << 21 | codes, return_counts=True)
    of = keys >> 21
    p = counts / sizes[of]
    return np.bincount(of, -p * np.log2(p), minlength=len(strings)) + 0.0
