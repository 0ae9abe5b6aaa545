r"""Problem 4: cutting oversized texts and files at natural boundaries, with an overlap.

A text or file is taken in ranges. Each range finds the boundaries in its own characters and those of two halos, and makes a
table from them: for every place at which a piece may end that began in the range before, where the chain of cuts that
starts there leaves the range, and after how many pieces. The tables of a file are stitched: one pass over them, in order,
gives each range the place at which the real chain enters it, the number of its first piece and its first character
(prefix sums). With these, each range emits its pieces by offset. So a cut depends on the text alone, not on the
ranges; no text is gathered in a group, and no file is read as a whole.

A piece ends at the last paragraph end of its second half, else at the last sentence end there, else at the last word end, else
at the limit. A paragraph end is the end of blanks that hold, in their last ``limit`` characters, two line ends or a form feed
or paragraph separator. Every piece after the first begins with the last ``overlap`` characters of the one before.

Results: null texts and texts within the limit have no pieces; files within it are one piece, empty files none; positions count
code points; malformed bytes of files count as U+FFFD.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamis.functions.session import free_name

LIMIT, OVERLAP = 4000, 200
RANGE_CHARS = 1 << 14
RANGE_BYTES = 4 << 20
SENTENCE = re.compile(r"[.!?…]+[\"'”’»)\]]*(?=\s)|[。！？]+[」』”’]*")


@lru_cache(maxsize=1)
def _blank() -> np.ndarray:
    return np.fromiter((chr(c).isspace() for c in range(0x110000)), bool, 0x110000)


class Range:
    """The characters [begin, end) of a text, with those before and after them in ``text``; ``origin`` is the offset of text[0].

    ``total`` is the length of the whole text where ``text`` reaches to its end, else None."""

    def __init__(self, text: str, origin: int, begin: int, end: int, total: int | None, limit: int, overlap: int):
        self.text, self.origin, self.begin, self.end, self.total, self.limit, self.overlap = text, origin, begin, end, total, limit, overlap
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        blank = _blank()[codes]
        feed, back = codes == 0x0A, codes == 0x0D
        line = (feed | back) & ~np.concatenate([back[:-1] & feed[1:], [False]]) if len(codes) else feed  # CR LF counts at its LF
        lines = np.concatenate([[0], np.cumsum(line + 2 * ((codes == 0x0C) | (codes == 0x2029)))])
        after = np.flatnonzero(blank[:-1] & ~blank[1:]) + 1  # first characters after blanks
        words = np.flatnonzero(~blank[:-1] & blank[1:]) + 1  # blanks after characters
        start = np.concatenate([[0], words])[np.searchsorted(words, after, side="left")]
        self.paragraphs = after[lines[after] - lines[np.maximum(start, after - limit)] >= 2] + origin
        self.sentences = np.fromiter((m.end() for m in SENTENCE.finditer(text)), np.int64) + origin
        self.words = words + origin

    def cuts(self, at: np.ndarray) -> np.ndarray:
        """Where the piece after a cut at ``at`` ends."""
        low, high = at + self.overlap, at + self.limit - self.overlap
        half = np.maximum(low, high - self.limit // 2)
        out = high
        for ends, least in ((self.words, low), (self.sentences, half), (self.paragraphs, half)):
            if len(ends):
                last = ends[np.maximum(np.searchsorted(ends, high, side="right") - 1, 0)]
                out = np.where((last > least) & (last <= high), last, out)
        if self.total is not None:
            out = np.where(self.total - low + 2 * self.overlap <= self.limit, self.total, out)
        return out

    def first(self) -> int:
        """The cut that the first piece of the text counts as following."""
        return self.overlap

    def table(self) -> tuple[np.ndarray, np.ndarray]:
        """For each entry (a cut at begin + entry): the exit (the last cut less ``end``) and the number of pieces."""
        first = self.begin == 0
        at = np.array([self.first()]) if first else self.begin + np.arange(self.limit - self.overlap)
        count = np.zeros(len(at), np.int64)
        todo = (at < self.end) | (first & (self.end > 0))
        while todo.any():
            places, where = np.unique(at[todo], return_inverse=True)
            at[todo] = self.cuts(places)[where]
            count[todo] += 1
            todo = at < self.end
        return at - self.end, count

    def pieces(self, entry: int) -> list[tuple[int, int, str]]:
        """(start, stop, piece) of the pieces whose cut before them is in the range; a cut at begin + entry is the first one."""
        first = self.begin == 0
        at, out = (self.first() if first else self.begin + entry), []
        while at < self.end or (first and not out and self.end > 0):
            stop = int(self.cuts(np.array([at]))[0])
            start = at - self.overlap
            out.append((start, stop, self.text[start - self.origin : stop - self.origin]))
            at = stop
        return out


def stitched(tables: list[tuple[np.ndarray, np.ndarray]]) -> tuple[list[int], list[int]]:
    """The entry of each range and the number of pieces before it, from the tables in order."""
    entries, before, entry, n = [], [], 0, 0
    for exits, counts in tables:
        entries.append(entry)
        before.append(n)
        entry, n = int(exits[entry]), n + int(counts[entry])
    return entries, before


def split(text: str, limit: int = LIMIT, overlap: int = OVERLAP, range_chars: int = RANGE_CHARS) -> list[tuple[int, int, str]]:
    """(start, stop, piece) of a text in memory: the ranges one after the other."""
    n = len(text)
    ranges = []
    for begin in range(0, n, range_chars):
        end, origin = min(n, begin + range_chars), max(0, begin - limit - 1)
        to = min(n, end + 2 * limit)
        ranges.append(Range(text[origin:to], origin, begin, end, n if to == n else None, limit, overlap))
    entries, _ = stitched([r.table() for r in ranges])
    return [piece for r, entry in zip(ranges, entries) for piece in r.pieces(entry)]


PIECES = "array<struct<start: bigint, stop: bigint, piece: string>>"


def _splitter(limit: int, overlap: int, range_chars: int):
    @F.arrow_udf(PIECES)
    def run(texts: pa.Array) -> pa.Array:
        out = [[{"start": a, "stop": b, "piece": t} for a, b, t in split(text, limit, overlap, range_chars)] for text in texts.to_pylist()]
        return pa.array(out, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("piece", pa.string())])))

    return run


def split_texts(df: DataFrame, key: str = "parsed_id", text: str = "text", limit: int = LIMIT, overlap: int = OVERLAP, range_chars: int = RANGE_CHARS) -> DataFrame:
    """``key``, piece_no, start_char, n_chars, piece of the texts longer than ``limit``. Repeated keys must have been told apart before."""
    p = free_name([key], "_p")
    long = df.where(F.length(text) > limit).select(F.col(key), _splitter(limit, overlap, range_chars)(F.col(text)).alias(p))
    flat = long.select(key, F.posexplode(p).alias("piece_no", p))
    return flat.select(key, "piece_no", F.col(f"{p}.start").alias("start_char"), (F.col(f"{p}.stop") - F.col(f"{p}.start")).cast("int").alias("n_chars"), F.col(f"{p}.piece").alias("piece"))


# ---- files ----------------------------------------------------------------------------------------------------


def _lead(data: bytes, at: int) -> int:
    """The first byte from ``at`` that begins a character."""
    while at < len(data) and data[at] & 0xC0 == 0x80:
        at += 1
    return at


def read_range(path: str, begin: int, end: int, size: int, limit: int, overlap: int) -> tuple[Range, int]:
    """The range of the characters that begin in the bytes [begin, end) of a file; its offsets count from its own first
    character. Any file system that Arrow knows by the path's scheme will do. Also the number of its characters."""
    from pyarrow import fs

    scheme = re.match(r"[a-z0-9+.-]+://[^/]", path)
    system, name = fs.FileSystem.from_uri(path) if scheme else (fs.LocalFileSystem(), re.sub("^file:/+", "/", path))
    low, high = max(0, begin - 4 * (limit + 1)), min(size, end + 8 * limit + 4)
    with system.open_input_file(name) as f:
        data = f.read_at(high - low, low)
    a, b = _lead(data, begin - low), _lead(data, end - low)
    before, own, after = (x.decode("utf-8", "replace") for x in (data[_lead(data, 0) if low else 0 : a], data[a:b], data[b : _lead(data, len(data) - 3) if high < size else len(data)]))
    # an inner range counts from ``limit``, so that nothing of it lies at 0, where a text begins
    at = 0 if begin == 0 else limit
    total = at + len(own) + len(after) if high == size else None
    return Range(before + own + after, at - len(before), at, at + len(own), total, limit, overlap), len(own)


def split_files(spark: SparkSession, paths: list[str] | str, limit: int = LIMIT, overlap: int = OVERLAP, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """path, piece_no, start_char, n_chars, piece of UTF-8 files (or folders of them), each range read by its offset, twice:
    for its table and for its pieces."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths).select("path", F.col("length").alias("size")).where("size > 0")
    last = F.floor((F.col("size") - 1) / range_bytes).cast("int")
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = files.select("path", "size", F.explode(F.sequence(F.lit(0), last)).alias("range_no")).repartition(width, "path", "range_no")

    def of(row: dict) -> tuple[Range, int]:
        begin = row["range_no"] * range_bytes
        return read_range(row["path"], begin, min(row["size"], begin + range_bytes), row["size"], limit, overlap)

    def table(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                part, n = of(row)
                exits, counts = part.table()
                blobs = [zstandard.compress(x.astype(np.int32).tobytes(), 1) for x in (exits, counts)]
                yield pa.RecordBatch.from_pylist([row | {"n": n, "exits": blobs[0], "counts": blobs[1]}], schema=pa.schema([("path", pa.string()), ("size", pa.int64()), ("range_no", pa.int32()), ("n", pa.int64()), ("exits", pa.binary()), ("counts", pa.binary())]))

    def stitch(tables: pa.Table) -> pa.Table:
        rows = tables.sort_by("range_no").to_pylist()
        parts = ([np.frombuffer(zstandard.decompress(r[c]), np.int32) for c in ("exits", "counts")] for r in rows)
        entries, before = stitched(parts)
        starts = np.cumsum([0, *(r["n"] for r in rows)])[:-1]
        columns = [[r[c] for r in rows] for c in ("path", "size", "range_no")]
        return pa.table(dict(zip(("path", "size", "range_no", "entry", "before", "starts"), [pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int32()), pa.array(entries, pa.int32()), pa.array(before, pa.int64()), pa.array(starts, pa.int64())])))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                part, _ = of(row)
                found = part.pieces(row["entry"])
                moved = row["starts"] - part.begin
                numbers = range(row["before"], row["before"] + len(found))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["path"]] * len(found), pa.string()), pa.array(numbers, pa.int64()), pa.array([a + moved for a, _, _ in found], pa.int64()), pa.array([b - a for a, b, _ in found], pa.int32()), pa.array([t for _, _, t in found], pa.string())],
                    ["path", "piece_no", "start_char", "n_chars", "piece"],
                )

    tables = ranges.mapInArrow(table, "path string, size bigint, range_no int, n bigint, exits binary, counts binary")
    plan = tables.groupBy("path").applyInArrow(stitch, "path string, size bigint, range_no int, entry int, before bigint, starts bigint")
    return plan.repartition(width, "path", "range_no").mapInArrow(emit, "path string, piece_no bigint, start_char bigint, n_chars int, piece string")


def found(df: DataFrame) -> DataFrame:
    return split_texts(df).select("parsed_id").distinct()
