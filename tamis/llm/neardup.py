"""Problem 5: exact Jaccard join of shingle sets with set-relation skipping.

Rows of equal sets form a class and one member stands for it; the other members' answers are derived from its
answers. The tokens of a set are ordered by their frequency in all sets (a count table of bounded size, so ties and
clashes only cost work), rarest first. Two sets of sizes x >= y that reach the threshold t share at least
a = ceil(t / (1 + t) * (x + y)) tokens, so at least 1 + floor(SHARED * y) of the shared ones lie where a - floor(SHARED * y)
tokens of either set are still to come. Only such places are indexed. A token's index list is split into blocks by
position and ordered by size within a block; a probing set meets only the sizes that its own position and the block's
position allow, so blocks and their ends are skipped without being read. The list of a token that is much more frequent
than others is cut into lots of sets, and each pair of lots is a task of its own.

Pairs with enough such tokens are candidates. Each set is first compared with its leader, the least set that it is a
candidate pair with. The answers of two sets with one leader are then derived from what they share with it: with
r = leader, they share at least |a & r| + |b & r| - |r| tokens and at most min(|a & r|, |b & r|) + min(|a - r|, |b - r|), which settles many pairs without
any token. Of other pairs of sets that are similar to their leader, the answer follows from the differences to it alone:
|a & b| = |r| - |r - a| - |r - b| + |(r - a) & (r - b)| + |(a - r) & (b - r)|. Only pairs without a common similar leader are
compared themselves. So a group of k similar sets takes about k comparisons of whole sets, not k * k. Nothing is capped: a long list only means more work in its tasks.

Tokens are 40-bit hashes (a clash inside a pair of n-token sets has probability n * n / 2**40), the digest of a set has 128 bits.
Texts with fewer than ``least_words`` words and null texts have no set and no partners.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import StorageLevel, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamis.functions.session import cut
from tamis.llm.words import word_hashes

TOKEN_BYTES = 5
SHARED = 0.05
LEAST_BITS, MOST_BITS = 20, 26  # of the count table: at most 64 MB of one-byte levels
FAN_IN = 64  # count tables that are added up by one task
BUCKET_ENTRIES = 400_000
HOT_ENTRIES = 100_000  # a token whose list may be longer, and that is HOT_TIMES as frequent as the mean, is cut into lots of sets
HOT_TIMES = 8
MOST_LOTS = 4095
CLASS_LOT = 2_000  # members of a class that one task pairs with as many others
BLOCKS = 3
EXPAND = 2_000_000  # pairs looked at once by a worker


def _pack(tokens: np.ndarray) -> bytes:
    return tokens.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :TOKEN_BYTES].tobytes()


def _unpack(data: np.ndarray) -> np.ndarray:
    wide = np.zeros((len(data) // TOKEN_BYTES, 8), np.uint8)
    wide[:, :TOKEN_BYTES] = data.reshape(-1, TOKEN_BYTES)
    return wide.view("<u8").ravel()


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of all sets of a binary column and the size of each set."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if offsets[-1] > offsets[0] else np.empty(0, np.uint8)
    return _unpack(data), np.diff(offsets) // TOKEN_BYTES


def _set_builder(width: int, least_words: int):
    @F.arrow_udf("struct<size: int, digest: binary, tokens: binary>")
    def build(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            counts, sets = [], []
            for _, flat, sizes in word_hashes(column, digits=True):
                doc = np.repeat(np.arange(len(sizes)), sizes)
                n = max(0, len(flat) - width + 1)
                key = np.zeros(n, np.uint64)
                with np.errstate(over="ignore"):
                    for k in range(width):
                        key = (key ^ flat[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
                        key ^= key >> np.uint64(32)
                begins = np.flatnonzero((doc[:n] == doc[n and width - 1 :][:n]) & (sizes[doc[:n]] >= least_words))
                pair = np.sort(doc[begins].astype(np.uint64) << np.uint64(40) | key[begins] >> np.uint64(24))
                pair = pair[np.concatenate([[True], pair[1:] != pair[:-1]])] if len(pair) else pair
                count = np.bincount((pair >> np.uint64(40)).astype(np.int64), minlength=len(sizes))
                packed, at = _pack(pair & np.uint64((1 << 40) - 1)), 0
                for c in count.tolist():
                    sets.append(packed[at : at + c * TOKEN_BYTES] if c else None)
                    at += c * TOKEN_BYTES
                counts.append(count)
            size = np.concatenate(counts) if counts else np.empty(0, np.int64)
            yield pa.StructArray.from_arrays(
                [pa.array(size.astype(np.int32)), pa.array([s and xxhash.xxh3_128_digest(s) for s in sets], pa.binary()), pa.array(sets, pa.binary())], ["size", "digest", "tokens"]
            )

    return build


def shingle_sets(df: DataFrame, key: str, text: str, width: int, least_words: int) -> DataFrame:
    """id, size, digest, tokens of the rows that have a set. ``least_words`` is at least ``width``."""
    built = df.where(F.col(text).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("id"), _set_builder(width, max(width, least_words))(F.col(text)).alias("s"))
    return built.select("id", "s.size", "s.digest", "s.tokens").where("size > 0")


def table_bits(tokens: int) -> int:
    """The count table grows with the number of tokens, within bounds."""
    return min(MOST_BITS, max(LEAST_BITS, tokens.bit_length() - 4))


def frequency_levels(sets: DataFrame, bits: int, partitions: int) -> np.ndarray:
    """One byte for each of 2 ** bits groups of tokens: 8 * log2 of its number of tokens. Each task counts its own sets; counts are added up in a tree."""
    parts, width = 64, (1 << bits) // 64

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << bits, np.int64)
        for batch in batches:
            total += np.bincount((_flat(batch.column(0))[0] >> np.uint64(8 * TOKEN_BYTES - bits)).astype(np.int64), minlength=1 << bits)
        if total.any():
            lot = TaskContext.get().partitionId() // FAN_IN
            rows = [zstandard.compress(total[k * width : (k + 1) * width].tobytes(), 1) for k in range(parts)]
            yield pa.RecordBatch.from_arrays([pa.array(range(parts), pa.int32()), pa.array([lot] * parts, pa.int32()), pa.array(rows, pa.binary())], ["part", "lot", "counts"])

    def add(last: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(width, np.int64)
            for batch in batches:
                part, lot = batch.column(0)[0].as_py(), batch.column(1)[0].as_py()
                for x in batch.column(2).to_pylist():
                    total += np.frombuffer(zstandard.decompress(x), np.int64)
            out = np.minimum(255, np.round(8 * np.log2(np.maximum(total, 1)))).astype(np.uint8).tobytes() if last else zstandard.compress(total.tobytes(), 1)
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([lot // FAN_IN], pa.int32()), pa.array([out], pa.binary())], ["part", "lot", "counts"])

        return run

    schema = "part int, lot int, counts binary"
    added = sets.select("tokens").mapInArrow(count, schema)
    while partitions > FAN_IN:
        added = added.groupBy("part", "lot").applyInArrow(add(False), schema)
        partitions = -(-partitions // FAN_IN)
    levels = np.zeros(1 << bits, np.uint8)
    for part, _, counts in added.groupBy("part").applyInArrow(add(True), schema).collect():
        levels[part * width : (part + 1) * width] = np.frombuffer(counts, np.uint8)
    return levels


def _lot(ids: np.ndarray, lots) -> np.ndarray:
    with np.errstate(over="ignore"):
        mixed = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed >> np.uint64(33)) % np.asarray(lots, np.uint64)).astype(np.int64)


def task_of(bucket: np.ndarray, lots: np.ndarray, i: np.ndarray, k: np.ndarray, buckets: int) -> np.ndarray:
    """One number for a bucket of tokens and a pair of lots i <= k."""
    return bucket + buckets * (1 + (lots * (MOST_LOTS + 1) + i) * (MOST_LOTS + 1) + k)


def lots_of(task: int, buckets: int) -> tuple[int, int, int]:
    rest = task // buckets - 1
    return (0, 0, 0) if rest < 0 else (rest // (MOST_LOTS + 1) ** 2, rest // (MOST_LOTS + 1) % (MOST_LOTS + 1), rest % (MOST_LOTS + 1))


def _entry_writer(levels, bits: int, buckets: int, t: float, shared: float, hot: float):
    """Blobs of the indexed places of the sets of a batch, one a bucket of tokens or, of tokens more frequent than ``hot``, a pair of lots."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.asarray(batch.column(0)).astype(np.int64)
            tokens, sizes = _flat(batch.column(1))
            doc = np.repeat(np.arange(len(sizes)), sizes)
            level = levels.value[(tokens >> np.uint64(8 * TOKEN_BYTES - bits)).astype(np.int64)]
            order = np.lexsort((tokens, level, doc))
            tokens, level = tokens[order], level[order]
            place = np.arange(len(doc)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            use = (place <= (1 - t + shared * t) * sizes[doc] + 1e-9) & (level > 0)
            tokens, doc, place, level = tokens[use], doc[use], place[use], level[use]
            bucket = (tokens % np.uint64(buckets)).astype(np.int64)
            often = 2 ** (level.astype(np.float64) / 8)
            many = np.flatnonzero(often > hot)
            if len(many):
                lots = np.minimum(MOST_LOTS, np.ceil(often[many] / hot)).astype(np.int64)
                own = _lot(ids[doc[many]], lots)
                at = np.repeat(np.arange(len(many)), lots)
                other = np.arange(len(at)) - np.repeat(np.cumsum(lots) - lots, lots)
                split = task_of(bucket[many][at], lots[at], np.minimum(own[at], other), np.maximum(own[at], other), buckets)
                few = often <= hot
                tokens, doc, place, bucket = (np.concatenate([x[few], x[many][at]]) for x in (tokens, doc, place, bucket))
                bucket[few.sum() :] = split
            order = np.lexsort((doc, bucket)) if len(many) else np.argsort(bucket, kind="stable")
            # what is left of a token is cut to 32 bits; with few buckets two tokens may then clash, which only adds candidates
            tokens, doc, place, bucket = (tokens // np.uint64(buckets))[order].astype(np.uint32), doc[order], place[order].astype(np.int32), bucket[order]
            cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True]) if len(bucket) else np.zeros(1, np.int64)
            rows = []
            for a, b in zip(cuts[:-1], cuts[1:]):
                firsts = np.flatnonzero(np.r_[True, doc[a + 1 : b] != doc[a : b - 1]]) + a
                own = doc[firsts]
                small = [ids[own], sizes[own].astype(np.int32), np.diff(np.r_[firsts, b]).astype(np.int32)]
                rows.append((int(bucket[a]), *(zstandard.compress(x.tobytes(), 1) for x in small), tokens[a:b].tobytes(), zstandard.compress(place[a:b].tobytes(), 1)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if k == 0 else pa.binary()) for k, c in enumerate(zip(*rows))], ["bucket", "ids", "sizes", "counts", "tokens", "places"])

    return write


def join_bucket(ids: np.ndarray, size: np.ndarray, token: np.ndarray, place: np.ndarray, t: float, shared: float, lots: tuple[int, int, int] = (0, 0, 0)) -> Iterator[tuple[np.ndarray, ...]]:
    """Pairs of sets with the number of tokens they share at indexed places: a, b (a < b), n, smaller size. A pair may come in
    several parts. With ``lots`` (number, i, k), i < k, only pairs of sets of different lots count."""
    across = lots[1] < lots[2]
    s = t / (1 + t)
    order = np.lexsort((place, size, token))
    ids, size, token, place = ids[order], size[order].astype(np.int64), token[order], place[order].astype(np.int64)
    run = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
    length = np.diff(np.r_[run, len(token)])
    many = np.repeat(length > 1, length)
    ids, size, place = ids[many], size[many], place[many]
    tok = np.repeat(np.arange((length > 1).sum()), length[length > 1])
    n, width = len(ids), int(size.max(initial=0)) + 2
    key = tok * width + size
    high = np.minimum(size, np.floor((size - place - s * size) / (s - shared) + 1e-6)).astype(np.int64)
    relative = place / np.maximum(size, 1)
    edges = np.linspace(0, 1 - s - s + shared + 1e-6, BLOCKS + 1)
    for low_edge, high_edge in zip(edges[:-1], edges[1:]):
        block = np.flatnonzero((relative >= low_edge) & (relative < high_edge))
        if not len(block):
            continue
        least = np.ceil(np.maximum(t, s / (1 - s + shared - low_edge)) * size - 1e-6).astype(np.int64)
        probe = np.flatnonzero(high >= least)
        begin = np.searchsorted(key[block], tok[probe] * width + least[probe], side="left")
        end = np.searchsorted(key[block], tok[probe] * width + high[probe], side="right")
        end = np.minimum(end, np.searchsorted(block, probe, side="left"))  # each pair of places once: the later probes
        probe, begin, count = probe[end > begin], begin[end > begin], (end - begin)[end > begin]
        ends = np.cumsum(count)
        at = 0
        while at < len(probe):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + EXPAND, side="right")))
            c = count[at:to]
            x = np.repeat(probe[at:to], c)
            y = block[np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c) + np.repeat(begin[at:to], c)]
            need = np.ceil(s * (size[x] + size[y]) - 1e-9) - np.floor(shared * size[y] + 1e-9)
            ok = (np.minimum(size[x] - place[x], size[y] - place[y]) >= need) & (ids[x] != ids[y])
            if across:
                ok &= _lot(ids[x], lots[0]) != _lot(ids[y], lots[0])
            x, y = x[ok], y[ok]
            at = to
            if len(x):
                yield _added(np.minimum(ids[x], ids[y]), np.maximum(ids[x], ids[y]), np.ones(len(x), np.int64), size[y])


def _added(a: np.ndarray, b: np.ndarray, n: np.ndarray, smaller: np.ndarray) -> tuple[np.ndarray, ...]:
    """Each pair once, with the sum of its n."""
    order = np.lexsort((b, a))
    a, b, n, smaller = a[order], b[order], n[order], smaller[order]
    first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
    return a[first], b[first], np.add.reduceat(n, first), smaller[first]


def _whole(table: pa.Table, name: str, kind) -> np.ndarray:
    return np.concatenate([np.frombuffer(x if name == "tokens" else zstandard.decompress(x), kind) for x in table.column(name).to_pylist()])


def _blobs(parts: np.ndarray, columns: list[np.ndarray]) -> list[tuple]:
    """Rows of a part and its compressed columns; ``parts`` is sorted."""
    cuts = np.flatnonzero(np.r_[True, parts[1:] != parts[:-1], True]) if len(parts) else np.zeros(1, np.int64)
    return [(int(parts[i]), *(zstandard.compress(c[i:k].tobytes(), 1) for c in columns)) for i, k in zip(cuts[:-1], cuts[1:])]


PAIR_BLOBS = "part int, a binary, b binary, n binary, smaller binary"


def _joiner(t: float, shared: float, buckets: int):
    """Pairs of one bucket of tokens, packed by a hash of the pair. They leave as they are found."""

    def join(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lots = lots_of(key[0].as_py(), buckets)
        table = pa.Table.from_batches(list(batches))
        count = _whole(table, "counts", np.int32)
        ids, size = np.repeat(_whole(table, "ids", np.int64), count), np.repeat(_whole(table, "sizes", np.int32), count)
        parts, n_found = [], 0

        def packed() -> pa.RecordBatch:
            a, b, n, smaller = _added(*map(np.concatenate, zip(*parts)))
            part = _lot(a * 31 + b, buckets)
            order = np.argsort(part, kind="stable")
            columns = list(zip(*_blobs(part[order], [a[order], b[order], n[order].astype(np.int32), smaller[order].astype(np.int32)])))
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if k == 0 else pa.binary()) for k, c in enumerate(columns)], [c.split()[0] for c in PAIR_BLOBS.split(", ")])

        for found in join_bucket(ids, size, _whole(table, "tokens", np.uint32), _whole(table, "places", np.int32), t, shared, lots):
            parts.append(found)
            n_found += len(found[0])
            if n_found > EXPAND:
                yield packed()
                parts, n_found = [], 0
        if parts:
            yield packed()

    return join


def _counter(shared: float):
    """Adds up the pairs of one part; leaves those that share enough tokens at indexed places."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        a, b, n, smaller = _added(_whole(table, "a", np.int64), _whole(table, "b", np.int64), _whole(table, "n", np.int32), _whole(table, "smaller", np.int32))
        enough = n >= 1 + np.floor(shared * smaller + 1e-9)
        yield pa.RecordBatch.from_arrays([pa.array(a[enough]), pa.array(b[enough])], ["a", "b"])

    return count


def _marked(left: pa.Array, right: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row and token of all tokens of two columns, sorted, and whether the next one is the same."""
    (x, nx), (y, ny) = _flat(left), _flat(right)
    both = np.concatenate([np.repeat(np.arange(len(nx)), nx).astype(np.uint64) << np.uint64(40) | x, np.repeat(np.arange(len(ny)), ny).astype(np.uint64) << np.uint64(40) | y])
    both.sort()
    return both, np.concatenate([both[1:] == both[:-1], [False]]) if len(both) else np.zeros(0, bool)


def overlap(left: pa.Array, right: pa.Array) -> pa.Array:
    """Tokens that the sets of two columns share; null sets share none."""
    both, twice = _marked(left, right)
    return pa.array(np.bincount((both[twice] >> np.uint64(40)).astype(np.int64), minlength=len(left)).astype(np.int32))


DIFFERENCES = "struct<n: int, less: binary, more: binary>"


def _compare(t: float):
    """Arrow function over a leader's and another's tokens: what they share, and, if they reach the threshold, what the other has less and more."""

    def run(leader: pa.Array, other: pa.Array) -> pa.Array:
        m = len(leader)
        row = lambda v: (v >> np.uint64(40)).astype(np.int64)
        (x, nx), (y, ny) = _flat(leader), _flat(other)
        one = np.repeat(np.arange(m), nx).astype(np.uint64) << np.uint64(40) | x
        two = np.repeat(np.arange(m), ny).astype(np.uint64) << np.uint64(40) | y
        both, twice = _marked(leader, other)
        shared = both[twice]
        n = np.bincount(row(shared), minlength=m)
        near = n >= t * (nx + ny - n) - 1e-9
        out = []
        for own in (one, two):
            rest = np.sort(own[~np.isin(own, shared)])
            packed, ends = _pack(rest & np.uint64((1 << 40) - 1)), np.cumsum(np.bincount(row(rest), minlength=m)) * TOKEN_BYTES
            starts = np.concatenate([[0], ends[:-1]])
            out.append(pa.array([packed[a:b] if ok else None for a, b, ok in zip(starts.tolist(), ends.tolist(), near.tolist())], pa.binary()))
        return pa.StructArray.from_arrays([pa.array(n.astype(np.int32)), *out], ["n", "less", "more"])

    return run


def derived(candidates: DataFrame, star: DataFrame, t: float) -> DataFrame:
    """a, b, n_a, n_b, n_r, low, high, near of the candidates outside ``star`` (b, r, n_b, n_r, with_r, near_b): bounds of what a and b share, from their leader, null without a common one;
    and near: whether both are similar to it."""
    of_b = candidates.join(star, "b").where("a <> r")
    of_a = star.select(F.col("b").alias("a"), F.col("r").alias("r_a"), F.col("n_b").alias("n_a"), F.col("with_r").alias("a_with_r"), F.col("near_b").alias("near_a"))
    both = of_b.join(of_a, "a", "left").withColumn("_one", F.coalesce(F.col("r") == F.col("r_a"), F.lit(False)))
    low = F.col("a_with_r") + F.col("with_r") - F.col("n_r")
    high = F.least("a_with_r", "with_r") + F.least(F.col("n_a") - F.col("a_with_r"), F.col("n_b") - F.col("with_r"))
    return both.select("a", "b", F.when(F.col("_one"), F.col("n_a")).alias("n_a"), "n_b", "n_r", F.when(F.col("_one"), low).alias("low"), F.when(F.col("_one"), high).alias("high"), (F.col("_one") & F.col("near_a") & F.col("near_b")).alias("near"))


class NearDuplicates:
    """``members``: id, rep (the least id of the rows with the same set); ``links``: a, b, jaccard, derived of representatives, a < b. Of a pair
    whose answer was derived, ``jaccard`` is a lower bound that reaches the threshold.

    The jobs run when the object is made. The sets are kept in executor memory (disk where it does not suffice) meanwhile; lost parts are computed anew."""

    def __init__(self, df: DataFrame, key: str = "parsed_id", text: str = "text", t: float = 0.8, width: int = 5, least_words: int = 20, shared: float = SHARED, bits: int | None = None, hot_entries: int = HOT_ENTRIES):
        spark = df.sparkSession
        partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
        sets = shingle_sets(df, key, text, width, least_words)
        kept = sets.repartition(partitions, "id").persist(StorageLevel.MEMORY_AND_DISK)
        tokens = kept.agg(F.sum("size")).first()[0] or 0
        bits = bits or table_bits(tokens)
        levels = spark.sparkContext.broadcast(frequency_levels(kept, bits, partitions))
        buckets = max(partitions, -(-int((1 - t + shared) * tokens) // BUCKET_ENTRIES))
        hot = max(hot_entries, HOT_TIMES * tokens / (1 << bits))
        reps = kept.groupBy("digest").agg(F.min("id").alias("rep"))
        self.members = cut(kept.select("id", "digest").join(reps, "digest").select("id", "rep"))
        chosen = self.members.where("id = rep").select("id")
        single = kept.join(chosen.distinct(), "id").select("id", "tokens")
        entries = single.mapInArrow(_entry_writer(levels, bits, buckets, t, shared, hot), "bucket bigint, ids binary, sizes binary, counts binary, tokens binary, places binary")
        pairs = entries.groupBy("bucket").applyInArrow(_joiner(t, shared, buckets), PAIR_BLOBS)
        self.candidates = cut(pairs.groupBy("part").applyInArrow(_counter(shared), "a bigint, b bigint"))
        own = kept.select("id", "size", "tokens")
        x, y = own.withColumnsRenamed({"id": "a", "size": "n_a", "tokens": "x"}), own.withColumnsRenamed({"id": "b", "size": "n_b", "tokens": "y"})
        pairs_of = lambda rows: rows.join(x, "a").join(y, "b")
        leaders = self.candidates.groupBy("b").agg(F.min("a").alias("a"))
        first = cut(pairs_of(leaders).select("a", "b", "n_a", "n_b", F.arrow_udf(_compare(t), DIFFERENCES)("x", "y").alias("d")).select("a", "b", "n_a", "n_b", "d.*"))
        star = first.select("b", F.col("a").alias("r"), "n_b", F.col("n_a").alias("n_r"), F.col("n").alias("with_r"), F.col("less").isNotNull().alias("near_b"))
        share = lambda n: n / (F.col("n_a") + F.col("n_b") - n)
        reaches = lambda n: share(n) >= t - 1e-12
        settled = F.coalesce(reaches(F.col("low")) | ~reaches(F.col("high")), F.lit(False))
        of_a, of_b = first.where("less is not null").select(F.col("b").alias("a"), F.col("less").alias("less_a"), F.col("more").alias("more_a")), first.where("less is not null").select("b", F.col("less").alias("less_b"), F.col("more").alias("more_b"))
        self.derived = cut(derived(self.candidates, star, t).withColumn("settled", settled))
        by_bounds = self.derived.where(F.col("settled") & reaches(F.col("low"))).select("a", "b", share(F.col("low")).alias("jaccard"), F.lit(True).alias("derived"))
        apart = self.derived.where("near and not settled").join(of_a, "a").join(of_b, "b")
        both = F.arrow_udf(overlap, "int")("less_a", "less_b") + F.arrow_udf(overlap, "int")("more_a", "more_b")
        gone = F.length("less_a") + F.length("less_b")
        by_differences = apart.select("a", "b", "n_a", "n_b", (F.col("n_r") - gone / TOKEN_BYTES + both).alias("n"))
        rest = pairs_of(self.derived.where("not near and not settled").select("a", "b")).select("a", "b", "n_a", "n_b", F.arrow_udf(overlap, "int")("x", "y").alias("n"))
        exact = first.select("a", "b", "n_a", "n_b", "n").unionByName(rest).where(reaches(F.col("n"))).select("a", "b", share(F.col("n")).alias("jaccard"), F.lit(False).alias("derived"))
        apart_links = by_differences.where(reaches(F.col("n"))).select("a", "b", share(F.col("n")).alias("jaccard"), F.lit(True).alias("derived"))
        self.links = cut(exact.unionByName(by_bounds).unionByName(apart_links))
        kept.unpersist()

    def saved(self) -> DataFrame:
        """n_candidates, and how many of them were settled by bounds from their leader and by their differences to it; all others were compared whole."""
        one = F.lit(1).alias("n")
        every = self.candidates.select(F.lit("c").alias("k"), one).unionByName(self.derived.where("settled").select(F.lit("b").alias("k"), one)).unionByName(self.derived.where("near and not settled").select(F.lit("d").alias("k"), one))
        count = lambda k: F.count_if(F.col("k") == k)
        return every.agg(count("c").alias("n_candidates"), count("b").alias("n_by_bounds"), count("d").alias("n_by_differences"))

    def pairs(self) -> DataFrame:
        """a, b, jaccard of rows, a < b: linked classes member by member, and the members of one class, a large one in lots."""
        m = self.members
        a, b = m.withColumnsRenamed({"id": "i", "rep": "a"}), m.withColumnsRenamed({"id": "k", "rep": "b"})
        across = self.links.join(a, "a").join(b, "b").select(F.least("i", "k").alias("a"), F.greatest("i", "k").alias("b"), "jaccard")
        lots = m.groupBy("rep").count().where("count > 1").select("rep", F.ceil(F.col("count") / CLASS_LOT).cast("int").alias("_lots"))
        own = m.join(lots, "rep").withColumn("_lot", F.pmod(F.xxhash64("id"), "_lots").cast("int")).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_lots") - 1)))
        split = own.select("rep", "id", "_lot", F.least("_lot", "_other").alias("_i"), F.greatest("_lot", "_other").alias("_k"))
        x, y = split.withColumnsRenamed({"id": "a", "_lot": "_x"}), split.withColumnsRenamed({"id": "b", "_lot": "_y"})
        inside = x.join(y, ["rep", "_i", "_k"]).where("a < b and (_i = _k or _x <> _y)").select("a", "b", F.lit(1.0).alias("jaccard"))
        return across.unionByName(inside)

    def groups(self) -> DataFrame:
        """id, rep, group_id (the least id of its linked classes), n_links (the rep's links to other classes)."""
        ends = self.links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("n_links"))
        labels = components(self.links.select("a", "b"))
        return self.members.join(labels, "rep", "left").join(ends, "rep", "left").select("id", "rep", F.coalesce("label", "rep").alias("group_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def components(edges: DataFrame) -> DataFrame:
    """rep, label: the least node of each node's component, by large-star and small-star rounds; each round is cut off from its past."""
    at = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while True:
        both = at.unionByName(at.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(down.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        new = cut(small)
        if new.exceptAll(at).isEmpty() and at.exceptAll(new).isEmpty():
            break
        at = new
    return at.groupBy("u").agg(F.min("v").alias("label")).withColumnRenamed("u", "rep").unionByName(at.select(F.col("v").alias("rep"), F.col("v").alias("label")).distinct())


def found(df: DataFrame, t: float = 0.6, width: int = 3, least_words: int = 20) -> DataFrame:
    pairs = NearDuplicates(df, t=t, width=width, least_words=least_words).pairs()
    return pairs.select(F.col("a").alias("parsed_id_a"), F.col("b").alias("parsed_id_b")).distinct()
