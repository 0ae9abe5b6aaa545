"""Operators over many reports: evaluation against labels, summaries, hash reputation, similarity."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def clean_verdict(v: Column) -> Column:
    return F.upper(F.trim(v))


def labels(manifest: DataFrame) -> DataFrame:
    """One label a file: the latest; of equals the severest. Null verdicts are no labels."""
    severity = F.array_position(F.array(F.lit("ALLOW"), F.lit("FLAG"), F.lit("BLOCK")), clean_verdict(F.col("expected_verdict")))
    return manifest.where("file_path is not null and expected_verdict is not null").groupBy("file_path").agg(F.max_by(clean_verdict(F.col("expected_verdict")), F.struct("labelled_at", severity)).alias("expected"))


def evaluate(reports: DataFrame, manifest: DataFrame) -> DataFrame:
    """tp, fp, fn, tn, precision, recall, f1 of "not ALLOW" by file; the severest report of a file counts."""
    rank = F.array_position(F.array(F.lit("ALLOW"), F.lit("FLAG"), F.lit("BLOCK")), clean_verdict(F.col("verdict")))
    # grouped before the join: a file that was scanned very often is then one row
    predicted = reports.where("file_path is not null").groupBy("file_path").agg(F.max(rank).alias("rank"))
    joined = labels(manifest).join(predicted, "file_path")
    bad, said = F.col("expected") != "ALLOW", F.col("rank") > 1
    count = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("bigint")
    n = joined.agg(count(bad & said).alias("tp"), count(~bad & said).alias("fp"), count(bad & ~said).alias("fn"), count(~bad & ~said).alias("tn"))
    p, r = F.col("tp") / F.nullif(F.col("tp") + F.col("fp"), F.lit(0)), F.col("tp") / F.nullif(F.col("tp") + F.col("fn"), F.lit(0))
    return n.select("tp", "fp", "fn", "tn", p.alias("precision"), r.alias("recall"), (2 * p * r / F.nullif(p + r, F.lit(0.0))).alias("f1"))


def threat_summary(findings: DataFrame) -> DataFrame:
    """Counts by threat and severity with their totals (null stands for all)."""
    known = findings.where("threat_id is not null and severity is not null")
    return known.cube("threat_id", "severity").agg(F.count("*").alias("n"), F.countDistinct("report_id").alias("n_reports"))


def reputation(df: DataFrame, known: DataFrame, key: str = "sha256") -> DataFrame:
    """Adds infected: whether the digest is listed. Each side is distinct by digest before the join, so hot digests do not skew it."""
    listed = df.select(key).distinct().join(known.select(key).distinct(), key, "left_semi").withColumn("_listed", F.lit(True))
    return df.join(listed, key, "left").withColumn("infected", F.coalesce("_listed", F.lit(False))).drop("_listed")


BLOCK = 1024  # vectors of a block
BLOCKS = "ids binary, vectors binary"


def blocks(df: DataFrame, key: str, vector: str) -> DataFrame:
    """Vectors of length 1, as matrices of up to BLOCK rows, with their ids; packed where they are, without a shuffle. Null and zero vectors are left out."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            width = len(batch.column(1)[0])
            ids, flat = np.asarray(batch.column(0)).astype(np.int64), np.asarray(batch.column(1).flatten()).astype(np.float64)
            v = flat.reshape(len(ids), width)
            size = np.sqrt((v * v).sum(1))
            ids, v = ids[size > 0], v[size > 0] / size[size > 0, None]
            for at in range(0, len(ids), BLOCK):
                yield pa.RecordBatch.from_arrays([pa.array([ids[at : at + BLOCK].tobytes()], pa.binary()), pa.array([v[at : at + BLOCK].tobytes()], pa.binary())], ["ids", "vectors"])

    whole = df.select(F.col(key).cast("bigint").alias("k"), F.col(vector).cast("array<double>").alias("v")).where(F.col("k").isNotNull() & (F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull()))
    return whole.mapInArrow(pack, BLOCKS)


def _best(ids: pa.Array, vectors: pa.Array, q_ids: pa.Array, q_vectors: pa.Array) -> pa.Array:
    """For each pair of blocks, each query's highest cosine to another row of the block."""
    out = []
    for a, x, b, y in zip(ids, vectors, q_ids, q_vectors):
        a, b = np.frombuffer(a.as_buffer(), np.int64), np.frombuffer(b.as_buffer(), np.int64)
        sim = np.frombuffer(y.as_buffer()).reshape(len(b), -1) @ np.frombuffer(x.as_buffer()).reshape(len(a), -1).T
        sim[b[:, None] == a[None, :]] = -np.inf
        most = sim.max(1)
        out.append([{"q": int(q), "sim": float(s)} for q, s in zip(b, most) if s > -np.inf])
    return pa.array(out, pa.list_(pa.struct([("q", pa.int64()), ("sim", pa.float64())])))


def most_similar(queries: DataFrame, rows: DataFrame, key: str, vector: str, limit: float = 0.75) -> DataFrame:
    """For each of a stated set of queries (bigint ``key``), the highest cosine to another row, and whether it is above ``limit``.

    Blocks of queries meet blocks of rows (by a broadcast only if Spark's size check allows it), each pair by one product of
    matrices; a pair of blocks keeps one value a query, and only these are shuffled. All vectors have one length."""
    q = blocks(queries, key, vector).withColumnsRenamed({"ids": "q_ids", "vectors": "q_vectors"})
    pairs = blocks(rows, key, vector).crossJoin(q)
    best = pairs.select(F.explode(F.arrow_udf(_best, "array<struct<q: bigint, sim: double>>")("ids", "vectors", "q_ids", "q_vectors")).alias("b"))
    return best.groupBy(F.col("b.q").alias(key)).agg(F.max("b.sim").alias("max_sim")).select(key, "max_sim", (F.col("max_sim") > limit).alias("hit"))
