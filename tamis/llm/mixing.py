"""Problem 8: one collection of several sources with target shares of all tokens.

Weights are either given targets, or source token shares raised to an exponent that is bisected until the mixture
has a wanted entropy or keeps the repetition limits. Normalised weights become token budgets; a budget is realised
as whole passes over a source and one partial pass in the order of a block permutation: documents hash into blocks,
blocks are ordered by a keyed hash, whole blocks are taken until the budget is nearly used, and the one block at
the border is cut in a keyed order of its documents. Documents are never sorted and never joined with each other.

Results: null and unlisted sources, and texts without tokens, are not used. A listed source without documents
reaches 0; the other targets keep their proportions. Targets listed twice count once (the first in order of share).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tamis.functions.session import cut
from tamis.llm.bpe import token_count

BLOCK_TOKENS = 100_000  # tokens of a block on average; only the block at the border of a budget is ever sorted
SUPER_BLOCKS = 4096  # ranges of block keys in which a source's blocks are summed up before the border is looked for
MAX_SOURCES = 100_000  # rows of the target table that the driver may hold


def entropy(weights: Sequence[float]) -> float:
    return -sum(w * math.log(w) for w in weights if w > 0)


def tempered(shares: Sequence[float], exponent: float) -> list[float]:
    """Shares raised to ``exponent`` and normalised; empty sources stay at 0."""
    raised = [s**exponent if s > 0 else 0.0 for s in shares]
    total = sum(raised)
    return [r / total if total else 0.0 for r in raised]


def bisect_exponent(shares: Sequence[float], tokens: Sequence[int], total: float, limits: Sequence[float], target_entropy: float | None = None, rounds: int = 60) -> float:
    """The least exponent of [0, 1] that keeps every source within ``limits`` passes at ``total`` tokens and, if
    ``target_entropy`` is given, whose entropy is not above it. Both loads fall as the exponent grows to 1; 1 if none fits."""

    def fits(exponent: float) -> bool:
        w = tempered(shares, exponent)
        return all(x * total <= limit * n * (1 + 1e-12) for x, n, limit in zip(w, tokens, limits) if n) and (target_entropy is None or entropy(w) <= target_entropy)

    low, high = 0.0, 1.0
    if fits(low):
        return low
    for _ in range(rounds):
        middle = (low + high) / 2
        low, high = (low, middle) if fits(middle) else (middle, high)
    return high


def largest_total(weights: Sequence[float], tokens: Sequence[int], limits: Sequence[float]) -> int:
    """The most tokens a mixture of these weights can have within the repetition limits."""
    return int(min((n * limit / w for w, n, limit in zip(weights, tokens, limits) if w > 0), default=0))


def counted(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """doc_id, source, n_tokens of the documents that have tokens, cut off from their texts."""
    n = token_count(docs.sparkSession, F.col("text"), tokenizer)
    return cut(docs.select("doc_id", "source", n.alias("n_tokens")).where("n_tokens > 0 and source is not null"))


def source_table(counts: DataFrame, targets: DataFrame) -> list[dict]:
    """One row a target source: target_share, max_repeats, tokens. Bounded by the target table."""
    once = targets.where("source is not null and target_share > 0").groupBy("source").agg(F.max(F.struct("target_share", F.coalesce("max_repeats", F.lit(1)).alias("r"))).alias("t"))
    sums = counts.groupBy("source").agg(F.sum("n_tokens").alias("tokens"))
    rows = once.join(sums, "source", "left").select("source", "t.target_share", F.col("t.r").alias("max_repeats"), F.coalesce("tokens", F.lit(0)).alias("tokens")).limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} target sources")
    return sorted((r.asDict() for r in rows), key=lambda r: r["source"])


def plan(sources: list[dict], total: int | None = None, use_targets: bool = True, target_entropy: float | None = None) -> list[dict]:
    """Adds exponent, weight and budget (tokens) to each source.

    ``use_targets``: weights are the targets of the sources that have documents, normalised; else token shares
    with a bisected exponent. ``total``: wanted tokens; by default as many as the limits allow (with targets) or
    as the sources hold."""
    tokens, limits = [s["tokens"] for s in sources], [s["max_repeats"] for s in sources]
    if use_targets:
        exponent, weights = None, tempered([s["target_share"] * (s["tokens"] > 0) for s in sources], 1.0)
        most = largest_total(weights, tokens, limits)
        total = most if total is None else min(total, most)
    else:
        total = sum(tokens) if total is None else total
        shares = [n / (sum(tokens) or 1) for n in tokens]
        exponent = bisect_exponent(shares, tokens, total, limits, target_entropy)
        weights = tempered(shares, exponent)
        total = min(total, largest_total(weights, tokens, limits))
    return [s | {"exponent": exponent, "weight": w, "budget": min(int(round(w * total)), s["tokens"] * s["max_repeats"])} for s, w in zip(sources, weights)]


def block_key(seed: int):
    return F.xxhash64(F.lit(seed), "source", "_block")


def border_blocks(sums: DataFrame) -> DataFrame:
    """source, _border (the key of the block in which the running sum of blocks in order of their keys reaches ``_rest``), _left (what of it
    fits). The running sum is taken over SUPER_BLOCKS ranges of keys first and then inside one of them, so no task sees all blocks of a source."""
    upto = lambda n, by: F.sum(n).over(Window.partitionBy("source").orderBy(by).rowsBetween(Window.unboundedPreceding, 0))
    reached = "_end >= _rest and _end - _sum < _rest"
    of = sums.withColumn("_super", F.shiftright("_key", 64 - (SUPER_BLOCKS - 1).bit_length()))
    supers = of.groupBy("source", "_rest", "_super").agg(F.sum("_sum").alias("_sum")).withColumn("_end", upto("_sum", "_super"))
    inside = of.drop("_rest").join(supers.where(reached).select("source", "_super", (F.col("_rest") - F.col("_end") + F.col("_sum")).alias("_rest")), ["source", "_super"])
    return inside.withColumn("_end", upto("_sum", "_key")).where(reached).select("source", F.col("_key").alias("_border"), (F.col("_rest") - F.col("_end") + F.col("_sum")).alias("_left"))


def realise(counts: DataFrame, planned: list[dict], seed: int = 7, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """The collection: doc_id, source, copy_no (from 1), n_tokens, order_key (a keyed hash that mixes the sources when sorted by)."""
    spark = counts.sparkSession
    rows = [(p["source"], p["budget"] // p["tokens"], p["budget"] % p["tokens"], max(1, -(-p["tokens"] // block_tokens))) for p in planned if p["tokens"] and p["budget"]]
    plans = spark.createDataFrame(rows, "source string, _passes bigint, _rest bigint, _blocks bigint").coalesce(1)
    blocked = counts.join(plans, "source").withColumn("_block", F.pmod(F.xxhash64("doc_id"), "_blocks")).withColumn("_key", block_key(seed))
    border = cut(border_blocks(blocked.where("_rest > 0").groupBy("source", "_rest", "_key").agg(F.sum("n_tokens").alias("_sum"))))
    # the documents of one block a source: in keyed order while they fit, then the largest one that still does
    inside = blocked.join(border, "source").where("_key = _border")
    order = Window.partitionBy("source").orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    inside = inside.withColumn("_end", F.sum("n_tokens").over(order)).withColumn("_fits", F.col("_end") <= F.col("_left"))
    inside = inside.withColumn("_left", F.col("_left") - F.coalesce(F.max(F.when(F.col("_fits"), F.col("_end"))).over(Window.partitionBy("source")), F.lit(0)))
    late = ~F.col("_fits") & (F.col("n_tokens") <= F.col("_left"))
    first = F.row_number().over(Window.partitionBy("source").orderBy(late.desc(), F.desc("n_tokens"), "doc_id")) == 1
    cut_block = inside.withColumn("_take", F.col("_fits") | (late & first)).select("doc_id", "source", "n_tokens", (F.col("_passes") + F.col("_take").cast("bigint")).alias("_copies"))
    rest = blocked.join(border, "source", "left").where("_border is null or _key <> _border").select("doc_id", "source", "n_tokens", (F.col("_passes") + F.expr("cast(coalesce(_key < _border, false) as bigint)")).alias("_copies"))
    copies = rest.unionByName(cut_block).where("_copies > 0")
    return copies.select("doc_id", "source", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int"))).alias("copy_no"), "n_tokens").withColumn("order_key", F.xxhash64(F.lit(seed), "doc_id", "copy_no"))


def reached(collection: DataFrame, planned: list[dict]) -> DataFrame:
    """The report: one row a target source, with the tokens and the share it really has in the collection."""
    spark = collection.sparkSession
    schema = "source string, target_share double, max_repeats int, tokens bigint, exponent double, weight double, budget bigint"
    names = [x.split()[0] for x in schema.split(", ")]
    plans = spark.createDataFrame([tuple(p[n] for n in names) for p in planned], schema).coalesce(1)
    got = collection.groupBy("source").agg(F.sum("n_tokens").alias("got"), F.count("*").alias("n_rows"), F.max("copy_no").alias("most_copies"))
    table = plans.join(got, "source", "left").withColumn("got", F.coalesce("got", F.lit(0)))
    share = F.col("got") / F.nullif(F.sum("got").over(Window.partitionBy()), F.lit(0))
    return table.select("source", "target_share", "max_repeats", "tokens", "exponent", "weight", "budget", F.col("got").alias("reached_tokens"), F.coalesce(share, F.lit(0.0)).alias("reached_share"), F.coalesce("n_rows", F.lit(0)).alias("n_rows"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"))


def mix(docs: DataFrame, targets: DataFrame, tokenizer: str | None = None, seed: int = 7, **how) -> tuple[DataFrame, DataFrame]:
    """The collection (with each source's reached_share) and the report. ``how`` goes to ``plan``."""
    counts = counted(docs, tokenizer)
    planned = plan(source_table(counts, targets), **how)
    collection = realise(counts, planned, seed)
    report = reached(collection, planned)
    return collection.join(report.select("source", "reached_share"), "source").select("doc_id", "source", "copy_no", "n_tokens", "order_key", "reached_share"), report
