"""The same stateless projection over a stream of parsed documents, written batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tamis.config import Config
from tamis.functions.session import load
from tamis.plans.pipeline import scan_parsed


def read_stream(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """The stream of all files that ``load`` reads: the table is one file, or a folder of part files of any name, partitioned or not."""
    path = f"{sf_dir}/{table}.parquet"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).isDirectory(at):
        path = path[:-1] + "[t]"  # a stream takes a plain path for a folder of partitions, and fails on a file; a pattern may meet a file
    return spark.readStream.schema(load(spark, sf_dir, table).schema).parquet(path)


def scan_stream(docs: DataFrame, out: str, checkpoint: str, cfg: Config = Config()) -> StreamingQuery:
    """Writes reports as parquet exactly once a batch; runs until all available files are read."""
    return scan_parsed(docs, cfg).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
