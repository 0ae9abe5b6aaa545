"""Session helpers: table loading, shared checkpoints, free column names."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; a temporary one only where the setting is unset (local tests)."""
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if configured:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(configured)
        return configured
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(os.path.join(tempfile.gettempdir(), f"tamis-checkpoint-{os.getpid()}"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def free_name(taken, base: str) -> str:
    """``base``, or ``base`` with underscores before it until no column of ``taken`` has that name (case-insensitive)."""
    used = {c.lower() for c in (taken.columns if isinstance(taken, DataFrame) else taken)}
    while base.lower() in used:
        base = "_" + base
    return base


def ship(spark: SparkSession) -> None:
    """Make this package importable by the Python workers of every executor, once a session."""
    sc = spark.sparkContext
    if getattr(sc, "_tamis_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="tamis-")) / f"{root.name}.zip"  # the driver serves it to the executors
    with zipfile.ZipFile(archive, "w") as z:
        for path in sorted(root.rglob("*.py")):
            z.write(path, path.relative_to(root.parent))
    sc.addPyFile(str(archive))
    sc._tamis_shipped = True
