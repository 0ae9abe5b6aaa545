"""Command line: scan one file or folder; ``python -m tamis.cli PATH [--json]``."""

from __future__ import annotations

import argparse
import os

from pyspark.sql import SparkSession

from tamis.config import Config
from tamis.functions.session import ship
from tamis.plans import pipeline
from tamis.sources.files import read_files


def main(words: list[str] | None = None) -> int:
    """Prints a report a line (text or JSON). Exit code 2 where nothing was scanned."""
    args = argparse.ArgumentParser(prog="tamis", description="Scans PDF, DOCX and other files.")
    args.add_argument("path")
    args.add_argument("--json", action="store_true", help="print reports as JSON")
    args.add_argument("--config", help="settings as YAML")
    known = args.parse_args(words)
    cfg = Config.from_yaml(known.config) if known.config else Config.from_env()
    spark = SparkSession.builder.appName("tamis").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    ship(spark)
    path = known.path if "://" in known.path else os.path.abspath(known.path)
    files = read_files(spark, path)
    reports = pipeline.scan_files(files, cfg)
    lines = reports.toJSON() if known.json else pipeline.as_text(reports).rdd.map(lambda r: r["value"])
    n = 0
    for line in lines.toLocalIterator():
        print(line)
        n += 1
    for row in pipeline.rejects(files, cfg).toLocalIterator():
        print(f"{row['path']}: {row['reason']}")
    return 0 if n else 2


if __name__ == "__main__":
    raise SystemExit(main())
