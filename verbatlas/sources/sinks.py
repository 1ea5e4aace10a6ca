"""Sinks: tables by name, and status files of counts."""

from __future__ import annotations

import json
import os
from collections.abc import Mapping

from pyspark.sql import DataFrame


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """One file with a header: for reports, whose tables are small."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_tables(tables: Mapping[str, DataFrame], folder: str, prefix: str) -> dict[str, int]:
    """Each table as ``<prefix>_<name>`` in CSV; the counts of rows."""
    counts = {}
    for name, df in tables.items():
        path = f"{folder}/{prefix}_{name}"
        write_csv(df, path)
        counts[name] = df.sparkSession.read.option("header", True).csv(path).count()
    return counts


def write_status(status: Mapping, folder: str, name: str) -> None:
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/{name}.json", "w", encoding="utf-8") as f:
        json.dump(status, f, indent=2, default=str)
