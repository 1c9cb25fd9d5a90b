"""Scans of the input tables.

All reads are plain ``spark.read.parquet`` so Catalyst prunes columns and
pushes filters into the scan; callers select only what they need (``html``
is by far the widest column and must stay out of link-only plans).
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Scan one driver table (one parquet file or folder per table)."""
    return spark.read.parquet(table_path(sf_dir, name))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``src_pages``: page snapshot ``(page_id, url, html)``."""
    return read_table(spark, sf_dir, "pages")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event log; ``ts`` is TIMESTAMP_NTZ in the files, exposed as-is."""
    return read_table(spark, sf_dir, "events")
