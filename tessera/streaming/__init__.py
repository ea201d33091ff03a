"""Extraction over streams of source rows: stateless, so the batch expressions run unchanged."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.operators.extract import extract, virtual
from tessera.schemas import SOURCES


def sources(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """A stream of rows (snapshot_id, file_id, content) from files that arrive in a folder."""
    return spark.readStream.format(fmt).schema(SOURCES).load(path)


def imports(rows: DataFrame) -> DataFrame:
    """Import entries of a stream of sources."""
    return extract(virtual(rows))
