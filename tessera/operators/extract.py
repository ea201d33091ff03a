"""Sources to import entries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import imports, paths


def virtual(sources: DataFrame) -> DataFrame:
    """Sources (snapshot_id, file_id, content) with normalised ids, unsupported languages left out."""
    ids = sources.withColumn("file_id", paths.normalize(F.col("file_id")))
    return ids.withColumn("language", paths.language(F.col("file_id"))).filter("language IS NOT NULL").select("snapshot_id", "file_id", "language", "content")


def extract(files: DataFrame) -> DataFrame:
    """Import entries of files (snapshot_id, file_id, language, content): pos, kind, specifier, names."""
    entries = imports.by_language(F.col("language"), imports.newlines(F.coalesce("content", F.lit(""))))
    rows = files.select("snapshot_id", "file_id", "language", F.posexplode(entries).alias("pos", "entry"))
    return rows.select("snapshot_id", "file_id", "language", "pos", "entry.*")
