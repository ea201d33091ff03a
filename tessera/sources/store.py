"""Source files in stores that only Spark reads, through its binary file source.

That source hides names that begin with a dot or an underscore; use the source_tree data source where such files matter
and executors see the file system.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import imports, paths


def decoded(files: DataFrame) -> DataFrame:
    """content (binary) to text: invalid UTF-8 is left out, a byte order mark dropped, line ends become line feeds."""
    valid = files.filter(F.is_valid_utf8(F.col("content").cast("string")))
    text = F.regexp_replace(F.decode("content", "UTF-8"), "^\uFEFF", "")
    return valid.withColumn("content", imports.newlines(text))


def binary(spark: SparkSession, root: str) -> DataFrame:
    """snapshot_id (the root), file_id, content of the supported files below root."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    top = F.regexp_replace(F.lit(root.rstrip("/")), "^[a-z0-9]+:/*", "/")
    plain = F.regexp_replace("path", "^[a-z0-9]+:/*", "/")
    ids = files.withColumn("file_id", F.regexp_replace(F.substring(plain, F.length(top) + 2, F.length(plain)), "^/+", ""))
    kept = ids.filter(paths.language(F.col("file_id")).isNotNull() & ~paths.ignored(F.col("file_id")))
    return decoded(kept.select(F.lit(root).alias("snapshot_id"), "file_id", "content"))
