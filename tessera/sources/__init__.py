"""Sources: directory trees, git refs, stores that Spark reads, and virtual files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.sources.gitref import GitRefSource
from tessera.sources.tree import SourceTreeSource


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SourceTreeSource)
    spark.dataSource.register(GitRefSource)


def tree(spark: SparkSession, path: str) -> DataFrame:
    """snapshot_id (the root), file_id, content of the supported files below a directory, or of a single file."""
    register(spark)
    return spark.read.format("source_tree").option("path", path).load()


def git_ref(spark: SparkSession, repo: str, ref: str) -> DataFrame:
    """snapshot_id (the ref), file_id, content of the supported files of a git ref."""
    register(spark)
    return spark.read.format("git_ref").option("repo", repo).option("ref", ref).load()
