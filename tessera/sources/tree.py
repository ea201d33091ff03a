"""Spark data source "source_tree": the source files of a directory.

Spark's own file sources hide names that begin with a dot or an underscore, so __init__.py would be missing. The driver
lists the tree, leaving out ignored directories while walking; the files are dealt to partitions and read by executors,
which must see the same file system. Files that are not UTF-8 or cannot be read are skipped, a byte order mark is
dropped, line ends become line feeds. Options: path, files_per_partition (default 256).
"""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from tessera.schemas import SOURCES
from tessera.sources import names


class Files(InputPartition):
    def __init__(self, ids: list[str]):
        super().__init__(ids)


def listed(root: str) -> list[str]:
    """Ids below root, sorted; of a root that is a file, its name."""
    if os.path.isfile(root):
        return [os.path.basename(root)] if names.supported(root) else []
    found = []
    for folder, inner, files in os.walk(root):
        inner[:] = [d for d in inner if not names.skipped(d)]
        below = os.path.relpath(folder, root)
        found += ["/".join(([] if below == "." else below.split(os.sep)) + [f]) for f in files if names.supported(f) and not names.skipped(f) and os.path.isfile(os.path.join(folder, f))]
    return sorted(found)


class TreeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root = os.path.realpath(options["path"])
        self.size = int(options.get("files_per_partition", "256"))

    def partitions(self) -> list[InputPartition]:
        ids = listed(self.root)
        return [Files(ids[i : i + self.size]) for i in range(0, len(ids), self.size)] or [Files([])]

    def read(self, partition: InputPartition) -> Iterator[tuple[str, str, str]]:
        for file_id in partition.value:
            path = self.root if os.path.isfile(self.root) else os.path.join(self.root, file_id)
            try:
                with open(path, encoding="utf-8-sig", newline=None) as f:
                    yield self.root, file_id, f.read()
            except (UnicodeDecodeError, OSError):
                continue


class SourceTreeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> StructType:
        return SOURCES

    def reader(self, schema: StructType) -> DataSourceReader:
        return TreeReader({k.lower(): v for k, v in self.options.items()})
