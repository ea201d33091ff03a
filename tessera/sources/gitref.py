"""Spark data source "git_ref": the source files of a git ref.

The driver lists the ref's names once; executors read the files of their partition through one `git cat-file --batch`
process, not one process a file. Names are taken as git prints them, without the ignore list; files that git cannot
show are skipped; bytes that are not UTF-8 become replacement characters; line ends become line feeds; a byte order
mark stays. An unknown ref or repository is an error. Options: repo, ref, files_per_partition (default 256).
"""

from __future__ import annotations

import subprocess
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from tessera.schemas import SOURCES
from tessera.sources import names
from tessera.sources.tree import Files


def git(repo: str, *args: str) -> str:
    """Output of a git command as text; RuntimeError with its message if it fails."""
    done = subprocess.run(["git", *args], cwd=repo, capture_output=True)
    out, err = (names.universal(x.decode("utf-8", "replace")) for x in (done.stdout, done.stderr))
    if done.returncode:
        raise RuntimeError(err.strip() or out.strip() or "git command failed")
    return out


def contents(repo: str, ref: str, ids: list[str]) -> Iterator[tuple[str, str]]:
    """Ids and texts, through one process."""
    with subprocess.Popen(["git", "cat-file", "--batch"], cwd=repo, stdin=subprocess.PIPE, stdout=subprocess.PIPE) as run:
        for file_id in ids:
            run.stdin.write(f"{ref}:{file_id}\n".encode())
            run.stdin.flush()
            head = run.stdout.readline().split()
            if len(head) != 3 or not head[2].isdigit():
                continue
            data = run.stdout.read(int(head[2]) + 1)[:-1]
            if head[1] == b"blob":
                yield file_id, names.universal(data.decode("utf-8", "replace"))
        run.stdin.close()


class GitReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.repo, self.ref, self.size = options.get("repo", "."), options["ref"], int(options.get("files_per_partition", "256"))

    def partitions(self) -> list[InputPartition]:
        listed = git(self.repo, "ls-tree", "-r", "--name-only", self.ref).splitlines()
        ids = sorted(x.strip() for x in listed if names.supported(x.strip()))
        return [Files(ids[i : i + self.size]) for i in range(0, len(ids), self.size)] or [Files([])]

    def read(self, partition: InputPartition) -> Iterator[tuple[str, str, str]]:
        for file_id, text in contents(self.repo, self.ref, partition.value):
            yield self.ref, file_id, text


class GitRefSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "git_ref"

    def schema(self) -> StructType:
        return SOURCES

    def reader(self, schema: StructType) -> DataSourceReader:
        return GitReader({k.lower(): v for k, v in self.options.items()})
