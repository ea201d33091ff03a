"""The report of a project: graph, cycles, rankings, risks; and the comparison of two."""

from __future__ import annotations

import functools
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import sources
from tessera.lineage import cut
from tessera.operators import components, diff, extract, graph, resolve, risks


@dataclass
class Report:
    """Frames of one or more snapshots, each evaluated when first asked for. files: snapshot_id, file_id, language, repeated or not; dependencies: resolve's rows; distinct: none of these is repeated."""

    files: DataFrame
    dependencies: DataFrame
    distinct: bool = False

    @functools.cached_property
    def pairs(self) -> DataFrame:
        """Distinct edges without an id, flagged with the types of the dependencies."""
        return cut(graph.flagged(self.dependencies, self.distinct))

    @property
    def links(self) -> DataFrame:
        """Distinct edges; an id is made when read."""
        return self.pairs.select("snapshot_id", F.concat("source", F.lit("->"), "target").alias("id"), "source", "target")

    @functools.cached_property
    def bare(self) -> DataFrame:
        """Nodes without what follows from cycles."""
        return cut(graph.nodes(self.files.dropDuplicates(["snapshot_id", "file_id"]), self.dependencies, self.links))

    @functools.cached_property
    def counted(self) -> DataFrame:
        """Type and degrees of the nodes, which is all that rankings, thresholds and scores need of them."""
        return graph.tally(self.files, self.dependencies, self.pairs)

    @functools.cached_property
    def members(self) -> DataFrame:
        pairs = self.dependencies.select("snapshot_id", "source", F.col("id").alias("target"))
        counted = self.__dict__.get("counted")  # at hand where scores were asked for
        keep = lambda edge: graph.only_files(edge, self.files, self.dependencies) if counted is None else graph.without_others(edge, counted)
        return cut(components.strong_components(pairs, keep=keep))

    @functools.cached_property
    def limits(self) -> DataFrame:
        return cut(risks.thresholds(self.counted))

    @functools.cached_property
    def nodes(self) -> DataFrame:
        return cut(graph.annotate_nodes(self.bare, self.members))

    @functools.cached_property
    def edges(self) -> DataFrame:
        return cut(graph.annotate_edges(self.links, self.members))

    @property
    def circular_edges(self) -> DataFrame:
        return graph.circular_edges(self.dependencies, self.members)

    @property
    def metrics(self) -> DataFrame:
        return graph.metrics(self.bare, self.links, self.members)

    @property
    def complexity(self) -> DataFrame:
        return graph.complexity(graph.scored(self.counted))

    @property
    def critical(self) -> DataFrame:
        return graph.critical(self.counted)

    @property
    def cycles(self) -> DataFrame:
        return components.cycles(self.members)

    @property
    def gods(self) -> DataFrame:
        return risks.god_modules(self.counted, self.limits)

    @property
    def explosions(self) -> DataFrame:
        return risks.explosions(self.counted, self.limits)

    @property
    def broken(self) -> DataFrame:
        """violations, not written."""
        return risks.violations(self.links, self.counted, pick=graph.without_others)

    @functools.cached_property
    def violations(self) -> DataFrame:
        return cut(self.broken)

    @functools.cached_property
    def scores(self) -> DataFrame:
        return cut(risks.scores(self.counted, self.members, self.limits, self.broken))

    @property
    def top_risks(self) -> DataFrame:
        return risks.top_risks(self.scores)

    def deltas(self, base: str, head: str) -> DataFrame:
        """One row of differences between two snapshots."""
        return diff.deltas(diff.paired(self.files, self.dependencies, base, head), base, head)

    def views(self, prefix: str = "") -> None:
        """Registers the frames as temporary views, for SQL."""
        for name in ("nodes", "edges", "members", "limits", "metrics", "complexity", "critical", "cycles", "gods", "explosions", "violations", "scores", "top_risks"):
            getattr(self, name).createOrReplaceTempView(f"{prefix}{name}")


def of_graph(files: DataFrame, dependencies: DataFrame, distinct: bool = False) -> Report:
    """files: snapshot_id, file_id, language; dependencies: resolve's rows; distinct: none of these is repeated."""
    return Report(files, dependencies, distinct)


def of_sources(rows: DataFrame) -> Report:
    """rows: snapshot_id, file_id, content."""
    files = extract.virtual(rows)
    ids = cut(files.select("snapshot_id", "file_id", "language"))
    return of_graph(ids, cut(resolve.resolve(extract.extract(files), ids)))


def of_project(spark: SparkSession, path: str) -> Report:
    return of_sources(sources.tree(spark, path))


def of_ref(spark: SparkSession, repo: str, ref: str) -> Report:
    return of_sources(sources.git_ref(spark, repo, ref))


def compare(spark: SparkSession, repo: str, base: str, head: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One row of deltas, the added and the removed edges (by source, target) between two refs, analysed in one plan."""
    rows = sources.git_ref(spark, repo, base)
    both = of_sources(rows if base == head else rows.unionByName(sources.git_ref(spark, repo, head)))
    of = lambda ref: both.edges.filter(F.col("snapshot_id") == ref)
    return both.deltas(base, head), diff.added(of(base), of(head)).orderBy("source", "target"), diff.removed(of(base), of(head)).orderBy("source", "target")
