"""Degree thresholds, god modules, explosions, layer violations and the risk score."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import numbers, paths
from tessera.operators.graph import between_files
from tessera.schemas import EXPLOSION_FLOOR, GOD_FLOOR, LAYERS, QUANTILE, RULE, TOP_RISKS, WEIGHTS


def thresholds(node: DataFrame, times: Column | None = None) -> DataFrame:
    """One row a snapshot: god_module_min_outgoing, dependency_explosion_min_connections. times: how many nodes a row stands for."""
    files = node.filter("type = 'file'").withColumn("total", F.col("outgoing") + F.col("incoming"))
    god = numbers.nearest_rank(files, "snapshot_id", "outgoing", QUANTILE, "god", times)
    explosion = numbers.nearest_rank(files, "snapshot_id", "total", QUANTILE, "explosion", times)
    every = node.select("snapshot_id").distinct().join(god, "snapshot_id", "left").join(explosion, "snapshot_id", "left")
    return every.select(
        "snapshot_id", F.greatest(F.lit(GOD_FLOOR), F.coalesce("god", F.lit(0))).cast("long").alias("god_module_min_outgoing"),
        F.greatest(F.lit(EXPLOSION_FLOOR), F.coalesce("explosion", F.lit(0))).cast("long").alias("dependency_explosion_min_connections"),
    )


def god_modules(node: DataFrame, limits: DataFrame) -> DataFrame:
    """file, outgoing; ranked by outgoing, then file."""
    return node.filter("type = 'file'").join(limits, "snapshot_id").filter("outgoing >= god_module_min_outgoing").select("snapshot_id", F.col("id").alias("file"), "outgoing")


def explosions(node: DataFrame, limits: DataFrame) -> DataFrame:
    """file, incoming, outgoing, total_connections; ranked by total_connections, then file."""
    rows = node.filter("type = 'file'").withColumn("total_connections", F.col("incoming") + F.col("outgoing"))
    return rows.join(limits, "snapshot_id").filter("total_connections >= dependency_explosion_min_connections").select("snapshot_id", F.col("id").alias("file"), "incoming", "outgoing", "total_connections")


def violations(edge: DataFrame, node: DataFrame, layers: dict[str, int] | None = None, pick: Callable[[DataFrame, DataFrame], DataFrame] = between_files) -> DataFrame:
    """Edges between files from a layer of lower to one of higher rank: source, target, source_layer, target_layer, rule; ordered by edge id. pick: takes those between files, given edges and node."""
    ranks = F.create_map(*(F.lit(x) for pair in (layers or LAYERS).items() for x in pair))
    rows = edge.select("snapshot_id", "id", "source", "target", paths.first_segment(F.col("source")).alias("source_layer"), paths.first_segment(F.col("target")).alias("target_layer"))
    wrong = ranks[F.col("source_layer")] < ranks[F.col("target_layer")]
    return pick(rows.filter(wrong), node).withColumn("rule", F.lit(RULE))


def violations_by_file(found: DataFrame) -> DataFrame:
    return found.groupBy("snapshot_id", F.col("source").alias("file")).agg(F.count("*").alias("violations"))


def scores(node: DataFrame, cycle_members: DataFrame, limits: DataFrame, broken: DataFrame) -> DataFrame:
    """file, risk_score, dependents, outgoing, signals of files with a positive score; ranked by score, then file."""
    rows = node.filter("type = 'file'").select("snapshot_id", F.col("id").alias("file"), "incoming", "outgoing")
    rows = rows.join(cycle_members.select("snapshot_id", F.col("file_id").alias("file"), F.lit(True).alias("cycle")), ["snapshot_id", "file"], "left")
    rows = rows.join(violations_by_file(broken), ["snapshot_id", "file"], "left").join(limits, "snapshot_id")
    cycle, many = F.coalesce("cycle", F.lit(False)), F.coalesce("violations", F.lit(0))
    god, explosion = F.col("outgoing") >= F.col("god_module_min_outgoing"), F.col("incoming") + F.col("outgoing") >= F.col("dependency_explosion_min_connections")
    score = F.col("incoming") * WEIGHTS["incoming"] + F.col("outgoing") * WEIGHTS["outgoing"] + many * WEIGHTS["violation"]
    for flag, weight in ((cycle, "cycle"), (god, "god"), (explosion, "explosion")):
        score = score + F.when(flag, WEIGHTS[weight]).otherwise(0)
    signals = F.array_compact(F.array(F.when(cycle, "circular_dependency"), F.when(god, "god_module"), F.when(explosion, "dependency_explosion"), F.when(many > 0, F.concat(F.lit("layer_violations:"), many.cast("string")))))
    return rows.select("snapshot_id", "file", score.cast("long").alias("risk_score"), F.col("incoming").alias("dependents"), "outgoing", signals.alias("signals")).filter("risk_score > 0")


def top_risks(scored: DataFrame, n: int = TOP_RISKS) -> DataFrame:
    """The n files of the highest scores in each snapshot. Scores that n files exceed are left out before files are ordered."""
    above = Window.partitionBy("snapshot_id").orderBy(F.desc("risk_score")).rowsBetween(Window.unboundedPreceding, -1)
    levels = scored.groupBy("snapshot_id", "risk_score").agg(F.count("*").alias("files")).withColumn("above", F.coalesce(F.sum("files").over(above), F.lit(0)))
    least = levels.filter(F.col("above") < n).groupBy("snapshot_id").agg(F.min("risk_score").alias("least"))
    scored = scored.join(F.broadcast(least), "snapshot_id").filter("risk_score >= least").select(*scored.columns)
    place = F.row_number().over(Window.partitionBy("snapshot_id").orderBy(F.desc("risk_score"), "file"))
    return scored.withColumn("place", place).filter(F.col("place") <= n)
