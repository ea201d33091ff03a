"""Interactive views of a graph: filters, search, neighbourhoods, colours. Nodes and edges are annotated ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def folders(node: DataFrame) -> DataFrame:
    return node.filter("type = 'file'").select("snapshot_id", "folder").distinct()


def _ends(edge: DataFrame, node: DataFrame) -> DataFrame:
    end = lambda name: node.select("snapshot_id", F.col("id").alias(name))
    return edge.join(end("source"), ["snapshot_id", "source"], "left_semi").join(end("target"), ["snapshot_id", "target"], "left_semi").select(*edge.columns)


def visible(node: DataFrame, edge: DataFrame, folder: str | None = None, cycles_only: bool = False, term: str = "") -> tuple[DataFrame, DataFrame]:
    """The nodes and edges that stay: files of a folder, parts of cycles, labels that hold a term; packages only with a visible edge."""
    file = F.col("type") == "file"
    keep = F.lit(True)
    if folder is not None:
        keep = keep & (~file | (F.col("folder") == folder))
    if cycles_only:
        keep = keep & file & F.col("is_circular")
    if term.strip():
        keep = keep & F.contains(F.lower("label"), F.lit(term.strip().lower()))
    left = node.filter(keep)
    between = _ends(edge, left)
    if not cycles_only:
        touched = between.select("snapshot_id", F.explode(F.array("source", "target")).alias("id")).distinct()
        left = left.filter(file).unionByName(left.filter(~file).join(touched, ["snapshot_id", "id"], "left_semi").select(*left.columns))
        between = _ends(edge, left)
    return left, between.filter("is_circular") if cycles_only else between


def neighbours(edge: DataFrame, node_id: str, n: int | None = None) -> DataFrame:
    """direction (out, in) and id of a node's neighbours, the first n of each direction by id if asked for."""
    out = edge.filter(F.col("source") == node_id).select("snapshot_id", F.lit("out").alias("direction"), F.col("target").alias("id"))
    into = edge.filter(F.col("target") == node_id).select("snapshot_id", F.lit("in").alias("direction"), F.col("source").alias("id"))
    rows = out.unionByName(into).distinct()
    if n is None:
        return rows
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("snapshot_id", "direction").orderBy("id"))).filter(F.col("place") <= n).drop("place")


def neighbourhood(edge: DataFrame, node_id: str) -> DataFrame:
    """The closed neighbourhood's nodes: the node and all its neighbours."""
    near = edge.filter((F.col("source") == node_id) | (F.col("target") == node_id))
    return near.select("snapshot_id", F.explode(F.array("source", "target")).alias("id")).distinct()


# fixed values: the heat map's colours at 0, 0.5 and 1
GREEN, YELLOW, RED = (71, 181, 111), (242, 191, 67), (221, 77, 83)


def heat_colour(score: Column) -> Column:
    """The colour of a score, as rgb(r, g, b), from 0 to 1, linear between three colours; halves round up."""
    x = F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0))
    low = x <= 0.5
    share = F.when(low, x / 0.5).otherwise((x - 0.5) / 0.5)
    part = lambda i: F.floor(F.when(low, GREEN[i] + (YELLOW[i] - GREEN[i]) * share).otherwise(YELLOW[i] + (RED[i] - YELLOW[i]) * share) + 0.5).cast("int")
    return F.format_string("rgb(%d, %d, %d)", *(part(i) for i in range(3)))
