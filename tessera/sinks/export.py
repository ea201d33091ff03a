"""Exports of a report of one snapshot.

The text formats describe one project and are assembled on the driver from the collected report; `tables` writes the
frames of any number of snapshots in parallel, and `mermaid_lines` gives the diagram as a frame.
"""

from __future__ import annotations

import json
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.lineage import cut
from tessera.operators.graph import node_order
from tessera.plans.report import Report


def collected(report: Report, project_root: str) -> dict:
    """The report of its only snapshot as plain lists and dicts, in their orders."""
    node = [
        {"id": r.id, "label": r.label, "type": r.type, "language": r.language, "folder": r.folder, "outgoing": r.outgoing, "incoming": r.incoming, "isCircular": r.is_circular, "complexityImports": r.complexity_imports, "complexityScore": r.complexity_score}
        for r in report.nodes.orderBy(*node_order()).collect()
    ]
    edge = [{"id": r.id, "source": r.source, "target": r.target, "isCircular": r.is_circular} for r in report.edges.orderBy("id").collect()]
    metrics = report.metrics.first()
    count = lambda name: metrics[name] if metrics else 0
    limits = report.limits.first()
    return {
        "projectRoot": project_root, "nodes": node, "edges": edge,
        "metrics": {
            "filesAnalyzed": count("files_analyzed"), "totalDependencies": count("total_dependencies"), "externalDependencies": count("external_dependencies"), "circularDependencyCount": count("circular_dependency_count"),
            "complexity": [{"file": r.file, "imports": r.imports, "score": r.score} for r in report.complexity.orderBy(F.desc("score"), "file").collect()],
            "criticalFiles": [{"file": r.file, "dependents": r.dependents} for r in report.critical.orderBy(F.desc("dependents"), "file").collect()],
        },
        "cycles": [r.members for r in report.cycles.orderBy("place").collect()],
        "risks": {
            "god_modules": [{"file": r.file, "outgoing": r.outgoing} for r in report.gods.orderBy(F.desc("outgoing"), "file").collect()],
            "layer_violations": [{"source": r.source, "target": r.target, "sourceLayer": r.source_layer, "targetLayer": r.target_layer, "rule": r.rule} for r in report.violations.orderBy("id").collect()],
            "dependency_explosions": [{"file": r.file, "incoming": r.incoming, "outgoing": r.outgoing, "totalConnections": r.total_connections} for r in report.explosions.orderBy(F.desc("total_connections"), "file").collect()],
            "top_risk_files": [{"file": r.file, "riskScore": r.risk_score, "dependents": r.dependents, "outgoing": r.outgoing, "signals": r.signals} for r in report.top_risks.orderBy("place").collect()],
            "thresholds": {"god_module_min_outgoing": limits.god_module_min_outgoing if limits else 8, "dependency_explosion_min_connections": limits.dependency_explosion_min_connections if limits else 12},
        },
        "simple": {"nodes": [n["id"] for n in node], "edges": [[e["source"], e["target"]] for e in edge]},
    }


def _written(path: str | Path, text: str) -> Path:
    target = Path(path).resolve()
    target.parent.mkdir(parents=True, exist_ok=True)
    target.write_text(text, encoding="utf-8")
    return target


def write_json(report: dict, path: str | Path) -> Path:
    body = {"projectRoot": report["projectRoot"], "generatedAt": datetime.now(UTC).isoformat(), **report["simple"], **{k: report[k] for k in ("metrics", "cycles", "risks")}}
    body["detailed"] = {"nodes": report["nodes"], "edges": report["edges"]}
    return _written(path, json.dumps(body, indent=2) + "\n")


def write_cytoscape(report: dict, path: str | Path) -> Path:
    body = {kind: [{"data": item} for item in report[kind]] for kind in ("nodes", "edges")}
    body["metadata"] = {k: report[k] for k in ("projectRoot", "metrics", "cycles", "risks")}
    return _written(path, json.dumps(body, indent=2) + "\n")


def mermaid_id(node_id: Column, node_type: Column) -> Column:
    prefix = F.when(node_type == "package", "pkg_").otherwise("file_")
    return F.concat(prefix, F.regexp_replace(F.regexp_replace(node_id, "^pkg:", ""), r"[^\p{L}\p{N}_]", "_"))


def numbered(rows: DataFrame, order: list[Column]) -> DataFrame:
    """rows with line_no, from 1 on in each snapshot: range partitions are sorted alone, and each starts behind those before it."""
    keys = [F.col("snapshot_id"), *order]
    placed = cut(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__at", F.monotonically_increasing_id()))
    pieces = placed.groupBy("snapshot_id", F.shiftright("__at", 33).alias("__piece")).agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    before = Window.partitionBy("snapshot_id").orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = pieces.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    joined = placed.withColumn("__piece", F.shiftright("__at", 33)).join(starts, ["snapshot_id", "__piece"])
    return joined.select(*rows.columns, (F.col("__at") - F.col("__first") + F.col("__before") + 1).alias("line_no"))


def mermaid_lines(node: DataFrame, edge: DataFrame) -> DataFrame:
    """snapshot_id, part (0 head, 1 nodes, 2 edges), line_no in the part, line. Nodes of equal diagram ids appear once, the first; edges all."""
    named = node.withColumn("m", mermaid_id(F.col("id"), F.col("type")))
    own = named.withColumn("r", F.row_number().over(Window.partitionBy("snapshot_id", "m").orderBy(*node_order()))).filter("r = 1")
    nodes = numbered(own, node_order()).select("snapshot_id", F.lit(1).alias("part"), "line_no", F.concat(F.lit("  "), "m", F.lit("["), F.replace("label", F.lit('"'), F.lit('\\"')), F.lit("]")).alias("line"))
    kind = lambda c: F.when(F.startswith(c, F.lit("pkg:")), "package").otherwise("file")
    ends = [mermaid_id(F.col(c), kind(F.col(c))) for c in ("source", "target")]
    edges = numbered(edge, [F.col("id")]).select("snapshot_id", F.lit(2).alias("part"), "line_no", F.concat(F.lit("  "), ends[0], F.lit(" --> "), ends[1]).alias("line"))
    head = node.select("snapshot_id").distinct().select("snapshot_id", F.lit(0).alias("part"), F.lit(0).cast("long").alias("line_no"), F.lit("graph TD").alias("line"))
    return head.unionByName(nodes).unionByName(edges)


def write_mermaid(node: DataFrame, edge: DataFrame, path: str | Path) -> Path:
    lines = [r.line for r in mermaid_lines(node, edge).orderBy("part", "line_no").select("line").collect()] or ["graph TD"]
    return _written(path, "\n".join(lines) + "\n")


def elements(node: DataFrame, edge: DataFrame) -> DataFrame:
    """Cytoscape elements as rows: grp (nodes, edges), id, data (JSON)."""
    camel = lambda df: F.to_json(F.struct(*(F.col(c).alias("".join(w.capitalize() if i else w for i, w in enumerate(c.split("_")))) for c in df.columns if c != "snapshot_id")))
    return node.select("snapshot_id", F.lit("nodes").alias("grp"), "id", camel(node).alias("data")).unionByName(edge.select("snapshot_id", F.lit("edges").alias("grp"), "id", camel(edge).alias("data")))


def tables(report: Report, directory: str) -> None:
    """All frames as Parquet below a directory, one folder each; for any number of snapshots."""
    for name in ("nodes", "edges", "members", "limits", "metrics", "complexity", "critical", "cycles", "gods", "explosions", "violations", "scores", "top_risks"):
        getattr(report, name).write.mode("overwrite").parquet(f"{directory.rstrip('/')}/{name}")
