"""Command line: analyze, serve, diff, version."""

from __future__ import annotations

import argparse
import json
import sys
import webbrowser
from pathlib import Path

from pyspark.sql import SparkSession

from tessera import __version__
from tessera.plans import report as plans
from tessera.sinks import export, web

OUT = ".tessera/graph.json", ".tessera/graph.mmd", ".tessera/graph-cytoscape.json"


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tessera", description="Dependency-graph analysis on Spark")
    commands = top.add_subparsers(dest="command")
    for name, default in (("analyze", "json"), ("serve", "both")):
        p = commands.add_parser(name)
        p.add_argument("path", nargs="?", default=".")
        p.add_argument("--format", choices=("json", "mermaid", "both"), default=default)
        for flag, out in zip(("--out", "--out-mermaid", "--out-cytoscape"), OUT):
            p.add_argument(flag, default=out)
        p.add_argument("--include-cytoscape", action="store_true")
        if name == "serve":
            p.add_argument("--port", type=int, default=3000)
            p.add_argument("--host", default="127.0.0.1")
            p.add_argument("--no-open", action="store_true")
    p = commands.add_parser("diff")
    p.add_argument("base_ref")
    p.add_argument("head_ref")
    p.add_argument("--repo", default=".")
    p.add_argument("--json", action="store_true")
    commands.add_parser("version")
    return top


def _spark() -> SparkSession:
    return SparkSession.builder.appName("tessera").config("spark.ui.showConsoleProgress", "false").getOrCreate()


def export_all(found: plans.Report, report: dict, args: argparse.Namespace) -> dict[str, str]:
    """Writes what the flags ask for; the paths by format."""
    out = {}
    if args.format in ("json", "both"):
        out["JSON report"] = str(export.write_json(report, args.out))
    if args.format in ("mermaid", "both"):
        out["Mermaid graph"] = str(export.write_mermaid(found.nodes, found.edges, args.out_mermaid))
    if args.include_cytoscape:
        out["Cytoscape data"] = str(export.write_cytoscape(report, args.out_cytoscape))
    return out


def summary(report: dict, written: dict[str, str]) -> str:
    m = report["metrics"]
    lines = [f"[ok] {m['filesAnalyzed']} files analyzed", f"[ok] {m['totalDependencies']} dependencies detected", f"[ok] {m['circularDependencyCount']} circular dependencies detected"]
    if m["complexity"]:
        lines += ["Top complexity (imports):"] + [f"  - {c['file']}: {c['imports']} imports ({round(c['score'] * 100)}% score)" for c in m["complexity"][:5]]
    if report["risks"]["top_risk_files"]:
        lines += ["Top risk files:"] + [f"  - {r['file']}: score {r['riskScore']} ({', '.join(r['signals']) or 'none'})" for r in report["risks"]["top_risk_files"][:5]]
    return "\n".join(lines + [f"[info] {kind} exported to {path}" for kind, path in written.items()])


def _analyzed(args: argparse.Namespace) -> dict:
    path = str(Path(args.path).resolve())
    found = plans.of_project(_spark(), path)
    report = export.collected(found, path)
    print(summary(report, export_all(found, report, args)))
    return report


def _serve(args: argparse.Namespace) -> None:
    with web.server(_analyzed(args), args.port, args.host) as http:
        print(f"Serving on http://localhost:{args.port}", flush=True)
        if not args.no_open:
            webbrowser.open(f"http://localhost:{args.port}")
        try:
            http.serve_forever()
        except KeyboardInterrupt:
            pass


def diff_text(row: dict) -> str:
    lines = [f"Comparing {row['base_ref']} -> {row['head_ref']}", f"{row['edges_delta']:+d} dependencies", f"{row['cycles_delta']:+d} circular dependencies", f"complexity {row['complexity_delta_percent']:+.2f}%"]
    return "\n".join(lines + [f"{row[key]:+d} {name}" for key, name in (("layer_violations_delta", "layer violations"), ("god_modules_delta", "god modules"), ("dependency_explosions_delta", "dependency explosions"))])


def diff_dict(row: dict, added: list, removed: list) -> dict:
    return {
        "baseRef": row["base_ref"], "headRef": row["head_ref"], "edges": {"added": added, "removed": removed, "delta": row["edges_delta"]},
        "cycles": {"base": row["base_cycles"], "head": row["head_cycles"], "delta": row["cycles_delta"]},
        "complexity": {"baseAverageScore": row["base_average_score"], "headAverageScore": row["head_average_score"], "delta": row["complexity_delta"], "deltaPercent": row["complexity_delta_percent"]},
        "riskSummary": {"baseTopRisks": row["base_top_risks"], "headTopRisks": row["head_top_risks"], "layerViolationsDelta": row["layer_violations_delta"], "godModulesDelta": row["god_modules_delta"], "dependencyExplosionsDelta": row["dependency_explosions_delta"]},
    }


def _diff(args: argparse.Namespace) -> None:
    deltas, added, removed = plans.compare(_spark(), str(Path(args.repo).resolve()), args.base_ref, args.head_ref)
    row = deltas.first().asDict()
    print(json.dumps(diff_dict(row, *([list(r) for r in df.collect()] for df in (added, removed))), indent=2) if args.json else diff_text(row))


def main(argv: list[str] | None = None) -> int:
    """0 if all went well, 1 with a message on any error; help without a command."""
    parser = _parser()
    args = parser.parse_args(argv)
    if args.command is None:
        parser.print_help()
        return 0
    try:
        if args.command == "version":
            print(f"tessera {__version__}")
        else:
            {"analyze": _analyzed, "serve": _serve, "diff": _diff}[args.command](args)
    except Exception as e:  # noqa: BLE001  the command line reports any error and ends
        print(f"[error] {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
