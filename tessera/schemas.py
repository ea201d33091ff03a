"""Column layouts and constant tables of the dependency graph."""

from __future__ import annotations

from pyspark.sql import types as T

S, L, D, B = T.StringType(), T.LongType(), T.DoubleType(), T.BooleanType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


SOURCES = _struct(snapshot_id=S, file_id=S, content=S)
DEPENDENCIES = _struct(snapshot_id=S, source=S, id=S, label=S, type=S, ord=L)
NODES = _struct(snapshot_id=S, id=S, label=S, type=S, language=S, folder=S, outgoing=L, incoming=L)
EDGES = _struct(snapshot_id=S, id=S, source=S, target=S)

# fixed values: languages by lower-case file suffix
EXTENSIONS = {
    ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".cjs": "javascript",
    ".ts": "typescript", ".tsx": "typescript", ".mts": "typescript", ".cts": "typescript",
    ".py": "python", ".rs": "rust",
}

# fixed values: suffixes that a JavaScript or TypeScript specifier is tried with, in this order
JS_SUFFIXES = (".cjs", ".cts", ".js", ".json", ".jsx", ".mjs", ".mts", ".ts", ".tsx")

# fixed values: directories whose files are not read
IGNORED = (".git", "node_modules", "dist", "build", "target", "coverage", ".venv", "venv", "__pycache__", ".pytest_cache", ".ruff_cache", ".mypy_cache")

# fixed values: rank of a layer (first path segment); a lower rank must not depend on a higher one
LAYERS = {
    "cli": 5, "web-ui": 5, "api": 5, "interface": 5, "app": 4, "application": 4, "core": 3, "domain": 3,
    "exporters": 2, "adapters": 2, "infra": 2, "utils": 1, "shared": 1,
}

RULE = "lower-level module should not depend on higher-level module"

# fixed values: floors of the two degree thresholds, their quantile, and the weights of the risk score
GOD_FLOOR, EXPLOSION_FLOOR, QUANTILE = 8, 12, 0.9
WEIGHTS = {"incoming": 2, "outgoing": 1, "cycle": 10, "god": 8, "explosion": 6, "violation": 4}
TOP_RISKS = 15
