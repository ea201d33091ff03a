import pytest
from pyspark.sql import functions as F

from tessera.functions import paths
from tessera.operators.extract import extract, virtual
from tessera.operators.resolve import resolve


def resolved(spark, content, file_id, others):
    rows = [("s", file_id, content)] + [("s", o, "") for o in others] + [("t", "decoy.py", ""), ("t", "lib.js", "")]
    files = virtual(spark.createDataFrame(rows, "snapshot_id string, file_id string, content string"))
    found = resolve(extract(files), files).filter(F.col("source") == file_id).orderBy("ord").collect()
    assert all(r.label == r.id.removeprefix("pkg:") and r.type == ("package" if r.id.startswith("pkg:") else "file") for r in found)
    return [r.id for r in found]


JS = [
    ('import "./lib"', "web/app.ts", ["web/lib.ts", "web/lib.js", "web/lib/index.cjs"], ["web/lib.js"]),
    ('import "./lib"', "web/app.ts", ["web/lib/index.ts", "web/lib/index.js"], ["web/lib/index.js"]),
    ('import "./x.js"', "web/app.ts", ["web/x.ts", "web/x.js.ts"], []),
    ('import "./user.service"', "a.ts", ["user.service.ts"], []),
    ('import "../lib"', "web/app.ts", ["lib.mjs"], ["lib.mjs"]),
    ('import "../../lib"', "web/app.ts", ["lib.js"], []),
    ('import "/web/util"', "x/y/app.ts", ["web/util.tsx"], ["web/util.tsx"]),
    ('import "react/dom"; import "react"', "a.js", [], ["pkg:react"]),
    ('import "@s/p/q"; import "@x"; import "node:fs"; import "@/x/y"', "a.js", [], ["pkg:@/x", "pkg:@s/p", "pkg:@x", "pkg:node:fs"]),
    ('import "./lib.js"', "a.js", ["lib.js"], ["lib.js"]),
    ('import "./data.json"', "a.js", ["data.json"], []),
    ('import "lib"', "a.js", ["lib.js"], ["pkg:lib"]),
    ('import "."', "web/a.js", ["web/index.js"], ["web/index.js"]),
]
PY = [
    ("import os.path, a.b", "m.py", ["a/b.py"], ["pkg:os.path", "a/b.py"]),
    ("import a", "m.py", ["a.py", "a/__init__.py"], ["a.py"]),
    ("import a", "m.py", ["a/__init__.py"], ["a/__init__.py"]),
    ("from pkg import sub", "m.py", ["pkg/sub.py"], ["pkg:pkg"]),
    ("from . import x, y, *", "p/q/m.py", ["p/q/x.py", "p/q/y/__init__.py"], ["p/q/x.py", "p/q/y/__init__.py"]),
    ("from .. import x", "p/q/m.py", ["p/x.py", "p/q/x.py"], ["p/x.py"]),
    ("from ...... import x", "p/q/m.py", ["x.py"], ["x.py"]),
    ("from ..z.w import x", "p/q/m.py", ["p/z/w.py"], ["p/z/w.py"]),
    ("from .gone import x", "p/m.py", ["gone.py"], []),
    ("import a\nimport a\nfrom a import b", "m.py", ["a.py"], ["a.py"]),
    ("from .m import x", "m.py", [], ["m.py"]),
]
RUST = [
    ("mod x;\nmod y;\nmod gone;", "src/a/lib.rs", ["src/a/x.rs", "src/a/y/mod.rs"], ["src/a/x.rs", "src/a/y/mod.rs"]),
    ("use crate::a::b::C;", "src/deep/m.rs", ["src/a/b.rs", "src/a.rs"], ["src/a/b.rs"]),
    ("use crate::a::b::C;", "crates/k/src/m.rs", ["crates/k/src/a/mod.rs"], ["crates/k/src/a/mod.rs"]),
    ("use crate::gone;", "src/m.rs", [], []),
    ("use self::z::Q;", "src/core/g.rs", ["src/core/z.rs"], ["src/core/z.rs"]),
    ("use super::z::Q;", "src/core/g.rs", ["src/z.rs", "src/core/z.rs"], ["src/z.rs"]),
    ("use super::super::z;", "a/b/c/g.rs", ["a/z.rs"], ["a/z.rs"]),
    ("use super::super::super::super::z;", "a/g.rs", ["z.rs"], ["z.rs"]),
    ("use a::b;", "m.rs", ["a.rs"], ["a.rs"]),
    ("use serde::{A, B};\nextern crate tokio;", "src/m.rs", [], ["pkg:serde", "pkg:tokio"]),
    ("use crate::{a, b};\nuse super::*;", "src/m.rs", [], ["pkg:crate", "pkg:super"]),
]


@pytest.mark.parametrize("content, file_id, others, expected", JS + PY + RUST)
def test_resolution(spark, content, file_id, others, expected):
    assert resolved(spark, content, file_id, others) == expected


def values(spark, make, *texts):
    return [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(make(F.col("t"))).collect()]


def test_paths(spark):
    assert values(spark, paths.normalize, "./a//b/./c", "a\\b", "", ".", "a/../b", "/x//y", "//x", "///x", "a/") == ["a/b/c", "a/b", ".", ".", "a/../b", "/x/y", "//x", "/x", "a"]
    assert values(spark, lambda c: paths.join(F.lit("a/b"), c), "../c", "../../c", "../../../c", "..", "../..", "", "./x/../y") == ["a/c", "c", "", "a", ".", "a/b", "a/b/y"]
    assert values(spark, paths.suffix, "a.py", ".py", "a.", "x/a.tar.gz", "x.y/a", "a/.b.c") == [".py", "", "", ".gz", "", ".c"]
    assert values(spark, paths.parent, "a/b/c", "a", "a/b", ".") == ["a/b", ".", "a", "."]
    assert values(spark, paths.language, "a.TSX", "b.cjs", "c.rs", "d.py", "e.txt", "f") == ["typescript", "javascript", "rust", "python", None, None]
    assert values(spark, paths.first_segment, "a/b/c", "a", "./a/b") == ["a", ".", "a"]
    assert values(spark, lambda c: paths.relative("/r/p", c), "/r/p/x/y.py", "/r/p") == ["x/y.py", "p"]
