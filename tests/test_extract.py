import pytest
from pyspark.sql import functions as F

from tessera.operators.extract import extract, virtual
from tessera.streaming import imports, sources


def entries(spark, file_id, content):
    rows = spark.createDataFrame([("s", file_id, content)], "snapshot_id string, file_id string, content string")
    return [(r.kind, r.specifier, r.names) for r in extract(virtual(rows)).orderBy("pos").collect()]


CASES = [
    ("a.js", 'import express from "express"\nimport { auth } from "./auth"\nconst c = require("./config")\nimport("./dynamic")\nexport { thing } from "./thing"', [("js", s, []) for s in ("./auth", "./config", "./dynamic", "./thing", "express")]),
    ("a.ts", 'import type { A } from "./t";\nimport "side";\n// import x from "commented"\nimport A from "./t"', [("js", s, []) for s in ("./t", "commented", "side")]),
    ("a.js", 'import a, {\n  b,\n} from \'multi\';\nrequire( "spaced" )\nimport " "', [("js", "multi", []), ("js", "spaced", [])]),
    ("a.py", "import os\nimport app.utils as utils\nfrom .services import auth, cache\nfrom framework.http import Request", [("import", "os", []), ("import", "app.utils", []), ("from", ".services", ["auth", "cache"]), ("from", "framework.http", ["Request"])]),
    ("a.py", "from x import y\nimport a, b as c , d", [("import", "a", []), ("import", "b", []), ("import", "d", []), ("from", "x", ["y"])]),
    ("a.py", "﻿import os\nimport re  # gone\n  import sys", [("import", "os", []), ("import", "sys", [])]),
    ("a.py", "from m import (a, b)\nfrom . import (\n  c\n)", [("from", "m", ["(a", "b)"]), ("from", ".", ["("])]),
    ("a.py", "import\nfoo", [("import", "foo", [])]),
    ("a.py", "import os\r\nimport sys\r\n", [("import", "os", []), ("import", "sys", [])]),
    ("a.py", "from a import b as c, *", [("from", "a", ["b", "*"])]),
    ("a.py", "import nb", [("import", "nb", [])]),
    ("a.py", "important = 1\nimport_x = 2", []),
    ("a.rs", "use crate::core::graph::builder;\nuse serde::{Serialize, Deserialize};\nmod parser;\nextern crate tokio;", [("use", "crate::core::graph::builder", []), ("use", "serde", []), ("mod", "parser", []), ("extern", "tokio", [])]),
    ("a.rs", "mod z;\nuse a::b as c;\nuse d::*;\npub use e::f;\npub mod g;\nuse h ::\n  i;", [("use", "a::b", []), ("use", "d", []), ("use", "h :: i", []), ("mod", "z", [])]),
    ("a.rs", "use a::{b as c, d};", [("use", "a::{b", [])]),
    ("a.txt", "import os", []),
    ("a.PY", "import os", [("import", "os", [])]),
    ("a.py", None, []),
    ("a.py", "", []),
]


@pytest.mark.parametrize("file_id, content, expected", CASES)
def test_entries(spark, file_id, content, expected):
    assert entries(spark, file_id, content) == expected


def test_stream(spark, tmp_path):
    spark.createDataFrame([("s", "a.py", "import os")], "snapshot_id string, file_id string, content string").write.parquet(str(tmp_path / "in"))
    run = imports(sources(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("seen").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
    run.awaitTermination(60)
    assert [r.specifier for r in spark.table("seen").select(F.col("specifier")).collect()] == ["os"]
