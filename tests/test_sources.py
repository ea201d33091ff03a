import json
import subprocess

import pytest

from tessera import cli, sources
from tessera.plans import report
from tessera.sinks import export
from tessera.sources import store


def git(repo, *args):
    subprocess.run(["git", "-c", "user.name=t", "-c", "user.email=t@example.com", *args], cwd=repo, check=True, capture_output=True)


def put(root, files):
    for name, data in files.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(data if isinstance(data, bytes) else data.encode())


def rows(df):
    return sorted((r.file_id, r.content) for r in df.collect())


FILES = {
    "a.py": b"\xef\xbb\xbfimport b\r\nimport c\r", "pkg/__init__.py": "x", "pkg/.hidden.js": "h", "_u/v.TS": "v", "node_modules/i.js": "no", "deep/build/x.py": "no",
    "bad.py": b"\xff\xfe", "note.txt": "no", "build.py": "yes",
}


def test_tree(spark, tmp_path):
    put(tmp_path, FILES)
    assert rows(sources.tree(spark, str(tmp_path))) == [("_u/v.TS", "v"), ("a.py", "import b\nimport c\n"), ("build.py", "yes"), ("pkg/.hidden.js", "h"), ("pkg/__init__.py", "x")]
    assert rows(sources.tree(spark, str(tmp_path / "a.py"))) == [("a.py", "import b\nimport c\n")]
    assert rows(sources.tree(spark, str(tmp_path / "note.txt"))) == []
    assert rows(store.binary(spark, str(tmp_path))) == [("a.py", "import b\nimport c\n"), ("build.py", "yes")]


def test_git(spark, tmp_path):
    put(tmp_path, FILES)
    git(tmp_path, "init", "-q")
    git(tmp_path, "add", "-A", "-f")
    git(tmp_path, "commit", "-qm", "one")
    found = dict(rows(sources.git_ref(spark, str(tmp_path), "HEAD")))
    assert found["a.py"] == "﻿import b\nimport c\n" and found["bad.py"] == "��" and "node_modules/i.js" in found and "note.txt" not in found
    with pytest.raises(Exception, match="(?i)not a valid object|unknown"):
        sources.git_ref(spark, str(tmp_path), "nothing").collect()


def test_diff(spark, tmp_path, capsys):
    put(tmp_path, {"a.py": "from b import fn\n", "b.py": "fn = 1\n"})
    git(tmp_path, "init", "-q")
    git(tmp_path, "add", "-A")
    git(tmp_path, "commit", "-qm", "base")
    put(tmp_path, {"b.py": "import a\n", "c.py": "import a\n"})
    git(tmp_path, "add", "-A")
    git(tmp_path, "commit", "-qm", "head")
    deltas, added, removed = report.compare(spark, str(tmp_path), "HEAD~1", "HEAD")
    row = deltas.first().asDict()
    assert [tuple(r) for r in added.collect()] == [("b.py", "a.py"), ("c.py", "a.py")] and removed.collect() == []
    assert (row["edges_delta"], row["base_cycles"], row["head_cycles"], row["cycles_delta"]) == (2, 0, 1, 1)
    assert (row["base_average_score"], row["head_average_score"], row["complexity_delta_percent"]) == (0.5, 1.0, 100.0)
    assert cli.diff_text(row).splitlines() == ["Comparing HEAD~1 -> HEAD", "+2 dependencies", "+1 circular dependencies", "complexity +100.00%", "+0 layer violations", "+0 god modules", "+0 dependency explosions"]
    assert cli.main(["diff", "HEAD~1", "HEAD", "--repo", str(tmp_path), "--json"]) == 0
    assert json.loads(capsys.readouterr().out)["edges"]["delta"] == 2
    assert cli.main(["diff", "HEAD~1", "gone", "--repo", str(tmp_path)]) == 1


def test_sample(spark, tmp_path):
    put(tmp_path, {f"{x}.py": f"﻿{t}\n" for x, t in (("a", "import b"), ("b", "import c"), ("c", "value = 1"))})
    r = export.collected(report.of_project(spark, str(tmp_path)), str(tmp_path))
    assert r["simple"]["edges"] == [["a.py", "b.py"], ["b.py", "c.py"]] and r["cycles"] == []


def test_cli(spark, tmp_path, capsys):
    put(tmp_path, {"p/server.py": "import requests\nfrom .auth import token\n", "p/auth.py": "token = 1\n"})
    out, mmd = tmp_path / "o/g.json", tmp_path / "o/g.mmd"
    assert cli.main(["analyze", str(tmp_path / "p"), "--format", "both", "--out", str(out), "--out-mermaid", str(mmd)]) == 0
    text = capsys.readouterr().out
    assert "[ok] 2 files analyzed" in text and "[ok] 2 dependencies detected" in text and out.exists() and "file_server_py --> pkg_requests" in mmd.read_text()
    out.unlink()
    assert cli.main(["analyze", str(tmp_path / "p"), "--format", "mermaid", "--out", str(out), "--out-mermaid", str(mmd)]) == 0
    assert not out.exists()
    assert cli.main([]) == 0 and cli.main(["version"]) == 0
