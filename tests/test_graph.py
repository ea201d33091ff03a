import json
import random
import urllib.error
import urllib.request
from threading import Thread

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import numbers
from tessera.operators import components, graph, risks, views
from tessera.operators.sieve import sieve
from tessera.plans import fixture, report
from tessera.sinks import export, web

DEPS = "snapshot_id string, source string, id string, label string, type string, ord long"


def small(spark):
    files = spark.createDataFrame([("s", f, "python") for f in ("a.py", "b.py", "c.py", "alone.py")], "snapshot_id string, file_id string, language string")
    deps = [("s", "a.py", "b.py", "b.py", "file", 0), ("s", "a.py", "pkg:requests", "requests", "package", 1), ("s", "b.py", "a.py", "a.py", "file", 0), ("s", "c.py", "a.py", "a.py", "file", 0)]
    return report.of_graph(files, spark.createDataFrame(deps, DEPS))


def test_report(spark, tmp_path):
    found = small(spark)
    r = export.collected(found, "/p")
    m = r["metrics"]
    assert (m["filesAnalyzed"], m["totalDependencies"], m["externalDependencies"], m["circularDependencyCount"]) == (4, 4, 1, 1)
    assert r["cycles"] == [["a.py", "b.py"]]
    assert [(c["file"], c["imports"], c["score"]) for c in m["complexity"]] == [("a.py", 2, 1.0), ("b.py", 1, 0.5), ("c.py", 1, 0.5), ("alone.py", 0, 0.0)]
    assert m["criticalFiles"][0] == {"file": "a.py", "dependents": 2}
    assert [(x["file"], x["riskScore"], x["signals"]) for x in r["risks"]["top_risk_files"]] == [("a.py", 16, ["circular_dependency"]), ("b.py", 13, ["circular_dependency"]), ("c.py", 1, [])]
    assert r["risks"]["thresholds"] == {"god_module_min_outgoing": 8, "dependency_explosion_min_connections": 12}
    assert [n["id"] for n in r["nodes"]] == ["a.py", "alone.py", "b.py", "c.py", "pkg:requests"]
    assert r["nodes"][-1] | {} == {"id": "pkg:requests", "label": "requests", "type": "package", "language": "package", "folder": "(external)", "outgoing": 0, "incoming": 1, "isCircular": False, "complexityImports": 0, "complexityScore": 0.0}
    assert [(e["id"], e["isCircular"]) for e in r["edges"]] == [("a.py->b.py", True), ("a.py->pkg:requests", False), ("b.py->a.py", True), ("c.py->a.py", False)]
    body = json.loads(export.write_json(r, tmp_path / "deep/g.json").read_text())
    assert body["nodes"][0] == "a.py" and ["a.py", "b.py"] in body["edges"] and body["detailed"]["nodes"][0]["id"] == "a.py"
    assert json.loads(export.write_cytoscape(r, tmp_path / "c.json").read_text())["nodes"][0]["data"]["id"] == "a.py"
    text = export.write_mermaid(found.nodes, found.edges, tmp_path / "g.mmd").read_text()
    assert text.startswith("graph TD\n  file_a_py[a.py]\n") and "  pkg_requests[requests]\n" in text and text.endswith("  file_c_py --> file_a_py\n")
    export.tables(found, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t/metrics")).first().files_analyzed == 4
    found.views("v_")
    assert spark.sql("SELECT count(*) FROM v_nodes WHERE is_circular").first()[0] == 2


def test_server(spark):
    with web.server({"x": 1}, 0) as http:
        Thread(target=http.serve_forever, daemon=True).start()
        get = lambda p: urllib.request.urlopen(f"http://127.0.0.1:{http.server_address[1]}{p}", timeout=10).read()
        assert json.loads(get("/api/graph")) == {"x": 1} and get("/api/health") == b'{"status":"ok"}' and b"Dependency graph" in get("/")
        assert b"/api/graph" in get("/page.js?x=1") and b"canvas" in get("/page.css") and http.server_address[0] == "127.0.0.1"
        for path in ("/nothing", "/../web.py", "/page.js/"):
            with pytest.raises(urllib.error.HTTPError) as refused:
                get(path)
            assert refused.value.code == 404
        http.shutdown()


def test_numbered(spark):
    """Lines are numbered over range partitions as over the whole snapshot."""
    rows = [(f"s{i % 3}", f"n{i * 7919 % 1000:03}", i) for i in range(1000)]
    found = export.numbered(spark.createDataFrame(rows, "snapshot_id string, id string, i int").repartition(5), [F.col("id")]).collect()
    for name in ("s0", "s1", "s2"):
        own = sorted((r.line_no, r.id) for r in found if r.snapshot_id == name)
        assert [n for n, _ in own] == list(range(1, len(own) + 1)) and [i for _, i in own] == sorted(i for s, i, _ in rows if s == name)


def brute(edges):
    nodes = {x for e in edges for x in e}
    reach = {n: {n} for n in nodes}
    out = {}
    for a in nodes:
        seen, todo = set(), [a]
        while todo:
            for u, v in edges:
                if u == todo[-1] and v not in seen:
                    seen.add(v)
                    todo.insert(0, v)
            todo.pop()
        reach[a] = seen
    for a in nodes:
        own = {b for b in reach[a] if a in reach[b]}
        if a in own:
            out[a] = min(own)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    rng = random.Random(seed)
    graphs = {"p": [(rng.randrange(30), rng.randrange(30)) for _ in range(45)], "q": [(i, (i + 1) % 25) for i in range(25)] + [(40 + i, 41 + i) for i in range(20)] + [(99, 99)], "r": [(1, 2), (2, 3)]}
    rows = [(s, f"n{u:02}", f"n{v:02}") for s, edges in graphs.items() for u, v in edges]
    df = spark.createDataFrame(rows, "snapshot_id string, source string, target string")
    expected = sorted((s, r, f) for s, edges in graphs.items() for f, r in brute([(f"n{u:02}", f"n{v:02}") for u, v in edges]).items())
    for found in (components.strong_components(df), components.coloured(df), components.strong_components(df, one_task=10)):
        assert sorted((r.snapshot_id, r.cycle_root, r.file_id) for r in found.collect()) == expected
    assert components.strong_components(df.limit(0)).collect() == []


def test_percentile(spark):
    for n in (1, 2, 6, 7, 26, 46):
        rows = spark.createDataFrame([("g", v) for v in range(n)], "g string, v long")
        for q in (0.0, 0.5, 0.9, 1.0):
            assert numbers.nearest_rank(rows, "g", "v", q, "p").first().p == (0 if q <= 0 else n - 1 if q >= 1 else int(round((n - 1) * q)))


def test_layers(spark):
    deps = [("s", a, b, b, "file", 0) for a, b in (("utils/a.py", "cli/b.py"), ("cli/a.py", "api/b.py"), ("core/a.py", "cli/b.py"), ("cli/b.py", "utils/a.py"), ("misc/a.py", "cli/b.py"), ("core/a.py", "core/z.py"))]
    files = spark.createDataFrame([("s", f, "python") for f in sorted({d[1] for d in deps})], "snapshot_id string, file_id string, language string")
    df = spark.createDataFrame(deps, DEPS)
    node, edge = graph.nodes(files, df), graph.edges(df)
    found = risks.violations(edge, node).orderBy("id").collect()
    assert [(r.source, r.target, r.source_layer, r.target_layer) for r in found] == [("core/a.py", "cli/b.py", "core", "cli"), ("utils/a.py", "cli/b.py", "utils", "cli")]
    other = risks.violations(edge, node, {"misc": 1, "cli": 2})
    assert [r.source for r in other.collect()] == ["misc/a.py"]


def test_views(spark):
    r = small(spark)
    ids = lambda pair: (sorted(x.id for x in pair[0].collect()), sorted(x.id for x in pair[1].collect()))
    assert ids(views.visible(r.nodes, r.edges, cycles_only=True)) == (["a.py", "b.py"], ["a.py->b.py", "b.py->a.py"])
    assert ids(views.visible(r.nodes, r.edges, term="B.")) == (["b.py"], [])
    assert ids(views.visible(r.nodes, r.edges, folder="."))[0] == ["a.py", "alone.py", "b.py", "c.py", "pkg:requests"]
    assert ids(views.visible(r.nodes, r.edges, folder="none"))[0] == []
    assert sorted(x.id for x in views.neighbourhood(r.edges, "a.py").collect()) == ["a.py", "b.py", "c.py", "pkg:requests"]
    assert [x.folder for x in views.folders(r.nodes).collect()] == ["."]
    colours = spark.createDataFrame([(0.0,), (0.5,), (1.0,), (0.25,), (7.0,)], "s double").select(views.heat_colour(F.col("s")).alias("c"))
    assert [x.c for x in colours.collect()] == ["rgb(71, 181, 111)", "rgb(242, 191, 67)", "rgb(221, 77, 83)", "rgb(157, 186, 89)", "rgb(221, 77, 83)"]


def test_empty(spark):
    files = spark.createDataFrame([], "snapshot_id string, file_id string, language string")
    found = report.of_graph(files, spark.createDataFrame([], DEPS))
    r = export.collected(found, "/p")
    assert r["nodes"] == [] and r["metrics"]["filesAnalyzed"] == 0 and r["risks"]["top_risk_files"] == []


def refused(*_, **__):
    raise AssertionError("not needed here")


def rings(spark, n, size=5):
    """n rings of some nodes and a tail in a graph larger than one task takes; edges and the members they should give."""
    rows = [("s", f"n{i:03}_{j}", f"n{i:03}_{(j + 1) % size}") for i in range(n) for j in range(size)] + [("s", f"n{i:03}_0", f"tail{i}") for i in range(n)]
    return spark.createDataFrame(rows + rows[:3], "snapshot_id string, source string, target string"), sorted((f"n{i:03}_0", f"n{i:03}_{j}") for i in range(n) for j in range(size))


def test_many_small_components(spark, monkeypatch):
    """A graph larger than a task is dealt out by weak components; only one that is itself too large is coloured."""
    monkeypatch.setattr(components, "coloured", refused)
    edge, expected = rings(spark, 40)
    assert sorted((r.cycle_root, r.file_id) for r in components.strong_components(edge, one_task=20).collect()) == expected
    chain = [("s", f"n{i:03}", f"n{i + 1:03}") for i in range(50)] + [("s", "n050", "n050"), ("s", "n000", "n000"), ("t", "a", "a")]
    found = components.strong_components(spark.createDataFrame(chain, edge.schema), one_task=60).collect()
    assert sorted((r.snapshot_id, r.cycle_root, r.file_id) for r in found) == [("s", "n000", "n000"), ("s", "n050", "n050"), ("t", "a", "a")]


def test_weak_in_one_task(spark, monkeypatch):
    """What trimming leaves is dealt out without joins where one task holds its hashes, and by joins otherwise; with the same rows."""
    edge, expected = rings(spark, 12)
    members = lambda: sorted((r.cycle_root, r.file_id) for r in components.strong_components(edge, one_task=20).collect())
    with monkeypatch.context() as patch:
        patch.setattr(components, "_weak", refused)
        assert members() == expected
    monkeypatch.setattr(components, "HELD", 0)
    assert members() == expected


def test_weak(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(i, i + 1) for i in range(1000, 1100)]
    root = {x: x for e in edges for x in e}
    for _ in root:
        for u, v in edges:
            root[u] = root[v] = min(root[u], root[v])
    found = {r.x: r.r for r in components._weak(spark.createDataFrame(edges, "hu long, hv long")).collect()}
    assert found == {x: r for x, r in root.items() if x != r}


def test_only_files(spark):
    files = spark.createDataFrame([("s", "a", "python"), ("s", "b", "python")], "snapshot_id string, file_id string, language string")
    deps = spark.createDataFrame([("s", "a", "b", "b", "file", 0), ("s", "a", "c", "c", "file", 0), ("s", "a", "pkg:d", "d", "package", 0), ("s", "x", "b", "b", "file", 0)], DEPS)
    edge = graph.edges(deps)
    ids = lambda df: sorted(r.id for r in df.collect())
    assert ids(graph.only_files(edge, files, deps)) == ids(graph.between_files(edge, graph.nodes(files, deps))) == ["a->b", "a->c"]


def test_sieve(spark):
    """What matches passes; of the rest little does, and rows come once however often a hash is wanted."""
    rows = spark.range(2000).withColumn("h", F.xxhash64("id"))
    wanted = rows.filter("id % 10 = 0").select("h")
    found = [r.id for r in sieve(rows, F.col("h"), wanted.unionByName(wanted)).select("id").collect()]
    assert {*range(0, 2000, 10)} <= {*found} and len(found) == len({*found}) < 250
    assert sieve(rows, F.col("h"), wanted.limit(0)).count() == 0


def test_cycles_alone(spark, monkeypatch):
    """Cycles and circular edges are found without nodes, thresholds or marked tables of all edges."""
    for where, name in ((graph, "nodes"), (graph, "annotate_nodes"), (graph, "annotate_edges"), (risks, "thresholds")):
        monkeypatch.setattr(where, name, refused)
    found = small(spark)
    assert [r.members for r in found.cycles.collect()] == [["a.py", "b.py"]]
    assert sorted(r.id for r in found.circular_edges.collect()) == ["a.py->b.py", "b.py->a.py"]


def test_tally(spark):
    """One aggregation gives the types and degrees that nodes() gives; ends that are no nodes have no type."""
    files = spark.createDataFrame([("s", f, "python") for f in ("a", "b", "a", "alone", "d")], "snapshot_id string, file_id string, language string")
    deps = [("s", "a", "b", "b", "file", 0), ("s", "a", "b", "b", "file", 3), ("s", "a", "c", "c", "file", 1), ("s", "x", "b", "b", "file", 0), ("s", "b", "p", "p", "package", 0), ("s", "b", "d", "d", "package", 1)]
    # the first dependency by source decides what an unread end is
    deps += [("s", "a", "m", "m", "package", 5), ("s", "b", "m", "m", "file", 0), ("s", "a", "k", "k", "file", 6), ("s", "b", "k", "k", "package", 2)]
    deps = spark.createDataFrame(deps, DEPS)
    node = graph.nodes(files.distinct(), deps)
    expected = {(r.id, r.type, r.outgoing, r.incoming) for r in node.collect()} | {("x", None, 1, 0)}
    found = graph.tally(files, deps, graph.flagged(deps))
    rows = [(r.id, r.type, r.outgoing, r.incoming) for r in found.collect()]
    assert len(rows) == len(expected) and {*rows} == expected
    edge = graph.edges(deps)
    ids = lambda df: sorted(r.id for r in df.collect())
    assert ids(graph.without_others(edge, found)) == ids(graph.between_files(edge, node))


def test_scores_without_named_nodes(spark, monkeypatch):
    """Scores, their ranking and the comparison need types and degrees, not nodes with labels, languages and folders."""
    monkeypatch.setattr(graph, "nodes", refused)
    found = small(spark)
    assert [(r.file, r.risk_score) for r in found.top_risks.orderBy("place").collect()] == [("a.py", 16), ("b.py", 13), ("c.py", 1)]
    assert found.deltas("none", "s").first().head_top_risks == 3


def test_top_risks(spark):
    """The threshold keeps all ties of the last place, which go by name."""
    scored = spark.createDataFrame([("s", f"f{i:02}", score) for i, score in enumerate([5, 1, 9, 5, 5, 1, 5])] + [("t", "f", 2)], "snapshot_id string, file string, risk_score long")
    rows = sorted((r.snapshot_id, r.place, r.file) for r in risks.top_risks(scored, 3).collect())
    assert rows == [("s", 1, "f02"), ("s", 2, "f00"), ("s", 3, "f03"), ("t", 1, "f")]


def test_risks_alone(spark, monkeypatch):
    """Scores and the comparison of snapshots need no marked tables of nodes and edges."""
    for name in ("annotate_nodes", "annotate_edges"):
        monkeypatch.setattr(graph, name, refused)
    found = small(spark)
    assert [(r.file, r.risk_score) for r in found.top_risks.orderBy("place").collect()] == [("a.py", 16), ("b.py", 13), ("c.py", 1)]
    row = found.deltas("none", "s").first()
    assert (row.edges_added, row.edges_removed, row.base_cycles, row.head_cycles, row.base_top_risks, row.head_top_risks, row.head_average_score) == (4, 0, 0, 1, 0, 3, 0.5)


def test_deltas(spark, monkeypatch):
    """Both snapshots are compared from one aggregation over both, with the counts that each one's own frames give."""
    rng = random.Random(5)
    layers = ("core/", "utils/", "cli/", "")
    name = lambda i: f"{layers[i % 4]}f{i}.py"
    files = [(s, name(i), "python") for s in "ab" for i in range(60) for _ in range(1 + i % 2) if i % 7 or s == "a"]
    deps = [(s, name(rng.randrange(70)), name(min(rng.randrange(75), rng.randrange(75))), "x", rng.choice(["file"] * 9 + ["package"]), i) for s in "aabc" for i in range(140)]
    deps += [("b", name(1), name(i), "x", "file", i) for i in range(40)] + [("b", "pkg:only", "pkg:p", "p", "package", 1)]
    files, deps = spark.createDataFrame(files, "snapshot_id string, file_id string, language string"), spark.createDataFrame(deps + deps[:9], DEPS)
    found = report.of_graph(files, deps)
    of = lambda df, s: [r for r in df.collect() if r.snapshot_id == s]
    assert {"both", None} & {r.type for r in graph.tally(files, deps, graph.flagged(deps)).collect()} == {None}
    assert {(r.source, r.id) for r in deps.collect() if r.type == "file"} & {(r.source, r.id) for r in deps.collect() if r.type == "package"}
    expected = {}
    for s in "ab":
        scores = [r.score for r in of(found.complexity, s)]
        expected[s] = (
            {(r.source, r.target) for r in of(found.links, s)}, len({r.cycle_root for r in of(found.members, s)}), round(sum(scores) / len(scores), 6), min(15, len(of(found.scores, s))),
            len(of(found.broken, s)), len(of(found.gods, s)), len(of(found.explosions, s)),
        )
    monkeypatch.setattr(graph, "tally", refused)
    for base, head in ("ab", "ba", "aa"):
        b, h = expected[base], expected[head]
        row = report.of_graph(files, deps).deltas(base, head).first()
        assert (row.base_ref, row.head_ref, row.edges_added, row.edges_removed) == (base, head, len(h[0] - b[0]), len(b[0] - h[0]))
        assert (row.base_cycles, row.head_cycles, row.base_average_score, row.head_average_score, row.base_top_risks, row.head_top_risks) == (b[1], h[1], b[2], h[2], b[3], h[3])
        assert (row.layer_violations_delta, row.god_modules_delta, row.dependency_explosions_delta) == tuple(y - x for x, y in zip(b[4:], h[4:], strict=True))
    assert expected["a"][1] and expected["b"][4] and expected["b"][5]


def test_both_orders(spark):
    """The two graphs that are made side by side are those made one by one."""
    pair = fixture.both(spark, "/root/testdata/sf0.001")
    rows = pair.edge.select(pair.named(F.col("source")).alias("s"), pair.named(F.col("target")).alias("t"), "base", "head").collect()
    for side in ("base", "head"):
        one = sorted((r.source, r.id) for r in fixture.project(spark, "/root/testdata/sf0.001", snapshot=side)[1].distinct().collect())
        assert sorted((r.s, r.t) for r in rows if r[side]) == [*dict.fromkeys(one)]


def test_trimming_bits(spark, monkeypatch):
    """Ends that share the bits by which trimming looks them up change no component."""
    monkeypatch.setattr(components, "_SEEN", 1)
    a = np.array([5, -1, 1 << 62, 7], np.int64)
    assert components._seen(a, a[:1]).tolist() == [True, False, True, True] and not components._seen(a, a[:0]).any() and len(components._distinct(a[:0])) == 0
    edge, expected = rings(spark, 12)
    assert sorted((r.cycle_root, r.file_id) for r in components.strong_components(edge, one_task=20).collect()) == expected
