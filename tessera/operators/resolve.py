"""Import entries to dependencies: ordered candidates, an equi-join with the project's files, the first match.

Every entry becomes one or more targets. A target has an array of candidate ids, tried in order, and perhaps a package
that stands when no candidate is a file. Candidates are exploded with their position and joined with the file ids; the
package is one more candidate at the end that needs no file. The smallest position wins.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import paths
from tessera.schemas import JS_SUFFIXES

_LAST = 1 << 20


def _empty() -> Column:
    return F.array().cast("array<string>")


def _some(path: Column, candidates: Callable[[Column], Column]) -> Column:
    return paths.let(path, lambda p: F.when(p == "", _empty()).otherwise(candidates(p)))


def js_candidates(base: Column) -> Column:
    """The id itself; without a suffix also with each known suffix, and as a directory's index file."""

    def body(base: Column) -> Column:
        tails = F.array(*(F.lit(t) for t in [*JS_SUFFIXES, *(f"/index{s}" for s in JS_SUFFIXES)]))
        tried = F.transform(tails, lambda t: paths.normalize(F.concat(base, t)))
        return F.concat(F.array(base), F.when(paths.suffix(base) != "", _empty()).otherwise(tried))

    return paths.let(paths.normalize(base), body)


def module_candidates(base: Column, direct: str, nested: str) -> Column:
    return F.transform(F.array(F.lit(direct), F.lit(nested)), lambda t: paths.normalize(F.concat(base, t)))


def python_candidates(base: Column) -> Column:
    return module_candidates(base, ".py", "/__init__.py")


def rust_candidates(base: Column) -> Column:
    return module_candidates(base, ".rs", "/mod.rs")


def ancestor(path: Column, hops: Column) -> Column:
    """A directory so many levels up; "." at the root."""
    up = paths.let(paths.segments(path), lambda parts: F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - hops, F.lit(0))), "/"))
    return paths.let(up, lambda p: F.when(p == "", ".").otherwise(p))


def rust_root(file_id: Column) -> Column:
    """The path up to the first part "src", else "."."""
    parts = F.split(file_id, "/")
    at = F.array_position(parts, "src").cast("int")
    return F.when(at > 0, paths.normalize(F.array_join(F.slice(parts, 1, F.greatest(at, F.lit(1))), "/"))).otherwise(".")


def prefixes(base: Column, parts: Column) -> Column:
    """Candidates of all prefixes of the parts below base, the longest first."""

    def body(both: Column) -> Column:
        own, root = both["parts"], both["base"]
        lengths = F.when(F.size(own) > 0, F.sequence(F.size(own), F.lit(1), F.lit(-1))).otherwise(F.array().cast("array<int>"))
        below = F.transform(lengths, lambda n: paths.join(root, F.array_join(F.slice(own, 1, n), "/")))
        return F.flatten(F.transform(F.filter(below, lambda p: p != ""), rust_candidates))

    return paths.let(F.struct(base.alias("base"), parts.alias("parts")), body)


def _js(entries: DataFrame) -> DataFrame:
    spec = F.col("specifier")
    local, rooted = spec.rlike("^[./]"), F.startswith(spec, F.lit("/"))
    base = F.when(rooted, paths.normalize(F.regexp_replace(spec, "^/+", ""))).otherwise(paths.join(paths.parent(F.col("file_id")), spec))
    return entries.select("*", F.when(local, _some(base, js_candidates)).otherwise(_empty()).alias("candidates"), F.when(~local, paths.package_name(spec)).alias("package"), F.lit(0).alias("sub"))


def _python(entries: DataFrame) -> DataFrame:
    spec = F.col("specifier")
    dots = F.length(F.regexp_extract(spec, r"^(\.*)", 1))
    relative = (F.col("kind") == "from") & (dots > 0)
    absolute = paths.normalize(F.replace(spec, F.lit("."), F.lit("/")))
    here = ancestor(paths.parent(F.col("file_id")), dots - 1)
    rest = F.regexp_replace(spec, r"^\.+", "")
    named = F.when(rest != "", F.array(rest)).otherwise(F.filter("names", lambda n: n != "*"))
    below = F.transform(named, lambda n: paths.join(here, F.replace(n, F.lit("."), F.lit("/"))))
    targets = F.when(relative, F.transform(below, lambda p: _some(p, python_candidates))).otherwise(F.array(python_candidates(absolute)))
    rows = entries.select("*", F.when(~relative, paths.package_name(spec)).alias("package"), F.posexplode(targets).alias("sub", "candidates"))
    return rows.select(*entries.columns, "candidates", "package", "sub")


def _rust(entries: DataFrame) -> DataFrame:
    kind, spec, here = F.col("kind"), F.col("specifier"), paths.parent(F.col("file_id"))
    parts = F.filter(F.split(spec, "::"), lambda p: p != "")
    head = lambda word: F.startswith(spec, F.lit(f"{word}::"))
    after = F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))
    supers = F.size(F.split(F.regexp_extract(spec, "^((?:super::+)*(?:super$)?)", 1), "super")) - 1
    left = F.slice(parts, supers + 1, F.greatest(F.size(parts) - supers, F.lit(0)))
    sibling = paths.join(here, spec)
    candidates = (
        F.when(kind == "mod", _some(sibling, rust_candidates))
        .when(kind == "extern", _empty())
        .when(head("crate"), prefixes(rust_root(F.col("file_id")), after))
        .when(head("self"), prefixes(here, after))
        .when(head("super"), prefixes(ancestor(here, supers), left))
        .otherwise(prefixes(rust_root(F.col("file_id")), parts))
    )
    plain = (kind == "use") & ~head("crate") & ~head("self") & ~head("super")
    package = F.when(kind == "extern", spec).when(plain, F.get(parts, F.lit(0)))
    return entries.select("*", candidates.alias("candidates"), package.alias("package"), F.lit(0).alias("sub"))


def targets(entries: DataFrame) -> DataFrame:
    """Entries (extract's rows) to targets: snapshot_id, source, pos, sub, candidates, package."""
    of = lambda *names: entries.filter(F.col("language").isin(*names))
    rows = _js(of("javascript", "typescript")).unionByName(_python(of("python"))).unionByName(_rust(of("rust")))
    return rows.select("snapshot_id", F.col("file_id").alias("source"), "pos", "sub", "candidates", "package")


def resolve(entries: DataFrame, files: DataFrame) -> DataFrame:
    """Dependencies (snapshot_id, source, id, label, type, ord) of import entries; each id of a source once, in its first place."""
    found = targets(entries)
    keys = ["snapshot_id", "source", "pos", "sub"]
    tried = found.select(*keys, F.posexplode("candidates").alias("at", "id"))
    there = files.select("snapshot_id", F.col("file_id").alias("id")).distinct()
    matched = tried.join(there, ["snapshot_id", "id"]).select(*keys, "at", "id", F.col("id").alias("label"), F.lit("file").alias("type"))
    name = paths.strip(F.col("package"))
    external = found.filter("package IS NOT NULL AND package <> ''").select(*keys, F.lit(_LAST).alias("at"), F.concat(F.lit("pkg:"), name).alias("id"), name.alias("label"), F.lit("package").alias("type"))
    first = matched.unionByName(external).groupBy(*keys).agg(F.min_by(F.struct("id", "label", "type"), "at").alias("d"))
    place = F.min(F.col("pos").cast("long") * 100_000 + F.col("sub")).alias("ord")
    return first.groupBy("snapshot_id", "source", F.col("d.id").alias("id")).agg(F.first("d.label").alias("label"), F.first("d.type").alias("type"), place)
