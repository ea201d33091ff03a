"""File ids and paths as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.schemas import EXTENSIONS, IGNORED

#: Blanks in the wide sense of Unicode, at both ends.
_ENDS = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once, and once in the plan, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, _ENDS, "")


def _strings(*values: str) -> Column:
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def segments(path: Column) -> Column:
    """The parts of a path without empty ones and single dots."""
    return F.filter(F.split(path, "/"), lambda p: ~p.isin("", "."))


def normalize(file_id: Column) -> Column:
    """Forward slashes, no empty parts, no single dots; the empty path is "."; parent dots stay; leading slashes stay (two or one)."""

    def body(slashed: Column) -> Column:
        root = F.when(slashed.rlike("^//(?!/)"), "//").when(F.startswith(slashed, F.lit("/")), "/").otherwise("")
        return let(F.concat(root, F.array_join(segments(slashed), "/")), lambda joined: F.when(joined == "", ".").otherwise(joined))

    return let(F.replace(file_id, F.lit("\\"), F.lit("/")), body)


def collapse(parts: Column) -> Column:
    """Parts with ".." resolved; leading ones stay."""
    start = F.array().cast("array<string>")
    up = lambda a, p: (p == "..") & (F.size(a) > 0) & (F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit("")) != "..")
    return F.aggregate(parts, start, lambda a, p: F.when(up(a, p), F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(p))))


def join(*pieces: Column) -> Column:
    """The pieces joined and collapsed as one path: "." if empty, "" if it leaves the root."""

    def body(text: Column) -> Column:
        rooted = F.startswith(text, F.lit("/"))
        head = F.when(text.rlike("^//(?!/)"), "//").otherwise("/")
        plain = lambda parts: F.when(F.size(parts) == 0, ".").when(F.get(parts, F.lit(0)) == "..", "").otherwise(F.array_join(parts, "/"))
        return let(collapse(segments(text)), lambda parts: F.when(rooted, F.concat(head, F.array_join(F.filter(parts, lambda p: p != ".."), "/"))).otherwise(plain(parts)))

    return let(F.array_join(F.filter(F.array(*pieces), lambda p: ~p.isin("", ".")), "/"), body)


def parent(path: Column) -> Column:
    """The directory of a path; "." at the root."""
    return F.when(F.instr(path, "/") == 0, ".").otherwise(normalize(F.regexp_replace(path, "[^/]*$", "")))


def suffix(path: Column) -> Column:
    """From the last dot of the last part on, "" where that dot is the first or the last character."""
    name = F.substring_index(F.regexp_replace(path, "/+$", ""), "/", -1)
    return F.regexp_extract(name, r"^.+(\.[^.]+)$", 1)


def language(file_id: Column) -> Column:
    """Language by suffix, in any case; null for others."""
    table = F.create_map(*(F.lit(x) for pair in EXTENSIONS.items() for x in pair))
    return table[F.lower(suffix(file_id))]


def ignored(path: Column) -> Column:
    return F.arrays_overlap(F.split(path, "/"), _strings(*IGNORED))


def first_segment(file_id: Column) -> Column:
    """The first part of a path with several, else "."."""
    first = lambda path: F.when(F.instr(path, "/") > 0, F.substring_index(path, "/", 1)).otherwise(".")
    odd = F.endswith(file_id, F.lit("/"))
    for text in ("\\", "//", "/.", "./"):
        odd = odd | F.contains(file_id, F.lit(text))
    return F.when(~odd, first(file_id)).otherwise(let(normalize(file_id), first))


def package_name(specifier: Column) -> Column:
    """@scope/name, or what stands before the first slash."""
    scoped = F.startswith(specifier, F.lit("@"))
    return F.when(specifier == "", None).when(scoped, F.substring_index(specifier, "/", 2)).otherwise(F.substring_index(specifier, "/", 1))


def relative(root: str, path: Column) -> Column:
    """A path's id below root; a root that is the file itself gives its name."""
    base = root.rstrip("/")
    inside = F.substring(path, F.lit(len(base) + 2), F.length(path))
    return F.when(path == base, F.substring_index(path, "/", -1)).otherwise(normalize(inside))
