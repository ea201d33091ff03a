"""Import extraction: regular expressions of four languages as column expressions.

Extraction is lexical: what stands in comments and strings counts. Each function gives an array of structs
(kind, specifier, names) in the order in which imports are resolved; fields that a kind lacks are empty.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.paths import strip

# fixed values: the patterns of import statements
JS_IMPORT = r"""(?U)\b(?:import|export)\s+(?:type\s+)?(?:[^"'()]*?\s+from\s+)?["']([^"']+)["']"""
JS_REQUIRE = r"""(?U)\brequire\(\s*["']([^"']+)["']\s*\)"""
JS_DYNAMIC = r"""(?U)\bimport\(\s*["']([^"']+)["']\s*\)"""
PY_IMPORT = r"(?mdU)^\s*import\s+([^\n#]+)$"
PY_FROM = r"(?mdU)^\s*from\s+([.a-zA-Z0-9_]+)\s+import\s+([^\n#]+)$"
RUST_USE = r"(?mdU)^\s*use\s+([^;]+);"
RUST_MOD = r"(?mdU)^\s*mod\s+([a-zA-Z0-9_]+)\s*;"
RUST_EXTERN = r"(?mdU)^\s*extern\s+crate\s+([a-zA-Z0-9_]+)\s*;"

ENTRY = "array<struct<kind:string,specifier:string,names:array<string>>>"


def _found(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _entry(kind: str, specifier: Column, names: Column | None = None) -> Column:
    none = F.array().cast("array<string>")
    return F.struct(F.lit(kind).alias("kind"), specifier.alias("specifier"), (none if names is None else names).alias("names"))


def _full(values: Column) -> Column:
    return F.filter(values, lambda v: v != "")


def _unaliased(text: Column) -> Column:
    return strip(F.substring_index(strip(text), " as ", 1))


def newlines(text: Column) -> Column:
    """Line ends as line feeds."""
    return F.regexp_replace(text, "\r\n?", "\n")


def js(text: Column) -> Column:
    """Distinct specifiers of import, export-from, require and import(), sorted."""
    every = F.concat(*(_found(text, p) for p in (JS_IMPORT, JS_REQUIRE, JS_DYNAMIC)))
    return F.transform(F.array_sort(F.array_distinct(_full(F.transform(every, strip)))), lambda s: _entry("js", s))


def python(text: Column) -> Column:
    """All import entries, one for each module, then all from entries with their names."""
    text = F.regexp_replace(text, "^\uFEFF+", "")
    listed = lambda part: _full(F.transform(F.split(strip(part), ","), _unaliased))
    modules = F.flatten(F.transform(_found(text, PY_IMPORT), listed))
    froms = F.zip_with(_found(text, PY_FROM, 1), _found(text, PY_FROM, 2), lambda m, names: _entry("from", strip(m), listed(names)))
    return F.concat(F.transform(modules, lambda m: _entry("import", m)), froms)


def use_path(raw: Column) -> Column:
    """A use path without alias, group and wildcard."""
    compact = strip(F.regexp_replace(raw, r"(?U)[\s\x1c-\x1f]+", " "))
    plain = strip(F.regexp_replace(compact, "^pub ", ""))
    whole = strip(F.substring_index(plain, " as ", 1))
    path = strip(F.regexp_replace(whole, r"\{.*\}", ""))
    return strip(F.regexp_replace(strip(F.regexp_replace(path, r"::\*$", "")), "::$", ""))


def rust(text: Column) -> Column:
    """use, then mod, then extern entries."""
    used = F.transform(_full(F.transform(_found(text, RUST_USE), use_path)), lambda p: _entry("use", p))
    return F.concat(used, F.transform(_found(text, RUST_MOD), lambda m: _entry("mod", m)), F.transform(_found(text, RUST_EXTERN), lambda c: _entry("extern", c)))


def by_language(language: Column, text: Column) -> Column:
    none = F.array().cast(ENTRY)
    return F.when(language.isin("javascript", "typescript"), js(text)).when(language == "python", python(text)).when(language == "rust", rust(text)).otherwise(none)
