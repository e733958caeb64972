"""Python imports: extraction from source text and candidate paths."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Modules taken for standard library or external.
EXTERNAL_MODULES = (
    "os", "sys", "json", "re", "math", "datetime", "time", "collections", "itertools", "functools", "typing", "pathlib", "subprocess", "threading", "multiprocessing", "asyncio", "logging",
    "unittest", "pytest", "numpy", "pandas", "matplotlib", "sklearn", "tensorflow", "torch", "django", "flask", "requests", "urllib", "http", "xml", "html", "email", "smtplib",
)

# The statement patterns of the graph builder and of the detector.
GRAPH_FROM = r"(?m)^\s*from\s+([^\s;]+)\s+import"
GRAPH_IMPORT = r"(?m)^\s*import\s+([^\s;]+)"
SIMPLE_IMPORT = r"(?m)^[ \t]*import\s+([\w.]+(?:\s+as\s+\w+)?(?:\s*,\s*[\w.]+(?:\s+as\s+\w+)?)*)[ \t]*(?:#.*)?$"
INLINE_FROM = r"(?m)^[ \t]*from\s+([\w.]+\s+import\s+(?:\*|\w+(?:\s*,\s*\w+)*))[ \t]*(?:#.*)?$"
PAREN_FROM = r"(?m)^[ \t]*from\s+([\w.]+\s+import\s+\([^)]*)\)"

_SIMPLE, _INLINE, _PAREN = re.compile(SIMPLE_IMPORT), re.compile(INLINE_FROM), re.compile(PAREN_FROM)


def is_repository_import(module: Column) -> Column:
    """Relative imports, and absolute ones that name no external module."""
    return F.startswith(module, F.lit(".")) | ~F.substring_index(module, ".", 1).isin(*EXTERNAL_MODULES)


def file_imports(content: Column) -> Column:
    """Distinct imported modules that may be files of the same repository."""
    found = F.array_union(F.regexp_extract_all(content, F.lit("(?d)" + GRAPH_FROM), 1), F.regexp_extract_all(content, F.lit("(?d)" + GRAPH_IMPORT), 1))
    return F.array_distinct(F.filter(F.transform(found, lambda m: F.trim(m)), is_repository_import))


def parsed_imports(content: Column) -> Column:
    """Array of (module, name) of all absolute imports; name is empty for plain imports."""

    def pair(module: Column, name: Column) -> Column:
        return F.struct(module.alias("module"), name.alias("name"))

    simple = F.flatten(F.transform(F.regexp_extract_all(content, F.lit("(?d)" + SIMPLE_IMPORT), 1), lambda s: F.split(s, ",")))
    plain = F.transform(simple, lambda s: pair(F.trim(F.regexp_replace(F.trim(s), r"(?s)\s+as\s.*$", "")), F.lit("")))

    def named(statement: Column, comments: bool) -> Column:
        module = F.regexp_extract(statement, r"^([\w.]+)", 1)
        names = F.regexp_replace(statement, r"(?s)^[\w.]+\s+import\s+\(?", "")
        if comments:
            names = F.regexp_replace(F.regexp_replace(names, r"(?m)#.*$", ""), r"(?m)\\+$", "")
        cleaned = F.filter(F.transform(F.split(names, ","), lambda n: F.trim(F.regexp_replace(n, r"\s+", " "))), lambda n: n != "")
        return F.transform(cleaned, lambda n: pair(module, n))

    inline = F.flatten(F.transform(F.regexp_extract_all(content, F.lit("(?d)" + INLINE_FROM), 1), lambda s: named(s, False)))
    paren = F.flatten(F.transform(F.regexp_extract_all(content, F.lit("(?d)" + PAREN_FROM), 1), lambda s: named(s, True)))
    every = F.concat(plain, inline, paren)
    return F.filter(every, lambda p: (p["module"] != "") & ~F.startswith(p["module"], F.lit(".")))


def candidate_paths(module: Column, name: Column) -> Column:
    """Repository paths a module may stand for, most specific first."""
    base = F.replace(module, F.lit("."), F.lit("/"))
    own = F.array(F.concat(base, F.lit(".py")), F.concat(base, F.lit("/__init__.py")))
    sub = F.array(F.concat(base, F.lit("/"), name, F.lit(".py")), F.concat(base, F.lit("/"), name, F.lit("/__init__.py")))
    return F.when((name != "") & (name != "*"), F.concat(sub, own)).otherwise(own)


def module_paths(module: str, name: str) -> list[str]:
    """``candidate_paths`` of one import, outside a query."""
    base = module.replace(".", "/")
    stems = [f"{base}/{name}", base] if name not in ("", "*") else [base]
    return [stem + ending for stem in stems for ending in (".py", "/__init__.py")]


def statements(text: str) -> Iterator[tuple[str, str, int, int]]:
    """(module, name, start, end) of the absolute imports of a text: plain ones, those on one
    line and those in parentheses, in this order; name is empty for plain ones."""
    for found in _SIMPLE.finditer(text):
        for item in found[1].split(","):
            module = item.strip().split(" as ")[0].strip()
            if module and not module.startswith("."):
                yield module, "", *found.span()
    for pattern, spread in ((_INLINE, False), (_PAREN, True)):
        for found in pattern.finditer(text):
            module, names = re.split(r"\s+import\s+\(?", found[1], maxsplit=1)
            if module.startswith("."):
                continue
            if spread:
                names = " ".join(line.split("#")[0].rstrip("\\") for line in names.split("\n"))
            for name in filter(None, map(str.strip, names.split(","))):
                yield module, name, *found.span()


def import_links(content: Column) -> Column:
    """Source text with the modules of import statements written as Markdown links."""
    statement = re.compile(r"\b(?:from|import)[ \t]+(\w+(?:\.\w+)*)")

    def package_id(name: str) -> str:
        clean = re.sub("__+", "_", re.sub(r"[^a-z0-9\-_]", "_", name.replace(".", "_").lower())).strip("_")
        return f"{clean}_{hashlib.md5(clean.encode()).hexdigest()[:6]}"

    @F.pandas_udf("string")
    def rewrite(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: statement.sub(lambda m: f"[{m[1]}]({package_id(m[1])})", t), na_action="ignore")

    return rewrite(content)
