"""Identifier normalisation as column expressions."""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

ColumnLike = Column | str


def _c(value: ColumnLike) -> Column:
    return F.col(value) if isinstance(value, str) else value


def _squeezed(text: Column) -> Column:
    """Other characters than a-z, 0-9, - and _ become _, runs of _ shrink, ends are cut."""
    text = F.regexp_replace(F.regexp_replace(text, r"[^a-z0-9\-_]", "_"), "__+", "_")
    return F.btrim(text, F.lit("_"))


def _tag(text: Column) -> Column:
    return F.substring(F.md5(text), 1, 6)


@F.pandas_udf(StringType())
def html_unescape(texts: pd.Series) -> pd.Series:
    """Entity decoding, for which Spark has no builtin."""
    return texts.map(html.unescape, na_action="ignore")


def normalize_identifier(raw: ColumnLike, unescape: bool = False) -> Column:
    """Article identifier: readable part of at most 193 characters and a tag of the canonical form."""
    text = html_unescape(_c(raw)) if unescape else _c(raw)
    canonical = F.replace(F.trim(F.lower(text)), F.lit(" "), F.lit("_"))
    return F.concat(F.substring(_squeezed(canonical), 1, 193), F.lit("_"), _tag(canonical))


def normalize_repository(name: ColumnLike) -> Column:
    """Repository identifier; the tag is that of the cleaned name."""
    clean = _squeezed(F.lower(F.translate(_c(name), "/-", "__")))
    return F.concat(clean, F.lit("_"), _tag(clean))


def normalize_package(name: ColumnLike) -> Column:
    clean = _squeezed(F.lower(F.replace(_c(name), F.lit("."), F.lit("_"))))
    return F.concat(clean, F.lit("_"), _tag(clean))


def generation_identifier(raw: ColumnLike) -> Column:
    """The generation side's identifier: odd characters are removed rather than replaced and
    the tag is that of the raw string, so it differs from ``normalize_identifier``."""
    text = F.replace(F.trim(F.lower(_c(raw))), F.lit(" "), F.lit("_"))
    clean = F.btrim(F.regexp_replace(F.regexp_replace(text, r"[^a-z0-9_]", ""), "_+", "_"), F.lit("_"))
    return F.concat(F.substring(clean, 1, 193), F.lit("_"), _tag(_c(raw)))


def strip_hash(identifier: ColumnLike) -> Column:
    return F.regexp_replace(_c(identifier), "_[0-9a-f]{6}$", "")


def hash_matches(identifier: ColumnLike, raw: ColumnLike) -> Column:
    return _c(identifier) == generation_identifier(raw)


def raw_link_target(raw: ColumnLike, unescape: bool = False) -> Column:
    return F.trim(html_unescape(_c(raw)) if unescape else _c(raw))


def module_of_path(path: ColumnLike) -> Column:
    """Dotted module name of a repository path."""
    bare = F.regexp_replace(_c(path), r"\.py$", "")
    return F.btrim(F.translate(bare, "/\\", ".."), F.lit("."))


def extension(path: ColumnLike) -> Column:
    """Lower-cased extension with its dot, or ``<none>``."""
    found = F.lower(F.regexp_extract(_c(path), r"[^/.][^/]*?(\.[^./]+)$", 1))
    return F.when(found != "", found).otherwise("<none>")


def is_test_path(path: ColumnLike) -> Column:
    low = F.lower(_c(path))
    return F.regexp_like(low, F.lit(r"(^|/)tests?/|(^|/)test_[^/]*$|_test\.py$"))


def is_python_file(path: ColumnLike) -> Column:
    return F.endswith(_c(path), F.lit(".py")) | F.endswith(_c(path), F.lit(".pyw"))


def is_likely_code_file(path: ColumnLike) -> Column:
    name = F.regexp_extract(_c(path), r"([^/]*)$", 1)
    return is_python_file(path) | F.endswith(_c(path), F.lit(".ipynb")) | name.isin("setup.py", "requirements.txt", "pyproject.toml", "setup.cfg", "__init__.py")


def span_key(raw: ColumnLike, style: str = "markdown") -> Column:
    """Index key of a document span: the raw identifier, or for code the path after ``repo:``."""
    if style == "markdown":
        return _c(raw)
    tail = F.regexp_extract(_c(raw), r"(?s)^[^:]*:(.*)$", 1)
    return F.when(F.contains(_c(raw), F.lit(":")), tail).otherwise(_c(raw))


def det_hash32(text: ColumnLike) -> Column:
    """Rolling 32-bit hash h = h * 131 + code point, for stable bucketing."""
    chars = F.filter(F.split(_c(text), ""), lambda c: c != "")
    return F.aggregate(chars, F.lit(0).cast("bigint"), lambda h, c: (h * 131 + F.ascii(c)).bitwiseAND(F.lit(0xFFFFFFFF)))


def python_normalize_identifier(raw: str) -> str:
    """The same as ``normalize_identifier`` for code that already runs in Python."""
    import hashlib

    canonical = html.unescape(raw).lower().strip().replace(" ", "_")
    clean = re.sub("__+", "_", re.sub(r"[^a-z0-9\-_]", "_", canonical)).strip("_")[:193]
    return f"{clean}_{hashlib.md5(canonical.encode()).hexdigest()[:6]}"
