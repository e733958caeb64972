"""Markdown links in texts and in token sequences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.identifiers import normalize_identifier

# Fixed value: the link pattern of the graph builder (a target ends at the first parenthesis).
LINK = r"\[[^!\]]*?\]\((.*?)\)"


def link_targets(body: Column) -> Column:
    """Targets of all links, percent-decoded (a plus sign stays a plus sign)."""
    found = F.regexp_extract_all(body, F.lit("(?d)" + LINK), 1)
    return F.transform(found, lambda x: F.coalesce(F.try_url_decode(F.replace(x, F.lit("+"), F.lit("%2B"))), x))


def link_identifiers(body: Column) -> Column:
    """Distinct normalised identifiers of the targets, sorted."""
    return F.sort_array(F.array_distinct(F.transform(link_targets(body), lambda t: normalize_identifier(t))))


def display_links(text: Column) -> Column:
    """(label, target) of links whose label and target are at most 80 and 100 characters."""
    found = F.regexp_extract_all(text, F.lit(r"(\[[^\]]{1,80}\]\([^)]{1,100}\))"), 1)
    return F.transform(found, lambda x: F.struct(F.regexp_extract(x, r"^\[([^\]]*)\]", 1).alias("label"), F.regexp_extract(x, r"\(([^)]*)\)$", 1).alias("target")))
