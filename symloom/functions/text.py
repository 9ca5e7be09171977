"""Column functions over source text, names and paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def like_any_case(column: Column, query: str, literal: bool = False) -> Column:
    """Substring test; ``%`` and ``_`` are wildcards unless ``literal``. A backslash stands for itself."""
    return F.contains(F.lower(column), F.lit(query.lower())) if literal else column.ilike("%" + query.replace("\\", "\\\\") + "%")


def signature_line(text: Column) -> Column:
    """First line, trimmed, without a brace at its end."""
    return F.regexp_replace(F.trim(F.split_part(F.trim(text), F.lit("\n"), F.lit(1))), r"\s*\{$", "")


def last_segment(dotted: Column) -> Column:
    return F.element_at(F.split(dotted, r"\."), -1)


def decorator_name(text: Column) -> Column:
    """Last segment of a decorator's name, without empty parentheses."""
    return last_segment(F.regexp_replace(text, r"\(\)$", ""))


def unquoted(text: Column) -> Column:
    return F.regexp_replace(text, "['\"]", "")


def hrefs(html: Column) -> Column:
    """All link targets of a page, in order."""
    return F.regexp_extract_all(html, F.lit('href="([^"]*)"'), F.lit(1))


def calls_own(text: Column) -> Column:
    """Whether a call's text goes through its own object."""
    return F.contains(text, F.lit("this."))


#: Fixed values.
ROUTE_METHODS = ("use", "get", "post", "put", "delete", "patch")


def route_method(callee: Column) -> Column:
    """The method by which a call registers a route (``app.get``), or null."""
    found = F.regexp_extract(callee, r"\.(" + "|".join(ROUTE_METHODS) + ")$", 1)
    return F.when(found != "", found)


def route_segments(path: Column) -> Column:
    """Segments of a path, each with whether it is a bracketed one that stands for a value, and its bare name."""
    own = F.filter(F.split(path, "/"), lambda x: x != "")
    return F.transform(own, lambda x: F.struct(F.regexp_replace(x, r"^\[(?:\.\.\.)?|\]$", "").alias("name"), x.startswith("[").alias("dynamic")))


def shown_value(value: Column) -> Column:
    """A value as text: JSON if it has parts."""
    return F.to_json(value)


def resource_name(uri: Column, scheme: str) -> Column:
    """The decoded name in ``scheme://name``, or null for other addresses; a plus sign is no blank."""
    found = F.regexp_extract(uri, "^" + scheme + "://(.+)$", 1)
    return F.when(found != "", F.try_url_decode(F.replace(found, F.lit("+"), F.lit("%2B"))))
