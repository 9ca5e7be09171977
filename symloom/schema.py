"""Tables of the graph, the values that their columns may take, and errors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SYMBOLS = "id long, name string, kind string, file_path string, line int, column int, end_line int, parent_id long, signature string, modifiers string, return_type string, params string, doc_comment string"
REFERENCES = "source_symbol_id long, target_symbol_id long, ref_kind string, source_line int, confidence string"
FILES = "path string, last_modified timestamp, content_hash string, symbol_count long"
FILE_IMPORTS = "source_file string, target_file string"
NAMED_REFS = "source_name string, source_file string, source_parent_name string, target_name string, target_file string, target_parent_name string, ref_kind string, source_line int, confidence string"
CHANGE_FEED = "ts timestamp, path string, op string, content string"

#: Fixed values.
SYMBOL_KINDS = ("class", "constructor", "enum", "enum_member", "function", "getter", "interface", "method", "property", "setter", "type_alias", "variable")
REF_KINDS = ("calls", "imports", "extends", "implements", "type_ref", "decorator")
CONFIDENCES = ("direct", "inferred", "weak")


class GraphError(Exception):
    """Any error of this package."""


class ValidationError(GraphError):
    """A request that cannot be answered as it stands."""


def validate(symbols: DataFrame, references: DataFrame) -> DataFrame:
    """(rule, violations): rows that break a rule, counted in one pass over each table."""
    bad = lambda c: F.count_if(F.coalesce(c, F.lit(True)))
    one = symbols.agg(bad(~F.col("kind").isin(*SYMBOL_KINDS)).alias("symbol_kind"), bad(F.col("name").isNull()).alias("symbol_name"), bad(F.col("line") < 1).alias("symbol_line"))
    two = references.agg(bad(~F.col("ref_kind").isin(*REF_KINDS)).alias("ref_kind"), bad(~F.col("confidence").isin(*CONFIDENCES)).alias("confidence"))
    flat = lambda df: df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("rule"), F.col(c).alias("violations")) for c in df.columns])).alias("x")).select("x.*")
    return flat(one).union(flat(two))


def validate_keys(symbols: DataFrame, references: DataFrame, files: DataFrame) -> DataFrame:
    """(rule, violations): rows beyond the first of a key, and rows that point to nothing."""
    count = lambda df, rule: df.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(rule).alias("rule"), "violations")
    beyond = lambda df, rule, *keys: df.groupBy(*keys).agg((F.count(F.lit(1)) - 1).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("violations")).select(F.lit(rule).alias("rule"), "violations")
    ids = symbols.select("id").distinct()
    missing = lambda df, column, rule: count(df.select(F.col(column).alias("id")).where("id is not null").join(ids, "id", "left_anti"), rule)
    out = beyond(symbols, "symbol_id", "id").union(beyond(symbols, "symbol_place", "file_path", "name", "kind", "line")).union(beyond(files, "file_path", "path"))
    return out.union(missing(symbols, "parent_id", "symbol_parent")).union(missing(references, "source_symbol_id", "edge_source")).union(missing(references, "target_symbol_id", "edge_target"))


def demand_valid(symbols: DataFrame, references: DataFrame) -> None:
    """Raise ValidationError, naming the rules, if some rows break them."""
    broken = {r["rule"]: r["violations"] for r in validate(symbols, references).where("violations > 0").collect()}  # a row for each rule
    if broken:
        raise ValidationError("rows break rules: " + ", ".join(f"{k} ({n})" for k, n in sorted(broken.items())))
