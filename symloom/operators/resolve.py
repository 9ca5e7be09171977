"""From names to edges: parent links and the resolution of named references, as joins against aggregated candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def parent_link(children: DataFrame, symbols: DataFrame) -> DataFrame:
    """(file_path, parent_name) rows get ``parent_id``: the first symbol of that name in the file, of any kind."""
    first = symbols.groupBy("file_path", F.col("name").alias("parent_name")).agg(F.min("id").alias("parent_id"))
    return children.join(first, ["file_path", "parent_name"], "left")


def known_names(named_refs: DataFrame, symbols: DataFrame) -> DataFrame:
    """Named references whose target name some symbol has."""
    return named_refs.join(symbols.select(F.col("name").alias("target_name")).distinct(), "target_name", "left_semi")


def with_ends(named_refs: DataFrame, symbols: DataFrame, anywhere: DataFrame | None = None) -> DataFrame:
    """References with source_symbol_id and target_symbol_id, null where an end is not found.

    anywhere: (name, any_hit, any_n), the smallest id and number of the symbols of a name, if ``symbols`` are not all.

    Source: a file's first symbol for ``<file>``; a class's member if a parent is named; else the first of that name
    in the file. Target: a member if file and parent are given; the only one of that name in the file if the file is;
    else the only one of that name anywhere. Ambiguous or missing ends resolve to nothing.
    """
    at = symbols.select("id", "name", "file_path", "parent_id")
    classes = symbols.where(F.col("kind") == "class").select(F.col("id").alias("parent_id"), F.col("name").alias("parent_name"))
    in_class = at.join(classes, "parent_id").groupBy("file_path", "parent_name", "name").agg(F.min("id").alias("class_hit"))
    in_file = at.groupBy("file_path", "name").agg(F.min("id").alias("file_hit"), F.count(F.lit(1)).alias("file_n"))
    anywhere = anywhere if anywhere is not None else at.groupBy("name").agg(F.min("id").alias("any_hit"), F.count(F.lit(1)).alias("any_n"))
    first = at.groupBy("file_path").agg(F.min("id").alias("first_hit"))
    by = lambda df, side, **cols: df.select(*[F.col(a).alias(f"{side}_{b}" if b else f"_{side}_{a}") for a, b in cols.items()])
    refs = named_refs
    refs = refs.join(by(first, "source", file_path="file", first_hit=""), "source_file", "left")
    refs = refs.join(by(in_class, "source", file_path="file", parent_name="parent_name", name="name", class_hit=""), ["source_file", "source_parent_name", "source_name"], "left")
    refs = refs.join(by(in_file, "source", file_path="file", name="name", file_hit="", file_n=""), ["source_file", "source_name"], "left")
    refs = refs.join(by(in_class, "target", file_path="file", parent_name="parent_name", name="name", class_hit=""), ["target_file", "target_parent_name", "target_name"], "left")
    refs = refs.join(by(in_file, "target", file_path="file", name="name", file_hit="", file_n=""), ["target_file", "target_name"], "left")
    refs = refs.join(by(anywhere, "target", name="name", any_hit="", any_n=""), "target_name", "left")
    source = F.when(F.col("source_name") == "<file>", F.col("_source_first_hit")).when(F.col("source_parent_name").isNotNull(), F.col("_source_class_hit")).otherwise(F.col("_source_file_hit"))
    one = lambda hit, n: F.when(F.col(n) == 1, F.col(hit))
    target = F.when(F.col("target_file").isNotNull() & F.col("target_parent_name").isNotNull(), F.col("_target_class_hit")).when(F.col("target_file").isNotNull(), one("_target_file_hit", "_target_file_n")).otherwise(one("_target_any_hit", "_target_any_n"))
    return refs.withColumn("source_symbol_id", source).withColumn("target_symbol_id", target).select(*named_refs.columns, "source_symbol_id", "target_symbol_id")


def resolve_named_refs(named_refs: DataFrame, symbols: DataFrame, keep_unresolved: bool = False) -> DataFrame:
    """Edges for the references whose ends are found, or the references without an edge."""
    out = with_ends(named_refs, symbols)
    missing = F.col("source_symbol_id").isNull() | F.col("target_symbol_id").isNull()
    if keep_unresolved:
        return out.where(missing).select(*named_refs.columns)
    return out.where(~missing).select("source_symbol_id", "target_symbol_id", "ref_kind", "source_line", "confidence")
