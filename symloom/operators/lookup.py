"""Symbol lookup, members, callers, implementations, hierarchy and file relations.

Each takes the graph's tables; the ones that take a name also take a table of names (column ``symbol_name``), for
many requests in one job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from symloom.functions.text import like_any_case
from symloom.schema import SYMBOL_KINDS, ValidationError

#: Kinds of a class's members that are shown in a summary.
MEMBER_KINDS = ("method", "constructor", "getter", "setter")
SHOWN = ("name", "kind", "file_path", "line", "signature", "modifiers")


def _of_kind(df: DataFrame, kind: str | None) -> DataFrame:
    if kind is not None and kind not in SYMBOL_KINDS:
        raise ValidationError(f"unknown kind {kind}")
    return df if kind is None else df.where(F.col("kind") == kind)


def find_symbol(symbols: DataFrame, name: str, kind: str | None = None) -> DataFrame:
    return _of_kind(symbols.where(F.col("name") == name), kind).select("id", *SHOWN)


def by_ids(symbols: DataFrame, ids: DataFrame) -> DataFrame:
    """Whole symbols of these ids (column ``id``), each once; ids that no symbol has give nothing."""
    return symbols.join(ids.select("id").distinct(), "id", "left_semi").select(symbols.columns)


def search_symbols(symbols: DataFrame, query: str, kind: str | None = None, limit: int = 20, literal: bool = False) -> DataFrame:
    """The first ``limit`` symbols, by id, whose name holds the query."""
    if not 1 <= limit <= 100:
        raise ValidationError("limit is from 1 to 100")
    return _of_kind(symbols.where(like_any_case(F.col("name"), query, literal)), kind).orderBy("id").limit(limit).select("id", *SHOWN)


def get_file_symbols(symbols: DataFrame, file_path: str, kind: str | None = None) -> DataFrame:
    return _of_kind(symbols.where(F.col("file_path") == file_path), kind).select("id", *SHOWN)


def members(symbols: DataFrame, class_name: str | None = None) -> DataFrame:
    """Children of every class (of that name): class_name, id and the shown columns."""
    parents = symbols.where(F.col("kind") == "class").select(F.col("id").alias("parent_id"), F.col("name").alias("class_name"))
    parents = parents if class_name is None else parents.where(F.col("class_name") == class_name)
    return symbols.join(parents, "parent_id").select("class_name", "id", *SHOWN)


def by_name_and_class(symbols: DataFrame, name: str, class_name: str, kind: str | None = None) -> DataFrame:
    return _of_kind(members(symbols, class_name).where(F.col("name") == name), kind).drop("class_name")


def callers(symbols: DataFrame, references: DataFrame, wanted: DataFrame | None = None, class_name: str | None = None) -> DataFrame:
    """symbol_name and its distinct callers: caller_name, caller_class, caller_file, line, confidence.

    Of several calls by one caller the first counts: smallest target id, then first line of the call. With
    ``class_name`` only methods of classes of that name are targets.
    """
    targets = symbols.select(F.col("id").alias("target_symbol_id"), F.col("name").alias("symbol_name"), "kind", "parent_id")
    if class_name is not None:
        owners = symbols.where((F.col("kind") == "class") & (F.col("name") == class_name)).select(F.col("id").alias("parent_id"))
        targets = targets.where(F.col("kind") == "method").join(owners, "parent_id", "left_semi")
    if wanted is not None:
        targets = targets.join(wanted.select("symbol_name").distinct(), "symbol_name", "left_semi")
    calls = references.where(F.col("ref_kind") == "calls").join(targets.select("target_symbol_id", "symbol_name"), "target_symbol_id")
    # One row per (target name, caller) before any wider join: the hot targets shrink here.
    order = F.struct("target_symbol_id", "source_line", "confidence")
    calls = calls.groupBy("symbol_name", "source_symbol_id").agg(F.min(order).alias("first"))
    sources = symbols.select(F.col("id").alias("source_symbol_id"), F.col("name").alias("caller_name"), F.col("file_path").alias("caller_file"), "line", F.col("parent_id").alias("p_id"))
    classes = symbols.where(F.col("kind") == "class").select(F.col("id").alias("p_id"), F.col("name").alias("caller_class"))
    found = calls.join(sources, "source_symbol_id").join(classes, "p_id", "left")
    same = ("symbol_name", "caller_name", "caller_class", "caller_file", "line")
    return found.groupBy(*same).agg(F.min(F.struct("first", "source_symbol_id")).alias("x")).select(*same, F.col("x.first.confidence").alias("confidence"))


def implementations(symbols: DataFrame, references: DataFrame, interface_name: str | None = None) -> DataFrame:
    """interface_name, class_name, file_path, line (always 0) of what implements it."""
    targets = symbols.select(F.col("id").alias("target_symbol_id"), F.col("name").alias("interface_name"))
    targets = targets if interface_name is None else targets.where(F.col("interface_name") == interface_name)
    edges = references.where(F.col("ref_kind") == "implements").join(targets, "target_symbol_id")
    own = symbols.select(F.col("id").alias("source_symbol_id"), F.col("name").alias("class_name"), "file_path")
    return edges.join(own, "source_symbol_id").select("interface_name", "class_name", "file_path").distinct().withColumn("line", F.lit(0))


def hierarchy(symbols: DataFrame, references: DataFrame, class_name: str | None = None) -> DataFrame:
    """class_name, relation, name, file_path, line: what classes of that name extend and implement, and what does so."""
    classes = symbols.where(F.col("kind") == "class").select(F.col("id").alias("own"), F.col("name").alias("class_name"))
    classes = classes if class_name is None else classes.where(F.col("class_name") == class_name)
    edges = references.where(F.col("ref_kind").isin("extends", "implements"))
    out = edges.select(F.col("source_symbol_id").alias("own"), F.col("target_symbol_id").alias("id"), F.col("ref_kind").alias("relation"))
    back = edges.select(F.col("target_symbol_id").alias("own"), F.col("source_symbol_id").alias("id"), F.when(F.col("ref_kind") == "extends", "extended_by").otherwise("implemented_by").alias("relation"))
    shown = symbols.select("id", "name", "file_path", "line")
    return out.union(back).join(classes, "own").join(shown, "id").select("class_name", "relation", "name", "file_path", "line").distinct()


def related_files(file_imports: DataFrame, file_path: str | None = None) -> DataFrame:
    """file_path, direction (imports_from, imported_by), other_file."""
    both = file_imports.select(F.col("source_file").alias("file_path"), F.lit("imports_from").alias("direction"), F.col("target_file").alias("other_file"))
    both = both.union(file_imports.select("target_file", F.lit("imported_by"), "source_file"))
    return both if file_path is None else both.where(F.col("file_path") == file_path)


def outgoing(symbols: DataFrame, references: DataFrame, kind: str | None = None) -> DataFrame:
    """Edges with the names at both ends."""
    edges = references if kind is None else references.where(F.col("ref_kind") == kind)
    source = symbols.select(F.col("id").alias("source_symbol_id"), F.col("name").alias("source_name"))
    target = symbols.select(F.col("id").alias("target_symbol_id"), F.col("name").alias("target_name"), F.col("file_path").alias("target_file"))
    return edges.join(source, "source_symbol_id").join(target, "target_symbol_id").select("source_symbol_id", "source_name", "target_symbol_id", "target_name", "target_file", "ref_kind", "source_line", "confidence")


def file_by_path(files: DataFrame, path: str) -> DataFrame:
    return files.where(F.col("path") == path)


def counts(**tables: DataFrame) -> DataFrame:
    """(name, count) of each table."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count(F.lit(1)).alias("count")).select(F.lit(name).alias("name"), "count")
        out = one if out is None else out.union(one)
    return out


def class_members(symbols: DataFrame) -> DataFrame:
    """file_path, class_name, class_line, members: every class with the sorted names of what can be called on it."""
    own = symbols.where(F.col("kind").isin(*MEMBER_KINDS) & F.col("parent_id").isNotNull()).groupBy(F.col("parent_id").alias("id")).agg(F.sort_array(F.collect_list("name")).alias("members"))
    classes = symbols.where(F.col("kind") == "class").select("id", "file_path", F.col("name").alias("class_name"), F.col("line").alias("class_line"))
    return classes.join(own, "id", "left").select("file_path", "class_name", "class_line", F.coalesce("members", F.array().cast("array<string>")).alias("members"))


def name_order(column: str) -> tuple[Column, Column]:
    """The order that people expect of names: letters first, then accents, then case (small before capital), code points last."""
    return F.collate(F.col(column), "UNICODE"), F.col(column)


def collated(df: DataFrame, column: str) -> DataFrame:
    return df.orderBy(*name_order(column))


def write_targets(symbols: DataFrame, references: DataFrame, symbol_name: str, limit: int = 10, class_name: str | None = None) -> DataFrame:
    """Where a change of a symbol must be made, ranked: declaration 100, caller 80, implementor 75, subclass 70.

    With ``class_name`` only members of classes of that name are meant.
    """
    if not 1 <= limit <= 25:
        raise ValidationError("limit is from 1 to 25")
    own = symbols.where(F.col("name") == symbol_name)
    if class_name is not None:
        own = own.join(symbols.where((F.col("kind") == "class") & (F.col("name") == class_name)).select(F.col("id").alias("parent_id")), "parent_id", "left_semi")
    shown = lambda reason, score: (F.lit(reason).alias("reason"), F.lit(score).alias("score"))
    declared = own.select("file_path", "line", F.col("name").alias("symbol"), "kind", *shown("declaration", 100))
    names = own.select(F.col("name").alias("symbol_name")).distinct()
    calls = references if class_name is None else references.join(own.select(F.col("id").alias("target_symbol_id")), "target_symbol_id", "left_semi")
    called = callers(symbols, calls, names).select(F.col("caller_file").alias("file_path"), "line", F.col("caller_name").alias("symbol"), F.when(F.col("caller_class").isNotNull(), "method").otherwise("function").alias("kind"), *shown("caller", 80))
    faces = own.where(F.col("kind") == "interface").select(F.col("id").alias("target_symbol_id"))
    bases = own.where(F.col("kind") == "class").select(F.col("id").alias("target_symbol_id"))
    source = symbols.select(F.col("id").alias("source_symbol_id"), "file_path", "line", "name", "kind")
    by = lambda kind, owners: references.where(F.col("ref_kind") == kind).join(owners, "target_symbol_id", "left_semi").join(source, "source_symbol_id")
    implemented = by("implements", faces).select("file_path", F.lit(0).alias("line"), F.col("name").alias("symbol"), F.lit("class").alias("kind"), *shown("implementor", 75))
    extended = by("extends", bases).select("file_path", "line", F.col("name").alias("symbol"), "kind", *shown("subclass", 70))
    rows = declared.unionByName(called).unionByName(implemented).unionByName(extended)
    return rows.groupBy("reason", "file_path", "line", "symbol").agg(F.max("score").alias("score"), F.min("kind").alias("kind")).orderBy(F.desc("score"), *name_order("file_path"), "line", *name_order("symbol")).limit(limit)
