"""Keeping the graph current: last write wins, hash comparison, deletion with its cascade, import replacement."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symloom.operators.resolve import resolve_named_refs
from symloom.shared import written


def last_wins(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One whole row per key, the one with the largest ``order`` (then the largest other columns)."""
    rest = [c for c in rows.columns if c not in keys and c != order]
    best = rows.groupBy(*keys).agg(F.max(F.struct(order, *rest)).alias("x"))
    return best.select(*[c if c in keys else F.col(f"x.`{c}`").alias(c) for c in rows.columns])


def changed(current: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows of ``current`` (path, content_hash, ...) that are new or differ from what is stored."""
    return current.join(stored.select("path", "content_hash"), ["path", "content_hash"], "left_anti")


def delete_files(symbols: DataFrame, references: DataFrame, paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables without the symbols of these files (column ``file_path``), their children and all their edges."""
    gone = symbols.join(paths.select("file_path").distinct(), "file_path", "left_semi").select("id")
    children = symbols.join(gone.select(F.col("id").alias("parent_id")), "parent_id", "left_semi").select("id")
    gone = written(gone.union(children).distinct(), "gone")  # read by three joins; its size on disk decides how
    kept = symbols.join(gone, "id", "left_anti")
    edges = references
    for end in ("source_symbol_id", "target_symbol_id"):
        edges = edges.join(gone.select(F.col("id").alias(end)), end, "left_anti")
    return kept, edges


def replace_imports(file_imports: DataFrame, fresh: DataFrame) -> DataFrame:
    """Import pairs after the files in ``fresh`` were read again."""
    kept = file_imports.join(fresh.select("source_file").distinct(), "source_file", "left_anti")
    return kept.select("source_file", "target_file").union(fresh.select("source_file", "target_file")).distinct()


def upsert_symbols(symbols: DataFrame, fresh: DataFrame, read: DataFrame | None = None) -> DataFrame:
    """Symbols after files were parsed again: theirs are replaced as a whole.

    read: the files (column ``file_path``), for some may have no symbols now; those of ``fresh`` if not given.
    """
    read = fresh if read is None else read
    return symbols.join(read.select("file_path").distinct(), "file_path", "left_anti").unionByName(fresh)


def insert_edges(references: DataFrame, fresh: DataFrame) -> DataFrame:
    """Edges as they come: an edge that is there already is kept twice."""
    return references.unionByName(fresh)


def delete_file_references(symbols: DataFrame, references: DataFrame, paths: DataFrame) -> DataFrame:
    """Edges without those that start in these files (column ``file_path``); what points to them stays."""
    own = symbols.join(paths.select("file_path").distinct(), "file_path", "left_semi").select(F.col("id").alias("source_symbol_id"))
    return references.join(own, "source_symbol_id", "left_anti")


def delete_file_imports(file_imports: DataFrame, paths: DataFrame) -> DataFrame:
    """Import pairs with none of these files on either side."""
    gone = written(paths.select("file_path").distinct(), "gone-files")
    for side in ("source_file", "target_file"):
        file_imports = file_imports.join(gone.select(F.col("file_path").alias(side)), side, "left_anti")
    return file_imports.select("source_file", "target_file")


def upsert_files(files: DataFrame, fresh: DataFrame) -> DataFrame:
    """File records after those in ``fresh`` were read again."""
    return files.join(fresh.select("path").distinct(), "path", "left_anti").unionByName(fresh)


@dataclass
class State:
    """The graph as it is stored. named_refs: references as parsed, before any resolution."""

    symbols: DataFrame
    named_refs: DataFrame
    files: DataFrame
    references: DataFrame | None = None
    errors: DataFrame | None = None


def reset(state: State) -> State:
    """A project without any rows; the tables stay."""
    return State(*(None if df is None else df.limit(0) for df in (state.symbols, state.named_refs, state.files, state.references, state.errors)))


def reindex(state: State, read: DataFrame, symbols: DataFrame, named_refs: DataFrame) -> State:
    """The graph after files were read again.

    read: path, content_hash, symbol_count and ``error``, a row for each file read; symbols, named_refs: what was
    parsed from them. Files with their stored hash are skipped; files with an error keep what was stored and are told
    in ``errors``; all others are replaced as a whole. First all symbols, then all edges: every stored reference is
    resolved again, since its target may be in a file that changed.
    """
    good = written(changed(read.where("error is null"), state.files).select("path", "content_hash", "symbol_count"), "changed-files")
    of_good = lambda df, column: df.join(good.select(F.col("path").alias(column)), column, "left_semi").select(df.columns)
    without = lambda df, column: df.join(good.select(F.col("path").alias(column)), column, "left_anti").select(df.columns)
    all_symbols = upsert_symbols(state.symbols, of_good(symbols, "file_path"), good.select(F.col("path").alias("file_path")))
    all_symbols = written(all_symbols.select(state.symbols.columns), "symbols")
    all_refs = without(state.named_refs, "source_file").unionByName(of_good(named_refs, "source_file"))
    files = upsert_files(state.files.select("path", "content_hash", "symbol_count"), good)
    return State(all_symbols, all_refs, files, resolve_named_refs(all_refs, all_symbols), read.where("error is not null").select("path", "error"))
