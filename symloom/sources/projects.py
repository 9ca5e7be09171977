"""Source trees as tables: files with hashes, and import specifiers."""

from __future__ import annotations

import re
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders that are no part of a project unless a caller says otherwise.
SKIPPED = (".git", "dist", "node_modules")
#: What a specifier may stand for, in this order; the bare name only through an alias.
SUFFIXES = (".ts", "/index.ts", ".tsx", "/index.tsx")


def read_project(spark: SparkSession, root: str, pattern: str = "*.{ts,tsx}", skipped: tuple[str, ...] = SKIPPED) -> DataFrame:
    """(path, last_modified, content, content_hash) of a tree's source files; empty ones have no last_modified."""
    folders = "/(" + "|".join(s.replace(".", r"\.") for s in skipped) + ")/"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    # The reader leaves empty files out, but its listing (which the driver holds anyway) has them.
    listed = [(re.sub("^file:/+", "file:/", unquote(p)),) for p in files.inputFiles()]
    content = F.coalesce("content", F.lit(b""))
    found = spark.createDataFrame(listed, "path string").join(files, "path", "left")
    return found.where(~F.col("path").rlike(folders)).select("path", F.col("modificationTime").alias("last_modified"), F.decode(content, "UTF-8").alias("content"), F.sha2(content, 256).alias("content_hash"))


def read_aliases(spark: SparkSession, path: str, root: str) -> DataFrame:
    """(turn, pattern, target) from a project's compiler settings, targets below ``root``; none if they can't be read."""
    text = spark.read.text(path, wholetext=True)
    paths = F.from_json(F.get_json_object("value", "$.compilerOptions.paths"), "map<string, array<string>>")
    each = text.select(F.posexplode(F.map_entries(paths)).alias("alias", "entry")).select("alias", F.col("entry.key").alias("pattern"), F.posexplode("entry.value").alias("at", "value"))
    return each.select(F.struct("alias", "at").alias("turn"), "pattern", F.concat(F.lit(root.rstrip("/") + "/"), "value").alias("target"))


#: What is read as one piece of code. Comments, strings, templates (with strings and one more template inside their
#: insertions) and regular expressions are consumed whole, so an import inside them is none; ``import(...)``,
#: ``import x = ...`` and ``x.import`` are no import statements.
_COMMENT = r"/\*(?s:.*?)\*/|//[^\n]*+"
_STRING = r"""'[^'\\\n]*+(?:\\(?s:.)[^'\\\n]*+)*+'|"[^"\\\n]*+(?:\\(?s:.)[^"\\\n]*+)*+\""""
_TEMPLATE = rf"`[^`\\$]*+(?:(?:\\(?s:.)|\$\{{[^`'\"{{}}]*+(?:(?:`[^`]*+`|{_STRING}|\{{[^{{}}]*+\}})[^`'\"{{}}]*+)*+\}}|\$)[^`\\$]*+)*+`"
_REGEX = r"(?<=[=(,:!&|?\[;{}]\s{0,9})/(?![*/])[^/\\\[\n]*+(?:(?:\\.|\[[^\]\\\n]*+(?:\\.[^\]\\\n]*+)*+\])[^/\\\[\n]*+)*+/"
_IMPORT = rf"""(?<![\w$.])import(?:\s|{_COMMENT})++(?:type\s+)?(?:((?:[\w$*{{}},\s]|{_COMMENT})+?)\s*+from)?\s*+(?:'([^'\n]*+)'|"([^"\n]*+)")"""
CODE = f"{_IMPORT}|{_COMMENT}|{_TEMPLATE}|{_STRING}|{_REGEX}"


def _statements(content: Column) -> Column:
    """Import statements of a source text in order: clause (empty for side effects), specifier."""
    part = lambda n: F.regexp_extract_all(content, F.lit(CODE), F.lit(n))
    each = F.arrays_zip(part(1).alias("clause"), part(2).alias("one"), part(3).alias("two"))
    named = F.transform(each, lambda x: F.struct(F.regexp_replace(x["clause"], _COMMENT, " ").alias("clause"), F.concat(x["one"], x["two"]).alias("specifier")))
    return F.filter(named, lambda x: x["specifier"] != "")


def import_specifiers(files: DataFrame) -> DataFrame:
    """(path, specifier): distinct modules that a file's import statements name, side effects included."""
    return files.select("path", F.explode(F.array_distinct(F.transform(_statements(F.col("content")), lambda x: x["specifier"]))).alias("specifier"))


def normal_path(path: Column) -> Column:
    """A path without ``.`` and ``..`` segments."""
    kept = F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), lambda acc, x: F.when(x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).when((x == ".") | ((x == "") & (F.size(acc) > 0)), acc).otherwise(F.concat(acc, F.array(x))))
    return F.array_join(kept, "/")


def imported_names(files: DataFrame) -> DataFrame:
    """(path, position, specifier, name): each name that a file's imports bring in, default ones too, under the name it is exported by."""
    each = files.select("path", F.posexplode(F.filter(_statements(F.col("content")), lambda x: x["clause"] != "")).alias("position", "x"))
    clause = F.col("x.clause")
    named = F.split(F.regexp_extract(clause, r"\{([^}]*)\}", 1), ",")
    default = F.array(F.regexp_extract(clause, r"^\s*([\w$]+)\s*(?:,|$)", 1))
    names = F.filter(F.transform(F.concat(named, default), lambda n: F.regexp_extract(n, r"^\s*(?:type\s+)?([\w$]+)", 1)), lambda n: n != "")
    return each.select("path", "position", F.col("x.specifier").alias("specifier"), F.explode(names).alias("name"))


def import_map(names: DataFrame) -> DataFrame:
    """(source_file, name, target_file) from (source_file, position, name, target_file): of several imports of a name the last counts."""
    return names.groupBy("source_file", "name").agg(F.max_by("target_file", F.struct("position", "target_file")).alias("target_file"))


def target_files(refs: DataFrame, imported: DataFrame, declared: DataFrame) -> DataFrame:
    """refs (source_file, target_name, ...) with target_file: where the name is imported from, else its own file if the name is declared there.

    imported: an import map; declared: (file_path, name) of every declaration, local ones too.
    """
    here = declared.select(F.col("file_path").alias("source_file"), F.col("name").alias("target_name")).distinct().withColumn("own", F.lit(True))
    there = imported.select("source_file", F.col("name").alias("target_name"), F.col("target_file").alias("from_import"))
    out = refs.join(there, ["source_file", "target_name"], "left").join(here, ["source_file", "target_name"], "left")
    return out.withColumn("target_file", F.coalesce("from_import", F.when(F.col("own"), F.col("source_file")))).drop("from_import", "own")


def alias_bases(imports: DataFrame, aliases: DataFrame) -> DataFrame:
    """(path, specifier, base, turn) of specifiers that an alias fits: ``x/*`` by its start, others as a whole.

    aliases: (turn, pattern, target), a project's own settings: a few rows.
    """
    wild = F.col("pattern").endswith("/*")
    start = F.expr("substring(pattern, 1, length(pattern) - 1)")
    hit = imports.where(~F.col("specifier").startswith(".")).join(F.broadcast(aliases), F.when(wild, F.col("specifier").startswith(start)).otherwise(F.col("specifier") == F.col("pattern")))
    filled = F.when(wild & F.col("target").endswith("/*"), F.concat(F.expr("substring(target, 1, length(target) - 1)"), F.expr("substring(specifier, length(pattern))"))).otherwise(F.col("target"))
    return hit.select("path", "specifier", filled.alias("base"), "turn")


def resolve_imports(imports: DataFrame, files: DataFrame, aliases: DataFrame | None = None, with_specifier: bool = False) -> DataFrame:
    """(source_file, target_file): each specifier's first candidate that is a file. Aliases: (turn, pattern, target)."""
    base = normal_path(F.concat(F.regexp_extract("path", "^(.*)/[^/]*$", 1), F.lit("/"), "specifier"))
    tried = lambda df, suffixes: df.select("path", "specifier", "turn", F.posexplode(F.array(*[F.concat("base", F.lit(s)) for s in suffixes])).alias("rank", "target_file"))
    relative = imports.where(F.col("specifier").startswith(".")).select("path", "specifier", base.alias("base"), F.lit(None).alias("turn"))
    candidates = tried(relative, SUFFIXES)
    if aliases is not None:
        own = alias_bases(imports, aliases)
        own = tried(own.withColumn("base", normal_path(F.col("base"))), (*SUFFIXES, ""))
        candidates = candidates.withColumn("turn", F.col("turn").cast(aliases.schema["turn"].dataType)).union(own)
    found = candidates.join(files.select(F.col("path").alias("target_file")), "target_file")
    first = found.groupBy("path", "specifier").agg(F.min_by("target_file", F.struct("turn", "rank")).alias("target_file"))
    return first.select(F.col("path").alias("source_file"), *(["specifier"] if with_specifier else []), "target_file").distinct()
