"""The graph in catalog tables that are kept current by deltas.

Every table is partitioned by a hash of the key by which it is replaced: symbols, files and references by file, the
index of names by name, the index of targets by what a reference aims at. A change rewrites the partitions of its keys
alone (dynamic partition overwrite) and reads no others. Within partitions symbols are bucketed by id and references
by target, so a join of the two on ids needs no exchange.

A reference aims at a file (``f``) if it names one, else at a name anywhere (``n``). When files are read again, only
these references are resolved again: their own, those that aim at them, and those that aim at a name which they had or
have. How many symbols have a name, and the least id, is kept for each (name, file), so the change of a file replaces
its rows and a name's candidates are summed from few.

An update is staged as a whole, named in a note, and put into the tables; an update that was cut off is finished from
its note by the next one. An update may carry an epoch, and an epoch is applied once.

The driver gets numbers of partitions, never names or rows. One writer at a time.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from symloom.operators.maintain import changed
from symloom.operators.resolve import with_ends
from symloom.schema import FILE_IMPORTS, demand_valid
from symloom.shared import create_new, exists, list_names, new_folder, remove, written

#: Partitions of each table, and buckets in each: what a change of one file rewrites is one in so many of its rows, so
#: both grow with the project.
PARTS, BUCKETS = 64, 8
OVERWRITE = "spark.sql.sources.partitionOverwriteMode"
PENDING = "name string, path string, parts array<int>, epoch long"
REF_KEY = ("source_file", "source_name", "source_parent_name", "target_name", "target_file", "target_parent_name", "ref_kind", "source_line", "confidence")


@dataclass
class Touched:
    """Numbers of the partitions that an update read and wrote, by table; ``resolved``: references that were resolved again."""

    files: int = 0
    names: int = 0
    references: int = 0
    targets: int = 0
    resolved: int = 0


class StoredGraph:
    """symbols, refs (with both ends, null where unresolved), files, names, targets, imports and importers in one database.

    Import pairs stand twice, by the file that imports and by the one that is imported, so either side is read or
    deleted by its own partitions.
    """

    def __init__(self, spark: SparkSession, database: str, folder: str | None = None, parts: int = PARTS, buckets: int = BUCKETS):
        self.spark, self.database, self.parts, self.buckets = spark, database, parts, buckets
        self.folder = (folder or new_folder(spark, database)).rstrip("/")
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {database} LOCATION '{self.folder}'")

    # Tables and their keys.
    def part(self, key: str | Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.parts)).cast("int").alias("part")

    def _put(self, df: DataFrame, name: str, key: str, bucket: str | None = None) -> None:
        # Adaptive execution splits a partition that a common name or a large file makes too large for a task.
        rows = df.withColumn("part", self.part(key)).hint("rebalance", "part")
        writer = rows.write.format("parquet").option("path", f"{self.folder}/{name}").partitionBy("part")
        (writer.bucketBy(self.buckets, bucket).sortBy(bucket) if bucket else writer).mode("overwrite").saveAsTable(f"{self.database}.{name}")

    def table(self, name: str) -> DataFrame:
        return self.spark.table(f"{self.database}.{name}")

    @property
    def symbols(self) -> DataFrame:
        return self.table("symbols").drop("part")

    @property
    def references(self) -> DataFrame:
        """Edges, as the other operators take them."""
        found = self.table("refs").where("source_symbol_id is not null and target_symbol_id is not null")
        return found.select("source_symbol_id", "target_symbol_id", "ref_kind", "source_line", "confidence")

    @property
    def files(self) -> DataFrame:
        return self.table("files").drop("part")

    @staticmethod
    def names_of(symbols: DataFrame) -> DataFrame:
        return symbols.groupBy("name", "file_path").agg(F.min("id").alias("least_id"), F.count(F.lit(1)).alias("n"))

    @staticmethod
    def aim(refs: DataFrame) -> Column:
        return F.coalesce(F.concat(F.lit("f"), refs["target_file"]), F.concat(F.lit("n"), refs["target_name"]))

    def targets_of(self, refs: DataFrame) -> DataFrame:
        return refs.select(self.aim(refs).alias("aim"), "source_file").where("aim is not null").distinct()

    def create(self, symbols: DataFrame, named_refs: DataFrame, files: DataFrame, imports: DataFrame | None = None) -> StoredGraph:
        """All tables anew, from whole ones: symbols, references by name, files (path, content_hash, symbol_count).

        Rows that break a rule of the schema raise ValidationError, here and in updates, before anything is written.
        """
        demand_valid(symbols, named_refs)
        self._put(symbols, "symbols", "file_path", "id")
        self._put(files.select("path", "content_hash", "symbol_count"), "files", "path")
        self._put(self.names_of(self.symbols), "names", "name")
        self._put(with_ends(named_refs.select(*REF_KEY), self.symbols), "refs", "source_file", "target_symbol_id")
        self._put(self.targets_of(self.table("refs")), "targets", "aim")
        pairs = self.spark.createDataFrame([], FILE_IMPORTS) if imports is None else imports.select("source_file", "target_file").distinct()
        self._put(pairs, "imports", "source_file")
        self._put(self.table("imports").drop("part"), "importers", "target_file")
        return self

    def reset(self) -> None:
        """No rows; the tables stay."""
        none = lambda name, *drop: self.spark.createDataFrame([], self.table(name).drop("part", *drop).schema)
        self.create(none("symbols"), none("refs", "source_symbol_id", "target_symbol_id"), none("files"), none("imports"))

    # Changes.
    def _of(self, keys: DataFrame, column: str) -> list[int]:
        """Partitions in which keys lie: as many numbers as there are partitions, at most."""
        return sorted(r[0] for r in keys.select(self.part(column)).distinct().collect())

    def _at(self, name: str, parts: list[int]) -> DataFrame:
        return self.table(name).where(F.col("part").isin(parts)) if parts else self.table(name).limit(0)

    def _stage(self, name: str, rows: DataFrame, key: str, parts: list[int]) -> dict:
        """What the partitions of a table will hold, written beside it."""
        path = new_folder(self.spark, f"next-{name}")
        rows.withColumn("part", self.part(key)).select(self.table(name).columns).write.parquet(path)
        return {"name": name, "path": path, "parts": parts}

    def _commit(self, staged: list[dict], epoch: int | None) -> None:
        """Name what is staged in one place, then put it into the tables: whoever finds the note does it again."""
        note = [(x["name"], x["path"], x["parts"], epoch) for x in staged]
        self.spark.createDataFrame(note, PENDING).coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/_pending")
        self.recover()

    def recover(self) -> bool:
        """Finish an update that was cut off; False if there is none. An update whose note is not complete never began."""
        note = f"{self.folder}/_pending"
        if not exists(self.spark, f"{note}/_SUCCESS"):
            return False
        rows = self.spark.read.schema(PENDING).parquet(note).collect()  # one for each table
        before = self.spark.conf.get(OVERWRITE)
        self.spark.conf.set(OVERWRITE, "dynamic")
        try:
            for r in rows:
                self._put_partitions(r["name"], self.spark.read.schema(self.table(r["name"]).schema).parquet(r["path"]), list(r["parts"]))
        finally:
            self.spark.conf.set(OVERWRITE, before)
        if rows[0]["epoch"] is not None:
            create_new(self.spark, self._mark(rows[0]["epoch"]))
        remove(self.spark, note)
        for r in rows:
            remove(self.spark, r["path"])
        return True

    def _put_partitions(self, name: str, ready: DataFrame, parts: list[int]) -> None:
        table = f"{self.database}.{name}"
        ready.hint("rebalance", "part").write.mode("overwrite").insertInto(table)
        for empty in set(parts) - {r[0] for r in ready.select("part").distinct().collect()}:
            self.spark.sql(f"ALTER TABLE {table} DROP IF EXISTS PARTITION (part = {empty})")
            remove(self.spark, f"{self.folder}/{name}/part={empty}")  # an external table keeps its files otherwise
        self.spark.catalog.refreshTable(table)

    def _mark(self, epoch: int) -> str:
        return f"{self.folder}/_epochs/{epoch:012d}"

    def epoch(self) -> int:
        """The last epoch that was applied, -1 before the first."""
        return max((int(n) for n in list_names(self.spark, f"{self.folder}/_epochs") if n.isdigit()), default=-1)

    def update(self, read: DataFrame, symbols: DataFrame, named_refs: DataFrame, imports: DataFrame | None = None, epoch: int | None = None) -> Touched:
        """Files were read again: path, content_hash, symbol_count, error (a row for each), and what was parsed from them.

        Files with their stored hash or with an error keep what is stored. A file that is gone comes with a null hash
        and no rows: its record goes too, and so do imports of it. Without ``imports`` (source_file, target_file) those
        of files that are still there stay. An epoch that was applied before changes nothing.
        """
        self.recover()
        out = Touched()
        if epoch is not None and epoch <= self.epoch():
            return out
        stored = self._at("files", self._of(read, "path"))
        good = written(changed(read.where("error is null"), stored).select("path", "content_hash", "symbol_count"), "changed-files")
        of = lambda df, column: df.join(good.select(F.col("path").alias(column)), column, "left_semi").select(df.columns)
        without = lambda name, parts, column: self._at(name, parts).drop("part").join(good.select(F.col("path").alias(column)), column, "left_anti")
        at_files = self._of(good, "path")
        if not at_files:  # nothing changed
            if epoch is not None:
                create_new(self.spark, self._mark(epoch))
            return out
        fresh, fresh_refs = written(of(symbols, "file_path"), "fresh-symbols"), of(named_refs.select(*REF_KEY), "source_file")
        demand_valid(fresh, fresh_refs)
        fresh_names = self.names_of(fresh)
        names = written(of(self._at("symbols", at_files), "file_path").select("name").union(fresh.select("name")).distinct(), "touched-names")
        # Whom the change concerns.
        aims = good.select(F.concat(F.lit("f"), "path").alias("aim")).union(names.select(F.concat(F.lit("n"), "name"))).where("aim is not null")
        aims = written(aims.distinct(), "touched-aims")
        concerned = self._at("targets", self._of(aims, "aim")).join(aims, "aim", "left_semi").select("source_file")
        concerned = written(concerned.union(good.select("path")).distinct(), "concerned-files")
        at_refs = self._of(concerned, "source_file")
        # Old rows of these partitions: to be resolved again, or as they are.
        here = without("refs", at_refs, "source_file")
        here = here.withColumn("aim", self.aim(here))
        again = written(here.join(aims, "aim", "left_semi").select(*REF_KEY).union(fresh_refs), "references-again")
        same = here.join(aims, "aim", "left_anti").drop("aim")
        ends = self._resolved(again, lambda parts: without("symbols", parts, "file_path").unionByName(fresh, allowMissingColumns=True), lambda parts: without("names", parts, "file_path").unionByName(fresh_names))
        at_names, new_targets = self._of(names, "name"), self.targets_of(fresh_refs)
        old_targets = self.targets_of(of(self._at("refs", at_files), "source_file"))
        at_targets = sorted({*self._of(old_targets, "aim"), *self._of(new_targets, "aim")})
        self._commit([
            self._stage("symbols", without("symbols", at_files, "file_path").unionByName(fresh, allowMissingColumns=True), "file_path", at_files),
            self._stage("names", without("names", at_names, "file_path").unionByName(fresh_names), "name", at_names),
            self._stage("targets", without("targets", at_targets, "source_file").unionByName(new_targets), "aim", at_targets),
            self._stage("refs", same.unionByName(ends), "source_file", at_refs),
            *self._staged_imports(good, imports),
            self._stage("files", without("files", at_files, "path").unionByName(good.where("content_hash is not null")), "path", at_files),
        ], epoch)
        out.files, out.names, out.references, out.targets, out.resolved = len(at_files), len(at_names), len(at_refs), len(at_targets), again.count()
        return out

    def _staged_imports(self, good: DataFrame, imports: DataFrame | None) -> list[dict]:
        """Both tables of import pairs, of the partitions that the files of ``good`` touch on either side."""
        gone = good.where("content_hash is null").select("path")
        at_sources, at_gone = self._of(good, "path"), self._of(gone, "path")
        own = lambda df, files, side: df.join(files.select(F.col("path").alias(side)), side, "left_semi").select("source_file", "target_file")
        rest = lambda df, files, side: df.join(files.select(F.col("path").alias(side)), side, "left_anti").select("source_file", "target_file")
        old = own(self._at("imports", at_sources), good, "source_file")
        fresh = rest(own(old if imports is None else imports.distinct(), good.where("content_hash is not null"), "source_file"), gone, "target_file")
        fresh = written(fresh, "fresh-imports")
        lost = written(own(self._at("importers", at_gone), gone, "target_file"), "lost-imports")
        sources = sorted({*at_sources, *self._of(lost, "source_file")})
        targets = sorted({*at_gone, *self._of(old, "target_file"), *self._of(fresh, "target_file")})
        after = lambda name, parts: rest(rest(self._at(name, parts), good, "source_file"), gone, "target_file").unionByName(fresh)
        return [self._stage("imports", after("imports", sources), "source_file", sources), self._stage("importers", after("importers", targets), "target_file", targets)]

    def related_files(self, path: str) -> DataFrame:
        """(file_path, direction, other_file) of one file, from its partition on either side."""
        there = lambda name, side, other, direction: self.table(name).where((F.col("part") == self.part(F.lit(path))) & (F.col(side) == path)).select(F.lit(path).alias("file_path"), F.lit(direction).alias("direction"), F.col(other).alias("other_file"))
        return there("imports", "source_file", "target_file", "imports_from").union(there("importers", "target_file", "source_file", "imported_by"))

    def _resolved(self, refs: DataFrame, symbols_at: Callable[[list[int]], DataFrame], names_at: Callable[[list[int]], DataFrame]) -> DataFrame:
        """Both ends of references, from the partitions of their files and names alone."""
        files = written(refs.select(F.col("source_file").alias("file_path")).union(refs.select("target_file")).where("file_path is not null").distinct(), "files-of-ends")
        near = symbols_at(self._of(files, "file_path")).join(files, "file_path", "left_semi")
        wanted = refs.where("target_file is null").select(F.col("target_name").alias("name")).where("name is not null").distinct()
        wanted = written(wanted, "names-of-ends")
        anywhere = names_at(self._of(wanted, "name")).join(wanted, "name", "left_semi").groupBy("name").agg(F.min("least_id").alias("any_hit"), F.sum("n").alias("any_n"))
        return with_ends(refs, near, anywhere)

    def delete(self, paths: DataFrame) -> Touched:
        """Files (column ``path``) that are gone: as if they were read again and empty, and without a record."""
        gone = paths.select("path").distinct()
        read = gone.select("path", F.lit(None).cast("string").alias("content_hash"), F.lit(0).cast("long").alias("symbol_count"), F.lit(None).cast("string").alias("error"))
        return self.update(read, self.symbols.limit(0), self.table("refs").select(*REF_KEY).limit(0))

    def calls_to(self, name: str) -> DataFrame:
        """Edges of kind ``calls`` to the symbols of a name, with their names: bucketed tables joined where they lie."""
        own = self.symbols.where(F.col("name") == name).select(F.col("id").alias("target_symbol_id"), F.col("name").alias("symbol_name"))
        calls = self.table("refs").where("ref_kind = 'calls' and source_symbol_id is not null")
        return calls.join(own, "target_symbol_id").select("symbol_name", "target_symbol_id", "source_symbol_id", "source_line", "confidence", "source_name", "source_file")

    def callers(self, name: str) -> DataFrame:
        """symbol_name, caller_name, caller_file and confidence of the first call by each caller."""
        first = F.min(F.struct("target_symbol_id", "source_line", "confidence")).alias("x")
        return self.calls_to(name).groupBy("symbol_name", F.col("source_name").alias("caller_name"), F.col("source_file").alias("caller_file")).agg(first).select("symbol_name", "caller_name", "caller_file", F.col("x.confidence").alias("confidence"))
