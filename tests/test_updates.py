"""Updates of the stored graph from a stream: replayed after a failure, drained, and a root bound while readers go on."""

import json
import threading
import time
import uuid

import pytest
from pyspark.sql import functions as F
from test_stored import EDGE, READ, Tree, new_store, rows

from symloom.operators import stored
from symloom.schema import ValidationError
from symloom.sources.bound import Binding
from symloom.sources.listing import ListingState
from symloom.sources.projects import read_project
from symloom.streaming.feed import follow, run_updates
from symloom.streaming.watch import poll


def put(folder, k, events):
    folder.mkdir(exist_ok=True)
    (folder.parent / f"{k}.json").write_text("".join(json.dumps({"ts": f"2024-01-01T00:00:{k:02d}Z", "path": p}) + "\n" for p in events))
    (folder.parent / f"{k}.json").rename(folder / f"{k}.json")


def feed_of(spark, folder):
    return spark.readStream.schema("ts timestamp, path string").option("maxFilesPerTrigger", 1).json(str(folder))


def test_a_batch_that_failed_is_applied_once(spark, tmp_path, monkeypatch):
    tree = Tree(6, 10, 8)
    store = new_store(spark, tree, parts=4, buckets=1)
    applied = []

    def apply(batch, epoch):
        paths = [r["path"] for r in batch.collect()]
        applied.append((epoch, store.update(tree.read(spark, paths), *tree.tables(spark, paths), epoch=epoch)))

    for p in tree.paths[:4]:
        tree.write(p)
    put(tmp_path / "in", 0, tree.paths[:2])
    put(tmp_path / "in", 1, tree.paths[2:4])
    whole, calls = stored.StoredGraph._put_partitions, []

    def fails(self, name, *a):
        calls.append(name)
        if len(calls) == 8:  # in the second batch
            raise RuntimeError("lost")
        return whole(self, name, *a)

    monkeypatch.setattr(stored.StoredGraph, "_put_partitions", fails)
    run = lambda: run_updates(feed_of(spark, tmp_path / "in"), apply, str(tmp_path / "checkpoint")).awaitTermination()
    with pytest.raises(Exception, match="lost"):
        run()
    assert [e for e, _ in applied] == [0] and store.epoch() == 0
    run()
    assert applied[1:] == [(1, stored.Touched())]  # found finished, so not applied again
    assert store.epoch() == 1 and rows(store.references.select(*EDGE)) == tree.edges(spark)


def test_drain_ends_after_the_batch_in_flight(spark, tmp_path):
    begun, done = threading.Event(), []

    def apply(batch, epoch):
        begun.set()
        time.sleep(3)
        done.append((epoch, batch.count()))

    put(tmp_path / "in", 0, ["/a", "/a", "/b"])
    put(tmp_path / "in", 1, ["/c"])
    updates = follow(feed_of(spark, tmp_path / "in"), apply, str(tmp_path / "checkpoint"), every="0 seconds")
    assert begun.wait(60)
    assert updates.drain(60) and done == [(0, 2)] and not updates.query.isActive
    begun.clear()
    updates = follow(feed_of(spark, tmp_path / "in"), apply, str(tmp_path / "checkpoint"), every="0 seconds")
    assert begun.wait(60)
    assert not updates.drain(0.1) and not updates.query.isActive


def test_a_root_is_bound_while_readers_go_on(spark):
    one, two = Tree(7, 6, 6), Tree(8, 6, 6)
    build = lambda tree: lambda graph: graph.create(*tree.tables(spark), tree.read(spark, list(tree.files)).drop("error"))
    binding = Binding(spark, "default.test_project", parts=2, buckets=1)
    with pytest.raises(ValidationError):
        binding.open()
    first, built = binding.bind("/o'ne", build(one))
    assert built and binding.root == "/o'ne"
    again, built = binding.bind("/o'ne", lambda graph: 1 / 0)
    assert not built and again.database == first.database
    reader = binding.open()
    begun = reader.references.select(*EDGE)  # planned before the switch, read after it
    with pytest.raises(ZeroDivisionError):
        binding.bind("/broken", lambda graph: 1 / 0)
    assert binding.root == "/o'ne"
    binding.bind("/two", build(two))
    assert rows(begun) == rows(reader.references.select(*EDGE)) == one.edges(spark)
    assert rows(binding.open().references.select(*EDGE)) == two.edges(spark)
    with pytest.raises(ValidationError):
        binding.retire(binding.open())
    binding.retire(first)
    assert not spark.catalog.databaseExists(first.database) and rows(binding.open().symbols.select("id")) != []
    spark.sql("DROP VIEW default.test_project")


def test_files_without_rows(spark):
    tree = Tree(9, 3, 3)
    store = new_store(spark, tree, parts=2, buckets=1)
    assert store.update(spark.createDataFrame([], READ), *tree.tables(spark, [])) == stored.Touched()
    failed = spark.createDataFrame([(tree.paths[0], "other", 0, "cannot be parsed")], READ)
    assert store.update(failed, *tree.tables(spark, [])) == stored.Touched()
    assert rows(store.references.select(*EDGE)) == tree.edges(spark)


def parse(files):
    """A language of one line for each function: its name and the names that it calls; ``+path`` imports a file."""
    lines = files.select("path", F.posexplode(F.split(F.coalesce("content", F.lit("")), "\n")).alias("line", "text")).where("text <> ''")
    own = lines.where("not startswith(text, '+')").withColumn("words", F.split("text", " "))
    ident = F.pmod(F.xxhash64("path", "line"), F.lit(1 << 40))
    symbols = own.select(ident.alias("id"), F.col("words")[0].alias("name"), F.lit("function").alias("kind"), F.col("path").alias("file_path"), (F.col("line") + 1).alias("line"), F.lit(None).cast("long").alias("parent_id"), F.lit("").alias("modifiers"))
    none = F.lit(None).cast("string")
    calls = own.select("path", "line", F.col("words")[0].alias("source"), F.explode(F.slice("words", 2, 99)).alias("target"))
    refs = calls.select(F.col("source").alias("source_name"), F.col("path").alias("source_file"), none.alias("source_parent_name"), F.col("target").alias("target_name"), none.alias("target_file"), none.alias("target_parent_name"), F.lit("calls").alias("ref_kind"), F.col("line").alias("source_line"), F.lit("direct").alias("confidence"))
    return symbols, refs, lines.where("startswith(text, '+')").select(F.col("path").alias("source_file"), F.expr("substring(text, 2)").alias("target_file"))


def test_a_graph_follows_a_tree(spark, tmp_path, monkeypatch):
    root = tmp_path / "tree"
    root.mkdir()
    write = lambda name, text: (root / name).write_text(text)
    tree = lambda: read_project(spark, str(root)).withColumn("path", F.regexp_extract("path", "/tree/(.*)$", 1))
    listings = ListingState(spark, str(tmp_path / "listings"))
    graph = stored.StoredGraph(spark, f"graph_{uuid.uuid4().hex[:12]}", parts=4, buckets=1)
    graph.create(*(df.limit(0) for df in parse(tree())[:2]), spark.createDataFrame([], "path string, content_hash string, symbol_count long"))

    def calls():
        name = graph.symbols.select("id", "name")
        met = graph.references.join(name.toDF("source_symbol_id", "a"), "source_symbol_id").join(name.toDF("target_symbol_id", "b"), "target_symbol_id")
        return sorted((r["a"], r["b"]) for r in met.collect())

    write("a.ts", "run greet\n+b.ts"), write("b.ts", "greet"), write("c.ts", "other run")
    poll(graph, listings, tree(), parse)
    assert calls() == [("other", "run"), ("run", "greet")] and graph.epoch() == 1
    # A file that others call is read again: they still point to it. Another one goes.
    write("b.ts", "\n\ngreet other"), (root / "c.ts").unlink()
    touched = poll(graph, listings, tree(), parse)
    assert calls() == [("run", "greet")] and touched.resolved == 2
    # A poll that fails is made up for by the next one, which sees a later tree.
    write("c.ts", "other run")
    monkeypatch.setattr(stored.StoredGraph, "_commit", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        poll(graph, listings, tree(), parse)
    monkeypatch.undo()
    write("d.ts", "greet")  # now there are two of that name, so nobody knows which is called
    poll(graph, listings, tree(), parse)
    assert calls() == [("greet", "other"), ("other", "run")] and graph.epoch() == 4
    assert poll(graph, listings, tree(), parse).resolved == 0
    assert {r["path"]: r["symbol_count"] for r in graph.files.collect()} == {"a.ts": 1, "b.ts": 1, "c.ts": 1, "d.ts": 1}
    assert rows(graph.related_files("b.ts")) == [("b.ts", "imported_by", "a.ts")]
