"""The stored graph against rebuilding, and what its updates read and write."""

import random
import uuid

import pytest

from symloom.operators import maintain, resolve, stored
from symloom.schema import ValidationError

SYMBOLS = "id long, name string, kind string, file_path string, line int, parent_id long, modifiers string"
REFS = "source_name string, source_file string, source_parent_name string, target_name string, target_file string, target_parent_name string, ref_kind string, source_line int, confidence string"
READ = "path string, content_hash string, symbol_count long, error string"
EDGE = ("source_symbol_id", "target_symbol_id", "ref_kind", "source_line", "confidence")


class Tree:
    """A project whose files are written anew at random."""

    def __init__(self, seed, n_files, n_names):
        self.rng, self.n_names, self.next_id = random.Random(seed), n_names, 1
        self.paths = [f"/p/f{i}.ts" for i in range(n_files)]
        self.files = {}
        for p in self.paths:
            self.write(p)

    def name(self):
        return f"n{self.rng.randrange(self.n_names)}"

    def write(self, path):
        rng, symbols, refs = self.rng, [], []
        for line in range(rng.randint(0, 6)):
            parent = rng.choice([s[0] for s in symbols if s[2] == "class"] or [None]) if rng.random() < 0.5 else None
            symbols.append((self.next_id, self.name(), "method" if parent else rng.choice(["class", "function"]), path, line + 1, parent, ""))
            self.next_id += 1
        for line in range(rng.randint(0, 6)):
            source = rng.choice([s[1] for s in symbols] + ["<file>"])
            target = rng.choice([None, rng.choice(self.paths)])
            refs.append((source, path, rng.choice([None, None, self.name()]), self.name(), target, rng.choice([None, None, self.name()]) if target else None, "calls", line, "direct"))
        self.files[path] = (uuid.uuid4().hex, symbols, refs)

    def tables(self, spark, paths=None):
        own = [self.files[p] for p in (self.files if paths is None else paths) if p in self.files]
        return spark.createDataFrame([s for f in own for s in f[1]], SYMBOLS), spark.createDataFrame([r for f in own for r in f[2]], REFS)

    def read(self, spark, paths):
        rows = [(p, self.files[p][0], len(self.files[p][1]), None) if p in self.files else (p, None, 0, None) for p in paths]
        return spark.createDataFrame(rows, READ)

    def edges(self, spark):
        symbols, refs = self.tables(spark)
        return rows(resolve.resolve_named_refs(refs, symbols).select(*EDGE))


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def new_store(spark, tree, **kw):
    store = stored.StoredGraph(spark, f"graph_{uuid.uuid4().hex[:12]}", **kw)
    return store.create(*tree.tables(spark), tree.read(spark, list(tree.files)).drop("error"))


def test_updates_equal_a_rebuild(spark):
    tree = Tree(1, 25, 30)
    store = new_store(spark, tree, parts=8, buckets=2)
    assert rows(store.references.select(*EDGE)) == tree.edges(spark)
    for step in range(3):
        paths = tree.rng.sample(tree.paths, tree.rng.randint(1, 4))
        for p in paths:
            if step == 1:
                tree.files.pop(p, None)
            else:
                tree.write(p)
        store.update(tree.read(spark, paths), *tree.tables(spark, paths))
        assert rows(store.references.select(*EDGE)) == tree.edges(spark), step
        symbols, refs = tree.tables(spark)
        assert rows(store.symbols.select("id", "name")) == rows(symbols.select("id", "name"))
        assert rows(store.table("refs").select(*stored.REF_KEY)) == rows(refs.select(*stored.REF_KEY))
        assert rows(store.table("names").drop("part")) == rows(store.names_of(symbols))
        assert {r["path"]: r["content_hash"] for r in store.files.collect()} == {p: f[0] for p, f in tree.files.items()}
    # The same in one job over everything.
    paths = tree.paths[:2]
    before = maintain.State(*tree.tables(spark), store.files)
    for p in paths:
        tree.write(p)
    after = maintain.reindex(before, tree.read(spark, paths), *tree.tables(spark, paths))
    store.update(tree.read(spark, paths), *tree.tables(spark, paths))
    assert rows(store.references.select(*EDGE)) == rows(after.references.select(*EDGE))


def test_what_is_read_follows_the_change(spark):
    small, large = Tree(2, 40, 4000), Tree(2, 400, 40000)
    found = []
    for tree in (small, large):
        store = new_store(spark, tree, parts=128, buckets=1)
        tree.write(tree.paths[0])
        found.append(store.update(tree.read(spark, tree.paths[:1]), *tree.tables(spark, tree.paths[:1])))
        assert store.update(tree.read(spark, tree.paths[:3]), *tree.tables(spark, tree.paths[:3])) == stored.Touched()  # hashes are equal
    for touched in found:
        assert touched.files == 1 and touched.names <= 12 and touched.references <= 12 and touched.targets <= 12 and touched.resolved <= 20


def test_joins_on_ids_need_no_exchange(spark):
    store = new_store(spark, Tree(3, 30, 10), parts=4, buckets=4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = store.calls_to("n1")._jdf.queryExecution().executedPlan().toString()
        assert "Join" in plan and "Exchange" not in plan
        calls, own = store.references.where("ref_kind = 'calls'"), store.symbols
        want = calls.join(own.where("name = 'n1'").selectExpr("id as target_symbol_id"), "target_symbol_id").select("source_symbol_id", "target_symbol_id")
        assert rows(store.calls_to("n1").select("source_symbol_id", "target_symbol_id")) == rows(want) != []
        assert store.callers("n1").count() <= store.calls_to("n1").count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    scan = store._at("symbols", [1])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(part" in scan


def test_an_update_that_was_cut_off_is_finished_and_an_epoch_applied_once(spark, monkeypatch):
    tree = Tree(4, 12, 8)
    store = new_store(spark, tree, parts=4, buckets=1)
    paths = tree.paths[:3]
    for p in paths:
        tree.write(p)
    put, calls = stored.StoredGraph._put_partitions, []

    def fails(self, name, *a):
        calls.append(name)
        if len(calls) == 3:
            raise RuntimeError("lost")
        return put(self, name, *a)

    monkeypatch.setattr(stored.StoredGraph, "_put_partitions", fails)
    with pytest.raises(RuntimeError):
        store.update(tree.read(spark, paths), *tree.tables(spark, paths), epoch=7)
    monkeypatch.setattr(stored.StoredGraph, "_put_partitions", put)
    assert store.epoch() == -1 and rows(store.references.select(*EDGE)) != tree.edges(spark)
    # The same epoch comes again, with other rows: it had begun, so it is finished as it was.
    assert store.update(tree.read(spark, paths[:1]), *tree.tables(spark, paths[:1]), epoch=7) == stored.Touched()
    assert store.epoch() == 7 and rows(store.references.select(*EDGE)) == tree.edges(spark)
    # An update that fails before its note is there leaves all as it was.
    tree.write(paths[0])
    monkeypatch.setattr(stored.StoredGraph, "_commit", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        store.update(tree.read(spark, paths[:1]), *tree.tables(spark, paths[:1]), epoch=8)
    monkeypatch.undo()
    assert store.epoch() == 7 and not store.recover()
    store.update(tree.read(spark, paths[:1]), *tree.tables(spark, paths[:1]), epoch=8)
    assert store.epoch() == 8 and rows(store.references.select(*EDGE)) == tree.edges(spark)


def test_deletion_and_reset(spark):
    tree = Tree(5, 10, 6)
    store = new_store(spark, tree, parts=4, buckets=1)
    gone = tree.paths[:4]
    for p in gone:
        tree.files.pop(p)
    store.delete(spark.createDataFrame([(p,) for p in gone], "path string"))
    assert rows(store.references.select(*EDGE)) == tree.edges(spark)
    assert {r["path"] for r in store.files.collect()} == set(tree.files)
    store.reset()
    assert store.symbols.count() == store.references.count() == store.files.count() == 0


def test_rows_that_break_a_rule_are_refused(spark):
    tree = Tree(10, 4, 4)
    store = new_store(spark, tree, parts=2, buckets=1)
    before = rows(store.symbols.select("id"))
    tree.files[tree.paths[0]] = ("new", [(999, None, "module", tree.paths[0], 1, None, "")], [])
    with pytest.raises(ValidationError, match=r"symbol_kind \(1\), symbol_name \(1\)"):
        store.update(tree.read(spark, tree.paths[:1]), *tree.tables(spark, tree.paths[:1]))
    assert rows(store.symbols.select("id")) == before


def test_imports_of_either_side(spark):
    tree = Tree(11, 9, 5)
    store = new_store(spark, tree, parts=4, buckets=1)
    pairs = {(a, b) for a in tree.paths for b in tree.paths if a != b and tree.rng.random() < 0.4}
    frame = lambda rows: spark.createDataFrame(sorted(rows), "source_file string, target_file string")
    store.create(*tree.tables(spark), tree.read(spark, list(tree.files)).drop("error"), frame(pairs))
    changed, gone = tree.paths[:2], tree.paths[2:4]
    for p in changed:
        tree.write(p)
    fresh = {(changed[0], tree.paths[5]), (changed[1], tree.paths[3]), (tree.paths[6], changed[0])}  # the last is none of theirs
    store.update(tree.read(spark, changed), *tree.tables(spark, changed), frame(fresh | {(changed[0], tree.paths[5])}))
    pairs = {p for p in pairs if p[0] not in changed} | {p for p in fresh if p[0] in changed}
    for name in ("imports", "importers"):
        assert rows(store.table(name).select("source_file", "target_file")) == sorted(pairs)
    for p in gone:
        tree.files.pop(p)
    store.delete(spark.createDataFrame([(p,) for p in gone], "path string"))
    pairs = {p for p in pairs if p[0] not in gone and p[1] not in gone}
    for name in ("imports", "importers"):
        assert rows(store.table(name).select("source_file", "target_file")) == sorted(pairs)
    path = tree.paths[5]
    want = [(path, "imports_from", b) for a, b in pairs if a == path] + [(path, "imported_by", a) for a, b in pairs if b == path]
    assert rows(store.related_files(path)) == sorted(want, key=str)
    tree.write(path)
    store.update(tree.read(spark, [path]), *tree.tables(spark, [path]))  # without imports those of the file stay
    assert rows(store.table("imports").select("source_file", "target_file")) == sorted(pairs)
