"""Graph operators on small hand-made tables, and against plain Python."""

import random

import pytest

from symloom import schema
from symloom.functions import text
from symloom.functions.text import like_any_case
from symloom.operators import lookup, maintain, resolve, traverse
from symloom.sources import projects
from symloom.streaming import feed

S = "id long, name string, kind string, file_path string, line int, parent_id long, signature string, modifiers string"


@pytest.fixture(scope="module")
def symbols(spark):
    rows = [(1, "Animal", "interface", "/p/a.ts", 1, None), (2, "Dog", "class", "/p/a.ts", 5, None), (3, "speak", "method", "/p/a.ts", 6, 2), (4, "Cat", "class", "/p/b.ts", 1, None), (5, "speak", "method", "/p/b.ts", 2, 4), (6, "greet", "function", "/p/c.ts", 1, None), (7, "speak_up", "function", "/p/c.ts", 9, None)]
    return spark.createDataFrame([(*r, None, "") for r in rows], S)


@pytest.fixture(scope="module")
def references(spark):
    rows = [(6, 3, "calls", 2, "direct"), (6, 3, "calls", 3, "weak"), (7, 5, "calls", 9, "direct"), (5, 3, "calls", 3, "direct"), (2, 1, "implements", 5, "direct"), (4, 2, "extends", 1, "direct"), (4, 1, "implements", 1, "direct")]
    return spark.createDataFrame(rows, schema.REFERENCES)


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols or df.columns) for r in df.collect())


def test_lookup(symbols):
    assert rows(lookup.find_symbol(symbols, "speak"), "id") == [(3,), (5,)]
    assert rows(lookup.search_symbols(symbols, "SPEAK_"), "id") == [(7,)]
    assert rows(lookup.search_symbols(symbols, "k_u", literal=True), "id") == [(7,)]
    assert rows(lookup.members(symbols, "Dog"), "name") == [("speak",)]
    assert symbols.where(like_any_case(symbols.name, "a\\b")).count() == 0
    with pytest.raises(schema.ValidationError):
        lookup.search_symbols(symbols, "x", limit=0)
    with pytest.raises(schema.ValidationError):
        lookup.find_symbol(symbols, "x", "nothing")


def test_callers_and_hierarchy(symbols, references):
    found = lookup.callers(symbols, references)
    assert rows(found.where("caller_name = 'greet'"), "symbol_name", "line", "confidence") == [("speak", 1, "direct")]
    assert rows(lookup.callers(symbols, references, class_name="Cat"), "caller_name") == [("speak_up",)]
    assert rows(lookup.implementations(symbols, references, "Animal"), "class_name") == [("Cat",), ("Dog",)]
    assert rows(lookup.hierarchy(symbols, references, "Dog"), "relation", "name") == [("extended_by", "Cat"), ("implements", "Animal")]
    assert [r["score"] for r in lookup.write_targets(symbols, references, "Animal").collect()] == [100, 75, 75]


def test_resolution_takes_only_unique_targets(spark, symbols):
    refs = [("greet", "/p/c.ts", None, "speak", None, None), ("greet", "/p/c.ts", None, "speak", "/p/a.ts", None), ("<file>", "/p/c.ts", None, "Dog", None, None), ("gone", "/p/c.ts", None, "Dog", None, None), ("speak", "/p/b.ts", "Cat", "speak", "/p/a.ts", "Dog")]
    df = spark.createDataFrame([(*r, "calls", 1, "direct") for r in refs], schema.NAMED_REFS)
    assert rows(resolve.resolve_named_refs(df, symbols), "source_symbol_id", "target_symbol_id") == [(5, 3), (6, 2), (6, 3)]
    assert resolve.resolve_named_refs(df, symbols, keep_unresolved=True).count() == 2


def test_maintenance(spark, symbols, references):
    kept, edges = maintain.delete_files(symbols, references, spark.createDataFrame([("/p/a.ts",)], "file_path string"))
    assert rows(kept, "id") == [(4,), (5,), (6,), (7,)]
    assert rows(edges, "source_symbol_id") == [(7,)]
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, None)], "k string, n int, v string")
    assert sorted((r.k, r.n, r.v) for r in maintain.last_wins(df, ["k"], "n").collect()) == [("a", 2, "y"), ("b", 1, None)]
    assert {r["rule"]: r["violations"] for r in schema.validate(symbols, references).collect()}["ref_kind"] == 0


def test_edges_and_imports_of_files(spark, symbols, references):
    one = lambda c: spark.createDataFrame([(c,)], "file_path string")
    assert rows(maintain.delete_file_references(symbols, references, one("/p/b.ts")), "source_symbol_id") == [(2,), (6,), (6,), (7,)]
    pairs = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d")], schema.FILE_IMPORTS)
    assert rows(maintain.delete_file_imports(pairs, one("b"))) == [("c", "d")]
    assert maintain.insert_edges(references, references).count() == 14


def test_reindex_is_like_building_anew(spark, symbols):
    """Only files that changed are taken, failed ones keep what they had, and all edges follow the new symbols."""
    refs = [("greet", "/p/c.ts", None, "speak", "/p/a.ts", None), ("speak", "/p/b.ts", "Cat", "speak", "/p/a.ts", "Dog"), ("speak_up", "/p/c.ts", None, "Cat", None, None), ("Dog", "/p/a.ts", None, "Animal", None, None)]
    refs = spark.createDataFrame([(*r, "calls", 1, "direct") for r in refs], schema.NAMED_REFS)
    files = spark.createDataFrame([("/p/a.ts", "1", 3), ("/p/b.ts", "2", 2), ("/p/c.ts", "3", 2)], "path string, content_hash string, symbol_count long")
    state = maintain.State(symbols, refs, files)
    read = spark.createDataFrame([("/p/a.ts", "9", 2, None), ("/p/b.ts", "2", 2, None), ("/p/c.ts", "8", 2, "cannot be parsed"), ("/p/d.ts", "7", 1, None)], "path string, content_hash string, symbol_count long, error string")
    fresh = spark.createDataFrame([(11, "Dog", "class", "/p/a.ts", 1, None, None, ""), (12, "speak", "method", "/p/a.ts", 2, 11, None, ""), (13, "Cat", "class", "/p/d.ts", 1, None, None, ""), (99, "wrong", "class", "/p/c.ts", 1, None, None, ""), (98, "wrong", "class", "/p/b.ts", 1, None, None, "")], S)
    new_refs = spark.createDataFrame([("Cat", "/p/d.ts", None, "Dog", "/p/a.ts", None, "extends", 1, "direct"), ("greet", "/p/c.ts", None, "wrong", None, None, "calls", 1, "direct")], schema.NAMED_REFS)
    after = maintain.reindex(state, read, fresh, new_refs)
    assert rows(after.symbols, "id") == [(4,), (5,), (6,), (7,), (11,), (12,), (13,)]
    assert rows(after.errors) == [("/p/c.ts", "cannot be parsed")]
    assert rows(after.files) == [("/p/a.ts", "9", 2), ("/p/b.ts", "2", 2), ("/p/c.ts", "3", 2), ("/p/d.ts", "7", 1)]
    # Cat is ambiguous now, Animal is gone, the member and the function go to the new method.
    assert rows(after.references, "source_symbol_id", "target_symbol_id") == [(5, 12), (6, 12), (13, 11)]
    again = maintain.reindex(maintain.State(after.symbols, after.named_refs, after.files), read.where("error is null"), fresh, new_refs)
    assert rows(again.references) == rows(after.references) and rows(again.symbols, "id") == rows(after.symbols, "id")
    nothing = maintain.reset(after)
    assert [df.count() for df in (nothing.symbols, nothing.named_refs, nothing.files, nothing.references, nothing.errors)] == [0] * 5 and nothing.symbols.columns == after.symbols.columns


def test_reachable_like_plain_search(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(40), rng.randrange(40), "calls", 1, "direct") for _ in range(70)]
    found = {r["id"]: r["depth"] for r in traverse.reachable(spark.createDataFrame(edges, schema.REFERENCES), spark.createDataFrame([(0,)], "id long"), 3).collect()}
    want, front = {0: 0}, {0}
    for level in (1, 2, 3):
        front = {b for a, b, *_ in edges if a in front} - want.keys()
        want |= dict.fromkeys(front, level)
    assert found == want


def test_flow(spark, symbols, references):
    flow = lambda depth, **seed: [(r["path_rank"], r["hops"], r["path"]) for r in traverse.explain_flow(symbols, references, traverse.seeds_of(symbols, **seed), depth).collect()]
    assert flow(9, symbol_name="speak_up") == [(1, 3, "speak_up -> speak -> speak")]
    assert flow(1, symbol_name="speak_up") == [(1, 1, "speak_up")]
    # The class is left out of what a member's seed goes on from: the first symbol of its name in its file.
    assert flow(3, symbol_name="speak", class_name="Cat") == [(1, 2, "speak -> speak")]
    assert flow(3, file_path="/p/c.ts") == [(1, 2, "greet -> speak"), (2, 3, "speak_up -> speak -> speak")]
    assert flow(3, file_path="/p/none.ts") == [(1, 1, "none.ts")]
    assert flow(3, symbol_name="nothing") == []
    assert traverse.clamped(9) == (4, ["max_depth capped at 4 (requested 9)"]) and traverse.clamped(0) == (1, [])
    for wrong in ({}, {"symbol_name": "a", "file_path": "b"}):
        with pytest.raises(schema.ValidationError):
            traverse.seeds_of(symbols, **wrong)


def test_flow_that_leads_back(spark):
    names = spark.createDataFrame([(i, n, "function", "/p/x.ts", i, None, None, "") for i, n in enumerate("abc", 1)], S)
    edges = spark.createDataFrame([(1, 1, "calls", 1, "direct"), (2, 3, "calls", 1, "direct"), (3, 2, "calls", 1, "direct")], schema.REFERENCES)
    flow = lambda n: [r["path"] for r in traverse.explain_flow(names, edges, traverse.seeds_of(names, symbol_name=n), 4).collect()]
    assert flow("a") == ["a"] and flow("b") == ["b"]


def test_write_targets_and_members(symbols, references):
    found = lookup.write_targets(symbols, references, "speak", class_name="Cat").collect()
    assert [(r["reason"], r["symbol"], r["kind"]) for r in found] == [("declaration", "speak", "method"), ("caller", "speak_up", "function")]
    assert [(r["reason"], r["symbol"]) for r in lookup.write_targets(symbols, references, "Dog").collect()] == [("declaration", "Dog"), ("subclass", "Cat")]
    assert rows(lookup.class_members(symbols), "class_name", "members") == [("Cat", ["speak"]), ("Dog", ["speak"])]
    assert rows(lookup.counts(symbols=symbols, references=references)) == [("references", 7), ("symbols", 7)]
    some = symbols.sparkSession.createDataFrame([("Zoo",), ("apple",), ("Äpfel",), ("Apple",)], "name string")
    assert [r["name"] for r in lookup.collated(some, "name").collect()] == ["Äpfel", "apple", "Apple", "Zoo"]


def test_feed(spark):
    df = spark.createDataFrame([("a", 0.0, "add"), ("a", 0.3, "change"), ("a", 0.7, "unlink"), ("b", 1.0, "add")], "path string, t double, op string").selectExpr("path", "timestamp_micros(cast(t * 1000000 as long)) as ts", "op")
    assert sorted((r["path"], r["n"]) for r in feed.debounce(df, "path", "ts", 0.3).collect()) == [("a", 1), ("a", 2), ("b", 1)]
    assert [r["path"] for r in feed.latest_state(df, "path", ["ts"], "op", "unlink").collect()] == ["b"]


def test_stream_updates(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, "add"), ("a", 2, "unlink"), ("b", 1, "add")], "path string, t long, op string").selectExpr("path", "timestamp_seconds(t) as ts", "op", "cast(null as string) as content")
    df.write.parquet(str(tmp_path / "in"))
    seen = []
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    feed.run_updates(stream, lambda batch, _: seen.extend((r["path"], r["op"]) for r in batch.collect()), str(tmp_path / "ck")).awaitTermination(60)
    assert sorted(seen) == [("a", "unlink"), ("b", "add")]


def test_project_imports(spark, tmp_path):
    (tmp_path / "src/lib").mkdir(parents=True)
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "node_modules/x.ts").write_text("")
    (tmp_path / "src/a.ts").write_text("import { b } from './lib/b'\nimport './side'\nimport c from '@lib/b'\n")
    (tmp_path / "src/lib/b.ts").write_text("export const b = 1\n")
    files = projects.read_project(spark, str(tmp_path))
    assert files.count() == 2
    base = f"file:{tmp_path}/src"
    aliases = spark.createDataFrame([(0, "@lib/*", f"{base}/lib/*")], "turn int, pattern string, target string")
    pairs = projects.resolve_imports(projects.import_specifiers(files), files, aliases).collect()
    assert [(r["source_file"].rpartition("/")[2], r["target_file"].rpartition("/")[2]) for r in pairs] == [("a.ts", "b.ts")]


def test_import_candidates_in_order(spark, tmp_path):
    """Of several files that a specifier may mean: .ts, /index.ts, .tsx, /index.tsx; the bare name only by an alias."""
    have = ["/r/x/index.ts", "/r/x.tsx", "/r/y.tsx", "/r/y/index.tsx", "/r/z.css", "/r/w", "/r/lib/k.ts", "/r/lib2/k.ts", "/r/one.ts", "/r/deep/k/index.ts"]
    files = spark.createDataFrame([(p,) for p in have], "path string")
    asked = ["./x", "./y", "./z.css", "./w", "@/w", "@/k", "~one", "~on", "react", "../r/./x", "@"]
    imports = spark.createDataFrame([("/r/a.ts", s) for s in asked], "path string, specifier string")
    (tmp_path / "settings.json").write_text('{"compilerOptions": {"paths": {"~one": ["none", "one"], "@/*": ["lib2/*", "lib/*", "deep/*", "*"]}}}')
    aliases = projects.read_aliases(spark, str(tmp_path / "settings.json"), "/r")
    found = {r["specifier"]: r["target_file"] for r in projects.resolve_imports(imports, files, aliases, with_specifier=True).collect()}
    assert found == {"./x": "/r/x/index.ts", "./y": "/r/y.tsx", "@/w": "/r/w", "@/k": "/r/lib2/k.ts", "~one": "/r/one.ts", "../r/./x": "/r/x/index.ts"}
    (tmp_path / "broken.json").write_text("{")
    assert projects.read_aliases(spark, str(tmp_path / "broken.json"), "/r").count() == 0


def test_import_map_and_local_names(spark):
    source = "import Def, { A, B as C, type T } from './one'\nimport { A } from './two'\nimport type { U } from './one'\nimport './side'\nimport * as ns from './one'\n"
    names = projects.imported_names(spark.createDataFrame([("/r/a.ts", source), ("/r/b.ts", "")], "path string, content string"))
    assert rows(names, "position", "specifier", "name") == [(0, "./one", "A"), (0, "./one", "B"), (0, "./one", "Def"), (0, "./one", "T"), (1, "./two", "A"), (2, "./one", "U")]
    placed = names.selectExpr("path as source_file", "position", "name", "concat('/r/', substring(specifier, 3), '.ts') as target_file")
    known = projects.import_map(placed)
    assert rows(known.where("name = 'A'"), "target_file") == [("/r/two.ts",)]
    refs = spark.createDataFrame([("/r/a.ts", "A"), ("/r/a.ts", "local"), ("/r/a.ts", "none"), ("/r/b.ts", "A")], "source_file string, target_name string")
    declared = spark.createDataFrame([("/r/a.ts", "local"), ("/r/a.ts", "A"), ("/r/c.ts", "none")], "file_path string, name string")
    assert rows(projects.target_files(refs, known, declared).fillna("-"), "source_file", "target_name", "target_file") == [("/r/a.ts", "A", "/r/two.ts"), ("/r/a.ts", "local", "/r/a.ts"), ("/r/a.ts", "none", "-"), ("/r/b.ts", "A", "-")]


def test_text_functions(spark):
    df = spark.createDataFrame([("app.get", "/blog/[slug]/[...rest]", "project://a%20b", "this.go()", "Ns.Deco()", "'x'"), ("app.listen", "/", "http://x", "go(other)", "Deco", '"y"')], "c string, p string, u string, t string, d string, q string")
    got = df.select(text.route_method(df.c), text.route_segments(df.p), text.resource_name(df.u, "project"), text.calls_own(df.t), text.decorator_name(df.d), text.unquoted(df.q)).collect()
    assert tuple(got[0]) == ("get", [("blog", False), ("slug", True), ("rest", True)], "a b", True, "Deco", "x")
    assert tuple(got[1]) == (None, [], None, False, "Deco", "y")


def test_debounced_stream(spark, tmp_path):
    """A burst fires once, with its last operation, when the watermark has passed its end."""
    feed_rows = [("a", 0, "add"), ("a", 200, "change"), ("b", 100, "add"), ("a", 900, "unlink"), ("z", 60_000, "add")]
    spark.createDataFrame(feed_rows, "path string, ms long, op string").selectExpr("path", "timestamp_millis(ms) as ts", "op").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("path string, ts timestamp, op string").parquet(str(tmp_path / "in"))
    run = feed.debounced_stream(stream).writeStream.format("memory").queryName("fired").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    assert run.awaitTermination(90)
    assert rows(spark.table("fired").selectExpr("path", "unix_millis(fire_ts) as ms", "op")) == [("a", 500, "change"), ("a", 1200, "unlink"), ("b", 400, "add")]


def test_entry_names():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
