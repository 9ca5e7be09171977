"""Search by grams, the trie of prefixes, imports in true code, recursive queries and the order of names, against plain Python."""

import random
import re

from pyspark.sql import functions as F

from symloom.operators import lookup, search, traverse
from symloom.sources import projects

S = "id long, name string, kind string, file_path string, line int"


def test_search_of_many_patterns(spark):
    rng = random.Random(1)
    names = ["".join(rng.choice("abcAB_%é\\' ") for _ in range(rng.randint(0, 12))) for _ in range(300)] + [None]
    symbols = [(i, n, "function", "/f", i) for i, n in enumerate(names)]
    df = spark.createDataFrame(symbols, S)
    patterns = ["".join(rng.choice("abcAB_%é\\'") for _ in range(rng.randint(0, 6))) for _ in range(120)] + [None, "", "%", "__", "ABC", "abc", "%%%%", "\\"]
    wanted = spark.createDataFrame([(p,) for p in patterns + patterns[:5]], "pattern string")
    for literal in (False, True):
        want = set()
        for p in {p for p in patterns if p is not None}:
            own = "".join(".*" if c == "%" and not literal else "." if c == "_" and not literal else re.escape(c) for c in p.lower())
            hits = [i for i, n in enumerate(names) if n is not None and re.search(own, n.lower(), re.S)]
            want |= {(p, i) for i in hits[:7]}
        found = search.search_many(df, wanted, 7, literal)
        assert {(r["pattern"], r["id"]) for r in found.collect()} == want
    assert search.search_many(df, wanted, None).count() > search.search_many(df, wanted, 7).count()
    assert search.search_many(df, wanted.limit(0)).count() == 0


def test_candidates_follow_the_rarest_gram(spark):
    names = spark.createDataFrame([(i, f"common_{i:05d}" + ("_rare" if i == 77 else ""), "function", "/f", i) for i in range(2000)], S)
    found = search.search_many(names, spark.createDataFrame([("common_00077_rare",), ("mon%rar",)], "pattern string"))
    assert {(r["pattern"], r["id"]) for r in found.collect()} == {("common_00077_rare", 77), ("mon%rar", 77)}


def test_longest_prefix(spark):
    rng = random.Random(2)
    path = lambda n: "".join(rng.choice(["/", "a", "b", "/a", "/ab/"]) for _ in range(rng.randint(0, n)))
    routes, prefixes = [path(10) for _ in range(400)] + [None], [path(6) for _ in range(120)] + [None, "/", "zz"]
    found = search.longest_prefix(spark.createDataFrame([(i, r) for i, r in enumerate(routes)], "id long, route string"), spark.createDataFrame([(p,) for p in prefixes], "prefix string"))
    best = {i: max((p for p in prefixes if p is not None and r.startswith(p)), key=len, default=None) for i, r in enumerate(routes) if r is not None}
    assert {r["id"]: r["prefix"] for r in found.collect()} == {i: p for i, p in best.items() if p is not None}


CODE = r"""import a, {b as c, type D} from './one';
import "./side"; // import x from './no'
/* import y from "./no" */
const s = "import z from './no'", t = 'it\'s import q from "./no"';
const u = `import r from './no' ${f("import './no'", `import './no'`)} ${ {a: 1} } import './no'`;
import /* why */ * as ns /* not './no' */ from "./two";
const re = /['"`]/; import type { T } from './three'
const m = import('./no'); import eq = require('./no'); x.import './no'; important './no';
<p>don't</p>
import {
  long, // './no'
  names
} from "./four";
import
  last
from
  './five'
"""


def test_imports_of_true_code_only(spark):
    df = spark.createDataFrame([("p", CODE), ("q", ""), ("r", None), ("s", "// import './no'"), ("t", "`unclosed import './t'")], "path string, content string")
    assert {(r["path"], r["specifier"]) for r in projects.import_specifiers(df).collect()} == {("p", f"./{x}") for x in ("one", "side", "two", "three", "four", "five")} | {("t", "./t")}
    names = {(r["specifier"], r["name"]) for r in projects.imported_names(df).collect()}
    assert names == {("./one", "a"), ("./one", "b"), ("./one", "D"), ("./three", "T"), ("./four", "long"), ("./four", "names"), ("./five", "last")}


def test_long_units_need_no_deep_stack(spark):
    big = 'x = "' + 'a\\"' * 200_000 + '"; /*' + 'import "./no"\n' * 50_000 + '*/ import "./yes"; `' + "y${1}" * 50_000 + '`; import "./end"'
    found = projects.import_specifiers(spark.createDataFrame([("p", big)], "path string, content string"))
    assert [r["specifier"] for r in found.collect()] == ["./yes", "./end"]


def test_recursive_query_equals_levels(spark):
    rng = random.Random(3)
    edges = [(i, rng.randrange(max(0, i - 4), i), "extends", 1, "direct") for i in range(1, 60)] + [(0, 5, "extends", 1, "direct"), (1, 2, "calls", 1, "direct")]
    refs = spark.createDataFrame(edges, "source_symbol_id long, target_symbol_id long, ref_kind string, source_line int, confidence string")
    seeds = spark.createDataFrame([(59,), (40,), (59,)], "id long")
    for depth in (0, 3, 10):
        shown = lambda df: sorted(map(tuple, df.collect()))
        assert shown(traverse.reachable_sql(refs, seeds, depth, "extends")) == shown(traverse.reachable(refs, seeds, depth, "extends"))


def test_order_of_names(spark):
    names = ["Zebra", "apple", "Äpfel", "Apple", "zebra", "éa", "eb", "ea", "apple"]
    found = lookup.collated(spark.createDataFrame([(n,) for n in names], "name string"), "name")
    assert [r["name"] for r in found.collect()] == ["Äpfel", "apple", "apple", "Apple", "ea", "éa", "eb", "zebra", "Zebra"]
    symbols = spark.createDataFrame([(i, "f", "function", f"/{n}", 1, None, None, "") for i, n in enumerate(names[:-1])], "id long, name string, kind string, file_path string, line int, parent_id long, signature string, modifiers string")
    refs = spark.createDataFrame([], "source_symbol_id long, target_symbol_id long, ref_kind string, source_line int, confidence string")
    targets = lookup.write_targets(symbols, refs, "f", 25).select(F.substring("file_path", 2, 9).alias("n")).collect()
    assert [r["n"] for r in targets] == ["Äpfel", "apple", "Apple", "ea", "éa", "eb", "zebra", "Zebra"]
