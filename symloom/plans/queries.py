"""The registered queries over the graph and the other tables, and the same in SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from symloom.functions.text import ROUTE_METHODS, calls_own, decorator_name, hrefs, last_segment, resource_name, route_method, route_segments, shown_value, signature_line, unquoted
from symloom.operators import lookup, maintain, resolve, search, stored, traverse
from symloom.plans.graph import Graph, IMPORTS_SQL, MIXED_SQL, NAMED_SQL, RESOLVED_SQL, RULES_SQL, load, mixed_refs, named_refs, with_graph
from symloom.schema import validate, validate_keys
from symloom.shared import new_folder
from symloom.sources import listing, projects
from symloom.streaming import feed, timers

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

SHOWN_SQL = "id, name, kind, file_path, line, NULL::VARCHAR AS signature, modifiers"
RESOLUTION = (NAMED_SQL, RESOLVED_SQL)


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query(with_graph(f"SELECT {SHOWN_SQL} FROM symbols WHERE name = 'supply_3'"))
def find_symbol(spark, sf_dir):
    return lookup.find_symbol(load(spark, sf_dir).symbols, "supply_3")


@query(with_graph(f"SELECT {SHOWN_SQL} FROM symbols WHERE name = 'small ring' AND kind = 'function'"))
def find_symbol_kind(spark, sf_dir):
    return lookup.find_symbol(load(spark, sf_dir).symbols, "small ring", "function")


@query(with_graph(f"SELECT {SHOWN_SQL} FROM symbols WHERE name ILIKE '%ri_g%' ORDER BY id LIMIT 20"))
def search_symbols(spark, sf_dir):
    return lookup.search_symbols(load(spark, sf_dir).symbols, "ri_g")


@query(with_graph(f"SELECT {SHOWN_SQL} FROM symbols WHERE name ILIKE '%1%' AND kind = 'method' ORDER BY id LIMIT 100"))
def search_symbols_kind_limit(spark, sf_dir):
    return lookup.search_symbols(load(spark, sf_dir).symbols, "1", "method", 100)


#: Patterns of every length, with wildcards, quotes, backslashes and capitals, beside those that come from the tables.
PATTERNS = ("ri_g", "R%3", "%", "_", "a", "#0", "", "zzz", "O'x", "\\\\", "b__e")
PATTERNS_SQL = "patterns AS (SELECT DISTINCT substr(n_name, 3, 6) AS pattern FROM nation UNION SELECT DISTINCT substr(p_name, 2, 5) FROM part UNION SELECT unnest([" + ", ".join("'" + p.replace("'", "''") + "'" for p in PATTERNS) + "]))"


def patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = read(spark, sf_dir, "nation").select(F.substring("n_name", 3, 6).alias("pattern")).union(read(spark, sf_dir, "part").select(F.substring("p_name", 2, 5)))
    return own.union(spark.createDataFrame([(p,) for p in PATTERNS], "pattern string"))


FOUND_SQL = "SELECT pattern, id, name, kind, file_path, line FROM (SELECT *, row_number() OVER (PARTITION BY pattern ORDER BY id) AS n FROM patterns JOIN symbols ON {test}) WHERE n <= 20"


@query(with_graph(FOUND_SQL.format(test="lower(name) LIKE '%' || replace(lower(pattern), chr(92), chr(92) || chr(92)) || '%' ESCAPE chr(92)"), PATTERNS_SQL))
def search_many(spark, sf_dir):
    return search.search_many(load(spark, sf_dir).symbols, patterns(spark, sf_dir))


@query(with_graph(FOUND_SQL.format(test="contains(lower(name), lower(pattern))"), PATTERNS_SQL))
def search_many_literal(spark, sf_dir):
    return search.search_many(load(spark, sf_dir).symbols, patterns(spark, sf_dir), literal=True)


WORDS_SQL = r"words AS (SELECT DISTINCT w FROM (SELECT unnest(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS w FROM documents) WHERE length(w) < 8)"


@query("WITH " + WORDS_SQL + " SELECT w AS name, row_number() OVER (ORDER BY w COLLATE en, w)::INT AS place FROM words ORDER BY place LIMIT 200")
def names_in_order(spark, sf_dir):
    """The first short words of the documents in the order of names, accents and capitals included."""
    words = read(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))).alias("name")).where("length(name) < 8").distinct()
    first = lookup.collated(words, "name").limit(200)
    return first.withColumn("place", F.row_number().over(Window.orderBy(*lookup.name_order("name"))))  # 200 rows


@query(with_graph("SELECT p.name AS class_name, c.id, c.name, c.kind, c.file_path, c.line, NULL::VARCHAR AS signature, c.modifiers FROM symbols c JOIN symbols p ON c.parent_id = p.id AND p.kind = 'class'"))
def get_methods(spark, sf_dir):
    return lookup.members(load(spark, sf_dir).symbols)


@query(with_graph(f"SELECT {SHOWN_SQL} FROM symbols WHERE file_path = '/proj/region_1.ts' AND kind = 'method'"))
def get_file_symbols(spark, sf_dir):
    return lookup.get_file_symbols(load(spark, sf_dir).symbols, "/proj/region_1.ts", "method")


@query(with_graph("SELECT c.id, c.name, c.kind, c.file_path, c.line, NULL::VARCHAR AS signature, c.modifiers FROM symbols c JOIN symbols p ON c.parent_id = p.id AND p.kind = 'class' WHERE c.name = 'supply_3' AND p.name = 'NATION_14'"))
def symbols_by_name_and_class(spark, sf_dir):
    return lookup.by_name_and_class(load(spark, sf_dir).symbols, "supply_3", "NATION_14")


CALLERS_SQL = """
SELECT symbol_name, caller_name, caller_class, caller_file, line, confidence FROM (
  SELECT t.name AS symbol_name, s.name AS caller_name, p.name AS caller_class, s.file_path AS caller_file, s.line, r.confidence,
    row_number() OVER (PARTITION BY t.name, s.name, p.name, s.file_path, s.line ORDER BY r.target_symbol_id, r.source_line, r.confidence, r.source_symbol_id) AS n
  FROM refs r JOIN symbols t ON t.id = r.target_symbol_id JOIN symbols s ON s.id = r.source_symbol_id LEFT JOIN symbols p ON p.id = s.parent_id AND p.kind = 'class'
  WHERE r.ref_kind = 'calls' AND {where}) WHERE n = 1
"""


@query(with_graph(CALLERS_SQL.format(where="t.name = 'small ring'")))
def get_callers(spark, sf_dir):
    g = load(spark, sf_dir)
    return lookup.callers(g.symbols, g.references, g.symbols.where("name = 'small ring'").select(F.col("name").alias("symbol_name")))


@query(with_graph(CALLERS_SQL.format(where="t.name = 'supply_3' AND t.kind = 'method' AND t.parent_id IN (SELECT id FROM symbols WHERE kind = 'class' AND name = 'NATION_14')")))
def get_callers_class(spark, sf_dir):
    g = load(spark, sf_dir)
    return lookup.callers(g.symbols, g.references, g.symbols.where("name = 'supply_3'").select(F.col("name").alias("symbol_name")), "NATION_14")


@query(with_graph(CALLERS_SQL.format(where="true")))
def callers_all_batch(spark, sf_dir):
    g = load(spark, sf_dir)
    return lookup.callers(g.symbols, g.references)


@query(with_graph("SELECT DISTINCT t.name AS interface_name, s.name AS class_name, s.file_path, 0 AS line FROM refs JOIN symbols t ON t.id = target_symbol_id JOIN symbols s ON s.id = source_symbol_id WHERE ref_kind = 'implements'"))
def get_implementations(spark, sf_dir):
    g = load(spark, sf_dir)
    return lookup.implementations(g.symbols, g.references)


@query(
    with_graph("""
SELECT DISTINCT c.name AS class_name, x.relation, o.name, o.file_path, o.line FROM (
  SELECT source_symbol_id AS own, target_symbol_id AS other, ref_kind AS relation FROM refs WHERE ref_kind IN ('extends', 'implements')
  UNION ALL SELECT target_symbol_id, source_symbol_id, CASE ref_kind WHEN 'extends' THEN 'extended_by' ELSE 'implemented_by' END FROM refs WHERE ref_kind IN ('extends', 'implements')) x
JOIN symbols c ON c.id = x.own AND c.kind = 'class' JOIN symbols o ON o.id = x.other""")
)
def get_hierarchy(spark, sf_dir):
    g = load(spark, sf_dir)
    return lookup.hierarchy(g.symbols, g.references)


@query(with_graph("SELECT source_file AS file_path, 'imports_from' AS direction, target_file AS other_file FROM file_imports UNION ALL SELECT target_file, 'imported_by', source_file FROM file_imports", IMPORTS_SQL))
def get_related_files(spark, sf_dir):
    return lookup.related_files(load(spark, sf_dir).file_imports)


@query(with_graph("SELECT file_path AS path, count(*)::BIGINT AS symbol_count, sha256(string_agg(name, chr(10) ORDER BY id)) AS content_hash FROM symbols GROUP BY file_path"))
def resource_files(spark, sf_dir):
    return load(spark, sf_dir).files


@query(with_graph("SELECT DISTINCT name FROM symbols"))
def resource_symbols(spark, sf_dir):
    return load(spark, sf_dir).symbols.select("name").distinct().orderBy("name")


FULL_SQL = "SELECT id, name, kind, file_path, line, 0 AS \"column\", line AS end_line, parent_id, NULL::VARCHAR AS signature, modifiers, NULL::VARCHAR AS return_type, NULL::VARCHAR AS params, NULL::VARCHAR AS doc_comment FROM symbols WHERE "


@query(with_graph(FULL_SQL + "file_path = '/proj/Brand#2.ts'"))
def resource_file(spark, sf_dir):
    return load(spark, sf_dir).symbols.where("file_path = '/proj/Brand#2.ts'")


@query(with_graph(FULL_SQL + "name = 'blue bolt'"))
def resource_symbol(spark, sf_dir):
    return load(spark, sf_dir).symbols.where("name = 'blue bolt'")


@query(with_graph("SELECT id, name, kind, file_path, line, parent_id FROM symbols WHERE id IN (SELECT target_symbol_id FROM refs WHERE ref_kind IN ('extends', 'implements'))"))
def symbols_by_id(spark, sf_dir):
    g = load(spark, sf_dir)
    wanted = g.references.where(F.col("ref_kind").isin("extends", "implements")).select(F.col("target_symbol_id").alias("id"))
    return lookup.by_ids(g.symbols, wanted).select("id", "name", "kind", "file_path", "line", "parent_id")


@query(with_graph("SELECT source_symbol_id, s.name AS source_name, target_symbol_id, t.name AS target_name, t.file_path AS target_file, ref_kind, source_line, confidence FROM refs JOIN symbols s ON s.id = source_symbol_id JOIN symbols t ON t.id = target_symbol_id WHERE ref_kind = 'calls'"))
def outgoing_refs(spark, sf_dir):
    g = load(spark, sf_dir)
    return lookup.outgoing(g.symbols, g.references, "calls")


@query("WITH words AS (SELECT conv_id, turn, unnest(string_split(text, ' ')) AS target_name FROM conversations) SELECT DISTINCT conv_id, turn, target_name FROM words WHERE target_name IN (SELECT p_name FROM part UNION SELECT unnest(string_split(p_name, ' ')) FROM part UNION SELECT unnest(string_split(text, ' ')) FROM benchmark)")
def known_name_filter(spark, sf_dir):
    words = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.explode(F.split("text", " ")).alias("target_name")).distinct()
    part = read(spark, sf_dir, "part")
    known = part.select(F.col("p_name").alias("name")).union(part.select(F.explode(F.split("p_name", " ")))).union(read(spark, sf_dir, "benchmark").select(F.explode(F.split("text", " "))))
    return resolve.known_names(words, known)


@query(with_graph("SELECT source_symbol_id, target_symbol_id, 'calls' AS ref_kind, source_line, 'direct' AS confidence FROM resolved WHERE source_symbol_id IS NOT NULL AND target_symbol_id IS NOT NULL", *RESOLUTION))
def resolve_named_refs(spark, sf_dir):
    return resolve.resolve_named_refs(named_refs(spark, sf_dir), load(spark, sf_dir).symbols)


@query(with_graph("SELECT source_name, source_file, source_parent_name, target_name, target_file, NULL::VARCHAR AS target_parent_name, 'calls' AS ref_kind, source_line, 'direct' AS confidence FROM resolved WHERE source_symbol_id IS NULL OR target_symbol_id IS NULL", *RESOLUTION))
def unresolved_named_refs(spark, sf_dir):
    return resolve.resolve_named_refs(named_refs(spark, sf_dir), load(spark, sf_dir).symbols, keep_unresolved=True)


@query("SELECT user_id, event_type, event_id, value, props FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS n FROM events) WHERE n = 1")
def dedupe_last_wins(spark, sf_dir):
    return maintain.last_wins(read(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value", "props"), ["user_id", "event_type"], "event_id")


@query(with_graph("SELECT c.id, c.name, c.file_path, p.name AS parent_name, min(f.id) AS parent_id FROM symbols c JOIN symbols p ON p.id = c.parent_id JOIN symbols f ON f.file_path = c.file_path AND f.name = p.name GROUP BY ALL"))
def parent_link(spark, sf_dir):
    s = load(spark, sf_dir).symbols
    children = s.join(s.select(F.col("id").alias("parent_id"), F.col("name").alias("parent_name")), "parent_id").select("id", "name", "file_path", "parent_name")
    return resolve.parent_link(children, s)


@query(with_graph("SELECT source_symbol_id, target_symbol_id, ref_kind, source_line, confidence FROM refs WHERE source_symbol_id NOT IN (SELECT id FROM gone) AND target_symbol_id NOT IN (SELECT id FROM gone)", "gone AS (SELECT id FROM symbols WHERE file_path IN (SELECT file_path FROM symbols WHERE name = 'NATION_3'))"))
def delete_cascade(spark, sf_dir):
    g = load(spark, sf_dir)
    kept = maintain.delete_files(g.symbols, g.references, g.symbols.where("name = 'NATION_3'"))[1]
    return kept.select("source_symbol_id", "target_symbol_id", "ref_kind", "source_line", "confidence")


@query(with_graph("SELECT source_file, target_file FROM file_imports WHERE source_file <> '/proj/region_1.ts' UNION SELECT source_file, target_file FROM file_imports WHERE source_file = '/proj/region_1.ts' AND target_file LIKE '%1%'", IMPORTS_SQL))
def replace_imports(spark, sf_dir):
    old = load(spark, sf_dir).file_imports
    return maintain.replace_imports(old, old.where("source_file = '/proj/region_1.ts' AND target_file LIKE '%1%'"))


@query(with_graph("SELECT file_path, count(*) FILTER (kind = 'class')::BIGINT AS classes, count(*) FILTER (kind = 'function')::BIGINT AS functions, count(*) FILTER (parent_id IS NOT NULL)::BIGINT AS members, coalesce(string_agg(name, ',' ORDER BY name) FILTER (modifiers = 'export'), '') AS exports FROM symbols GROUP BY file_path"))
def summarize_files(spark, sf_dir):
    s = load(spark, sf_dir).symbols
    exported = F.array_join(F.sort_array(F.collect_list(F.when(F.col("modifiers") == "export", F.col("name")))), ",")
    return s.groupBy("file_path").agg(F.count_if(F.col("kind") == "class").alias("classes"), F.count_if(F.col("kind") == "function").alias("functions"), F.count_if(F.col("parent_id").isNotNull()).alias("members"), exported.alias("exports"))


@query(
    with_graph("""
SELECT reason, file_path, line, symbol, score, kind FROM (
  SELECT 'declaration' AS reason, file_path, line, name AS symbol, 100 AS score, min(kind) AS kind FROM symbols WHERE name = 'NATION_1' GROUP BY ALL
  UNION ALL SELECT 'subclass', s.file_path, s.line, s.name, 70, 'class' FROM refs JOIN symbols t ON t.id = target_symbol_id AND t.name = 'NATION_1' AND t.kind = 'class' JOIN symbols s ON s.id = source_symbol_id WHERE ref_kind = 'extends'
) ORDER BY score DESC, file_path, line, symbol LIMIT 10""")
)
def find_write_targets(spark, sf_dir):
    g = load(spark, sf_dir)
    return lookup.write_targets(g.symbols, g.references, "NATION_1")


TARGETS_SQL = """
, own AS (SELECT * FROM symbols WHERE {own}),
found AS (
  SELECT 'declaration' AS reason, file_path, line, name AS symbol, 100 AS score, kind FROM own
  UNION ALL SELECT 'caller', s.file_path, s.line, s.name, 80, CASE WHEN p.id IS NULL THEN 'function' ELSE 'method' END FROM refs JOIN own ON own.id = target_symbol_id JOIN symbols s ON s.id = source_symbol_id LEFT JOIN symbols p ON p.id = s.parent_id AND p.kind = 'class' WHERE ref_kind = 'calls'
  UNION ALL SELECT 'implementor', s.file_path, 0, s.name, 75, 'class' FROM refs JOIN own ON own.id = target_symbol_id AND own.kind = 'interface' JOIN symbols s ON s.id = source_symbol_id WHERE ref_kind = 'implements'
  UNION ALL SELECT 'subclass', s.file_path, s.line, s.name, 70, 'class' FROM refs JOIN own ON own.id = target_symbol_id AND own.kind = 'class' JOIN symbols s ON s.id = source_symbol_id WHERE ref_kind = 'extends')
SELECT reason, file_path, line, symbol, max(score) AS score, min(kind) AS kind FROM found GROUP BY reason, file_path, line, symbol ORDER BY score DESC, file_path, line, symbol LIMIT 25"""


def targets_sql(own: str) -> str:
    return with_graph(TARGETS_SQL.replace("{own}", own))


@query(targets_sql("name = 'supply_3'"))
def find_write_targets_callers(spark, sf_dir):
    g = load(spark, sf_dir)
    return lookup.write_targets(g.symbols, g.references, "supply_3", 25)


@query(targets_sql("name = 'supply_3' AND parent_id IN (SELECT id FROM symbols WHERE kind = 'class' AND name = 'NATION_14')"))
def find_write_targets_member(spark, sf_dir):
    g = load(spark, sf_dir)
    return lookup.write_targets(g.symbols, g.references, "supply_3", 25, "NATION_14")


@query(targets_sql("name = 'ASIA'"))
def find_write_targets_interface(spark, sf_dir):
    g = load(spark, sf_dir)
    return lookup.write_targets(g.symbols, g.references, "ASIA", 25)


FLOW_SQL = """
, calls AS (SELECT source_symbol_id AS a, target_symbol_id AS b, min(source_line) AS line FROM refs WHERE ref_kind = 'calls' GROUP BY ALL),
e AS (SELECT a, b, printf('%08d/%012d ', calls.line, b) AS step, name FROM calls JOIN symbols ON id = b),
f0 AS (SELECT s.id AS seed, arg_min(t.id, (t.file_path <> s.file_path, t.id)) AS id, s.name AS path, '' AS ord FROM (SELECT * FROM symbols WHERE {seeds}) s JOIN symbols t ON t.name = s.name GROUP BY s.id, s.name),
f1 AS (SELECT seed, f0.id AS base, b AS id, arg_min(path || ' -> ' || e.name, ord || step) AS path, min(ord || step) AS ord FROM f0 JOIN e ON a = f0.id WHERE b <> f0.id GROUP BY seed, f0.id, b),
f2 AS (SELECT f1.seed, b AS id, arg_min(f1.path || ' -> ' || e.name, f1.ord || step) AS path, min(f1.ord || step) AS ord FROM f1 JOIN e ON a = f1.id
  LEFT JOIN f1 v ON v.seed = f1.seed AND v.id = b WHERE b <> f1.base AND v.id IS NULL GROUP BY f1.seed, b),
done AS (SELECT seed, 3 AS hops, path, ord FROM f2 UNION ALL SELECT seed, 2, path, ord FROM f1 WHERE id NOT IN (SELECT a FROM e) UNION ALL SELECT seed, 1, path, ord FROM f0 WHERE id NOT IN (SELECT a FROM e)),
every AS (SELECT * FROM done UNION ALL SELECT seed, 1, path, ord FROM f0 WHERE seed NOT IN (SELECT seed FROM done))
SELECT row_number() OVER (ORDER BY seed, hops, ord)::INT AS path_rank, hops, path FROM every ORDER BY path_rank LIMIT 3"""


def flow_sql(seeds: str) -> str:
    return with_graph(FLOW_SQL.replace("{seeds}", seeds))


@query(flow_sql("name = 'Customer#000000001'"))
def explain_flow_symbol(spark, sf_dir):
    g = load(spark, sf_dir)
    return traverse.explain_flow(g.symbols, g.references, traverse.seeds_of(g.symbols, symbol_name="Customer#000000001"))


@query(flow_sql("name = 'supply_3' AND parent_id IN (SELECT id FROM symbols WHERE kind = 'class' AND name = 'NATION_14')"))
def explain_flow_member(spark, sf_dir):
    g = load(spark, sf_dir)
    return traverse.explain_flow(g.symbols, g.references, traverse.seeds_of(g.symbols, symbol_name="supply_3", class_name="NATION_14"))


@query(flow_sql("file_path = '/proj/region_2.ts' AND parent_id IS NULL AND kind IN ('function', 'class')"))
def explain_flow_file(spark, sf_dir):
    g = load(spark, sf_dir)
    return traverse.explain_flow(g.symbols, g.references, traverse.seeds_of(g.symbols, file_path="/proj/region_2.ts"))


@query(with_graph("SELECT id, min(depth) AS depth FROM walk GROUP BY id", "steps AS (SELECT DISTINCT source_symbol_id AS a, target_symbol_id AS b FROM refs WHERE ref_kind = 'calls')", "walk AS (SELECT id, 0 AS depth FROM symbols WHERE name = 'Customer#000000001' UNION SELECT b, depth + 1 FROM walk JOIN steps ON a = id WHERE depth < 4)"))
def reachable_depth(spark, sf_dir):
    g = load(spark, sf_dir)
    return traverse.reachable(g.references, g.symbols.where("name = 'Customer#000000001'"), 4)


@query(with_graph("SELECT id, min(depth) AS depth FROM walk GROUP BY id", "steps AS (SELECT DISTINCT source_symbol_id AS a, target_symbol_id AS b FROM refs WHERE ref_kind = 'calls')", "walk AS (SELECT id, 0 AS depth FROM symbols WHERE name = 'Customer#000000001' UNION SELECT b, depth + 1 FROM walk JOIN steps ON a = id WHERE depth < 10)"))
def reachable_depth_ten(spark, sf_dir):
    g = load(spark, sf_dir)
    return traverse.reachable(g.references, g.symbols.where("name = 'Customer#000000001'"), 10)


@query(with_graph("SELECT id, min(depth) AS depth FROM walk GROUP BY id", "steps AS (SELECT DISTINCT source_symbol_id AS a, target_symbol_id AS b FROM refs WHERE ref_kind = 'extends')", "walk AS (SELECT id, 0 AS depth FROM symbols WHERE kind = 'class' AND file_path = '/proj/region_1.ts' UNION SELECT b, depth + 1 FROM walk JOIN steps ON a = id WHERE depth < 10)"))
def inheritance_depth_ten(spark, sf_dir):
    """What the classes of a file come from, by a recursive query."""
    g = load(spark, sf_dir)
    return traverse.reachable_sql(g.references, g.symbols.where("kind = 'class' and file_path = '/proj/region_1.ts'"), 10, "extends")


@query(with_graph("SELECT file_path, kind, count(*)::BIGINT AS symbol_count FROM symbols GROUP BY file_path, kind"))
def symbol_counts(spark, sf_dir):
    return load(spark, sf_dir).symbols.groupBy("file_path", "kind").agg(F.count(F.lit(1)).alias("symbol_count"))


@query("SELECT doc_id AS path, sha256(coalesce(text, '')) AS content_hash FROM documents WHERE doc_id % 7 = 0 OR n_chars > 2000")
def hash_diff(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    current = docs.select(F.col("doc_id").alias("path"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("content_hash"))
    # What was stored before: long documents were different, and every seventh was absent.
    stored = docs.where("doc_id % 7 <> 0").select(F.col("doc_id").alias("path"), F.sha2(F.concat(F.coalesce("text", F.lit("")), F.when(F.col("n_chars") > 2000, "x").otherwise("")), 256).alias("content_hash"))
    return maintain.changed(current, stored)


DEBOUNCE_SQL = """
SELECT user_id, min(ts) AS first_ts, max(ts) AS last_ts, count(*)::BIGINT AS n FROM (
  SELECT user_id, ts, sum(cut) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS burst FROM (
    SELECT user_id, ts, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) > 21600000000 THEN 1 ELSE 0 END AS cut FROM events))
GROUP BY user_id, burst
"""


@query(DEBOUNCE_SQL)
def debounce_batch(spark, sf_dir):
    return feed.debounce(read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")), "user_id", "ts", 21600).select("user_id", F.col("first_ts").cast("timestamp_ntz").alias("first_ts"), F.col("last_ts").cast("timestamp_ntz").alias("last_ts"), "n")


FLUSH_SQL = """
WITH e AS (SELECT DISTINCT user_id, ts, event_type AS what, event_type IN ('error', 'purchase') AS request FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL AND event_type IS NOT NULL),
o AS (SELECT * FROM e WHERE NOT request UNION ALL SELECT user_id, ts, min(what), true FROM e WHERE request GROUP BY user_id, ts),
c AS (SELECT *, CASE WHEN lag(request) OVER w OR epoch_us(ts) - lag(epoch_us(ts)) OVER w > 21600000000 THEN 1 ELSE 0 END AS cut FROM o WINDOW w AS (PARTITION BY user_id ORDER BY ts, request, what)),
b AS (SELECT *, sum(cut) OVER (PARTITION BY user_id ORDER BY ts, request, what ROWS UNBOUNDED PRECEDING) AS burst FROM c)
SELECT user_id, coalesce(max(ts) FILTER (request), max(ts) + INTERVAL 6 HOUR) AS fire_ts, coalesce(max(what) FILTER (request), 'quiet') AS reason, arg_max(what, (ts, what)) FILTER (NOT request) AS op FROM b GROUP BY user_id, burst
"""


@query(FLUSH_SQL)
def debounce_flush(spark, sf_dir):
    """Bursts of a user's events; errors and purchases do not wait for the end of theirs."""
    events = read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return timers.debounce_flush(events, "user_id", "ts", "event_type", 21600, ("error", "purchase")).withColumn("fire_ts", F.col("fire_ts").cast("timestamp_ntz"))


@query("WITH a AS (SELECT doc_id, sha256(coalesce(text, '')) AS h FROM documents WHERE doc_id % 7 <> 0), b AS (SELECT doc_id, sha256(coalesce(text, '') || CASE WHEN n_chars > 2000 THEN 'x' ELSE '' END) AS h FROM documents WHERE doc_id % 11 <> 0) SELECT coalesce(a.doc_id, b.doc_id) AS path, CASE WHEN a.doc_id IS NULL THEN 'add' WHEN b.doc_id IS NULL THEN 'unlink' ELSE 'change' END AS op, b.h AS content_hash FROM a FULL JOIN b ON a.doc_id = b.doc_id WHERE a.h IS DISTINCT FROM b.h")
def listing_changes(spark, sf_dir):
    """Two listings of the documents: every seventh was absent before, every eleventh is now, long ones differ."""
    docs = read(spark, sf_dir, "documents").withColumn("text", F.coalesce("text", F.lit("")))
    listed = lambda df, text: df.select(F.col("doc_id").alias("path"), F.sha2(text, 256).alias("content_hash"))
    return listing.compare(listed(docs.where("doc_id % 7 <> 0"), F.col("text")), listed(docs.where("doc_id % 11 <> 0"), F.concat("text", F.when(F.col("n_chars") > 2000, "x").otherwise(""))))


@query("SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1 AND event_type <> 'error'")
def latest_state(spark, sf_dir):
    return feed.latest_state(read(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type", "value"), "user_id", ["ts", "event_id"], "event_type", "error").select("user_id", "event_id", "event_type", "value")


@query("SELECT doc_id, sha256(coalesce(text, '')) AS content_hash, (length(coalesce(text, '')) - length(replace(coalesce(text, ''), chr(10), '')) + 1)::BIGINT AS line_count FROM documents")
def file_hashes(spark, sf_dir):
    text = F.coalesce("text", F.lit(""))
    return read(spark, sf_dir, "documents").select("doc_id", F.sha2(text, 256).alias("content_hash"), (F.regexp_count(text, F.lit("\n")) + 1).cast("long").alias("line_count"))


@query(r"SELECT doc_id, regexp_replace(trim(string_split(trim(text), chr(10))[1]), '\s*\{$', '') AS signature FROM documents")
def signature_first_line(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", signature_line(F.col("text")).alias("signature"))


@query("""SELECT page_id, unnest(list_distinct(regexp_extract_all(html, 'href="([^"]*)"', 1))) AS specifier FROM pages""")
def import_specifiers(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", F.explode(F.array_distinct(hrefs(F.col("html")))).alias("specifier"))


ALIASES = [("http://", "/ext/"), ("https://", "/ext/"), ("/", "/proj/"), ("#", "/self/")]
ALIASES_SQL = ", ".join(f"('{a}', '{b}', {i})" for i, (a, b) in enumerate(ALIASES))


@query(f"""WITH x AS (SELECT page_id, unnest(list_distinct(regexp_extract_all(html, 'href="([^"]*)"', 1))) AS specifier FROM pages), a(prefix, target, rank) AS (VALUES {ALIASES_SQL})
SELECT page_id, specifier, arg_min(target || substr(specifier, length(prefix) + 1), rank) AS path FROM x JOIN a ON starts_with(specifier, prefix) GROUP BY page_id, specifier""")
def path_alias_match(spark, sf_dir):
    x = import_specifiers(spark, sf_dir)
    aliases = spark.createDataFrame([(a, b, i) for i, (a, b) in enumerate(ALIASES)], "prefix string, target string, rank int")
    hits = x.join(F.broadcast(aliases), F.col("specifier").startswith(F.col("prefix")))  # four rows
    return hits.groupBy("page_id", "specifier").agg(F.min_by(F.concat("target", F.expr("substring(specifier, length(prefix) + 1)")), "rank").alias("path"))


@query("WITH u AS (SELECT page_id, regexp_extract(url, '^https?://[^/]+(/[^?]*)', 1) AS route FROM pages), p AS (SELECT DISTINCT '/' || lang AS prefix FROM documents UNION SELECT '/') SELECT page_id, route, arg_max(prefix, length(prefix)) AS prefix FROM u JOIN p ON starts_with(route, prefix) GROUP BY page_id, route")
def route_prefix_match(spark, sf_dir):
    routes = read(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "^https?://[^/]+(/[^?]*)", 1).alias("route"))
    prefixes = read(spark, sf_dir, "documents").where("lang is not null").select(F.concat(F.lit("/"), "lang").alias("prefix")).distinct().union(spark.range(1).select(F.lit("/")))
    return search.longest_prefix(routes, prefixes)


@query(r"""WITH u AS (SELECT page_id, regexp_extract(url, '^https?://[^/]+(/[^?]*)', 1) AS route FROM pages),
p AS (SELECT DISTINCT regexp_extract(route, '^(/[^/]*/[^/]{0,3})', 1) AS prefix FROM u WHERE page_id % 3 = 0 UNION SELECT DISTINCT regexp_extract(route, '^(/[^/]*/)', 1) FROM u UNION SELECT substr(route, 1, 4) FROM u WHERE page_id % 5 = 0)
SELECT page_id, route, arg_max(prefix, length(prefix)) AS prefix FROM u JOIN p ON starts_with(route, prefix) GROUP BY page_id, route""")
def route_prefix_many(spark, sf_dir):
    """Prefixes that come from the routes themselves: thousands, at segments and within them."""
    routes = read(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "^https?://[^/]+(/[^?]*)", 1).alias("route"))
    start = lambda pattern: F.regexp_extract("route", pattern, 1)
    prefixes = routes.where("page_id % 3 = 0").select(start("^(/[^/]*/[^/]{0,3})").alias("prefix")).union(routes.select(start("^(/[^/]*/)"))).union(routes.where("page_id % 5 = 0").select(F.substring("route", 1, 4)))
    return search.longest_prefix(routes, prefixes)


@query("SELECT event_id, json_extract_string(props, '$.k') AS value, CASE WHEN json_extract_string(props, '$.k') IS NULL THEN 'default' ELSE 'props' END AS source FROM events")
def config_key_path(spark, sf_dir):
    value = F.get_json_object("props", "$.k")
    return read(spark, sf_dir, "events").select("event_id", value.alias("value"), F.when(value.isNull(), "default").otherwise("props").alias("source"))


@query("SELECT event_id, string_split(event_type || '.' || props, '.')[-1] AS segment FROM events")
def last_segments(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", last_segment(F.concat("event_type", F.lit("."), "props")).alias("segment"))


@query(with_graph("SELECT 'symbol_kind' AS rule, 0::BIGINT AS violations UNION ALL SELECT 'symbol_name', count(*) FILTER (name IS NULL)::BIGINT FROM symbols UNION ALL SELECT 'symbol_line', count(*) FILTER (line < 1)::BIGINT FROM symbols UNION ALL SELECT 'ref_kind', 0 UNION ALL SELECT 'confidence', 0"))
def validate_graph(spark, sf_dir):
    g = load(spark, sf_dir)
    return validate(g.symbols, g.references)


@query(with_graph("SELECT path, symbol_count FROM (SELECT file_path AS path, count(*)::BIGINT AS symbol_count FROM symbols GROUP BY file_path) WHERE path = '/proj/region_1.ts'"))
def file_by_path(spark, sf_dir):
    return lookup.file_by_path(load(spark, sf_dir).files, "/proj/region_1.ts").select("path", "symbol_count")


@query(with_graph("SELECT 'symbols' AS name, count(*)::BIGINT AS count FROM symbols UNION ALL SELECT 'references', count(*) FROM refs UNION ALL SELECT 'files', count(DISTINCT file_path) FROM symbols"))
def indexed_counts(spark, sf_dir):
    g = load(spark, sf_dir)
    return lookup.counts(symbols=g.symbols, references=g.references, files=g.symbols.select("file_path").distinct())


@query(with_graph("SELECT c.file_path, c.name AS class_name, c.line AS class_line, coalesce(string_agg(m.name, ',' ORDER BY m.name), '') AS members FROM symbols c LEFT JOIN symbols m ON m.parent_id = c.id AND m.kind IN ('method', 'constructor', 'getter', 'setter') WHERE c.kind = 'class' GROUP BY c.id, c.file_path, c.name, c.line"))
def class_members(spark, sf_dir):
    return lookup.class_members(load(spark, sf_dir).symbols).withColumn("members", F.array_join("members", ","))


@query(with_graph("SELECT id, name, file_path, CASE WHEN file_path = '/proj/Brand#2.ts' THEN line + 1 ELSE line END AS line FROM symbols WHERE NOT (file_path = '/proj/Brand#2.ts' AND id % 3 = 0) AND file_path <> '/proj/Brand#3.ts'"))
def upsert_symbols(spark, sf_dir):
    """One file is read again with lines moved and some symbols gone, another one has none left."""
    s = load(spark, sf_dir).symbols
    fresh = s.where("file_path = '/proj/Brand#2.ts' and id % 3 <> 0").withColumn("line", F.col("line") + 1)
    read_again = s.where(F.col("file_path").isin("/proj/Brand#2.ts", "/proj/Brand#3.ts")).select("file_path")
    return maintain.upsert_symbols(s, fresh, read_again).select("id", "name", "file_path", "line")


@query(with_graph("SELECT * FROM refs UNION ALL SELECT * FROM refs WHERE ref_kind = 'extends'"))
def insert_edges(spark, sf_dir):
    edges = load(spark, sf_dir).references
    return maintain.insert_edges(edges, edges.where("ref_kind = 'extends'"))


@query(with_graph("SELECT * FROM refs WHERE source_symbol_id NOT IN (SELECT id FROM symbols WHERE file_path = '/proj/Brand#2.ts')"))
def delete_file_references(spark, sf_dir):
    g = load(spark, sf_dir)
    kept = maintain.delete_file_references(g.symbols, g.references, spark.createDataFrame([("/proj/Brand#2.ts",)], "file_path string"))
    return kept.select("source_symbol_id", "target_symbol_id", "ref_kind", "source_line", "confidence")


@query(with_graph("SELECT * FROM file_imports WHERE source_file NOT IN (SELECT file_path FROM symbols WHERE name = 'NATION_3') AND target_file NOT IN (SELECT file_path FROM symbols WHERE name = 'NATION_3')", IMPORTS_SQL))
def delete_file_imports(spark, sf_dir):
    g = load(spark, sf_dir)
    return maintain.delete_file_imports(g.file_imports, g.symbols.where("name = 'NATION_3'"))


@query(with_graph("SELECT DISTINCT source_symbol_id, target_symbol_id, ref_kind, source_line, confidence FROM rules WHERE source_symbol_id IS NOT NULL AND target_symbol_id IS NOT NULL", MIXED_SQL, RULES_SQL))
def resolve_named_refs_rules(spark, sf_dir):
    """References by every rule for either end: whole files, members, names in a file, names anywhere."""
    return resolve.resolve_named_refs(mixed_refs(spark, sf_dir), load(spark, sf_dir).symbols).distinct()


REINDEX_SQL = """
, now AS (SELECT id, CASE WHEN file_path = '/proj/Brand#2.ts' THEN name || ' two' ELSE name END AS name, kind, file_path, parent_id FROM symbols),
in_class AS (SELECT m.file_path, c.name AS parent_name, m.name, min(m.id) AS hit FROM now m JOIN now c ON m.parent_id = c.id AND c.kind = 'class' GROUP BY ALL),
in_file AS (SELECT file_path, name, min(id) AS hit FROM now GROUP BY ALL HAVING count(*) = 1),
anywhere AS (SELECT name, min(id) AS hit FROM now GROUP BY ALL HAVING count(*) = 1)
SELECT s.hit AS source_symbol_id, CASE WHEN n.target_file IS NOT NULL THEN f.hit ELSE a.hit END AS target_symbol_id, source_line FROM named n
JOIN in_class s ON s.file_path = n.source_file AND s.parent_name = n.source_parent_name AND s.name = n.source_name
LEFT JOIN in_file f ON f.file_path = n.target_file AND f.name = n.target_name LEFT JOIN anywhere a ON a.name = n.target_name
WHERE n.source_file <> '/proj/region_2.ts' AND (CASE WHEN n.target_file IS NOT NULL THEN f.hit ELSE a.hit END) IS NOT NULL"""


def read_again(g: Graph) -> tuple[DataFrame, DataFrame]:
    """Four files are read again: one as it was, one with other names, one without its references, one that fails."""
    paths = ["/proj/region_1.ts", "/proj/Brand#2.ts", "/proj/region_2.ts", "/proj/region_3.ts"]
    hashed = F.when(F.col("path").isin("/proj/Brand#2.ts", "/proj/region_2.ts"), F.sha2("content_hash", 256)).otherwise(F.col("content_hash"))
    read_again = g.files.where(F.col("path").isin(*paths)).select("path", hashed.alias("content_hash"), "symbol_count", F.when(F.col("path") == "/proj/region_3.ts", "cannot be parsed").alias("error"))
    fresh = g.symbols.where(F.col("file_path").isin(*paths))
    return read_again, fresh.withColumn("name", F.when(F.col("file_path") == "/proj/Brand#2.ts", F.concat("name", F.lit(" two"))).otherwise(F.col("name")))


@query(with_graph(REINDEX_SQL, NAMED_SQL))
def reindex(spark, sf_dir):
    g, refs = load(spark, sf_dir), named_refs(spark, sf_dir)
    kept = maintain.State(g.symbols, refs, g.files.select("path", "content_hash", "symbol_count"))
    again, fresh = read_again(g)
    return maintain.reindex(kept, again, fresh, refs.limit(0)).references.select("source_symbol_id", "target_symbol_id", "source_line")


def stored_graph(spark: SparkSession, sf_dir: str) -> stored.StoredGraph:
    """The graph in tables of their own; 8 partitions are enough for some 30 files."""
    g, name = load(spark, sf_dir), f"graph_{uuid.uuid4().hex[:12]}"
    return stored.StoredGraph(spark, name, new_folder(spark, name), parts=8, buckets=2).create(g.symbols, named_refs(spark, sf_dir), g.files, g.file_imports)


@query(with_graph(REINDEX_SQL, NAMED_SQL))
def reindex_stored(spark, sf_dir):
    """The same change as a delta on stored tables: the edges afterwards."""
    graph, g = stored_graph(spark, sf_dir), load(spark, sf_dir)
    again, fresh = read_again(g)
    graph.update(again, fresh, named_refs(spark, sf_dir).limit(0))
    return graph.references.select("source_symbol_id", "target_symbol_id", "source_line")


@query(with_graph("SELECT id, CASE WHEN file_path = '/proj/Brand#2.ts' THEN name || ' two' ELSE name END AS name, kind, file_path, line, parent_id FROM symbols WHERE file_path <> '/proj/Brand#3.ts'"))
def stored_symbols(spark, sf_dir):
    """The table of symbols after a file was read again and another one deleted."""
    graph, g = stored_graph(spark, sf_dir), load(spark, sf_dir)
    again, fresh = read_again(g)
    graph.update(again, fresh, named_refs(spark, sf_dir).limit(0), epoch=1)
    graph.delete(spark.createDataFrame([("/proj/Brand#3.ts",)], "path string"))
    return graph.symbols.select("id", "name", "kind", "file_path", "line", "parent_id")


@query(with_graph("SELECT '/proj/region_1.ts' AS file_path, 'imports_from' AS direction, target_file AS other_file FROM file_imports WHERE source_file = '/proj/region_1.ts' AND target_file LIKE '%2%' AND target_file <> '/proj/Brand#3.ts' UNION ALL SELECT '/proj/region_1.ts', 'imported_by', source_file FROM file_imports WHERE target_file = '/proj/region_1.ts' AND source_file <> '/proj/Brand#3.ts'", IMPORTS_SQL))
def stored_related_files(spark, sf_dir):
    """A file's imports on either side after its own were replaced and another file was deleted."""
    graph, g = stored_graph(spark, sf_dir), load(spark, sf_dir)
    own = g.files.where("path = '/proj/region_1.ts'").select("path", F.sha2("content_hash", 256).alias("content_hash"), "symbol_count", F.lit(None).cast("string").alias("error"))
    graph.update(own, g.symbols, named_refs(spark, sf_dir), g.file_imports.where("source_file = '/proj/region_1.ts' and target_file like '%2%'"))
    graph.delete(spark.createDataFrame([("/proj/Brand#3.ts",)], "path string"))
    return graph.related_files("/proj/region_1.ts")


@query(with_graph("SELECT target_name AS symbol_name, source_name AS caller_name, source_file AS caller_file, 'direct' AS confidence FROM resolved WHERE source_symbol_id IS NOT NULL AND target_symbol_id IS NOT NULL AND target_name = (SELECT min(p_name) FROM part) GROUP BY ALL", *RESOLUTION))
def stored_callers(spark, sf_dir):
    """Callers by a join of bucketed tables."""
    return stored_graph(spark, sf_dir).callers(read(spark, sf_dir, "part").agg(F.min("p_name")).first()[0])


IMPORTED_SQL = """
bought AS (SELECT '/proj/region_' || n_regionkey || '.ts' AS source_file, p_name AS name, '/proj/' || p_brand || '.ts' AS target_file, o_orderkey * 10 + l_linenumber AS position
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'R'),
imported AS (SELECT source_file, name, arg_max(target_file, (position, target_file)) AS target_file FROM bought GROUP BY source_file, name)
"""


def imported_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a region's file imports: returned parts, in the order of the lines."""
    t = {n: read(spark, sf_dir, n) for n in ("nation", "customer", "part", "orders", "lineitem")}
    rows = t["lineitem"].where("l_returnflag = 'R'").join(t["orders"], F.col("l_orderkey") == F.col("o_orderkey")).join(t["customer"], F.col("o_custkey") == F.col("c_custkey")).join(t["nation"], F.col("c_nationkey") == F.col("n_nationkey")).join(t["part"], F.col("l_partkey") == F.col("p_partkey"))
    return rows.select(F.concat(F.lit("/proj/region_"), "n_regionkey", F.lit(".ts")).alias("source_file"), F.col("p_name").alias("name"), F.concat(F.lit("/proj/"), "p_brand", F.lit(".ts")).alias("target_file"), (F.col("o_orderkey") * 10 + F.col("l_linenumber")).alias("position"))


@query("WITH " + IMPORTED_SQL + "SELECT * FROM imported")
def import_map(spark, sf_dir):
    return projects.import_map(imported_parts(spark, sf_dir)).select("source_file", "name", "target_file")


@query(with_graph("SELECT n.source_file, n.target_name, coalesce(i.target_file, d.file_path) AS target_file FROM (SELECT DISTINCT source_file, target_name FROM named UNION SELECT DISTINCT source_file, source_name FROM named) n LEFT JOIN imported i ON i.source_file = n.source_file AND i.name = n.target_name LEFT JOIN (SELECT DISTINCT file_path, name FROM symbols) d ON d.file_path = n.source_file AND d.name = n.target_name", NAMED_SQL, IMPORTED_SQL))
def reference_target_files(spark, sf_dir):
    """Where the names that a file uses come from: its imports, else the file itself."""
    refs = named_refs(spark, sf_dir)
    used = refs.select("source_file", "target_name").union(refs.select("source_file", "source_name")).distinct()
    return projects.target_files(used, projects.import_map(imported_parts(spark, sf_dir)), load(spark, sf_dir).symbols)


#: (turn, pattern, target) as a project's settings would give them.
WILD_ALIASES = [(0, "/a*", "/none"), (1, "/de", "/proj/de"), (2, "/*", "/proj/*")]
PAGE_FILES_SQL = """
x AS (SELECT page_id, '/page/' || page_id AS path, unnest(list_distinct(regexp_extract_all(html, 'href="([^"]*)"', 1))) AS specifier FROM pages),
files AS (SELECT DISTINCT '/proj' || specifier || CASE ascii(right(specifier, 1)) % 5 WHEN 0 THEN '.ts' WHEN 1 THEN '/index.ts' WHEN 2 THEN '.tsx' WHEN 3 THEN '/index.tsx' ELSE '' END AS path FROM x WHERE specifier LIKE '/%' AND length(specifier) % 3 > 0
  UNION SELECT '/proj' || specifier || '/index.ts' FROM x WHERE specifier LIKE '/%' AND length(specifier) % 3 = 1)
"""


@query("WITH " + PAGE_FILES_SQL + """
, tried AS (SELECT x.path, specifier, CASE WHEN specifier = '/de' THEN '/proj/de' ELSE '/proj' || specifier END AS base, unnest([0, 1, 2, 3, 4]) AS rank FROM x WHERE specifier LIKE '/_%' AND specifier NOT LIKE '%/./%'),
full_path AS (SELECT path, specifier, rank, rtrim(base, '/') || ['.ts', '/index.ts', '.tsx', '/index.tsx', ''][rank + 1] AS target_file FROM tried)
SELECT f.path AS source_file, specifier, arg_min(target_file, rank) AS target_file FROM full_path f JOIN files ON files.path = target_file GROUP BY f.path, specifier""")
def resolve_aliased_imports(spark, sf_dir):
    """Links of pages as imports through wildcard and exact aliases, against files that end in each of the suffixes."""
    links = import_specifiers(spark, sf_dir).select(F.concat(F.lit("/page/"), "page_id").alias("path"), "specifier")
    own = links.where("specifier like '/%'").select("specifier").distinct()
    ending = F.element_at(F.array(*[F.lit(s) for s in (".ts", "/index.ts", ".tsx", "/index.tsx", "")]), (F.ascii(F.right("specifier", F.lit(1))) % 5 + 1).cast("int"))
    files = own.where("length(specifier) % 3 > 0").select(F.concat(F.lit("/proj"), "specifier", ending).alias("path"))
    files = files.union(own.where("length(specifier) % 3 = 1").select(F.concat(F.lit("/proj"), "specifier", F.lit("/index.ts")))).distinct()
    aliases = spark.createDataFrame(WILD_ALIASES, "turn int, pattern string, target string")
    return projects.resolve_imports(links, files, aliases, with_specifier=True)


@query(r"SELECT page_id, regexp_extract_all(regexp_extract(url, '^https?://[^/]+(/[^?#]*)', 1), '[^/]+')[-1] AS last, len(regexp_extract_all(regexp_extract(url, '^https?://[^/]+(/[^?#]*)', 1), '[^/]+'))::INT AS n, false AS dynamic FROM pages WHERE regexp_matches(url, '^https?://[^/]+/[^?#]*[^/?#]')")
def page_route_segments(spark, sf_dir):
    route = F.regexp_extract("url", "^https?://[^/]+(/[^?#]*)", 1)
    own = read(spark, sf_dir, "pages").where(F.col("url").rlike("^https?://[^/]+/[^?#]*[^/?#]")).select("page_id", route_segments(route).alias("s"))
    return own.select("page_id", F.element_at("s", -1)["name"].alias("last"), F.size("s").alias("n"), F.exists("s", lambda x: x["dynamic"]).alias("dynamic"))


@query(r"SELECT page_id, regexp_extract(url, '^https://(.+)$', 1) AS name FROM pages WHERE url LIKE 'https://_%'")
def page_resource_names(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", resource_name(F.col("url"), "https").alias("name")).where("name is not null")


METHODS_SQL = ", ".join(f"'{m}'" for m in (*ROUTE_METHODS, "listen"))


@query(f"SELECT event_id, m AS method FROM (SELECT event_id, [{METHODS_SQL}][(event_id % 7 + 1)::INT] AS m FROM events) WHERE m <> 'listen'")
def route_registrations(spark, sf_dir):
    callee = F.concat("event_type", F.lit("."), F.element_at(F.array(*[F.lit(m) for m in (*ROUTE_METHODS, "listen")]), (F.col("event_id") % 7 + 1).cast("int")))
    return read(spark, sf_dir, "events").select("event_id", route_method(callee).alias("method")).where("method is not null")


@query("SELECT doc_id FROM documents WHERE contains(text, 'this.')")
def own_calls(spark, sf_dir):
    return read(spark, sf_dir, "documents").where(calls_own(F.col("text"))).select("doc_id")


@query("SELECT event_id, to_json({'type': event_type, 'user': user_id})::VARCHAR AS shown FROM events")
def shown_values(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", shown_value(F.struct(F.col("event_type").alias("type"), F.col("user_id").alias("user"))).alias("shown"))


@query("SELECT event_id, event_type AS decorator, replace(props, '\"', '') AS bare FROM events")
def decorator_names(spark, sf_dir):
    name = decorator_name(F.concat(F.lit("ns."), "event_type", F.lit("()")))
    return read(spark, sf_dir, "events").select("event_id", name.alias("decorator"), unquoted(F.col("props")).alias("bare"))


@query(with_graph("SELECT 'symbol_kind' AS rule, count(*) FILTER (id % 7 = 0)::BIGINT AS violations FROM symbols UNION ALL SELECT 'symbol_name', count(*) FILTER (id % 11 = 0)::BIGINT FROM symbols UNION ALL SELECT 'symbol_line', count(*) FILTER (id % 13 = 0 OR line < 1)::BIGINT FROM symbols UNION ALL SELECT 'ref_kind', count(*) FILTER (source_line = 2)::BIGINT FROM refs UNION ALL SELECT 'confidence', count(*) FILTER (confidence = 'weak')::BIGINT FROM refs"))
def validate_damaged_graph(spark, sf_dir):
    """Rows of which some break each of the rules."""
    g = load(spark, sf_dir)
    symbols = g.symbols.withColumn("kind", F.when(F.col("id") % 7 == 0, "module").otherwise(F.col("kind"))).withColumn("name", F.when(F.col("id") % 11 != 0, F.col("name"))).withColumn("line", F.when(F.col("id") % 13 == 0, 0).otherwise(F.col("line")))
    references = g.references.withColumn("ref_kind", F.when(F.col("source_line") == 2, None).otherwise(F.col("ref_kind"))).withColumn("confidence", F.when(F.col("confidence") == "weak", "unsure").otherwise(F.col("confidence")))
    return validate(symbols, references)


KEYS_SQL = """
, s AS (SELECT id, name, kind, file_path, line, parent_id FROM symbols WHERE id % 9 <> 0 UNION ALL SELECT id, name, kind, file_path, line, parent_id FROM symbols WHERE id % 14 = 0 UNION ALL SELECT id + 900000000000, name, kind, file_path, line, parent_id FROM symbols WHERE id % 15 = 0)
SELECT 'symbol_id' AS rule, (count(*) - count(DISTINCT id))::BIGINT AS violations FROM s
UNION ALL SELECT 'symbol_place', (count(*) - count(DISTINCT (file_path, name, kind, line)))::BIGINT FROM s
UNION ALL SELECT 'file_path', count(DISTINCT file_path)::BIGINT FROM symbols
UNION ALL SELECT 'symbol_parent', count(*)::BIGINT FROM s WHERE parent_id NOT IN (SELECT id FROM s)
UNION ALL SELECT 'edge_source', count(*)::BIGINT FROM refs WHERE source_symbol_id NOT IN (SELECT id FROM s)
UNION ALL SELECT 'edge_target', count(*)::BIGINT FROM refs WHERE target_symbol_id NOT IN (SELECT id FROM s)"""


@query(with_graph(KEYS_SQL))
def validate_graph_keys(spark, sf_dir):
    """Symbols of which some are gone, some there twice and some under another id; every file twice."""
    g = load(spark, sf_dir)
    again = g.symbols.where("id % 14 = 0").union(g.symbols.where("id % 15 = 0").withColumn("id", F.col("id") + 900000000000))
    return validate_keys(g.symbols.where("id % 9 <> 0").union(again), g.references, g.files.union(g.files))


@query("SELECT p_partkey, p_name || '+' || p_brand AS name FROM part")
def encoded_resource_names(spark, sf_dir):
    """Names with blanks and number signs in addresses; a plus sign stands for itself."""
    uri = F.concat(F.lit("symbol://"), F.replace("p_name", F.lit(" "), F.lit("%20")), F.lit("+"), F.replace("p_brand", F.lit("#"), F.lit("%23")))
    return read(spark, sf_dir, "part").select("p_partkey", resource_name(uri, "symbol").alias("name"))


@query("SELECT event_id, ['k', event_type, 'rest', user_id::VARCHAR] AS names, [false, true, true, false] AS dynamic FROM events")
def dynamic_route_segments(spark, sf_dir):
    """Routes with segments that stand for a value and for all that follow."""
    route = F.concat(F.lit("/k/["), "event_type", F.lit("]/[...rest]/"), "user_id")
    own = read(spark, sf_dir, "events").select("event_id", route_segments(route).alias("s"))
    return own.select("event_id", F.col("s.name").alias("names"), F.col("s.dynamic").alias("dynamic"))


SUFFIXES_SQL = "['.ts', '/index.ts', '.tsx', '/index.tsx', '.js']"
RELATIVE_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(lang, 'none') AS lang FROM documents),
files AS (SELECT '/src/' || lang || '/d' || doc_id || {SUFFIXES_SQL}[(doc_id % 5 + 1)::INT] AS path FROM d),
x AS (SELECT '/src/' || lang || '/m' || doc_id || '.ts' AS source_file, './d' || doc_id + 1 AS specifier, '/src/' || lang || '/d' || (doc_id + 1) AS base FROM d
  UNION ALL SELECT '/src/' || lang || '/m' || doc_id || '.ts', '.././en/../en/d' || doc_id + 2, '/src/en/d' || (doc_id + 2) FROM d),
tried AS (SELECT source_file, specifier, base || {SUFFIXES_SQL}[rank] AS target_file, rank FROM x, range(1, 5) AS t(rank))
SELECT source_file, specifier, arg_min(target_file, rank) AS target_file FROM tried JOIN files ON path = target_file GROUP BY source_file, specifier"""


@query(RELATIVE_SQL)
def resolve_relative_imports(spark, sf_dir):
    """Modules of one folder and of another one, by each suffix; what only a ``.js`` file would answer is not found."""
    docs = read(spark, sf_dir, "documents").select("doc_id", F.coalesce("lang", F.lit("none")).alias("lang"))
    folder = F.concat(F.lit("/src/"), "lang", F.lit("/"))
    ending = F.element_at(F.array(*[F.lit(x) for x in (*projects.SUFFIXES, ".js")]), (F.col("doc_id") % 5 + 1).cast("int"))
    files = docs.select(F.concat(folder, F.lit("d"), "doc_id", ending).alias("path"))
    each = F.array(F.concat(F.lit("./d"), F.col("doc_id") + 1), F.concat(F.lit(".././en/../en/d"), F.col("doc_id") + 2))
    imports = docs.select(F.concat(folder, F.lit("m"), "doc_id", F.lit(".ts")).alias("path"), F.explode(each).alias("specifier"))
    return projects.resolve_imports(imports, files, with_specifier=True)


CODE_SQL = r"""
SELECT doc_id::VARCHAR AS path, unnest(['./a' || doc_id, './b' || (doc_id % 7), '../c/' || coalesce(lang, '')]) AS specifier FROM documents"""


@query(CODE_SQL)
def imports_in_code(spark, sf_dir):
    """Sources in which the documents' texts stand in comments, strings and templates, beside imports that are none."""
    bare = F.regexp_replace(F.coalesce("text", F.lit("")), r"[\\*/'\"`${}]", " ")
    line = F.regexp_replace(bare, r"\s", " ")
    content = F.concat(
        F.lit("import a, { b as c } from './a"), "doc_id", F.lit("';\n/* import no from './no1'\n"), bare, F.lit("*/\n// import './no2' "), line,
        F.lit("\nconst s = \"import './no3' "), line, F.lit("\"; import * as ns from \"./b"), F.col("doc_id") % 7, F.lit("\"\nconst t = `\nimport './no4'\n"), bare, F.lit("${f('`', `import './no5'`)}`, r = /[`\"']import '.no6'/\n"),
        F.lit("import {\n  d, // from './no7'\n  type E\n} from '../c/"), F.coalesce("lang", F.lit("")), F.lit("'\nimport('./no8')\n"),
    )
    return projects.import_specifiers(read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), content.alias("content")))


def reindexed(spark: SparkSession, sf_dir: str) -> maintain.State:
    g, refs = load(spark, sf_dir), named_refs(spark, sf_dir)
    again, fresh = read_again(g)
    return maintain.reindex(maintain.State(g.symbols, refs, g.files.select("path", "content_hash", "symbol_count")), again, fresh, refs.limit(0))


@query(with_graph("SELECT path, CASE WHEN path IN ('/proj/Brand#2.ts', '/proj/region_2.ts') THEN sha256(content_hash) ELSE content_hash END AS content_hash, symbol_count FROM (SELECT file_path AS path, count(*)::BIGINT AS symbol_count, sha256(string_agg(name, chr(10) ORDER BY id)) AS content_hash FROM symbols GROUP BY file_path)"))
def reindex_files(spark, sf_dir):
    """File records after the re-index: new ones for what changed, old ones where parsing failed."""
    return reindexed(spark, sf_dir).files


@query("SELECT '/proj/region_3.ts' AS path, 'cannot be parsed' AS error FROM (SELECT count(*) AS n FROM nation WHERE n_regionkey = 3) WHERE n > 0")
def reindex_errors(spark, sf_dir):
    return reindexed(spark, sf_dir).errors
