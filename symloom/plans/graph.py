"""The graph that the registered queries run on: a fixed projection of the star-schema tables, in Spark and in SQL."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass
class Graph:
    symbols: DataFrame
    references: DataFrame

    @property
    def file_imports(self) -> DataFrame:
        """Distinct pairs of files that an edge joins."""
        at = self.symbols.select("id", "file_path")
        source = at.select(F.col("id").alias("source_symbol_id"), F.col("file_path").alias("source_file"))
        target = at.select(F.col("id").alias("target_symbol_id"), F.col("file_path").alias("target_file"))
        pairs = self.references.select("source_symbol_id", "target_symbol_id").distinct()
        return pairs.join(source, "source_symbol_id").join(target, "target_symbol_id").where("source_file <> target_file").select("source_file", "target_file").distinct()

    @property
    def files(self) -> DataFrame:
        """path, symbol_count and the hash of its symbols' names in order."""
        named = self.symbols.groupBy(F.col("file_path").alias("path")).agg(F.count(F.lit(1)).alias("symbol_count"), F.sort_array(F.collect_list(F.struct("id", "name"))).alias("x"))
        return named.select("path", "symbol_count", F.sha2(F.array_join("x.name", "\n"), 256).alias("content_hash"))


def load(spark: SparkSession, sf_dir: str) -> Graph:
    t = {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")}
    col, lit = F.col, F.lit
    place = F.concat(lit("/proj/region_"), col("n_regionkey"), lit(".ts"))
    no_parent = lit(None).cast("long")
    symbol = lambda df, base, key, name, kind, path, line, parent, modifiers: df.select((lit(base) + col(key)).cast("long").alias("id"), name.alias("name"), lit(kind).alias("kind"), path.alias("file_path"), (lit(line) + col(key)).cast("int").alias("line"), parent.alias("parent_id"), lit(modifiers).alias("modifiers"))
    own_nation = (lit(2000000000) + col("n_nationkey")).cast("long")
    people = t["customer"].join(t["nation"], col("c_nationkey") == col("n_nationkey"))
    makers = t["supplier"].join(t["nation"], col("s_nationkey") == col("n_nationkey"))
    symbols = [
        symbol(t["region"], 1000000000, "r_regionkey", col("r_name"), "interface", lit("/proj/region.ts"), 1, no_parent, "export"),
        symbol(t["nation"], 2000000000, "n_nationkey", col("n_name"), "class", place, 1, no_parent, "export"),
        symbol(people, 3000000000, "c_custkey", col("c_name"), "method", place, 1000, own_nation, ""),
        symbol(makers, 4000000000, "s_suppkey", F.concat(lit("supply_"), col("s_suppkey") % 10), "method", place, 1000000, own_nation, "async"),
        symbol(t["part"], 5000000000, "p_partkey", col("p_name"), "function", F.concat(lit("/proj/"), col("p_brand"), lit(".ts")), 1, no_parent, "export"),
    ]
    all_symbols = symbols[0]
    for s in symbols[1:]:
        all_symbols = all_symbols.unionByName(s)
    none = lambda kind: lit(None).cast(kind)
    all_symbols = all_symbols.select("id", "name", "kind", "file_path", "line", lit(0).alias("column"), col("line").alias("end_line"), "parent_id", none("string").alias("signature"), "modifiers", none("string").alias("return_type"), none("string").alias("params"), none("string").alias("doc_comment"))
    edge = lambda df, source, target, kind, line, confidence=None: df.select(source.cast("long").alias("source_symbol_id"), target.cast("long").alias("target_symbol_id"), lit(kind).alias("ref_kind"), line.cast("int").alias("source_line"), (lit("direct") if confidence is None else confidence).alias("confidence"))
    bought = t["lineitem"].join(t["orders"], col("l_orderkey") == col("o_orderkey"))
    sure = F.when(col("l_returnflag") == "N", "direct").when(col("l_returnflag") == "A", "inferred").otherwise("weak")
    supplied = t["lineitem"].groupBy("l_partkey", "l_suppkey").agg(F.min("l_linenumber").alias("line"))
    references = [
        edge(bought, lit(3000000000) + col("o_custkey"), lit(5000000000) + col("l_partkey"), "calls", col("l_linenumber"), sure),
        edge(supplied, lit(5000000000) + col("l_partkey"), lit(4000000000) + col("l_suppkey"), "calls", col("line")),
        edge(t["supplier"].join(t["customer"], col("s_suppkey") == col("c_custkey")), lit(4000000000) + col("s_suppkey"), lit(3000000000) + col("c_custkey"), "calls", lit(1)),
        edge(t["nation"], lit(2000000000) + col("n_nationkey"), lit(1000000000) + col("n_regionkey"), "implements", col("n_nationkey") + 1),
        edge(t["nation"].where("n_nationkey >= 5"), lit(2000000000) + col("n_nationkey"), lit(2000000000) + col("n_nationkey") % 5, "extends", col("n_nationkey") + 1),
        edge(t["customer"], lit(3000000000) + col("c_custkey"), lit(2000000000) + col("c_nationkey"), "type_ref", lit(1000) + col("c_custkey")),
        edge(makers, lit(4000000000) + col("s_suppkey"), lit(1000000000) + col("n_regionkey"), "decorator", lit(1000000) + col("s_suppkey")),
    ]
    all_references = references[0]
    for r in references[1:]:
        all_references = all_references.unionByName(r)
    return Graph(all_symbols, all_references)


def named_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of customers to parts by name: with the part's file on odd lines, by the name alone on even ones."""
    t = {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("nation", "customer", "part", "orders", "lineitem")}
    rows = t["lineitem"].join(t["orders"], F.col("l_orderkey") == F.col("o_orderkey")).join(t["customer"], F.col("o_custkey") == F.col("c_custkey")).join(t["nation"], F.col("c_nationkey") == F.col("n_nationkey")).join(t["part"], F.col("l_partkey") == F.col("p_partkey"))
    odd = F.col("l_linenumber") % 2 == 1
    return rows.select(F.col("c_name").alias("source_name"), F.concat(F.lit("/proj/region_"), "n_regionkey", F.lit(".ts")).alias("source_file"), F.col("n_name").alias("source_parent_name"), F.col("p_name").alias("target_name"), F.when(odd, F.concat(F.lit("/proj/"), "p_brand", F.lit(".ts"))).alias("target_file"), F.lit(None).cast("string").alias("target_parent_name"), F.lit("calls").alias("ref_kind"), F.col("l_linenumber").alias("source_line"), F.lit("direct").alias("confidence"))


def mixed_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References of every form, from the calls of parts to suppliers and of customers to parts, by the line's number.

    0: a file to a name in a file; 1: a name to a name anywhere; 2: a name to a member of a class of a file;
    3: a member that does not exist; 4: a name in a file of several to a name anywhere.
    """
    t = {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("nation", "supplier", "part", "lineitem")}
    rows = t["lineitem"].join(t["part"], F.col("l_partkey") == F.col("p_partkey")).join(t["supplier"], F.col("l_suppkey") == F.col("s_suppkey")).join(t["nation"], F.col("s_nationkey") == F.col("n_nationkey"))
    form, none = F.col("l_linenumber") % 5, F.lit(None).cast("string")
    file_, region = F.concat(F.lit("/proj/"), "p_brand", F.lit(".ts")), F.concat(F.lit("/proj/region_"), "n_regionkey", F.lit(".ts"))
    supply = F.concat(F.lit("supply_"), F.col("s_suppkey") % 10)
    return rows.select(
        F.when(form == 0, "<file>").otherwise(F.col("p_name")).alias("source_name"), file_.alias("source_file"), F.when(form == 3, "Nothing").otherwise(none).alias("source_parent_name"),
        F.when(form.isin(0, 1), F.col("n_name")).otherwise(supply).alias("target_name"), F.when(form.isin(0, 2), region).otherwise(none).alias("target_file"), F.when(form == 2, F.col("n_name")).otherwise(none).alias("target_parent_name"),
        F.lit("calls").alias("ref_kind"), F.col("l_linenumber").alias("source_line"), F.lit("direct").alias("confidence"),
    )


SYMBOLS_SQL = """
symbols AS (
  SELECT (1000000000 + r_regionkey)::BIGINT AS id, r_name AS name, 'interface' AS kind, '/proj/region.ts' AS file_path, (r_regionkey + 1)::INT AS line, NULL::BIGINT AS parent_id, 'export' AS modifiers FROM region
  UNION ALL SELECT 2000000000 + n_nationkey, n_name, 'class', '/proj/region_' || n_regionkey || '.ts', (n_nationkey + 1)::INT, NULL, 'export' FROM nation
  UNION ALL SELECT 3000000000 + c_custkey, c_name, 'method', '/proj/region_' || n_regionkey || '.ts', (1000 + c_custkey)::INT, 2000000000 + n_nationkey, '' FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT 4000000000 + s_suppkey, 'supply_' || (s_suppkey % 10), 'method', '/proj/region_' || n_regionkey || '.ts', (1000000 + s_suppkey)::INT, 2000000000 + n_nationkey, 'async' FROM supplier JOIN nation ON s_nationkey = n_nationkey
  UNION ALL SELECT 5000000000 + p_partkey, p_name, 'function', '/proj/' || p_brand || '.ts', (p_partkey + 1)::INT, NULL, 'export' FROM part)
"""

REFERENCES_SQL = """
refs AS (
  SELECT (3000000000 + o_custkey)::BIGINT AS source_symbol_id, (5000000000 + l_partkey)::BIGINT AS target_symbol_id, 'calls' AS ref_kind, l_linenumber::INT AS source_line, CASE l_returnflag WHEN 'N' THEN 'direct' WHEN 'A' THEN 'inferred' ELSE 'weak' END AS confidence FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  UNION ALL SELECT 5000000000 + l_partkey, 4000000000 + l_suppkey, 'calls', min(l_linenumber)::INT, 'direct' FROM lineitem GROUP BY l_partkey, l_suppkey
  UNION ALL SELECT 4000000000 + s_suppkey, 3000000000 + c_custkey, 'calls', 1, 'direct' FROM supplier JOIN customer ON s_suppkey = c_custkey
  UNION ALL SELECT 2000000000 + n_nationkey, 1000000000 + n_regionkey, 'implements', (n_nationkey + 1)::INT, 'direct' FROM nation
  UNION ALL SELECT 2000000000 + n_nationkey, 2000000000 + n_nationkey % 5, 'extends', (n_nationkey + 1)::INT, 'direct' FROM nation WHERE n_nationkey >= 5
  UNION ALL SELECT 3000000000 + c_custkey, 2000000000 + c_nationkey, 'type_ref', (1000 + c_custkey)::INT, 'direct' FROM customer
  UNION ALL SELECT 4000000000 + s_suppkey, 1000000000 + n_regionkey, 'decorator', (1000000 + s_suppkey)::INT, 'direct' FROM supplier JOIN nation ON s_nationkey = n_nationkey)
"""

IMPORTS_SQL = """
file_imports AS (
  SELECT DISTINCT s.file_path AS source_file, t.file_path AS target_file
  FROM refs JOIN symbols s ON s.id = source_symbol_id JOIN symbols t ON t.id = target_symbol_id WHERE s.file_path <> t.file_path)
"""

NAMED_SQL = """
named AS (
  SELECT c_name AS source_name, '/proj/region_' || n_regionkey || '.ts' AS source_file, n_name AS source_parent_name, p_name AS target_name,
    CASE WHEN l_linenumber % 2 = 1 THEN '/proj/' || p_brand || '.ts' END AS target_file, l_linenumber::INT AS source_line
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN part ON l_partkey = p_partkey)
"""

RESOLVED_SQL = """
in_class AS (SELECT m.file_path, c.name AS parent_name, m.name, min(m.id) AS hit FROM symbols m JOIN symbols c ON m.parent_id = c.id AND c.kind = 'class' GROUP BY ALL),
in_file AS (SELECT file_path, name, min(id) AS hit FROM symbols GROUP BY ALL HAVING count(*) = 1),
anywhere AS (SELECT name, min(id) AS hit FROM symbols GROUP BY ALL HAVING count(*) = 1),
resolved AS (
  SELECT n.*, s.hit AS source_symbol_id, CASE WHEN n.target_file IS NOT NULL THEN f.hit ELSE a.hit END AS target_symbol_id
  FROM named n LEFT JOIN in_class s ON s.file_path = n.source_file AND s.parent_name = n.source_parent_name AND s.name = n.source_name
  LEFT JOIN in_file f ON f.file_path = n.target_file AND f.name = n.target_name LEFT JOIN anywhere a ON a.name = n.target_name)
"""

MIXED_SQL = """
mixed AS (
  SELECT CASE WHEN form = 0 THEN '<file>' ELSE p_name END AS source_name, '/proj/' || p_brand || '.ts' AS source_file, CASE WHEN form = 3 THEN 'Nothing' END AS source_parent_name,
    CASE WHEN form IN (0, 1) THEN n_name ELSE 'supply_' || (s_suppkey % 10) END AS target_name, CASE WHEN form IN (0, 2) THEN '/proj/region_' || n_regionkey || '.ts' END AS target_file, CASE WHEN form = 2 THEN n_name END AS target_parent_name, l_linenumber::INT AS source_line
  FROM (SELECT *, l_linenumber % 5 AS form FROM lineitem) JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey)
"""

RULES_SQL = """
in_class AS (SELECT m.file_path, c.name AS parent_name, m.name, min(m.id) AS hit FROM symbols m JOIN symbols c ON m.parent_id = c.id AND c.kind = 'class' GROUP BY ALL),
in_file AS (SELECT file_path, name, min(id) AS hit, count(*) AS n FROM symbols GROUP BY ALL),
anywhere AS (SELECT name, min(id) AS hit, count(*) AS n FROM symbols GROUP BY ALL),
top AS (SELECT file_path, min(id) AS hit FROM symbols GROUP BY file_path),
rules AS (
  SELECT CASE WHEN source_name = '<file>' THEN t.hit WHEN source_parent_name IS NOT NULL THEN c.hit ELSE s.hit END AS source_symbol_id,
    CASE WHEN target_file IS NOT NULL AND target_parent_name IS NOT NULL THEN d.hit WHEN target_file IS NOT NULL THEN CASE WHEN f.n = 1 THEN f.hit END WHEN a.n = 1 THEN a.hit END AS target_symbol_id, 'calls' AS ref_kind, source_line, 'direct' AS confidence
  FROM mixed m LEFT JOIN top t ON t.file_path = m.source_file LEFT JOIN in_class c ON c.file_path = m.source_file AND c.parent_name = m.source_parent_name AND c.name = m.source_name
  LEFT JOIN in_file s ON s.file_path = m.source_file AND s.name = m.source_name LEFT JOIN in_class d ON d.file_path = m.target_file AND d.parent_name = m.target_parent_name AND d.name = m.target_name
  LEFT JOIN in_file f ON f.file_path = m.target_file AND f.name = m.target_name LEFT JOIN anywhere a ON a.name = m.target_name)
"""


def with_graph(body: str, *more: str) -> str:
    return "WITH RECURSIVE " + ",".join((SYMBOLS_SQL, REFERENCES_SQL, *more)) + body
