"""Bounded traversal of the call graph, one level per step, each step a join.

The edges and each level are written to the shared folder: a level reads them instead of making them anew.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symloom.schema import ValidationError
from symloom.shared import written

MAX_DEPTH = 4


def reachable(references: DataFrame, seeds: DataFrame, depth: int, kind: str = "calls") -> DataFrame:
    """(id, depth): nodes that the seeds (column ``id``) reach, with the smallest number of steps."""
    steps = written(references.where(F.col("ref_kind") == kind).select(F.col("source_symbol_id").alias("id"), F.col("target_symbol_id").alias("next")).distinct(), "steps")
    front = written(seeds.select("id").distinct().withColumn("depth", F.lit(0)), "front")
    seen = front
    for level in range(1, depth + 1):
        new = steps.join(front.select("id"), "id", "left_semi").select(F.col("next").alias("id")).distinct().join(seen.select("id"), "id", "left_anti")
        front = written(new.withColumn("depth", F.lit(level)), "front")
        seen = seen.union(front)
    return seen


def reachable_sql(references: DataFrame, seeds: DataFrame, depth: int, kind: str = "calls") -> DataFrame:
    """The same by Spark's own recursive query, for edges that fan out little, such as inheritance.

    A recursive query cannot drop what it has seen: its rows are walks, not nodes. So it stops at ``depth`` on a cycle
    too, but where walks multiply :func:`reachable` is the choice.
    """
    spark, name = references.sparkSession, f"t{uuid.uuid4().hex}"
    references.where(F.col("ref_kind") == kind).select(F.col("source_symbol_id").alias("a"), F.col("target_symbol_id").alias("b")).distinct().createOrReplaceTempView(f"{name}_steps")
    seeds.select("id").distinct().createOrReplaceTempView(f"{name}_seeds")
    return spark.sql(f"""
        WITH RECURSIVE walk(id, depth) AS (
          SELECT id, 0 FROM {name}_seeds UNION ALL SELECT b, depth + 1 FROM walk JOIN {name}_steps ON a = id WHERE depth < {depth})
        SELECT id, min(depth) AS depth FROM walk GROUP BY id""")


def clamped(max_depth: int) -> tuple[int, list[str]]:
    """The depth that is used, and what the caller is told about it (fixed wording)."""
    return max(1, min(max_depth, MAX_DEPTH)), [f"max_depth capped at {MAX_DEPTH} (requested {max_depth})"] if max_depth > MAX_DEPTH else []


def symbol_seeds(symbols: DataFrame, name: str, class_name: str | None = None) -> DataFrame:
    """(seed, name, file_path) of the symbols of a name, those of one class only if given."""
    own = symbols.where(F.col("name") == name)
    if class_name is not None:
        own = own.join(symbols.where((F.col("kind") == "class") & (F.col("name") == class_name)).select(F.col("id").alias("parent_id")), "parent_id", "left_semi")
    return own.select(F.col("id").alias("seed"), "name", "file_path")


def file_seeds(symbols: DataFrame, file_path: str) -> DataFrame:
    """(seed, name, file_path) of a file's top functions and classes; of none, the file's own name stands for it."""
    own = symbols.where((F.col("file_path") == file_path) & F.col("parent_id").isNull() & F.col("kind").isin("function", "class")).select(F.col("id").alias("seed"), "name", "file_path")
    spark = symbols.sparkSession
    stand_in = spark.range(1).select(F.lit(0).cast("long").alias("seed"), F.lit(file_path.replace("\\", "/").rpartition("/")[2]).alias("name"), F.lit(file_path).alias("file_path"))
    none = own.limit(1).agg(F.count(F.lit(1)).alias("n")).where("n = 0")
    return own.union(stand_in.join(F.broadcast(none), F.lit(True)).select("seed", "name", "file_path"))  # one row at most


def seeds_of(symbols: DataFrame, symbol_name: str | None = None, file_path: str | None = None, class_name: str | None = None) -> DataFrame:
    if (symbol_name is None) == (file_path is None):
        raise ValidationError("exactly one of symbol_name and file_path is asked for")
    return symbol_seeds(symbols, symbol_name, class_name) if file_path is None else file_seeds(symbols, file_path)


def explain_flow(symbols: DataFrame, references: DataFrame, seeds: DataFrame, max_depth: int = 3, paths: int = 3) -> DataFrame:
    """(path_rank, hops, path): the first ``paths`` call flows from the seeds (seed, name, file_path), breadth first.

    A seed goes on from the first symbol of its name, in its own file if there is one. max_depth counts the nodes of a
    path and is kept between 1 and 4. A node is visited once; a node whose targets were all visited before gives no
    path, unless nothing else does. A seed that no symbol has the name of is a path by itself.
    """
    depth, _ = clamped(max_depth)
    node = symbols.select("id", "name")
    edges = references.where(F.col("ref_kind") == "calls").groupBy(F.col("source_symbol_id").alias("id"), F.col("target_symbol_id").alias("next")).agg(F.min("source_line").alias("line"))
    edges = written(edges, "calls") if depth > 1 else edges
    named = seeds.join(symbols.select("name", "id", F.col("file_path").alias("own_file")), "name", "left")
    base = named.groupBy("seed", "name").agg(F.min(F.struct((F.col("own_file") != F.col("file_path")).alias("elsewhere"), "id")).alias("x"))
    front = base.select("seed", F.col("x.id").alias("id"), F.array("name").alias("names"), F.array(F.struct(F.lit(0).alias("line"), F.coalesce("x.id", F.lit(0).cast("long")).alias("id"))).alias("key"))
    front = written(front, "flow")
    start, visited, done = front.select("seed", "names", "key"), front.select("seed", "id"), None
    for _ in range(1, depth):
        step = front.join(edges, "id").select("seed", "names", F.concat("key", F.array(F.struct("line", F.col("next").alias("id")))).alias("key"), "next")
        leaf = front.join(edges.select("id"), "id", "left_anti").select("seed", "names", "key")
        done = leaf if done is None else done.union(leaf)
        best = step.groupBy("seed", "next").agg(F.min(F.struct("key", "names")).alias("x")).select("seed", F.col("next").alias("id"), "x.key", "x.names")
        best = best.join(visited, ["seed", "id"], "left_anti").join(node, "id")
        front = written(best.select("seed", "id", F.concat("names", F.array("name")).alias("names"), "key"), "flow")
        visited = visited.union(front.select("seed", "id"))
    last = front.select("seed", "names", "key")
    done = last if done is None else done.union(last)
    done = done.union(start.join(done.select("seed"), "seed", "left_anti").select("seed", "names", "key"))
    top = done.withColumn("hops", F.size("names")).orderBy("seed", "hops", "key").limit(paths)
    ranked = top.groupBy().agg(F.sort_array(F.collect_list(F.struct("seed", "hops", "key", "names"))).alias("x"))  # ``paths`` rows
    return ranked.select(F.posexplode("x").alias("at", "p")).select((F.col("at") + 1).alias("path_rank"), F.col("p.hops").alias("hops"), F.array_join("p.names", " -> ").alias("path"))
