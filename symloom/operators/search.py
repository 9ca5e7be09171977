"""Search of names by many patterns in one job, through a table of grams.

A pattern's longest run of letters without wildcards gives its grams of three letters (fewer, down to none, for shorter
runs); names that hold the rarest one are met by an equality join and then checked with the whole pattern. So the rows
that are looked at follow the rarest gram's, not names times patterns. Names stand in the index once each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from symloom.schema import ValidationError
from symloom.shared import written

GRAM = 3


def _grams(text: Column, size: int) -> Column:
    """Distinct grams of a size, the empty one for size 0."""
    if not size:
        return F.array(F.lit(""))
    starts = F.sequence(F.lit(1), F.length(text) - size + 1)
    return F.when(F.length(text) >= size, F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, size)))).otherwise(F.array().cast("array<string>"))


def gram_index(names: DataFrame, sizes: tuple[int, ...] = (GRAM,)) -> DataFrame:
    """(gram, name): each distinct name (column ``name``) with the grams of its lower-case form."""
    own = F.lower("name")
    return names.select("name").where("name is not null").distinct().select("name", F.explode(F.concat(*[_grams(own, n) for n in sizes])).alias("gram"))


def search_many(symbols: DataFrame, patterns: DataFrame, limit: int | None = 20, literal: bool = False) -> DataFrame:
    """(pattern, id, name, kind, file_path, line) of the symbols whose name holds each pattern (column ``pattern``), whatever the case.

    ``%`` and ``_`` are wildcards unless ``literal``; a backslash stands for itself. The first ``limit`` by id for each
    pattern, all if it is None. A null pattern finds nothing.
    """
    if limit is not None and limit < 1:
        raise ValidationError("limit is 1 or more")
    low = F.lower("pattern")
    runs = F.array(low) if literal else F.split(low, "[%_]")
    longest = F.array_max(F.transform(runs, lambda r: F.struct(F.length(r).alias("n"), r.alias("run"))))
    wanted = patterns.select("pattern").where("pattern is not null").distinct().withColumn("run", longest["run"])
    wanted = written(wanted.withColumn("size", F.least(F.lit(GRAM), F.length("run"))), "patterns")
    sizes = tuple(sorted(r[0] for r in wanted.select("size").distinct().collect()))  # 0 to 3
    if not sizes:
        sizes = (GRAM,)
    index = written(gram_index(symbols, sizes), "grams")
    each = None
    for n in sizes:
        own = wanted.where(F.col("size") == n).select("pattern", F.explode(_grams(F.col("run"), n)).alias("gram"))
        each = own if each is None else each.union(own)
    # The rarest gram of each pattern; a gram that no name has ends the search for it.
    common = index.join(each.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    rarest = each.join(common, "gram", "left").groupBy("pattern").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("x"))
    rarest = rarest.where("x.n > 0").select("pattern", F.col("x.gram").alias("gram"))
    met = index.join(rarest, "gram")
    holds = F.contains(F.lower("name"), low) if literal else F.expr(r"lower(name) like concat('%', replace(lower(pattern), '\\', '\\\\'), '%')")
    names = met.where(holds).select("pattern", "name")
    found = symbols.join(names, "name").select("pattern", "id", "name", "kind", "file_path", "line")
    if limit is None:
        return found
    place = F.row_number().over(Window.partitionBy("pattern").orderBy("id"))
    return found.withColumn("place", place).where(F.col("place") <= limit).drop("place")


def prefix_index(prefixes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A trie by segments as rows, of prefixes (column ``prefix``).

    Nodes: (node, lengths), what ends at a slash (or nothing), and the lengths that go on from there; leaves: (node,
    rest, prefix).
    """
    node = F.regexp_extract("prefix", "^(.*/)?", 0)
    leaves = prefixes.select("prefix").where("prefix is not null").distinct().select(node.alias("node"), F.expr("substring(prefix, length(regexp_extract(prefix, '^(.*/)?', 0)) + 1)").alias("rest"), "prefix")
    return leaves.groupBy("node").agg(F.sort_array(F.collect_set(F.length("rest"))).alias("lengths")), leaves


def longest_prefix(routes: DataFrame, prefixes: DataFrame, route: str = "route") -> DataFrame:
    """Rows of ``routes`` with ``prefix``, the longest of the prefixes that their route starts with; rows without any are left out.

    A route meets the trie's nodes at its own slashes, a row for each, and goes on from a node only by the lengths that
    occur there, so the rows follow its segments and not its letters.
    """
    nodes, leaves = prefix_index(prefixes)
    own = routes.select(F.col(f"`{route}`").alias("route")).where("route is not null").distinct()
    parts = F.split("route", "/")
    at = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda d: F.when(d == 0, F.lit("")).otherwise(F.concat(F.array_join(F.slice(parts, 1, d), "/"), F.lit("/"))))
    steps = own.select("route", F.explode(at).alias("node")).join(nodes, "node")
    # Lengths that the rest of the route has room for.
    room = F.length("route") - F.length("node")
    tries = steps.select("route", "node", F.explode(F.filter("lengths", lambda n: n <= room)).alias("n"))
    tries = tries.select("route", "node", F.expr("substring(route, length(node) + 1, n)").alias("rest"))
    best = tries.join(leaves, ["node", "rest"]).groupBy("route").agg(F.max_by("prefix", F.length("prefix")).alias("prefix"))
    return routes.join(best.select(F.col("route").alias(route), "prefix"), route)
