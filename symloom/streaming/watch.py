"""A stored graph that follows a source tree: listings are compared, what changed is parsed, and the graph updated once.

The number of a listing is the epoch of the update that brings the graph to it. So a poll that failed anywhere is made
up for by the next one: the graph's epoch tells from which listing on changes are still to be applied.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symloom.operators.stored import StoredGraph, Touched
from symloom.sources.listing import ListingState

#: From files (path, content): symbols, references by name, import pairs.
Parse = Callable[[DataFrame], tuple[DataFrame, DataFrame, DataFrame]]


def poll(graph: StoredGraph, listings: ListingState, tree: DataFrame, parse: Parse) -> Touched:
    """Bring the graph to the state of a tree (path, last_modified, content, content_hash): only files that differ are parsed."""
    graph.recover()
    version = listings.take(tree)
    changes = listings.between(max(graph.epoch(), 0), version)
    there = changes.where("op <> 'unlink'").select("path")
    symbols, named_refs, imports = parse(tree.join(there, "path", "left_semi").select("path", "content"))
    n = symbols.groupBy(F.col("file_path").alias("path")).agg(F.count(F.lit(1)).alias("n"))
    read = changes.join(n, "path", "left").select("path", "content_hash", F.coalesce("n", F.lit(0)).alias("symbol_count"), F.lit(None).cast("string").alias("error"))
    return graph.update(read, symbols, named_refs, imports, epoch=version)
