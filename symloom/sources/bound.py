"""The project that readers see: graphs of several roots side by side, and a view that names the current one.

A root is bound by building its tables beside those of the root before it and then replacing the view, one statement.
Whoever opened the graph before that goes on reading the old tables, which stay until they are retired; a build that
fails leaves the view as it was.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession

from symloom.operators.stored import StoredGraph
from symloom.schema import ValidationError
from symloom.shared import remove


class Binding:
    def __init__(self, spark: SparkSession, view: str = "default.current_project", **settings: int):
        self.spark, self.view, self.settings = spark, view, settings

    def _row(self):
        return self.spark.table(self.view).first() if self.spark.catalog.tableExists(self.view) else None

    @property
    def root(self) -> str | None:
        row = self._row()
        return row and row["root"]

    def open(self) -> StoredGraph:
        """The current root's graph; it stays this one for the reader, whatever is bound later."""
        row = self._row()
        if row is None:
            raise ValidationError("no project is bound")
        return StoredGraph(self.spark, row["database"], row["folder"], **self.settings)

    def bind(self, root: str, build: Callable[[StoredGraph], object]) -> tuple[StoredGraph, bool]:
        """The graph of a root and whether it was built: the root that is bound already is not built again."""
        if self.root == root:
            return self.open(), False
        graph = StoredGraph(self.spark, f"graph_{uuid.uuid4().hex[:12]}", **self.settings)
        try:
            build(graph)
        except BaseException:
            self.retire(graph)
            raise
        text = lambda s: "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"
        self.spark.sql(f"CREATE OR REPLACE VIEW {self.view} AS SELECT {text(root)} AS root, '{graph.database}' AS database, {text(graph.folder)} AS folder")
        return graph, True

    def retire(self, graph: StoredGraph) -> None:
        """Drop a graph that nobody reads any more; the current one cannot go."""
        row = self._row()
        if row is not None and row["database"] == graph.database:
            raise ValidationError("the current project cannot be retired")
        self.spark.sql(f"DROP DATABASE IF EXISTS {graph.database} CASCADE")
        remove(self.spark, graph.folder)
