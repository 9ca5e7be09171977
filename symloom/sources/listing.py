"""A source of changes without a feed: two listings of a tree, compared.

Listings are tables in a folder that driver and executors share, each a numbered version. A reader asks for the changes
from the version that it applied last to a later one, so a comparison whose reader failed is made again and gives the
same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symloom.shared import exists, list_names, new_folder

LISTING = "path string, last_modified timestamp, content_hash string"


def compare(last: DataFrame, now: DataFrame) -> DataFrame:
    """(path, op, content_hash): ``add``, ``change`` or ``unlink`` for each path in which two listings (path, content_hash, ...) differ.

    A listing names a path once. A null hash equals a null hash only.
    """
    a = last.select("path", F.col("content_hash").alias("old"), F.lit(True).alias("was"))
    b = now.select("path", F.col("content_hash").alias("new"), F.lit(True).alias("is"))
    both = a.join(b, "path", "full_outer")
    op = F.when(F.col("was").isNull(), "add").when(F.col("is").isNull(), "unlink").when(~F.col("old").eqNullSafe(F.col("new")), "change")
    return both.select("path", op.alias("op"), F.col("new").alias("content_hash")).where("op is not null")


class ListingState:
    """Listings by number in one folder: ``000007`` is complete when its files have Spark's success mark."""

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark, self.folder = spark, (folder or new_folder(spark, "listings")).rstrip("/")

    def versions(self) -> list[int]:
        return sorted(int(n) for n in list_names(self.spark, self.folder) if n.isdigit() and exists(self.spark, f"{self.folder}/{n}/_SUCCESS"))

    def listing(self, version: int) -> DataFrame:
        """Listing 0 is empty."""
        if not version:
            return self.spark.createDataFrame([], LISTING)
        return self.spark.read.schema(LISTING).parquet(f"{self.folder}/{version:06d}")

    def take(self, now: DataFrame) -> int:
        """Keep a new listing (path, last_modified, content_hash); its number."""
        version = max(self.versions(), default=0) + 1
        now.select("path", "last_modified", "content_hash").write.mode("overwrite").parquet(f"{self.folder}/{version:06d}")
        return version

    def between(self, first: int, last: int) -> DataFrame:
        """What the listings from one to another change; whoever applies it remembers ``last``, so nothing is lost or applied twice."""
        return compare(self.listing(first), self.listing(last))
