"""Uniform shuffle into shards of exact size through a hypergeometric communication matrix.

Rows lie in blocks (by a hash of all their columns) and are to go to cells; a shard is a run of cells. How many rows of block b
go to cell c in a uniform shuffle follows a multivariate hypergeometric law with fixed row and column sums. The
matrix is never held whole: it is split like a tree. The cells' capacities of a range of blocks divide between its
two halves by a hypergeometric draw that is seeded by the range, so a task walks from the root to its own block and
has its row of the matrix, with no exchange between tasks. Each block then deals its rows, in a random order, to the
cells in exactly those counts; rows move to their cells; each cell permutes what it received.

Law ``rows``: shards' row counts differ by one at most. Slots of a shard run from 0 without gaps.

Only the number of rows per fine block (FINE at most) goes to the driver. A block and a cell hold about ``per_task``
rows until there are FINE of them; rows stream through a block's task, and only its labels (4 bytes a row) are held.

Rows are ordered in a block by a hash of all their columns, so a retried task deals alike; rows that tie are equal in
every column. Very many equal rows are split over blocks by their place in the table, which is a written one: reruns
over the same files agree. Defined cases: null ids and null texts are values like others; an empty table gives an empty result;
other columns may have any name.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from symloom.llm.common import free_names, materialise, text_or_empty

FINE = 4096
PER_TASK = 20_000
#: numpy draws hypergeometric numbers for populations below this.
NUMPY_MOST = 999_999_999


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """How many of ``draws`` from good + bad items are good; any size."""
    if good + bad <= NUMPY_MOST:
        return int(rng.hypergeometric(good, bad, draws))
    low, high = max(0, draws - bad), min(good, draws)
    if low == high:
        return low
    # Ratio of uniforms around the mode, for a log-concave law.
    lg = math.lgamma
    total = good + bad
    mean = draws * good / total
    sd = math.sqrt(max(1e-9, mean * (bad / total) * (total - draws) / max(1, total - 1)) + 0.5)
    mode = min(high, max(low, int((draws + 1) * (good + 1) / (total + 2))))
    weight = lambda k: -(lg(k + 1) + lg(good - k + 1) + lg(draws - k + 1) + lg(bad - draws + k + 1))
    top, width = weight(mode), 1.7156 * sd + 0.8989
    while True:
        u, v = rng.random(), rng.random() - 0.5
        k = math.floor(mean + 0.5 + width * v / max(u, 1e-300))
        if low <= k <= high and 2 * math.log(max(u, 1e-300)) <= weight(k) - top:
            return k


def divide(rng: np.random.Generator, capacity: np.ndarray, draws: int) -> np.ndarray:
    """A multivariate hypergeometric draw of ``draws`` items from cells with these capacities."""
    if capacity.sum() <= NUMPY_MOST:
        return rng.multivariate_hypergeometric(capacity, draws, method="marginals")
    out, left = np.zeros_like(capacity), int(capacity.sum())
    for i, c in enumerate(capacity.tolist()):
        if draws <= 0:
            break
        left -= c
        out[i] = hypergeometric(rng, c, left, draws) if left else draws
        draws -= int(out[i])
    return out


def matrix_row(block: int, rows: np.ndarray, capacity: np.ndarray, seed: int) -> np.ndarray:
    """Row ``block`` of the communication matrix with row sums ``rows`` and column sums ``capacity``."""
    low, high, cap = 0, len(rows), capacity
    while high - low > 1:
        mid = (low + high) // 2
        first = divide(np.random.default_rng([seed, low, high]), cap, int(rows[low:mid].sum()))
        low, high, cap = (low, mid, first) if block < mid else (mid, high, cap - first)
    return cap


def even(total: int, parts: int) -> np.ndarray:
    return np.array([total // parts + (i < total % parts) for i in range(parts)], dtype=np.int64)


def shuffle_into_shards(df: DataFrame, n_shards: int = 16, seed: int = 11, per_task: int = PER_TASK) -> DataFrame:
    """``df``, a written table, with ``shard`` and ``slot``: a uniform random assignment with shard sizes at most one apart."""
    names = [f"`{c}`" for c in df.columns]
    at_, block_, order_, cell_ = free_names(df, "at", "block", "order", "cell")
    fine = F.pmod(F.xxhash64(F.lit(seed), *names), F.lit(FINE)).cast("int")
    counted = np.zeros(FINE, dtype=np.int64)
    for r in df.groupBy(fine.alias("b")).count().collect():  # FINE rows at most
        counted[r["b"]] = r["count"]
    total = int(counted.sum())
    n_even = max(1, min(FINE, -(-total // per_task)))
    owner = np.arange(FINE) * n_even // FINE
    # Fine blocks of very many rows, which are mostly equal, are dealt to blocks of their own by the rows' places.
    large = {b: -(-int(counted[b]) // per_task) for b in np.flatnonzero(counted > 2 * max(per_task, total / FINE)).tolist()}
    first, n_blocks = {}, n_even
    for b, n in large.items():
        first[b], n_blocks = n_blocks, n_blocks + n
    placed = df.withColumn(at_, F.monotonically_increasing_id())
    block = F.floor(fine * n_even / FINE).cast("int")
    if large:
        of = F.create_map(*[F.lit(x) for b in large for x in (b, b)])  # few: each has per_task rows at least
        begin, pieces = (F.element_at(F.create_map(*[F.lit(x) for b in large for x in (b, d[b])]), fine) for d in (first, large))
        block = F.when(F.element_at(of, fine).isNull(), block).otherwise(begin + F.pmod(F.xxhash64(F.lit(seed), at_), pieces).cast("int"))
    keyed = placed.withColumn(block_, block).drop(at_)
    rows = np.bincount(owner, weights=np.where(np.isin(np.arange(FINE), list(large)), 0, counted), minlength=n_blocks).astype(np.int64)
    if large:
        for r in keyed.where(F.col(block_) >= n_even).groupBy(F.col(block_).alias("b")).count().collect():
            rows[r["b"]] = r["count"]
    cells_per_shard = max(1, min(FINE // n_shards, -(-total // (per_task * n_shards))))
    capacity = np.concatenate([even(int(s), cells_per_shard) for s in even(total, n_shards)])
    offset = np.concatenate([np.cumsum(c) - c for c in capacity.reshape(n_shards, -1)])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, labels, at = -1, np.zeros(0, dtype=np.int32), 0
        for batch in batches:
            own = batch.column(block_).to_numpy()
            out = np.empty(len(own), dtype=np.int32)
            for start, end in _runs(own):
                if own[start] != block:
                    block, at = int(own[start]), 0
                    row = matrix_row(block, rows, capacity, seed)
                    labels = np.random.default_rng([seed, 1, block]).permutation(np.repeat(np.arange(len(row), dtype=np.int32), row))
                out[start:end] = labels[at : at + end - start]
                at += end - start
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], names=[*batch.schema.names, cell_])

    keyed = keyed.withColumn(order_, F.xxhash64(F.lit(seed + 1), *names))
    local = keyed.repartition(n_blocks, block_).sortWithinPartitions(block_, order_, *names)
    dealt = local.mapInArrow(deal, T.StructType([*keyed.schema.fields, T.StructField(cell_, T.IntegerType())]))
    again = Window.partitionBy(cell_).orderBy(F.xxhash64(F.lit(seed + 2), order_), *names)
    base = F.element_at(F.lit(offset.tolist()).cast("array<long>"), F.col(cell_) + 1)
    slot = (base + F.row_number().over(again) - 1).cast("long")
    return dealt.withColumn("slot", slot).withColumn("shard", F.floor(F.col(cell_) / cells_per_shard).cast("int")).drop(block_, order_, cell_)


def _runs(values: np.ndarray) -> list[tuple[int, int]]:
    """(start, end) of each run of equal values."""
    if not len(values):
        return []
    cuts = np.flatnonzero(values[1:] != values[:-1]) + 1
    return list(zip([0, *cuts.tolist()], [*cuts.tolist(), len(values)], strict=True))


def shard_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_shards: int = 16, seed: int = 11) -> DataFrame:
    """The digest: doc_id, size (UTF-8 bytes plus 1), text_crc32, law, shard, slot, grown_shard (null under this law)."""
    text = F.encode(text_or_empty(F.col(f"`{text_col}`")), "UTF-8")
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).cast("long").alias("text_crc32"))
    rows = materialise(rows, "shard-rows")
    out = shuffle_into_shards(rows, n_shards, seed)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
