"""Vector codes: product quantisation in integers, nearest entries found by LAESA pivots.

Components become integers, vectors are cut into equal parts, and each part has a codebook that starts as that part of
the vectors with the smallest ids and is moved to its parts' means in each round.

LAESA: each codebook's first entries give a few fixed pivots, far from each other. The exact integer distances of every
part to its pivots are computed once and written with the vectors. In each round the pivots' distances to the moved
entries give, by the triangle inequality, a lower bound |d(part, pivot) - d(pivot, entry)| for each entry. Entries are
tried in the order of their bounds, by exact integer distances, until the next bound exceeds the best distance: what is
left cannot be nearer or equal. Bounds are lowered by more than their rounding errors, so the result is exact.

Only the codebooks (entries x dimension integers) go through the driver; tasks sum the parts of each entry before
anything is shuffled.

Defined cases: rows take no part whose vector is null, empty, or holds null or non-finite components, or whose length
is not that of the kept vector with the smallest id (then first in order of its components); that length must be a
multiple of ``parts``. Null ids come last. Fewer vectors than entries give as many entries; an empty table an empty
result. Components of 2^29 and more after scaling would leave 64-bit integers and raise ValueError. Equal rows get
equal codes; other columns may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symloom.llm.common import materialise

PARTS, ENTRIES, ROUNDS, SCALE, PIVOTS = 16, 64, 2, 256, 4
#: Scaled components are below this; parts of up to 8 components then have distances below 2^63.
MOST = 1 << 29
#: Parts whose bounds are held at a time.
CHUNK = 1 << 14


def scaled(vectors: np.ndarray, scale: int) -> np.ndarray:
    """Components to integers, all floors going down."""
    x = np.floor(vectors.astype(np.float64) * scale)
    if x.size and np.abs(x).max() >= MOST:
        raise ValueError(f"components of {MOST} and more after scaling by {scale}")
    return x.astype(np.int64)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return ((a - b) ** 2).sum(axis=-1)


def choose_pivots(entries: np.ndarray, n: int) -> np.ndarray:
    """Of one codebook, the first entry and then each time the one farthest from those chosen, summed over them."""
    chosen, total = [0], np.zeros(len(entries))
    while len(chosen) < min(n, len(entries)):
        total += np.sqrt(squared(entries, entries[chosen[-1]]))
        total[chosen] = -1
        chosen.append(int(total.argmax()))
    return entries[chosen]


def nearest(points: np.ndarray, to_pivots: np.ndarray, entries: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(index, squared distance) of each point's nearest entry, ties to the lower index; and how many distances were computed.

    points: n x width; to_pivots: n x pivots, squared distances; entries: k x width; pivots: p x width.
    """
    n, k = len(points), len(entries)
    at, best, tried = np.full(n, k), np.full(n, np.iinfo(np.int64).max), 0
    moved = np.sqrt(squared(pivots[:, None, :], entries[None]))
    for low in range(0, n, CHUNK):
        high = min(n, low + CHUNK)
        root = np.sqrt(to_pivots[low:high])
        bound = np.zeros((high - low, k))
        for p in range(len(pivots)):
            np.maximum(bound, np.abs(root[:, p, None] - moved[None, p]), out=bound)
        # Roots and differences are off by some 2^-52 of the larger distance.
        bound = np.maximum(bound - 1e-12 * (root.max(axis=1, initial=0)[:, None] + moved.max(initial=0)), 0)
        bound *= bound
        order = np.argsort(bound, axis=1)
        rows = np.arange(high - low)
        for step in range(k):
            entry = order[rows, step]
            open_ = bound[rows, entry] <= best[low + rows] * (1 + 1e-12)
            rows, entry = rows[open_], entry[open_]
            if not len(rows):
                break
            tried += len(rows)
            distance = squared(points[low + rows], entries[entry])
            better = (distance < best[low + rows]) | (distance == best[low + rows]) & (entry < at[low + rows])
            best[low + rows[better]], at[low + rows[better]] = distance[better], entry[better]
    return at, best, tried


@dataclass
class Codebooks:
    """entries: parts x entries x width; pivots: parts x pivots x width."""

    entries: np.ndarray
    pivots: np.ndarray

    def assign(self, points: np.ndarray, to_pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entries and squared distances, rows x parts; points: rows x parts x width, to_pivots: rows x parts x pivots."""
        found = [nearest(points[:, p], to_pivots[:, p], self.entries[p], self.pivots[p])[:2] for p in range(len(self.entries))]
        return np.stack([a for a, _ in found], axis=1), np.stack([d for _, d in found], axis=1)

    def moved(self, sums: dict[tuple[int, int], tuple[int, list[int]]]) -> Codebooks:
        """Entries at the means (floors) of their parts: (part, entry) to (number of parts, sums of components)."""
        entries = self.entries.copy()
        for (part, entry), (n, total) in sums.items():
            entries[part, entry] = [x // n for x in total]
        return Codebooks(entries, self.pivots)

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def kept_vectors(rows: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(vec_id, label, vector) of rows with a vector of finite components."""
    v = F.col(f"`{vector_col}`").cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.select(F.col(f"`{id_col}`").alias("vec_id"), F.col(f"`{label_col}`").alias("label"), F.col(f"`{vector_col}`").alias("vector")).where(F.coalesce((F.size(v) > 0) & fine, F.lit(False)))


def first_codebooks(kept: DataFrame, parts: int, entries: int, scale: int, pivots: int) -> Codebooks | None:
    """The parts of the vectors with the smallest ids, so many of them; None if there are no vectors."""
    order = (F.col("vec_id").asc_nulls_last(), "vector")
    first = kept.orderBy(*order).limit(1).select(F.size("vector")).first()
    if first is None:
        return None
    if first[0] % parts:
        raise ValueError(f"vectors of {first[0]} components cannot be cut into {parts} parts")
    rows = kept.where(F.size("vector") == first[0]).orderBy(*order).limit(entries).select("vector").collect()
    own = scaled(np.array([r[0] for r in rows]), scale).reshape(len(rows), parts, -1).transpose(1, 0, 2)
    return Codebooks(own, np.stack([choose_pivots(x, pivots) for x in own]))


def matrix(column: pa.Array, dtype: type) -> np.ndarray:
    """Lists of one length as rows."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def with_pivot_distances(kept: DataFrame, books: Codebooks, scale: int) -> DataFrame:
    """(vec_id, label, parts, pivots), written: integer components, and squared distances of each part to each pivot."""
    pivots, (n_parts, _, width) = books.pivots, books.entries.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            points = scaled(matrix(batch.column(2), np.float64), scale)
            far = squared(points.reshape(-1, n_parts, 1, width), pivots[None]).reshape(len(points), -1)
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(kind)) for x, kind in ((points.astype(np.int32), pa.int32()), (far, pa.int64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *lists], names=["vec_id", "label", "parts", "pivots"])

    kinds = {f.name: f.dataType.simpleString() for f in kept.schema}
    rows = kept.where(F.size("vector") == n_parts * width)
    return materialise(rows.mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, parts array<int>, pivots array<long>"), "integer-vectors")


def _points(batch: pa.RecordBatch, at: int, shape: tuple[int, int, int]) -> tuple[np.ndarray, np.ndarray]:
    n_parts, _, width = shape
    return matrix(batch.column(at), np.int64).reshape(-1, n_parts, width), matrix(batch.column(at + 1), np.int64).reshape(len(batch), n_parts, -1)


def move(vectors: DataFrame, books: Codebooks) -> Codebooks:
    """One round: every part to its nearest entry, then every used entry to its parts' mean."""
    shape = n_parts, n_entries, width = books.entries.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros((n_parts, n_entries), np.int64), np.zeros((n_parts, n_entries, width), np.int64)
        for batch in batches:
            if not len(batch):
                continue
            points, far = _points(batch, 0, shape)
            at, _ = books.assign(points, far)
            for p in range(n_parts):
                n[p] += np.bincount(at[:, p], minlength=n_entries)
                np.add.at(total[p], at[:, p], points[:, p])
        part, entry = np.nonzero(n)
        sums = pa.FixedSizeListArray.from_arrays(pa.array(total[part, entry].ravel()), width).cast(pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(entry.astype(np.int32)), pa.array(n[part, entry]), sums], names=["part", "entry", "n", "sums"])

    found = vectors.select("parts", "pivots").mapInArrow(run, "part int, entry int, n long, sums array<long>")
    each = [F.sum(F.element_at("sums", k + 1)) for k in range(width)]
    rows = found.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*each).alias("sums")).collect()  # parts x entries at most
    return books.moved({(r["part"], r["entry"]): (r["n"], r["sums"]) for r in rows})


def codes(vectors: DataFrame, books: Codebooks) -> DataFrame:
    """(vec_id, label, code, error): indexes of each part's entry, two hex digits each (four beyond 256 entries), and the summed squared distance."""
    shape = books.entries.shape
    digits = 2 if shape[1] <= 256 else 4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            at, far = books.assign(*_points(batch, 2, shape))
            code = [x.tobytes().hex() for x in at.astype(">u1" if digits == 2 else ">u2")]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(code), pa.array(far.sum(axis=1))], names=["vec_id", "label", "code", "error"])

    kinds = {f.name: f.dataType.simpleString() for f in vectors.schema}
    return vectors.mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long")


def train(kept: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, pivots: int = PIVOTS) -> tuple[DataFrame, Codebooks] | None:
    """The integer vectors (written) and the codebooks after so many rounds; None if there are no vectors."""
    books = first_codebooks(kept, parts, entries, scale, pivots)
    if books is None:
        return None
    vectors = with_pivot_distances(kept, books, scale)
    for _ in range(rounds):
        books = move(vectors, books)
    return vectors, books


def decode(coded: DataFrame, books: Codebooks, scale: int = SCALE) -> DataFrame:
    """Rows (with ``code``) and ``vector``, what the code stands for: the middle of each integer's interval."""
    n_parts, n_entries, _ = books.entries.shape
    digits = 2 if n_entries <= 256 else 4
    table = F.array(*[F.array(*[F.array(*[F.lit((x + 0.5) / scale) for x in e]) for e in p]) for p in books.entries.tolist()])
    index = lambda p: F.conv(F.substring("code", p * digits + 1, digits), 16, 10).cast("int") + 1
    return coded.withColumn("vector", F.concat(*[F.element_at(F.element_at(table, p + 1), index(p)) for p in range(n_parts)]))


def compress(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", **settings) -> DataFrame:
    """vec_id, code, error, label_error (errors summed over equal labels), codebooks_sha256 of every kept vector."""
    kept = kept_vectors(rows, id_col, vector_col, label_col)
    trained = train(kept, **settings)
    if trained is None:
        return kept.select("vec_id", *[F.lit(None).cast(t).alias(n) for n, t in (("code", "string"), ("error", "long"), ("label_error", "long"), ("codebooks_sha256", "string"))]).limit(0)
    vectors, books = trained
    coded = materialise(codes(vectors, books), "codes")
    # One row for each label; adaptive execution broadcasts them if they are few, and splits a large label if not.
    sums = coded.groupBy("label").agg(F.sum("error").alias("label_error")).select(F.col("label").alias("own_label"), "label_error")
    met = coded.join(sums, F.col("label").eqNullSafe(F.col("own_label")))
    return met.select("vec_id", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))
