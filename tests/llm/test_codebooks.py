"""Vector codes against plain product quantisation in Python integers."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from symloom.llm import codebooks

SCHEMA = "vec_id long, embedding array<float>, label int, code string, parts int, vector string"


def make_rows(seed=1, n=300, width=32):
    rng = random.Random(seed)
    rows = [(i, [rng.gauss(0, 0.2) for _ in range(width)], rng.choice([1, 1, 2, None]), "c", 1, "v") for i in range(n)]
    rows[3] = (3, None, 1, "c", 1, "v")
    rows[4] = (4, [None, *rows[5][1][1:]], 1, "c", 1, "v")
    rows[6] = (6, [math.nan, *rows[5][1][1:]], 1, "c", 1, "v")
    rows[7] = (7, [-math.inf, *rows[5][1][1:]], 1, "c", 1, "v")
    rows[8] = (8, [], 1, "c", 1, "v")
    rows[9] = (9, [0.5], 1, "c", 1, "v")
    rows[20] = (20, rows[21][1], 2, "c", 1, "v")
    rows[22] = (None, rows[21][1], 2, "c", 1, "v")
    rng.shuffle(rows)
    return [*rows, rows[0], rows[1]]


def plain(rows, parts, entries, rounds):
    kept = sorted(((r[0] is None, r[0] or 0, [float(np.float32(x)) for x in r[1]]), r) for r in rows if r[1] and all(x is not None and math.isfinite(x) for x in r[1]) and len(r[1]) > 1)
    vectors = [([math.floor(256 * x) for x in key[2]], r) for key, r in kept]
    width = len(vectors[0][0]) // parts
    cut = lambda v: [v[p * width : (p + 1) * width] for p in range(parts)]
    books = [[cut(v)[p] for v, _ in vectors[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    assign = lambda v: [min((far(x, e), i) for i, e in enumerate(books[p])) for p, x in enumerate(cut(v))]
    for _ in range(rounds):
        found = [[assign(v), cut(v)] for v, _ in vectors]
        for p in range(parts):
            for i in range(len(books[p])):
                if own := [c[p] for a, c in found if a[p][1] == i]:
                    books[p][i] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    sha = hashlib.sha256(",".join(str(x) for p in books for e in p for x in e).encode()).hexdigest()
    out = [(r[0], r[2], "".join(f"{i:02x}" if entries <= 256 else f"{i:04x}" for _, i in assign(v)), sum(d for d, _ in assign(v))) for v, r in vectors]
    label = lambda k: sum(d for _, x, _, d in out if x == k)
    return sorted((str(i), code, d, label(k), sha) for i, k, code, d in out)


@pytest.mark.parametrize(("parts", "entries", "pivots"), [(16, 64, 4), (8, 20, 3), (4, 500, 1)])
def test_codes_are_those_of_plain_integers(spark, parts, entries, pivots):
    rows = make_rows()
    found = codebooks.compress(spark.createDataFrame(rows, SCHEMA).repartition(5), parts=parts, entries=entries, pivots=pivots)
    assert sorted((str(r["vec_id"]), r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in found.collect()) == plain(rows, parts, entries, 2)


def test_bounds_prune_and_lose_nothing():
    rng = np.random.default_rng(3)
    for width, scale in ((4, 50), (2, 3), (4, 1 << 28)):  # coarse ones have many ties
        points, entries = rng.integers(-scale, scale, (3000, width)), rng.integers(-scale, scale, (64, width))
        pivots = codebooks.choose_pivots(entries, 4)
        far = codebooks.squared(points[:, None], pivots[None])
        at, best, tried = codebooks.nearest(points, far, entries, pivots)
        every = codebooks.squared(points[:, None], entries[None])
        assert (at == every.argmin(axis=1)).all() and (best == every.min(axis=1)).all()
        assert tried < 0.5 * every.size or scale == 3


def test_few_rows_none_and_wrong_shapes(spark):
    rows = [(1, [0.5] * 16, 1), (2, [0.25] * 16, None)]
    found = codebooks.compress(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert sorted((r["code"], r["error"]) for r in found) == [("00" * 16, 0), ("01" * 16, 0)]
    empty = spark.createDataFrame([(1, None, 1)], "vec_id long, embedding array<double>, label int")
    assert codebooks.compress(empty).collect() == []
    with pytest.raises(ValueError, match="cut into"):
        codebooks.compress(spark.createDataFrame([(1, [0.5], 1)], "vec_id long, embedding array<double>, label int"))
    with pytest.raises(Exception, match="after scaling"):
        codebooks.compress(spark.createDataFrame([(1, [1e30] * 16, 1)], "vec_id long, embedding array<double>, label int")).collect()
    renamed = spark.createDataFrame(rows, "`v.id` string, `e.m` array<double>, `l.b` string")
    assert codebooks.compress(renamed, "v.id", "e.m", "l.b").count() == 2


def test_decoded_vectors_are_near(spark):
    df = spark.createDataFrame(make_rows(2, 500), SCHEMA)
    vectors, books = codebooks.train(codebooks.kept_vectors(df, "vec_id", "embedding", "label"))
    back = codebooks.decode(codebooks.codes(vectors, books), books).select("vec_id", "vector").where("vec_id is not null").dropDuplicates(["vec_id"])
    met = back.join(df.dropDuplicates(["vec_id"]).select("vec_id", "embedding"), "vec_id")
    off = met.select(F.sqrt(F.aggregate(F.zip_with("vector", "embedding", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, x: a + x)).alias("d")).agg(F.avg("d")).first()[0]
    assert met.count() > 480 and off < 0.8 * 0.2 * 32**0.5
