"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text's features are the distinct hashed words, word pairs and pairs with one word skipped, in 2^BITS places. FTRL
keeps a learning rate per coordinate and an L1 term that leaves most weights at exactly zero: the model is a few
thousand (place, weight) pairs, 2^BITS at most, and is broadcast.

The fit takes at most ``sample`` labelled rows (a documented bound: those with the smallest hash of their id, so
every size behaves alike), whose features are made in parallel; the sequential pass over them runs in one task.
Scoring covers every row and whole texts. Rows whose crc32(id as text) mod 3 is 1 are held out of the fit. Only the
text enters a score.

Defined cases: a null text is empty; a text without words scores as the model's intercept says; a null id is never
labelled and is not held out; labels that are null or contradict each other for one id (the larger counts) do no
harm; of rows that share a labelled id the greatest text is learnt; without labelled rows every score is 0; an empty table gives an empty result; other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symloom.llm.common import materialise, text_or_empty

BITS = 20
SAMPLE = 12_000
EPOCHS = 5
ALPHA, BETA, L1, L2 = 3.0, 1.0, 3.0, 0.01
TOXIC = 0.7
#: Words kept with their hash in a Python worker.
TABLE = 150_000
#: Words of a text whose features are made at a time when scoring.
SPAN = 1 << 16


class WordHashes(dict):
    """64-bit hashes of words without the signs around them."""

    def __missing__(self, piece: bytes) -> int:
        if len(self) >= TABLE:
            self.clear()
        word = piece.lower().strip("\"'.,;:!?()[]{}<>*#$%&/\\-_=+~^|`@")
        found = self[piece] = xxhash.xxh3_64_intdigest(word.encode()) if word else 0
        return found


HASHES = WordHashes()


def features(text: str) -> np.ndarray:
    """Sorted distinct places of the text's words, pairs and skip pairs."""
    words = text.split()
    parts = [np.zeros(0, dtype=np.uint32)]
    for i in range(0, len(words), SPAN):
        h = np.fromiter(map(HASHES.__getitem__, words[i : i + SPAN + 2]), dtype=np.uint64)
        pair = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:] * np.uint64(0xC2B2AE3D27D4EB4F)
        skip = h[:-2] * np.uint64(0x165667B19E3779F9) + h[2:] * np.uint64(0x27D4EB2F165667C5)
        both = np.concatenate([h[:SPAN], pair[:SPAN], skip[:SPAN]])
        parts.append(np.unique(((both ^ both >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - BITS)).astype(np.uint32)))
    return parts[1] if len(parts) == 2 else np.unique(np.concatenate(parts))


def fit_ftrl(rows: list[np.ndarray], labels: list[int], epochs: int = EPOCHS, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2) -> tuple[np.ndarray, float]:
    """Weights and intercept after ``epochs`` passes in the given order."""
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    bias = zb = nb = 0.0
    for _ in range(epochs):
        for x, y in zip(rows, labels, strict=True):
            zx, nx = z[x], n[x]
            root = np.sqrt(nx)
            w = np.where(np.abs(zx) <= l1, 0.0, (np.sign(zx) * l1 - zx) / ((beta + root) / alpha + l2))
            p = 1 / (1 + np.exp(-np.clip(w.sum() + bias, -35, 35)))
            g = p - y
            sigma = (np.sqrt(nx + g * g) - root) / alpha
            z[x] = zx + g - sigma * w
            n[x] = nx + g * g
            zb += g - ((nb + g * g) ** 0.5 - nb**0.5) / alpha * bias
            nb += g * g
            bias = -zb / ((beta + nb**0.5) / alpha)
    weights = np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((beta + np.sqrt(n)) / alpha + l2))
    return weights, bias


def held_out(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.encode(F.col(id_col).cast("string"), "UTF-8")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray, float]:
    """(places, weights, intercept) from a bounded sample of the labelled rows that are not held out."""

    def featurise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"key": pdf["key"], "y": pdf["y"], "x": [features(t).astype(np.int32) for t in pdf["text"]]})

    def train(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("key")
        weights, bias = fit_ftrl([np.asarray(x) for x in pdf["x"]], pdf["y"].tolist())
        used = np.flatnonzero(weights)
        return pd.DataFrame({"place": np.r_[used, -1], "weight": np.r_[weights[used], bias]})

    own = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col)).groupBy(F.col(id_col).alias("__id")).agg(F.max(label_col).cast("double").alias("y"))
    chosen = own.withColumn("key", F.xxhash64(F.lit(6), "__id")).orderBy("key", "__id").limit(sample)
    chosen = materialise(chosen, "label-sample")
    texts = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    rows = texts.join(F.broadcast(chosen), texts["doc_id"] == chosen["__id"])
    rows = rows.groupBy("key", "y").agg(F.max("text").alias("text"))  # `sample` rows at most
    model = rows.mapInPandas(featurise, "key long, y double, x array<int>").groupBy().applyInPandas(train, "place long, weight double").collect()  # 2^BITS + 1 rows at most
    found = {r["place"]: r["weight"] for r in model}
    bias = found.pop(-1, -35.0)
    places = np.array(sorted(found), dtype=np.int64)
    return places, np.array([found[p] for p in places.tolist()]), bias


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], text_col: str = "text") -> Column:
    """The score of each row's text; rows themselves stay in the JVM."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scores(texts: pa.Array) -> pa.Array:
        places, weights, bias = shared.value
        full = np.zeros(1 << BITS)
        full[places] = weights
        # Twelve digits: the order in which a machine adds must not show.
        sums = np.array([np.round(full[features(t.as_py())].sum() + bias, 9) for t in texts])
        return pa.array(np.round(1 / (1 + np.exp(-np.clip(sums, -35, 35))), 12), pa.float64())

    scores.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(scores, "double")(text_or_empty(F.col(f"`{text_col}`")))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted for each row."""
    own = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    found = own.select("doc_id", score(own, fit(docs, labels, id_col, text_col)).alias("score"))
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= TOXIC).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that score as toxic; all columns stay as they are."""
    return docs.where(score(docs, fit(docs, labels, id_col, text_col), text_col) < TOXIC)
