"""SimHash near-duplicates through anchor-point covering.

The 64 bits of a fingerprint are cut into ``parts`` pieces. Two fingerprints that differ in at most T bits differ in
at most floor(T / parts) bits, t, in one of the pieces (pigeonhole). A piece is compared through a covering code: the
words of a Hamming code of 15 bits, with the other bits of the piece as they are, are the anchors, and every value
lies within the covering radius 1 of exactly one anchor, its home. A fingerprint is at home at that one anchor and is
replicated to every anchor within covering radius plus t of it; so of two near fingerprints each is found at the
other's home. Each anchor compares who is at home there with all who came, over all 64 bits.

Equal fingerprints are joined before that. An anchor gives no pairs but the links of a forest over its fingerprints,
so copies in thousands cost rows in proportion; alternating stars turn links into components.

With ``similarity`` given, fingerprints only propose. They are then two with independent bits, over a text's distinct
five-word shingles, and a pair within reach in either, and within OTHER_BITS in the other one, is proposed: that is
4.5 standard deviations for texts at the limit, and one chance meeting in a hundred. First the rows that have a partner
are found. For that the pieces' reaches add up to no more than they must (``reach``), a piece's values are its anchors,
near rows meet halfway, and sets of which one has less than ``similarity`` times the size of the other, which cannot be
alike, are not compared: an anchor's rows are sorted by size. Rows with a partner get a sketch of one-bit minhashes of the
same shingles and meet at the anchors once more: pairs whose sketches are CLEARLY on one side of the limit (over four
standard errors) are linked or left. The open ones, unless clear links join their groups, are decided by the exact
Jaccard similarity of the shingles' 64-bit hashes, in rounds. First a spanning forest of the most similar is compared,
so no more pairs than texts leave an anchor and most groups are whole at once. Where a pair of the forest fails, other
pairs may still join the two groups: every open pair between groups next to a failed one comes in the next round, but
for those that were compared before. If they are too many for a task (over FORESTS for each text), FORESTS disjoint
forests of them come, and another round follows, until none is left. This keeps chance meetings of fingerprints, which
grow with the square of the corpus, out of the groups, and so allows a wide radius.

At a large anchor a home row skips all that its group already holds, so a cluster of near copies is not compared pair
by pair once links join it.

With three pieces an anchor sees one of about 3,000 fingerprints; ``parts=2`` (t = 2) is the choice beyond some
hundred million distinct ones: more rows for each, but an anchor sees one of some 100,000.

Defined cases: a null text is empty; a text without words has fingerprint zero and is linked like any other; a row
without an id has a fingerprint but takes no part in linking, and its component is null; equal ids are one node; an
empty table gives an empty result; other columns may have any name.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symloom.llm.common import free_names, materialise, text_or_empty
from symloom.llm.components import connected_components

SHINGLE = 4
THRESHOLD = 4
PARTS = 3
#: Pairs compared at a time in a task, and sketches; rows that make an anchor large, and home rows taken there at a time.
BLOCK, SKETCH_BLOCK, LARGE, HOMES_AT_ONCE = 1 << 18, 1 << 15, 4096, 32
#: To find rows with a partner: rows against how many others at a time; rows sent to anchors at a time in a task, and held there.
LEFTS_AT_ONCE, COLUMNS, SPREAD_AT_ONCE, COMPARE_AT_ONCE = 64, 4096, 1 << 18, 1 << 16
#: One-bit minhashes in a sketch, and words in their shingles.
SKETCH_BITS, SKETCH_WORDS = 1024, 5
#: In how many bits the other fingerprint of a proposed pair may differ.
OTHER_BITS = 22
#: How far from the limit a similarity shown by sketches must be to decide: 4.2 standard errors at 0.8.
CLEARLY = 0.08
#: Open pairs for each group, and disjoint forests of them, that a task gives in a round after the first.
FORESTS = 8


def shingle_hashes(text: str, shingle: int) -> np.ndarray:
    words = text.encode().lower().split()
    n = len(words)
    if not n:
        return np.zeros(0, dtype="<u8")
    joined = b" ".join(words)
    ends = list(itertools.accumulate(map(len, words), lambda a, b: a + 1 + b))
    k = min(shingle, n)
    h = xxhash.xxh64_intdigest
    starts = [0, *[e + 1 for e in ends[: n - k]]]
    return np.array([h(joined[a:b], 42) for a, b in zip(starts, ends[k - 1 :], strict=True)], dtype="<u8")


def _majority(hashes: np.ndarray) -> int:
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 8192):
        ones += np.unpackbits(hashes[i : i + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes), bitorder="little").tobytes(), "little")


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    return _majority(shingle_hashes(text, shingle))


def fingerprint_pair(shingles: np.ndarray) -> tuple[int, int]:
    """Two fingerprints with independent bits, of a text's distinct shingles."""
    other = (shingles ^ shingles >> np.uint64(31)) * np.uint64(0x9E3779B97F4A7C15)
    other = (other ^ other >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    return _majority(shingles), _majority(other ^ other >> np.uint64(32))


_ORDERS = np.random.default_rng(11).integers(0, 1 << 32, (2, SKETCH_BITS), dtype=np.uint32) | np.array([[1], [0]], dtype=np.uint32)


def sketch(shingles: np.ndarray) -> bytes:
    """One bit of each of SKETCH_BITS minima over the text's distinct shingles; equal minima give equal bits."""
    hashes = np.unique((shingles >> np.uint64(32)).astype(np.uint32))
    least = np.full(SKETCH_BITS, (1 << 32) - 1, dtype=np.uint32)
    for i in range(0, len(hashes), 256):
        np.minimum(least, (hashes[i : i + 256, None] * _ORDERS[0] + _ORDERS[1]).min(axis=0), out=least)
    least = (least ^ least >> np.uint32(15)) * np.uint32(0x2C1B3C6D)
    least = (least ^ least >> np.uint32(12)) * np.uint32(0x297A2D39)
    return np.packbits(least >> np.uint32(31)).tobytes()


def _per_text(docs: DataFrame, id_col: str, text_col: str, names: list[str], kind: str, of: Callable[[str], tuple]) -> DataFrame:
    """doc_id and, for each text, the values that ``of`` gives."""
    types = [pa.binary() if " binary" in x else pa.list_(pa.int64()) if "array" in x else pa.int64() for x in kind.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), 1024):
                part = batch.slice(i, 1024)
                found = zip(*[of(t.as_py()) for t in part.column(1)], strict=True)
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(x, t) for x, t in zip(found, types, strict=True)]], names=["doc_id", *names])

    id_kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), text_or_empty(F.col(f"`{text_col}`")).alias("text")).mapInArrow(run, f"doc_id {id_kind}, {kind}")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fp (the 64 bits as a signed long) of every row."""
    return _per_text(docs, id_col, text_col, ["fp"], "fp long", lambda t: (_signed(fingerprint(t, shingle)),))


def proposing_prints(docs: DataFrame, id_col: str, text_col: str, sketches: bool = False, sets: bool = False) -> DataFrame:
    """doc_id, fp and other (two fingerprints), size (distinct shingles), with ``sketches`` also sketch, with ``sets`` also the shingles."""
    names = ["fp", "other", "size", *(["sketch"] if sketches else []), *(["shingles"] if sets else [])]

    def of(text: str) -> tuple:
        shingles = np.unique(shingle_hashes(text, SKETCH_WORDS))
        return *map(_signed, fingerprint_pair(shingles)), len(shingles), *([sketch(shingles)] if sketches else []), *([shingles.view(np.int64)] if sets else [])

    return _per_text(docs, id_col, text_col, names, "fp long, other long, size long" + ", sketch binary" * sketches + ", shingles array<long>" * sets, of)


def _hamming_homes() -> np.ndarray:
    """For each 15-bit value the word of the Hamming code within one bit: the syndrome names the bit to flip."""
    x = np.arange(1 << 15, dtype=np.uint64)
    syndrome = np.zeros_like(x)
    for bit in range(15):
        syndrome ^= np.where(x >> np.uint64(bit) & np.uint64(1), np.uint64(bit + 1), np.uint64(0))
    return x ^ np.where(syndrome > 0, np.uint64(1) << (np.maximum(syndrome, np.uint64(1)) - np.uint64(1)), np.uint64(0))


HOMES = _hamming_homes()
CODED = np.uint64(0x7FFF)


def home(value: np.ndarray) -> np.ndarray:
    """The anchor within covering radius 1: the code word for the low 15 bits, the others as they are."""
    return HOMES[value & CODED] | value & ~CODED


def anchors(value: np.ndarray, width: int, t: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, anchor) of every replica of values of ``width`` bits: all anchors within radius 1 plus t."""
    row = np.arange(len(value), dtype=np.uint64) << np.uint64(32)
    found = []
    for free in range(t + 1):  # bits flipped among those that are not coded
        for bits in itertools.combinations(range(15, width), free):
            for near in range(t - free + 1):  # the homes of all values within t - free are the code words in reach
                for flips in itertools.combinations(range(15), near):
                    found.append(row | home(value ^ np.uint64(sum(1 << b for b in (*bits, *flips)))))
    pairs = np.unique(np.concatenate(found))
    return (pairs >> np.uint64(32)).astype(np.int64), pairs & np.uint64(0xFFFFFFFF)


def pieces(parts: int) -> list[tuple[int, int]]:
    """(lowest bit, width) of each piece."""
    cuts = [64 * i // parts for i in range(parts + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def forest(u: np.ndarray, v: np.ndarray, n: int, parent: np.ndarray | None = None) -> np.ndarray:
    """The smallest member of each of n nodes' set, given links u-v (and sets so far)."""
    parent = np.arange(n) if parent is None else parent
    while True:
        a, b = parent[u], parent[v]
        if not (open_ := a != b).any():
            return parent
        np.minimum.at(parent, np.maximum(a, b)[open_], np.minimum(a, b)[open_])
        while not np.array_equal(up := parent[parent], parent):
            parent = up


def _differing(marks: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """In how many bits the sketches of the pairs a, b differ."""
    cuts = range(0, len(a), SKETCH_BLOCK)
    return np.concatenate([np.zeros(0, dtype=np.int64), *(np.bitwise_count(marks[a[i : i + SKETCH_BLOCK]] ^ marks[b[i : i + SKETCH_BLOCK]]).sum(axis=1, dtype=np.int64) for i in cuts)])


def _spanning(a: np.ndarray, b: np.ndarray, cost: np.ndarray, parent: np.ndarray) -> np.ndarray:
    """Which of the pairs a, b are a spanning forest of least cost over the sets of ``parent``."""
    order = np.argsort(cost, kind="stable")
    alive, chosen, none, parent = order, [], len(a), parent.copy()
    rank = np.empty(len(a), dtype=np.int64)
    rank[order] = np.arange(len(a))
    while True:  # each set takes its cheapest pair
        alive = alive[parent[a[alive]] != parent[b[alive]]]
        if not len(alive):
            return np.concatenate([np.zeros(0, dtype=np.int64), *chosen])
        best = np.full(len(parent), none)
        for side in (a, b):
            np.minimum.at(best, parent[side[alive]], rank[alive])
        pick = order[np.unique(best[best < none])]
        chosen.append(pick)
        parent = forest(a[pick], b[pick], len(parent), parent)


def _forests(a: np.ndarray, b: np.ndarray, cost: np.ndarray, parent: np.ndarray, n: int) -> np.ndarray:
    """Which of the pairs a, b are n disjoint spanning forests, each the cheapest of what those before it left."""
    left, chosen = np.arange(len(a)), [np.zeros(0, dtype=np.int64)]
    for _ in range(n):
        pick = _spanning(a[left], b[left], cost[left], parent)
        chosen.append(left[pick])
        left = np.delete(left, pick)
    return np.concatenate(chosen)


def _compare(anchor: np.ndarray, is_home: np.ndarray, fp: np.ndarray, node: np.ndarray, threshold: int, marks: np.ndarray | None = None, like: int = 0, open_: int = 0, parts: int = 1, joined: np.ndarray | None = None, failed: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Links (nodes, nodes, bits) among rows sorted by anchor, homes before replicas.

    A pair counts at the anchors of the first piece in which it is near, so that one piece tells of a cluster, not all.
    Sure links, a forest, have bits -1. With marks, up to ``like`` differing bits are sure; up to ``open_`` are open,
    and a forest of those with fewest bits is given. With joined (a label of each node's group), all open pairs are
    given but ``failed`` ones (rows of two nodes), or, if they are too many, FORESTS forests and a row with bits -2;
    sure links are then those between groups, not those that the groups stand for.
    """
    names, own = np.unique(node, return_inverse=True)
    start = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
    end = np.r_[start[1:], len(anchor)]
    homes = np.add.reduceat(is_home.astype(np.int64), start)
    parent = np.arange(len(names))
    cut, of_piece = pieces(parts), anchor >> 60
    unsure: list[np.ndarray] = []
    kept, thinned, tested = 1, False, np.zeros(0, dtype=np.int64)
    key = lambda a, b: np.minimum(a, b) * len(names) + np.maximum(a, b)
    if joined is not None:
        label = np.zeros(len(names), dtype=np.int64)
        label[own] = joined
        _, first, back = np.unique(label, return_index=True, return_inverse=True)
        parent, kept = first[back], FORESTS
        at = np.minimum(np.searchsorted(names, failed), len(names) - 1)
        tested = key(*at[(names[at] == failed).all(axis=1)].T)
    before = parent.copy()

    def thin() -> None:
        nonlocal thinned
        pairs = np.concatenate(unsure, axis=1)
        if joined is not None:
            pairs = pairs[:, np.unique(key(pairs[0], pairs[1]), return_index=True)[1]]
            pairs = pairs[:, parent[pairs[0]] != parent[pairs[1]]]
            if pairs.shape[1] <= kept * len(first):
                unsure[:] = [pairs]
                return
            thinned = True
        unsure[:] = [pairs[:, _forests(*pairs, parent, kept)]]

    def join(left: np.ndarray, right: np.ndarray) -> None:
        nonlocal parent
        differ = fp[left] ^ fp[right]
        near = np.flatnonzero(np.bitwise_count(differ) <= threshold)
        if len(cut) > 1:
            differ, piece = differ[near], of_piece[left[near]]
            told = np.zeros(len(near), dtype=bool)
            for k, (low, width) in enumerate(cut[:-1]):
                told |= (piece > k) & (np.bitwise_count(differ >> np.uint64(low) & np.uint64((1 << width) - 1)) <= threshold // parts)
            near = near[~told]
        left, right = left[near], right[near]
        if joined is not None:  # each pair at one of its two homes
            once = own[left] < own[right]
            left, right = left[once], right[once]
        if marks is not None:
            apart = parent[own[left]] != parent[own[right]]
            left, right = left[apart], right[apart]
            bits = _differing(marks, left, right)
            maybe = (bits > like) & (bits <= open_)
            if len(tested):
                maybe &= ~np.isin(key(own[left], own[right]), tested)
            if maybe.any():
                unsure.append(np.stack([own[left[maybe]], own[right[maybe]], bits[maybe]]))
            left, right = left[bits <= like], right[bits <= like]
        parent = forest(own[left], own[right], len(names), parent)
        if sum(x.shape[1] for x in unsure) > max(BLOCK, 2 * kept * len(names)):  # over twice what forests can hold
            thin()

    # Small anchors: each home row against all rows of its anchor, a bounded number of pairs at a time.
    size = end - start
    small = size <= LARGE
    at = np.flatnonzero(is_home)
    group = np.repeat(np.arange(len(start)), homes)
    at, group = at[small[group]], group[small[group]]
    todo = size[group]
    for lo, hi in _portions(todo, np.cumsum(todo)):
        n = todo[lo:hi]
        left = np.repeat(at[lo:hi], n)
        right = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start[group[lo:hi]], n)
        join(left, right)
    # Large anchors: some home rows at a time, against rows that the group of those does not hold yet.
    for g in np.flatnonzero(~small).tolist():
        todo = np.arange(start[g], start[g] + homes[g])
        step = 1
        while len(todo):
            todo = todo[np.argsort(parent[own[todo]], kind="stable")]  # home rows of one group together
            left, todo = todo[:step], todo[step:]
            group_of = parent[own[left]]
            right = np.arange(start[g], end[g])
            if (group_of == group_of[0]).all():
                right = right[parent[own[right]] != group_of[0]]
            for i in range(0, len(right), max(1, BLOCK // len(left))):
                part = right[i : i + max(1, BLOCK // len(left))]
                join(np.repeat(left, len(part)), np.tile(part, len(left)))
            step = min(HOMES_AT_ONCE, step * 2)
    if unsure:
        thin()
        a, b, bits = unsure[0]
        yield names[np.maximum(a, b)], names[np.minimum(a, b)], bits
        if thinned:
            yield names[:1], names[:1], np.array([-2])
    linked = np.flatnonzero((before == np.arange(len(names))) & (parent != before))  # the first of each group stands for it
    yield names[linked], names[parent[linked]], np.full(len(linked), -1)


def _portions(todo: np.ndarray, upto: np.ndarray) -> Iterator[tuple[int, int]]:
    lo = 0
    while lo < len(todo):
        hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + BLOCK, side="right")))
        yield lo, hi
        lo = hi


def links(prints: DataFrame, threshold: int = THRESHOLD, parts: int = PARTS, like: int | None = None, open_: int | None = None) -> DataFrame:
    """(fp, node) with distinct fp to edges (a, b, bits) that join all nodes whose fingerprints differ in few enough bits.

    With ``like``, (fp, node, mark): marks are compared too, bit by bit. Up to ``like`` differing bits an edge is sure
    (its bits are -1), up to ``open_`` it is open. With (group, failed) too, group joins nodes beforehand and failed has
    pairs of nodes that are out of the question, 16 bytes each. What a task sends to an anchor is packed into one row.
    """
    t = threshold // parts
    marked, grouped = like is not None, "group" in prints.columns
    at_once = 1024 if marked else 8192
    fixed = ["fp", "node", *(["mark"] if marked else []), *(["group"] if grouped else [])]
    names = ["anchor", "homes", *fixed, *(["failed"] if grouped else [])]
    cut = pieces(parts)

    def values(column: pa.Array) -> np.ndarray:
        """Numbers, or the rows of a matrix of packed bits."""
        if pa.types.is_int64(column.type):
            return column.to_numpy().view(np.uint64)
        return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint64).reshape(len(column), -1)

    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _of_size(batches, at_once):
            cols = [values(batch.column(i)) for i in range(len(fixed))]
            failed = batch.column(len(fixed)).to_pylist() if grouped else []
            for k, (low, width) in enumerate(cut):
                value = cols[0] >> np.uint64(low) & np.uint64((1 << width) - 1)
                row, anchor = anchors(value, width, t)
                at_home = home(value)[row] == anchor
                order = np.lexsort((~at_home, anchor))
                row, anchor, at_home = row[order], anchor[order], at_home[order]
                start = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
                ends = np.r_[start[1:], len(anchor)].tolist()
                packed = [[x[row[i:j]].tobytes() for i, j in zip(start.tolist(), ends, strict=True)] for x in cols]
                key = (anchor[start] | np.uint64(k) << np.uint64(60)).view(np.int64)
                homes = np.add.reduceat(at_home.astype(np.int32), start)
                if grouped:  # a pair is out of the question wherever one of its nodes is at home
                    packed.append([b"".join([failed[r] for r in row[i : i + h].tolist()]) for i, h in zip(start.tolist(), homes.tolist(), strict=True)])
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(homes, pa.int32()), *[pa.array(x, pa.binary()) for x in packed]], names=names)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        rows, limit = 0, 50_000

        def emit(cols: list[np.ndarray], failed: np.ndarray | None) -> Iterator[pa.RecordBatch]:
            order = np.lexsort((~cols[1], cols[0]))
            anchor, at_home, *cols = (x[order] for x in cols)
            own = dict(zip(fixed, cols, strict=True))
            group = own["group"].view(np.int64) if grouped else None
            for a, b, bits in _compare(anchor, at_home, own["fp"], own["node"].view(np.int64), threshold, own.get("mark"), like or 0, open_ or like or 0, parts, group, failed):
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(bits.astype(np.int32))], names=["a", "b", "bits"])

        def pairs(at: np.ndarray, blobs: list[bytes]) -> list[np.ndarray]:
            sizes = np.array([len(x) // 16 for x in blobs])
            return [np.repeat(at, sizes), np.frombuffer(b"".join(blobs), dtype=np.int64).reshape(-1, 2)]

        gone: list[list[np.ndarray]] = []
        for batch in _of_size(batches, 256):
            fps = batch.column(2).to_pylist()
            sizes = np.array([len(x) // 8 for x in fps])
            place = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            cols = [np.repeat(batch.column(0).to_numpy(), sizes), place < np.repeat(batch.column(1).to_numpy(), sizes)]
            for k, name in enumerate(fixed):
                x = np.frombuffer(b"".join(batch.column(2 + k).to_pylist()), dtype=np.uint64)
                cols.append(x.reshape(len(place), -1) if name == "mark" else x)
            if grouped:
                gone.append(pairs(batch.column(0).to_numpy(), batch.column(len(names) - 1).to_pylist()))
            held.append(cols)
            rows += len(place)
            if rows >= limit:
                kept = [np.concatenate(x) for x in zip(*held, strict=True)]
                whole = int(np.searchsorted(kept[0], kept[0][-1]))  # the last anchor may go on
                at, failed = (np.concatenate(x) for x in zip(*gone, strict=True)) if grouped else (None, None)
                if whole:
                    yield from emit([x[:whole] for x in kept], failed)
                gone = [[at[at == kept[0][-1]], failed[at == kept[0][-1]]]] if grouped else []
                held, rows = [[x[whole:].copy() for x in kept]], rows - whole
                limit = max(50_000, 2 * rows)
        if rows:
            yield from emit([np.concatenate(x) for x in zip(*held, strict=True)], np.concatenate([f for _, f in gone]) if grouped else None)

    kind = "anchor long, homes int, " + ", ".join(f"{n} binary" for n in names[2:])
    spread = prints.select(*fixed, *names[2 + len(fixed) :]).mapInArrow(replicate, kind)
    return spread.repartition(F.col("anchor")).sortWithinPartitions("anchor").mapInArrow(compare, "a long, b long, bits int")


def reach(threshold: int, parts: int) -> list[tuple[int, int, int]]:
    """(lowest bit, width, t) of each piece that counts: fingerprints within ``threshold`` bits are within t in one of them.

    Were they over t in every piece, they would differ in the sum of all t + 1, which is ``threshold`` + 1.
    """
    cut, left = pieces(parts), threshold - parts + 1
    least = sorted(range(parts), key=lambda k: cut[k][1])[: parts - left % parts]  # the narrow pieces get the smaller t
    found = [(*cut[k], left // parts + (k not in least)) for k in range(parts)]
    return [x for x in found if x[2] >= 0]


def ball(width: int, t: int) -> np.ndarray:
    """All patterns of at most t of ``width`` bits."""
    return np.array([sum(1 << b for b in bits) for n in range(t + 1) for bits in itertools.combinations(range(width), n)], dtype=np.uint64)


#: What goes to an anchor for a row: its fingerprint that is cut there, the other one, and its number of shingles.
ROW = np.dtype([("own", "<u8"), ("other", "<u8"), ("size", "<u4")])


def _told(anchor: int, turned: int, piece: int, reached: list[tuple[int, int, int]], rows: np.ndarray, threshold: int, similarity: float) -> np.ndarray:
    """Which of an anchor's rows, sorted by size, are told to have a partner.

    A row is known once a partner of it was seen here, and two rows that are known are not compared, so a cluster is not
    compared pair by pair. A row that is known is told here, unless it is certain to be told elsewhere: for a pair that
    an earlier piece (or the fingerprint before) brings together, there; for a pair that meets at the row's home, the
    anchor that is its own value, there.
    """
    low, width, t = reached[piece]
    own, other, size = (np.ascontiguousarray(rows[x]) for x in ROW.names)
    part = lambda x, low, width: x >> np.uint64(low) & np.uint64((1 << width) - 1)
    away = np.bitwise_count(part(own, low, width) ^ np.uint64(anchor))
    short, long = t // 2, t - t // 2
    # Larger rows than this cannot be alike, nor smaller ones; with an even t a row is compared with those behind it.
    upto = np.searchsorted(size, size / similarity + 1e-6, side="right")
    since = np.arange(len(rows)) if short == long else np.searchsorted(size, size * similarity - 1e-6)
    lefts = np.arange(len(rows)) if short == long else np.flatnonzero(away <= short)
    known, told = np.zeros(len(rows), dtype=bool), np.zeros(len(rows), dtype=bool)
    seen: list[np.ndarray] = []

    def meet() -> None:
        x, y = np.concatenate(seen, axis=1)
        seen.clear()
        others = np.bitwise_count(other[x] ^ other[y])
        fit = (others <= OTHER_BITS) & (np.maximum(x, y) < upto[np.minimum(x, y)])
        x, y, others = x[fit], y[fit], others[fit]
        differ = own[x] ^ own[y]
        before = (others <= threshold) & (np.bitwise_count(differ) <= OTHER_BITS) if turned else np.zeros(len(x), dtype=bool)
        for low_, width_, t_ in reached[:piece]:
            before |= np.bitwise_count(part(differ, low_, width_)) <= t_
        at_homes = np.bitwise_count(part(differ, low, width)) <= long
        ends = np.concatenate([x, y])
        elsewhere = np.concatenate([before | at_homes & (away[x] > 0), before | at_homes & (away[y] > 0)])
        safe = known.copy()
        safe[ends[elsewhere]] = True
        told[ends[~safe[ends]]] = True
        known[ends] = True

    for i in range(0, len(lefts), LEFTS_AT_ONCE):
        left = lefts[i : i + LEFTS_AT_ONCE]
        lo, hi = since[left[0]], upto[left[-1]]
        old = known[left]
        turns = [(left[~old], None), (left[old], lo + np.flatnonzero(~known[lo:hi]))] if 2 * old.sum() > len(left) else [(left, None)]
        for some, others in turns:
            for j in range(lo, hi, COLUMNS) if others is None else range(0, len(others), COLUMNS):
                right = slice(j, min(j + COLUMNS, hi)) if others is None else others[j : j + COLUMNS]
                across = own[right]
                near = np.flatnonzero((np.bitwise_count(own[some, None] ^ across) <= threshold).ravel())
                x, y = some[near // len(across)], near % len(across)
                y = y + j if others is None else right[y]
                if (apart := x != y).any():
                    seen.append(np.stack([x[apart], y[apart]]))
                    if sum(x.shape[1] for x in seen) > COLUMNS:
                        meet()
    if seen:
        meet()
    return told


def partners(prints: DataFrame, threshold: int, parts: int, similarity: float) -> DataFrame:
    """(fp, other, size), distinct, to those rows of it with a partner; some come several times.

    A partner is near by one fingerprint, and within OTHER_BITS by the other one, and its size allows the similarity. Pieces are
    narrow here, and every value of a piece is an anchor. With t = a + b, a the smaller half, a row goes to all anchors
    within b, and two rows of which one is within a and the other within b are compared: so all within t meet, in the
    middle. In 13 bits that is 14 anchors for a t of 2, where one side alone would have to go to 92.
    """
    reached = reach(threshold, parts)
    at_once = max(1, SPREAD_AT_ONCE // max([1, *(len(ball(width, t - t // 2)) for _, width, t in reached)]))

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        held, rows = [], 0
        for batch in _of_size(batches, at_once):
            held.append(np.stack([batch.column(i).to_numpy().view(np.uint64) for i in range(3)]))
            rows += len(batch)
            if rows >= at_once:
                yield np.concatenate(held, axis=1)
                held, rows = [], 0
        if rows:
            yield np.concatenate(held, axis=1)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for fp, other, size in gathered(batches):
            for turned, (own, second) in enumerate(((fp, other), (other, fp))):
                rows = np.empty(len(own), dtype=ROW)
                rows["own"], rows["other"], rows["size"] = own, second, size
                for k, (low, width, t) in enumerate(reached):
                    flips = ball(width, t - t // 2)
                    anchor = ((own >> np.uint64(low) & np.uint64((1 << width) - 1))[:, None] ^ flips).ravel()
                    order = np.argsort(anchor.astype(np.uint16) if width <= 16 else anchor, kind="stable")
                    anchor, packed = anchor[order], rows[order // len(flips)]
                    start = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
                    key = anchor[start] | np.uint64(turned * len(reached) + k) << np.uint64(56)
                    ends = (np.r_[start, len(anchor)] * ROW.itemsize).astype(np.int32)
                    blobs = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(ends), pa.py_buffer(packed.view(np.uint8))])
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), blobs], names=["anchor", "rows"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(anchor: np.ndarray, rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            order = np.lexsort((rows["size"], anchor))
            anchor, rows = anchor[order], rows[order]
            start = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
            found = []
            for a, b in zip(start.tolist(), [*start[1:].tolist(), len(anchor)], strict=True):
                if b - a > 1:
                    turned, k = divmod(int(anchor[a]) >> 56, len(reached))
                    own = rows[a:b]
                    own = own[_told(int(anchor[a]) & (1 << 56) - 1, turned, k, reached, own, threshold, similarity)]
                    found.append(np.stack([own[x].astype(np.uint64) for x in (("other", "own") if turned else ("own", "other"))] + [own["size"].astype(np.uint64)]))
            if found:
                found = np.unique(np.concatenate(found, axis=1), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in np.ascontiguousarray(found)], names=["fp", "other", "size"])

        held: list[tuple[np.ndarray, np.ndarray]] = []
        n, limit = 0, COMPARE_AT_ONCE
        for batch in _of_size(batches, 256):
            blobs = batch.column(1).to_pylist()
            sizes = np.array([len(x) // ROW.itemsize for x in blobs])
            held.append((np.repeat(batch.column(0).to_numpy(), sizes), np.frombuffer(b"".join(blobs), dtype=ROW)))
            n += int(sizes.sum())
            if n >= limit:
                anchor, rows = (np.concatenate(x) for x in zip(*held, strict=True))
                whole = int(np.searchsorted(anchor, anchor[-1]))  # the last anchor may go on
                if whole:
                    yield from emit(anchor[:whole], rows[:whole])
                held, n = [(anchor[whole:].copy(), rows[whole:].copy())], n - whole
                limit = max(COMPARE_AT_ONCE, 2 * n)
        if n:
            yield from emit(*(np.concatenate(x) for x in zip(*held, strict=True)))

    sent = prints.select("fp", "other", "size").mapInArrow(spread, "anchor long, rows binary")
    return sent.repartition(F.col("anchor")).sortWithinPartitions("anchor").mapInArrow(compare, "fp long, other long, size long")


def _of_size(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The same rows, ``rows`` at a time but for those at a batch's end."""
    for batch in batches:
        for i in range(0, len(batch), rows):
            yield batch.slice(i, rows)


def _grouped(rows: DataFrame, prints: DataFrame, keys: list[str], edges: DataFrame) -> DataFrame:
    """doc_id, fp, component_id of rows with doc_id and keys; prints: keys, node; edges: (a, b) between nodes."""
    # An id with several fingerprints joins them.
    one = F.struct(*keys)
    same = rows.where("doc_id is not null").groupBy("doc_id").agg(F.min(one).alias("x"), F.max(one).alias("y"))
    repeated = materialise(same.where("x <> y").select("doc_id"), "repeated-ids")
    extra = rows.join(repeated, "doc_id").join(prints, keys).select(F.col("doc_id").cast("long").alias("a"), F.col("node").alias("b"))
    root = materialise(connected_components(edges.union(extra)), "components")
    by_print = materialise(prints.join(root, "node", "left").select(*keys, F.coalesce("root", "node").alias("component_id")), "component-of-print")
    return rows.join(by_print, keys, "left").select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def _distinct_prints(rows: DataFrame, keys: list[str]) -> DataFrame:
    return materialise(rows.where("doc_id is not null").groupBy(*keys).agg(F.min("doc_id").cast("long").alias("node"), F.count(F.lit(1)).alias("n")), "distinct-fingerprints")


def _packed_pairs(node: str, others: str) -> Column:
    """(node, other) of each other, 16 bytes a pair, as numpy reads them."""

    @F.pandas_udf("binary")
    def pack(own: pd.Series, lists: pd.Series) -> pd.Series:
        return pd.Series([b"" if x is None else np.stack([np.full(len(x), n, dtype=np.int64), np.asarray(x, dtype=np.int64)], axis=1).tobytes() for n, x in zip(own, lists, strict=True)])

    return pack(F.col(node), F.col(others))


def _similar_groups(docs: DataFrame, id_col: str, text_col: str, threshold: int, parts: int, similarity: float) -> DataFrame:
    """doc_id, fp, component_id by exact similarity of proposed pairs."""
    rows = materialise(proposing_prints(docs, id_col, text_col), "fingerprints")
    both = ["fp", "other"]
    prints = _distinct_prints(rows, [*both, "size"])
    near = prints.where("n > 1").select(*both, "size").union(partners(prints, threshold, parts, similarity))
    near = materialise(near.distinct(), "near-fingerprints")
    near = rows.join(near, [*both, "size"], "left_semi").where("doc_id is not null").select("doc_id")
    id_, = free_names(docs, "id")
    near = materialise(near.select(F.col("doc_id").alias(id_)).distinct(), "near-ids")
    own_docs = docs.join(near, F.col(f"`{id_col}`") == F.col(id_), "left_semi")
    marked = materialise(proposing_prints(own_docs, id_col, text_col, sketches=True), "sketches")
    keys = [*both, "sketch"]
    prints = _distinct_prints(marked, keys)
    # Unequal minima give equal bits half of the time.
    like, open_ = (int(SKETCH_BITS * (1 - similarity + d) / 2) for d in (-CLEARLY, CLEARLY))

    def proposed(own: DataFrame, name: str, *more: str) -> DataFrame:
        every = [links(own.select(F.col(fp).alias("fp"), "node", F.col("sketch").alias("mark"), *more), threshold, parts, like, open_) for fp in both]
        return materialise(every[0].union(every[1]).distinct(), name)

    def compared(pairs: DataFrame) -> DataFrame:
        """(a, b, alike) by the exact similarity of both texts' shingles."""
        nodes = materialise(pairs.select(F.explode(F.array("a", "b")).alias(id_)).distinct(), "open-nodes")
        sets = proposing_prints(docs.join(nodes, F.col(f"`{id_col}`") == F.col(id_), "left_semi"), id_col, text_col, sketches=True, sets=True)
        sets = sets.join(prints.select(*keys, "node"), keys).where("doc_id = node").groupBy("node").agg(F.first("shingles").alias("shingles"))
        sets = materialise(sets, "shingle-sets")
        met = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
        common = F.size(F.array_intersect("x", "y"))
        met = met.withColumn("common", common).select("a", "b", (F.col("common") >= similarity * (F.size("x") + F.size("y") - F.col("common"))).alias("alike"))
        return materialise(met, "compared-pairs")

    def between(pairs: DataFrame, root: DataFrame) -> DataFrame:
        """Pairs of different groups, with their groups x and y."""
        ends = [root.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}")) for c in "ab"]
        met = pairs.join(ends[0], "a", "left").join(ends[1], "b", "left").withColumn("x", F.coalesce("root_a", "a")).withColumn("y", F.coalesce("root_b", "b"))
        return met.where("x <> y").drop("root_a", "root_b")

    found = proposed(prints, "proposed-pairs")
    edges = found.where("bits = -1").select("a", "b")
    root = materialise(connected_components(edges), "sure-components")
    stars = lambda: root.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))  # noqa: E731  in place of the links that gave them
    pairs = between(found.where("bits >= 0"), root).groupBy(F.least("x", "y"), F.greatest("x", "y")).agg(F.min(F.struct("bits", "a", "b")).alias("p"))  # one for two groups
    pairs, failed, complete, edges = materialise(pairs.select("p.a", "p.b"), "open-pairs"), None, False, stars()
    while not pairs.isEmpty():
        met = compared(pairs)
        edges = stars().union(met.where("alike").select("a", "b"))
        failed = met.where("not alike").select("a", "b") if failed is None else failed.union(met.where("not alike").select("a", "b"))
        if complete:
            break
        root = materialise(connected_components(edges), "similar-components")
        # Other open pairs of two groups lead out of each past a pair that failed: the groups next to those come again.
        beside = materialise(between(failed, root), "failed-pairs")
        groups = beside.select(F.explode(F.array("x", "y")).alias("group")).distinct()
        own = prints.join(root, "node", "left").withColumn("group", F.coalesce("root", "node")).drop("root").join(groups, "group", "left_semi")
        both_ways = beside.select(F.col("a").alias("node"), "b").union(beside.select(F.col("b").alias("node"), "a"))
        lists = both_ways.groupBy("node").agg(F.collect_set("b").alias("out"))
        own = own.join(lists, "node", "left").withColumn("failed", _packed_pairs("node", "out")).select(*keys, "node", "group", "failed")
        found = proposed(materialise(own, "nodes-again"), "proposed-again", "group", "failed")
        pairs, complete = materialise(found.where("bits >= 0").select("a", "b").distinct(), "open-pairs"), found.where("bits = -2").isEmpty()
    alone = rows.join(near, F.col("doc_id") == F.col(id_), "left_anti").select("doc_id", "fp", F.col("doc_id").cast("long").alias("component_id"))
    return _grouped(marked, prints, keys, edges).union(alone)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, threshold: int = THRESHOLD, parts: int = PARTS, similarity: float | None = None) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for each row. Ids are integers."""
    if similarity is None:
        rows = materialise(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
        prints = _distinct_prints(rows, ["fp"])
        found = _grouped(rows, prints, ["fp"], links(prints, threshold, parts).select("a", "b"))
    else:
        found = _similar_groups(docs, id_col, text_col, threshold, parts, similarity)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one document of each component, the one with the smallest id; all columns stay as they are."""
    id_, = free_names(docs, "gone")
    found = near_duplicates(docs, id_col, text_col, **options)
    gone = materialise(found.where("doc_id <> component_id").select(F.col("doc_id").alias(id_)).distinct(), "near-decisions")
    return docs.join(gone, F.col(f"`{id_col}`") == F.col(id_), "left_anti")
