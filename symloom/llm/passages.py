"""Fuzzy repeated passages by collinear chaining.

Seeds are runs of K words; of each window of WINDOW runs the one with the smallest hash is kept, so texts that share
a stretch of words share seeds. Each seed is linked to the smallest document that holds it and to the one before its
own that does (never all pairs), which gives matches (position here, position there) for pairs of documents. The
matches of a pair are chained in order: a match adds its weight to the best chain that ends before it in both texts,
less a cost for the gap; a Fenwick tree over the positions there answers that in logarithmic time. Chains are then
aligned on the words themselves and extended at both ends, as far as the texts agree; an alignment of MIN_WORDS words
or more, SIMILARITY of them equal, is a fuzzy passage. A chain that is not similar enough as a whole is cut at its
widest gap and its parts are tried.

Runs of LONG words are seeds too, kept alike by LONG_WINDOW. So two documents meet in a passage though each of its short seeds
belongs to older documents that hold a part of it: a stretch of LONG + LONG_WINDOW - 1 words (47) has a kept long run in
every document that holds it, and the smallest document with that run shares LONG words or more. Long matches that
overlap on a diagonal are one segment, cut into short seeds for the chain.

Pairs of seeds make up for older parts in edited copies too. Where two short seeds within SPREAD words of each other
have first holders that differ, or one that holds them elsewhere, the pair is a seed of its own (one in PAIRED of
them, by hash) and linked like the others: whoever holds both so near shares more than the older parts do. Such places
are few, for a passage that was copied as a whole has one first holder.

A seed that a sample of the documents shows to be very common is dealt to tasks by ranges of document ids: each range
has a smallest document of its own, and these are linked to the smallest of all. The sample only decides how rows are
dealt.

The result has one row per passage: doc_id, source_doc_id (smaller), the words' ranges [start_word, end_word) and
[source_start, source_end), matched words and similarity. Of a pair's passages, those inside another one here (lines
repeated in both texts, say) are left out. Copies are linked to the documents that own their seeds and not expanded
into pairs.

Defined cases: a null text is empty; texts of fewer than MIN_WORDS words match nothing; a row without an id takes no
part; of rows that share an id the one with the longest text (then the greatest) stands for it; passages repeated
within one document are not reported; an empty table gives an empty result; other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from itertools import chain as joined_lists

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from symloom.llm.common import arrow_rows, materialise, text_or_empty

K = 5
WINDOW, LONG_WINDOW = 7, 8
#: Words of the long seeds, a multiple of K.
LONG = 40
MIN_WORDS = 40
SIMILARITY = 0.8
#: Seeds that a chain has at least.
MIN_SEEDS = 2
WEIGHT, GAP_COST, MAX_GAP = 5.0, 0.15, 48
#: Words between the seeds of a pair, at most, how much these may be shifted in a holder of both, and one in how many pairs is kept.
SPREAD, SHIFT, PAIRED = 48, 16, 4
#: What a match is: to the first holder, to the one before, what a common seed's ranges need, and a first holder itself.
OWNER, BEFORE, HEAD, ITSELF = range(4)
#: Words of context read at first at either end; where an alignment goes on past them, so many times as many.
CONTEXT, MORE_CONTEXT = 96, 8
#: One in so many documents shows which seeds are common, and how often a seed must be met there to tell.
SAMPLED, LEAST_MET = 64, 50
#: So many ids are sent to every task, to keep the texts that are still open.
BROADCAST_IDS = 50_000
#: Rows times words of context that are in a batch.
ROWS_OF_WORDS = 200_000
CHUNK_BYTES = 4 << 20
#: Characters whose seeds are found at once, rows that are packed at once, and rows of packed tables that are in a batch.
CHARACTERS, PACKED, PACKED_ROWS = 1 << 20, 1 << 19, 1024
#: Words that agree before whole blocks of words are compared.
RUN = 16
SEED = np.dtype([("h", "<i8"), ("doc_id", "<i8"), ("pos", "<i4")])
MATCH = np.dtype([("doc_id", "<i8"), ("source", "<i8"), ("pos", "<i4"), ("source_pos", "<i4"), ("kind", "i1")])


_FACTORS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def word_hashes(words: Iterable[bytes], n: int) -> np.ndarray:
    """Of n words; a table of known ones takes longer than hashing them."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)


def _joined(parts: list[np.ndarray]) -> np.ndarray:
    """A hash of each row of the parts, in order."""
    h = np.zeros(len(parts[0]), dtype=np.uint64)
    for i, part in enumerate(parts):
        h = (h ^ h >> np.uint64(31)) + part * _FACTORS[i % len(_FACTORS)]
    h = (h ^ h >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ h >> np.uint64(31)


def _over(best: np.ufunc, h: np.ndarray, window: int) -> np.ndarray:
    """The best of each window of h; h has at least so many places."""
    n, size = len(h) - window + 1, 1
    while size < window:
        step = min(size, window - size)
        h, size = best(h[:-step], h[step:]), size + step
    return h[:n]


def _minima(h: np.ndarray, offset: np.ndarray, length: np.ndarray, window: int) -> np.ndarray:
    """Where h is the smallest of a window of a document's; of equal ones in a row, as few as leave one to each window.

    offset: of each place in its document; length: that document's number of places. Documents are window - 1 places
    or more apart; one that is shorter than a window has one window."""
    inside = offset < length
    high = np.where(inside, h, ~np.uint64(0))
    low = _over(np.minimum, np.r_[high, np.full(window - 1, ~np.uint64(0))], window)
    low[~(inside & (offset <= np.maximum(length - window, 0)))] = 0  # no window begins here
    # A place is kept if it is as small as the largest of its windows' minima: none of these is above it.
    at = np.flatnonzero(inside & (_over(np.maximum, np.r_[np.zeros(window - 1, np.uint64), low], window) == h))
    same = (h[at[1:]] == h[at[:-1]]) & (np.diff(at) < window)
    if same.any():
        keep, last = np.ones(len(at), dtype=bool), -1
        for i in np.flatnonzero(same).tolist():  # at[i + 1] repeats at[i]
            if i == 0 or not same[i - 1]:
                last = at[i]
            if i + 1 < len(same) and same[i + 1] and at[i + 2] - last <= window:
                keep[i + 1] = False
            else:
                last = at[i + 1]
        at = at[keep]
    return at


def seeds(words: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, position * 2 + long?, hash) of the kept seeds of documents that have so many words each."""
    gap = max(WINDOW, LONG_WINDOW)
    starts = np.cumsum(counts + gap) - (counts + gap)
    number = np.repeat(np.arange(len(counts)), counts + gap)
    offset = np.arange(len(number)) - starts[number]
    spread = np.zeros(len(number) + LONG, dtype=np.uint64)
    spread[:-LONG][offset < counts[number]] = words
    n = len(number) + LONG - K + 1
    h = _joined([spread[i : i + n] for i in range(K)])
    long = _joined([h[i : i + len(number)] for i in range(0, LONG, K)])
    out = []
    for h, size, window, mark in ((h[: len(number)], K, WINDOW, 0), (long, LONG, LONG_WINDOW, 1)):
        at = _minima(h, offset, (counts - size + 1)[number], window)
        out.append((number[at], (offset[at] << 1 | mark).astype(np.int32), h[at].view(np.int64)))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def seeds_of_texts(ids: np.ndarray, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(hash, id, position * 2 + long?) of the kept seeds, for some texts at a time."""
    lo = 0
    while lo < len(texts):
        hi, size = lo, 0
        while hi < len(texts) and (hi == lo or size + len(texts[hi]) <= CHARACTERS):
            size, hi = size + len(texts[hi]), hi + 1
        words = [t.encode().lower().split() for t in texts[lo:hi]]
        counts = np.array([len(w) for w in words], dtype=np.int64)
        number, pos, h = seeds(word_hashes(joined_lists.from_iterable(words), int(counts.sum())), counts)
        yield h, ids[lo:hi][number], pos
        lo = hi


def bucket_of(key: np.ndarray, buckets: int) -> np.ndarray:
    return (_joined([key.astype(np.int64).view(np.uint64)]) % np.uint64(buckets)).astype(np.int32)


def packed(parts: Iterator[tuple[np.ndarray, ...]], kind: np.dtype, buckets: int) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, rows of that kind as bytes), dealt by the first column: an exchange of few long rows."""

    def pack(held: list[np.ndarray]) -> pa.RecordBatch:
        rows = np.concatenate(held)
        bucket = bucket_of(rows[kind.names[0]], buckets)
        order = np.argsort(bucket, kind="stable")
        rows, bucket = rows[order], bucket[order]
        cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True])
        data, size = rows.tobytes(), kind.itemsize
        blocks = [data[a * size : b * size] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(bucket[cuts[:-1]]), pa.array(blocks, pa.binary())], names=["bucket", "data"])

    held, n = [], 0
    for columns in parts:
        rows = np.empty(len(columns[0]), dtype=kind)
        for name, c in zip(kind.names, columns, strict=True):
            rows[name] = c
        if len(rows):
            held.append(rows)
            n += len(rows)
        if n >= PACKED:
            yield pack(held)
            held, n = [], 0
    if held:
        yield pack(held)


def unpacked(batches: Iterator[pa.RecordBatch], kind: np.dtype) -> Iterator[list[np.ndarray]]:
    """The columns of each bucket; the rows of a bucket come one after another."""
    held, last = [], None

    def columns() -> list[np.ndarray]:
        rows = np.frombuffer(b"".join(held), dtype=kind)
        return [rows[n].copy() for n in kind.names]

    for batch in batches:
        for bucket, data in zip(batch.column("bucket").to_pylist(), batch.column("data").to_pylist(), strict=True):
            if bucket != last and held:
                yield columns()
                held = []
            last = bucket
            held.append(data)
    if held:
        yield columns()


def piece_of(h: np.ndarray, part: np.ndarray) -> np.ndarray:
    """The hash that a common seed goes by in a range of ids."""
    x = h.view(np.uint64) + (part.astype(np.uint64) + np.uint64(1)) * _FACTORS[0]
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ x >> np.uint64(31)).view(np.int64)


class Owners:
    """Goes through seeds sorted by (h, doc, at), batch after batch."""

    def __init__(self):
        self.key = None  # h of the last row
        self.first = self.last = self.before = (0, 0)  # (doc, at): of its first, last and last but one document

    def take(self, h: np.ndarray, doc: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
        """(row, source, its position, OWNER or BEFORE) of every match, the rows that are the first of their h, and (document, position) of first holders that others follow."""
        fresh = np.r_[self.key != h[0], h[1:] != h[:-1]]
        new_doc = fresh | np.r_[doc[0] != self.last[0], doc[1:] != doc[:-1]]
        heads, firsts = np.flatnonzero(fresh), np.flatnonzero(new_doc)
        owner, place = (np.r_[x, y[heads]][np.cumsum(fresh)] for x, y in zip(self.first, (doc, at), strict=True))
        # Documents in order: the last two so far, then those of this batch.
        docs, places = (np.r_[x, y, z[firsts]] for x, y, z in zip(self.before, self.last, (doc, at), strict=True))
        previous = np.cumsum(new_doc)  # index of the document before each row's own
        row = np.flatnonzero(owner != doc)
        also = row[(docs[previous[row]] != owner[row]) & (at[row] & 1 == 0)]
        told = np.concatenate([row, also]), np.concatenate([owner[row], docs[previous[also]]]), np.concatenate([place[row], places[previous[also]]]), np.repeat([OWNER, BEFORE], [len(row), len(also)]).astype(np.int8)
        second = row[new_doc[row] & (docs[previous[row]] == owner[row])]
        end = previous[-1] + 1
        self.key, self.first = h[-1], (owner[-1], place[-1])
        self.last, self.before = (docs[end], places[end]), (docs[end - 1], places[end - 1])
        return *told, heads, owner[second], place[second]


def matches_of(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Matches of short seeds, from those of both kinds (positions * 2 + long?) of a pair of documents."""
    long, x, y = (x & 1).astype(bool), x >> 1, y >> 1
    if not long.any():
        return x, y
    order = np.lexsort((x, x - y))
    x, y, long = x[order], y[order], long[order]
    # Segments: long matches of a diagonal that overlap or touch. On one diagonal ends only grow with a running maximum.
    lx, ly, end = x[long], y[long], x[long] + LONG
    diagonal = lx - ly
    number = np.cumsum(np.r_[False, diagonal[1:] != diagonal[:-1]])
    lift = number * (int(end.max()) + 1)
    upto = np.maximum.accumulate(end + lift)
    first = np.flatnonzero(np.r_[True, (lx + lift)[1:] > upto[:-1]])
    last = upto[np.r_[first[1:] - 1, len(lx) - 1]] - lift[first]
    sx, shift = lx[first], diagonal[first]
    xs, ys = [], []
    for a, b, d in zip(sx.tolist(), last.tolist(), shift.tolist(), strict=True):
        own = np.r_[np.arange(a, b - K, K), b - K]
        xs.append(own)
        ys.append(own - d)
    # Short matches inside a segment say no more than it does.
    keys = {}
    for a, b, d in zip(sx.tolist(), last.tolist(), shift.tolist(), strict=True):
        keys.setdefault(d, []).append((a, b))
    px, py = x[~long], y[~long]
    inside = np.zeros(len(px), dtype=bool)
    for d in np.intersect1d(px - py, shift).tolist():
        here = np.flatnonzero(px - py == d)
        a, b = np.array(keys[d]).T
        i = np.searchsorted(a, px[here], side="right") - 1
        inside[here] = (i >= 0) & (px[here] + K <= b[np.maximum(i, 0)])
    return np.concatenate([px[~inside], *xs]), np.concatenate([py[~inside], *ys])


def seed_pairs(doc: np.ndarray, x: np.ndarray, source: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, hash, first position * 64 + distance) of the kept pairs among the short seeds of each document, given each seed's first holder and its position there."""
    order = np.lexsort((x, doc))
    doc, x, source, y = doc[order], x[order], source[order], y[order]
    name = _joined([source.astype(np.uint64), y.astype(np.uint64)])
    docs, keys, places = [doc[:0]], [np.zeros(0, np.int64)], [x[:0]]
    i = np.arange(len(x))
    for k in range(1, SPREAD + 1):  # those whose k-th seed from here is near; further ones are further off
        i = i[: np.searchsorted(i, len(x) - k)]
        i = i[(doc[i + k] == doc[i]) & (x[i + k] - x[i] <= SPREAD)]
        if not len(i):
            break
        gap = x[i + k] - x[i]
        apart = (gap > 0) & ((source[i + k] != source[i]) | (np.abs(y[i + k] - y[i] - gap) > SHIFT))
        first, gap = i[apart], gap[apart]
        key = _joined([name[first], name[first + k]])
        kept = key % np.uint64(PAIRED) == 0
        docs.append(doc[first[kept]])
        keys.append(key[kept].view(np.int64))
        places.append((x[first] << 6 | gap)[kept])
    return np.concatenate(docs), np.concatenate(keys), np.concatenate(places)


def chain(x: np.ndarray, y: np.ndarray) -> list[list[int]]:
    """Chains of matches (x, y), as lists of indexes in order, best first; each match is in one chain at most."""
    order = np.lexsort((-y, x)).tolist()
    ranks = {v: i + 1 for i, v in enumerate(sorted(set(y.tolist())))}
    size = len(ranks)
    best, holder = [-1e18] * (size + 1), [-1] * (size + 1)
    score, parent = [0.0] * len(x), [-1] * len(x)
    xs, ys = x.tolist(), y.tolist()
    for i in order:
        cost, r = GAP_COST * (xs[i] + ys[i]), ranks[ys[i]]
        top, j = -1e18, r - 1
        while j > 0:  # best among smaller y
            if best[j] > top:
                top, parent[i] = best[j], holder[j]
            j -= j & -j
        if top - cost > 0:
            score[i] = WEIGHT + top - cost
        else:
            score[i], parent[i] = WEIGHT, -1
        value, j = score[i] + cost, r
        while j <= size:
            if value > best[j]:
                best[j], holder[j] = value, i
            j += j & -j
    used, out = [False] * len(x), []
    for i in sorted(range(len(x)), key=lambda i: -score[i]):
        if used[i]:
            continue
        own = []
        while i >= 0 and not used[i]:
            used[i] = True
            if own and (xs[own[-1]] - xs[i] > MAX_GAP or ys[own[-1]] - ys[i] > MAX_GAP):
                out.append(own[::-1])
                own = []
            own.append(i)
            i = parent[i]
        out.append(own[::-1])
    return [c for c in out if len(c) >= MIN_SEEDS]


def clusters(chains: list[list[int]], x: np.ndarray) -> Iterator[list[list[int]]]:
    """Chains whose ranges here overlap or nearly do, together; within a cluster the one with most seeds first."""
    held, end = [], -1
    for c in sorted(chains, key=lambda c: x[c[0]]):
        if held and x[c[0]] > end + MAX_GAP:
            yield sorted(held, key=len, reverse=True)
            held, end = [], -1
        held.append(c)
        end = max(end, int(x[c[-1]]) + K)
    if held:
        yield sorted(held, key=len, reverse=True)


def _common(a: Sequence[int], b: Sequence[int]) -> int:
    """Length of the longest common subsequence of two short lists."""
    row = [0] * (len(b) + 1)
    for u in a:
        corner = 0
        for j, v in enumerate(b, 1):
            corner, row[j] = row[j], corner + 1 if u == v else max(row[j], row[j - 1])
    return row[-1]


def _extend(a: Sequence[int], b: Sequence[int]) -> tuple[int, int, int]:
    """How far an alignment goes on over the starts of a and b: words of a, words of b, equal words."""
    i = j = equal = run = 0
    good, balance, peak = (0, 0, 0), 0, 0
    n, m = len(a), len(b)
    while i < n and j < m and balance > peak - 6:
        if a[i] == b[j]:
            more, run = 1, run + 1
            if run == RUN:  # blocks, larger while they agree, then smaller
                step, grows = RUN, True
                while step >= RUN:
                    u, v = i + more, j + more
                    if u + step <= n and v + step <= m and a[u : u + step] == b[v : v + step]:
                        more += step
                        step = 2 * step if grows else step // 2
                    else:
                        step, grows = step // 2, False
            i, j, equal, balance = i + more, j + more, equal + more, balance + more
            if balance >= peak:
                peak, good = balance, (i, j, equal)
        else:
            balance -= 2
            run = 0
            if i + 1 < n and a[i + 1] == b[j]:
                i += 1
            elif j + 1 < m and a[i] == b[j + 1]:
                j += 1
            else:
                i, j = i + 1, j + 1
    return good


def align(a: Sequence[int], b: Sequence[int], x: list[int], y: list[int]) -> tuple[int, int, int, int, int]:
    """Ranges in a and b of the alignment through the seeds at x, y, and its number of equal words."""
    end_a, end_b, equal = x[0] + K, y[0] + K, K
    for u, v in zip(x[1:], y[1:], strict=True):
        if u + K <= end_a or v + K <= end_b:
            continue
        if u < end_a or v < end_b:  # seeds overlap; words past the overlap that agree count
            over = max(end_a - u, end_b - v)
            if u - end_a != v - end_b:
                equal += K - over
            else:
                equal += u + K - end_a
        else:
            p, q = a[end_a:u], b[end_b:v]
            equal += K + (len(p) if p == q else _common(p, q))
        end_a, end_b = u + K, v + K
    more_a, more_b, more = _extend(a[end_a:], b[end_b:])
    less_a, less_b, less = _extend(a[: x[0]][::-1], b[: y[0]][::-1])
    return x[0] - less_a, end_a + more_a, y[0] - less_b, end_b + more_b, equal + more + less


def similar(a: Sequence[int], b: Sequence[int], x: list[int], y: list[int], min_words: int, similarity: float) -> Iterator[tuple[int, int, int, int, int, int]]:
    """Alignments (ranges, equal words, seeds) along a chain that are long and similar enough, of the whole chain or of its parts."""
    a0, a1, b0, b1, equal = align(a, b, x, y)
    if min(a1 - a0, b1 - b0) < min_words:
        return
    if equal >= similarity * max(a1 - a0, b1 - b0):
        yield a0, a1, b0, b1, equal, len(x)
    elif len(x) > MIN_SEEDS:
        cut = max(range(1, len(x)), key=lambda i: max(x[i] - x[i - 1], y[i] - y[i - 1]))
        for part in (slice(0, cut), slice(cut, None)):
            if len(x[part]) >= MIN_SEEDS:
                yield from similar(a, b, x[part], y[part], min_words, similarity)


def _inside(a: int, b: int, ranges: list[tuple]) -> bool:
    return any(r[0] <= a and b <= r[1] for r in ranges)


def aligned(a: Sequence[int], b: Sequence[int], xs: list[list[int]], ys: list[list[int]], min_words: int, similarity: float) -> list[tuple[int, int, int, int, int, int]]:
    """The passages of a cluster of chains; none lies inside another one here."""
    out: list[tuple[int, int, int, int, int, int]] = []
    for x, y in zip(xs, ys, strict=True):
        if not _inside(x[0], x[-1] + K, out):
            for found in similar(a, b, x, y, min_words, similarity):
                if not _inside(found[0], found[1], out):
                    out = [r for r in out if not _inside(r[0], r[1], [found])] + [found]
    return out


def fuzzy_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """One row per passage that a document shares, nearly or wholly, with a smaller one."""
    spark = docs.sparkSession
    rows = docs.where(F.col(f"`{id_col}`").isNotNull()).select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text_or_empty(F.col(f"`{text_col}`")).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    chunks = max(1, -(-total // CHUNK_BYTES))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = tasks * max(1, -(-chunks // tasks))  # of packed rows, each with the seeds of some CHUNK_BYTES

    def sample_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for h, _, _ in seeds_of_texts(batch.column(0).to_numpy(), batch.column(1).to_pylist()):
                yield pa.RecordBatch.from_arrays([pa.array(h)], names=["h"])

    def seeds_of(hot: np.ndarray, bounds: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def find(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
            for batch in batches:
                for h, ids, pos in seeds_of_texts(batch.column(0).to_numpy(), batch.column(1).to_pylist()):
                    if len(hot):
                        common = hot[np.minimum(np.searchsorted(hot, h), len(hot) - 1)] == h
                        h = np.where(common, piece_of(h, np.searchsorted(bounds, ids, side="right")), h)
                    yield h, ids, pos

        return lambda batches: packed(find(batches), SEED, buckets)

    def own_of(hot: np.ndarray, bounds: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def own(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
            pieces = piece_of(np.repeat(hot, len(bounds) + 1), np.tile(np.arange(len(bounds) + 1), len(hot)))
            order = np.argsort(pieces)
            pieces, seed = pieces[order], np.repeat(hot, len(bounds) + 1)[order]
            for h, doc, at in unpacked(batches, SEED):
                order = np.argsort(h)
                same = h[order[1:]] == h[order[:-1]]
                met = np.r_[False, same] | np.r_[same, False]  # a seed met once matches nothing
                if len(pieces):
                    met |= pieces[np.minimum(np.searchsorted(pieces, h[order]), len(pieces) - 1)] == h[order]
                order = order[met]
                if not len(order):
                    continue
                h, doc, at = h[order], doc[order], at[order]
                order = np.lexsort((at, doc, h))
                h, doc, at = h[order], doc[order], at[order]
                row, source, place, kind, heads, first, own_place = Owners().take(h, doc, at)
                none = np.zeros(0, dtype=np.int64)
                i = np.minimum(np.searchsorted(pieces, h[heads]), len(pieces) - 1) if len(pieces) else none
                heads, i = (heads[here := pieces[i] == h[heads]], i[here]) if len(pieces) else (none, none)
                kinds = np.r_[kind, np.full(len(heads), HEAD, np.int8), np.full(len(first), ITSELF, np.int8)]
                yield np.r_[doc[row], doc[heads], first], np.r_[source, seed[i], first], np.r_[at[row], at[heads], own_place], np.r_[place, at[heads], own_place], kinds

        return lambda batches: packed(own(batches), MATCH, buckets)

    def heads_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The ranges' smallest documents, as rows."""
        for batch in batches:
            for data in batch.column("data").to_pylist():
                rows = np.frombuffer(data, dtype=MATCH)
                rows = rows[rows["kind"] == HEAD]
                if len(rows):
                    yield pa.RecordBatch.from_arrays([pa.array(rows[n].copy()) for n in ("doc_id", "source", "pos")], names=["doc_id", "source", "pos"])

    def pack_heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ([batch.column(i).to_numpy() for i in range(4)] for batch in batches)
        return packed(((*r, np.full(len(r[0]), BEFORE, np.int8)) for r in rows), MATCH, buckets)

    def whole_documents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for pdf in batches:
            pdf = pd.concat([*held, pdf], ignore_index=True) if held else pdf
            last = (pdf["doc_id"] == pdf["doc_id"].iloc[-1]).to_numpy() if len(pdf) else np.zeros(0, dtype=bool)
            yield pdf[~last]
            held = [pdf[last]]
        yield from held

    def chained(doc: np.ndarray, source: np.ndarray, x: np.ndarray, y: np.ndarray, matches: Callable[..., tuple[np.ndarray, np.ndarray]]) -> list[tuple]:
        """Clusters of chains of each (doc, source), which come in order."""
        out = []
        if not len(doc):
            return out
        cuts = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (source[1:] != source[:-1]), True])
        bounds = np.stack([cuts[:-1], cuts[1:]], axis=1)
        if matches is matches_of:  # a short match alone is no chain
            bounds = bounds[(np.diff(cuts) >= MIN_SEEDS) | np.logical_or.reduceat(x & 1 == 1, cuts[:-1])]
        for lo, hi in bounds.tolist():
            u, v = matches(x[lo:hi], y[lo:hi])
            if len(u) >= MIN_SEEDS:
                for cluster in clusters(chain(u, v), u):
                    every = np.concatenate(cluster)
                    out.append((int(doc[lo]), int(source[lo]), u[every], v[every], [len(c) for c in cluster], None, None))
        return out

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Chains, and the pairs of seeds that are seeds of their own."""
        names = ["doc_id", "source", "xs", "ys", "sizes", "h", "at"]
        kinds = [pa.int64(), pa.int64(), *[pa.list_(pa.int32())] * 3, pa.int64(), pa.int64()]
        for doc, source, x, y, kind in unpacked(batches, MATCH):
            order = np.lexsort((x, source, doc))
            order = order[kind[order] != HEAD]
            doc, source, x, y, kind = (c[order] for c in (doc, source, x, y, kind))
            at = kind != ITSELF
            out = chained(doc[at], source[at], x[at], y[at], matches_of)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
            at = ((kind == OWNER) | (kind == ITSELF)) & (x & 1 == 0)
            doc, keys, places = seed_pairs(doc[at], x[at].astype(np.int64) >> 1, source[at], y[at].astype(np.int64) >> 1)
            if len(doc):
                yield pa.RecordBatch.from_arrays([pa.array(doc), *(pa.nulls(len(doc), t) for t in kinds[1:5]), pa.array(keys), pa.array(places)], names=names)

    def own_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owners = Owners()
        for batch in batches:
            if len(batch):
                h, doc, at = (batch.column(i).to_numpy() for i in range(3))
                row, source, place, *_ = owners.take(h, doc, at << 1)
                yield pa.RecordBatch.from_arrays([pa.array(doc[row]), pa.array(source), pa.array(at[row]), pa.array(place >> 1)], names=["doc_id", "source", "pos", "source_pos"])

    def both_seeds(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        every = np.unique(np.stack([np.r_[x >> 6, (x >> 6) + (x & 63)], np.r_[y >> 6, (y >> 6) + (y & 63)]], axis=1), axis=0)
        return every[:, 0].astype(np.int32), every[:, 1].astype(np.int32)

    def link_pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in whole_documents(batches):
            out = chained(*(pdf[c].to_numpy() for c in ("doc_id", "source", "pos", "source_pos")), both_seeds)
            yield pd.DataFrame([r[:5] for r in out], columns=["doc_id", "source", "xs", "ys", "sizes"])

    def cut(texts: pa.Table, wanted: pa.Table) -> pa.Table:
        spans: dict[int, list[tuple[int, int]]] = {}
        for d, a, b in zip(*(wanted.column(c).to_pylist() for c in ("doc_id", "lo", "hi")), strict=True):
            spans.setdefault(d, []).append((a, b))
        chosen: dict[int, str] = {}
        if spans:
            for d, t in zip(texts.column("doc_id").to_pylist(), texts.column("text").to_pylist(), strict=True):
                if d in spans and (d not in chosen or (len(t), t) > (len(chosen[d]), chosen[d])):
                    chosen[d] = t
        out = []
        for d, own in spans.items():
            words = chosen[d].encode().lower().split()
            words = (word_hashes(words, len(words)) >> np.uint64(33)).astype(np.int32)
            out += [(d, a, b, words[a:b].tobytes()) for a, b in own]
        cols = list(zip(*out, strict=True)) if out else [[]] * 4
        return pa.Table.from_arrays([pa.array(list(c), t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int32(), pa.binary()), strict=True)], names=["d", "a", "b", "words"])

    names = ["doc_id", "source_doc_id", "start_word", "end_word", "source_start", "source_end", "matched", "similarity", "n_seeds"]

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for cluster, doc, source, xs, ys, sizes, lo, lo2, hi, hi2, wa, wb in zip(*(pdf[c] for c in ("cluster", "doc_id", "source", "xs", "ys", "sizes", "lo", "lo2", "hi", "hi2", "wa", "wb")), strict=True):
                wa, wb = memoryview(wa).cast("i"), memoryview(wb).cast("i")
                if len(wa) < xs.max() - lo + K or len(wb) < ys.max() - lo2 + K:
                    continue  # seeds of another row with this id
                ends = np.cumsum(sizes)[:-1]
                found = aligned(wa, wb, [x.tolist() for x in np.split(xs - lo, ends)], [y.tolist() for y in np.split(ys - lo2, ends)], min_words, similarity)
                if any((a0 == 0 < lo) or (b0 == 0 < lo2) or a1 == hi - lo or b1 == hi2 - lo2 for a0, a1, b0, b1, *_ in found):
                    out.append((cluster, True, doc, source, *[0] * 7))  # goes on past what was read
                    continue
                out += [(cluster, False, doc, source, a0 + lo, a1 + lo, b0 + lo2, b1 + lo2, equal, round(equal / max(a1 - a0, b1 - b0), 6), n) for a0, a1, b0, b1, equal, n in found]
            yield pd.DataFrame(out, columns=["cluster", "open", *names])

    # Common seeds, at most 2 * tasks of them, and ranges of ids to deal them by.
    sample = rows.where(F.pmod(F.xxhash64(F.lit(9), "doc_id"), F.lit(SAMPLED)) == 0)
    none = np.zeros(0, dtype=np.int64)
    met = materialise(sample.mapInArrow(sample_seeds, "h long").groupBy("h").agg(F.count(F.lit(1)).alias("n")), "seed-sample")
    share = max(LEAST_MET, (met.agg(F.sum("n")).first()[0] or 0) / (2 * tasks))
    common = sorted((r["h"], r["n"]) for r in met.where(F.col("n") > share).collect())
    hot, bounds = np.array([h for h, _ in common], dtype=np.int64), none
    if common:
        pieces = min(tasks, max([2, *(int(n / share) for _, n in common)]))
        bounds = np.array(sample.agg(F.percentile_approx("doc_id", [i / pieces for i in range(1, pieces)], 10_000)).first()[0], dtype=np.int64)
    dealt = lambda df: df.repartitionById(tasks, F.col("bucket") % tasks).sortWithinPartitions("bucket")
    table = "bucket int, data binary"
    with arrow_rows(spark, PACKED_ROWS):
        matches = dealt(rows.mapInArrow(seeds_of(hot, bounds), table)).mapInArrow(own_of(hot, bounds), table)
        if common:
            matches = materialise(matches, "matches")
            # The ranges' smallest documents, a row per range of a common seed, are linked to the smallest of all.
            least = F.min(F.struct("doc_id", "pos")).over(Window.partitionBy("source"))
            heads = matches.mapInArrow(heads_of, "doc_id long, source long, pos int").withColumn("least", least).where("doc_id <> least.doc_id")
            matches = matches.union(heads.select("doc_id", F.col("least.doc_id").alias("source"), "pos", F.col("least.pos").alias("source_pos")).mapInArrow(pack_heads, table))
        schema = "doc_id long, source long, xs array<int>, ys array<int>, sizes array<int>"
        linked = materialise(dealt(matches).mapInArrow(link, schema + ", h long, at long"), "chains-and-pairs")
    in_order = lambda df: df.repartition(F.col("doc_id")).sortWithinPartitions("doc_id", "source", "pos")
    pairs = linked.where("h is not null").select("h", "doc_id", "at").repartition(F.col("h")).sortWithinPartitions("h", "doc_id", "at")
    more = in_order(pairs.mapInArrow(own_pairs, "doc_id long, source long, pos long, source_pos long")).mapInPandas(link_pairs, schema)
    found = linked.where("h is null").drop("h", "at").union(more)
    left = materialise(found.withColumn("cluster", F.monotonically_increasing_id()), "chains")

    of_chunk = F.pmod(F.xxhash64("doc_id"), F.lit(chunks)).cast("int").alias("chunk")
    done, context, texts = None, CONTEXT, rows
    while True:
        span = lambda c: (F.greatest(F.lit(0), F.array_min(c) - context), F.array_max(c) + K + context)  # noqa: B023, E731
        (lo, hi), (lo2, hi2) = span("xs"), span("ys")
        left = left.select("cluster", "doc_id", "source", "xs", "ys", "sizes", lo.alias("lo"), hi.alias("hi"), lo2.alias("lo2"), hi2.alias("hi2"))
        spans = left.select("doc_id", "lo", "hi").union(left.select("source", "lo2", "hi2")).distinct()
        if done is not None:  # few documents are left
            ids = materialise(spans.select("doc_id").distinct(), "open-documents")
            texts = rows.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "doc_id", "left_semi")
        slices = texts.select("doc_id", "text", of_chunk).groupBy("chunk").cogroup(spans.select("doc_id", "lo", "hi", of_chunk).groupBy("chunk")).applyInArrow(cut, "d long, a int, b int, words binary")
        slices = materialise(slices, "slices")
        sides = [slices.select(F.col("d").alias(f"{s}_d"), F.col("a").alias(f"{s}_a"), F.col("b").alias(f"{s}_b"), F.col("words").alias(f"w{s}")) for s in "ab"]
        both = left.join(sides[0], (F.col("doc_id") == F.col("a_d")) & (F.col("lo") == F.col("a_a")) & (F.col("hi") == F.col("a_b")))
        both = both.join(sides[1], (F.col("source") == F.col("b_d")) & (F.col("lo2") == F.col("b_a")) & (F.col("hi2") == F.col("b_b")))
        both = both.select("cluster", "doc_id", "source", "xs", "ys", "sizes", "lo", "hi", "lo2", "hi2", "wa", "wb")
        told = both.mapInPandas(compare, "cluster long, open boolean, doc_id long, source_doc_id long, start_word int, end_word int, source_start int, source_end int, matched int, similarity double, n_seeds int")
        with arrow_rows(spark, max(16, ROWS_OF_WORDS // context)):  # slices are long in later rounds
            told = materialise(told, "passages")
        now = told.where("not open").select(*names)
        done = now if done is None else done.union(now)
        still = told.where("open").select("cluster")
        if still.isEmpty():
            break
        left, context = materialise(left.join(still, "cluster", "left_semi"), "open-chains"), context * MORE_CONTEXT
    # Clusters that were extended over one another tell the same passage once, and none that lies inside another of the pair.
    once = done.groupBy("doc_id", "source_doc_id", "start_word", "end_word").agg(F.max(F.struct("matched", "similarity", "source_start", "source_end", "n_seeds")).alias("x"))
    before = Window.partitionBy("doc_id", "source_doc_id").orderBy("start_word", F.desc("end_word")).rowsBetween(Window.unboundedPreceding, -1)
    once = once.withColumn("reached", F.max("end_word").over(before)).where("reached is null or reached < end_word")
    return once.select("doc_id", "source_doc_id", "start_word", "end_word", "x.source_start", "x.source_end", "x.matched", "x.similarity", "x.n_seeds")
