"""Repeated substrings through run-length indexes.

Every LENGTH-byte string of a text has a smallest 24-byte piece (by hash); strings that follow each other and share it
make a stretch of text. Equal strings share their smallest piece, so stretches are dealt to buckets by it, and a
bucket sees every occurrence of its strings. First the buckets only learn the pieces and tell which occur in more than
one document; other stretches hold no repeats and go no further. Then of each chunk of documents a bucket gets each
distinct stretch once, with the smallest document that holds it: the rows of a hot passage grow with the chunks, not
with its copies.

A bucket first sets aside stretches that cannot match another: a common string would hold the piece and, on one side
of it, half of what else it has, and no other stretch has either of those two extensions. It builds a run-length index
of all others:
their Burrows-Wheeler transform as runs, cut also where the LENGTH-byte context changes, with a sample at each run's
end: the smallest document that holds the run's context. Stretches stream backwards through it, one LF step per byte,
all side by side; each step's run gives both the next row and, once the match is LENGTH long, the sampled document.
The answers (stretch, from which string on, first document) go back to the chunks that sent them. A chunk derives its
stretches anew, in the same order, and marks the strings that start in a smaller document.

Work per bucket and chunk is bounded (BUCKET_BYTES, CHUNK_BYTES); their numbers follow the size of the input.

Defined cases: a null text is empty; texts under LENGTH bytes stay as they are; a row without an id neither gives nor
loses anything; rows that share an id don't match each other; an empty table gives an empty result; other columns may
have any name. Two stretches count as equal when 128 bits of hash and their lengths agree.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symloom.llm.common import materialise, text_or_empty

LENGTH = 50
PIECE = 24
#: Most strings in a stretch.
STRETCH = 32
CHUNK_BYTES = 4 << 20
#: Bytes of text per bucket; its stretches take some 0.6 of that.
BUCKET_BYTES = 12 << 20
#: A bucket indexes its stretches in so many parts, one after another: a part fits the processor's cache.
PARTS = 16

_RNG = np.random.default_rng(50)
_CODES = _RNG.integers(1, 1 << 63, (2, 256), dtype=np.uint64)
_BASES = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95)]
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * _MIX
    return x ^ x >> np.uint64(29)


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(high, low): base to the power i, for i up to n, is high[i >> 12] * low[i & 4095]."""
    low = np.cumprod(np.r_[np.uint64(1), np.full(4095, base, dtype=np.uint64)])
    step = np.uint64(pow(base, 4096, 1 << 64))
    return np.cumprod(np.r_[np.uint64(1), np.full(n >> 12, step, dtype=np.uint64)]), low


def _range_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of data[start:end] each."""
    out = []
    for k, base in enumerate(_BASES):
        high, low = _powers(int(base), len(data))
        sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(_CODES[k][data] * (high[:, None] * low).ravel()[: len(data)], out=sums[1:])
        high, low = _powers(pow(int(base), -1, 1 << 64), len(data))
        out.append(_mixed((sums[end] - sums[start]) * (high[start >> 12] * low[start & 4095])))
    return out[0], out[1]


def _ragged(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ..., for size[0] numbers, then the next."""
    first = np.cumsum(size) - size
    return np.arange(int(size.sum()), dtype=np.int64) - np.repeat(first - start, size)


def _piece_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the PIECE bytes from each position on."""
    words = np.ndarray((len(data) - 7,), dtype="<u8", buffer=np.ascontiguousarray(data), strides=(1,))
    m = len(data) - PIECE + 1
    return _mixed(words[:m] * _BASES[0] ^ (words[8 : m + 8] + _BASES[1]) * _MIX ^ _mixed(words[PIECE - 8 :]))


def _may_repeat(data: np.ndarray, start: np.ndarray, size: np.ndarray, length: int) -> np.ndarray:
    """Of stretches laid end to end: which may share a string with another one."""
    h = np.full(len(data), np.iinfo(np.uint64).max, dtype=np.uint64)
    h[: len(data) - PIECE + 1] = pieces = _piece_hashes(data)
    for i in range(1, PIECE):  # pieces that would run over a stretch's end
        h[start + size - i] = np.iinfo(np.uint64).max
    at = np.flatnonzero(h == np.repeat(np.minimum.reduceat(h, start), size))
    owner = np.searchsorted(start, at, side="right") - 1
    count = np.bincount(owner, minlength=len(start))
    place = at[np.searchsorted(owner, np.arange(len(start)))]
    more = (length - PIECE) // 2
    keep = count > 1  # the piece comes twice: no telling which one a string holds
    for a, b in ((place - more, place + PIECE), (place, place + PIECE + more)):
        there = np.flatnonzero((a >= start) & (b <= start + size))
        if not len(there):
            continue
        # Two pieces that overlap cover the extension; a hash that two of them share by chance only keeps more.
        key = _mixed(pieces[a[there]] * _BASES[1] ^ pieces[b[there] - PIECE])
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        keep[there[order[np.r_[False, same] | np.r_[same, False]]]] = True
    return keep


def stretches(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document row, first string's start, number of strings, smallest piece's hash) of every stretch, in text order."""
    n, none = len(data), np.zeros(0, dtype=np.int64)
    sizes = np.diff(offsets)
    if n < length or not (sizes >= length).any():
        return none, none, none, none.astype(np.uint64)
    h = _piece_hashes(data)
    # Smallest over `length - PIECE + 1` pieces, by doubling.
    wide, low = 1, h
    span = length - PIECE + 1
    while wide * 2 <= span:
        low = np.minimum(low[: len(low) - wide], low[wide:])
        wide *= 2
    if wide < span:
        low = np.minimum(low[: len(low) - (span - wide)], low[span - wide :])
    fresh = np.ones(len(low) + 1, dtype=bool)
    np.not_equal(low[1:], low[:-1], out=fresh[1:-1])
    own = np.flatnonzero(sizes >= length)
    fresh[offsets[own]] = fresh[offsets[own + 1] - length + 1] = True  # a text's first string, and past its last
    first = np.flatnonzero(fresh)
    first, run = first[:-1], np.diff(first)
    row = np.searchsorted(offsets, first, side="right") - 1
    inside = first + length <= offsets[row + 1]
    first, run, row = first[inside], run[inside], row[inside]
    parts = -(-run // STRETCH)
    begin = np.repeat(first, parts) + _ragged(np.zeros(len(run), dtype=np.int64), parts) * STRETCH
    count = np.minimum(STRETCH, np.repeat(first + run, parts) - begin)
    return np.repeat(row, parts), begin, count, np.repeat(low[first], parts)


class Chunk:
    """A chunk of documents and its stretches, in an order that their contents alone decide."""

    def __init__(self, table: pa.Table, buckets: int, length: int = LENGTH):
        table = table.combine_chunks()
        ids, self.texts = table.column("doc_id").to_pylist(), table.column("raw").to_pylist()
        self.ids = np.array([0 if x is None else x for x in ids], dtype=np.int64)
        self.sizes = np.array([len(t) for t in self.texts], dtype=np.int64)
        self.data = np.frombuffer(b"".join(self.texts), dtype=np.uint8)
        self.offsets = np.r_[0, np.cumsum(self.sizes)]
        self.length = length
        self.row, self.at, count, low = stretches(self.data, self.offsets, length)
        self.size = count + length - 1
        if None in ids:
            known = ~np.array([x is None for x in ids])[self.row]
            self._keep(known)
            low = low[known]
        # Bucket above, 31 bits of the piece's hash below.
        key = _mixed(low * _BASES[1])
        self.piece = key % np.uint64(buckets) << np.uint64(32) | key >> np.uint64(33)

    def _keep(self, which: np.ndarray) -> None:
        self.row, self.at, self.size = self.row[which], self.at[which], self.size[which]

    def pieces(self) -> Iterator[tuple[int, bytes]]:
        """(bucket, sorted pieces with a low bit that says: in several documents) for each bucket."""
        order = np.argsort(self.piece)
        piece, ids = self.piece[order], self.ids[self.row[order]]
        if not len(piece):
            return
        first = np.flatnonzero(np.r_[True, piece[1:] != piece[:-1]])
        several = np.minimum.reduceat(ids, first) != np.maximum.reduceat(ids, first)
        piece = piece[first]
        bucket = (piece >> np.uint64(32)).astype(np.int64)
        told = ((piece & np.uint64(0x7FFFFFFF)).astype(np.uint32) << np.uint32(1)) | several
        cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
        for lo, hi in zip(cuts, np.r_[cuts[1:], len(piece)], strict=False):
            yield int(bucket[lo]), told[lo:hi].tobytes()

    def sort(self, replies: dict[int, bytes]) -> None:
        """Keep the stretches whose pieces repeat, as the buckets' bit masks say, and sort them by content."""
        piece = np.sort(self.piece)
        piece = piece[np.r_[True, piece[1:] != piece[:-1]]] if len(piece) else piece
        bucket = (piece >> np.uint64(32)).astype(np.int64)
        cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(piece) else np.zeros(0, dtype=np.int64)
        repeats = np.zeros(len(piece), dtype=bool)
        for lo, hi in zip(cuts, np.r_[cuts[1:], len(piece)], strict=False):
            if (mask := replies.get(int(bucket[lo]))) is not None:
                repeats[lo:hi] = np.unpackbits(np.frombuffer(mask, dtype=np.uint8), count=hi - lo).astype(bool)
        which = repeats[np.searchsorted(piece, self.piece)] if len(piece) else np.zeros(0, dtype=bool)
        self._keep(which)
        self.bucket = (self.piece[which] >> np.uint64(32)).astype(np.int64)
        begin = np.cumsum(self.size) - self.size
        h1, h2 = _range_hashes(self.data[_ragged(self.at, self.size)], begin, begin + self.size)
        part = (self.piece[which] % np.uint64(PARTS)).astype(np.uint8)
        # Equal stretches have one bucket and part: these, above half of a hash, lead the order.
        lead = (self.bucket.astype(np.uint64) * np.uint64(PARTS) + part) << np.uint64(32) | h1 >> np.uint64(32)
        order = np.lexsort((self.ids[self.row], h2, lead))
        self._keep(order)
        self.bucket, self.part, h1, h2 = self.bucket[order], part[order], h1[order], h2[order]
        new = np.ones(len(order), dtype=bool)
        new[1:] = (self.bucket[1:] != self.bucket[:-1]) | (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1]) | (self.size[1:] != self.size[:-1])
        #: Of each distinct stretch: its first occurrence in the sorted arrays.
        self.first = np.flatnonzero(new)
        self.copies = np.diff(np.r_[self.first, len(order)])
        self.bucket_first = np.flatnonzero(np.r_[True, np.diff(self.bucket[self.first]) != 0]) if len(self.first) else np.zeros(0, dtype=np.int64)

    def bundles(self) -> Iterator[tuple[int, bytes, bytes, bytes, bytes, bytes]]:
        """(bucket, parts, lengths, smallest ids, in several documents?, bytes) for each bucket."""
        squeeze = zstandard.ZstdCompressor(level=1)
        for lo, hi in zip(self.bucket_first, np.r_[self.bucket_first[1:], len(self.first)], strict=False):
            f = self.first[lo:hi]
            ids = self.ids[self.row[f]]
            last = self.ids[self.row[f + self.copies[lo:hi] - 1]]  # sorted by id within a stretch
            raw = self.data[_ragged(self.at[f], self.size[f])]
            yield int(self.bucket[f[0]]), self.part[f].tobytes(), self.size[f].astype(np.uint8).tobytes(), ids.tobytes(), (last != ids).tobytes(), squeeze.compress(raw.tobytes())

    def removed(self, replies: Iterator[tuple[int, bytes, bytes, bytes]]) -> np.ndarray:
        """Which bytes go, from the answers of the buckets."""
        length = self.length
        marks = np.zeros(len(self.data) + 2, dtype=np.int32)
        at_bucket = {int(self.bucket[self.first[i]]): int(i) for i in self.bucket_first}
        for bucket, entry, begin, owner in replies:
            entry, begin, owner = np.frombuffer(entry, dtype=np.int32).astype(np.int64), np.frombuffer(begin, dtype=np.uint8).astype(np.int64), np.frombuffer(owner, dtype=np.int64)
            f = at_bucket[bucket] + entry
            strings = self.size[self.first[f]] - length + 1
            until = np.r_[begin[1:], 0]
            until = np.where(np.r_[entry[1:] != entry[:-1], True], strings, until)
            n = self.copies[f]
            place = _ragged(self.first[f], n)
            hit = np.repeat(owner, n) < self.ids[self.row[place]]
            a, b = (self.at[place] + np.repeat(begin, n))[hit], (self.at[place] + np.repeat(until, n))[hit]
            np.add.at(marks, a, 1)
            np.add.at(marks, b, -1)
        starts = np.cumsum(marks)[: len(self.data)] > 0  # strings that go
        cover = np.zeros(len(self.data) + length + 1, dtype=np.int32)
        s = np.flatnonzero(starts)
        cover[s] += 1
        cover[s + length] -= 1
        return np.cumsum(cover)[: len(self.data)] > 0


class RunLengthIndex:
    """Of strings laid end to end: runs of their Burrows-Wheeler transform and a sample at each run's end."""

    def __init__(self, data: np.ndarray, size: np.ndarray, owner: np.ndarray, length: int = LENGTH):
        """owner: of each string, the smallest document that holds it."""
        m = len(size)
        self.size = size
        total = int(size.sum()) + m
        end = np.cumsum(size + 1) - 1
        inside = np.ones(total, dtype=bool)
        inside[end] = False
        present = np.bincount(data, minlength=256) > 0
        text = np.zeros(total, dtype=np.int16)  # 0 ends a string
        text[inside] = np.cumsum(present).astype(np.int16)[data]
        left = (np.repeat(end, size + 1) - np.arange(total)).astype(np.int32)  # bytes up to the string's end
        string = np.repeat(np.arange(m), size + 1)

        def after(x: np.ndarray, i: int) -> np.ndarray:
            """What stands i places on in the same string; 0 past its end."""
            out = np.zeros_like(x)
            out[: max(0, total - i)] = x[i:]
            return out * (left > i)

        bits = max(1, int(present.sum()).bit_length())
        key, known = text.astype(np.int64), 1
        while known * 2 * bits <= 63:
            key, known = key << bits * known | after(key, known), known * 2
        while (known + 1) * bits <= 63:
            key, known = key << bits | after(text, known), known + 1
        rank = self._ranks(key)
        part, covered = rank, known  # equal over `covered` bytes: the longest such ranks within a context
        while known < int(size.max(initial=0)):
            further = [after(rank + 1, i * known) for i in (1, 2)]
            if total < 1 << 20:
                key = rank.astype(np.int64) << 42 | further[0].astype(np.int64) << 21 | further[1]
            else:
                key = self._ranks(rank.astype(np.int64) << 32 | further[0]).astype(np.int64) << 32 | further[1]
            rank, known = self._ranks(key), known * 3
            if known <= length:
                part, covered = rank, known
        order = (np.sort(rank.astype(np.int64) << 32 | np.arange(total)) & 0xFFFFFFFF).astype(np.int32)
        # Rows that share their first `length` bytes lie side by side.
        long = left[order] >= length
        same = long[1:] & long[:-1]
        for i in sorted({*range(0, max(1, length - covered), covered), max(0, length - covered)}):
            there = part[np.minimum(order + i, total - 1)]
            same &= there[1:] == there[:-1]
        fresh = np.r_[True, ~same]
        before = text[order - 1]  # before the first one stands the last one's end, 0 as well
        new_run = fresh.copy()
        new_run[1:] |= before[1:] != before[:-1]
        self.run_start = np.flatnonzero(new_run)
        self.run_char = before[self.run_start]
        # Runs by row: a bit per row that begins one, and how many began before each 32 rows.
        bits = np.packbits(np.r_[new_run, np.zeros(-total % 32, dtype=bool)], bitorder="little").view("<u4")
        self.begins, counts = bits, np.bitwise_count(bits).astype(np.int64)
        self.began = np.cumsum(counts) - counts
        run_len = np.diff(np.r_[self.run_start, total])
        context = np.minimum.reduceat(owner[string[order]], np.flatnonzero(fresh))
        #: The sample of each run: the smallest document that holds its context.
        self.sample = context[np.cumsum(fresh)[self.run_start] - 1]
        # LF of a run's first row: rows of smaller characters, then of its own character in earlier runs.
        by_char = np.argsort(self.run_char, kind="stable")
        self.lf_start = np.empty(len(by_char), dtype=np.int64)
        self.lf_start[by_char] = np.cumsum(run_len[by_char]) - run_len[by_char]
        self.m = m

    @staticmethod
    def _ranks(key: np.ndarray) -> np.ndarray:
        order = np.argsort(key)
        step = np.r_[0, np.cumsum(np.diff(key[order]) != 0)]
        rank = np.empty(len(key), dtype=np.int32)
        rank[order] = step
        return rank

    def run_of(self, row: np.ndarray) -> np.ndarray:
        word = row >> 5
        upto = np.uint32(0xFFFFFFFF) >> (31 - (row & 31)).astype(np.uint32)
        return self.began[word] + np.bitwise_count(self.begins[word] & upto) - 1

    def stream(self, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(string, start, sampled document) for every ``length``-byte match of the strings, each read from its end."""
        order = np.argsort(-self.size, kind="stable")
        row, longest = order.astype(np.int64), self.size[order]
        out = []
        for matched in range(int(longest[0]) + 1 if len(order) else 0):
            live = int(np.searchsorted(-longest, -matched, side="right"))
            row, order_live = row[:live], order[:live]
            run = self.run_of(row)
            if matched >= length:
                out.append((order_live, longest[:live] - matched, self.sample[run]))
            row = self.lf_start[run] + row - self.run_start[run]
        if not out:
            return (np.zeros(0, dtype=np.int64),) * 3
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def repeated_pieces(table: pa.Table) -> Iterator[tuple[int, int, bytes]]:
    """(chunk, bucket, bit mask over the chunk's pieces) for each chunk with pieces that occur in several documents."""
    chunk, bucket = table.column("chunk").to_pylist(), table.column("bucket")[0].as_py()
    lists = [np.frombuffer(x, dtype=np.uint32) for x in table.column("pieces").to_pylist()]
    told = np.sort(np.concatenate(lists))
    piece, several = told >> np.uint32(1), (told & np.uint32(1)).astype(bool)
    first = np.flatnonzero(np.r_[True, piece[1:] != piece[:-1]])
    hot = piece[first][np.logical_or.reduceat(several, first) | (np.diff(np.r_[first, len(piece)]) > 1)]
    for c, own in zip(chunk, lists, strict=True):
        own = own >> np.uint32(1)
        found = hot[np.minimum(np.searchsorted(hot, own), len(hot) - 1)] == own if len(hot) else np.zeros(len(own), dtype=bool)
        if found.any():
            yield c, bucket, np.packbits(found).tobytes()


def answer_bucket(table: pa.Table, length: int = LENGTH) -> Iterator[tuple[int, int, bytes, bytes, bytes]]:
    """(chunk, bucket, entry, start, owner) for chunks whose stretches repeat elsewhere."""
    chunk, bucket = table.column("chunk").to_pylist(), table.column("bucket")[0].as_py()
    cols = {c: table.column(c).to_pylist() for c in ("parts", "sizes", "ids", "several")}
    n = np.array([len(x) for x in cols["sizes"]])
    part, size = (np.frombuffer(b"".join(cols[c]), dtype=np.uint8).astype(np.int64) for c in ("parts", "sizes"))
    ids, several = np.frombuffer(b"".join(cols["ids"]), dtype=np.int64), np.frombuffer(b"".join(cols["several"]), dtype=bool)
    source, entry = np.repeat(np.arange(len(n)), n), _ragged(np.zeros(len(n), dtype=np.int64), n)
    spread = zstandard.ZstdDecompressor()
    data = np.frombuffer(b"".join([spread.decompress(x) for x in table.column("data").to_pylist()]), dtype=np.uint8)
    start = np.cumsum(size) - size
    order = np.argsort(part, kind="stable")
    cuts = np.flatnonzero(np.r_[True, np.diff(part[order]) != 0, True])
    for lo, hi in zip(cuts, cuts[1:], strict=False):
        own = order[lo:hi]
        yield from _answer_part(chunk, bucket, data[_ragged(start[own], size[own])], size[own], ids[own], several[own], source[own], entry[own], length)


def _answer_part(chunk: list[int], bucket: int, data: np.ndarray, size: np.ndarray, ids: np.ndarray, several: np.ndarray, source: np.ndarray, entry: np.ndarray, length: int) -> Iterator[tuple[int, int, bytes, bytes, bytes]]:
    start = np.cumsum(size) - size
    keep = several | _may_repeat(data, start, size, length)
    if not keep.any():
        return
    data = data[np.repeat(keep, size)]
    size, ids, several, source, entry = size[keep], ids[keep], several[keep], source[keep], entry[keep]
    start = np.cumsum(size) - size
    h1, h2 = _range_hashes(data, start, start + size)
    order = np.lexsort((h2, h1))
    fresh = np.r_[True, (np.diff(h1[order]) != 0) | (np.diff(h2[order]) != 0) | (np.diff(size[order]) != 0)]
    first = order[np.flatnonzero(fresh)]
    string = np.empty(len(order), dtype=np.int64)
    string[order] = np.cumsum(fresh) - 1
    owner = np.minimum.reduceat(ids[order], np.flatnonzero(fresh))
    index = RunLengthIndex(data[_ragged(start[first], size[first])], size[first], owner, length)
    s, begin, doc = index.stream(length)
    # Every string of a stretch has one answer: each goes to its place.
    strings = size[first] - length + 1
    place = (np.cumsum(strings) - strings)[s] + begin
    doc[place] = doc.copy()
    s, begin = np.repeat(np.arange(len(first)), strings), _ragged(np.zeros(len(first), dtype=np.int64), strings)
    change = np.flatnonzero(np.r_[True, (np.diff(s) != 0) | (np.diff(doc) != 0)])
    s, begin, doc = s[change], begin[change], doc[change]
    where = np.searchsorted(s, np.arange(len(first) + 1))
    least = np.minimum.reduceat(doc, where[:-1])
    told = np.flatnonzero(several | (least[string] < ids))
    told = told[np.lexsort((entry[told], source[told]))]
    runs = np.diff(where)[string[told]]
    pick = _ragged(where[:-1][string[told]], runs)
    src = np.repeat(source[told], runs)
    ent = np.repeat(entry[told], runs)
    for i in np.unique(source[told]):
        a, b = np.searchsorted(src, [i, i + 1])
        yield chunk[i], bucket, ent[a:b].astype(np.int32).tobytes(), begin[pick[a:b]].astype(np.uint8).tobytes(), doc[pick[a:b]].tobytes()


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, chunk_bytes: int = CHUNK_BYTES, bucket_bytes: int = BUCKET_BYTES, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each row; ``with_text`` adds the bytes that stay.

    Removed is each byte that a string of ``length`` bytes covers which also starts in a row with a smaller id.
    """
    if length < PIECE or length + STRETCH > 255:
        raise ValueError(f"length must be from {PIECE} to {255 - STRETCH}")
    raw = F.encode(text_or_empty(text_col), "UTF-8")
    total = docs.select(F.octet_length(raw).cast("long").alias("n")).agg(F.sum("n")).first()[0] or 0
    chunks, buckets = max(1, -(-total // chunk_bytes)), max(1, -(-total // bucket_bytes))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), raw.alias("raw"))
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("doc_id", F.octet_length("raw")), F.lit(chunks)).cast("int"))

    def frame(found: list[tuple], fields: list[tuple[str, pa.DataType]]) -> pa.Table:
        columns = zip(*found, strict=True) if found else [[]] * len(fields)
        return pa.Table.from_arrays([pa.array(list(x), t) for x, (_, t) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])

    def pieces(table: pa.Table) -> pa.Table:
        chunk = table.column("chunk")[0].as_py()
        return frame([(chunk, *x) for x in Chunk(table, buckets, length).pieces()], key + [("pieces", pa.binary())])

    def repeated(table: pa.Table) -> pa.Table:
        return frame(list(repeated_pieces(table)), key + [("mask", pa.binary())])

    def masks(replies: pa.Table) -> dict[int, bytes]:
        return {b: m for b, m in zip(replies.column("bucket").to_pylist(), replies.column("mask").to_pylist(), strict=True) if m is not None}

    def send(table: pa.Table, replies: pa.Table) -> pa.Table:
        if not len(table):
            return frame([], sent)
        own = Chunk(table, buckets, length)
        own.sort(masks(replies))
        chunk = table.column("chunk")[0].as_py()
        return frame([(chunk, *x) for x in own.bundles()], sent)

    def answer(table: pa.Table) -> pa.Table:
        return frame(list(answer_bucket(table, length)), told)

    def mark(table: pa.Table, replies: pa.Table) -> pa.Table:
        if not len(table):
            return frame([], out)
        own = Chunk(table, buckets, length)
        own.sort(masks(replies))
        answers = zip(*(replies.column(c).to_pylist() for c in ("bucket", "entry", "start", "owner")), strict=True)
        gone = own.removed(x for x in answers if x[1] is not None)
        edge = np.diff(gone.astype(np.int8), prepend=0) == 1
        begins = own.offsets[:-1][own.sizes > 0]
        edge[begins] = gone[begins]
        n_gone, n_edge = np.r_[0, np.cumsum(gone)], np.r_[0, np.cumsum(edge)]
        a, b = own.offsets[:-1], own.offsets[1:]
        removed = n_gone[b] - n_gone[a]
        kept = [own.data[i:j][~gone[i:j]].tobytes() if r else t for i, j, r, t in zip(a, b, removed, own.texts, strict=True)]
        cols = [table.column("doc_id").combine_chunks(), pa.array(own.sizes), pa.array(removed), pa.array(n_edge[b] - n_edge[a]), pa.array([hashlib.sha256(k).hexdigest() for k in kept])]
        return pa.Table.from_arrays([*cols, *([pa.array(kept, pa.binary())] if with_text else [])], names=[n for n, _ in out])

    key = [("chunk", pa.int32()), ("bucket", pa.int32())]
    sent = key + [("parts", pa.binary()), ("sizes", pa.binary()), ("ids", pa.binary()), ("several", pa.binary()), ("data", pa.binary())]
    told = key + [("entry", pa.binary()), ("start", pa.binary()), ("owner", pa.binary())]
    out = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())] + [("kept", pa.binary())] * with_text
    by_chunk = rows.groupBy("chunk")
    known = by_chunk.applyInArrow(pieces, "chunk int, bucket int, pieces binary").groupBy("bucket").applyInArrow(repeated, "chunk int, bucket int, mask binary")
    known = materialise(known, "repeated-pieces")
    bundles = by_chunk.cogroup(known.groupBy("chunk")).applyInArrow(send, "chunk int, bucket int, parts binary, sizes binary, ids binary, several binary, data binary")
    replies = bundles.groupBy("bucket").applyInArrow(answer, "chunk int, bucket int, entry binary, start binary, owner binary")
    both = replies.withColumn("mask", F.lit(None).cast("binary")).unionByName(known.select("chunk", "bucket", *[F.lit(None).cast("binary").alias(c) for c in ("entry", "start", "owner")], "mask"))
    return by_chunk.cogroup(both.groupBy("chunk")).applyInArrow(mark, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text)
