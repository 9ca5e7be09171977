"""Byte pair encoding and decoding with forced boundaries.

A merge that joins two bytes makes a token that holds them side by side, and every such token is in the vocabulary.
So a pair of bytes that lies inside no vocabulary token can never be joined: between them there is a certain cut. The
operator collects the pairs that do occur, cuts each word at all others, encodes the fragments independently (each
fragment once; they repeat far more than words do) and concatenates their ids. Word boundaries, which the tokenizer's
own splitting gives, are certain cuts as well.

White space never lies inside a token, so texts are handled by their white-space-separated pieces, each looked up in
a bounded table of pieces already encoded. Texts with characters outside a plain Latin set go through the tokenizer
file's own normalisation and splitting, so that every Unicode rule is the library's; the encoding proper is the same.

The vocabulary file's path is a parameter; executors read it from their own disk, where the library is installed.

Defined cases: a null text is empty and gives no tokens; special tokens' strings in a text become their ids; an empty
table gives an empty result; ids may repeat or be null; other columns may have any name.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symloom.llm.common import text_or_empty

#: Entries of each table of encoded pieces and fragments.
TABLE = 200_000
WORD_END = "</w>"
#: Fragments of more bytes (rare: no two of their neighbouring bytes may be cut) are merged one by one, by the
#: library's model, all others side by side: the ids are the same, and tests cross the limit in both directions.
LONG = 32
NONE = np.iinfo(np.int32).max
SLOT_BITS = 20

#: Fixed: printable ASCII and Latin letters and signs that normalisation leaves alone but for lower case.
_PLAIN = [chr(c) for c in (*range(0x21, 0x7F), *range(0xA1, 0x180)) if c not in (0xAD, 0x130, 0x149)]
_ASCII_SPACE = "\t\n\x0b\x0c\r "


def byte_alphabet() -> dict[int, str]:
    """The printable stand-in of every byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Table:
    """What was computed lately, in two halves: when the newer is full, the older goes."""

    def __init__(self, most: int = TABLE, longest: int = 64):
        self.new, self.old, self.most, self.longest = {}, {}, most // 2, longest

    def get(self, key):
        if (found := self.new.get(key)) is None and (found := self.old.get(key)) is not None:
            self.put(key, found, 0)
        return found

    def put(self, key, value, length: int) -> None:
        if length <= self.longest:
            if len(self.new) >= self.most:
                self.new, self.old = {}, self.new
            self.new[key] = value


class Encoder:
    """One vocabulary file, ready to encode; made once in each Python worker."""

    def __init__(self, path: str):
        import json

        from tokenizers import Tokenizer, models

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library = Tokenizer.from_file(path)
        self.ids: dict[str, int] = spec["model"]["vocab"]
        merges = [tuple(m if isinstance(m, list) else m.split(" ")) for m in spec["model"]["merges"]]
        self.ending = models.BPE(vocab=self.ids, merges=merges, end_of_word_suffix=WORD_END, cache_capacity=0)
        self.inner = models.BPE(vocab=self.ids, merges=merges, cache_capacity=0)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in (self.ids | self.special).items()}
        self.alphabet = byte_alphabet()
        self.back = back = {c: b for b, c in self.alphabet.items()}
        self.joined = np.zeros(1 << 16, dtype=bool)
        for token in self.ids:
            raw = [back[c] for c in token.removesuffix(WORD_END) if c in back]
            self.joined[[a << 8 | b for a, b in zip(raw, raw[1:], strict=False)]] = True
        self.shown = {i: str(i) for i in self.tokens}
        self.of_byte = np.array([self.ids[self.alphabet[b]] for b in range(256)], dtype=np.int32)
        self.of_end = np.array([self.ids[self.alphabet[b] + WORD_END] for b in range(256)], dtype=np.int32)
        self.makes = np.array([self.ids[a + b] for a, b in merges], dtype=np.int32)
        # Ranks by pair, in hash tables without collisions; what collides in one goes to the next.
        left = np.arange(len(merges), dtype=np.int32)
        pairs = np.array([self.ids[a] << 16 | self.ids[b] for a, b in merges], dtype=np.uint64)
        self.merges, factor = [], 0x9E3779B97F4A7C15
        while len(left):
            slot = (pairs[left] * np.uint64(factor) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
            _, first = np.unique(slot, return_index=True)
            keys, merged = np.full(1 << SLOT_BITS, (1 << 64) - 1, dtype=np.uint64), np.zeros(1 << SLOT_BITS, dtype=np.int32)
            keys[slot[first]], merged[slot[first]] = pairs[left[first]], left[first]
            self.merges.append((np.uint64(factor), keys, merged))
            left, factor = np.delete(left, first), factor * 0x2545F4914F6CDD1D & ((1 << 64) - 1) | 1
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.plain = re.compile(f"[{re.escape(''.join(_PLAIN))}{_ASCII_SPACE}]*")
        kinds = {k: "".join(re.escape(c) for c in _PLAIN if unicodedata.category(c)[0] == k) for k in "LN"}
        self.words = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{kinds['L']}]+|[{kinds['N']}]|[^\s{kinds['L']}{kinds['N']}]+")
        self.pieces = Table()

    def _pair(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of the merge of tokens a and b (NONE where there is none) and the token that it makes."""
        key = a.astype(np.uint64) << np.uint64(16) | b.astype(np.uint64)
        rank, made = np.full(len(key), NONE, dtype=np.int32), np.zeros(len(key), dtype=np.int32)
        for factor, keys, merges in self.merges:
            slot = (key * factor >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
            hit = keys[slot] == key
            found = merges[slot[hit]]
            rank[hit], made[hit] = found, self.makes[found]
        return rank, made

    def cuts(self, raw: np.ndarray, word_ends: np.ndarray) -> np.ndarray:
        """Ends of the fragments in words laid end to end: word ends, and between any two bytes that no token joins."""
        certain = np.zeros(len(raw), dtype=bool)
        certain[:-1] = ~self.joined[raw[:-1].astype(np.int64) << 8 | raw[1:]]
        certain[word_ends - 1] = True
        return np.flatnonzero(certain) + 1

    def words_ids(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after another, and how many each word has."""
        raw = np.frombuffer(b"".join(words), dtype=np.uint8)
        word_ends = np.cumsum([len(w) for w in words])
        ends = self.cuts(raw, word_ends)
        starts = np.concatenate([[0], ends[:-1]])
        last = np.isin(ends, word_ends, assume_unique=True)
        size, counts, rows = ends - starts, np.zeros(len(ends), dtype=np.int64), []
        for low, high in ((0, 8), (8, 16), (16, LONG)):
            if len(own := np.flatnonzero((size > low) & (size <= high))):
                rows.append((own, *self._merge(raw, starts[own], size[own], last[own], high)))
                counts[own] = rows[-1][2]
        for i in np.flatnonzero(size > LONG):
            model = self.ending if last[i] else self.inner
            ids = [t.id for t in model.tokenize("".join([self.alphabet[b] for b in raw[starts[i] : ends[i]].tolist()]))]
            rows.append((np.array([i]), np.array([ids]), np.array([len(ids)])))
            counts[i] = len(ids)
        at = np.cumsum(counts) - counts
        out = np.zeros(int(counts.sum()), dtype=np.int32)
        for own, ids, n in rows:
            there = np.arange(ids.shape[1]) < n[:, None]
            out[(at[own][:, None] + np.arange(ids.shape[1]))[there]] = ids[there]
        first = np.searchsorted(ends, word_ends - np.array([len(w) for w in words]), side="right")
        return out, np.add.reduceat(counts, first)

    def _merge(self, raw: np.ndarray, start: np.ndarray, size: np.ndarray, last: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Merges of many fragments side by side: each round joins every fragment's pair of lowest rank, leftmost first."""
        col = np.arange(width)
        ids = self.of_byte[raw[np.minimum(start[:, None] + col, len(raw) - 1)]]
        tail = np.flatnonzero(last)
        ids[tail, size[tail] - 1] = self.of_end[raw[start[tail] + size[tail] - 1]]
        rank, made = (x.reshape(len(ids), width - 1) for x in self._pair(ids[:, :-1].ravel(), ids[:, 1:].ravel()))
        rank[col[:-1] >= size[:, None] - 1] = NONE
        out, n, rows = ids.copy(), size.copy(), np.arange(len(ids))
        while len(rows):
            at = rank.argmin(axis=1)
            open_ = rank[np.arange(len(at)), at] != NONE
            out[rows[~open_]] = ids[~open_]
            rows, ids, rank, made, at = rows[open_], ids[open_], rank[open_], made[open_], at[open_]
            if not len(rows):
                break
            k = np.arange(len(rows))
            token = made[k, at]
            shift = np.minimum(col + (col > at[:, None]), width - 1)
            ids, rank, made = (np.take_along_axis(x, shift[:, : x.shape[1]].clip(max=x.shape[1] - 1), axis=1) for x in (ids, rank, made))
            ids[k, at] = token
            n[rows] -= 1
            rank[:, -1] = NONE
            for left in (at - 1, at):
                ok = (left >= 0) & (left < n[rows] - 1)
                rank[k[~ok], left[~ok].clip(0, width - 2)] = np.where(left[~ok] < 0, rank[k[~ok], 0], NONE)
                rank[k[ok], left[ok]], made[k[ok], left[ok]] = self._pair(ids[k[ok], left[ok]], ids[k[ok], left[ok] + 1])
        return out, n

    def learn(self, pieces: list[str]) -> list[tuple[str, str, int]]:
        """Of plain pieces without white space: ids and tokens, joined by spaces, and their number; kept in the table."""
        words, per_piece = [], []
        for p in pieces:
            found = self.words.findall(p)
            words += [w.encode() for w in found]
            per_piece.append(len(found))
        ids, counts = self.words_ids(words)
        first = np.cumsum(per_piece) - per_piece
        n = np.add.reduceat(counts, first).tolist()
        ids, out, at, shown, tokens = ids.tolist(), [], 0, self.shown, self.tokens
        for p, k in zip(pieces, n, strict=True):
            own = ids[at : at + k]
            at += k
            out.append((" ".join([shown[i] for i in own]), " ".join([tokens[i] for i in own]), k))
            self.pieces.put(p, out[-1], len(p))
        return out

    def batch(self, texts: list[str]) -> list[list[tuple[str, str, int]]]:
        """For each text its pieces' ids, tokens and numbers; pieces that are new to the table are encoded together."""
        cut = [self.split_special.split(t) if self.split_special else [t] for t in texts]
        plain = [[part.lower().split() if not k % 2 and self.plain.fullmatch(part) else None for k, part in enumerate(parts)] for parts in cut]
        wanted = set().union(*[p for parts in plain for p in parts if p])
        have = {p: f for p in wanted if (f := self.pieces.get(p)) is not None}
        if new := sorted(wanted - have.keys()):
            have.update(zip(new, self.learn(new), strict=True))
        out = []
        for parts, pieces in zip(cut, plain, strict=True):
            found = []
            for k, (part, own) in enumerate(zip(parts, pieces, strict=True)):
                if own is not None:
                    found += [have[p] for p in own]
                elif k % 2:
                    found.append((str(self.special[part]), part, 1))
                elif shown := self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(part)):
                    ids = self.words_ids([bytes([self.back[c] for c in word]) for word, _ in shown])[0].tolist()
                    found.append((" ".join([self.shown[i] for i in ids]), " ".join([self.tokens[i] for i in ids]), len(ids)))
            out.append(found)
        return out

    def parts(self, text: str) -> list[tuple[str, str, int]]:
        return self.batch([text])[0]

    def encode(self, text: str) -> list[int]:
        return [int(i) for p in self.parts(text) for i in p[0].split()]

    def decode(self, ids: list[int]) -> str:
        """As a tokenizer file without a decoder gives it: tokens joined by spaces."""
        return " ".join(self.tokens[i] for i in ids)


_made: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    return _made.get(path) or _made.setdefault(path, Encoder(path))


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for each row; ``with_ids`` adds the ids and the decoded text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for batch in batches:
            own = encoder(path)
            for start in range(0, len(batch), 256):
                part = batch.slice(start, 256)
                found = own.batch(part.column(1).to_pylist())
                n = [sum([p[2] for p in x]) for x in found]
                ids = [" ".join([p[0] for p in x]) for x in found]
                decoded = [" ".join([p[1] for p in x]) for x in found]
                cols = [part.column(0), pa.array(n, pa.int64()), pa.array(map(sha, ids)), pa.array(map(sha, decoded))]
                if with_ids:
                    cols += [pa.array([[int(i) for i in x.split()] for x in ids], pa.list_(pa.int32())), pa.array(decoded, pa.string())]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_ids
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *(["ids", "decoded"] if with_ids else [])]
    return docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text")).mapInArrow(run, schema)
