"""Token ids in binary files: canonical length-limited Huffman codes, independent blocks, bit-offset checkpoints.

Texts are encoded once, ids counted over all documents, and code lengths found from the counts by package-merge, none
longer than ``LIMIT`` bits (more only where the vocabulary needs them). Codes are canonical, so a file holds lengths
alone. Documents are dealt to ranges of doc_ids and written in ascending order.

A file is: magic, payload, index, length of the index, magic. A document's bits begin at a byte; its ids form blocks of
``BLOCK``, each of which can be decoded by itself from its checkpoint, the offset of its first bit. The reader decodes
many blocks side by side: each step looks the next bits of all of them up in one table of 2^LIMIT entries. A file's
index has doc_ids, numbers of ids and checkpoints; the table of files has the number of ids before each file.

The tokenizer file's rules are compared with those that the fast path knows: byte-level splitting without prefix, no
normaliser, merges in the order of their ids. Then texts are cut at single blanks before something that is not white
space, where the splitting rule always cuts, each distinct piece is encoded once, and a piece's ids put wherever it
occurs. Pieces outside ASCII and Latin, texts with other blanks or special tokens, and files with other rules go through the
tokenizers library itself.

Defined cases: a null text is empty and holds the end id alone; null ids come first; rows of one id are ordered by a
hash of their ids, equal rows are interchangeable; an empty table gives no files and an empty result; other columns
may have any name.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symloom.llm.bpe import byte_alphabet
from symloom.llm.common import materialise, new_folder, text_or_empty
from symloom.llm.warc import open_fs

END_ID = 0
#: Bits of the longest code, ids of a block, and bytes of payload in a file, about.
LIMIT, BLOCK, FILE_BYTES = 18, 1024, 32 << 20
#: Ids that are decoded side by side, at most (one document more), and bytes of files that one task reads, about.
GROUP, BYTES_A_TASK = 4 << 20, 32 << 20
#: Ids that are packed at a time, at most (one document more): so many fit a core's cache.
PACKED = 1 << 18
#: Encoded pieces that a worker keeps.
TABLE = 1_000_000
MAGIC = b"SLTOKEN1"
TAIL = struct.Struct("<Q8s")
#: Where the text is not cut at single blanks: a blank before white space or the end.
ODD_BLANKS = r" (?:[\s\x0b\x1c-\x1f\x{85}\p{Z}]|$)"
#: Pieces of visible ASCII and Latin characters, which every version of the Unicode tables puts into the same classes.
PLAIN = re.compile("[ !-~¡-¬®-ƺ][!-~¡-¬®-ƺ]*")
SPACED = re.compile(r"[^\S\n]")


class Tokens:
    """One byte-level tokenizer file, ready to encode; made once in each Python worker."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.dtype = np.dtype("<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4")
        self.ranks = self._ranks(spec)
        self.fast = self._fast() if self.ranks else None
        self.known: dict[str, bytes] = {}
        self.end = np.array([END_ID], dtype=self.dtype).tobytes()

    @staticmethod
    def _ranks(spec: dict) -> dict[bytes, int] | None:
        """Bytes of each token to its id, if merging by smallest id is what the file says."""
        model, split = spec["model"], spec["pre_tokenizer"] or {}
        plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        splits = split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex")
        bare = not any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"])
        if not (plain and splits and bare and spec["normalizer"] is None):
            return None
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        made, back = [model["vocab"][a + b] for a, b in merges], {c: b for b, c in byte_alphabet().items()}
        if any(a >= b for a, b in zip(made, made[1:], strict=False)):
            return None
        own = {t for t in model["vocab"] if all(c in back for c in t)} - {t["content"] for t in spec["added_tokens"]}
        return {bytes(back[c] for c in t): model["vocab"][t] for t in own}

    def _fast(self):
        import public_tokenizers
        import tiktoken

        return tiktoken.Encoding("pieces", pat_str=public_tokenizers.PATTERN, mergeable_ranks=self.ranks, special_tokens={})

    def _whole(self, text: str) -> np.ndarray:
        if self.fast and text.isascii() and not any(s in text for s in self.special):
            return self.fast.encode_to_numpy(text, disallowed_special=()).astype(self.dtype)
        return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype=self.dtype)

    def _learn(self, pieces: list[str]) -> None:
        """Ids of new pieces: plain ones joined by line ends, which no token of theirs can hold."""
        line, end = self.ranks[b"\n"], np.array([self.ranks[b"\n"]], dtype=self.dtype).tobytes()
        # Parts between line ends are pieces themselves; of several line ends, three in a row or two at the end are a token.
        lines = {p: p.split("\n") for p in pieces if "\n" in p and "\n\n\n" not in p and not p.endswith("\n\n")}
        wanted = {p for p in (*pieces, *(x for parts in lines.values() for x in parts)) if p and p not in self.known}
        plain = [p for p in wanted if PLAIN.fullmatch(p)]
        for blank in (True, False):
            if own := [p for p in plain if (p[0] == " ") == blank]:
                ids = self.fast.encode_to_numpy("\n".join(own), disallowed_special=()).astype(self.dtype)
                cuts = np.flatnonzero(ids == line)
                raw, width = ids.tobytes(), self.dtype.itemsize
                starts, ends = [0, *((cuts + 1) * width).tolist()], [*(cuts * width).tolist(), len(raw)]
                self.known.update(zip(own, [raw[a:b] for a, b in zip(starts, ends, strict=True)], strict=True))
        for p in wanted - lines.keys():
            if p not in self.known:
                self.known[p] = self._whole(p).tobytes()
        self.known[""] = b""
        for p, parts in lines.items():
            self.known[p] = self._whole(p).tobytes() if SPACED.search(p, 1) else end.join([self.known[x] for x in parts])

    def encode(self, texts: pa.Array) -> tuple[memoryview, np.ndarray]:
        """Ids of texts that may be cut at every blank, each text's end id last, as bytes, and where each text ends."""
        lists = pc.split_pattern(texts, " ")
        at = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        coded = lists.flatten().dictionary_encode()
        slots, distinct = coded.indices.to_numpy().copy(), coded.dictionary
        opening = np.unique(slots[at[:-1]])
        slots[at[:-1]] = len(distinct) + np.searchsorted(opening, slots[at[:-1]])  # a text's first piece has no blank
        pieces = [" " + p for p in distinct.to_pylist()] + distinct.take(pa.array(opening)).to_pylist()
        if len(self.known) > TABLE:
            self.known = {}
        if new := [p for p in pieces if p not in self.known]:
            self._learn(new)
        have = pa.array([*[self.known[p] for p in pieces], self.end], pa.large_binary())
        found = have.take(pa.array(np.insert(slots, at[1:], len(pieces))))
        ends = np.frombuffer(found.buffers()[1], dtype=np.int64)[at + np.arange(len(at))]
        return memoryview(found.buffers()[2]), ends

    def batches(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, memoryview, np.ndarray]]:
        """(rows, ids as bytes, where each row's begin and end): every row of the texts in one of the parts, the end id after each text."""
        odd = np.ones(len(texts), dtype=bool)
        if self.ranks:
            hit = pc.match_substring_regex(texts, ODD_BLANKS)
            for s in self.special:
                hit = pc.or_(hit, pc.match_substring(texts, s))
            odd = hit.to_numpy(zero_copy_only=False)
        if len(rows := np.flatnonzero(~odd)):
            yield rows, *self.encode(texts.take(pa.array(rows)))
        if len(rows := np.flatnonzero(odd)):
            found = [self._whole(t).tobytes() + self.end for t in texts.take(pa.array(rows)).to_pylist()]
            yield rows, memoryview(b"".join(found)), np.cumsum([0, *map(len, found)])


_made: dict[str, Tokens] = {}


def tokens_of(path: str) -> Tokens:
    return _made.get(path) or _made.setdefault(path, Tokens(path))


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Bits of each symbol's code, 0 for symbols that do not occur: the least total under the limit (package-merge)."""
    lengths = np.zeros(len(counts), dtype=np.uint8)
    used = np.flatnonzero(counts)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    limit = max(limit, (len(used) - 1).bit_length())
    used = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[used].astype(np.int64)
    level, masks = leaves, [np.ones(len(leaves), dtype=bool)]
    for _ in range(limit - 1):
        pairs = level[: len(level) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([leaves, pairs])
        order = np.argsort(both, kind="stable")
        level = both[order]
        masks.append(order < len(leaves))
    take, found = 2 * len(leaves) - 2, np.zeros(len(leaves), dtype=np.int64)
    for mask in reversed(masks):
        n = int(mask[:take].sum())
        found[:n] += 1
        take = 2 * (take - n)
    lengths[used] = found
    return lengths


class Code:
    """A canonical code: of symbols in the order of (length, symbol), each takes the next free code of its length."""

    def __init__(self, lengths: np.ndarray):
        self.lengths = lengths
        used = np.flatnonzero(lengths)
        order = used[np.argsort(lengths[used], kind="stable")]
        self.limit = int(lengths.max(initial=1))
        if self.limit > 24:
            raise ValueError("codes of over 24 bits")
        width = 1 << (self.limit - lengths[order].astype(np.int64))
        self.codes = np.zeros(len(lengths), dtype=np.uint64)
        self.codes[order] = ((np.cumsum(width) - width) >> (self.limit - lengths[order].astype(np.int64))).astype(np.uint64)
        self.symbol, self.step = (np.zeros(1 << self.limit, dtype=t) for t in (np.uint32, np.int64))
        self.symbol[: width.sum()], self.step[: width.sum()] = np.repeat(order, width), np.repeat(lengths[order], width)

    def pack(self, ids: np.ndarray, n: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
        """Documents' ids laid end to end to (bits, each document's bytes, blocks of each, first bit of each block in its document)."""
        size = self.lengths[ids].astype(np.int64)
        ends = np.cumsum(size)
        last = np.cumsum(n)
        first = last - n
        before = np.concatenate([[0], ends])
        begin = before[first]
        n_bytes = (before[last] - begin + 7) // 8
        shift = (np.cumsum(n_bytes) - n_bytes) * 8 - begin  # from bits laid end to end to whole bytes
        at = ends - size + np.repeat(shift, n)
        total = int(n_bytes.sum())
        words = np.zeros(total // 4 + 3, dtype=np.uint64)  # 32 bits of the stream in each, with room for what runs over
        wide = self.codes[ids] << (64 - (at & 31) - size).astype(np.uint64)
        word = at >> 5
        starts = np.flatnonzero(np.diff(word, prepend=-1))
        for half, k in ((wide >> np.uint64(32), 0), (wide & np.uint64(0xFFFFFFFF), 1)):
            if len(starts):
                words[word[starts] + k] += np.add.reduceat(half, starts)
        blocks = -(-n // BLOCK)
        of = np.repeat(np.arange(len(n)), blocks)
        k = np.arange(len(of)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        return words.astype(">u4").tobytes()[:total], n_bytes, blocks, before[first[of] + k * BLOCK] - begin[of]

    def unpack(self, payload: bytes, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Ids of blocks (first bit, number of ids), one block after another; all blocks advance side by side."""
        raw = np.frombuffer(payload + bytes(8), dtype=np.uint8)
        view = np.lib.stride_tricks.as_strided(raw[:4].view(">u4"), shape=(len(raw) - 3,), strides=(1,))
        order = np.argsort(-n, kind="stable")
        bit, left = at[order].astype(np.int64), n[order]
        place = (np.cumsum(n) - n)[order]
        out = np.zeros(int(n.sum()), dtype=np.uint32)
        open_ = len(left) - np.searchsorted(left[::-1], np.arange(int(left.max(initial=0))), side="right")
        rest = np.uint32(32 - self.limit)
        for step, m in enumerate(open_.tolist()):
            bit, place = bit[:m], place[:m]
            seen = (view[bit >> 3].astype(np.uint32) << (bit & 7).astype(np.uint32)) >> rest
            out[place + step] = self.symbol[seen]
            bit = bit + self.step[seen]
        return out


def encode_texts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids) of every row, written; ids as little-endian integers, the end id last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = tokens_of(path)
            texts = batch.column(1).cast(pa.large_string())
            for rows, raw, ends in own.batches(texts):
                # Documents of one part share a buffer; Arrow's offsets are of 32 bits, so a large part is cut.
                for low, high in pieces_of(ends, 1 << 30):
                    offsets = pa.py_buffer((ends[low : high + 1] - ends[low]).astype(np.int32).tobytes())
                    blob = pa.Array.from_buffers(pa.binary(), high - low, [None, offsets, pa.py_buffer(raw[ends[low] : ends[high]])])
                    n = (ends[low + 1 : high + 1] - ends[low:high]) // own.dtype.itemsize
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows[low:high])), pa.array(n), blob], names=["doc_id", "n_tokens", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text_or_empty(F.col(f"`{text_col}`")).alias("text"))
    out = rows.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids binary")
    folder = new_folder(docs.sparkSession, "token-ids")
    out.write.option("compression", "zstd").parquet(folder)
    return docs.sparkSession.read.schema(out.schema).parquet(folder)


def pieces_of(ends: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs (from, to) of items with at most so many bytes, or one item."""
    low = 0
    while low < len(ends) - 1:
        high = max(low + 1, int(np.searchsorted(ends, ends[low] + most, side="right")) - 1)
        yield low, high
        low = high


def flat_ids(blobs: pa.Array, dtype: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    at = np.frombuffer(blobs.buffers()[1], dtype=np.int32)[blobs.offset : blobs.offset + len(blobs) + 1].astype(np.int64)
    raw = np.frombuffer(blobs.buffers()[2] or b"", dtype=np.uint8)[at[0] : at[-1]] if len(blobs) else np.zeros(0, np.uint8)
    return raw.view(dtype), np.diff(at) // dtype.itemsize


def count_ids(encoded: DataFrame, dtype: np.dtype, size: int) -> np.ndarray:
    """How often each id occurs in all documents; tasks count, the driver gets a row for each id of the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, dtype=np.int64)
        for batch in batches:
            total += np.bincount(flat_ids(batch.column(0), dtype)[0], minlength=size)
        own = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(total[own])], names=["id", "n"])

    counts = np.zeros(size, dtype=np.int64)
    for r in encoded.select("ids").mapInArrow(run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        counts[r["id"]] = r["n"]
    return counts


class FileWriter:
    def __init__(self, fs, path: str, code: Code):
        self.sink, self.code, self.at = fs.open_output_stream(path), code, 0
        self.ids, self.n, self.marks = [], [], []
        self.sink.write(MAGIC)

    def put(self, doc_ids: list[str | None], ids: np.ndarray, n: np.ndarray) -> None:
        bits, n_bytes, blocks, marks = self.code.pack(ids, n)
        self.ids += doc_ids
        self.n += n.tolist()
        self.marks.append(marks + np.repeat(self.at + np.cumsum(n_bytes) - n_bytes, blocks) * 8)
        self.sink.write(bits)
        self.at += len(bits)

    def close(self) -> int:
        """Writes the index; returns the file's size."""
        parts = [json.dumps(self.ids).encode(), np.array(self.n, dtype="<i8").tobytes(), np.concatenate(self.marks).astype("<i8").tobytes(), self.code.lengths.tobytes()]
        packed = [zlib.compress(p, 1) for p in parts]
        index = struct.pack("<QII4Q", self.at, BLOCK, len(parts), *map(len, packed)) + b"".join(packed)
        self.sink.write(index + TAIL.pack(len(index), MAGIC))
        self.sink.close()
        return len(MAGIC) + self.at + len(index) + TAIL.size


class FileReader:
    def __init__(self, fs, path: str, size: int):
        self.f = fs.open_input_file(path)
        length, magic = TAIL.unpack(self.range(size - TAIL.size, TAIL.size))
        if magic != MAGIC or self.range(0, len(MAGIC)) != MAGIC:
            raise ValueError(f"{path} is no file of token ids")
        raw = self.range(size - TAIL.size - length, length)
        self.bytes, self.block, _, *sizes = struct.unpack_from("<QII4Q", raw)
        parts, at = [], 48
        for n in sizes:
            parts.append(zlib.decompress(raw[at : at + n]))
            at += n
        self.ids, self.n, self.marks = json.loads(parts[0]), np.frombuffer(parts[1], "<i8"), np.frombuffer(parts[2], "<i8")
        self.code = Code(np.frombuffer(parts[3], np.uint8))
        self.first = np.concatenate([[0], np.cumsum(-(-self.n // self.block))])

    def range(self, at: int, n: int) -> bytes:
        self.f.seek(at)
        return self.f.read(n)

    def documents(self, low: int, high: int) -> np.ndarray:
        """Ids of documents low to high - 1: only their bits are read."""
        a, b = self.first[low], self.first[high]
        start = int(self.marks[a]) // 8
        end = int(self.marks[b]) // 8 if b < len(self.marks) else self.bytes
        k = np.arange(a, b) - np.repeat(self.first[low:high], np.diff(self.first[low : high + 1]))
        n = np.minimum(self.block, np.repeat(self.n[low:high], np.diff(self.first[low : high + 1])) - k * self.block)
        return self.code.unpack(self.range(len(MAGIC) + start, end - start), self.marks[a:b] - start * 8, n)


def write_files(encoded: DataFrame, lengths: np.ndarray, dtype: np.dtype, folder: str) -> DataFrame:
    """Files of documents in ascending doc_id; the table of files, written: part, seq, file, size, documents, ids, start.

    part is the range of doc_ids, start the number of ids before the file in its range. Files of lost attempts are
    never named in the table.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, seq, start, writer, code = TaskContext.get(), 0, 0, None, Code(lengths)
        part = task.partitionId()
        fs, base = open_fs(folder)
        fs.create_dir(base, recursive=True)

        def finish() -> pa.RecordBatch:
            row = {"part": part, "seq": seq, "file": f"{folder}/{name}", "size": writer.close(), "documents": len(writer.n), "ids": sum(writer.n), "start": start}
            return pa.RecordBatch.from_pylist([row], schema=schema)

        for batch in batches:
            ends = np.concatenate([[0], np.cumsum(batch.column(1).to_numpy())])
            for low, high in pieces_of(ends, PACKED):
                if writer is None:
                    name = f"part-{part:06d}-{task.taskAttemptId()}-{seq:04d}.tok"
                    writer = FileWriter(fs, f"{base}/{name}", code)
                own = batch.slice(low, high - low)
                writer.put(own.column(0).to_pylist(), *flat_ids(own.column(2), dtype))
                if writer.at >= FILE_BYTES:
                    yield finish()
                    start, seq, writer = start + sum(writer.n), seq + 1, None
        if writer is not None:
            yield finish()

    schema = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("file", pa.string()), ("size", pa.int64()), ("documents", pa.int64()), ("ids", pa.int64()), ("start", pa.int64())])
    order = ("doc_id", "tie", "place")
    # The table is written, so a row's place, by which equal rows can be dealt apart, is the same in every attempt.
    rows = encoded.select("doc_id", F.xxhash64("ids").alias("tie"), F.monotonically_increasing_id().alias("place"), "n_tokens", "ids")
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select(F.col("doc_id").cast("string"), "n_tokens", "ids")
    return materialise(rows.mapInArrow(run, "part int, seq int, file string, size long, documents long, ids long, start long"), "token-files")


def with_starts(files: DataFrame) -> DataFrame:
    """The table of files with ``start`` counted over all files; the driver gets a number for each range of ids."""
    totals = sorted((r["part"], r["n"]) for r in files.groupBy("part").agg(F.sum("ids").alias("n")).collect())
    before = np.cumsum([0, *(n for _, n in totals)]).tolist()
    bases = files.sparkSession.createDataFrame([(p, b) for (p, _), b in zip(totals, before, strict=False)], "part int, base long")
    return files.join(F.broadcast(bases), "part").withColumn("start", F.col("start") + F.col("base")).drop("base")  # a row for each range


def read_files(files: DataFrame, kind: str = "bigint", with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and ids) of every document in the files (file, size, start)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, size, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                fs, path = open_fs(file)
                reader = FileReader(fs, path, size)
                ends = np.concatenate([[0], np.cumsum(reader.n)])
                for low, high in pieces_of(ends, GROUP):
                    ids, at = reader.documents(low, high), (ends[low : high + 1] - ends[low]).tolist()
                    own = [ids[a:b] for a, b in zip(at, at[1:], strict=False)]
                    crc = [zlib.crc32(x.astype("<u4").tobytes()) for x in own]
                    cols = [pa.array(reader.ids[low:high], pa.string()), pa.array(ends[low:high] + start), pa.array(reader.n[low:high]), pa.array(crc, pa.int64())]
                    yield pa.RecordBatch.from_arrays(cols + ([pa.array([x.astype(np.int32) for x in own], pa.list_(pa.int32()))] if with_ids else []), names=names)
                reader.f.close()

    names = ["doc_id", "start", "n_tokens", "ids_crc32", *(["ids"] if with_ids else [])]
    n = max(1, -(-(files.agg(F.sum("size")).first()[0] or 0) // BYTES_A_TASK))
    rows = files.select("file", "size", "start").repartition(n, "file")
    out = rows.mapInArrow(run, "doc_id string, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)
    return out.withColumn("doc_id", F.col("doc_id").cast(kind))


def token_files(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None) -> DataFrame:
    """Encode every text, write the files (to ``folder``, else to the shared one); the table of files."""
    own = tokens_of(path)
    encoded = encode_texts(docs, path, id_col, text_col)
    lengths = code_lengths(count_ids(encoded, own.dtype, own.library.get_vocab_size()))
    return with_starts(write_files(encoded, lengths, own.dtype, folder or new_folder(docs.sparkSession, "tokens")))


def token_round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files."""
    return read_files(token_files(docs, path, id_col, text_col), docs.schema[id_col].dataType.simpleString(), with_ids)
