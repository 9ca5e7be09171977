"""Files of token ids against the tokenizers library, and codes against plain ones."""

import heapq
import json
import random
import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pytest
from pyspark.sql import functions as F

from symloom.llm import tokenfiles
from symloom.llm.common import new_folder
from symloom.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, ids string, tie long, place long"
PATH = tokenizer_path("byte_bpe_50k.json")


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


ODD = [None, "", " ", "\n", "  ", " a", "a ", "a  b", "a \n b", "a\n\n\nb", "a\n\nb c", "a\n\n", "x\n\n y", "\ta\tb", "it's we'll DON'T", "naïve café ß", "日本語 テキスト", "a b  c", " x", "a <|endoftext|> b", "<|endoftext|>", "é \U0001f600 \U0001f600", "1234 5,678.90", "a\x85b \x85", "\x1c \x1d", "ab\r\ncd \r\n", "İstanbul ŉ ǆ Ⱥ", "x" * 5000, "word " * 3000, "\n".join(["line of text."] * 700)]


def make_docs(seed=1):
    rng = random.Random(seed)
    alphabet = "aab  \n'sé.,1\t"
    texts = ODD + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(400)]
    rows = [(i * 3 % 1009, t, "x", 0, 0) for i, t in enumerate(texts)]
    return [*rows, rows[8], rows[8], (None, "null id", "x", 0, 0), (None, "another", "x", 0, 0)]


@pytest.mark.parametrize("partitions", [1, 7])
def test_files_hold_what_the_library_gives(spark, partitions, monkeypatch):
    docs = spark.createDataFrame(make_docs(), SCHEMA).repartition(3)
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        found = tokenfiles.token_round_trip(docs, PATH, with_ids=True).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    lib, want = library(), {}
    for i, text, *_ in make_docs():
        want.setdefault(i, []).append(lib.encode(text or "", add_special_tokens=False).ids + [0])
    assert len(found) == len(make_docs())
    found.sort(key=lambda r: r["start"])
    ids = [r["doc_id"] for r in found]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    at = 0
    for r in found:
        assert r["ids"] in want[r["doc_id"]]
        want[r["doc_id"]].remove(r["ids"])
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(r["ids"]), zlib.crc32(struct.pack(f"<{len(r['ids'])}I", *r["ids"])))
        at += len(r["ids"])


def test_every_latin_character_goes_the_same_way():
    own, lib = tokenfiles.tokens_of(PATH), library()
    texts = [f"a{chr(c)}b {chr(c)}{chr(c)} 1{chr(c)}" for c in range(1, 0x400)]
    assert own.fast is not None
    for rows, raw, ends in own.batches(pa.array(texts, pa.large_string())):
        ids = np.frombuffer(raw, own.dtype)
        for r, a, b in zip(rows, ends // 2, ends[1:] // 2, strict=False):
            assert ids[a:b].tolist() == lib.encode(texts[r], add_special_tokens=False).ids + [0], repr(texts[r])


def test_files_with_other_rules_go_through_the_library(tmp_path):
    spec = json.load(open(PATH, encoding="utf-8"))
    spec["pre_tokenizer"]["add_prefix_space"] = True
    path = str(tmp_path / "t.json")
    json.dump(spec, open(path, "w", encoding="utf-8"))
    own, (texts, lib) = tokenfiles.Tokens(path), (["word here", "x"], __import__("tokenizers").Tokenizer.from_file(path))
    assert own.ranks is None
    (rows, raw, ends), = own.batches(pa.array(texts, pa.large_string()))
    assert np.frombuffer(raw, own.dtype).tolist() == [x for t in texts for x in [*lib.encode(t, add_special_tokens=False).ids, 0]]


def huffman_total(counts):
    heap, total = [c for c in counts if c], 0
    heapq.heapify(heap)
    while len(heap) > 1:
        x = heapq.heappop(heap) + heapq.heappop(heap)
        total += x
        heapq.heappush(heap, x)
    return total


def limited_total(counts, limit):
    """Least total under a limit, over all sorted sequences of lengths that fill the code."""
    counts, best = sorted((c for c in counts if c), reverse=True), [10**9]

    def go(i, least, room, total):
        if total >= best[0]:
            return
        if i == len(counts):
            best[0] = total
            return
        for n in range(least, limit + 1):
            if room >= 2 ** (limit - n) * 1:
                go(i + 1, n, room - 2 ** (limit - n), total + n * counts[i])

    go(0, 1, 2**limit, 0)
    return best[0]


def test_code_lengths_are_the_best_under_the_limit():
    rng = random.Random(2)
    for _ in range(40):
        counts = np.array([rng.choice([0, 1, 1, 2, 5, 100, 10**6]) for _ in range(rng.randint(2, 9))])
        for limit in (4, 5):
            lengths = tokenfiles.code_lengths(counts, limit).astype(int)
            if (counts > 0).sum() > 1:
                assert lengths.max() <= limit and (lengths * counts).sum() == limited_total(counts, limit)
    counts = np.array([rng.randint(0, 10**rng.randint(0, 6)) for _ in range(3000)])
    lengths = tokenfiles.code_lengths(counts, 40).astype(int)
    assert (lengths * counts).sum() == huffman_total(counts.tolist())
    assert sum(2.0**-n for n in lengths if n) == 1


def test_codes_are_canonical_and_blocks_independent():
    rng = np.random.default_rng(1)
    ids = np.minimum(rng.geometric(0.01, 20_000), 3000)
    code = tokenfiles.Code(tokenfiles.code_lengths(np.bincount(ids, minlength=3001)))
    used = sorted((int(n), s) for s, n in enumerate(code.lengths) if n)
    at, before = 0, 0
    for n, s in used:
        at <<= n - before
        assert int(code.codes[s]) == at
        at, before = at + 1, n
    n = np.array([1, 5000, 1, 0, 1024, 2048, 11926])
    bits, n_bytes, blocks, first = code.pack(ids[: n.sum()], n)
    at = np.repeat(np.cumsum(n_bytes) - n_bytes, blocks) * 8 + first
    k = np.arange(len(at)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    size = np.minimum(tokenfiles.BLOCK, np.repeat(n, blocks) - k * tokenfiles.BLOCK)
    starts = np.repeat(np.cumsum(n) - n, blocks) + k * tokenfiles.BLOCK
    for i in rng.permutation(len(at)):
        assert (code.unpack(bits, at[i : i + 1], size[i : i + 1]) == ids[starts[i] : starts[i] + size[i]]).all()


def test_small_files_and_ranges_of_documents(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"text {i} " * (i % 50), "", 0, 0) for i in range(300)], SCHEMA)
    folder = new_folder(spark, "tokens")
    files = tokenfiles.token_files(docs, PATH, folder=folder)
    row = files.orderBy("start").first()
    fs, path = pafs.FileSystem.from_uri(row["file"])
    reader = tokenfiles.FileReader(fs, path, row["size"])
    lib, by_id = library(), {r["doc_id"]: r["text"] for r in docs.collect()}
    ends = np.cumsum(reader.n)
    for low, high in ((0, 1), (5, 9), (0, len(reader.ids))):
        want = [x for i in reader.ids[low:high] for x in [*lib.encode(by_id[int(i)], add_special_tokens=False).ids, 0]]
        assert reader.documents(low, high).tolist() == want and len(want) == ends[high - 1] - (ends[low - 1] if low else 0)


def test_defined_cases(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert tokenfiles.token_round_trip(empty, PATH).collect() == []
    one = spark.createDataFrame([("a", None)], "`d.id` string, `t.x` string")
    assert [tuple(r) for r in tokenfiles.token_round_trip(one, PATH, "d.id", "t.x").collect()] == [("a", 0, 1, zlib.crc32(bytes(4)))]
    assert one.select(F.col("`d.id`")).count() == 1
