"""Corpus operators against brute force on small tables with nulls, ties, repeats, empty and long texts."""

import hashlib
import io
import itertools
import math
import random
import re
import zipfile
import zlib

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from symloom.llm import ann, bpe, exact_dedup, mixing, passages, sharding, simhash, substrings, toxicity, warc
from symloom.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, name string, shard string, h long"


def make_docs(seed=1, n=120):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7))) for _ in range(400)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 3, 30, 90, 200]))) for _ in range(n)]
    texts[3], texts[4], texts[5] = None, "", " \t "
    texts[10] = texts[11] = texts[12]
    texts[20] = "x" * 3000
    texts[21] = texts[20] + "y"
    shared = " ".join(rng.choice(words) for _ in range(70))
    for i in (30, 31, 32):
        texts[i] = f"{texts[i] or ''} {shared} {texts[i + 5] or ''}"
    texts[33] = "intro " + " ".join(w if k % 9 else "ZZ" for k, w in enumerate(shared.split())) + " outro"
    ids = [*range(n - 4), 12, 12, None, 7]
    rows = [(i, t, "en", None if k % 17 == 0 else f"s{k % 4}", len(t or ""), "n", "s", 0) for k, (i, t) in enumerate(zip(ids, texts, strict=True))]
    return [*rows, rows[30]]  # one row twice


@pytest.fixture(scope="module")
def rows():
    return make_docs()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_sharding(docs, rows, empty):
    out = sharding.shard_documents(docs).collect()
    assert len(out) == len(rows) and sharding.shard_documents(empty).count() == 0
    assert sorted((r["size"], r["text_crc32"]) for r in out) == sorted((len((x[1] or "").encode()) + 1, zlib.crc32((x[1] or "").encode())) for x in rows)
    slots = {s: sorted(r["slot"] for r in out if r["shard"] == s) for s in range(16)}
    assert all(v == list(range(len(v))) for v in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    key = lambda o: sorted((str(r["doc_id"]), r["size"], r["shard"], r["slot"]) for r in o)
    assert key(out) == key(sharding.shard_documents(docs).collect())


def test_sharding_of_equal_rows(spark, tmp_path):
    """Most rows equal, or of one id: blocks stay bounded, sizes exact, reruns agree."""
    spark.range(4000).selectExpr("case when id < 2500 then null else 7 end as doc_id", "case when id < 1500 then 1 else id end as n", "'x' as block_", "id % 2 as cell_").drop("id").write.parquet(str(tmp_path / "rows"))
    df = spark.read.parquet(str(tmp_path / "rows"))
    runs = []
    for _ in range(2):
        out = sharding.shuffle_into_shards(df, 7, per_task=100)
        assert out.columns == [*df.columns, "slot", "shard"]
        runs.append(sorted(map(str, out.collect())))
        sizes = {}
        for r in out.collect():
            sizes.setdefault(r["shard"], []).append(r["slot"])
        assert sorted(map(len, sizes.values())) == [571] * 4 + [572] * 3 and all(sorted(v) == list(range(len(v))) for v in sizes.values())
    assert runs[0] == runs[1]
    # 1,500 equal rows of 4,000 are spread like the rest.
    equal = out.where("n = 1").groupBy("shard").count().collect()
    assert len(equal) == 7 and all(160 < r["count"] < 270 for r in equal)


def test_sharding_is_uniform(spark):
    """Over many seeds each row comes to each shard, and to each slot, alike (chi square), and pairs of rows are independent."""
    n, shards, seeds = 12, 3, 120
    rows = np.full(4, 3)
    places, together = np.zeros((n, shards)), 0
    for seed in range(seeds * 40):  # the matrix and the labels, as tasks draw them
        cap = sharding.even(n, shards)
        where = np.concatenate([np.random.default_rng([seed, 1, b]).permutation(np.repeat(np.arange(shards), sharding.matrix_row(b, rows, cap, seed))) for b in range(4)])
        places[np.arange(n), where] += 1
        together += int(where[0] == where[1]) + int(where[0] == where[11])
    draws = seeds * 40
    assert ((places - draws / shards) ** 2 / (draws / shards)).sum() < 60  # 22 degrees of freedom
    assert abs(together / (2 * draws) - 3 / 11) < 0.02  # in a uniform shuffle two rows share a shard of 4 with 3 in 11
    df = spark.range(24).selectExpr("id as doc_id", "cast(null as string) as text")
    firsts = [next(r["doc_id"] for r in sharding.shard_documents(df, n_shards=2, seed=s).collect() if r["shard"] == 0 and r["slot"] == 0) for s in range(12)]
    assert len(set(firsts)) > 5


def test_communication_matrix():
    rows_, caps = np.array([5, 0, 17, 9, 3]), np.array([10, 4, 20])
    m = np.stack([sharding.matrix_row(b, rows_, caps, 1) for b in range(5)])
    assert (m.sum(axis=0) == caps).all() and (m.sum(axis=1) == rows_).all() and (m >= 0).all()
    rng = np.random.default_rng(0)
    x = [sharding.hypergeometric(rng, 3 * 10**9, 10**9, 10**6) for _ in range(200)]
    assert abs(np.mean(x) - 750_000) < 200


def test_bpe(docs, rows, empty):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(tokenizer_path())
    texts = ["İSTANBUL ß ﬁ Ǆ 中文 x́ \x85a\xa0b", "it's we'll <|endoftext|>don't", "=" * 500 + "a1b2", "日本語" * 40]
    more = docs.sparkSession.createDataFrame([(1000 + i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    out = bpe.encode_documents(docs.select("doc_id", "text").union(more), tokenizer_path(), with_ids=True).collect()
    want = []
    for t in [*(r[1] for r in rows), *texts]:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        want.append((ids, lib.decode(ids, skip_special_tokens=False)))
    assert sorted((r["ids"], r["decoded"]) for r in out) == sorted(want)
    r = out[0]
    assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, r["ids"])).encode()).hexdigest() and r["n_tokens"] == len(r["ids"])
    assert bpe.encode_documents(empty, tokenizer_path()).count() == 0


def test_warc(spark, tmp_path):
    body = "<p>" + "w" * 120
    pages = [(5, "u", body), (2, "u2", body), (9, None, body), (1, "v", "short"), (3, "v", "short"), (4, "n", None), (None, "z", body)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    out = {r["page_id"]: r for r in warc.archive_round_trip(df).collect()}
    assert out[2]["record_type"] == "response" and out[5]["refers_to"] == 2 and out[9]["record_type"] == "revisit"
    assert out[1]["record_type"] == out[3]["record_type"] == "response" and out[4]["payload_bytes"] == 0
    assert out[9]["payload_digest"] == hashlib.sha256(body.encode()).hexdigest() and out[9]["payload_bytes"] == len(body)
    assert warc.archive_round_trip(df.limit(0)).count() == 0
    long = body * 30_000  # some MB in one record
    odd = spark.createDataFrame([(None, "a", body), (None, "b", body), (7, "a", long), (7, "b", long), (8, "a", long), (9, "c", "x" * 99), (10, "c", "x" * 99)], "page_id long, url string, html string").selectExpr("*", "url as digest", "1 as size", "'y' as record_type", "0 as copies", "true as turn", "'q' as first_id")
    got = sorted(((r["page_id"] or 0, r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.archive_round_trip(odd).collect()), key=str)
    assert got == sorted([(0, 123, "response", None)] * 2 + [(7, len(long), "response", None), (7, len(long), "revisit", 7), (8, len(long), "revisit", 7), (9, 99, "response", None), (10, 99, "response", None)], key=str)
    text_ids = spark.createDataFrame([("", "a", "1"), ("-", "a", "2"), (None, "a", "3")], "page_id string, url string, html string")
    assert sorted(str(r["page_id"]) for r in warc.archive_round_trip(text_ids).collect()) == ["", "-", "None"]
    made = warc.write_packages(df.where("page_id < 5"), f"file://{tmp_path}/z", always64=True)
    for r in made.collect():  # other readers agree
        with zipfile.ZipFile(r["package"].removeprefix("file://")) as z:
            assert z.testzip() is None and z.namelist() == [warc.DATA, warc.INDEX]
    assert {r["page"] for r in warc.read_records(warc.list_records(made), with_payload=True).collect()} == {"1", "2", "3", "4"}
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("a", b"12345")
    assert [m[0] for m in warc.directory(buffer, len(buffer.getvalue()))] == ["a"]


def test_substrings(docs, rows, empty):
    valid = [(i, (t or "").encode()) for i, t, *_ in rows]
    first = {}
    for i, t in valid:
        if i is not None:
            for k in range(len(t) - 49):
                first[t[k : k + 50]] = min(i, first.get(t[k : k + 50], i))
    want = []
    for i, t in valid:
        gone = np.zeros(len(t), dtype=bool)
        for k in range(len(t) - 49 if i is not None else 0):
            if first[t[k : k + 50]] < i:
                gone[k : k + 50] = True
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        want.append((str(i), len(t), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(t, np.uint8)[~gone].tobytes()).hexdigest()))
    out = substrings.remove_repeats(docs, chunk_bytes=4000, bucket_bytes=3000).collect()
    assert sorted((str(r["doc_id"]), *tuple(r)[1:]) for r in out) == sorted(want)
    assert sum(w[2] for w in want) > 3000 and substrings.remove_repeats(empty).count() == 0


def brute_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize(("threshold", "parts"), [(4, 3), (4, 2), (7, 4)])
def test_simhash(docs, rows, empty, threshold, parts):
    out = simhash.near_duplicates(docs, threshold=threshold, parts=parts).collect()
    prints = [(i, brute_print(t)) for i, t, *_ in rows]
    group = {i: i for i, _ in prints if i is not None}

    def top(i):
        while group[i] != i:
            i = group[i]
        return i

    for (a, x), (b, y) in itertools.combinations([p for p in prints if p[0] is not None], 2):
        if (x ^ y).bit_count() <= threshold:
            a, b = sorted((top(a), top(b)))
            group[b] = a
    want = sorted((str(i), f"{x:016x}", None if i is None else top(i)) for i, x in prints)
    assert sorted((str(r["doc_id"]), r["fingerprint"], r["component_id"]) for r in out) == want
    assert simhash.near_duplicates(empty).count() == 0


def jaccard(a, b):
    a, b = ({" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in ((t or "").split() for t in (a, b)))
    return len(a & b) / len(a | b)


def shown(a, b):
    """The similarity that the sketches of two texts show."""
    a, b = (int.from_bytes(simhash.sketch(simhash.shingle_hashes(t, 5))) for t in (a, b))
    return 1 - 2 * (a ^ b).bit_count() / simhash.SKETCH_BITS


def test_simhash_similarity(spark, docs, empty):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(3000)]
    texts, family = [], []
    for k in range(60):  # families: a text and three with a few words changed, clearly over 0.8; one clearly under
        base = [rng.choice(words) for _ in range(400)]
        for n_changed in (0, 3, 3, 3, 60):
            own = list(base)
            for at in rng.sample(range(400), n_changed):
                own[at] = rng.choice(words)
            texts.append(" ".join(own))
            family.append(k if n_changed < 60 else None)
    texts += ["a a a a a b c d e f", "a a a a a z y x w v", None, ""]  # equal or near fingerprints; empty texts are equal
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(df, threshold=13, parts=5, similarity=0.8).collect()}
    assert len(out) == len(texts) and out[302] == out[303] == 302 and out[300] != out[301]
    for i, k in enumerate(family):
        if k is None:
            assert out[i] == i and max(jaccard(texts[i], texts[j]) for j in range(len(texts)) if j != i) < 0.8
    joined = sum(out[i] == k * 5 for i, k in enumerate(family) if k is not None)
    assert joined >= 0.95 * 240
    for a, b in itertools.pairwise(rng.sample(range(300), 60)):
        assert abs(shown(texts[a], texts[b]) - jaccard(texts[a], texts[b])) < 0.15
    for a in range(0, 300, 5):
        assert abs(shown(texts[a], texts[a + 1]) - jaccard(texts[a], texts[a + 1])) < simhash.CLEARLY
    assert simhash.near_duplicates(docs, threshold=13, parts=5, similarity=0.8).count() == docs.count()
    assert simhash.near_duplicates(empty, threshold=13, parts=5, similarity=0.8).count() == 0


def test_simhash_similarity_by_brute_force(spark):
    """Families all about the limit: the groups are those of all pairs with a similarity of 0.8 or more."""
    rng, texts = random.Random(12), []
    for _ in range(50):
        base = [f"w{rng.randrange(10**6)}" for _ in range(300)]
        texts.append(" ".join(base))
        for _ in range(3):
            own = list(base)
            for at in rng.sample(range(300), rng.randint(4, 9)):  # 0.7 to 0.87 alike
                own[at] = "changed" + str(rng.randrange(10**6))
            texts.append(" ".join(own))
    texts += [" ".join(["again and again the line"] * n) for n in (3, 30, 300)]  # equal as sets of shingles
    near = [(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if jaccard(texts[i], texts[j]) >= 0.8]
    group = list(range(len(texts)))
    for i, j in near:
        group = [group[i] if g == group[j] else g for g in group] if group[i] < group[j] else [group[j] if g == group[i] else g for g in group]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(df, threshold=13, parts=5, similarity=0.8).collect()}
    assert 60 < len(near) < 290 and sum(out[i] == out[j] for i, j in near) >= 0.97 * len(near)
    apart = [(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if group[i] != group[j]]
    assert not any(out[i] == out[j] for i, j in apart)


def test_simhash_large_anchors(spark, docs, rows, monkeypatch):
    """Anchors counted as large give the same groups."""
    want = sorted((str(r["doc_id"]), r["component_id"]) for r in simhash.near_duplicates(docs, threshold=7, parts=4).collect())
    rng = np.random.default_rng(3)
    fp = rng.integers(0, 1 << 63, 40).astype(np.uint64).repeat(40)
    fp ^= np.uint64(1) << rng.integers(0, 63, len(fp)).astype(np.uint64)
    fp ^= np.uint64(1) << rng.integers(0, 63, len(fp)).astype(np.uint64)
    anchor, is_home = np.zeros(len(fp), dtype=np.int64), np.ones(len(fp), dtype=bool)
    groups = []
    for large in (simhash.LARGE, 1):
        monkeypatch.setattr(simhash, "LARGE", large)
        parent = np.arange(len(fp))
        for a, b, bits in simhash._compare(anchor, is_home, fp, np.arange(len(fp)), 4):
            assert (bits == -1).all()
            parent = simhash.forest(a, b, len(fp), parent)
        groups.append(parent.tolist())
    assert groups[0] == groups[1] and len(set(groups[0])) == 40 and want


def test_spanning_forest():
    """Open pairs: as cheap as by taking them in order of cost, whatever was joined before."""
    rng = np.random.default_rng(2)
    for _ in range(50):
        a, b, cost = rng.integers(0, 40, 200), rng.integers(0, 40, 200), rng.integers(0, 30, 200)
        joined = simhash.forest(rng.integers(0, 40, 8), rng.integers(0, 40, 8), 40)
        group, want = joined.tolist(), []
        pick = simhash._spanning(a, b, cost, joined)
        assert joined.tolist() == group
        for i in np.argsort(cost, kind="stable").tolist():
            x, y = group[a[i]], group[b[i]]
            if x != y:
                want.append(cost[i])
                group = [x if g == y else g for g in group]
        assert sorted(cost[pick].tolist()) == sorted(want)


def test_pairs_that_hide_behind_others(spark, monkeypatch):
    """B is like A2, not like A1; A1 and A2 are alike, and by their sketches B seems nearer to A1: all three are one group."""
    rng, texts = random.Random(5), []
    change = lambda words, n: [f"c{rng.randrange(10**9)}" if k in at else w for at in [set(rng.sample(range(len(words)), n))] for k, w in enumerate(words)]
    while len(texts) < 3 * 25:
        one = [f"w{rng.randrange(10**9)}" for _ in range(300)]
        two, three = change(one, rng.randint(1, 2)), change(one, rng.randint(6, 8))
        a, b, c = (" ".join(x) for x in (one, two, three))
        if jaccard(a, b) >= 0.9 and jaccard(a, c) >= 0.8 > jaccard(b, c) and shown(b, c) >= shown(a, c):
            texts += [b, a, c]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(simhash, "FORESTS", 2)
    out = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(df, threshold=13, parts=5, similarity=0.8).collect()}
    near = [i for i in range(0, 75, 3) if min((brute_print(texts[i]) ^ brute_print(texts[i + k])).bit_count() for k in (1, 2)) <= 13]
    assert sum(out[i + 2] == i for i in near) >= len(near) - 1


def test_open_pairs_in_rounds():
    """With groups, every open pair between them is given once, or forests of them and a mark; failed ones are not."""
    rng = np.random.default_rng(4)
    n = 60
    marks = rng.integers(0, 1 << 63, (n, 16), dtype=np.uint64)
    marks[:] = marks[0]
    for i in range(n):
        marks[i, rng.integers(0, 16)] ^= np.uint64(rng.integers(1, 1 << 62))
    anchor, fp, node, group = np.zeros(n, np.uint64), np.zeros(n, np.uint64), np.arange(n) * 7, np.arange(n) // 3
    bits = np.bitwise_count(marks[:, None] ^ marks[None]).sum(axis=2)
    failed = [(i, j) for i in range(n) for j in range(i) if (i + j) % 5 == 0]
    want = {(i, j) for i in range(n) for j in range(i) if group[i] != group[j] and bits[i, j] <= 60} - set(failed)
    both = np.array([p for i, j in failed for p in ((i * 7, j * 7), (j * 7, i * 7))] + [(1, 2)])
    for forests in (100, 2):
        simhash.FORESTS, before = forests, simhash.FORESTS
        found = list(simhash._compare(anchor, np.ones(n, bool), fp, node, 4, marks, -1, 60, 1, group, both))
        simhash.FORESTS = before
        pairs = {(a // 7, b // 7) for x, y, k in found for a, b, c in zip(x.tolist(), y.tolist(), k.tolist(), strict=True) if c >= 0}
        over = any((k == -2).any() for _, _, k in found)
        assert (pairs == want and not over) if forests == 100 else (pairs < want and over and len(pairs) <= 2 * (n // 3))


def test_groups_are_not_told_again():
    """With groups, a task tells no link inside one, however many members it has; a sure link of two groups once."""
    n = 400
    marks = np.zeros((n, 16), dtype=np.uint64)
    for k, group in enumerate((np.arange(n) // 200, np.arange(n) // 100)):  # all marks are alike: the four groups of 100 are joined by links
        marks[200:] = (1 << 64) - 1
        found = list(simhash._compare(np.zeros(n, np.uint64), np.ones(n, bool), np.zeros(n, np.uint64), np.arange(n) * 7, 4, marks, 20, 60, 1, group, np.zeros((0, 2), np.int64)))
        told = [(a // 7, b // 7) for x, y, _ in found for a, b in zip(x.tolist(), y.tolist(), strict=True)]
        assert len(told) == 2 * k
        assert all(a // 200 == b // 200 and group[a] != group[b] for a, b in told)


def test_pipeline_near_copies_far_apart(spark):
    """Copies clearly over the limit whose plain fingerprints are 12 or 13 bits apart are compared too."""
    import corpus_pipeline

    rng, texts = random.Random(8), []
    while len(texts) < 20:
        base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
        other = [*base[:-12], *(f"w{rng.randrange(10**6)}" for _ in range(rng.randint(1, 9)))]
        a, b = " ".join(base), " ".join(other)
        if jaccard(a, b) >= 0.8 and 12 <= (brute_print(a) ^ brute_print(b)).bit_count() <= 13:
            texts += [a, b]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, df, "").collect()) == list(range(0, 20, 2))


def test_anchors_cover():
    rng = np.random.default_rng(5)
    x = rng.integers(0, 1 << 22, 300).astype(np.uint64)
    for t in (1, 2):
        row, anchor = simhash.anchors(x, 22, t)
        have = set(zip(row.tolist(), anchor.tolist(), strict=True))
        for _ in range(20):
            y = x.copy()
            for _ in range(t):
                y ^= np.uint64(1) << rng.integers(0, 22, len(x)).astype(np.uint64)
            assert all((i, a) in have for i, a in enumerate(simhash.home(y).tolist()))


def test_reach():
    """However the differing bits fall, one piece has no more than its t of them; no t could be smaller."""
    rng = np.random.default_rng(1)
    for threshold, parts in ((13, 5), (4, 3), (7, 4), (2, 5), (9, 2)):
        reached = simhash.reach(threshold, parts)
        of_piece = lambda x: [int(x >> low & (1 << width) - 1).bit_count() for low, width, _ in reached]  # noqa: E731, B023
        for _ in range(300):
            x = sum(1 << int(b) for b in rng.choice(64, threshold, replace=False))
            assert any(n <= t for n, (_, _, t) in zip(of_piece(x), reached, strict=True))
        x = sum(((1 << t + 1) - 1) << low for low, _, t in reached)  # one bit more than t in each
        assert x.bit_count() == threshold + 1


def test_partners_by_brute_force(spark):
    """Rows with a partner near by either fingerprint, and of a size that allows the similarity: all, and no others."""
    rng = np.random.default_rng(6)
    flip = lambda x, n: x ^ sum(1 << int(b) for b in rng.choice(64, n, replace=False))
    rows = {(0, 0, 0)}
    for k in range(700):  # a row and one that is about as far as the limits allow; sizes on either side of 0.8
        fp, other, size = int(rng.integers(0, 1 << 63)), int(rng.integers(0, 1 << 63)), int(rng.integers(5, 2000))
        near, far = int(rng.integers(0, 17)), int(rng.integers(8, 26))
        again = (flip(fp, near), flip(other, far)) if k % 2 else (flip(fp, far), flip(other, near))
        rows |= {(fp, other, size), (*again, int(size * rng.uniform(0.7, 1.3)))}
    rows |= {(11 << 40, 5 << 50, 100), (11 << 40, 5 << 50, 125), (12 << 30, 3 << 20, 100), (12 << 30, 3 << 20, 126)}  # equal but for the size: 0.8, and less
    base = [int(x) for x in rng.integers(0, 1 << 63, 2)]
    rows |= {(flip(base[0], int(rng.integers(0, 5))), flip(base[1], int(rng.integers(0, 5))), int(rng.integers(90, 110))) for _ in range(900)}  # a cluster
    rows = sorted(rows)
    fp, other, size = (np.array(x, dtype=np.uint64) for x in zip(*rows, strict=True))
    one, two = (np.bitwise_count(x[:, None] ^ x) for x in (fp, other))
    met = ((one <= 13) & (two <= simhash.OTHER_BITS) | (two <= 13) & (one <= simhash.OTHER_BITS)) & (5 * np.minimum(size[:, None], size) >= 4 * np.maximum(size[:, None], size))
    np.fill_diagonal(met, False)
    want = {rows[i] for i in np.flatnonzero(met.any(axis=1))}
    df = spark.createDataFrame(pd.DataFrame({"fp": fp.view(np.int64), "other": other.view(np.int64), "size": size.astype(np.int64)})).repartition(3)
    out = [tuple(int(x) & (1 << 64) - 1 for x in r) for r in simhash.partners(df, 13, 5, 0.8).collect()]
    assert set(out) == want and 1200 < len(want) < len(rows) - 300
    assert len(out) < 4 * len(want)  # most are told at their home alone
    assert simhash.partners(df.limit(0), 13, 5, 0.8).count() == 0


def test_partners_work(monkeypatch):
    """Of the pairs that could meet, few are compared: at an anchor only those of like sizes, and no two that are known."""
    counted, count = [0], np.bitwise_count

    def counting(x):
        counted[0] += x.size
        return count(x)

    monkeypatch.setattr(simhash.np, "bitwise_count", counting)
    rng, n = np.random.default_rng(7), 6000
    reached = simhash.reach(13, 5)

    def told(piece, own, other, size):
        rows = np.empty(n, dtype=simhash.ROW)
        rows["own"], rows["other"], rows["size"] = own, other, size
        counted[0] = 0
        return simhash._told(0, 0, piece, reached, rows, 13, 0.8).sum()

    own, other = rng.integers(0, 1 << 63, (2, n)).astype(np.uint64)
    own &= ~np.uint64((1 << 25) - 1)  # all at home
    assert told(1, own, other, np.sort(np.exp(rng.uniform(2, 10, n)))) == 0 and counted[0] < 0.05 * n * n
    cluster = rng.integers(0, 8, n).astype(np.uint64) << np.uint64(30)
    for piece, want in ((0, n), (1, 0)):  # the first piece tells of the cluster, the others need not
        assert told(piece, cluster, cluster, np.sort(rng.integers(90, 110, n))) == want and counted[0] < 0.05 * n * n


def test_toxicity(spark, empty):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(900):
        bad = rng.random() < 0.3
        text = [rng.choice(words) for _ in range(30)]
        text[5:5] = [rng.choice(["vile", "awful"]) for _ in range(2)] if bad else []
        rows.append((i, " ".join(text)))
        labels.append((i, int(bad)))
    docs, lab = spark.createDataFrame([*rows, (None, None), (5000, "")], "doc_id long, text string"), spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, toxic int")
    out = {r["doc_id"]: r for r in toxicity.toxicity(docs, lab).collect()}
    held = [i for i, _ in labels if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(out[i]["held_out"] for i in held) and not out[None]["held_out"]
    assert np.mean([out[i]["predicted"] == y for i, y in labels if out[i]["held_out"]]) > 0.95
    assert 0 <= out[5000]["score"] < 0.5
    assert toxicity.toxicity(docs, lab.limit(0)).where("score > 1e-9").count() == 0
    assert toxicity.toxicity(empty, lab).count() == 0


def nearest(vecs, q, own, top=20):
    """Ids of the best by inner product in double precision, ties to the smaller id."""
    score = (vecs * vecs[q]).sum(axis=1)
    return [i for i in sorted(range(len(vecs)), key=lambda i: (-score[i], i)) if i != own][:top], score


def test_ann(spark):
    """Recall over several shards, each much larger than the beam; equal, repeated, null and unusable vectors."""
    rng = np.random.default_rng(4)
    v = rng.normal(size=(9000, 24)).round(3)
    v[50:90] = v[50]
    v[100] *= 1e6  # an outlier: the best for half of all queries, and no harm to the rest
    v[101] *= 1e-6
    data = [(i, [float(x) for x in row], 1, "x", 2.0) for i, row in enumerate(v)] + [(9900, None, 1, "x", 0.0), (9901, [0.0] * 24, 1, "x", 0.0), (9902, [float("nan")] * 24, 1, "x", 0.0), (9903, [None] * 24, 1, "x", 0.0), (None, [1.0] * 24, 1, "x", 0.0), (9904, [1.0] * 3, 1, "x", 0.0), (9905, [], 1, "x", 0.0)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, shard int, key string, score double")
    out = ann.search(df, df.where("vec_id % 100 = 0"), shard_rows=3000).collect()
    found = 0
    for q in range(0, 9000, 100):
        want, s = nearest(v, q, q)
        got = sorted((r["rank"], r["vec_id"], r["score"]) for r in out if r["query_id"] == q)
        assert [g[0] for g in got] == list(range(1, 21)) and all(abs(g[2] - s[g[1]]) <= 1e-12 * max(1, abs(s[g[1]])) for g in got)
        assert got == sorted(got, key=lambda g: (-g[2], g[1]))
        found += len({g[1] for g in got} & set(want))
    assert found / (20 * 90) >= 0.95 and {r["query_id"] for r in out} == set(range(0, 9000, 100))


def test_ann_small_tables(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0]), (3, [1.0, 1.0]), (None, [5.0, 5.0]), (4, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert ann.search(df.limit(0), df.limit(0)).count() == 0
    out = {q: [(r["vec_id"], r["score"]) for r in sorted(found, key=lambda r: r["rank"])] for q, found in itertools.groupby(sorted(ann.search(df, df.where("vec_id = 2")).collect(), key=lambda r: r["query_id"]), key=lambda r: r["query_id"])}
    assert out == {2: [(3, 2.0), (1, 1.0), (1, 1.0)]}  # equal ids are candidates each; another length is none
    own = ann.search(df, df.where("vec_id = 1")).collect()  # two vectors ask, neither gets its own id
    assert sorted((r["rank"], r["vec_id"], r["score"]) for r in own) == [(1, 2, 1.0), (1, 2, 1.0), (2, 3, 1.0), (2, 3, 1.0)]


def test_exact_dedup(docs, rows, empty):
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or "") for r in rows]
    out = exact_dedup.exact_dedup(docs, block_chars=16).collect()
    groups = {}
    for r, t in zip(rows, norm, strict=True):
        groups.setdefault(t, []).append(r[0])
    want = sorted((str(r[0]), str(min((i for i in groups[t] if i is not None), default=None)), len(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for r, t in zip(rows, norm, strict=True))
    assert sorted((str(r["doc_id"]), str(r["keep_id"]), r["group_size"], r["text_sha256"]) for r in out) == want
    assert sum(r["kept"] for r in out) == len(groups) and exact_dedup.exact_dedup(empty).count() == 0
    kept = exact_dedup.drop_exact_duplicates(docs)
    assert kept.count() == len(groups) and kept.columns == docs.columns


def test_passages(docs, empty):
    out = passages.fuzzy_passages(docs).collect()
    pairs = {(r["doc_id"], r["source_doc_id"]) for r in out}
    assert {(31, 30), (32, 30), (33, 30)} <= pairs and (21, 20) not in pairs
    assert passages.fuzzy_passages(empty).count() == 0
    assert passages.chain(np.array([0, 10, 20, 5]), np.array([0, 10, 20, 500])) == [[0, 1, 2]]


def test_passages_cut_by_older_documents(spark):
    """Every stretch of 47 words that a smaller document holds too is covered, by brute force over all of them."""
    rng = random.Random(9)
    fresh = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    texts, pairs = [], []
    for _ in range(12):  # two older documents hold a half each; an older one holds the middle
        n = rng.randint(25, 30)
        p = fresh(2 * n)
        at = len(texts)
        texts += [fresh(20) + part + fresh(20) for part in (p[:n], p[n:], p, p)]
        q = fresh(60)
        texts += [fresh(20) + part + fresh(20) for part in (q[7:52], q, q)]
        pairs += [(at + 3, at + 2, 2 * n), (at + 6, at + 5, 60)]
    pool = [fresh(rng.randint(15, 45)) for _ in range(25)]
    for _ in range(80):
        texts.append([w for _ in range(6) for w in (rng.choice(pool) if rng.random() < 0.7 else fresh(12))])
    # Two equal stretches with a gap between them are two passages, not one that is too unlike.
    x, y = fresh(50), fresh(50)
    texts += [x + fresh(40) + y, x + fresh(40) + y]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    out = passages.fuzzy_passages(df).collect()
    for doc, source, n in pairs:
        assert any(r["matched"] >= n for r in out if (r["doc_id"], r["source_doc_id"]) == (doc, source)), (doc, source)
    first, wanted = {}, 0
    for i, t in enumerate(texts):
        covered = [(r["start_word"], r["end_word"]) for r in out if r["doc_id"] == i]
        for k in range(len(t) - 46):
            if first.setdefault(tuple(t[k : k + 47]), i) < i:
                wanted += 1
                assert all(any(a <= j < b for a, b in covered) for j in range(k, k + 47)), (i, k)
    assert wanted > 500


def test_passages_owners():
    """First and previous holders of seeds, in whatever batches they come."""
    rng = np.random.default_rng(6)
    rows = sorted({(int(h), int(d), int(a)) for h, d, a in zip(rng.integers(0, 12, 600), rng.integers(0, 60, 600), rng.integers(0, 9, 600), strict=True)})
    want, heads = set(), set()
    for _, own in itertools.groupby(rows, key=lambda r: r[0]):
        own = list(own)
        docs = {}
        for r in own:
            docs.setdefault(r[1], r[2])  # the first place in each document
        order = sorted(docs)
        heads.add(own[0])
        for r in own:
            if r[1] != order[0]:
                want.add((r, order[0], docs[order[0]]))
                before = order[order.index(r[1]) - 1]
                if before != order[0] and r[2] % 2 == 0:
                    want.add((r, before, docs[before]))
    for _ in range(20):
        owners, found, met, followed = passages.Owners(), set(), set(), []
        cuts = sorted({0, len(rows), *rng.integers(0, len(rows), 15).tolist()})
        for a, b in itertools.pairwise(cuts):
            row, source, place, kind, first, doc, at = owners.take(*(np.array(x) for x in zip(*rows[a:b], strict=True)))
            followed += list(zip(doc.tolist(), at.tolist(), strict=True))
            assert set(kind.tolist()) <= {passages.OWNER, passages.BEFORE}
            found |= {(rows[a + i], int(s), int(p)) for i, s, p in zip(row.tolist(), source, place, strict=True)}
            met |= {rows[a + i] for i in first.tolist()}
        assert found == want and met == heads
        assert sorted(followed) == sorted({(r[0], s, p): (s, p) for r, s, p in want if s == min(d for h, d, _ in rows if h == r[0])}[h, s, p] for h, s, p in {(r[0], s, p) for r, s, p in want if s == min(d for h, d, _ in rows if h == r[0])})


def test_seed_pairs_of_many_documents():
    """Pairs of seeds of documents taken together are those of each alone, by plain loops."""
    rng = np.random.default_rng(8)
    doc = np.sort(rng.integers(0, 9, 500))
    x, source, y = rng.integers(0, 300, 500), rng.integers(0, 3, 500), rng.integers(0, 300, 500)
    want = []
    for d in range(9):
        own = sorted((x[i], i) for i in np.flatnonzero(doc == d))
        for (a, i), (b, j) in itertools.combinations(own, 2):
            if 0 < b - a <= passages.SPREAD and b - a < 64 and (source[i] != source[j] or abs(y[j] - y[i] - (b - a)) > passages.SHIFT):
                one, two = (passages._joined([source[[k]].astype(np.uint64), y[[k]].astype(np.uint64)]) for k in (i, j))
                h = passages._joined([one, two])
                if h[0] % np.uint64(passages.PAIRED) == 0 and own.index((b, j)) - own.index((a, i)) <= passages.SPREAD:
                    want.append((d, int(h.view(np.int64)[0]), int(a * 64 + b - a)))
    assert len(want) > 100 and sorted(zip(*(c.tolist() for c in passages.seed_pairs(doc, x, source, y)), strict=True)) == sorted(want)
    assert all(len(c) == 0 for c in passages.seed_pairs(*(c[:0] for c in (doc, x, source, y))))


def test_seeds_of_texts_taken_together():
    """Kept seeds of texts taken together are those of each alone, by plain loops over its windows."""
    rng = random.Random(4)
    texts = [" ".join(f"W{rng.randrange(10**6)}" for _ in range(n)) for n in [0, 1, 4, 5, 6, 10, 11, 12, 39, 40, 41, 46, 47, 48, 90, 300] * 3]
    ids = np.arange(len(texts)) * 7
    found = [set(zip(*(c.tolist() for c in part), strict=True)) for part in passages.seeds_of_texts(ids, texts)]
    want = set()
    for i, t in zip(ids.tolist(), texts, strict=True):
        words = [passages.word_hashes([w], 1) for w in t.encode().lower().split()]
        short = [passages._joined(words[a : a + passages.K]) for a in range(len(words) - passages.K + 1)]
        long = [passages._joined(short[a : a + passages.LONG : passages.K]) for a in range(len(words) - passages.LONG + 1)]
        for runs, window, mark in ((short, passages.WINDOW, 0), (long, passages.LONG_WINDOW, 1)):
            for a in range(max(1, len(runs) - window + 1) if runs else 0):
                b = min(range(a, min(a + window, len(runs))), key=lambda k: runs[k][0])  # noqa: B023
                want.add((int(runs[b].view(np.int64)[0]), i, b * 2 + mark))
    assert len(want) > 500 and set().union(*found) == want and sum(map(len, found)) == len(want)


def test_seeds_are_sent_in_few_long_rows():
    rng = np.random.default_rng(2)
    h, doc, at = rng.integers(-(2**63), 2**63, 50_000), rng.integers(0, 900, 50_000), rng.integers(0, 999, 50_000).astype(np.int32)
    cuts = [0, 10, 10, 30_000, 50_000]
    sent = list(passages.packed(((h[a:b], doc[a:b], at[a:b]) for a, b in itertools.pairwise(cuts)), passages.SEED, 20))
    assert sum(map(len, sent)) <= 20
    found = [list(zip(*(c.tolist() for c in part), strict=True)) for part in passages.unpacked(iter(sent), passages.SEED)]
    assert sorted(itertools.chain(*found)) == sorted(zip(h.tolist(), doc.tolist(), at.tolist(), strict=True))
    assert all(len({int(b) for b in passages.bucket_of(np.array([r[0] for r in part]), 20)}) == 1 for part in found)


class Counted(list):
    """Words, and how many were read one by one."""

    read = 0

    def __getitem__(self, i):
        self.read += not isinstance(i, slice)
        return super().__getitem__(i)


def test_extension_goes_over_equal_words_in_blocks():
    a = Counted(range(20_000))
    assert passages._extend(a, Counted(range(20_000))) == (20_000, 20_000, 20_000)
    assert a.read < 200
    rng = random.Random(6)

    def plain(a, b):
        i = j = equal = balance = peak = 0
        good = (0, 0, 0)
        while i < len(a) and j < len(b) and balance > peak - 6:
            if a[i] == b[j]:
                i, j, equal, balance = i + 1, j + 1, equal + 1, balance + 1
                if balance >= peak:
                    peak, good = balance, (i, j, equal)
            else:
                balance -= 2
                over, under = i + 1 < len(a) and a[i + 1] == b[j], j + 1 < len(b) and a[i] == b[j + 1]
                i, j = i + (over or not under), j + (not over)
        return good

    for _ in range(300):
        one = [rng.randrange(50) for _ in range(rng.choice([0, 20, 300, 2000]))]
        edits = rng.choice([0, 0.003, 0.03, 0.2])
        two = [x for w in one for x in ([w] if rng.random() >= edits else rng.choice([[], [w, w], [rng.randrange(50)]]))] + [7] * rng.randrange(20)
        assert passages._extend(one, two) == plain(one, two)


def fresh(rng, n):
    return [f"w{rng.randrange(10**9)}" for _ in range(n)]


def shared_passages(spark, texts):
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    return passages.fuzzy_passages(df).collect()


@pytest.mark.parametrize(("part", "every"), [(12, 12), (12, 9), (20, 10), (30, 12)])
def test_edited_copies_behind_older_parts(spark, part, every):
    """Older documents hold parts of a passage, one holds all of it, later ones the parts again, the last all of it edited."""
    rng = random.Random(part)
    texts, wanted = [], []
    for _ in range(6):
        p = fresh(rng, 200)
        cuts = list(range(0, 200, part // 2))
        parts = [p[a : a + part] for a in cuts]
        edited = [f"x{rng.randrange(10**9)}" if k % every == every - 1 else w for k, w in enumerate(p)]
        at = len(texts)
        texts += [fresh(rng, 20) + x + fresh(rng, 20) for x in [*parts, p, *parts, edited]]
        wanted.append((len(texts) - 1, at + len(parts), sum(a == b for a, b in zip(p, edited, strict=True))))
    out = shared_passages(spark, texts)
    for doc, source, n in wanted:
        assert sum(r["matched"] for r in out if (r["doc_id"], r["source_doc_id"]) == (doc, source)) >= 0.95 * n - every, (doc, source, n)


def test_edited_passages_by_alignment_of_all_pairs(spark):
    """Of all pairs of documents that share 60 to 150 words at 0.85 or more, by a plain alignment, 0.9 or more lie in passages told, of whatever source."""
    rng, texts, spans = random.Random(17), [], []
    for _ in range(40):
        base = fresh(rng, rng.randint(60, 150))
        for k in range(rng.randint(2, 5)):
            own, at = [], rng.randint(10, 60)
            for w in base:
                act = rng.random() if k else 1
                own += [] if act < 0.03 else [f"y{rng.randrange(10**9)}"] if act < 0.08 else [w, w] if act < 0.1 else [w]
            texts.append(fresh(rng, at) + own + fresh(rng, rng.randint(10, 60)))
            spans.append((base, at, at + len(own)))
    out = shared_passages(spark, texts)
    wanted = found = 0
    for i, (base, a, b) in enumerate(spans):
        if any(spans[j][0] is base and passages._common(texts[i][a:b], texts[j][spans[j][1] : spans[j][2]]) >= 0.85 * max(b - a, spans[j][2] - spans[j][1]) for j in range(i)):
            wanted += 1
            covered = {k for r in out if r["doc_id"] == i for k in range(r["start_word"], r["end_word"])}
            found += len(covered & set(range(a, b))) >= 0.9 * (b - a)
            assert len(covered - set(range(a, b))) <= 8
    assert wanted > 60 and found >= 0.9 * wanted, (found, wanted)


@pytest.mark.parametrize("common", [False, True])
def test_passages_owned_by_many(spark, monkeypatch, common):
    """Two documents share 400 words of which older ones hold parts, or the end."""
    if common:  # seeds met twice count as common, in a sample of all
        monkeypatch.setattr(passages, "SAMPLED", 1)
        monkeypatch.setattr(passages, "LEAST_MET", 2)
    rng = random.Random(3)
    p, q = fresh(rng, 400), fresh(rng, 1500)
    parts, at = [], 0
    while at < 400:
        n = rng.randint(16, 18)
        parts += [p[at : at + n]] * 3
        at += n
    texts = [fresh(rng, 20) + x + fresh(rng, 20) for x in [*parts, p, p, q[100:], q, q]]
    out, n = shared_passages(spark, texts), len(texts)
    assert max(r["matched"] for r in out if (r["doc_id"], r["source_doc_id"]) == (n - 4, n - 5)) == 400
    assert max(r["matched"] for r in out if (r["doc_id"], r["source_doc_id"]) == (n - 1, n - 2)) == 1500
    assert max(r["matched"] for r in out if (r["doc_id"], r["source_doc_id"]) == (n - 1, n - 3)) == 1400


def test_passages_with_edits(spark):
    """Passages with every sixth to tenth word changed, dropped or doubled are found, 0.9 of them at least."""
    rng, texts, pairs = random.Random(5), [], []
    for _ in range(200):
        base = fresh(rng, rng.randint(50, 120))
        other, k = list(base), rng.randint(6, 10)
        for i in range(len(base) - rng.randint(1, k), -1, -k):
            other[i : i + 1] = rng.choice([["changed"], ["changed"], [], [other[i]] * 2])
        pairs.append((len(texts) + 1, len(texts)))
        texts += [fresh(rng, 30) + x + fresh(rng, 30) for x in (base, other)]
    found = {(r["doc_id"], r["source_doc_id"]) for r in shared_passages(spark, texts)}
    assert found <= set(pairs) and len(found) >= 0.9 * len(pairs), len(found)


def test_passages_repeated_lines(spark):
    """Lines and words repeated in both texts give a passage or a few, not one for each pair of places."""
    rng = random.Random(7)
    line = fresh(rng, 9)
    texts = [fresh(rng, 30) + x + fresh(rng, 30) for x in (line * 40, line * 60, ["same"] * 300, ["same"] * 500, ["a", "b", "c"] * 90, ["a", "b", "c"] * 80)]
    out = shared_passages(spark, texts)
    assert {(r["doc_id"], r["source_doc_id"]) for r in out} == {(1, 0), (3, 2), (5, 4)} and len(out) <= 12


def plain_targets(sizes, weights=(3, 1, 2), share=1.5, most=2):
    """Words for each source, by sharing the excess again and again."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    full, left = {}, share * sum(sizes.values())
    while True:
        open_ = [s for s in order if s not in full]
        give = {s: (left - sum(full.values())) * weight[s] / sum(weight[x] for x in open_) for s in open_}
        above = [s for s in open_ if give[s] > most * sizes[s]]
        if not above:
            return full | give
        full |= {s: most * sizes[s] for s in above}


def plain_mix(rows, u, **options):
    """(copies, target) of each (source, size), by bisection for the scale and going through each source in order."""
    tilt = options.pop("tilt", mixing.TILT)
    sizes = {}
    for s, n in rows:
        sizes[s] = sizes.get(s, 0) + n
    aim, out = plain_targets(sizes, **options), [None] * len(rows)
    for s in sizes:
        own = [i for i, r in enumerate(rows) if r[0] == s]
        gain = {i: 2 ** (tilt * (rows[i][1].bit_length() - 1)) if rows[i][1] else 0 for i in own}
        lo, hi = 0.0, 4.0
        for _ in range(200):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if sum(min(2, mid * gain[i]) * rows[i][1] for i in own) < aim[s] else (lo, mid)
        copies = {i: 2.0 if aim[s] >= 2 * sizes[s] - 0.5 else min(2, hi * gain[i]) for i in own}
        whole = {i: int(copies[i] + 1e-9) for i in own}
        left = aim[s] - sum(whole[i] * rows[i][1] for i in own)
        p = {i: min(max(copies[i] - whole[i], 1e-9), 1 - 1e-9) for i in own}
        for i in sorted(own, key=lambda i: u[i] / (1 - u[i]) * (1 - p[i]) / p[i]):
            take = left >= 1 and 0 < rows[i][1] <= left and whole[i] < 2
            left -= rows[i][1] * take
            out[i] = (whole[i] + take if rows[i][1] else 0, aim[s])
    return out


def test_mixing(docs, rows, empty):
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    out = mixing.mix(docs).collect()
    sizes = {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + count(r[1])
    aim = plain_targets(sizes)
    assert len(out) == len(rows) and all(r["taken"] <= 2 * r["size"] for r in out)
    largest = max(r["size"] for r in out)
    for s, goal in aim.items():
        assert {(r["source_size"], round(r["target"], 6)) for r in out if r["source"] == s} == {(sizes[s], round(goal, 6))}
        assert goal <= 2 * sizes[s] + 1e-6 and abs(sum(r["taken"] for r in out if r["source"] == s) - goal) <= largest
    key = lambda o: sorted((str(r["doc_id"]), r["size"], r["taken"]) for r in o)
    assert key(out) == key(mixing.mix(docs).collect()) and mixing.mix(empty).count() == 0
    taken = mixing.take_mix(docs)
    assert taken.columns == docs.columns and sum(count(r["text"]) for r in taken.collect()) == sum(r["taken"] for r in out)
    odd = docs.withColumn("id_", F.lit(1)).withColumn("copies_", F.lit("x")).withColumn("words", F.lit(0))
    assert mixing.take_mix(odd).columns == odd.columns and mixing.take_mix(odd).count() == taken.count()


@pytest.mark.parametrize(("weights", "share", "at_once"), [((1,), 0.5, 1000), ((1,), 0.5, 7), ((3, 1, 2), 1.5, 20), ((1, 5), 1.0, 7)])
def test_mixing_by_brute_force(spark, monkeypatch, weights, share, at_once):
    """As plain Python takes them, whatever the bins: long documents are skipped, all later ones that fit are taken."""
    monkeypatch.setattr(mixing, "AT_ONCE", at_once)
    monkeypatch.setattr(mixing, "BINS", 8 if at_once < 1000 else 1024)
    rng = random.Random(6)
    sizes = [("a", 200)] * 50 + [("a", 20_000)] + [("b", rng.randint(1, 60)) for _ in range(1500)] + [("b", 15_000)] * 4
    sizes += [(None, rng.choice([3, 70, 900, 9000])) for _ in range(40)] + [(f"x{k % 9}", rng.choice([0, 5, 40, 2000])) for k in range(90)]
    sizes += [("\ue000", 50)] * 3 + [("\U00010000", 50)] * 3  # code point order is not that of UTF-16
    df = spark.createDataFrame([(i, "w " * n, s) for i, (s, n) in enumerate(sizes)], "doc_id long, text string, source string")
    out = {r["doc_id"]: r for r in mixing.mix(df, weights=weights, share=share).collect()}
    u = {r["doc_id"]: r["u"] for r in df.select("doc_id", mixing.uniform(20, F.col("doc_id"), F.crc32(F.encode("text", "UTF-8"))).alias("u")).collect()}
    want = plain_mix(sizes, [u[i] for i in range(len(sizes))], weights=weights, share=share)
    for i, (copies, target) in enumerate(want):
        assert out[i]["copies"] == copies and abs(out[i]["target"] - target) < 1e-6, (sizes[i], out[i], copies)


def test_mixing_inclusion(spark):
    """Over many sources that are alike, documents are in the sample as often as their inclusion odds say."""
    words, n = [64, 128, 256] * 60, 60
    df = spark.createDataFrame([(s * 1000 + k, "w " * w, f"s{s:03}") for s in range(n) for k, w in enumerate(words)], "doc_id long, text string, source string")
    out = mixing.mix(df, weights=(1,), share=0.5).groupBy("size").agg(F.avg("copies").alias("copies")).collect()
    gain = {w: 2 ** (mixing.TILT * (w.bit_length() - 1)) for w in set(words)}
    scale = 0.5 * sum(words) / sum(gain[w] * w for w in words)
    for r in out:
        assert abs(r["copies"] - scale * gain[r["size"]]) < 0.04, (r, scale * gain[r["size"]])


def plain_ftrl(rows, labels, epochs=5, alpha=3.0, beta=1.0, l1=3.0, l2=0.01):
    """FTRL-proximal as published, one coordinate at a time; place None is the intercept, which has no penalty."""
    z, n = {}, {}

    def weight(i):
        if i is None:
            return -z.get(i, 0.0) / ((beta + n.get(i, 0.0) ** 0.5) / alpha)
        return 0.0 if abs(z.get(i, 0.0)) <= l1 else -(z[i] - (l1 if z[i] > 0 else -l1)) / ((beta + n[i] ** 0.5) / alpha + l2)

    for _ in range(epochs):
        for x, y in zip(rows, labels, strict=True):
            own = [*x, None]
            w = {i: weight(i) for i in own}
            g = 1 / (1 + math.exp(-sum(w.values()))) - y
            for i in own:
                sigma = ((n.get(i, 0.0) + g * g) ** 0.5 - n.get(i, 0.0) ** 0.5) / alpha
                z[i], n[i] = z.get(i, 0.0) + g - sigma * w[i], n.get(i, 0.0) + g * g
    return {i: w for i in z if (w := weight(i))}


def test_ftrl_like_plain_python():
    rng = random.Random(3)
    rows = [np.array(sorted(rng.sample(range(400), 25)), dtype=np.uint32) for _ in range(300)]
    labels = [int(sum(x < 60) > 4) for x in rows]
    weights, bias = toxicity.fit_ftrl(rows, labels)
    want = plain_ftrl([x.tolist() for x in rows], labels)
    assert abs(bias - want.pop(None)) < 1e-9 and set(np.flatnonzero(weights).tolist()) == set(want) and 5 < len(want) < 400
    assert all(abs(weights[i] - w) < 1e-9 for i, w in want.items())


def test_features_over_spans(monkeypatch):
    """Features of a text longer than a span are those of the whole text."""
    rng = random.Random(5)
    for n in (0, 1, 2, 3, 9, 10, 11, 12, 50):
        text = " ".join(rng.choice("abcdefgh") for _ in range(n))
        monkeypatch.setattr(toxicity, "SPAN", 1 << 16)
        whole = toxicity.features(text)
        monkeypatch.setattr(toxicity, "SPAN", 10)
        assert toxicity.features(text).tolist() == whole.tolist() == sorted(set(whole.tolist()))


def test_toxicity_cases(spark):
    """Repeated rows and ids, ties, contradicting labels, columns of other names, a text beyond one span."""
    rng = random.Random(4)
    words = [f"w{i}" for i in range(50)]
    rows = [(i, " ".join(rng.choices(words, k=20)) + (" vile" if i % 3 == 0 else "")) for i in range(300)]
    long = " ".join(rng.choices(words, k=70_000))
    more = [rows[0], rows[0], (1000, rows[3][1]), (1001, rows[3][1]), (6, long), (1002, long), (1003, long + " vile"), (1004, None)]
    docs = spark.createDataFrame([(i, t, 1, 2, 0.5, 3) for i, t in [*rows, *more]], "doc_id long, text string, score int, y int, key double, __id int")
    labels = spark.createDataFrame([(i, int(i % 3 == 0), "q") for i in range(300)] + [(5, 1, "q"), (5, 0, "q"), (7, None, "q")], "doc_id long, toxic int, text string")
    out = toxicity.toxicity(docs, labels).collect()
    assert len(out) == 308 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in out)
    of = {i: {r["score"] for r in out if r["doc_id"] == i} for i in (0, 3, 1000, 1001)}
    assert len(of[0]) == 1 and of[3] == of[1000] == of[1001]
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r["predicted"] == 0 for r in out)


def test_very_long_texts(spark):
    """Texts of a megabyte and more, equal and nearly equal, through the operators that cut texts."""
    from tokenizers import Tokenizer

    rng = random.Random(8)
    long = " ".join(f"w{rng.randrange(10**5)}" for _ in range(160_000))
    other = long[:500_000] + "X" + long[500_001:]
    texts = [long, long, other, "é" * 300_000, "=" * 50_000 + long[:1000], "short"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r["doc_id"]: r for r in exact_dedup.exact_dedup(df).collect()}
    assert [out[i]["keep_id"] for i in range(6)] == [0, 0, 2, 3, 4, 5] and out[1]["group_size"] == 2
    found = {r["doc_id"]: r for r in substrings.remove_repeats(df).collect()}
    assert [found[i]["n_removed"] for i in range(6)] == [0, len(long), len(long) - 1, 0, 1000, 0] and found[2]["n_spans"] == 2
    groups = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(df, threshold=13, parts=5, similarity=0.8).collect()}
    assert [groups[i] for i in range(6)] == [0, 0, 0, 3, 4, 5]
    pairs = {(r["doc_id"], r["source_doc_id"], r["matched"]) for r in passages.fuzzy_passages(df).collect()}
    assert (1, 0, 160_000) in pairs and any(p[:2] == (2, 0) and p[2] > 159_990 for p in pairs)
    lib = Tokenizer.from_file(tokenizer_path())
    ids = {r["doc_id"]: r["ids_sha256"] for r in bpe.encode_documents(df.where("doc_id in (0, 3, 4)"), tokenizer_path()).collect()}
    for i in (0, 3, 4):
        assert ids[i] == hashlib.sha256(" ".join(map(str, lib.encode(texts[i], add_special_tokens=False).ids)).encode()).hexdigest()


def test_exact_dedup_by_any_key(spark, docs, rows):
    """Blocks that share a key, here their length, are told apart by their characters."""
    show = lambda df: sorted((str(r["doc_id"]), str(r["keep_id"]), r["group_size"], r["text_sha256"]) for r in df.collect())
    assert show(exact_dedup.exact_dedup(docs, block_chars=7, key=lambda b: F.length(b).cast("long"))) == show(exact_dedup.exact_dedup(docs))


def plain_groups(n, links):
    group = list(range(n))

    def top(i):
        while group[i] != i:
            i = group[i]
        return i

    for a, b in links:
        a, b = sorted((top(a), top(b)))
        group[b] = a
    return [top(i) for i in range(n)]


def test_pipeline_by_brute_force(spark, tmp_path):
    """run()'s rows against plain Python: the scores of its own model, equal texts, all pairs' similarity, the mixture in order, the library's tokens."""
    from tokenizers import Tokenizer

    import corpus_pipeline

    rng = random.Random(21)
    words = [f"w{i}" for i in range(900)]
    # Fingerprints tell little of very short texts: near copies have some words here.
    texts = [" ".join(rng.choices(words, k=rng.choice([8, 40, 120, 300][i < 30 :]))) for i in range(260)]
    toxic = [i % 5 == 0 for i in range(260)]
    texts = [t + " vile awful" if x else t for t, x in zip(texts, toxic, strict=True)]
    for i in range(200, 230):  # exact copies but for white space, near copies, some of those toxic
        texts[i] = texts[i - 200].replace(" ", "\n ", 3) if i % 2 else texts[i - 200] + " " + rng.choice(words)
        toxic[i] = toxic[i - 200]
    texts += [None, "", " ", texts[41]]
    sources = [None if i % 9 == 0 else f"s{i % 4}" for i in range(len(texts))]
    rows = [(i, t, "en", s, len(t or "")) for i, (t, s) in enumerate(zip(texts, sources, strict=True))]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    labels = spark.createDataFrame([(i, 0, int(x)) for i, x in enumerate(toxic) if i % 4], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    places, weights, bias = toxicity.fit(docs, labels)
    model = dict(zip(places.tolist(), weights.tolist(), strict=True))
    logit = [sum(model.get(p, 0.0) for p in toxicity.features(t or "").tolist()) + bias for t in texts]
    kept = [i for i, x in enumerate(logit) if 1 / (1 + math.exp(-x)) < 0.7]
    assert 0 < len(texts) - len(kept) < 100 and sum(toxic[i] for i in range(260) if i not in kept) > 0.9 * sum(toxic)
    first = {}
    kept = [i for i in kept if first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", texts[i] or ""), i) == i]
    near = [(a, b) for a, b in itertools.combinations(range(len(kept)), 2) if jaccard(texts[kept[a]], texts[kept[b]]) >= 0.8 or not (texts[kept[a]] or "").split() and not (texts[kept[b]] or "").split()]
    kept = [kept[i] for i, g in enumerate(plain_groups(len(kept), near)) if i == g]
    assert near
    count = lambda t: len((t or "").split())
    u = {r["doc_id"]: r["u"] for r in docs.select("doc_id", mixing.uniform(20, F.col("doc_id"), F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8"))).alias("u")).collect()}
    mixed = plain_mix([(sources[i], count(texts[i])) for i in kept], [u[i] for i in kept])
    lib = Tokenizer.from_file(tokenizer_path())
    want = []
    for i, (copies, _) in zip(kept, mixed, strict=True):
        ids = lib.encode(texts[i] or "", add_special_tokens=False).ids
        want += [(i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())] * copies
    assert sorted((r["doc_id"], r["n_tokens"], r["ids_sha256"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == sorted(want)


def test_pipeline(spark, docs, tmp_path):
    import corpus_pipeline

    docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    found = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, found, str(tmp_path))
        assert after.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        found = after
    assert 0 < corpus_pipeline.run(spark, str(tmp_path)).count() <= 2 * docs.count()
