"""Conversation repair against plain parsing, on small tables with nulls, ties, repeats, empty and long conversations."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from symloom.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string, digest int, part string, piece long"
NEXT = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}


def make_rows(seed=1, n=160):
    rng = random.Random(seed)
    roles = ["user", "assistant", "system", "tool", None, "", "umpire", "User"]
    out = []
    for conv in [None, *range(n)]:
        size = rng.choice([1, 2, 3, 5, 8, 8, 17, 40]) if conv != 5 else 300
        for turn in range(size):
            role = ("user", "assistant")[turn % 2] if rng.random() < 0.6 else rng.choice(roles)
            text = rng.choice(["Yes. ", "No!", "cut off", "", " \t\n", None, "é?", f"t{turn}.", f"t{turn}", "dot. "])
            out.append((conv, rng.choice([turn, turn, turn, turn + 3, None]) if conv and conv % 9 == 0 else turn, role, text, 1, "x", 2))
    return out + out[:7]


def damaged(rows):
    convs = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        own = convs[conv]
        show = lambda x: " " if x is None else str(x)
        role, text, kind = show(role), show(text), zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        own += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    for own in convs.values():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).digest()))
    return convs


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def cheapest(rows, marks):
    """(cost, audit, repaired rows), from the last row to the first: the best end from each state."""
    never, then = (10**9, "", ()), None
    for i in range(len(rows), -1, -1):
        own = {}
        for state in ("", "s", "u", "a"):
            found = [never]
            if i == len(rows):
                found += [(0, "", ())] * (state in ("", "a"))
            else:
                _, role, text = rows[i]
                cost, audit, kept = then[state]
                found.append((cost + 2, "D" + audit, kept))
                for edit, price, new in (("K", 0, role), ("R", 1, "user"), ("R", 1, "assistant")):
                    if marks[i] not in ("blank", "duplicate") and (to := NEXT.get((state, new[:1]))):
                        cost, audit, kept = then[to]
                        found.append((cost + price + 5 * (marks[i] == "truncated"), edit + audit, ((new, text), *kept)))
            own[state] = min(found)
        then = dict(own)
        for state, best in own.items():  # one or two inserted rows; more lead to a state again
            cost, letters, put = 0, "", ()
            to = state
            for _ in range(2):
                role = "assistant" if to == "u" else "user"
                to, cost, letters, put = role[0], cost + 5, letters + "I", (*put, (role, ""))
                best = min(best, (cost + own[to][0], letters + own[to][1], put + own[to][2]))
            then[state] = best
    return then[""]


def summary(own):
    marks = faults(own)
    turns = sorted({t for t, _, _ in own if t is not None})
    initials = [r[:1] for _, r, _ in own]
    cost, audit, kept = cheapest(own, marks)
    count = marks.count
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
    text = "\n".join(f"{r}:{t}" for r, t in kept)
    return (turns[-1] - turns[0] + 1 - len(turns) if turns else 0, count("blank"), count("duplicate"), count("truncated"), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())


NAMES = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


@pytest.mark.parametrize("partitions", [1, 23])
def test_summary_is_that_of_plain_parsing(spark, partitions):
    rows = make_rows()
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        found = repair.damaged_and_repaired(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    convs = damaged(rows)
    assert len(found) == len(convs) == len({r["conv_id"] for r in found})
    for r in found:
        assert tuple(r[k] for k in NAMES) == summary(convs[r["conv_id"]]), r["conv_id"]


def test_a_conversation_over_many_tasks(spark):
    rng = random.Random(3)
    rows = [(None, t, rng.choice(["user", "assistant", "system"]), rng.choice(["ok.", f"w{t}.", f"w{t}"]), 1, "x", 2) for t in range(900)]
    spark.conf.set("spark.sql.shuffle.partitions", 40)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        flags = repair._flags(repair._prepared(repair.damage(repair.columns_of(spark.createDataFrame(rows, SCHEMA)))))
        assert repair.parsed(flags).count() > 20
        found = repair.damaged_and_repaired(spark.createDataFrame(rows, SCHEMA)).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert [tuple(r[k] for k in NAMES) for r in found] == [summary(damaged(rows)[None])]


def test_any_split_gives_the_same_cells():
    rng = np.random.default_rng(5)
    for n in (1, 2, 15, 16, 17, 33, 40):
        kinds = rng.integers(0, repair.KINDS, n).astype(np.int8)
        spans = {(i, i + 1): repair.TERMINALS[k] for i, k in enumerate(kinds)}
        for length in range(2, n + 1):
            for i in range(n - length + 1):
                best = {}
                for k in range(i + 1, i + length):
                    cells = repair.times(spans[i, k], spans[k, i + length])
                    best = {key: min(x for x in (best.get(key), cells.get(key)) if x is not None) for key in best.keys() | cells.keys()}
                spans[i, i + length] = best
        assert repair.parse_many([kinds])[0] == spans[0, n]


def test_repaired_rows_read_as_they_should(spark):
    rows = make_rows(4, 60)
    found = repair.repaired_rows(repair.damage(repair.columns_of(spark.createDataFrame(rows, SCHEMA)))).collect()
    convs = damaged(rows)
    own = defaultdict(list)
    for r in sorted(found, key=lambda r: r["position"]):
        own[r["conv_id"]].append(r)
    for conv, before in convs.items():
        assert re.fullmatch("(s?(ua)+)?", "".join(r["role"][0] for r in own[conv]))
        assert [r["position"] for r in own[conv]] == list(range(len(own[conv])))
        text = "\n".join(f"{r['role']}:{r['text']}" for r in own[conv])
        assert hashlib.sha256(text.encode()).hexdigest() == summary(before)[-1]


def test_a_table_without_damage_or_rows(spark):
    good = spark.createDataFrame([(1, 0, "system", "Be kind."), (1, 1, "user", "Hello!"), (1, 2, "assistant", "Hello.")], "conv_id string, turn int, role string, text string")
    rows = repair.undamaged(repair.columns_of(good))
    assert [(r["audit"], r["cost"], r["gaps"]) for r in repair.repair_summary(rows).collect()] == [("KKK", 0, 0)]
    assert repair.damaged_and_repaired(good.limit(0)).collect() == []
    renamed = good.select(F.col("conv_id").alias("a.b"), F.col("turn").alias("t"), F.col("role").alias("r"), F.col("text").alias("x"))
    assert repair.damaged_and_repaired(renamed, "a.b", "t", "r", "x").count() == 1
