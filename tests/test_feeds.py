"""Change feeds: keyed timers on a stream against the same rule in plain Python, and listings of a tree."""

import datetime
import json
import random
import uuid

import pytest
from pyspark.sql import functions as F

from symloom.sources import listing
from symloom.sources.projects import read_project
from symloom.streaming import timers

START = datetime.datetime(2024, 1, 1)
GAP = 300_000  # microseconds


def plain(events):
    """Bursts of each path by the rule, from (path, microseconds, op)."""
    out = []
    for path in {p for p, _, _ in events}:
        own, fired = sorted({(t, op in timers.AT_ONCE, op) for p, t, op in events if p == path}), set()
        last = None
        for t, request, op in own:
            if last and t - last[0] > GAP:
                out.append((path, last[0] + GAP, "quiet", last[1]))
                last = None
            if not request:
                last = (t, op)
            elif t not in fired:
                fired.add(t)
                out.append((path, t, op, last and last[1]))
                last = None
        if last:
            out.append((path, last[0] + GAP, "quiet", last[1]))
    return sorted(out, key=str)


def shown(rows):
    epoch = datetime.datetime(1970, 1, 1)
    micros = lambda t: round((t - epoch).total_seconds() * 1_000_000) - round((START - epoch).total_seconds() * 1_000_000)
    return sorted([(r["path"], micros(r["fire_ts"]), r["reason"], r["op"]) for r in rows], key=str)


def at(t):
    return START + datetime.timedelta(microseconds=t)


def test_batch_rule(spark):
    rng = random.Random(1)
    events = [(f"/f{rng.randrange(4)}", rng.randrange(60) * 100_000, rng.choice(["change", "change", "add", "flush", "unlink"])) for _ in range(150)]
    feed = spark.createDataFrame([(p, at(t), op) for p, t, op in events] + [(None, at(0), "change"), ("/x", None, "change"), ("/x", at(0), None)], "path string, ts timestamp, op string")
    assert shown(timers.debounce_flush(feed, "path", "ts", "op", 0.3).collect()) == plain(events)


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset(key)


def run_stream(spark, tmp_path, batches):
    """Rows that each micro-batch of a stream over (path, microseconds, op) gives."""
    source, found, name = tmp_path / "in", [], f"fired_{uuid.uuid4().hex[:8]}"
    source.mkdir()
    feed = spark.readStream.schema("path string, ts timestamp, op string").json(str(source))
    query = timers.debounced_flush_stream(feed, 0.3, "1 second").writeStream.foreachBatch(lambda df, n: found.append(shown(df.collect()))).option("checkpointLocation", str(tmp_path / "checkpoint")).queryName(name).start()
    try:
        for k, events in enumerate(batches):
            lines = "".join(json.dumps({"path": p, "ts": at(t).isoformat() + "Z", "op": op}) + "\n" for p, t, op in events)
            (tmp_path / f"{k}.json").write_text(lines)
            (tmp_path / f"{k}.json").rename(source / f"{k}.json")
            query.processAllAvailable()
    finally:
        query.stop()
    return found


END = [("/end", 60_000_000, "flush")]  # moves the watermark past all timers


def test_a_flush_fires_at_once_and_cancels_the_timer(spark, tmp_path, rocks):
    first = [("/a", 0, "add"), ("/b", 0, "change"), ("/a", 100_000, "change")]
    found = run_stream(spark, tmp_path, [first, [("/a", 200_000, "flush")], [("/a", 150_000, "change"), ("/a", 200_000, "flush")], END, []])
    at_flush = next(rows for rows in found if rows)
    assert at_flush == [("/a", 200_000, "flush", "change")]  # /b still waits
    every = sorted([r for rows in found for r in rows], key=str)
    # What came late and what came twice fires nothing; /a's timer is gone.
    assert every == [("/a", 200_000, "flush", "change"), ("/b", GAP, "quiet", "change"), ("/end", 60_000_000, "flush", None)]


def test_stream_equals_batch(spark, tmp_path, rocks):
    rng = random.Random(3)
    events = sorted([(f"/f{rng.randrange(3)}", rng.randrange(80) * 50_000, rng.choice(["change", "change", "change", "flush"])) for _ in range(60)], key=lambda e: e[1])
    # Changes may come up to half a second late, within the watermark; no request overtakes a change of its path.
    moved = sorted(events, key=lambda e: e[1] + (rng.randrange(400_000) if e[2] == "change" else 400_000))
    batches = [moved[i : i + 9] for i in range(0, len(moved), 9)]
    kept, seen = [], {}
    for p, t, op in moved:
        if op == "flush" or t > seen.get(p, -1):
            kept.append((p, t, op))
        if op == "flush":
            seen[p] = max(t, seen.get(p, -1))
    found = run_stream(spark, tmp_path, [*batches, END, []])
    assert sorted([r for rows in found for r in rows if r[0] != "/end"], key=str) == plain(kept)


def test_listings_of_a_tree(spark, tmp_path):
    root = tmp_path / "tree"
    (root / "src").mkdir(parents=True)
    (root / "node_modules").mkdir()
    write = lambda name, text: (root / name).write_text(text)
    write("src/a.ts", "one"), write("src/b.tsx", "two"), write("src/c.js", "no"), write("node_modules/d.ts", "no")
    state = listing.ListingState(spark, str(tmp_path / "listings"))
    now = lambda: read_project(spark, str(root)).withColumn("path", F.regexp_extract("path", "/tree/(.*)$", 1))
    shown = lambda df: sorted((r["path"], r["op"]) for r in df.collect())
    assert state.take(now()) == 1
    assert shown(state.between(0, 1)) == [("src/a.ts", "add"), ("src/b.tsx", "add")]
    write("src/a.ts", "three"), (root / "src/b.tsx").unlink(), write("src/e f.ts", "")
    assert state.take(now()) == 2
    want = [("src/a.ts", "change"), ("src/b.tsx", "unlink"), ("src/e f.ts", "add")]
    assert shown(state.between(1, 2)) == shown(state.between(1, 2)) == want
    assert state.take(now()) == 3 and shown(state.between(2, 3)) == []
    assert shown(state.between(1, 3)) == want and shown(state.between(2, 0)) == [("src/a.ts", "unlink"), ("src/e f.ts", "unlink")]
    # A listing that failed is no version.
    (tmp_path / "listings" / "000004").mkdir()
    assert listing.ListingState(spark, str(tmp_path / "listings")).versions() == [1, 2, 3]
