"""Conversation structure repair: weighted CYK interval parsing over a repair grammar in Chomsky normal form.

A conversation must read ``(s?(ua)+)?`` in its role initials. Edits: keep a row (0), rerole it to user or assistant (1),
delete it (2), insert an empty user or assistant row (5); a row whose text ends unfinished costs 5 more unless it is
deleted, blank and repeated rows must be deleted.

Grammar: the language's automaton has the states start, s, u, a. A nonterminal X(p, q) derives the spans that lead
from p to q. Rules: X(p, q) -> X(p, r) X(r, q) for every r; X(p, q) -> edit of one row. Insertions are the closure of
the empty span, put before each row and after the last. A span's cell for X(p, q) is the minimum of (cost, audit), the
audit being the edits' initials; cells are combined bottom-up by span length.

That minimum is exact although it is taken part by part: an audit that another one begins with has as many rows and
the same edits, so the longer one has more insertions and costs more. Audits of equal cost thus differ at some letter
within both, and what follows cannot turn their order.

Up to ``WIDTH`` rows, every span and every split is evaluated (audits are packed into 64 bits, and all conversations
of a batch parsed side by side). Longer spans are halved at such blocks: any split of a span gives the same cells,
since every state is a nonterminal's end, which a test holds against all splits. So a long conversation costs no more
a row than a short one, and one that lies in several tasks is parsed in each and put together from their cells.

Flow: flags of rows, without texts, are dealt to ranges of (conv_id, turn, role, text's digest), so that the rows of one
conversation, be it a third of all, are parsed by many tasks; equal rows come as one with a count. Then texts and
audits meet by conv_id, in order, and each conversation's digest streams over them: SHA-256 of a whole conversation
is sequential by nature, but no task holds more than a batch of rows and the audit.

Defined cases: null role and text are one space, so a null role is no known one and a null text is blank; rows with a
null conv_id are one conversation; rows of one turn are ordered by role, then by the digest of the text, so equal ones
stand together; a role counts by its first letter, an empty role by none, so it cannot be kept; an empty table gives
an empty result; other columns may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a block that is parsed with all its splits; two bits a letter, so audits of a block fit 64 bits.
WIDTH = 16
DELETE, INSERT, RESHAPE, RETRUNCATE = 2, 5, 1, 5
LETTERS = "DIKR"
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = 4
#: (state, initial) to state.
MOVES = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
LEGAL = ("su", "ua", "au")
ENDS = (START, ASSISTANT)
INITIALS = "sua"
#: A row as the grammar sees it: its initial's place in "sua" (3: another), 4 more if truncated; or to be deleted.
OTHER, FORCED = 3, 8
KINDS = 9
NEVER = 1 << 40

Cells = dict[tuple[int, int], tuple[int, str]]


def times(left: Cells, right: Cells) -> Cells:
    """X(p, q) -> X(p, r) X(r, q): the cells of two adjacent spans to those of both."""
    out: Cells = {}
    for (p, r), (cost, audit) in left.items():
        for q in range(STATES):
            if (other := right.get((r, q))) is not None:
                total = cost + other[0]
                have = out.get((p, q))
                if have is None or total < have[0] or (total == have[0] and audit + other[1] < have[1]):
                    out[p, q] = (total, audit + other[1])
    return out


def insertions() -> Cells:
    """The empty span's closure: the fewest inserted rows from each state to each."""
    cells: Cells = {(p, p): (0, "") for p in range(STATES)}
    one = {(p, q): (INSERT, "I") for (p, i), q in MOVES.items() if i in "ua"}
    for _ in range(STATES):
        for key, value in times(cells, one).items():
            cells[key] = min(cells.get(key, value), value)
    return cells


def edits(kind: int) -> Cells:
    """One row's edits, without insertions."""
    cells: Cells = {(p, p): (DELETE, "D") for p in range(STATES)}
    if kind != FORCED:
        extra, initial = RETRUNCATE * (kind >= 4), (*INITIALS, None)[kind % 4]
        for (p, i), q in MOVES.items():
            own = ([(extra, "K")] if i == initial else []) + ([(RESHAPE + extra, "R")] if i in "ua" else [])
            if own:
                cells[p, q] = min([*own, cells.get((p, q), own[0])])
    return cells


CLOSURE = insertions()
#: Cells of a span of one row, insertions before it included.
TERMINALS = [times(CLOSURE, edits(kind)) for kind in range(KINDS)]


def _packed(cells: Cells) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(costs, audits, lengths) by state pair; an audit's letters are two bits each, from the top of 64 bits."""
    cost, audit, size = (np.zeros((STATES, STATES), dtype=t) for t in (np.int64, np.uint64, np.uint64))
    cost[:] = NEVER
    for (p, q), (c, letters) in cells.items():
        cost[p, q], size[p, q] = c, len(letters)
        audit[p, q] = sum(LETTERS.index(x) << (62 - 2 * k) for k, x in enumerate(letters))
    return cost, audit, size


_PACKED = [np.stack(x) for x in zip(*map(_packed, TERMINALS), strict=True)]


def parse_blocks(kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cells (costs, audits, lengths; blocks x states x states) of blocks of equally many rows, at most ``WIDTH``.

    kinds: blocks x rows. Every span is made from all its splits, shorter spans first.
    """
    n = kinds.shape[1]
    spans = {(i, i + 1): tuple(x[kinds[:, i]] for x in _PACKED) for i in range(n)}
    for length in range(2, n + 1):
        for i in range(n - length + 1):
            best = None
            for k in range(i + 1, i + length):
                (lc, la, ls), (rc, ra, rs) = spans[i, k], spans[k, i + length]
                for r in range(STATES):
                    cost = lc[:, :, r, None] + rc[:, None, r, :]
                    size = ls[:, :, r, None] + rs[:, None, r, :]
                    audit = la[:, :, r, None] | ra[:, None, r, :] >> (ls[:, :, r, None] * np.uint64(2))
                    if best is None:
                        best = [cost, audit, size]
                    else:
                        better = (cost < best[0]) | (cost == best[0]) & (audit < best[1])
                        for old, new in zip(best, (cost, audit, size), strict=True):
                            np.copyto(old, new, where=better)
            spans[i, i + length] = tuple(best)
    return spans[0, n]


def unpacked(cost: np.ndarray, audit: np.ndarray, size: np.ndarray) -> Cells:
    return {(p, q): (int(cost[p, q]), "".join(LETTERS[int(audit[p, q]) >> (62 - 2 * k) & 3] for k in range(int(size[p, q])))) for p in range(STATES) for q in range(STATES) if cost[p, q] < NEVER}


def together(spans: list[Cells]) -> Cells:
    """Adjacent spans to one, pairs of spans first, then pairs of pairs."""
    while len(spans) > 1:
        spans = [times(*spans[i : i + 2]) if i + 1 < len(spans) else spans[i] for i in range(0, len(spans), 2)]
    return spans[0]


def best_parse(cells: Cells) -> tuple[int, str]:
    """(cost, audit) of a whole conversation, rows inserted at its end included."""
    whole = times({k: v for k, v in cells.items() if k[0] == START}, CLOSURE)
    return min(whole[START, q] for q in ENDS if (START, q) in whole)


def parse_many(rows: list[np.ndarray]) -> list[Cells]:
    """Cells of each sequence of kinds (none of them empty); blocks of one length are parsed side by side."""
    blocks = [x[i : i + WIDTH] for x in rows for i in range(0, len(x), WIDTH)]
    lengths = np.array([len(b) for b in blocks])
    found: list[Cells | None] = [None] * len(blocks)
    for n in np.unique(lengths):
        own = np.flatnonzero(lengths == n)
        distinct, back = np.unique(np.stack([blocks[i] for i in own]), axis=0, return_inverse=True)
        cells = [unpacked(*x) for x in zip(*parse_blocks(distinct), strict=True)]
        for i, k in zip(own, back.ravel(), strict=True):
            found[i] = cells[k]
    out, at = [], 0
    for x in rows:
        n = -(-len(x) // WIDTH)
        out.append(together(found[at : at + n]))
        at += n
    return out


@dataclass
class Piece:
    """What is known of a stretch of one conversation's rows, enough to put stretches together."""

    kinds: list[np.ndarray] = field(default_factory=list)
    blank: int = 0
    duplicate: int = 0
    truncated: int = 0
    illegal: int = 0
    first: str | None = None
    last: str | None = None
    turns: int = 0
    low: int | None = None
    high: int | None = None
    cells: Cells | None = None

    def add(self, turn: int | None, initial: str, blank: bool, truncated: bool, n: int, is_first: bool) -> None:
        """n equal rows; is_first: no earlier row of the conversation has their role and text."""
        if self.last is not None:
            self.illegal += self.last + initial not in LEGAL
        self.illegal += n - 1  # no initial may follow itself
        self.first, self.last = initial if self.first is None else self.first, initial
        if turn is not None and turn != self.high:
            self.turns, self.low, self.high = self.turns + 1, turn if self.low is None else self.low, turn
        good = is_first and not blank
        self.blank += n * blank
        self.duplicate += 0 if blank else n - good
        self.truncated += good and truncated
        kinds = np.full(n, FORCED, dtype=np.int8)
        if good:
            kinds[0] = (INITIALS.find(initial) % 4 if initial else OTHER) + 4 * truncated
        self.kinds.append(kinds)

    def then(self, other: Piece) -> Piece:
        """This stretch and the one after it."""
        illegal = self.illegal + other.illegal + (self.last + other.first not in LEGAL)
        turns = self.turns + other.turns - (self.high is not None and self.high == other.low)
        low, high = (self.low if self.low is not None else other.low), (other.high if other.high is not None else self.high)
        return Piece([], self.blank + other.blank, self.duplicate + other.duplicate, self.truncated + other.truncated, illegal, self.first, other.last, turns, low, high, None)

    @property
    def gaps(self) -> int:
        return 0 if self.low is None else self.high - self.low + 1 - self.turns


def damage(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) with planted faults, by crc32 of ``conv_id:turn`` modulo 20; ``dropped`` marks what fell out.

    0 drops a row, 1 empties its text, 2 removes its full stops, 3 doubles it, 4 makes it a user's.
    """
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(shown("text"), "[.!?]", "")).otherwise(shown("text"))
    role = F.when(kind == 4, "user").otherwise(shown("role"))
    rows = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (kind == 0).alias("dropped"), F.explode(F.array_repeat(F.lit(0), F.when(kind == 3, 2).otherwise(1))).alias("copy"))
    gone = lambda c: F.when(~F.col("dropped"), F.col(c)).alias(c)
    return rows.select("conv_id", "turn", gone("role"), gone("text"), "dropped")


def _flags(rows: DataFrame) -> DataFrame:
    """Distinct rows of each conversation without their texts: conv_id, turn, role, digest, blank, truncated, n, is_first."""
    blanks = F.lit(" \t\n\x0b\x0c\r")
    trimmed = F.rtrim(F.col("text"), blanks)
    last = F.right(trimmed, F.lit(1))
    own = rows.where(~F.col("dropped")).select("conv_id", "turn", "role", F.col("digest"), (trimmed == "").alias("blank"), (~last.isin(".", "!", "?")).alias("truncated"))
    each = own.groupBy("conv_id", "turn", "role", "digest").agg(F.count(F.lit(1)).alias("n"), F.first("blank").alias("blank"), F.first("truncated").alias("truncated"))
    # Where a role and text come in several turns, only the first of these has no earlier copy.
    again = own.groupBy("conv_id", "role", "digest").agg(F.min(F.struct(F.col("turn").isNotNull(), "turn")).alias("first"), F.max(F.struct(F.col("turn").isNotNull(), "turn")).alias("last"))
    again = again.where("first <> last").select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), F.col("first.turn").alias("first_turn"))
    met = each.join(again, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d")), "left")
    return met.select("conv_id", "turn", "role", "digest", "blank", "truncated", "n", (F.col("d").isNull() | F.col("turn").eqNullSafe(F.col("first_turn"))).alias("is_first"))


_PIECE = "piece struct<blank: long, duplicate: long, truncated: long, illegal: long, first: string, last: string, turns: long, low: long, high: long, cells: array<struct<p: int, q: int, cost: long, audit: string>>>"


def parsed(flags: DataFrame) -> DataFrame:
    """(conv_id, part, piece): the stretch of each conversation in each range of rows, with its cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()

        def rows_of(done: list[tuple[object, Piece]]) -> pa.RecordBatch:
            cells = parse_many([np.concatenate(p.kinds) for _, p in done])
            out = []
            for (conv, p), own in zip(done, cells, strict=True):
                shown = [{"p": a, "q": b, "cost": c, "audit": x} for (a, b), (c, x) in own.items()]
                out.append({"conv_id": conv, "part": part, "piece": {"blank": p.blank, "duplicate": p.duplicate, "truncated": p.truncated, "illegal": p.illegal, "first": p.first, "last": p.last, "turns": p.turns, "low": p.low, "high": p.high, "cells": shown}})
            return pa.RecordBatch.from_pylist(out, schema=arrow)

        conv, piece, done = None, None, []
        for batch in batches:
            arrow = pa.schema([("conv_id", batch.schema.field(0).type), ("part", pa.int32()), ("piece", piece_type)])
            for c, turn, role, blank, truncated, n, is_first in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if piece is None or c != conv:
                    if piece is not None:
                        done.append((conv, piece))
                    conv, piece = c, Piece()
                piece.add(turn, role[:1], blank, truncated, n, is_first)
            if len(done) >= 1000:
                yield rows_of(done)
                done = []
        if piece is not None:
            yield rows_of([*done, (conv, piece)])

    cell = pa.struct([("p", pa.int32()), ("q", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])
    piece_type = pa.struct([*((k, pa.int64()) for k in ("blank", "duplicate", "truncated", "illegal")), ("first", pa.string()), ("last", pa.string()), *((k, pa.int64()) for k in ("turns", "low", "high")), ("cells", pa.list_(cell))])
    order = ("conv_id", "turn", "role", "digest")
    kind = flags.schema["conv_id"].dataType.simpleString()
    rows = flags.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "turn", "role", "blank", "truncated", "n", "is_first")
    return rows.mapInArrow(run, f"conv_id {kind}, part int, {_PIECE}")


def _joined(pieces: list[dict]) -> tuple[Piece, int, str]:
    """A conversation from its stretches: counts, cost and audit."""
    whole, cells = None, []
    for x in pieces:
        cells.append({(c["p"], c["q"]): (c["cost"], c["audit"]) for c in x["cells"]})
        own = Piece(**{k: v for k, v in x.items() if k != "cells"})
        whole = own if whole is None else whole.then(own)
    return (Piece(), 0, "") if whole is None else (whole, *best_parse(together(cells)))


def _streamed(rows: DataFrame, pieces: DataFrame) -> DataFrame:
    """Each conversation's stretches, then its rows in order, in one task: (conv_id, part, role, text, piece), part null for rows."""
    piece_type = pieces.schema["piece"].dataType.simpleString()
    heads = pieces.select("conv_id", "part", F.lit(None).cast("long").alias("turn"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("binary").alias("digest"), "piece")
    # What was dropped still names its conversation.
    own = rows.select("conv_id", F.lit(None).cast("int").alias("part"), "turn", "role", "text", "digest", F.lit(None).cast(piece_type).alias("piece"))
    both = heads.unionByName(own)
    order = (F.col("part").asc_nulls_last(), "turn", "role", "digest")
    return both.repartition("conv_id").sortWithinPartitions("conv_id", *order).select("conv_id", "part", "turn", "role", "text", "piece")


class Rewriter:
    """A conversation's rows as its audit leaves them, one after another."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, START

    def _to(self, initial: str) -> None:
        self.state = MOVES[self.state, initial]

    def inserted(self) -> Iterator[tuple[str, str, str]]:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.at += 1
            role = "assistant" if self.state == USER else "user"
            self._to(role[0])
            yield role, "", "insert"

    def take(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        yield from self.inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self._to(role[:1])
            yield role, text, "keep"
        elif edit == "R":
            role = "assistant" if self.state == USER else "user"
            self._to(role[0])
            yield role, text, "rerole"


def _prepared(rows: DataFrame) -> DataFrame:
    return rows.withColumn("digest", F.unhex(F.sha2("text", 256)))


def columns_of(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    c = lambda name: F.col(f"`{name}`")
    return rows.select(c(conv_col).alias("conv_id"), c(turn_col).cast("long").alias("turn"), c(role_col).cast("string").alias("role"), c(text_col).cast("string").alias("text"))


def undamaged(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as they are, ready for repair."""
    blank = lambda c: F.coalesce(c, F.lit(" ")).alias(c)
    return rows.select("conv_id", "turn", blank("role"), blank("text"), F.lit(False).alias("dropped"))


def repair_summary(rows: DataFrame) -> DataFrame:
    """A row for each conv_id of prepared rows (:func:`damage`, :func:`undamaged`): gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    rows = _prepared(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, pieces, found, out, rewriter, digest, begun = None, [], None, [], None, None, False

        def put(rows) -> None:
            nonlocal begun
            for role, text, _ in rows:
                digest.update((("\n" if begun else "") + role + ":" + text).encode())
                begun = True

        def finish() -> None:
            put(rewriter.inserted())
            p, cost, audit = found
            out.append({"conv_id": conv, "gaps": p.gaps, "blank": p.blank, "duplicate": p.duplicate, "truncated": p.truncated, "illegal": p.illegal, "cost": cost, "audit": audit, "repaired_sha256": digest.hexdigest()})

        for batch in batches:
            schema = pa.schema([("conv_id", batch.schema.field(0).type), *((k, pa.int64()) for k in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string()), ("repaired_sha256", pa.string())])
            heads = {i: x for i, x in enumerate(batch.column(5).to_pylist()) if x is not None}
            for i, (c, role, text) in enumerate(zip(*(batch.column(k).to_pylist() for k in (0, 3, 4)), strict=True)):
                if (rewriter is None and not pieces) or c != conv:
                    if rewriter is not None:
                        finish()
                    conv, pieces, rewriter, digest, begun = c, [], None, hashlib.sha256(), False
                if i in heads:
                    pieces.append(heads[i])
                    continue
                if rewriter is None:
                    found = _joined(pieces)
                    rewriter, pieces = Rewriter(found[2]), []
                if role is not None:
                    put(rewriter.take(role, text))
            if len(out) >= 1000:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
                out = []
        if rewriter is not None:
            finish()
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    kind = rows.schema["conv_id"].dataType.simpleString()
    counts = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long"
    return _streamed(rows, parsed(_flags(rows))).mapInArrow(run, f"conv_id {kind}, {counts}, audit string, repaired_sha256 string")


def repaired_rows(rows: DataFrame) -> DataFrame:
    """The repaired conversations themselves: conv_id, position (from 0), turn (null if inserted), role, text, edit."""
    rows = _prepared(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, pieces, rewriter, position, out = None, [], None, 0, []

        def put(rows, turn) -> None:
            nonlocal position
            for role, text, edit in rows:
                out.append({"conv_id": conv, "position": position, "turn": None if edit == "insert" else turn, "role": role, "text": text, "edit": edit})
                position += 1

        for batch in batches:
            schema = pa.schema([("conv_id", batch.schema.field(0).type), ("position", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("edit", pa.string())])
            for c, _, turn, role, text, head in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if (rewriter is None and not pieces) or c != conv:
                    if rewriter is not None:
                        put(rewriter.inserted(), None)
                    conv, pieces, rewriter, position = c, [], None, 0
                if head is not None:
                    pieces.append(head)
                    continue
                if rewriter is None:
                    rewriter, pieces = Rewriter(_joined(pieces)[2]), []
                if role is not None:
                    put(rewriter.take(role, text), turn)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
                out = []
        if rewriter is not None:
            put(rewriter.inserted(), None)
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    kind = rows.schema["conv_id"].dataType.simpleString()
    return _streamed(rows, parsed(_flags(rows))).mapInArrow(run, f"conv_id {kind}, position long, turn long, role string, text string, edit string")


def damaged_and_repaired(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The summary of conversations after the planted damage."""
    return repair_summary(damage(columns_of(rows, conv_col, turn_col, role_col, text_col)))

