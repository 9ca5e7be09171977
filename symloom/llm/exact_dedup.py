"""Exact duplicates by deterministic block naming (DataFrame functions only).

Each text is cut into blocks of a fixed number of characters. Sorting the distinct blocks, dealt by hash, gives every
block an integer name; then adjacent names are paired, and sorting the distinct pairs names them in turn, until each
text has one name. Two texts have one name if and only if they are equal. Every row is named.

Blocks find their names by a 64-bit hash, so that texts are shuffled once and only as distinct blocks. Where two
different blocks have one hash, which is counted, the blocks of that hash are named and joined by their characters
instead: no hash decides.

Defined cases: a null text is empty and equals other empty ones; of equal texts the smallest id stays, null ids come
last, and of rows that also share the id exactly one stays; an empty table gives an empty result; other columns may
have any name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symloom.llm.common import SPACES, free_names, materialise, text_or_empty

#: Characters in a block. Longer blocks mean fewer naming rounds and larger sort keys.
BLOCK_CHARS = 4096
#: Stands for the second name of an odd block out: no block or pair has it.
NO_NAME = -(1 << 62)


def normalised(column: str) -> Column:
    return F.regexp_replace(text_or_empty(F.col(f"`{column}`")), SPACES, " ")


def cut_blocks(text: str, block_chars: int = BLOCK_CHARS) -> Column:
    """The text's blocks in order, in one pass over it; an empty text is one empty block."""
    return F.regexp_extract_all(text, F.lit(f"(?s)^$|.{{1,{block_chars}}}"), F.lit(0))


def _named(keys: DataFrame, columns: list[str], keep: list[str], label: str) -> DataFrame:
    """Distinct keys, sorted in each partition of their hash, with an integer name each; written, so that names stay.

    The partition is part of the name, so no order across partitions, and no sample of keys at the driver, is needed.
    """
    distinct = keys.select(*columns).distinct().sortWithinPartitions(*columns)
    return materialise(distinct.withColumn("name", F.monotonically_increasing_id()).select(*keep, "name"), label)


def _first_names(rows: DataFrame, block_chars: int, key: Callable[[Column], Column]) -> DataFrame:
    """(uid, text, keys: the hashes of the text's blocks) to (uid, n, pos, name) of every block."""
    blocks = rows.select("uid", F.size("keys").alias("n"), F.posexplode("keys").alias("pos", "h"))
    cut = rows.select(F.explode(cut_blocks("text", block_chars)).alias("block")).select(key(F.col("block")).alias("h"), "block")
    names = _named(cut, ["h", "block"], ["h"], "block-names")
    shared = materialise(names.groupBy("h").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("h"), "shared-hashes")
    if shared.isEmpty():
        return blocks.join(names, "h").select("uid", "n", "pos", "name")
    several = rows.select("uid", F.size("keys").alias("n"), F.posexplode(cut_blocks("text", block_chars)).alias("pos", "block")).withColumn("h", key(F.col("block")))
    several = materialise(several.join(shared, "h", "left_semi").select("uid", "n", "pos", "block"), "blocks-of-shared-hashes")
    own = _named(several, ["block"], ["block"], "names-of-shared-hashes").select("block", (-1 - F.col("name")).alias("name"))
    alone = blocks.join(shared, "h", "left_anti").join(names, "h").select("uid", "n", "pos", "name")
    return alone.union(several.join(own, "block").select("uid", "n", "pos", "name"))


def identities(rows: DataFrame, block_chars: int = BLOCK_CHARS, key: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """(uid, level, name): equal texts, and only those, get equal (level, name). rows: uid, text, keys; written."""
    longest = rows.agg(F.max(F.size("keys"))).first()[0] or 0
    state = materialise(_first_names(rows, block_chars, key), "block-level")
    done, level = [state.where("n = 1").select("uid", F.lit(0).alias("level"), "name")], 0
    while longest > 1:
        half = F.floor(F.col("pos") / 2).cast("int").alias("half")
        pairs = state.where("n > 1").groupBy("uid", "n", half).agg(F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("a"), F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))).alias("b"))
        pairs = materialise(pairs.withColumn("b", F.coalesce("b", F.lit(NO_NAME))), "block-pairs")
        names = _named(pairs, ["a", "b"], ["a", "b"], "pair-names")
        state = pairs.join(names, ["a", "b"]).select("uid", F.ceil(F.col("n") / 2).cast("int").alias("n"), F.col("half").alias("pos"), "name")
        state = materialise(state, "block-level")
        level, longest = level + 1, -(-longest // 2)
        done.append(state.where("n = 1").select("uid", F.lit(level).alias("level"), "name"))
    out = done[0]
    for x in done[1:]:
        out = out.union(x)
    return out


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS, key: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256 (of the normalised text).

    key: what blocks find their names by, a 64-bit hash unless another one is given.
    """
    texts = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(f"`{id_col}`").alias("doc_id"), normalised(text_col).alias("text"))
    texts = texts.withColumn("text_sha256", F.sha2(F.encode("text", "UTF-8"), 256)).withColumn("keys", F.transform(cut_blocks("text", block_chars), lambda block: key(block)))
    rows = materialise(texts, "block-keys")
    named = materialise(rows.select("uid", "doc_id", "text_sha256").join(identities(rows.select("uid", "text", "keys"), block_chars, key), "uid"), "identities")
    best = named.groupBy("level", "name").agg(F.count(F.lit(1)).alias("group_size"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "uid")).alias("best"))
    best = materialise(best, "groups")  # written, so that adaptive execution can split a hot group's rows in the join
    return named.join(best, ["level", "name"]).select("doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("uid") == F.col("best.uid")).alias("kept"), "text_sha256")


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that :func:`exact_dedup` drops; all columns stay as they are."""
    id_, sha, own = free_names(docs, "id", "sha", "own")
    found = materialise(exact_dedup(docs, id_col, text_col).where("group_size > 1").select("doc_id", "text_sha256", "kept"), "exact-decisions")
    pairs = found.groupBy("doc_id", "text_sha256").agg(F.max("kept").alias("any_kept"), F.min("kept").alias("all_kept")).where(~F.col("all_kept"))
    pairs = materialise(pairs.select(F.col("doc_id").alias(id_), F.col("text_sha256").alias(sha), "any_kept"), "exact-dropped")
    gone, twins = pairs.where("not any_kept").drop("any_kept"), pairs.where("any_kept").drop("any_kept")
    keyed = docs.withColumn(own, F.sha2(F.encode(normalised(text_col), "UTF-8"), 256))
    match = F.col(own).eqNullSafe(F.col(sha)) & F.col(f"`{id_col}`").eqNullSafe(F.col(id_))
    rest = keyed.join(gone, match, "left_anti")
    if twins.isEmpty():
        return rest.drop(own)
    # Rows that share id and text: one of each stays.
    return rest.join(twins, match, "left_anti").unionByName(rest.join(twins, match, "left_semi").dropDuplicates([id_col, own])).drop(own)
