"""Mixing sources to target weights by Pareto order sampling.

Sources, in code point order and null last, get weights 3, 1, 2, repeating. They share 150 % of all words; a target
stops at twice its source's words, and the excess is shared again by weight until no target is above.

Within a source a document's expected copies grow with its length: each doubling of the words gives 2^TILT times as
many, at most ``most``, scaled so that the expected words are the target. The whole part of that number are certain
copies. The fraction is the document's inclusion probability p in a sample of fixed size (in words): documents are
ranked by random odds divided by inclusion odds, (u / (1 - u)) / (p / (1 - p)), and taken in that order until the
target's words are used up. A document that would pass the target is skipped for later ones that fit.

The order is cut through sums per bin of the rank; the bin at the cut is cut again until it holds at most AT_ONCE
documents, which are then gone through one by one. The same is done with all later documents that are no larger than
the words left, until no source has any: the outcome is that of going through the whole source in order, and no
source is ever sorted or held as a whole. Totals, targets and cuts are tables with a row per source, never collected.

u comes from a hash of the id, the text's checksum and the seed: reruns agree.

Defined cases: a null text has size 0 and is never taken; a null source is a source of its own, last in order; rows
with equal id and text have equal rank and are taken together where possible; an empty table gives an empty result;
other columns may have any name.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from symloom.llm.common import free_names, materialise, text_or_empty, word_count

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
#: A document of twice the words gets 2^TILT times the expected copies.
TILT = 0.125
#: Documents at the cut of a source that are gone through one by one, and bins that the rest is cut into.
AT_ONCE, BINS = 1000, 1024


def numbered(sources: DataFrame) -> DataFrame:
    """``sources`` with ``number``: each source's place in code point order, null last, from 0."""
    last = F.col("source").asc_nulls_last()
    dealt = sources.repartitionByRange(last).sortWithinPartitions(last).withColumn("at", F.monotonically_increasing_id())
    dealt = materialise(dealt, "mix-sources")  # partition above 33 bits, row below
    part = F.shiftright("at", 33)
    counts = dealt.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect()  # a row per partition
    first, starts = 0, []
    for r in counts:
        starts.append((r["part"], first))
        first += r["n"]
    starts = sources.sparkSession.createDataFrame(starts, "part long, first long")
    return dealt.join(starts, part == F.col("part")).withColumn("number", F.col("first") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).drop("at", "part", "first")


def targets(totals: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size) to (source, source_size, target): words that each source gets, from the words it has."""
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("number") % len(weights) + 1).cast("int"))
    own = materialise(numbered(totals).select("source", "source_size", weight.alias("weight"), (F.col("source_size") * float(most)).alias("limit")), "mix-weights")
    start = own.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("words"), F.coalesce(F.sum("weight"), F.lit(0.0)).alias("weight")).first()
    everything = left = share * start["words"]
    open_weight, n_full = start["weight"], 0
    while open_weight > 0:  # the level only rises, so a source that is full stays so
        full = F.lit(left) * F.col("weight") / F.lit(open_weight) > F.col("limit")
        now = own.agg(F.count_if(full).alias("n"), F.coalesce(F.sum(F.when(full, F.col("limit"))), F.lit(0.0)).alias("full"), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0)).alias("open")).first()
        if now["n"] == n_full:
            break
        n_full, left, open_weight = now["n"], everything - now["full"], now["open"]
    if open_weight > 0:
        aim = F.lit(left) * F.col("weight") / F.lit(open_weight)
        aim = F.when(aim > F.col("limit"), F.col("limit")).otherwise(aim)
    else:
        aim = F.col("limit")
    return own.select("source", "source_size", aim.alias("target"))


def expected_copies(classes: DataFrame, most: float = MOST, tilt: float = TILT) -> DataFrame:
    """(source, class, words, source_size, target) with whole, p and the source's budget: words left to sample.

    A class is the documents of 2^class to 2^(class + 1) - 1 words of a source; those of no words are class -1. With
    the longest k classes at ``most`` copies, the others' scale follows from the target; k is the first that fits.
    """
    rest = Window.partitionBy("source")
    upto = rest.orderBy(F.desc("class")).rowsBetween(Window.unboundedPreceding, -1)
    onward = rest.orderBy(F.desc("class")).rowsBetween(0, Window.unboundedFollowing)
    gain = F.when(F.col("class") < 0, 0.0).otherwise(F.pow(F.lit(2.0), F.col("class") * tilt))
    out = classes.withColumn("gain", gain)
    out = out.withColumn("above", F.coalesce(F.sum("words").over(upto), F.lit(0))).withColumn("onward", F.sum(F.col("gain") * F.col("words")).over(onward))
    scale = F.when(F.col("onward") > 0, (F.col("target") - most * F.col("above")) / F.nullif("onward", F.lit(0.0)))
    out = out.withColumn("scale", scale)
    fits = F.when(F.col("scale") * F.col("gain") <= most * (1 + 1e-9), F.struct(-F.col("class"), "scale"))
    out = out.withColumn("scale", F.min(fits).over(rest)["scale"])
    copies = F.least(F.lit(float(most)), F.coalesce(F.col("scale") * F.col("gain"), F.lit(float(most))))
    out = out.withColumn("copies", F.when(F.col("target") >= most * F.col("source_size") - 0.5, F.lit(float(most))).otherwise(copies))
    out = out.withColumn("whole", F.floor(F.col("copies") + 1e-9).cast("int")).withColumn("p", F.greatest(F.lit(0.0), F.col("copies") - F.col("whole")))
    return out.withColumn("budget", F.col("target") - F.sum(F.col("whole") * F.col("words")).over(rest)).select("source", "class", "source_size", "target", "whole", "p", "budget")


def uniform(seed: int, *columns: Column) -> Column:
    """In (0, 1), from a hash."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *columns), 11).cast("double") + 0.5) / float(1 << 53)


def rank_of(u: Column, p: Column) -> Column:
    """Random odds over inclusion odds, Q, as Q / (1 + Q): a p of 0 comes last."""
    p = F.least(F.greatest(p, F.lit(1e-9)), F.lit(1 - 1e-9))
    q = (u / (1 - u)) * ((1 - p) / p)
    return q / (1 + q)


def _same(left: str, right: str) -> Column:
    return F.col(left).eqNullSafe(F.col(right))


def _cut(live: DataFrame) -> DataFrame:
    """Per source the ranks [low, high] around the place where ``left`` words are used up, and the words before it.

    live: source, rank, size, lo, left. Sources that fit as a whole have low null.
    """
    spans = live.groupBy("source").agg(F.first("lo").alias("lo"), F.first("left").alias("left"), F.sum("size").alias("words"), F.count(F.lit(1)).alias("n"), F.min("rank").alias("low"), F.max("rank").alias("high"))
    spans = materialise(spans.withColumn("before", F.lit(0).cast("long")), "mix-spans")
    done = [spans.where("words <= left").select("source", "lo", "left", F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"), F.col("words").alias("before"))]
    wide = spans.where("words > left")
    while True:
        done.append(wide.where(f"n <= {AT_ONCE} or low >= high").select("source", "lo", "left", "low", "high", "before"))
        wide = wide.where(f"n > {AT_ONCE} and low < high")
        if wide.isEmpty():
            break
        own = wide.select(F.col("source").alias("s"), "low", "high", "before")
        inside = live.join(own, _same("source", "s")).where("rank between low and high")
        bin_ = F.least(F.floor((F.col("rank") - F.col("low")) / (F.col("high") - F.col("low")) * BINS), F.lit(BINS - 1))
        sums = inside.groupBy("source", bin_.alias("bin")).agg(F.first("lo").alias("lo"), F.first("left").alias("left"), F.first("before").alias("so_far"), F.sum("size").alias("words"), F.count(F.lit(1)).alias("n"), F.min("rank").alias("low"), F.max("rank").alias("high"))
        before = F.col("so_far") + F.sum("words").over(Window.partitionBy("source").orderBy("bin")) - F.col("words")  # BINS rows a source at most
        crossing = sums.withColumn("before", before).where("before + words > left")
        crossing = crossing.groupBy("source").agg(F.min(F.struct("bin", "lo", "left", "words", "n", "low", "high", "before")).alias("x"))
        wide = materialise(crossing.select("source", *[f"x.{c}" for c in ("lo", "left", "words", "n", "low", "high", "before")]), "mix-cut")
    out = done[0]
    for part in done[1:]:
        out = out.union(part)
    return materialise(out, "mix-cuts")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 20, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, tilt: float = TILT) -> DataFrame:
    """One row per row of ``docs``: doc_id, key (of the text), size, source, source_size, target, copies, taken."""
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{source_col}`").alias("source"), F.crc32(F.encode(text_or_empty(F.col(f"`{text_col}`")), "UTF-8")).alias("key"), word_count(F.col(f"`{text_col}`")).alias("size"))
    rows = rows.withColumn("class", F.when(F.col("size") > 0, F.length(F.bin("size")) - 1).otherwise(-1))
    sized = materialise(rows, "mix-sizes")
    classes = materialise(sized.groupBy("source", "class").agg(F.sum("size").alias("words")), "mix-classes")
    aims = targets(classes.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, most)
    plan = classes.join(aims.withColumnRenamed("source", "s"), _same("source", "s")).drop("s")
    plan = materialise(expected_copies(plan, most, tilt), "mix-plan")
    own = plan.select(F.col("source").alias("s"), F.col("class").alias("c"), "source_size", "target", "whole", "p")
    ranked = sized.join(own, _same("source", "s") & (F.col("class") == F.col("c"))).drop("s", "c", "class")
    ranked = materialise(ranked.withColumn("rank", rank_of(uniform(seed, F.col("doc_id"), F.col("key")), F.col("p"))), "mix-ranked")

    id_type = ranked.schema["doc_id"].dataType
    chosen_type = T.StructType([T.StructField("source", T.StringType()), T.StructField("doc_id", id_type), T.StructField("key", T.LongType()), T.StructField("words", T.LongType())])

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["rank", "doc_id", "key"])
        left, keep = pdf["room"].iloc[0], []
        for n in pdf["words"].tolist():
            keep.append(n <= left)
            left -= n if n <= left else 0
        return pdf.loc[keep, ["source", "doc_id", "key", "words"]]

    spark = docs.sparkSession
    pool = ranked.where(f"size > 0 and whole < {most}").select("source", "doc_id", "key", "size", "rank")
    state = plan.where("budget >= 1").select("source", F.lit(-1.0).alias("lo"), F.col("budget").alias("left")).distinct()
    runs, edge = spark.createDataFrame([], "source string, above double, below double, largest double"), spark.createDataFrame([], chosen_type)
    while not state.isEmpty():
        at = state.select(F.col("source").alias("s"), "lo", "left")
        cuts = _cut(pool.join(at, _same("source", "s")).where("size <= left and rank > lo").select("source", "rank", "size", "lo", "left"))
        runs = runs.union(cuts.select("source", "lo", F.coalesce("low", F.lit(2.0)), "left"))
        at = cuts.where("low is not null").select(F.col("source").alias("s"), "low", "high", "left", (F.col("left") - F.col("before")).alias("room"))
        # AT_ONCE documents a source at most; equal rows stay together.
        near = pool.join(at, _same("source", "s")).where("size <= left and rank between low and high").groupBy("source", "rank", "doc_id", "key").agg(F.sum("size").alias("words"), F.first("room").alias("room"))
        filled = materialise(near.groupBy("source").applyInPandas(fill, chosen_type), "mix-edge")
        edge = edge.union(filled)
        used = filled.groupBy(F.col("source").alias("u")).agg(F.sum("words").alias("used"))
        state = at.join(used, _same("s", "u"), "left").select(F.col("s").alias("source"), F.col("high").alias("lo"), (F.col("room") - F.coalesce("used", F.lit(0))).alias("left"))
        state = materialise(state.where("left >= 1"), "mix-state")

    runs = runs.groupBy(F.col("source").alias("o")).agg(F.collect_list(F.struct("above", "below", "largest")).alias("runs"))  # a few a source
    out = ranked.join(runs, _same("source", "o"), "left")
    taken = F.exists("runs", lambda x: (F.col("rank") > x["above"]) & (F.col("rank") < x["below"]) & (F.col("size") <= x["largest"]))
    edge = edge.select(F.col("source").alias("e_source"), F.col("doc_id").alias("e_id"), F.col("key").alias("e_key"), F.lit(True).alias("edge"))
    out = out.join(edge, _same("source", "e_source") & _same("doc_id", "e_id") & (F.col("key") == F.col("e_key")), "left")
    extra = F.when((F.col("whole") < most) & (F.coalesce(taken, F.lit(False)) | F.coalesce("edge", F.lit(False))), 1).otherwise(0)
    copies = F.when(F.col("size") == 0, 0).otherwise(F.col("whole") + extra)
    return out.withColumn("copies", copies).select("doc_id", "key", "size", "source", "source_size", "target", "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def take_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mixture itself: rows of ``docs``, each as often as the mix takes it, all columns as they are."""
    id_, key, source, copies, own, copy = free_names(docs, "id", "key", "source", "copies", "own", "copy")
    chosen = mix(docs, id_col, text_col, source_col, **options).where("copies > 0")
    chosen = chosen.select(F.col("doc_id").alias(id_), F.col("key").alias(key), F.col("source").alias(source), F.col("copies").alias(copies)).dropDuplicates([id_, key, source])
    chosen = materialise(chosen, "mix-chosen")
    keyed = docs.withColumn(own, F.crc32(F.encode(text_or_empty(F.col(f"`{text_col}`")), "UTF-8")))
    match = _same(f"`{id_col}`", id_) & (F.col(own) == F.col(key)) & _same(f"`{source_col}`", source)
    return keyed.join(chosen, match).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*[F.col(f"`{c}`") for c in docs.columns])
