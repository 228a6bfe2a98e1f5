"""Mixing sources to target weights with hash-threshold histograms.

Documents hash to 2**24 values. Word counts are summed by source and hash bucket; a
source's remaining budget falls into one bucket, which alone is refined, level by level.
Everything below the threshold is taken; nothing is sorted. A source whose target exceeds
its size is taken whole as often as fits, and by the threshold for the rest.

Null and empty text has size 0; very long texts are counted whole. A null source is a source of its own, last in order. The hash is of doc_id and text, so
rows of one id, or of none, are decided apart unless their texts are equal too. A document of size 0 is never taken. An empty table gives an empty result. Ties on a
threshold fall to the side that brings the source nearer to its target. A column to keep that is named like one that
the mix adds (size, source_size, target, taken) is returned as in_size and so on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS, CEILING = (1, 2, 3), 3
#: Bits of the hash that each level of refinement looks at.
LEVELS, BITS = 3, 8
#: Columns that the mix adds.
ADDED = ("size", "source_size", "target", "taken")


def _numbered(rows: DataFrame, order: list[Column], sums: tuple[str, ...], work: Workspace, name: str) -> DataFrame:
    """rows with nth, their place in an order, from 0, and for each column of sums the sum of all rows before, as NAME_before.

    Rows are dealt out by ranges of the order. Only the ranges' own figures, one row each, meet in one task.
    """
    dealt = work.cut(rows.orderBy(*order).withColumn("at", F.monotonically_increasing_id()), name).withColumn("range", F.shiftright("at", 33))
    ranges = dealt.groupBy("range").agg(F.count("*").alias("n"), *(F.sum(c).alias(c) for c in sums))
    earlier, inside = (w.rowsBetween(Window.unboundedPreceding, -1) for w in (Window.orderBy("range"), Window.partitionBy("range").orderBy("at")))
    before = lambda c, window: F.coalesce(F.sum(c).over(window), F.lit(0))
    offsets = ranges.select("range", before("n", earlier).alias("n_first"), *(before(c, earlier).alias(f"{c}_first") for c in sums))
    held = dealt.select("*", *(before(c, inside).alias(f"{c}_inside") for c in sums)).join(F.broadcast(offsets), "range")
    nth = F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("n_first")
    return held.select(*rows.columns, nth.alias("nth"), *((F.col(f"{c}_inside") + F.col(f"{c}_first")).alias(f"{c}_before") for c in sums))


def targets(sizes: DataFrame, work: Workspace, weights: tuple[int, ...] = WEIGHTS, ceiling: int = CEILING) -> DataFrame:
    """(source, source_size, target) from (source, size): shares by weight, cut off at
    ceiling times the source's size, the excess reshared until no source is above.

    With sources in order of ceiling size over weight, those cut off come first, and the rest share
    what those leave; sums over that order give each source's share if all before it are cut off.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    named = _numbered(totals, [F.col("source").asc_nulls_last()], (), work, "by-name")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("nth") % len(weights) + 1).cast("int")).cast("long")
    ranked = named.select("source", "source_size", weight.alias("w"), (F.col("source_size") * ceiling).alias("cap"))
    summed = work.cut(_numbered(ranked, [F.col("cap") / F.col("w"), F.col("source").asc_nulls_last()], ("cap", "w"), work, "by-share"), "summed")
    all_ = summed.agg(F.sum("w").alias("w"), F.sum("source_size").alias("size")).first()
    level = (F.lit(all_["size"] or 0).cast("double") - F.col("cap_before")) / (F.lit(all_["w"] or 0) - F.col("w_before"))
    # Once a source is not cut off, none after it is: their level is that of the first such source.
    first = summed.withColumn("level", level).where(F.col("cap") > F.col("level") * F.col("w")).agg(F.min("nth").alias("nth"), F.min_by("level", "nth").alias("level")).first()
    target = F.col("cap").cast("double") if first["nth"] is None else F.when(F.col("nth") >= first["nth"], F.lit(first["level"]) * F.col("w")).otherwise(F.col("cap").cast("double"))
    return summed.select("source", "source_size", target.alias("target"))


def _same(a: str, b: str):
    return F.col(a).eqNullSafe(F.col(b))


def sized(docs: DataFrame, columns: list[str]) -> DataFrame:
    """columns in one struct, carried, beside source, size in words and a 24-bit hash of doc_id and text."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    carried = F.struct(*(F.col(f"`{c}`").alias(f"in_{c}" if c in ADDED else c) for c in columns))
    return docs.select(carried.alias("carried"), "source", size.alias("size"), F.shiftrightunsigned(F.xxhash64(F.lit("mix"), "doc_id", F.coalesce("text", F.lit(""))), 64 - LEVELS * BITS).alias("mix_hash"))


def thresholds(rows: DataFrame, goal: DataFrame, work: Workspace) -> DataFrame:
    """(t_source, whole, threshold): how often a source is taken whole, and below which hash once more. What is known
    of each source, a row, is written after each level, so that no level's plan holds the others'."""
    state = goal.select(
        F.col("source").alias("t_source"), "source_size", "target",
        F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long").alias("whole"),
    ).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")).withColumn("prefix", F.lit(0).cast("long"))
    state = work.cut(state, "state")
    for level in range(LEVELS):
        shift = BITS * (LEVELS - 1 - level)
        inside = rows.join(state, _same("source", "t_source") & (F.shiftright("mix_hash", shift + BITS) == F.col("prefix")))
        hist = inside.groupBy("source", F.shiftright("mix_hash", shift).alias("bucket")).agg(F.sum("size").alias("mass"))
        by = Window.partitionBy("source").orderBy("bucket")
        cum = hist.withColumn("upto", F.sum("mass").over(by))
        # The boundary bucket is the first that the rest does not cover.
        held = cum.join(state.select("t_source", "rest"), _same("source", "t_source")).groupBy("t_source").agg(
            F.min(F.when(F.col("upto") > F.col("rest"), F.struct("bucket", (F.col("upto") - F.col("mass")).alias("below"), "mass"))).alias("edge"))
        held = held.select(F.col("t_source").alias("e_source"), "edge")
        state = state.join(held, _same("t_source", "e_source"), "left").select(
            "t_source", "source_size", "target", "whole",
            (F.col("rest") - F.coalesce("edge.below", F.lit(0))).alias("rest"),
            # Without a boundary (nothing left to take from), the prefix leaves the range, and all below it is taken.
            F.coalesce("edge.bucket", F.shiftleft(F.col("prefix") + 1, BITS)).alias("prefix"),
            F.col("edge.mass").alias("mass"),
        )
        state = work.cut(state, f"state-{level}")
    nearer = F.coalesce(F.col("rest") * 2 > F.col("mass"), F.lit(False))
    return state.select("t_source", "source_size", "target", "whole", (F.col("prefix") + nearer.cast("long")).alias("threshold"))


def mix(docs: DataFrame, columns: tuple[str, ...] = ("doc_id",), weights: tuple[int, ...] = WEIGHTS, ceiling: int = CEILING) -> DataFrame:
    """columns of each document, with size, source_size, target, and taken: words the mix takes, repeats counted."""
    work = Workspace(docs.sparkSession, "mixing")
    rows = work.cut(sized(docs, list(dict.fromkeys(columns))), "sizes")
    goal = work.cut(targets(rows, work, weights, ceiling), "targets")
    edge = work.cut(thresholds(rows, goal, work), "thresholds")
    copies = F.col("whole") + (F.col("mix_hash") < F.col("threshold")).cast("long")
    return rows.join(edge, _same("source", "t_source"), "left").select("carried.*", "size", "source_size", "target", (F.col("size") * copies).alias("taken"))
