"""Mixing sources to target weights by Efraimidis-Spirakis sampling over whole epochs.

A source takes whole epochs while its target allows, then part of one more: every document has the exponential key
-ln(u) / w, with u from a hash of its id and w its quality weight, and documents are taken in order of the key until
their sizes add up to the rest of the target.

The order within a source is never sorted as a whole. Keys fall into ranges ("pieces") whose sizes are summed first;
pieces before the cut are taken whole and only the piece that holds the cut is sorted. Everything is an expression
of the DataFrame API.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewlens.llm.common import md5_part, stored

WEIGHTS = (5, 2, 1)
MOST_EPOCHS = 3
PIECES = 4096


def word_count(text: Column) -> Column:
    """Number of runs of characters other than ASCII white space; null counts none."""
    blank = F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", "     ")
    return F.size(F.array_remove(F.split(blank, " "), "")).cast("long")


def exponential_key(id_col: Column, weight: Column, seed: str = "mix") -> Column:
    """-ln(u) / w with u in (0, 1) from 48 bits of a hash."""
    u = (md5_part(F.concat(F.lit(seed + ":"), F.coalesce(id_col.cast("string"), F.lit(""))), 1, 12) + 0.5) / 2.0**48
    return -F.log(u) / weight


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """Per source (columns source, source_size, target): its share of all sizes by weight, at most `most` times its size.

    `sizes` has one row per source. Sources ordered by code point, null last, take the weights in turn. What a full
    source can't take is shared among the rest by weight: with sources ordered by size per weight, all before some
    place are full and the others get an equal level per weight, so the level follows from running sums.
    """
    # Ranks over the one row per source; the table is small next to the documents, but nothing is collected.
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    ranked = sizes.select("source", "source_size", weight.alias("w"))
    by_level = Window.orderBy(F.col("source_size") / F.col("w"), F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.partitionBy()
    levels = ranked.select(
        "*",
        F.sum("source_size").over(whole).alias("total"),
        F.coalesce(F.sum("source_size").over(before), F.lit(0)).alias("full"),
        F.sum("w").over(onward).alias("w_left"),
    ).withColumn("level", (F.col("total") - most * F.col("full")) / F.col("w_left"))
    # The first source whose cap is not below the level sets it for all that follow.
    open_ = F.col("level") * F.col("w") <= most * F.col("source_size")
    level = F.min(F.when(open_, F.struct("full", "level"))).over(whole)["level"]
    return levels.select("source", "source_size", "w", level.alias("level")).select(
        "source",
        "source_size",
        F.least(F.col("level") * F.col("w"), (most * F.col("source_size")).cast("double")).alias("target"),
    )


def mix(
    docs: DataFrame,
    *,
    size: Column | None = None,
    quality: Column | None = None,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    weights: Sequence[int] = WEIGHTS,
    most: int = MOST_EPOCHS,
    pieces: int = PIECES,
) -> DataFrame:
    """Per document row: its id, source, size, source_size, target and copies (how often the mix takes it).

    `size` defaults to the words of the text and `quality`, the sampling weight, to 1; a quality that is null or not
    positive counts as 1. Null ids are hashed as empty, so rows without id share a key. Rows that are alike are
    interchangeable. A row of size 0 is taken with the epochs and at its place in the order. A document at the cut is
    taken when that brings the source nearer to its target. Reruns agree, since keys are hashes. An empty table gives
    an empty result.
    """
    size = word_count(F.col(text_col)) if size is None else size
    quality = F.lit(1.0) if quality is None else quality
    weight = F.when(quality > 0, quality.cast("double")).otherwise(1.0)
    key = exponential_key(F.col(id_col), weight)
    keyed = docs.select(
        F.col(id_col), F.col(source_col).alias("source"), size.cast("long").alias("size"), key.alias("key")
    ).withColumn("piece", F.least(F.floor((1 - F.exp(-F.col("key"))) * pieces), F.lit(pieces - 1)).cast("int"))
    keyed = stored(keyed, "mix-keys")
    sums = keyed.groupBy("source", "piece").agg(F.sum("size").alias("piece_size"))
    targets = source_targets(sums.groupBy("source").agg(F.sum("piece_size").alias("source_size")), weights, most)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    planned = targets.withColumn("epochs", epochs.cast("long")).withColumn(
        "rest", F.col("target") - F.col("epochs") * F.col("source_size")
    )
    running = Window.partitionBy("source").orderBy("piece")
    plan = (
        sums.withColumn("before", F.sum("piece_size").over(running) - F.col("piece_size"))
        .join(planned.withColumnRenamed("source", "source_"), F.col("source").eqNullSafe(F.col("source_")))
        .select(
            F.struct("source", "piece").alias("part"), "source_size", "target", "epochs", "rest", "before",
            ((F.col("before") + F.col("piece_size") <= F.col("rest")) & (F.col("before") < F.col("rest"))).alias("taken"),
            (F.col("before") < F.col("rest")).alias("reached"),
        )
    )
    parted = keyed.withColumn("part", F.struct("source", "piece")).join(plan, "part")
    cut = F.col("reached") & ~F.col("taken")
    # Only rows of the piece with the cut are ordered; the others are spread so that the window has nothing to do.
    within = Window.partitionBy("part", F.when(~cut, F.xxhash64(id_col))).orderBy("key", id_col, "size")
    end = F.col("before") + F.when(cut, F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0)))
    start = end - F.col("size")
    nearer = (start < F.col("rest")) & (end - F.col("rest") <= F.col("rest") - start)
    return parted.select(
        id_col, "source", "size", "source_size", "target",
        (F.col("epochs") + F.when(cut, nearer).otherwise(F.col("taken")).cast("long")).alias("copies"),
    )
