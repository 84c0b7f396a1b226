"""Per-key ordering that holds when one key owns a large share of the rows.

A plain window puts a whole key into one task. Here the leading sort columns also split the key: each piece is
ordered on its own, and the pieces are stitched with counts or edge rows that were aggregated before the shuffle.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from reviewlens.session import shared_folder


def first_per_key(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], also: Mapping[str, Column] | None = None
) -> DataFrame:
    """The row with the smallest `order` per key, by an aggregate that combines before the shuffle.

    `also` holds further aggregates over the key's rows; a name that is a column already replaces it.
    """
    return _edge_per_key(df, keys, order, F.min_by, also or {})


def last_per_key(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], also: Mapping[str, Column] | None = None
) -> DataFrame:
    """The row with the largest `order` per key."""
    return _edge_per_key(df, keys, order, F.max_by, also or {})


def _edge_per_key(df, keys, order, pick, also):
    rest = [c for c in df.columns if c not in keys and c not in also]
    row = F.struct(*[F.col(c) for c in rest])
    best = df.groupBy(*keys).agg(pick(row, F.struct(*order)).alias("_row"), *[a.alias(n) for n, a in also.items()])
    picked = best.select(*keys, *[F.col(f"_row.`{c}`").alias(c) for c in rest], *also)
    return picked.select(*df.columns, *[n for n in also if n not in df.columns])


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank: str = "rank") -> DataFrame:
    """At most `n` rows per key with their rank. The limit runs on both sides of the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= n)


def _pieces(df: DataFrame, keys: Sequence[str], split: Sequence[Column]) -> DataFrame:
    """The frame with its piece: key and split columns in one struct, which equals itself even where fields are null.

    Windows, counts and the stitching join all go by this one column, so the rows are shuffled once.
    """
    fields = [F.col(k).alias(f"k{i}") for i, k in enumerate(keys)] + [c.alias(f"s{i}") for i, c in enumerate(split)]
    return df.withColumn("_piece", F.struct(*fields))


def _across(keys: Sequence[str], descending: Sequence[bool]) -> WindowSpec:
    """A window over the pieces of a key, in order."""
    order = [
        F.desc_nulls_last(f"_piece.s{i}") if down else F.asc_nulls_last(f"_piece.s{i}")
        for i, down in enumerate(descending)
    ]
    return Window.partitionBy(*[F.col(f"_piece.k{i}") for i in range(len(keys))]).orderBy(*order)


def rank_per_key(
    df: DataFrame,
    keys: Sequence[str],
    split: Sequence[tuple[Column, bool]],
    order: Sequence[Column],
    rank: str = "rank",
) -> DataFrame:
    """Exact row number per key for rows sorted by `split` (column, descending) and then by `order`."""
    pieces = _pieces(df, keys, [c for c, _ in split])
    local = pieces.withColumn("_local", F.row_number().over(Window.partitionBy("_piece").orderBy(*order)))
    before = _across(keys, [down for _, down in split]).rowsBetween(Window.unboundedPreceding, -1)
    offsets = pieces.groupBy("_piece").agg(F.count("*").alias("_n")).select(
        "_piece", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")
    )
    joined = local.join(offsets, "_piece", "left")
    return joined.select(*df.columns, (F.col("_before") + F.col("_local")).cast("int").alias(rank))


LOCAL_BITS = 33
#: Ranges that one task adds up; beyond it, and for their blocks, there is a second level.
RANGE_BLOCK = 1024
MOST_RANGES = 1 << 17
#: Keys whose first places are sent to all tasks; more of them are joined by a shuffle.
BROADCAST_KEYS = 1 << 20


def _placed(df: DataFrame, order: Sequence[Column], ranges: int | None) -> tuple[DataFrame, DataFrame]:
    """The rows, sorted into ranges and stored with their range and place in it, and how many rows come before each range."""
    spark = df.sparkSession
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    if not 0 < ranges <= MOST_RANGES:
        raise ValueError(f"1 to {MOST_RANGES} ranges")
    path = shared_folder(spark, "ranges")
    sorted_rows = df.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    numbered = sorted_rows.withColumns(
        {
            "_range": F.spark_partition_id(),
            "_local": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << LOCAL_BITS) - 1)),
        }
    )
    numbered.write.parquet(path)
    rows = spark.read.schema(numbered.schema).parquet(path)
    counts = rows.groupBy("_range").agg(F.count("*").alias("_n")).withColumn("_block", F.floor(F.col("_range") / RANGE_BLOCK))
    in_block = Window.partitionBy("_block").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    blocks = counts.groupBy("_block").agg(F.sum("_n").alias("_all"))
    over_blocks = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("_block", F.coalesce(F.sum("_all").over(over_blocks), F.lit(0)).alias("_far"))
    before = counts.withColumn("_near", F.coalesce(F.sum("_n").over(in_block), F.lit(0))).join(F.broadcast(blocks), "_block")
    return rows, before.select("_range", (F.col("_near") + F.col("_far")).alias("_before"))


def place_in_order(df: DataFrame, order: Sequence[Column], place: str = "place", ranges: int | None = None) -> DataFrame:
    """Exact position of every row in a total order of any columns, from 1.

    Spark samples the sort columns to cut them into ranges, so equal leading values are split by those after them, and each
    range is one sorted task. The sorted rows are written once to the shared folder; places add up counts per range on two
    levels. There are at most as many ranges as asked for (the shuffle partitions), which bounds what is broadcast.
    """
    rows, before = _placed(df, order, ranges)
    joined = rows.join(F.broadcast(before), "_range")
    return joined.select(*df.columns, (F.col("_before") + F.col("_local") + 1).alias(place))


def rank_in_ranges(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], rank: str = "rank", ranges: int | None = None
) -> DataFrame:
    """Exact row number per key in a total order: the place among all rows less that of the key's first row.

    Ranges go by key and order, so a key of any size is spread over them. All columns are stored: take those you need. First
    places are one row per key, combined before the shuffle and stored; where there are too many to send to every task, both sides are joined by key and AQE splits a frequent one.
    """
    placed = place_in_order(df, [*[F.asc_nulls_last(k) for k in keys], *order], "_place", ranges)
    named = placed.withColumn("_key", F.struct(*keys))
    first = named.groupBy("_key").agg(F.min("_place").alias("_first"))
    size, path = Observation(), shared_folder(df.sparkSession, "first-places")
    first.observe(size, F.count(F.lit(1)).alias("n")).write.parquet(path)
    first = df.sparkSession.read.schema(first.schema).parquet(path)
    joined = named.join(F.broadcast(first) if size.get["n"] <= BROADCAST_KEYS else first, "_key")
    return joined.select(*df.columns, (F.col("_place") - F.col("_first") + 1).cast("int").alias(rank))


def previous_per_key(
    df: DataFrame,
    keys: Sequence[str],
    split: Column,
    order: Sequence[str],
    carry: Sequence[str],
    prefix: str = "prev_",
) -> DataFrame:
    """Previous row's `carry` columns per key; `split` must never decrease along `order`."""
    pieces = _pieces(df, keys, [split])
    row = F.struct(*carry)
    local = pieces.withColumn("_near", F.lag(row).over(Window.partitionBy("_piece").orderBy(*order)))
    edges = pieces.groupBy("_piece").agg(F.max_by(row, F.struct(*order)).alias("_last")).select(
        "_piece", F.lag("_last").over(_across(keys, [False])).alias("_far")
    )
    joined = local.join(edges, "_piece", "left").withColumn("_prev", F.coalesce("_near", "_far"))
    return joined.select(*df.columns, *[F.col(f"_prev.`{c}`").alias(prefix + c) for c in carry])
