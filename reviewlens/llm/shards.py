"""Sharding by a minimax contiguous partition of ordered atomic groups.

Rows with equal texts have equal md5 and so share an atom: one of a fixed number of md5 ranges. The atoms are ordered
by md5 and have total sizes; the smallest capacity at which a greedy walk over the atoms needs no more than the given
number of shards is found by binary search, and the shards are cut there. Only the totals of the atoms reach the
driver, and their number is a parameter, whatever the size of the table.

A hot atom (one text repeated very often) is numbered in pieces, so that no task sorts more than about one atom's
fair share of rows: the rows of an atom are dealt to pieces by a hash, pieces are counted, and a row's slot is the
rows in pieces before it plus its place in its own piece.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reviewlens.llm.common import md5_part

SHARDS = 40
ATOM_DIGITS = 4
OVERHEAD = 16
PIECE_ROWS = 1000


def needed(sizes: list[int], capacity: int) -> int:
    """Shards a greedy walk opens at this capacity; no size may exceed it."""
    shards, room = 0, -1
    for size in sizes:
        if size > room:
            shards, room = shards + 1, capacity
        room -= size
    return shards


def smallest_capacity(sizes: list[int], shards: int) -> int:
    """The least capacity at which contiguous shards, at most `shards` of them, hold all sizes."""
    low, high = max([*sizes, -(-sum(sizes) // shards)], default=0), sum(sizes)
    while low < high:
        middle = (low + high) // 2
        if needed(sizes, middle) <= shards:
            high = middle
        else:
            low = middle + 1
    return low


def cut(sizes: list[int], shards: int) -> list[int]:
    """The shard of each size, in order."""
    capacity = smallest_capacity(sizes, shards)
    out, shard, room = [], -1, -1
    for size in sizes:
        if size > room:
            shard, room = shard + 1, capacity
        room -= size
        out.append(shard)
    return out


def shard(
    docs: DataFrame,
    *,
    shards: int = SHARDS,
    text_col: str = "text",
    id_col: str = "doc_id",
    atom_digits: int = ATOM_DIGITS,
    overhead: int = OVERHEAD,
) -> DataFrame:
    """Each document row with size (UTF-8 bytes and `overhead`), shard and slot (gapless from 0 in its shard).

    Columns of such names are replaced. Null texts are as large as empty ones and are grouped with them. Equal texts
    are never parted, so a text repeated often can make its shard larger than the others. Rows that are alike in id
    and text are interchangeable; their slots follow each other. With fewer atoms than shards some shards stay empty.
    """
    kept = [c for c in docs.columns if c not in ("size", "shard", "slot")]
    text = F.coalesce(F.col(text_col), F.lit(""))
    sized = docs.select(
        *kept,
        (F.octet_length(text) + overhead).cast("long").alias("size"),
        md5_part(text, 1, atom_digits).cast("int").alias("__atom"),
        F.xxhash64(F.col(id_col).cast("string"), text).alias("__deal"),
    )
    atoms = sized.groupBy("__atom").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect()
    atoms.sort(key=lambda r: r["__atom"])
    fair = max(PIECE_ROWS, 4 * sum(r["n"] for r in atoms) // 16**atom_digits)
    spark = docs.sparkSession
    plan = spark.createDataFrame(
        [
            (r["__atom"], home, -(-r["n"] // fair))
            for r, home in zip(atoms, cut([r["bytes"] for r in atoms], shards), strict=True)
        ],
        "__atom int, __shard int, __pieces long",
    )
    # At most 16 ** atom_digits rows of three numbers, whatever the size of the table.
    placed = sized.join(F.broadcast(plan), "__atom").withColumn("__piece", F.pmod("__deal", F.col("__pieces")))
    counts = placed.groupBy("__shard", "__atom", "__piece").agg(F.count("*").alias("n")).collect()
    counts.sort(key=lambda r: (r["__shard"], r["__atom"], r["__piece"]))
    before, total, last = [], 0, None
    for r in counts:
        total = 0 if r["__shard"] != last else total
        before.append((r["__atom"], r["__piece"], total))
        total, last = total + r["n"], r["__shard"]
    offsets = F.broadcast(spark.createDataFrame(before, "__atom int, __piece long, __before long"))
    order = Window.partitionBy("__atom", "__piece").orderBy(F.col(id_col), "size", "__deal")
    numbered = placed.withColumn("__place", F.row_number().over(order)).join(offsets, ["__atom", "__piece"])
    return numbered.select(
        *kept,
        "size",
        F.col("__shard").alias("shard"),
        (F.col("__before") + F.col("__place") - 1).cast("long").alias("slot"),
    )
