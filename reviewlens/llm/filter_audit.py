"""What each of several filters removes, in every order of applying them, from counts of failure masks.

A document's mask holds a bit per filter it fails. Documents are counted by part and mask, so at most 2^k cells remain
per part, whatever the number of documents. A walk over all 2^k sets of active filters in Gray-code order toggles one
filter at a time: each cell keeps a counter of the active filters it fails, and when that counter leaves or reaches
zero, the cell leaves or joins the running survivors. The survivors of all 2^k sets are stored; every figure of every
order is a difference of two of them, since what is left after some steps depends on the set of filters applied only.

Results for odd input: a null text is an empty text; a null part is the empty string. A document is a copy when another
row with the same text has a smaller id; equal ids are not smaller than each other, and a null id is neither smaller nor
larger than any, so rows without id are no copies and have no labels. Several labels of one id count as one if any is 1.
An empty table gives no rows, as it has no parts. Extra columns are ignored.

Equal texts are found by sha-256, counted before the shuffle: a group of copies is one row per part and task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Spread of rows that can't meet a label, since a null key would be one task.
SPREAD = 256
#: Parts whose rows are made at a time: each makes orders times steps of them.
SLICE = 64
COUNTS = ("n", "good", "toxic")
SPACE = r"[\x20\x09-\x0D]+"


def word_counts(text: Column) -> tuple[Column, Column]:
    """Number of words and of distinct words, case-sensitive."""
    pieces = F.split(text, SPACE)
    return F.size(F.array_remove(pieces, "")), F.size(F.array_remove(F.array_distinct(pieces), ""))


def too_short(text: Column, words: int = 200) -> Column:
    return word_counts(text)[0] < words


def repetitive(text: Column, percent: int = 50) -> Column:
    words, distinct = word_counts(text)
    return 100 * distinct.cast("long") < percent * words


def shouting(text: Column, percent: int = 2) -> Column:
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return 100 * capitals.cast("long") > percent * F.length(text)


def has_symbols(text: Column, symbols: str = "#$%&*|") -> Column:
    return reduce(Column.__or__, [F.contains(text, F.lit(symbol)) for symbol in symbols])


#: Filters that look at one text; the one after them in FILTERS fails copies of a smaller id.
TEXT_FILTERS: tuple[tuple[str, Callable[[Column], Column]], ...] = (
    ("A", too_short), ("B", repetitive), ("C", shouting), ("D", has_symbols),
)
COPIES = "E"


def mask_cells(
    docs: DataFrame, labels: DataFrame, filters=TEXT_FILTERS, text: str = "text", part: str = "source", key: str = "doc_id"
) -> DataFrame:
    """Documents by part and failure mask: rows, good ones, toxic ones. Bit i is filter i; the last bit is copies."""
    whole = F.coalesce(F.col(text), F.lit(""))
    mask = sum((F.when(fails(whole), 1 << i).otherwise(0) for i, (_, fails) in enumerate(filters)), F.lit(0))
    rows = docs.select(
        F.col(key).alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(whole, 256)).alias("digest"), mask.alias("mask"),
    )
    rows = rows.groupBy("id", "part", "digest", "mask").agg(F.count("*").alias("n"))
    marks = labels.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("id")).agg(
        F.coalesce(F.max((F.col("quality") == 1).cast("int")), F.lit(0)).alias("is_good"),
        F.coalesce(F.max((F.col("toxic") == 1).cast("int")), F.lit(0)).alias("is_toxic"),
    )
    spread = F.when(F.col("id").isNull(), F.pmod(F.xxhash64("digest", "part"), F.lit(SPREAD))).otherwise(0)
    marked = rows.withColumn("salt", spread).join(marks.withColumn("salt", F.lit(0).cast("long")), ["id", "salt"], "left")
    marked = marked.select(
        "id", "part", "digest", "mask", "n",
        *[(F.col("n") * F.coalesce(F.col(f"is_{c}"), F.lit(0))).alias(c) for c in COUNTS[1:]],
    )
    # Rows of the least id of a text in a part stay beside the sums: they are the ones that may be no copies.
    own = F.when(F.col("id").isNotNull(), F.struct("id", *COUNTS))
    groups = marked.groupBy("digest", "part", "mask").agg(
        *[F.sum(c).alias(c) for c in COUNTS], F.min(own).alias("least"),
        F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("unnamed"),
    )
    # A text has at most one row per part here.
    groups = groups.withColumn("least_id", F.min("least.id").over(Window.partitionBy("digest")))
    first = F.coalesce(F.col("least.id") == F.col("least_id"), F.lit(False))
    kept = {c: F.when(first, F.col(f"least.{c}")).otherwise(0) for c in COUNTS}
    kept["n"] = kept["n"] + F.col("unnamed")
    bit = 1 << len(filters)
    split = groups.select(
        "part",
        F.explode(
            F.array(
                F.struct(F.col("mask"), *[kept[c].alias(c) for c in COUNTS]),
                F.struct((F.col("mask") + bit).alias("mask"), *[(F.col(c) - kept[c]).alias(c) for c in COUNTS]),
            )
        ).alias("cell"),
    )
    return split.groupBy("part", F.col("cell.mask").alias("mask")).agg(*[F.sum(f"cell.{c}").alias(c) for c in COUNTS])


def survivors(cells: np.ndarray, k: int) -> np.ndarray:
    """What is left of cells[part, mask, count] under each set of filters: [part, set, count], by a Gray-code walk."""
    fails = [np.flatnonzero((np.arange(1 << k) >> f) & 1) for f in range(k)]
    active = np.zeros(1 << k, dtype=np.int64)
    states = np.empty_like(cells)
    running = cells.sum(axis=1)
    states[:, 0] = running
    chosen = 0
    for step in range(1, 1 << k):
        f = (step & -step).bit_length() - 1
        chosen ^= 1 << f
        touched = fails[f]
        if chosen >> f & 1:
            running = running - cells[:, touched[active[touched] == 0]].sum(axis=1)
            active[touched] += 1
        else:
            active[touched] -= 1
            running = running + cells[:, touched[active[touched] == 0]].sum(axis=1)
        states[:, chosen] = running
    return states


def order_rows(states: np.ndarray, names: str) -> dict[str, np.ndarray]:
    """All figures of all orders as [part, order * step] arrays, and the names of orders, from the survivors."""
    k = len(names)
    everything = (1 << k) - 1
    orders = list(permutations(range(k)))
    filters = np.array(orders)
    after = np.cumsum(1 << filters, axis=1)
    before = after - (1 << filters)
    left, lost = states[:, after], states[:, before] - states[:, after]
    alone = states[:, everything ^ (1 << filters), 0] - states[:, [everything], 0][:, :, None]
    failing = states[:, [0], 0][:, :, None] - states[:, 1 << filters, 0]
    shares = np.zeros((len(states), k), dtype=np.int64)
    for f in range(k):
        for subset in range(1 << k):
            if not subset >> f & 1:
                size = subset.bit_count()
                weight = factorial(size) * factorial(k - 1 - size)
                shares[:, f] += weight * (states[:, subset, 0] - states[:, subset | 1 << f, 0])
    figures = {
        "kept": left[..., 0], "removed": lost[..., 0], "redundant": failing - lost[..., 0], "unique_fails": alone,
        "good_lost": lost[..., 1], "toxic_lost": lost[..., 2], "shapley": shares[:, filters],
    }
    flat = {name: values.reshape(len(states), -1) for name, values in figures.items()}
    flat["filter_order"] = np.repeat(["".join(names[f] for f in order) for order in orders], k)
    flat["step"] = np.tile(np.arange(1, k + 1, dtype=np.int32), len(orders))
    return flat


FIGURES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def audit(cells: DataFrame, names: str) -> DataFrame:
    """A row per part, order of filters and step, from the cells of `mask_cells`; names holds a letter per bit."""
    k = len(names)
    masks = range(1 << k)
    packed = cells.groupBy("part").agg(
        F.array(*[F.coalesce(F.sum(F.when(F.col("mask") == m, F.col(c))), F.lit(0)) for m in masks for c in COUNTS]).alias("cells")
    )
    schema = pa.schema(
        [("part", pa.string()), ("filter_order", pa.string()), ("step", pa.int32()), *[(c, pa.int64()) for c in FIGURES]]
    )

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                some = batch.slice(start, SLICE)
                counts = some.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                flat = order_rows(survivors(counts.reshape(some.num_rows, 1 << k, len(COUNTS)), k), names)
                per_part = len(flat["step"])
                columns = [
                    some.column(0).take(pa.array(np.repeat(np.arange(some.num_rows), per_part))),
                    pa.array(np.tile(flat["filter_order"], some.num_rows)),
                    pa.array(np.tile(flat["step"], some.num_rows)),
                    *[pa.array(flat[c].ravel()) for c in FIGURES],
                ]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema)], schema=schema)

    kinds = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in FIGURES)
    return packed.mapInArrow(rows, kinds)


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The five filters over documents (doc_id, text, source) with labels (doc_id, quality, toxic), in all orders."""
    return audit(mask_cells(docs, labels), "".join(name for name, _ in TEXT_FILTERS) + COPIES)
