"""Linking re-published items: same product under another id.

Pairs are never formed. Items that agree on a set of fields share a composite key, and all a successor needs from
its key is the oldest item there, so each key is reduced to its two oldest ids before anything is joined.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlens.functions.identity import MATCH_FIELDS, normalize_identity
from reviewlens.operators.ordered import top_per_key
from reviewlens.operators.tables import upsert


def _normalized(items: DataFrame) -> DataFrame:
    ext = F.coalesce("ext_id", F.concat(F.lit("#"), F.col("id").cast("string")))
    return items.select("id", ext.alias("ext_id"), *[normalize_identity(f).alias(f) for f in MATCH_FIELDS])


def _field_sets(threshold: int) -> list[tuple[str, ...]]:
    sizes = range(len(MATCH_FIELDS), threshold - 1, -1)
    return [fields for size in sizes for fields in combinations(MATCH_FIELDS, size)]


def _keyed(items: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    present = F.lit(True)
    for f in fields:
        present = present & (F.col(f) != "")
    return items.filter(present)


def _oldest_two(items: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """Per key the oldest item and the oldest one that carries another store id."""
    per_ext = _keyed(items, fields).groupBy(*fields, "ext_id").agg(F.min("id").alias("id"))
    two = top_per_key(per_ext, list(fields), [F.asc("id")], 2)
    return two.groupBy(*fields).agg(
        F.max(F.when(F.col("rank") == 1, F.struct("ext_id", "id"))).alias("_a"),
        F.max(F.when(F.col("rank") == 2, F.struct("ext_id", "id"))).alias("_b"),
    )


def _best(items: DataFrame, pool: DataFrame, threshold: int, accept) -> DataFrame:
    """Best partner per item from `pool`: most agreeing fields, then lowest id."""
    # One pass per field set over narrow rows; an item reads one candidate row per set.
    found = items
    picks: list[Column] = []
    for i, fields in enumerate(_field_sets(threshold)):
        oldest = _oldest_two(pool, fields).select(
            *[F.col(f).alias(f"_k{i}_{f}") for f in fields], F.col("_a").alias(f"_a{i}"), F.col("_b").alias(f"_b{i}")
        )
        on = F.lit(True)
        for f in fields:
            on = on & (F.col(f) == F.col(f"_k{i}_{f}"))
        # Both sides grow with the items: a hash table of one is no task's to hold.
        found = found.join(oldest.hint("merge"), on, "left").drop(*[f"_k{i}_{f}" for f in fields])
        other = F.when(F.col(f"_a{i}.ext_id") != F.col("ext_id"), F.col(f"_a{i}.id")).otherwise(F.col(f"_b{i}.id"))
        picks.append(
            F.when(
                accept(other),
                F.struct(
                    F.lit(-len(fields)).alias("size"), other.alias("id"),
                    F.array(*[F.lit(f) for f in fields]).alias("points"),
                ),
            )
        )
    best = F.array_min(F.array_compact(F.array(*picks)))
    return found.withColumn("_best", best).filter(F.col("_best").isNotNull())


def link_successors(items: DataFrame, threshold: int = 2) -> DataFrame:
    """(successor_id, predecessor_id, points): the newer id points at its strongest older match."""
    rows = _normalized(items)
    linked = _best(rows, rows, threshold, lambda other: other < F.col("id"))
    return linked.select(
        F.col("id").alias("successor_id"),
        F.col("_best.id").alias("predecessor_id"),
        F.col("_best.points").alias("points"),
    )


def find_successor_match(candidates: DataFrame, existing: DataFrame, threshold: int = 2) -> DataFrame:
    """For each candidate the stored item under another store id that agrees most."""
    matched = _best(_normalized(candidates), _normalized(existing), threshold, lambda other: other.isNotNull())
    return matched.select(
        F.col("id").alias("candidate_id"), F.col("_best.id").alias("match_id"), F.col("_best.points").alias("points")
    )


def write_links(items: DataFrame, links: DataFrame) -> DataFrame:
    """Links stored on the newer row."""
    delta = links.select(
        F.col("successor_id").alias("id"),
        F.col("predecessor_id").alias("successor_of"),
        F.col("points").alias("successor_points"),
    )
    return upsert(items, delta, ["id"])
