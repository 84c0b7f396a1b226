"""Table maintenance: upserts, flags, status changes, deletes, checks and health counts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewlens import schemas as S
from reviewlens.operators.ordered import last_per_key


def ensure_columns(df: DataFrame | None, schema: T.StructType, spark=None) -> DataFrame:
    """The frame with every schema column; missing ones are null, a missing table is empty."""
    if df is None:
        return spark.createDataFrame([], schema)
    have = set(df.columns)
    return df.select(
        *[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema]
    )


def upsert(
    base: DataFrame,
    delta: DataFrame,
    keys: Sequence[str],
    as_of: Column | None = None,
    stamp: Sequence[str] = ("updated_at",),
    order: Sequence[str] | None = None,
) -> DataFrame:
    """Rows of `delta` replace the columns they carry, whatever their value; other columns keep theirs.

    The delta's column list decides what is replaced, so a null in it overwrites. With `order`, the last delta
    row per key counts; without it the delta must hold each key once.
    """
    if order:
        delta = last_per_key(delta, keys, order).drop(*[c for c in order if c not in base.columns])
    supplied = [c for c in delta.columns if c not in keys]
    right = delta.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *[F.col(c).alias(f"_d_{c}") for c in supplied])
    right = right.withColumn("_hit", F.lit(True))
    on = base[keys[0]].eqNullSafe(right[f"_k_{keys[0]}"])
    for k in keys[1:]:
        on = on & base[k].eqNullSafe(right[f"_k_{k}"])
    hit = F.coalesce(F.col("_hit"), F.lit(False))
    out = []
    for field in base.schema:
        name = field.name
        if name in keys:
            value = F.when(hit, F.col(f"_k_{name}")).otherwise(F.col(name))
        elif name in supplied:
            value = F.when(hit, F.col(f"_d_{name}").cast(field.dataType)).otherwise(F.col(name))
        elif as_of is not None and name in stamp:
            value = F.when(hit, as_of.cast(field.dataType)).otherwise(F.col(name))
        else:
            value = F.col(name)
        out.append(value.alias(name))
    return base.join(right, on, "full_outer").select(*out)


def append_snapshot(snapshots: DataFrame, items: DataFrame, as_of: Column) -> DataFrame:
    new = items.select(
        F.col("id").alias("item_id"), as_of.alias("captured_at"), "rating", "rating_count", "install_count"
    )
    return snapshots.unionByName(ensure_columns(new, snapshots.schema))


def sticky_flag(base: DataFrame, hits: DataFrame, keys: Sequence[str], flag: str = "helpful_ranked") -> DataFrame:
    """Set the flag for the listed keys; a flag once set stays."""
    marks = hits.select(*keys).distinct().withColumn("_hit", F.lit(True))
    value = F.coalesce(F.col(flag), F.lit(False)) | F.coalesce(F.col("_hit"), F.lit(False))
    return base.join(marks, list(keys), "left").withColumn(flag, value).select(*base.columns)


def transition(
    base: DataFrame,
    keys_df: DataFrame,
    status: str,
    error: Column | str | None = None,
    key: str = "item_id",
    insert_missing: bool = True,
    error_length: int | None = None,
) -> DataFrame:
    """New status for the listed keys; results stay. With `error_length`, messages are stored to so many characters."""
    message = F.lit(None).cast("string") if error is None else error if isinstance(error, Column) else F.lit(error)
    if error_length is not None:
        message = F.substring(message, 1, error_length)
    delta = keys_df.select(key, F.lit(status).alias("status"), message.alias("error")).dropDuplicates([key])
    if not insert_missing:
        delta = delta.join(base.select(key), key, "left_semi")
    return upsert(base, delta, [key])


def delete_cascade(
    parent: DataFrame,
    children: Mapping[str, DataFrame],
    gone: DataFrame,
    key: str = "id",
    child_key: str = "item_id",
    set_null: Sequence[str] = ("successor_of",),
) -> dict[str, DataFrame]:
    """Delete parents; children go with them and references to them become null."""
    keys = gone.select(key).distinct()
    kept = parent.join(keys, key, "left_anti")
    for column in set_null:
        dead = keys.select(F.col(key).alias(column), F.lit(True).alias("_dead"))
        kept = (
            kept.join(dead, column, "left")
            .withColumn(column, F.when(F.col("_dead").isNull(), F.col(column)))
            .select(*parent.columns)
        )
    child_keys = keys.select(F.col(key).alias(child_key))
    out = {name: child.join(child_keys, child_key, "left_anti") for name, child in children.items()}
    return {"parent": kept, **out}


def validate(checks: Mapping[str, tuple[DataFrame, Column]], unique=(), foreign=()) -> DataFrame:
    """Violations per rule.

    `checks` maps a rule to (frame, condition that must hold); `unique` holds (rule, frame, columns) and `foreign`
    holds (rule, child, child column, parent, parent column). Rules over one frame share one scan.
    """
    by_frame: dict[int, tuple[DataFrame, list[tuple[str, Column]]]] = {}
    for rule, (df, holds) in checks.items():
        by_frame.setdefault(id(df), (df, []))[1].append((rule, holds))
    parts = []
    for df, rules in by_frame.values():
        counts = df.agg(*[F.count_if(~F.coalesce(h, F.lit(False))).alias(r) for r, h in rules])
        pairs = ", ".join(f"'{r}', `{r}`" for r, _ in rules)
        parts.append(counts.selectExpr(f"stack({len(rules)}, {pairs}) as (rule, violations)"))
    for rule, df, columns in unique:
        repeated = df.groupBy(*columns).count().filter("count > 1")
        parts.append(repeated.agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("violations"))
                     .select(F.lit(rule).alias("rule"), F.col("violations").cast("long").alias("violations")))
    for rule, child, column, parent, parent_key in foreign:
        used = child.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("_fk")).count()
        orphans = used.join(parent.select(F.col(parent_key).alias("_fk")), "_fk", "left_anti")
        parts.append(orphans.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("violations"))
                     .select(F.lit(rule).alias("rule"), F.col("violations").cast("long").alias("violations")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def table_health(
    tables: Mapping[str, DataFrame], dives: DataFrame, analyses: DataFrame, studies: DataFrame
) -> DataFrame:
    """(probe, n): rows per table, dives and analyses per status, studies per layer and status."""
    parts = [
        df.agg(F.count("*").alias("n")).select(F.concat(F.lit("rows "), F.lit(name)).alias("probe"), "n")
        for name, df in tables.items()
    ]

    def spread(df: DataFrame, named: Mapping[str, Column]) -> DataFrame:
        counts = df.agg(*[F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in named.items()])
        pairs = ", ".join(f"'{n}', `{n}`" for n in named)
        return counts.selectExpr(f"stack({len(named)}, {pairs}) as (probe, n)")

    status = F.col("status")
    parts.append(spread(dives, {f"dives {s}": status == s for s in S.STATUSES}))
    parts.append(
        spread(
            analyses,
            {
                "analyses done": status == "done",
                "analyses error": status == "error",
                "analyses low legitimacy": F.col("legitimacy") < S.LOW_LEGITIMACY,
            },
        )
    )
    parts.append(
        spread(
            studies,
            {
                f"studies layer {layer} {s}": (F.col("layer") == layer) & (status == s)
                for layer in (2, 3)
                for s in ("queued", "done")
            },
        )
    )
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def ingest_stats(log: DataFrame, counters: Sequence[str], name: str = "counter", amount: str | None = None) -> DataFrame:
    """One row with a column per counter; counters the log never names are zero."""
    step = F.lit(1) if amount is None else F.col(amount)
    sums = [F.coalesce(F.sum(F.when(F.col(name) == c, step)), F.lit(0)).cast("long").alias(c) for c in counters]
    return log.agg(*sums)
