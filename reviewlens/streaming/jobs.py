"""Incremental jobs: review ingest, snapshots, complaint share and charge matching.

Every job takes streaming frames and folders. Reviews are merged into a keyed table batch by batch; the other sinks are
append-only tables of Spark's own file sink. A replayed batch changes neither.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewlens import schemas as S
from reviewlens.operators.ordered import first_per_key, last_per_key
from reviewlens.operators.store import KeyedTable
from reviewlens.session import brief_shuffles


def read_files(spark: SparkSession, folder: str, schema: T.StructType, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).format("parquet")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(folder)


def _finish(writer, checkpoint: str) -> int:
    """Run until all input is read; how many rows came behind the watermark and were dropped.

    Rows that were combined before they reached the state count as one.
    """
    query = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return sum(op.numRowsDroppedByWatermark for p in query.recentProgress for op in p.stateOperators)


# --- reviews -----------------------------------------------------------------------------------

REVIEW_KEYS = ("item_id", "review_uid")


def current_reviews(rows: DataFrame, keys=REVIEW_KEYS, order=("scraped_at",)) -> DataFrame:
    """One row per review: the last scrape wins, a helpful flag once set stays."""
    flag = F.bool_or(F.coalesce(F.col("helpful_ranked"), F.lit(False)))
    return last_per_key(rows, list(keys), list(order), {"helpful_ranked": flag})


def ingest_reviews(
    stream: DataFrame, store: str, checkpoint: str, order=("scraped_at",), buckets: int = 64, bucket_by=("item_id",), keep: int = 2,
) -> None:
    """Upsert every batch of scraped reviews into the keyed table at `store`; `read_reviews` gives its rows.

    A late scrape loses against a newer one that is already there, so batches may come in any order, and no state is held.
    A batch that is replayed after a crash changes nothing. After each batch the last `keep` versions stay: the one before
    the last is for readers that have begun.
    """
    target = KeyedTable(stream.sparkSession, store)
    if not target.exists():
        target.create(stream.schema, REVIEW_KEYS, bucket_by, buckets)

    def write(batch: DataFrame, number: int) -> None:
        # Repeats inside the batch are folded first, with the combining aggregate, then those with stored rows.
        # The later of equals counts.
        target.fold(
            current_reviews(batch, order=order), lambda rows, by: current_reviews(rows, by, (*order, "_new")), number, checkpoint
        )
        target.clean(keep)

    with brief_shuffles(stream.sparkSession):
        _finish(stream.writeStream.foreachBatch(write), checkpoint)


def read_reviews(spark: SparkSession, store: str) -> DataFrame:
    return KeyedTable(spark, store).read()


# --- snapshots ----------------------------------------------------------------------------------


def append_snapshots(stream: DataFrame, store: str, checkpoint: str) -> None:
    """Item scrapes to the snapshot table, each exactly once."""
    rows = stream.select("item_id", "captured_at", "rating", "rating_count", "install_count")
    _finish(rows.writeStream.format("parquet").option("path", store).outputMode("append"), checkpoint)


# --- complaint share --------------------------------------------------------------------------------


def complaint_share(reviews: DataFrame, days: int = S.TREND_RECENT_DAYS) -> DataFrame:
    """Share of negative reviews per item and tumbling window; the same plan for tables and streams.

    Reviews are first counted per item and window, so one busy item is combined before it is shuffled.
    """
    windowed = reviews.filter(F.col("stars").isNotNull()).groupBy(
        "item_id", F.window("reviewed_ts", f"{days} days").alias("w")
    )
    counts = windowed.agg(
        F.count("*").alias("reviews"), F.count_if(F.col("stars") <= S.NEGATIVE_STARS).alias("negative")
    )
    return counts.select(
        "item_id", F.col("w.start").cast("date").alias("window_start"), "reviews", "negative",
        (F.col("negative") / F.col("reviews")).alias("share"),
    )


def stream_complaint_share(stream: DataFrame, store: str, checkpoint: str, delay: str = "7 days") -> int:
    """Windows that the watermark has passed are appended to the store; returns the dropped late rows."""
    rows = complaint_share(stream.withWatermark("reviewed_ts", delay))
    return _finish(rows.writeStream.format("parquet").option("path", store).outputMode("append"), checkpoint)


# --- charges and orders --------------------------------------------------------------------------------


DAY_SECONDS = 24 * 60 * 60


def _day(moment: str) -> Column:
    """Days since 1970 in UTC, as stream windows have them."""
    return F.floor(F.unix_seconds(moment) / DAY_SECONDS).cast("int")


def candidate_days(
    charges: DataFrame, orders: DataFrame, window: int = S.CHARGE_AFTER_DAYS, back: int = S.CHARGE_BACK_DAYS,
    delay_days: int = 7,
) -> DataFrame:
    """Per charge and day of its window that has orders of its amount: how many and the lowest order id; without any, one row.

    Time is cut into blocks as long as a charge's window. Orders are counted per (amount, day) and filed under the blocks
    whose charges may ask for that day: two at most. A charge is one state row, in its own block, and both sides meet on
    (amount, block): a common amount is spread over its blocks, and a charge reads at most two blocks less a day of its
    amount's days. No charge-order pairs are formed. An order that comes after one of its blocks was closed, but not the
    other, counts for the charges of the other.
    """
    span = window + back + 1
    first, last = [F.floor((F.col("day") + offset) / span) for offset in (-back, window)]
    both = F.array(F.lit(-back), F.lit(window))
    filed = (
        orders.withColumn("day", _day("order_ts"))
        .withColumn("offset", F.explode(F.when(first == last, F.slice(both, 1, 1)).otherwise(both)))
        .withColumn("filed_ts", F.col("order_ts") + F.make_dt_interval(F.col("offset")))
        .withWatermark("filed_ts", f"{delay_days + window + back} days")
    )
    days = filed.groupBy(F.window("filed_ts", f"{span} days").alias("w"), "day", F.col("total_cents").alias("order_cents")).agg(
        F.count("*").alias("n"), F.min("order_id").alias("order_id")
    )
    asked = (
        charges.filter(F.col("amount_cents") < 0)
        .withWatermark("txn_ts", f"{delay_days} days")
        .withColumn("asked", F.window("txn_ts", f"{span} days"))
        .select("txn_id", (-F.col("amount_cents")).alias("cents"), _day("txn_ts").alias("asked_day"), "asked")
    )
    gap = F.col("asked_day") - F.col("day")
    same = (F.col("cents") == F.col("order_cents")) & (F.col("asked") == F.col("w"))
    # Charges without an order come out too, once the watermark has passed their block, so that they are known.
    met = asked.join(days, same & gap.between(-back, window), "left")
    return met.select("txn_id", F.coalesce(gap, F.lit(0)).alias("day_diff"), F.coalesce("n", F.lit(0)).alias("n"), "order_id")


def stream_match(charges: DataFrame, orders: DataFrame, store: str, checkpoint: str, **options) -> int:
    """Candidate days that the watermarks have passed are appended to the store; returns the dropped late rows."""
    met = candidate_days(charges, orders, **options)
    return _finish(met.writeStream.format("parquet").option("path", store).outputMode("append"), checkpoint)


def matched_charges(met: DataFrame) -> DataFrame:
    """Candidate count, closest order and status of every charge; without a candidate it is unmatched."""
    order = [F.col("order_id").isNull(), F.abs("day_diff"), F.col("order_id")]
    closest = first_per_key(met, ["txn_id"], order, {"candidate_count": F.sum("n")})
    found = F.col("candidate_count") > 0
    status: Column = F.when(~found, "unmatched").when(F.col("candidate_count") == 1, "auto").otherwise("review")
    return closest.drop("n").withColumns({"status": status, "day_diff": F.when(found, F.col("day_diff"))})
