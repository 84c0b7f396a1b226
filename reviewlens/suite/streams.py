"""Streaming jobs run over staged files until all are read, and compared with their batch twins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlens.adapters import Data
from reviewlens.operators.store import PACKED
from reviewlens.session import brief_shuffles, shared_folder, spread
from reviewlens.streaming import jobs
from reviewlens.suite.registry import case

LAST = "2100-01-01"  # one row at this time closes every window before it


def _stage(df: DataFrame, folder: str, name: str, files: int | None = None, per_batch: int | None = None) -> DataFrame:
    (df if files is None else df.repartition(files)).write.parquet(f"{folder}/{name}")
    return jobs.read_files(df.sparkSession, f"{folder}/{name}", df.schema, per_batch)


def _stage_in_order(df: DataFrame, folder: str, name: str, batches: int, order: Sequence[str]) -> DataFrame:
    """A stream of so many batches by order. A batch has as many files as its rows fill, each written and read by a task."""
    df = spread(df)
    per_batch = -(-df._jdf.queryExecution().toRdd().getNumPartitions() // batches)
    with brief_shuffles(df.sparkSession):
        df.repartitionByRange(batches * per_batch, *order).write.options(**PACKED).parquet(f"{folder}/{name}")
    return jobs.read_files(df.sparkSession, f"{folder}/{name}", df.schema, per_batch)


@case(
    "stream_review_ingest",
    """
select item_id, pass_uid as review_uid, stars, author, flag as helpful_ranked from (
  select *, bool_or(helpful_ranked) over (partition by item_id, pass_uid) as flag,
    row_number() over (partition by item_id, pass_uid order by coalesce(reviewed_at, date '1995-01-01') desc, review_uid desc) as rn
  from {v_reviews}) where rn = 1""",
)
def stream_review_ingest(d: Data):
    folder = shared_folder(d.spark, "ingest")
    scraped = F.coalesce("reviewed_at", F.lit("1995-01-01").cast("date")).cast("timestamp")
    rows = d.reviews.select(
        "item_id", F.col("pass_uid").alias("review_uid"), F.col("review_uid").alias("position"), "author", "stars",
        "helpful_ranked", scraped.alias("scraped_at"),
    )
    # The uid parts the reviews of a day, however many there are.
    stream = _stage_in_order(rows, folder, "in", 3, ["scraped_at", "position"])
    jobs.ingest_reviews(stream, f"{folder}/store", f"{folder}/state", order=("scraped_at", "position"), buckets=8, keep=1)
    out = jobs.read_reviews(d.spark, f"{folder}/store")
    return out.select("item_id", "review_uid", "stars", "author", "helpful_ranked")


@case(
    "stream_snapshots",
    "select item_id, cast(captured_at as varchar) as captured_at, rating, rating_count, install_count from {v_snaps}",
)
def stream_snapshots(d: Data):
    folder = shared_folder(d.spark, "snapshots")
    stream = _stage(d.table("v_snaps"), folder, "in", files=4, per_batch=2)
    jobs.append_snapshots(stream, f"{folder}/store", f"{folder}/state")
    return d.spark.read.parquet(f"{folder}/store").withColumn("captured_at", F.col("captured_at").cast("string"))


@case(
    "stream_complaint_share",
    """
select item_id, cast(date '1970-01-01' + cast(floor(date_diff('day', date '1970-01-01', reviewed_at) / 180) * 180 as int) as varchar) as window_start,
  count(*) as reviews, count(*) filter (where stars <= 2) as negative, cast(count(*) filter (where stars <= 2) as double) / count(*) as share
from {v_reviews} where reviewed_at is not null group by 1, 2""",
)
def stream_complaint_share(d: Data):
    folder = shared_folder(d.spark, "share")
    rows = d.reviews.filter("reviewed_at is not null").select(
        "item_id", "stars", F.col("reviewed_at").cast("timestamp").alias("reviewed_ts")
    )
    closing = d.spark.range(1).select(
        F.lit(-1).cast("long").alias("item_id"), F.lit(1).alias("stars"), F.lit(LAST).cast("timestamp").alias("reviewed_ts")
    )
    stream = _stage(rows.unionByName(closing), folder, "in")
    jobs.stream_complaint_share(stream, f"{folder}/store", f"{folder}/state", "0 days")
    out = d.spark.read.parquet(f"{folder}/store").filter("item_id >= 0")
    return out.withColumn("window_start", F.col("window_start").cast("string"))


@case(
    "stream_share_late_rows",
    """
select item_id, cast(date '1970-01-01' + cast(floor(date_diff('day', date '1970-01-01', reviewed_at) / 180) * 180 as int) as varchar) as window_start,
  count(*) as reviews, count(*) filter (where stars <= 2) as negative, cast(count(*) filter (where stars <= 2) as double) / count(*) as share
from {v_reviews} where reviewed_at is not null group by 1, 2""",
)
def stream_share_late_rows(d: Data):
    """The first months come again, with one star, half a year behind the watermark of a run before: all of them are lost."""
    folder = shared_folder(d.spark, "late-share")
    rows = d.reviews.filter("reviewed_at is not null").select(
        "item_id", "stars", F.col("reviewed_at").cast("timestamp").alias("reviewed_ts")
    )
    late = rows.filter("reviewed_ts < '1995-05-01'").withColumn("stars", F.lit(1))
    closing = d.spark.range(1).select(
        F.lit(-1).cast("long").alias("item_id"), F.lit(1).alias("stars"), F.lit(LAST).cast("timestamp").alias("reviewed_ts")
    )
    dropped = 0
    for part in (rows.filter("reviewed_ts < '1996-01-01'"), rows.filter("reviewed_ts >= '1996-01-01'").unionByName(late), closing):
        part.write.mode("append").parquet(f"{folder}/in")
        # Each run begins at the checkpoint of the one before.
        stream = jobs.read_files(d.spark, f"{folder}/in", rows.schema)
        dropped += jobs.stream_complaint_share(stream, f"{folder}/store", f"{folder}/state", "0 days")
    if not dropped:
        raise AssertionError("no late row was dropped")
    out = d.spark.read.parquet(f"{folder}/store").filter("item_id >= 0")
    return out.withColumn("window_start", F.col("window_start").cast("string"))


@case(
    "stream_match",
    "select txn_id, candidate_count, day_diff, order_id, status from {c_charges} where amount_cents < 0",
)
def stream_match(d: Data):
    folder = shared_folder(d.spark, "match")
    last = F.lit(LAST).cast("timestamp")
    charges = d.txns.select("txn_id", F.col("txn_date").cast("timestamp").alias("txn_ts"), "amount_cents")
    orders = d.orders.select("order_id", F.col("order_date").cast("timestamp").alias("order_ts"), "total_cents")
    one = d.spark.range(1)
    charges = charges.unionByName(one.select(F.lit("").alias("txn_id"), last.alias("txn_ts"), F.lit(-1).cast("long").alias("amount_cents")))
    orders = orders.unionByName(one.select(F.lit("").alias("order_id"), last.alias("order_ts"), F.lit(1).cast("long").alias("total_cents")))
    jobs.stream_match(
        _stage(charges, folder, "charges"), _stage(orders, folder, "orders"), f"{folder}/store", f"{folder}/state",
        delay_days=0,
    )
    return jobs.matched_charges(d.spark.read.parquet(f"{folder}/store")).filter("txn_id <> ''")


@case(
    "stream_match_late_rows",
    "select txn_id, candidate_count, day_diff, order_id, status from {c_charges} where amount_cents < 0",
)
def stream_match_late_rows(d: Data):
    """The first orders come again under lower ids, half a year behind the watermark of a run before: no charge meets them."""
    folder = shared_folder(d.spark, "late-match")
    charges = d.txns.select("txn_id", F.col("txn_date").cast("timestamp").alias("txn_ts"), "amount_cents")
    orders = d.orders.select("order_id", F.col("order_date").cast("timestamp").alias("order_ts"), "total_cents")
    late = orders.filter("order_ts < '1995-03-01'").withColumn("order_id", F.concat(F.lit("a-"), F.col("order_id")))
    one, last = d.spark.range(1), F.lit(LAST).cast("timestamp")
    runs = (
        (charges.filter("txn_ts < '1996-01-01'"), orders.filter("order_ts < '1996-01-01'")),
        (charges.filter("txn_ts >= '1996-01-01'"), orders.filter("order_ts >= '1996-01-01'").unionByName(late)),
        (
            one.select(F.lit("").alias("txn_id"), last.alias("txn_ts"), F.lit(-1).cast("long").alias("amount_cents")),
            one.select(F.lit("").alias("order_id"), last.alias("order_ts"), F.lit(1).cast("long").alias("total_cents")),
        ),
    )
    dropped = 0
    for new_charges, new_orders in runs:
        new_charges.write.mode("append").parquet(f"{folder}/charges")
        new_orders.write.mode("append").parquet(f"{folder}/orders")
        # Charges and orders of one day may come in two runs: orders wait for them a month.
        dropped += jobs.stream_match(
            jobs.read_files(d.spark, f"{folder}/charges", charges.schema), jobs.read_files(d.spark, f"{folder}/orders", orders.schema),
            f"{folder}/store", f"{folder}/state", delay_days=30,
        )
    if not dropped:
        raise AssertionError("no late row was dropped")
    return jobs.matched_charges(d.spark.read.parquet(f"{folder}/store")).filter("txn_id <> ''")
