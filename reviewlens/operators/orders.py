"""Order records: from item rows, across accounts, and across scan pages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewlens import schemas as S
from reviewlens.functions.parsing import _c
from reviewlens.operators.ordered import first_per_key, last_per_key


def order_key(df_titles: str = "item_titles") -> Column:
    """The order id, else date, cents and first title."""
    fallback = F.concat_ws(
        "|",
        F.coalesce(F.col("order_date").cast("string"), F.lit("")),
        F.coalesce(F.col("total_cents").cast("string"), F.lit("")),
        F.coalesce(F.get(F.col(df_titles), F.lit(0)), F.lit("")),
    )
    return F.when(F.coalesce(F.col("order_id"), F.lit("")) != "", F.col("order_id")).otherwise(fallback)


def orders_from_items(items: DataFrame, keys: Sequence[str] = ("order_id",), titles: int = S.TITLES_KEPT) -> DataFrame:
    """Item rows (order_id, order_date, cents, title, status, row_no) to one row per order.

    Cancelled rows and rows without id or date go; the first `titles` distinct titles of an order are listed in row order.
    Rows are combined per order and title first, so that what follows is shuffled once more and by order alone.
    """
    keys = list(keys)
    status = F.lower(F.coalesce(F.col("status"), F.lit("")))
    kept = (
        items.withColumn("order_id", F.trim("order_id"))
        .filter((F.coalesce(F.col("order_id"), F.lit("")) != "") & F.col("order_date").isNotNull())
        .filter(~status.contains("cancel"))
    )
    lines = kept.groupBy(*keys, F.coalesce(F.trim("title"), F.lit("")).alias("title")).agg(
        F.min("row_no").alias("row_no"),
        F.min("order_date").alias("order_date"),
        F.sum(F.coalesce("cents", F.lit(0))).alias("cents"),
        F.bool_or(status.rlike("return|refund")).alias("hint"),
    )
    # A row number per order, blank titles last; all but the listed titles are dropped before they are collected.
    order = Window.partitionBy(*keys).orderBy(F.col("title") == "", "row_no", "title")
    placed = lines.withColumn("rank", F.row_number().over(order))
    listed = F.when((F.col("rank") <= titles) & (F.col("title") != ""), F.struct("rank", "title"))
    orders = placed.groupBy(*keys).agg(
        F.min("order_date").alias("order_date"),
        F.sum("cents").cast("long").alias("total_cents"),
        F.bool_or("hint").alias("return_hint"),
        F.sort_array(F.collect_list(listed)).alias("_t"),
    )
    names = F.transform("_t", lambda x: x["title"]).alias("item_titles")
    return orders.filter("total_cents > 0").select(*keys, "order_date", "total_cents", names, "return_hint")


def _merge(rows: DataFrame, keys: Sequence[str], order: Sequence[str], pick) -> DataFrame:
    """One row per key by `pick`, with the return hint OR-ed over all of them."""
    hint = F.bool_or(F.coalesce(F.col("return_hint"), F.lit(False)))
    return pick(rows, keys, order, {"return_hint": hint})


def union_orders(store: DataFrame, order: Sequence[str] = ("account",)) -> DataFrame:
    """All accounts' orders by key: each field from the last account that has it, a return hint from any."""
    keyed = store.withColumn("order_key", order_key())
    last = F.struct(*order)
    fields = [c for c in store.columns if c != "return_hint"]
    merged = keyed.groupBy("order_key").agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), last)).alias(c) for c in fields],
        F.bool_or(F.coalesce(F.col("return_hint"), F.lit(False))).alias("return_hint"),
    )
    return merged.select(*store.columns, "order_key")


def merge_account_orders(store: DataFrame, account: str, fresh: DataFrame, as_of: Column) -> DataFrame:
    """A fresh scrape into one account: older orders stay, scraped fields win, hints stay."""
    mine = F.coalesce(F.col("account") == account, F.lit(False))
    columns = store.columns
    old = store.filter(mine).withColumn("_seq", F.lit(0))
    new = fresh.withColumn("account", F.lit(account)).withColumn("_seq", F.lit(1))
    both = old.unionByName(new, allowMissingColumns=True).withColumn("order_key", order_key())
    order = ["_seq"] + [c for c in ("position",) if c in both.columns]
    merged = _merge(both, ["order_key"], order, last_per_key).withColumn("last_sync", as_of)
    return store.filter(~mine).unionByName(merged.select(*columns))


def forget_account(store: DataFrame, account: str) -> DataFrame:
    return store.filter(~F.coalesce(F.col("account") == account, F.lit(False)))


def merge_exports(parts: DataFrame, order: Sequence[str] = ("part_no",)) -> DataFrame:
    """Several export parts: the first part that has an order wins."""
    return first_per_key(parts, ["order_id"], order)


def account_summary(store: DataFrame, active: str | None = None) -> DataFrame:
    rows = store.groupBy("account").agg(F.count("*").alias("orders"), F.max("last_sync").alias("last_sync"))
    flagged = rows.withColumn("active", F.col("account").eqNullSafe(F.lit(active)))
    return flagged.orderBy(F.desc("active"), F.desc_nulls_last("last_sync"), "account")


def deepest_sync(records: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The record that reaches back furthest, overall or per key."""
    rest = [c for c in records.columns if c not in keys]
    best = records.groupBy(*keys).agg(
        F.min_by(F.struct(*rest), F.struct(-F.col("months"), *[F.col(c) for c in rest])).alias("_r")
    )
    return best.filter(F.col("_r").isNotNull()).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def effective_lookback(settings: DataFrame, done: DataFrame) -> DataFrame:
    """Months the next fetch covers: three once a deep fetch of that depth is done."""
    depth = done.groupBy("account").agg(F.max("months").alias("_done"))
    wanted = F.col("lookback_months")
    months = F.when((wanted > 3) & (F.coalesce("_done", F.lit(0)) >= wanted), 3).otherwise(wanted)
    return settings.join(depth, "account", "left").select("account", "lookback_months", months.alias("months"))


def lookback_cutoff(as_of: Column | str, months: Column | str) -> Column:
    return F.add_months(_c(as_of), -_c(months))


def lookback_filters(as_of: Column | str, months: Column | str) -> Column:
    """Year filters from this year back to the cutoff's; one null for the default page of three months."""
    this_year, last_year = F.year(_c(as_of)), F.year(lookback_cutoff(as_of, months))
    years = F.transform(F.sequence(this_year, last_year), lambda y: F.concat(F.lit("year-"), y.cast("string")))
    return F.when(_c(months) <= 3, F.array(F.lit(None).cast("string"))).otherwise(years)


def page_flags(pages: DataFrame, cutoff: Column) -> DataFrame:
    """Per page: all orders older than the cutoff, and a year filter that returned no order of its year."""
    wanted = F.regexp_extract("filter", r"^year-(\d{4})$", 1)
    rows = pages.groupBy("page_id", "filter").agg(
        F.count("order_date").alias("orders"),
        F.bool_and(F.col("order_date") < cutoff).alias("_older"),
        F.bool_or(F.year("order_date").cast("string") == wanted).alias("_same"),
    )
    some = F.col("orders") > 0
    return rows.select(
        "page_id", "filter", "orders",
        (some & F.coalesce("_older", F.lit(False))).alias("all_older"),
        (some & (F.coalesce(wanted, F.lit("")) != "") & ~F.coalesce("_same", F.lit(False))).alias("year_mismatch"),
    )


def merge_scan_pages(pages: DataFrame) -> DataFrame:
    """Scan rows (page_no, position, order fields): the first seen wins per key, hints are OR-ed."""
    keyed = pages.withColumn("order_key", order_key())
    return _merge(keyed, ["order_key"], ["page_no", "position"], first_per_key)


def new_per_page(pages: DataFrame) -> DataFrame:
    """New keys every page brought; a page with none is where the scan stops."""
    keyed = pages.withColumn("order_key", order_key())
    firsts = keyed.groupBy("order_key").agg(F.min("page_no").alias("page_no"))
    counts = firsts.groupBy("page_no").agg(F.count("*").alias("new_orders"))
    all_pages = keyed.groupBy("page_no").agg(F.count("*").alias("rows"))
    return all_pages.join(counts, "page_no", "left").select(
        "page_no", "rows", F.coalesce("new_orders", F.lit(0)).alias("new_orders")
    )


def sum_cents(df: DataFrame, column: str) -> Column:
    """Exact sum; anything but an integer column is refused when the plan is built."""
    kind = df.schema[column].dataType
    if not isinstance(kind, T.IntegralType):
        raise TypeError(f"{column} must hold integer cents, not {kind.simpleString()}")
    return F.coalesce(F.sum(column), F.lit(0)).cast("long")


def split_balances(splits: DataFrame, totals: DataFrame, key: str = "txn_id") -> DataFrame:
    """Whether the split amounts of a transaction add up to its total."""
    sums = splits.groupBy(key).agg(sum_cents(splits, "cents").alias("split_cents"))
    joined = totals.join(sums, key, "left").withColumn("split_cents", F.coalesce("split_cents", F.lit(0)))
    return joined.select(
        key, "total_cents", "split_cents", (F.col("split_cents") == F.col("total_cents")).alias("balanced")
    )
