"""Bank transactions matched to orders by amount and date window.

An amount may be so common that charge-order pairs would explode. Nothing here forms pairs: orders are first reduced
to one row per (amount, day), and a range-framed window over those day rows counts candidates and finds the closest
one. A window partition then holds at most three rows per calendar day, however many orders share the amount.

A refund's window is months long. There, a day's orders are a row that adds their counts and a row that takes them off when
the window has passed: running sums count what is open, and the time does not depend on how many days have orders.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewlens import schemas as S
from reviewlens.functions.labels import is_store_merchant
from reviewlens.functions.notes import merchant_name, merge_notes, note_line
from reviewlens.operators.tables import ensure_columns
from reviewlens.session import settled

KEY = ["cents", "day"]
STATUS_ORDER = ("auto", "review", "unmatched", "refund")
RESULT = (
    "txn_id", "txn_date", "amount_cents", "kind", "status", "candidate_count", "day_diff", "refund_match",
    "order_id", "order_date", "order_cents", "item_titles", "return_hint",
)


def store_transactions(transactions: DataFrame, max_rows: int | None = None) -> DataFrame:
    """Store purchases with cents and defaults; the row cap is the reader's own option."""
    kept = transactions.filter(is_store_merchant("merchant_name")).select(
        F.coalesce("txn_id", F.lit("")).alias("txn_id"),
        "txn_date",
        F.floor(F.coalesce("amount", F.lit(0.0)) * 100 + 0.5).cast("long").alias("amount_cents"),
        F.coalesce("merchant_name", F.lit("")).alias("merchant_name"),
        F.coalesce("name", "merchant_name", F.lit("")).alias("name"),
        F.coalesce("notes", F.lit("")).alias("notes"),
    )
    return kept if max_rows is None else kept.orderBy(F.desc_nulls_last("txn_date"), "txn_id").limit(max_rows)


def within_lookback(orders: DataFrame, as_of: Column, months: int) -> DataFrame:
    return orders.filter(F.col("order_date") >= F.add_months(as_of, -months))


def order_days(orders: DataFrame) -> DataFrame:
    """(cents, day): order counts and the lowest order id, with and without a return hint."""
    full = ensure_columns(orders, S.ORDERS).filter(F.col("order_date").isNotNull() & F.col("total_cents").isNotNull())
    hint = F.coalesce(F.col("return_hint"), F.lit(False))
    order = F.struct(
        F.coalesce("order_id", F.lit("")).alias("order_id"), "order_date", F.col("total_cents").alias("order_cents"),
        "item_titles", hint.alias("return_hint"),
    )
    return full.groupBy(F.col("total_cents").alias("cents"), F.unix_date("order_date").alias("day")).agg(
        F.count("*").alias("n"),
        F.count_if(hint).alias("n_hinted"),
        F.min(order).alias("any"),
        F.min(F.when(hint, order)).alias("hinted"),
    )


def _with_probes(days: DataFrame, probes: DataFrame, key: list[str]) -> DataFrame:
    """Day rows and the days that are asked about, in one frame for the window."""
    asked = probes.select(*key, "day").distinct().withColumn("_asked", F.lit(True))
    return days.withColumn("_asked", F.lit(False)).unionByName(asked, allowMissingColumns=True)


def _charge_answers(probes: DataFrame, days: DataFrame, window: int, back: int) -> DataFrame:
    by_day = Window.partitionBy("cents").orderBy("day")
    rows = _with_probes(days, probes, ["cents"])
    rows = rows.withColumn("candidate_count", F.sum("n").over(by_day.rangeBetween(-window, back)))
    rows = rows.withColumn("_before", F.last("any", ignorenulls=True).over(by_day.rangeBetween(-window, 0)))
    if back > 0:
        after = F.first("any", ignorenulls=True).over(by_day.rangeBetween(1, back))
    else:
        after = F.col("any").isNull() & F.lit(False)
        after = F.when(after, F.col("any"))
    rows = rows.withColumn("_after", after)

    def distance(side: str) -> Column:
        gap = F.abs(F.col("day") - F.unix_date(f"{side}.order_date"))
        return F.when(F.col(side).isNotNull(), F.struct(gap.alias("gap"), F.col(f"{side}.order_id").alias("id")))

    nearer = F.col("_after").isNull() | (distance("_before") <= distance("_after"))
    best = F.when(F.col("_before").isNotNull() & nearer, F.col("_before")).otherwise(F.col("_after"))
    return rows.filter("_asked").select(*KEY, "candidate_count", best.alias("_order"))


def match_charges(
    transactions: DataFrame,
    orders: DataFrame,
    window: int = S.CHARGE_AFTER_DAYS,
    back: int = S.CHARGE_BACK_DAYS,
    days: DataFrame | None = None,
) -> DataFrame:
    """Money-out rows with the closest order of the same amount: one candidate auto, more review, none unmatched."""
    charges = transactions.filter(F.col("amount_cents") <= 0).withColumns(
        {"cents": -F.col("amount_cents"), "day": F.unix_date("txn_date")}
    )
    probes = charges.filter((F.col("cents") > 0) & F.col("day").isNotNull())
    answers = _charge_answers(probes, order_days(orders) if days is None else days, window, back)
    joined = charges.join(answers, KEY, "left").withColumns(
        {
            "candidate_count": F.coalesce("candidate_count", F.lit(0)),
            "kind": F.lit("charge"),
            "refund_match": F.lit(None).cast("string"),
        }
    )
    n = F.col("candidate_count")
    return _result(joined.withColumn("status", F.when(n == 0, "unmatched").when(n == 1, "auto").otherwise("review")))


def _result(joined: DataFrame) -> DataFrame:
    wide = joined.withColumn("day_diff", F.datediff("txn_date", "_order.order_date"))
    for field in ("order_id", "order_date", "order_cents", "item_titles", "return_hint"):
        wide = wide.withColumn(field, F.col(f"_order.{field}"))
    extra = [c for c in ("merchant_name", "name", "notes") if c in joined.columns]
    return wide.select(*RESULT, *extra)


def _with_expiry(days: DataFrame, window: int, counts: list[str]) -> DataFrame:
    """Day rows, and for each a row after its window that takes its counts off again and names no order."""
    kept = [c for c in days.columns if c in ("cents", "level", "block")]
    gone = days.select(*kept, (F.col("day") + window + 1).alias("day"), *[(-F.col(c)).alias(c) for c in counts])
    return days.unionByName(gone, allowMissingColumns=True)


def _so_far(*keys: str):
    """All days up to a row's own. The last order of them is in its window exactly when the window holds orders at all."""
    return Window.partitionBy(*keys).orderBy("day").rangeBetween(Window.unboundedPreceding, 0)


def _full_answers(probes: DataFrame, days: DataFrame, window: int) -> DataFrame:
    """Orders of exactly the refunded amount; a hinted one goes first, then the latest."""
    span = _so_far("cents")
    rows = _with_probes(_with_expiry(days, window, ["n", "n_hinted"]), probes, ["cents"]).withColumns(
        {
            "full_count": F.coalesce(F.sum("n").over(span), F.lit(0)),
            "full_hinted": F.coalesce(F.sum("n_hinted").over(span), F.lit(0)),
            "_hinted": F.last("hinted", ignorenulls=True).over(span),
            "_any": F.last("any", ignorenulls=True).over(span),
        }
    )
    order = F.when(F.col("full_hinted") > 0, F.col("_hinted")).when(F.col("full_count") > 0, F.col("_any"))
    return rows.filter("_asked").select(*KEY, "full_count", "full_hinted", order.alias("_full"))


def _partial_answers(probes: DataFrame, days: DataFrame, window: int) -> DataFrame:
    """Hinted orders with a larger total: how many, and the latest one.

    "Larger than" is cut into binary blocks. A total is larger than an amount exactly when, at the highest bit where
    they differ, the total has the one. So a total is filed under each of its one-bits (its prefix there), an amount
    asks at each of its zero-bits (its prefix plus one), and every larger total is met exactly once. Blocks carry an order's
    id and total only; the order itself comes from the row of its total and day at the end.
    """
    full = days.filter("n_hinted > 0")
    best = F.struct(F.col("hinted.order_id").alias("order_id"), F.col("cents").alias("cents"), F.col("day").alias("day"))
    hinted = full.select("cents", "day", F.col("n_hinted").alias("n"), best.alias("any"))
    bits = hinted.agg(F.coalesce(F.length(F.bin(F.max("cents"))), F.lit(1)).alias("bits")).scalar()

    def blocks(df: DataFrame, bit: int) -> DataFrame:
        levels = df.withColumn("level", F.explode(F.sequence(F.lit(0), bits - 1)))
        prefix = F.expr("shiftright(cents, level)")
        kept = levels.filter((prefix % 2) == bit)
        return kept.withColumn("block", prefix if bit else prefix + 1)

    filed = (
        blocks(hinted, 1).groupBy("level", "block", "day").agg(F.sum("n").alias("n"), F.min("any").alias("any"))
    )
    asks = blocks(probes.select(*KEY).distinct(), 0)
    span = _so_far("level", "block")
    rows = _with_probes(_with_expiry(filed, window, ["n"]), asks, ["level", "block"]).withColumns(
        {"_n": F.sum("n").over(span), "_last": F.last("any", ignorenulls=True).over(span)}
    )
    met = rows.filter(F.col("_asked") & (F.col("_n") > 0)).select("level", "block", "day", "_n", "_last")
    latest_first = F.struct(-F.col("_last.day"), F.col("_last.order_id"), F.col("_last.cents"))
    found = (
        asks.join(met, ["level", "block", "day"])
        .groupBy(*KEY)
        .agg(F.sum("_n").alias("partial_count"), F.min_by("_last", latest_first).alias("_last"))
    )
    orders = full.select(F.col("cents").alias("_cents"), F.col("day").alias("_day"), F.col("hinted").alias("_partial"))
    here = (F.col("_last.cents") == F.col("_cents")) & (F.col("_last.day") == F.col("_day"))
    return found.join(orders, here).select(*KEY, "partial_count", "_partial")


def match_refunds(
    transactions: DataFrame, orders: DataFrame, window: int = S.REFUND_DAYS, days: DataFrame | None = None
) -> DataFrame:
    """Money-in rows with the order they refund, in full or in part.

    The day rows and the full-refund answers are read more than once, so they are written once.
    """
    credits = transactions.filter(F.col("amount_cents") > 0).withColumns(
        {"cents": F.col("amount_cents"), "day": F.unix_date("txn_date")}
    )
    days = settled(order_days(orders)) if days is None else days
    full = settled(_full_answers(credits.filter(F.col("day").isNotNull()), days, window))
    partial = _partial_answers(full.filter("full_count = 0"), days, window)
    answers = full.join(partial, KEY, "left")
    joined = credits.join(answers, KEY, "left")
    is_full, is_partial = F.coalesce(F.col("full_count") > 0, F.lit(False)), F.col("partial_count").isNotNull()
    sure = (F.col("full_count") == 1) | (F.col("full_hinted") == 1)
    return _result(
        joined.withColumns(
            {
                "kind": F.lit("refund"),
                "refund_match": F.when(is_full, "full").when(is_partial, "partial"),
                "candidate_count": F.when(is_full, F.col("full_count")).otherwise(
                    F.coalesce("partial_count", F.lit(0))
                ),
                "status": F.when(is_full & sure, "auto").when(is_full | is_partial, "review").otherwise("refund"),
                "_order": F.when(is_full, F.col("_full")).otherwise(F.col("_partial")),
            }
        )
    )


def reconcile(
    transactions: DataFrame,
    orders: DataFrame,
    window: int = S.CHARGE_AFTER_DAYS,
    back: int = S.CHARGE_BACK_DAYS,
    refund_window: int = S.REFUND_DAYS,
) -> DataFrame:
    """Charges and refunds against one table of order days."""
    days = settled(order_days(orders))
    return match_charges(transactions, orders, window, back, days).unionByName(
        match_refunds(transactions, orders, refund_window, days)
    )


def match_summary(matches: DataFrame) -> DataFrame:
    return matches.agg(*[F.count_if(F.col("status") == s).alias(s) for s in STATUS_ORDER])


def review_queue(matches: DataFrame, k: int | None = None) -> DataFrame:
    """Exact matches, then reviews, charges without an order, refunds without one; with `k`, the first ones."""
    place = F.lit(len(STATUS_ORDER))
    for i, status in reversed(list(enumerate(STATUS_ORDER))):
        place = F.when(F.col("status") == status, i).otherwise(place)
    queue = matches.withColumn("place", place).orderBy("place", "txn_id")
    return queue if k is None else queue.limit(k)


def propose_updates(matches: DataFrame) -> DataFrame:
    """Note and name each matched transaction should carry, and whether they differ from now."""
    found = ensure_columns(matches, _with_text(matches)).filter(F.col("order_id").isNotNull())
    line = note_line("item_titles", "order_id", "kind", "refund_match")
    merged = merge_notes("notes", "order_id", line)
    name = merchant_name("item_titles", "kind")
    built = found.select("txn_id", "kind", "status", "order_id", "name", merged.alias("_m"), name.alias("new_name"))
    return built.select(
        "txn_id", "kind", "status", "order_id",
        F.col("_m.notes").alias("new_notes"), F.col("_m.changed").alias("note_changed"),
        "new_name", (~F.col("name").eqNullSafe(F.col("new_name"))).alias("name_changed"),
    )


def _with_text(matches: DataFrame):
    schema = matches.schema
    for column in ("name", "notes"):
        if column not in matches.columns:
            schema = schema.add(column, "string")
    return schema


def plan_auto_apply(matches: DataFrame, note: bool = True, rename: bool = True, enabled: bool = True) -> DataFrame:
    """One action row per exact match and switched-on kind."""
    kinds = [kind for kind, on in (("note", note), ("rename", rename)) if on and enabled]
    sure = matches.filter((F.col("status") == "auto") & F.col("order_id").isNotNull())
    actions = F.array(*[F.lit(k) for k in kinds]).cast("array<string>")
    return sure.select("txn_id", "order_id", F.explode(actions).alias("action"))


def apply_summary(results: DataFrame) -> DataFrame:
    """Outcome counts from (ok, verified, undo)."""
    ok = F.coalesce(F.col("ok"), F.lit(False))
    outcome = (
        F.when(~ok, "failed")
        .when(F.col("verified").eqNullSafe(F.lit(False)), "refuted")
        .when(F.coalesce(F.col("undo"), F.lit(False)), "applied")
        .otherwise("skipped")
    )
    named = results.select(outcome.alias("outcome"))
    return named.agg(
        F.count("*").alias("actions"),
        *[F.count_if(F.col("outcome") == o).alias(o) for o in ("applied", "skipped", "refuted", "failed")],
    )
