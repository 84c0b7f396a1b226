"""The rating zone: predicates, filters, sorts and top-k boards over items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlens import schemas as S
from reviewlens.functions.labels import money_status
from reviewlens.functions.parsing import _c
from reviewlens.operators.ordered import last_per_key, place_in_order, previous_per_key, rank_per_key


# --- predicates ---------------------------------------------------------------------------


def in_zone(rating: Column | str, lo: float = S.ZONE_LO, hi: float = S.ZONE_HI) -> Column:
    return F.coalesce(_c(rating).between(lo, hi), F.lit(False))


def should_fetch_reviews(
    rating: Column | str, zone_only: bool = True, lo: float = S.ZONE_LO, hi: float = S.ZONE_HI
) -> Column:
    return in_zone(rating, lo, hi) if zone_only else F.lit(True)


def reviews_are_fresh(current: Column | str, prior: Column | str, saved: Column | str, min_saved: int) -> Column:
    """Enough reviews saved and no new ratings since; anything unknown means fetch."""
    if min_saved <= 0:
        return F.lit(False)
    return F.coalesce((_c(saved) >= min_saved) & (_c(current) <= _c(prior)), F.lit(False))


def plan_fetch(candidates: DataFrame, items: DataFrame, cutoff: Column | None = None) -> DataFrame:
    """Candidates not stored yet, or with a cutoff not scraped since then."""
    known = items if cutoff is None else items.filter(F.col("last_scraped") >= cutoff)
    return candidates.join(known.select("ext_id"), "ext_id", "left_anti")


def filter_opportunities(
    board: DataFrame, complaint_type: str = "all", declining_only: bool = False, pricing: str = "all"
) -> DataFrame:
    out = board
    if complaint_type != "all":
        out = out.filter(F.col("complaint_type") == complaint_type)
    if declining_only:
        out = out.filter(F.col("decline_score") >= S.DECLINING_AT)
    return _with_pricing(out, pricing)


def _with_pricing(df: DataFrame, pricing: str) -> DataFrame:
    if pricing == "all":
        return df
    wanted = {"paid": "paid", "unpaid": "free", "unknown": "unknown"}[pricing]
    return df.filter(money_status("pricing_model", "has_paid_tier") == wanted)


def filter_zone(
    items: DataFrame,
    min_installs: int = 0,
    band: str = "all",
    saved_only: bool = False,
    category: str = "all",
    pricing: str = "all",
) -> DataFrame:
    out = items
    if min_installs:
        out = out.filter(F.col("install_count") >= min_installs)
    if band == "lower":
        out = out.filter(F.col("rating") < 3.0)
    elif band == "upper":
        out = out.filter(F.col("rating") >= 3.0)
    if saved_only:
        out = out.filter(F.col("saved") > 0)
    if category != "all":
        out = out.filter(F.col("store_category") == category)
    return _with_pricing(out, pricing)


def eligible_for_layer(dives: DataFrame, studies: DataFrame, layer: int) -> DataFrame:
    """Items whose previous layer is done; the first layer is open to all dives."""
    if layer == 3:
        done = studies.filter((F.col("layer") == 2) & (F.col("status") == "done"))
        return dives.select("item_id").distinct().join(done, "item_id", "left_semi")
    keep = dives.filter(F.col("status") == "done") if layer == 2 else dives
    return keep.select("item_id").distinct()


# --- joins ------------------------------------------------------------------------------------


def with_saved_count(items: DataFrame, reviews: DataFrame) -> DataFrame:
    """Stored review count per item, zero when there is none."""
    counts = reviews.groupBy("item_id").agg(F.count("*").alias("saved"))
    joined = items.join(counts, items["id"] == counts["item_id"], "left").drop("item_id")
    return joined.withColumn("saved", F.coalesce("saved", F.lit(0)))


def enrich(child: DataFrame, items: DataFrame, columns: list[str]) -> DataFrame:
    """Child rows with columns of their item; rows without one are dropped."""
    parent = items.select(F.col("id").alias("item_id"), *columns)
    return child.join(parent, "item_id")


def select_for_analysis(candidates: DataFrame, done: DataFrame, force: bool = False) -> DataFrame:
    return candidates if force else candidates.join(done.select(F.col("item_id").alias("id")), "id", "left_anti")


def with_legitimacy(items: DataFrame, analyses: DataFrame) -> DataFrame:
    joined = items.join(
        analyses.select(F.col("item_id").alias("id"), "legitimacy", "primary_cause"), "id", "left"
    )
    return joined.withColumn("multiplier", F.coalesce("legitimacy", F.lit(1.0)))


def work_queue(dives: DataFrame, items: DataFrame, limit: int | None = None) -> DataFrame:
    """Queued entries, oldest first, with their item; with `limit`, the first ones."""
    order = [F.asc_nulls_last("requested_at"), F.asc("item_id")]
    queued = dives.filter(F.col("status") == "queued").select("item_id", "requested_at")
    if limit is not None:
        queued = queued.orderBy(*order).limit(limit)
    parent = items.select(
        F.col("id").alias("item_id"), "ext_id", "name", "store_category", "rating", "rating_count", "install_count",
        "website",
    )
    return parent.join(queued, "item_id").orderBy(*order)


# --- boards: every one ends its sort with a unique column ----------------------------------------


def zone_candidates(items: DataFrame, limit: int | None = None) -> DataFrame:
    zone = items.filter(in_zone("rating"))
    return zone if limit is None else top_by_installs(zone, limit)


def top_by_installs(items: DataFrame, n: int) -> DataFrame:
    return items.orderBy(F.desc_nulls_last("install_count"), "id").limit(n)


def lowest_rated(items: DataFrame, k: int = 10) -> DataFrame:
    rated = items.filter(F.col("rating").isNotNull())
    return rated.orderBy("rating", F.desc_nulls_last("install_count"), "id").limit(k)


def highest_rated(items: DataFrame, k: int = 10) -> DataFrame:
    return items.filter(F.col("rating").isNotNull()).orderBy(F.desc("rating"), "id").limit(k)


def chart_points(items: DataFrame, k: int | None = None) -> DataFrame:
    """Rated items; with `k`, the most installed ones."""
    rated = items.filter(F.col("rating").isNotNull())
    return rated if k is None else top_by_installs(rated, k)


def top_opportunities(opportunities: DataFrame, k: int = 200) -> DataFrame:
    return opportunities.orderBy(F.desc_nulls_last("score"), "item_id").limit(k)


def helpful_reviews(reviews: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """Flagged reviews, fewest stars and newest first, with their item."""
    flagged = reviews.filter(F.coalesce(F.col("helpful_ranked"), F.lit(False)))
    order = [F.asc_nulls_last("stars"), F.desc_nulls_last("reviewed_at"), F.asc("review_uid")]
    top = flagged.orderBy(*order).limit(k)
    parent = items.select(F.col("id").alias("item_id"), "ext_id", "name", "store_category")
    return parent.join(top, "item_id").orderBy(*order)


def curated_zone(
    items: DataFrame,
    dismissed: DataFrame,
    analyses: DataFrame,
    fetch: int = S.ZONE_FETCH,
    show: int = S.ZONE_SHOW,
) -> DataFrame:
    """The most installed zone items, less the dismissed, re-ranked by installs times legitimacy."""
    candidates = zone_candidates(items, fetch)
    kept = candidates.join(dismissed.select(F.col("item_id").alias("id")), "id", "left_anti")
    scored = with_legitimacy(kept, analyses.join(kept.select(F.col("id").alias("item_id")), "item_id", "left_semi")).withColumn(
        "weighted_installs", F.coalesce(F.col("install_count"), F.lit(0)) * F.col("multiplier")
    )
    order = [F.desc("weighted_installs"), F.desc_nulls_last("install_count"), F.asc("id")]
    return scored.orderBy(*order).limit(show)


def dismissed_list(dismissed: DataFrame, items: DataFrame) -> DataFrame:
    listed = enrich(dismissed, items, ["ext_id", "name", "store_category", "rating", "install_count"])
    return listed.orderBy(F.desc_nulls_last("dismissed_at"), "item_id")


def top_revenue(prices: DataFrame, k: int | None = None, order: list[str] | None = None) -> DataFrame:
    """Price profiles by estimated revenue, the first `k` if given; with `order`, only an item's last profile counts."""
    latest = prices if order is None else last_per_key(prices, ["item_id"], order)
    ranked = latest.orderBy(F.desc_nulls_last("estimated_monthly_revenue_usd"), "item_id")
    return ranked if k is None else ranked.limit(k)


def snapshot_deltas(snapshots: DataFrame) -> DataFrame:
    """Change of rating, rating count and installs since the item's previous snapshot."""
    carry = ["captured_at", "rating", "rating_count", "install_count"]
    paired = previous_per_key(
        snapshots.select("item_id", *carry), ["item_id"], F.trunc("captured_at", "year"), ["captured_at"], carry
    )
    return paired.select(
        "item_id", "captured_at", "prev_captured_at",
        (F.col("rating") - F.col("prev_rating")).alias("rating_delta"),
        (F.col("rating_count") - F.col("prev_rating_count")).alias("rating_count_delta"),
        (F.col("install_count") - F.col("prev_install_count")).alias("install_delta"),
    )


def clusters_ranked(clusters: DataFrame) -> DataFrame:
    return rank_per_key(clusters, ["item_id"], [(F.col("independent_reviewers"), True)], [F.asc("cluster_no")])


def sort_nulls_last(df: DataFrame, column: str, direction: str = "asc", tie: str = "id") -> DataFrame:
    order = F.asc_nulls_last(column) if direction == "asc" else F.desc_nulls_last(column)
    return df.orderBy(order, F.asc(tie))


def place_nulls_last(
    df: DataFrame, column: str, direction: str = "asc", tie: str = "id", place: str = "place", ranges: int | None = None
) -> DataFrame:
    """Position of each row in that order, for columns of any type; the tie tells all rows apart."""
    order = F.asc_nulls_last(column) if direction == "asc" else F.desc_nulls_last(column)
    return place_in_order(df, [order, F.asc_nulls_last(tie)], place, ranges)


def sort_opportunities(board: DataFrame, mode: str = "score-desc") -> DataFrame:
    column, direction = mode.rsplit("-", 1)
    key = F.coalesce(F.col("decline_score" if column == "decline" else "score"), F.lit(-1.0))
    return board.orderBy(key.desc() if direction == "desc" else key.asc(), F.asc("item_id"))


def category_list(items: DataFrame) -> DataFrame:
    named = items.filter(F.coalesce(F.col("store_category"), F.lit("")) != "")
    return named.select("store_category").distinct().orderBy("store_category")


# --- charts ------------------------------------------------------------------------------------------


def rating_histogram(items: DataFrame) -> DataFrame:
    """Eight half-star buckets, empty ones included."""
    bucket = F.least(F.greatest(F.floor((F.col("rating") - 1.0) / 0.5), F.lit(0)), F.lit(7)).cast("int")
    counts = items.filter(F.col("rating").isNotNull()).groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))
    spine = items.sparkSession.range(8).select(F.col("id").cast("int").alias("bucket"))
    return spine.join(counts, "bucket", "left").select(
        "bucket",
        (1.0 + F.col("bucket") * 0.5).alias("low"),
        F.coalesce("n", F.lit(0)).alias("n"),
        F.col("bucket").isin(3, 4).alias("in_zone"),
    )


def _scatter_points(points: DataFrame, width: float, height: float, cell: float) -> DataFrame:
    """Plot position and grid cell of each point. Padding values are fixed: 46, 14, 16, 30."""
    left, right, top, bottom = 46.0, 14.0, 16.0, 30.0
    plot_w, plot_h = width - left - right, height - top - bottom
    usable = points.filter(F.col("rating").isNotNull() & (F.col("install_count") > 0))
    lo, hi = F.log10(F.min("install_count")), F.log10(F.max("install_count"))
    placed = usable.withColumn("_range", usable.agg(F.struct(lo.alias("lo"), hi.alias("hi")).alias("range")).scalar())
    low, high = F.col("_range.lo"), F.col("_range.hi")
    span = F.when(high == low, 1.0).otherwise(high - low)
    rating = F.greatest(F.lit(1.0), F.least(F.lit(5.0), F.col("rating").cast("double")))
    return (
        placed.withColumn("x", left + (rating - 1.0) / 4.0 * plot_w)
        .withColumn("y", top + plot_h - (F.log10("install_count") - low) / span * plot_h)
        .withColumn("cell_x", F.floor(F.col("x") / cell + 0.5).cast("int"))
        .withColumn("cell_y", F.floor(F.col("y") / cell + 0.5).cast("int"))
        .drop("_range")
    )


def scatter_members(points: DataFrame, width: float = 480.0, height: float = 240.0, cell: float = 8.0) -> DataFrame:
    """Which cluster every point falls into, one row per point."""
    return _scatter_points(points, width, height, cell).select("cell_x", "cell_y", "id", "ext_id", "rating_count")


def scatter_clusters(
    points: DataFrame,
    width: float = 480.0,
    height: float = 240.0,
    cell: float = 8.0,
    radius_scale: float = 5.0,
    labels: int = 12,
) -> DataFrame:
    """Points on nearly the same spot as one cluster with size, centre, representative and radius."""
    placed = _scatter_points(points, width, height, cell)
    most_rated = F.struct(-F.coalesce(F.col("rating_count"), F.lit(0)), F.col("id"))
    clusters = placed.groupBy("cell_x", "cell_y").agg(
        F.count("*").alias("n"),
        F.avg("x").alias("center_x"),
        F.avg("y").alias("center_y"),
        F.sum(F.coalesce("rating_count", F.lit(0))).cast("long").alias("total_ratings"),
        F.min_by(F.struct("id", "ext_id", "rating"), most_rated).alias("rep"),
    )
    largest = clusters.agg(F.greatest(F.max("total_ratings"), F.lit(1)).alias("largest")).scalar()
    order = [F.desc("total_ratings"), F.asc("cell_x"), F.asc("cell_y")]
    top = clusters.orderBy(*order).limit(labels).select("cell_x", "cell_y", F.lit(True).alias("_top"))
    return (
        clusters.join(top, ["cell_x", "cell_y"], "left")
        .select(
            "cell_x", "cell_y", "n", "center_x", "center_y", "total_ratings",
            F.col("rep.id").alias("rep_id"),
            F.col("rep.ext_id").alias("rep_ext_id"),
            in_zone("rep.rating").alias("in_zone"),
            (2.5 + F.sqrt(F.col("total_ratings") / largest) * radius_scale).alias("radius"),
            F.coalesce("_top", F.lit(False)).alias("labeled"),
        )
    )


def scatter_ticks(points: DataFrame) -> DataFrame:
    """Lowest, middle and highest install tick of the chart."""
    usable = points.filter(F.col("rating").isNotNull() & (F.col("install_count") > 0))
    lo, hi = F.log10(F.min("install_count")), F.log10(F.max("install_count"))
    return usable.agg(F.array(lo, (lo + hi) / 2, hi).alias("ticks")).select(
        F.posexplode("ticks").alias("tick", "log_installs")
    )
