"""The home and detail bundles: named DataFrames, each its own plan."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from reviewlens import schemas as S
from reviewlens.operators import zone
from reviewlens.operators.ordered import rank_per_key
from reviewlens.operators.reviews import latest_per_item, review_stats
from reviewlens.operators.tables import ensure_columns, table_health

BOARD_COLUMNS = ["ext_id", "name", "rating", "install_count"]


def opportunity_board(opportunities: DataFrame, items: DataFrame, k: int = 200) -> DataFrame:
    """Top opportunities with their item."""
    top = zone.top_opportunities(opportunities, k)
    parent = items.select(F.col("id").alias("item_id"), *BOARD_COLUMNS)
    return parent.join(top, "item_id")


def _tables(tables: Mapping[str, DataFrame | None], spark) -> dict[str, DataFrame]:
    """Optional tables that are missing become empty ones."""
    known = {
        "items": S.ITEMS, "reviews": S.REVIEWS, "opportunities": S.OPPORTUNITIES, "prices": S.PRICES,
        "dives": S.DIVES, "dismissed": S.DISMISSED, "analyses": S.REVIEW_ANALYSIS, "studies": S.STUDIES,
    }
    return {name: ensure_columns(tables.get(name), schema, spark) for name, schema in known.items()}


def dashboard(
    tables: Mapping[str, DataFrame | None], spark, points: int | None = None, prices: int | None = None
) -> dict[str, DataFrame]:
    """The thirteen datasets of the home page; `points` and `prices` limit what those two lists show."""
    t = _tables(tables, spark)
    items, reviews = t["items"], t["reviews"]
    return {
        "zone": zone.curated_zone(items, t["dismissed"], t["analyses"]),
        "lowest": zone.lowest_rated(items),
        "highest": zone.highest_rated(items),
        "opportunities": opportunity_board(t["opportunities"], items),
        "helpful": zone.helpful_reviews(reviews, items),
        "prices": zone.enrich(zone.top_revenue(t["prices"], prices), items, ["ext_id"]),
        "dives": zone.enrich(t["dives"].select("item_id", "status"), items, ["ext_id"]),
        "points": zone.chart_points(items, points),
        "histogram": zone.rating_histogram(items),
        "scatter": zone.scatter_clusters(items),
        "dismissed": zone.dismissed_list(t["dismissed"], items),
        "categories": zone.category_list(items),
        "health": table_health(
            {"items": items, "reviews": reviews}, t["dives"], t["analyses"], t["studies"]
        ),
    }


def write_dashboard(
    tables: Mapping[str, DataFrame | None], spark, folder: str, points: int | None = None, prices: int | None = None
) -> DataFrame:
    """The bundle as a table per dataset below a folder, and (dataset, n) of what was written.

    Rows are counted by the writes themselves.
    """
    counts = []
    for name, df in dashboard(tables, spark, points, prices).items():
        seen = Observation(name)
        df.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(f"{folder}/{name}")
        counts.append((name, seen.get["n"]))
    return spark.createDataFrame(counts, "dataset string, n long")


def item_detail(
    tables: Mapping[str, DataFrame | None], ext_id: str, spark, reviews: int | None = None
) -> dict[str, DataFrame]:
    """Everything about one item: filters reach each scan. `reviews` limits the listed reviews to the newest ones."""
    t = _tables(tables, spark)
    item = t["items"].filter(F.col("ext_id") == ext_id)
    own = item.select(F.col("id").alias("item_id"))

    def mine(df: DataFrame) -> DataFrame:
        return df.join(own, "item_id", "left_semi")

    return {
        "item": item,
        "reviews": latest_per_item(mine(t["reviews"]), reviews),
        "opportunity": mine(t["opportunities"]),
        "price": mine(t["prices"]),
        "dive": mine(t["dives"]),
        "analysis": mine(t["analyses"]),
        "studies": mine(t["studies"]),
    }


def item_details(tables: Mapping[str, DataFrame | None], spark) -> DataFrame:
    """The detail header of all items at once, one row per item."""
    t = _tables(tables, spark)
    stats = review_stats(t["reviews"])
    layers = t["studies"].groupBy("item_id").agg(
        *[F.max(F.when(F.col("layer") == n, F.col("status"))).alias(f"layer{n}") for n in (2, 3)]
    )
    return (
        t["items"].select(F.col("id").alias("item_id"), "ext_id", "name", "rating", "install_count")
        .join(stats, "item_id", "left")
        .join(t["opportunities"].select("item_id", "score", "top_complaint"), "item_id", "left")
        .join(t["prices"].select("item_id", "pricing_model"), "item_id", "left")
        .join(t["dives"].select("item_id", F.col("status").alias("dive")), "item_id", "left")
        .join(t["analyses"].select("item_id", "legitimacy"), "item_id", "left")
        .join(layers, "item_id", "left")
        .withColumns({"total": F.coalesce("total", F.lit(0)), "helpful": F.coalesce("helpful", F.lit(0)),
                      "dive": F.coalesce("dive", F.lit("none"))})
    )


def recent_first(reviews: DataFrame) -> DataFrame:
    """Position of every review of an item, newest first, however many there are."""
    return rank_per_key(reviews, ["item_id"], [(F.col("reviewed_at"), True)], [F.asc("review_uid")])
