"""The home page as one bundle; its counts are those of the parts' own checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from reviewlens.adapters import Data
from reviewlens.plans import dashboards
from reviewlens.session import shared_folder
from reviewlens.suite import boards, tables, zones  # noqa: F401 - their checks are used below
from reviewlens.suite.registry import CHECKS, case

#: Datasets of the bundle and the query that shows the same rows.
PARTS = {
    "zone": "curated_zone", "lowest": "lowest_rated", "highest": "highest_rated", "opportunities": "opportunity_board",
    "helpful": "helpful_reviews", "prices": "top_revenue", "points": "chart_points", "histogram": "rating_histogram",
    "scatter": "scatter_clusters", "dismissed": "dismissed_list", "categories": "category_list", "health": "table_health",
}


@case(
    "dashboard_bundle",
    " union all ".join(f"select '{name}' as dataset, count(*) as n from ({CHECKS[key]})" for name, key in PARTS.items())
    + " union all select 'dives', count(*) from {v_dives}",
)
def dashboard_bundle(d: Data):
    tables = {
        "items": d.items.withColumn("rating", F.col("rating").cast("decimal(2,1)")), "reviews": d.reviews,
        "opportunities": d.scored(), "prices": d.table("v_prices"), "dives": d.table("v_dives"),
        "dismissed": d.table("v_dismissed"), "analyses": d.analyses(), "studies": d.table("v_studies"),
    }
    return dashboards.write_dashboard(tables, d.spark, shared_folder(d.spark, "dashboard"), points=1500, prices=2000)
