"""Table schemas and the fixed numbers of the scoring rubric."""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values: rating zone -------------------------------------------------
ZONE_LO, ZONE_HI = 2.5, 3.5
ZONE_FETCH, ZONE_SHOW = 200, 25

# --- fixed values: age of a review in days -> weight; older than all -> floor ---
RECENCY_STEPS = ((91, 1.0), (182, 0.85), (365, 0.7), (730, 0.5), (1095, 0.3))
RECENCY_FLOOR = 0.15
COMPLAINT_STARS = 3

# --- fixed values: trend windows ------------------------------------------------
TREND_RECENT_DAYS, TREND_PRIOR_DAYS, TREND_MIN_ROWS = 180, 540, 3
NEGATIVE_STARS = 2
DECLINING_AT = 0.2

# --- fixed values: score weights ------------------------------------------------
WEIGHT_DEMAND, WEIGHT_PAY, WEIGHT_FIXABLE, WEIGHT_MARKET = 45.0, 20.0, 15.0, 20.0
BONUS_ZONE, WEIGHT_DECLINE = 10.0, 15.0
PENALTY_JUST_BAD, PENALTY_BACKEND = 60.0, 15.0
DEMAND_FULL, INSTALL_CAP = 10, 10_000_000

# --- fixed values: how much a cause counts as a real product problem ------------
CAUSE_WEIGHT = {
    "product_issues": 1.0,
    "mixed": 0.5,
    "praise": 1.0,
    "off_topic": 0.15,
    "competitor_attack": 0.1,
    "review_bombing": 0.0,
}
UNKNOWN_CAUSE_WEIGHT = 0.5
LOW_LEGITIMACY = 0.6

# --- fixed values: enumerations ---------------------------------------------------
COMPLAINT_TYPES = ("missing_feature", "bug", "pricing", "abandonment", "other")
FIXABLE = ("yes", "no", "maybe")
PRICING_MODELS = ("free", "freemium", "paid", "subscription", "ads", "unknown")
PAID_MODELS = ("paid", "freemium", "subscription")
CONFIDENCE = ("low", "medium", "high")
RECOMMENDATIONS = ("build", "maybe", "avoid")
STATUSES = ("queued", "done", "error")
ERROR_LENGTH = 2000
TITLES_KEPT = 10

# --- fixed values: reconciliation windows, in days ---------------------------------
CHARGE_AFTER_DAYS, CHARGE_BACK_DAYS, REFUND_DAYS = 10, 2, 120


KINDS = {
    "long": T.LongType(), "int": T.IntegerType(), "string": T.StringType(), "double": T.DoubleType(),
    "boolean": T.BooleanType(), "date": T.DateType(), "timestamp": T.TimestampType(),
    "rating": T.DecimalType(2, 1), "strings": T.ArrayType(T.StringType()),
}


def columns(text: str) -> T.StructType:
    """`name kind, name kind` as a struct type; usable before a session exists."""
    pairs = [part.split() for part in text.split(",")]
    return T.StructType([T.StructField(name, KINDS[kind]) for name, kind in pairs])


ITEMS = columns(
    "id long, ext_id string, name string, developer string, store_category string, summary string, "
    "description string, install_count long, install_count_raw string, rating rating, "
    "rating_count int, version string, last_updated date, website string, support_url string, "
    "privacy_url string, listing_url string, icon_url string, price string, permissions strings, "
    "raw string, first_seen timestamp, last_scraped timestamp, updated_at timestamp, "
    "successor_of long, successor_points strings"
)
REVIEWS = columns(
    "id long, item_id long, review_uid string, author string, stars int, body string, reviewed_at date, "
    "language string, helpful_count int, raw string, scraped_at timestamp, helpful_ranked boolean"
)
SNAPSHOTS = columns(
    "item_id long, captured_at date, rating double, rating_count int, install_count long"
)
CLUSTERS = columns(
    "item_id long, cluster_no string, complaint string, complaint_type string, fixable string, "
    "independent_reviewers long, wtp_quotes strings"
)
ANALYSES = columns(
    "item_id long, overall_just_bad boolean, needs_heavy_backend boolean, build_effort string, brief string"
)
OPPORTUNITIES = columns(
    "item_id long, score double, top_complaint string, complaint_type string, fixable string, "
    "demand_intensity long, wtp_evidence strings, build_effort string, brief string, "
    "recency_weight double, decline_score double, recent_rating double, baseline_rating double, "
    "complaint_trend double, model string"
)
CAUSES = columns("item_id long, cause string, share double, note string")
REVIEW_ANALYSIS = columns(
    "item_id long, status string, model string, reviews_analyzed long, legitimacy double, "
    "primary_cause string, verdict string, error string"
)
DIVES = columns("item_id long, status string, requested_at date, error string")
STUDIES = columns("item_id long, layer int, status string, details string")
DISMISSED = columns("item_id long, reason string, dismissed_at date")
PRICES = columns(
    "item_id long, pricing_model string, makes_money boolean, has_paid_tier boolean, price_min_usd double, "
    "price_max_usd double, estimated_users long, estimated_monthly_revenue_usd double, "
    "revenue_low_usd double, revenue_high_usd double, confidence string, monetization_summary string, "
    "pricing_notes string, sources strings"
)
ORDERS = columns(
    "order_id string, order_date date, total_cents long, item_titles strings, return_hint boolean, "
    "account string"
)
TRANSACTIONS = columns(
    "txn_id string, txn_date date, amount_cents long, merchant_name string, name string, notes string"
)
COMPETITOR = columns(
    "name string, url string, pricing string, users string, positioning string, strengths string, weaknesses string"
)
STUDY_OPPORTUNITY = columns("title string, detail string, evidence string, effort string")
