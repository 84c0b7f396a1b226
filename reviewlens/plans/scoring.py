"""Opportunity scores and the rows derived from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlens import schemas as S
from reviewlens.functions.parsing import _c
from reviewlens.functions.rounding import round_half_even
from reviewlens.operators.reviews import latest_per_item, legitimacy, review_signals
from reviewlens.operators.tables import ensure_columns, upsert
from reviewlens.operators.zone import in_zone, select_for_analysis, top_by_installs, zone_candidates


def norm_log(value: Column | str, cap: int = S.INSTALL_CAP) -> Column:
    """Installs on a log scale, 0 … 1."""
    v = _c(value)
    return F.when(v > 0, F.least(F.lit(1.0), F.log10(v) / F.log10(F.lit(float(cap))))).otherwise(0.0)


def best_cluster(clusters: DataFrame) -> DataFrame:
    """The most promising fixable complaint: has a pay quote, most reviewers, surely fixable; first on ties."""
    usable = clusters.filter(F.col("fixable").isin("yes", "maybe"))
    paid = F.size(F.coalesce("wtp_quotes", F.array().cast("array<string>"))) > 0
    order = F.struct(
        (~paid).cast("int"), -F.col("independent_reviewers"), (F.col("fixable") != "yes").cast("int"), "cluster_no"
    )
    row = F.struct("cluster_no", "complaint", "complaint_type", "fixable", "independent_reviewers", "wtp_quotes")
    return usable.groupBy("item_id").agg(F.min_by(row, order).alias("b")).select("item_id", "b.*")


def score(demand: Column, paid: Column, fixable: Column, installs: Column, rating: Column, recency: Column,
          decline: Column, just_bad: Column, backend: Column) -> Column:
    """The rubric, one term per signal, never below zero, not yet rounded."""
    fixability = F.when(fixable == "yes", 1.0).when(fixable == "maybe", 0.5).otherwise(0.0)
    raw = (
        S.WEIGHT_DEMAND * F.least(F.lit(1.0), demand / F.lit(float(S.DEMAND_FULL))) * recency
        + F.when(paid, S.WEIGHT_PAY).otherwise(0.0)
        + S.WEIGHT_FIXABLE * fixability
        + S.WEIGHT_MARKET * norm_log(installs)
        + F.when(in_zone(rating), S.BONUS_ZONE).otherwise(0.0)
        + S.WEIGHT_DECLINE * decline
        - F.when(F.coalesce(just_bad, F.lit(False)), S.PENALTY_JUST_BAD).otherwise(0.0)
        - F.when(F.coalesce(backend, F.lit(False)), S.PENALTY_BACKEND).otherwise(0.0)
    )
    return F.greatest(F.lit(0.0), raw)


def score_opportunities(
    items: DataFrame, analyses: DataFrame, clusters: DataFrame, reviews: DataFrame, as_of: Column, model: str = "rules"
) -> DataFrame:
    """One opportunity row per analysed item."""
    best = best_cluster(clusters)
    signals = review_signals(reviews, as_of)
    base = items.select(F.col("id").alias("item_id"), "rating", "install_count")
    joined = base.join(analyses, "item_id").join(best, "item_id", "left").join(signals, "item_id", "left")
    demand = F.coalesce("independent_reviewers", F.lit(0)).cast("long")
    quotes = F.coalesce("wtp_quotes", F.array().cast("array<string>"))
    recency, decline = F.coalesce("recency", F.lit(1.0)), F.coalesce("decline_score", F.lit(0.0))
    return joined.select(
        "item_id",
        score(
            demand, F.size(quotes) > 0, F.col("fixable"), F.col("install_count"), F.col("rating"), recency, decline,
            F.col("overall_just_bad"), F.col("needs_heavy_backend"),
        ).alias("score"),
        F.col("complaint").alias("top_complaint"),
        "complaint_type", "fixable",
        demand.alias("demand_intensity"),
        quotes.alias("wtp_evidence"),
        "build_effort", "brief",
        recency.alias("recency_weight"),
        decline.alias("decline_score"),
        "recent_rating", "baseline_rating",
        F.coalesce("complaint_trend", F.lit(0.0)).alias("complaint_trend"),
        F.lit(model).alias("model"),
    ).withColumn("score", round_half_even(F.col("score"), 1))


def rank_all(
    items: DataFrame,
    analyses: DataFrame,
    clusters: DataFrame,
    reviews: DataFrame,
    opportunities: DataFrame,
    as_of: Column,
    limit: int | None = None,
    min_reviews: int = 5,
    max_reviews: int | None = None,
    force: bool = False,
    model: str = "rules",
) -> DataFrame:
    """The opportunities table after a run over the most installed items, new ones only unless forced."""
    candidates = items if limit is None else top_by_installs(items, limit)
    todo = select_for_analysis(candidates, opportunities, force)
    mine = reviews.join(todo.select(F.col("id").alias("item_id")), "item_id", "left_semi")
    recent = latest_per_item(mine, max_reviews, min_reviews)
    enough = recent.select(F.col("item_id").alias("id")).distinct()
    rows = score_opportunities(
        todo.join(enough, "id", "left_semi"), analyses, clusters, recent, as_of, model
    )
    return upsert(ensure_columns(opportunities, S.OPPORTUNITIES), rows, ["item_id"])


def review_analysis_rows(
    items: DataFrame,
    reviews: DataFrame,
    reports: DataFrame,
    causes: DataFrame,
    stored: DataFrame,
    limit: int | None = None,
    min_reviews: int = 5,
    max_reviews: int | None = None,
    force: bool = False,
    model: str = "rules",
) -> DataFrame:
    """The review-analysis table after screening zone items; a failed report becomes an error row."""
    todo = select_for_analysis(zone_candidates(items, limit), stored, force)
    ids = todo.select(F.col("id").alias("item_id"))
    # Counting combines before the shuffle; only a short list of items is worth a filter ahead of it.
    mine = reviews if limit is None else reviews.join(ids, "item_id", "left_semi")
    analyzed = F.count("*") if max_reviews is None else F.least(F.count("*"), F.lit(max_reviews))
    counts = mine.groupBy("item_id").agg(analyzed.alias("reviews_analyzed"))
    screened = (
        reports.join(ids, "item_id", "left_semi")
        .join(counts.filter(F.col("reviews_analyzed") >= min_reviews), "item_id")
    )
    good = screened.filter(F.col("error").isNull())
    done = (
        legitimacy(good, causes.join(good.select("item_id"), "item_id", "left_semi")).drop("primary_cause")
        .join(good, "item_id")
        .select(
            "item_id", F.lit("done").alias("status"), F.lit(model).alias("model"), "reviews_analyzed", "legitimacy",
            "primary_cause", "verdict", F.lit(None).cast("string").alias("error"),
        )
    )
    failed = screened.filter(F.col("error").isNotNull()).select("item_id", F.lit("error").alias("status"), "error")
    table = upsert(ensure_columns(stored, S.REVIEW_ANALYSIS), done, ["item_id"])
    return upsert(table, failed, ["item_id"])
