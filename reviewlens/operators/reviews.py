"""Signals over dated, starred reviews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewlens import schemas as S
from reviewlens.functions.parsing import _c, squash
from reviewlens.functions.rounding import round_half_even
from reviewlens.operators.ordered import first_per_key, rank_in_ranges, rank_per_key, top_per_key




def _zero_if_null(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


def recency_percent(reviewed_at: Column | str, as_of: Column) -> Column:
    """Age weight in whole percent; sums of it are exact in any order. Null and future dates weigh 100."""
    age = F.datediff(as_of, _c(reviewed_at))
    weight = F.when(age.isNull() | (age <= 0), 100)
    for days, step in S.RECENCY_STEPS:
        weight = weight.when(age <= days, round(step * 100))
    return weight.otherwise(round(S.RECENCY_FLOOR * 100))


def recency_weight(reviewed_at: Column | str, as_of: Column) -> Column:
    return recency_percent(reviewed_at, as_of) / F.lit(100.0)


def _signals(as_of: Column) -> dict[str, Column]:
    """The partial aggregates behind both the recency factor and the trend."""
    stars, day = F.col("stars"), F.col("reviewed_at")
    dated = day.isNotNull()
    complaint = dated & (stars <= S.COMPLAINT_STARS)
    weight = recency_percent(day, as_of)
    age = F.greatest(F.datediff(as_of, day), F.lit(0))
    rated = dated & stars.isNotNull()
    recent = rated & (age <= S.TREND_RECENT_DAYS)
    prior = rated & (age > S.TREND_RECENT_DAYS) & (age <= S.TREND_PRIOR_DAYS)
    out = {
        "_wc": F.sum(F.when(complaint, weight)), "_nc": F.count_if(complaint),
        "_wa": F.sum(F.when(dated, weight)), "_na": F.count_if(dated),
    }
    for name, part in (("r", recent), ("p", prior)):
        out[f"_n{name}"] = F.count_if(part)
        out[f"_s{name}"] = F.sum(F.when(part, stars))
        out[f"_g{name}"] = F.count_if(part & (stars <= S.NEGATIVE_STARS))
    return out


def _factor() -> Column:
    def mean(total: str, n: str) -> Column:
        return F.when(F.col(n) > 0, F.col(total) / (F.lit(100.0) * F.col(n)))

    return round_half_even(F.coalesce(mean("_wc", "_nc"), mean("_wa", "_na"), F.lit(1.0)), 3)


def _trend() -> list[Column]:
    enough = (F.col("_nr") >= S.TREND_MIN_ROWS) & (F.col("_np") >= S.TREND_MIN_ROWS)

    def share(part: str, n: str) -> Column:
        return F.when(enough, F.col(part) / F.col(n))

    recent, prior = share("_sr", "_nr"), share("_sp", "_np")
    drop = F.greatest(F.lit(0.0), prior - recent)
    surge = F.greatest(F.lit(0.0), share("_gr", "_nr") - share("_gp", "_np"))
    decline = F.when(enough, F.least(F.lit(1.0), F.lit(0.6) * (drop / 2.0) + F.lit(0.4) * surge))
    return [
        _zero_if_null(round_half_even(decline, 3)).alias("decline_score"),
        round_half_even(recent, 2).alias("recent_rating"),
        round_half_even(prior, 2).alias("baseline_rating"),
        _zero_if_null(round_half_even(F.when(enough, surge), 3)).alias("complaint_trend"),
    ]


def recency_factor(reviews: DataFrame, as_of: Column) -> DataFrame:
    """How fresh the complaints of an item are, 0.15 … 1."""
    agg = {k: v for k, v in _signals(as_of).items() if k in ("_wc", "_nc", "_wa", "_na")}
    return (
        reviews.groupBy("item_id").agg(*[v.alias(k) for k, v in agg.items()])
        .select("item_id", _factor().alias("recency"))
    )


def trend_signal(reviews: DataFrame, as_of: Column) -> DataFrame:
    """Is an item getting worse: half a year against the year before it."""
    agg = {k: v for k, v in _signals(as_of).items() if k not in ("_wc", "_nc", "_wa", "_na")}
    return reviews.groupBy("item_id").agg(*[v.alias(k) for k, v in agg.items()]).select("item_id", *_trend())


def review_signals(reviews: DataFrame, as_of: Column) -> DataFrame:
    """Recency factor and trend from one shared aggregation."""
    return (
        reviews.groupBy("item_id").agg(*[v.alias(k) for k, v in _signals(as_of).items()])
        .select("item_id", _factor().alias("recency"), *_trend())
    )


def cause_percent(cause: Column | str, unknown: float = S.UNKNOWN_CAUSE_WEIGHT) -> Column:
    """Weight of a cause in whole percent, so that weighted shares add up the same in any order."""
    c = _c(cause)
    chain = None
    for name, weight in S.CAUSE_WEIGHT.items():
        percent = float(round(weight * 100))
        chain = F.when(c == name, percent) if chain is None else chain.when(c == name, percent)
    return chain.otherwise(float(round(unknown * 100)))


def legitimacy(analyses: DataFrame, causes: DataFrame) -> DataFrame:
    """How much a rating reflects real problems: override, else share-weighted causes, else primary cause."""
    real = causes.filter(F.coalesce(F.col("cause"), F.lit("")) != "praise")
    sums = real.groupBy("item_id").agg(
        F.sum(cause_percent("cause") * F.col("share")).alias("_weighted"), F.sum("share").alias("_share")
    )

    def unit(c: Column) -> Column:
        clamped = F.when(c < 0, 0.0).when(c > 1, 1.0).otherwise(c)
        return round_half_even(clamped, 3)

    shared = F.when(F.col("_share") > 0, F.col("_weighted") / (F.col("_share") * 100))
    value = F.coalesce(unit(F.col("override")), unit(shared), cause_percent("primary_cause", 1.0) / 100)
    return analyses.join(sums, "item_id", "left").select("item_id", "primary_cause", value.alias("legitimacy"))


def latest_per_item(
    reviews: DataFrame, n: int | None = None, min_reviews: int = 0, tie: str = "review_uid"
) -> DataFrame:
    """The newest `n` reviews per item (all of them without `n`), for items of which at least `min_reviews` are kept."""
    if min_reviews > 0:
        have = F.count("*") if n is None else F.least(F.count("*"), F.lit(n))
        enough = reviews.groupBy("item_id").agg(have.alias("_have")).filter(F.col("_have") >= min_reviews)
        reviews = reviews.join(enough, "item_id", "left_semi")
    if n is None:
        return rank_per_key(reviews, ["item_id"], [(F.col("reviewed_at"), True)], [F.asc(tie)])
    return top_per_key(reviews, ["item_id"], [F.desc_nulls_last("reviewed_at"), F.asc(tie)], n)


def _weighting_order(tie: str) -> list[Column]:
    """Helpful flag, helpful count, date, all descending."""
    return [
        F.desc(F.coalesce(F.col("helpful_ranked"), F.lit(False))), F.desc(F.coalesce(F.col("helpful_count"), F.lit(0))),
        F.desc_nulls_last("reviewed_at"), F.asc_nulls_last(tie),
    ]


def rank_for_weighting(reviews: DataFrame, tie: str = "review_uid", ranges: int | None = None) -> DataFrame:
    """Position of every review of an item in the order of weighting."""
    return rank_in_ranges(reviews, ["item_id"], _weighting_order(tie), ranges=ranges)


def merge_reviews(passes: DataFrame) -> DataFrame:
    """One row per (item, uid): the first pass and position wins, the helpful flag is OR-ed."""
    keys = ["item_id", "review_uid"]
    flag = F.bool_or(F.coalesce(F.col("helpful_ranked"), F.lit(False)))
    return first_per_key(passes, keys, ["pass_no", "position"], {"helpful_ranked": flag})


def review_stats(reviews: DataFrame) -> DataFrame:
    stars = F.col("stars")
    return reviews.groupBy("item_id").agg(
        F.count("*").alias("total"),
        round_half_even(F.sum(stars) / F.count(stars), 1).alias("mean_stars"),
        F.count_if(F.coalesce(F.col("helpful_ranked"), F.lit(False))).alias("helpful"),
    )


# --- fixed values: phrases that say a fix would win the reviewer ------------------------
DEMAND_PHRASES = (
    ("would_pay", r"(?i)\b(?:i'd|i would|would gladly|happy to) pay\b"),
    ("wish", r"(?i)\bi wish (?:it|this) (?:could|would|had)\b"),
    ("almost", r"(?i)\balmost perfect(?:,)? but\b"),
)


def demand_kind(body: Column | str) -> Column:
    c, chain = _c(body), None
    for kind, pattern in DEMAND_PHRASES:
        chain = F.when(c.rlike(pattern), kind) if chain is None else chain.when(c.rlike(pattern), kind)
    return chain


def demand_signals(reviews: DataFrame) -> DataFrame:
    """One row per review that says it would pay, wishes for something or calls the item almost perfect."""
    return (
        reviews.withColumn("kind", demand_kind("body"))
        .filter(F.col("kind").isNotNull())
        .withColumn("quote", squash("body"))
    )


def digest_line(stars: Column | str, reviewed_at: Column | str, helpful: Column, body: Column | str) -> Column:
    return F.concat(
        F.lit("- "), F.coalesce(_c(stars).cast("string"), F.lit("?")), F.lit("★ | "),
        F.coalesce(_c(reviewed_at).cast("string"), F.lit("?")), F.lit(" | "), helpful, F.lit(" | "),
        F.coalesce(squash(body), F.lit("")),
    )


def review_digest(items: DataFrame, reviews: DataFrame, max_reviews: int | None = None) -> DataFrame:
    """Header and one line per review in weighting order; with `max_reviews` only an item's newest ones.

    A digest is one text, so an item's lines meet in one row of one task: set `max_reviews` where an item may hold millions.
    `annotate_reviews` streams items of any size instead.
    """
    recent = reviews if max_reviews is None else latest_per_item(reviews, max_reviews).drop("rank")
    mark = (
        F.when(F.coalesce(F.col("helpful_ranked"), F.lit(False)), "👍")
        .when(F.coalesce(F.col("helpful_count"), F.lit(0)) != 0, F.col("helpful_count").cast("string"))
        .otherwise("")
    )
    order = _weighting_order("review_uid")
    placed = recent.withColumn("_at", F.row_number().over(Window.partitionBy("item_id").orderBy(*order)))
    lines = placed.groupBy("item_id").agg(
        F.count("*").alias("n_reviews"),
        F.sort_array(
            F.collect_list(F.struct("_at", digest_line("stars", "reviewed_at", mark, "body").alias("line")))
        ).alias("_lines"),
    )
    head = F.concat_ws(
        "\n",
        F.concat(F.lit("Item: "), F.coalesce("name", F.lit("?"))),
        F.concat(F.lit("Category: "), F.coalesce("store_category", F.lit("unknown"))),
        F.concat(
            F.lit("Rating: "), F.coalesce(F.col("rating").cast("string"), F.lit("?")),
            F.lit(" ("), F.coalesce(F.col("rating_count").cast("string"), F.lit("?")), F.lit(" ratings)  Installs: "),
            F.coalesce(F.col("install_count").cast("string"), F.lit("?")),
        ),
    )
    text = F.concat_ws("\n", head, F.transform("_lines", lambda x: x["line"]))
    return items.join(lines, items["id"] == lines["item_id"]).select("item_id", "n_reviews", text.alias("digest"))
