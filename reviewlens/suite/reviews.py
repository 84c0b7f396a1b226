"""Review signals, scores and annotations."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewlens.adapters import Data
from reviewlens.functions.identity import review_uid
from reviewlens.functions.rounding import round_half_even_sql as R2E
from reviewlens.functions.labels import low_legitimacy, recency_label, trend_label
from reviewlens.operators import reviews as R
from reviewlens.operators import zone as Z
from reviewlens.plans import annotate, dashboards, scoring
from reviewlens.session import spread
from reviewlens.suite.registry import SHARED, case, shared

AS_OF = "date '2000-06-30'"
AGE = f"date_diff('day', reviewed_at, {AS_OF})"
PERCENT = f"""case when reviewed_at is null or {AGE} <= 0 then 100 when {AGE} <= 91 then 100 when {AGE} <= 182 then 85
  when {AGE} <= 365 then 70 when {AGE} <= 730 then 50 when {AGE} <= 1095 then 30 else 15 end"""

shared(
    "c_signals",
    f"""
select item_id,
  sum(w) filter (where stars <= 3 and reviewed_at is not null) as wc,
  count(*) filter (where stars <= 3 and reviewed_at is not null) as nc,
  sum(w) filter (where reviewed_at is not null) as wa, count(*) filter (where reviewed_at is not null) as na,
  count(*) filter (where age <= 180) as nr, sum(stars) filter (where age <= 180) as sr,
  count(*) filter (where age <= 180 and stars <= 2) as gr,
  count(*) filter (where age > 180 and age <= 540) as np, sum(stars) filter (where age > 180 and age <= 540) as sp,
  count(*) filter (where age > 180 and age <= 540 and stars <= 2) as gp
from (select *, {PERCENT} as w, case when reviewed_at is not null then greatest({AGE}, 0) end as age from {{v_reviews}}) group by item_id""",
)
shared(
    "c_recency",
    f"""
select item_id, {R2E('f', 3)} as recency from (
  select item_id, coalesce(case when nc > 0 then cast(wc as double) / (cast(100 as double) * nc) end,
    case when na > 0 then cast(wa as double) / (cast(100 as double) * na) end, cast(1 as double)) as f
  from {{c_signals}})""",
)
shared(
    "c_trend",
    f"""
select item_id, coalesce({R2E('decline', 3)}, 0) as decline_score, {R2E('ra', 2)} as recent_rating,
  {R2E('pa', 2)} as baseline_rating, coalesce({R2E('surge', 3)}, 0) as complaint_trend
from (
  select *, case when ra is not null then
    least(cast(1 as double), 6e-1 * (greatest(cast(0 as double), pa - ra) / 2) + 4e-1 * surge) end as decline
  from (
    select item_id, ra, pa, case when ra is not null then greatest(cast(0 as double), rn - pn) end as surge
    from (
      select item_id, case when ok then cast(sr as double) / nr end as ra, case when ok then cast(sp as double) / np end as pa,
        case when ok then cast(gr as double) / nr end as rn, case when ok then cast(gp as double) / np end as pn
      from (select *, nr >= 3 and np >= 3 as ok from {{c_signals}}))))""",
)
shared(
    "c_legitimacy",
    f"""
select item_id, primary_cause, {R2E('value', 3)} as legitimacy from (
select r.item_id, r.primary_cause, case
    when r.override is not null then greatest(cast(0 as double), least(cast(1 as double), r.override))
    when c.s > 0 then greatest(cast(0 as double), least(cast(1 as double), c.w / (c.s * 100)))
    else coalesce(case r.primary_cause when 'product_issues' then 1e0 when 'mixed' then 5e-1 when 'praise' then 1e0
      when 'off_topic' then 15e-2 when 'competitor_attack' then 1e-1 when 'review_bombing' then 0e0 end, 1e0) end as value
from {{v_reports}} r left join (
  select item_id, sum(share) as s, sum(share * case cause when 'product_issues' then 100 when 'mixed' then 50
    when 'off_topic' then 15 when 'competitor_attack' then 10 when 'review_bombing' then 0 else 50 end) as w
  from {{v_causes}} where cause <> 'praise' group by item_id) c on r.item_id = c.item_id)""",
)
shared(
    "c_best",
    """
select item_id, cluster_no, complaint, complaint_type, fixable, independent_reviewers, quote
from (select *, row_number() over (partition by item_id order by quote is not null desc, independent_reviewers desc,
    fixable = 'yes' desc, cluster_no) as rn
  from {v_clusters} where fixable in ('yes', 'maybe')) where rn = 1""",
)
SCORE = """greatest(cast(0 as double),
    cast(45 as double) * least(cast(1 as double), coalesce(b.independent_reviewers, 0) / cast(10 as double)) * {recency}
    + case when b.quote is not null then 20e0 else 0e0 end
    + 15e0 * (case b.fixable when 'yes' then 1e0 when 'maybe' then 5e-1 else 0e0 end)
    + 20e0 * (case when i.install_count > 0 then least(1e0, log10(i.install_count) / log10(1e7)) else 0e0 end)
    + case when coalesce(i.rating between 25e-1 and 35e-1, false) then 10e0 else 0e0 end
    + 15e0 * {decline}
    - case when a.overall_just_bad then 60e0 else 0e0 end
    - case when a.needs_heavy_backend then 15e0 else 0e0 end)"""
SCORED = f"""
select * exclude (raw), {R2E('raw', 1)} as score from (
select i.id as item_id, {SCORE.format(recency="coalesce(r.recency, 1e0)", decline="coalesce(t.decline_score, 0e0)")} as raw,
  b.complaint as top_complaint, b.complaint_type, b.fixable, coalesce(b.independent_reviewers, 0) as demand_intensity,
  coalesce(b.quote, '') as wtp_evidence, a.build_effort, a.brief, coalesce(r.recency, 1e0) as recency_weight,
  coalesce(t.decline_score, 0e0) as decline_score, t.recent_rating, t.baseline_rating,
  coalesce(t.complaint_trend, 0e0) as complaint_trend, 'rules' as model
from {{v_items}} i join {{v_analyses}} a on i.id = a.item_id left join {{c_best}} b on i.id = b.item_id
left join {{c_recency}} r on i.id = r.item_id left join {{c_trend}} t on i.id = t.item_id)"""
shared("c_scored", SCORED)


#: The same signals and scores over the newest 20 reviews of each item.
shared(
    "c_newest",
    """
select * exclude (rn) from (
  select *, row_number() over (partition by item_id order by reviewed_at desc nulls last, review_uid) as rn from {v_reviews})
where rn <= 20""",
)
for _name in ("signals", "recency", "trend", "scored"):
    _text = SHARED[f"c_{_name}"].replace("{v_reviews}", "{c_newest}")
    for _part in ("signals", "recency", "trend"):
        _text = _text.replace(f"{{c_{_part}}}", f"{{c_{_part}_newest}}")
    shared(f"c_{_name}_newest", _text)


def _flat(df):
    return df.withColumn("wtp_evidence", F.array_join("wtp_evidence", "|"))


@case("recency_weight", f"select review_uid, cast({PERCENT} as double) / 100 as weight from {{v_reviews}}")
def recency_weight(d: Data):
    return d.reviews.select("review_uid", R.recency_weight("reviewed_at", d.as_of).alias("weight"))


@case("recency_factor", "select item_id, recency from {c_recency}")
def recency_factor(d: Data):
    return R.recency_factor(d.reviews, d.as_of)


@case("trend_signal", "select * from {c_trend}")
def trend_signal(d: Data):
    return R.trend_signal(d.reviews, d.as_of)


@case("legitimacy", "select * from {c_legitimacy}")
def legitimacy(d: Data):
    return d.analyses()


@case(
    "latest_reviews",
    """
select item_id, review_uid, rank from (
  select *, count(*) over (partition by item_id) as have from (
    select item_id, review_uid, cast(row_number() over (partition by item_id order by reviewed_at desc nulls last, review_uid) as int) as rank
    from {v_reviews}) where rank <= 20) where have >= 15""",
)
def latest_reviews(d: Data):
    return R.latest_per_item(d.reviews, 20, 15).select("item_id", "review_uid", "rank")


@case(
    "review_weight_rank",
    """
select item_id, review_uid, cast(row_number() over (partition by item_id order by helpful_ranked desc, helpful_count desc,
  reviewed_at desc nulls last, review_uid) as int) as rank from {v_reviews}""",
)
def review_weight_rank(d: Data):
    # Rows are sampled before they are dealt into ranges; spread ones are computed once.
    rows = spread(d.reviews.select("item_id", "review_uid", "helpful_ranked", "helpful_count", "reviewed_at"))
    return R.rank_for_weighting(rows).select("item_id", "review_uid", "rank")


@case(
    "merge_reviews",
    """
select item_id, pass_uid, review_uid, stars, flag as helpful_ranked from (
  select *, bool_or(helpful_ranked) over (partition by item_id, pass_uid) as flag,
    row_number() over (partition by item_id, pass_uid order by pass_flag, review_uid) as rn from {v_reviews}) where rn = 1""",
)
def merge_reviews(d: Data):
    passes = d.reviews.select(
        "item_id", F.col("pass_uid").alias("review_uid"), F.col("pass_flag").alias("pass_no"),
        F.col("review_uid").alias("position"), "stars", "helpful_ranked",
    )
    return R.merge_reviews(passes).select(
        "item_id", F.col("review_uid").alias("pass_uid"), F.col("position").alias("review_uid"), "stars", "helpful_ranked"
    )


@case(
    "review_uid",
    """
select review_uid, case when helpful_count > 6 then pass_uid else concat('syn_', left(sha256(concat(author, chr(0),
  coalesce(cast(reviewed_at as varchar), ''), chr(0), coalesce(body, ''), chr(0))), 24)) end as uid from {v_reviews}""",
)
def review_uids(d: Data):
    given = F.when(F.col("helpful_count") > 6, F.col("pass_uid"))
    return d.reviews.select("review_uid", review_uid(given, "author", "reviewed_at", "body").alias("uid"))


@case(
    "demand_signals",
    """
select item_id, review_uid, kind, trim(regexp_replace(body, '\\s+', ' ', 'g')) as quote from (
  select *, case when regexp_matches(body, '(?i)\\b(?:i''d|i would|would gladly|happy to) pay\\b') then 'would_pay'
    when regexp_matches(body, '(?i)\\bi wish (?:it|this) (?:could|would|had)\\b') then 'wish'
    when regexp_matches(body, '(?i)\\balmost perfect(?:,)? but\\b') then 'almost' end as kind from {v_reviews})
where kind is not null""",
)
def demand_signals(d: Data):
    return R.demand_signals(d.reviews).select("item_id", "review_uid", "kind", "quote")


shared(
    "c_stats",
    f"""
select item_id, total, {R2E('mean', 1)} as mean_stars, helpful from (
  select item_id, count(*) as total, cast(sum(stars) as double) / count(stars) as mean,
    count(*) filter (where helpful_ranked) as helpful from {{v_reviews}} group by item_id)""",
)


@case("review_stats", "select * from {c_stats}")
def review_stats(d: Data):
    return R.review_stats(d.reviews)


@case(
    "best_cluster",
    "select item_id, cluster_no, complaint, complaint_type, fixable, independent_reviewers from {c_best}",
)
def best_cluster(d: Data):
    return scoring.best_cluster(d.clusters).drop("wtp_quotes")


@case(
    "clusters_ranked",
    """
select item_id, cluster_no, cast(row_number() over (partition by item_id order by independent_reviewers desc, cluster_no) as int) as rank
from {v_clusters}""",
)
def clusters_ranked(d: Data):
    return Z.clusters_ranked(d.clusters).select("item_id", "cluster_no", "rank")


@case("score_opportunities", "select * from {c_scored}")
def score_opportunities(d: Data):
    return _flat(d.scored())




@case(
    "rank_all",
    f"""
with enough as (select item_id from {{c_newest}} group by item_id having count(*) >= 5),
stored as (select item_id, cast(1 as double) as score from {{v_dives}} where status = 'done'),
fresh as (select s.* from {{c_scored_newest}} s join enough e on s.item_id = e.item_id where s.item_id not in (select item_id from stored))
select item_id, score, top_complaint, demand_intensity, recency_weight, decline_score from fresh
union all select item_id, score, null, null, null, null from stored""",
)
def rank_all(d: Data):
    stored = d.table("v_dives").filter("status = 'done'").select("item_id", F.lit(1.0).alias("score"))
    rows = scoring.rank_all(
        d.items, d.table("v_analyses"), d.clusters, d.reviews, stored, d.as_of, max_reviews=20
    )
    return rows.select("item_id", "score", "top_complaint", "demand_intensity", "recency_weight", "decline_score")


@case(
    "incremental_select",
    "select id, ext_id from {v_items} where id not in (select item_id from {v_dives} where status = 'done')",
)
def incremental_select(d: Data):
    done = d.table("v_dives").filter("status = 'done'")
    return Z.select_for_analysis(d.items, done).select("id", "ext_id")


@case(
    "review_analysis_rows",
    """
with counts as (select item_id, least(count(*), 20) as n from {v_reviews} group by item_id having count(*) >= 5),
zone as (select id from {v_items} where rating between 25e-1 and 35e-1)
select r.item_id, case when r.error is null then 'done' else 'error' end as status,
  case when r.error is null then 'rules' end as model, case when r.error is null then c.n end as reviews_analyzed,
  case when r.error is null then l.legitimacy end as legitimacy, case when r.error is null then r.primary_cause end as primary_cause,
  case when r.error is null then r.verdict end as verdict, r.error
from {v_reports} r join zone z on r.item_id = z.id join counts c on r.item_id = c.item_id
join {c_legitimacy} l on r.item_id = l.item_id
where r.item_id not in (select item_id from {v_dismissed})
union all select item_id, 'done', 'before', null, null, null, null, null from {v_dismissed}""",
)
def review_analysis_rows(d: Data):
    stored = d.table("v_dismissed").select("item_id", F.lit("done").alias("status"), F.lit("before").alias("model"))
    return scoring.review_analysis_rows(
        d.items, d.reviews, d.table("v_reports"), d.table("v_causes"), stored, max_reviews=20
    )


@case(
    "signal_labels",
    """
select s.item_id, case when floor(recency_weight * 100 + 5e-1) >= 85 then 'fresh' when floor(recency_weight * 100 + 5e-1) >= 50 then 'partly' else 'old' end as recency,
  case when decline_score < 2e-1 then 'steady' else 'declining' end as trend, coalesce(l.legitimacy < 6e-1, false) as low_legitimacy
from {c_scored} s left join {c_legitimacy} l on s.item_id = l.item_id""",
)
def signal_labels(d: Data):
    joined = d.scored().join(d.analyses(), "item_id", "left")
    return joined.select(
        "item_id", recency_label("recency_weight").alias("recency"), trend_label("decline_score").alias("trend"),
        low_legitimacy("legitimacy").alias("low_legitimacy"),
    )


@case(
    "review_digest",
    """
with recent as (
  select *, row_number() over (partition by item_id order by helpful_ranked desc, helpful_count desc, reviewed_at desc nulls last, review_uid) as place
  from (select *, row_number() over (partition by item_id order by reviewed_at desc nulls last, review_uid) as rn from {v_reviews}) where rn <= 20),
lines as (
  select item_id, count(*) as n_reviews, string_agg(concat('- ', stars, '★ | ', coalesce(cast(reviewed_at as varchar), '?'), ' | ',
    case when helpful_ranked then '👍' when helpful_count <> 0 then cast(helpful_count as varchar) else '' end, ' | ',
    coalesce(trim(regexp_replace(body, '\\s+', ' ', 'g')), '')), chr(10) order by place) as body from recent group by item_id)
select item_id, n_reviews, concat('Item: ', name, chr(10), 'Category: ', store_category, chr(10), 'Rating: ',
  coalesce(cast(rating as varchar), '?'), ' (', rating_count, ' ratings)  Installs: ', coalesce(cast(install_count as varchar), '?'),
  chr(10), body) as digest
from {v_items} join lines on id = item_id""",
)
def review_digest(d: Data):
    return R.review_digest(d.items, d.reviews, 20)


@case(
    "annotate_items",
    """
with recent as (
  select *, row_number() over (partition by item_id order by helpful_ranked desc, helpful_count desc, reviewed_at desc nulls last, review_uid) as place,
    (body like 'If sync%' or body like 'I wish it%' or body like 'Almost%') as wants
  from (select *, row_number() over (partition by item_id order by reviewed_at desc nulls last, review_uid) as rn from {v_reviews}) where rn <= 20)
select item_id, 'done' as status, cast(null as varchar) as error, cast(count(*) as int) as n_lines, cast(count(*) filter (where wants) as int) as n_demand,
  arg_min(trim(regexp_replace(body, '\\s+', ' ', 'g')), place) filter (where wants) as first_quote
from recent group by item_id""",
)
def annotate_items(d: Data):
    return annotate.annotate_items(d.items, d.reviews, max_reviews=20)


@case(
    "annotate_reviews",
    """
with said as (
  select r.*, i.rating, row_number() over (partition by item_id order by helpful_ranked desc, helpful_count desc, reviewed_at desc nulls last, review_uid) as place
  from {v_reviews} r join {v_items} i on i.id = r.item_id),
stars as (select item_id, string_agg(concat(stars, '=', n, '@', firsts), '|' order by stars) as clusters from (
  select item_id, stars, count(*) as n, min(place) as firsts from said group by 1, 2) group by item_id),
notes as (select item_id, count(*) as n, arg_min(review_uid, place) as top_uid, min(rating) as rating from said group by item_id)
select i.id as item_id, case when i.rating is null or n is null then 'skipped' when i.id % 17 = 0 then 'error' else 'done' end as status,
  case when i.rating is not null and n is not null and i.id % 17 = 0 then concat('ValueError: no notes for item', i.id) end as error,
  case when i.rating is not null and i.id % 17 <> 0 then n end as n, case when i.rating is not null and i.id % 17 <> 0 then top_uid end as top_uid,
  case when i.rating is not null and i.id % 17 <> 0 then clusters end as clusters
from {v_items} i left join notes on notes.item_id = i.id left join stars on stars.item_id = i.id""",
)
def annotate_reviews(d: Data):
    """Clusters of reviews by stars from an injected callable; it fails for some items, and unrated ones are gated."""

    def annotator(item, reviews):
        found, n, top = {}, 0, None
        for n, r in enumerate(reviews, 1):
            top = top or r["review_uid"]
            entry = found.setdefault(r["stars"], {"stars": r["stars"], "n": 0, "first": n})
            entry["n"] += 1
        if item["id"] % 17 == 0:
            raise ValueError(f"no notes for {item['ext_id']}")
        return {"profile": {"n": n, "top_uid": top}, "clusters": [found[k] for k in sorted(found)]}

    record = T.StructType.fromDDL("profile struct<n: long, top_uid: string>, clusters array<struct<stars: int, n: long, first: long>>")
    items = d.items.select("id", "ext_id", "rating")
    rows = d.reviews.select("item_id", "review_uid", "stars", "helpful_ranked", "helpful_count", "reviewed_at")
    out = annotate.annotate_reviews(items, rows, annotator, record, gate=F.col("rating").isNotNull())
    shown = F.transform("clusters", lambda c: F.format_string("%d=%d@%d", c["stars"], c["n"], c["first"]))
    return out.select("item_id", "status", "error", "profile.n", "profile.top_uid", F.array_join(shown, "|").alias("clusters"))


@case(
    "annotation_rows",
    """
select item_id, 'done' as status, 'rules' as model, cast(null as varchar) as error, concat('about ', item_id) as what_it_is,
  case when status = 'done' then 'build' else 'avoid' end as recommendation from {v_dives}""",
)
def annotation_rows(d: Data):
    records = d.table("v_dives").select(
        "item_id",
        F.struct(
            F.concat(F.lit("about "), F.col("item_id").cast("string")).alias("what_it_is"),
            F.when(F.col("status") == "done", "build").otherwise("avoid").alias("recommendation"),
        ).alias("rec"),
    )
    return annotate.annotation_rows(records, done=True)


@case(
    "item_detail",
    """
select i.id as item_id, i.ext_id, i.name, i.rating, i.install_count, coalesce(t.total, 0) as total, t.mean_stars,
  coalesce(t.helpful, 0) as helpful, s.score, s.top_complaint, p.pricing_model, coalesce(v.status, 'none') as dive, l.legitimacy,
  y.layer2, y.layer3
from {v_items} i
left join {c_stats} t on i.id = t.item_id
left join {c_scored} s on i.id = s.item_id left join {v_prices} p on i.id = p.item_id left join {v_dives} v on i.id = v.item_id
left join {c_legitimacy} l on i.id = l.item_id
left join (select item_id, max(case when layer = 2 then status end) as layer2, max(case when layer = 3 then status end) as layer3
  from {v_studies} group by item_id) y on i.id = y.item_id""",
)
def item_detail(d: Data):
    tables = {
        "items": d.items.withColumn("rating", F.col("rating").cast("decimal(2,1)")), "reviews": d.reviews,
        "opportunities": d.scored(), "prices": d.table("v_prices"), "dives": d.table("v_dives"),
        "analyses": d.analyses(), "studies": d.table("v_studies"),
    }
    out = dashboards.item_details(tables, d.spark)
    return out.withColumn("rating", F.col("rating").cast("double"))


@case(
    "single_item_detail",
    """
select 'item' as part, cast(id as varchar) as key from {v_items} where ext_id = 'item42'
union all select 'review', review_uid from (select * from {v_reviews} where item_id = 42 order by reviewed_at desc nulls last, review_uid limit 5)
union all select 'opportunity', top_complaint from {c_scored} where item_id = 42
union all select 'dive', status from {v_dives} where item_id = 42
union all select 'price', pricing_model from {v_prices} where item_id = 42""",
)
def single_item_detail(d: Data):
    tables = {
        "items": d.items.withColumn("rating", F.col("rating").cast("decimal(2,1)")), "reviews": d.reviews,
        "opportunities": d.scored(), "prices": d.table("v_prices"), "dives": d.table("v_dives"),
        "analyses": d.analyses(), "studies": d.table("v_studies"),
    }
    parts = dashboards.item_detail(tables, "item42", d.spark, reviews=5)
    shown = {
        "item": ("item", F.col("id").cast("string")), "review": ("reviews", F.col("review_uid")),
        "opportunity": ("opportunity", F.col("top_complaint")), "dive": ("dive", F.col("status")),
        "price": ("price", F.col("pricing_model")),
    }
    out = None
    for name, (part, key) in shown.items():
        rows = parts[part].select(F.lit(name).alias("part"), key.alias("key"))
        out = rows if out is None else out.unionByName(rows)
    return out


@case(
    "snapshot_deltas",
    """
select item_id, cast(captured_at as varchar) as captured_at, cast(lag(captured_at) over w as varchar) as prev_captured_at,
  rating - lag(rating) over w as rating_delta, rating_count - lag(rating_count) over w as rating_count_delta,
  install_count - lag(install_count) over w as install_delta
from {v_snaps} window w as (partition by item_id order by captured_at)""",
)
def snapshot_deltas(d: Data):
    out = Z.snapshot_deltas(d.table("v_snaps"))
    return out.withColumns({c: F.col(c).cast("string") for c in ("captured_at", "prev_captured_at")})
