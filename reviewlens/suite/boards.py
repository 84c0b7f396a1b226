"""Top-k boards, queues and charts."""

from __future__ import annotations

from pyspark.sql import functions as F

from reviewlens.adapters import Data
from reviewlens.operators import zone as Z
from reviewlens.plans import dashboards
from reviewlens.suite.registry import case, shared

ITEM = ("id", "ext_id", "rating", "install_count")


@case("top_by_installs", "select id, ext_id, rating, install_count from {v_items} order by install_count desc nulls last, id limit 25")
def top_by_installs(d: Data):
    return Z.top_by_installs(d.items, 25).select(*ITEM)


@case(
    "lowest_rated",
    "select id, ext_id, rating, install_count from {v_items} where rating is not null order by rating, install_count desc nulls last, id limit 10",
)
def lowest_rated(d: Data):
    return Z.lowest_rated(d.items).select(*ITEM)


@case(
    "highest_rated",
    "select id, ext_id, rating, install_count from {v_items} where rating is not null order by rating desc, id limit 10",
)
def highest_rated(d: Data):
    return Z.highest_rated(d.items).select(*ITEM)


@case(
    "opportunity_board",
    """
select t.item_id, i.ext_id, i.name, t.score, t.top_complaint from (select * from {c_scored} order by score desc, item_id limit 200) t
join {v_items} i on i.id = t.item_id""",
)
def opportunity_board(d: Data):
    return dashboards.opportunity_board(d.scored(), d.items).select("item_id", "ext_id", "name", "score", "top_complaint")


POINTS = "select id, ext_id, rating, rating_count, install_count from {v_items} where rating is not null order by install_count desc nulls last, id limit 1500"
shared("c_points", POINTS)


@case("chart_points", "select * from {c_points}")
def chart_points(d: Data):
    return Z.chart_points(d.items, 1500).select("id", "ext_id", "rating", "rating_count", "install_count")


@case(
    "helpful_reviews",
    """
select r.review_uid, r.stars, i.ext_id, i.store_category from (
  select * from {v_reviews} where helpful_ranked order by stars, reviewed_at desc nulls last, review_uid limit 20) r
join {v_items} i on i.id = r.item_id""",
)
def helpful_reviews(d: Data):
    return Z.helpful_reviews(d.reviews, d.items).select("review_uid", "stars", "ext_id", "store_category")


@case(
    "curated_zone",
    """
with candidates as (select * from {v_items} where rating between 25e-1 and 35e-1 order by install_count desc nulls last, id limit 200)
select id, ext_id, legitimacy, primary_cause, coalesce(install_count, 0) * coalesce(legitimacy, 1e0) as weighted_installs
from candidates left join {c_legitimacy} l on l.item_id = id where id not in (select item_id from {v_dismissed})
order by weighted_installs desc, install_count desc nulls last, id limit 25""",
)
def curated_zone(d: Data):
    rows = Z.curated_zone(d.items, d.table("v_dismissed"), d.analyses())
    return rows.select("id", "ext_id", "legitimacy", "primary_cause", "weighted_installs")


@case(
    "dismissed_list",
    """
select item_id, reason, cast(dismissed_at as varchar) as dismissed_at, ext_id, rating from {v_dismissed} join {v_items} on id = item_id""",
)
def dismissed_list(d: Data):
    rows = Z.dismissed_list(d.table("v_dismissed"), d.items)
    return rows.select("item_id", "reason", F.col("dismissed_at").cast("string").alias("dismissed_at"), "ext_id", "rating")


@case(
    "top_revenue",
    """
select item_id, pricing_model, estimated_monthly_revenue_usd from {v_prices}
order by estimated_monthly_revenue_usd desc nulls last, item_id limit 2000""",
)
def top_revenue(d: Data):
    return Z.top_revenue(d.table("v_prices"), 2000).select("item_id", "pricing_model", "estimated_monthly_revenue_usd")


@case(
    "work_queue",
    """
select item_id, cast(requested_at as varchar) as requested_at, ext_id, rating from {v_dives} v join {v_items} i on i.id = v.item_id
where status = 'queued' order by v.requested_at, item_id limit 25""",
)
def work_queue(d: Data):
    rows = Z.work_queue(d.table("v_dives"), d.items, 25)
    return rows.select("item_id", F.col("requested_at").cast("string").alias("requested_at"), "ext_id", "rating")


@case(
    "rating_histogram",
    """
select cast(b as int) as bucket, 1 + b * 5e-1 as low, coalesce(n, 0) as n, b in (3, 4) as in_zone
from range(8) t(b) left join (
  select least(greatest(floor((rating - 1) / 5e-1), 0), 7) as k, count(*) as n from {v_items} where rating is not null group by 1) on k = b""",
)
def rating_histogram(d: Data):
    return Z.rating_histogram(d.items)


shared(
    "c_placed",
    """
select *, cast(floor(x / 8e0 + 5e-1) as int) as cell_x, cast(floor(y / 8e0 + 5e-1) as int) as cell_y from (
  select p.*, 46e0 + (greatest(1e0, least(5e0, rating)) - 1e0) / 4e0 * 420e0 as x,
    16e0 + 194e0 - (log10(install_count) - lo) / case when hi = lo then 1e0 else hi - lo end * 194e0 as y
  from {v_items} p cross join (select log10(min(install_count)) as lo, log10(max(install_count)) as hi from {v_items}
    where install_count > 0 and rating is not null)
  where install_count > 0 and rating is not null)""",
)


@case("scatter_members", "select cell_x, cell_y, id, ext_id, rating_count from {c_placed}")
def scatter_members(d: Data):
    return Z.scatter_members(d.items)


@case(
    "scatter_ticks",
    """
select cast(t as int) as tick, case t when 0 then lo when 1 then (lo + hi) / 2 else hi end as log_installs
from (select log10(min(install_count)) as lo, log10(max(install_count)) as hi from {v_items} where install_count > 0 and rating is not null), range(3) r(t)""",
)
def scatter_ticks(d: Data):
    return Z.scatter_ticks(d.items)


@case(
    "scatter_clusters",
    """
with c as (
  select cell_x, cell_y, count(*) as n, avg(x) as cx, avg(y) as cy, cast(sum(rating_count) as bigint) as total_ratings,
    arg_min(id, cast(rating_count as bigint) * -100000000 + id) as rep_id, arg_min(rating, cast(rating_count as bigint) * -100000000 + id) as rep_rating
  from {c_placed} group by 1, 2)
select cell_x, cell_y, n, round(cx, 6) as center_x, round(cy, 6) as center_y, total_ratings, rep_id, concat('item', rep_id) as rep_ext_id,
  rep_rating between 25e-1 and 35e-1 as in_zone,
  round(25e-1 + sqrt(total_ratings / greatest((select max(total_ratings) from c), 1)) * 5e0, 6) as radius,
  row_number() over (order by total_ratings desc, cell_x, cell_y) <= 12 as labeled
from c""",
)
def scatter_clusters(d: Data):
    rows = Z.scatter_clusters(d.items)
    return rows.withColumns({c: F.round(c, 6) for c in ("center_x", "center_y", "radius")})
