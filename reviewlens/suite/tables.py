"""Scans and table maintenance."""

from __future__ import annotations

from pyspark.sql import functions as F

from reviewlens import schemas as S
from reviewlens.adapters import Data
from reviewlens.operators import tables as T
from reviewlens.operators.store import KeyedTable
from reviewlens.session import shared_folder
from reviewlens.sources.scan import scan
from reviewlens.suite.registry import case, shared


@case("scan_items", "select p_partkey, p_brand, p_size from {part}")
def scan_items(d: Data):
    return scan(d.spark, f"{d.folder}/part.parquet", ["p_partkey", "p_brand", "p_size"])


DELTA = """
select ext_id, 5 - coalesce(rating, cast(0 as double)) as rating, cast(null as varchar(20)) as developer
from {v_items} where rating_count > 1500
union all
select concat('new', cast(s_suppkey as varchar(20))), cast(3 as double), s_name from {supplier}"""
shared("c_delta", DELTA)


@case(
    "upsert_items",
    """
select coalesce(d.ext_id, i.ext_id) as ext_id, i.name,
  case when d.ext_id is not null then d.rating else i.rating end as rating,
  case when d.ext_id is not null then d.developer else i.developer end as developer,
  i.install_count,
  cast(case when d.ext_id is not null then date '2000-07-01' else i.last_scraped end as varchar) as last_scraped
from {v_items} i full outer join {c_delta} d on i.ext_id = d.ext_id""",
)
def upsert_items(d: Data):
    base = d.items.select("ext_id", "name", "rating", "developer", "install_count", "last_scraped")
    out = T.upsert(base, d.sql(DELTA), ["ext_id"], F.lit("2000-07-01").cast("date"), ["last_scraped"])
    return out.withColumn("last_scraped", F.col("last_scraped").cast("string"))


@case(
    "store_upsert",
    """
select coalesce(d.ext_id, i.ext_id) as ext_id, i.name, case when d.ext_id is not null then d.rating else i.rating end as rating,
  case when d.ext_id is not null then d.developer else i.developer end as developer
from {v_items} i full outer join {c_delta} d on i.ext_id = d.ext_id""",
)
def store_upsert(d: Data):
    rows = d.items.select("ext_id", "name", "rating", "developer")
    table = KeyedTable(d.spark, shared_folder(d.spark, "items"))
    table.create(rows.schema, ["ext_id"], buckets=8)
    for number, delta in enumerate((rows, d.sql(DELTA), d.sql(DELTA))):
        # The last batch is a replay of the one before and changes nothing.
        table.merge(delta, lambda old, new: T.upsert(old, new, ["ext_id"]), min(number, 1), "scrape")
    table.clean(keep=1)
    return table.read()


@case(
    "schema_tolerance",
    """
select id, ext_id, name, cast(null as varchar) as developer, cast(null as bigint) as install_count, cast(null as varchar) as price from {v_items}""",
)
def schema_tolerance(d: Data):
    """Items without most of their columns, and a second table that isn't there at all."""
    have = T.ensure_columns(d.items.select("name", "id", "ext_id", F.lit(1).alias("unknown")), S.ITEMS)
    both = have.unionByName(T.ensure_columns(None, S.ITEMS, d.spark))
    return both.select("id", "ext_id", "name", "developer", "install_count", "price")


@case(
    "snapshot_append",
    """
select item_id, cast(captured_at as varchar) as captured_at, rating, rating_count, install_count from {v_snaps}
union all
select id, '2000-06-30', rating, rating_count, install_count from {v_items}""",
)
def snapshot_append(d: Data):
    out = T.append_snapshot(d.table("v_snaps"), d.items, d.as_of)
    return out.withColumn("captured_at", F.col("captured_at").cast("string"))


@case(
    "helpful_sticky",
    """
with hits as (select distinct item_id, pass_uid from {v_reviews} where body like 'If sync%')
select r.item_id, r.review_uid, r.helpful_ranked or h.item_id is not null as helpful_ranked
from {v_reviews} r left join hits h on r.item_id = h.item_id and r.pass_uid = h.pass_uid""",
)
def helpful_sticky(d: Data):
    hits = d.reviews.filter(F.col("body").startswith("If sync"))
    out = T.sticky_flag(d.reviews, hits, ["item_id", "pass_uid"])
    return out.select("item_id", "review_uid", "helpful_ranked")


@case(
    "status_transition",
    """
with queued as (
  select coalesce(v.item_id, x.item_id) as item_id, case when x.item_id is not null then 'queued' else v.status end as status,
    v.requested_at, v.error
  from {v_dives} v full outer join {v_dismissed} x on v.item_id = x.item_id),
failed as (select id as item_id, left(repeat(concat('timeout ', name, ' '), 200), 2000) as error from {v_items} where rating > 4)
select q.item_id, case when f.item_id is not null then 'error' else q.status end as status,
  cast(q.requested_at as varchar) as requested_at, case when f.item_id is not null then f.error else q.error end as error
from queued q left join failed f on q.item_id = f.item_id""",
)
def status_transition(d: Data):
    queued = T.transition(d.table("v_dives"), d.table("v_dismissed"), "queued")
    failing = d.items.filter("rating > 4").select(
        F.col("id").alias("item_id"), F.expr("repeat(concat('timeout ', name, ' '), 200)").alias("message")
    )
    out = T.transition(queued, failing, "error", F.col("message"), insert_missing=False, error_length=S.ERROR_LENGTH)
    return out.withColumn("requested_at", F.col("requested_at").cast("string"))


@case(
    "delete_cascade",
    """
with linked as (select id, rating_count, case when rating > 3 then id - 7 else null end as successor_of from {v_items}),
gone as (select id from {v_items} where rating_count > 1700)
select 'item' as part, id as item_id,
  case when successor_of in (select id from gone) then null else successor_of end as link, cast(1 as bigint) as n
from linked where id not in (select id from gone)
union all
select 'reviews', item_id, null, count(*) from {v_reviews} where item_id not in (select id from gone) group by item_id
union all
select 'dives', item_id, null, count(*) from {v_dives} where item_id not in (select id from gone) group by item_id""",
)
def delete_cascade(d: Data):
    linked = d.items.select("id", "rating_count", F.when(F.col("rating") > 3, F.col("id") - 7).alias("successor_of"))
    gone = d.items.filter("rating_count > 1700")
    kept = T.delete_cascade(linked, {"reviews": d.reviews, "dives": d.table("v_dives")}, gone)
    out = kept["parent"].select(
        F.lit("item").alias("part"), F.col("id").alias("item_id"), F.col("successor_of").alias("link"),
        F.lit(1).cast("long").alias("n"),
    )
    for name in ("reviews", "dives"):
        counts = kept[name].groupBy("item_id").agg(F.count("*").alias("n"))
        out = out.unionByName(
            counts.select(F.lit(name).alias("part"), "item_id", F.lit(None).cast("long").alias("link"), "n")
        )
    return out


@case(
    "constraint_violations",
    """
select 'item rating range' as rule, count(*) filter (where not coalesce(rating between 1 and 5, false)) as violations from {v_items}
union all select 'item installs known', count(*) filter (where install_count is null) from {v_items}
union all select 'review stars range', count(*) filter (where not stars between 1 and 4) from {v_reviews}
union all select 'review body known', count(*) filter (where body is null) from {v_reviews}
union all select 'complaint type known', count(*) filter (where complaint_type not in ('missing_feature', 'bug')) from {v_clusters}
union all select 'review uid unique', cast(coalesce(sum(n - 1), 0) as bigint)
  from (select count(*) as n from {v_reviews} group by item_id, pass_uid having count(*) > 1)
union all select 'dive has item', cast(coalesce(count(*), 0) as bigint) from {v_dives} where item_id + 40 not in (select id from {v_items})""",
)
def constraint_violations(d: Data):
    reviews, items = d.reviews, d.items
    checks = {
        "item rating range": (items, F.col("rating").between(1, 5)),
        "item installs known": (items, F.col("install_count").isNotNull()),
        "review stars range": (reviews, F.col("stars").between(1, 4)),
        "review body known": (reviews, F.col("body").isNotNull()),
        "complaint type known": (d.clusters, F.col("complaint_type").isin("missing_feature", "bug")),
    }
    return T.validate(
        checks,
        unique=[("review uid unique", reviews, ["item_id", "pass_uid"])],
        foreign=[("dive has item", d.table("v_dives").select((F.col("item_id") + 40).alias("item_id")), "item_id", items, "id")],
    )


@case(
    "table_health",
    """
with health as (
  select 'rows items' as probe, count(*) as n from {v_items} union all select 'rows reviews', count(*) from {v_reviews}
  union all select 'dives queued', count(*) from {v_dives} where status = 'queued'
  union all select 'dives done', count(*) from {v_dives} where status = 'done'
  union all select 'dives error', count(*) from {v_dives} where status = 'error'
  union all select 'analyses done', count(*) from {v_reports} where error is null
  union all select 'analyses error', count(*) from {v_reports} where error is not null
  union all select 'analyses low legitimacy', count(*) from {c_legitimacy} where legitimacy < 6e-1
  union all select 'studies layer 2 queued', count(*) from {v_studies} where layer = 2 and status = 'queued'
  union all select 'studies layer 2 done', count(*) from {v_studies} where layer = 2 and status = 'done'
  union all select 'studies layer 3 queued', count(*) from {v_studies} where layer = 3 and status = 'queued'
  union all select 'studies layer 3 done', count(*) from {v_studies} where layer = 3 and status = 'done')
select * from health""",
)
def table_health(d: Data):
    failed = d.table("v_reports").select(
        "item_id", F.when(F.col("error").isNull(), "done").otherwise("error").alias("status")
    )
    analyses = d.analyses().join(failed, "item_id")
    return T.table_health(
        {"items": d.items, "reviews": d.reviews}, d.table("v_dives"), analyses, d.table("v_studies")
    )
