"""Views that give the driver tables the schemas the operators expect.

One SQL text serves Spark and the check engine; names in braces are tables or other views.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
)
AS_OF = "2000-06-30"

VIEWS = {
    "v_items": """
select p_partkey as id, concat('item', cast(p_partkey as varchar(20))) as ext_id,
  concat(p_name, ' ', cast(cast(floor(p_partkey / 50) as bigint) as varchar(20))) as name, replace(p_brand, '#', ' ') as developer,
  case when p_partkey % 11 = 0 then null else concat('https://www.', lower(p_type),
    cast(cast(floor(p_partkey / 50) as bigint) as varchar(20)), '.com/p?id=', cast(p_partkey as varchar(20))) end as website,
  p_type as store_category,
  case when p_partkey % 29 = 0 then null else cast(10 + p_partkey * 7 % 41 as double) / 10 end as rating,
  p_size * 37 as rating_count,
  case when p_partkey % 50 = 0 then null
    else (p_size + 1) * cast(power(10, p_partkey % 6) as bigint) * 10 end as install_count,
  date '2000-06-30' - cast(p_partkey % 60 as int) as last_scraped
from {part}""",
    "v_reviews": """
select l_partkey as item_id,
  concat(cast(l_orderkey as varchar(20)), '-', cast(l_linenumber as varchar(20))) as pass_uid,
  concat_ws('-', cast(l_orderkey as varchar(20)), cast(l_linenumber as varchar(20)), cast(l_partkey as varchar(20)),
    cast(l_suppkey as varchar(20)), cast(cast(round(l_extendedprice * 100) as bigint) as varchar(20)),
    cast(cast(l_shipdate as date) as varchar(20))) as review_uid,
  concat('user', cast(l_suppkey as varchar(20))) as author, cast(1 + cast(l_quantity as int) % 5 as int) as stars,
  case when l_suppkey % 23 = 0 then null else cast(l_shipdate as date) end as reviewed_at,
  l_returnflag = 'R' as helpful_ranked, cast(round(l_tax * 100) as int) as helpful_count,
  l_returnflag as pass_flag,
  case (l_orderkey + l_linenumber) % 6 when 0 then 'If sync worked I would pay for this.'
    when 1 then 'I wish it could  export to CSV' when 2 then 'Almost perfect but it crashes' when 3 then 'Great tool'
    when 4 then 'Does not work any more' else null end as body
from {lineitem}""",
    "v_clusters": """
select l_partkey as item_id, concat(l_returnflag, l_linestatus) as cluster_no,
  concat('complaint ', l_returnflag, l_linestatus) as complaint,
  case l_returnflag when 'R' then 'bug' when 'A' then 'missing_feature' else 'pricing' end as complaint_type,
  case (l_partkey + ascii(l_returnflag)) % 3 when 0 then 'yes' when 1 then 'maybe' else 'no' end as fixable,
  count(distinct l_suppkey) as independent_reviewers,
  max(case when (l_orderkey + l_linenumber) % 6 = 0 then 'I would pay for this' end) as quote
from {lineitem} group by l_partkey, l_returnflag, l_linestatus""",
    "v_analyses": """
select p_partkey as item_id, p_size = 7 as overall_just_bad, p_size between 10 and 14 as needs_heavy_backend,
  concat(cast(p_size as varchar(20)), ' hrs') as build_effort, concat('brief for ', p_name) as brief
from {part} where p_size > 2""",
    "v_causes": """
select l_partkey as item_id, case l_linenumber % 6 when 0 then 'product_issues' when 1 then 'review_bombing'
    when 2 then 'competitor_attack' when 3 then 'off_topic' when 4 then 'praise' else 'mixed' end as cause,
  cast(count(*) as double) / 64 as share
from {lineitem} group by 1, 2""",
    "v_reports": """
select p_partkey as item_id,
  case p_partkey % 7 when 0 then 'product_issues' when 1 then 'review_bombing' when 2 then 'competitor_attack'
    when 3 then 'off_topic' when 4 then 'praise' when 5 then 'mixed' else null end as primary_cause,
  case p_size when 5 then cast(42 as double) / 100 when 6 then cast(17 as double) / 10 else null end as override,
  concat('verdict ', p_brand) as verdict,
  case when p_size = 9 then concat('failed: ', p_name) else null end as error
from {part}""",
    "v_dives": """
select p_partkey as item_id, case p_partkey % 5 when 0 then 'done' when 1 then 'queued' else 'error' end as status,
  date '2000-01-01' + cast(p_partkey % 200 as int) as requested_at,
  cast(null as varchar(20)) as error
from {part} where p_size <= 17""",
    "v_studies": """
select p_partkey as item_id, 2 as layer, case p_partkey % 3 when 0 then 'done' else 'queued' end as status
from {part} where p_size <= 17
union all
select p_partkey, 3, case p_partkey % 2 when 0 then 'done' else 'queued' end from {part} where p_size <= 8""",
    "v_dismissed": """
select p_partkey as item_id, case p_partkey % 2 when 0 then 'Too large' else 'Uninterested' end as reason,
  date '2000-03-01' + cast(p_partkey % 90 as int) as dismissed_at
from {part} where p_size between 40 and 43""",
    "v_prices": """
select p_partkey as item_id,
  case p_partkey % 6 when 0 then 'free' when 1 then 'freemium' when 2 then 'paid' when 3 then 'subscription'
    when 4 then 'ads' else 'unknown' end as pricing_model,
  p_size > 30 as has_paid_tier,
  case when p_partkey % 17 = 0 then null else p_retailprice * p_size end as estimated_monthly_revenue_usd,
  case when p_size > 20 then 'high' else 'low' end as confidence
from {part} where p_size > 4""",
    "v_snaps": """
select item_id, cast(date_trunc('month', reviewed_at) as date) as captured_at,
  cast(sum(stars) as double) / count(*) as rating, cast(count(*) as int) as rating_count,
  cast(sum(helpful_count) as bigint) as install_count
from {v_reviews} where reviewed_at is not null group by 1, 2""",
    "v_orders": """
select concat('o', cast(o_orderkey as varchar(20))) as order_id, cast(o_orderdate as date) as order_date,
  cast(floor(o_totalprice / 1000) as bigint) * 100000 as total_cents, o_orderpriority as account,
  o_orderkey % 4 = 0 as return_hint,
  case o_orderkey % 4 when 0 then 'Nordic Fish Oil, 690mg, 120 Soft Gels' when 1 then 'USB-C Cable [2-Pack] braided'
    when 2 then 'Very long stainless steel kitchen organiser shelf with hooks' else 'Soap (pack of 3)' end as title1,
  case when o_orderstatus = 'F' then concat('Extra ', o_orderpriority) else null end as title2,
  o_orderkey
from {orders}""",
    "v_txns": """
select concat('c', cast(o_orderkey as varchar(20))) as txn_id,
  cast(o_orderdate as date) + cast(o_orderkey % 16 - 3 as int) as txn_date,
  -cast(floor(o_totalprice / 1000) as bigint) * 100000 as amount_cents, o_orderkey
from {orders}
union all
select concat('r', cast(o_orderkey as varchar(20))), cast(o_orderdate as date) + cast(o_orderkey % 140 as int),
  case when o_orderkey % 2 = 0 then cast(floor(o_totalprice / 1000) as bigint) * 100000
    else cast(floor(o_totalprice / 1000) as bigint) * 50000 end, o_orderkey
from {orders} where o_orderpriority = '1-URGENT'""",
    "v_feed": """
select txn_id, txn_date, cast(amount_cents as double) / 100 as amount,
  case o_orderkey % 7 when 0 then 'AMZN Mktp US*2K4' when 1 then 'Amazon.com' when 2 then 'WHOLE FOODS MKT'
    when 3 then 'Prime Video *X1' when 4 then 'Corner Cafe' when 5 then 'Amazon Fresh 99' else null end as merchant_name,
  case when o_orderkey % 3 = 0 then null else concat('feed ', txn_id) end as name,
  case o_orderkey % 4 when 0 then null when 1 then concat('seen o', cast(o_orderkey as varchar(20)))
    else 'groceries' end as notes
from {v_txns}""",
    "v_hubs": """
select l_orderkey, min(l_partkey) as hub from {lineitem} group by l_orderkey""",
    "v_edges": """
select distinct h.hub as src, l.l_partkey as dst
from {lineitem} l join {v_hubs} h on l.l_orderkey = h.l_orderkey where l.l_partkey <> h.hub""",
    "v_order_items": """
select concat('o', cast(l_orderkey as varchar(20))) as order_id, cast(l_shipdate as date) as order_date,
  cast(round(l_extendedprice * 100) as bigint) as cents, p_name as title,
  case when l_returnflag = 'N' and l_linestatus = 'F' then 'Cancelled' when l_returnflag = 'R' then 'Return completed'
    else 'Shipped' end as status,
  concat(lpad(cast(l_linenumber as varchar(20)), 4, '0'), '-', cast(l_partkey as varchar(20)), '-',
    cast(l_suppkey as varchar(20)), '-', cast(cast(round(l_extendedprice * 100) as bigint) as varchar(20)), '-',
    cast(cast(l_shipdate as date) as varchar(20))) as row_no,
  case when l_discount > 0.05 then 2 else 1 end as part_no
from {lineitem} join {part} on l_partkey = p_partkey""",
    "v_accounts": """
select c_name as account, cast(3 * (1 + c_custkey % 5) as int) as lookback_months,
  cast(3 * (c_custkey % 7) as int) as months, date '2000-06-30' - cast(c_custkey % 400 as int) as as_of,
  c_mktsegment as segment, c_custkey
from {customer}""",
}


def placeholders(sql: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\{([a-z]\w*)\}", sql)))


class Data:
    """Driver tables and views of one folder, built when first asked for."""

    def __init__(self, spark: SparkSession, folder: str):
        # Day windows and casts between dates and timestamps are meant in UTC.
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        self.spark, self.folder = spark, folder
        self._made: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        if name not in self._made:
            if name in TABLES:
                self._made[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
            else:
                sql = VIEWS[name]
                self._made[name] = self.spark.sql(sql, **{p: self.table(p) for p in placeholders(sql)})
        return self._made[name]

    def sql(self, text: str) -> DataFrame:
        return self.spark.sql(text, **{p: self.table(p) for p in placeholders(text)})

    @property
    def as_of(self) -> Column:
        return F.lit(AS_OF).cast("date")

    @cached_property
    def items(self) -> DataFrame:
        return self.table("v_items")

    @cached_property
    def reviews(self) -> DataFrame:
        return self.table("v_reviews")

    @cached_property
    def clusters(self) -> DataFrame:
        quotes = F.array_compact(F.array("quote"))
        return self.table("v_clusters").withColumn("wtp_quotes", quotes).drop("quote")

    @cached_property
    def orders(self) -> DataFrame:
        titles = F.array_compact(F.array("title1", "title2"))
        return self.table("v_orders").withColumn("item_titles", titles).drop("title1", "title2", "o_orderkey")

    @cached_property
    def txns(self) -> DataFrame:
        return self.table("v_txns").drop("o_orderkey")

    def scored(self) -> DataFrame:
        from reviewlens.plans.scoring import score_opportunities

        return score_opportunities(self.items, self.table("v_analyses"), self.clusters, self.reviews, self.as_of)

    def analyses(self) -> DataFrame:
        from reviewlens.operators.reviews import legitimacy

        return legitimacy(self.table("v_reports"), self.table("v_causes"))
