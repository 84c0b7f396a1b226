"""Charges, refunds, orders and accounts."""

from __future__ import annotations

from pyspark.sql import functions as F

from reviewlens.adapters import Data
from reviewlens.functions.labels import account_label, is_store_merchant
from reviewlens.functions.money import format_cents, parse_cents
from reviewlens.functions.notes import merchant_name, merge_notes, note_line, short_summary
from reviewlens.operators import accounts, orders as O
from reviewlens.operators import reconcile as R
from reviewlens.session import shared_folder
from reviewlens.sources.exports import orders_from_csv
from reviewlens.suite.registry import SHARED, case, shared

shared(
    "c_charges",
    """
select t.txn_id, t.amount_cents, 'charge' as kind, case coalesce(n, 0) when 0 then 'unmatched' when 1 then 'auto' else 'review' end as status,
  coalesce(n, 0) as candidate_count, dd as day_diff, cast(null as varchar) as refund_match, order_id
from {v_txns} t left join (
  select txn_id, count(*) over (partition by txn_id) as n, dd, order_id,
    row_number() over (partition by txn_id order by abs(dd), order_id) as rn
  from (select t.txn_id, o.order_id, cast(date_diff('day', o.order_date, t.txn_date) as int) as dd
    from {v_txns} t join {v_orders} o on o.total_cents = -t.amount_cents and t.amount_cents < 0)
  where dd between -2 and 10) b on t.txn_id = b.txn_id and b.rn = 1
where t.amount_cents <= 0""",
)
shared(
    "c_full",
    """
select txn_id, count(*) over (partition by txn_id) as n, sum(h) over (partition by txn_id) as nh, dd, order_id,
  row_number() over (partition by txn_id order by h desc, dd, order_id) as rn
from (select t.txn_id, o.order_id, o.return_hint::int as h, cast(date_diff('day', o.order_date, t.txn_date) as int) as dd
  from {v_txns} t join {v_orders} o on o.total_cents = t.amount_cents where t.amount_cents > 0) where dd between 0 and 120""",
)
shared(
    "c_partial",
    """
select txn_id, count(*) over (partition by txn_id) as n, dd, order_id, row_number() over (partition by txn_id order by dd, order_id) as rn
from (select t.txn_id, o.order_id, cast(date_diff('day', o.order_date, t.txn_date) as int) as dd
  from {v_txns} t join {v_orders} o on o.total_cents > t.amount_cents and o.return_hint
    and o.order_date between t.txn_date - 120 and t.txn_date
  where t.amount_cents > 0 and t.txn_id not in (select txn_id from {c_full}))""",
)
shared(
    "c_refunds",
    """
select t.txn_id, t.amount_cents, 'refund' as kind,
  case when f.n is not null then case when f.n = 1 or f.nh = 1 then 'auto' else 'review' end when p.n is not null then 'review' else 'refund' end as status,
  coalesce(f.n, p.n, 0) as candidate_count, coalesce(f.dd, p.dd) as day_diff,
  case when f.n is not null then 'full' when p.n is not null then 'partial' end as refund_match, coalesce(f.order_id, p.order_id) as order_id
from {v_txns} t left join {c_full} f on t.txn_id = f.txn_id and f.rn = 1 left join {c_partial} p on t.txn_id = p.txn_id and p.rn = 1
where t.amount_cents > 0""",
)
shared("c_matches", "select * from {c_charges} union all select * from {c_refunds}")
COLUMNS = ("txn_id", "amount_cents", "kind", "status", "candidate_count", "day_diff", "refund_match", "order_id")
TITLES = """case title1 when 'Nordic Fish Oil, 690mg, 120 Soft Gels' then 'Nordic Fish Oil' when 'USB-C Cable [2-Pack] braided' then 'USB-C Cable braided'
  when 'Soap (pack of 3)' then 'Soap' else 'Very long stainless steel kitchen' end || case when title2 is not null then ' +1' else '' end"""
LINK = "https://www.amazon.com/gp/css/order-details?orderID="


@case("match_charges", "select * from {c_charges}")
def match_charges(d: Data):
    return R.match_charges(d.txns, d.orders).select(*COLUMNS)


@case("match_refunds", "select * from {c_refunds}")
def match_refunds(d: Data):
    return R.match_refunds(d.txns, d.orders).select(*COLUMNS)


@case("reconcile", "select * from {c_matches}")
def reconcile(d: Data):
    return R.reconcile(d.txns, d.orders).select(*COLUMNS)


@case(
    "match_summary",
    """
select count(*) filter (where status = 'auto') as auto, count(*) filter (where status = 'review') as review,
  count(*) filter (where status = 'unmatched') as unmatched, count(*) filter (where status = 'refund') as refund from {c_matches}""",
)
def match_summary(d: Data):
    return R.match_summary(R.reconcile(d.txns, d.orders))


@case(
    "match_review_queue",
    """
select txn_id, status, order_id from {c_matches}
order by case status when 'auto' then 0 when 'review' then 1 when 'unmatched' then 2 when 'refund' then 3 else 4 end, txn_id limit 60""",
)
def match_review_queue(d: Data):
    return R.review_queue(R.reconcile(d.txns, d.orders), 60).select("txn_id", "status", "order_id")


@case(
    "propose_updates",
    f"""
with lines as (
  select m.*, concat('[Order] ', case when kind = 'charge' then '' when refund_match = 'partial' then 'Partial refund — ' else 'Refund — ' end,
      concat_ws(', ', title1, title2), ' · #', o.order_id, ' · {LINK}', o.order_id) as line,
    concat(case kind when 'refund' then 'Amazon refund' else 'Amazon' end, ' — ', {TITLES}) as new_name,
    coalesce(f.notes, '') as notes, f.name
  from {{c_matches}} m join {{v_orders}} o on m.order_id = o.order_id join {{v_feed}} f on m.txn_id = f.txn_id)
select txn_id, kind, status, order_id, case when contains(notes, order_id) then notes when notes = '' then line else concat(notes, chr(10), line) end as new_notes,
  not contains(notes, order_id) as note_changed, new_name, name is distinct from new_name as name_changed from lines""",
)
def propose_updates(d: Data):
    named = d.txns.join(d.table("v_feed").select("txn_id", "merchant_name", "name", "notes"), "txn_id")
    return R.propose_updates(R.reconcile(named, d.orders))


@case(
    "auto_apply_plan",
    """
select txn_id, order_id, 'note' as action from {c_matches} where status = 'auto'
union all select txn_id, order_id, 'rename' from {c_matches} where status = 'auto'""",
)
def auto_apply_plan(d: Data):
    return R.plan_auto_apply(R.reconcile(d.txns, d.orders))


@case(
    "apply_summary",
    """
select count(*) as actions, count(*) filter (where ok and verified is distinct from false and undo) as applied,
  count(*) filter (where ok and verified is distinct from false and not undo) as skipped,
  count(*) filter (where ok and verified is not distinct from false) as refuted, count(*) filter (where not ok) as failed
from (select o_orderstatus <> 'P' as ok, case o_orderkey % 3 when 0 then true when 1 then false end as verified, o_orderkey % 5 < 2 as undo from {orders})""",
)
def apply_summary(d: Data):
    results = d.table("orders").select(
        (F.col("o_orderstatus") != "P").alias("ok"),
        F.when(F.col("o_orderkey") % 3 == 0, True).when(F.col("o_orderkey") % 3 == 1, False).alias("verified"),
        (F.col("o_orderkey") % 5 < 2).alias("undo"),
    )
    return R.apply_summary(results)


@case(
    "merge_notes",
    f"""
select order_id, case when seen then cur when cur = '' then line else concat(cur, chr(10), line) end as notes, not seen as changed
from (select *, contains(cur, order_id) or contains(cur, line) as seen from (
  select order_id, concat('[Order] ', concat_ws(', ', title1, title2), ' · #', order_id, ' · {LINK}', order_id) as line,
    case o_orderkey % 3 when 0 then '' when 1 then concat('bought ', order_id) else 'weekly shop' end as cur from {{v_orders}}))""",
)
def merge_note_lines(d: Data):
    key = F.regexp_replace("order_id", "^o", "").cast("long")
    current = F.when(key % 3 == 0, F.lit(None)).when(key % 3 == 1, F.concat(F.lit("bought "), F.col("order_id"))).otherwise("weekly shop")
    merged = merge_notes(current, "order_id", note_line("item_titles", "order_id"))
    return d.orders.select("order_id", merged.alias("m")).select("order_id", "m.notes", "m.changed")


@case("merchant_names", f"select order_id, concat('Amazon — ', {TITLES}) as name, {TITLES} as summary from {{v_orders}}")
def merchant_names(d: Data):
    return d.orders.select("order_id", merchant_name("item_titles").alias("name"), short_summary("item_titles").alias("summary"))


@case(
    "merchant_classify",
    """
select txn_id, coalesce(merchant_name in ('AMZN Mktp US*2K4', 'Amazon.com', 'Prime Video *X1'), false) as is_store from {v_feed}""",
)
def merchant_classify(d: Data):
    return d.table("v_feed").select("txn_id", is_store_merchant("merchant_name").alias("is_store"))


@case(
    "store_transactions",
    """
select txn_id, cast(txn_date as varchar) as txn_date, cast(round(amount * 100) as bigint) as amount_cents, merchant_name,
  coalesce(name, merchant_name) as name, coalesce(notes, '') as notes
from {v_feed} where merchant_name in ('AMZN Mktp US*2K4', 'Amazon.com', 'Prime Video *X1')""",
)
def store_transactions(d: Data):
    return R.store_transactions(d.table("v_feed")).withColumn("txn_date", F.col("txn_date").cast("string"))


@case("lookback_filter", "select order_id, cast(order_date as varchar) as order_date from {v_orders} where order_date >= date '1999-12-30'")
def lookback_filter(d: Data):
    out = R.within_lookback(d.orders, d.as_of, 6)
    return out.select("order_id", F.col("order_date").cast("string").alias("order_date"))


@case(
    "split_balances",
    """
select t.order_id as txn_id, t.total as total_cents, coalesce(s.s, 0) as split_cents, coalesce(s.s, 0) = t.total as balanced
from (select concat('o', o_orderkey) as order_id, cast(round(o_totalprice * 100) as bigint) as total from {orders}) t
left join (select order_id, cast(sum(cents) as bigint) as s from {v_order_items} group by order_id) s on t.order_id = s.order_id""",
)
def split_balances(d: Data):
    totals = d.table("orders").select(
        F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("txn_id"),
        F.round(F.col("o_totalprice") * 100).cast("long").alias("total_cents"),
    )
    splits = d.table("v_order_items").select(F.col("order_id").alias("txn_id"), "cents")
    return O.split_balances(splits, totals)


ITEM_ORDERS = """
select g.*, x.item_titles from (
  select {key}, cast(min(order_date) as varchar) as order_date, cast(sum(cents) as bigint) as total_cents, bool_or(status like 'Return%') as return_hint
  from {{v_order_items}} where status <> 'Cancelled' group by {key} having sum(cents) > 0) g
left join (select {key}, string_agg(title, '|' order by rank) as item_titles from (
  select {key}, title, row_number() over (partition by {key} order by min(row_no), title) as rank
  from {{v_order_items}} where status <> 'Cancelled' group by {key}, title) where rank <= 10 group by {key}) x using ({key})"""
shared("c_parts", ITEM_ORDERS.format(key="order_id, part_no"))


def _flat(df):
    return df.withColumns(
        {"item_titles": F.array_join("item_titles", "|"), "order_date": F.col("order_date").cast("string")}
    )


@case("orders_from_items", ITEM_ORDERS.format(key="order_id"))
def orders_from_items(d: Data):
    return _flat(O.orders_from_items(d.table("v_order_items")))


@case(
    "merge_exports",
    """
select order_id, part_no, order_date, total_cents, return_hint, item_titles from (
  select *, row_number() over (partition by order_id order by part_no) as rn from {c_parts}) where rn = 1""",
)
def merge_exports(d: Data):
    parts = O.orders_from_items(d.table("v_order_items"), ["order_id", "part_no"])
    return _flat(O.merge_exports(parts))


STORE = """select order_id, order_date, total_cents, account, return_hint, title1 from {v_orders}
union all
select case when title1 like 'USB%' then '' else order_id end, order_date, total_cents, '0-HOUSE', false, concat('House ', title1) from {v_orders} where title2 is not null
union all
select '', order_date, total_cents, '6-GUEST', return_hint, concat('House ', title1) from {v_orders} where title1 like 'USB%' and title2 is not null"""
shared("c_store", STORE)
KEY = "case when order_id <> '' then order_id else concat_ws('|', cast(order_date as varchar), cast(total_cents as varchar), title1) end"


def _store(d: Data):
    return d.sql(STORE).withColumn("item_titles", F.array("title1")).drop("title1")


@case(
    "union_orders",
    f"""
select order_key, account, title, hint as return_hint from (
  select {KEY} as order_key, account, title1 as title, bool_or(return_hint) over (partition by {KEY}) as hint,
    row_number() over (partition by {KEY} order by account desc) as rn from (select distinct * from {{c_store}})) where rn = 1""",
)
def union_orders(d: Data):
    out = O.union_orders(_store(d))
    return out.select("order_key", "account", F.col("item_titles")[0].alias("title"), "return_hint")


@case(
    "reconcile_union",
    """
with u as (
  select order_id, order_date, total_cents from (
    select *, row_number() over (partition by order_id order by account desc) as rn
    from (select order_id, order_date, total_cents, account from {v_orders}
      union all select order_id, order_date, total_cents, '9-SECOND' from {v_orders} where title2 is not null)) where rn = 1),
met as (
  select t.txn_id, count(*) as n from {v_txns} t join u o on o.total_cents = -t.amount_cents
  where t.amount_cents < 0 and date_diff('day', o.order_date, t.txn_date) between -2 and 10 group by 1)
select t.txn_id, coalesce(n, 0) as candidate_count from {v_txns} t left join met m on m.txn_id = t.txn_id where t.amount_cents < 0""",
)
def reconcile_union(d: Data):
    both = d.orders.unionByName(d.orders.filter("size(item_titles) > 1").withColumn("account", F.lit("9-SECOND")))
    orders = O.union_orders(both).drop("order_key")
    return R.match_charges(d.txns.filter("amount_cents < 0"), orders).select("txn_id", "candidate_count")


shared(
    "c_united",
    """
select * exclude (rn) from (
  select order_id, order_date, total_cents, bool_or(return_hint) over (partition by order_id) as return_hint,
    row_number() over (partition by order_id order by account desc) as rn
  from (select order_id, order_date, total_cents, account, return_hint from {v_orders}
    union all select order_id, order_date, total_cents, '9-SECOND', true from {v_orders} where title2 is not null)) where rn = 1""",
)
# The matches as above, over the united orders.
_OVER_UNION = {"{v_orders}": "{c_united}", "{c_full}": "{u_full}", "{c_partial}": "{u_partial}"}
for _name in ("charges", "full", "partial", "refunds"):
    _sql = SHARED[f"c_{_name}"]
    for _old, _new in _OVER_UNION.items():
        _sql = _sql.replace(_old, _new)
    shared(f"u_{_name}", _sql)


@case("reconcile_all_accounts", "select * from {u_charges} union all select * from {u_refunds}")
def reconcile_all_accounts(d: Data):
    second = d.orders.filter("size(item_titles) > 1").withColumns({"account": F.lit("9-SECOND"), "return_hint": F.lit(True)})
    return R.reconcile(d.txns, O.union_orders(d.orders.unionByName(second)).drop("order_key")).select(*COLUMNS)


@case(
    "merge_account_orders",
    """
with fresh as (select order_id, total_cents + 100 as total_cents, title1 from {v_orders} where account = '5-LOW' and title2 is not null),
mine as (select order_id, total_cents, return_hint, title1 from {v_orders} where account in ('1-URGENT'))
select coalesce(f.order_id, m.order_id) as order_id, '1-URGENT' as account, coalesce(f.total_cents, m.total_cents) as total_cents,
  coalesce(m.return_hint, false) as return_hint, '2000-06-30' as last_sync from mine m full outer join fresh f on m.order_id = f.order_id
union all
select order_id, account, total_cents, return_hint, '2000-01-01' from {v_orders} where account <> '1-URGENT'""",
)
def merge_account_orders(d: Data):
    store = d.orders.withColumn("last_sync", F.lit("2000-01-01").cast("date"))
    fresh = d.orders.filter("account = '5-LOW' and size(item_titles) > 1").select(
        "order_id", "order_date", (F.col("total_cents") + 100).alias("total_cents"), "item_titles",
        F.lit(False).alias("return_hint"),
    )
    out = O.merge_account_orders(store, "1-URGENT", fresh, d.as_of)
    return out.select("order_id", "account", "total_cents", "return_hint", F.col("last_sync").cast("string").alias("last_sync"))


@case("forget_account", "select order_id, account from {v_orders} where account <> '3-MEDIUM'")
def forget_account(d: Data):
    return O.forget_account(d.orders, "3-MEDIUM").select("order_id", "account")


@case(
    "account_summary",
    """
select account, count(*) as orders, cast(max(order_date) as varchar) as last_sync, account = '2-HIGH' as active from {v_orders} group by account""",
)
def account_summary(d: Data):
    out = O.account_summary(d.orders.withColumn("last_sync", F.col("order_date")), "2-HIGH")
    return out.withColumn("last_sync", F.col("last_sync").cast("string"))


@case(
    "deepest_sync",
    """
select segment, account, months from (select segment, account, months, row_number() over (partition by segment order by months desc, account) as rn from {v_accounts}) where rn = 1
union all select * from (select 'all', account, months from {v_accounts} order by months desc, account limit 1)""",
)
def deepest_sync(d: Data):
    records = d.table("v_accounts").select("segment", "account", "months")
    per = O.deepest_sync(records, ["segment"])
    overall = O.deepest_sync(records.select("account", "months")).select(F.lit("all").alias("segment"), "account", "months")
    return per.unionByName(overall)


@case(
    "effective_lookback",
    """
select account, lookback_months, case when lookback_months > 3 and segment <> 'BUILDING' and months >= lookback_months then 3 else lookback_months end as months
from {v_accounts}""",
)
def effective_lookback(d: Data):
    records = d.table("v_accounts")
    return O.effective_lookback(records, records.filter("segment <> 'BUILDING'").select("account", "months"))


@case(
    "lookback_plan",
    """
select account, cast(as_of - to_months(lookback_months) as date)::varchar as cutoff, case when lookback_months <= 3 then ''
  when year(as_of - to_months(lookback_months)) = year(as_of) then concat('year-', year(as_of))
  when year(as_of - to_months(lookback_months)) = year(as_of) - 1 then concat('year-', year(as_of), '|year-', year(as_of) - 1)
  else concat('year-', year(as_of), '|year-', year(as_of) - 1, '|year-', year(as_of) - 2) end as filters
from {v_accounts}""",
)
def lookback_plan(d: Data):
    return d.table("v_accounts").select(
        "account",
        O.lookback_cutoff("as_of", "lookback_months").cast("string").alias("cutoff"),
        F.array_join(O.lookback_filters("as_of", "lookback_months"), "|").alias("filters"),
    )


PAGES = """select cast(floor(o_orderkey / 10) as bigint) as page_id, concat('year-', cast(1996 + cast(floor(o_orderkey / 10) as bigint) % 7 as varchar(20))) as year_filter,
  order_date, order_id from {v_orders}"""
shared("c_scan_pages", PAGES)


@case(
    "page_flags",
    """
select page_id, year_filter as filter, count(*) as orders, bool_and(order_date < date '2001-03-30') as all_older,
  not bool_or(concat('year-', year(order_date)) = year_filter) as year_mismatch from {c_scan_pages} group by 1, 2""",
)
def page_flags(d: Data):
    pages = d.sql(PAGES).withColumnRenamed("year_filter", "filter")
    return O.page_flags(pages, F.add_months(F.lit("2001-06-30").cast("date"), -3))


SCAN = """select cast(floor(o_orderkey / 10) as bigint) as page_no, o_orderkey as position, order_id, order_date, total_cents, return_hint, title1 from {v_orders}
union all
select cast(floor(o_orderkey / 10) as bigint) + 1, o_orderkey, order_id, order_date, total_cents, true, title1 from {v_orders} where total_cents > 30000000"""
shared("c_scan", SCAN)


@case(
    "scan_new_per_page",
    """
select page_no, count(*) as rows, count(*) filter (where page_no = first) as new_orders
from (select *, min(page_no) over (partition by order_id) as first from {c_scan}) group by page_no""",
)
def scan_new_per_page(d: Data):
    pages = d.sql(SCAN).withColumn("item_titles", F.array("title1"))
    return O.new_per_page(pages)


@case(
    "scan_merged",
    """
select order_key, page_no, position, total_cents, hint as return_hint, title1 as title from (
  select *, order_id as order_key, bool_or(return_hint) over (partition by order_id) as hint,
    row_number() over (partition by order_id order by page_no, position) as rn from {c_scan}) where rn = 1""",
)
def scan_merged(d: Data):
    out = O.merge_scan_pages(d.sql(SCAN).withColumn("item_titles", F.array("title1")))
    return out.select("order_key", "page_no", "position", "total_cents", "return_hint", F.col("item_titles")[0].alias("title"))


@case(
    "export_orders",
    """
select order_id, order_date, total_cents, return_hint, item_titles from (
  select *, row_number() over (partition by order_id order by part_no) as rn from {c_parts}) where rn = 1""",
)
def export_orders(d: Data):
    """Item lines written as export files, two parts with other headers, and read back as orders."""
    folder = shared_folder(d.spark, "exports")
    dollars = F.concat(
        F.lit("$"), F.format_number(F.floor(F.col("cents") / 100).cast("long"), 0), F.lit("."), F.lpad((F.col("cents") % 100).cast("string"), 2, "0")
    )
    # A file is read by one task: there are more of them the larger the input is.
    files = max(8, d.table("lineitem")._jdf.queryExecution().toRdd().getNumPartitions())
    lines = d.table("v_order_items").repartition(files, "order_id").sortWithinPartitions("order_id", "row_no")
    first = lines.filter("part_no = 1").select(
        F.col("order_id").alias("Order ID"), F.date_format("order_date", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("Order Date"),
        dollars.alias("Total Owed"), F.col("title").alias("Product Name"), F.col("status").alias("Order Status"),
    )
    other = lines.filter("part_no = 2").select(
        F.concat(F.lit('a "quoted", long\nnote '), F.col("row_no")).alias("Note"), F.col("title").alias("TITLE"), F.col("status").alias("order-status"),
        F.date_format("order_date", "M/d/yyyy").alias("order date"), dollars.alias("Item Total"), F.col("order_id").alias("ORDERID"),
    )
    for name, part in (("1", first), ("2", other)):
        part.write.csv(f"{folder}/{name}", header=True, quote='"', escape='"')
    return _flat(orders_from_csv(d.spark, [f"{folder}/1", f"{folder}/2"]))


@case(
    "parse_money",
    """
select o_orderkey, cents, case when cents is null then null else concat(case when cents < 0 then '-' else '' end, '$', format('{:,}', abs(cents) // 100), '.', lpad(cast(abs(cents) % 100 as varchar), 2, '0')) end as shown
from (select o_orderkey, case when o_orderkey % 5 = 4 then null else case when o_orderkey % 5 = 1 then -1 else 1 end * v end as cents
  from (select o_orderkey, cast(round(o_totalprice * 100) as bigint) as v from {orders}))""",
)
def parse_money(d: Data):
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    plain = F.concat(F.format_number((cents / 100).cast("long"), 0), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"))
    turn = F.col("o_orderkey") % 5
    text = (
        F.when(turn == 0, F.concat(F.lit(" $"), plain, F.lit(" "))).when(turn == 1, F.concat(F.lit("-$"), plain))
        .when(turn == 2, F.concat(F.lit("+"), plain)).when(turn == 3, plain).otherwise(F.concat(plain, F.lit("7 USD")))
    )
    texts = d.table("orders").select("o_orderkey", text.alias("text"))
    parsed = texts.select("o_orderkey", parse_cents("text").alias("cents"))
    return parsed.withColumn("shown", format_cents("cents"))


@case(
    "account_labels",
    """
select c_custkey, case c_custkey % 6 when 0 then c_name when 1 then c_name when 2 then null when 3 then null
  when 4 then left(concat(c_name, ' ', c_mktsegment, ' of the long and winding street'), 40) else null end as label from {customer}""",
)
def account_labels(d: Data):
    name, turn = F.col("c_name"), F.col("c_custkey") % 6
    greeting = (
        F.when(turn == 0, F.concat(F.lit("Hello,  "), name)).when(turn == 1, F.concat(F.lit(" hola "), name))
        .when(turn == 2, "Hello, sign in").when(turn == 3, "Hello, Accounts & Lists")
        .when(turn == 4, F.concat(F.lit("Hi "), name, F.lit("  "), F.col("c_mktsegment"), F.lit(" of the long and winding street")))
    )
    return d.table("customer").select("c_custkey", account_label(greeting).alias("label"))


@case(
    "entitlement_status",
    """
with l as (
  select c_custkey, c_acctbal > 4000 as active, case when c_custkey % 5 = 0 then null else timestamp '2000-06-20 06:00:00' + to_days(cast(c_custkey % 25 as int)) end as expires_at,
    case when c_custkey % 3 = 0 then null else timestamp '2000-06-25 18:30:00' + to_days(cast(c_custkey % 11 as int)) end as trial_ends_at,
    case when c_custkey % 4 = 0 then null else timestamp '2000-06-22 00:00:00' + to_days(cast(c_custkey % 8 as int)) end as last_validated_at,
    timestamp '2000-06-30 12:00:00' as t from {customer}),
s as (select *, case when active and (expires_at is null or t <= expires_at) then 'active' when active and t <= last_validated_at + to_days(5) then 'grace'
    when active then 'expired' when t <= trial_ends_at then 'trial' when trial_ends_at is not null then 'trial-expired' else 'none' end as entitlement from l)
select c_custkey, entitlement, case entitlement when 'active' then cast(ceil((epoch(expires_at) - epoch(t)) / 86400) as int) when 'grace' then 0
  when 'trial' then cast(ceil((epoch(trial_ends_at) - epoch(t)) / 86400) as int) when 'trial-expired' then 0 end as days_left,
  entitlement in ('active', 'grace', 'trial') as allowed from s""",
)
def entitlement_status(d: Data):
    key = F.col("c_custkey")

    def moment(start: str, days):
        return F.lit(start).cast("timestamp") + F.make_dt_interval(days.cast("int"))

    licenses = d.table("customer").select(
        "c_custkey",
        (F.col("c_acctbal") > 4000).alias("active"),
        F.when(key % 5 != 0, moment("2000-06-20 06:00:00", key % 25)).alias("expires_at"),
        F.when(key % 3 != 0, moment("2000-06-25 18:30:00", key % 11)).alias("trial_ends_at"),
        F.when(key % 4 != 0, moment("2000-06-22 00:00:00", key % 8)).alias("last_validated_at"),
    )
    out = accounts.entitlement(licenses, F.lit("2000-06-30 12:00:00").cast("timestamp"))
    return out.select("c_custkey", "entitlement", "days_left", "allowed")
