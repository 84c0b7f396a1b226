"""Zone predicates, filters, joins and identity."""

from __future__ import annotations

from pyspark.sql import functions as F

from reviewlens.adapters import Data
from reviewlens.functions.identity import category_display, is_same, normalize_identity, single_known
from reviewlens.functions.labels import dive_rank, money_status
from reviewlens.functions.money import fmt_compact, fmt_usd
from reviewlens.operators import graph, identity
from reviewlens.operators import zone as Z
from reviewlens.suite.registry import case, shared

ZONE = "coalesce(rating between 25e-1 and 35e-1, false)"
shared("c_saved", "select item_id, count(*) as saved from {v_reviews} group by item_id")


def _saved(d: Data):
    """Items with their count of saved reviews."""
    return Z.with_saved_count(d.items, d.reviews)


@case("zone_candidates", f"select id, ext_id, rating, install_count from {{v_items}} where {ZONE}")
def zone_candidates(d: Data):
    return Z.zone_candidates(d.items).select("id", "ext_id", "rating", "install_count")


@case("fetch_gate", f"select id, {ZONE} as gated, true as ungated from {{v_items}}")
def fetch_gate(d: Data):
    return d.items.select(
        "id", Z.should_fetch_reviews("rating").alias("gated"),
        Z.should_fetch_reviews("rating", zone_only=False).alias("ungated"),
    )


@case(
    "freshness_skip",
    """
select id, coalesce(saved >= 30 and rating_count <= prior, false) as fresh
from (select i.id, i.rating_count, coalesce(s.saved, 0) as saved,
    case when i.rating > 45e-1 then null else i.rating_count + i.id % 3 - 1 end as prior
  from {v_items} i left join {c_saved} s on i.id = s.item_id)""",
)
def freshness_skip(d: Data):
    prior = F.when(F.col("rating") > 4.5, F.lit(None)).otherwise(F.col("rating_count") + F.col("id") % 3 - 1)
    # A null rating is not above 4.5, so its prior count is known.
    return _saved(d).select("id", Z.reviews_are_fresh(F.col("rating_count"), prior, F.col("saved"), 30).alias("fresh"))


@case(
    "plan_fetch",
    """
select ext_id, 'missing' as why from {c_wanted} where ext_id not in (select ext_id from {v_items})
union all
select ext_id, 'stale' from {c_wanted} where ext_id not in (select ext_id from {v_items} where last_scraped >= date '2000-06-01')""",
)
def plan_fetch(d: Data):
    wanted = d.sql(WANTED)
    cutoff = F.lit("2000-06-01").cast("date")
    missing = Z.plan_fetch(wanted, d.items).withColumn("why", F.lit("missing"))
    return missing.unionByName(Z.plan_fetch(wanted, d.items, cutoff).withColumn("why", F.lit("stale")))


WANTED = """select ext_id from {v_items}
union all select concat('supplier', cast(s_suppkey as varchar(20))) from {supplier}"""
shared("c_wanted", WANTED)


@case(
    "opportunity_filter",
    """
select item_id, score, decline_score, money from (
  select s.*, case when coalesce(p.pricing_model, 'unknown') = 'unknown' then 'unknown'
    when p.has_paid_tier or p.pricing_model in ('paid', 'freemium', 'subscription') then 'paid' else 'free' end as money
  from {c_scored} s left join {v_prices} p on s.item_id = p.item_id)
where complaint_type = 'bug' and decline_score >= 2e-1 and money = 'paid'""",
)
def opportunity_filter(d: Data):
    board = d.scored().join(d.table("v_prices"), "item_id", "left")
    kept = Z.filter_opportunities(board, "bug", True, "paid")
    kept = kept.withColumn("money", money_status("pricing_model", "has_paid_tier"))
    return Z.sort_opportunities(kept, "decline-desc").select("item_id", "score", "decline_score", "money")


@case(
    "zone_filter",
    """
select i.id, i.install_count, i.rating, coalesce(s.saved, 0) as saved from {v_items} i left join {c_saved} s on i.id = s.item_id
join {v_prices} p on i.id = p.item_id
where install_count >= 10000 and rating < 3 and coalesce(saved, 0) > 0 and store_category = 'ECONOMY'
  and pricing_model not in ('unknown', 'paid', 'freemium', 'subscription') and not has_paid_tier""",
)
def zone_filter(d: Data):
    rows = _saved(d).join(d.table("v_prices").withColumnRenamed("item_id", "id"), "id")
    kept = Z.filter_zone(rows, 10_000, "lower", True, "ECONOMY", "unpaid")
    return kept.select("id", "install_count", "rating", "saved")


@case(
    "zone_sorted",
    f"""
select id, rating, cast(row_number() over (order by rating desc nulls last, id) as int) as place from {{v_items}}""",
)
def zone_sorted(d: Data):
    placed = Z.place_nulls_last(d.items.select("id", "rating"), "rating", "desc")
    return placed.select("id", "rating", F.col("place").cast("int").alias("place"))


@case(
    "saved_counts",
    "select i.id, coalesce(s.saved, 0) as saved from {v_items} i left join {c_saved} s on i.id = s.item_id",
)
def saved_counts(d: Data):
    return _saved(d).select("id", "saved")


@case(
    "layer_eligibility",
    """
select item_id, cast(1 as int) as layer from {v_dives}
union all select item_id, 2 from {v_dives} where status = 'done'
union all select item_id, 3 from {v_dives} where item_id in (select item_id from {v_studies} where layer = 2 and status = 'done')""",
)
def layer_eligibility(d: Data):
    out = None
    for layer in (1, 2, 3):
        part = Z.eligible_for_layer(d.table("v_dives"), d.table("v_studies"), layer).withColumn("layer", F.lit(layer))
        out = part if out is None else out.unionByName(part)
    return out


@case(
    "dive_status_rank",
    """
select id, coalesce(status, 'none') as status, case status when 'done' then 3 when 'queued' then 2 when 'error' then 1 else 0 end as rank
from {v_items} left join {v_dives} on id = item_id""",
)
def dive_status_rank(d: Data):
    joined = d.items.join(d.table("v_dives").withColumnRenamed("item_id", "id"), "id", "left")
    return joined.select("id", F.coalesce("status", F.lit("none")).alias("status"), dive_rank("status").alias("rank"))


@case(
    "category_display",
    """
select id, case slug when 'productivity/tools' then 'Productivity / Tools' when 'lifestyle/well_being' then 'Lifestyle / Well-being'
    when 'lifestyle' then 'Lifestyle' when '/make_chrome_yours/privacy/' then 'Make Chrome Yours / Privacy & Security'
    when 'productivity/web3-dev_kits' then 'Productivity / Web3 Dev Kits' when 'new_things/' || lower(store_category) then 'New Things / ' || left(store_category, 1) || lower(substr(store_category, 2))
    else null end as display from {c_slugs}""",
)
def categories(d: Data):
    return d.sql(SLUGS).select("id", category_display("slug").alias("display"))


SLUGS = """select id, store_category, case id % 7 when 0 then 'productivity/tools' when 1 then 'lifestyle/well_being' when 2 then 'lifestyle'
  when 3 then '/make_chrome_yours/privacy/' when 4 then 'productivity/web3-dev_kits' when 5 then concat('new_things/', lower(store_category))
  else '/' end as slug from {v_items}"""
shared("c_slugs", SLUGS)


@case(
    "category_list",
    "select distinct store_category from {v_items} where store_category is not null and store_category <> ''",
)
def category_list(d: Data):
    return Z.category_list(d.items)


@case(
    "identity_normalize",
    """
select id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(coalesce(website, ''))), '^https?://', ''),
    '^www\\.', ''), '[/?#].*$', ''), '[^a-z0-9]+', ' ', 'g')) as site,
  trim(regexp_replace(lower(developer), '[^a-z0-9]+', ' ', 'g')) as maker
from {v_items}""",
)
def identity_normalize(d: Data):
    return d.items.select("id", normalize_identity("website").alias("site"), normalize_identity("developer").alias("maker"))


shared(
    "c_norm",
    """
select id, ext_id, name as name, lower(regexp_replace(developer, '[^A-Za-z0-9]+', ' ', 'g')) as developer,
  regexp_replace(regexp_extract(website, 'www\\.([^/]*)', 1), '[^a-z0-9]+', ' ', 'g') as website from {v_items}""",
)
PAIRS = """
select a.id as a_id, b.id as b_id, concat_ws('|', case when a.name = b.name then 'name' end, case when a.developer = b.developer then 'developer' end,
    case when a.website = b.website and a.website <> '' then 'website' end) as points,
  (a.name = b.name)::int + (a.developer = b.developer)::int + coalesce((a.website = b.website and a.website <> '')::int, 0) as hits
from {c_norm} a join {c_norm} b on a.ext_id <> b.ext_id"""
shared("c_pairs", PAIRS)


@case(
    "same_items",
    """
select a.id as left_id, b.id as right_id, a.ext_id = b.ext_id or (a.name = b.name)::int + (a.developer = b.developer)::int
  + coalesce((a.website = b.website and a.website <> '')::int, 0) >= 2 as same
from {c_norm} a join {c_norm} b on b.id = a.id or b.id = a.id + 25""",
)
def same_items(d: Data):
    """Each item beside itself and a later one: one id, or two agreeing fields."""
    items = d.items.select("id", "ext_id", "name", "developer", "website")
    left = items.select(F.explode(F.array("id", F.col("id") + 25)).alias("other"), *items.columns)
    pairs = left.alias("l").join(items.alias("r"), F.col("l.other") == F.col("r.id"))
    return pairs.select(F.col("l.id").alias("left_id"), F.col("r.id").alias("right_id"), is_same("l", "r").alias("same"))


@case(
    "successor_links",
    """
select a_id as successor_id, b_id as predecessor_id, points from (
  select *, row_number() over (partition by a_id order by hits desc, b_id) as rn from {c_pairs} where hits >= 2 and b_id < a_id) where rn = 1""",
)
def successor_links(d: Data):
    return identity.link_successors(d.items).withColumn("points", F.array_join("points", "|"))


@case(
    "successor_lookup",
    """
select a_id as candidate_id, b_id as match_id, points from (
  select p.*, row_number() over (partition by a_id order by hits desc, b_id) as rn from {c_pairs} p
  join {v_items} i on i.id = p.a_id where hits >= 2 and i.rating < 2) where rn = 1""",
)
def successor_lookup(d: Data):
    found = identity.find_successor_match(d.items.filter("rating < 2"), d.items)
    return found.withColumn("points", F.array_join("points", "|"))


@case(
    "successor_writeback",
    """
select i.id, l.successor_of, l.points as successor_points from {v_items} i left join (
  select a_id, b_id as successor_of, points from (
    select *, row_number() over (partition by a_id order by hits desc, b_id) as rn from {c_pairs} where hits >= 2 and b_id < a_id) where rn = 1) l
on i.id = l.a_id""",
)
def successor_writeback(d: Data):
    base = d.items.withColumns(
        {"successor_of": F.lit(None).cast("long"), "successor_points": F.lit(None).cast("array<string>")}
    )
    out = identity.write_links(base, identity.link_successors(d.items))
    return out.select("id", "successor_of", F.array_join("successor_points", "|").alias("successor_points"))


@case(
    "related_reach",
    """
with recursive walk(id, depth) as (
  select p_partkey, 0 from {part} where p_size = 1
  union
  select e.dst, w.depth + 1 from walk w join {v_edges} e on e.src = w.id where w.depth < 40)
select id, cast(min(depth) as int) as depth from walk group by id""",
)
def related_reach(d: Data):
    seeds = d.table("part").filter("p_size = 1").select(F.col("p_partkey").alias("id"))
    return graph.reachable(seeds, d.table("v_edges"))


@case(
    "taxonomy_extend",
    """
with seen as (select lower(p_type) as slug, min(p_partkey) as position from {part} group by 1
  union all select concat('brand/', lower(p_brand)), min(p_partkey) from {part} group by 1)
select slug, false as extra, position from seen where slug not like 'brand/%'
union all select slug, true, position from seen where slug like 'brand/%'""",
)
def taxonomy_extend(d: Data):
    part = d.table("part")
    known = part.groupBy(F.lower("p_type").alias("slug")).agg(F.min("p_partkey").alias("position"))
    named = part.select(F.col("p_partkey").alias("position"), F.lower("p_type").alias("slug")).unionByName(
        part.select(F.col("p_partkey").alias("position"), F.concat(F.lit("brand/"), F.lower("p_brand")).alias("slug"))
    )
    return graph.extend_taxonomy(known, named)


@case(
    "category_from_links",
    """
select page_id, case when n = 1 then name end as category from (
  select page_id, count(distinct name) as n, min(name) as name from (
    select page_id, case word when 'the' then 'Productivity / Tools' when 'of' then 'Lifestyle / Games' when 'de' then 'Lifestyle / Art & Design'
      when 'la' then 'Make Chrome Yours / Accessibility' end as name
    from (select page_id, lower(unnest(regexp_extract_all(html, 'href="/([^"]*)"', 1))) as word from {pages}
      union all select page_id, null from {pages})) group by page_id)""",
)
def category_from_links(d: Data):
    words = F.transform(F.regexp_extract_all("html", F.lit('href="/([^"]*)"'), F.lit(1)), F.lower)
    table = {"the": "productivity/tools", "of": "/lifestyle/games", "de": "lifestyle/art", "la": "make_chrome_yours/accessibility/"}
    slugs = F.transform(words, lambda w: F.coalesce(
        *[F.when(w == k, F.lit(v)) for k, v in table.items()], F.concat(F.lit("other/"), w)))
    return d.table("pages").select("page_id", single_known(slugs).alias("category"))


@case(
    "pricing_status",
    """
select item_id, case when pricing_model = 'unknown' then 'unknown'
  when has_paid_tier or pricing_model in ('paid', 'freemium', 'subscription') then 'paid' else 'free' end as status from {v_prices}""",
)
def pricing_status(d: Data):
    return d.table("v_prices").select("item_id", money_status("pricing_model", "has_paid_tier").alias("status"))


def _compact(v: str) -> str:
    def one(unit: str, suffix: str) -> str:
        t = f"cast(floor({v} / ({unit} / 10) + 5e-1) as bigint)"
        return f"concat(cast({t} // 10 as varchar), '.', cast({t} % 10 as varchar), '{suffix}')"

    def whole(unit: str, suffix: str) -> str:
        return f"concat(cast(cast(floor({v} / {unit} + 5e-1) as bigint) as varchar), '{suffix}')"

    return f"""case when {v} is null then '—' when {v} >= 1e7 then {whole('1e6', 'M')} when {v} >= 1e6 then {one('1e6', 'M')}
      when {v} >= 1e4 then {whole('1e3', 'k')} when {v} >= 1e3 then {one('1e3', 'k')} else {whole('1e0', '')} end"""


@case(
    "compact_format",
    f"""
select i.id, {_compact('cast(install_count as double)')} as installs,
  case when r is null then '—' when r <= 0 then '$0' else concat('$', {_compact('r')}) end as revenue
from {{v_items}} i left join (select item_id, estimated_monthly_revenue_usd - 5000 as r from {{v_prices}}) p on i.id = p.item_id""",
)
def compact_format(d: Data):
    rows = d.items.join(d.table("v_prices").withColumnRenamed("item_id", "id"), "id", "left")
    return rows.select(
        "id", fmt_compact("install_count").alias("installs"),
        fmt_usd(F.col("estimated_monthly_revenue_usd") - 5000).alias("revenue"),
    )
