"""Parsers over page text, markup and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from reviewlens.adapters import Data
from reviewlens.functions import labels as L
from reviewlens.functions import parsing as P
from reviewlens.operators import tables as T
from reviewlens.plans import pages as G
from reviewlens.plans import studies as U
from reviewlens.session import spread
from reviewlens.suite.registry import case, shared


@case(
    "parse_counts",
    """
select id, case turn when 0 then install_count when 1 then 1000000 + (id % 10) * 100000 when 2 then null else (id % 90 + 1) * 1000 end as installs,
  case when turn < 3 then rating else null end as rating,
  cast(case turn when 0 then rating_count when 1 then 1200 else null end as bigint) as ratings,
  cast(case turn when 0 then nullif(id % 5, 0) when 1 then 2 when 2 then 4 else null end as int) as raw_stars,
  case when turn < 2 then concat('1.', id, '.0-b') else null end as version
from (select *, id % 4 as turn from {v_items})""",
)
def parse_counts(d: Data):
    turn = F.col("id") % 4
    key = F.col("id").cast("string")
    rating = F.col("rating").cast("string")
    rows = d.items.select(
        "id", turn.alias("turn"),
        F.when(turn == 0, F.concat(F.format_number("install_count", 0), F.lit("+ users")))
        .when(turn == 1, F.concat(F.lit("about 1."), (F.col("id") % 10).cast("string"), F.lit("M users")))
        .when(turn == 2, "no count here").otherwise(F.concat((F.col("id") % 90 + 1).cast("string"), F.lit("K USERS"))).alias("a"),
        F.when(turn == 0, F.concat(F.lit("Rated "), rating, F.lit(" out of 5"))).when(turn == 1, F.concat(F.lit(" "), rating, F.lit(" ")))
        .when(turn == 2, F.concat(rating, F.lit(" out of 5 stars"))).otherwise("9.5").alias("b"),
        F.when(turn == 0, F.concat(F.format_number("rating_count", 0), F.lit(" ratings"))).when(turn == 1, "1.2K Reviews").otherwise("none").alias("c"),
        F.when(turn == 0, F.concat((F.col("id") % 5).cast("string"), F.lit(" stars"))).when(turn == 1, "Rated 2.5 out of 5")
        .when(turn == 2, "3.5 out of 5").otherwise("7 stars").alias("e"),
        F.when(turn == 0, F.concat(F.lit("Version 1."), key, F.lit(".0-b "))).when(turn == 1, F.concat(F.lit("version: 1."), key, F.lit(".0-b")))
        .otherwise("Versions differ").alias("f"),
    )
    return rows.select(
        "id", P.parse_install_count("a").alias("installs"), P.parse_rating("b").alias("rating"),
        P.parse_rating_count("c").alias("ratings"),
        P.parse_star_label("e").alias("raw_stars"),
        P.parse_version("f").alias("version"),
    )


@case(
    "parse_dates",
    """
select review_uid, cast(case helpful_count % 8 when 0 then reviewed_at when 1 then reviewed_at when 2 then reviewed_at when 3 then reviewed_at
    when 4 then date '2000-06-30' - stars * 7 when 5 then date '2000-06-30' - stars * 30 when 6 then date '2000-06-30' else null end as varchar) as parsed,
  cast(case when stars = 5 then null else reviewed_at end as varchar) as normalized
from {v_reviews}""",
)
def parse_dates(d: Data):
    turn, day, n = F.col("helpful_count") % 8, F.col("reviewed_at"), F.col("stars").cast("string")
    text = (
        F.when(turn == 0, F.concat(F.lit("Updated "), F.date_format(day, "MMMM d, yyyy")))
        .when(turn == 1, F.date_format(day, "MMM d, yyyy"))
        .when(turn == 2, F.concat(F.lit("added "), F.date_format(day, "d MMMM yyyy")))
        .when(turn == 3, F.concat(day.cast("string"), F.lit("T10:00:00Z")))
        .when(turn == 4, F.concat(F.lit("Updated "), n, F.lit(" weeks ago")))
        .when(turn == 5, F.concat(n, F.lit(" Months ago")))
        .when(turn == 6, F.concat(n, F.lit(" hours ago")))
        .otherwise(F.concat(F.lit("99999999"), n, F.lit("999 years ago")))
    )
    other = F.col("helpful_count") % 6
    export = (
        F.when(F.col("stars") == 5, "not a date").when(other == 0, F.concat(F.lit(" "), day.cast("string"), F.lit("T08:30:00Z")))
        .when(other == 1, F.date_format(day, "M/d/yyyy")).when(other == 2, F.date_format(day, "d MMMM yyyy"))
        .when(other == 3, F.date_format(day, "yyyy/MM/dd")).when(other == 4, F.date_format(day, "MMM d yyyy"))
        .otherwise(F.date_format(day, "EEE, d MMM yyyy"))
    )
    texts = spread(d.reviews.select("review_uid", text.alias("text"), export.alias("export")))
    return texts.select(
        "review_uid", P.parse_date("text", d.as_of).cast("string").alias("parsed"),
        P.normalize_date("export").cast("string").alias("normalized"),
    )


@case(
    "parse_general_dates",
    "select review_uid, cast(reviewed_at as varchar) as parsed, cast(reviewed_at as varchar) as normalized from {v_reviews}",
)
def parse_general_dates(d: Data):
    turn, day = (F.col("stars") + F.col("helpful_count")) % 8, F.col("reviewed_at")

    def shown(pattern: str):
        return F.date_format(day, pattern)

    text = (
        F.when(turn == 0, F.concat(shown("M/d/yy"), F.lit(" 10:30")))
        .when(turn == 1, F.when(F.dayofmonth(day) > 12, shown("d/MM/yyyy")).otherwise(shown("MM-d-yyyy")))
        .when(turn == 2, F.concat(F.lit("seen on the "), shown("d'th of 'MMMM, yyyy"), F.lit(" in May")))
        .when(turn == 3, shown("yyyy.M.d")).when(turn == 4, shown("EEEE, d-MMM-yyyy")).when(turn == 5, shown("'since 'yyyy MMM d"))
        .when(turn == 6, F.concat(F.lit("v1.2.30, 1/2 off, "), shown("MMMM d'st', yy"))).otherwise(shown("'('yyyy/M/dd')'"))
    )
    texts = spread(d.reviews.select("review_uid", text.alias("text")))
    return texts.select(
        "review_uid", P.parse_date("text", d.as_of).cast("string").alias("parsed"),
        P.normalize_date("text").cast("string").alias("normalized"),
    )


ORDER_NO = "concat('114-', lpad(cast(o_orderkey as varchar(20)), 7, '0'), '-', lpad(cast(o_orderkey * 7 % 10000000 as varchar(20)), 7, '0'))"
CARDS = f"""select o_orderkey, cast(o_orderdate as date) as order_date, cast(round(o_totalprice * 100) as bigint) as cents,
  {ORDER_NO} as order_id, o_orderkey % 3 as turn, o_orderpriority from {{orders}}"""
shared("c_cards", CARDS)


def _cards(d: Data):
    dollars = F.concat(
        F.lit("$"), F.format_number((F.col("cents") / 100).cast("long"), 0), F.lit("."), F.lpad((F.col("cents") % 100).cast("string"), 2, "0")
    )
    return d.sql(CARDS).withColumns({"dollars": dollars, "shown": F.date_format("order_date", "MMMM d, yyyy")})


@case(
    "parse_order_fields",
    """
select o_orderkey, case when turn = 2 then '' else order_id end as order_id, cast(order_date as varchar) as order_date,
  case when turn = 1 then null else cents end as total, cents as best_total, turn = 0 as hint from {c_cards}""",
)
def parse_order_fields(d: Data):
    turn = F.col("turn")
    text = F.concat_ws(
        " ", F.lit("Order placed"), F.col("shown"), F.when(turn == 1, "Paid").otherwise("Total"), F.col("dollars"),
        F.when(turn == 2, "Order # 12-34").otherwise(F.concat(F.lit("Order # "), F.col("order_id"))),
        F.when(turn == 0, "Refund issued").otherwise("Return or replace items: eligible"),
    )
    rows = spread(_cards(d).select("o_orderkey", text.alias("text")))
    return rows.select(
        "o_orderkey", F.coalesce(G.order_id("text"), F.lit("")).alias("order_id"),
        P.parse_order_date("text").cast("string").alias("order_date"), G.order_total("text").alias("total"),
        G.best_total("text").alias("best_total"), L.has_return_hint("text").alias("hint"),
    )


@case(
    "parse_order_pages",
    """
select cast(floor(o_orderkey / 10) as bigint) as page_id, order_id, cast(order_date as varchar) as order_date, cents as total_cents,
  case turn when 0 then concat('Lamp & "Shade" ', o_orderpriority) else concat('Cable ', o_orderkey, '|Soap') end as titles, turn = 0 as return_hint
from {c_cards} where turn <> 1""",
)
def parse_order_pages(d: Data):
    turn = F.col("turn")
    key = F.col("o_orderkey").cast("string")
    links = F.when(
        turn == 0, F.concat(F.lit('<a class="x" href="/gp/product/B0/ref">Lamp &amp; &quot;Shade&quot; '), F.col("o_orderpriority"), F.lit("</a>"))
    ).otherwise(
        F.concat(F.lit('<a href="/dp/B1/">Cable '), key, F.lit('</a><a href="/dp/B2/"> Soap </a><a href="/dp/B2/">Soap</a><a href="/help">Get help</a>'))
    )
    card = F.concat(
        F.lit("<div><span>Order placed</span> <span>"), F.col("shown"), F.lit("</span> "),
        F.when(turn == 1, F.lit("<b>Sum</b> ")).otherwise(F.lit("<b>Total</b> <span>")), F.col("dollars"),
        F.lit("</span> #"), F.col("order_id"), links,
        F.when(turn == 0, "Return complete").otherwise("Return or replace items"), F.lit("</div>"),
    )
    page = F.floor(F.col("o_orderkey") / 10).cast("long")
    # An order page shows ten orders.
    built = _cards(d).select(page.alias("page_id"), "o_orderkey", card.alias("card")).groupBy("page_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("o_orderkey", "card"))), lambda x: x["card"]), "\n").alias("html")
    )
    rows = G.parse_order_pages(built)
    return rows.select(
        "page_id", "order_id", F.col("order_date").cast("string").alias("order_date"), "total_cents",
        F.array_join("item_titles", "|").alias("titles"), "return_hint",
    )


@case(
    "parse_listings",
    """
select ext_id, name, developer, concat('Handy tool ', id, '.') as summary, concat('Handy tool ', id, '. It helps every day.') as description,
  install_count, rating, cast(rating_count as bigint) as rating_count, concat('2.', id) as version, cast(last_scraped as varchar) as last_updated,
  website, concat('https://help.example/', id) as support_url, 'https://p.example/privacy' as privacy_url,
  concat('https://chromewebstore.google.com/detail/x/', ext_id) as listing_url, case when id % 2 = 0 then concat('https://img.example/', id, '.png') end as icon_url
from {v_items}""",
)
def parse_listings(d: Data):
    key, nl = F.col("id").cast("string"), F.lit("\n")
    site = F.when(F.col("website").isNotNull(), F.concat(F.lit('<a href="'), F.col("website"), F.lit('">Visit <b>website</b></a>'))).otherwise("")
    html = F.concat(
        F.lit('<html><body><img src="'), F.when(F.col("id") % 2 == 0, F.lit("https://img.example/")).otherwise(F.lit("/static/")), key, F.lit('.png">'),
        F.lit("<h1 class='t'>"), F.col("name"), F.lit("</h1>"), site, F.lit('<a href="/local">website local</a><a href="https://help.example/'), key,
        F.lit('">Support</a><a href="https://p.example/privacy">Policy</a></body></html>'),
    )
    mid = F.col("id") % 3
    who = F.col("developer")
    text = F.concat(
        F.col("name"), nl, F.when(mid == 2, F.concat(F.lit("Featured\n"), who)).otherwise("Featured"), nl,
        F.when(mid == 0, F.concat(F.lit("offered by "), who, F.lit("   since 1999\n"))).otherwise(""),
        F.coalesce(F.concat(F.format_number("install_count", 0), F.lit("+ users\n")), F.lit("")),
        F.lit("Overview\nHandy  tool "), key, F.lit(". It helps every day.\nSee more\n"),
        F.coalesce(F.concat(F.col("rating").cast("string"), F.lit(" out of 5\n")), F.lit("")),
        F.format_number("rating_count", 0), F.lit(" ratings\nDetails\nVersion 2."), key, F.lit("\nUpdated "),
        F.date_format("last_scraped", "MMMM d, yyyy"), nl,
        F.when(mid == 1, F.concat(F.lit("  Developer\n"), who, nl)).otherwise("Developer\nWebsite\n"),
    )
    out = G.parse_listings(d.items.select("ext_id", html.alias("html"), text.alias("text")), d.as_of)
    return out.drop("install_count_raw", "price", "permissions", "raw").withColumn("last_updated", F.col("last_updated").cast("string"))


@case(
    "parse_review_pages",
    """
select review_uid as page_id, case when turn < 2 then review_uid end as given_uid, author, stars,
  trim(regexp_replace(body, '\\s+', ' ', 'g')) as body, cast(case when turn < 2 then reviewed_at end as varchar) as reviewed_at
from (select *, helpful_count % 3 as turn from {v_reviews})""",
)
def parse_review_pages(d: Data):
    turn, text = F.col("helpful_count") % 3, F.coalesce("body", F.lit(""))
    # Every third page nests elements of the same name in the text.
    nested = F.concat(F.lit('<div class="x fzDEpf">'), F.regexp_replace(text, r"(\S+)", "<div><div>$1</div></div>"), F.lit("<div></div></div>"))
    marked = F.when(turn == 1, nested).otherwise(F.concat(F.lit('<p class="x fzDEpf">'), text, F.lit("</p>")))
    # Both cards of a page show the same parts: these are bound, to be built once.
    reviews = d.reviews.select(
        "review_uid", "author", "stars", turn.alias("turn"), text.alias("body"), marked.alias("shown"),
        F.coalesce(F.date_format("reviewed_at", "MMM d, yyyy"), F.lit("")).alias("day"),
    )
    day, body, shown = F.col("day"), F.col("body"), F.col("shown")
    stars = F.concat(F.lit('<div aria-label="'), F.col("stars").cast("string"), F.lit(' out of 5 stars"></div>'))

    def card(uid):
        return F.concat(
            F.lit('<section class="a T7rvce" data-review-id="'), uid, F.lit('">'), stars, F.lit('<span class="LfYwpe">'), F.col("author"),
            F.lit('</span><span class="ydlbEf">'), day, F.lit("</span>"), shown,
            F.lit('<div class="fPNqW"><p class="Iu8e1b">Thanks, says the developer</p></div></section>'),
        )

    known = F.concat(
        card(F.col("review_uid")), card(F.concat(F.lit("again-"), F.col("review_uid"))),
        F.lit('<section class="T7rvce"><span class="LfYwpe">nobody</span><p class="fzDEpf">no stars</p></section>'),
    )
    generic = F.concat(F.lit("<ul><li>"), stars, F.lit("<h3>"), F.col("author"), F.lit("</h3><p>"), body, F.lit("</p></li><li>menu</li></ul>"))
    html = F.when(F.col("turn") < 2, known).otherwise(generic)
    pages = reviews.select(F.col("review_uid").alias("page_id"), html.alias("html"))
    out = G.parse_review_pages(pages, d.as_of)
    return out.select("page_id", "given_uid", "author", "stars", "body", F.col("reviewed_at").cast("string").alias("reviewed_at"))


shared(
    "c_links",
    """
select page_id, i, translate(md5(w), '0123456789abcdef', 'abcdefghijklmnop') as id
from (select page_id, unnest(words) as w, generate_subscripts(words, 1) as i from (
  select page_id, regexp_extract_all(html, 'href="/([^"]*)"', 1) as words from {pages}))""",
)


@case(
    "extract_links",
    """
with named as (select page_id, id, min(case when i % 2 = 1 then i else 1000000 + i end) as ord from {c_links} group by 1, 2),
own as (select page_id, id from {c_links} where i = 1)
select n.page_id, 'listing' as kind, cast(row_number() over (partition by n.page_id order by ord) - 1 as int) as position, n.id as value
from named n left join own o on n.page_id = o.page_id and n.id = o.id where o.id is null
union all
select page_id, 'category', 0, concat('lifestyle/', case page_id % 3 when 0 then 'art' when 1 then 'news' else 'fun' end) from {pages}""",
)
def extract_links(d: Data):
    words = F.regexp_extract_all("html", F.lit('href="/([^"]*)"'), F.lit(1))
    ids = F.transform(words, lambda w: F.translate(F.md5(w), "0123456789abcdef", "abcdefghijklmnop"))
    links = F.transform(
        F.col("ids"),
        lambda w, i: F.concat(F.when(i % 2 == 0, F.lit("<a href='/detail/a-slug/")).otherwise(F.lit("<a href='/detail/")), w, F.lit("'>x</a>")),
    )
    sub = F.when(F.col("page_id") % 3 == 0, "art").when(F.col("page_id") % 3 == 1, "news").otherwise("fun")
    nav = F.concat(F.lit('<a href="/category/extensions/lifestyle/'), sub, F.lit('/">c</a><a href="/category/extensions/lifestyle/'), sub, F.lit('">d</a>'))
    rows = d.table("pages").select("page_id", ids.alias("ids"), "html")
    built = rows.select(
        "page_id", F.get("ids", F.lit(0)).alias("ext_id"), F.concat("html", F.array_join(links, "\n"), nav).alias("html")
    )
    return G.extract_links(built)


@case(
    "first_named_ids",
    """
select id, page_id, cast(i - 1 as int) as position from (
  select id, page_id, i, row_number() over (partition by id order by page_id, i) as rn from {c_links}) where rn = 1""",
)
def first_named_ids(d: Data):
    words = F.regexp_extract_all("html", F.lit('href="/([^"]*)"'), F.lit(1))
    ids = F.transform(words, lambda w: F.translate(F.md5(w), "0123456789abcdef", "abcdefghijklmnop"))
    return G.distinct_in_order(d.table("pages").select("page_id", ids.alias("ids")), "page_id", "ids").select("id", "page_id", "position")


MARKED = """select page_id, case page_id % 5 when 0 then concat(url, '/ap/signin') else url end as url,
  concat(html, case page_id % 4 when 0 then '<div class="box order-card js-order-card">Order placed June 3, 1999 Total $1,234.56 114-1234567-1234567</div><div class="order-card">Order  placed</div>'
    when 1 then '<div class="a order-card">grand total $5.00</div><script type="application/json">{"orderTotal":1}</script>' when 2 then 'order placed 1999-06-03 noscript' else '' end) as html
from {pages}"""
shared("c_marked", MARKED)


def _marked(d: Data):
    # The text holds braces, so it is passed as literals and not through the view formatter.
    turn = F.col("page_id") % 4
    extra = (
        F.when(turn == 0, '<div class="box order-card js-order-card">Order placed June 3, 1999 Total $1,234.56 114-1234567-1234567</div><div class="order-card">Order  placed</div>')
        .when(turn == 1, '<div class="a order-card">grand total $5.00</div><script type="application/json">{"orderTotal":1}</script>')
        .when(turn == 2, "order placed 1999-06-03 noscript").otherwise("")
    )
    url = F.when(F.col("page_id") % 5 == 0, F.concat("url", F.lit("/ap/signin"))).otherwise(F.col("url"))
    return d.table("pages").select("page_id", url.alias("url"), F.concat("html", extra).alias("html"))


def _count(pattern: str) -> str:
    return "cast(len(regexp_extract_all(html, '" + pattern.replace("'", "''") + "')) as int)"


def _rx(pattern: str) -> str:
    return "regexp_matches(html, '" + pattern.replace("'", "''") + "')"


TITLE = "left(trim(regexp_extract(html, '(?i)<title[^>]*>([^<]*)</title>', 1)), 100)"


@case(
    "page_pattern_counts",
    "select page_id, cast(length(html) as int) as html_length, " + TITLE + " as title, "
    + ", ".join(f"{_count(p)} as {n}" for n, p in G.PAGE_PATTERNS.items())
    + f", {_rx(G.JS_SHELL)}::int as looks_js_shell, {_rx(G.CAPTCHA)}::int as looks_captcha from {{c_marked}}",
)
def page_pattern_counts(d: Data):
    return G.pattern_counts(_marked(d))


@case(
    "classify_pages",
    f"""
select page_id, case when page_id % 5 = 0 then 'login' when page_id % 4 < 3 then 'orders' else 'unknown' end as kind,
  cast(case page_id % 4 when 0 then 1 when 1 then 1 when 2 then 1 else 0 end as int) as cards, {TITLE} as title from {{pages}}""",
)
def classify_pages(d: Data):
    return G.classify_pages(_marked(d))


@case(
    "redact_text",
    r"""
select page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '[0-9]', '#', 'g'), '>([^<]{16,})<', '>[text]<', 'g'), '\s+', ' ', 'g')) as redacted,
  regexp_replace(html, '\b[A-Za-z0-9_-]{24,}\b', '«redacted»', 'g') as scrubbed from {pages}""",
)
def redact_text(d: Data):
    return d.table("pages").select("page_id", L.redact_html("html").alias("redacted"), L.scrub("html", None).alias("scrubbed"))


@case(
    "json_shape",
    """
select page_id, case page_id % 4 when 0 then 'OBJECT<lang: STRING, links: ARRAY<STRING>, page: BIGINT>'
  when 1 then 'OBJECT<a: OBJECT<b: ARRAY<OBJECT<n: DECIMAL(2,1)>>>, ok: BOOLEAN>' when 2 then 'OBJECT<k: STRING, z: VOID>' else null end as shape from {pages}""",
)
def json_shape(d: Data):
    turn, key = F.col("page_id") % 4, F.col("page_id").cast("string")
    script = '<script type="application/json">'
    extra = (
        F.when(turn == 0, F.concat(F.lit(script + '{"page":'), key, F.lit(',"lang":"x","links":["a","b"]}</script>' + script + '{"s":1}</script>')))
        .when(turn == 1, F.concat(F.lit(script + '{"a":{"b":[{"n":1.5}]},"ok":true}</script>' + script), F.lit('{"long but broken": [1, 2, 3, 4, 5, 6, 7, 8, 9</script>')))
        .when(turn == 2, "<div data-a-state='{&quot;k&quot;:&quot;v&quot;,&quot;z&quot;:null}'></div>")
        .otherwise(script + "nothing</script>")
    )
    return d.table("pages").select("page_id", G.json_shape(F.concat("html", extra)).alias("shape"))


# --- reports ------------------------------------------------------------------------------------------


def _reports(d: Data):
    key, lang, src = F.col("doc_id").cast("string"), F.col("lang"), F.col("source")
    turn = F.col("doc_id") % 4
    data = F.concat(
        F.lit('{"summary":" About '), src, F.lit(' ","recommendation":"BUILD","target_strengths":"fast","target_weaknesses":["slow",null," old '), lang,
        F.lit(' "],"competitors":[{"name":" Rival '), src, F.lit(' ","url":"https://r.example/'), key, F.lit('","pricing":5},"Plain '), lang,
        F.lit('",{"url":"nameless"}],"opportunities":[{"title":"","detail":"d '), lang, F.lit('"},{"evidence":"only"},"idea"],"financials":'), F.when(turn == 0, F.lit('{"usd":12}')).when(turn == 1, F.lit('[1,2]')).when(turn == 2, F.lit("null")).otherwise(F.lit("5")), F.lit(',"sources":["'),
        src, F.lit('","  "]}'),
    )
    start, end = F.lit(U.DATA_START), F.lit(U.DATA_END)
    text = (
        F.when(lang == "en", F.concat("text", F.lit("\n"), start, F.lit("\n```json\n"), data, F.lit("\n```\n"), end, F.lit(" bye")))
        .when(lang == "fr", F.concat("text", F.lit("\r\n"), start, F.lit("Here it is: "), data, F.lit(" thanks")))
        .when(lang == "de", F.concat("text", start, F.when(turn == 0, "0").when(turn == 1, "false").when(turn == 2, '""').otherwise('{"broken'), end))
        .otherwise(F.col("text"))
    )
    return U.parse_study_reports(d.table("documents").select("doc_id", text.alias("text")))


PLAIN = "regexp_replace(replace(text, chr(13) || chr(10), chr(10)), '^\\s+|\\s+$', '', 'g')"


@case(
    "parse_study_reports",
    f"""
select doc_id, {PLAIN} as report_md, case when good then concat('About ', source) else '' end as summary, case when good then 'build' else '' end as recommendation,
  case when good then 'fast' else '' end as strengths, case when good then concat('slow|old ', lang) else '' end as weaknesses,
  case when good then concat('Rival ', source, '~https://r.example/', doc_id, '~5|Plain ', lang, '~~') else '' end as competitors,
  case when good then concat('~d ', lang, '|idea~') else '' end as opportunities, case when good and doc_id % 4 = 0 then '{{"usd":12}}' when good and doc_id % 4 = 1 then '[1,2]' else '{{}}' end as financials,
  case when good then concat('About ', source) else '' end as detail,
  case when good then source else '' end as sources,
  case lang when 'de' then '{U.BAD_BLOCK}' when 'es' then '{U.NO_BLOCK}' end as parse_warning
from (select *, lang in ('en', 'fr') as good from {{documents}})""",
)
def parse_study_reports(d: Data):
    def joined(array: str, *fields: str):
        return F.array_join(F.transform(array, lambda x: F.concat_ws("~", *[x[f] for f in fields])), "|")

    return _reports(d).select(
        "doc_id", "report_md", "summary", "recommendation", F.array_join("target_strengths", "|").alias("strengths"),
        F.array_join("target_weaknesses", "|").alias("weaknesses"), joined("competitors", "name", "url", "pricing").alias("competitors"),
        joined("opportunities", "title", "detail").alias("opportunities"), "financials",
        F.coalesce(F.trim(F.get_json_object("details", "$.summary")), F.lit("")).alias("detail"), F.array_join("sources", "|").alias("sources"), "parse_warning",
    )


@case(
    "study_rows",
    """
with r as (select doc_id as item_id, case when lang in ('en', 'fr') then concat('About ', source) end as summary,
  case when lang in ('en', 'fr') then 'build' end as recommendation from {documents})
select coalesce(r.item_id, s.item_id) as item_id, coalesce(s.layer, 2) as layer, case when r.item_id is not null then 'done' else s.status end as status,
  r.summary, r.recommendation from (select * from {v_studies} where layer = 2) s full outer join r on s.item_id = r.item_id
union all select item_id, layer, status, null, null from {v_studies} where layer = 3""",
)
def study_rows(d: Data):
    parsed = _reports(d).withColumnRenamed("doc_id", "item_id").withColumn("layer", F.lit(2))
    stored = d.table("v_studies").withColumns({c: F.lit(None).cast("string") for c in ("summary", "recommendation")})
    return U.study_rows(parsed, stored, d.as_of)


@case(
    "competitor_edges",
    """
select doc_id as item_id, 0 as position, concat('Rival ', source) as name, '5' as pricing from {documents} where lang in ('en', 'fr')
union all select doc_id, 1, concat('Plain ', lang), '' from {documents} where lang in ('en', 'fr')""",
)
def competitor_edges(d: Data):
    dives = _reports(d).withColumnRenamed("doc_id", "item_id")
    return U.competitors(dives).select("item_id", "position", "name", "pricing")


@case(
    "facts_block",
    """
select id as item_id, concat_ws(chr(10), concat('- Name: ', name), concat('- Developer: ', developer), concat('- Category: ', store_category),
  case when rating is not null then concat('- Store rating: ', printf('%.1f', rating), '★ (', format('{:,}', rating_count), ' ratings)') end,
  case when install_count is not null then concat('- Installs: ', format('{:,}', install_count)) end,
  concat('- Chrome Web Store listing: https://chromewebstore.google.com/detail/', ext_id)) as facts from {v_items}""",
)
def facts_block(d: Data):
    return U.facts_block(d.items)


@case(
    "ingest_stats",
    """
select count(*) filter (where event_type = 'view') as view, count(*) filter (where event_type = 'click') as click,
  count(*) filter (where event_type = 'purchase') as purchase, count(*) filter (where event_type = 'error') as error,
  cast(0 as bigint) as skipped from {events}""",
)
def ingest_stats(d: Data):
    return T.ingest_stats(d.table("events"), ["view", "click", "purchase", "error", "skipped"], "event_type")
