"""Pages and reports on small markup."""

import datetime as dt
import json

from pyspark.sql import functions as F

from reviewlens import schemas as S
from reviewlens.plans import annotate, pages as G, studies as U

ID_A, ID_B, ID_C = "a" * 32, "b" * 32, "c" * 32
LISTING = f"""<html><img src="/i.png"><h1>Tab &amp; Pin</h1>
<a href="https://site.io/">Our website support page</a><a href="https://help.io">Support</a><a href="https://p.io/privacy">Read it</a>
<a href="/local">website</a><a href="https://store/detail/tab-pin/{ID_B}">x</a></html>"""
TEXT = """Tab & Pin
Featured
(12)
Jane Dev
4.1 out of 5
1.2K ratings
10,000+ users
Overview
Pins  your tabs! Works offline.

Second part.
See more
Details
Version
2.3.1
Updated September 5, 2024
Developer
Website
"""


def as_of():
    return F.lit("2024-10-01").cast("date")


def test_listing(spark):
    df = spark.createDataFrame([(ID_A, LISTING, TEXT), (ID_C, None, "offered by Big Co   since 1999")], "ext_id string, html string, text string")
    got = {r["ext_id"]: r for r in G.parse_listings(df, as_of()).collect()}
    r = got[ID_A]
    assert (r["name"], r["developer"], r["rating"], r["rating_count"]) == ("Tab & Pin", "Jane Dev", 4.1, 1200)
    assert r["description"] == "Pins your tabs! Works offline.\n\nSecond part." and r["summary"] == "Pins your tabs!"
    assert (r["install_count"], r["install_count_raw"], r["version"]) == (10_000, "10,000+ users", "2.3.1")
    assert r["last_updated"] == dt.date(2024, 9, 5)
    assert (r["website"], r["support_url"], r["privacy_url"]) == ("https://site.io/", "https://help.io", "https://p.io/privacy")
    assert r["icon_url"] is None and r["listing_url"].endswith("/detail/x/" + ID_A)
    assert (got[ID_C]["name"], got[ID_C]["developer"], got[ID_C]["rating"]) == (ID_C, "Big Co", None)


def test_developer_label(spark):
    df = spark.createDataFrame([("n\nx", "n"), ("t\n Developer \n\n Acme Ltd\n", "t"), ("n\n5 stars\n(2)\nMaker", "n"), ("", "n")], "t string, n string")
    assert [r[0] for r in df.select(G.developer(F.col("t"), F.col("n"))).collect()] == ["x", "Acme Ltd", "Maker", None]


CARD = """<section class="x T7rvce" data-review-id="{id}"><div aria-label="{stars} out of 5 stars"></div><span class="LfYwpe">{who}</span>
<span class="ydlbEf">{when}</span><p class="fzDEpf">{body}</p><div class="fPNqW"><p class="Iu8e1b">Thank you from us</p></div></section>"""


def test_review_cards(spark):
    html = "".join([
        CARD.format(id="r1", stars=1, who="Ann", when="Sep 5, 2024", body="It <b>broke</b>"),
        CARD.format(id="r2", stars=5, who="Bob", when="2 weeks ago", body="Fine"),
        CARD.format(id="r9", stars=3, who="Ann", when="", body="It <b>broke</b>"),
        '<section class="T7rvce"><span class="LfYwpe">Cy</span></section>',
    ])
    plain = '<article><i aria-label="4 out of 5"></i><h3>Dee</h3><time>2024-01-02</time><p>Good</p></article><li>nav</li>'
    df = spark.createDataFrame([(1, html), (2, plain), (3, "none")], "page_id long, html string")
    got = sorted(tuple(r) for r in G.parse_review_pages(df, as_of()).drop("position").collect())
    assert got == [
        (1, "r1", "Ann", 1, "It broke", dt.date(2024, 9, 5)), (1, "r2", "Bob", 5, "Fine", dt.date(2024, 9, 17)),
        (2, None, "Dee", 4, "Good", dt.date(2024, 1, 2)),
    ]


def test_review_cards_of_other_shapes(spark):
    star = '<i aria-label="{} out of 5"></i>'
    nested = (
        '<section class="T7rvce" data-review-id="n1"><section><h5>x</h5></section>' + star.format(2)
        + '<span class="LfYwpe">Eve</span><p class="fzDEpf">Slow</p></section><p class="fzDEpf">footer</p>'
    )
    both = "<article><h2>Reviews</h2><ul><li>" + star.format(3) + "<h3>Fay</h3><p>Ok</p></li></ul></article>"
    own = '<div data-review-id="d1">' + star.format(1) + "<h4>Gus</h4><p>Bad</p></div><li>menu</li>"
    named = "<ul><li>menu</li></ul><div jsname=\"q\"><h3>Hal</h3>" + star.format(5) + "<p>Top</p></div>"
    parent = "<div><h3>Ida</h3>" + star.format(4) + "<p>Nice</p></div>"
    two = "<li>" + star.format(4) + "<h3>Jo</h3><p>A</p></li><li>x</li><li>" + star.format(2) + "<h3>Kit</h3><p>B</p></li>"
    again = "<li>" + star.format(4) + "<h3>Jo</h3><p>A</p></li>" + "<li>" + star.format(1) + "<h3>Jo</h3><p>A</p></li>"
    bare = "<li>" + star.format(4) + "</li><li>" + star.format(4) + "</li>"
    pages = [nested, both, own, named, parent, two, again, bare, None]
    df = spark.createDataFrame(list(enumerate(pages)), "page_id long, html string")
    out = G.parse_review_pages(df, as_of())
    got = sorted(((r["page_id"], r["given_uid"], r["author"], r["stars"], r["body"]) for r in out.collect()), key=repr)
    assert got == [
        (0, "n1", "Eve", 2, "Slow"), (1, None, "Fay", 3, "Ok"), (2, "d1", "Gus", 1, "Bad"), (3, None, "Hal", 5, "Top"),
        (4, None, "Ida", 4, "Nice"), (5, None, "Jo", 4, "A"), (5, None, "Kit", 2, "B"), (6, None, "Jo", 4, "A"),
        (7, None, None, 4, None), (7, None, None, 4, None),
    ]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan


def test_nested_review_text(spark):
    card = (
        '<section class="T7rvce" data-review-id="n1"><div aria-label="2 out of 5 stars"></div><h3><span class="LfYwpe"><span>Lee</span> M.</span>'
        '<span class="ydlbEf"><span>on</span> 9/5/24</span></h3><div class="fzDEpf"><div>first</div> part <div>and <div>rest</div></div></div>'
        '<div class="fPNqW"><div class="fzDEpfx">reply</div></div></section>'
    )
    generic = '<li><i aria-label="3 out of 5"></i><h3>Max</h3><div data-review-text><div>one</div> two</div><time><b>5</b> Sep 2024</time></li>'
    open_ended = '<section class="T7rvce" data-review-id="n2"><i aria-label="5 out of 5"></i><p class="fzDEpf">no end<p>next'
    df = spark.createDataFrame([(1, card), (2, generic), (3, open_ended)], "page_id long, html string")
    got = sorted(tuple(r) for r in G.parse_review_pages(df, as_of()).drop("position").collect())
    day = dt.date(2024, 9, 5)
    assert got == [
        (1, "n1", "Lee M.", 2, "first part and rest", day), (2, None, "Max", 3, "one two", day), (3, "n2", None, 5, "no end", None),
    ]


def test_listing_fits_the_item_schema(spark):
    df = spark.createDataFrame([(ID_A, LISTING, TEXT)], "ext_id string, html string, text string")
    out = G.parse_listings(df, as_of())
    kinds = {f.name: f.dataType for f in S.ITEMS}
    assert {f.name for f in out.schema} <= set(kinds)
    assert all(out.schema[name].dataType == kinds[name] for name in ("price", "permissions", "raw", "last_updated", "icon_url"))
    r = out.first()
    assert (r["price"], r["permissions"], r["raw"]) == (None, [], None)


def test_links(spark):
    html = f"/detail/{ID_C}' /detail/slug/{ID_A}\" /detail/x/{ID_B}/reviews /detail/slug/{ID_A} /category/extensions/Tools/Sub/ /category/extensions/tools"
    df = spark.createDataFrame([(1, ID_A, html)], "page_id long, ext_id string, html string")
    got = [(r["kind"], r["position"], r["value"]) for r in G.extract_links(df).orderBy("kind", "position").collect()]
    assert got == [("category", 0, "Tools/Sub"), ("category", 1, "tools"), ("listing", 0, ID_B), ("listing", 1, ID_C)]
    first = G.distinct_in_order(df.select("page_id", G.listing_ids("html").alias("ids")), "page_id", "ids")
    assert {r["id"]: r["position"] for r in first.collect()} == {ID_A: 0, ID_B: 1, ID_C: 2}


def test_order_page(spark):
    html = (
        '<h1>Orders</h1><div>ORDER PLACED March 3, 2024 Total <b>$1,012.50</b> 114-1234567-7654321 <a href="/dp/X1/?r">Lamp &amp; shade</a>'
        '<a href="/gp/product/X2/">ab</a><a href="/dp/X1/">Lamp &amp; shade</a> Return or replace items</div>'
        "<div>Order placed May 1, 2024 no sum</div><div>Order placed June 1, 2024 Total: $5.00 Refund issued</div>"
    )
    rows = G.parse_order_pages(spark.createDataFrame([(1, html)], "page_id long, html string")).orderBy("position").collect()
    assert [tuple(r)[2:] for r in rows] == [
        ("114-1234567-7654321", dt.date(2024, 3, 3), 101250, ["Lamp & shade"], False), ("", dt.date(2024, 6, 1), 500, [], True),
    ]


def test_best_total(one):
    assert one(G.best_total, "Paid $7.00") == 700
    assert one(G.best_total, "$1.00 then Total $7.00") == 700
    assert one(G.best_total, "none") is None


def test_page_kinds(spark):
    rows = [(1, "https://x/ap/signin", ""), (2, "u", "<input id='ap_email'>"), (3, "u", '<div class="js-order-card"></div> Order placed'),
            (4, "u", "<title> Hi </title>"), (5, None, None)]
    got = [tuple(r)[1:] for r in G.classify_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).orderBy("page_id").collect()]
    assert got == [("login", 0, ""), ("login", 0, ""), ("orders", 1, ""), ("unknown", 0, "Hi"), ("unknown", 0, "")]


def test_json_shape(spark):
    df = spark.createDataFrame([('<script type="application/json">{"a":1}</script><script type="application/json">{"b":["x"],"c":"long"}</script>',), ("x",)], "h string")
    assert [r[0] for r in df.select(G.json_shape("h")).collect()] == ["OBJECT<b: ARRAY<STRING>, c: STRING>", None]


# --- reports -----------------------------------------------------------------------------------


def report(data, fence=True):
    body = json.dumps(data)
    return f"# Story\r\ntext\n{U.DATA_START}\n" + (f"```json\n{body}\n```" if fence else body) + f"\n{U.DATA_END}\n"


def test_reports(spark):
    data = {
        "summary": " S ", "recommendation": "Build", "target_strengths": ["a", "", 3], "target_weaknesses": "slow",
        "competitors": ["Plain", {"name": " R ", "pricing": 5, "users": None}, {"url": "u"}, 7],
        "opportunities": [{"detail": "d"}, "idea", {}], "financials": {"usd": 1}, "sources": "s",
    }
    texts = [report(data), report(data, False).replace("{", "noise {", 1), f"only {U.DATA_START} {{bad", "just words", report([1]), None, U.DATA_START + "null"]
    rows = U.parse_study_reports(spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")).orderBy("item_id").collect()
    for r in rows[:2]:
        assert r["report_md"] == "# Story\ntext" and r["summary"] == "S" and r["recommendation"] == "build"
        assert r["target_strengths"] == ["a", "3"] and r["target_weaknesses"] == ["slow"] and r["sources"] == ["s"]
        assert [(c["name"], c["pricing"]) for c in r["competitors"]][:2] == [("Plain", ""), ("R", "5")]
        assert [(o["title"], o["detail"]) for o in r["opportunities"]] == [("", "d"), ("idea", "")]
        assert json.loads(r["financials"]) == {"usd": 1} and r["parse_warning"] is None
    assert rows[2]["parse_warning"] == U.BAD_BLOCK and rows[2]["report_md"] == "only"
    assert rows[3]["parse_warning"] == U.NO_BLOCK and rows[3]["report_md"] == "just words"
    assert rows[4]["parse_warning"] is None and rows[4]["competitors"] == []
    assert rows[5]["parse_warning"] == U.NO_BLOCK and rows[6]["parse_warning"] == U.BAD_BLOCK


def test_study_rows_and_competitors(spark):
    parsed = U.parse_study_reports(
        spark.createDataFrame([(1, 2, report({"summary": "new", "competitors": ["A", " ", {"name": "B"}]}))], "item_id long, layer int, text string")
    )
    stored = spark.createDataFrame([(1, 2, "queued", None), (1, 3, "queued", "keep")], "item_id long, layer int, status string, summary string")
    rows = {r["layer"]: (r["status"], r["summary"]) for r in U.study_rows(parsed, stored, as_of()).collect()}
    assert rows == {2: ("done", "new"), 3: ("queued", "keep")}
    assert [(r["position"], r["name"]) for r in U.competitors(parsed).orderBy("position").collect()][0] == (0, "A")
    assert {r["name"] for r in U.competitors(parsed).collect()} == {"A", "B"}


def test_facts(spark):
    df = spark.createDataFrame(
        [(1, "e1", "N", None, "c", 3.0, None, 12000, ""), (2, "e2", "M", "D", "", None, 5, None, "https://l")],
        "id long, ext_id string, name string, developer string, store_category string, rating double, rating_count int, install_count long, listing_url string",
    )
    got = {r[0]: r[1].split("\n") for r in U.facts_block(df).collect()}
    assert got[1] == ["- Name: N", "- Category: c", "- Store rating: 3.0★ (? ratings)", "- Installs: 12,000",
                      "- Chrome Web Store listing: https://chromewebstore.google.com/detail/e1"]
    assert got[2] == ["- Name: M", "- Developer: D", "- Chrome Web Store listing: https://l"]


def test_price_rows(spark):
    rec = spark.createDataFrame([(7, ("paid", 3.5))], "item_id long, rec struct<pricing_model: string, price_min_usd: double>")
    assert tuple(annotate.annotation_rows(rec, model="m").first()) == (7, "m", "paid", 3.5)
    assert S.PRICING_MODELS[2] == "paid"


def test_marker_literals_lose_no_match(spark):
    texts = [
        '<div class="box ORDER-CARD js-order-card">Order Placed June 3, 1999 TOTAL $1,234.56 114-1234567-1234567</div>', "grand Total $ 5.00",
        '<SCRIPT TYPE="application/JSON">{"Order_Date":1,"orderPlacedDate":2,"purchaseDate":3,"grandTotal":4,"total_amount":5}</script>',
        '<a HREF="/GP/product/B1/"></a><a href="x/dp/B2/">', "DATA-A-STATE ordered On", "enable javascript NOSCRIPT captcha", "Order\n placed", "name='email' x type='email'",
        "id=\"ap_email\" Amazon Sign-In auth-error-message-box AmazonSignIn", "orderKplaced İ total", "", None,
    ]
    df = spark.createDataFrame([(i, "u", t) for i, t in enumerate(texts)], "page_id long, url string, html string")
    html = F.coalesce(F.col("html"), F.lit(""))
    plain = df.select("page_id", *[F.regexp_count(html, F.lit(p)).alias(n) for n, p in G.PAGE_PATTERNS.items()])
    got = G.pattern_counts(df).select(plain.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, plain.collect()))
    kinds = df.select("page_id", html.rlike(G.LOGIN_HTML).alias("login"), html.rlike(G.ORDERS_HTML).alias("orders"))
    want = {r["page_id"]: "login" if r["login"] else "orders" if r["orders"] else "unknown" for r in kinds.collect()}
    assert {r["page_id"]: r["kind"] for r in G.classify_pages(df).collect()} == want
