"""Golden values of the column functions."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from reviewlens.functions import identity as I
from reviewlens.functions import labels as L
from reviewlens.functions import money as M
from reviewlens.functions import notes as N
from reviewlens.functions import parsing as P
from reviewlens.functions.rounding import round_half_even

DAY = dt.date


def rows(spark, build, cases):
    """Evaluate `build` over many single-column cases in one job."""
    df = spark.createDataFrame([(i, v) for i, (v, _) in enumerate(cases)], "i int, v string")
    got = {r["i"]: r["x"] for r in df.select("i", build(F.col("v")).alias("x")).collect()}
    return [(v, got[i]) for i, (v, _) in enumerate(cases)]


COUNTS = [
    ("10,000+ users", 10_000), ("1.2M users", 1_200_000), ("3k Users", 3_000), ("2B users", 2_000_000_000),
    ("1.2.3 users", None), ("users", None), ("", None), (None, None), ("about 7 users now", 7),
]
RATINGS = [
    ("Rated 4.2 out of 5", 4.2), ("4.2", 4.2), (" 3 ", 3.0), ("9", None), ("4.35 out of 5", 4.3), ("none", None), (None, None),
]
STARS = [
    ("Rated 3 out of 5", 3), ("2.5 out of 5 stars", 2), ("3.5 out of 5", 4), ("4 stars", 4), ("7 stars", None),
    ("0 out of 5 stars", None), ("great", None),
]
DATES = [
    ("Updated Sep 5, 2024", DAY(2024, 9, 5)), ("September 5, 2024", DAY(2024, 9, 5)), ("2 weeks ago", DAY(2024, 1, 17)),
    ("Added 3 hours ago", DAY(2024, 1, 31)), ("1 year ago", DAY(2023, 1, 31)), ("5 Sept 2024", DAY(2024, 9, 5)),
    ("2024-02-30", None), ("2024-02-29T10:00:00Z", DAY(2024, 2, 29)), ("soon", None), (None, None),
]
ORDER_DATES = [
    ("Order placed March 3, 2024 Total", DAY(2024, 3, 3)), ("Sept 9, 2023", DAY(2023, 9, 9)), ("Foo 3, 2024", None), ("3/3/2024", None),
]
#: Each date also as an export date, where words like `ago` mean nothing.
GENERAL_DATES = [
    ("05/01/24", DAY(2024, 5, 1)), ("13/02/2024", DAY(2024, 2, 13)), ("2024/1/5 10:00", DAY(2024, 1, 5)), ("2024.01.05", DAY(2024, 1, 5)),
    ("1-5-99", DAY(1999, 1, 5)), ("12/31/49", DAY(2049, 12, 31)), ("5th of September, 2024", DAY(2024, 9, 5)), ("2024 Sep 5", DAY(2024, 9, 5)),
    ("Reviewed in the US on September 5, 2024 again", DAY(2024, 9, 5)), ("v2.3.10 sept. 3 2021", DAY(2021, 9, 3)), ("Mon, 5-Sep-2024", DAY(2024, 9, 5)),
    ("Sep 5 24", DAY(2024, 9, 5)), ("Sep 5 12:30", None), ("31/31/2024", None), ("2024-13-01", None), ("0000-01-01", None),
    ("Marching 5 2024", None), ("March 2024", None), ("1.5.99", None), ("12345/01/02", None), ("", None), (None, None),
]
CENTS = [
    ("$1,234.56", 123456), ("-$12.00", -1200), ("1,234.5", 123450), ("+7", 700), ("$12.345", None), ("12 USD", None), ("", None),
    ("  $5 ", 500),
]
IDENTITY = [
    ("https://www.Pinterest.com/", "pinterest com"), ("Save to Pinterest!", "save to pinterest"), ("http://a.b/c?d#e", "a b"), (None, ""),
]
CATEGORIES = [
    ("productivity/tools", "Productivity / Tools"), ("/lifestyle/well_being/", "Lifestyle / Well-being"), ("lifestyle", "Lifestyle"),
    ("brand_new/sub-cat2x", "Brand New / Sub Cat2X"), ("", None), ("/", None), (None, None),
]
MERCHANTS = [
    ("AMZN Mktp US*1A2", True), ("Amazon.com", True), ("Prime Video", True), ("WHOLE FOODS", False), ("Amazon Fresh", False),
    ("Amazonian tours", False), ("", False), (None, False),
]
LABELS = [
    ("Hello, Quillon", "Quillon"), ("Hola  Ana  Maria", "Ana Maria"), ("Hello, sign in", None), ("Account & Lists", None), ("Hello,", None),
    ("Sam", "Sam"), (None, None),
]


@pytest.mark.parametrize(
    "build, cases",
    [
        (P.parse_install_count, COUNTS), (P.parse_rating, RATINGS), (P.parse_star_label, STARS),
        (lambda c: P.parse_date(c, F.lit("2024-01-31").cast("date")), DATES), (P.parse_order_date, ORDER_DATES),
        (lambda c: P.parse_date(c, F.lit("2024-01-31").cast("date")), GENERAL_DATES), (P.normalize_date, GENERAL_DATES),
        (M.parse_cents, CENTS), (I.normalize_identity, IDENTITY), (I.category_display, CATEGORIES),
        (L.is_store_merchant, MERCHANTS), (L.account_label, LABELS),
    ],
    ids=["installs", "rating", "stars", "dates", "order_dates", "general_dates", "export_dates", "cents", "identity", "categories", "merchants", "labels"],
)
def test_text(spark, build, cases):
    assert rows(spark, build, cases) == cases


def test_dates_stay_in_generated_code(spark):
    day = F.lit("2024-01-31").cast("date")
    for read in (lambda c: P.parse_date(c, day), P.normalize_date, P.parse_order_date, M.parse_cents):
        plan = spark.range(5).select(F.col("id").cast("string").alias("v")).select(read(F.col("v")).alias("x"))
        text = plan._jdf.queryExecution().executedPlan().toString()
        assert "lambda" not in text and all(line.lstrip("+- ").startswith("*(") for line in text.strip().splitlines())


def test_rating_count_and_version(one):
    assert one(P.parse_rating_count, "1.2K ratings") == 1200
    assert one(P.parse_rating_count, "12 reviews") == 12
    assert one(P.parse_version, "Version: 1.2.3-beta x") == "1.2.3-beta"


def test_format_cents(one):
    assert one(M.format_cents, -123456) == "-$1,234.56"
    assert one(M.format_cents, 5) == "$0.05"


def test_compact(spark):
    cases = [(None, "—", "—"), (310.0, "310", "$310"), (1500.0, "1.5k", "$1.5k"), (45_400.0, "45k", "$45k"), (1_250_000.0, "1.3M", "$1.3M"),
             (12_000_000.0, "12M", "$12M"), (0.0, "0", "$0"), (-4.0, "-4", "$0")]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, v double")
    got = df.orderBy("i").select(M.fmt_compact("v").alias("a"), M.fmt_usd("v").alias("b")).collect()
    assert [tuple(r) for r in got] == [c[1:] for c in cases]


def test_rounding_equals_python(spark):
    rng = random.Random(7)
    values = [rng.randint(0, 5000) / rng.randint(1, 400) for _ in range(3000)] + [0.5075, 2.675, 0.0005, 0.0015, 1.005, 0.125, 2.5]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for digits in (1, 2, 3):
        got = [r[0] for r in df.select(round_half_even(F.col("v"), digits)).collect()]
        assert got == [round(v, digits) for v in values]


def test_review_uid(one):
    def uid(given, author, day, body):
        return one(lambda a, b, c, d: I.review_uid(a, b, c, d), given, author, day, body)

    made = uid("", "a", "2024-01-01", "text")
    assert made.startswith("syn_") and len(made) == 28
    assert made == uid("", "a", "2024-01-01", "text") != uid("", "a", "2024-01-02", "text")
    assert uid("r1", "a", "2024-01-01", "text") == "r1"
    import hashlib

    assert made == "syn_" + hashlib.sha256(b"a\x002024-01-01\x00text\x00").hexdigest()[:24]


def test_single_known(spark):
    df = spark.createDataFrame(
        [(["productivity/tools", "x/y", "/productivity/tools"],), (["productivity/tools", "lifestyle/art"],), ([],)], "s array<string>"
    )
    assert [r[0] for r in df.select(I.single_known("s")).collect()] == ["Productivity / Tools", None, None]


def test_return_hint(one):
    assert one(L.has_return_hint, "Your refund was issued") is True
    assert one(L.has_return_hint, "Return or replace items: eligible through May 1") is False


def test_redaction(one):
    assert one(L.redact_html, "<b>Order 12</b><i>a very long private text</i>") == "<b>Order ##</b><i>[text]</i>"
    token = "A" * 30
    assert one(L.scrub, f"key {token} end") == "key «redacted» end"
    assert len(one(lambda t: L.scrub(t, 500), "word " * 300)) == 500 and len(one(L.scrub, "word " * 300)) == 1500
    assert one(L.card_sample, "nothing here") == ""
    assert one(L.card_sample, '<div class="js-order-card">7</div>') == '<div class="js-order-card">#</div>'


def test_notes(spark):
    df = spark.createDataFrame(
        [(["Cable", "Soap"], "114-1", None), (["Cable"], "114-1", "had 114-1"), ([], "", "old")], "t array<string>, o string, cur string"
    )
    line = N.note_line("t", "o")
    got = df.select(N.merge_notes("cur", "o", line).alias("m")).select("m.*").collect()
    link = "https://www.amazon.com/gp/css/order-details?orderID=114-1"
    assert [tuple(r) for r in got] == [
        (f"[Order] Cable, Soap · #114-1 · {link}", True), ("had 114-1", False), ("old\n[Order] Amazon order", True),
    ]
    again = df.select(N.merge_notes(line, "o", line)["changed"]).collect()
    assert not any(r[0] for r in again)


def test_short_summary(spark):
    cases = [
        (["Nordic Naturals Omega-3 Fish Oil, 690mg, 120 Soft Gels"], "Nordic Naturals Omega-3 Fish Oil"),
        (["USB-C Cable (Black) [2-Pack]", "Soap"], "USB-C Cable +1"), ([], "order"), (["Pack of 3"], "order"),
        (["Extremely long product title that keeps going on and on"], "Extremely long product title that keeps"),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, t array<string>")
    assert [r[0] for r in df.orderBy("i").select(N.short_summary("t")).collect()] == [w for _, w in cases]


def test_money_status(spark):
    df = spark.createDataFrame(
        [(None, None), ("unknown", True), ("free", False), ("free", True), ("ads", None), ("subscription", None)], "m string, t boolean"
    )
    assert [r[0] for r in df.select(L.money_status("m", "t")).collect()] == ["unknown", "unknown", "free", "paid", "free", "paid"]


def test_day_diff(one):
    assert one(P.day_diff, "2024-01-01", "2024-01-11") == 10
    assert one(P.day_diff, "x", "2024-01-11") is None


def test_oversized_numbers_are_null(one):
    as_of = F.lit("2024-10-01").cast("date")
    assert one(lambda t: P.parse_date(t, as_of), "99999999 years ago") is None
    assert one(lambda t: P.parse_date(t, as_of), "99999999999999999999 weeks ago") is None
    assert str(one(lambda t: P.parse_date(t, as_of), "2 weeks ago")) == "2024-09-17"
    assert one(M.parse_cents, "$999999999999999999.00") is None
    assert one(M.parse_cents, "99999999999999999999") is None
    assert one(M.parse_cents, "-$92,233,720,368,547,758.07") == -(2**63 - 1)


def test_export_dates_of_many_shapes(one):
    for text in ("2024-01-05T10:00", "1/5/2024", "2024/01/05", "5 January 2024", "Jan 5 2024", "January 5, 2024", "Fri, 5 Jan 2024"):
        assert str(one(P.normalize_date, text)) == "2024-01-05", text
    assert one(P.normalize_date, "not a date") is None
