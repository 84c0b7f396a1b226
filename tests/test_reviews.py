"""Review signals and scores on small cases."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewlens import schemas as S
from reviewlens.operators import reviews as R
from reviewlens.operators.ordered import previous_per_key, rank_per_key
from reviewlens.plans import annotate, scoring

TODAY = dt.date(2026, 6, 17)
def as_of():
    return F.lit(TODAY)


def ago(days):
    return None if days is None else TODAY - dt.timedelta(days=days)


def reviews(spark, rows):
    return spark.createDataFrame([(i, s, ago(d)) for i, s, d in rows], "item_id long, stars int, reviewed_at date")


def test_recency_weight(spark):
    days = [10, 150, 300, 600, 1000, 2000, None, -5, 91, 92, 1095]
    df = reviews(spark, [(1, 3, d) for d in days])
    got = [r[0] for r in df.select(R.recency_weight("reviewed_at", as_of())).collect()]
    assert got == [1.0, 0.85, 0.7, 0.5, 0.3, 0.15, 1.0, 1.0, 1.0, 0.85, 0.3]


def test_recency_factor(spark):
    rows = [(1, 1, 20), (1, 2, 40), (1, 5, 2000), (2, 1, 2000), (2, 5, 10), (3, 5, 2000), (4, 1, None)]
    got = dict(tuple(r) for r in R.recency_factor(reviews(spark, rows), as_of()).collect())
    assert got == {1: 1.0, 2: 0.15, 3: 0.15, 4: 1.0}


def test_trend(spark):
    rows = [(1, 1, 30)] * 4 + [(1, 5, 300)] * 4 + [(2, 1, 30)] * 2 + [(2, 5, 300)] * 4
    rows += [(3, 5, -3)] * 3 + [(3, 4, 200)] * 3 + [(3, None, 10), (3, 1, None)]
    got = {r["item_id"]: tuple(r)[1:] for r in R.trend_signal(reviews(spark, rows), as_of()).collect()}
    assert got == {1: (1.0, 1.0, 5.0, 1.0), 2: (0.0, None, None, 0.0), 3: (0.0, 5.0, 4.0, 0.0)}


def test_legitimacy(spark):
    analyses = spark.createDataFrame(
        [(1, None, None), (2, "praise", None), (3, None, 0.42), (4, "competitor_attack", None), (5, "odd", None), (6, None, 1.7)],
        "item_id long, primary_cause string, override double",
    )
    causes = spark.createDataFrame(
        [(1, "review_bombing", 0.8), (1, "product_issues", 0.2), (2, "praise", 0.5), (2, "product_issues", 0.5), (3, "review_bombing", 1.0)],
        "item_id long, cause string, share double",
    )
    got = {r["item_id"]: r["legitimacy"] for r in R.legitimacy(analyses, causes).collect()}
    assert got == {1: 0.2, 2: 1.0, 3: 0.42, 4: 0.1, 5: 1.0, 6: 1.0}


def full_reviews(spark, n=4000, hot=0.6, seed=3):
    """Random reviews where one item holds most rows."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        item = 0 if rng.random() < hot else rng.randint(1, 40)
        day = None if rng.random() < 0.05 else TODAY - dt.timedelta(days=rng.randint(-10, 1200))
        flag = rng.choice([True, False, None])
        rows.append((item, f"u{i:05d}", rng.randint(1, 5), day, flag, rng.choice([None, 0, 1, 2]), f"text {i}"))
    return rows, spark.createDataFrame(
        rows, "item_id long, review_uid string, stars int, reviewed_at date, helpful_ranked boolean, helpful_count int, body string"
    )


def test_weighting_rank_matches_brute_force_with_a_hot_item(spark):
    rows, df = full_reviews(spark)
    want = {}
    for item in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == item]
        mine.sort(key=lambda r: (not r[4], -(r[5] or 0), -(r[3].toordinal() if r[3] else 0), r[1]))
        want.update({r[1]: i for i, r in enumerate(mine, 1)})
    got = {r["review_uid"]: r["rank"] for r in R.rank_for_weighting(df.repartition(7)).collect()}
    assert got == want


def test_rank_and_previous_do_not_depend_on_partitions(spark):
    _, df = full_reviews(spark, 1500)
    dated = df.filter("reviewed_at is not null").groupBy("item_id", "reviewed_at").agg(F.count("*").alias("n"))
    for parts in (1, 5):
        prev = previous_per_key(dated.repartition(parts), ["item_id"], F.trunc("reviewed_at", "year"), ["reviewed_at"], ["reviewed_at", "n"])
        got = sorted(tuple(r) for r in prev.collect())
        seen, want = {}, []
        for item, day, n in sorted(tuple(r) for r in dated.collect()):
            want.append((item, day, n, *seen.get(item, (None, None))))
            seen[item] = (day, n)
        assert got == want


def test_latest_per_item(spark):
    rows, df = full_reviews(spark, 800)
    got = R.latest_per_item(df, 10, 5)
    assert got.groupBy("item_id").count().filter("count > 10 or count < 5").count() == 0
    mine = sorted((r for r in rows if r[0] == 0), key=lambda r: (-(r[3].toordinal() if r[3] else 0), r[1]))[:10]
    assert [r["review_uid"] for r in got.filter("item_id = 0").orderBy("rank").collect()] == [r[1] for r in mine]


def test_merge_reviews(spark):
    df = spark.createDataFrame(
        [(1, "r1", 0, 0, None), (1, "r2", 0, 1, None), (1, "r1", 1, 0, True), (1, "r3", 1, 1, True)],
        "item_id long, review_uid string, pass_no int, position int, helpful_ranked boolean",
    )
    got = {r["review_uid"]: (r["pass_no"], r["helpful_ranked"]) for r in R.merge_reviews(df).collect()}
    assert got == {"r1": (0, True), "r2": (0, False), "r3": (1, True)}


def clusters(spark, rows):
    return spark.createDataFrame(
        [(item, no, f"c{no}", "bug", fixable, n, quotes) for item, no, fixable, n, quotes in rows], S.CLUSTERS
    )


def test_best_cluster(spark):
    df = clusters(spark, [
        (1, "a", "yes", 9, []), (1, "b", "maybe", 2, ["q"]), (2, "a", "no", 9, ["q"]), (3, "a", "maybe", 4, []), (3, "b", "yes", 4, []),
        (4, "b", "yes", 4, []), (4, "a", "yes", 4, []),
    ])
    got = {r["item_id"]: r["cluster_no"] for r in scoring.best_cluster(df).collect()}
    assert got == {1: "b", 3: "b", 4: "a"}


def score(spark, item, cluster_rows, just_bad=False, backend=False, review_rows=()):
    items = spark.createDataFrame([(1, *item)], "id long, rating double, install_count long")
    analyses = spark.createDataFrame([(1, just_bad, backend, "20 hrs", "brief")], S.ANALYSES)
    return scoring.score_opportunities(
        items, analyses, clusters(spark, cluster_rows), reviews(spark, list(review_rows)), as_of()
    ).first()


def test_score(spark):
    strong = score(spark, (3.0, 500_000), [(1, "a", "yes", 8, ["q1", "q2"])])
    assert strong["score"] > 70
    assert strong["demand_intensity"] == 8 and len(strong["wtp_evidence"]) == 2
    bad = score(spark, (3.0, 500_000), [(1, "a", "yes", 8, ["q1"])], just_bad=True)
    assert bad["score"] == pytest.approx(strong["score"] - 60)
    none = score(spark, (None, None), [(1, "a", "no", 9, ["q"])])
    assert none["score"] == 0.0 and none["top_complaint"] is None and none["demand_intensity"] == 0
    old = score(spark, (3.0, 500_000), [(1, "a", "yes", 8, ["q1"])], review_rows=[(1, 1, 2000)] * 5)
    assert old["recency_weight"] == 0.15 and old["score"] < strong["score"]


def test_rank_all_is_incremental(spark):
    items = spark.createDataFrame([(i, f"e{i}", 3.0, i * 100) for i in (1, 2, 3)], "id long, ext_id string, rating double, install_count long")
    analyses = spark.createDataFrame([(i, False, False, "h", "b") for i in (1, 2, 3)], S.ANALYSES)
    many = [(i, 1, 10 + n) for i in (1, 2) for n in range(6)] + [(3, 1, 5)]
    revs = reviews(spark, many).withColumn("review_uid", F.monotonically_increasing_id().cast("string"))
    stored = spark.createDataFrame([(1, 7.0)], "item_id long, score double")
    c = clusters(spark, [(i, "a", "yes", 3, []) for i in (1, 2, 3)])
    got = {r["item_id"]: r["score"] for r in scoring.rank_all(items, analyses, c, revs, stored, as_of()).collect()}
    assert set(got) == {1, 2} and got[1] == 7.0
    forced = {r["item_id"]: r["score"] for r in scoring.rank_all(items, analyses, c, revs, stored, as_of(), force=True).collect()}
    assert forced[1] != 7.0 and forced.keys() == {1, 2}


def test_annotator_failures_become_rows(spark):
    _, df = full_reviews(spark, 200)
    items = spark.createDataFrame(
        [(i, f"item {i}", "c", 3.0, 1, 1) for i in range(3)], "id long, name string, store_category string, rating double, rating_count int, install_count long"
    )

    def picky(digest):
        if "item 1" in digest:
            raise ValueError("no " * 2000)
        return {"n_lines": digest.count("\n- ")}

    got = {r["item_id"]: r for r in annotate.annotate_items(items, df, picky).collect()}
    assert got[1]["status"] == "error" and got[1]["error"] == "no " * 2000
    assert got[0]["status"] == "done" and got[0]["n_lines"] > 120
    few = annotate.annotate_items(items, df, picky, max_reviews=7).collect()
    assert {r["n_lines"] for r in few if r["status"] == "done"} == {7}


def test_review_analysis_rows(spark):
    items = spark.createDataFrame(
        [(i, f"e{i}", 3.0 if i < 5 else 4.5, 100 - i) for i in range(1, 7)], "id long, ext_id string, rating double, install_count long"
    )
    revs = reviews(spark, [(i, 1, n) for i in (1, 2, 4, 6) for n in range(6)] + [(3, 1, 1)])
    reports = spark.createDataFrame(
        [(1, "mixed", None, "v", None), (2, None, None, None, "x" * 2500), (3, "mixed", None, "v", None), (4, "mixed", 0.9, "v", None), (6, "mixed", None, "v", None)],
        "item_id long, primary_cause string, override double, verdict string, error string",
    )
    causes = spark.createDataFrame([(1, "off_topic", 1.0)], "item_id long, cause string, share double")
    stored = spark.createDataFrame([(4, "done", "before")], "item_id long, status string, model string")

    def run(**options):
        rows = scoring.review_analysis_rows(items, revs, reports, causes, stored, **options).collect()
        return {r["item_id"]: (r["status"], r["legitimacy"], r["reviews_analyzed"], len(r["error"] or "")) for r in rows}

    assert run(limit=25) == run(limit=None) == {1: ("done", 0.15, 6, 0), 2: ("error", None, None, 2500), 4: ("done", None, None, 0)}
    assert run(limit=1) == {1: ("done", 0.15, 6, 0), 4: ("done", None, None, 0)}
    assert run(limit=None, force=True, max_reviews=5)[4] == ("done", 0.9, 5, 0)


def test_rank_with_null_keys_and_splits(spark):
    df = spark.createDataFrame([(None, None, "a"), (None, 2, "b"), (None, 1, "c"), (1, None, "d"), (1, None, "e")], "k long, s int, u string")
    got = {r["u"]: r["rank"] for r in rank_per_key(df, ["k"], [(F.col("s"), True)], [F.asc("u")]).collect()}
    assert got == {"b": 1, "c": 2, "a": 3, "d": 1, "e": 2}
    up = {r["u"]: r["rank"] for r in rank_per_key(df, ["k"], [(F.col("s"), False)], [F.asc("u")]).collect()}
    assert up == {"c": 1, "b": 2, "a": 3, "d": 1, "e": 2}


def test_annotator_over_a_stream_of_reviews(spark, monkeypatch):
    monkeypatch.setattr(annotate, "SLICE_ROWS", 2)
    monkeypatch.setattr(annotate, "FLUSH_ROWS", 2)
    items = spark.createDataFrame([(i, f"x{i}") for i in range(1, 8)] + [(None, "none"), (1, "x1")], "id long, ext_id string")
    rows = [(1, f"u{n:03d}", n % 5 + 1, n % 2 == 0, n) for n in range(300)] + [(i, "v", 3, None, None) for i in (2, 3, 4, 5, 99)]
    reviews = spark.createDataFrame([(*r, None) for r in rows + [(None, "w", 1, True, 1)]], "item_id long, review_uid string, stars int, helpful_ranked boolean, helpful_count int, reviewed_at date")
    record = T.StructType.fromDDL("n long, causes array<struct<cause: string, share: double>>, profile struct<top: string, price: struct<low: double>>")

    def notes(item, said):
        if item["id"] == 3:
            raise ValueError("refused")
        if item["id"] == 4:
            return {"n": "not a number"}
        if item["id"] == 5:
            return {}
        first = next(said)  # the others are not asked for: later items must not see them
        n = sum(1 for _ in said) + 1 if item["id"] == 2 else -1
        return {"n": n, "causes": [{"cause": "bug", "share": 0.5}], "profile": {"top": first["review_uid"], "price": {"low": 1.0}}}

    out = annotate.annotate_reviews(items, reviews, notes, record, gate=F.col("id") != 7, partitions=2)
    assert out.schema["causes"].dataType == record["causes"].dataType
    got = {r["item_id"]: r.asDict(recursive=True) for r in out.collect()}
    assert len(got) == 8
    done = {"n": -1, "causes": [{"cause": "bug", "share": 0.5}], "profile": {"top": "u298", "price": {"low": 1.0}}}
    assert got[1] == {"item_id": 1, "status": "done", "error": None, **done}
    assert got[2]["n"] == 1 and got[2]["profile"]["top"] == "v"
    assert (got[3]["status"], got[3]["error"], got[3]["n"]) == ("error", "ValueError: refused", None)
    assert got[4]["status"] == "error" and got[4]["n"] is None
    assert got[5]["status"] == "done" and got[5]["causes"] is None
    assert {got[i]["status"] for i in (6, 7, None)} == {"skipped"}
