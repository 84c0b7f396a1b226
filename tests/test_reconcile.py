"""Matching on golden cases, and against brute force with one amount on most rows."""

import datetime as dt
import random

import pytest
from reviewlens.operators import reconcile as R

START = dt.date(2024, 1, 1)


def day(n):
    return START + dt.timedelta(days=n)


def frames(spark, txns, orders):
    t = spark.createDataFrame(txns, "txn_id string, txn_date date, amount_cents long")
    o = spark.createDataFrame(orders, "order_id string, order_date date, total_cents long, return_hint boolean")
    return t, o


def brute(txns, orders):
    out = {}
    for tid, when, cents in txns:
        if cents <= 0:
            fits = [(abs((when - d).days), oid, (when - d).days) for oid, d, total, _ in orders
                    if cents and total == -cents and -2 <= (when - d).days <= 10]
            n, best = len(fits), min(fits, default=(None, None, None))
            out[tid] = ("charge", {0: "unmatched", 1: "auto"}.get(n, "review"), n, best[1], best[2], None)
            continue
        near = [((when - d).days, oid, total, bool(h)) for oid, d, total, h in orders if 0 <= (when - d).days <= 120]
        full = sorted((not h, dd, oid) for dd, oid, total, h in near if total == cents)
        part = sorted((dd, oid) for dd, oid, total, h in near if h and total > cents)
        if full:
            sure = len(full) == 1 or sum(not f[0] for f in full) == 1
            out[tid] = ("refund", "auto" if sure else "review", len(full), full[0][2], full[0][1], "full")
        elif part:
            out[tid] = ("refund", "review", len(part), part[0][1], part[0][0], "partial")
        else:
            out[tid] = ("refund", "refund", 0, None, None, None)
    return out


def got(df):
    rows = df.select("txn_id", "kind", "status", "candidate_count", "order_id", "day_diff", "refund_match").collect()
    return {r[0]: tuple(r)[1:] for r in rows}


def test_golden(spark):
    txns = [
        ("one", day(3), -1000), ("two", day(2), -2000), ("none", day(40), -1000), ("zero", day(0), 0), ("early", day(48), -5000),
        ("full", day(30), 3000), ("hint", day(30), 4000), ("part", day(30), 100), ("lost", day(30), 999_999),
    ]
    orders = [
        ("a", day(0), 1000, False), ("b", day(0), 2000, False), ("c", day(1), 2000, False), ("d", day(10), 3000, False),
        ("e", day(5), 4000, False), ("f", day(1), 4000, True), ("g", day(50), 5000, False),
    ]
    rows = got(R.reconcile(*frames(spark, txns, orders)))
    assert rows["one"] == ("charge", "auto", 1, "a", 3, None)
    assert rows["two"] == ("charge", "review", 2, "c", 1, None)
    assert rows["none"][1] == rows["zero"][1] == "unmatched"
    assert rows["early"] == ("charge", "auto", 1, "g", -2, None)
    assert rows["full"] == ("refund", "auto", 1, "d", 20, "full")
    assert rows["hint"] == ("refund", "auto", 2, "f", 29, "full")
    assert rows["part"] == ("refund", "review", 1, "f", 29, "partial")
    assert rows["lost"] == ("refund", "refund", 0, None, None, None)


@pytest.mark.parametrize("seed, common", [(1, 0.0), (2, 0.7), (3, 0.4)])
def test_brute_force(spark, seed, common):
    rng = random.Random(seed)

    def cents():
        return 999 if rng.random() < common else rng.choice([1, 2, 3, 64, 127, 128, 500, 999, 1000, 4096]) * rng.choice([1, 1, 7])

    orders = [(f"o{i:04d}", day(rng.randint(0, 150)), cents(), rng.choice([True, False, None])) for i in range(400)]
    txns = [(f"c{i}", day(rng.randint(-5, 160)), -cents()) for i in range(200)]
    txns += [(f"r{i}", day(rng.randint(-5, 300)), cents() + rng.choice([0, 0, -1, 5])) for i in range(250)]
    txns = [t for t in txns if t[2] != 0]
    t, o = frames(spark, txns, orders)
    assert got(R.reconcile(t.repartition(3), o.repartition(5))) == brute(txns, orders)


def test_refund_windows_are_running_sums(spark):
    """A frame that slides reads all days of the window again for each row."""
    orders = [("a", day(0), 700, True), ("b", day(1), 700, False), ("c", day(1), 900, True), ("d", day(130), 900, False), ("a", day(1), 800, True)]
    txns = [(f"{cents}-{n}", day(n), cents) for cents in (100, 700) for n in (-1, 0, 1, 119, 120, 121, 122, 250, 251)]
    t, o = frames(spark, txns, orders)
    rows = got(R.match_refunds(t, o))
    assert rows == brute(txns, orders)
    assert (rows["100-121"][2:4], rows["100-122"][2:4], rows["700-121"][2:4]) == ((2, "a"), (0, None), (1, "b"))
    days, probes = R.order_days(o), t.select(t.amount_cents.alias("cents"), R.F.unix_date("txn_date").alias("day"))
    for answers in (R._full_answers, R._partial_answers):
        plan = answers(probes, days, 120)._jdf.queryExecution().executedPlan().toString()
        assert "RangeFrame, unboundedpreceding" in plan and "RangeFrame, -120" not in plan


def test_other_windows(spark):
    txns, orders = [("x", day(3), -10)], [("a", day(0), 10, False), ("b", day(4), 10, False)]
    t, o = frames(spark, txns, orders)
    assert got(R.match_charges(t, o, window=3, back=0))["x"][2:4] == (1, "a")
    assert got(R.match_charges(t, o, window=2, back=1))["x"][2:4] == (1, "b")


def test_no_pairs_in_the_plan(spark):
    t, o = frames(spark, [("x", day(3), -10)], [("a", day(0), 10, False)])
    plan = R.reconcile(t, o)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_auto_plan_and_summaries(spark):
    t, o = frames(spark, [("x", day(3), -10), ("y", day(3), -11)], [("a", day(0), 10, False)])
    matches = R.reconcile(t, o)
    assert sorted(r["action"] for r in R.plan_auto_apply(matches).collect()) == ["note", "rename"]
    assert R.plan_auto_apply(matches, rename=False).count() == 1
    assert R.plan_auto_apply(matches, enabled=False).count() == 0
    assert tuple(R.match_summary(matches).first()) == (1, 0, 1, 0)
    results = spark.createDataFrame(
        [(True, True, True), (True, None, True), (True, None, False), (True, False, True), (False, None, None)],
        "ok boolean, verified boolean, undo boolean",
    )
    assert tuple(R.apply_summary(results).first()) == (5, 2, 1, 1, 1)


def test_store_transactions(spark):
    df = spark.createDataFrame(
        [("1", day(0), -12.345, "AMZN Mktp", None, None), ("2", day(1), -1.0, "Cafe", "n", "x"), (None, day(2), None, "Amazon", "n", "x")],
        "txn_id string, txn_date date, amount double, merchant_name string, name string, notes string",
    )
    rows = {r["txn_id"]: (r["amount_cents"], r["name"], r["notes"]) for r in R.store_transactions(df).collect()}
    assert rows == {"1": (-1234, "AMZN Mktp", ""), "": (0, "n", "x")}
    assert R.store_transactions(df, 1).first()["txn_id"] == ""
