"""Streams over several runs agree with the batch twins."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from reviewlens.operators.store import KeyedTable
from reviewlens.streaming import jobs

DAY = dt.datetime


def feed(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


REVIEWS = "item_id long, review_uid string, stars int, helpful_ranked boolean, scraped_at timestamp"


def test_ingest_over_two_runs(spark, tmp_path):
    src, store, state = (str(tmp_path / n) for n in ("src", "store", "state"))

    def run():
        stream = jobs.read_files(spark, src, spark.createDataFrame([], REVIEWS).schema)
        jobs.ingest_reviews(stream, store, state)

    feed(spark, src, [(1, "a", 1, True, DAY(2024, 1, 1)), (1, "a", 1, True, DAY(2024, 1, 1)), (1, "b", 5, None, DAY(2024, 1, 1))], REVIEWS)
    run()
    feed(spark, src, [(1, "a", 2, False, DAY(2024, 1, 5)), (2, "c", 3, False, DAY(2024, 1, 5)), (1, "b", 5, None, DAY(2024, 1, 6))], REVIEWS)
    run()
    # A scrape that comes late: its flag counts, its stars don't.
    feed(spark, src, [(2, "c", 1, True, DAY(2023, 1, 1))], REVIEWS)
    run()
    run()  # nothing new
    now = {(r["item_id"], r["review_uid"]): (r["stars"], r["helpful_ranked"]) for r in jobs.read_reviews(spark, store).collect()}
    assert now == {(1, "a"): (2, True), (1, "b"): (5, False), (2, "c"): (3, True)}
    assert KeyedTable(spark, store).version().number == 3


def test_ingest_keeps_two_versions_and_no_shuffles(spark, tmp_path):
    src, store, state = (str(tmp_path / n) for n in ("src", "store", "state"))
    for day in (1, 2, 3, 4):
        feed(spark, src, [(i, "a", day, False, DAY(2024, 1, day)) for i in range(20)], REVIEWS)
        jobs.ingest_reviews(jobs.read_files(spark, src, spark.createDataFrame([], REVIEWS).schema), store, state)
    table = KeyedTable(spark, store)
    assert table._numbers() == [3, 4] and len(table._names("rows")) == 2 and not table._names("staged")
    assert {r["stars"] for r in table.read().collect()} == {4} and {r["stars"] for r in table.read(3).collect()} == {3}


def test_crash_between_rows_and_manifest(spark, tmp_path, monkeypatch):
    src, store, state = (str(tmp_path / n) for n in ("src", "store", "state"))

    def run():
        jobs.ingest_reviews(jobs.read_files(spark, src, spark.createDataFrame([], REVIEWS).schema), store, state)

    feed(spark, src, [(1, "a", 1, True, DAY(2024, 1, 1))], REVIEWS)
    run()
    feed(spark, src, [(1, "a", 4, False, DAY(2024, 1, 2)), (1, "b", 5, False, DAY(2024, 1, 2))], REVIEWS)
    with monkeypatch.context() as m:
        m.setattr(KeyedTable, "_publish", lambda *_: 1 / 0)
        with pytest.raises(Exception, match="division"):
            run()
    assert [r["stars"] for r in jobs.read_reviews(spark, store).collect()] == [1]
    run()  # the batch is replayed from the checkpoint
    rows = {(r["review_uid"], r["stars"], r["helpful_ranked"]) for r in jobs.read_reviews(spark, store).collect()}
    assert rows == {("a", 4, True), ("b", 5, False)}


def test_snapshots_once(spark, tmp_path):
    schema = "item_id long, captured_at date, rating double, rating_count int, install_count long"
    src, store, state = (str(tmp_path / n) for n in ("src", "store", "state"))
    for day in (1, 2):
        feed(spark, src, [(1, dt.date(2024, 1, day), 3.0, 5, 10)], schema)
        for _ in range(2):
            jobs.append_snapshots(jobs.read_files(spark, src, spark.createDataFrame([], schema).schema), store, state)
    assert spark.read.parquet(store).count() == 2


def test_share_is_the_batch_result_for_ordered_input(spark, tmp_path):
    schema = "item_id long, stars int, reviewed_ts timestamp"
    start = DAY(2023, 1, 1)
    rows = [(i % 3, 1 + i % 5, start + dt.timedelta(days=i)) for i in range(700)]
    src, store, state = (str(tmp_path / n) for n in ("src", "store", "state"))
    for part in (rows[:350], rows[350:], [(-1, 1, DAY(2099, 1, 1))]):
        feed(spark, src, part, schema)
        stream = jobs.read_files(spark, src, spark.createDataFrame([], schema).schema)
        jobs.stream_complaint_share(stream, store, state, "1 day")
    got = sorted(tuple(r) for r in spark.read.parquet(store).filter("item_id >= 0").collect())
    want = sorted(tuple(r) for r in jobs.complaint_share(spark.createDataFrame(rows, schema)).collect())
    assert got == want and len(want) >= 12


def test_match_over_two_runs(spark, tmp_path):
    c_schema, o_schema = "txn_id string, txn_ts timestamp, amount_cents long", "order_id string, order_ts timestamp, total_cents long"
    src_c, src_o, store, state = (str(tmp_path / n) for n in ("c", "o", "store", "state"))
    steps = [
        ([("x", DAY(2024, 1, 5), -10), ("y", DAY(2024, 1, 5), -20)], [("a", DAY(2024, 1, 1), 10), ("b", DAY(2024, 1, 6), 10), ("c", DAY(2024, 1, 20), 20)]),
        ([("z", DAY(2024, 2, 1), -10)], [("d", DAY(2024, 1, 31), 10), ("e", DAY(2024, 1, 31), 10)]),
        ([("", DAY(2099, 1, 1), -1)], [("", DAY(2099, 1, 1), 1)]),
    ]
    for charges, orders in steps:
        feed(spark, src_c, charges, c_schema)
        feed(spark, src_o, orders, o_schema)
        jobs.stream_match(
            jobs.read_files(spark, src_c, spark.createDataFrame([], c_schema).schema),
            jobs.read_files(spark, src_o, spark.createDataFrame([], o_schema).schema), store, state, delay_days=30,
        )
    got = jobs.matched_charges(spark.read.parquet(store)).filter(F.col("txn_id") != "")
    assert {r["txn_id"]: (r["candidate_count"], r["order_id"], r["day_diff"], r["status"]) for r in got.collect()} == {
        "x": (2, "b", -1, "review"), "y": (0, None, None, "unmatched"), "z": (2, "d", 1, "review"),
    }


def test_a_charge_is_one_state_row(spark, tmp_path):
    c_schema, o_schema = "txn_id string, txn_ts timestamp, amount_cents long", "order_id string, order_ts timestamp, total_cents long"
    src_c, src_o = str(tmp_path / "c"), str(tmp_path / "o")
    start, n = DAY(2024, 1, 1), 60
    charges = [(f"t{i}", start + dt.timedelta(days=i % 30), -100 - i) for i in range(n)]
    orders = [(f"o{i}", start + dt.timedelta(days=i % 30), 100 + i) for i in range(n)]
    feed(spark, src_c, charges, c_schema)
    feed(spark, src_o, orders, o_schema)
    met = jobs.candidate_days(
        jobs.read_files(spark, src_c, spark.createDataFrame([], c_schema).schema),
        jobs.read_files(spark, src_o, spark.createDataFrame([], o_schema).schema), delay_days=0,
    )
    query = met.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    joins = [op.numRowsTotal for p in query.recentProgress for op in p.stateOperators if op.operatorName == "symmetricHashJoin"]
    # A charge once, an order's day under two blocks at most.
    assert joins and n <= max(joins) <= 3 * n


def test_window_edges_across_blocks(spark, tmp_path):
    """One charge a day for 40 days, at odd hours; orders on the first and last day of a window, and one day beyond."""
    c_schema, o_schema = "txn_id string, txn_ts timestamp, amount_cents long", "order_id string, order_ts timestamp, total_cents long"
    src_c, src_o, store, state = (str(tmp_path / n) for n in ("c", "o", "store", "state"))
    charges, orders = [("", DAY(2099, 1, 1), -1)], [("", DAY(2099, 1, 1), 1)]
    for i in range(40):
        day = DAY(2023, 12, 20, 1) + dt.timedelta(days=i)
        charges.append((f"t{i:02}", day, -100 - i))
        orders += [(f"{i:02}{gap:+}", day + dt.timedelta(days=-gap, hours=22), 100 + i) for gap in (-3, -2, 10, 11)]
    feed(spark, src_c, charges, c_schema)
    feed(spark, src_o, orders, o_schema)
    jobs.stream_match(
        jobs.read_files(spark, src_c, spark.createDataFrame([], c_schema).schema),
        jobs.read_files(spark, src_o, spark.createDataFrame([], o_schema).schema), store, state, delay_days=0,
    )
    got = jobs.matched_charges(spark.read.parquet(store)).filter(F.col("txn_id") != "")
    assert {r["txn_id"]: (r["candidate_count"], r["order_id"], r["day_diff"], r["status"]) for r in got.collect()} == {
        f"t{i:02}": (2, f"{i:02}-2", -2, "review") for i in range(40)
    }


def test_staged_batches_of_one_day_are_many_files(spark, tmp_path):
    from reviewlens.suite.streams import _stage_in_order

    rows = spark.range(0, 6000, 1, 9).select("id", F.lit(DAY(1995, 1, 1)).alias("at"))
    stream = _stage_in_order(rows, str(tmp_path), "in", 3, ["at", "id"])
    files = spark.read.parquet(str(tmp_path / "in")).groupBy(F.input_file_name()).count().collect()
    assert len(files) == 9 and max(r["count"] for r in files) < 2000 and stream.isStreaming
