"""Orders from item rows, exports, accounts and scans."""

import datetime as dt
import gzip
import io
import zipfile

import pytest
from pyspark.sql import functions as F

from reviewlens import schemas as S
from reviewlens.operators import accounts, orders as O
from reviewlens.sources import exports

DAY = dt.date


def test_items_to_orders(spark):
    rows = [
        ("a", DAY(2024, 1, 2), 1000, "Cable", "Shipped", 0), ("a", DAY(2024, 1, 1), 250, "Soap", "Return completed", 1),
        ("a", DAY(2024, 1, 3), 1, "Cable", "", 2), ("b", DAY(2024, 1, 1), 500, "X", "Cancelled", 3), ("", DAY(2024, 1, 1), 5, "X", "", 4),
        ("c", None, 5, "X", "", 5), ("d", DAY(2024, 1, 1), 0, "X", "", 6),
    ] + [("e", DAY(2024, 1, 1), 1, f"t{i:02d}", None, 20 - i) for i in range(14)]
    df = spark.createDataFrame(rows, "order_id string, order_date date, cents long, title string, status string, row_no long")
    got = {r["order_id"]: tuple(r)[1:] for r in O.orders_from_items(df.repartition(4)).collect()}
    assert got["a"] == (DAY(2024, 1, 1), 1251, ["Cable", "Soap"], True)
    assert got["e"] == (DAY(2024, 1, 1), 14, [f"t{i:02d}" for i in range(13, 3, -1)], False)
    assert set(got) == {"a", "e"}


CSV = (
    '﻿"Order ID","Order Date","Total Owed","Product Name","Order Status"\r\n'
    '"1","2024-01-15T08:30:00Z","$1,040.00","Lamp, ""big"" one\nwith shade","Closed"\r\n'
    '"1","2024-01-14","7.47","Soap","Return Complete"\r\n'
    '"2","2024-02-01","5.00","Gone","Cancelled"\r\n'
)
OTHER = "order date,ORDERID,Item Total,Title\n2/3/2024,1,9.99,Later copy\n2024-02-05,3,4.00,Cup"


def check(rows):
    got = {r["order_id"]: (r["order_date"], r["total_cents"], r["item_titles"], r["return_hint"]) for r in rows}
    assert got == {
        "1": (DAY(2024, 1, 14), 104747, ['Lamp, "big" one\nwith shade', "Soap"], True),
        "3": (DAY(2024, 2, 5), 400, ["Cup"], False),
    }


def test_csv_export(spark, tmp_path):
    paths = []
    for name, text in (("a.csv", CSV), ("b.csv", OTHER), ("c.csv", "x,y\n1,2\n")):
        (tmp_path / name).write_bytes(text.encode())
        paths.append(str(tmp_path / name))
    check(exports.orders_from_csv(spark, paths).collect())
    assert exports.orders_from_csv(spark, paths[2:]).count() == 0


def test_archives(spark, tmp_path):
    for n, members in enumerate([{"x/Retail.OrderHistory.1.csv": CSV, "notes.txt": "hi"}, {"Retail.OrderHistory.2.csv": OTHER}]):
        buffer = io.BytesIO()
        with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as archive:
            for name, text in members.items():
                archive.writestr(name, text.encode())
        (tmp_path / f"{n}.zip").write_bytes(buffer.getvalue())
    check(exports.ingest_order_archives(spark, [str(tmp_path)]).collect())
    (tmp_path / "3.zip").write_bytes(b"PK no archive")
    with zipfile.ZipFile(tmp_path / "4.zip", "w") as archive:
        archive.writestr("other.txt", "x")
    with zipfile.ZipFile(tmp_path / "5.zip", "w") as archive:
        archive.writestr("Retail.OrderHistory.9.csv", "a,b\n1,2\n")
    raw = exports.read_order_archives(spark, [str(tmp_path)])
    check(exports.orders_of_archives(raw).collect())
    found = {r["path"][-5:]: r["error"] for r in exports.archive_errors(raw).collect()}
    assert found["4.zip"] == exports.NO_MEMBER and found["5.zip"] == exports.NO_COLUMNS
    assert found["3.zip"].startswith(exports.BAD_ARCHIVE) and len(found) == 3


def test_many_csv_files_are_one_scan(spark, tmp_path):
    paths = []
    for n in range(200):
        (tmp_path / f"{n}.csv").write_text(f"Order ID,Order Date,Total Owed,Title\n{n % 150},2024-01-02,{n + 1}.00,t{n}\n")
        paths.append(str(tmp_path / f"{n}.csv"))
    rows = exports.read_order_csv(spark, paths)
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("Relation") <= 2
    got = {r["order_id"]: r["total_cents"] for r in exports.orders_from_csv(spark, paths).collect()}
    assert got == {str(n): (n + 1) * 100 for n in range(150)}, "the first file of an order wins"


def store(spark, rows):
    return spark.createDataFrame(
        [(oid, DAY(2024, 1, d), cents, titles, hint, acc, DAY(2024, 1, 31)) for oid, d, cents, titles, hint, acc in rows],
        "order_id string, order_date date, total_cents long, item_titles array<string>, return_hint boolean, account string, last_sync date",
    )


def test_union_orders(spark):
    df = store(spark, [("1", 1, 10, ["a"], True, "ann"), ("1", 1, 20, ["b"], False, "bob"), ("", 2, 5, ["c"], False, "ann"), ("", 2, 5, ["c"], True, "bob")])
    got = {r["order_key"]: (r["total_cents"], r["account"], r["return_hint"]) for r in O.union_orders(df).collect()}
    assert got == {"1": (20, "bob", True), "2024-01-02|5|c": (5, "bob", True)}
    gaps = df.withColumn("total_cents", F.when((F.col("order_id") == "") | (F.col("account") == "ann"), F.col("total_cents")))
    got = {r["order_key"]: (r["total_cents"], r["account"]) for r in O.union_orders(gaps).collect()}
    assert got["1"] == (10, "bob"), "a field that the last account lacks is kept"


def test_merge_and_forget_account(spark):
    df = store(spark, [("1", 1, 10, ["a"], True, "ann"), ("9", 1, 10, ["z"], False, "bob")])
    fresh = store(spark, [("1", 1, 12, ["a"], False, None), ("2", 3, 7, ["n"], False, None)]).drop("account", "last_sync")
    merged = O.merge_account_orders(df, "ann", fresh, F.lit("2024-03-01").cast("date"))
    got = {r["order_id"]: (r["account"], r["total_cents"], r["return_hint"], r["last_sync"]) for r in merged.collect()}
    assert got == {
        "1": ("ann", 12, True, DAY(2024, 3, 1)), "2": ("ann", 7, False, DAY(2024, 3, 1)), "9": ("bob", 10, False, DAY(2024, 1, 31)),
    }
    assert [r["account"] for r in O.forget_account(merged, "ann").collect()] == ["bob"]
    assert [tuple(r) for r in O.account_summary(merged, "bob").select("account", "orders", "active").collect()] == [("bob", 1, True), ("ann", 2, False)]


def test_lookback(spark):
    df = spark.createDataFrame([(DAY(2026, 3, 31), 1), (DAY(2026, 2, 10), 12), (DAY(2026, 6, 1), 3)], "d date, m int")
    got = df.select(O.lookback_cutoff("d", "m"), O.lookback_filters("d", "m")).collect()
    assert [tuple(r) for r in got] == [
        (DAY(2026, 2, 28), [None]), (DAY(2025, 2, 10), ["year-2026", "year-2025"]), (DAY(2026, 3, 1), [None]),
    ]
    settings = spark.createDataFrame([("a", 12), ("b", 12), ("c", 3)], "account string, lookback_months int")
    done = spark.createDataFrame([("a", 12), ("b", 6), ("c", 24)], "account string, months int")
    assert {r[0]: r[2] for r in O.effective_lookback(settings, done).collect()} == {"a": 3, "b": 12, "c": 3}
    assert O.deepest_sync(done).first()["months"] == 24


def test_page_flags(spark):
    rows = [(1, "year-2023", DAY(2023, 5, 1)), (1, "year-2023", DAY(2022, 5, 1)), (2, "year-2020", DAY(2024, 1, 1)), (3, None, DAY(2019, 1, 1)), (4, "year-2020", None)]
    df = spark.createDataFrame(rows, "page_id long, filter string, order_date date")
    got = {r["page_id"]: (r["all_older"], r["year_mismatch"]) for r in O.page_flags(df, F.lit("2023-01-01").cast("date")).collect()}
    assert got == {1: (False, False), 2: (False, True), 3: (True, False), 4: (False, False)}


def test_scan_pages(spark):
    rows = [(0, 0, "a", False), (0, 1, "b", False), (1, 0, "b", True), (1, 1, "c", False), (2, 0, "c", False)]
    df = spark.createDataFrame(rows, "page_no int, position int, order_id string, return_hint boolean").withColumns(
        {"order_date": F.lit("2024-01-01").cast("date"), "total_cents": F.lit(1), "item_titles": F.array(F.lit("t"))}
    )
    assert {r[0]: r[2] for r in O.new_per_page(df).collect()} == {0: 2, 1: 1, 2: 0}
    assert {r["order_id"]: (r["page_no"], r["return_hint"]) for r in O.merge_scan_pages(df).collect()} == {"a": (0, False), "b": (0, True), "c": (1, False)}


def test_split_balances(spark):
    totals = spark.createDataFrame([("a", 30), ("b", 5)], "txn_id string, total_cents long")
    splits = spark.createDataFrame([("a", 10), ("a", 20)], "txn_id string, cents long")
    assert {r[0]: r[3] for r in O.split_balances(splits, totals).collect()} == {"a": True, "b": False}
    with pytest.raises(TypeError):
        O.split_balances(splits.withColumn("cents", F.col("cents") / 2), totals)


def test_entitlement(spark):
    now = dt.datetime(2024, 5, 10, 12)

    def at(days):
        return None if days is None else now + dt.timedelta(days=days)

    rows = [("open", True, None, None, None), ("live", True, 1.5, None, None), ("grace", True, -1, None, -4), ("gone", True, -1, None, -6),
            ("trial", False, None, 0.2, None), ("over", False, None, -3, None), ("none", False, None, None, None)]
    df = spark.createDataFrame(
        [(n, a, at(e), at(t), at(v)) for n, a, e, t, v in rows],
        "name string, active boolean, expires_at timestamp, trial_ends_at timestamp, last_validated_at timestamp",
    )
    got = {r["name"]: (r["entitlement"], r["days_left"], r["allowed"]) for r in accounts.entitlement(df, F.lit(now)).collect()}
    assert got == {
        "open": ("active", None, True), "live": ("active", 2, True), "grace": ("grace", 0, True), "gone": ("expired", None, False),
        "trial": ("trial", 1, True), "over": ("trial-expired", 0, False), "none": ("none", None, False),
    }
    assert S.ORDERS.fieldNames()[0] == "order_id"


def test_wide_export_is_refused(spark, tmp_path):
    (tmp_path / "wide.csv").write_text("Order ID,Order Date,Total,Title,More\n1,2024-01-01,5.00,Cup,x\n")
    assert exports.orders_from_csv(spark, [str(tmp_path / "wide.csv")]).count() == 1
    with pytest.raises(Exception, match="more than 4 columns"):
        exports.read_order_csv(spark, [str(tmp_path / "wide.csv")], width=4).collect()


def test_headers_are_found_without_sorting_rows(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Title,Order ID,Order Date,Total\nOrder ID order date,1,2024-01-02,3.00\nCup,2,2024-01-03,4.00\n")
    (tmp_path / "b.csv").write_text('no header\nOrder ID,Order Date,Total\n9,2024-01-02,1.00\n')
    rows = exports.read_order_csv(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")])
    assert sorted((r["order_id"], r["cents"], r["title"]) for r in rows.collect()) == [("1", 300, "Order ID order date"), ("2", 400, "Cup")]
    assert "SortAggregate" not in rows._jdf.queryExecution().executedPlan().toString()


def test_only_wanted_columns_are_read(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Note,Order ID,More,Order Date,Total,Title\nn,1,x,2024-01-02,3.00,Cup\ns\n")
    (tmp_path / "b.csv").write_text("x,y\n1,2\n")
    rows = exports.read_order_csv(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")])
    assert [(r["order_id"], r["cents"], r["title"]) for r in rows.orderBy("row_no").collect()] == [("1", 300, "Cup"), (None, None, None)]
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan csv") == 1
    (columns,) = {line.split("ReadSchema: ")[1] for line in plan.splitlines() if "ReadSchema" in line}
    assert columns == "struct<_c1:string,_c3:string,_c4:string,_c5:string,_c64:string>"


def test_odd_first_records(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(exports, "HEAD_BYTES", 8)
    texts = {
        "bom.csv": b"\xef\xbb\xbf" + 'Order ID,Order Date,Total,Title\r\n1,2024-01-02,3.00,"a ""b"",\nc"\r\n'.encode(),
        "blank lines.csv": b'\n\n"Order\nID","Order ""Date""",Total,Title\n2,2024-01-02,3.00,b',
        "quote%.csv": b'Order ID,5" wide,Order Date,Total,Title\n3,x,2024-01-02,3.00,c\n',
        "empty.csv": b"", "head.csv": b"Order ID,Order Date,Total",
        "cr.csv": b"Order ID,Order Date,Total,Title\r4,2024-01-02,3.00,d\r",
        "packed.csv.gz": gzip.compress(b"Order ID,Order Date,Total,Title\n5,2024-01-02,3.00,e\n"),
    }
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text)
    got = {r["order_id"]: r["title"] for r in exports.read_order_csv(spark, [str(tmp_path)]).collect()}
    assert got == {"1": 'a "b",\nc', "2": "b", "3": "c", "4": "d", "5": "e"}
    assert exports.read_order_csv(spark, [str(tmp_path / "empty.csv")]).count() == 0
