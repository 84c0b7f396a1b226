"""The keyed table: what a merge touches, replays, failures and cleaning."""

import os
import random

import pytest
from pyspark.sql import functions as F

from reviewlens.operators import store
from reviewlens.operators.store import KeyedTable
from reviewlens.operators.tables import upsert
from reviewlens.session import SHUFFLE_CLEANUP_CONF

SCHEMA = "item long, uid string, v int"


def put(old, new):
    return upsert(old, new, ["item", "uid"])


def rows(table, number=None):
    return sorted(map(tuple, table.read(number).collect()), key=repr)


def make(spark, tmp_path, **options):
    table = KeyedTable(spark, str(tmp_path / "t"), pieces=3)
    table.create(spark.createDataFrame([], SCHEMA).schema, ["item", "uid"], **options)
    return table


def test_random_merges(spark, tmp_path):
    r = random.Random(6)
    table, want = make(spark, tmp_path, buckets=5), {}
    assert table.exists() and rows(table) == []
    for batch in range(4):
        delta = {(r.choice([None, 1, 1, 2, 3, r.randrange(50)]), r.choice([None, "a", "b", "é"])): r.randrange(99) for _ in range(30)}
        frame = spark.createDataFrame([(*k, v) for k, v in delta.items()], SCHEMA)
        assert table.merge(frame, put, batch, "s")
        want |= delta
        assert rows(table) == sorted(((*k, v) for k, v in want.items()), key=repr)
    assert not table.merge(frame.withColumn("v", F.lit(-1)), put, 3, "s")
    assert table.merge(frame, put, 0, "another source") and table.version().batches == {"s": 3, "another source": 0}


def last(rows, by):
    return rows.groupBy(*by).agg(F.max_by("v", "_new").alias("v"))


def test_random_folds_in_rounds(spark, tmp_path, monkeypatch):
    r = random.Random(7)
    table, want = make(spark, tmp_path, buckets=5), {}
    monkeypatch.setattr(store, "ROUND_BYTES", 1)
    monkeypatch.setattr(store, "ROUNDS", 1000)
    for batch in range(3):
        delta = {(r.choice([None, 1, 1, 2, 3, r.randrange(50)]), r.choice([None, "a", "b", "é"])): r.randrange(99) for _ in range(30)}
        seen = []
        frame = spark.createDataFrame([(*k, v) for k, v in delta.items()], SCHEMA)
        assert table.fold(frame, lambda rows, by: seen.append(by) or last(rows, by), batch, "s")
        want |= delta
        assert len(seen) == 5 and rows(table) == sorted(((*k, v) for k, v in want.items()), key=repr)
    assert not table.fold(frame.withColumn("v", F.lit(-1)), last, 2, "s")
    assert table.fold(frame.limit(0), last, 3, "s") and len(rows(table)) == len(want)
    assert spark.conf.get(SHUFFLE_CLEANUP_CONF, None) in (None, "false")


def test_a_fold_shuffles_once(spark, tmp_path, monkeypatch):
    table, plans = make(spark, tmp_path, buckets=2), []
    table.fold(spark.createDataFrame([(i, "a", i) for i in range(20)], SCHEMA), last)

    def noted(rows, by):
        out = last(rows, by)
        plans.append(out._jdf.queryExecution().executedPlan().toString())
        return out

    table.fold(spark.createDataFrame([(3, "a", -3)], SCHEMA), noted)
    assert (3, "a", -3) in rows(table) and len(rows(table)) == 20
    assert [p.count("Exchange") for p in plans] == [1]


def test_untouched_buckets_keep_their_files(spark, tmp_path):
    table = make(spark, tmp_path, bucket_by=["item"], buckets=16)
    table.merge(spark.createDataFrame([(i, "a", i) for i in range(200)], SCHEMA), put)
    before = table.version()
    assert len(before.folders) == 16
    table.merge(spark.createDataFrame([(7, "a", 70), (7, "b", 71)], SCHEMA), put)
    after = table.version()
    changed = {b for b in before.folders if before.folders[b] != after.folders[b]}
    assert len(changed) == 1 and after.number == before.number + 1
    assert len(rows(table)) == 201 and len(rows(table, before.number)) == 200
    # A merge reads the buckets of its keys only.
    seen = []
    table.merge(spark.createDataFrame([(7, "c", 1)], SCHEMA), lambda old, new: seen.extend(old.inputFiles()) or put(old, new))
    (bucket,) = changed
    assert seen and all(f"_bucket={bucket}/" in name for name in seen)


def test_rows_may_go(spark, tmp_path):
    table = make(spark, tmp_path, buckets=2)
    table.merge(spark.createDataFrame([(1, "a", 1), (2, "b", 2)], SCHEMA), put)
    gone = spark.createDataFrame([(1, "a", 0), (2, "b", 0)], SCHEMA)
    table.merge(gone, lambda old, new: old.join(new, ["item", "uid"], "left_anti"))
    assert rows(table) == [] and table.version().folders == {}
    table.merge(spark.createDataFrame([], SCHEMA), put)
    assert rows(table) == []


def test_failed_merge_and_cleaning(spark, tmp_path, monkeypatch):
    table = make(spark, tmp_path, buckets=4)
    frame = spark.createDataFrame([(i, "a", i) for i in range(20)], SCHEMA)
    table.merge(frame, put)
    with monkeypatch.context() as m:
        m.setattr(KeyedTable, "_publish", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            table.merge(frame.withColumn("v", F.lit(0)), put)
    assert sorted(rows(table)) == [(i, "a", i) for i in range(20)]
    table.merge(spark.createDataFrame([(3, "a", -3)], SCHEMA), put)
    kept = rows(table)
    table.clean(keep=1)
    assert rows(table) == kept and table._numbers() == [2]
    folders = {f"rows/{a}/{b}" for a in os.listdir(tmp_path / "t/rows") for b in os.listdir(tmp_path / "t/rows" / a) if b.startswith("_bucket")}
    assert folders == set(table.version().folders.values()) and not os.path.exists(tmp_path / "t/staged")


def test_one_writer_per_version(spark, tmp_path):
    table = make(spark, tmp_path, buckets=2)
    with pytest.raises(RuntimeError, match="another writer"):
        table.create(spark.createDataFrame([], SCHEMA).schema, ["item", "uid"])
    with pytest.raises(ValueError):
        KeyedTable(spark, str(tmp_path / "u")).create(spark.createDataFrame([], SCHEMA).schema, ["item"], ["uid"])


def test_a_large_bucket_is_written_by_more_tasks_than_pieces(spark, tmp_path):
    rows = spark.range(200_000).select(F.col("id"), F.sha2(F.col("id").cast("string"), 256).alias("text"))
    table = KeyedTable(spark, str(tmp_path / "t"), pieces=1)
    table.create(rows.schema, ["id"], buckets=1)
    name = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    spark.conf.set(name, "256k")
    try:
        table.merge(rows.repartition(8), lambda old, new: new)
    finally:
        spark.conf.unset(name)
    assert table.read().distinct().count() == 200_000
    assert len(list((tmp_path / "t" / "rows").glob("*/_bucket=0/*.parquet"))) > 4
