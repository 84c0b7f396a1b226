"""Zone, identity, graph and table maintenance."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from reviewlens import schemas as S
from reviewlens.operators import graph, identity, ordered
from reviewlens.operators import tables as T
from reviewlens.operators import zone as Z
from reviewlens.plans import dashboards


def items(spark, rows):
    return spark.createDataFrame(rows, "id long, ext_id string, name string, developer string, website string")


def test_zone_bounds_and_fetch_gate(spark):
    df = spark.createDataFrame([(2.5,), (3.5,), (2.4,), (3.6,), (None,)], "rating double")
    assert [r[0] for r in df.select(Z.in_zone("rating")).collect()] == [True, True, False, False, False]
    assert all(r[0] for r in df.select(Z.should_fetch_reviews("rating", zone_only=False)).collect())


def test_freshness(spark):
    df = spark.createDataFrame([(5, 5, 3), (6, 5, 3), (5, 5, 1), (None, 5, 3), (5, None, 3), (5, 5, None)], "now int, prior int, saved int")
    assert [r[0] for r in df.select(Z.reviews_are_fresh("now", "prior", "saved", 2)).collect()] == [True] + [False] * 5
    assert not df.select(Z.reviews_are_fresh("now", "prior", "saved", 0)).first()[0]


def test_curated_zone(spark):
    rows = [(1, "a", 3.0, 100), (2, "b", 3.0, 300), (3, "c", 3.0, 500), (4, "d", 3.0, None), (5, "e", 4.5, 900)]
    df = spark.createDataFrame(rows, "id long, ext_id string, rating double, install_count long")
    dismissed = spark.createDataFrame([(3,)], "item_id long")
    analyses = spark.createDataFrame([(2, 0.1, "review_bombing"), (1, None, None)], "item_id long, legitimacy double, primary_cause string")
    assert [r["id"] for r in Z.curated_zone(df, dismissed, analyses).collect()] == [1, 2, 4]
    assert [r["id"] for r in Z.curated_zone(df, dismissed, analyses, fetch=2, show=5).collect()] == [2]


def test_layers(spark):
    dives = spark.createDataFrame([(1, "done"), (2, "queued")], "item_id long, status string")
    studies = spark.createDataFrame([(1, 2, "done", None), (2, 2, "queued", None)], S.STUDIES)
    assert {n: sorted(r[0] for r in Z.eligible_for_layer(dives, studies, n).collect()) for n in (1, 2, 3)} == {1: [1, 2], 2: [1], 3: [1]}


def test_histogram_keeps_empty_buckets(spark):
    df = spark.createDataFrame([(1, 0.5), (2, 5.0), (3, 2.5), (4, None), (5, 3.49)], "id long, rating double")
    assert [r["n"] for r in Z.rating_histogram(df).orderBy("bucket").collect()] == [1, 0, 0, 1, 1, 0, 0, 1]


def test_scatter_members_cover_all_points(spark):
    rng = random.Random(1)
    rows = [(i, f"e{i}", rng.choice([1.0, 2.5, 3.0, 4.9, None]), rng.randint(0, 5), rng.choice([0, 10, 11, 5000, 10**7])) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, ext_id string, rating double, rating_count int, install_count long")
    usable = sum(r[2] is not None and r[4] > 0 for r in rows)
    clusters = Z.scatter_clusters(df)
    assert clusters.agg(F.sum("n")).first()[0] == usable == Z.scatter_members(df).count()
    assert clusters.filter("labeled").count() == min(12, clusters.count())
    assert Z.scatter_ticks(df).count() == 3


# --- identity ------------------------------------------------------------------------------


def norm(spark, rows):
    from reviewlens.functions.identity import normalize_identity

    df = items(spark, rows)
    return [tuple(r) for r in df.select("id", "ext_id", *[normalize_identity(f) for f in identity.MATCH_FIELDS]).collect()]


def brute_links(rows, threshold):
    out = {}
    for b in rows:
        best = None
        for a in rows:
            if a[0] < b[0] and a[1] != b[1]:
                hits = [f for f, x, y in zip(identity.MATCH_FIELDS, a[2:], b[2:]) if x and x == y]
                if len(hits) >= threshold and (best is None or (-len(hits), a[0]) < best[0]):
                    best = ((-len(hits), a[0]), a[0], hits)
        if best:
            out[b[0]] = (best[1], best[2])
    return out


def test_links_golden(spark):
    rows = [(10, "x", "Old Name", "Acme", "https://acme.com/a"), (25, "y", "New Name", "ACME", "http://www.acme.com"), (30, "x", "Old Name", "Acme", None), (31, "z", "Solo", None, None)]
    got = {r[0]: (r[1], r[2]) for r in identity.link_successors(items(spark, rows)).collect()}
    assert got == {25: (10, ["developer", "website"])}


def test_links_match_brute_force_with_a_hot_developer(spark):
    rng = random.Random(4)
    rows = [
        (i, f"e{rng.randint(0, 250)}" if rng.random() < 0.9 else f"u{i}", f"name {rng.randint(0, 40)}",
         "BigCo" if rng.random() < 0.6 else rng.choice(["A", "B", None]), rng.choice(["https://one.com/x", f"https://s{rng.randint(0, 30)}.com", None, ""]))
        for i in range(300)
    ]
    plain = norm(spark, rows)
    for threshold in (1, 2, 3):
        got = {r[0]: (r[1], r[2]) for r in identity.link_successors(items(spark, rows).repartition(6), threshold).collect()}
        want = brute_links(plain, threshold)
        assert {k: (v[0], len(v[1])) for k, v in got.items()} == {k: (v[0], len(v[1])) for k, v in want.items()}
        if threshold >= 2:
            assert got == want


def test_lookup(spark):
    stored = [(1, "a", "Tool", "Acme", "https://a.com"), (2, "b", "Tool", "Acme", None), (3, "c", "Other", None, None)]
    seen = [(1, "a", "Tool", "Acme", "https://a.com"), (9, "n", "tool", "acme", "https://a.com/x")]
    got = {r[0]: (r[1], len(r[2])) for r in identity.find_successor_match(items(spark, seen), items(spark, stored)).collect()}
    assert got == {1: (2, 2), 9: (1, 3)}
    pairs = items(spark, seen).alias("l").crossJoin(items(spark, stored).alias("r"))
    from reviewlens.functions.identity import is_same

    assert pairs.filter(is_same("l", "r")).count() == 4


# --- graph ----------------------------------------------------------------------------------


@pytest.mark.parametrize("direction", ["asc", "desc"])
@pytest.mark.parametrize("ranges", [1, 7])
def test_places_of_any_column(spark, direction, ranges, monkeypatch):
    monkeypatch.setattr(ordered, "RANGE_BLOCK", 2)  # both levels of offsets
    r = random.Random(ranges)
    rows = [(i, r.choice([None, 1.5, 1.5, 1.5, float(r.randrange(9))]), r.choice([None, "a", "b", "é"])) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, x double, s string").repartition(5)
    for at, column in ((1, "x"), (2, "s")):
        got = {row["id"]: row["place"] for row in Z.place_nulls_last(df, column, direction, ranges=ranges).collect()}
        known = sorted((x for x in rows if x[at] is not None), key=lambda x: x[at], reverse=direction == "desc")
        want = [x[0] for x in known] + [x[0] for x in rows if x[at] is None]  # ids ascend among equals: sorts are stable
        assert got == {i: n for n, i in enumerate(want, 1)}
    assert Z.place_nulls_last(df.limit(0), "x").collect() == []


@pytest.mark.parametrize("few", [1, 1 << 20])
def test_ranks_of_a_hot_key(spark, monkeypatch, few):
    monkeypatch.setattr(ordered, "BROADCAST_KEYS", few)
    r = random.Random(few)
    rows = [(r.choice([1, 1, 1, 1, 2, None, r.randrange(40)]), r.randrange(5), i) for i in range(600)]
    df = spark.createDataFrame(rows, "k long, a int, id long").repartition(4)
    out = ordered.rank_in_ranges(df, ["k"], [F.desc("a"), F.asc("id")], ranges=6)
    want = {}
    for k in {x[0] for x in rows}:
        own = sorted((x for x in rows if x[0] == k), key=lambda x: (-x[1], x[2]))
        want |= {x[2]: n for n, x in enumerate(own, 1)}
    assert {x["id"]: x["rank"] for x in out.collect()} == want
    # Windows see the counts of ranges only.
    assert "row_number" not in out._jdf.queryExecution().executedPlan().toString()


def test_a_level_moves_no_edges(spark, monkeypatch):
    monkeypatch.setattr(graph.Reach, "finish", lambda self: self)  # tables stay for the plan
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        edges = spark.range(500).select(F.col("id").alias("src"), (F.col("id") * 7 % 501).alias("dst"))
        seeds = spark.range(3).select((F.col("id") + 1).alias("id"))
        reach = graph.Reach.start(edges)
        assert reach.add(seeds.distinct(), 0) == 3
        assert reach.add(reach.next_level(0), 1) == 3
        plan = reach.next_level(1)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # The one exchange is over targets, above both scans of the first join.
    assert plan.count("Exchange") == 1 and plan.index("Exchange") < plan.index("FileScan")
    assert plan.count("Bucketed: true") == 3
    monkeypatch.undo()
    tables = {reach.edges, reach.nodes}
    assert sorted(r["id"] for r in reach.finish().collect()) == [1, 2, 3, 7, 14, 21]
    assert not tables & {t.name for t in spark.catalog.listTables()}


def test_reach_of_a_random_graph(spark):
    r = random.Random(5)
    pairs = [(r.randrange(300), r.randrange(300)) for _ in range(420)] + [(0, i) for i in range(1, 200, 3)]
    depth, level = dict.fromkeys([0, 7], 0), {0, 7}
    while level:
        level = {b for a, b in pairs if a in level} - set(depth)
        depth |= dict.fromkeys(level, 1 + max(depth.values()))
    edges = spark.createDataFrame(pairs + [(None, 3), (5, 5)], "src long, dst long")
    seeds = spark.createDataFrame([(0,), (7,), (7,)], "id long")
    for buckets in (None, 3):
        assert {x["id"]: x["depth"] for x in graph.reachable(seeds, edges, buckets=buckets).collect()} == depth


def test_reachable(spark):
    edges = spark.createDataFrame([(1, 3), (3, 1), (3, 4), (4, 5)], "src long, dst long")
    seeds = spark.createDataFrame([(1,), (2,)], "id long")
    assert {r[0]: r[1] for r in graph.reachable(seeds, edges).collect()} == {1: 0, 2: 0, 3: 1, 4: 2, 5: 3}
    assert graph.reachable(seeds, edges, max_depth=0).count() == 2
    assert sorted(r[0] for r in graph.reachable(seeds, edges, max_total=3).collect()) == [1, 2, 3]


def test_taxonomy(spark):
    known = spark.createDataFrame([("a", 0), ("b", 1)], "slug string, position int")
    seen = spark.createDataFrame([("c", 3), ("a", 0), ("d", 1), ("c", 2)], "slug string, position int")
    rows = graph.extend_taxonomy(known, seen).orderBy("extra", "position").collect()
    assert [r["slug"] for r in rows] == ["a", "b", "d", "c"]


# --- tables ----------------------------------------------------------------------------------


def test_upsert_keeps_unsupplied_columns(spark):
    base = spark.createDataFrame([(1, "a", 5), (2, "b", 6)], "id long, name string, n int")
    delta = spark.createDataFrame([(1, None, 1), (3, "c", 1), (1, "z", 2)], "id long, name string, seq int")
    got = {r[0]: (r[1], r[2]) for r in T.upsert(base, delta, ["id"], order=["seq"]).collect()}
    assert got == {1: ("z", 5), 2: ("b", 6), 3: ("c", None)}
    nulls = {r[0]: r[1] for r in T.upsert(base, delta.filter("seq = 1").drop("seq"), ["id"]).collect()}
    assert nulls[1] is None


def test_sticky_flag_never_clears(spark):
    base = spark.createDataFrame([(1, True), (2, False), (3, None)], "id long, helpful_ranked boolean")
    hits = spark.createDataFrame([(2,), (2,)], "id long")
    assert {r[0]: r[1] for r in T.sticky_flag(base, hits, ["id"]).collect()} == {1: True, 2: True, 3: False}


def test_transition(spark):
    base = spark.createDataFrame([(1, "done", "old", "kept")], "item_id long, status string, error string, report string")
    keys = spark.createDataFrame([(1,), (2,)], "item_id long")
    queued = {r[0]: tuple(r)[1:] for r in T.transition(base, keys, "queued").collect()}
    assert queued == {1: ("queued", None, "kept"), 2: ("queued", None, None)}
    failed = T.transition(base, keys, "error", "x" * 3000, insert_missing=False, error_length=2000).collect()
    assert len(failed) == 1 and len(failed[0]["error"]) == 2000


def test_ensure_columns(spark):
    part = spark.createDataFrame([(1, "done")], "item_id int, status string")
    full = T.ensure_columns(part, S.DIVES)
    assert full.columns == S.DIVES.fieldNames() and full.schema["item_id"].dataType == S.DIVES["item_id"].dataType
    assert T.ensure_columns(None, S.DIVES, spark).count() == 0


def test_dashboard_tolerates_missing_tables(spark):
    rows = spark.createDataFrame([(1, "a", "n", 3.0, 10, 5)], "id long, ext_id string, name string, rating double, install_count long, rating_count int")
    home = dashboards.dashboard({"items": rows}, spark)
    assert len(home) == 13
    sizes = {name: df.count() for name, df in home.items()}
    assert sizes["zone"] == 1 and sizes["helpful"] == 0 and sizes["histogram"] == 8
    detail = dashboards.item_detail({"items": rows}, "a", spark)
    assert detail["item"].count() == 1 and detail["studies"].count() == 0


def test_all_sort_modes(spark):
    df = spark.createDataFrame([(1, 5.0, None), (2, None, 0.9), (3, 7.0, 0.1)], "item_id long, score double, decline_score double")
    order = {m: [r[0] for r in Z.sort_opportunities(df, m).collect()] for m in ("score-desc", "score-asc", "decline-desc")}
    assert order == {"score-desc": [3, 1, 2], "score-asc": [2, 1, 3], "decline-desc": [2, 3, 1]}
    ids = df.withColumnRenamed("item_id", "id")
    for direction, want in (("asc", [1, 3, 2]), ("desc", [3, 1, 2])):
        assert [r[0] for r in Z.sort_nulls_last(ids, "score", direction).collect()] == want
    assert list(itertools.islice(Z.category_list(ids.withColumn("store_category", F.lit("x"))).collect(), 2)) == [("x",)]


def test_links_hold_no_side_in_memory(spark):
    rows = items(spark, [(i, f"e{i}", f"name {i // 2}", "dev", f"https://s{i // 2}.com") for i in range(20)])
    links = identity.link_successors(rows)
    assert "Broadcast" not in links._jdf.queryExecution().executedPlan().toString()
    assert {(r[0], r[1]) for r in links.collect()} == {(i, i - 1) for i in range(1, 20, 2)}
