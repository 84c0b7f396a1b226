"""The pipeline against a brute-force version of all its stages."""

import math
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

import __spark_entry__ as driver
import corpus_pipeline
from reviewlens.llm import shards
from test_groups import check_shards, plain_components, plain_targets
from test_text_scans import plain_counts, plain_hits

FOLDER = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def plain_quality(docs):
    counts = {i: plain_counts(d["text"]) for i, d in enumerate(docs)}
    soft = {
        "symbols": lambda t, n, chars, sym, lines: sym > (1.0 - 0.9 * t) * n,
        "lines": lambda t, n, chars, sym, lines: lines >= 10.0 - 7.0 * t,
        "lengths": lambda t, n, chars, sym, lines: chars < (1.25 + 0.75 * t) * n or chars > (40.0 - 25.0 * t) * n,
    }
    hosts = Counter(d["source"] for d in docs)
    rejected = set()
    for rule in soft.values():
        failed = {i for i, c in counts.items() if rule(1.0, *c[:4])}
        of = Counter(docs[i]["source"] for i in failed)
        rates = [int(of[h] * 1_000_000 / n) for h, n in hosts.items()]
        mean = sum(rates) / len(rates) / 1e6
        spread = sum(r * r for r in rates) / len(rates) / 1e12 - mean * mean
        strength = max(1.0, mean * (1 - mean) / spread - 1) if spread > 1e-12 else sum(hosts.values()) / len(hosts)
        if mean:
            strict = {h: min(1.0, (of[h] + mean * strength) / (n + strength) / mean) for h, n in hosts.items()}
            rejected |= {i for i in failed if rule(strict[docs[i]["source"]], *counts[i][:4])}
    return [d for i, d in enumerate(docs) if i not in rejected and counts[i][0] >= 20 and 100 * counts[i][4] <= 30 * counts[i][0]]


def plain_mix(docs, labels):
    import hashlib

    quality_of = defaultdict(list)
    for x in labels:
        quality_of[x["doc_id"]].append(x["quality"])
    size = {d["doc_id"]: len(re.findall(r"[^\x20\x09-\x0D]+", d["text"] or "")) for d in docs}
    sizes = Counter()
    for d in docs:
        sizes[d["source"]] += size[d["doc_id"]]
    targets, out = plain_targets(sizes), []
    for s, total in sizes.items():
        epochs = math.floor(targets[s] / total)
        rest = targets[s] - epochs * total

        def key(d):
            u = (int(hashlib.md5(f"mix:{d['doc_id']}".encode()).hexdigest()[:12], 16) + 0.5) / 2**48
            q = max(quality_of[d["doc_id"]], default=None)
            return -math.log(u) / (1.0 if q is None else 2.0 if q > 0 else 0.5)

        start = 0
        for d in sorted((d for d in docs if d["source"] == s), key=key):
            end = start + size[d["doc_id"]]
            out += [d] * (epochs + (start < rest and end - rest <= rest - start))
            start = end
    return out


def test_same_as_brute_force(spark):
    docs = [r.asDict() for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    items = [(str(r["item_id"]), r["text"]) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet").collect()
    got = [r.asDict() for r in corpus_pipeline.run(spark, FOLDER).collect()]

    want = plain_quality(docs)
    groups = plain_components([(d["doc_id"], d["text"]) for d in want], 5)
    want = [d for d in want if groups[d["doc_id"]][2]]
    want = [d for d in want if not plain_hits_fast(d["text"], items)]
    want = plain_mix(want, labels)
    rows = lambda ds: sorted(tuple(d[c] for c in COLUMNS) for d in ds)
    assert rows(got) == rows(want)
    for d in got:
        d["key"] = d["text"]
        assert d["size"] == len(d["text"].encode()) + shards.OVERHEAD
    loads = check_shards(got, 40)
    largest = Counter()
    for d in got:
        largest[d["text"]] += d["size"]
    assert max(loads.values()) <= sum(loads.values()) / 40 + max(largest.values())


def plain_hits_fast(text, items):
    """plain_hits only where a first word of a window occurs at all."""
    lower = (text or "").lower()
    near = [(n, t) for n, t in items if all(w in lower for w in re.findall(r"\w+", t.lower())[:2]) or len(t) < 400]
    return plain_hits(text, near)[1] > 0 if near else False


def test_stages_keep_the_columns_and_odd_rows(spark):
    good = " ".join(f"word{i}" for i in range(40))
    rows = [(1, good, "en", "a", 5), (1, good, "en", "a", 5), (2, None, None, None, None), (3, "", "en", "b", 0), (None, good + " x", "en", None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for frame in (docs, docs.limit(0)):
        step = frame
        for name, stage in corpus_pipeline.STAGES:
            step = stage(spark, step, FOLDER)
            assert step.columns[:5] == COLUMNS, name
        out = step.collect()
        assert {r["doc_id"] for r in out} <= {1, None} and bool(out) == (frame is docs)


def test_one_row_of_a_repeated_id_in_every_run(spark):
    rows = [(1, " ".join(f"{w}{i}" for i in range(40)), lang, "a", 5) for w in "abc" for lang in ("en", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    runs = {tuple(map(tuple, corpus_pipeline.near_dup_stage(spark, d, FOLDER).collect())) for d in (docs, docs.orderBy(F.desc("text")), docs.repartition(5))}
    assert len(runs) == 1 and len(runs.pop()) == 1


def test_rows_without_id_take_the_epochs_of_their_source(spark):
    rows = [(i, "w " * 40, "en", "a", 80) for i in range(100)] + [(None, "v " * 40 + str(i), "en", "a", 80) for i in range(5)]
    rows += [(1000 + i, "x " * 40, "en", "b", 80) for i in range(3)] + [(None, "y " * 40 + str(i), "en", "b", 80) for i in range(2)]
    rows += [(None, "z " * 40, "en", None, 80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len(r[1].split())
    epochs = {s: math.floor(t / sizes[s]) for s, t in plain_targets(sizes).items()}
    assert len(set(epochs.values())) > 1
    got = Counter((r["source"], r["text"]) for r in corpus_pipeline.mixture_stage(spark, docs, FOLDER).collect() if r["doc_id"] is None)
    assert all(got[(r[3], r[1])] == epochs[r[3]] for r in rows if r[0] is None)


def test_registered():
    assert driver.queries()["pipeline"] is corpus_pipeline.run
    numbers = [re.match(r"op(\d+)_", n)[1] for n in driver.queries() if re.match(r"op\d+_", n)]
    assert sorted(map(int, numbers)) == list(range(1, 14))
    assert set(driver.oracle_sql()) <= set(driver.queries())
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_dedup", "decontaminate", "mixture", "sharding"]
