"""The language model against a plain version with dictionaries."""

import math
import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from reviewlens.llm import katz
from reviewlens.llm.queries import op8_katz_lm


def words_of(text):
    return [w.decode() for w in (text or "").encode().lower().split()] + [" "]


def plain(docs):
    """(id, held) -> scores, by the textbook formulas."""
    train = [words_of(t) for i, t, held in docs if not held]
    uni = Counter(w for ws in train for w in ws)
    pairs = Counter(p for ws in train for p in zip([None, *ws], ws))
    contexts = Counter(u for ws in train for u in [None, *ws[:-1]])
    n = sum(uni.values())

    def factors(counter):
        of = Counter(counter.values())
        return katz.discounts([0] + [of[c] for c in range(1, katz.DISCOUNTED + 2)])

    fu, fb = factors(uni), factors(pairs)

    def cut(c, f):
        return c * (f[c] if c <= katz.DISCOUNTED else 1.0)

    kept = sum(cut(c, fu) for c in uni.values())
    total, rest = (n, n - kept) if n - kept > 1e-9 else (n + 1, 1)

    def low(w):
        if not n:
            return 1.0
        return cut(uni[w], fu) / total if w in uni else rest / total

    followers = {}
    for (u, w), c in pairs.items():
        followers.setdefault(u, {})[w] = c

    def prob(u, w):
        seen = followers.get(u)
        if not seen:
            return low(w)
        mass = sum(cut(c, fb) for c in seen.values()) / contexts[u]
        scale, left = (1, 1 - mass) if 1 - mass > 1e-12 else (contexts[u] / (contexts[u] + 1), 1 / (contexts[u] + 1))
        if w in seen:
            return scale * cut(seen[w], fb) / contexts[u]
        return left / (1 - sum(low(x) for x in seen)) * low(w)

    out = {}
    for i, t, held in docs:
        ws = words_of(t)
        base = sum(math.log10((uni[w] + 0.5) / (n + 0.5 * (len(uni) + 1))) for w in ws)
        score = sum(math.log10(prob(u, w)) for u, w in zip([None, *ws], ws))
        out[i] = (held, len(ws), sum(w in uni for w in ws), n, base, score)
    return out, prob, uni


def check(spark, docs, **options):
    df = spark.createDataFrame([(i, t, h) for i, t, h in docs], "doc_id long, text string, h boolean")
    got = {r["doc_id"]: tuple(r)[1:] for r in katz.katz_scores(df, F.col("h"), **options).collect()}
    want, prob, uni = plain(docs)
    assert got.keys() == want.keys()
    for i in want:
        assert got[i][:4] == want[i][:4], i
        assert got[i][4:] == pytest.approx(want[i][4:], rel=1e-9, abs=1e-9), i
    return prob, uni


def made(n, seed):
    r = random.Random(seed)
    vocabulary = [f"w{int(r.paretovariate(0.7))}" for _ in range(400)]
    return [(i, " ".join(r.choices(vocabulary, k=r.randint(0, 60))), i % 4 == 1) for i in range(n)]


def test_same_as_plain(spark):
    check(spark, made(150, 1), block_tokens=500, bucket_tokens=800)


def test_split_contexts(spark):
    docs = made(60, 2) + [(100 + i, "the " + " the ".join(f"x{j}" for j in range(i, i + 30)), i % 5 == 0) for i in range(40)]
    check(spark, docs, block_tokens=400, bucket_tokens=300, hot_tokens=50)


def test_sums_to_one():
    _, prob, uni = plain(made(80, 3))
    for u in [None, *list(uni)[:20], "never seen"]:
        assert sum(prob(u, w) for w in [*uni, "unknown"]) == pytest.approx(1)


def test_odd_rows(spark):
    check(spark, [(1, None, False), (2, "", False), (3, "A a\tB", False), (4, "a b c", True), (5, "a " * 5000, False)])
    check(spark, [(1, "only held out", True)])
    df = spark.createDataFrame([(None, "a b", True), (7, "a b", None), (7, "a b", None)], "doc_id long, text string, h boolean")
    rows = katz.katz_scores(df, F.col("h")).collect()
    assert sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["train_tokens"]) for r in rows) == [
        ("7", False, 3, 6), ("7", False, 3, 6), ("None", True, 3, 6),
    ]
    assert katz.katz_scores(df.limit(0), F.col("h")).count() == 0


def test_discounts():
    assert katz.discounts([0, 100, 40, 20, 12, 8, 5])[1] == pytest.approx((2 * 40 / 100 - 0.3) / 0.7)
    assert all(katz.discounts([0, 0, 3, 1, 0, 0, 0]) == 1)
    for n in ([0, 5, 0, 0, 0, 0, 0], [0, 5, 9, 0, 1, 0, 2], [0, 1, 100, 1, 100, 1, 100]):
        assert all(0 < d <= 1 for d in katz.discounts(n)[1:])


def test_pack():
    import numpy as np

    for kind in ("<u4", "<u8"):
        for values in ([], [0], [1, 2**31, 5]):
            assert katz.unpack(katz.pack(np.array(values), kind), kind).tolist() == values


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    docs = [
        (r["doc_id"], r["text"], zlib.crc32(str(r["doc_id"]).encode()) % 5 == 1)
        for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    ]
    want, _, _ = plain(docs)
    got = {r["doc_id"]: tuple(r)[1:] for r in op8_katz_lm(spark, folder).collect()}
    assert got.keys() == want.keys()
    for i in want:
        assert got[i][:4] == want[i][:4]
        assert got[i][4:] == pytest.approx(want[i][4:], rel=1e-9)
    held = [v for v in want.values() if v[0]]
    assert sum(v[5] for v in held) > sum(v[4] for v in held), "the model beats the baseline on held-out text"
