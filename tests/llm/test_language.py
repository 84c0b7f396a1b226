"""Language profiles against a letter by letter version, and held-out accuracy on the given documents."""

import hashlib
import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from reviewlens.llm import language_id
from reviewlens.llm.language_id import Letters, bundled, identify
from reviewlens.llm.queries import op12_language_id

SCHEMA = "doc_id long, text string, lang string, learn boolean, score string"


def letter(point, dimensions):
    bits = hashlib.shake_128(point.to_bytes(4, "big")).digest(dimensions // 8)
    return [-1 if bits[i // 8] >> (7 - i % 8) & 1 else 1 for i in range(dimensions)]


def plain_bundle(text, dimensions, gram):
    symbols = [0]
    for char in text or "":
        if char.isalpha():
            low = char.lower()
            symbols.append(ord(low) if len(low) == 1 and low.isalpha() else ord(char))
        elif symbols[-1]:
            symbols.append(0)
    symbols += [0] if symbols[-1] else []
    out = [0] * dimensions
    known = {p: letter(p, dimensions) for p in set(symbols)}
    for start in range(len(symbols) - gram + 1):
        for i in range(dimensions):
            product = 1
            for place, point in enumerate(symbols[start : start + gram]):
                product *= known[point][(i - (gram - 1 - place)) % dimensions]
            out[i] += product
    return out


def plain_identify(rows, dimensions, gram):
    vectors = [plain_bundle(r[1], dimensions, gram) for r in rows]
    sums = defaultdict(lambda: [0] * dimensions)
    for (_, _, lang, learn, _), vector in zip(rows, vectors):
        if learn and lang is not None and any(vector):
            sums[lang] = [a + b for a, b in zip(sums[lang], vector)]
    sums = {name: p for name, p in sums.items() if any(p)}
    out = []
    for row, vector in zip(rows, vectors):
        best = ("und", 0.0)
        if any(vector) and sums:
            def cosine(p):
                return sum(a * b for a, b in zip(vector, p)) / math.sqrt(sum(a * a for a in vector) * sum(b * b for b in p))
            name = max(sorted(sums), key=lambda n: cosine(sums[n]))
            best = (name, max(0.0, min(1.0, cosine(sums[name]))))
        out.append((row[0], *best))
    return out


def check(spark, rows, dimensions=64, gram=3):
    df = spark.createDataFrame(rows, SCHEMA)
    got = identify(df, F.col("learn"), dimensions=dimensions, gram=gram)
    assert got.columns == ["doc_id", "learn", "lang_pred", "score"]
    got = sorted(((r["doc_id"] or 0, r["lang_pred"], r["score"]) for r in got.collect()))
    want = sorted((i or 0, name, score) for i, name, score in plain_identify(rows, dimensions, gram))
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert np.allclose([g[2] for g in got], [w[2] for w in want], atol=1e-12)


@pytest.mark.parametrize("gram", [2, 3, 4])
def test_profiles(spark, gram):
    r = random.Random(gram)
    sounds = {"xx": ["ba", "do", "ki", "\u00e9r"], "yy": ["str", "och", "\u00fcn", "DA"], "zz": ["\u4e2d", "\u6587\u5b57", "\u8a9e"]}
    rows = []
    for i in range(60):
        lang = r.choice(list(sounds))
        text = r.choice([" ", ", ", "#1 "]).join("".join(r.choices(sounds[lang], k=r.choice([1, 2, 3]))) for _ in range(r.choice([1, 5, 40])))
        rows.append((i, text, r.choice([lang, lang, None]), r.random() < 0.6, "s"))
    check(spark, rows, gram=gram)


def test_odd_input(spark):
    rows = [
        (1, None, "a", True, None), (2, "", "a", True, None), (3, "12 #$% 34", "b", True, None), (4, "one two", "a", True, None),
        (4, "one two", "a", True, None), (5, "\u0130stanbul \u00df \ud7ff \U0001f600", "c", True, None), (None, "one two", None, True, None),
        (6, "x", None, False, None), (7, " one  two!", "zz", False, None), (8, "\u00b2 \u2160", None, False, None),
    ]
    check(spark, rows)
    # Nothing to learn from.
    check(spark, [(i, t, None, True, s) for i, t, _, _, s in rows])
    check(spark, [(i, t, name, False, s) for i, t, name, _, s in rows])
    # Equal prototypes: the first name.
    check(spark, [(1, "same words", "b", True, ""), (2, "same words", "a", True, ""), (3, "same", None, False, "")])
    assert identify(spark.createDataFrame([], SCHEMA), F.col("learn")).collect() == []


def test_slices_don_t_matter(monkeypatch):
    r = random.Random(1)
    texts = ["".join(r.choices("ab \u00e9\u4e2d\U0001f600\u0416.", k=n)) for n in (0, 1, 2, 3, 5, 40, 41, 200, 1000, 0, 7)]
    whole = np.concatenate(list(bundled((t.encode() for t in texts), Letters(64, 3))))
    assert (whole == np.array([plain_bundle(t, 64, 3) for t in texts])).all()
    for points, some, grams, direct in ((3, 2, 2, 1 << 22), (17, 100, 5, 4), (64, 3, 1 << 12, 1 << 22)):
        for name, value in (("POINTS", points), ("TEXTS", some), ("GRAMS", grams), ("DIRECT", direct)):
            monkeypatch.setattr(language_id, name, value)
        assert (np.concatenate(list(bundled((t.encode() for t in texts), Letters(64, 3)))) == whole).all()


def test_too_many_languages(spark):
    rows = [(i, "word", f"l{i}", True, "") for i in range(20)]
    with pytest.raises(Exception, match="more than 8 languages"):
        identify(spark.createDataFrame(rows, SCHEMA).repartition(4), F.col("learn"), most_languages=8)


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang").collect()}
    got = op12_language_id(spark, folder).collect()
    assert len(got) == len(truth)
    held = [r["lang_pred"] == truth[r["doc_id"]] for r in got if r["held_out"]]
    assert len(held) > 250 and sum(held) / len(held) >= 0.99
    assert all(0 <= r["score"] <= 1 for r in got)
