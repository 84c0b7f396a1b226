"""The filter audit against a document by document version."""

import random
from itertools import permutations

import numpy as np
import pytest

from reviewlens.llm.filter_audit import filter_audit, order_rows, survivors

DOCS = "doc_id long, text string, source string, part string, n long, cells string"
LABELS = "doc_id long, quality int, toxic int, id string"


def fails(doc_id, text, rows):
    words = text.encode().split()
    return {
        "A": len(words) < 200,
        "B": 100 * len(set(words)) < 50 * len(words),
        "C": 100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text),
        "D": any(c in "#$%&*|" for c in text),
        "E": doc_id is not None and any(i is not None and i < doc_id and (t or "") == text for i, t, _ in rows),
    }


def plain_audit(rows, labels):
    out = {}
    orders = ["".join(o) for o in permutations("ABCDE")]
    judged = [(i, s or "", fails(i, t or "", rows)) for i, t, s in rows]
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    for part in {s for _, s, _ in judged}:
        own = [(i, f) for i, s, f in judged if s == part]
        removed_in_all = dict.fromkeys("ABCDE", 0)
        lines = []
        for order in orders:
            left = own
            for step, name in enumerate(order, 1):
                gone = [x for x in left if x[1][name]]
                left = [x for x in left if not x[1][name]]
                failing = [f for _, f in own if f[name]]
                removed_in_all[name] += len(gone)
                lines.append((order, step, name, (
                    len(left), len(gone), len(failing) - len(gone), sum(sum(f.values()) == 1 for f in failing),
                    sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone),
                )))
        for order, step, name, figures in lines:
            out[part, order, step] = (*figures, removed_in_all[name])
    return out


def check(spark, rows, labels):
    docs = spark.createDataFrame([(i, t, s, "x", 1, "y") for i, t, s in rows], DOCS)
    marks = spark.createDataFrame([(*r, "z") for r in labels], LABELS)
    got = [tuple(r) for r in filter_audit(docs, marks).collect()]
    assert len(got) == len(set(r[:3] for r in got))
    assert {r[:3]: r[3:] for r in got} == plain_audit(rows, labels)


def test_documents(spark):
    r = random.Random(3)
    texts = []
    for _ in range(40):
        words = [f"w{r.randrange(r.choice([20, 400]))}" for _ in range(r.choice([3, 199, 200, 201, 260]))]
        words[0] = r.choice(["ABCDEFGHIJKLMNOPQRST" * 2, "a", "#", "x|y", "\u00c9\u00c4"])
        texts.append(r.choice([" ", "\n", "\t\x0b "]).join(words))
    rows = [(i, r.choice(texts), r.choice(["a", "a", "b", None, ""])) for i in range(150)]
    labels = [(i, r.choice([0, 1, None]), r.choice([0, 1, None])) for i in r.choices(range(160), k=120)]
    check(spark, rows, labels)


def test_odd_input(spark):
    rows = [
        (1, None, None), (1, None, None), (2, "", "a"), (None, "", "a"), (None, None, "b"), (3, " \n ", "a"), (3, "x", "b"),
        (4, "x", "b"), (4, "x", "c"), (4, "y", "c"), (None, "x", None), (-5, "y", "a"), (7, "\u00a0 \u2003", ""),
    ]
    check(spark, rows, [(1, 1, 1), (1, 0, 1), (None, 1, 1), (4, 1, None), (99, 1, 1), (4, None, 1)])
    check(spark, rows, [])


def test_hot_group_and_long_text(spark):
    rows = [(i, "same copies # here", "hot" if i % 2 else None) for i in range(400)]
    rows += [(1000, "word other " * 200_000, "hot"), (1001, "Z" * 100_000, "one")]
    check(spark, rows, [(i, i % 2, 1) for i in range(0, 1002, 3)])


def test_empty(spark):
    docs, marks = spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)
    assert filter_audit(docs, marks).collect() == []


@pytest.mark.parametrize("k", [1, 3, 6])
def test_walk_counts_every_set(k):
    cells = np.random.default_rng(k).integers(0, 50, (7, 1 << k, 3))
    states = survivors(cells, k)
    for chosen in range(1 << k):
        passing = [m for m in range(1 << k) if not m & chosen]
        assert (states[:, chosen] == cells[:, passing].sum(axis=1)).all()
    rows = order_rows(states, "ABCDEF"[:k])
    assert rows["kept"].shape == rows["shapley"].shape == (7, len(rows["step"]))
