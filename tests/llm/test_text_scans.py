"""Operators that judge one text at a time, against plain versions: benchmarks, personal data, secrets, quality counts."""

import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from reviewlens.llm import pii, quality, secret_scan
from reviewlens.llm.decontaminate import decontaminate
from reviewlens.llm.queries import op2_pii, op3_decontaminate, op4_secret_scan, op6_quality_rules

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet").collect()


def digest(spans, order):
    spans = sorted(spans, key=lambda s: (s[0], order.index(s[2])))
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, b, k in spans).encode()).hexdigest()


# Personal data --------------------------------------------------------------------------------------------------------

PII = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def plain_pii(text):
    out = []
    for kind, pattern in PII.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {
                "email": True,
                "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else False,
                "card": 14 <= len(digits) <= 19 and luhn(digits),
                "phone": 10 <= len(digits) <= 15,
            }[kind]
            if ok:
                out.append((m.start(), m.end(), kind))
    return out


TEXTS = [
    None, "", "no data", "a@b.c_d@e.f g@h.i.", "x@y", "me.you+tag@mail-1.example.com,you@x.y", "é 10.0.0.1 ü 256.1.1.1 1.2.3.4.5.6.7.8",
    "001.002.003.004 0000000000.1.1.1 1.2.3", "4111 1111 1111 1111 and 4111-1111-1111-1112 4", "+1 (555) 010-9999 ++49 30 1234567 +12",
    "𝒳 +44 20 7946 0958. a@b.co 𝒴 c@d.co", "1" * 5000, "+1" + " " * 3000 + "2", "a" * 20000 + "@" + "b." * 5000 + "c", "@" * 3000,
    "1.2.3.4 " * 700, "x@y.z " * 700, "9" * 14 + " " + "0" * 14 + " " + "0" * 19 + " " + "0" * 20,
]


def test_pii_same_as_plain(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    names = [k.name for k in pii.KINDS]
    for r in pii.find_pii(df).collect():
        got = [(s["start"], s["end"], s["kind"]) for s in r["pii"] if s["kind"] in PII]
        assert got == sorted(plain_pii(TEXTS[r["doc_id"]]), key=lambda s: (s[0], names.index(s[2]))), r["doc_id"]


def test_pii_more_kinds(spark):
    texts = [
        "my IBAN is DE89 3704 0044 0532 0130 00 ok", "DE89 3704 0044 0532 0130 01", "number 123-45-6789 alone",
        "SSN: 123-45-6789", "ssn 000-45-6789", "call (555) 123-4567 now", "see 555-123-4567", "tel. 555-123-4567",
    ]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: [(s["kind"], texts[r["doc_id"]][s["start"] : s["end"]]) for s in r["pii"]] for r in pii.find_pii(df).collect()}
    assert got[0] == [("iban", "DE89 3704 0044 0532 0130 00")]
    assert all(k != "iban" for k, _ in got[1]) and got[2] == [] and got[4] == [] and got[6] == []
    assert got[3] == [("ssn", "123-45-6789")]
    assert got[5] == [("local_phone", "(555) 123-4567")] and got[7] == [("local_phone", "555-123-4567")]


def test_iban_before_capitals_and_numbers(spark):
    de, no, gb = "DE89370400440532013000", "NO9386011117947", "GB82 WEST 1234 5698 7654 32"
    want = {
        f"{de} BIC COBADEFFXXX": [de], f"{de} 100 EUR": [de], f"PAY TO {gb} 12 AND MORE": [gb], f"{no} {no} {de} {gb}": [no, no, de, gb],
        f"{de[:-1]}1 100 EUR": [], f"{de}X": [], "é DE89 3704 0044 0532 0130 00 A B C D E F": ["DE89 3704 0044 0532 0130 00"],
        "ZZ34370400440532013000 BIC": ["ZZ34370400440532013000"] if plain_iban("ZZ34370400440532013000") else [],
    }
    df = spark.createDataFrame(list(enumerate(want)), "doc_id long, text string")
    for r in pii.find_pii(df).collect():
        text = list(want)[r["doc_id"]]
        assert [text[s["start"] : s["end"]] for s in r["pii"] if s["kind"] == "iban"] == want[text], text


def plain_iban(text):
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97 == 1


def test_pii_query(spark, documents):
    got = {r["doc_id"]: r for r in op2_pii(spark, FOLDER).collect()}
    assert len(got) == len(documents)
    for d in documents:
        spans, r = plain_pii(d["text"]), got[d["doc_id"]]
        counts = Counter(k for _, _, k in spans)
        assert [r[f"n_{k}"] for k in PII] == [counts[k] for k in PII]
        assert r["base_sha256"] == digest(spans, list(PII))


def test_pii_stays_native(spark):
    plan = op2_pii(spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_extra_columns_and_empty(spark):
    df = spark.createDataFrame([(1, "a@b.co", "x")], "doc_id long, text string, pii string")
    row = pii.find_pii(df).first()
    assert row["doc_id"] == 1 and len(row["pii"]) == 1
    assert pii.find_pii(df.limit(0)).count() == 0
    df = spark.createDataFrame([(1, "token=abcdef", "x"), (1, "token=abcdef", "x")], "doc_id long, text string, secrets string")
    assert [len(r["secrets"]) for r in secret_scan.scan_secrets(df).collect()] == [1, 1]
    assert secret_scan.scan_secrets(df.limit(0)).count() == 0
    df = spark.createDataFrame([(1, "a b", "x", 3)], "doc_id long, text string, hits string, n_words int")
    assert decontaminate(df, df.select(F.lit("q").alias("item_id"), "text")).first()["n_hit"] == 2
    assert decontaminate(df.limit(0), df.select(F.lit("q").alias("item_id"), "text")).count() == 0


# Benchmarks -----------------------------------------------------------------------------------------------------------

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_hits(text, items, window=10):
    words = WORDS.findall((text or "").translate(LOWER))
    hit, names = set(), set()
    for name, item in items:
        parts = WORDS.findall((item or "").translate(LOWER))
        n = min(window, len(parts))
        for i in range(len(parts) - n + 1 if parts else 0):
            for j in range(len(words) - n + 1):
                if words[j : j + n] == parts[i : i + n]:
                    hit.update(range(j, j + n))
                    names.add(name)
    return len(words), len(hit), sorted(names)


def test_benchmark_hits(spark):
    ten = "One two, three FOUR five six seven eight nine ten"
    items = [("a", ten + " eleven"), ("b", "short one"), ("c", None), ("d", ""), (None, "gap"), ("b", "short one"), ("10", "é ünï"), ("9", "ünï")]
    texts = [
        None, "", "short one", "shorter one", "x " + ten.upper() + " eleven twelve", ten + " " + ten, "É é ünï!", "é,ünï " * 40,
        "one two three four five six seven eight nine", "a gap", "short one short-one", "short one short one",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id string, text string")
    for r in decontaminate(docs, bench).collect():
        text = texts[r["doc_id"]]
        want = plain_hits(text, [(n or "", t) for n, t in items])
        assert (r["n_words"], r["n_hit"], r["item_ids"]) == want, (r, text)
        assert r["contaminated"] == (want[1] > 0)
        cut = [text[h["start"] : h["end"]] for h in r["hits"]]
        assert sum(len(WORDS.findall(c.translate(LOWER))) for c in cut) == want[1]
    # One automaton holds a checked number of characters.
    size = sum(len(n or "") + len(t or "") for n, t in set(items))
    assert decontaminate(docs, bench, most_chars=size).count() == len(texts)
    with pytest.raises(ValueError, match=f"{size} characters, more than {size - 1}"):
        decontaminate(docs, bench, most_chars=size - 1)


def test_no_items(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    bench = spark.createDataFrame([], "item_id string, text string")
    assert not decontaminate(docs, bench).first()["contaminated"]


def test_benchmark_query(spark, documents):
    items = [(str(r["item_id"]), r["text"]) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    runs = {}
    for name, text in items:
        parts = WORDS.findall((text or "").translate(LOWER))
        n = min(10, len(parts))
        for i in range(len(parts) - n + 1 if parts else 0):
            runs.setdefault(n, {}).setdefault(tuple(parts[i : i + n]), set()).add(name)
    got = {r["doc_id"]: r for r in op3_decontaminate(spark, FOLDER).collect()}
    for d in documents:
        words = WORDS.findall((d["text"] or "").translate(LOWER))
        hit, names = set(), set()
        for n, known in runs.items():
            for j in range(len(words) - n + 1):
                if (owners := known.get(tuple(words[j : j + n]))) is not None:
                    hit.update(range(j, j + n))
                    names |= owners
        r = got[d["doc_id"]]
        assert (r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) == (len(words), len(hit), len(names), bool(hit))
        assert r["items_sha256"] == hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
    assert any(r["contaminated"] for r in got.values())


# Secrets --------------------------------------------------------------------------------------------------------------


def plain_secrets(text):
    text, out = text or "", []
    for m in re.finditer(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text, re.I | re.A):
        if len(m[2]) >= 6:
            out.append((m.start(), m.end(), "assign"))
    out += [(m.start(), m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return out


def test_secrets_same_as_plain(spark):
    texts = [
        None, "", "password=hunter2x", "PassWord : 'abc'", 'api_key="abcdef123"', "secret=token:abcdefgh", "token=token=abcdef",
        "AKIA" + "A" * 16, "AKIAB AKIA" + "1" * 40, "f" * 24 + "g" + "0" * 23, "é token = 'deadbeefdeadbeefdeadbeef00'", "paſſword=abcdefg",
        "toKen=abcdefgh", "a" * 30000, "token=" * 3000,
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in secret_scan.scan_secrets(df).collect():
        got = [(s["start"], s["end"], s["kind"]) for s in r["secrets"] if s["kind"] != "novel"]
        assert got == sorted(plain_secrets(texts[r["doc_id"]]), key=lambda s: (s[0], secret_scan.KINDS.index(s[2])))


def test_novelty(spark):
    key = "kX9v2QpL7mZt4RwB8nYc"
    texts = [
        f"Authorization: Bearer {key} and more", f"the word {key} alone", "auth: configuration_response_handler_2",
        f"session {key} then later {key * 2}", "bearer aaaaaaaaaaaaaaaaaaaaaaaa1", "secret 4929381048572834 card",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: [texts[r["doc_id"]][s["start"] : s["end"]] for s in r["secrets"] if s["kind"] == "novel"] for r in secret_scan.scan_secrets(df).collect()}
    assert got[0] == [key] and got[1] == [] and got[2] == [] and got[4] == [] and got[5] == []


def plain_novel(text, limit, letter_limit, context, around):
    """Novel spans by looking at every token, without the search through base spans."""
    novelty, base, out = secret_scan.Novelty(), plain_secrets(text), []
    for m in re.finditer(r"[A-Za-z0-9+/_=-]+", text):
        start, end = m.span()
        word = m[0]
        if len(word) < 16 or not re.search("[A-Za-z]", word) or any(a < end and start < b for a, b, _ in base):
            continue
        if not secret_scan.SENSITIVE.search(text[max(0, start - context) : start]):
            continue
        least = limit if re.search("[0-9]", word) else letter_limit
        if novelty.of(text[max(0, start - around) : start], word, text[end : end + around]) >= least:
            out.append((start, end))
    return out


def test_novel_spans_same_as_plain(spark):
    r = random.Random(12)
    letters, mixed = "abcdefghijklmnopqrstuvwxyz", "abcXYZ0123456789+/_-="
    texts = ["bearer qwkzxjvbpltmnrsdfghc", "bearer 1234567890123456 x"]
    for _ in range(150):
        words = [r.choice(["token", "session", "the", "bearer", "password=abcdef", "login", "plain"]) for _ in range(6)]
        words += ["".join(r.choices(r.choice([letters, mixed]), k=r.choice([12, 16, 24, 40]))) for _ in range(3)]
        words += [r.choice(["configuration", "authentication"]) * 2, "0" * 20]
        r.shuffle(words)
        texts.append(r.choice([" ", ": ", "\n"]).join(words))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = 0
    for options in ((0.6, 0.95, 60, 256), (0.8, 0.9, 12, 40)):
        out = secret_scan.scan_secrets(df, **dict(zip(("limit", "letter_limit", "context", "around"), options)))
        for row in out.collect():
            got = [(s["start"], s["end"]) for s in row["secrets"] if s["kind"] == "novel"]
            assert got == plain_novel(texts[row["doc_id"]], *options)
            found += len(got)
            if row["doc_id"] == 0:
                assert got == [(7, 27)]
    assert found > 50


def test_secrets_query(spark, documents):
    got = {r["doc_id"]: r for r in op4_secret_scan(spark, FOLDER).collect()}
    for d in documents:
        spans, r = plain_secrets(d["text"]), got[d["doc_id"]]
        counts = Counter(k for _, _, k in spans)
        assert [r[f"n_{k}"] for k in ("assign", "access", "hex")] == [counts[k] for k in ("assign", "access", "hex")]
        assert r["base_sha256"] == digest(spans, ["assign", "access", "hex"])


# Quality --------------------------------------------------------------------------------------------------------------


def plain_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines, seen = 0, set()
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            lines += line in seen
            seen.add(line)
    runs = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {j for i in range(len(words) - 7) if runs[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), lines, len(covered)


def test_quality_counts():
    cache = quality.WordHashes()
    texts = [
        "", "a", "a b c d e f g h i " * 3, "x " * 9, "x " * 8, "é ü\x85 #*\n\n \n a\na\na\n", "l\n" * 5 + "\x0b\n\x0b\n", "|" * 100000,
        "one two three four five six seven eight " + "z " + "one two three four five six seven eight",
    ]
    for text in texts:
        assert quality.measure(text.encode(), cache) == plain_counts(text), text[:40]


def test_quality_query(spark, documents):
    got = {r["doc_id"]: r for r in op6_quality_rules(spark, FOLDER).collect()}
    for d in documents:
        r, want = got[d["doc_id"]], plain_counts(d["text"])
        assert tuple(r[c] for c in quality.FEATURES) == want
        assert r["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r["base_failed"] and r["kept"])


def test_hosts_decide_given_documents(spark):
    folder = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "source")
    labels = spark.read.parquet(f"{folder}/labels.parquet").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    clear = quality.soft_failures(dict.fromkeys(quality.soft_failures(), F.lit(0.0)))
    mild = quality.soft_failures()
    some = lambda rules: rules["symbols"] | rules["lines"] | rules["lengths"]
    counts = quality.quality_rules(docs).filter("not base_failed").join(labels, "doc_id", "left").agg(
        F.count_if(some(clear)).alias("clear"), F.count_if(some(clear) & F.col("kept")).alias("clear_kept"),
        F.count_if(some(mild) & ~some(clear) & ~F.col("kept")).alias("host_rejects"),
        F.count_if(some(mild) & ~some(clear) & F.col("kept")).alias("host_forgives"),
        F.count_if(~some(mild) & ~F.col("kept")).alias("innocent"),
        F.count_if(~F.col("kept") & (F.col("quality") == 1)).alias("good_rejected"), F.count_if(F.col("quality") == 1).alias("good"),
    ).first()
    assert counts["clear"] > 300 and counts["clear_kept"] == counts["innocent"] == 0
    assert counts["host_rejects"] > 300 and counts["host_forgives"] > 0
    assert counts["good_rejected"] < 0.01 * counts["good"]


def test_quality_hosts(spark):
    good = " ".join(f"word{i}" for i in range(40))
    marks = good + " #### #### ####"
    rows = [(i, good, "fine") for i in range(50)] + [(100 + i, marks, "bad") for i in range(30)] + [(200 + i, good, "bad") for i in range(5)]
    rows += [(300, marks, "fine"), (400, None, None), (401, marks, None), (402, "", "new"), (403, "few words", "fine")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("kept", F.lit("old"))
    out = {r["doc_id"]: r for r in quality.quality_rules(df).collect()}
    assert len(out) == len(rows)
    assert all(out[i]["kept"] for i in range(50)) and all(out[200 + i]["kept"] for i in range(5)), "clean documents stay"
    assert not any(out[100 + i]["kept"] for i in range(30)) and not out[100]["base_failed"]
    assert out[300]["kept"], "one failure on a good host"
    assert not out[400]["kept"] and not out[402]["kept"] and not out[403]["kept"]
    assert quality.quality_rules(df.limit(0)).count() == 0
