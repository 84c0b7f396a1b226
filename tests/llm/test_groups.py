"""Operators over groups of rows, against plain versions: near-duplicates, mixing, shards, URLs, page text."""

import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from reviewlens.llm import main_text, mixture, near_dup, shards, url_filter
from reviewlens.llm.queries import REJECTED_WORDS, URL_RULES, op9_sharding, op10_main_text

FOLDER = "/root/testdata/sf0.001"

# Near-duplicates ------------------------------------------------------------------------------------------------------


def plain_components(rows, k, percent=80):
    sets = {}
    for i, t in rows:
        words = (t or "").encode().lower().split()
        n = min(k, len(words))
        sets[i] = {tuple(words[j : j + n]) for j in range(len(words) - n + 1)} if words else set()
    least = {i: i for i in sets}

    def root(i):
        while least[i] != i:
            i = least[i]
        return i

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                low, high = sorted((root(a), root(b)))
                least[high] = low
    return {i: (len(sets[i]), root(i), root(i) == i) for i in ids}


def check_components(spark, rows, **options):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: tuple(r)[1:] for r in near_dup.near_duplicates(df, **options).collect()}
    assert got == plain_components(rows, options.get("words", near_dup.WORDS))


def test_near_copies(spark):
    r = random.Random(5)
    vocabulary = [f"w{i}" for i in range(500)]
    rows = []
    for g in range(12):
        base = r.choices(vocabulary, k=r.choice([1, 2, 4, 5, 6, 30, 120]))
        for _ in range(r.choice([1, 2, 8, 25])):
            words = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 4])):
                words[r.randrange(len(words))] = r.choice(vocabulary)
            rows.append((len(rows), " ".join(words)))
    rows += [(1000, None), (1001, ""), (1002, " \n"), (1003, "A B"), (1004, "a\tb"), (1005, "solo"), (1006, "Solo")]
    for k in (2, 5):
        check_components(spark, rows, words=k)


def test_chain_at_the_limit(spark):
    # Each set shares just enough with the next one: one component, though its ends share little.
    words = [f"x{i}" for i in range(80)]
    rows = [(i, " ".join(words[i * 4 : i * 4 + 41])) for i in range(10)]
    check_components(spark, rows, words=2)


def test_shared_passage_is_no_copy(spark):
    r = random.Random(8)
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(i, passage + " " + " ".join(f"q{r.random()}" for _ in range(r.choice([14, 15, 16, 20, 30])))) for i in range(60)]
    rows += [(100 + i, rows[i][1].replace("p30", "p31")) for i in range(10)]
    check_components(spark, rows, words=2)


def test_rare_shingles_find_what_bands_of_firsts_miss(spark):
    # Two pairs in one band, whose first member is similar to neither of the second pair.
    members = spark.createDataFrame([(1, 1, 4), (2, 2, 4), (3, 3, 4)], "id long, component long, n long")
    texts = spark.createDataFrame(
        [(1, "a b c d e"), (2, "k l m n o"), (3, "k l m n o")], "id long, text string"
    )
    found = near_dup._by_rare_shingles(members, texts, 2, 80).collect()
    assert [tuple(sorted((x["a"], x["b"]))) for x in found] == [(2, 3)]


def test_components(spark):
    r = random.Random(3)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(500 + i, 501 + i) for i in range(40)] + [(7, 7)]
    links += [(900, 901 + i) for i in range(50)]
    least = {x: x for link in links for x in link}
    for _ in range(400):
        for a, b in links:
            least[a] = least[b] = min(least[a], least[b])
    got = {x["node"]: x["component"] for x in near_dup.connected(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got.get(n, n) == least[n] for n in least)
    assert near_dup.connected(spark.createDataFrame([], "a long, b long")).count() == 0


def test_repeats_and_missing_ids(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(1, text), (1, text), (None, text), (2, text + " tail"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit("clash"))
    got = sorted((str(x["doc_id"]), str(x["component_id"]), x["kept"]) for x in near_dup.near_duplicates(df).collect())
    assert got == [("1", "1", True), ("1", "1", True), ("2", "1", False), ("None", "None", True), ("None", "None", True)]
    assert near_dup.near_duplicates(df.limit(0)).count() == 0


# Mixing ---------------------------------------------------------------------------------------------------------------


def plain_targets(sizes, weights=mixture.WEIGHTS, most=3):
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    full, left = set(), float(sum(sizes.values()))
    while True:
        rest = [s for s in names if s not in full]
        share = {s: left * w[s] / sum(w[x] for x in rest) for s in rest}
        over = [s for s in rest if share[s] > most * sizes[s] + 1e-9]
        if not over:
            return {s: share.get(s, most * sizes[s]) for s in names}
        full |= set(over)
        left = sum(sizes.values()) - sum(most * sizes[s] for s in full)


@pytest.mark.parametrize("seed", range(4))
def test_targets_and_taken(spark, seed):
    r = random.Random(seed)
    rows = [(i, "w " * r.randint(0, 30), r.choice(["a", "b", "c", "hot", "hot", "hot", None, "é"][: 3 + seed * 2])) for i in range(400)]
    rows += [(1000, None, "empty"), (1001, "", "empty"), (None, "x y", "a"), (5, rows[5][1], rows[5][2])]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixture.mix(df, quality=F.when(F.col("doc_id") % 2 == 0, 3.0), pieces=16).collect()
    again = mixture.mix(df.repartition(3), quality=F.when(F.col("doc_id") % 2 == 0, 3.0), pieces=4).collect()
    assert len(out) == len(rows) and sorted(map(repr, out)) == sorted(map(repr, again)), "neither order nor pieces matter"
    sizes, taken, biggest = defaultdict(int), defaultdict(int), defaultdict(int)
    for x in out:
        sizes[x["source"]] += x["size"]
        taken[x["source"]] += x["size"] * x["copies"]
        biggest[x["source"]] = max(biggest[x["source"]], x["size"])
        assert 0 <= x["copies"] <= 3
    want = plain_targets(sizes)
    for x in out:
        assert x["source_size"] == sizes[x["source"]] and x["target"] == pytest.approx(want[x["source"]])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= biggest[s]
    assert sum(want.values()) == pytest.approx(sum(sizes.values()))
    for s in sizes:  # whole epochs come first
        copies = {x["copies"] for x in out if x["source"] == s and x["size"]}
        assert max(copies, default=0) - min(copies, default=0) <= 1


def test_weights_matter(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("w w").alias("text"), F.lit("s").alias("source"), (F.col("id") % 2).alias("heavy"))
    other = spark.range(1000).select((F.col("id") + 9000).alias("doc_id"), F.lit("w " * 6).alias("text"), F.lit("t").alias("source"), F.lit(0).cast("long").alias("heavy"))
    out = mixture.mix(df.union(other), quality=F.when(F.col("heavy") == 1, 4.0).otherwise(1.0), weights=(1, 3))
    picked = out.filter("source = 's' and copies > 0").groupBy((F.col("doc_id") % 2).alias("heavy")).count().collect()
    counts = {x["heavy"]: x["count"] for x in picked}
    assert counts[1] > 1.5 * counts.get(0, 0)


def test_mix_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixture.mix(df).count() == 0
    df = spark.createDataFrame([(1, None, None)], "doc_id long, text string, source string")
    assert [tuple(x) for x in mixture.mix(df).collect()] == [(1, None, 0, 0, 0.0, 0)]


def test_mix_stays_native(spark):
    df = spark.read.parquet(f"{FOLDER}/documents.parquet")
    plan = mixture.mix(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# Shards ---------------------------------------------------------------------------------------------------------------


def test_smallest_capacity():
    r = random.Random(4)
    for _ in range(300):
        sizes = [r.randint(1, 30) for _ in range(r.randint(0, 9))]
        n = r.randint(1, 5)
        least = next(c for c in range(0, 400) if max(sizes, default=0) <= c and shards.needed(sizes, c) <= n)
        assert shards.smallest_capacity(sizes, n) == least
        home = shards.cut(sizes, n)
        assert home == sorted(home) and all(h < n for h in home)
        loads = defaultdict(int)
        for h, s in zip(home, sizes, strict=True):
            loads[h] += s
        assert max(loads.values(), default=0) <= least


def check_shards(rows, n):
    slots, homes, loads = defaultdict(list), defaultdict(set), defaultdict(int)
    for x in rows:
        assert 0 <= x["shard"] < n
        slots[x["shard"]].append(x["slot"])
        homes[x["key"]].add(x["shard"])
        loads[x["shard"]] += x["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(h) == 1 for h in homes.values()), "equal texts stay together"
    return loads


def test_sharding_query(spark):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    rows = [r.asDict() for r in op9_sharding(spark, FOLDER).collect()]
    assert {r["doc_id"] for r in rows} == texts.keys()
    for r in rows:
        r["key"] = texts[r["doc_id"]]
        assert r["size"] == len(r["key"].encode()) + 16 and r["text_crc32"] == zlib.crc32(r["key"].encode())
    loads = check_shards(rows, 40)
    largest = defaultdict(int)
    for r in rows:
        largest[r["key"]] += r["size"]
    assert max(loads.values()) <= sum(loads.values()) / 40 + max(largest.values())
    again = [r.asDict() for r in op9_sharding(spark, FOLDER).collect()]
    assert {(r["doc_id"], r["shard"], r["slot"]) for r in rows} == {(r["doc_id"], r["shard"], r["slot"]) for r in again}


def test_shards_of_copies_and_nulls(spark, monkeypatch):
    monkeypatch.setattr(shards, "PIECE_ROWS", 7)
    rows = [(i, "copy") for i in range(60)] + [(i, f"text {i}" * (i % 9)) for i in range(100, 160)]
    rows += [(1, None), (None, ""), (None, "copy"), (3, "copy"), (3, "copy")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("size", F.lit("clash"))
    out = [r.asDict() | {"key": r["text"] or ""} for r in shards.shard(df, shards=5).collect()]
    assert len(out) == len(rows)
    check_shards(out, 5)
    assert shards.shard(df.limit(0), shards=5).count() == 0


# URLs -----------------------------------------------------------------------------------------------------------------


def test_hosts_rules_and_odd_urls(spark):
    urls = [
        None, "", "no scheme/x", "HTTP://WWW.Example.ORG/en/1x?q", "http://example.org/es/", "http://notexample.org/es/", "x://a.com/fr/",
        "x://a.com/fr", "https://é.com/de/ü#f", "http://host?x/y", "a://b://c/d", "http://example.org", "://", "http://A\nb.com/de/\nx",
    ]
    want = [
        ("", "", None), ("", "", None), ("", "", None), ("www.example.org", "/en/1x", "example.org/en/1"), ("example.org", "/es/", "example.org/es/"),
        ("notexample.org", "/es/", "org/"), ("a.com", "/fr/", "com/fr/"), ("a.com", "/fr", None), ("é.com", "/de/ü", "com/de/"),
        ("host", "", None), ("b:", "//c/d", None), ("example.org", "", None), ("", "", None), ("a\nb.com", "/de/\nx", "com/de/"),
    ]
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, verdict string")
    out = {r["page_id"]: r for r in url_filter.filter_urls(df, URL_RULES, rejected_words=REJECTED_WORDS).collect()}
    for i, w in enumerate(want):
        r = out[i]
        assert (r["host"], r["path"], r["rule"]) == w, urls[i]
        assert r["verdict"] == (URL_RULES[w[2]] if w[2] else r["verdict"]) and r["verdict"] in ("allow", "block")
    assert url_filter.filter_urls(df.limit(0), URL_RULES).count() == 0


def test_one_class_allows_all(spark):
    df = spark.createDataFrame([(1, "http://a.org/x"), (2, "http://b.net/casino"), (2, "http://b.net/casino")], "page_id long, url string")
    assert [r["verdict"] for r in url_filter.filter_urls(df, {"org/": "allow"}).collect()] == ["allow"] * 3


def test_held_out_accuracy(spark):
    r = random.Random(6)
    good, bad = ["garden", "museum", "river", "library", "school"], ["casino", "jackpot", "slots", "pokies", "bonus"]

    def url(i, words, end):
        return f"http://{r.choice(words)}-{r.choice(words)}.{end}/{r.choice(words)}/{i}"

    rows = [(i, url(i, good, "org"), True) for i in range(400)] + [(i, url(i, bad, "xyz"), False) for i in range(400, 700)]
    rows += [(i, url(i, good, "net"), True) for i in range(1000, 1100)] + [(i, url(i, bad, "net"), False) for i in range(1100, 1200)]
    df = spark.createDataFrame(rows, "page_id long, url string, good boolean")
    out = url_filter.filter_urls(df, {"org/": "allow", "xyz/": "block"}).filter("rule is null").collect()
    right = sum((x["verdict"] == "allow") == x["good"] for x in out)
    assert len(out) == 200 and right >= 195


def test_url_filter_stays_native(spark):
    df = spark.read.parquet(f"{FOLDER}/pages.parquet").select("page_id", "url")
    plan = url_filter.filter_urls(df, URL_RULES)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_url_models_stay_off_the_driver(spark, monkeypatch):
    urls = [(i, f"http://h{i % 7}.{'net/casino' if i % 3 else 'org'}/{i}") for i in range(60)]
    df = spark.createDataFrame(urls, "page_id long, url string")
    seen = []

    def noted(fn):
        def call(*args, **kwargs):
            out = fn(*args, **kwargs)
            seen.append(out if hasattr(out, "collect") else args[0])
            return out

        return call

    for name in ("score_urls", "calibrated_limit"):
        monkeypatch.setattr(url_filter, name, noted(getattr(url_filter, name)))
    frames = [url_filter.filter_urls(df, {"org/": "allow", "net/": "block"}), *seen]
    assert len(frames) == 3
    for frame in frames:
        frame.collect()
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan


# Page text ------------------------------------------------------------------------------------------------------------


def lines(html):
    return [text for text, _, _ in main_text.page_lines(html)]


def test_lines_of_blocks():
    assert lines("<p>a <b>b</b>\n c&nbsp;&amp;d<br>e<p>f</p>g<div>h<span>i</span></div>") == ["a b c &d e", "f", "g", "hi"]
    assert lines("<nav><ul><li>x</nav><p>y<footer>z</footer><aside>s</aside><form>f</form>") == ["y"]
    assert lines('<div class="ad">x<div>y</div></div>z<div id="user-comments"><p>c</p></div>') == ["z"]
    assert lines('<script>var t="</p>";</script><style>p{}</style><title>t</title><!-- <p>no --><p>1 < 2 & 3 &copy 4') == ["1 < 2 & 3 © 4"]
    assert lines('<div title="a > b" class=sidebar>x</div><p>y<img alt="<p>">z</p>') == ["yz"]
    assert lines("<header>top</header><article><header><h1>h</h1></header><p>p</p></article>") == ["h", "p"]
    assert lines("<nav><a>m</a><article><p>kept</p></article>") == ["kept"]
    assert lines("") == [] and lines("<p></p> <br>") == [] and lines("text only") == ["text only"] and lines("<p>x</p><div cl") == ["x"]
    assert lines("a" * 100000 + "<" * 20000) != []


def test_names_hide_no_wanted_text():
    assert lines('<main class="site-main has-sidebar"><p>x</p></main>') == ["x"]
    assert lines('<article class="post comment-open"><p>x</p></article>') == ["x"]
    assert lines('<div class="layout no-sidebar"><article><p>x</p></article></div>') == ["x"]
    assert lines('<div class="content sidebar"><p>menu</p><article><p>x</p></article><p>y</p></div>') == ["x", "y"]
    assert lines('<article><section class="search-engines"><p>x</p></section><p>costs <span class="share-price promo">9 dollars</span></p></article>') == ["x", "costs 9 dollars"]
    assert lines('<article><p>x</p><div class="share-buttons">s</div><div id="user-comments">c</div><p hidden>h</p></article>') == ["x"]
    assert lines('<article><p>x</p></article><article class="comment"><p>c</p></article><div class="related"><article>r</article></div>') == ["x"]
    assert lines('<div style="display: none"><article>x</article></div>') == []


def test_shared_lines():
    r = random.Random(2)
    for _ in range(300):
        a, b = ([r.randrange(6) for _ in range(r.randint(0, 9))] for _ in range(2))
        kept = main_text.shared_lines(a, b)
        assert kept == sorted(kept)
        rest = iter(b)
        assert all(a[i] in rest for i in kept), "a common subsequence"
    assert main_text.shared_lines([1, 2, 3, 4], [9, 1, 3, 4, 2]) == [0, 2, 3]


def test_template_lines_go(spark):
    def page(i):
        return f"<div>Site name</div><div><p>Body {i} of its own.</p><p>More {i}.</p></div><div>Powered by x</div>"

    rows = [(i, f"http://h.com/a/{i:03}", page(i)) for i in range(30)] + [(100, "http://h.com/a/005", page(5)), (101, "http://h.com/a/005", page(5))]
    rows += [(200, "http://alone.com/", page(1)), (201, None, None), (202, None, ""), (203, "http://h.com/zz", "<article><p>Site name</p><p><a>Site name</a></p></article>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    out = {r["page_id"]: r["text"] for r in main_text.main_text(df).collect()}
    assert len(out) == len(rows)
    for i in range(30):
        assert out[i] == f"Body {i} of its own.\nMore {i}.", i
    assert out[200] == "Site name\nBody 1 of its own.\nMore 1.\nPowered by x"
    assert out[201] == out[202] == "" and out[203].startswith("Site name")
    assert main_text.main_text(df.limit(0)).count() == 0


def test_shared_lines_are_longest(monkeypatch):
    r = random.Random(9)

    def longest(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            row = [0] + [max(row[j + 1], row[j] + 1 if x == y else 0) for j, y in enumerate(b)]
            for j in range(len(b)):
                row[j + 1] = max(row[j + 1], row[j])
        return row[-1]

    for bits in (main_text.ROW_BITS, 4):
        monkeypatch.setattr(main_text, "ROW_BITS", bits)
        for _ in range(400):
            a, b = ([r.randrange(5) for _ in range(r.randint(0, 14))] for _ in range(2))
            kept = main_text.shared_lines(a, b)
            rest = iter(b)
            assert all(a[i] in rest for i in kept) and len(kept) == longest(a, b)
    assert main_text.shared_lines([7, 1, 7], [1, 7]) == [1, 2], "occurrences pair by order, not by number"


def page_texts(spark, rows):
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    return {r["page_id"]: r["text"] for r in main_text.main_text(df).collect()}


def test_copies_are_one_page(spark):
    # Ten template lines and one of its own; an article whose links are all template; many copies side by side.
    template = [f"<p>Part {k}</p>" for k in range(10)]
    rows = [(i, f"http://short.com/{i:02}", "".join(template) + f"<p>Own {i}</p>") for i in range(8)]
    rows += [(100 + i, f"http://links.com/{i:02}", f"<article><p>Own {i}</p><p><a>Home</a></p><p><a>Top</a></p></article>") for i in range(8)]
    rows += [(200 + i, f"http://many.com/a{i:02}", "<p>Menu</p><p>Story</p>") for i in range(30)]
    rows += [(300, "http://many.com/b", "<p>Menu</p><p>Other</p>")]
    # Another version of a page is no template.
    rows += [(400 + i, f"http://two.com/{i}", "".join(template) + f"<p>Views {i}</p>") for i in range(2)]
    out = page_texts(spark, rows)
    assert [out[i] for i in range(8)] == [f"Own {i}" for i in range(8)]
    assert [out[100 + i] for i in range(8)] == [f"Own {i}" for i in range(8)]
    assert {out[200 + i] for i in range(30)} == {"Story"} and out[300] == "Other"
    assert out[400].count("Part") == 10


def test_template_prose_in_articles(spark):
    def page(i):
        own = "".join(f"<p>Own {i} {k}</p>" for k in range(3))
        quote = "<blockquote><p>Famous words</p></blockquote>"
        return f"<article><p>Tell your friends</p>{own}{quote}{'<p>Said twice</p>' if i in (3, 4) else ''}<p>Licence: free</p></article>"

    rows = [(i, f"http://h.com/{'abcdefgh'[i]}{i:08}", page(i)) for i in range(8)]
    rows += [(100 + i, f"http://few.com/{i}", page(i)) for i in range(3)]
    # Versions of one article keep it.
    story = "".join(f"<p>Line {k}</p>" for k in range(20))
    rows += [(200 + i, f"http://v.com/{i}", f"<article>{story}<p>Edition {i}</p></article>") for i in range(9)]
    out = page_texts(spark, rows)
    for i in range(8):
        want = [f"Own {i} {k}" for k in range(3)] + ["Famous words"] + ["Said twice"] * (i in (3, 4))
        assert out[i].split("\n") == want
    assert all(out[100 + i].startswith("Tell your friends") for i in range(3))
    assert all(out[200 + i].count("\n") == 20 for i in range(9))


def test_page_query(spark):
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{FOLDER}/pages.parquet").collect()}
    got = {r["page_id"]: r for r in op10_main_text(spark, FOLDER).collect()}
    assert got.keys() == pages.keys()
    for i, r in got.items():
        body = re.search(r"(?s)<article>(.*?)(?:</article>|<footer>|\Z)", pages[i]["html"])[1]
        parts = [re.sub(r"<[^>]*>", "", b) for b in re.split(r"</?(?:p|h1|li|div)>", body)]
        import html

        want = [w for w in (" ".join(html.unescape(p).split()) for p in parts) if w]
        assert r["text"] == "\n".join(want) and r["n_chars"] == len(r["text"]) and r["url"] == pages[i]["url"]
