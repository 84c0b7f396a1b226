"""URL filter by a character language-model ratio.

Two variable-order Markov models, one of accepted and one of rejected URLs, give every character a probability from
the longest context that was seen, smoothed by Witten-Bell with the shorter ones down to uniform. A URL's score is the
difference of its log-likelihoods per character; the limit is calibrated on held-out accepted URLs, so that at most a
given share of them would be rejected, and never above zero.

A character's probability depends on it and its last few predecessors alone. So the models are evaluated once per
distinct character window of the URLs, and the windows' scores, whole micro-units, are joined to the URLs: sums don't
depend on row order. Windows that most URLs share are salted in that join. Everything is DataFrame expressions.

Both sides of every join grow with the URLs, and their files and shuffles are packed far below their size in memory, so
Spark would take some for small: merge joins keep them off the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlens.llm.common import md5_part, stored

ORDER = 5
ALPHABET = 256
HELD_OUT = 5
FALSE_REJECTS = 0.01
SALT = 16
PAD = "\u0002"
END = "\u0003"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host in lower case (A-Z) and path as given; both empty without `://`."""
    has = F.coalesce(F.instr(url, "://") > 0, F.lit(False))
    rest = F.substr(url, F.instr(url, "://") + F.lit(3))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*+)", 1), upper, lower)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*+([^?#]*+)", 1)
    return F.when(has, host).otherwise(""), F.when(has, path).otherwise("")


def matching_rule(rules: dict[str, str], host: Column, path: Column) -> Column:
    """The longest rule (host and path in one string) that fits, else null."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r), r)):
        domain, _, rest = rule.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith("/" + rest)
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def windows_of(key: Column, order: int = ORDER) -> Column:
    """For each character of the text and its end mark, that character with its predecessors."""
    padded = F.concat(F.lit(PAD * order), key, F.lit(END))
    return F.transform(F.sequence(F.lit(1), F.length(key) + 1), lambda i: F.substr(padded, i, F.lit(order + 1)))


def _counts(labelled: DataFrame, order: int) -> tuple[DataFrame, DataFrame]:
    """Per n-gram its count in each class; per context its count and number of successors in each class.

    Longest windows are counted first; shorter n-grams are suffixes of those, so the URLs are cut only once.
    """
    grams = labelled.select("accepted", F.explode(windows_of(F.col("key"), order)).alias("window"))
    longest = grams.groupBy("window").agg(
        F.count_if("accepted").alias("a"), F.count_if(~F.col("accepted")).alias("r")
    )
    suffix = F.explode(F.transform(F.sequence(F.lit(1), F.lit(order + 1)), lambda n: F.right(F.col("window"), n)))
    counts = longest.select(suffix.alias("gram"), "a", "r").groupBy("gram").agg(F.sum("a").alias("a"), F.sum("r").alias("r"))
    counts = stored(counts, "url-grams")
    context = F.substr(F.col("gram"), F.lit(1), F.length("gram") - 1)
    contexts = counts.groupBy(context.alias("context")).agg(
        F.sum("a").alias("n_a"), F.count_if(F.col("a") > 0).alias("t_a"),
        F.sum("r").alias("n_r"), F.count_if(F.col("r") > 0).alias("t_r"),
    )
    return counts, contexts


def _witten_bell(levels: Column, gram: str, n: str, t: str) -> Column:
    """Probability of the last character, from the shortest to the longest context."""
    return F.aggregate(
        levels,
        F.lit(1.0 / ALPHABET),
        lambda p, x: F.when(x[n] > 0, (x[gram] + x[t] * p) / F.when(x[n] > 0, x[n] + x[t])).otherwise(p),
    )


def window_scores(windows: DataFrame, counts: DataFrame, contexts: DataFrame, order: int = ORDER) -> DataFrame:
    """Log-likelihood difference of each distinct window's last character, in whole micro-units."""
    parts = F.explode(F.transform(F.sequence(F.lit(1), F.lit(order + 1)), lambda n: F.right(F.col("window"), n)))
    levels = windows.select("window", parts.alias("gram")).withColumn(
        "context", F.substr(F.col("gram"), F.lit(1), F.length("gram") - 1)
    )
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("a", "r", "n_a", "t_a", "n_r", "t_r")]
    found = levels.join(counts.hint("merge"), "gram", "left").join(contexts.hint("merge"), "context", "left")
    by_window = found.groupBy("window").agg(
        F.array_sort(F.collect_list(F.struct(F.length("gram").alias("n"), *zero))).alias("levels")
    )
    ratio = F.log(_witten_bell(F.col("levels"), "a", "n_a", "t_a")) - F.log(
        _witten_bell(F.col("levels"), "r", "n_r", "t_r")
    )
    return by_window.select("window", F.round(ratio * 1_000_000).cast("long").alias("micro"))


def score_urls(keys: DataFrame, labelled: DataFrame, *, order: int = ORDER, salt: int = SALT) -> DataFrame:
    """Per distinct `key` its length-normalised score (whole micro-units per character), by models of `labelled`.

    `labelled` has key and accepted. Keys must be distinct.
    """
    counts, contexts = _counts(labelled, order)
    cut = keys.select("key", F.explode(windows_of(F.col("key"), order)).alias("window"))
    scores = window_scores(cut.select("window").distinct(), counts, contexts, order)
    salted = cut.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(salt)))
    spread = scores.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salt - 1).cast("long"))))
    sums = salted.join(spread.hint("merge"), ["window", "salt"]).groupBy("key").agg(
        F.sum("micro").alias("total"), F.count("*").alias("n")
    )
    return sums.select("key", F.round(F.col("total") / F.col("n")).cast("long").alias("score"))


def calibrated_limit(scores: DataFrame, share: float = FALSE_REJECTS, step: int = 1000) -> int:
    """The largest limit (a multiple of `step`) below which at most `share` of these scores lie, but zero at most.

    Above zero a URL is likelier under the accepted model, however far the held-out ones lie. Scores are counted in steps of a thousandth; the number of steps is bounded by the range of log-likelihoods.
    """
    bins = scores.groupBy(F.floor(F.col("score") / step).cast("long").alias("bin")).agg(F.count("*").alias("n")).collect()
    allowed, below, limit = share * sum(r["n"] for r in bins), 0, 0
    for r in sorted(bins, key=lambda r: r["bin"]):
        limit = r["bin"] * step
        below += r["n"]
        if below > allowed:
            break
    return min(0, limit)


def filter_urls(
    urls: DataFrame,
    rules: dict[str, str],
    *,
    url_col: str = "url",
    rejected_words: tuple[str, ...] = (),
    background: bool = False,
    order: int = ORDER,
    false_rejects: float = FALSE_REJECTS,
) -> DataFrame:
    """Each row with host, path, rule, score (null where a rule decides) and verdict ("allow" or "block").

    URLs that a rule decides train the models: blocked ones, and any whose host holds one of `rejected_words`, as
    rejected; allowed ones as accepted. With `background`, those that nothing decides are accepted examples too: where
    rules cover only some hosts or languages, the models would else tell covered from uncovered ones. A fifth of the
    examples, by hash, is held out to calibrate the limit. Columns of the added names are replaced. Null URLs and ones without `://` have empty host and path and are scored as the empty
    text. Repeated URLs are scored once. Where either class has no example, all that no rule decides is allowed.
    """
    kept = [c for c in urls.columns if c not in ("host", "path", "rule", "score", "verdict")]
    host, path = host_and_path(F.col(url_col))
    split = urls.select(*kept, host.alias("host"), path.alias("path"))
    ruled = split.withColumn("rule", matching_rule(rules, F.col("host"), F.col("path")))
    decided = F.element_at(F.create_map(*[F.lit(x) for pair in rules.items() for x in pair]), F.col("rule"))
    ruled = ruled.withColumn("__decided", decided).withColumn("__key", F.concat("host", "path"))
    bad = F.lit(False)
    for word in rejected_words:
        bad = bad | F.col("host").contains(word)
    # One row per distinct host and path; all that follows is on these.
    keys = stored(
        ruled.select(F.col("__key").alias("key"), "host", F.col("__decided").alias("decided"))
        .groupBy("key")
        .agg(F.max("decided").alias("decided"), F.max(bad).alias("bad")),
        "url-keys",
    )
    accepted = F.when(F.col("bad") | (F.col("decided") == "block"), False).when(
        (F.col("decided") == "allow") | F.lit(background), True
    )
    labels = keys.select("key", accepted.alias("accepted")).filter("accepted is not null")
    fold = md5_part(F.col("key"), 1, 8) % HELD_OUT
    train = labels.filter(fold != 0)
    seen = train.agg(F.count_if("accepted").alias("a"), F.count_if(~F.col("accepted")).alias("r")).first()
    if not (seen["a"] and seen["r"]):
        scored = keys.select("key", F.lit(0).cast("long").alias("score"))
        limit = 0
    else:
        scored = stored(score_urls(keys.select("key"), train, order=order), "url-scores")
        held = labels.filter("accepted").filter(fold == 0)
        limit = calibrated_limit(scored.join(held.hint("merge"), "key"), false_rejects)
    open_rows = ruled.join(scored.withColumnRenamed("key", "__key").hint("merge"), "__key", "left")
    return open_rows.select(
        *kept, "host", "path", "rule",
        F.when(F.col("rule").isNull(), F.col("score")).alias("score"),
        F.coalesce("__decided", F.when(F.col("score") < limit, "block").otherwise("allow")).alias("verdict"),
    )
