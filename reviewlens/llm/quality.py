"""Quality rules judged per host: failures are counted by host, shrunk by an empirical beta prior, joined back.

Two hard rules reject a document by itself: too few words, and too large a share of words in repeated windows. The
soft rules (symbols, repeated lines, odd word lengths) measure how bad a document is, and its host decides how bad it may
be. Per rule, the rate of mild failures of each host is drawn towards the mean of all hosts by a beta prior fitted to the
hosts by moments. The shrunk rate over that mean, 1 at most, is the host's strictness: the limit for its documents lies
between the clear limit (strictness 0) and the mild one (strictness 1). So clear junk goes everywhere, a mild failure is
forgiven on a host that seldom fails, and junk that is spread evenly over all hosts meets the mild limit on each of them.
A document that passes the mild limits is never rejected by its host.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewlens.llm.common import WordHashes, bounded_batches, by_bytes, runs_of, stored

MIN_WORDS = 20
REPEAT_PERCENT = 30
REPEAT_WINDOW = 8
SYMBOLS = "#*$%&|<>"
#: Limits of the soft rules, mild and clear: symbols per word, repeated lines, and word length from below and above.
SYMBOL_LIMITS = (0.1, 1.0)
LINE_LIMITS = (3.0, 10.0)
SHORT_LIMITS, LONG_LIMITS = (2.0, 1.25), (15.0, 40.0)
#: Hosts that are broadcast at most, after counting them; more are joined by a shuffle.
BROADCAST_HOSTS = 10_000

FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_SPACES = (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r")
_FIELDS = [pa.field(name, pa.int64()) for name in FEATURES]


def _repeated(hashes: np.ndarray, window: int) -> int:
    """Words inside windows that the text holds twice or more, the first occurrence included."""
    runs = runs_of(hashes, window)
    if len(runs) < 2:
        return 0
    _, group, counts = np.unique(runs, return_inverse=True, return_counts=True)
    starts = np.flatnonzero(counts[group] > 1)
    if not len(starts):
        return 0
    edges = np.zeros(len(hashes) + 1, dtype=np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + window, -1)
    return int((np.cumsum(edges[:-1]) > 0).sum())


def measure(text: bytes, cache: WordHashes, window: int = REPEAT_WINDOW) -> tuple[int, int, int, int, int]:
    """The five counts of one text."""
    words = text.split()
    points = len(text) if text.isascii() else len(text.decode("utf-8", "replace"))
    blank = sum(text.count(space) for space in _SPACES)
    seen: set[bytes] = set()
    repeats = 0
    for line in text.split(b"\n"):
        if line in seen:
            repeats += 1
        elif line and not line.isspace():
            seen.add(line)
    symbols = sum(text.count(c.encode()) for c in SYMBOLS)
    return len(words), points - blank, symbols, repeats, _repeated(cache.of(words), window)


@F.arrow_udf(returnType=T.StructType([T.StructField(name, T.LongType()) for name in FEATURES]))
def text_counts(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    cache = WordHashes()
    for part in parts:
        rows = np.array([measure(text, cache) for text in by_bytes(part)], dtype=np.int64).reshape(-1, len(FEATURES))
        yield pa.StructArray.from_arrays([pa.array(rows[:, i]) for i in range(len(FEATURES))], fields=_FIELDS)


def hard_failure() -> Column:
    few = F.col("n_words") < MIN_WORDS
    return few | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))


def _limit(limits: tuple[float, float], strictness: Column) -> Column:
    mild, clear = limits
    return F.lit(clear) + F.lit(mild - clear) * strictness


def soft_failures(strictness: dict[str, Column] | None = None) -> dict[str, Column]:
    """Whether a document fails each soft rule on a host of some strictness, and without it at the mild limits."""
    n, chars = F.col("n_words"), F.col("word_chars")
    strict = strictness or dict.fromkeys(("symbols", "lines", "lengths"), F.lit(1.0))
    return {
        "symbols": F.col("n_symbols") > _limit(SYMBOL_LIMITS, strict["symbols"]) * n,
        "lines": F.col("n_dup_lines") >= _limit(LINE_LIMITS, strict["lines"]),
        "lengths": (chars < _limit(SHORT_LIMITS, strict["lengths"]) * n) | (chars > _limit(LONG_LIMITS, strict["lengths"]) * n),
    }


def host_rules(judged: DataFrame, host_col: str) -> DataFrame:
    """One row per host: n_docs, and per soft rule its mild failures and the host's strictness.

    With m and v the mean and variance of the hosts' rates, the prior has strength m(1-m)/v - 1 (at least 1), so the
    shrunk rate is (failures + m * strength) / (n + strength). Where all hosts agree the prior is as strong as the
    hosts are large, and every host gets the mean. Rates are whole millionths, so sums don't depend on row order.
    """
    rules = list(soft_failures())
    hosts = stored(
        judged.groupBy(host_col).agg(
            F.count("*").alias("n_docs"), *[F.sum(F.col(f"__{r}").cast("long")).alias(f"__n_{r}") for r in rules]
        ),
        "quality-hosts",
    )
    rate = {r: (F.col(f"__n_{r}") * 1_000_000 / F.col("n_docs")).cast("long") for r in rules}
    prior = hosts.agg(
        F.count("*").alias("__hosts"),
        *[F.sum(rate[r]).alias(f"__s_{r}") for r in rules],
        *[F.sum((rate[r] * rate[r]).cast("decimal(38,0)")).alias(f"__q_{r}") for r in rules],
        F.avg("n_docs").alias("__size"),
    )
    moments = prior.first()
    strictness = {}
    for r in rules:
        mean = moments[f"__s_{r}"] / moments["__hosts"] / 1e6 if moments["__hosts"] else 0.0
        if mean:
            spread = float(moments[f"__q_{r}"]) / moments["__hosts"] / 1e12 - mean * mean
            strength = max(1.0, mean * (1 - mean) / spread - 1) if spread > 1e-12 else moments["__size"]
            shrunk = (F.col(f"__n_{r}") + mean * strength) / (F.col("n_docs") + strength)
            strictness[r] = F.least(F.lit(1.0), shrunk / mean)
        else:
            strictness[r] = F.lit(0.0)
    return hosts.select(
        host_col, "n_docs", *[F.col(f"__n_{r}").alias(f"n_{r}") for r in rules],
        *[strictness[r].alias(f"strict_{r}") for r in rules],
    )


def with_features(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents with the five counts; columns of such a name are replaced."""
    kept = [c for c in docs.columns if c not in FEATURES]
    # A filter on the counts is not to run the counting again below itself.
    counted = bounded_batches(docs).select(*kept, text_counts.asNondeterministic()(F.col(text_col)).alias("__counts"))
    return counted.select(*kept, *[F.col(f"__counts.{c}").alias(c) for c in FEATURES])


def judge(counted: DataFrame, hosts: DataFrame, host_col: str) -> DataFrame:
    """Adds base_failed and kept to counted rows, by the strictness of their hosts."""
    strict = {r: f"__strict_{r}" for r in soft_failures()}
    by_host = hosts.select(F.col(host_col).alias("__host"), *[F.col(f"strict_{r}").alias(c) for r, c in strict.items()])
    if by_host.count() <= BROADCAST_HOSTS:
        by_host = F.broadcast(by_host)
    rejected = reduce(Column.__or__, soft_failures({r: F.coalesce(F.col(c), F.lit(0.0)) for r, c in strict.items()}).values())
    names = [c for c in counted.columns if c not in ("base_failed", "kept")]
    joined = counted.join(by_host, counted[host_col].eqNullSafe(F.col("__host")), "left")
    return joined.select(*names, hard_failure().alias("base_failed"), (~(hard_failure() | rejected)).alias("kept"))


def host_table(counted: DataFrame, host_col: str) -> DataFrame:
    marked = counted.select(host_col, *[failed.alias(f"__{r}") for r, failed in soft_failures().items()])
    return host_rules(marked, host_col)


def quality_rules(docs: DataFrame, *, host_col: str = "source", text_col: str = "text") -> DataFrame:
    """Each document row with its counts, base_failed and kept; columns of such names are replaced.

    A null text counts as empty and fails for too few words. Rows without a host form one host. Repeated rows are
    counted and judged each. A text is measured whole. An empty table gives an empty result.
    The texts are measured twice, once for the hosts and once for the rows, rather than stored in between.
    """
    counted = with_features(docs, text_col)
    return judge(counted, host_table(counted, host_col), host_col)
