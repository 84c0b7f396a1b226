"""Benchmark decontamination with one Aho-Corasick automaton over normalised test items.

Texts are lower-cased (A-Z) and cut into words of digits, letters and non-ASCII characters. Every window of
consecutive item words is a pattern; an item with fewer words is one pattern. Documents are scanned once, as a
single string of words with one space around each, so that matches end at word borders, and hits are mapped back
to code point offsets of the original text.

The items are a stated query set of bounded size: the driver reads them and every task builds the automaton, which takes
some 400 bytes a character. More characters than `most_chars` are an error; such a set is cut by item, each part run on its
own, and the findings joined by document. Documents are not shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlens.llm.common import bounded_batches, by_bytes, emit

WINDOW = 10
#: Characters of all distinct items that one automaton may hold.
MOST_CHARS = 1_000_000

#: Digits, letters in lower case and all non-ASCII bytes stay; the other ASCII bytes part words.
FOLD = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 32
    for b in range(256)
)


def _automaton(items: list[tuple[str, bytes]], window: int) -> ahocorasick.Automaton | None:
    """Patterns of all windows, each with its number of words and the items that hold it."""
    owners: dict[bytes, tuple[int, set[str]]] = {}
    for name, text in items:
        words = text.translate(FOLD).split()
        for i in range(max(1, len(words) - window + 1) if words else 0):
            part = words[i : i + window]
            owners.setdefault(b" " + b" ".join(part) + b" ", (len(part), set()))[1].add(name)
    if not owners:
        return None
    found = ahocorasick.Automaton()
    for pattern, value in owners.items():
        found.add_word(pattern.decode("latin-1"), value)
    found.make_automaton()
    return found


def _scan(text: bytes, automaton) -> tuple[int, list[tuple[int, int]], set[str]]:
    """Number of words, hit word ranges (end exclusive) and the items that occur."""
    words = text.translate(FOLD).split()
    if automaton is None or not words:
        return len(words), [], set()
    joined = b" " + b" ".join(words) + b" "
    ranges, names = [], set()
    spaces = None
    for end, (n, owners) in automaton.iter(joined.decode("latin-1")):
        if spaces is None:
            spaces = np.flatnonzero(np.frombuffer(joined, dtype=np.uint8) == 32)
        last = int(np.searchsorted(spaces, end))
        ranges.append((last - n, last))
        names |= owners
    return len(words), ranges, names


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted ranges with overlapping and touching ones joined."""
    out: list[tuple[int, int]] = []
    for first, last in sorted(ranges):
        if out and first <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], last))
        else:
            out.append((first, last))
    return out


def offsets(text: bytes, ranges: list[tuple[int, int]]) -> list[dict]:
    """Word ranges as code point offsets of the original text, end exclusive."""
    if not ranges:
        return []
    folded = np.frombuffer(text.translate(FOLD), dtype=np.uint8)
    inside = np.concatenate([[0], (folded != 32).view(np.int8), [0]])
    starts, ends = np.flatnonzero(np.diff(inside) == 1), np.flatnonzero(np.diff(inside) == -1)
    points = np.concatenate([[0], np.cumsum((np.frombuffer(text, dtype=np.uint8) & 0xC0) != 0x80)])
    return [{"start": int(points[starts[a]]), "end": int(points[ends[b - 1]])} for a, b in ranges]


def _items(items: DataFrame, item_col: str, text_col: str, most_chars: int) -> list[tuple[str, bytes]]:
    """The distinct items, after a check of their size."""
    named = items.select(
        F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("id"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    ).distinct()
    total = named.agg(F.coalesce(F.sum(F.length("text") + F.length("id")), F.lit(0)).alias("n")).first()["n"]
    if total > most_chars:
        raise ValueError(f"the items hold {total} characters, more than {most_chars}")
    return [(r["id"], r["text"].encode()) for r in named.collect()]


def decontaminate(
    docs: DataFrame,
    items: DataFrame,
    *,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    most_chars: int = MOST_CHARS,
) -> DataFrame:
    """Each document row with what it shares with the items.

    Adds n_words, n_hit (words inside any occurrence of a window), item_ids (items with occurring windows, sorted
    as strings), hits (code point ranges of the original text) and contaminated. A column of such a name is replaced.
    Null and empty texts have no words and no hits. Items without words match nothing; a null item id counts as an
    empty one; repeated items count once; repeated documents each get their row. No items: nothing is contaminated.
    """
    added = {"n_words", "n_hit", "item_ids", "hits", "contaminated"}
    kept = [c for c in docs.columns if c not in added]
    out = bounded_batches(docs).select(*kept)
    known = _items(items, item_col, item_text_col, most_chars)
    arrow = pa.schema(
        [
            ("n_words", pa.int64()), ("n_hit", pa.int64()), ("item_ids", pa.list_(pa.string())),
            ("hits", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
        ]
    )

    @F.arrow_udf(returnType="n_words long, n_hit long, item_ids array<string>, hits array<struct<start: long, end: long>>")
    def shared(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        automaton = _automaton(known, window)
        for part in parts:
            rows: dict[str, list] = {f.name: [] for f in arrow}
            for text in by_bytes(part):
                n, ranges, names = _scan(text, automaton)
                ranges = merged(ranges)
                rows["n_words"].append(n)
                rows["n_hit"].append(sum(b - a for a, b in ranges))
                rows["item_ids"].append(sorted(names))
                rows["hits"].append(offsets(text, ranges))
            batch = next(emit([rows], arrow))
            yield pa.StructArray.from_arrays(batch.columns, fields=list(arrow))

    # A filter on the findings is not to run the scan again below itself.
    out = out.withColumn("__shared", shared.asNondeterministic()(F.col(text_col)))
    return out.select(
        *kept,
        *[F.col(f"__shared.{c}").alias(c) for c in ("n_words", "n_hit", "item_ids", "hits")],
        (F.col("__shared.n_hit") > 0).alias("contaminated"),
    )
