"""Katz backoff language model: counted, stored in partitioned tables and evaluated per token.

Bigram and unigram counts are discounted by Good-Turing, and what a context loses is given to the words that never
followed it, in proportion to their lower-order probability, with a weight that makes the context's probabilities sum to
exactly one. The recursion ends at unigrams, whose own discount is the probability of the unknown word.

All counts are over all training texts, and nothing is pruned. Words are 64-bit hashes until the vocabulary gives them
numbers. To keep shuffles small, texts are first packed into blocks (a few million tokens, with a dictionary of their own),
and blocks talk to buckets: a block sends each bucket its distinct words or bigrams, the bucket sums them over all
blocks and answers with totals. The steps:

1. blocks: tokens of each block as numbers of its dictionary;
2. unigram buckets by word hash: totals and numbers of words, counts of counts;
3. bigram buckets by context: totals of bigrams, counts of counts (the stored model table);
4. backoff weights in each bucket, then answers to the blocks, which add up the probabilities of their texts.

Contexts that own a large share of the tokens are split over buckets by the following word; their sums are merged on the
driver, where their number is at most SPLITS * 2.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlens.llm.common import WordHashes, bounded_batches, by_bytes, mixed, stored

BLOCK_TOKENS = 2_000_000
BUCKET_TOKENS = 2_000_000
#: Counts up to this are discounted by Good-Turing.
DISCOUNTED = 5
#: Contexts are split when they own more than this many tokens, or more than one SPLITS-th of all.
HOT_TOKENS = 1_000_000
SPLITS = 65_536
#: Numbers of the start of a text and of words without training count.
START, UNKNOWN, FIRST = 0, 1, 2
END_WORD = b" "
TINY = 1e-12

BLOCKS = (
    "block long, n_tokens long, n_train long, train_docs long, ids array<long>, held array<boolean>, lengths binary, "
    "tokens binary, order binary, words binary, counts binary"
)
UNIGRAMS = "bucket int, block long, words binary, numbers binary, totals binary, stats array<long>"
BIGRAMS = (
    "bucket int, contexts binary, context_totals binary, rows binary, words binary, counts binary, word_totals binary, "
    "blocks array<long>, places array<binary>, asked array<binary>, stats array<long>"
)


def pack(values: np.ndarray, kind: str = "<u8") -> bytes:
    """Whole numbers by byte planes, compressed."""
    flat = np.ascontiguousarray(values, dtype=kind)
    planes = flat.view(np.uint8).reshape(len(flat), flat.itemsize).T
    return zstandard.ZstdCompressor(level=3).compress(planes.tobytes())


def unpack(data: bytes, kind: str = "<u8") -> np.ndarray:
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8)
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(flat.reshape(width, -1).T).view(kind).reshape(-1)


def discounts(n: list[int]) -> np.ndarray:
    """Factor of each count up to DISCOUNTED (index 0 unused), from n[c], how many items occur c times.

    Good-Turing in Katz's form; where the counts of counts don't allow it (a gap, or a factor outside (0, 1]), absolute
    discounting by n1 / (n1 + 2 n2) takes its place.
    """
    k = DISCOUNTED
    out = np.ones(k + 1)
    if n[1] == 0:
        return out
    if all(n[c] > 0 for c in range(1, k + 2)):
        common = (k + 1) * n[k + 1] / n[1]
        if common < 1:
            for c in range(1, k + 1):
                out[c] = ((c + 1) * n[c + 1] / (c * n[c]) - common) / (1 - common)
            if np.all((out[1:] > 0) & (out[1:] <= 1)):
                return out
    lost = n[1] / (n[1] + 2 * n[2])
    out[1:] = [(c - lost) / c for c in range(1, k + 1)]
    # With no count of two, a count of one would lose everything.
    return np.maximum(out, 0.5 / np.maximum(np.arange(k + 1), 1)) if lost >= 1 else out


def discounted(counts: np.ndarray, factors: np.ndarray) -> np.ndarray:
    return counts * np.where(counts <= DISCOUNTED, factors[np.minimum(counts, DISCOUNTED).astype(np.int64)], 1.0)


class Unigrams:
    """Probabilities of words by their totals."""

    def __init__(self, tokens: int, n: list[int]) -> None:
        self.tokens, self.factors = tokens, discounts(n)
        lost = sum(n[c] * c * (1 - self.factors[c]) for c in range(1, DISCOUNTED + 1))
        if not tokens:
            self.scale, self.unknown = 0.0, 1.0
        elif lost > 0:
            self.scale, self.unknown = 1 / tokens, lost / tokens
        else:
            self.scale, self.unknown = 1 / (tokens + 1), 1 / (tokens + 1)

    def of(self, totals: np.ndarray) -> np.ndarray:
        known = discounted(totals.astype(np.float64), self.factors) * self.scale
        return np.where(totals > 0, known, self.unknown)


def backoff(mass: np.ndarray, lower: np.ndarray, totals: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Backoff weight of each context, and the factor on its seen words.

    `mass` is the discounted probability of the seen words, `lower` their lower-order probability. A context whose words
    were all seen too often to be discounted leaves the share of one count.
    """
    full = 1 - mass <= TINY
    scale = np.where(full, totals / (totals + 1), 1.0)
    left = np.where(full, 1 / (totals + 1), 1 - mass)
    return left / np.maximum(1 - lower, TINY), scale


# 1. Blocks ------------------------------------------------------------------------------------------------------------


def _block(number: int, ids: list, held: list[bool], parts: list[np.ndarray]) -> dict:
    lengths = np.array([len(p) for p in parts], dtype=np.int64)
    tokens = np.concatenate(parts)
    words, inverse, counts = np.unique(tokens, return_inverse=True, return_counts=True)
    train = np.repeat(~np.array(held, dtype=bool), lengths)
    # Frequent words get small numbers: the bytes of their numbers then compress well.
    order = np.argsort(-counts, kind="stable")
    place = np.empty(len(order), dtype=np.uint32)
    place[order] = np.arange(len(order), dtype=np.uint32)
    return {
        "block": number,
        "n_tokens": len(tokens),
        "n_train": int(train.sum()),
        "train_docs": len(held) - sum(held),
        "ids": ids,
        "held": held,
        "lengths": pack(lengths),
        "tokens": pack(place[inverse], "<u4"),
        "order": pack(order, "<u4"),
        "words": words.tobytes(),
        "counts": pack(np.bincount(inverse[train], minlength=len(words))),
    }


def _columns(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[f.name] for r in rows], f.type) for f in schema], schema=schema)


BLOCK_SCHEMA = pa.schema(
    [
        ("block", pa.int64()), ("n_tokens", pa.int64()), ("n_train", pa.int64()), ("train_docs", pa.int64()),
        ("ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), ("lengths", pa.binary()), ("tokens", pa.binary()),
        ("order", pa.binary()), ("words", pa.binary()), ("counts", pa.binary()),
    ]
)


def blocks_of(docs: DataFrame, block_tokens: int) -> DataFrame:
    """Packed blocks of documents (id, held, text)."""

    def pack_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        cache = WordHashes()
        end = cache.of([END_WORD])
        ids: list = []
        held: list[bool] = []
        parts: list[np.ndarray] = []
        tokens = 0
        for batch in batches:
            for id_, out, text in zip(
                batch.column("id").to_pylist(), batch.column("held").to_pylist(), by_bytes(batch.column("text")), strict=True
            ):
                part = np.concatenate([cache.of(text.lower().split()), end])
                ids.append(id_)
                held.append(out)
                parts.append(part)
                tokens += len(part)
                if tokens >= block_tokens:
                    yield _columns([_block(number, ids, held, parts)], BLOCK_SCHEMA)
                    number, ids, held, parts, tokens = number + 1, [], [], [], 0
        if ids:
            yield _columns([_block(number, ids, held, parts)], BLOCK_SCHEMA)

    return docs.mapInArrow(pack_blocks, BLOCKS)


# 2. Unigrams ----------------------------------------------------------------------------------------------------------


def _histogram(counts: np.ndarray) -> list[int]:
    """How many of the counts are 1, 2, ... DISCOUNTED + 1."""
    small = counts[(counts > 0) & (counts <= DISCOUNTED + 1)].astype(np.int64)
    return np.bincount(small, minlength=DISCOUNTED + 2)[1:].tolist()


UNIGRAM_SCHEMA = pa.schema(
    [
        ("bucket", pa.int32()), ("block", pa.int64()), ("words", pa.binary()), ("numbers", pa.binary()),
        ("totals", pa.binary()), ("stats", pa.list_(pa.int64())),
    ]
)


def unigram_table(blocks: DataFrame, bits: int) -> DataFrame:
    """Per bucket its words, numbers and totals (block -1, with the statistics), and its answers to the blocks."""
    ask = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("words", pa.binary()), ("counts", pa.binary())])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = np.array([i << (64 - bits) for i in range(1, 1 << bits)], dtype=np.uint64)
        for batch in batches:
            for r in batch.to_pylist():
                words, counts = np.frombuffer(r["words"], "<u8"), unpack(r["counts"])
                cuts = np.searchsorted(words, edges).tolist()
                rows = [
                    {"bucket": b, "block": r["block"], "words": words[i:j].tobytes(), "counts": pack(counts[i:j])}
                    for b, (i, j) in enumerate(zip([0, *cuts], [*cuts, len(words)], strict=True))
                    if i < j
                ]
                yield _columns(rows, ask)

    def answer(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        bucket = rows[0]["bucket"]
        parts = [np.frombuffer(r["words"], "<u8") for r in rows]
        words, inverse = np.unique(np.concatenate(parts), return_inverse=True)
        totals = np.zeros(len(words), dtype=np.int64)
        np.add.at(totals, inverse, np.concatenate([unpack(r["counts"]) for r in rows]).astype(np.int64))
        known = totals > 0
        numbers = np.where(known, FIRST + ((np.cumsum(known) - 1) << bits) + bucket, UNKNOWN)
        stats = [int(known.sum()), *_histogram(totals)]
        out = [
            {
                "bucket": bucket, "block": -1, "words": words[known].tobytes(), "numbers": pack(numbers[known]),
                "totals": pack(totals[known]), "stats": stats,
            }
        ]
        at = 0
        for r, part in zip(rows, parts, strict=True):
            mine = inverse[at : at + len(part)]
            at += len(part)
            out.append(
                {
                    "bucket": bucket, "block": r["block"], "words": None, "numbers": pack(numbers[mine]),
                    "totals": pack(totals[mine]), "stats": None,
                }
            )
        return pa.Table.from_batches([_columns(out, UNIGRAM_SCHEMA)])

    asked = blocks.select("block", "words", "counts").mapInArrow(
        send, "bucket int, block long, words binary, counts binary"
    )
    return asked.groupBy("bucket").applyInArrow(answer, UNIGRAMS)


# 3. Bigrams -----------------------------------------------------------------------------------------------------------


class Pairs:
    """The distinct bigrams of a block, in order of context and word number, and where they go."""

    def __init__(self, block: dict, answers: list[dict], start_total: int, bits: int, hot: int) -> None:
        answers = sorted(answers, key=lambda r: r["bucket"])  # buckets follow the order of the block's dictionary
        numbers = np.concatenate([unpack(r["numbers"]) for r in answers])
        totals = np.concatenate([unpack(r["totals"]) for r in answers])
        tokens = unpack(block["tokens"], "<u4")
        order = unpack(block["order"], "<u4")
        self.lengths = unpack(block["lengths"]).astype(np.int64)
        self.held = np.array(block["held"], dtype=bool)
        self.token_totals = totals[order][tokens].astype(np.int64)
        # Numbers of this block in order, the start first; equal numbers (unknown words) fall together.
        self.numbers, place = np.unique(np.concatenate([[np.uint64(START)], numbers]), return_inverse=True)
        self.totals = np.zeros(len(self.numbers), dtype=np.int64)
        self.totals[place[1:]] = totals.astype(np.int64)
        self.totals[0] = start_total
        word = place[1:][order][tokens].astype(np.uint64)
        context = np.empty_like(word)
        context[1:] = word[:-1]
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        context[self.starts] = 0
        pairs, self.inverse = np.unique((context << np.uint64(32)) | word, return_inverse=True)
        self.context = (pairs >> np.uint64(32)).astype(np.int64)
        self.word = (pairs & np.uint64(0xFFFFFFFF)).astype(np.int64)
        train = np.repeat(~self.held, self.lengths)
        self.counts = np.bincount(self.inverse[train], minlength=len(pairs))
        # Contexts that own many tokens are split by the following word.
        pieces = pieces_of(self.totals, hot)[self.context].astype(np.uint64)
        u, w = self.numbers[self.context], self.numbers[self.word]
        spread = np.where(pieces > 1, (mixed(w) >> np.uint64(33)) % pieces, np.uint64(0))
        self.bucket = ((mixed(u) >> np.uint64(33)) + spread) & np.uint64((1 << bits) - 1)
        self.bucket[self.numbers[self.context] == UNKNOWN] = np.uint64(1 << bits)  # nowhere: nothing follows it

    def by_bucket(self) -> Iterator[tuple[int, np.ndarray]]:
        """Each bucket with the places of its bigrams, in order."""
        order = np.argsort(self.bucket, kind="stable")
        buckets, first = np.unique(self.bucket[order], return_index=True)
        for b, i, j in zip(buckets.tolist(), first.tolist(), [*first[1:].tolist(), len(order)], strict=True):
            yield b, order[i:j]


def pieces_of(totals: np.ndarray, hot: int) -> np.ndarray:
    return 1 + totals // hot


BIGRAM_SCHEMA = pa.schema(
    [
        ("bucket", pa.int32()), ("contexts", pa.binary()), ("context_totals", pa.binary()), ("rows", pa.binary()),
        ("words", pa.binary()), ("counts", pa.binary()), ("word_totals", pa.binary()), ("blocks", pa.list_(pa.int64())),
        ("places", pa.list_(pa.binary())), ("asked", pa.list_(pa.binary())), ("stats", pa.list_(pa.int64())),
    ]
)


def _steps(values: np.ndarray) -> np.ndarray:
    """Differences of ascending numbers."""
    return np.diff(values, prepend=values[:1] * 0)


def bigram_table(blocks: DataFrame, unigrams: DataFrame, start_total: int, bits: int, hot: int) -> DataFrame:
    """One row per bucket: its contexts, its bigrams with totals, and which of them each block asked for."""
    ask = pa.schema(
        [
            ("bucket", pa.int32()), ("block", pa.int64()), ("contexts", pa.binary()), ("context_totals", pa.binary()),
            ("sizes", pa.binary()), ("words", pa.binary()), ("counts", pa.binary()), ("word_totals", pa.binary()),
        ]
    )

    def send(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.Table.from_batches([], schema=ask)
        block = left.to_pylist()[0]
        pairs = Pairs(block, right.to_pylist(), start_total, bits, hot)
        rows = []
        for bucket, at in pairs.by_bucket():
            if bucket >> bits:
                continue
            contexts, sizes = np.unique(pairs.context[at], return_counts=True)
            words = pairs.numbers[pairs.word[at]].astype(np.int64)
            steps = words.copy()
            same = pairs.context[at][1:] == pairs.context[at][:-1]
            steps[1:][same] -= words[:-1][same]
            rows.append(
                {
                    "bucket": bucket, "block": block["block"], "contexts": pack(_steps(pairs.numbers[contexts])),
                    "context_totals": pack(pairs.totals[contexts]), "sizes": pack(sizes), "words": pack(steps),
                    "counts": pack(pairs.counts[at]), "word_totals": pack(pairs.totals[pairs.word[at]]),
                }
            )
        return pa.Table.from_batches([_columns(rows, ask)], schema=ask)

    def total(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["block"])
        asked = [np.cumsum(unpack(r["contexts"])) for r in rows]
        contexts, where = np.unique(np.concatenate(asked), return_inverse=True)
        context_totals = np.zeros(len(contexts), dtype=np.int64)
        context_totals[where] = np.concatenate([unpack(r["context_totals"]) for r in rows]).astype(np.int64)
        context_of, words = [], []
        own = np.split(where, np.cumsum([len(a) for a in asked])[:-1])
        for r, mine in zip(rows, own, strict=True):
            sizes = unpack(r["sizes"]).astype(np.int64)
            context_of.append(np.repeat(mine, sizes))
            steps = unpack(r["words"]).astype(np.int64)
            # Running sums that begin anew at each context.
            run = np.cumsum(steps)
            first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            words.append(run - np.repeat(run[first] - steps[first], sizes))
        lengths = [len(w) for w in words]
        word_numbers, word = np.unique(np.concatenate(words), return_inverse=True)
        keys = (np.concatenate(context_of).astype(np.uint64) << np.uint64(32)) | word.astype(np.uint64)
        pairs, place = np.unique(keys, return_inverse=True)
        counts = np.zeros(len(pairs), dtype=np.int64)
        np.add.at(counts, place, np.concatenate([unpack(r["counts"]) for r in rows]).astype(np.int64))
        word_totals = np.zeros(len(pairs), dtype=np.int64)
        word_totals[place] = np.concatenate([unpack(r["word_totals"]) for r in rows]).astype(np.int64)
        row = {
            "bucket": rows[0]["bucket"],
            "contexts": pack(contexts),
            "context_totals": pack(context_totals),
            "rows": pack(_steps((pairs >> np.uint64(32)).astype(np.int64))),
            "words": pack(word_numbers[(pairs & np.uint64(0xFFFFFFFF)).astype(np.int64)]),
            "counts": pack(counts),
            "word_totals": pack(word_totals),
            "blocks": [r["block"] for r in rows],
            "places": [pack(_steps(p)) for p in np.split(place, np.cumsum(lengths)[:-1])],
            "asked": [pack(_steps(a)) for a in own],
            "stats": _histogram(counts),
        }
        return pa.Table.from_batches([_columns([row], BIGRAM_SCHEMA)])

    left = blocks.select("block", "held", "lengths", "tokens", "order")
    right = unigrams.filter("block >= 0").select("block", "bucket", "numbers", "totals")
    messages = left.groupBy("block").cogroup(right.groupBy("block")).applyInArrow(
        send,
        "bucket int, block long, contexts binary, context_totals binary, sizes binary, words binary, counts binary, "
        "word_totals binary",
    )
    return messages.groupBy("bucket").applyInArrow(total, BIGRAMS)


# 4. Weights and scores ------------------------------------------------------------------------------------------------


def _sums(r: dict, unigrams: Unigrams, factors: np.ndarray) -> tuple[np.ndarray, ...]:
    """A bucket's counts, contexts, totals, and per context the seen mass and its lower-order probability."""
    counts = unpack(r["counts"]).astype(np.int64)
    rows = np.cumsum(unpack(r["rows"]).astype(np.int64))
    contexts, totals = unpack(r["contexts"]), unpack(r["context_totals"]).astype(np.float64)
    seen = counts > 0
    probability = discounted(counts[seen].astype(np.float64), factors) / totals[rows[seen]]
    mass = np.bincount(rows[seen], weights=probability, minlength=len(contexts))
    lower = unigrams.of(unpack(r["word_totals"])[seen].astype(np.int64))
    return counts, contexts, totals, mass, np.bincount(rows[seen], weights=lower, minlength=len(contexts))


def hot_weights(bigrams: DataFrame, unigrams: Unigrams, factors: np.ndarray, hot: int) -> dict[int, tuple[float, float]]:
    """Backoff weight and seen factor of the contexts that are split; at most 2 * SPLITS rows reach the driver."""
    schema = pa.schema([("context", pa.int64()), ("bucket", pa.int32()), ("total", pa.float64()), ("mass", pa.float64()), ("lower", pa.float64())])

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                _, contexts, totals, mass, lower = _sums(r, unigrams, factors)
                at = np.flatnonzero(pieces_of(totals.astype(np.int64), hot) > 1)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(contexts[at].astype(np.int64)), pa.array([r["bucket"]] * len(at), pa.int32()),
                        pa.array(totals[at]), pa.array(mass[at]), pa.array(lower[at]),
                    ],
                    schema=schema,
                )

    columns = ["bucket", "contexts", "context_totals", "rows", "counts", "word_totals"]
    parts = bigrams.select(*columns).mapInArrow(part, "context long, bucket int, total double, mass double, lower double")
    sums: dict[int, list[float]] = {}
    for r in sorted(parts.collect(), key=lambda r: (r["context"], r["bucket"])):
        s = sums.setdefault(r["context"], [r["total"], 0.0, 0.0])
        s[1] += r["mass"]
        s[2] += r["lower"]
    out = {}
    for context, (total, mass, lower) in sums.items():
        weight, scale = backoff(np.array([mass]), np.array([lower]), np.array([total]))
        out[context] = (float(weight[0]), float(scale[0]))
    return out


def answers_of(bigrams: DataFrame, unigrams: Unigrams, factors: np.ndarray) -> DataFrame:
    """To each block the totals of the bigrams it asked for, and weights of the contexts."""
    schema = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("counts", pa.binary()), ("weights", pa.binary()), ("scales", pa.binary())])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                counts, _, totals, mass, lower = _sums(r, unigrams, factors)
                weight, scale = backoff(mass, lower, totals)
                rows = []
                for block, places, asked in zip(r["blocks"], r["places"], r["asked"], strict=True):
                    at = np.cumsum(unpack(asked).astype(np.int64))
                    rows.append(
                        {
                            "block": block, "bucket": r["bucket"],
                            "counts": pack(counts[np.cumsum(unpack(places).astype(np.int64))]),
                            "weights": pack(weight[at].view("<u8")), "scales": pack(scale[at].view("<u8")),
                        }
                    )
                yield _columns(rows, schema)

    return bigrams.mapInArrow(answer, "block long, bucket int, counts binary, weights binary, scales binary")


SCORES = "id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def scored_blocks(
    blocks: DataFrame, unigrams: DataFrame, answers: DataFrame, model: Unigrams, factors: np.ndarray,
    special: dict[int, tuple[float, float]], vocabulary: int, start_total: int, bits: int, hot: int,
) -> DataFrame:
    schema = pa.schema(
        [
            ("id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
            ("base_score", pa.float64()), ("score", pa.float64()),
        ]
    )

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.Table.from_batches([], schema=schema)
        block, rows = left.to_pylist()[0], right.to_pylist()
        pairs = Pairs(block, [r for r in rows if r["counts"] is None], start_total, bits, hot)
        by_bucket = {r["bucket"]: r for r in rows if r["counts"] is not None}
        counts = np.zeros(len(pairs.context), dtype=np.int64)
        weights = np.ones(len(pairs.numbers))
        scales = np.ones(len(pairs.numbers))
        for bucket, at in pairs.by_bucket():
            if bucket in by_bucket:
                r, contexts = by_bucket[bucket], np.unique(pairs.context[at])
                counts[at] = unpack(r["counts"]).astype(np.int64)
                weights[contexts] = unpack(r["weights"]).view("<f8")
                scales[contexts] = unpack(r["scales"]).view("<f8")
        for i in np.flatnonzero(pieces_of(pairs.totals, hot) > 1).tolist():
            # The end of a text is frequent but never a context.
            weights[i], scales[i] = special.get(int(pairs.numbers[i]), (1.0, 1.0))
        total = np.maximum(pairs.totals[pairs.context], 1)
        seen = discounted(counts.astype(np.float64), factors) / total * scales[pairs.context]
        backed = weights[pairs.context] * model.of(pairs.totals[pairs.word])
        logs = np.log10(np.where(counts > 0, seen, backed))
        base = np.log10((pairs.token_totals + 0.5) / (model.tokens + 0.5 * (vocabulary + 1)))
        columns = [
            pa.array(block["ids"], pa.int64()), pa.array(pairs.held), pa.array(pairs.lengths),
            pa.array(np.add.reduceat((pairs.token_totals > 0).astype(np.int64), pairs.starts)),
            pa.array(np.add.reduceat(base, pairs.starts)), pa.array(np.add.reduceat(logs[pairs.inverse], pairs.starts)),
        ]
        return pa.Table.from_arrays(columns, schema=schema)

    none = F.lit(None).cast("binary")
    replies = unigrams.filter("block >= 0").select(
        "block", "bucket", "numbers", "totals", none.alias("counts"), none.alias("weights"), none.alias("scales")
    ).unionByName(
        answers.select("block", "bucket", none.alias("numbers"), none.alias("totals"), "counts", "weights", "scales")
    )
    left = blocks.select("block", "ids", "held", "lengths", "tokens", "order")
    return left.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(score, SCORES)


def katz_scores(
    docs: DataFrame,
    held_out: Column,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    block_tokens: int = BLOCK_TOKENS,
    bucket_tokens: int = BUCKET_TOKENS,
    hot_tokens: int = HOT_TOKENS,
) -> DataFrame:
    """Per document row: id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10 probability).

    Rows where `held_out` is true (null counts as false) don't train. Words are lower-cased (A-Z) and parted by ASCII white
    space; each text ends with one more token. `base_score` is by unigrams with half a count added.
    Null and empty texts are one end token. Ids are whole numbers or null and are only passed on. Repeated rows train
    and are scored each. Without training text every token is the unknown one, with probability one. An empty table
    gives an empty result.
    """
    texts = bounded_batches(docs).select(
        F.col(id_col).cast("long").alias("id"), F.coalesce(held_out, F.lit(False)).alias("held"), F.col(text_col).alias("text")
    )
    blocks = stored(blocks_of(texts, block_tokens), "katz-blocks")
    sums = blocks.agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_tokens", "n_train", "train_docs")]
    ).first()
    bits = max(1, math.ceil(math.log2(max(1, sums["n_tokens"] / bucket_tokens))))
    hot = max(hot_tokens, sums["n_train"] // SPLITS)

    unigrams = stored(unigram_table(blocks, bits), "katz-unigrams")
    stats = unigrams.filter("block = -1").agg(
        *[F.coalesce(F.sum(F.col("stats")[i]), F.lit(0)).alias(f"n{i}") for i in range(DISCOUNTED + 2)]
    ).first()
    model = Unigrams(sums["n_train"], [0, *stats[1:]])

    bigrams = stored(bigram_table(blocks, unigrams, sums["train_docs"], bits, hot), "katz-bigrams")
    pairs = bigrams.agg(
        *[F.coalesce(F.sum(F.col("stats")[i]), F.lit(0)).alias(f"n{i}") for i in range(DISCOUNTED + 1)]
    ).first()
    factors = discounts([0, *pairs])
    special = hot_weights(bigrams, model, factors, hot)
    scores = scored_blocks(
        blocks, unigrams, answers_of(bigrams, model, factors), model, factors, special, stats[0], sums["train_docs"], bits, hot
    )
    return scores.select(
        F.col("id").alias(id_col), "held_out", "n_tokens", "n_known",
        F.lit(sums["n_train"]).cast("long").alias("train_tokens"), "base_score", "score",
    )
