"""Near-duplicate documents by MinHash.

Every document's distinct word shingles are hashed; many universal hash functions give their minima, which are cut
into bands. Documents with equal shingle sets are first put into one class. Classes that share a band are candidates,
and candidates are confirmed on full sets; confirmed links are joined into components by alternating large-star and
small-star steps.

Nothing emits all pairs of a band. Each member of a band is compared with the band's first member; that links groups of
copies of any size with as many pairs as members. Where a band then still holds several components, its members
are compared by their rarest shingles: two sets of the given similarity must share one of their few rarest
shingles, so only members that share such a one, and aren't linked yet, are compared. At the limit similarity of 0.8
and 54 bands of 6 minima a pair shares no band with a chance of about 8e-8; every pair that shares one is settled exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reviewlens.llm.common import WordHashes, bounded_batches, by_bytes, mixed, runs_of, stored

WORDS = 5
PERCENT = 80
BANDS = 54
ROWS = 6
SEED = 20240
#: Ids that are broadcast at most, after counting them; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000

_CHUNK = 2048


def shingles(text: bytes, k: int, cache: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the text's k-word shingles; fewer words are one shingle, none are none."""
    words = text.lower().split()
    hashes = cache.of(words)
    if not words:
        return hashes
    if len(words) < k:
        return runs_of(hashes, len(words)) ^ np.uint64(len(words))
    return np.unique(runs_of(hashes, k))


class Bands:
    """MinHash minima of a set, folded into one 64-bit key per band."""

    def __init__(self, bands: int = BANDS, rows: int = ROWS, seed: int = SEED) -> None:
        draw = np.random.Generator(np.random.PCG64(seed))
        self._a = draw.integers(0, 1 << 32, bands * rows, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
        self._b = draw.integers(0, 1 << 32, bands * rows, dtype=np.uint64).astype(np.uint32)
        self._bands, self._rows = bands, rows

    def of(self, found: np.ndarray) -> np.ndarray:
        x = (found >> np.uint64(32)).astype(np.uint32)
        least = np.full(len(self._a), 0xFFFFFFFF, dtype=np.uint32)
        for i in range(0, len(x), _CHUNK):
            part = x[i : i + _CHUNK, None] * self._a[None, :]
            part += self._b[None, :]
            np.minimum(least, part.min(axis=0), out=least)
        minima = least.astype(np.uint64).reshape(self._bands, self._rows)
        key = mixed(np.arange(self._bands, dtype=np.uint64))
        for j in range(self._rows):
            key = mixed(key * np.uint64(0x100000001B3) + minima[:, j])
        return key.view(np.int64)


def _features(docs: DataFrame, id_col: str, text_col: str, k: int, bands: int, rows: int) -> DataFrame:
    fields = [pa.field("n", pa.int64()), pa.field("digest", pa.binary()), pa.field("bands", pa.list_(pa.int64()))]

    @F.arrow_udf(returnType="n long, digest binary, bands array<long>")
    def measured(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        cache, banded = WordHashes(), Bands(bands, rows)
        for part in parts:
            n, digests, keys = [], [], []
            for text in by_bytes(part):
                found = shingles(text, k, cache)
                n.append(len(found))
                digests.append(xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None)
                keys.append(banded.of(found) if len(found) else None)
            yield pa.StructArray.from_arrays(
                [pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], fields=fields
            )

    out = bounded_batches(docs).select(F.col(id_col).cast("long").alias("id"), measured(F.col(text_col)).alias("m"))
    return out.select("id", "m.n", "m.digest", "m.bands")


def _similar(k: int, percent: int):
    """A column function: whether two texts are similar enough, on their full shingle sets."""

    @F.arrow_udf(returnType="boolean")
    def similar(parts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        cache = WordHashes()
        text, known = None, None
        for left, right in parts:
            out = []
            for a, b in zip(by_bytes(left), by_bytes(right), strict=True):
                if b != text:  # neighbours often share the band's first member
                    text, known = b, shingles(b, k, cache)
                mine = shingles(a, k, cache)
                both = len(np.intersect1d(mine, known, assume_unique=True))
                out.append(100 * both >= percent * (len(mine) + len(known) - both))
            yield pa.array(out, pa.bool_())

    return similar


def _confirmed(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Those of the pairs (a, b) whose texts are similar enough."""
    similar = _similar(k, percent)
    left = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
    both = left.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
    return both.select("a", "b", similar("text_a", "text_b").alias("linked")).filter("linked").select("a", "b")


def connected(links: DataFrame) -> DataFrame:
    """Component (least node) of every node of the links (a, b), by alternating large-star and small-star.

    Each step is written to the shared checkpoint folder. Nodes with many links are met by joins, never as lists.
    """

    def state(edges: DataFrame):
        return edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()

    edges = stored(
        links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "star"
    )
    last = None
    while (now := state(edges)) != last:
        last = now
        # Large star: every neighbour above a node moves to the least of its neighbourhood.
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = stored(large.filter("a <> b").distinct(), "star")
        # Small star: a node and its neighbours below move to the least of those.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.unionByName(least.select("a", F.col("m").alias("b")))
        edges = stored(small.filter("a <> b").distinct(), "star")
    return edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))


def _by_rare_shingles(members: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs of members (id, component, n) of different components that share one of their rarest shingles.

    Each member's shingles are ordered by how many members have them. The first one that two members share bounds their
    intersection by what either has left from there on, so a pair is only kept where that can still be enough. Members
    whose own changes are too many drop out here, against groups of copies of any size.
    """

    @F.arrow_udf(returnType="array<long>")
    def hashed(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        cache = WordHashes()
        for part in parts:
            yield pa.array([shingles(t, k, cache).view(np.int64) for t in by_bytes(part)], pa.list_(pa.int64()))

    tokens = members.join(texts, "id").select("id", "component", "n", F.explode(hashed("text")).alias("token"))
    tokens = stored(tokens, "near-tokens")
    counts = tokens.groupBy("token").agg(F.count("*").alias("df"))
    order = Window.partitionBy("id").orderBy("df", "token")
    least = F.ceil(F.col("n") * percent / 100)
    rare = (
        tokens.join(counts.filter("df > 1"), "token", "left")
        .withColumn("df", F.coalesce("df", F.lit(1)))
        .withColumn("place", F.row_number().over(order))
        .filter(F.col("place") <= F.col("n") - least + 1)
        .filter("df > 1")
        .select("id", "component", "n", (F.col("n") - F.col("place") + 1).alias("rest"), "token")
    )
    rare = stored(rare, "near-rare")
    split = rare.groupBy("token").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x <> y")
    rare = rare.join(split.select("token"), "token", "left_semi")
    a, b = (
        rare.select("token", *[F.col(c).alias(f"{c}_{end}") for c in ("id", "component", "n", "rest")]) for end in "ab"
    )
    a, b = a.withColumnRenamed("id_a", "a"), b.withColumnRenamed("id_b", "b")
    enough = (100 + percent) * F.least("rest_a", "rest_b") >= percent * (F.col("n_a") + F.col("n_b"))
    fits = (F.col("component_a") < F.col("component_b")) & enough
    return a.join(b, "token").filter(fits).select("a", "b").distinct()


def near_duplicates(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = WORDS,
    percent: int = PERCENT,
    bands: int = BANDS,
    rows: int = ROWS,
) -> DataFrame:
    """Per document row: its id (as `id_col`), n_shingles, component_id (least id of its component) and kept.

    Words are lower-cased (A-Z) and parted by ASCII white space. Two documents are linked when 100 * intersection >=
    `percent` * union of their shingle sets. Documents without words, null or empty, are linked with nothing.
    Ids are whole numbers and name a document; rows with one id are expected to be repeats of it. A row without id has
    no component (null) and is kept. An empty table gives an empty result.
    """
    features = stored(_features(docs, id_col, text_col, words, bands, rows), "near-features")
    # One class per shingle set; its least id stands for it. All rows of a class have the same bands.
    classes = stored(
        features.filter("digest is not null and id is not null")
        .groupBy("digest")
        .agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("bands").alias("bands")),
        "near-classes",
    )
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).filter("text is not null")

    def texts_of(ids: DataFrame) -> DataFrame:
        """Texts of some representatives, one row each; few ids are sent to the texts instead of moving all texts."""
        ids = stored(ids.distinct(), "near-ids")
        if ids.count() <= BROADCAST_IDS:
            ids = F.broadcast(ids)
        return stored(texts.join(ids, "id", "left_semi").dropDuplicates(["id"]), "near-texts")

    def ends(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id")))

    band = classes.select("rep", "n", F.explode("bands").alias("band"))
    firsts = band.groupBy("band").agg(F.min("rep").alias("first"), F.count("*").alias("members")).filter("members > 1")
    # Most bands have one member; only the others are looked at again.
    shared = stored(band.join(firsts, "band"), "near-bands")
    pairs = stored(
        shared.filter("rep <> first").select(F.col("rep").alias("a"), F.col("first").alias("b")).distinct(), "near-pairs"
    )
    links = stored(_confirmed(pairs, texts_of(ends(pairs)), words, percent), "near-links")
    component = stored(connected(links), "near-components")

    # Bands of three and more whose members aren't all linked hold pairs that weren't compared.
    banded = shared.filter("members > 2").join(component, F.col("rep") == F.col("node"), "left").select(
        "rep", "n", F.coalesce("component", "rep").alias("component"), "band"
    )
    open_bands = banded.groupBy("band").agg(
        F.min("component").alias("x"), F.max("component").alias("y")
    ).filter("x <> y")
    members = stored(
        banded.join(open_bands.select("band"), "band", "left_semi")
        .select(F.col("rep").alias("id"), "component", "n")
        .distinct(),
        "near-members",
    )
    if not members.isEmpty():
        more = _by_rare_shingles(members, texts_of(members.select("id")), words, percent)
        more = more.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        more = stored(more.join(pairs, ["a", "b"], "left_anti"), "near-pairs")
        found = _confirmed(more, texts_of(ends(more)), words, percent)
        component = stored(connected(links.unionByName(found)), "near-components")

    labels = classes.join(component, F.col("rep") == F.col("node"), "left").select(
        "digest", F.coalesce("component", "rep").alias("component_id")
    )
    out = features.select("id", "n", "digest").join(labels, "digest", "left")
    component_id = F.when(F.col("digest").isNull(), F.col("id")).otherwise(F.col("component_id"))
    component_id = F.when(F.col("id").isNotNull(), component_id)
    return out.select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        component_id.alias("component_id"),
        component_id.eqNullSafe(F.col("id")).alias("kept"),
    )
