"""Language by hyperdimensional profiles: letters are random vectors, texts and languages are bundles of their n-grams.

A letter's vector holds +1 and -1, drawn from a hash of its code point. An n-gram binds its letters: the vector of the
i-th last letter is rotated i places, and the rotated vectors are multiplied. A text's vector bundles (adds) those of
all its n-grams, a language's prototype those of all training texts of the language. The predicted language is that of
the prototype with the largest cosine; equal cosines go to the first in code-point order.

Letters are lower-cased characters with `str.isalpha`; a run of others counts as one blank, which has a vector too, and
a text begins and ends with a blank. Bundles are sums of whole numbers, so order and partitions don't matter.

Results for odd input: a text that is null or has no letter is `und` with score 0, as is every text if nothing could be
learned; a cosine below 0 scores 0. Rows without language teach nothing, rows of any language are judged. Texts of any
length are read whole, in slices. Extra columns are ignored, repeated rows are judged each; an empty table gives no rows.

Both passes read texts in tasks and shuffle one bundle per task and language; the driver gets one per language, and no
more than LANGUAGES of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlens.llm.common import bounded_batches, by_bytes

DIMENSIONS = 1024
GRAM = 3
#: More languages than this are an error: their prototypes travel to every task.
LANGUAGES = 4096
UNKNOWN = "und"
#: Code points and texts that are bundled at a time, and n-grams whose vectors are held at a time.
POINTS = 1 << 19
TEXTS = 256
GRAMS = 1 << 12
#: Up to this many possible values are ranked by direct addressing, more by sorting.
DIRECT = 1 << 22


def ranked(values: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values below a limit, in order, and the rank of each value among them."""
    if limit > DIRECT:
        return np.unique(values, return_inverse=True)
    distinct = np.flatnonzero(np.bincount(values, minlength=limit))
    place = np.zeros(limit, dtype=np.int64)
    place[distinct] = np.arange(len(distinct))
    return distinct, place[values]


class Letters:
    """Symbols and vectors of letters, and the bundles of texts."""

    def __init__(self, dimensions: int, gram: int):
        self.dimensions, self.gram = dimensions, gram
        self.known = np.full(0x110000, -1, dtype=np.int32)

    def folded(self, points: np.ndarray) -> np.ndarray:
        """The lower-case letters of code points, 0 for what is no letter; each point is looked up once."""
        out = self.known[points]
        if out.min(initial=0) < 0:
            for point in np.unique(points[out < 0]):
                char = chr(point)
                low = char.lower()
                self.known[point] = 0 if not char.isalpha() else ord(low) if len(low) == 1 and low.isalpha() else point
            out = self.known[points]
        return out

    def vector(self, point: int) -> np.ndarray:
        bits = hashlib.shake_128(point.to_bytes(4, "big")).digest(self.dimensions // 8)
        return 1 - 2 * np.unpackbits(np.frombuffer(bits, dtype=np.uint8)).astype(np.int8)

    def points(self, text: bytes) -> Iterator[np.ndarray]:
        """Slices of a text's letters and blanks; each begins with the last gram - 1 symbols of the one before."""
        tail = np.zeros(1, dtype=np.int32)
        for start in range(0, len(text), POINTS):
            stop = min(start + POINTS, len(text))
            # A slice may cut a character: it begins after the bytes that continue one and ends with its last one whole.
            while start and start < len(text) and text[start] & 0xC0 == 0x80:
                start += 1
            while stop < len(text) and text[stop] & 0xC0 == 0x80:
                stop += 1
            symbols = self.folded(np.frombuffer(text[start:stop].decode("utf-8", "replace").encode("utf-32-le"), dtype=np.uint32))
            symbols = np.concatenate([tail, symbols])
            blank = symbols == 0
            blank[1:] &= symbols[:-1] == 0
            blank[0] = False
            symbols = symbols[~blank]
            if stop == len(text) and symbols[-1]:
                symbols = np.append(symbols, np.int32(0))
            if len(symbols) >= self.gram:
                yield symbols
                tail = symbols[1 - self.gram :]
            else:
                tail = symbols

    def bundles(self, texts: list[np.ndarray], owners: list[int], n: int) -> np.ndarray:
        """The bundle of each of n owners, from the symbol runs that belong to them."""
        out = np.zeros((n, self.dimensions), dtype=np.float64)
        if not texts:
            return out
        symbols = np.concatenate(texts)
        owner = np.repeat(np.array(owners), [len(t) for t in texts])
        run = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
        alphabet, coded = ranked(symbols, int(symbols.max()) + 1)
        m, size, last = len(alphabet), self.gram, len(symbols) - self.gram + 1
        whole = run[:last] == run[size - 1 :]
        grams = np.zeros(last, dtype=np.int64)
        for i in range(size):
            grams = grams * m + coded[i : i + last]
        grams, owner = grams[whole], owner[:last][whole]
        distinct, which = ranked(grams, m**size)
        vectors = np.stack([self.vector(int(point)) for point in alphabet])
        rotated = [np.roll(vectors, size - 1 - i, axis=1) for i in range(size)]
        for start in range(0, len(distinct), GRAMS):
            some = distinct[start : start + GRAMS]
            own = (which >= start) & (which < start + GRAMS) if len(distinct) > GRAMS else slice(None)
            counts = np.bincount(owner[own] * len(some) + which[own] - start, minlength=n * len(some))
            bound = rotated[size - 1][some % m]
            rest = some // m
            for i in range(size - 2, -1, -1):
                bound = bound * rotated[i][rest % m]
                rest = rest // m
            # Counts per slice of points are whole and far below 2^24, so the float32 product is exact.
            out += counts.reshape(n, len(some)).astype(np.float32) @ bound.astype(np.float32)
        return out


def bundled(texts: Iterable[bytes], table: Letters) -> Iterator[np.ndarray]:
    """The bundles of some texts at a time, in order; a text without letters is all zeros."""
    runs: list[np.ndarray] = []
    owners: list[int] = []
    n = points = 0
    carried = np.zeros(table.dimensions)
    for text in texts:
        for symbols in table.points(text):
            runs.append(symbols)
            owners.append(n)
            points += len(symbols)
            if points >= POINTS:
                # The text may go on: what is bundled of it so far is carried.
                part = table.bundles(runs, owners, n + 1)
                part[0] += carried
                carried = part[-1]
                if n:
                    yield part[:-1]
                runs, owners, n, points = [], [], 0, 0
        n += 1
        if n >= TEXTS:
            part = table.bundles(runs, owners, n)
            part[0] += carried
            yield part
            runs, owners, n, points, carried = [], [], 0, 0, np.zeros(table.dimensions)
    if n:
        part = table.bundles(runs, owners, n)
        part[0] += carried
        yield part


def prototypes(docs: DataFrame, lang: str, dimensions: int, gram: int, most: int) -> tuple[list[str], np.ndarray]:
    """The languages of docs(text, lang) in code-point order, and the bundle of all texts of each."""
    schema = pa.schema([("lang", pa.string()), ("sums", pa.binary())])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Letters(dimensions, gram)
        seen: dict[str, int] = {}
        sums = np.zeros((0, dimensions))
        runs: list[np.ndarray] = []
        owners: list[int] = []
        points = 0

        def added() -> np.ndarray:
            part = table.bundles(runs, owners, len(seen))
            part[: len(sums)] += sums
            return part

        for batch in batches:
            for name, text in zip(batch.column(1).to_pylist(), by_bytes(batch.column(0))):
                for symbols in table.points(text):
                    runs.append(symbols)
                    owners.append(seen.setdefault(name, len(seen)))
                    points += len(symbols)
                    if points >= POINTS:
                        sums, runs, owners, points = added(), [], [], 0
                if len(seen) > most:
                    raise ValueError(f"more than {most} languages")
        packed = [vector.astype(np.int64).tobytes() for vector in added()]
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(packed, pa.binary())], schema=schema)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for name, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sums[name] = sums.get(name, 0) + np.frombuffer(packed, dtype=np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.string()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], schema=schema
        )

    kinds = "lang string, sums binary"
    taught = docs.filter(F.col(lang).isNotNull()).select("text", F.col(lang).cast("string").alias("lang"))
    partial = bounded_batches(taught).mapInArrow(learn, kinds)
    rows = partial.repartition("lang").mapInArrow(add, kinds).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} languages")
    found = {r["lang"]: np.frombuffer(r["sums"], dtype=np.int64) for r in rows}
    names = sorted(name for name, vector in found.items() if vector.any())
    return names, np.array([found[name] for name in names], dtype=np.float64).reshape(len(names), dimensions)


def unit(vectors: np.ndarray) -> np.ndarray:
    lengths = np.linalg.norm(vectors, axis=1, keepdims=True)
    return np.divide(vectors, lengths, out=np.zeros_like(vectors), where=lengths > 0)


def predict(vectors: np.ndarray, profiles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest profile and its cosine."""
    cosines = unit(vectors) @ unit(profiles).T
    best = np.argmax(cosines, axis=1)
    return best, np.clip(cosines[np.arange(len(best)), best], 0.0, 1.0)


def identify(
    docs: DataFrame, learn_from: Column, text: str = "text", lang: str = "lang", dimensions: int = DIMENSIONS,
    gram: int = GRAM, most_languages: int = LANGUAGES,
) -> DataFrame:
    """The columns of docs but text and lang, with lang_pred and score, learned from the rows that learn_from marks.

    Columns of docs named lang_pred or score are replaced.
    """
    if dimensions % 8 or gram < 2:
        raise ValueError("dimensions come in eights, and an n-gram has two letters at least")
    kept = [c for c in docs.columns if c not in (text, lang, "lang_pred", "score")]
    taught = docs.filter(learn_from).select(F.col(text).alias("text"), F.col(lang).alias("lang"))
    names, profiles = prototypes(taught, "lang", dimensions, gram, most_languages)
    source = docs.select(F.col(text).alias("__text"), *kept)
    fields = [f for f in source.schema.fields if f.name != "__text"]
    kinds = source.select(*kept, F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Letters(dimensions, gram)
        for batch in batches:
            found: list[str] = []
            scores: list[np.ndarray] = []
            for part in bundled(by_bytes(batch.column(0)), table):
                if names:
                    best, score = predict(part, profiles)
                else:
                    best, score = np.zeros(len(part), dtype=int), np.zeros(len(part))
                has = part.any(axis=1) if names else np.zeros(len(part), dtype=bool)
                found += [names[b] if h else UNKNOWN for b, h in zip(best, has)]
                scores.append(np.where(has, score, 0.0))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.array(found, pa.string()), pa.array(np.concatenate(scores) if scores else [], pa.float64())],
                names=[*[f.name for f in fields], "lang_pred", "score"],
            )

    return bounded_batches(source).mapInArrow(judge, kinds)
