"""What several operators of this package share: stored tables, byte words, and hashes of words."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlens.session import shared_folder

#: A word is a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
CACHE_WORDS = 1 << 17
BATCH_ROWS = 1000
BATCH_BYTES = 8 << 20
SLICE = 256


def stored(df: DataFrame, name: str) -> DataFrame:
    """The frame written once to the shared checkpoint folder and read back, so that its lineage ends there."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded_batches(df: DataFrame) -> DataFrame:
    """The frame, in a session whose Arrow batches are small: texts can be long, and a batch is held several times."""
    conf = df.sparkSession.conf
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        name = f"spark.sql.execution.arrow.{key}"
        now = int(conf.get(name).rstrip("b"))
        if not 0 < now <= most:
            conf.set(name, most)
    return df


def by_bytes(column: pa.Array) -> Iterator[bytes]:
    """Texts of an Arrow column as UTF-8 bytes, null as empty; few of them are Python objects at a time."""
    kind = pa.binary() if column.type == pa.string() else pa.large_binary()
    for start in range(0, len(column), SLICE):
        for text in column.slice(start, SLICE).cast(kind).to_pylist():
            yield text or b""


class WordHashes(dict):
    """64-bit hash of a word, remembered while it recurs; the memory is bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def runs_of(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash for each run of k consecutive words; empty when there are fewer."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        out = mixed(out + hashes[j : j + n])
    return out


def emit(batches: Iterable[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Record batches from dicts of columns."""
    for columns in batches:
        yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)


def table(spark, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def md5_part(column, start: int, digits: int):
    """Some hex digits of the md5 of a string column, as a whole number."""
    return F.conv(F.substring(F.md5(column), start, digits), 16, 10).cast("long")
