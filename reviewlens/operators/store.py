"""A table kept under its keys, for upserts batch by batch.

Rows lie in buckets by the hash of some key columns. A merge reads and rewrites only the buckets that hold keys of the
delta, into a folder of its own, and then publishes a manifest: one small file per version that names the folder of each
bucket. Readers take the last manifest, so they see whole versions and never fold history; what a failed merge has
written is named by no manifest. `merge` takes any function of old rows and delta, `fold` an aggregate per key, which costs
one shuffle of both. There is one writer at a time; a second one that publishes the same version fails.

Choose `bucket_by` so that a batch falls into few buckets (the items it scraped, say) and `buckets` so that one holds some
hundred megabytes. A bucket is dealt into `pieces`, and adaptive execution splits large ones, so one frequent key value is no single
task.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewlens.session import brief_shuffles

#: The manifest names each bucket, and the driver reads it.
MOST_BUCKETS = 1 << 16
#: Rows hold long keys; this packs them into two thirds of what Spark's default does.
PACKED = {"compression": "zstd"}
#: A fold goes in rounds of buckets, so that its shuffle is a share of the table: an eighth, or this many bytes of files.
ROUND_BYTES = 1 << 30
ROUNDS = 8
#: Pieces that one task of a fold gets, on average: more of them even out their dealing by hash.
PIECES_PER_TASK = 4


@dataclass
class Version:
    """What a manifest says."""

    number: int
    schema: T.StructType
    keys: list[str]
    bucket_by: list[str]
    buckets: int
    folders: dict[str, str] = field(default_factory=dict)
    batches: dict[str, int] = field(default_factory=dict)

    def text(self) -> str:
        return json.dumps(self.__dict__ | {"schema": self.schema.json()})

    @classmethod
    def read(cls, text: str) -> Version:
        said = json.loads(text)
        return cls(**said | {"schema": T.StructType.fromJson(json.loads(said["schema"]))})


class KeyedTable:
    """A handle on one table folder."""

    def __init__(self, spark: SparkSession, folder: str, pieces: int = 8):
        self.spark, self.folder, self.pieces = spark, folder.rstrip("/"), pieces
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(folder).getFileSystem(spark._jsc.hadoopConfiguration())

    # --- files ---

    def _names(self, folder: str) -> list[str]:
        path = self._path(f"{self.folder}/{folder}")
        return [s.getPath().getName() for s in self._fs.listStatus(path)] if self._fs.exists(path) else []

    def _publish(self, version: Version) -> None:
        """Name a version: its file appears whole or not at all."""
        target = self._path(f"{self.folder}/versions/{version.number:010}.json")
        draft = self._path(f"{self.folder}/versions/.{uuid.uuid4().hex}")
        out = self._fs.create(draft, False)
        out.write(bytearray(version.text(), "utf-8"))
        out.close()
        if self._fs.exists(target) or not self._fs.rename(draft, target):
            self._fs.delete(draft, False)
            raise RuntimeError(f"version {version.number} of {self.folder} was published by another writer")

    def _numbers(self) -> list[int]:
        return sorted(int(n[:-5]) for n in self._names("versions") if n.endswith(".json") and not n.startswith("."))

    def version(self, number: int | None = None) -> Version:
        """A version, the last one without a number."""
        number = self._numbers()[-1] if number is None else number
        name = self._path(f"{self.folder}/versions/{number:010}.json")
        stream = self._fs.open(name)
        text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
        return Version.read(text)

    def exists(self) -> bool:
        return bool(self._numbers())

    # --- rows ---

    def create(self, schema: T.StructType, keys: Sequence[str], bucket_by: Sequence[str] | None = None, buckets: int = 64) -> None:
        """An empty table."""
        bucket_by = list(bucket_by or keys)
        if not set(bucket_by) <= set(keys) <= set(schema.names):
            raise ValueError("buckets go by keys, and keys are columns")
        if not 0 < buckets <= MOST_BUCKETS:
            raise ValueError(f"1 to {MOST_BUCKETS} buckets")
        self._publish(Version(0, schema, list(keys), bucket_by, buckets))

    def _rows(self, version: Version, buckets: Sequence[str]) -> DataFrame:
        paths = [f"{self.folder}/{version.folders[b]}" for b in buckets if b in version.folders]
        if not paths:
            return self.spark.createDataFrame([], version.schema)
        return self.spark.read.schema(version.schema).parquet(*paths)

    def read(self, number: int | None = None) -> DataFrame:
        version = self.version(number)
        return self._rows(version, list(version.folders))

    @staticmethod
    def _bucket(version: Version) -> Column:
        return F.pmod(F.xxhash64(*version.bucket_by), F.lit(version.buckets)).cast("int")

    @staticmethod
    def _piece(version: Version, pieces: int) -> Column:
        return F.pmod(F.xxhash64(*version.keys), F.lit(pieces))

    def _size(self, path: str) -> int:
        return self._fs.getContentSummary(self._path(path)).getLength()

    def merge(
        self, delta: DataFrame, how: Callable[[DataFrame, DataFrame], DataFrame], batch: int | None = None, source: str = "",
    ) -> bool:
        """The table after `how(old rows, delta)`, for the buckets of the delta's keys only.

        `how` keeps keys in their buckets: it may change, add and drop rows of the delta's keys and must return all others.
        A batch of a source that the table already holds is skipped, so replays change nothing; the result says whether
        the delta was merged.
        """

        def placed(now: Version, old: DataFrame, delta: DataFrame, size: int) -> DataFrame:
            merged = how(old, delta).select(*now.schema.names)
            rows = merged.withColumns({"_bucket": self._bucket(now), "_piece": self._piece(now, self.pieces)})
            # Pieces that are large are split by their size, so a task's share doesn't grow with the table.
            return rows.hint("rebalance", "_bucket", "_piece").drop("_piece")

        return self._change(delta, placed, lambda sizes: [list(sizes)], batch, source)

    def fold(
        self, delta: DataFrame, how: Callable[[DataFrame, list[str]], DataFrame], batch: int | None = None, source: str = "",
    ) -> bool:
        """As `merge`, by an aggregate of old rows and the delta's, which come in one frame: `how(rows, by)` gives a row per `by`.

        `by` is the keys with what the rows are dealt by, so the aggregate and the write need no shuffle but that of both
        together. `_new` tells rows of the delta (1) from old ones (0).
        """

        def placed(now: Version, old: DataFrame, delta: DataFrame, size: int) -> DataFrame:
            both = old.withColumn("_new", F.lit(0)).unionByName(delta.withColumn("_new", F.lit(1)))
            conf = self.spark.conf
            most = self.spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(
                conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
            )
            # As many tasks as the rows fill, so a task's share doesn't grow with the table.
            tasks = -(-size // most)
            pieces = max(self.pieces, -(-tasks * PIECES_PER_TASK // now.buckets))
            rows = both.withColumns({"_bucket": self._bucket(now), "_piece": self._piece(now, pieces)})
            more = [tasks] if tasks > int(conf.get("spark.sql.shuffle.partitions")) else []
            dealt = rows.repartition(*more, "_bucket", "_piece")
            return how(dealt, ["_bucket", "_piece", *now.keys]).select(*now.schema.names, "_bucket")

        def rounds(sizes: dict[str, int]) -> list[list[str]]:
            most, out, size = max(ROUND_BYTES, sum(sizes.values()) // ROUNDS), [], 0
            for bucket, own in sizes.items():
                if not out or size + own > most:
                    out.append([])
                    size = 0
                out[-1].append(bucket)
                size += own
            return out

        with brief_shuffles(self.spark):
            return self._change(delta, placed, rounds, batch, source)

    def _change(
        self, delta: DataFrame, placed: Callable[..., DataFrame], rounds: Callable[[dict[str, int]], list[list[str]]],
        batch: int | None, source: str,
    ) -> bool:
        """Write the buckets of the delta's keys anew, some in each round, and name the version.

        `placed` gives a round's rows with `_bucket`, `rounds` divides the buckets by the sizes of old files and delta.
        """
        now = self.version()
        if batch is not None and batch <= now.batches.get(source, -1):
            return False
        name = f"{now.number + 1:010}-{uuid.uuid4().hex}"
        staged, rows = f"{self.folder}/staged/{name}", f"rows/{name}"
        # The delta is written once: a stream's batch isn't read twice, and lost tasks don't reach behind it.
        delta.withColumn("_bucket", self._bucket(now)).write.options(**PACKED).parquet(staged)
        delta = self.spark.read.parquet(staged)
        touched = {str(r["_bucket"]): r["count"] for r in delta.groupBy("_bucket").count().collect()}
        new, count = self._size(staged), sum(touched.values())
        sizes = {
            b: new * n // count + (self._size(f"{self.folder}/{now.folders[b]}") if b in now.folders else 0)
            for b, n in touched.items()
        }
        for own in rounds(sizes):
            fresh = delta if len(own) == len(sizes) else delta.filter(F.col("_bucket").isin([int(b) for b in own]))
            after = placed(now, self._rows(now, own), fresh.drop("_bucket"), sum(sizes[b] for b in own))
            after.write.options(**PACKED).mode("append").partitionBy("_bucket").parquet(f"{self.folder}/{rows}")
        filled = {n.split("=")[1] for n in self._names(rows) if n.startswith("_bucket=")}
        folders = {b: f for b, f in now.folders.items() if b not in touched}
        folders |= {b: f"{rows}/_bucket={b}" for b in filled}
        batches = now.batches if batch is None else now.batches | {source: batch}
        self._publish(Version(now.number + 1, now.schema, now.keys, now.bucket_by, now.buckets, folders, batches))
        self._fs.delete(self._path(staged), True)
        return True

    def clean(self, keep: int = 2) -> None:
        """Delete what the last `keep` versions don't name: older versions, replaced buckets, leftovers of failed merges.

        Readers of older versions must be done, and no merge may be running.
        """
        numbers = self._numbers()
        used = {f for n in numbers[-keep:] for f in self.version(n).folders.values()}
        for number in numbers[:-keep]:
            self._fs.delete(self._path(f"{self.folder}/versions/{number:010}.json"), False)
        for name in self._names("rows"):
            for bucket in self._names(f"rows/{name}"):
                if f"rows/{name}/{bucket}" not in used:
                    self._fs.delete(self._path(f"{self.folder}/rows/{name}/{bucket}"), True)
            if not any(b.startswith("_bucket=") for b in self._names(f"rows/{name}")):
                self._fs.delete(self._path(f"{self.folder}/rows/{name}"), True)
        self._fs.delete(self._path(f"{self.folder}/staged"), True)
