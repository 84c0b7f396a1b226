"""Reach over related links, and taxonomy growth."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from reviewlens.session import shared_folder


@dataclass
class Reach:
    """Edges bucketed by source and reached nodes bucketed by id, alike, so that a level moves neither.

    Both are tables of the session's catalog over folders of their own. What a level shuffles is the targets of its
    frontier's edges, once, to drop repeats; they land in the buckets in which the reached nodes lie already.
    """

    spark: SparkSession
    folder: str
    edges: str
    nodes: str
    buckets: int

    @classmethod
    def start(cls, edges: DataFrame, buckets: int | None = None) -> Reach:
        spark = edges.sparkSession
        # As many buckets as a shuffle has partitions: a shuffled side then fits them as it is.
        buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        name = uuid.uuid4().hex
        reach = cls(spark, shared_folder(spark, "reach"), f"reach_edges_{name}", f"reach_nodes_{name}", buckets)
        links = edges.select("src", "dst").repartition(buckets, "src")
        reach._bucketed(links.write, "src").option("path", f"{reach.folder}/edges").saveAsTable(reach.edges)
        return reach

    def _bucketed(self, writer, column: str):
        return writer.format("parquet").bucketBy(self.buckets, column).sortBy(column)

    def add(self, level: DataFrame, depth: int) -> int:
        """Append a level's nodes, distinct and so dealt by id already; their number comes from the write itself."""
        grown = Observation()
        rows = level.select("id", F.lit(depth).alias("depth"))
        rows = rows.observe(grown, F.count(F.lit(1)).alias("n"))
        writer = self._bucketed(rows.write.mode("append").partitionBy("depth"), "id")
        writer.option("path", f"{self.folder}/nodes").saveAsTable(self.nodes)
        return grown.get["n"]

    def next_level(self, depth: int) -> DataFrame:
        """Distinct targets of the frontier's edges that were not reached before."""
        nodes = self.spark.table(self.nodes)
        frontier = nodes.filter(F.col("depth") == depth).select(F.col("id").alias("src"))
        targets = self.spark.table(self.edges).join(frontier, "src", "left_semi").select(F.col("dst").alias("id")).distinct()
        return targets.join(nodes.select("id"), "id", "left_anti")

    def finish(self) -> DataFrame:
        """The reached nodes; the edges and both names in the catalog go."""
        schema = self.spark.table(self.nodes).schema
        for table in (self.edges, self.nodes):
            self.spark.sql(f"drop table {table}")
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/edges")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        return self.spark.read.schema(schema).parquet(f"{self.folder}/nodes")


def reachable(
    seeds: DataFrame, edges: DataFrame, max_depth: int | None = None, max_total: int | None = None, buckets: int | None = None
) -> DataFrame:
    """(id, depth): every node reached from the seeds once, at its smallest depth.

    Each level is one join of the distinct frontier with the edges, appended to a table in the shared folder. So plans
    stay short, and a lost executor replays one level at most. `max_total` keeps the first nodes by (depth, id).
    """
    reach = Reach.start(edges, buckets)
    level, depth, seen = seeds.select("id").distinct(), 0, 0
    while True:
        grown = reach.add(level, depth)
        seen += grown
        if grown == 0 or depth == max_depth or (max_total is not None and seen >= max_total):
            break
        level = reach.next_level(depth)
        depth += 1
    reached = reach.finish()
    return reached if max_total is None else reached.orderBy("depth", "id").limit(max_total)


def extend_taxonomy(canonical: DataFrame, seen: DataFrame) -> DataFrame:
    """Canonical slugs first, then new slugs in the order they were first seen."""
    fresh = seen.groupBy("slug").agg(F.min("position").alias("position"))
    extra = fresh.join(canonical.select("slug"), "slug", "left_anti")
    return canonical.select("slug", F.lit(False).alias("extra"), "position").unionByName(
        extra.select("slug", F.lit(True).alias("extra"), "position")
    )
