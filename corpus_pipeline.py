"""Training text from raw documents: five stages, each one operator of reviewlens.llm, written and reread between.

Quality rules, near-duplicates, benchmark decontamination, mixing of sources, and sharding. Each stage works on all rows
its predecessor kept and returns the columns of `documents`; the last one adds size, shard and slot.
Nulls, empty texts, empty tables and repeated rows go as the operators' docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlens.llm.common import stored, table
from reviewlens.llm.decontaminate import decontaminate
from reviewlens.llm.mixture import mix, word_count
from reviewlens.llm.near_dup import near_duplicates
from reviewlens.llm.quality import quality_rules
from reviewlens.llm.queries import label_weights
from reviewlens.llm.shards import shard


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules(docs).filter("kept").select(*docs.columns)


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, 0.8); one row per document id.

    Rows without id stay.
    """
    kept = near_duplicates(docs).filter("kept and doc_id is not null").select("doc_id").distinct()
    rows = docs.join(kept, "doc_id", "left_semi")
    # Of several rows with one id the one with the least hash stays, in every run.
    chosen = rows.groupBy("doc_id").agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*docs.columns)).alias("row"))
    return chosen.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns]).unionByName(docs.filter("doc_id is null"))


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window with a benchmark item."""
    found = decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return found.filter(~F.col("contaminated")).select(*docs.columns)


def mixture_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it. Documents without id are taken by their source's whole epochs."""
    # Sizes come first, so that the join with the labels doesn't move texts.
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))
    weighted = sized.join(label_weights(table(spark, sf_dir, "labels")), "doc_id", "left")
    mixed = mix(weighted, size=F.col("size"), quality=F.col("weight"))
    # Rows without id can't be told apart here.
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    copies = mixed.groupBy(F.col("doc_id").alias("__taken"), F.col("source").alias("__from")).agg(
        F.max(F.when(F.col("doc_id").isNull(), epochs).otherwise(F.col("copies"))).alias("__copies")
    )
    joined = docs.join(
        copies.filter("__copies > 0"),
        F.col("doc_id").eqNullSafe(F.col("__taken")) & F.col("source").eqNullSafe(F.col("__from")),
    )
    repeated = joined.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies"))))
    return repeated.select(*docs.columns)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with size, shard and slot."""
    return shard(docs)


STAGES = [
    ("quality_rules", quality_stage),
    ("near_dedup", near_dup_stage),
    ("decontaminate", decontaminate_stage),
    ("mixture", mixture_stage),
    ("sharding", sharding_stage),
]

#: MinHash groups and the minimax walk over shards are iterations that SQL doesn't express on whole tables; the rows are
#: tested against a brute-force version of all five stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written to the shared folder and reread."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
