"""The registered query of each operator, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlens.llm import checks
from reviewlens.llm.common import table
from reviewlens.llm.decontaminate import decontaminate
from reviewlens.llm.filter_audit import filter_audit
from reviewlens.llm.katz import katz_scores
from reviewlens.llm.language_id import identify
from reviewlens.llm.main_text import main_text
from reviewlens.llm.mixture import mix, word_count
from reviewlens.llm.near_dup import near_duplicates
from reviewlens.llm.pii import KINDS as PII_KINDS
from reviewlens.llm.pii import find_pii
from reviewlens.llm.quality import quality_rules
from reviewlens.llm.secret_scan import KINDS as SECRET_KINDS
from reviewlens.llm.secret_scan import scan_secrets
from reviewlens.llm.shards import shard
from reviewlens.llm.url_filter import filter_urls
from reviewlens.llm.whitening import whiten

#: Rules of the URL query (host, path).
URL_RULES = {"org/": "allow", "example.org/es/": "block", "example.org/en/1": "block", "com/fr/": "allow", "com/de/": "block"}
#: Host words whose URLs are examples of rejected ones.
REJECTED_WORDS = ("casino", "pills", "adult", "spam")


def _joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _of_kind(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    judged = filter_urls(pages, URL_RULES, rejected_words=REJECTED_WORDS, background=True)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = [k.name for k in PII_KINDS if k.base]
    of_base = F.filter("pii", lambda s: s["kind"].isin(*base))
    return found.select(
        "doc_id", *[_of_kind("pii", k) for k in base],
        F.sha2(_joined(of_base), 256).alias("base_sha256"), _joined(F.col("pii")).alias("spans"),
    )


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated",
    )


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = SECRET_KINDS[:3]
    of_base = F.filter("secrets", lambda s: s["kind"].isin(*base))
    return found.select(
        "doc_id", *[_of_kind("secrets", k) for k in base],
        F.sha2(_joined(of_base), 256).alias("base_sha256"), _joined(F.col("secrets")).alias("spans"),
    )


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), words=2)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return quality_rules(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def label_weights(labels: DataFrame) -> DataFrame:
    """Sampling weight of labelled documents: good ones twice, poor ones half as likely as others to come early."""
    return labels.groupBy("doc_id").agg(F.max("quality").alias("q")).filter("doc_id is not null").select(
        "doc_id", F.when(F.col("q") > 0, 2.0).when(F.col("q") == 0, 0.5).otherwise(1.0).alias("weight")
    )


def op7_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Sizes come first, so that the join with the labels doesn't move texts.
    sized = table(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("size"))
    weighted = sized.join(label_weights(table(spark, sf_dir, "labels")), "doc_id", "left")
    mixed = mix(weighted, size=F.col("size"), quality=F.col("weight"))
    return mixed.select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken")
    )


def op8_katz_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5
    return katz_scores(docs, fold == 1)


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "text", F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32")
    )
    return shard(docs).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return filter_audit(docs, table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic"))


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", (fold == 1).alias("held_out"))
    return identify(docs, ~F.col("held_out"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    fn.__name__: fn
    for fn in (
        op1_url_filter, op2_pii, op3_decontaminate, op4_secret_scan, op5_near_dedup, op6_quality_rules, op7_mixture,
        op8_katz_lm, op9_sharding, op10_main_text, op11_filter_audit, op12_language_id, op13_whitening,
    )
}
CHECKS: dict[str, str] = checks.CHECKS | {"op1_url_filter": checks.url_filter_sql(URL_RULES, REJECTED_WORDS)}
