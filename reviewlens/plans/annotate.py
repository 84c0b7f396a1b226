"""Running an injected annotator over every item, and storing what it returns."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain, groupby

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from reviewlens import schemas as S
from reviewlens.functions.parsing import squash
from reviewlens.operators.reviews import demand_kind, latest_per_item, review_digest

#: Rows that are Python objects at a time, and results per batch.
SLICE_ROWS = 256
FLUSH_ROWS = 1000
NOTES = S.columns("n_lines int, n_demand int, first_quote string")


def phrase_notes(items: DataFrame, reviews: DataFrame, max_reviews: int | None = None) -> DataFrame:
    """Per item the review lines, those with a demand phrase and the first such quote, all by column expressions."""
    recent = reviews if max_reviews is None else latest_per_item(reviews, max_reviews)
    wants = demand_kind("body").isNotNull()
    # The order of the digest: helpful flag, helpful count and date descending, then the id.
    order = F.struct(
        ~F.coalesce(F.col("helpful_ranked"), F.lit(False)), -F.coalesce(F.col("helpful_count"), F.lit(0)),
        F.col("reviewed_at").isNull(), -F.unix_date("reviewed_at"), F.col("review_uid"),
    )
    notes = recent.groupBy("item_id").agg(
        F.count("*").cast("int").alias("n_lines"),
        F.count_if(F.coalesce(wants, F.lit(False))).cast("int").alias("n_demand"),
        F.min_by(squash("body"), F.when(wants, order)).alias("first_quote"),
    )
    return notes.join(items.select(F.col("id").alias("item_id")), "item_id", "left_semi")


def annotate_items(
    items: DataFrame,
    reviews: DataFrame,
    annotator: Callable[[str], dict] | None = None,
    record: T.StructType = NOTES,
    max_reviews: int | None = None,
) -> DataFrame:
    """(item_id, status, error, *record): one call per item digest; a failed call is an error row.

    Without an annotator the notes are demand phrases, which need no Python.
    """
    if annotator is None:
        return phrase_notes(items, reviews, max_reviews).select(
            "item_id", F.lit("done").alias("status"), F.lit(None).cast("string").alias("error"), *NOTES.fieldNames()
        )
    fields = [f.name for f in record]
    schema = S.columns("item_id long, status string, error string")
    for f in record:
        schema = schema.add(f.name, f.dataType)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for item_id, digest in zip(batch["item_id"], batch["digest"]):
                try:
                    notes = annotator(digest)
                    out.append((item_id, "done", None, *[notes.get(f) for f in fields]))
                except Exception as exc:  # one bad item must not end the run
                    out.append((item_id, "error", str(exc), *[None] * len(fields)))
            yield pd.DataFrame(out, columns=["item_id", "status", "error", *fields], dtype=object)

    digests = review_digest(items, reviews, max_reviews).select("item_id", "digest")
    return digests.mapInPandas(run, schema)


def annotate_reviews(
    items: DataFrame,
    reviews: DataFrame,
    annotator: Callable[[dict, Iterator[dict]], dict],
    record: T.StructType,
    gate: Column | None = None,
    max_reviews: int | None = None,
    partitions: int | None = None,
) -> DataFrame:
    """(item_id, status, error, *record): one call per item with its columns and an iterator over its reviews.

    The record may nest structs and arrays, as a cluster list or a price profile does. `gate` is asked before the call:
    items it doesn't let through, and items without reviews, are `skipped` rows. A call that fails, or returns what the
    record can't hold, is an error row; others go on.

    Items and reviews are dealt by item and sorted, so a task streams one item after the other, in the order of the digest,
    and an item of any size is never held whole.
    """
    recent = reviews if max_reviews is None else latest_per_item(reviews, max_reviews).drop("rank")
    about, said = F.struct(*items.columns), F.struct(*recent.columns)
    heads = items.select(
        F.col("id").alias("item_id"), F.lit(0).alias("kind"), F.coalesce(gate if gate is not None else F.lit(True), F.lit(False)).alias("open"),
        about.alias("item"), F.lit(None).cast(recent.select(said.alias("r")).schema["r"].dataType).alias("review"),
    )
    lines = recent.filter("item_id is not null").select(
        "item_id", F.lit(1).alias("kind"), F.lit(False).alias("open"), F.lit(None).cast(heads.schema["item"].dataType).alias("item"),
        said.alias("review"),
    )
    order = [
        F.asc("item_id"), F.asc("kind"), F.desc(F.coalesce(F.col("review.helpful_ranked"), F.lit(False))),
        F.desc(F.coalesce(F.col("review.helpful_count"), F.lit(0))), F.desc_nulls_last("review.reviewed_at"),
        F.asc_nulls_last("review.review_uid"),
    ]
    both = heads.unionByName(lines)
    dealt = both.repartition(partitions, "item_id") if partitions else both.repartition("item_id")
    sorted_rows = dealt.sortWithinPartitions(*order)
    head = T.StructType([heads.schema["item_id"], *S.columns("status string, error string").fields])
    out_schema = T.StructType([*head.fields, *record.fields])
    arrow_fields = [(f.name, to_arrow_type(f.dataType)) for f in out_schema.fields]
    n_head = len(head.fields)
    slice_rows, flush_rows = SLICE_ROWS, FLUSH_ROWS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(arrow_fields)

        def rows() -> Iterator[dict]:
            for batch in batches:
                for start in range(0, batch.num_rows, slice_rows):
                    yield from batch.slice(start, slice_rows).to_pylist()

        nothing = [None] * len(record.fields)

        def called(item: dict, own: Iterator[dict]) -> tuple[str, str | None, list]:
            said = (r["review"] for r in own if r["kind"])  # an item that is listed twice is called once
            first_review = next(said, None)
            if first_review is None:
                return "skipped", None, nothing
            try:
                notes = annotator(item, chain([first_review], said))
                values = [notes.get(f.name) for f in record.fields]
                for value, (_, kind) in zip(values, arrow_fields[n_head:]):
                    pa.array([value], kind)  # what the record can't hold fails here, for this item alone
                return "done", None, values
            except Exception as exc:  # one bad item must not end the run
                return "error", f"{type(exc).__name__}: {exc}", nothing

        out: list[list] = [[] for _ in schema]

        def batch_of() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema)], schema=schema)
            for column in out:
                column.clear()
            return made

        for item_id, group in groupby(rows(), key=lambda r: r["item_id"]):
            item = next(group)
            if item["kind"] == 0:  # reviews of unknown items are passed over
                status, error, values = called(item["item"], group) if item["open"] else ("skipped", None, nothing)
                for column, value in zip(out, (item_id, status, error, *values)):
                    column.append(value)
                if len(out[0]) >= flush_rows:
                    yield batch_of()
        if out[0]:
            yield batch_of()

    return sorted_rows.mapInArrow(run, out_schema)


def annotation_rows(records: DataFrame, struct: str = "rec", model: str = "rules", done: bool = False) -> DataFrame:
    """A structured record per item as a table row; dives are marked done, price profiles carry the model."""
    extra: list[Column] = [F.lit(model).alias("model")]
    if done:
        extra = [F.lit("done").alias("status"), *extra, F.lit(None).cast("string").alias("error")]
    return records.select("item_id", *extra, f"{struct}.*")
