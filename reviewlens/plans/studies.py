"""Research reports to structured rows, and the blocks and tables built from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlens.operators.tables import upsert

DATA_START, DATA_END = "===STUDY-DATA===", "===END-STUDY-DATA==="
NO_BLOCK = "no data block in the report; only its text is kept"
BAD_BLOCK = "the data block is not valid JSON; only the text is kept"
COMPETITOR_FIELDS = ("name", "url", "pricing", "users", "positioning", "strengths", "weaknesses")
OPPORTUNITY_FIELDS = ("title", "detail", "evidence", "effort")


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def _text(value: Column, path: str = "$") -> Column:
    return F.coalesce(_strip(F.try_variant_get(value, path, "string")), F.lit(""))


def _list(data: Column, name: str) -> Column:
    return F.coalesce(
        F.try_variant_get(data, f"$.{name}", "array<variant>"), F.array().cast("array<variant>")
    )


def _is_text(value: Column) -> Column:
    return F.schema_of_variant(value) == "STRING"


def _strings(data: Column, name: str) -> Column:
    """A list of texts, or one text as a list; blanks go."""
    single = F.try_variant_get(data, f"$.{name}", "variant")
    many = F.transform(_list(data, name), lambda v: _text(v))
    values = F.when(_is_text(single), F.array(_text(single))).otherwise(many)
    return F.filter(F.coalesce(values, F.array().cast("array<string>")), lambda s: s != "")


def _records(data: Column, name: str, fields: tuple[str, ...], needed: tuple[str, ...]) -> Column:
    """Objects with text fields; a bare text fills the first field; records without the needed ones go."""

    def one(v: Column) -> Column:
        plain = _is_text(v)
        first = F.when(plain, _text(v)).otherwise(_text(v, f"$.{fields[0]}")).alias(fields[0])
        rest = [F.when(plain, F.lit("")).otherwise(_text(v, f"$.{f}")).alias(f) for f in fields[1:]]
        return F.struct(first, *rest)

    def keep(r: Column) -> Column:
        some = r[needed[0]] != ""
        for f in needed[1:]:
            some = some | (r[f] != "")
        return some

    return F.filter(F.transform(_list(data, name), one), keep)


def parse_study_reports(
    docs: DataFrame, text: str = "text", start: str = DATA_START, end: str = DATA_END
) -> DataFrame:
    """Narrative and structured data of every report; a bad or missing block gives a warning, never a failure."""
    raw = F.replace(F.coalesce(F.col(text), F.lit("")), F.lit("\r\n"), F.lit("\n"))
    keep = [c for c in docs.columns if c != text]
    wide = docs.select(*keep, raw.alias("_raw")).withColumn("_at", F.instr("_raw", start))
    has = F.col("_at") > 0
    after = F.col("_raw").substr(F.col("_at") + F.lit(len(start)), F.length("_raw"))
    wide = wide.withColumn("_block", F.when(has, F.split_part(after, F.lit(end), F.lit(1))))
    unfenced = F.regexp_replace(F.regexp_replace(_strip(F.col("_block")), r"^```[a-zA-Z]*\s*", ""), r"\s*```$", "")
    braces = F.regexp_extract(unfenced, r"(?s)(\{.*\})", 1)
    wide = wide.withColumn("_data", F.coalesce(F.try_parse_json(_strip(unfenced)), F.try_parse_json(braces)))
    narrative = F.when(has, _strip(F.substring_index("_raw", start, 1))).otherwise(_strip(F.col("_raw")))
    data = F.col("_data")
    # Null, false, zero and the empty text are no data.
    bare = F.coalesce(F.to_json(data), F.lit(""))
    usable = (bare != "") & ~bare.isin("null", "false", '""') & ~bare.rlike(r"^-?0(\.0*)?([eE][+-]?\d+)?$")
    kind = F.schema_of_variant(data)
    details = F.when(kind.startswith("OBJECT") | kind.startswith("ARRAY"), bare)
    money = F.try_variant_get(data, "$.financials", "variant")
    money_kind = F.schema_of_variant(money)
    return wide.select(
        *keep,
        F.when(narrative != "", narrative).otherwise(_strip(F.col("_raw"))).alias("report_md"),
        _text(data, "$.summary").alias("summary"),
        F.lower(_text(data, "$.recommendation")).alias("recommendation"),
        _strings(data, "target_strengths").alias("target_strengths"),
        _strings(data, "target_weaknesses").alias("target_weaknesses"),
        _records(data, "competitors", COMPETITOR_FIELDS, ("name",)).alias("competitors"),
        _records(data, "opportunities", OPPORTUNITY_FIELDS, ("title", "detail")).alias("opportunities"),
        F.coalesce(
            F.when(money_kind.startswith("OBJECT") | money_kind.startswith("ARRAY"), F.to_json(money)), F.lit("{}")
        ).alias("financials"),
        _strings(data, "sources").alias("sources"),
        F.coalesce(details, F.lit("{}")).alias("details"),
        F.when(~has, NO_BLOCK).when(~usable, BAD_BLOCK).alias("parse_warning"),
    )


def study_rows(parsed: DataFrame, stored: DataFrame, as_of: Column, model: str = "report") -> DataFrame:
    """Parsed reports stored as finished studies per (item, layer)."""
    delta = parsed.select(
        "item_id", "layer", F.lit("done").alias("status"), as_of.alias("uploaded_at"), F.lit(model).alias("model"),
        "report_md",
        F.when(F.col("summary") != "", F.col("summary")).alias("summary"),
        F.when(F.col("recommendation") != "", F.col("recommendation")).alias("recommendation"),
        "target_strengths", "target_weaknesses", "competitors", "opportunities", "financials", "sources", "details",
        "parse_warning", F.lit(None).cast("string").alias("error"),
    )
    return upsert(stored, delta.select(*[c for c in delta.columns if c in stored.columns]), ["item_id", "layer"])


def competitors(dives: DataFrame) -> DataFrame:
    """One row per named competitor of an item, in report order."""
    rows = dives.select("item_id", F.posexplode_outer("competitors").alias("position", "c"))
    named = rows.filter(F.trim(F.coalesce(F.col("c.name"), F.lit(""))) != "")
    return named.select("item_id", "position", "c.*")


def facts_block(items: DataFrame) -> DataFrame:
    """The facts of an item as text lines; missing facts are left out."""
    rating = F.format_number(F.col("rating").cast("double"), 1)
    ratings = F.coalesce(F.format_number("rating_count", 0), F.lit("?"))
    store = F.coalesce(
        F.when(F.col("listing_url") != "", F.col("listing_url")) if "listing_url" in items.columns else F.lit(None),
        F.concat(F.lit("https://chromewebstore.google.com/detail/"), F.col("ext_id")),
    )
    facts = {
        "Name": F.col("name"),
        "Developer": F.col("developer"),
        "Category": F.col("store_category"),
        "Store rating": F.concat(rating, F.lit("★ ("), ratings, F.lit(" ratings)")),
        "Installs": F.format_number("install_count", 0),
        "Chrome Web Store listing": store,
    }
    # Concatenation with null is null, and concat_ws passes nulls over.
    lines = [F.concat(F.lit(f"- {label}: "), F.nullif(value, F.lit(""))) for label, value in facts.items()]
    return items.select(F.col("id").alias("item_id"), F.concat_ws("\n", *lines).alias("facts"))
