"""Note lines and short merchant names for matched orders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from reviewlens.functions.parsing import _c, let

NOTE_MARK = "[Order]"
# --- fixed values ---------------------------------------------------------------------
ORDER_LINK = "https://www.amazon.com/gp/css/order-details?orderID="
NO_TITLES = "Amazon order"
CHARGE_NAME, REFUND_NAME = "Amazon", "Amazon refund"
NOTE_TITLES = 5
SUMMARY_LENGTH = 42
BRACKETED = r"\([^)]*\)|\[[^\]]*\]"
PACK_OF = r"(?i)\bpack of \d+\b"
N_PACK = r"(?i)\b\d+[-\s]?pack\b"
SIZE_TOKEN = (
    r"(?i)\b\d[\d.,]*\s?(count|ct|pack|pk|pieces?|pcs?|soft ?gels?|capsules?|caplets?|tablets?|servings?"
    r"|fl ?oz|oz|ml|l|mg|g|kg|lbs?|inch(?:es)?|in|ft|cm|mm|pack)\b"
)


def note_line(
    titles: Column | str,
    order_id: Column | str,
    kind: Column | str | None = None,
    refund_match: Column | str | None = None,
    mark: str = NOTE_MARK,
    shown: int = NOTE_TITLES,
) -> Column:
    """`[Order] first titles · #id · link`, with as many titles as shown; refunds say so."""
    items = F.array_join(F.slice(F.coalesce(_c(titles), F.array().cast("array<string>")), 1, shown), ", ")
    items = F.when(items != "", items).otherwise(NO_TITLES)
    if kind is None:
        head = items
    else:
        partial = F.coalesce(_c(refund_match) == "partial", F.lit(False))
        what = F.when(partial, "Partial refund").otherwise("Refund")
        head = F.when(_c(kind) == "refund", F.concat(what, F.lit(" — "), items)).otherwise(items)
    oid = F.coalesce(_c(order_id), F.lit(""))
    return F.concat_ws(
        " · ",
        F.concat(F.lit(mark + " "), head),
        F.when(oid != "", F.concat(F.lit("#"), oid)),
        F.when(oid != "", F.concat(F.lit(ORDER_LINK), oid)),
    )


def merge_notes(current: Column | str, order_id: Column | str, line: Column | str) -> Column:
    """struct(notes, changed): append the line unless the order or the line is already there."""
    oid = F.coalesce(_c(order_id), F.lit(""))

    def merge(pair: Column) -> Column:
        cur, new = pair["cur"], pair["new"]
        present = ((oid != "") & cur.contains(oid)) | cur.contains(new)
        merged = F.when(present, cur).when(cur == "", new).otherwise(F.concat(cur, F.lit("\n"), new))
        return F.struct(merged.alias("notes"), (~present).alias("changed"))

    return let(F.struct(F.coalesce(_c(current), F.lit("")).alias("cur"), _c(line).alias("new")), merge)


def short_summary(titles: Column | str, length: int = SUMMARY_LENGTH) -> Column:
    """The first title without brackets, packs and sizes, cut at a word; how many more there are."""
    t = F.coalesce(_c(titles), F.array().cast("array<string>"))
    s = F.coalesce(F.get(t, F.lit(0)), F.lit(""))
    for pattern in (BRACKETED, PACK_OF, N_PACK, SIZE_TOKEN, r"[,|]+"):
        s = F.regexp_replace(s, pattern, " ")

    def cut(c: Column) -> Column:
        short = F.trim(F.regexp_replace(F.substring(c, 1, length), r"\s\S*$", ""))
        return F.when(c == "", "order").when(F.length(c) <= length, c).when(short == "", "order").otherwise(short)

    extra = F.when(F.size(t) > 1, F.concat(F.lit(" +"), (F.size(t) - 1).cast("string"))).otherwise("")
    return F.concat(let(F.trim(F.regexp_replace(s, r"\s+", " ")), cut), extra)


def merchant_name(titles: Column | str, kind: Column | str | None = None, length: int = SUMMARY_LENGTH) -> Column:
    base = F.lit(CHARGE_NAME) if kind is None else F.when(_c(kind) == "refund", REFUND_NAME).otherwise(CHARGE_NAME)
    return F.concat(base, F.lit(" — "), short_summary(titles, length))
