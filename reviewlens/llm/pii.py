"""Personal data: regular expressions propose spans, checksums confirm them, nearby words adjust the score.

Everything is built of DataFrame expressions. A text is split by a pattern into the pieces between its matches; the
code point offsets of the matches are running sums of piece and match lengths, so no offset is searched for twice.

The four base kinds are decided by their own checks alone and are always reported. The further kinds (bank account,
national identity number, phone without country code) are proposed by looser patterns; a checksum or range check gives
them a score, words nearby raise it, and spans that reach the limit and don't touch a base span are added.

The patterns are possessive where that gives the same matches, so that long runs of one character take linear time
and constant stack.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONTEXT = 40
LIMIT = 0.6
CHUNK = 256
#: Characters of an IBAN by country.
IBAN_LENGTHS = {
    country: int(n)
    for n, countries in (
        line.split(":")
        for line in (
            "15:NO", "16:BE", "18:DK FI FK FO GL NL SD", "19:MK SI", "20:AT BA EE KZ LT LU MN XK", "21:CH HR LI LV",
            "22:BG BH CR DE GB GE IE ME RS VA", "23:AE GI IL IQ OM SO TL", "24:AD CZ ES MD PK RO SA SE SK TN VG",
            "25:LY PT ST", "26:IS TR", "27:BI DJ FR GR IT MC MR SM", "28:AL AZ BY CY DO GT HN HU LB NI PL SV",
            "29:BR EG PS QA UA", "30:JO KW MU YE", "31:MT SC", "32:LC", "33:RU",
        )
    )
    for country in countries.split()
}


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _at_most_255(part: Column) -> Column:
    bare = F.regexp_replace(part, "^0+", "")
    return (F.length(bare) <= 3) & (F.coalesce(F.when(F.length(bare) <= 3, bare).try_cast("int"), F.lit(0)) <= 255)


def ip_ok(match: Column) -> Column:
    return F.forall(F.split(match, r"\."), _at_most_255)


def luhn_ok(match: Column) -> Column:
    """14 to 19 digits whose Luhn sum is a multiple of ten."""
    digits = _digits(match)
    fits = F.length(digits).between(14, 19)
    # From the right, every second digit is doubled; doubled digits over nine lose nine.
    values = F.transform(F.split(F.reverse(F.when(fits, digits)), ""), lambda d: d.cast("int"))
    worth = F.transform(values, lambda d, i: F.when(i % 2 == 0, d).when(d < 5, 2 * d).otherwise(2 * d - 9))
    total = F.aggregate(worth, F.lit(0), lambda a, x: a + x)
    return fits & F.coalesce(total % 10 == 0, F.lit(False))


def phone_ok(match: Column) -> Column:
    return F.length(_digits(match)).between(10, 15)


def iban_ok(match: Column) -> Column:
    """15 to 34 characters whose number, country and check digits moved to the end, leaves 1 modulo 97."""
    bare = F.regexp_replace(match, " ", "")
    fits = F.length(bare).between(15, 34)
    turned = F.concat(F.substring(bare, 5, 34), F.substring(bare, 1, 4))
    values = F.transform(
        F.split(F.when(fits, turned), ""),
        lambda c: F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55),
    )
    rest = F.aggregate(values, F.lit(0), lambda a, v: (a * F.when(v > 9, 100).otherwise(10) + v) % 97)
    return fits & F.coalesce(rest == 1, F.lit(False))


def iban_of(found: Column) -> Column:
    """The beginning of the match, up to one of its spaces or its end, that is an IBAN, else null.

    Capitals and numbers may follow an IBAN, so a beginning counts where it has its country's length; for a country
    without a known length the longest one with right check digits does.
    """
    parts = F.split(found, " ")
    starts = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), " "))
    lengths = F.create_map(*[F.lit(x) for pair in IBAN_LENGTHS.items() for x in pair])
    length = F.element_at(lengths, F.substring(found, 1, 2))
    of_length = F.filter(starts, lambda s: length.isNull() | (F.length(F.regexp_replace(s, " ", "")) == length))
    fits = F.filter(of_length, iban_ok)
    return F.when(F.size(fits) > 0, F.element_at(fits, -1))


def ssn_ok(match: Column) -> Column:
    area, group, serial = (F.split_part(match, F.lit("-"), F.lit(i)) for i in (1, 2, 3))
    return ~area.isin("000", "666") & ~area.startswith("9") & (group != "00") & (serial != "0000")


@dataclass(frozen=True)
class Kind:
    """A kind of personal data: a pattern, a cheap sign that a text may hold it, a check and its scores.

    With `cut`, the pattern matches the beginning only and its group what may follow, so that no match takes another's
    beginning; `cut` gives the part of both that is reported, or null.
    `base` kinds need no context. For the others, a confirmed match has `score`, and each side of it that holds one of
    `words` within CONTEXT characters adds `boost`.
    """

    name: str
    pattern: str
    sign: Callable[[Column], Column]
    check: Callable[[Column], Column] | None = None
    cut: Callable[[Column], Column] | None = None
    base: bool = True
    score: float = 1.0
    boost: float = 0.0
    words: str = ""


def _any(text: Column) -> Column:
    return text.rlike("[0-9]")


KINDS = (
    Kind(
        "email",
        r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        lambda t: t.contains("@"),
    ),
    Kind("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", lambda t: t.rlike(r"[0-9]\.[0-9]"), ip_ok),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", lambda t: t.rlike("[0-9]"), luhn_ok),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda t: t.contains("+"), phone_ok),
    Kind(
        "iban", r"\b[A-Z]{2}[0-9]{2}(?=((?:\x20?[A-Z0-9]){11,30}\b))", lambda t: t.rlike("[A-Z]{2}[0-9]{2}"), cut=iban_of,
        base=False, score=0.8, boost=0.1, words="iban|bank|account|konto|compte|cuenta|bic|swift",
    ),
    Kind(
        "ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", lambda t: t.rlike("[0-9]-[0-9]"), ssn_ok,
        base=False, score=0.4, boost=0.3, words="ssn|social security|identity|tax id|taxpayer",
    ),
    Kind(
        "local_phone", r"(?<![0-9.+-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9-])",
        lambda t: t.rlike("[0-9][.-][0-9]"),
        base=False, score=0.4, boost=0.3, words="phone|tel|call|mobile|fax|cell|contact|whatsapp",
    ),
)


def _sums_before(values: Column) -> Column:
    """For each number of an array the sum of those before it, by chunks so that long arrays stay cheap."""
    chunks = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(values) - 1) / CHUNK).cast("int")),
        lambda c: F.slice(values, c * CHUNK + 1, CHUNK),
    )

    def scan(part: Column, start: Column) -> Column:
        first = F.struct(start.cast("int").alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(
            part,
            first,
            lambda a, v: F.struct((a["at"] + v).alias("at"), F.array_append(a["out"], a["at"]).alias("out")),
            lambda a: a["out"],
        )

    totals = F.transform(chunks, lambda part: F.aggregate(part, F.lit(0), lambda a, v: a + v))
    return F.flatten(F.zip_with(chunks, scan(totals, F.lit(0)), scan))


def _with_matches(frame: DataFrame, kind: Kind, text: str) -> DataFrame:
    """Adds an array of the kind's confirmed matches (start, end, found)."""
    none = F.array().cast("array<string>")
    pattern = F.lit(kind.pattern)
    frame = frame.withColumn(
        "__found", F.when(kind.sign(F.col(text)), F.regexp_extract_all(F.col(text), pattern, F.lit(0))).otherwise(none)
    )
    some = F.size("__found") > 0
    frame = frame.withColumn("__gaps", F.when(some, F.split(F.col(text), kind.pattern, -1)).otherwise(none))
    # Gap and match lengths in turn: the sums before the matches are their starts.
    frame = frame.withColumn(
        "__steps",
        F.zip_with(
            F.slice("__gaps", 1, F.size("__found")),
            F.concat(F.array(F.lit("")), F.slice("__found", 1, F.greatest(F.size("__found") - 1, F.lit(0)))),
            lambda gap, found: F.length(gap) + F.length(found),
        ),
    )
    frame = frame.withColumn(
        "__starts",
        F.when(
            some, F.zip_with(_sums_before(F.col("__steps")), "__steps", lambda before, step: before + step)
        ).otherwise(F.array().cast("array<int>")),
    )
    found = F.col("__found")
    if kind.cut is not None:
        cut = kind.cut
        tails = F.when(some, F.regexp_extract_all(F.col(text), pattern, F.lit(1))).otherwise(none)
        found = F.zip_with(found, tails, lambda head, tail: cut(F.concat(head, tail)))
    spans = F.zip_with(
        "__starts",
        found,
        lambda start, found: F.struct(
            start.alias("start"), (start + F.length(found)).alias("end"), found.alias("found")
        ),
    )
    if kind.check is not None:
        check = kind.check
        spans = F.filter(spans, lambda s: check(s["found"]))
    if kind.cut is not None:
        # A beginning inside a span that is reported is no span of its own.
        held = F.filter(spans, lambda s: s["found"].isNotNull())
        spans = F.filter(held, lambda s: ~F.exists(held, lambda t: (t["start"] < s["start"]) & (s["start"] < t["end"])))
    return frame.withColumn(f"__{kind.name}", spans).drop("__found", "__gaps", "__steps", "__starts")


def _scored(kind: Kind, rank: int, text: Column) -> Column:
    """The kind's matches as (start, rank, end, kind, score)."""

    def one(s: Column) -> Column:
        score = F.lit(kind.score)
        if kind.words:
            pattern = rf"(?i)(?<![a-z])(?:{kind.words})"
            left = F.substring(text, F.greatest(s["start"] - CONTEXT + 1, F.lit(1)), F.least(s["start"], F.lit(CONTEXT)))
            right = F.substring(text, s["end"] + 1, F.lit(CONTEXT))
            near = F.when(left.rlike(pattern), 1).otherwise(0) + F.when(right.rlike(pattern), 1).otherwise(0)
            score = score + near * kind.boost
        return F.struct(
            s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"),
            F.lit(kind.name).alias("kind"), score.cast("double").alias("score"),
        )

    return F.transform(F.col(f"__{kind.name}"), one)


def find_pii(docs: DataFrame, *, text_col: str = "text", limit: float = LIMIT) -> DataFrame:
    """Each row with `pii`: its spans (start, rank, end, kind, score) by start and then kind.

    Offsets are code points, the end is exclusive. An added column replaces one of its name. Null and empty texts have
    no spans. Base kinds keep every confirmed match, also where kinds overlap; added kinds need a score of `limit` and
    must not touch a base span. Repeated rows are judged each. Long texts are searched whole.
    """
    kept = [c for c in docs.columns if c != "pii"]
    frame = docs.select(*kept, F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    for kind in KINDS:
        frame = _with_matches(frame, kind, "__text")
    text = F.col("__text")
    base = F.concat(*[_scored(k, i, text) for i, k in enumerate(KINDS) if k.base])
    more = F.concat(*[_scored(k, i, text) for i, k in enumerate(KINDS) if not k.base])
    frame = frame.withColumn("__base", F.array_sort(base)).withColumn("__more", more)
    free = F.filter(
        "__more",
        lambda s: (s["score"] >= limit)
        & ~F.exists("__base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])),
    )
    return frame.select(*kept, F.array_sort(F.concat("__base", free)).alias("pii"))
