"""Column builders that read numbers, dates and labels out of page text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from reviewlens.functions.rounding import round_half_even

# --- fixed values: patterns of visible text ---------------------------------------
INSTALLS = r"(?i)([\d.,]+)\s*([KkMmBb]?)\s*\+?\s*users"
RATING_OF_FIVE = r"(?i)(\d(?:\.\d+)?)\s*out of\s*5"
RATING_BARE = r"^\s*(\d(?:\.\d+)?)\s*$"
RATING_COUNT = r"(?i)([\d.,]+)\s*([KkMmBb]?)\s*(?:ratings|reviews)"
STARS = r"(?i)(\d)\s*stars?"
VERSION = r"(?i)Version\s*:?\s*([0-9][0-9A-Za-z.\-_]*)"
RELATIVE_DATE = r"(?i)(\d+)\s+(second|minute|hour|day|week|month|year)s?\s+ago"
UPDATED_PHRASE = r"(?i)Updated[:\s]+([A-Za-z0-9,\s]+?\d{4}|\d+\s+\w+\s+ago)"
SUFFIX_FACTOR = {"": 1, "k": 1_000, "m": 1_000_000, "b": 1_000_000_000}
MOST_DAYS = 700_000  # further back there is no calendar
UNIT_DAYS = {"second": 0, "minute": 0, "hour": 0, "day": 1, "week": 7, "month": 30, "year": 365}
MONTHS = (
    "january", "february", "march", "april", "may", "june",
    "july", "august", "september", "october", "november", "december",
)
UNIT_STARTS = {unit[:3]: days for unit, days in UNIT_DAYS.items()}
# --- the shapes of a date: each names its year, month and day, and only one of them matches ---
_MONTH = (
    r"(?:j(?:an(?:uary)?|une?|uly?)|feb(?:ruary)?|ma(?:r(?:ch)?|y)|a(?:pr(?:il)?|ug(?:ust)?)|sep(?:t(?:ember)?)?|oct(?:ober)?"
    r"|nov(?:ember)?|dec(?:ember)?)\b"
)
_GAP, _TH = r"[\s,-]+", r"(?:st|nd|rd|th)?"


def _date_shapes() -> tuple[str, str]:
    """A pattern that matches a whole text around its first date, and what rewrites it to `\\1year-month-day`."""

    def year(i: int) -> str:
        """Of four digits, or of two: up to 49 in the next century."""
        return rf"(?:(?<y{i}>(?!0000)\d{{4}})|(?<a{i}>[0-4]\d)|(?<b{i}>[5-9]\d))(?![\d:])"

    def month(i: int) -> str:
        return rf"(?={_MONTH})(?<m{i}>[a-z]{{3}})[a-z]*\.?"

    numbers = (
        rf"(?<y1>(?!0000)\d{{4}})(?<s1>[-/.])(?<m1>\d{{1,2}})\k<s1>(?<d1>\d{{1,2}})(?!\d)",
        rf"(?!\d+\.\d+\.\d\d(?!\d))(?<d2>1[3-9]|2\d|3[01])(?<s2>[-/.])(?<m2>\d{{1,2}})\k<s2>{year(2)}",
        rf"(?!\d+\.\d+\.\d\d(?!\d))(?<m3>\d{{1,2}})(?<s3>[-/.])(?<d3>\d{{1,2}})\k<s3>{year(3)}",
        rf"(?<d4>\d{{1,2}}){_TH}{_GAP}(?:of\s+)?{month(4)}{_GAP}{year(4)}",
        rf"(?<y5>(?!0000)\d{{4}}){_GAP}{month(5)}{_GAP}(?<d5>\d{{1,2}}){_TH}(?!\d)",
    )
    named = rf"(?=[jfmasond])(?<![a-z]){month(6)}{_GAP}(?<d6>\d{{1,2}}){_TH}{_GAP}{year(6)}"
    pattern = rf"(?is)^.*?(?:(?=\d)(?<![\d/.-])(?:{'|'.join(numbers)})|{named}).*$"

    def any_of(kind: str, shapes: str) -> str:
        return "".join(f"${{{kind}{i}}}" for i in shapes)

    short = f"<{any_of('a', '2346')}^{any_of('b', '2346')}>"
    return pattern, f"\1{any_of('y', '123456')}{short}-{any_of('m', '123456')}-{any_of('d', '123456')}"


DATE_PATTERN, DATE_PARTS = _date_shapes()
ORDER_DATE = r"(?s)^.*?([A-Za-z]{3,9})\s+(\d{1,2}),\s+(\d{4}).*$"
ORDER_MONTHS = {f"-{name}-": f"-{i}-" for i, m in enumerate(MONTHS, 1) for name in (m, m[:3])} | {"-sept-": "-9-"}
#: What turns the century marks and month names of DATE_PARTS into numbers.
DATE_WORDS = {"<^>": "", "<^": "19", "<": "20", "^>": "", ">": ""} | {m[:3]: str(i) for i, m in enumerate(MONTHS, 1)}

def _c(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def let(value: Column, use) -> Column:
    """`use(value)` with the value computed once, however often it is read."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def lookup(key: Column, table: dict) -> Column:
    """Constant table lookup; null for a key that is not in it."""
    flat = [F.lit(part) for pair in table.items() for part in pair]
    return F.try_element_at(F.create_map(*flat), key)


def group(text: Column, pattern: str, number: int = 1) -> Column:
    """A capture group of the first match; null when the pattern does not match or the group is empty."""
    return F.nullif(F.regexp_extract(text, pattern, number), F.lit(""))


def _scaled(text: Column, pattern: str) -> Column:
    number = F.regexp_replace(group(text, pattern, 1), ",", "").try_cast("double")
    factor = lookup(F.lower(F.regexp_extract(text, pattern, 2)), SUFFIX_FACTOR)
    return (number * factor).try_cast("long")


def parse_install_count(text: Column | str) -> Column:
    return _scaled(_c(text), INSTALLS)


def parse_rating_count(text: Column | str) -> Column:
    return _scaled(_c(text), RATING_COUNT)


def parse_rating(text: Column | str) -> Column:
    c = _c(text)
    value = F.coalesce(group(c, RATING_OF_FIVE), group(c, RATING_BARE)).try_cast("double")
    return F.when(value.between(0, 5), round_half_even(value, 1))


def parse_star_label(text: Column | str) -> Column:
    """Whole stars from 1 to 5. No match is null before it is cast: a cast of an empty text to a number is slow to fail."""
    c = _c(text)
    of_five = F.bround(group(c, RATING_OF_FIVE).try_cast("double"), 0).cast("int")
    stars = F.coalesce(of_five, group(c, STARS).try_cast("int"))
    return lookup(stars, {n: n for n in range(1, 6)})


def parse_version(text: Column | str) -> Column:
    return group(_c(text), VERSION)


def _rewritten(text: Column, pattern: str, parts: str, words: dict[str, str]) -> Column:
    """The parts of a text that a pattern rewrites to `\\1parts`, in lower case, with words replaced; null if it doesn't match.

    A chain in which each step reads the one before once stays in generated code. A cast that fails is slow, so what is
    no date is null before it is cast.
    """
    out = F.lower(F.get(F.split(F.regexp_replace(text, pattern, parts), "\1"), F.lit(1)))
    for word, other in words.items():
        out = F.replace(out, F.lit(word), F.lit(other))
    return out


def first_day(text: Column) -> Column:
    """`Y-M-D` of the first date in a text; null when there is none.

    Years of four digits come first or last, with a month name the day is the other number; of two numbers the first one is
    the month unless it is beyond 12. Only one shape of the pattern matches; the groups of the others are empty.
    """
    return _rewritten(text, DATE_PATTERN, DATE_PARTS, DATE_WORDS)


def parse_order_date(text: Column | str) -> Column:
    """The first `Month D, YYYY` of a text; null if its word is no month."""
    return _rewritten(_c(text), ORDER_DATE, "\1$3-$1-$2", ORDER_MONTHS).try_cast("date")


def parse_date(text: Column | str, as_of: Column) -> Column:
    """A relative date against `as_of`, else the first date in the text, whatever words are around it."""
    c = _c(text)
    relative = group(c, RELATIVE_DATE, 0)
    days = F.try_multiply(
        F.regexp_extract(relative, r"\d+", 0).try_cast("long"),
        lookup(F.lower(F.regexp_extract(relative, "[A-Za-z]{3}", 0)), UNIT_STARTS).cast("long"),
    )
    ago = F.when(days <= MOST_DAYS, F.date_sub(as_of, F.least(days, F.lit(MOST_DAYS)).cast("int")))
    return F.when(relative.isNotNull(), ago).otherwise(first_day(c).try_cast("date"))


def normalize_date(text: Column | str) -> Column:
    """Export dates: an ISO prefix, else the first date in the text."""
    return first_day(_c(text)).try_cast("date")


def iso_day(text: Column | str) -> Column:
    """Date from the first ten characters, as stored timestamps carry them."""
    return F.substring(_c(text), 1, 10).try_cast("date")


def day_diff(earlier: Column | str, later: Column | str) -> Column:
    """Days between two ISO day strings or dates; null when either does not parse."""
    return F.datediff(_c(later).try_cast("date"), _c(earlier).try_cast("date"))


def squash(text: Column | str) -> Column:
    return F.trim(F.regexp_replace(_c(text), r"\s+", " "))


def decode_entities(text: Column | str) -> Column:
    """The handful of HTML entities that page titles carry (fixed values)."""
    c = _c(text)
    for entity, plain in (
        ("&amp;", "&"), ("&quot;", '"'), ("&#39;", "'"), ("&#039;", "'"), ("&apos;", "'"), ("&lt;", "<"), ("&gt;", ">"),
        ("&nbsp;", " "),
    ):
        c = F.replace(c, F.lit(entity), F.lit(plain))
    return c


def strip_tags(html: Column | str) -> Column:
    """Visible text of a markup fragment: tags become spaces, entities are decoded."""
    return squash(decode_entities(F.regexp_replace(_c(html), r"<[^>]*>", " ")))
