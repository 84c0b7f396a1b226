"""Classifiers and display labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from reviewlens import schemas as S
from reviewlens.functions.parsing import _c

# --- fixed values: bank-feed merchant names -------------------------------------------
STORE_MERCHANT = (
    r"(?i)\b(amazon(\.com)?|amzn(\s*mktp)?|amznmktp|amazon\s*mktp|amazon\s*prime|amazon\s*digital|prime\s*video)\b"
)
OTHER_MERCHANT = r"(?i)\b(whole\s*foods|amazon\s*fresh|amzn\s*fresh)\b"
# --- fixed values: wording of a finished return ------------------------------------------
RETURN_DONE = (
    r"(?i)(?=[rtyi])(?:refund (issued|complete|completed|processed)|refunded|your refund|track (your )?refund"
    r"|return (complete|completed|received|successful)|items? returned)"
)
# --- fixed values: greetings and placeholder names ---------------------------------------
GREETING = r"(?i)^(?:hello|hi|hey|hola|bonjour|hallo|ciao|olá|ola)[,!\s]+"
NO_NAME = r"(?i)^(sign\s?in|identify yourself|account|your account|accounts?\s*&\s*lists?)$"
LABEL_LENGTH = 40
TOKEN_SHAPED = r"\b[A-Za-z0-9_-]{24,}\b"
TOKEN_MARK = "«redacted»"


def is_store_merchant(name: Column | str) -> Column:
    c = F.coalesce(_c(name), F.lit(""))
    return c.rlike(STORE_MERCHANT) & ~c.rlike(OTHER_MERCHANT)


def has_return_hint(text: Column | str) -> Column:
    return F.coalesce(_c(text).rlike(RETURN_DONE), F.lit(False))


def account_label(greeting: Column | str) -> Column:
    t = F.trim(F.regexp_replace(_c(greeting), r"\s+", " "))
    name = F.trim(F.regexp_replace(t, GREETING, ""))
    return F.nullif(F.substring(F.regexp_replace(name, NO_NAME, ""), 1, LABEL_LENGTH), F.lit(""))


def redact_html(html: Column | str) -> Column:
    """Digits masked, text nodes longer than 15 characters blanked, whitespace collapsed."""
    c = F.regexp_replace(_c(html), r"[0-9]", "#")
    c = F.regexp_replace(c, r">([^<]{16,})<", ">[text]<")
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def card_sample(html: Column | str, before: int = 250, span: int = 2800) -> Column:
    """Redacted markup around the first order card; empty when there is none."""
    c = _c(html)
    at = F.regexp_instr(c, F.lit(r"js-order-card|\border-card\b"))
    start = F.greatest(at - before, F.lit(1))
    return F.when(at > 0, redact_html(c.substr(start, F.lit(span)))).otherwise("")


def scrub(text: Column | str, limit: int | None = None) -> Column:
    """Long key-shaped runs replaced by a marker; with `limit`, cut to so many characters."""
    c = F.regexp_replace(_c(text), TOKEN_SHAPED, TOKEN_MARK)
    return c if limit is None else F.substring(c, 1, limit)


def money_status(pricing_model: Column | str, has_paid_tier: Column | str) -> Column:
    m, tier = _c(pricing_model), F.coalesce(_c(has_paid_tier), F.lit(False))
    return (
        F.when(F.coalesce(m, F.lit("")).isin("", "unknown"), "unknown")
        .when(tier | m.isin(*S.PAID_MODELS), "paid")
        .otherwise("free")
    )


def percent(value: Column | str) -> Column:
    return F.floor(_c(value) * 100 + 0.5).cast("int")


def recency_label(weight: Column | str) -> Column:
    pct = percent(weight)
    return F.when(pct >= 85, "fresh").when(pct >= 50, "partly").when(pct.isNotNull(), "old")


def trend_label(decline: Column | str) -> Column:
    d = _c(decline)
    return F.when(d < S.DECLINING_AT, "steady").when(d.isNotNull(), "declining")


def low_legitimacy(legitimacy: Column | str) -> Column:
    return F.coalesce(_c(legitimacy) < S.LOW_LEGITIMACY, F.lit(False))


def dive_rank(status: Column | str) -> Column:
    c = _c(status)
    return F.when(c == "done", 3).when(c == "queued", 2).when(c == "error", 1).otherwise(0)
