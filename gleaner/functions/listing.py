"""Listing rules as Column expressions: contacts, purpose, currency, kind of property."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import urls
from .numbers import decode_currencies
from .text import filled

EMAIL = r"(?i)([A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,})"
PHONE = r"((?:\+\s?\d{1,3}[\s().-]*)?(?:\d[\s().-]*){7,15})"
POSTCODE = r"(?i)^[A-Z]{1,2}\d[A-Z\d]?\s*\d[A-Z]{2}$"
# Kind of property and the pattern that tells it, the first match counts.
PROPERTY_TYPES = [
    ("semi-detached house", r"(?i)\bsemi[\s-]?detached\b"),
    ("detached house", r"(?i)\bdetached\b"),
    ("terraced house", r"(?i)\b(?:end[\s-]?terrace|terraced?|townhouse|town house)\b"),
    ("maisonette", r"(?i)\bmaisonette\b"),
    ("apartment", r"(?i)\b(?:apartment|flat)\b"),
    ("bungalow", r"(?i)\bbungalow\b"),
    ("cottage", r"(?i)\bcottage\b"),
    ("studio", r"(?i)\bstudio\b"),
    ("house", r"(?i)\b(?:house|home|residence)\b"),
    ("commercial property", r"(?i)\b(?:commercial|retail|office|warehouse)\b"),
    ("land", r"(?i)\b(?:plot|land)\b"),
]
# Signs in the order in which they are looked for.
CURRENCY_SIGNS = [("GBP", "£"), ("NGN", "₦"), ("EUR", "€"), ("USD", "$")]
UK_NAMES = ["UK", "GB", "UNITED KINGDOM", "ENGLAND", "SCOTLAND", "WALES", "NORTHERN IRELAND"]


def clean_email(text: Column) -> Column:
    found = F.lower(F.nullif(F.regexp_extract(F.regexp_replace(text, "(?i)^mailto:", ""), EMAIL, 1), F.lit("")))
    return F.when(text.contains("@"), found)  # the pattern is slow on long texts and needs the sign


def clean_phone(text: Column) -> Column:
    found = F.regexp_replace(F.trim(F.regexp_extract(F.trim(F.regexp_replace(text, "(?i)^tel:", "")), PHONE, 1)), r"\s+", " ")
    return F.when(F.length(F.regexp_replace(found, r"\D", "")).between(7, 15), found)


def purpose(text: Column) -> Column:
    """short-let before rent before sale; other words are unknown, no words are null."""
    t = F.lower(filled(text))
    return (
        F.when(t == "unknown", t).when(t.rlike(r"short[\s-]?(let|term)|holiday"), "short-let")
        .when(t.rlike("rent|let|lease"), "rent").when(t.rlike("sale|buy|purchase"), "sale").when(t.isNotNull(), "unknown")
    )


def purpose_map(text: Column, args: dict[str, str] | None = None) -> Column:
    t = F.lower(F.trim(text))
    named = [F.when(t == k.lower(), F.lit(v)) for k, v in (args or {}).items()]
    return F.when(text.isNotNull(), F.coalesce(*named, purpose(text), F.lit("unknown")))


def property_type(text: Column) -> Column:
    out = None
    for name, pattern in PROPERTY_TYPES:
        out = F.when(text.rlike(pattern), name) if out is None else out.when(text.rlike(pattern), name)
    return out


def currency_from_symbol(text: Column) -> Column:
    t = decode_currencies(text)
    return F.coalesce(*[F.when(t.contains(s), c) for c, s in CURRENCY_SIGNS], F.when(F.upper(F.trim(t)).rlike("^[A-Z]{3}$"), F.upper(F.trim(t))))


def currency(code: Column, price: Column, country: Column, postcode: Column, site: Column) -> Column:
    """An ISO code, else a sign in the price, else the country, postcode or the site's host."""
    c, t, h = F.upper(F.trim(code)), decode_currencies(price), urls.host(site)
    signs = [F.when(t.contains(s) | (t.rlike(r"(?i)\bNGN\b") if k == "NGN" else F.lit(False)), k) for k, s in CURRENCY_SIGNS]
    uk = F.upper(country).isin(UK_NAMES) | F.trim(postcode).rlike(POSTCODE)
    return F.coalesce(F.when(c.rlike("^[A-Z]{3}$"), c), *signs, F.when(uk, "GBP"), F.when(h.endswith(".uk"), "GBP"), F.when(h.endswith(".ng"), "NGN"))
