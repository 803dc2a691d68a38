"""Text rules as Column expressions: entities, tags, cleaning per field, noise tests, title case."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# What marks a heading as a status or as page furniture.
STATUS_ONLY_TITLE = r"(?i)^(?:sold(?:\s+stc)?|under\s+offer|new\s+build|available|for\s+sale|to\s+let|let\s+agreed|apartment\s+living)$"
PAGE_NOISE = r"(?i)(?:properties?\s+archive|search\s+results?|page\s+\d+\s+of\s+\d+|\.st\d+\s*\{|fill\s*:\s*#|<svg|<style|@keyframes)"
UI_TITLE = r"(?i)^(?:minimum|maximum)?\s*(?:price|location|bedrooms?)\s*:?$|^(?:load|show|view)\s+(?:previous|next|more|items|results)|properties?\s+archive|search\s+results?|page\s+\d+\s+of\s+\d+|\.st\d+\s*\{|fill\s*:"
MERGE_NOISE = r"(?i)^(?:load|show|view)\s+(?:previous|next|more|items|results)|\.st\d+\s*\{|fill\s*:|<svg|@keyframes"
STYLE_NOISE = r"(?i)(?:\.st\d+\s*\{|fill\s*:|<svg|@keyframes|font-family\s*:)"
GENERIC_TITLE = r"(?i)^(?:under offer|sold(?:\s+stc)?|new instruction|for sale|to let)$"
STYLE_RULES_ONLY = r"(?i)^(?:\.?st\d+\s*\{[^}]*\}\s*)+$"
BLOCKED_PAGE = r"(?i)\.well-known/sgcaptcha|cf-chl-|captcha|verify you are human|checking your browser"
# Named entities, in the order in which they are decoded.
ENTITIES_FULL = [(r"(?i)&nbsp;|&#160;", " "), (r"(?i)&amp;", "&"), (r"(?i)&quot;|&#34;", '"'), (r"(?i)&#39;|&apos;", "'"), (r"(?i)&lt;", "<"), (r"(?i)&gt;", ">")]
ENTITIES_SHORT = [(r"(?i)&nbsp;", " "), (r"(?i)&amp;", "&"), (r"(?i)&lt;", "<"), (r"(?i)&gt;", ">"), (r"(?i)&quot;", '"'), (r"(?i)&#39;", "'")]
MAX_CODE_POINT = 0x10FFFF


def _replace_all(text: Column, rules: list[tuple[str, str]]) -> Column:
    for pattern, put in rules:
        text = F.regexp_replace(text, pattern, re.sub(r"([\\$])", r"\\\1", put))
    return text


def decode_entities(text: Column) -> Column:
    """Named entities one after another, then numeric ones; numbers beyond Unicode stay as they are."""
    text = _replace_all(text, ENTITIES_FULL)
    parts = F.regexp_extract_all(text, F.lit(r"(?is)(&#x?[0-9a-f]+;|(?:(?!&#x?[0-9a-f]+;).)+)"), F.lit(1))

    def one(p: Column) -> Column:
        digits = F.when(F.lower(p).startswith("&#x"), F.conv(F.regexp_extract(p, r"(?i)^&#x([0-9a-f]{1,6});$", 1), 16, 10)).otherwise(F.regexp_extract(p, r"^&#(\d{1,7});$", 1))
        code = digits.try_cast("int")
        utf32 = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        valid = p.rlike(r"(?i)^&#(x[0-9a-f]{1,6}|\d{1,7});$") & code.between(1, MAX_CODE_POINT) & ~code.between(0xD800, 0xDFFF)
        return F.when(valid, utf32).otherwise(p)

    return F.when(text.rlike("(?i)&#x?[0-9a-f]+;"), F.array_join(F.transform(parts, one), "")).otherwise(text)


def strip_html(text: Column) -> Column:
    """Breaks to line ends, paragraphs to blank lines, other tags away, then six entities."""
    text = F.regexp_replace(text, r"(?i)<br\s*/?>", "\n")
    text = F.regexp_replace(text, r"(?i)</p>\s*<p[^>]*>", "\n\n")
    return F.trim(_replace_all(F.regexp_replace(text, "<[^>]+>", ""), ENTITIES_SHORT))


def without_tags(text: Column) -> Column:
    """Style, drawing and script blocks, then all tags, give way to blanks."""
    for tag in ("style", "svg", "script"):
        text = F.regexp_replace(text, rf"(?is)<{tag}\b[^>]*>.*?</{tag}>", " ")
    return F.regexp_replace(F.regexp_replace(text, r"(?i)<br\s*/?>", "\n"), "<[^>]+>", " ")


def clean_text(text: Column, field: str = "") -> Column:
    """A display text without markup; null where nothing or page furniture is left."""
    text = without_tags(decode_entities(text))
    if field == "address":
        text = F.regexp_replace(text, r"^\s*\d{3}\s*(?:\r?\n|\s{3,})+", "")
    if field == "description":
        text = F.regexp_replace(F.regexp_replace(text, r"[ \t]+", " "), r"\n\s*\n\s*\n+", "\n\n")
    else:
        text = F.regexp_replace(text, r"\s+", " ")
    text = F.trim(F.regexp_replace(text, r"^\s+|\s+$", ""))
    return F.when((text != "") & ~text.rlike(PAGE_NOISE) & ~text.rlike(STYLE_RULES_ONLY), text)


def title_case(text: Column) -> Column:
    """Upper-cases the first letter of each run of ASCII word characters; the rest stays."""
    parts = F.regexp_extract_all(text, F.lit(r"([A-Za-z0-9_]+|[^A-Za-z0-9_]+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike("^[a-z]"), F.concat(F.upper(F.substring(p, 1, 1)), F.substr(p, F.lit(2)))).otherwise(p)), "")


def blank(text: Column) -> Column:
    return text.isNull() | (text == "")


def filled(text: Column) -> Column:
    """The trimmed text, or null where nothing is left of it."""
    return F.nullif(F.trim(text), F.lit(""))


def invalid_address(text: Column) -> Column:
    t = F.trim(F.coalesce(text, F.lit("")))
    return (t == "") | t.rlike(STYLE_NOISE) | t.rlike(r"^\d{3}\s+") | t.rlike(r"(?i)^\d{2,3}\s+(?:this|nestled|located|a\s|an\s|the\s)")


def is_blocked_page(html: Column) -> Column:
    return F.coalesce(F.substring(html, 1, 20_000).rlike(BLOCKED_PAGE), F.lit(False))
