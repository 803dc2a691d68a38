"""Scalar rules: one table of (input, expected) for each."""

import pytest
from pyspark.sql import functions as F

from gleaner.functions import listing, numbers, text, urls


def told(spark, rule, values, kind="string"):
    rows = spark.createDataFrame(list(enumerate(values)), f"i int, x {kind}").repartition(2)
    return [r.y for r in rows.select("i", rule(F.col("x")).alias("y")).orderBy("i").collect()]


RULES = {
    "to_number": (numbers.to_number, {"£1,250.50": 1250.5, "POA": None, "£": 0.0, "": None, " ": 0.0, "0x10": 16.0, "12d": None, "NaN": None, "-5": -5.0, "5 pcm": None, "&pound;7": 7.0, "1e3": 1000.0, None: None}),
    "first_number": (numbers.first_number, {"£1,250.50 pcm": 1250.5, "POA": None, "-5": -5.0, "a 3 b 4": 3.0, "": None, None: None}),
    "title_case": (text.title_case, {"élan house": "éLan House", "3 BED flat": "3 BED Flat", "": "", None: None}),
    "strip_html": (text.strip_html, {"a<br>b</p> <p class='x'>c &amp; &lt;d&gt;": "a\nb\n\nc & <d>", None: None}),
    "decode_entities": (text.decode_entities, {"&#163;5 &#x41;&amp;lt;": "£5 A<", "&#99999999;": "&#99999999;", "&nbsp;x": " x", "&#xD800;": "&#xD800;", None: None}),
    "clean_title": (text.clean_text, {" Search  results ": None, "<b>Elm</b>\n road": "Elm road", "": None, "<style>x{}</style>A": "A", None: None}),
    "clean_address": (lambda c: text.clean_text(c, "address"), {"200\n1 Elm Road": "1 Elm Road", "12 Elm": "12 Elm"}),
    "purpose": (listing.purpose, {"Short Let": "short-let", "holiday": "short-let", "To Let": "rent", "current": "rent", "For Sale": "sale", "unknown": "unknown", "x": "unknown", "": None, None: None}),
    "property_type": (listing.property_type, {"Semi-detached villa": "semi-detached house", "Detached": "detached house", "ground floor flat": "apartment", "Plot": "land", "castle": None, None: None}),
    "currency_from_symbol": (listing.currency_from_symbol, {"£5": "GBP", "&#8358;5": "NGN", "5 €": "EUR", "$": "USD", "gbp": "GBP", "pounds": None, None: None}),
    "clean_email": (listing.clean_email, {"mailto:A@B.Example?subject=x": "a@b.example", "none": None, None: None}),
    "clean_phone": (listing.clean_phone, {"tel:+44 1904  123456": "+44 1904 123456", "192.168.100.1": "192.168.100.1", "123": None, None: None}),
    "canonical": (urls.canonical, {"HTTP://A.Example/x/#top": "http://a.example/x", "https://a.example?b=1": "https://a.example/?b=1", "not a url/": "not a url", None: ""}),
    "dedupe_key": (urls.dedupe_key, {"https://a.example/x?utm_source=m&b=1#c": "https://a.example/x?b=1", "id-7": "id-7", None: None}),
    "host": (urls.host, {"https://www.A.example:8080/x": "a.example", "x": None, None: None}),
    "title_status": (lambda c: c.rlike(text.STATUS_ONLY_TITLE), {"Sold STC": True, "For sale": True, "Sold house": False}),
    "invalid_address": (text.invalid_address, {"": True, "200 Elm": True, "12 nestled in": True, "1 Elm Road": False, None: True}),
}


@pytest.mark.parametrize("name", RULES)
def test_rule(spark, name):
    rule, cases = RULES[name]
    assert told(spark, rule, [*cases]) == [*cases.values()]


@pytest.mark.parametrize("url, detail, scope", [
    ("https://a.example/property/for-sale/in-york/", False, True), ("https://a.example/property/for-sale/in-york/elm-1", True, False),
    ("https://a.example/properties/elm-1", True, False), ("https://a.example/property/", False, False), ("https://a.example/details/3", True, False),
    ("https://a.example/x?search=york", False, True), ("https://a.example/about", False, False), ("junk", False, False), (None, False, False),
])
def test_url_classes(spark, url, detail, scope):
    row = spark.createDataFrame([(url,)], "x string").select(urls.is_detail(F.col("x")).alias("d"), F.coalesce(urls.is_scope(F.col("x")), F.lit(False)).alias("s")).first()
    assert (row.d, row.s) == (detail, scope)


def test_absolute_links(spark):
    cases = {"/a": "https://x.example/a", "//c.example/a": "https://c.example/a", "b?c": "https://x.example/p/b?c", "?q=1": "https://x.example/p/q?q=1", "https://o.example/": "https://o.example/", "mailto:a@b": "mailto:a@b"}
    assert told(spark, lambda c: urls.absolute(c, F.lit("https://x.example/p/q")), [*cases]) == [*cases.values()]


def test_images_keep_the_largest_variant(spark):
    given = ["https://a.example/1.jpg?size=10x10", "https://a.example/1.jpg?size=20x10", "https://a.example/logo.png", "https://a.example/x.svg", "https://a.example/2.jpg", "https://w.example/x%3E768:https://a.example/3.jpg", "junk"]
    got = spark.createDataFrame([(given,), ([],), (None,)], "x array<string>").select(urls.clean_images(F.col("x")).alias("y")).collect()
    assert got[0].y == ["https://a.example/1.jpg?size=20x10", "https://a.example/2.jpg", "https://a.example/3.jpg"]
    assert got[1].y is None and got[2].y is None


def test_options():
    assert [numbers.positive_integer(v, 25, 100) for v in ("12abc", "0", None, "500", 7)] == [12, 25, 25, 100, 7]
