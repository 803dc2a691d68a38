"""Pages as tables of their elements. A worker parses a page and does nothing else; what a page means is
worked out on the table, by joins on the interval of places that an element's inside takes.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from html.parser import HTMLParser
from itertools import groupby
from operator import itemgetter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Text of an element that is kept; that of scripts, text areas, titles and marked-up properties is kept whole.
MAX_TEXT = 2_000
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
WHOLE, HIDDEN = {"script", "textarea", "title"}, {"script", "style", "svg"}
#: What a start tag closes if it is open, up to the element that bounds the search.
_CLOSES = {"li": ({"li"}, {"ul", "ol"}), "option": ({"option"}, {"select"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"})}
_BLOCKS = {"address", "article", "aside", "blockquote", "div", "dl", "fieldset", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"}

SCHEMA = "ord int, parent int, last int, tag string, attrs map<string,string>, text string, visible string"


class _Elements(HTMLParser):
    """Elements as rows of SCHEMA, each done when it ends. Open ones are [ord, parent, tag, attributes, first text, size of the
    texts before it]; texts are kept as far back as an open element may still want them."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.done: list[tuple] = []
        self.open: list[list] = []
        self.texts: list[str] = []
        self.hidden: list[bool] = []
        self.count = self.size = self.hiding = self.dropped = 0
        self.most = 1_000

    def _close(self, tags: set[str], bounds: set[str]) -> None:
        for depth in range(len(self.open) - 1, -1, -1):
            tag = self.open[depth][2]
            if tag in tags:
                self._end(depth)
                return
            if tag in bounds:
                return

    def _told(self, tag: str, attrs: dict, before: int) -> bool:
        return self.size - before <= MAX_TEXT or tag in WHOLE or "itemprop" in attrs

    def _end(self, depth: int) -> None:
        for at, parent, tag, attrs, first, before in self.open[depth:]:
            text = visible = None
            if self._told(tag, attrs, before):
                texts, hidden = self.texts[first - self.dropped :], self.hidden[first - self.dropped :]
                text = "".join(texts)
                visible = " ".join("".join(t for t, h in zip(texts, hidden, strict=True) if not h).split())
            self.done.append((at, parent, self.count - 1, tag, attrs, text, visible))
            self.hiding -= tag in HIDDEN
        del self.open[depth:]

    def handle_starttag(self, tag, attrs):
        if tag in _CLOSES:
            self._close(*_CLOSES[tag])
        elif tag in _BLOCKS:
            self._close({"p"}, {"button", "td", "th", "table", "object"})
        at, known = self.count, {}
        for k, v in attrs:
            known.setdefault(k, v or "")
        parent = self.open[-1][0] if self.open else -1
        self.count += 1
        if tag in VOID:
            self.done.append((at, parent, at, tag, known, "", ""))
        else:
            self.open.append([at, parent, tag, known, self.dropped + len(self.texts), self.size])
            self.hiding += tag in HIDDEN

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self._end(len(self.open) - 1)

    def handle_endtag(self, tag):
        for depth in range(len(self.open) - 1, -1, -1):
            if self.open[depth][2] == tag:
                self._end(depth)
                return

    def handle_data(self, data):
        self.texts.append(data)
        self.hidden.append(self.hiding > 0)
        self.size += len(data)
        if len(self.texts) > self.most:
            first = next((first for _, _, tag, attrs, first, before in self.open if self._told(tag, attrs, before)), self.dropped + len(self.texts))
            del self.texts[: first - self.dropped], self.hidden[: first - self.dropped]
            self.dropped, self.most = first, 2 * len(self.texts) + 1_000

    def taken(self) -> list[tuple]:
        done, self.done = self.done, []
        return done


#: Characters that are parsed at once, and rows and characters of their texts that a worker hands over at once.
CHUNK, ROWS, TEXTS = 1_000_000, 5_000, 4_000_000


def ended(pieces: Iterable[str | None]) -> Iterator[tuple]:
    """Rows of SCHEMA for one page that comes in pieces, in the order in which its elements end."""
    page, waiting, size = _Elements(), [], 0
    for piece in pieces:
        for lo in range(0, len(piece or ""), CHUNK):
            waiting.append(piece[lo : lo + CHUNK])
            size += len(waiting[-1])
            if size >= max(CHUNK, len(page.rawdata)):  # what is not parsed yet is searched anew: it is at least doubled first
                page.feed("".join(waiting))
                waiting, size = [], 0
                yield from page.taken()
    page.feed("".join(waiting))
    page.close()
    page._end(0)
    yield from page.taken()


def elements(html: str | None) -> Iterator[tuple]:
    """Rows of SCHEMA for one page."""
    yield from sorted(ended([html]), key=itemgetter(0))


def nodes(pages: DataFrame, key: str = "page_id", html: str = "html", place: str | None = None) -> DataFrame:
    """(key, ord, parent, last, tag, attrs, text, visible) of every element of every page.

    ``ord`` numbers a page's elements as they begin; those from ord + 1 to ``last`` are inside. ``text`` is all
    text inside as it stands, null if it is longer than MAX_TEXT; ``visible`` is it without scripts, styles and
    drawings, with single blanks. Unclosed elements end where their parent does. Null pages have none.

    With ``place`` a row is a piece of a page, and the pieces of a key are a page in the order of their places: a page is read as it
    comes and nowhere whole. Null pieces are skipped."""
    rows = pages.select(F.col(key).alias("k"), F.col(html).alias("h"), *([F.col(place).alias("p")] if place else []))
    if place:
        rows = rows.repartition("k").sortWithinPartitions("k", "p", "h").select("k", "h")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.strip().split(" ")[0] for c in SCHEMA.replace("map<string,string>", "map").split(",")]
        pieces = ((k, h) for rows in batches for k, h in zip(rows["k"], rows["h"], strict=True))
        if place:
            whole = ((k, (h for _, h in page)) for k, page in groupby(pieces, lambda r: None if r[0] != r[0] else r[0]))
        else:
            whole = ((k, [h]) for k, h in pieces)
        out, size = [], 0
        for k, page in whole:
            for e in ended(page):
                out.append((k, *e))
                size += len(e[5] or "")
                if len(out) >= ROWS or size >= TEXTS:
                    yield pd.DataFrame(out, columns=["k", *names])
                    out, size = [], 0
        if out:
            yield pd.DataFrame(out, columns=["k", *names])

    return rows.mapInPandas(run, f"k {dict(pages.dtypes)[key]}, {SCHEMA}").withColumnRenamed("k", key)


def attr(name: str) -> Column:
    """An attribute; null where it is absent or empty."""
    return F.nullif(F.try_element_at("attrs", F.lit(name)), F.lit(""))


def classes() -> Column:
    return F.split(F.trim(F.coalesce(attr("class"), F.lit(""))), r"\s+")


#: Places in a block, by which elements meet what is inside them.
BLOCK = 64


def inside(outer: DataFrame, inner: DataFrame, key: str, itself: bool = False) -> DataFrame:
    """Pairs of an element of ``outer`` (key, ord, last and more, renamed to o_*) and one of ``inner`` within it. They
    meet by block of places, so an element is compared with what is near it and not with its whole page."""
    told = outer.select(*[F.col(c).alias(f"o_{c}") for c in outer.columns], F.explode(F.sequence(F.expr(f"ord div {BLOCK}"), F.expr(f"last div {BLOCK}"))).alias("_o_block"))
    low = F.col("ord") >= F.col("o_ord") if itself else F.col("ord") > F.col("o_ord")
    rows = inner.withColumn("_block", F.expr(f"ord div {BLOCK}"))
    met = rows.join(told, (F.col(key) == F.col(f"o_{key}")) & (F.col("_block") == F.col("_o_block")) & low & (F.col("ord") <= F.col("o_last")))
    return met.drop("_block", "_o_block")
