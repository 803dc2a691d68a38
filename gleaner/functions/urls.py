"""URL rules as Column expressions. None of them fails on text that is no URL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ABSOLUTE = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?"
# Query keys that only track where a visit came from.
TRACKING_KEYS = ["utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content"]
SEARCH_CHANNELS = ["for-sale", "to-rent", "sales", "lettings", "search", "list", "map"]
SCOPE_PATH = r"/(?:properties?|search|for-sale|to-rent|sales|lettings)(?:/|$)"
SCOPE_KEY = r"address|location|area|place|postcode|instruction|search|branch|bid"
NOT_IMAGE = r"(?i)^(?:data:|blob:|javascript:|#)|\.(?:svg|ico)(?:[?#]|$)|(?:^|[/_-])(?:logos?|favicons?|sprites?|avatars?|icons?|markers?|loading|placeholders?|spacers?|blank)(?:[/_\-.]|$)|broadbandavailability|broadband(?:uk)?[-_]?badge"
FLOOR_PLAN = r"(?i)(?:^|[/_-])floor[\s_-]?plans?(?:[/_\-.]|$)"


def _part(url: Column, i: int) -> Column:
    return F.regexp_extract(url, ABSOLUTE, i)


def is_absolute(url: Column) -> Column:
    return F.coalesce(url.rlike(ABSOLUTE), F.lit(False))


def origin(url: Column) -> Column:
    """Scheme, host and port, without the default one."""
    whole = F.lower(F.concat(_part(url, 1), F.lit("://"), F.regexp_extract(_part(url, 2), "([^@]*)$", 1)))
    return F.when(is_absolute(url), F.regexp_replace(whole, r"^(http:.*):(?:80)?$|^(https:.*):(?:443)?$", "$1$2"))


def path(url: Column) -> Column:
    return _part(url, 3)


def query(url: Column) -> Column:
    return F.substr(_part(url, 4), F.lit(2))


def host(url: Column) -> Column:
    """Lower-cased host without port and without a leading www."""
    bare = F.regexp_replace(F.lower(_part(url, 2)), r"^.*@|:\d+$", "")
    return F.when(is_absolute(url), F.regexp_replace(bare, r"^www\.", ""))


def host_slug(url: Column) -> Column:
    return F.regexp_replace(host(url), "[^a-z0-9]+", "-")


def canonical(url: Column) -> Column:
    """Without fragment and one trailing slash, scheme and host lower-cased."""
    whole = F.concat(origin(url), F.when(path(url) == "", "/").otherwise(path(url)), _part(url, 4))
    return F.regexp_replace(F.coalesce(whole, F.coalesce(url, F.lit(""))), "/$", "")


def dedupe_key(url: Column) -> Column:
    """``canonical`` without tracking keys."""
    kept = F.filter(F.split(query(url), "&"), lambda p: (p != "") & ~F.lower(F.element_at(F.split(p, "="), 1)).isin(TRACKING_KEYS))
    tail = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    whole = F.concat(origin(url), F.when(path(url) == "", "/").otherwise(path(url)), tail)
    return F.regexp_replace(F.coalesce(whole, url), "/$", "")


def _with(value: Column, use) -> Column:
    """``use(value)``, where ``value`` is computed once however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _escaped(text: Column, unsafe: str) -> Column:
    """Percent-encodes the characters that match ``unsafe``."""
    one = lambda c: F.when(c.rlike(unsafe), F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))).otherwise(c)
    return _with(text, lambda t: F.when(t.rlike(unsafe), F.array_join(F.transform(F.split(t, ""), one), "")).otherwise(t))


def without_dot_segments(path: Column) -> Column:
    """A path that begins with a slash, with its . and .. taken."""
    dot, up = r"(?i)^(?:\.|%2e)$", r"(?i)^(?:\.|%2e){2}$"
    step = lambda kept, s: F.when(s.rlike(up), F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0)))).when(s.rlike(dot), kept).otherwise(F.concat(kept, F.array(s)))

    def taken(p: Column) -> Column:
        steps = F.split(F.substr(p, F.lit(2)), "/")
        end = F.when(F.element_at(steps, -1).rlike(r"(?i)^(?:\.|%2e){1,2}$"), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
        return F.concat(F.lit("/"), F.array_join(F.concat(F.aggregate(steps, F.array().cast("array<string>"), step), end), "/"))

    return _with(path, lambda p: F.when(p.rlike(r"(?i)/(?:\.|%2e){1,2}(?:/|$)"), taken(p)).otherwise(p))


def normal(url: Column) -> Column:
    """An absolute URL as a browser writes it: scheme and host lower-cased, the default port left out, dot
    segments taken, an empty path a slash, what may not stand in a part percent-encoded."""

    def parts(u: Column) -> Column:
        place = F.lower(F.regexp_replace(F.concat(_part(u, 1), F.lit("://"), F.regexp_extract(_part(u, 2), "([^@]*)$", 1)), r"^(?i)(http:.*):(?:80)?$|^(https:.*):(?:443)?$", "$1$2"))
        user = F.regexp_extract(_part(u, 2), "^(.*@)", 1)
        steps = F.regexp_replace(F.regexp_replace(_part(u, 3), r"\\", "/"), "^$", "/")
        steps = _escaped(without_dot_segments(steps), "[^\\x21-\\x7e]|[\"<>`{}]")
        rest = F.concat(_escaped(_part(u, 4), "[^\\x21-\\x7e]|[\"'<>]"), _escaped(F.regexp_extract(u, "(#.*)$", 1), "[^\\x21-\\x7e]|[\"<>`]"))
        with_user = F.when(user != "", F.regexp_replace(place, "://", F.concat(F.lit("://"), user))).otherwise(place)
        return F.concat(with_user, steps, rest)

    return _with(F.trim(url), parts)


def absolute(link: Column, base: Column) -> Column:
    """A link as seen from a page: absolute, root-relative or relative to the folder, in its normal form. One
    without a scheme but with a host gets the page's scheme and stays as it is otherwise; so do links of
    other schemes, and all links where the page's own URL is none (if it is null, absolute ones are normal)."""

    def joined(text: Column, page: Column) -> Column:
        top = F.concat(_part(page, 1), F.lit("://"), _part(page, 2))
        folder = F.coalesce(F.nullif(F.regexp_extract(path(page), "^(.*/)", 1), F.lit("")), F.lit("/"))
        return (
            F.when(is_absolute(text), text).when(text.startswith("/"), F.concat(top, text)).when(text.startswith("?"), F.concat(top, path(page), text))
            .when((text == "") | text.startswith("#"), F.concat(top, path(page), _part(page, 4), text)).otherwise(F.concat(top, folder, text))
        )

    def seen(both: Column) -> Column:
        text, page = both["text"], both["page"]
        other = text.rlike("^[A-Za-z][A-Za-z0-9+.-]*:") & ~text.rlike("(?i)^https?://")
        stays = (both["link"] == "") | both["link"].isNull() | (~is_absolute(page) & page.isNotNull()) | other | (page.isNull() & ~is_absolute(text))
        return F.when(stays, both["link"]).when(both["link"].startswith("//"), F.concat(F.lower(_part(page, 1)), F.lit(":"), both["link"])).otherwise(normal(joined(text, page)))

    return _with(F.struct(link.alias("link"), F.trim(link).alias("text"), base.alias("page")), seen)


def same_origin(a: Column, b: Column) -> Column:
    return F.coalesce(origin(a) == origin(b), F.lit(False))


def _segments(url: Column) -> Column:
    return F.filter(F.split(F.lower(path(url)), "/"), lambda s: s != "")


def is_detail(url: Column) -> Column:
    """A page about one listing: something follows /property/, three steps deep after a search channel."""
    s = _segments(url)
    first = F.least(F.nullif(F.array_position(s, F.lit("property")), F.lit(0)), F.nullif(F.array_position(s, F.lit("properties")), F.lit(0))).cast("int")
    after = F.get(s, first)
    return F.coalesce(
        F.when(first.isNull(), F.regexp_replace(F.lower(path(url)), "/+$", "").rlike("/(?:property-details|details)/"))
        .when(after.isin(SEARCH_CHANNELS), F.size(s) > first + 2)
        .otherwise(after.isNotNull()),
        F.lit(False),
    )


def is_scope(url: Column) -> Column:
    keys = F.transform(F.split(F.lower(query(url)), "&"), lambda p: F.element_at(F.split(p, "="), 1))
    return ~is_detail(url) & (F.lower(path(url)).rlike(SCOPE_PATH) | F.exists(keys, lambda k: k.rlike(SCOPE_KEY)))


def paging(url: Column) -> Column:
    """How a URL pages: struct of the key and its kind, page (step 1) or offset (step limit or 1)."""
    q = F.str_to_map(F.lower(query(url)), F.lit("&"), F.lit("="))
    number = lambda k: F.try_element_at(q, F.lit(k)).try_cast("int")
    page = next_of([(k, number(k)) for k in ("page", "pagenumber", "page_number", "p")])
    offset = next_of([(k, number(k)) for k in ("offset", "start", "skip", "from")])
    limit = F.coalesce(number("limit"), number("size"), number("per_page"), F.lit(1))
    return F.when(page.isNotNull(), F.struct(F.lit("page").alias("kind"), page.alias("key"), F.lit(1).alias("step"))).when(offset.isNotNull(), F.struct(F.lit("offset").alias("kind"), offset.alias("key"), limit.alias("step")))


def next_of(named: list[tuple[str, Column]]) -> Column:
    return F.coalesce(*[F.when(v.isNotNull(), F.lit(k)) for k, v in named])


def is_image(url: Column) -> Column:
    return F.coalesce((F.trim(url) != "") & ~F.trim(url).rlike(NOT_IMAGE), F.lit(False))


def srcset(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(r"(https?://[^\s,]+)"), F.lit(1))
    plain = F.filter(F.transform(F.split(text, ","), lambda c: F.element_at(F.split(F.trim(c), r"\s+"), 1)), lambda c: c != "")
    return F.when(F.size(found) > 0, found).otherwise(plain)


def clean_images(urls: Column) -> Column:
    """The best sized variant of each picture, in first-seen order; null where none is left."""
    found = F.flatten(F.transform(urls, lambda u: (lambda e: F.when(F.size(e) > 1, F.slice(e, 2, F.size(e))).otherwise(e))(F.regexp_extract_all(F.regexp_replace(u, "(?i)%3E", ">"), F.lit(r"(?i)(https?://[^\s,>]+)"), F.lit(1)))))
    good = F.filter(found, lambda u: ~u.rlike(NOT_IMAGE))

    def keyed(u: Column) -> Column:
        size = lambda g: F.regexp_extract(F.regexp_replace(u, "(?i)%2C", ","), r"[?&]size=(\d+)[,x](\d+)", g).try_cast("long")
        width, height = (F.regexp_extract(u, rf"[?&]{k}=(\d+)", 1).try_cast("long") for k in ("width", "height"))
        score = F.coalesce(size(1) * size(2), F.when(width > 0, width * F.when(height > 0, height).otherwise(width)), F.when(u.contains("?"), 1).otherwise(2).cast("long"))
        return F.struct(F.lower(F.concat(origin(u), path(u))).alias("key"), score.alias("score"), u.alias("url"))

    def step(acc: Column, c: Column) -> Column:
        better = F.transform(acc, lambda a: F.when((a["key"] == c["key"]) & (c["score"] > a["score"]), c).otherwise(a))
        return F.when(F.exists(acc, lambda a: a["key"] == c["key"]), better).otherwise(F.concat(acc, F.array(c)))

    none = F.array().cast("array<struct<key:string,score:bigint,url:string>>")
    best = F.transform(F.aggregate(F.transform(good, keyed), none, step), lambda c: c["url"])
    return F.when(F.size(best) > 0, best)


# Path steps that name no place on sites of one search engine.
_SEARCH_STEPS = ["properties", "property", "sales", "lettings", "list", "map"]


def search_endpoint(url: Column, page: Column) -> Column:
    """Where such a site's own search gives ``page`` of a listing page as JSON: the path's steps that name a place
    and the page as a fragment, the query's other keys as they are, sales unless the path says lettings."""

    def told(u: Column) -> Column:
        steps = F.filter(F.split(path(u), "/"), lambda s: s != "")
        channel = F.when(F.array_contains(steps, "lettings"), "lettings").otherwise("sales")
        places = F.filter(steps, lambda s: ~s.isin(_SEARCH_STEPS))
        first = F.array_position(F.transform(places, lambda s: s.rlike(r"^page-\d+$")), True).cast("int")
        places = F.when(first > 0, F.concat(F.slice(places, 1, F.greatest(first - 1, F.lit(0))), F.slice(places, first + 1, F.size(places)))).otherwise(places)
        kept = F.filter(F.split(query(u), "&"), lambda p: (p != "") & ~F.element_at(F.split(p, "="), 1).isin("page", "fragment", "channel"))
        fragment = F.url_encode(F.array_join(F.concat(places, F.array(F.concat(F.lit("page-"), page.cast("string")))), "/"))
        return F.concat(origin(u), F.lit("/search.ljson?"), F.array_join(F.concat(kept, F.array(F.concat(F.lit("channel="), channel), F.concat(F.lit("fragment="), fragment))), "&"))

    return F.when(is_absolute(url), _with(url, told))


def search_cursor(body: Column) -> Column:
    """struct<page, has_next, total> of such a search's answer; null for other JSON: it needs a list of properties and a
    numbered page."""
    v = F.try_parse_json(F.regexp_replace(body, r"^\)\]\}',?\s*", ""))
    at = lambda name, kind: F.try_variant_get(v, f"$.pagination.{name}", kind)
    fit = F.schema_of_variant(F.try_variant_get(v, "$.properties", "variant")).startswith("ARRAY") & at("current_page", "double").isNotNull()
    return F.when(fit, F.struct(at("current_page", "int").alias("page"), F.coalesce(at("has_next_page", "boolean"), F.lit(False)).alias("has_next"), F.nullif(at("total_count", "long"), F.lit(0)).alias("total")))
