"""From raw records to canonical listings and platform rows.

A record is JSON text of any shape. One small Python stage parses it once and lists the entries that any
field may want, in the order in which a search would visit them (a node's own keys first, then its
children in turn), with its public contacts. Every field is then a Column over that list, so all fields
of a row are one select.

Null, broken and scalar records have no entries: all their fields are null and their contacts empty.
Numbers are written as a script writes them (12.0 is 12), objects and arrays under a text field keep their
JSON text. Columns named like a canonical field are replaced by it; all others are kept.
"""

from __future__ import annotations

import json
import re
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import listing, numbers, urls
from ..functions.text import filled
from ..sources.json_shapes import _contacts
from .quality import ARRAY_FIELDS, NUMBER_FIELDS, STRING_FIELDS

# The names under which a canonical field is found, letters and digits only.
FIELD_ALIASES = {
    "id": ["id", "listingid", "propertyid", "slug", "uuid"],
    "title": ["title", "friendlystr", "displayaddress", "addresswithcommas", "name", "headline"],
    "description": ["description", "shortdescription", "summary", "details", "body"],
    "price": ["price", "pricevalue", "listprice", "askingprice"],
    "currency": ["currency", "pricecurrency"],
    "bedrooms": ["bedrooms", "beds", "bedroomcount", "numbedrooms", "noofbedrooms"],
    "bathrooms": ["bathrooms", "baths", "bathroomcount", "numbathrooms"],
    "sqft": ["sqft", "squarefeetinternal", "squarefeet", "floorarea", "size"],
    "propertyType": ["propertytype", "proptype", "type", "listingtype"],
    "address": ["address", "addresswithcommas", "displayaddress", "street", "streetaddress"],
    "city": ["city", "town"],
    "state": ["state", "region", "county"],
    "postcode": ["postcode", "zip", "zipcode", "postalcode"],
    "country": ["country"],
    "latitude": ["latitude", "lat"],
    "longitude": ["longitude", "lng", "lon", "long"],
    "images": ["images", "photos", "propertyindexphotos", "photo", "photosquare", "media", "gallery"],
    "status": ["status", "listingstatus"],
    "agentName": ["agentname", "branchname", "officename", "listedby"],
    "agentEmail": ["agentemail", "branchemail", "officeemail", "contactemail", "email"],
    "agentPhone": ["agentphone", "agentmobile", "branchphone", "officephone", "contactphone", "telephone", "phone", "mobile", "voxnumber"],
    "agentContact": ["agentcontact", "contactdetails"],
    "sourceUrl": ["url", "href", "permalink", "link", "detailurl", "propertyurl"],
}
# The parts of an address object, in the order in which they are joined.
ADDRESS_PARTS = ["building_number", "buildingName", "streetAddress", "address1", "address2", "address3", "town", "city", "postcode", "postalCode"]
# Fields of a record read from a page's elements, and the keys that may hold them.
DOM_FIELDS = {
    "title": ["title", "name", "headline"], "description": ["description", "summary"], "price": ["price"],
    "bedrooms": ["bedrooms", "numberOfBedrooms"], "bathrooms": ["bathrooms", "numberOfBathroomsTotal"], "sqft": ["sqft", "floorSize"],
    "propertyType": ["propertyType", "additionalType"], "address": ["address"], "city": ["city", "addressLocality"],
    "postcode": ["postcode", "postalCode"], "country": ["country"], "latitude": ["latitude"], "longitude": ["longitude"],
    "agentName": ["agentName"], "agentEmail": ["agentEmail"], "agentPhone": ["agentPhone"], "agentContact": ["agentContact"],
}

# Names under which a platform field is found in the raw record.
SOURCE_ALIASES = {
    "price": ["priceValue", "price", "askingPrice", "listPrice"], "purpose": ["purpose", "channel", "department", "search_type", "instruction_type", "listingType"],
    "images": ["images", "photos", "propertyIndexPhotos", "photo", "gallery"], "floorPlan": ["floorPlan", "floorPlans", "floorplan", "floorplans"],
    "features": ["features", "propertyFeatures", "bulletPoints", "keyFeatures"], "period": ["priceQualifier", "rentFrequency", "frequency"],
    "title": ["title", "headline", "displayAddress", "name"], "location": ["displayAddress", "location", "area"], "address": ["displayAddress", "addressWithCommas", "address"],
    "city": ["city", "town", "addressLocality"], "typeOfProperty": ["propertyType", "type", "building", "subType"], "bedrooms": ["bedrooms", "bedroom", "beds"],
    "bathrooms": ["bathrooms", "bathroom", "baths"], "livingRoom": ["livingRoom", "reception", "receptions", "receptionRooms"], "size": ["size", "floorArea", "squareFeetInternal", "squareFeet"],
    "tenureOfProperty": ["tenure", "tenureOfProperty"], "description": ["longDescription", "description", "shortDescription", "summary"], "video_link": ["videoLink", "videoUrl", "video"],
    "virtual_tour_link": ["virtualTourLink", "virtualTour", "virtual_tour"], "subType": ["subType", "propertySubType", "style"], "currency": ["currency", "priceCurrency", "price_currency"],
    "priceText": ["price", "priceValue", "amount"], "country": ["country", "addressCountry"], "postcode": ["postcode", "postalCode"], "id": ["id", "propertyId", "listingId", "crmId", "objectID"],
}
#: Own keys of a record that its links depend on.
LINK_KEYS = ["_documentBaseUrl", "search_type", "department", "slug", "objectID", "strapi_id", "images", "url"]

ALIAS_DEPTH, SOURCE_DEPTH = 5, 6
#: kind: empty (null or an empty text), none (an empty array), text, number, bool, array or object. source: the text
#: that the value is read as. media and links: its links by the canonical and by the platform's rule.
ENTRY = "struct<depth: int, key: string, name: string, value: string, kind: string, source: string, media: array<string>, links: array<string>, texts: array<string>>"
RECORD = f"entries array<{ENTRY}>, contact struct<names: array<string>, emails: array<string>, phones: array<string>>"


def _name(key: str) -> str:
    return re.sub("[^a-z0-9]", "", key.lower())


_WANTED = {_name(n) for names in [*FIELD_ALIASES.values(), *SOURCE_ALIASES.values(), *DOM_FIELDS.values(), LINK_KEYS] for n in names}
_MEDIA = {_name(n) for names in (FIELD_ALIASES["images"], SOURCE_ALIASES["images"], SOURCE_ALIASES["floorPlan"]) for n in names}
_FEATURES = {_name(n) for n in SOURCE_ALIASES["features"]}


def _number(text: str) -> int | float:
    """A number as a script holds it: a double, whole ones without a fraction."""
    x = float(text)
    return int(Decimal(repr(x))) if x.is_integer() and abs(x) < 1e21 else x


def _not_json(name: str):
    raise ValueError(name)


def _loaded(text: str | None) -> object:
    try:
        return json.loads(text, parse_float=_number, parse_int=_number, parse_constant=_not_json) if text else None
    except (ValueError, RecursionError):
        return None


def _told(x: object) -> str:
    """A value as text."""
    if isinstance(x, str):
        return x
    if isinstance(x, float):
        return format(Decimal(repr(x)), "f") if 1e-6 <= abs(x) < 1e-4 else re.sub(r"e([+-])0+", r"e\1", repr(x))
    return json.dumps(x, ensure_ascii=False)


def _source_text(x: object) -> str | None:
    """A text or a number as it is; the first filled one of an array; the distinct parts of an address object,
    joined; nothing for other objects, for false and for true."""
    if x is None or isinstance(x, bool):
        return None
    if isinstance(x, list):
        return next((t for v in x if (t := _source_text(v))), None)
    if isinstance(x, dict):
        return ", ".join(dict.fromkeys(t for k in ADDRESS_PARTS if (t := _source_text(x.get(k))))) or None
    return _told(x).strip() or None


def _media(x: object, depth: int = 0) -> list[str]:
    """Links of canonical pictures: texts, the link of an object, else all that it holds."""
    if x is None or depth > 7:
        return []
    if isinstance(x, str):
        return [x.strip()] if x.strip() else []
    if isinstance(x, list):
        return [u for v in x for u in _media(v, depth + 1)]
    if not isinstance(x, dict):
        return []
    direct = next((x[k] for k in ("url", "src", "href", "contentUrl") if x.get(k)), None)
    return [direct] if isinstance(direct, str) else [u for v in x.values() for u in _media(v, depth + 1)]


def _links(x: object, depth: int = 0) -> list[str]:
    """The same by the platform's rule: one more key, and an object's link may itself be nested."""
    if x is None or depth > 6:
        return []
    if isinstance(x, str):
        return [x.strip()] if x.strip() else []
    if isinstance(x, list):
        return [u for v in x for u in _links(v, depth + 1)]
    if not isinstance(x, dict):
        return []
    direct = next((x[k] for k in ("url", "src", "href", "contentUrl", "srcUrl") if x.get(k)), None)
    return _links(direct, depth + 1) if direct else [u for v in x.values() for u in _links(v, depth + 1)]


def _kind(x: object) -> str:
    if x is None or x == "":
        return "empty"
    if isinstance(x, list):
        return "array" if x else "none"
    return "text" if isinstance(x, str) else "bool" if isinstance(x, bool) else "object" if isinstance(x, dict) else "number"


def _visited(record: object) -> list[tuple]:
    """The wanted entries down to SOURCE_DEPTH, in the order of a search."""
    out, stack = [], [(record, 0)]
    while stack:
        node, depth = stack.pop()
        for key, x in node.items() if isinstance(node, dict) else ():
            if (name := _name(key)) in _WANTED:
                links = (_media(x), _links(x)) if name in _MEDIA else (None, None)
                texts = [t for v in x if isinstance(v, str) and (t := v.strip())] if name in _FEATURES and isinstance(x, list) else None
                out.append((depth, key, name, _told(x), _kind(x), _source_text(x), *links, texts))
        if depth < SOURCE_DEPTH:
            children = node.values() if isinstance(node, dict) else node
            stack += [(v, depth + 1) for v in reversed([*children]) if isinstance(v, (dict, list))]
    return out


def read_records(record: Column) -> Column:
    """Entries and public contacts of JSON records: struct of RECORD, from one parse."""

    @F.pandas_udf(RECORD)
    def run(texts: pd.Series) -> pd.DataFrame:
        loaded = [x if isinstance(x := _loaded(t), (dict, list)) else [] for t in texts]
        contacts = [dict(zip(("names", "emails", "phones"), _contacts(x), strict=True)) for x in loaded]
        return pd.DataFrame({"entries": [_visited(x) for x in loaded], "contact": contacts})

    return run(record)


def entry(found: Column, names: list[str], depth: int = ALIAS_DEPTH, empty_lists: bool = False) -> Column:
    """The first entry in ``found`` under any of ``names`` that is not empty."""
    wanted = sorted({_name(n) for n in names})
    usable = lambda e: e["name"].isin(wanted) & (e["depth"] <= depth) & (e["kind"] != "empty") & (F.lit(empty_lists) | (e["kind"] != "none"))
    return F.get(F.filter(found, usable), F.lit(0))


def alias(found: Column, names: list[str], depth: int = ALIAS_DEPTH, empty_lists: bool = False) -> Column:
    """Its value."""
    return entry(found, names, depth, empty_lists)["value"]


def _false(e: Column) -> Column:
    """Whether an entry's value counts as false."""
    return e["kind"].isin("empty") | (e["kind"].isin("number", "bool") & e["value"].isin("false", "0", "-0"))


def _own(found: Column, keys: list[str]) -> Column:
    """The first of ``keys``, by the record's own names, whose value counts as true."""
    at = lambda k: F.get(F.filter(found, lambda e: (e["depth"] == 0) & (e["key"] == k)), F.lit(0))
    return F.coalesce(*[F.when(~_false(at(k)), at(k)["value"]) for k in keys])


def _with_contacts(out: DataFrame, contact: Column) -> DataFrame:
    out = out.withColumn("contact", contact)
    first = lambda c: F.get(F.col("contact")[c], F.lit(0))
    some = lambda own, c: F.coalesce(filled(F.col(own)), first(c))
    out = out.withColumns({"agentName": some("agentName", "names"), "agentEmail": some("agentEmail", "emails"), "agentPhone": some("agentPhone", "phones")})
    return out.withColumn("agentContact", F.coalesce(filled(F.col("agentContact")), "agentEmail", "agentPhone"))


def normalise_records(df: DataFrame, raw: str = "raw", site_url: str = "site_url", keep_record: bool = False) -> DataFrame:
    """Adds the 23 canonical fields, sourceSiteUrl and contact (names, emails, phones) of the records in ``raw``.
    Links are made absolute as seen from _documentBaseUrl, else from ``site_url``. ``keep_record`` keeps
    what was read as ``_record``, so that ``platform_rows`` need not parse again."""
    df = df.withColumn("_record", read_records(F.col(raw))).withColumn("_site", F.col(site_url))
    found = F.col("_record.entries")
    own = {name: alias(found, names, 0 if name == "sourceUrl" else ALIAS_DEPTH) for name, names in FIELD_ALIASES.items()}
    media = entry(found, FIELD_ALIASES["images"])["media"]
    out = df.withColumns(own | {"images": media, "sourceSiteUrl": F.col("_site")})
    out = _with_contacts(out, F.col("_record.contact"))
    out = out.withColumn("_base", F.coalesce(_own(found, ["_documentBaseUrl"]), F.col("_site")))
    base = F.col("_base")
    route = F.when(F.coalesce(_own(found, ["search_type", "department"]), F.lit("")).rlike("(?i)rent|lett"), "to-rent").otherwise("for-sale")
    built = F.concat(F.lit("/property-"), route, F.lit("/"), _own(found, ["slug"]), F.lit("/"), _own(found, ["objectID", "strapi_id"]))
    images = F.array_distinct(F.filter(F.transform("images", lambda u: urls.absolute(u, base)), lambda u: u != ""))
    out = out.withColumn("sourceUrl", F.coalesce(filled(F.col("sourceUrl")), built))
    out = out.withColumns({"images": images, "sourceUrl": urls.absolute(F.col("sourceUrl"), base)})
    return out.drop("_site", "_base", *([] if keep_record else ["_record"]))


def normalise_dom(df: DataFrame, raw: str = "raw", site_url: str = "site_url", keep_record: bool = False) -> DataFrame:
    """The same for records read from a page's elements: a fixed list of own keys, where an empty text, zero
    and false count as missing."""
    df = df.withColumn("_record", read_records(F.col(raw))).withColumn("_site", F.col(site_url))
    found = F.col("_record.entries")
    out = df.withColumns({name: _own(found, keys) for name, keys in DOM_FIELDS.items()} | {"sourceSiteUrl": F.col("_site")})
    out = _with_contacts(out, F.col("_record.contact"))
    images = F.from_json(_own(found, ["images"]), "array<string>")
    pictures = F.filter(F.transform(images, lambda u: urls.absolute(u, F.col("_site"))), lambda u: u.isNotNull() & (u != ""))
    out = out.withColumns({"images": pictures, "sourceUrl": urls.absolute(_own(found, ["url"]), F.col("_site"))})
    return out.drop("_site", *([] if keep_record else ["_record"]))


def _with_entries(df: DataFrame) -> DataFrame:
    """Adds the entry of every platform source (_raw_*) and canonical field (_own_*) of ``_record``, each once."""
    found = F.col("_record.entries")
    # A search from the listing down meets the record twice: inside the listing first, there a level deeper.
    twice = lambda names: F.coalesce(entry(found, names, SOURCE_DEPTH - 2, True), entry(found, names, SOURCE_DEPTH - 1, True))
    nested = {"purpose", "currency", "priceText", "country", "postcode"}
    df = df.withColumns({f"_raw_{n}": twice(names) if n in nested else entry(found, names, SOURCE_DEPTH, True) for n, names in SOURCE_ALIASES.items()})
    own = [n for n in FIELD_ALIASES if n not in ("images", "sourceUrl")]
    return df.withColumns({f"_own_{n}": entry(found, FIELD_ALIASES[n]) for n in own})


def derive_platform(df: DataFrame) -> tuple[DataFrame, dict[str, Column]]:
    """Platform fields that follow from a canonical listing and the entries of its raw record, as Columns over the
    frame returned beside them: ``df`` with what several fields need. Four of the platform's fields have
    no source and are left out."""
    df = _with_entries(df)
    raw = lambda name: F.col(f"_raw_{name}")

    def own(name: str, what: str) -> Column:
        """A canonical field read as ``what``: by its kind where it is the record's own value, else as text."""
        e = F.col(f"_own_{name}")
        return F.when(F.coalesce(e["value"] == F.col(name), F.lit(False)), e[what]).otherwise(filled(F.col(name)) if what == "source" else F.lit("text"))

    text = lambda name, *names: F.coalesce(*([own(name, "source")] if name else []), *[raw(n)["source"] for n in names])

    def number(name: str | None, source: str) -> Column:
        plain = lambda kind: ~kind.isin("object", "bool")
        deep = F.when(plain(raw(source)["kind"]), numbers.first_number(raw(source)["value"]))
        return F.when(F.col(name).isNotNull(), F.when(plain(own(name, "kind")), numbers.first_number(F.col(name)))).otherwise(deep) if name else deep

    shared = {
        "_price": number("price", "price"), "_period": F.concat_ws(" ", F.coalesce("price", raw("price")["value"]), raw("period")["value"]), "_site_url": F.coalesce("sourceSiteUrl", "sourceUrl"),
        "_code": F.coalesce(filled(F.col("currency")), F.when(raw("currency")["kind"] == "text", raw("currency")["value"])), "_shown": F.coalesce(filled(F.col("price")), raw("priceText")["value"]),
        "_country": F.coalesce(filled(F.col("country")), raw("country")["value"]), "_postcode": F.coalesce(filled(F.col("postcode")), raw("postcode")["value"]),
    }
    df = df.withColumns(shared)
    price, period, site = F.col("_price"), F.col("_period"), F.col("_site_url")
    asked = raw("purpose")
    purpose = F.when(asked.isNull() | _false(asked), listing.purpose(site)).when(asked["kind"] == "text", listing.purpose(asked["value"]))
    links = lambda c: F.when(F.size(c) > 0, F.array_distinct(c))
    trimmed = F.filter(F.transform("images", lambda u: F.trim(u)), lambda u: u != "")
    return df, {
        "title": F.coalesce(text("title", "title"), own("address", "source")),
        "purpose": F.coalesce(purpose, F.lit("unknown")),
        "location": F.coalesce(own("address", "source"), own("city", "source"), raw("location")["source"]),
        "price": price,
        "images": F.when(F.col("images").isNotNull(), links(trimmed)).otherwise(links(raw("images")["links"])),
        "address": text("address", "address"),
        "city": text("city", "city"),
        "typeOfProperty": text("propertyType", "typeOfProperty"),
        "bedrooms": number("bedrooms", "bedrooms"),
        "bathrooms": number("bathrooms", "bathrooms"),
        "livingRoom": number(None, "livingRoom"),
        "size": text("sqft", "size"),
        "tenureOfProperty": text(None, "tenureOfProperty"),
        "description": text("description", "description"),
        "amount": price,
        "currency": listing.currency(F.col("_code"), F.col("_shown"), F.col("_country"), F.col("_postcode"), site),
        "add_features": F.when(F.size(raw("features")["texts"]) > 0, raw("features")["texts"]),
        "video_link": text(None, "video_link"),
        "virtual_tour_link": text(None, "virtual_tour_link"),
        "floorPlan": links(raw("floorPlan")["links"]),
        "PCM": F.when(period.rlike(r"(?i)\bpcm\b|per\s+month"), price),
        "PCW": F.when(period.rlike(r"(?i)\b(?:pcw|pw)\b|per\s+week"), price),
        "subType": text(None, "subType"),
    }


def system_defaults(source_url: Column) -> dict[str, Column]:
    """The fields that the platform owns; salesPlatform is the host of the source."""
    no, host = F.lit(False), F.nullif(urls.host(source_url), F.lit(""))
    return {"justAddedExpiration": no, "isPaid": no, "isSold": no, "salesPlatform": host, "isArchive": no, "profilePicture": F.lit(None).cast("string")}


def source_envelope(found: Column, raw: str = "raw") -> Column:
    """Where a platform row comes from: the listing's own fields, its contacts and its raw record."""
    one = lambda c: F.filter(F.array(F.col(c)), lambda x: x.isNotNull() & (x != ""))
    contact = {c: F.array_distinct(F.when(F.size(F.col("contact")[c]) > 0, F.col("contact")[c]).otherwise(one(own))) for c, own in (("names", "agentName"), ("emails", "agentEmail"), ("phones", "agentPhone"))}
    return F.struct(
        F.coalesce("id", alias(found, SOURCE_ALIASES["id"], SOURCE_DEPTH, True)).alias("id"),
        F.col("sourceUrl").alias("url"), F.col("sourceSiteUrl").alias("siteUrl"), "status", "postcode", "state", "country", "latitude", "longitude", "agentName",
        F.struct(*[c.alias(n) for n, c in contact.items()]).alias("contact"), F.col(raw).alias("raw"),
    )


def platform_rows(listings: DataFrame, raw: str = "raw", keys: tuple[str, ...] = ()) -> DataFrame:
    """``keys``, the platform's 27 fields, its own six and _source, of canonical ``listings``."""
    df = listings if "_record" in listings.columns else listings.withColumn("_record", read_records(F.col(raw)))
    df, derived = derive_platform(df)
    kind = {**dict.fromkeys(STRING_FIELDS, "string"), **dict.fromkeys(NUMBER_FIELDS, "double"), **dict.fromkeys(ARRAY_FIELDS, "array<string>")}
    fields = [derived.get(n, F.lit(None)).cast(t).alias(n) for n, t in kind.items()]
    system = [c.alias(n) for n, c in system_defaults(F.col("sourceSiteUrl")).items()]
    return df.select(*keys, *fields, *system, source_envelope(F.col("_record.entries"), raw).alias("_source"))
