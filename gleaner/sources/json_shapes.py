"""Record sets inside JSON: balanced scan, property-shape scores, paths, candidates, contacts, redaction.

These walk free-form JSON in key order, which a variant does not keep, so they run on the text in
Arrow batches. Malformed JSON gives no rows and never fails a batch.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Names of fields that tell a property listing, by what they tell.
FIELD_GROUPS = [
    ["price", "pricevalue", "listprice", "list_price", "askingprice", "asking_price"],
    ["bedrooms", "beds", "bedroomcount", "numbedrooms", "no_of_bedrooms"],
    ["bathrooms", "baths", "bathroomcount", "numbathrooms"],
    ["address", "addresswithcommas", "address_with_commas", "displayaddress", "display_address", "street", "streetaddress", "street_address", "location"],
    ["sqft", "squarefeet", "square_feet", "floorarea", "floor_area", "size"],
    ["propertytype", "property_type", "type", "listingtype"],
    ["images", "photos", "photo", "photosquare", "propertyindexphotos", "media", "gallery"],
    ["description", "shortdescription", "short_description", "summary", "details"],
    ["title", "friendly_str", "displayaddress", "display_address", "addresswithcommas", "address_with_commas", "name", "headline"],
    ["url", "href", "permalink", "link", "detailurl", "detail_url", "property_url"],
    ["id", "listingid", "listing_id", "propertyid", "property_id", "slug", "uuid"],
]
# Keys of personal data; singular and plural, with and without what they belong to.
PERSONAL_KEYS = {
    "sellerfullname", "selleremail", "sellerphone", "sellerfulladdress", "sellerdob", "agentcontact", "agentemail",
    "agentphone", "agentmobile", "email", "emails", "phone", "phones", "telephone", "mobile", "contact", "contacts", "dob", "dateofbirth",
    "birthdate", "branchemail", "branchphone", "officeemail", "officephone", "contactemail", "contactphone", "pagecontact",
}
XSSI = r"^\)\]\}',?\s*"
MAX_DEPTH = 8
EMAIL, PHONE = re.compile(r"[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}", re.I), re.compile(r"(?:\+\s?\d{1,3}[\s().-]*)?(?:\d[\s().-]*){7,15}")


def balanced(text: str, start: int = 0) -> str | None:
    """The first bracketed value from ``start`` on, up to its own closing bracket, quotes respected."""
    m = re.search(r"[{\[]", text[start:])
    if not m:
        return None
    first = start + m.start()
    opener = text[first]
    closer, depth, at = "}" if opener == "{" else "]", 0, first
    token = re.compile(rf"\\.|[\"'`]|{re.escape(opener)}|{re.escape(closer)}", re.S)
    quote = None
    while m := token.search(text, at):
        t, at = m.group(), m.end()
        if t[0] == "\\":
            continue
        if quote:
            quote = None if t == quote else quote
        elif t in "\"'`":
            quote = t
        else:
            depth += 1 if t == opener else -1
            if not depth:
                return text[first:at]
    return None


def shape_score(record: object) -> int:
    """How many groups of fields a record has."""
    keys = {str(k).lower() for k in record} if isinstance(record, dict) else set()
    return sum(any(k in keys for k in group) for group in FIELD_GROUPS)


def best_records(value: object) -> tuple[int, str, list[dict]]:
    """(score, path, records) of the array or object that looks most like listings; the first of several.
    An array is told by its first object."""
    best: tuple[int, str, list[dict]] = (0, "", [])
    stack: list[tuple[object, str]] = [(value, "")]
    while stack:
        node, path = stack.pop()
        if isinstance(node, list):
            records = [x for x in node if isinstance(x, dict)]
            if records and shape_score(records[0]) > best[0]:
                best = (shape_score(records[0]), path or "(root array)", records)
            children = [(x, f"{path}[{i}]") for i, x in enumerate(node) if isinstance(x, (dict, list))][:1]
        elif isinstance(node, dict):
            if shape_score(node) > best[0]:
                best = (shape_score(node), path or "(root object)", [node])
            children = [(x, f"{path}.{k}" if path else str(k)) for k, x in node.items() if isinstance(x, (dict, list))]
        else:
            children = []
        stack.extend(reversed(children))
    return best


def _load(text: str | None) -> object:
    try:
        return json.loads(re.sub(XSSI, "", text)) if text else None
    except (ValueError, RecursionError):
        return None


def candidates(payloads: DataFrame, key: str, body: str, least: int = 4) -> DataFrame:
    """(key, score, path, n, ord, raw): the records of each payload's best set, ``least`` groups or more."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for k, text in zip(rows["k"], rows["body"]):
                score, path, records = best_records(_load(text))
                if score >= least:
                    out += [(k, score, path, len(records), i, json.dumps(r, ensure_ascii=False)) for i, r in enumerate(records)]
            yield pd.DataFrame(out, columns=["k", "score", "path", "n", "ord", "raw"])

    kind = dict(payloads.dtypes)[key]
    rows = payloads.select(F.col(key).alias("k"), F.col(body).alias("body"))
    return rows.mapInPandas(run, f"k {kind}, score int, path string, n int, ord int, raw string").withColumnRenamed("k", key)


def rank_sets(found: DataFrame, keys: list[str]) -> DataFrame:
    """The best candidate set of each key: score, then size, then the shorter path."""
    w = Window.partitionBy(*keys).orderBy(F.desc("score"), F.desc("n"), F.length("path"), "path")
    return found.where("ord = 0").withColumn("rank", F.row_number().over(w)).where("rank = 1").drop("rank")


def flat_shape_score(text):
    """Score of a JSON object's own keys as a Column, without a Python worker."""
    keys = F.transform(F.json_object_keys(text), F.lower)
    score = F.lit(0)
    for group in FIELD_GROUPS:
        score = score + F.coalesce(F.arrays_overlap(keys, F.array(*map(F.lit, group))), F.lit(False)).cast("int")
    return score


def _redacted(x: object, depth: int = 0) -> object:
    if depth > MAX_DEPTH:
        return None
    if isinstance(x, dict):
        return {k: _redacted(v, depth + 1) for k, v in x.items() if re.sub("[^a-z0-9]", "", k.lower()) not in PERSONAL_KEYS}
    if isinstance(x, list):
        return [_redacted(v, depth + 1) for v in x[:30]]
    return PHONE.sub("[phone]", EMAIL.sub("[email]", x))[:12_000] if isinstance(x, str) else x


def redact(text):
    """A JSON text without personal data at any depth; null where it is no JSON."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if (x := _load(t)) is None else json.dumps(_redacted(x), ensure_ascii=False))

    return run(text)


def _contacts(value: object) -> tuple[list[str], list[str], list[str]]:
    names: dict[str, None] = {}
    emails: dict[str, None] = {}
    phones: dict[str, None] = {}
    stack: list[tuple[object, str, int]] = [(value, "", 0)]
    while stack:
        node, path, depth = stack.pop()
        if node is None or depth > MAX_DEPTH:
            continue
        if isinstance(node, (dict, list)):
            pairs = node.items() if isinstance(node, dict) else enumerate(node)
            stack.extend(reversed([(v, f"{path}.{re.sub('[^a-z0-9]', '', str(k).lower())}", depth + 1) for k, v in pairs]))
            continue
        text, key = str(node), path.rsplit(".", 1)[-1]
        about = re.search("agent|agency|branch|office|broker|negotiator|contact|seller|vendor|listedby|provider", path)
        coded = re.search("(?:id|code|ref)$", key)
        if about and not coded and re.search("name$|^(?:agent|agency|branch|office|broker|negotiator|listedby|provider)$", key) and re.search("[a-z]", text, re.I) and "@" not in text:
            names.setdefault(text.strip())
        if m := EMAIL.search(text):
            emails.setdefault(m[0].lower())
        if re.search("phone|telephone|mobile|tel|voxnumber", key) or "tel:" in text.lower() or (about and not coded and re.search(r"\+?\d[\d\s().-]{6,}", text)):
            m = PHONE.search(re.sub("^tel:", "", text, flags=re.I).strip())
            if m and 7 <= sum(c.isdigit() for c in m[0]) <= 15:
                phones.setdefault(" ".join(m[0].split()))
    return [*names], [*emails], [*phones]


def public_contacts(text):
    """Names, emails and phones in a JSON record, in its own order."""

    @F.pandas_udf("names array<string>, emails array<string>, phones array<string>")
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_contacts(_load(t)) for t in texts], columns=["names", "emails", "phones"])

    return run(text)


def alias_value(text, aliases: list[str], depth: int = 5):
    """The first value that is not empty under any of the names, own keys first, then deeper ones."""
    wanted = {re.sub("[^a-z0-9]", "", a.lower()) for a in aliases}

    def find(x: object, left: int) -> object:
        if not isinstance(x, (dict, list)) or left < 0:
            return None
        pairs = [*x.items()] if isinstance(x, dict) else [*enumerate(x)]
        for k, v in pairs:
            if re.sub("[^a-z0-9]", "", str(k).lower()) in wanted and v not in (None, "", []):
                return v
        return next((y for _, v in pairs if (y := find(v, left - 1)) is not None), None)

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if (y := find(_load(t), depth)) is None else y if isinstance(y, str) else json.dumps(y, ensure_ascii=False))

    return run(text)
