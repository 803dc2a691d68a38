"""Mapping recipes: a host's rules from source paths to platform fields, compiled to one select.

A recipe names, for each field, a path or a fixed value and a transform out of a closed registry.
Each path is read from a variant column that is parsed once a row.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import listing, numbers, text
from .batch import numbered
from .quality import ARRAY_FIELDS, NUMBER_FIELDS, STRING_FIELDS

VERSION = 2


def _text(x: Column) -> Column:
    return F.try_variant_get(x, "$", "string")


def extract_urls(json_text: Column) -> Column:
    """Every http link in a JSON value, in order, each once."""
    return F.array_distinct(F.regexp_extract_all(json_text, F.lit(r'(https?://[^\s"\\]+)'), F.lit(1)))


#: Name -> builder of a Column from (variant, arguments).
TRANSFORMS = {
    "stripHtml": lambda x, args: text.strip_html(_text(x)),
    "purposeMap": lambda x, args: listing.purpose_map(_text(x), args),
    "extractUrls": lambda x, args: extract_urls(F.to_json(x)),
    "appendUnit": lambda x, args: numbers.append_unit(numbers.whole_number(_text(x)), args.get("unit", "")),
    "titleCase": lambda x, args: text.title_case(_text(x)),
    "joinAddress": lambda x, args: F.nullif(F.concat_ws(args.get("separator", ", "), *[text.filled(F.try_variant_get(x, f"$.{k}", "string")) for k in args.get("keys", [])], *([] if args.get("keys") else [_text(x)])), F.lit("")),
    "toNumber": lambda x, args: numbers.to_number(_text(x)),
    "firstElement": lambda x, args: F.coalesce(F.try_variant_get(x, "$[0]", "string"), _text(x)),
    "currencyFromSymbol": lambda x, args: listing.currency_from_symbol(_text(x)),
    "propertyTypeFromText": lambda x, args: listing.property_type(_text(x)),
}


@dataclass
class Recipe:
    host: str
    fields: dict[str, dict] = field(default_factory=dict)
    confidence: float = 0.0
    version: int | None = None
    reviewed: bool = False
    warnings: list[str] = field(default_factory=list)

    @property
    def fresh(self) -> bool:
        return self.version == VERSION or self.reviewed

    @classmethod
    def parse(cls, host: str, raw: dict) -> Recipe:
        """Keeps known fields and transforms; what is unknown is dropped with a warning."""
        out = cls(host, confidence=float(raw.get("confidence") or 0), version=raw.get("version"), reviewed=bool(raw.get("reviewed")))
        for name, spec in (raw.get("mappings") or raw.get("fields") or {}).items():
            if name not in STRING_FIELDS + NUMBER_FIELDS + ARRAY_FIELDS:
                out.warnings.append(f"unknown field {name}")
            elif spec:
                spec = {"path": spec} if isinstance(spec, str) else dict(spec)
                if spec.get("transform") and spec["transform"] not in TRANSFORMS:
                    out.warnings.append(f"unknown transform {spec.pop('transform')} for {name}")
                out.fields[name] = spec
        return out


def coerce(value: Column, name: str, kind: str) -> Column:
    """A mapped value in its field's type; texts for numbers count as a whole or not at all."""
    if name in ARRAY_FIELDS:
        return value if kind == "array" else F.when(value.isNotNull(), F.array(value.cast("string")))
    if name in NUMBER_FIELDS:
        return value if kind == "double" else numbers.whole_number(value)
    return numbers.number_text(value) if kind == "double" else F.array_join(value, ", ") if kind == "array" else text.filled(value)


_KIND = {"toNumber": "double", "extractUrls": "array"}


_TYPES = {**dict.fromkeys(STRING_FIELDS, "string"), **dict.fromkeys(NUMBER_FIELDS, "double"), **dict.fromkeys(ARRAY_FIELDS, "array<string>")}


def mapped_columns(recipe: Recipe, parsed: str = "_v") -> dict[str, Column]:
    """The recipe's fields as Columns over a record's variant, and mapping_confidence. A fixed value wins over
    a path, purpose is put in its own words, and a currency needs three capitals."""
    out = {}
    for name, kind in _TYPES.items():
        spec = recipe.fields.get(name)
        if not spec:
            out[name] = F.lit(None).cast(kind)
        elif spec.get("value") is not None:
            out[name] = coerce(F.lit(spec["value"]).cast("string"), name, "string")
        else:
            at = F.try_variant_get(parsed, f"$.{spec['path']}" if not spec["path"].startswith("[") else f"${spec['path']}", "variant")
            t = spec.get("transform")
            out[name] = coerce(TRANSFORMS[t](at, spec.get("args") or {}) if t else extract_urls(F.to_json(at)) if name in ARRAY_FIELDS else _text(at), name, _KIND.get(t, "array" if name in ARRAY_FIELDS and not t else "string"))
    if "purpose" in recipe.fields:
        out["purpose"] = F.when(out["purpose"].isin("sale", "rent", "short-let", "unknown"), out["purpose"]).otherwise(listing.purpose(out["purpose"]))
    out["currency"] = F.when(F.upper(out["currency"]).rlike("^[A-Z]{3}$"), F.upper(out["currency"]))
    return out | {"mapping_confidence": F.lit(float(recipe.confidence if recipe.fresh else min(recipe.confidence, 0.6)))}


def apply_recipe(df: DataFrame, recipe: Recipe, raw: str = "raw") -> DataFrame:
    """``df`` with the recipe's fields; others are null. Null or broken JSON gives nulls."""
    return df.withColumn("_v", F.try_parse_json(raw)).withColumns(mapped_columns(recipe)).drop("_v")


def apply_recipes(df: DataFrame, recipes: list[Recipe], host: str = "host", raw: str = "raw") -> tuple[DataFrame, DataFrame]:
    """(mapped rows, rows of hosts without a recipe). One scan and one parse for all hosts: a field is the
    expression of its row's host, so their number bounds the plan, not the data. Null hosts have no recipe."""
    if not recipes:
        return df.limit(0), df
    known = F.coalesce(F.col(host).isin([r.host for r in recipes]), F.lit(False))
    compiled = [(F.col(host) == r.host, mapped_columns(r)) for r in recipes]
    fields = {}
    for name in [*_TYPES, "mapping_confidence"]:
        told = [(at, columns[name]) for (at, columns), r in zip(compiled, recipes, strict=True) if name in r.fields or name == "mapping_confidence"]
        value = F.coalesce(*[F.when(at, c) for at, c in told]) if told else F.lit(None).cast(_TYPES[name])
        fields[name] = value
    mapped = df.where(known).withColumn("_v", F.try_parse_json(raw)).withColumns(fields).drop("_v")
    return mapped, df.where(~known)


def even_sample(df: DataFrame, order: list[str], n: int = 8) -> DataFrame:
    """``n`` rows at even steps from the first to the last, all rows if there are no more than ``n``.

    Rows are numbered through ranges of ``order`` and only the chosen numbers are kept."""
    total = df.count()
    if total <= n:
        return df
    wanted = sorted({int(i * (total - 1) / (n - 1) + 0.5) for i in range(n)})
    numbered = with_row_numbers(df, order)
    return numbered.where(F.col("row_number").isin(wanted)).drop("row_number")


def with_row_numbers(df: DataFrame, order: list[str]) -> DataFrame:
    """Adds row_number from 0 in ``order``."""
    return numbered(df, [], order, "row_number")
