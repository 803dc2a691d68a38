"""Keyed deduplication: one row for each key, its fields merged in input order.

``ord`` gives the input order; every aggregate carries it, so no shuffle changes a result. Partial
aggregation keeps scalar fields to one value a key and task.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StringType, StructType

from ..functions import urls
from ..functions.text import MERGE_NOISE

#: Id fields in the order in which they are asked.
KEY_FIELDS = ["property_id", "propertyId", "listing_id", "listingId", "id", "uuid", "url", "sourceUrl", "permalink"]


def record_key(columns: Sequence[str], raw: Column) -> Column:
    """The first id that is not null; an empty one stops the search and address with price decide;
    else the whole record does."""
    have = [F.col(c).cast("string") for c in KEY_FIELDS if c in columns]
    explicit = F.trim(F.coalesce(*have, F.lit(""))) if have else F.lit("")
    pick = lambda names: F.trim(F.coalesce(*[F.col(c).cast("string") for c in names if c in columns], F.lit("")))
    address = F.lower(pick(["addressWithCommas", "address", "displayAddress", "title"]))
    price = pick(["priceValue", "price"])
    key = F.when(urls.is_absolute(explicit), urls.dedupe_key(explicit)).otherwise(explicit)
    return F.when(explicit != "", key).when((address != "") | (price != ""), F.concat(address, F.lit("|"), price)).otherwise(raw)


def _column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def first_value(c: Column | str, order: Column | str) -> Column:
    """The first value that is not empty."""
    c, order = _column(c), _column(order)
    return F.min_by(c, F.when(c.isNotNull() & (c.cast("string") != ""), order))


def longest(c: Column | str, order: Column | str) -> Column:
    """The longest text, the first of several."""
    c, order = _column(c), _column(order)
    return F.max_by(c, F.when(c != "", F.struct(F.length(c), -order)))


def cleanest(c: Column | str, order: Column | str) -> Column:
    """The first text that is no page furniture, else the last one that is not empty."""
    c, order = _column(c), _column(order)
    good = F.min_by(c, F.when((c != "") & ~c.rlike(MERGE_NOISE), order))
    return F.coalesce(good, F.max_by(c, F.when(c != "", order)))


def cleanest_then_longest(c: Column | str, order: Column | str) -> Column:
    """For a name that both rules hold for: furniture gives way to what comes next, other texts to longer
    ones. What a text replaces depends on what came before, so a key's texts are gathered and folded in order."""
    c, order = _column(c), _column(order)
    texts = F.array_sort(F.collect_list(F.when(c != "", F.struct(order.alias("o"), c.alias("x")))))
    step = lambda kept, e: F.when(kept.isNull() | kept.rlike(MERGE_NOISE) | (F.length(e["x"]) > F.length(kept)), e["x"]).otherwise(kept)
    return F.aggregate(texts, F.lit(None).cast("string"), step)


def union_array(c: Column | str, order: Column | str) -> Column:
    """All values in order, each once; a lone array stays as it is."""
    c, order = _column(c), _column(order)
    full = F.when(F.size(c) > 0, F.struct(order.alias("o"), c.alias("a")))
    lists = F.transform(F.array_sort(F.collect_list(full)), lambda x: x["a"])
    return F.when(F.size(lists) == 1, F.get(lists, F.lit(0))).otherwise(F.array_distinct(F.flatten(lists)))


_CLEAN, _LONG = re.compile("title|name|headline|address|location", re.I), re.compile("description|details|summary|features", re.I)


def one_or_many(kind: DataType) -> bool:
    """Whether a type is struct<one, many>, which stands for a value that is a scalar in some records and
    an array in others."""
    return isinstance(kind, StructType) and kind.names == ["one", "many"] and isinstance(kind["many"].dataType, ArrayType)


def _scalar(c: Column, name: str, kind: DataType, order: Column) -> Column:
    if isinstance(kind, StringType):
        clean, long = _CLEAN.search(name), _LONG.search(name)
        rule = cleanest_then_longest if clean and long else cleanest if clean else longest if long else first_value
        return rule(c, order)
    return first_value(c, order)


def _merged_mixed(c: Column, name: str, kind: StructType, order: Column, first_array: Column) -> Column:
    """Scalars merge among themselves until the first array comes; from then on every value is an element
    of the union, the scalar kept so far first. ``first_array`` is the place of a key's first array."""
    before = first_array.isNull() | (order < first_array)
    kept = _scalar(F.when(before, c["one"]), name, kind["one"].dataType, order)
    some = lambda x: x.isNotNull() & (x.cast("string") != "")
    late = F.when(F.size(c["many"]) > 0, c["many"]).when(~before & some(c["one"]), F.array(c["one"]))
    lists = F.transform(F.array_sort(F.collect_list(F.when(late.isNotNull(), F.struct(order.alias("o"), late.alias("a"))))), lambda x: x["a"])
    head = F.when(kept.isNotNull(), F.array(F.array(kept))).otherwise(F.array().cast(ArrayType(kind["many"].dataType)))
    both = F.concat(head, lists)
    many = F.when(F.size(both) == 1, F.get(both, F.lit(0))).otherwise(F.array_distinct(F.flatten(both)))
    alone = F.max(first_array).isNull()
    return F.when(F.count(c) > 0, F.struct(F.when(alone, kept).alias("one"), F.when(~alone, many).alias("many")))


def _mixed_paths(kind: StructType, at: tuple[str, ...] = ()) -> list[tuple[str, ...]]:
    found = []
    for f in kind.fields:
        if one_or_many(f.dataType):
            found.append((*at, f.name))
        elif isinstance(f.dataType, StructType):
            found += _mixed_paths(f.dataType, (*at, f.name))
    return found


def _at(path: tuple[str, ...]) -> Column:
    c = F.col(f"`{path[0]}`")
    for name in path[1:]:
        c = c[name]
    return c


def merge_by_key(df: DataFrame, key: str, order: str = "ord") -> DataFrame:
    """One row a key, in columns of ``df``; fields are merged by what their names say of them.

    Null, an empty text and an empty array lose to any value. Arrays are united in order. Structs are merged
    field by field at any depth, each field by its own name; a struct that is null in all rows stays null.
    struct<one, many> stands for a value that may be a scalar or an array. Scalars are one value a key and
    task through the shuffle; only arrays are gathered, and texts whose name both text rules hold for.
    """
    mixed = [p for p in _mixed_paths(df.schema) if p[0] not in (key, order)]
    firsts = {p: f"_first_array_{i}" for i, p in enumerate(mixed)}
    if mixed:  # the keys that have an array anywhere, and where
        place = [F.min(F.when(F.size(_at(p)["many"]) > 0, F.col(order))).alias(firsts[p]) for p in mixed]
        told = df.groupBy(F.col(key).alias("_key")).agg(*place).where(F.coalesce(*[F.col(c) for c in firsts.values()]).isNotNull())
        df = df.join(told, F.col(key).eqNullSafe(F.col("_key")), "left").drop("_key")

    def merged(c: Column, name: str, kind: DataType, path: tuple[str, ...]) -> Column:
        if isinstance(kind, ArrayType):
            return union_array(c, F.col(order))
        if path in firsts:
            return _merged_mixed(c, name, kind, F.col(order), F.col(firsts[path]))
        if isinstance(kind, StructType):
            fields = [merged(c[f.name], f.name, f.dataType, (*path, f.name)).alias(f.name) for f in kind.fields]
            return F.when(F.count(c) > 0, F.struct(*fields))
        return _scalar(c, name, kind, F.col(order))

    skip = {key, order, *firsts.values()}
    out = [merged(F.col(f"`{f.name}`"), f.name, f.dataType, (f.name,)).alias(f.name) for f in df.schema.fields if f.name not in skip]
    return df.groupBy(key).agg(F.min(order).alias(order), *out)


def merged_pair(old: Column, new: Column, kind: DataType, name: str = "") -> Column:
    """The merge of two values of one row, ``old`` first: what ``merge_by_key`` makes of two rows."""
    if isinstance(kind, ArrayType):
        both = F.array_distinct(F.concat(old, new))
        return F.when(F.coalesce(F.size(new), F.lit(-1)) < 1, old).when(F.coalesce(F.size(old), F.lit(-1)) < 1, new).otherwise(both)
    if one_or_many(kind):
        item, full = kind["one"].dataType, lambda x: F.coalesce(F.size(x["many"]) > 0, F.lit(False))
        none = lambda x: ~full(x) & F.coalesce(x["one"].cast("string") == "", F.lit(True))
        listed = lambda x: F.when(full(x), x["many"]).otherwise(F.array(x["one"]))
        one, many = merged_pair(old["one"], new["one"], item, name), F.array_distinct(F.concat(listed(old), listed(new)))
        scalars = F.struct(one.alias("one"), F.lit(None).cast(kind["many"].dataType).alias("many"))
        arrays = F.struct(F.lit(None).cast(item).alias("one"), many.alias("many"))
        return F.when(none(new), old).when(none(old), new).when(full(old) | full(new), arrays).otherwise(scalars)
    if isinstance(kind, StructType):
        fields = F.struct(*[merged_pair(old[f.name], new[f.name], f.dataType, f.name).alias(f.name) for f in kind.fields])
        return F.when(new.isNull(), old).when(old.isNull(), new).otherwise(fields)
    empty = lambda x: F.coalesce(x.cast("string") == "", F.lit(True))
    kept = old
    if isinstance(kind, StringType) and _LONG.search(name):
        kept = F.when(F.length(new) > F.length(old), new).otherwise(kept)
    if isinstance(kind, StringType) and _CLEAN.search(name):
        kept = F.when(old.rlike(MERGE_NOISE), new).otherwise(kept)
    return F.when(empty(old), new).when(empty(new), old).otherwise(kept)


def last_wins(df: DataFrame, keys: Sequence[str], order: str = "ord") -> DataFrame:
    """The last row of each key at the place of its first."""
    rest = [c for c in df.columns if c not in (*keys, order)]
    kept = df.groupBy(*keys).agg(F.min(order).alias(order), F.max_by(F.struct(*rest), F.col(order)).alias("_row"))
    return kept.select(*keys, order, "_row.*")


def best_wins(df: DataFrame, keys: Sequence[str], score: str, order: str = "ord") -> DataFrame:
    """The row with the highest score of each key, the first of several."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(F.col(score), -F.col(order))).alias("_row")).select(*keys, "_row.*")


def ordered_unique(df: DataFrame, value: str, order: Sequence[str], cap: int | None = None) -> DataFrame:
    """Distinct values at the place of their first occurrence; ``cap`` keeps the first so many."""
    firsts = df.groupBy(value).agg(F.min(F.struct(*order)).alias("_first"))
    out = firsts.select(value, "_first.*").orderBy(*order, value)
    return out.limit(cap) if cap else out
