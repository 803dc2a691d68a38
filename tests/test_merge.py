"""Merging nested records against an ordered fold over plain Python values."""

import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gleaner.operators import merge

NOISE = re.compile(r"^(?:load|show|view)\s+(?:previous|next|more|items|results)|\.st\d+\s*\{|fill\s*:|<svg|@keyframes", re.I)


def unique(values):
    out = []
    for v in values:
        if v not in out:
            out.append(v)
    return out


def fold(old, new, key=""):
    """One step of the merge, on dicts, lists and scalars."""
    if old in (None, "", []):
        return new
    if new in (None, "", []):
        return old
    if isinstance(old, list) or isinstance(new, list):
        return unique((old if isinstance(old, list) else [old]) + (new if isinstance(new, list) else [new]))
    if isinstance(old, dict) and isinstance(new, dict):
        return {**old, **{k: fold(old.get(k), v, k) for k, v in new.items()}}
    texts = isinstance(old, str) and isinstance(new, str)
    if re.search("title|name|headline|address|location", key, re.I) and texts and NOISE.search(old):
        return new
    if re.search("description|details|summary|features", key, re.I) and texts and len(new) > len(old):
        return new
    return old


TEXT = st.sampled_from([None, "", "a", "bb", "Show more", "view items x", "ccc", " "])
LIST = st.one_of(st.none(), st.lists(st.sampled_from(["a", "b", "a b"]), max_size=3))
NOTES = st.one_of(TEXT, LIST)
RECORD = st.fixed_dictionaries({
    "id": st.sampled_from(["k", "l", None]), "price": st.one_of(st.none(), st.integers(0, 3)), "summaryTitle": TEXT, "images": LIST, "notes": NOTES,
    "contact": st.one_of(st.none(), st.fixed_dictionaries({
        "name": TEXT, "description": TEXT, "emails": LIST, "office": st.one_of(st.none(), st.fixed_dictionaries({"phone": TEXT, "location": TEXT, "ways": NOTES})),
    })),
})
SCHEMA = """ord long, id string, price long, summaryTitle string, images array<string>, notes struct<one: string, many: array<string>>,
 contact struct<name: string, description: string, emails: array<string>, office: struct<phone: string, location: string, ways: struct<one: string, many: array<string>>>>"""


def mixed(v):
    return None if v is None else (None, v) if isinstance(v, list) else (v, None)


def row(i, r):
    c = r["contact"]
    o = c and c["office"]
    contact = c and (c["name"], c["description"], c["emails"], o and (o["phone"], o["location"], mixed(o["ways"])))
    return i, r["id"], r["price"], r["summaryTitle"], r["images"], mixed(r["notes"]), contact


def plain(v):
    """Nothing, an empty text, an empty list and a record of such are the same."""
    if isinstance(v, dict):
        if set(v) == {"one", "many"}:
            return plain(v["many"]) or plain(v["one"])
        return {k: x for k, y in v.items() if (x := plain(y)) is not None} or None
    return v if v not in ("", []) else None


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(RECORD, min_size=1, max_size=8), st.integers(1, 3))
def test_nested_merge_is_an_ordered_fold(spark, records, slices):
    df = spark.createDataFrame([row(i, r) for i, r in enumerate(records)], SCHEMA).repartition(slices)
    got = {r["id"]: plain({k: v for k, v in r.asDict(True).items() if k not in ("id", "ord")}) for r in merge.merge_by_key(df, "id").collect()}
    want = {}
    for r in records:
        rest = {k: v for k, v in r.items() if k != "id"}
        want[r["id"]] = fold(want[r["id"]], rest) if r["id"] in want else rest
    assert got == {k: plain(v) for k, v in want.items()}


def test_lone_array_keeps_its_repeats_and_a_scalar_joins_a_later_array(spark):
    df = spark.createDataFrame([(0, "k", (None, ["a", "a"])), (1, "l", ("x", None)), (2, "l", ("y", None)), (3, "l", (None, ["x", "z"])), (4, "l", ("z", None)), (5, "l", ("w", None))], "ord long, id string, v struct<one: string, many: array<string>>")
    got = {r["id"]: (r["v"]["one"], r["v"]["many"]) for r in merge.merge_by_key(df, "id").collect()}
    assert got == {"k": (None, ["a", "a"]), "l": (None, ["x", "z", "w"])}


@pytest.mark.parametrize("n", [1, 3])
def test_struct_that_is_null_in_all_rows_stays_null(spark, n):
    df = spark.createDataFrame([(i, "k", None) for i in range(n)], "ord long, id string, c struct<a: string>")
    assert merge.merge_by_key(df, "id").where(F.col("c").isNull()).count() == 1
    assert merge.merge_by_key(df.limit(0), "id").count() == 0


def test_names_of_columns_may_hold_dots(spark):
    df = spark.createDataFrame([(1, "k", "x"), (0, "k", "")], ["ord", "id", "a.b"])
    assert merge.merge_by_key(df, "id").collect()[0]["a.b"] == "x"
