"""Suffix sorting and repeated passages against brute force."""

import hashlib
import random

import numpy as np
import pytest

from gleaner.llm.suffix_dedup import LENGTH, anchors, suffix_dedup, suffix_order


@pytest.mark.parametrize("seed", range(8))
def test_suffixes_are_in_order(seed):
    rng = random.Random(seed)
    for n in (0, 1, 2, 3, 4, 5, 7, 50, 301):
        s = np.array([rng.randint(1, rng.choice([1, 2, 5, 250])) for _ in range(n)], np.int64)
        if n > 100 and seed % 2:
            s = np.tile(s[:70], 5)
        order = suffix_order(s).tolist()
        assert sorted(order) == list(range(len(s)))
        cut = [s[i:i + LENGTH].tolist() for i in order]
        assert cut == sorted(cut)


def test_equal_strings_have_equal_anchors():
    rng = random.Random(1)
    for shared in (rng.randbytes(LENGTH), b"ab" * 25, b"a" * LENGTH):
        a, b = rng.randbytes(77) + shared + rng.randbytes(30), shared + rng.randbytes(90)
        for t, at in ((a, 77), (b, 0)):
            starts = [s for _, x, y in zip(*anchors(t)) for s in range(x, y + 1)]
            assert starts == list(range(len(t) - LENGTH + 1))
        one, two = ([h for h, x, y in zip(*anchors(t)) if x <= at <= y] for t, at in ((a, 77), (b, 0)))
        assert one == two


def brute(rows):
    out = []
    first = {}
    for doc, text in rows:
        t = (text or "").encode()
        for i in range(len(t) - LENGTH + 1):
            s = t[i:i + LENGTH]
            first[s] = min(first.get(s, 1 << 63), (1 << 63) - 1 if doc is None else doc)
    for doc, text in rows:
        t = (text or "").encode()
        gone = [False] * len(t)
        for i in range(len(t) - LENGTH + 1):
            if first[t[i:i + LENGTH]] < ((1 << 63) - 1 if doc is None else doc):
                gone[i:i + LENGTH] = [True] * LENGTH
        runs = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((doc, len(t), sum(gone), runs, hashlib.sha256(bytes(c for c, g in zip(t, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


def _rows(seed):
    rng = random.Random(seed)
    letters = "ab" if seed == 2 else "abcdefgh äö"
    passages = ["".join(rng.choices(letters, k=rng.randint(40, 200))) for _ in range(6)] + ["xyz" * 40, "a" * 120]
    rows = [(None, passages[0] + "tail" * 20), (None, "short"), (3, None), (4, ""), (5, "ä" * 60), (6, "ä" * 60)]
    for i in range(60):
        text = "".join(rng.choice(passages)[rng.randint(0, 20):] if rng.random() < 0.6 else "".join(rng.choices(letters, k=rng.randint(0, 90))) for _ in range(4))
        rows += [(rng.randint(0, 50), text)] * rng.choice([1, 1, 1, 2])
    return rows


@pytest.mark.parametrize("hot", [False, True])
@pytest.mark.parametrize("seed", [1, 2])
def test_spans_against_brute_force(spark, seed, hot, monkeypatch):
    from gleaner.llm import suffix_dedup as m

    monkeypatch.setattr(m, "ANCHORS_PER_BUCKET", 200)
    monkeypatch.setattr(m, "CONTEXT_BYTES_PER_BUCKET", 8000)
    if hot:
        monkeypatch.setattr(m, "LEAST_HOT", 4)
    rows = _rows(seed)
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, doc long").repartition(4)
    got = sorted((tuple(r) for r in suffix_dedup(docs).collect()), key=str)
    assert got == brute(rows)
    if not hot and seed == 1:
        kept = {(r.doc_id, r.text) for r in m.drop_repeats(docs).collect()}
        assert (5, "ä" * 60) in kept and (6, "") in kept and len(kept) > 10


def test_empty(spark):
    assert suffix_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_cut_texts_keep_clashing_columns(spark):
    from gleaner.llm.suffix_dedup import drop_repeats

    docs = spark.createDataFrame([(1, "abc" * 30, 4), (2, "abc" * 30, 4), (None, "d", 4)], "doc_id long, text string, _doc int").selectExpr("*", "5 AS _tag", "6 AS _spans")
    got = drop_repeats(docs)
    assert got.columns == docs.columns
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, [(1, "abc" * 30, 4, 5, 6), (2, "", 4, 5, 6), (None, "d", 4, 5, 6)]))
