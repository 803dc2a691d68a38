"""Brute force over all item-sized windows, and edge rows."""

import random
from collections import Counter

import pytest

from gleaner.llm.decontamination import ItemIndex, drop_leaks, find_leaks
from gleaner.llm.common import words_of


def _brute(text, items, k=5, least=0.8):
    words, best = words_of(text), {}
    for item_id, item in items:
        own = words_of(item)
        size = min(k, len(own))
        count = lambda w: Counter(tuple(w[i:i + size]) for i in range(len(w) - size + 1))
        for s in range(len(words) - len(own) + 1):
            a, b = count(words[s:s + len(own)]), count(own)
            sim = (a & b).total() / (a | b).total()
            if own and sim >= least and sim > best.get(item_id, (0,))[0]:
                best[item_id] = (sim, s)
    return {(i, s, round(sim, 9)) for i, (sim, s) in best.items()}


@pytest.mark.parametrize("seed", range(6))
def test_all_windows_within_similarity_are_found(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(3, 60))).encode()) for i in range(30)]
    index = ItemIndex(items)
    for _ in range(25):
        parts = []
        for _ in range(3):
            parts += rng.choices(vocabulary, k=rng.randint(0, 40))
            leak = rng.choice(items)[1].decode().split()
            for _ in range(rng.choice([0, 1, 1, 2])):  # a word changed near an end keeps the similarity
                leak[rng.choice([0, -1, 1, rng.randrange(len(leak))])] = "changed"
            parts += leak
        text = " ".join(parts).encode()
        assert {(i, s, round(x, 9)) for i, s, _, x in index.search(text)} == _brute(text, items)


def test_edges(spark):
    item = " ".join(f"a{i}" for i in range(20))
    rows = [(1, None), (2, ""), (3, f"x {item.upper()} y"), (None, item), (5, "a1 a2 a3 a4 a5"), (3, "x")]
    docs = spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame([(7, item), (7, item), (8, None), (9, "")], "item_id long, text string")
    found = find_leaks(docs, bench).collect()
    assert sorted((r.doc_id or 0, r.item_id, r.first_word, r.similarity) for r in found) == [(0, 7, 0, 1.0), (3, 7, 1, 1.0)]
    kept = drop_leaks(docs, bench)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, r.text or "") for r in kept.collect()) == [(1, ""), (2, ""), (3, "x"), (5, "a1 a2 a3 a4 a5")]
    more = docs.selectExpr("*", "1 AS _row", "2 AS _digest", "3 AS id")
    assert drop_leaks(more, bench).columns == more.columns and drop_leaks(more, bench).count() == 4
    assert drop_leaks(docs, bench.limit(0)).count() == 6
    assert find_leaks(docs, bench.limit(0)).count() == 0
    assert find_leaks(docs.limit(0), bench).count() == 0


def test_very_long_text_and_ties(spark):
    item = " ".join(f"a{i}" for i in range(20))
    long = " ".join(f"x{i}" for i in range(50_000))
    docs = spark.createDataFrame([(1, f"{long} {item} {long}"), (2, f"{item} {item}"), (3, long)], "doc_id long, text string")
    bench = spark.createDataFrame([(7, item), (8, item)], "item_id long, text string")
    found = sorted((r.doc_id, r.item_id, r.first_word) for r in find_leaks(docs, bench).collect())
    assert found == [(1, 7, 50_000), (1, 8, 50_000), (2, 7, 0), (2, 8, 0)]  # the first of equal windows, every item
    assert [r.doc_id for r in drop_leaks(docs, bench).collect()] == [3]
