import random
import re
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gleaner.llm import phrases


def brute(rows, least, first):
    """All counts by windows, all cuts, all longer phrases."""
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(fold)):
            words = [w for w in re.split(r"[ \t]+", piece) if w]
            n[lang] += len(words)
            for m in range(1, 6):
                f.update((lang, tuple(words[i:i + m])) for i in range(len(words) - m + 1))
    out = {}
    for (lang, w), a in f.items():
        if len(w) < 2 or a < least:
            continue
        inside = (x for (other, x), b in f.items() if other == lang and b >= least and 100 * b >= 100 * a and len(x) > len(w))
        if any(x[i:i + len(w)] == w for x in inside for i in range(len(x) - len(w) + 1)):
            continue
        score, _, left, right = min((1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
        out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), left, right))
    return {(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for lang, found in out.items() for i, (s, a, p, left, right) in enumerate(sorted(found)[:first])}


def mined(spark, rows, least, first):
    df = spark.createDataFrame([(lang, text, "x") for lang, text in rows], "lang string, text string, phrase string").repartition(3)
    return {tuple(r) for r in phrases.collocations(df, least, first).collect()}


ODD = ["", None, "New York, new york. New  York!", "one\x01two a\x00b one\x01two", "a b\tc a b\x0bc a b c", "Éa éa Éa éa", "a b c d e f a b c d e f", "x" * 300_000 + " y", ". , ;", "und x y x y"]


def test_against_brute_force(spark):
    draw = random.Random(5)
    rows = [(draw.choice(["en", "de", None, "und"]), " ".join(draw.choice(["a", "b", "c", "d", "B", "e.", "f,", "the"]) for _ in range(draw.randrange(40)))) for _ in range(120)]
    rows += [(lang, text) for text in ODD for lang in ("en", None)] + [("en", "of the one same long passage of words")] * 30
    for least, first in ((3, 50), (20, 2000), (1, 10)):
        assert mined(spark, rows, least, first) == brute(rows, least, first)


def test_shards_and_filter_do_not_matter(spark, monkeypatch):
    rows = [("en", f"a b c{i % 7} a b. {'w%d ' % (i % 50)} a b c") for i in range(300)]
    monkeypatch.setattr(phrases, "SHARD_WORDS", 40)
    whole = mined(spark, rows, 5, 100)
    assert whole == brute(rows, 5, 100)
    assert {r for r in whole if r[2] == "a b c"}


def test_empty_tables(spark):
    assert mined(spark, [], 1, 5) == set()
    assert mined(spark, [(None, None), ("en", "")], 1, 5) == set()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("aB c\t.\n\x0b\x01é", max_size=30), max_size=6))
def test_trie_of_a_shard_counts_all_windows(texts):
    import numpy as np

    class Everything:
        value = b"\xff" * (1 << (phrases.FILTER_BITS - 3))

    got = Counter()
    bits = np.frombuffer(Everything.value, np.uint8)
    shard = phrases._Shard("en")
    for t in texts:
        shard.add(t.encode())
    if shard.parts:
        for found in (shard.words(), shard.pairs(bits), shard.longer(bits)):
            got.update(dict(found))
    want = Counter()
    for t in texts:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", t.replace("B", "b")):
            words = [w for w in re.split(r"[ \t]+", piece) if w]
            for m in range(1, 6):
                want.update(" ".join(words[i:i + m]).encode() for i in range(len(words) - m + 1))
    assert got == want


@pytest.mark.parametrize("n", [1, 2, 300])
def test_one_hot_pair(spark, n):
    rows = [("en", "hot pair")] * n
    assert mined(spark, rows, 2, 5) == brute(rows, 2, 5)
