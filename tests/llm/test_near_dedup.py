"""Fingerprints, links and components against brute force; one document of each group."""

import random

import numpy as np
import pytest
import xxhash

from gleaner.llm import near_dedup as m


def _fingerprint(text, k=3):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    grams = [b" ".join(words[i:i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def _components(fps, ids, radius=2):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                root[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [least.get(find(i)) for i in range(len(fps))]


def _texts(seed):
    rng = random.Random(seed)
    base = [" ".join(rng.choices("abcdefgh", k=rng.randint(0, 300))) for _ in range(40)]
    out = [None, "", " ", "one", "one two"] + base
    for b in base:
        w = b.split()
        for _ in range(rng.randint(0, 2)):
            if w:
                w[rng.randrange(len(w))] = "x"
            out.append(" ".join(w))
    return out + [base[0].upper(), "é" * 50]


@pytest.mark.parametrize("shard", [8192, 8])
def test_against_brute_force(spark, monkeypatch, shard):
    monkeypatch.setattr(m, "SHARD", shard)
    monkeypatch.setattr(m, "SAMPLE", 64)
    texts = _texts(shard)
    ids = [None, None, 7, 7] + list(range(100, 96 + len(texts)))
    random.Random(3).shuffle(ids)
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in zip(ids, texts)], "doc_id long, text string, fp int, least string").repartition(3)
    fps = [_fingerprint(t) for t in texts]
    want = sorted(map(str, zip(ids, (f"{f:016x}" for f in fps), _components(fps, ids))))
    assert sorted(str(tuple(r)) for r in m.near_dedup(docs).collect()) == want


def test_near_pairs_are_complete():
    rng = np.random.default_rng(5)
    a = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    b = a[:500] ^ (np.uint64(1) << rng.integers(0, 63, 500, dtype=np.uint64))
    both = np.concatenate([a, b])
    found = {(int(x), int(y)) for q, h in m.near_pairs(both, both, 2) for x, y in zip(q, h) if x < y}
    assert {(i, 3000 + i) for i in range(500)} <= found
    assert all((int(both[x]) ^ int(both[y])).bit_count() <= 2 for x, y in found)


def test_one_stays(spark):
    text = "some words of a text that is long enough to be told apart " * 3
    rows = [(3, text), (1, text.upper()), (1, text.upper()), (None, text), (5, "another text entirely"), (None, None), (9, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    kept = sorted(((r.doc_id, r.text) for r in m.keep_one(docs).collect()), key=str)
    assert kept == sorted([(1, text.upper()), (5, "another text entirely"), (9, "")], key=str)
    assert m.keep_one(docs.limit(0)).count() == 0


def test_edited_copies_go_and_others_stay(spark):
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(4000)]
    rows, groups = [], 60
    for g in range(groups):
        words = rng.choices(vocabulary, k=rng.choice([60, 200, 500]))
        rows.append((10 * g, words))
        for c in range(rng.randint(0, 3)):
            copy = words[:]
            for _ in range(max(1, len(words) // 100)):
                copy[rng.randrange(len(copy))] = "edited"
            if m.similarity(" ".join(words).encode(), " ".join(copy).encode(), 5) >= 0.8:
                rows.append((10 * g + 1 + c, copy))
    licence = "this very line of a licence stands in each of the texts and makes none of them alike".split()
    docs = spark.createDataFrame([(i, " ".join(w + licence)) for i, w in rows], "doc_id long, text string").repartition(4)
    kept = sorted(r.doc_id for r in m.keep_one(docs).collect())
    assert kept == [10 * g for g in range(groups)] and len(rows) > groups + 20


def test_copies_that_are_alike_only_to_the_original_go(spark):
    """Prefix filtering against stars: copies are 0.8 or more to the original, and less to each other."""
    rng = random.Random(21)
    vocabulary = [f"w{i}" for i in range(4000)]
    rows = []
    for star, (size, copies) in enumerate([(500, 300), (200, 100)]):
        words = rng.choices(vocabulary, k=size)
        rows.append((10_000 * star, " ".join(words)))
        while sum(i // 10_000 == star for i, _ in rows) <= copies:
            copy = words[:]
            for i in rng.sample(range(size), round(size * 0.019)):
                copy[i] = f"x{rng.randrange(10**9)}"
            if m.similarity(" ".join(words).encode(), " ".join(copy).encode(), 5) >= 0.8:
                rows.append((10_000 * star + len(rows) + 1, " ".join(copy)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted(r.doc_id for r in m.keep_one(docs).collect()) == [0, 10_000]


def test_short_copies_go(spark):
    rng = random.Random(22)
    vocabulary = [f"w{i}" for i in range(4000)]
    rows = []
    for g in range(200):
        words = rng.choices(vocabulary, k=rng.choice([10, 14, 20, 28]))
        rows += [(10 * g, " ".join(words)), (10 * g + 1, " ".join([*words, "more"]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted(r.doc_id for r in m.keep_one(docs).collect()) == [10 * g for g in range(200)]


def test_pairs_that_share_common_shingles_are_complete(spark, monkeypatch):
    """Texts that share a long passage, whose shingles are too common to lead pairs, against brute force."""
    monkeypatch.setattr(m, "TOKENS_PER_BUCKET", 500)
    rng = random.Random(23)
    passage = [f"p{i}" for i in range(60)]
    texts = []
    for g in range(40):
        own = [f"w{rng.randrange(10**9)}" for _ in range(rng.choice([20, 60, 150]))]
        texts.append(" ".join(own + passage))
        for _ in range(rng.randint(0, 2)):
            texts.append(" ".join([f"y{rng.randrange(10**9)}" if rng.random() < 0.03 else w for w in own] + passage))
    bodies = [t.encode() for t in texts]
    up = list(range(len(texts)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    fps = [_fingerprint(t) for t in texts]
    for i in range(len(texts)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2 or m.similarity(bodies[i], bodies[j], 5) >= 0.8:
                x, y = root(i), root(j)
                up[max(x, y)] = min(x, y)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    assert sorted(r.doc_id for r in m.keep_one(docs).collect()) == sorted({root(i) for i in range(len(texts))})


def test_places_of_a_shared_token_rule_out_no_pair_that_is_alike(spark):
    rng = random.Random(24)
    base, rows, alike = list(range(100)), [], {}
    for pair in range(300):
        # Tokens in their common order; those from 100 on are a text's own, and have no place.
        a, b = ({*base} - {*rng.sample(base, gone)} | {rng.randrange(100, 10**9) for _ in range(gone)} for gone in rng.choices([2, 5, 6, 20], k=2))
        alike[pair] = len(a & b) / len(a | b) >= 0.8
        x, y = ({t: i + 1 for i, t in enumerate(sorted(own & {*base}))} for own in (a, b))
        rows += [(pair, len(a), len(x), x[t], len(b), len(y), y[t]) for t in x.keys() & y.keys()]
    met = spark.createDataFrame(rows, "pair int, na int, ma int, ata int, nb int, mb int, atb int")
    possible = {r.pair: r.c for r in met.where(m._possible(0.8)).groupBy("pair").agg(m.F.count("*").alias("c")).collect()}
    every = {r.pair: r.c for r in met.groupBy("pair").agg(m.F.count("*").alias("c")).collect()}
    assert all(possible.get(p) == every[p] for p, yes in alike.items() if yes) and 20 < sum(alike.values()) < 280
    assert sum(possible.values()) < sum(every.values())
