"""Perfect hash, lookups and groups against plain Python."""

import hashlib
import random

import numpy as np
import pytest

from gleaner.llm import exact_dedup as m


@pytest.mark.parametrize("n", [1, 2, 3, 100, 5000])
def test_perfect_hash_is_a_permutation(n):
    digests = np.random.default_rng(n).integers(0, 1 << 63, (n, 4), dtype=np.uint64)
    seed, pilots, slots = m.perfect_hash(digests)
    assert sorted(slots.tolist()) == list(range(n))
    again = m._slots(digests[:, 2], pilots[(digests[:, 1] % np.uint64(m._groups(n))).astype(int)], seed, n)
    assert (again == slots).all()


@pytest.mark.parametrize("hot", [False, True])
def test_groups(spark, monkeypatch, hot):
    if hot:  # every bucket is split
        monkeypatch.setattr(m, "ROWS_PER_BUCKET", 4)
        monkeypatch.setattr(m, "HOT_FACTOR", 1)
        monkeypatch.setattr(m, "HOT", 20)
    rng = random.Random(1)
    texts = [None, "", "A", "a", "É", "é", "x" * 100_000] + [f"text {rng.randint(0, 60)}" for _ in range(200)]
    rows = [(None if i in (1, 3) else i % 190, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, id int, digest int").repartition(3)
    norm = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    groups = {}
    for d, t in rows:
        groups.setdefault(norm(t), []).append(d)
    best = {k: max((d for d in v if d is not None), default=None) for k, v in groups.items()}
    want = [(d, best[norm(t)], len(groups[norm(t)]), d == best[norm(t)], hashlib.sha256(norm(t).encode()).hexdigest()) for d, t in rows]
    got = [(r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in m.exact_dedup(docs).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_empty(spark):
    assert m.exact_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_lookups_against_a_history(spark):
    """Hits and misses by the slots' bytes; the history grows by the hits."""
    digest = lambda i: hashlib.sha256(str(i).encode()).digest()
    history = spark.createDataFrame([(digest(i), 1000 + i, 1 + i % 3) for i in range(300)], "digest binary, winner long, copies long")
    rows = spark.createDataFrame([(i, digest(i % 400)) for i in range(900)] + [(None, digest(0)), (None, digest(9999))], "id long, digest binary")
    told, known = m.dedup(rows, history)
    ids = {}
    for i in range(900):
        ids.setdefault(i % 400, []).append(i)
    extra = lambda i: len(ids[i]) + (i == 0)
    want = [(i, 1000 + i % 400, 1 + i % 400 % 3 + extra(i % 400)) if i % 400 < 300 else (i, max(ids[i % 400]), len(ids[i % 400])) for i in range(900)]
    want += [(None, 1000, 1 + extra(0)), (None, None, 1)]
    assert sorted(map(str, want)) == sorted(str((r.id, r.keep_id, r.group_size)) for r in told.collect())
    assert {bytes(r.digest): r.group_size for r in known.collect()} == {digest(i): 1 + i % 3 + extra(i) for i in range(300)}
