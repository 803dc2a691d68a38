import hashlib
import random

from gleaner.llm.centroids import cluster, nearest


def brute(rows, dims, k=16, rounds=3):
    import math

    kept = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centres = [list(q) for _, q in order[:k]]
    dist = lambda q, c: sum((a - b) ** 2 for a, b in zip(q, c))
    own = lambda q: min(range(len(centres)), key=lambda c: (dist(q, centres[c]), c))
    for _ in range(rounds):
        groups = {}
        for _, q in kept:
            groups.setdefault(own(q), []).append(q)
        for c, qs in groups.items():
            centres[c] = [sum(x) // len(qs) for x in zip(*qs)]
    told = [(i, own(q), dist(q, centres[own(q)])) for i, q in kept]
    inertia = {}
    for _, c, d in told:
        inertia[c] = inertia.get(c, 0) + d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted(((i, c, d, inertia[c], sum(inertia.values()), sha[c]) for i, c, d in told), key=str)


def clustered(spark, rows, kind="float", **options):
    df = spark.createDataFrame([(*r, 1, [0.0]) for r in rows], f"vec_id long, embedding array<{kind}>, cluster int, q array<float>").repartition(4)
    return sorted((tuple(r) for r in cluster(df, **options).collect()), key=str)


def test_against_brute_force_with_repeats_and_odd_vectors(spark):
    draw = random.Random(3)
    rows = [(i, [draw.randrange(-32, 32) / 32 for _ in range(4)]) for i in range(200)]
    rows += [(1000 + i, [0.5, 0.25, -0.125, 0.0]) for i in range(150)] + [(7, rows[7][1])] * 3  # a hot vector, repeated rows
    rows += [(2000, None), (2001, [1.0]), (2002, [1.0, None, 0.0, 0.0]), (2003, [float("nan"), 0.0, 0.0, 0.0]), (2004, [float("inf"), 0.0, 0.0, 0.0]), (None, [0.0, -0.0, 1.0, -1.0])]
    assert clustered(spark, rows, dims=4) == brute(rows, 4)
    assert clustered(spark, rows, dims=4, k=3, rounds=1) == brute(rows, 4, 3, 1)


def test_large_components_stay_exact(spark):
    rows = [(i, [float(1 << (10 + i % 12)), -float(i)]) for i in range(60)]
    assert clustered(spark, rows, "double", dims=2, k=5) == brute(rows, 2, 5)
    told = clustered(spark, [(1, [1e30, 0.0]), (2, [-1e30, 0.0])], "double", dims=2, k=1)
    assert [r[2:5] for r in told] == [(None, None, None)] * 2


def test_few_and_no_vectors(spark):
    assert clustered(spark, [(5, [1.0, 2.0])], dims=2) == brute([(5, [1.0, 2.0])], 2)
    assert clustered(spark, [], dims=2) == []
    assert clustered(spark, [(5, None)], dims=2) == []


def test_ties_go_to_the_smaller_number():
    import numpy as np

    at, least = nearest(np.array([[0, 0], [1, 1]]), [[1, 0], [0, 1], [1, 0]])
    assert at.tolist() == [0, 0] and least == [1, 1]
    at, least = nearest(np.array([[1 << 40, 0]]), [[0, 0], [0, 0]])
    assert at.tolist() == [0] and least == [None]
