"""Centroid clustering by weighted deduplication.

Vectors are turned into integers and grouped: equal ones become one row with a multiplicity. Lloyd's
rounds run over the distinct rows alone. A round sends the centroids to all tasks (k vectors, whatever
the size of the table); tasks return weighted integer sums for each centroid, so what the driver gets
is k rows a round. Sums are exact, so neither the order of rows nor their partitions change a result.
At the end, assignments are joined back to the rows. A vector that makes up more than a thousandth of
all rows is joined by broadcast (there are a thousand of them at most), the others by shuffle.

Defined results: null vectors, vectors of another length and those with a null or non-finite component
are left out. Rows that repeat a vec_id are rows of their own; a null vec_id counts as the empty text
in the choice of first centroids, where equal hashes go by components. Fewer kept vectors than ``k``
give as many centroids as there are vectors; an empty table gives no rows. A component is held to
+-2^62 after scaling; a distance beyond 64 bits is null. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import save

#: Below this, squared distances of 64 components are exact in doubles.
_SMALL = 1 << 21
#: A vector is hot if it has more than one in so many rows.
HOT = 1_000


def quantised(vectors: Column, dims: int, scale: int) -> Column:
    """floor(scale * x) of each component; null for a vector that is not kept."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    whole = lambda x: F.floor(F.greatest(F.least(x.cast("double") * scale, F.lit(2.0**62)), F.lit(-(2.0**62))))
    return F.when((F.size(vectors) == dims) & F.forall(vectors, finite), F.transform(vectors, whole))


def nearest(rows: np.ndarray, centroids: list[list[int]]) -> tuple[np.ndarray, list[int | None]]:
    """Number and squared distance of the nearest centroid of each row; the smaller number wins a tie."""
    most = max(int(np.abs(rows).max(initial=0)), *(abs(x) for c in centroids for x in c))
    if most < _SMALL and rows.shape[1] <= 64:
        x, c = rows.astype(np.float64), np.array(centroids, np.float64)
        d = (x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)[None]
        at = d.argmin(1)
        return at, d[np.arange(len(x)), at].astype(np.int64).tolist()
    at, least = [], []
    for x in rows.tolist():
        d = [sum((a - b) ** 2 for a, b in zip(x, c, strict=True)) for c in centroids]
        at.append(d.index(min(d)))
        least.append(min(d) if min(d) < 1 << 63 else None)
    return np.array(at, np.int64), least


def _sums(centroids: list[list[int]]):
    """Batches of (q, weight) to the weighted sums of each centroid's rows, exact at any size of either."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            rows, weight = np.stack(batch["q"].to_numpy()).astype(np.int64), batch["weight"].tolist()
            at, _ = nearest(rows, centroids)
            small = max(int(np.abs(rows).max()), 1) * sum(weight) < 1 << 62
            kind = np.int64 if small else object
            values, weights = rows.astype(kind), np.array(weight, kind)
            for c in np.unique(at):
                own = at == c
                totals = (values[own] * weights[own][:, None]).sum(0)
                yield pd.DataFrame({"cluster": [int(c)] * len(totals), "place": range(len(totals)), "total": [str(int(t)) for t in totals], "rows": [int(weights[own].sum())] * len(totals)})

    return run


def _assigned(centroids: list[list[int]]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                at, least = nearest(np.stack(batch["q"].to_numpy()).astype(np.int64), centroids)
                yield batch.assign(cluster=at.astype(np.int32), distance=pd.array(least, "Int64"))

    return run


def cluster(df: DataFrame, id_column: str = "vec_id", vector: str = "embedding", k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, seed: int = 1) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every kept vector."""
    spark = df.sparkSession
    rows = df.select(F.col(id_column).alias("vec_id"), quantised(F.col(vector), dims, scale).alias("q")).where("q is not null")
    rows = save(rows, "vectors")
    distinct = save(rows.groupBy("q").agg(F.count(F.lit(1)).alias("weight")), "distinct")
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    centroids = [list(r["q"]) for r in rows.select(name.alias("name"), "q").orderBy("name", "q").limit(k).collect()]
    if not centroids:
        return spark.createDataFrame([], f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")

    for _ in range(rounds):
        sums = distinct.mapInPandas(_sums(centroids), "cluster int, place int, total string, rows long")
        sums = sums.groupBy("cluster", "place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("rows").alias("rows"))
        for r in sums.collect():  # k times dims numbers
            centroids[r["cluster"]][r["place"]] = int(r["total"]) // r["rows"]

    told = save(distinct.mapInPandas(_assigned(centroids), "q array<bigint>, weight long, cluster int, distance long"), "assigned")
    total = F.sum(F.col("weight").cast("decimal(19,0)") * F.col("distance"))
    inertia = told.groupBy("cluster").agg(F.when(F.count("distance") == F.count(F.lit(1)), total).alias("total")).collect()  # k rows
    whole = lambda x: x if x is not None and x < 1 << 63 else None
    own = {r["cluster"]: int(r["total"]) if r["total"] is not None else None for r in inertia}
    total = whole(sum(own.values())) if None not in own.values() else None
    told_of = [(c, whole(own[c]), total, hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for c in own]
    clusters = spark.createDataFrame(told_of, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")

    n = told.agg(F.sum("weight")).first()[0]
    hot = F.broadcast(told.where(F.col("weight") > n / HOT).drop("weight"))
    cold = told.where(F.col("weight") <= n / HOT).drop("weight").hint("merge")
    out = rows.join(hot, "q").unionByName(rows.join(hot, "q", "left_anti").join(cold, "q"))
    return out.join(F.broadcast(clusters), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
