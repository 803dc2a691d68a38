"""Exact deduplication through a minimal perfect hash over the distinct digests of a history.

The history is a table of distinct digests, each with the id of the row that won and its number of
copies. Digests are dealt to buckets; each bucket gets its own minimal perfect hash (hash and
displace), whose slots hold the full digest and the winner's locator. A lookup computes a row's
slot and compares all 32 bytes: a hit is a repeat of the slot's winner, a miss is new, and the new
rows are grouped among themselves.

Of one table, the rows from the median id upwards are the history of the others. The largest id stays,
so a winner of the history is final whatever follows; only its number of copies grows.

Nulls count as empty texts. Ids may be null: they lose against any other id. Rows that repeat the
winning id are each marked as kept. An empty table gives an empty result.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lower_az, save

KEYS_PER_BUCKET = 4096
ROWS_PER_BUCKET = 4096
#: A bucket is hot beyond this many times ROWS_PER_BUCKET, or beyond 1 / HOT_BUCKETS of all rows.
HOT_FACTOR, HOT_BUCKETS = 4, 10_000
#: Groups of more than 1 / HOT of all rows are fewer than HOT; what they hold is broadcast.
HOT = 1000

INDEX_SCHEMA = "bucket long, n int, seed long, pilots binary, digests binary, winners binary, copies binary"


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _slots(words: np.ndarray, pilots: np.ndarray, seed: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        moved = pilots.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)
        return (_mix(words ^ _mix(moved)) % np.uint64(n)).astype(np.int64)


def _groups(n: int) -> int:
    return n // 3 + 1


def perfect_hash(digests: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """Seed, pilot of each group and slot of each of n distinct digests (rows of four uint64)."""
    n = len(digests)
    group = (digests[:, 1] % np.uint64(_groups(n))).astype(np.int64)
    order = np.argsort(group, kind="stable")
    starts = np.searchsorted(group[order], np.arange(_groups(n) + 1))
    by_size = np.argsort(starts[:-1] - starts[1:], kind="stable")
    for seed in range(64):
        taken, pilots, slots = np.zeros(n, bool), np.zeros(_groups(n), np.uint32), np.zeros(n, np.int64)
        for g in by_size:
            rows = order[starts[g]:starts[g + 1]]
            if not len(rows):
                break
            for first in range(0, 64 * n + 4096, 256):
                tries = np.arange(first, first + 256)
                at = _slots(digests[rows, 2][:, None], tries[None, :], seed, n)
                fits = ~taken[at].any(0)
                if len(rows) > 1:
                    ranked = np.sort(at, 0)
                    fits &= (ranked[1:] != ranked[:-1]).all(0)
                if fits.any():
                    pick = int(np.argmax(fits))
                    pilots[g], slots[rows] = tries[pick], at[:, pick]
                    taken[at[:, pick]] = True
                    break
            else:
                break  # this seed has no pilot for the group
        if taken.all():
            return seed, pilots, slots
    raise ValueError("no perfect hash found: the digests are not distinct")


def _unpack(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype="<u8").reshape(-1, 4)


def _build_bucket(rows: pd.DataFrame) -> pd.DataFrame:
    digests = _unpack(rows["digest"])
    seed, pilots, slots = perfect_hash(digests)
    at = np.argsort(slots)
    return pd.DataFrame({
        "bucket": [rows["bucket"].iloc[0]], "n": [len(rows)], "seed": [seed], "pilots": [pilots.tobytes()],
        "digests": [digests[at].tobytes()],
        "winners": [rows["winner"].to_numpy("i8")[at].tobytes()],
        "copies": [rows["copies"].to_numpy("i8")[at].tobytes()],
    })


def _bucket(n_buckets: int):
    return F.pmod(F.conv(F.substring(F.hex("digest"), 1, 15), 16, 10).cast("long"), F.lit(n_buckets))


def digest_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, digest): SHA-256 of every whole text after lower-casing A-Z."""
    text = lower_az(F.coalesce(F.col(text_col), F.lit("")))
    return docs.select(F.col(id_col).cast("long").alias("id"), F.unhex(F.sha2(text, 256)).alias("digest"))


def distinct_digests(rows: DataFrame) -> DataFrame:
    """History entries (digest, winner, copies) of ``rows`` (id, digest), whose ids are not null."""
    return rows.groupBy("digest").agg(F.max("id").alias("winner"), F.count(F.lit(1)).alias("copies"))


def build_index(history: DataFrame, n_buckets: int) -> DataFrame:
    """One row a bucket: pilots of its perfect hash and its slots. A bucket holds about
    KEYS_PER_BUCKET digests, whatever the size of the history."""
    return history.withColumn("bucket", _bucket(n_buckets)).groupBy("bucket").applyInPandas(_build_bucket, INDEX_SCHEMA)


def _probe(rows: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
    out = rows[["id", "digest"]].assign(winner=pd.array([None] * len(rows), "Int64"), copies=pd.array([None] * len(rows), "Int64"))
    if not len(rows) or not len(index):
        return out
    row = index.iloc[0]
    n, digests = int(row["n"]), _unpack(rows["digest"])
    pilots = np.frombuffer(row["pilots"], np.uint32)[(digests[:, 1] % np.uint64(_groups(n))).astype(np.int64)]
    slots = _slots(digests[:, 2], pilots, int(row["seed"]), n)
    hit = (np.frombuffer(row["digests"], "<u8").reshape(-1, 4)[slots] == digests).all(1)
    for c in ("winner", "copies"):
        values = np.frombuffer(row["winners" if c == "winner" else c], "i8")[slots]
        out[c] = pd.array(np.where(hit, values, 0), "Int64")
        out.loc[~hit, c] = pd.NA
    return out


def lookup(rows: DataFrame, index: DataFrame, n_buckets: int, n_rows: int) -> DataFrame:
    """(id, digest, winner, copies) of every row; winner is null where the index lacks the digest.

    Rows meet their bucket's hash in one group. A bucket with very many rows, such as one that holds
    a text that a third of the rows repeat, is split by a hash of the id and its hash is copied to
    each split. Every hot bucket has over 1 / HOT_BUCKETS of all rows, so there are fewer than
    HOT_BUCKETS of them and their list can be broadcast.
    """
    rows = rows.withColumn("bucket", _bucket(n_buckets))
    hot_from = max(HOT_FACTOR * ROWS_PER_BUCKET, n_rows // HOT_BUCKETS)
    hot = (
        rows.groupBy("bucket").count().where(F.col("count") > hot_from)
        .select("bucket", F.ceil(F.col("count") / ROWS_PER_BUCKET).cast("int").alias("splits"))
    )
    splits = F.coalesce("splits", F.lit(1))
    left = rows.join(F.broadcast(hot), "bucket", "left").withColumn("salt", F.pmod(F.xxhash64("id"), splits).cast("int")).drop("splits")
    right = index.join(F.broadcast(hot), "bucket", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), splits - 1))).drop("splits")
    return left.groupBy("bucket", "salt").cogroup(right.groupBy("bucket", "salt")).applyInPandas(
        _probe, "id long, digest binary, winner long, copies long"
    )


def with_groups(rows: DataFrame, groups: DataFrame, n_rows: int) -> DataFrame:
    """``rows`` with the columns that ``groups`` has for their digest. Large groups are few and are
    broadcast, so that none brings its rows to one task."""
    large = F.col("group_size") > n_rows / HOT
    few, many = F.broadcast(groups.where(large)), groups.where(~large)
    rest = rows.join(few.select("digest"), "digest", "left_anti")
    return rows.join(few, "digest").unionByName(rest.join(many.hint("merge"), "digest"))


def dedup(rows: DataFrame, history: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rows`` (id, digest) with keep_id and group_size against ``history`` (digest, winner, copies),
    and the history with its groups' new sizes (digest, keep_id, group_size). Repeats of the history
    take the winner that their slot names; the rest are grouped alone."""
    n_rows, n_keys = rows.count(), history.count()
    n_buckets = max(1, ceil(n_rows / ROWS_PER_BUCKET), ceil(n_keys / KEYS_PER_BUCKET))
    found = save(lookup(rows, build_index(history, n_buckets), n_buckets, n_rows), "lookups")
    members = found.where("copies is not null").select("id", "digest", F.col("winner").alias("keep_id"))
    more = members.groupBy("digest").agg(F.count(F.lit(1)).alias("more"))
    size = F.col("copies") + F.coalesce("more", F.lit(0).cast("long"))
    known = save(history.join(more.hint("merge"), "digest", "left").select("digest", F.col("winner").alias("keep_id"), size.alias("group_size")), "groups")
    new = found.where("copies is null").select("id", "digest")
    own = save(new.groupBy("digest").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")), "new_groups")
    told = with_groups(members, known.select("digest", "group_size"), n_rows).unionByName(with_groups(new, own, n_rows))
    return told, known


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document, dropped ones too; of equal texts the row with the largest id stays."""
    rows = save(digest_rows(docs, id_col, text_col), "digests")
    n_rows, middle = rows.agg(F.count(F.lit(1)), F.percentile_approx("id", 0.5, 1000)).first()
    # Null ids lose against any other, so they are no history. Rows with the same id are on the same side.
    early = F.coalesce(F.col("id") >= F.lit(middle).cast("long"), F.lit(False))
    history = save(distinct_digests(rows.where(early)), "history")
    later, known = dedup(rows.where(~early), history)
    told = later.unionByName(with_groups(rows.where(early), known, n_rows))
    return told.select(
        F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
