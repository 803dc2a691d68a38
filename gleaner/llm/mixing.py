"""Mixing sources to target weights, by fixed-length blocks of words.

Each source's words, its documents one after another by id, are cut into blocks of fixed length.
Weights are shared out over the sources and limited to CAP times what a source has. The output is
dealt to shards: each source's blocks go to them by a multinomial draw of equal chances, made where the
source's row is, so no plan passes through the driver. Seen from a shard of a given size, its
counts of sources are drawn in proportion to what the targets ask, and over all shards they end on the
targets; shards differ in size by about the square root of their blocks. A source's draws
are numbered over all shards; number k of epoch e goes through the source's pseudorandom permutation
of that epoch to a block index, and blocks are joined by index. So a block is taken e or e + 1 times.

Nulls: a null text has no words, null is a source of its own and sorts last. Texts without words
take nothing. Repeated rows are rows like any other. An empty table gives an empty result. Extra
columns are ignored by ``take_words`` and kept by ``mix_texts``.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bounded, fresh, running_totals, save

WEIGHTS = (5.0, 2.0, 1.0)
SHARE, CAP = 1.5, 2.0
BLOCK_WORDS = 128
MIN_SHARDS, WORDS_PER_SHARD = 16, 1 << 28
#: Draws that a task makes at most, roughly.
DRAWS_PER_TASK = 500_000
SEED = 20240601
WORD = r"[^\x20\x09-\x0D]+"


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(source, source_id, source_size, target) from (source, source_size).

    Limited shares: with the sources in the order of cap / weight, those whose limit is below the
    level that the rest would get are at their limit, and the others share what is left by weight.
    """
    everything = Window.partitionBy(F.lit(1))
    numbered = sizes.withColumn("source_id", (F.row_number().over(everything.orderBy(F.col("source").asc_nulls_last())) - 1).cast("int"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod("source_id", F.lit(len(weights))) + 1)
    limited = numbered.withColumn("_w", weight).withColumn("_cap", cap * F.col("source_size"))
    earlier = everything.orderBy(F.col("_cap") / F.col("_w"), "source_id").rowsBetween(Window.unboundedPreceding, -1)
    level = (share * F.sum("source_size").over(everything) - F.coalesce(F.sum("_cap").over(earlier), F.lit(0.0))) / (
        F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(earlier), F.lit(0.0))
    )
    levels = limited.withColumn("_level", level).withColumn("_full", F.col("_level") >= F.col("_cap") / F.col("_w"))
    first_free = F.min_by(F.when(~F.col("_full"), F.col("_level")), F.when(~F.col("_full"), F.struct(F.col("_cap") / F.col("_w"), "source_id"))).over(everything)
    target = F.when(F.col("_full"), F.col("_cap")).otherwise(F.least(first_free * F.col("_w"), "_cap"))
    return levels.select("source", "source_id", "source_size", target.alias("target"))


def deal_draws(source_id: int, source_size: int, target: float, shards: int, block_words: int, seed: int) -> pd.DataFrame:
    """A source's draws by shard: the number of the first, and how many."""
    n_blocks = ceil(source_size / block_words)
    # A source's last block may be short: count in its own mean block, so that no target is missed by it.
    count = max(int(target > 0), round(target / source_size * n_blocks))
    drawn = np.random.default_rng([seed, source_id]).multinomial(count, np.full(shards, 1 / shards))
    first, shard = np.cumsum(drawn) - drawn, np.flatnonzero(drawn)
    return pd.DataFrame({"source_id": source_id, "n_blocks": n_blocks, "shard": shard, "first": first[shard], "n": drawn[shard]})


def permuted(slot: np.ndarray, n: np.ndarray, source: np.ndarray, seed: int) -> np.ndarray:
    """Block index of each draw: a Feistel network over the next even power of two, walked until it
    falls below n. The key is made of seed, source and epoch (slot // n)."""
    epoch, x = (slot // n).astype(np.uint64), (slot % n).astype(np.uint64)
    bits = np.maximum(1, np.ceil(np.log2(np.maximum(2, n)) / 2)).astype(np.uint64)
    mask = (np.uint64(1) << bits) - np.uint64(1)
    key = source.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + epoch * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(seed)
    out, todo = np.empty(len(x), np.int64), np.arange(len(x))
    while len(todo):
        left, right, k, m = x >> bits, x & mask, key, mask
        for turn in range(4):
            mixed = (right ^ (k + np.uint64(turn) * np.uint64(0xD6E8FEB86659FD93))) * np.uint64(0xFF51AFD7ED558CCD)
            mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xC4CEB9FE1A85EC53)
            left, right = right, left ^ ((mixed >> np.uint64(29)) & m)
        x = (left << bits) | right
        done = x < n.astype(np.uint64)
        out[todo[done]] = x[done].astype(np.int64)
        x, bits, mask, key, n, todo = x[~done], bits[~done], mask[~done], key[~done], n[~done], todo[~done]
    return out


def _with_blocks(seed: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            with np.errstate(over="ignore"):
                block = permuted(rows["slot"].to_numpy(), rows["n_blocks"].to_numpy(), rows["source_id"].to_numpy(), seed)
            yield rows.assign(block=block, epoch=rows["slot"] // rows["n_blocks"])[["shard", "source_id", "slot", "block", "epoch"]]

    return run


def _dealer(shards: int, block_words: int, seed: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for r in rows.itertuples():
                yield deal_draws(int(r.source_id), int(r.source_size), float(r.target), shards, block_words, seed)

    return run


def draw_blocks(targets: DataFrame, block_words: int = BLOCK_WORDS, seed: int = SEED) -> DataFrame:
    """(shard, source_id, slot, block, epoch) for every block of the output. Only the sum of the targets
    and the number of sources come to the driver."""
    total, sources = targets.agg(F.sum("target"), F.count(F.lit(1))).first()
    shards = max(MIN_SHARDS, ceil((total or 0) / WORDS_PER_SHARD))
    tasks = max(8, ceil(((total or 0) / block_words + sources) / DRAWS_PER_TASK))
    dealt = targets.where("source_size > 0").select("source_id", "source_size", "target").repartition("source_id")
    plan = dealt.mapInPandas(_dealer(shards, block_words, seed), "source_id int, n_blocks long, shard int, first long, n long")
    slots = (
        plan.repartition(tasks, "source_id", "shard")
        .select("source_id", "n_blocks", "shard", F.explode(F.sequence("first", F.col("first") + F.col("n") - 1)).alias("slot"))
    )
    return slots.mapInPandas(_with_blocks(seed), "shard int, source_id int, slot long, block long, epoch long")


def pack_blocks(placed: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Pieces of documents in blocks, from (source_id, before, size): the block, the piece's first
    word within the document and its number of words."""
    first, last = F.col("before"), F.col("before") + F.col("size")
    blocks = F.sequence(F.floor(first / block_words), F.floor((last - 1) / block_words))
    start = F.greatest(first, F.col("block") * block_words)
    stop = F.least(last, (F.col("block") + 1) * block_words)
    return (
        placed.where("size > 0").withColumn("block", F.explode(blocks))
        .select("source_id", "before", "block", (start - first).alias("from_word"), (stop - start).alias("n_words"))
    )


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), size.alias("size"), F.xxhash64(text_col).alias("tie"))


def _placed(sized: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents with their source's id and their place among its words; the source table."""
    sized = save(sized, "sizes")
    targets = save(source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"))), "targets")
    rows = sized.join(targets.select(F.col("source").alias("_source"), "source_id"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source", "source")
    return running_totals(rows, ["source_id"], ["id", "tie", "size"], "size", "before"), targets


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block_words: int = BLOCK_WORDS, seed: int = SEED) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents with their places, source table, mix). The mix has a row for each piece of a
    document in each block of the output: shard, slot, source_id, before, from_word, n_words, epoch."""
    placed, targets = _placed(_sized(docs, id_col, text_col, source_col))
    placed = save(placed, "placed")
    draws = draw_blocks(targets, block_words, seed)
    # Both sides grow with the corpus, whatever the size of the plan of draws says.
    return placed, targets, draws.hint("merge").join(pack_blocks(placed, block_words), ["source_id", "block"])


def take_words(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """For each document its size, its source's size and target, and the words the mix takes of it."""
    placed, targets, mixed = mix(docs, id_col, **options)
    taken = mixed.groupBy("source_id", "before").agg(F.sum("n_words").alias("_taken"))
    placed = placed.join(taken.hint("merge"), ["source_id", "before"], "left").join(targets.select("source_id", "source_size", "target"), "source_id")
    has = (F.col("size") > 0) & F.col("_taken").isNotNull()
    return placed.select(F.col("id").alias(id_col), "size", "source_size", "target", F.when(has, F.col("_taken")).otherwise(F.lit(0)).cast("long").alias("taken"))


def _cut(text_at: int, names: list[str]):
    """Rows as the mix takes them: one for each pass over a document, with the words of that pass."""
    import re

    word = re.compile(WORD)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, texts = [], []
            for i, (text, size, pieces) in enumerate(zip(batch.column(text_at).to_pylist(), batch.column(len(names)).to_pylist(), batch.column(len(names) + 1).to_pylist())):
                spans: list[tuple[int, int]] | None = None
                for epoch in sorted({p["epoch"] for p in pieces}):
                    own = sorted((p["from_word"], p["n_words"]) for p in pieces if p["epoch"] == epoch)
                    if sum(n for _, n in own) == size:
                        out = text
                    else:
                        spans = spans or [m.span() for m in word.finditer(text)]
                        out = " ".join(text[spans[a][0]:spans[a + n - 1][1]] for a, n in own)
                    keep.append(i)
                    texts.append(out)
            rows = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if i == text_at else rows.column(c) for i, c in enumerate(names)], names)

    return run


def mix_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """``docs`` as the mix takes them: a row for each pass over a document that took words of it, with
    the whole text where the pass took all words and else the taken words' stretches in order."""
    columns = docs.columns
    own_id, own_tie, own_turn, tie, turn_no, size, own_pieces = fresh(docs, "_id", "_tie", "_turn", "_tie2", "_turn2", "_size", "_pieces")
    placed, _, mixed = mix(docs, id_col, text_col, source_col, **options)
    pieces = mixed.groupBy("source_id", "before").agg(F.collect_list(F.struct("epoch", "from_word", "n_words")).alias("pieces"))
    # Rows that are the same in id and text are told apart by source, then by number.
    turn = Window.partitionBy("id", "tie").orderBy("source_id", "before")
    small = placed.withColumn("_turn", F.row_number().over(turn)).where("size > 0").join(pieces.hint("merge"), ["source_id", "before"])
    small = small.select(F.col("id").alias(own_id), F.col("tie").alias(own_tie), F.col("size").alias(size), F.col("_turn").alias(own_turn), F.col("pieces").alias(own_pieces))
    again = Window.partitionBy(id_col, tie).orderBy(F.col(source_col).asc_nulls_last())
    texts = docs.withColumn(tie, F.xxhash64(text_col)).withColumn(turn_no, F.row_number().over(again))
    rows = texts.join(small.hint("merge"), F.col(id_col).eqNullSafe(F.col(own_id)) & (F.col(tie) == F.col(own_tie)) & (F.col(turn_no) == F.col(own_turn)))
    rows = rows.select(*columns, size, own_pieces)
    return bounded(rows).mapInArrow(_cut(columns.index(text_col), columns), docs.schema)
