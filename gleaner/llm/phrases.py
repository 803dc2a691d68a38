"""Phrase collocation mining with count tries.

Every shard of texts builds a count trie of limited depth: a node is (parent node, next word), so a
level of the trie is one sort of pairs of numbers. The shard serialises its nodes sorted, cut at the
same prefix ranges everywhere; the runs of a range meet in one task and are merged k ways, summing
counts. Three passes build words, pairs, and phrases of three to five words: a phrase can only reach
``least`` occurrences if all words and pairs inside it do, so a pass looks at those positions alone.
What it looks them up in is a bitmap of hashes of fixed size: it lets all frequent ones pass and a
few others, whose own counts then rule them out. Only the merged counts decide.

The frequent phrases form one trie again. Going down it a level at a time, a node takes the counts
of its left parts from its parent, and those of its right parts from its suffix link, the phrase
without its first word.

Defined results: null text is empty, null lang is ``und``; empty tables give no rows; repeated rows
count as often as they occur; columns other than lang and text are not looked at.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import LOWER, UPPER, bounded, discard, save

#: Longest phrase, in words.
DEPTH = 5
#: Words that a shard holds before it serialises its trie.
SHARD_WORDS = 2_000_000
#: Bits of the bitmap that a pass looks positions up in: 8 MB, whatever the size of the tables.
FILTER_BITS = 26
#: Documents, about, whose phrases show where to cut prefix ranges. Any cuts give the same result.
RANGE_SAMPLE = 2_000
#: Groups in which the best of a language are found before they meet.
SPREAD = 64

#: Lower-cases A-Z, makes a tab a space and every end of a piece a line feed.
_FOLD = bytes.maketrans(UPPER.encode() + b"\t.,;:!?\x0b\x0c\r", LOWER.encode() + b" " + b"\n" * 9)
_MIX = 0x9E3779B97F4A7C15
_RUN = "part int, lang string, phrases binary, counts binary"
_SUM = "lang string, phrase string, f long, bit long"


class _Numbers(dict):
    """Numbers words as they come. 0 is nothing, 1 the end of a piece."""

    def __init__(self):
        super().__init__({b"": 0, b"\n": 1})

    def __missing__(self, word):
        self[word] = n = len(self)
        return n


def _hash(lang: str, word: bytes) -> int:
    return xxhash.xxh64_intdigest(lang.encode() + b"\0" + word)


def _bit(lang: str, words: list[bytes]) -> int:
    """Place in the bitmap of a word or a pair."""
    h = 0
    for w in words:
        h = (h * _MIX + _hash(lang, w)) & 0xFFFFFFFFFFFFFFFF
    return h >> (64 - FILTER_BITS)


class _Shard:
    """The words of one language in one shard, in order, numbered."""

    def __init__(self, lang: str):
        self.lang, self.numbers, self.parts, self.size = lang, _Numbers(), [], 0

    def add(self, text: bytes) -> int:
        tokens = text.translate(_FOLD).replace(b"\n", b" \n ").split(b" ")
        tokens.append(b"\n")
        got = np.fromiter(map(self.numbers.__getitem__, tokens), np.int32, len(tokens))
        self.parts.append(got[got > 0])
        self.size += len(self.parts[-1])
        return len(self.parts[-1])

    def ranked(self) -> tuple[list[bytes], np.ndarray]:
        """Its distinct words in order, and all words as ranks among them; -1 ends a piece."""
        words = [w for w in self.numbers if w not in (b"", b"\n")]
        order = sorted(range(len(words)), key=words.__getitem__)
        ranks = np.full(len(words) + 2, -1, np.int64)
        ranks[np.array(order, np.int64) + 2] = np.arange(len(order))
        return [words[i] for i in order], ranks[np.concatenate(self.parts)]

    def words(self) -> list[tuple[bytes, int]]:
        words, at = self.ranked()
        return list(zip(words, np.bincount(at[at >= 0], minlength=len(words)).tolist(), strict=True))

    def pairs(self, bits: np.ndarray) -> list[tuple[bytes, int]]:
        """Pairs of words that are both in the bitmap."""
        words, at = self.ranked()
        known = _looked_up(bits, np.fromiter((_hash(self.lang, w) for w in words), np.uint64, len(words)))
        known = (at >= 0) & np.append(known, False)[at]
        first = np.flatnonzero(known[:-1] & known[1:])
        nodes, n = np.unique(at[first] << 32 | at[first + 1], return_counts=True)
        phrases = [words[a] + b" " + words[b] for a, b in zip((nodes >> 32).tolist(), (nodes & 0xFFFFFFFF).tolist(), strict=True)]
        return list(zip(phrases, n.tolist(), strict=True))

    def longer(self, bits: np.ndarray) -> list[tuple[bytes, int]]:
        """Phrases of three words and more whose pairs are all in the bitmap."""
        words, at = self.ranked()
        hashes = np.append(np.fromiter((_hash(self.lang, w) for w in words), np.uint64, len(words)), np.uint64(0))[at]
        known = (at[:-1] >= 0) & (at[1:] >= 0) & _looked_up(bits, hashes[:-1] * np.uint64(_MIX) + hashes[1:])
        first = np.flatnonzero(known[:-1] & known[1:])
        nodes, node = np.unique(at[first] << 32 | at[first + 1], return_inverse=True)
        phrases = [words[a] + b" " + words[b] for a, b in zip((nodes >> 32).tolist(), (nodes & 0xFFFFFFFF).tolist(), strict=True)]
        found = []
        for depth in range(3, DEPTH + 1):
            nodes, node, n = np.unique(node << 32 | at[first + depth - 1], return_inverse=True, return_counts=True)
            phrases = [phrases[a] + b" " + words[b] for a, b in zip((nodes >> 32).tolist(), (nodes & 0xFFFFFFFF).tolist(), strict=True)]
            found += zip(phrases, n.tolist(), strict=True)
            more = first + depth - 1 < len(known)
            more[more] = known[first[more] + depth - 1]
            first, node = first[more], node[more]
        return found


def _looked_up(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    place = hashes >> np.uint64(64 - FILTER_BITS)
    return (bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def _runs(level: str, cuts: list[tuple[str, bytes]], bits=None, every: int = 1):
    """Shards of (lang, text) to sorted runs, a row for each prefix range that a shard has part in.
    ``every``: serialises each so many-th entry only, to learn where to cut."""

    def serialised(shards: dict[str, _Shard]) -> Iterator[pa.RecordBatch]:
        for lang, shard in shards.items():
            found = sorted(shard.words() if level == "words" else getattr(shard, level)(np.frombuffer(bits.value, np.uint8)))[::every]
            phrases, counts, at = [p for p, _ in found], np.array([n for _, n in found], "<i8"), 0
            while at < len(phrases):
                part = bisect_right(cuts, (lang, phrases[at]))
                stop = bisect_left(phrases, cuts[part][1]) if part < len(cuts) and cuts[part][0] == lang else len(phrases)
                row = [[part], [lang], [b"\n".join(phrases[at:stop])], [counts[at:stop].tobytes()]]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, (pa.int32(), pa.string(), pa.binary(), pa.binary()), strict=True)], names=["part", "lang", "phrases", "counts"])
                at = stop

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards, size = {}, 0
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                size += shards.setdefault(lang, _Shard(lang)).add(text)
                if size >= SHARD_WORDS:
                    yield from serialised(shards)
                    shards, size = {}, 0
        yield from serialised(shards)

    return run


def _merged(least: int, totals: bool):
    """The runs of a prefix range, merged: phrases with ``least`` occurrences or more; ``totals``: and a
    row without phrase for the sum of all counts of a language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs: dict[str, list[tuple[bytes, bytes]]] = {}
        for batch in batches:
            for lang, phrases, counts in zip(*(batch.column(c).to_pylist() for c in ("lang", "phrases", "counts")), strict=True):
                runs.setdefault(lang, []).append((phrases, counts))
        for lang, own in runs.items():
            entries = heapq.merge(*(zip(p.split(b"\n"), np.frombuffer(n, "<i8").tolist(), strict=True) for p, n in own))
            total, found = 0, []
            for phrase, same in groupby(entries, lambda x: x[0]):
                f = sum(n for _, n in same)
                total += f
                if f >= least:
                    words = phrase.split(b" ")
                    found.append((phrase.decode(), f, _bit(lang, words) if len(words) < 3 else None))
            if totals:
                found.append((None, total, None))
            columns = zip(*found, strict=True) if found else ((), (), ())
            arrays = [pa.array(list(c), t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64()), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), *arrays], names=["lang", "phrase", "f", "bit"])

    return run


def _count(docs: DataFrame, sample: DataFrame, level: str, least: int, bits=None) -> DataFrame:
    """Merged counts of a level, as a work table."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    seen = sample.mapInArrow(_runs(level, [], bits, every=20), _RUN).collect()
    keys = sorted((r["lang"], p) for r in seen for p in bytes(r["phrases"]).split(b"\n"))
    cuts = sorted({keys[len(keys) * i // parts] for i in range(1, parts)}) if keys else []
    runs = docs.mapInArrow(_runs(level, cuts, bits), _RUN).repartitionById(parts, "part")
    return save(runs.mapInArrow(_merged(least, level == "words"), _SUM), f"phrases-{level}")


def _bitmap(spark, frequent: DataFrame):
    """Broadcast bitmap of the ``bit`` column: FILTER_BITS bits, whatever the number of rows."""
    rows = frequent.where("bit is not null").groupBy(F.expr("bit div 32768").alias("row")).agg(F.bitmap_construct_agg(F.expr("bit % 32768")).alias("bits"))
    out = bytearray(1 << (FILTER_BITS - 3))
    for r in rows.collect():
        out[r["row"] * 4096:(r["row"] + 1) * 4096] = r["bits"]
    return spark.sparkContext.broadcast(bytes(out))


def phrase_counts(docs: DataFrame, least: int = 100) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, f) of all phrases of one to DEPTH words with ``least`` occurrences or more, and
    (lang, n) with the number of all words."""
    spark = docs.sparkSession
    docs = bounded(docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).cast("binary").alias("text")))
    sample = save(docs.sample(min(1.0, RANGE_SAMPLE / max(1, docs.count())), seed=1).coalesce(4), "phrases-sample")
    words = _count(docs, sample, "words", least)
    known = _bitmap(spark, words)
    pairs = _count(docs, sample, "pairs", least, known)
    known.destroy()
    known = _bitmap(spark, pairs)
    longer = _count(docs, sample, "longer", least, known)
    known.destroy()
    discard(sample)
    frequent = words.where("phrase is not null").unionByName(pairs).unionByName(longer)
    return frequent.select("lang", "phrase", "f"), words.where("phrase is null").groupBy("lang").agg(F.sum("f").alias("n"))


def linked(frequent: DataFrame) -> DataFrame:
    """Every phrase of two words and more with ``lefts``, the counts of its first 1, 2, ... words, ``rights``,
    those of what remains after them, and ``covered``: it occurs only inside one phrase a word longer."""
    counted = frequent.withColumn("depth", F.size(F.split("phrase", " ")))
    none = F.array().cast("array<bigint>")
    level = counted.where("depth = 1").select("lang", "phrase", "f", none.alias("lefts"), none.alias("rights"))
    out = None
    for depth in range(2, DEPTH + 1):
        nodes = counted.where(F.col("depth") == depth).select(
            "lang", "phrase", "f", F.substring_index("phrase", " ", depth - 1).alias("parent"), F.substring_index("phrase", " ", 1 - depth).alias("suffix")
        )
        up = level.select("lang", F.col("phrase").alias("parent"), F.concat("lefts", F.array("f")).alias("lefts"))
        link = level.select("lang", F.col("phrase").alias("suffix"), F.concat(F.array("f"), "rights").alias("rights"))
        nodes = nodes.join(up.hint("merge"), ["lang", "parent"]).join(link.hint("merge"), ["lang", "suffix"])
        level = save(nodes, f"phrases-depth{depth}")
        out = level if out is None else out.unionByName(level)
    same = out.where((F.element_at("lefts", -1) == F.col("f")) | (F.element_at("rights", 1) == F.col("f")))
    inner = F.array(F.when(F.element_at("lefts", -1) == F.col("f"), F.col("parent")), F.when(F.element_at("rights", 1) == F.col("f"), F.col("suffix")))
    inner = same.select("lang", F.explode(F.array_compact(inner)).alias("phrase")).distinct().withColumn("covered", F.lit(True))
    return out.drop("parent", "suffix").join(inner.hint("merge"), ["lang", "phrase"], "left").withColumn("covered", F.coalesce("covered", F.lit(False)))


def collocations(docs: DataFrame, least: int = 100, first: int = 2000) -> DataFrame:
    """The ``first`` phrases of each language by score: (lang, rank, phrase, a, l, r, n, score).

    The score of a cut is floor(1000 * a * n / (l * r)), in decimals of 38 digits, exact below 10^16
    words; the cut that scores least counts, the first of those that tie. Phrases that only occur
    inside one longer phrase are left out. Ties in score go by a, then by phrase.
    """
    frequent, sizes = phrase_counts(docs, least)
    phrases = linked(frequent).where("not covered").join(F.broadcast(sizes.where("n > 0")) if _few(sizes) else sizes, "lang")
    exact = lambda c: f"cast({c} as decimal(16,0))"
    cut = f"transform(sequence(1, size(lefts)), k -> struct((1000 * {exact('f')} * {exact('n')}) div ({exact('lefts[k - 1]')} * {exact('rights[k - 1]')}) as score, k as k, lefts[k - 1] as l, rights[k - 1] as r))"
    scored = phrases.withColumn("cut", F.array_min(F.expr(cut))).select("lang", "phrase", F.col("f").alias("a"), "cut.l", "cut.r", "n", "cut.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    scored = scored.withColumn("spread", F.pmod(F.xxhash64("phrase"), F.lit(SPREAD)))
    for keys in (["lang", "spread"], ["lang"]):
        scored = scored.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= first)
    return scored.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def _few(sizes: DataFrame, most: int = 10_000) -> bool:
    """Whether the languages are few enough to broadcast."""
    return sizes.limit(most + 1).count() <= most
