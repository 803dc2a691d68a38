"""Document fingerprints by a randomised edit embedding.

A pointer walks over the characters of a text. At output step j it writes its character, then moves on
if the shared random bit of (j, character class) is set, and stays otherwise. All texts share the bits,
so the walks of two texts that differ by an edit meet again soon after it, and few edits leave few
output steps that differ: edit distance becomes Hamming distance, as a rule; how long two walks stay apart
is a matter of chance with a long tail. The output is sampled at the same
steps for all texts, every step of the first 64 and 64 steps of each doubling of length after them,
one from each of 64 equal strata; a sample is four bits of a hash of the character. A fingerprint holds
the samples as hexadecimal digits, as many as its walk is long.

Likeness verifies a pair: the share of output steps that agree, each sample standing for its stratum,
among the steps that either walk takes. Bands find pairs: eight samples each of the two longest
doublings that a walk covers in full; texts that share a band are candidates.

Defined results: null text is empty and has the empty fingerprint; likeness of two empty ones is 1, of
an empty and another one 0. Documents go by descending id, null ids last, those with equal ids by hash of
their text; repeated rows are documents of their own. One document alone is its own next. Empty tables
give no rows; columns other than id and text are not looked at.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType

from .common import bounded, save
from .graph import components

#: Samples of the first steps and of every doubling; samples in a band.
SAMPLES, BAND = 64, 8
#: Classes of characters, and steps after which the random bits repeat.
CLASSES, PERIOD = 16, 2048
#: Characters that are walked at a time.
CHUNK = 1 << 16
#: Most ids that are sampled to cut the order of documents into ranges.
RANGE_SAMPLE = 1_000_000
#: Likeness from which documents are near copies.
LIKENESS = 0.8

_HEX = np.frombuffer(b"0123456789abcdef", np.uint8)


@lru_cache(1)
def _dwell() -> tuple[np.ndarray, list[bytes]]:
    """How many steps a pointer stays on a character of each class that it reaches at each step, and on
    two characters in a row, for each pair of classes."""
    bits = np.unpackbits(np.frombuffer(hashlib.shake_256(b"walk").digest(CLASSES * PERIOD // 8), np.uint8)).reshape(CLASSES, PERIOD)
    one = np.ones((CLASSES, PERIOD), np.uint8)
    for row, stay in zip(bits.tolist(), one, strict=True):
        n = 1
        for j in range(2 * PERIOD - 1, -1, -1):  # twice round, since the bits repeat
            n = 1 if row[j % PERIOD] else n + 1
            stay[j % PERIOD] = min(n, 127)
    then = (np.arange(PERIOD) + one) % PERIOD
    return one, [(one[a] + one[b][then[a]]).tobytes() for a in range(CLASSES) for b in range(CLASSES)]


@lru_cache(64)
def _octave(k: int) -> np.ndarray:
    """Sampled steps of the k-th doubling."""
    if k == 0:
        return np.arange(SAMPLES, dtype=np.int64)
    width = 1 << (k - 1)
    noise = np.frombuffer(hashlib.shake_256(f"sample {k}".encode()).digest(8 * SAMPLES), "<u8")
    return SAMPLES * width + np.arange(SAMPLES, dtype=np.int64) * width + (noise % np.uint64(width)).astype(np.int64)


@lru_cache(64)
def _steps(octaves: int) -> np.ndarray:
    return np.concatenate([_octave(k) for k in range(octaves)])


@lru_cache(64)
def _weights(octaves: int) -> np.ndarray:
    """Steps that the first samples stand for, summed up; the first entry is 0."""
    width = np.concatenate([np.full(SAMPLES, 1 << max(0, k - 1), np.int64) for k in range(octaves)])
    return np.concatenate([np.zeros(1, np.int64), width.cumsum()])


def _walk(points: np.ndarray, j: int) -> tuple[np.ndarray, int]:
    """Samples written by a pointer that reaches the first of these code points at step j, and the step
    at which it leaves the last one."""
    (one, two), out, last = _dwell(), [], PERIOD - 1
    for at in range(0, len(points), CHUNK):
        own, began = points[at:at + CHUNK], j
        kinds = (own * np.uint32(0x9E3779B1) >> np.uint32(28)).astype(np.uint8)
        paired = len(kinds) // 2 * 2
        pairs = (kinds[0:paired:2] * CLASSES + kinds[1:paired:2]).tobytes()
        ends = np.array([began] + [j := j + t[j & last] for t in map(two.__getitem__, pairs)], np.int64)
        if paired < len(kinds):
            j += int(one[kinds[-1], j & last])
        steps = _steps((j // SAMPLES).bit_length() + 1)
        wanted = steps[np.searchsorted(steps, began):np.searchsorted(steps, j)]
        pair = np.searchsorted(ends, wanted, side="right") - 1
        second = wanted >= ends[pair] + one[kinds[2 * pair], ends[pair] & last]
        out.append((own[2 * pair + second] * np.uint32(0x85EBCA6B) >> np.uint32(28)).astype(np.uint8))
    return np.concatenate(out) if out else np.zeros(0, np.uint8), j


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _digits(samples: np.ndarray) -> str:
    return _HEX[samples].tobytes().decode()


def fingerprint(text: str | None) -> str:
    return _digits(_walk(_points(text or ""), 0)[0])


def likeness(a: str, b: str) -> float:
    """Share of steps at which two walks agree, by their samples."""
    x, y = (np.frombuffer(s.encode(), np.uint8) for s in (a, b))
    least, most = sorted((len(x), len(y)))
    if not most:
        return 1.0
    total = _weights(-(-most // SAMPLES))
    return float(np.diff(total[:least + 1])[x[:least] == y[:least]].sum() / total[most])


def bands(print_: str) -> list[str]:
    """Keys of a fingerprint: texts with a key in common are candidates. A walk too short for a whole
    doubling has one key, all its samples."""
    whole = len(print_) // SAMPLES
    if not whole:
        return [print_]
    return [f"{at}:{print_[at:at + BAND]}" for at in range(max(0, whole - 2) * SAMPLES, whole * SAMPLES, BAND)]


def _successors(docs: DataFrame, id_col: str, parts: int) -> DataFrame:
    """Rows of (part, extra, id, place, text) such that a part, in descending order of (id, place), holds a
    stretch of the documents and, as extra, the document that comes next. Texts are moved once; ids alone
    tell where to cut, and which documents are first in a part."""
    ids = docs.select(F.coalesce(id_col, F.lit(-(2**63))).alias("id"), F.xxhash64("text").alias("place"))
    n = ids.count()
    fraction = min(1.0, min(20 * parts, RANGE_SAMPLE) / max(n, 1))
    seen = sorted((-r["id"], -r["place"]) for r in ids.sample(fraction, seed=1).collect())
    cuts = sorted({seen[len(seen) * i // parts] for i in range(1, parts)}) if seen else []

    @F.pandas_udf("int")
    def part_of(id_: pd.Series, place: pd.Series) -> pd.Series:
        return pd.Series([bisect_left(cuts, (-i, -p)) for i, p in zip(id_.tolist(), place.tolist(), strict=True)], dtype="int32")

    heads = ids.groupBy(part_of("id", "place").alias("part")).agg(F.max(F.struct("id", "place")).alias("head")).collect()  # a row a part
    heads = sorted((r["part"], (r["head"]["id"], r["head"]["place"])) for r in heads)
    before = {head: heads[i - 1][0] for i, (_, head) in enumerate(heads)}  # the first document follows the last part

    @F.pandas_udf("array<int>")
    def goes_to(id_: pd.Series, place: pd.Series) -> pd.Series:
        found = []
        for key in zip(id_.tolist(), place.tolist(), strict=True):
            own = bisect_left(cuts, (-key[0], -key[1]))
            found.append([own, before[key]] if key in before else [own])
        return pd.Series(found)

    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(id_col, F.lit(-(2**63))).alias("id"), F.xxhash64("text").alias("place"), "text")
    rows = rows.select("doc_id", "id", "place", "text", F.posexplode(goes_to("id", "place")).alias("extra", "part"))
    return rows.repartitionById(parts, "part").sortWithinPartitions("part", "extra", F.desc("id"), F.desc("place"))


_EDITED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, banded_edited boolean, banded_next boolean"


class _Document:
    """A text's walk, split where its edited text begins to differ."""

    def __init__(self, doc_id, text: str):
        self.doc_id, self.points = doc_id, _points(text)
        self.tail = len(self.points) // 3
        kept = len(self.points) - self.tail
        self.head, self.step = _walk(self.points[:kept], 0)
        self.print = _digits(np.concatenate([self.head, _walk(self.points[kept:], self.step)[0]]))
        self.bands = set(bands(self.print))

    def told(self, after: _Document) -> tuple:
        kept, new = self.points[:len(self.points) - self.tail], after.points[:self.tail]
        edited = _digits(np.concatenate([self.head, _walk(new, self.step)[0]]))
        digest = hashlib.sha256(np.concatenate([kept, new]).tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")).hexdigest()
        near = likeness(self.print, edited), likeness(self.print, after.print)
        return self.doc_id, len(self.points), digest, self.print, edited, *near, not self.bands.isdisjoint(bands(edited)), not self.bands.isdisjoint(after.bands)


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in _EDITED.split(", ")]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.bool_(), pa.bool_()]
    part = last = None
    for batch in batches:
        found = []
        for own, extra, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("part", "extra", "doc_id", "text")), strict=True):
            if own != part:
                part, last = own, None
            if extra and last is None:
                continue
            now = _Document(doc_id, text)
            if last is not None:
                found.append(last.told(now))
            last = None if extra else now
        columns = zip(*found, strict=True) if found else [()] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=names)


def edit_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every document and of its edited text, the last third replaced by the start of the
    next document, with the likeness of its fingerprint to the edited and to the next one's.

    ``banded_edited`` and ``banded_next`` tell whether the pair shares a band, that is, whether a search
    would meet it; the likeness verifies it.
    """
    docs = bounded(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text")))
    rows = _successors(docs, "doc_id", int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return rows.select("part", "extra", "doc_id", "text").mapInArrow(_compared, _EDITED)


@F.pandas_udf(StringType())
def _fingerprint(text: pd.Series) -> pd.Series:
    return text.map(fingerprint)


@F.pandas_udf(ArrayType(StringType()))
def _bands(prints: pd.Series) -> pd.Series:
    return prints.map(bands)


@F.pandas_udf(DoubleType())
def _likeness(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([likeness(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return bounded(docs).select(F.col(id_col).alias("doc_id"), _fingerprint(F.coalesce(text_col, F.lit(""))).alias("fingerprint"))


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = LIKENESS) -> DataFrame:
    """(doc_id, class_id) of every document: class_id is the least id of the documents that it is linked with.

    Equal fingerprints are one row. Each band's rows are verified against the band's first one, never in
    all pairs, so a band of any size costs as many comparisons as it has rows; two copies meet in each of
    up to 16 bands. Links are those with a likeness of ``least`` or more; classes are what they connect.
    Rows without id are left out. An id that stands on several texts has the class of each of them.
    """
    prints = save(fingerprints(docs, id_col, text_col).where("doc_id is not null"), "prints")
    one = save(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("node")), "distinct-prints")
    keys = one.select("node", F.explode(_bands("fingerprint")).alias("band"))
    firsts = keys.groupBy("band").agg(F.min("node").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    pairs = keys.join(firsts, "band").where("node <> first").select("node", "first").distinct()
    told = pairs.join(one, "node").withColumnRenamed("fingerprint", "a").join(one.select(F.col("node").alias("first"), F.col("fingerprint").alias("b")), "first")
    links = save(told.where(_likeness("a", "b") >= least).select(F.col("node").alias("a"), F.col("first").alias("b")), "links")
    roots = components(links)
    named = one.join(roots, "node", "left").select("fingerprint", F.coalesce("root", "node").alias("class_id"))
    return prints.join(named, "fingerprint").select("doc_id", "class_id")


def same_bands(a: Column, b: Column) -> Column:
    """Whether two fingerprints share a band."""
    return F.arrays_overlap(_bands(a), _bands(b))
