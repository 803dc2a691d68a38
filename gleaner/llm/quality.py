"""Quality classifier: similarity-weighted voting of labelled neighbours in a latent-semantic space.

A text is a bag of terms that no language owns: pairs and triples of character classes, each word's
shape, and a few coarse steps of how much the text repeats itself. Terms are weighted by the log of
their share and the inverse document frequency of the labelled sample, whose truncated singular value
decomposition gives the latent space. The sample, SAMPLE labelled rows at most (a documented bound),
is the only thing learnt from; its vectors are broadcast, and each text's cosines with all of them
are computed exactly, in blocks of texts. The NEIGHBOURS nearest vote, weighted by a power of their
similarity and so that both labels count by their share in the corpus.

The score is the weighted share of the votes for label 1. Null and empty texts have no terms; they
and texts at right angles to all labelled rows get the sample's share of label 1. Repeated rows each
get a row; labels of a repeated id vote for each of its texts. Without labelled rows every score is
0.5. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded

SAMPLE = 4096
RANK, NEIGHBOURS, POWER = 48, 25, 4
THRESHOLD = 0.7
HELD_OUT, FOLDS = 2, 4
BLOCK = 256

#: Classes of bytes: 0 lower case, 1 upper case, 2 digit, 3 blank, 4 line end, 5 and on: other ASCII marks; bytes of other letters count as lower case.
_MARKS = [c for c in range(33, 127) if not chr(c).isalnum()]
N_CLASSES = 5 + len(_MARKS)
_CLASS = bytes(
    1 if 65 <= c <= 90 else 2 if 48 <= c <= 57 else 4 if c in (10, 13) else 3 if c <= 32 or c == 127 else 5 + _MARKS.index(c) if c in _MARKS else 0
    for c in range(256)
)
#: Of triples only the seven classes that stand for kinds of characters are told apart.
_KIND = np.array([0, 1, 2, 3, 4] + [5 if chr(c) in ".,;:'\"?()-" else 6 for c in _MARKS], np.int64)
N_PAIRS, N_TRIPLES = N_CLASSES**2, 343
STEPS = 12
N_MEASURES = 6
N_TERMS = N_PAIRS + N_TRIPLES + STEPS * N_MEASURES
#: How much one coarse step weighs against the share of all pairs.
STEP_WEIGHT = 0.05


def _step(x: float) -> int:
    return min(STEPS - 1, int(x * STEPS))


def terms(text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """(term numbers, shares) of a whole text."""
    if not text or not text.strip():
        return np.empty(0, np.int64), np.empty(0)
    c = np.frombuffer(text.translate(_CLASS), np.uint8).astype(np.int64)
    k = _KIND[c]
    pairs = np.bincount(c[:-1] * N_CLASSES + c[1:], minlength=N_PAIRS) / len(c)
    triples = np.bincount(k[:-2] * 49 + k[1:-1] * 7 + k[2:], minlength=N_TRIPLES) / len(c)
    words = text.split()
    count = Counter(words)
    again = sum(a == b for a, b in zip(words, words[1:])) / len(words)
    sizes = np.bincount(k, minlength=7) / len(k)
    measures = (
        again, max(count.values()) / len(words), 1 - len(count) / len(words) / max(0.1, min(1.0, 8 / len(words) ** 0.35)),
        2 * sizes[1], 2 * sizes[6], sum(len(w) for w in words) / len(words) / 16,
    )
    steps = np.zeros(STEPS * N_MEASURES)
    for i, m in enumerate(measures):
        steps[i * STEPS + _step(max(0.0, float(m)))] = STEP_WEIGHT
    dense = np.concatenate([pairs, triples, steps])
    at = np.flatnonzero(dense)
    return at, dense[at]


def term_matrix(texts: list[bytes | None]) -> np.ndarray:
    out = np.zeros((len(texts), N_TERMS), np.float32)
    for i, t in enumerate(texts):
        at, share = terms(t)
        out[i, at] = np.log1p(200 * share)
    return out


class Space:
    """The latent space of a labelled sample, and its vectors."""

    def __init__(self, x: np.ndarray, labels: np.ndarray, rank: int = RANK):
        self.labels = labels.astype(np.float64)
        self.share = float(self.labels.mean()) if len(labels) else 0.5
        self.idf = np.log((1 + len(x)) / (1 + (x > 0).sum(0))).astype(np.float32) + 1
        if len(x):
            weighted = self._unit(x * self.idf)
            values, vectors = np.linalg.eigh((weighted.T @ weighted).astype(np.float64))
            self.axes = vectors[:, ::-1][:, :rank].astype(np.float32)
            self.vectors = self._unit(weighted @ self.axes)
        else:
            self.axes, self.vectors = np.zeros((N_TERMS, 1), np.float32), np.zeros((0, 1), np.float32)

    @staticmethod
    def _unit(x: np.ndarray) -> np.ndarray:
        size = np.linalg.norm(x, axis=1, keepdims=True)
        return x / np.where(size > 0, size, 1)

    def scores(self, texts: list[bytes | None], neighbours: int = NEIGHBOURS) -> np.ndarray:
        out = np.full(len(texts), self.share)
        if not len(self.vectors):
            return out
        own = self._unit(self._unit(term_matrix(texts) * self.idf) @ self.axes)
        cosines = own @ self.vectors.T
        k = min(neighbours, cosines.shape[1])
        near = np.argpartition(-cosines, k - 1, axis=1)[:, :k]
        # How far a neighbour is counts against the spread of the text's own neighbours.
        sims = np.maximum(np.take_along_axis(cosines, near, 1), 0).astype(np.float64)
        gap = 1 - np.minimum(sims, 1)
        weight = sims / (gap + 1e-3 + gap.mean(1, keepdims=True)) ** POWER
        total = weight.sum(1)
        some = (total > 0) & (np.abs(own).sum(1) > 0)
        # A tenth of a neighbour's weight stands for the prior, so that equal votes have no ties at 0 or 1.
        prior = 0.1 * weight.max(1, initial=0)
        np.divide((weight * self.labels[near]).sum(1) + prior * self.share, total + prior, out=out, where=some)
        return np.clip(out, 0, 1)


def held_out(id_col) -> object:
    """Whether a row is held out: crc32 of its id as text, modulo FOLDS, is HELD_OUT."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a in range(0, batch.num_rows, BLOCK):
            part = batch.slice(a, BLOCK)
            rows = [zlib.compress(row.tobytes(), 1) for row in term_matrix([t.as_py() for t in part.column("text")])]
            yield pa.RecordBatch.from_arrays([part.column("label"), part.column("turn"), pa.array(rows, pa.binary())], ["label", "turn", "terms"])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> Space:
    """The space of ``sample`` labelled rows at most, the first by a hash of their id. Held-out rows
    and rows without a label or id are never among them."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    picked = known.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("label")).distinct()
    picked = picked.orderBy(F.xxhash64("_id", F.lit(17)), "_id", "label").limit(sample)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("binary").alias("text")).join(F.broadcast(picked), "_id")
    turn = F.xxhash64("_id", F.xxhash64("text"))
    rows = rows.select("label", "text", turn.alias("turn")).mapInArrow(_vectors, "label int, turn long, terms binary")
    # As many rows as were picked, unless an id has several texts.
    found = rows.orderBy("turn", "label").limit(sample).collect()
    x = np.stack([np.frombuffer(zlib.decompress(r.terms), np.float32) for r in found]) if found else np.zeros((0, N_TERMS), np.float32)
    return Space(x, np.array([r.label for r in found], np.int64))


def _scorer(space):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = space.value
        for batch in batches:
            for a in range(0, batch.num_rows, BLOCK):
                part = batch.slice(a, BLOCK)
                score = model.scores([t.as_py() for t in part.column(part.num_columns - 1)])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score)], ["id", "score"])

    return run


def score(docs: DataFrame, space: Space, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(id, held_out, score, predicted) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(space)
    rows = bounded(docs).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    scored = rows.mapInArrow(_scorer(shared), "id long, score double")
    return scored.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def _keeper(space, text_at: int, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = space.value
        for batch in batches:
            for a in range(0, batch.num_rows, BLOCK):
                part = batch.slice(a, BLOCK)
                texts = [None if t is None else t.encode() for t in part.column(text_at).to_pylist()]
                yield part.filter(pa.array(model.scores(texts) >= threshold))

    return run


def keep_good(docs: DataFrame, space: Space, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose score reaches the threshold, as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(space)
    return bounded(docs).mapInArrow(_keeper(shared, docs.columns.index(text_col), threshold), docs.schema)
