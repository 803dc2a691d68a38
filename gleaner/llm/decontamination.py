"""Benchmark decontamination: SimHash item-sized windows, multi-index Hamming blocks, exact check.

A benchmark item of n words is compared with every window of n words of every text. Windows that
share no word shingle with any item of their size have similarity zero and are never fingerprinted.
A window's fingerprint has the majority bits of its shingles' hashes. The items' fingerprints are
indexed by RADIUS + 1 blocks of bits: two fingerprints within RADIUS bits agree in at least one
block, so looking up every block finds all items within the radius. Each candidate's weighted
similarity is then counted exactly: shingles with their numbers of occurrences, the sum of the lesser
over the sum of the greater numbers. A document is reported for an item if any window has SIMILARITY
or more; the most similar window (ties: the first) is given.

Fingerprints have BITS bits, of which a window just at the similarity differs in about BITS / 7; the
radius lies far above that. Benchmarks are taken in blocks of ITEMS_PER_PASS items, so what a pass
sends to its tasks is bounded whatever the size of the benchmark.

Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z. Items of fewer words than a shingle are one
shingle of all their words and match only themselves. Null and empty texts and items match nothing.
Repeated rows of an item count once (equal ids and texts); rows of a document are each compared and
reported. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, fresh, save, words_of

SHINGLE, SIMILARITY = 5, 0.8
BITS, RADIUS = 128, 47
ITEMS_PER_PASS, ITEM_BYTES = 5_000, 1 << 16
REMEMBERED = 150_000
FOUND = "doc_id long, item_id long, first_word long, n_words int, similarity double"

_words: dict[bytes, int] = {}


def word_hashes(words: list[bytes]) -> np.ndarray:
    """XXH64 of each word; a worker remembers them, for speed alone."""
    try:
        return np.array([*map(_words.__getitem__, words)], np.uint64)
    except KeyError:
        if len(_words) > REMEMBERED:
            _words.clear()
        for w in set(words):
            if w not in _words:
                _words[w] = xxhash.xxh64_intdigest(w)
        return np.array([*map(_words.__getitem__, words)], np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of k words in order."""
    n = len(hashes) - k + 1
    if n < 1:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + hashes[i:i + n])
    return out


def _bits(h: np.ndarray) -> np.ndarray:
    """The BITS bits of each shingle hash, from the hash and one more mixing."""
    with np.errstate(over="ignore"):
        both = np.stack([h, *(mixed(h + np.uint64(i)) for i in range(1, BITS // 64))], axis=1)
    return np.unpackbits(np.ascontiguousarray(both).view(np.uint8), axis=1, bitorder="little")


def window_fingerprints(h: np.ndarray, n: int) -> np.ndarray:
    """Majority bits (rows of BITS // 8 bytes) of each window of n consecutive shingles."""
    counts = np.zeros((len(h) + 1, BITS), np.int32)
    np.cumsum(_bits(h), axis=0, dtype=np.int32, out=counts[1:])
    return np.packbits(2 * (counts[n:] - counts[:-n]) > n, axis=1, bitorder="little")


def blocks(fps: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """The radius + 1 blocks of each fingerprint as small numbers, told apart by their place."""
    edges = np.linspace(0, BITS, radius + 2).astype(int)
    bits = np.unpackbits(fps, axis=1, bitorder="little")
    return np.stack([(bits[:, a:b] * (1 << np.arange(b - a))).sum(1) for a, b in zip(edges, edges[1:])], axis=1)


class ItemIndex:
    """The items of a pass: shingles, fingerprints and block index, by size."""

    def __init__(self, items: list[tuple[int, bytes]], k: int = SHINGLE, radius: int = RADIUS):
        self.k, self.radius = k, radius
        self.by_shape: dict[tuple[int, int], list[int]] = defaultdict(list)
        self.ids, self.sets, self.owns = [], [], []
        for item_id, text in items:
            words = words_of(text)
            if words:
                own = min(k, len(words))
                self.by_shape[own, len(words)].append(len(self.ids))
                self.ids.append(item_id)
                self.owns.append(own)
                self.sets.append(Counter(shingles(word_hashes(words), own).tolist()))
        self.fps, self.index = {}, {}
        for (own, n), rows in self.by_shape.items():
            # An item's own fingerprint is that of its only window.
            fps = np.concatenate([window_fingerprints(np.array([*self.sets[i].elements()], np.uint64), n - own + 1) for i in rows])
            self.fps[own, n] = fps
            table: list[dict[int, list[int]]] = [defaultdict(list) for _ in range(radius + 1)]
            for i, values in enumerate(blocks(fps, radius).tolist()):
                for slot, value in zip(table, values):
                    slot[value].append(i)
            self.index[own, n] = table
        self.known = {own: np.unique(np.array([s for o, c in zip(self.owns, self.sets) for s in c if o == own], np.uint64)) for own in set(self.owns)}
        self.shapes_of: dict[int, set[tuple[int, int]]] = defaultdict(set)
        for shape, rows in self.by_shape.items():
            for i in rows:
                for s in self.sets[i]:
                    self.shapes_of[s].add(shape)

    def near(self, shape: tuple[int, int], fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item of the shape) of all pairs within the radius, by the block index."""
        w_out, i_out = [], []
        for w, values in enumerate(blocks(fps, self.radius).tolist()):
            met = {i for slot, value in zip(self.index[shape], values) for i in slot.get(value, ())}
            w_out += [w] * len(met)
            i_out += sorted(met)
        w, i = np.array(w_out, np.int64), np.array(i_out, np.int64)
        if not len(w):
            return w, i
        away = np.bitwise_count(fps[w] ^ self.fps[shape][i]).sum(1, dtype=np.int64)
        return w[away <= self.radius], i[away <= self.radius]

    def search(self, text: bytes | None, similarity: float = SIMILARITY) -> list[tuple[int, int, int, float]]:
        """(item, first word, words, similarity) of the best window for each item found in a text."""
        words = words_of(text)
        if not words:
            return []
        hashes, best = word_hashes(words), {}
        for own, known in self.known.items():
            h = shingles(hashes, own)
            if not len(h) or not len(known):
                continue
            hit = np.flatnonzero(known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h)
            starts: dict[tuple[int, int], set[int]] = defaultdict(set)
            for j in hit.tolist():
                for shape in self.shapes_of[int(h[j])]:
                    n = shape[1] - own + 1
                    if shape[0] == own:
                        starts[shape].update(range(max(0, j - n + 1), min(j, len(h) - n) + 1))
            for shape, at in starts.items():
                n, where = shape[1] - own + 1, np.array(sorted(at), np.int64)
                # Runs of windows are summed together; far ones alone.
                for run in np.split(where, np.flatnonzero(np.diff(where) > 4 * n) + 1):
                    if not len(run):
                        continue
                    a = int(run[0])
                    fps = window_fingerprints(h[a:int(run[-1]) + n], n)[run - a]
                    for w, i in zip(*(x.tolist() for x in self.near(shape, fps))):
                        item, s = self.by_shape[shape][i], int(run[w])
                        own_set = Counter(h[s:s + n].tolist())
                        both = (own_set & self.sets[item]).total()
                        sim = both / (2 * n - both)
                        if sim >= similarity and (item not in best or (-sim, s) < best[item][:2]):
                            best[item] = (-sim, s, shape[1])
        return [(self.ids[i], s, n, -sim) for i, (sim, s, n) in best.items()]


def _search(index: ItemIndex, similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(d, *x) for d, t in zip(batch.column(0).to_pylist(), batch.column(1)) for x in index.search(t.as_py(), similarity)]
            cells = zip(*rows) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.float64()))], ["doc_id", "item_id", "first_word", "n_words", "similarity"])

    return run


def _leaky(index: ItemIndex, similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(d, hashlib.sha256(t.as_py()).digest()) for d, t in zip(batch.column(0).to_pylist(), batch.column(1)) if index.search(t.as_py(), similarity)]
            yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in rows], pa.int64()), pa.array([h for _, h in rows], pa.binary())], ["id", "digest"])

    return run


def _passes(benchmark: DataFrame, item_id: str, item_text: str) -> Iterator[list[tuple[int, bytes]]]:
    """The benchmark in blocks of ITEMS_PER_PASS rows at most; one block is in the driver at a time."""
    rows = benchmark.select(F.col(item_id).cast("long"), F.col(item_text).cast("binary")).distinct()
    block, size = [], 0
    for r in rows.toLocalIterator():
        if r[1]:
            if block and (len(block) >= ITEMS_PER_PASS or size + len(r[1]) > ITEMS_PER_PASS * ITEM_BYTES // 16):
                yield block
                block, size = [], 0
            block.append((r[0], bytes(r[1])))
            size += len(r[1])
    if block:
        yield block


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", k: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """(id, item_id, first_word, n_words, similarity): a row for each document row and item that it holds."""
    texts = bounded(docs).select(F.col(id_col).cast("long"), F.col(text_col).cast("binary"))
    found = [texts.mapInArrow(_search(ItemIndex(block, k), similarity), FOUND) for block in _passes(benchmark, item_id, item_text)]
    out = reduce(DataFrame.unionByName, found) if found else docs.sparkSession.createDataFrame([], FOUND)
    return out.withColumnRenamed("doc_id", id_col)


def drop_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", k: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` without the documents that hold a benchmark item. A row is known by its id and its
    text's SHA-256, so of rows with equal ids, or with none, only those with a leak go."""
    texts = bounded(docs).select(F.col(id_col).cast("long"), F.col(text_col).cast("binary"))
    found = [texts.mapInArrow(_leaky(ItemIndex(block, k), similarity), "id long, digest binary") for block in _passes(benchmark, item_id, item_text)]
    if not found:
        return docs
    hits = save(reduce(DataFrame.unionByName, found).distinct(), "leaks")
    row, digest = fresh(docs, "_row", "_digest")
    gone = hits.select(F.col("id").alias(row), F.col("digest").alias(digest))
    same = F.col(id_col).cast("long").eqNullSafe(F.col(row)) & (F.unhex(F.sha2(F.col(text_col).cast("binary"), 256)) == F.col(digest))
    return docs.join(gone, same, "left_anti")
