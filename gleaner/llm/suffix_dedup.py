"""Removal of passages repeated across documents, by difference-cover suffix sorting.

A byte goes if a string of LENGTH bytes that covers it also starts in a document with a smaller id.

A difference-cover sort of every suffix of the corpus moves each byte through several shuffles. Here
it sorts the suffixes of only those stretches that may repeat, dealt so that equal strings meet:

0. Copies. Of equal texts only the one with the least id is looked at further; the others go whole.
1. Anchors. In every LENGTH-byte string the least hashed gram of GRAM bytes is its anchor, a function
   of the string alone, so equal strings have equal anchors at equal places. About one position in
   sixteen is an anchor. Grams are dealt by hash; those seen in two documents survive.
2. Contexts. The bytes around a surviving anchor hold the strings that it anchors, which start one
   after another. Contexts are dealt
   by their gram, each distinct one once from a task. The strings of grams that more than 1 / MAX_HOT
   of all survivors have are dealt one by one by their own hash instead: common ones collapse in each
   task, and the others spread.
3. Sorting. Each bucket's contexts are sorted as suffixes: triples at positions 1 and 2 modulo 3 are
   sorted and named, the names are sorted in the same way until they stand for LENGTH bytes, the other
   suffixes are sorted by their first byte and the next one's rank and merged in. Adjacent suffixes
   are then compared byte by byte; equal ones form a group whose least document keeps its bytes.
4. Runs. The strings that go are merged to runs in each document and cut out.

Null texts count as empty. A null id is larger than any other. Rows with the same id never remove
each other's bytes; rows with the same id and text have the same result. Texts shorter than LENGTH
stay whole. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, discard, fresh, save

LENGTH, GRAM = 50, 20
WINDOW = LENGTH - GRAM + 1
#: Texts are hashed in pieces of so many windows, so that memory is bounded for any length. A
#: place in a piece has 16 bits and a gram's hash 48.
PIECE, HASH_BYTES = 1 << 15, 6
ANCHORS_PER_BUCKET, CONTEXT_BYTES_PER_BUCKET = 1 << 19, 1 << 22
FLUSH_ANCHORS, FLUSH_CONTEXTS = 1 << 20, 1 << 19
MAX_HOT, LEAST_HOT = 10_000, 20_000
NO_ID = (1 << 63) - 1
#: Names of the k-th level stand for 3**k bytes.
LEVELS = next(k for k in range(1, 9) if 3**k >= LENGTH)


# --- Anchors --------------------------------------------------------------------------------

def gram_hashes(x: np.ndarray, k: int = GRAM) -> np.ndarray:
    """A 48-bit hash of each run of k bytes, from hashes of runs of 1, 2, 4 ... bytes."""
    power = 0x9E3779B97F4A7C15
    runs, done, out = x.astype(np.uint64) + np.uint64(1), 0, None
    size, p, todo = 1, power, k
    with np.errstate(over="ignore"):
        while todo:
            if todo & size:
                # Runs of this size follow those gathered so far.
                out = runs if out is None else out[:len(x) - done - size + 1] * np.uint64(p) + runs[done:]
                done, todo = done + size, todo - size
            runs = runs[:-size] * np.uint64(p) + runs[size:] if todo and len(runs) > size else runs
            size, p = 2 * size, p * p % (1 << 64)
        out = out[:len(x) - k + 1]
        out = (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        out = (out ^ (out >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return out >> np.uint64(64 - 8 * HASH_BYTES)


def anchors(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, first starts, last starts): for each anchor in turn its hash and the starts of the
    LENGTH-byte strings that it anchors, which follow one another."""
    out = []
    x = np.frombuffer(text, np.uint8)
    for a in range(0, len(x) - LENGTH + 1, PIECE):
        h = gram_hashes(x[a:a + PIECE + LENGTH - 1])
        # The leftmost of equal hashes is the least.
        least = h << np.uint64(16) | np.arange(len(h), dtype=np.uint64)
        reach = 1
        while 2 * reach <= WINDOW:
            least, reach = np.minimum(least[:-reach], least[reach:]), 2 * reach
        rest = WINDOW - reach
        least = np.minimum(least[:len(least) - rest], least[rest:])
        first = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
        at = (least[first] & np.uint64((1 << 16) - 1)).astype(np.int64)
        out.append(np.stack([h[at].astype(np.int64), first + a, np.r_[first[1:], len(least)] - 1 + a]))
    return tuple(np.concatenate(out, axis=1)) if out else (np.empty(0, np.int64),) * 3


# --- Difference-cover suffix sorting -----------------------------------------------------------

def _pairs(s: np.ndarray, base: int, room: int) -> np.ndarray:
    """A number for each two neighbours, in their order, small enough to be multiplied by room."""
    pair = s[:-1] * base + s[1:]
    return pair if base * base * room < 1 << 62 else np.unique(pair, return_inverse=True)[1].reshape(-1)


def suffix_order(s: np.ndarray, levels: int = LEVELS) -> np.ndarray:
    """Suffixes of a row of numbers from 1 up, in the order of their first 3**levels numbers at least."""
    n = len(s)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), np.int64)
    s = np.concatenate([s.astype(np.int64), np.zeros(5, np.int64)])
    base, end = int(s.max()) + 1, n + (n % 3 == 1)
    sample = np.concatenate([np.arange(1, end, 3), np.arange(2, end, 3)])
    m = len(sample)
    pair = _pairs(s, base, max(base, m + 2))
    triple = pair[sample] * base + s[sample + 2]
    order = np.argsort(triple, kind="stable")
    names = np.empty(m, np.int64)
    names[order] = np.cumsum(np.r_[True, np.diff(triple[order]) != 0])
    if levels > 1 and names.max() < m:
        order = suffix_order(names, levels - 1)
    rank = np.zeros(n + 5, np.int64)
    rank[sample[order]] = np.arange(1, m + 1)
    sampled = sample[order]
    sampled = sampled[sampled < n]
    others = np.arange(0, n, 3)
    others = others[np.argsort(s[others] * (m + 2) + rank[others + 1], kind="stable")]
    one, two = sampled[sampled % 3 == 1], sampled[sampled % 3 == 2]
    before = np.searchsorted(s[one] * (m + 2) + rank[one + 1], s[others] * (m + 2) + rank[others + 1])
    before = before + np.searchsorted(pair[two] * (m + 2) + rank[two + 2], pair[others] * (m + 2) + rank[others + 2])
    # Suffixes alike in all that was sorted may come in any order; each still needs a place of its own.
    place = np.arange(len(others)) + np.maximum.accumulate(before)
    out, free = np.empty(n, np.int64), np.ones(n, bool)
    out[place], free[place] = others, False
    out[free] = sampled
    return out


def least_documents(items: list[bytes], docs: np.ndarray) -> np.ndarray:
    """For each item (row) and start of a LENGTH-byte string in it (column): the least document of
    any item that holds the string. Starts that the item lacks are NO_ID."""
    sizes = np.array([len(x) for x in items], np.int64)
    text = np.frombuffer(b"\0".join(items) + bytes(LENGTH), np.uint8).copy()
    begin = np.cumsum(sizes + 1) - sizes - 1
    numbers = text[:int(sizes.sum()) + len(items)].astype(np.int64) + 2
    numbers[begin + sizes] = 1
    order = suffix_order(numbers)
    item = np.repeat(np.arange(len(items)), sizes + 1)
    start = np.arange(len(numbers)) - begin[item]
    order = order[start[order] <= sizes[item[order]] - LENGTH]
    strings = np.lib.stride_tricks.sliding_window_view(text, LENGTH)
    new = np.ones(len(order), bool)
    for a in range(1, len(order), 1 << 16):
        b = min(len(order), a + (1 << 16))
        new[a:b] = (strings[order[a:b]] != strings[order[a - 1:b - 1]]).any(1)
    group = np.cumsum(new) - 1
    least = np.minimum.reduceat(docs[item[order]], np.flatnonzero(new)) if len(order) else np.empty(0, np.int64)
    out = np.full((len(items), int(sizes.max()) - LENGTH + 1), NO_ID, np.int64)
    out[item[order], start[order]] = least[group]
    return out


# --- Spark stages -------------------------------------------------------------------------------

def _pack(x: np.ndarray) -> bytes:
    """A column of numbers, as differences, compressed: most of them are small."""
    raw = np.diff(x.astype(np.int64), prepend=0).tobytes()
    return len(x).to_bytes(4, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpack(blob: bytes) -> np.ndarray:
    n = int.from_bytes(blob[:4], "little")
    return np.cumsum(np.frombuffer(pa.decompress(blob[4:], 8 * n, codec="zstd", asbytes=True), np.int64))


def _pack_hashes(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :HASH_BYTES]).tobytes()


def _unpack_hashes(blob: bytes) -> np.ndarray:
    out = np.zeros((len(blob) // HASH_BYTES, 8), np.uint8)
    out[:, :HASH_BYTES] = np.frombuffer(blob, np.uint8).reshape(-1, HASH_BYTES)
    return out.view("<u8").reshape(-1).astype(np.int64)


def _by_bucket(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(bucket, kind="stable")
    if len(order):
        for rows in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
            yield int(bucket[rows[0]]), rows


def _deal_anchors(n_buckets: int):
    """Each task asks about the grams that it saw once and tells how many documents have the others;
    of a gram in many documents a bucket gets one entry from a flush of a task. Bucket -1 holds
    (document, gram) pairs that are known to repeat."""

    def rows_of(docs: list[np.ndarray], grams: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        doc, gram = np.concatenate(docs), np.concatenate(grams)
        order = np.argsort(gram, kind="stable")
        doc, gram = doc[order], gram[order]
        once = np.r_[True, (doc[1:] != doc[:-1]) | (gram[1:] != gram[:-1])]
        doc, gram = doc[once], gram[once]
        first = np.r_[True, gram[1:] != gram[:-1]]
        number = np.diff(np.r_[np.flatnonzero(first), len(gram)])
        alone = (number == 1)[np.cumsum(first) - 1]
        out = [] if alone.all() else [(-1, _pack_hashes(gram[~alone]), _pack(doc[~alone]), _pack(np.empty(0)))]
        # In the order of documents the differences between them are small.
        asked, asker, number = gram[first], doc[first], np.where(number == 1, 1, number)
        by_doc = np.argsort(asker, kind="stable")
        asked, asker, number = asked[by_doc], asker[by_doc], number[by_doc]
        out += [(b, _pack_hashes(asked[rows]), _pack(asker[rows]), _pack(number[rows])) for b, rows in _by_bucket(asked % n_buckets)]
        for a in range(0, len(out), 1024):
            cells = zip(*out[a:a + 1024])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, (pa.int64(), pa.binary(), pa.binary(), pa.binary()))], ["bucket", "grams", "docs", "numbers"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs: list[np.ndarray] = []
        grams: list[np.ndarray] = []
        size = 0
        for batch in batches:
            for d, t in zip(batch.column("doc").to_pylist(), batch.column("text")):
                h = anchors(t.as_py())[0]
                if len(h):
                    docs.append(np.full(len(h), d, np.int64))
                    grams.append(h)
                    size += len(h)
                if size >= FLUSH_ANCHORS:
                    yield from rows_of(docs, grams)
                    docs, grams, size = [], [], 0
        if docs:
            yield from rows_of(docs, grams)

    return run


def _survivors(rows: pd.DataFrame) -> pd.DataFrame:
    """(doc, gram, null) of a bucket's grams that several documents have and that a flush saw once,
    and (null, gram, number of documents) of those that very many have."""
    doc, number = (np.concatenate([_unpack(x) for x in rows[c]]) for c in ("docs", "numbers"))
    gram = np.concatenate([_unpack_hashes(x) for x in rows["grams"]])
    order = np.argsort(gram, kind="stable")
    doc, gram, number = doc[order], gram[order], number[order]
    start = np.flatnonzero(np.r_[True, gram[1:] != gram[:-1]])
    total = np.add.reduceat(number, start)
    keep = np.repeat(total > 1, np.diff(np.r_[start, len(gram)])) & (number == 1)
    many = start[total > LEAST_HOT]
    doc = pd.concat([pd.Series(doc[keep], dtype="Int64"), pd.Series([None] * len(many), dtype="Int64")])
    n = pd.concat([pd.Series([None] * int(keep.sum()), dtype="Int64"), pd.Series(total[total > LEAST_HOT], dtype="Int64")])
    return pd.DataFrame({"doc": doc, "gram": np.concatenate([gram[keep], gram[many]]), "n": n})


def _known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for g, d in zip(batch.column("grams").to_pylist(), batch.column("docs").to_pylist()):
            doc = pa.array(_unpack(d))
            yield pa.RecordBatch.from_arrays([doc, pa.array(_unpack_hashes(g)), pa.nulls(len(doc), pa.int64())], ["doc", "gram", "n"])


CONTEXTS = "bucket long, items binary, n_bytes long, sizes binary, grams binary, item binary, doc binary, tag binary, start binary"


def _squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed one by one, which takes half the shuffle's own compression of them."""
    codec = pa.Codec("zstd", compression_level=3)
    for batch in batches:
        packed = [codec.compress(t.as_buffer(), asbytes=True) for t in batch.column("text")]
        sizes = pa.compute.binary_length(batch.column("text"))
        yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("tag"), sizes, pa.array(packed, pa.binary())], ["doc", "tag", "size", "text"])


def _deal_contexts(n_buckets: int, hot: np.ndarray):
    """Distinct contexts and the places that have them, for each bucket."""

    def rows_of(found: dict[bytes, int], grams: list[np.ndarray], members: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        items, gram = [*found], np.concatenate(grams)
        key = gram.copy()
        for i in np.flatnonzero(gram < 0).tolist():
            key[i] = xxhash.xxh64_intdigest(items[i]) >> 1
        bucket = key % n_buckets
        # Items are numbered anew within their bucket, in the order in which they were found.
        order = np.argsort(bucket, kind="stable")
        begins = np.r_[0, np.flatnonzero(np.diff(bucket[order])) + 1]
        local = np.empty(len(items), np.int64)
        local[order] = np.arange(len(items)) - np.repeat(begins, np.diff(np.r_[begins, len(items)]))
        sizes = np.fromiter(map(len, items), np.int64, len(items))
        place = np.concatenate(members, axis=1)
        place = place[:, np.argsort(bucket[place[0]], kind="stable")]
        owner = bucket[place[0]]
        for b, own in _by_bucket(bucket):
            item, doc, tag, start = place[:, np.searchsorted(owner, b):np.searchsorted(owner, b + 1)]
            joined = b"".join(map(items.__getitem__, own.tolist()))
            cells = [b, pa.compress(joined, codec="zstd", asbytes=True), len(joined), *map(_pack, (sizes[own], gram[own], local[item], doc, tag, start))]
            yield pa.RecordBatch.from_arrays([pa.array([c], pa.binary() if isinstance(c, bytes) else pa.int64()) for c in cells], [x.split()[0] for x in CONTEXTS.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[bytes, int] = {}
        grams: list[np.ndarray] = []
        members: list[np.ndarray] = []
        size = 0
        for batch in batches:
            wanted = batch.column("grams")
            edges, values = wanted.offsets.to_numpy(), wanted.values.to_numpy()
            for row, (doc, tag, size_of, packed) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("doc", "tag", "size", "text")))):
                text = pa.decompress(packed, size_of, codec="zstd", asbytes=True)
                h, firsts, lasts = anchors(text)
                kept = np.flatnonzero(np.isin(h, values[edges[row]:edges[row + 1]]))
                for a in range(0, len(kept), FLUSH_CONTEXTS):
                    part = kept[a:a + FLUSH_CONTEXTS]
                    g, first, last = h[part], firsts[part], lasts[part]
                    if len(hot) and (common := np.isin(g, hot)).any():
                        # Each string of a very common gram stands alone.
                        strings = np.concatenate([np.arange(x, y + 1) for x, y in zip(first[common].tolist(), last[common].tolist())])
                        first, last = np.concatenate([first[~common], strings]), np.concatenate([last[~common], strings])
                        g = np.concatenate([g[~common], np.full(len(strings), -1)])
                    before = len(found)
                    ids = np.array([found.setdefault(text[x:y + LENGTH], len(found)) for x, y in zip(first.tolist(), last.tolist())], np.int64)
                    new, where = np.unique(ids, return_index=True)
                    grams.append(g[where[new >= before]])
                    members.append(np.stack([ids, np.full(len(ids), doc), np.full(len(ids), tag), first]))
                    size += len(ids)
                    if size >= FLUSH_CONTEXTS:
                        yield from rows_of(found, grams, members)
                        found, grams, members, size = {}, [], [], 0
        if size:
            yield from rows_of(found, grams, members)

    return run


def _spans(rows: pd.DataFrame) -> pd.DataFrame:
    """(doc, tag, start, stop) of what goes, from all contexts of a bucket."""
    found: dict[bytes, int] = {}
    grams: list[np.ndarray] = []
    item, doc, tag, start = [], [], [], []
    for r in rows.itertuples():
        sizes = _unpack(r.sizes)
        ends = np.cumsum(sizes)
        joined = pa.decompress(r.items, r.n_bytes, codec="zstd", asbytes=True)
        number = np.array([found.setdefault(joined[e - n:e], len(found)) for e, n in zip(ends.tolist(), sizes.tolist())], np.int64)
        grams.append(np.stack([number, _unpack(r.grams)]))
        item.append(number[_unpack(r.item)])
        doc.append(_unpack(r.doc))
        tag.append(_unpack(r.tag))
        start.append(_unpack(r.start))
    item, doc, tag, start = map(np.concatenate, (item, doc, tag, start))
    items = list(found)
    gram = np.empty(len(items), np.int64)
    pairs = np.concatenate(grams, axis=1)
    gram[pairs[0]] = pairs[1]
    least = np.full(len(items), NO_ID, np.int64)
    np.minimum.at(least, item, doc)
    sizes = np.array([len(x) for x in items], np.int64)
    width = int(sizes.max()) - LENGTH + 1
    starts = np.arange(width)
    table = np.where(starts[None, :] <= (sizes - LENGTH)[:, None], least[:, None], NO_ID)
    # A context that is the only one of its gram repeats as a whole or not at all.
    _, inverse, number = np.unique(gram, return_inverse=True, return_counts=True)
    several = np.flatnonzero((number[inverse.reshape(-1)] > 1) & (gram >= 0))
    if len(several):
        part = least_documents([items[i] for i in several.tolist()], least[several])
        table[several[:, None], np.arange(part.shape[1])[None, :]] = part
    out = []
    for a in range(0, len(item), 1 << 16):
        own = slice(a, a + (1 << 16))
        goes = np.zeros((len(item[own]), width + 2), np.int8)
        goes[:, 1:-1] = table[item[own]] < doc[own, None]
        change = np.diff(goes, axis=1)
        r, first = np.nonzero(change == 1)
        last = np.nonzero(change == -1)[1]
        out.append(np.stack([doc[own][r], tag[own][r], start[own][r] + first, start[own][r] + last - 1 + LENGTH]))
    doc, tag, start, stop = np.concatenate(out, axis=1)
    # Runs of neighbouring anchors of a document that lie in one bucket are one.
    return pd.DataFrame({"doc": doc, "tag": tag, "start": start, "stop": stop}).drop_duplicates()


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cells = []
        for text, spans in zip(batch.column("text"), batch.column("spans").to_pylist()):
            text, runs, kept, at = text.as_py(), 0, hashlib.sha256(), 0
            stop, gone = -1, 0
            for a, z in sorted((x["start"], x["stop"]) for x in spans or ()):
                if a > stop:
                    kept.update(text[at:a])
                    runs, at = runs + 1, a
                if z > max(stop, at):
                    gone += z - max(stop, a) if stop > a else z - a
                    stop = at = z
            kept.update(text[at:])
            cells.append((len(text), gone, runs, kept.hexdigest()))
        cols = [*zip(*cells)] or [()] * 4
        yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string())))], ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _cutter(names: list[str], text_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, spans in zip(batch.column(text_at).to_pylist(), batch.column(len(names)).to_pylist()):
                if spans:
                    raw, out, at = text.encode(), [], 0
                    for a, z in sorted((x["start"], x["stop"]) for x in spans):
                        out.append(raw[at:max(at, a)])
                        at = max(at, z)
                    text = b"".join([*out, raw[at:]]).decode(errors="ignore")
                texts.append(text)
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if i == text_at else batch.column(i) for i in range(len(names))], names)

    return run


def repeated_spans(texts: DataFrame) -> DataFrame:
    """(doc, tag, spans) of the documents of ``texts`` (doc, tag, text) with bytes that go. ``doc`` is
    the id, NO_ID for null; ``tag`` tells texts with the same id apart."""
    long = texts.where(F.octet_length("text") >= LENGTH)
    rows = save(long.select("doc", "tag", F.octet_length("text").cast("long").alias("n"), F.unhex(F.sha2("text", 256)).alias("digest")), "copies")
    firsts = rows.groupBy("digest").agg(F.min("doc").alias("doc"))
    least = firsts.select("digest", F.col("doc").alias("least"))
    whole = rows.join(least, "digest").where("doc > least").select("doc", "tag", F.lit(0).cast("long").alias("start"), F.col("n").alias("stop")).distinct()
    buckets = max(1, ceil((rows.agg(F.sum("n")).first()[0] or 0) / 16 / ANCHORS_PER_BUCKET))
    dealt = save(long.select("doc", "text").mapInArrow(_deal_anchors(buckets), "bucket long, grams binary, docs binary, numbers binary"), "anchors")
    asked = dealt.where("bucket >= 0").groupBy("bucket").applyInPandas(_survivors, "doc long, gram long, n long")
    known = dealt.where("bucket < 0").mapInArrow(_known, "doc long, gram long, n long")
    pairs = save(asked.unionByName(known), "survivors")
    discard(dealt)
    n_pairs = pairs.count()
    most = max(LEAST_HOT, n_pairs // MAX_HOT)
    hot = np.array([r.gram for r in pairs.where(F.col("n") > most).select("gram").collect()], np.int64)  # MAX_HOT at most
    buckets = max(1, ceil(n_pairs * (LENGTH + WINDOW) / CONTEXT_BYTES_PER_BUCKET))
    own = pairs.where("n is null").groupBy("doc").agg(F.collect_list("gram").alias("grams"))  # a document has as many as its anchors at most
    own = own.join(firsts.select("doc").distinct(), "doc", "left_semi")
    packed = long.select("doc", "tag", "text").mapInArrow(_squeeze, "doc long, tag long, size int, text binary")
    joined = packed.join(own.hint("shuffle_hash"), "doc").select("doc", "tag", "size", "text", "grams")
    contexts = joined.mapInArrow(_deal_contexts(buckets, hot), CONTEXTS)
    spans = contexts.groupBy("bucket").applyInPandas(_spans, "doc long, tag long, start long, stop long")
    spans = save(spans.unionByName(whole).groupBy("doc", "tag").agg(F.collect_list(F.struct("start", "stop")).alias("spans")), "spans")
    discard(pairs)
    return spans


def _tag(docs: DataFrame, id_col: str, text_col: str) -> Column:
    """What tells texts with the same id apart: their hash, or nothing where no id repeats."""
    repeated = docs.groupBy(id_col).count().where("count > 1").limit(1).count()
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))) if repeated else F.lit(0).cast("long")


def _texts(docs: DataFrame, id_col: str, text_col: str, tag: Column) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    doc = F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))
    return bounded(docs).select(F.col(id_col).alias("id"), doc.alias("doc"), tag.alias("tag"), text.cast("binary").alias("text"))


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256) of each document row."""
    texts = _texts(docs, id_col, text_col, _tag(docs, id_col, text_col))
    spans = repeated_spans(texts)
    rows = texts.join(spans.hint("shuffle_hash"), ["doc", "tag"], "left").select("id", "text", "spans")
    schema = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return rows.withColumn("id", F.col("id").cast("long")).mapInArrow(_cut, schema).withColumnRenamed("id", id_col)


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the repeated bytes cut out of the texts; bytes of a letter cut in two go as well."""
    tag = _tag(docs, id_col, text_col)
    own_doc, own_tag, own_spans = fresh(docs, "_doc", "_tag", "_spans")
    spans = repeated_spans(_texts(docs, id_col, text_col, tag)).select(F.col("doc").alias(own_doc), F.col("tag").alias(own_tag), F.col("spans").alias(own_spans))
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))
    rows = docs.join(spans, (key == F.col(own_doc)) & (tag == F.col(own_tag)), "left")
    return rows.select(*docs.columns, own_spans).mapInArrow(_cutter(docs.columns, docs.columns.index(text_col)), docs.schema)
