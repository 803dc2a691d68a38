"""SimHash near-duplicates through vantage-point trees.

A text's fingerprint has a bit set where over half of its word shingles' XXH64 have it. Equal
fingerprints are one node. The distinct ones are dealt to shards by a vantage-point tree whose
vantage points come from a bounded sample (SAMPLE fingerprints): at each node a fingerprint goes
inside if its Hamming distance to the vantage point is at most mu, else outside. By the triangle
inequality two fingerprints within radius r can part ways only where both lie within r of mu, so a
fingerprint near the border of its side is also sent across as a visitor, and each linked pair meets
in the shard that is home to one of the two. Shards are searched through further vantage points,
whose distances prune in the same way. A shard returns a spanning forest of its links, which keeps
every component and no more edges than it has fingerprints.

Shards that hold far more fingerprints than planned, since the sample could not tell them apart, are
cut into parts that meet pair by pair.

``keep_one`` also joins texts whose 5-word shingles are alike by SIMILARITY or more but whose
fingerprints lie further apart: ``similar_texts``.

Null and empty texts have fingerprint zero and link like any other. Texts of fewer words than a
shingle have the whole sequence as their only shingle. Repeated rows each get a row; a null id never
is the least. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bounded, discard, fresh, perhaps_in, release, save, words_of
from .graph import components

SHINGLE, SEED, RADIUS = 3, 42, 2
SAMPLE, SHARD = 1 << 15, 8192
#: A shard is cut beyond this many times SHARD, or beyond 1 / MAX_CUT of all fingerprints.
CUT_FACTOR, MAX_CUT = 4, 10_000
TILE = 1 << 18
#: Where a group keeps one text: shingles and similarity that decide; tokens of a bucket, and of a flush.
#: From what ratio on two sizes are close.
TEXT_SHINGLE, SIMILARITY, CLOSE = 5, 0.8, 0.95
TOKENS_PER_BUCKET, FLUSH_TOKENS = 1 << 19, 1 << 20


def shingle_hashes(text: bytes | None, k: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """XXH64 of each k-word shingle, repeats included."""
    words = words_of(text)
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    stop = np.cumsum(size + 1) - 1
    start = stop - size
    n = max(1, len(words) - k + 1)
    h = xxhash.xxh64_intdigest
    ends = stop[min(k, len(words)) - 1:].tolist()
    return np.array([h(joined[a:b], seed) for a, b in zip(start[:n].tolist(), ends)], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """The 64 majority bits; zero for no shingles."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        part = np.ascontiguousarray(hashes[at:at + (1 << 14)]).view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0]) if len(hashes) else 0


def _fingerprints(k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = [fingerprint(shingle_hashes(t.as_py(), k)) for t in batch.column("text")]
            names = [n for n in batch.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays([*map(batch.column, names), pa.array(np.array(fp, np.uint64).view(np.int64))], [*names, "fp"])

    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, also: Sequence[str] = ()) -> DataFrame:
    """(id, ``also``, fp): the fingerprint of each row; ``also`` are columns of longs to be kept."""
    rows = bounded(docs).select(F.col(id_col).cast("long").alias("id"), *also, F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(_fingerprints(k), ", ".join(f"{c} long" for c in ["id", *also, "fp"]))


# --- The tree -------------------------------------------------------------------------------

def build_tree(sample: np.ndarray, depth: int, radius: int) -> list[tuple[int, int] | None]:
    """A heap of (vantage point, mu): node i has its inside at 2i + 1 and its outside at 2i + 2.

    Of a few candidates the one whose distances spread most is taken, and of the distances between
    the quartiles the mu with the fewest fingerprints near the border.
    """
    tree: list[tuple[int, int] | None] = [None] * (2**depth - 1)
    sets = {0: sample}
    for i in range(len(tree)):
        own = sets.pop(i, np.empty(0, np.uint64))
        if len(own) < 2:
            continue
        candidates = own[np.linspace(0, len(own) - 1, min(16, len(own))).astype(int)]
        away = np.bitwise_count(own[:, None] ^ candidates[None, :])
        pick = int(np.argmax(away.astype(np.float32).std(0)))
        d = away[:, pick].astype(int)
        low, high = np.percentile(d, [35, 65]).astype(int)
        counts = np.bincount(d, minlength=66 + radius)
        mu = min(range(low, max(low + 1, high)), key=lambda m: counts[max(0, m - radius + 1):m + radius + 1].sum())
        tree[i] = (int(candidates[pick]), int(mu))
        sets[2 * i + 1], sets[2 * i + 2] = own[d <= mu], own[d > mu]
    return tree


def route(fps: np.ndarray, tree: list[tuple[int, int] | None], radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of the fingerprint, shard, is at home) for each shard that a fingerprint goes to.

    A fingerprint at home goes across only from the inside to the outside, since one crossing of a
    pair is enough; a visitor goes to both sides when it is near the border.
    """
    out: list[tuple[np.ndarray, int, np.ndarray]] = []
    stack = [(0, np.arange(len(fps)), np.ones(len(fps), bool))]
    while stack:
        i, at, home = stack.pop()
        if not len(at):
            continue
        if i >= len(tree) or tree[i] is None:
            out.append((at, i, home))
            continue
        point, mu = tree[i]
        d = np.bitwise_count(fps[at] ^ np.uint64(point)).astype(int)
        inside = d <= mu
        to_in = inside | (~home & (d <= mu + radius))
        to_out = ~inside | (d > mu - radius)
        stack.append((2 * i + 1, at[to_in], home[to_in]))
        stack.append((2 * i + 2, at[to_out], home[to_out] & ~inside[to_out]))
    if not out:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)
    return np.concatenate([a for a, _, _ in out]), np.concatenate([np.full(len(a), s) for a, s, _ in out]), np.concatenate([h for _, _, h in out])


def _router(tree, radius: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            fps = rows["fp"].to_numpy("i8").view(np.uint64)
            at, shard, home = route(fps, tree, radius)
            yield pd.DataFrame({"fp": fps[at].view(np.int64), "shard": shard, "home": home})

    return run


def near_pairs(queries: np.ndarray, homes: np.ndarray, radius: int, depth: int = 4) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs within the radius. A vantage point among the homes orders both sides by distance;
    a query at distance j can only be near homes at j - radius to j + radius."""
    stack = [(np.arange(len(queries)), np.arange(len(homes)), depth)]
    while stack:
        q, h, left = stack.pop()
        if not len(q) or not len(h):
            continue
        if len(q) * len(h) <= TILE or not left:
            step = max(1, TILE // len(h)) if len(h) <= TILE else 1
            for a in range(0, len(q), step):
                x, y = np.nonzero(np.bitwise_count(queries[q[a:a + step], None] ^ homes[None, h]) <= radius)
                yield q[a:a + step][x], h[y]
            continue
        point = homes[h[(7919 * left) % len(h)]]
        dq, dh = np.bitwise_count(queries[q] ^ point).astype(int), np.bitwise_count(homes[h] ^ point).astype(int)
        q, h = q[np.argsort(dq, kind="stable")], h[np.argsort(dh, kind="stable")]
        dq, dh = np.sort(dq), np.sort(dh)
        for j in np.unique(dq):
            own = q[np.searchsorted(dq, j):np.searchsorted(dq, j + 1)]
            stack.append((own, h[np.searchsorted(dh, j - radius):np.searchsorted(dh, j + radius + 1)], left - 1))


def _forest(radius: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        home = rows["home"].to_numpy(bool)
        fps = rows["fp"].to_numpy("i8").view(np.uint64)
        order = np.argsort(~home, kind="stable")
        fps, n = fps[order], int(home.sum())
        up = np.arange(len(fps))

        def root(i: int) -> int:
            while up[i] != i:
                up[i] = up[up[i]]
                i = up[i]
            return i

        a_out, b_out = [], []
        for a, b in near_pairs(fps, fps[:n], radius):
            keep = a != b
            for i, j in zip(a[keep].tolist(), b[keep].tolist()):
                x, y = root(i), root(j)
                if x != y:
                    up[max(x, y)] = min(x, y)
                    a_out.append(i)
                    b_out.append(j)
        return pd.DataFrame({"a": fps[np.array(a_out, int)].view(np.int64), "b": fps[np.array(b_out, int)].view(np.int64)})

    return run


def link_forest(unique: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges (a, b) between distinct fingerprints ``fp`` that connect all pairs within ``radius``."""
    n = unique.count()
    depth = max(0, (max(1, n) - 1) // SHARD).bit_length()
    sample = [r.fp for r in unique.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).collect()]
    tree = build_tree(np.array(sample, np.int64).view(np.uint64), depth, radius)
    dealt = save(unique.select("fp").mapInPandas(_router(tree, radius), "fp long, shard long, home boolean"), "shards")
    most = max(CUT_FACTOR * SHARD, n // MAX_CUT)
    # Each such shard is home to over 1 / MAX_CUT of the fingerprints, so the list is short.
    cut = dealt.where("home").groupBy("shard").count().where(F.col("count") > most).select("shard", F.ceil(F.col("count") / SHARD).cast("int").alias("parts"))
    parts = F.coalesce("parts", F.lit(1))
    own = F.pmod(F.xxhash64("fp", F.lit(1)), parts).cast("int")
    meets = F.when(F.col("home"), F.sequence(own, parts - 1)).otherwise(F.sequence(F.lit(0), parts - 1))
    rows = (
        dealt.join(F.broadcast(cut), "shard", "left").withColumn("own", own).withColumn("part", F.explode(meets))
        .select("fp", "shard", "part", (F.col("home") & (F.col("own") == F.col("part"))).alias("home"))
    )
    return rows.groupBy("shard", "part").applyInPandas(_forest(radius), "a long, b long")


def groups(rows: DataFrame, radius: int = RADIUS, links: DataFrame | None = None, near: DataFrame | None = None) -> DataFrame:
    """(fp, component_id, head) of each distinct fingerprint of ``rows`` (id, fp): the least id of its
    component, and one fingerprint that stands for the component. ``links`` (a, b) join more of them;
    ``near`` are the links within the radius where they are known."""
    unique = save(rows.groupBy("fp").agg(F.min("id").alias("least")), "unique")
    edges = link_forest(unique, radius) if near is None else near
    roots = save(components(save(edges if links is None else edges.unionByName(links), "links")), "roots")
    linked = unique.join(roots, F.col("fp") == F.col("node")).select("fp", "root", "least")
    least = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    found = linked.join(least, "root").select("fp", "root", "component_id")
    head, least_id = F.coalesce("root", "fp"), F.when(F.col("root").isNull(), F.col("least")).otherwise(F.col("component_id"))
    return unique.join(found, "fp", "left").select("fp", least_id.alias("component_id"), head.alias("head"))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """(id, fingerprint, component_id) of each document; component_id is the least id reachable."""
    rows = save(fingerprints(docs, id_col, text_col, k), "fingerprints")
    named = groups(rows, radius)
    return rows.join(named, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# --- Texts that are alike beyond the radius --------------------------------------------------
#
# Prefix filtering, the rarest shingles first: two texts of similarity t that have n and m shingles
# share t / (1 + t) * (n + m) of them. So each may leave out its most frequent ones, but one less than
# that many: they still share one of the others. The closer the two sizes, the more can be left out.
# Passages that many texts hold go that way, and texts that are edited too much to be alike to any
# other have nothing left but shingles of their own, which are dropped before any row is written.

def _dropped(n, least: float, ratio: float):
    """All but one of the shingles that a text of ``n`` shares with any that is alike and whose size is
    ``ratio`` of its own or more, or the reverse."""
    return F.greatest(F.ceil(n * (least * (1 + ratio) / (1 + least)) - 1e-6) - 1, F.lit(0))


def _possible(least: float):
    """Whether texts a and b that share a token may share as many as they must: of those before it in the
    common order and of those after it, no more than the one with fewer has."""
    must = F.ceil((F.col("na") + F.col("nb")) * (least / (1 + least)) - 1e-6)
    return F.least("ata", "atb") + F.least(F.col("ma") - F.col("ata"), F.col("mb") - F.col("atb")) >= must


def numbered(hashes: np.ndarray) -> np.ndarray:
    """Sorted tokens of shingles: the second and later times of a shingle are tokens of their own."""
    h = np.sort(hashes)
    if not len(h):
        return h.view(np.int64)
    starts = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
    again = (np.arange(len(h)) - np.repeat(starts, np.diff(np.r_[starts, len(h)]))).astype(np.uint64)
    with np.errstate(over="ignore"):
        return np.sort((h + again * np.uint64(0x9E3779B97F4A7C15)).view(np.int64))


def _sized(k: int, text_k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp, sizes = [], []
            for t in batch.column("text"):
                text = t.as_py()
                fp.append(fingerprint(shingle_hashes(text, k)))
                n = len(words_of(text))
                sizes.append(max(1, n - text_k + 1) if n else 0)
            columns = [batch.column("id"), batch.column("tag"), pa.array(np.array(fp, np.uint64).view(np.int64)), pa.array(sizes, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "tag", "fp", "n"])

    return run


def _pack(x: np.ndarray) -> bytes:
    """The lower six bytes of each number."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _unpack(blob: bytes) -> np.ndarray:
    out = np.zeros((len(blob) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(blob, np.uint8).reshape(-1, 6)
    return out.view("<u8").reshape(-1).astype(np.int64)


DEALT = "bucket long, salt long, tokens binary, tags binary, counts binary, single binary"


def _deal(n_buckets: int, k: int):
    """Tokens of texts, of 48 bits, packed by bucket. What a flush of a task holds several times goes
    to bucket -1 in a group of its own; a bucket gets each token once from a flush. So a token that very many texts
    have comes to its bucket as often as there are flushes."""

    def rows_of(salt: int, tokens: list[np.ndarray], tags: list[int]) -> Iterator[pa.RecordBatch]:
        token = np.concatenate(tokens)
        owner = np.repeat(np.arange(len(tags)), [len(t) for t in tokens])
        order = np.argsort(token, kind="stable")
        token, owner, tag = token[order], owner[order], np.array(tags, np.int64)
        first = np.r_[True, token[1:] != token[:-1]]
        number = np.diff(np.r_[np.flatnonzero(first), len(token)])
        several = np.repeat(number > 1, number)
        asked, asker, single = token[first], owner[first], (number == 1).astype(np.uint8)

        def packed(bucket: int, salt: int, token: np.ndarray, owner: np.ndarray, single: np.ndarray):
            # By owner, so that an owner is told once with the number of its tokens.
            order = np.argsort(owner, kind="stable")
            own, counts = np.unique(owner, return_counts=True)
            return bucket, salt, _pack(token[order]), tag[own].tobytes(), counts.astype(np.int32).tobytes(), np.packbits(single[order]).tobytes()

        out = [packed(-1, salt, token[several], owner[several], several[several])] if several.any() else []
        bucket = asked % n_buckets
        by_bucket = np.argsort(bucket, kind="stable")
        for rows in np.split(by_bucket, np.flatnonzero(np.diff(bucket[by_bucket])) + 1):
            out.append(packed(int(bucket[rows[0]]), 0, asked[rows], asker[rows], single[rows]))
        kinds = [pa.int64(), pa.int64(), *[pa.binary()] * 4]
        for a in range(0, len(out), 256):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[a:a + 256]), kinds)], [c.split()[0] for c in DEALT.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, flushes = TaskContext.get().partitionId(), 0
        tokens: list[np.ndarray] = []
        tags: list[int] = []
        seen: set[int] = set()
        size = 0
        for batch in batches:
            for tag, t in zip(batch.column("tag").to_pylist(), batch.column("text")):
                if tag in seen:
                    continue
                own = numbered(shingle_hashes(t.as_py(), k))
                if len(own):
                    tokens.append(np.unique(own.view(np.uint64) >> np.uint64(16)).astype(np.int64))
                    tags.append(tag)
                    seen.add(tag)
                    size += len(own)
                if size >= FLUSH_TOKENS:
                    yield from rows_of(part << 24 | flushes, tokens, tags)
                    tokens, tags, seen, size, flushes = [], [], set(), 0, flushes + 1
        if tags:
            yield from rows_of(part << 24 | flushes, tokens, tags)

    return run


def _shared(rows: pd.DataFrame) -> pd.DataFrame:
    """(token, tag) of a bucket's tokens that several texts have, as far as no flush has told them."""
    tokens, tags, single = [], [], []
    for r in rows.itertuples():
        tokens.append(_unpack(r.tokens))
        tags.append(np.repeat(np.frombuffer(r.tags, np.int64), np.frombuffer(r.counts, np.int32)))
        single.append(np.unpackbits(np.frombuffer(r.single, np.uint8), count=len(tokens[-1])))
    token, tag, single = map(np.concatenate, (tokens, tags, single))
    if rows["bucket"].iloc[0] < 0:
        return pd.DataFrame({"token": token, "tag": tag})
    order = np.lexsort((single, tag, token))
    token, tag, single = token[order], tag[order], single[order]
    new = np.r_[True, (token[1:] != token[:-1]) | (tag[1:] != tag[:-1])]
    start = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
    texts = np.add.reduceat(new.astype(np.int64), start)
    repeats = np.minimum.reduceat(single, start) == 0
    keep = new & (single == 1) & np.repeat((texts > 1) | repeats, np.diff(np.r_[start, len(token)]))
    return pd.DataFrame({"token": token[keep], "tag": tag[keep]})


def similarity(a: bytes, b: bytes, k: int) -> float:
    """Weighted similarity of two texts' k-word shingles."""
    x, y = (Counter(shingle_hashes(t, k).tolist()) for t in (a, b))
    both = (x & y).total()
    return both / max(1, x.total() + y.total() - both)


def _squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    codec = pa.Codec("zstd", compression_level=3)
    for batch in batches:
        sizes = pa.compute.binary_length(batch.column("text"))
        packed = [codec.compress(t.as_buffer(), asbytes=True) for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("tag"), sizes.cast(pa.int64()), pa.array(packed, pa.binary())], ["tag", "size", "packed"])


def _alike(k: int, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, np.ndarray] = {}

        def tokens(packed: bytes, size: int) -> np.ndarray:
            # A text that many are compared with is hashed once.
            if packed not in known:
                if len(known) > 256:
                    known.clear()
                known[packed] = numbered(shingle_hashes(pa.decompress(packed, size, codec="zstd", asbytes=True), k))
            return known[packed]

        for batch in batches:
            ok = []
            for pa_, na, pb, nb in zip(*(batch.column(c).to_pylist() for c in ("pa", "na", "pb", "nb"))):
                x, y = tokens(pa_, na), tokens(pb, nb)
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(both >= least * (len(x) + len(y) - both) - 1e-9)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


def _compared(texts: DataFrame, one: DataFrame, pairs: DataFrame, k: int, least: float) -> DataFrame:
    """Links (a, b) between fingerprints of those ``pairs`` (a, b) of tags whose texts are alike."""
    pairs = save(pairs, "near_texts")
    wanted = pairs.select(F.col("a").alias("tag")).unionByName(pairs.select(F.col("b").alias("tag"))).distinct()
    packed = perhaps_in(texts.select("tag", "text"), "tag", wanted).mapInArrow(_squeeze, "tag long, size long, packed binary").dropDuplicates(["tag"])
    bodies = save(packed.join(one.select("tag", "fp").hint("merge"), "tag"), "near_bodies")
    side = {x: bodies.select(F.col("tag").alias(x), F.col("fp").alias(f"f{x}"), F.col("size").alias(f"n{x}"), F.col("packed").alias(f"p{x}")).hint("merge") for x in "ab"}
    told = pairs.join(side["a"], "a").join(side["b"], "b").select(F.col("fa").alias("a"), F.col("fb").alias("b"), "pa", "na", "pb", "nb")
    found = save(told.mapInArrow(_alike(k, least), "a long, b long"), "similar")
    discard(bodies)
    return found


def similar_texts(texts: DataFrame, rows: DataFrame, links: DataFrame, k: int = TEXT_SHINGLE, least: float = SIMILARITY) -> DataFrame:
    """Links (a, b) between fingerprints of ``rows`` (id, tag, fp, n) that, with ``links``, connect
    all whose ``texts`` (id, tag, text) have a similarity of ``least`` or more.

    Each token names the one of its texts whose tokens are the most frequent, as those of an original
    are among its edited copies; of those that it may be alike to, a text is compared with the one that most
    of its tokens name. Then all pairs that share a token, are in different components still, and may
    share as many tokens as they must, by the places of that token in both, are compared, so none is lost.
    """
    one = save(rows.where("n > 0").groupBy("tag").agg(F.min("fp").alias("fp"), F.min("n").alias("n")), "one")
    buckets = max(1, ceil((one.agg(F.sum("n")).first()[0] or 0) / TOKENS_PER_BUCKET))
    dealt = texts.select("tag", "text").mapInArrow(_deal(buckets, k), DEALT)
    found = dealt.groupBy("bucket", "salt").applyInPandas(_shared, "token long, tag long")
    shared = save(found, "shared_tokens")
    release(texts.sparkSession)
    # A text all but a few of whose tokens are its own is alike to none. Copies of a text in several
    # flushes may tell a token twice, which counts too many here and never too few.
    enough = shared.groupBy("tag").agg(F.count(F.lit(1)).alias("m")).join(one.select("tag", "n"), "tag").where(F.col("m") > _dropped(F.col("n"), least, least))
    has = save(shared.join(enough.select("tag", "n").hint("shuffle_hash"), "tag").dropDuplicates(["tag", "token"]), "likely_tokens")
    discard(shared)
    df = has.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    has = save(has.join(df, "token"), "counted_tokens")
    own = Window.partitionBy("tag")
    place = F.row_number().over(own.orderBy(F.desc("df"), "token"))
    ranked = has.select("token", "tag", "n", place.alias("at"), F.count(F.lit(1)).over(own).alias("m"), (F.sum("df").over(own) / F.col("n")).alias("centre"))
    kept = save(ranked.where(F.col("at") > _dropped(F.col("n"), least, least)), "first_tokens")
    discard(has)

    side = lambda x, rows, *also: rows.select("token", *also, F.col("tag").alias(x), *[F.col(c).alias(f"{c}{x}") for c in ("n", "m", "at")])
    fields = F.struct("tag", "n", "m", "at")
    named = kept.groupBy("token").agg(F.max_by(fields, F.struct("centre", "tag")).alias("head"))
    named = named.select("token", F.col("head.tag").alias("b"), *[F.col(f"head.{c}").alias(f"{c}b") for c in ("n", "m", "at")])
    votes = side("a", kept).join(named.hint("merge"), "token").where((F.col("a") != F.col("b")) & _possible(least)).groupBy("a", "b").agg(F.count(F.lit(1)).alias("m"))
    best = votes.groupBy("a").agg(F.max_by("b", F.struct("m", "b")).alias("b"))
    found = _compared(texts, one, best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), k, least)

    known = save(components(save(links.unionByName(found), "links")), "roots")
    comps = one.select("tag", "fp").join(known, F.col("fp") == F.col("node"), "left").select("tag", F.coalesce("root", "fp").alias("comp"))
    told = save(kept.join(comps, "tag").select("token", "tag", "n", "m", "at", "comp"), "told")
    mixed = told.groupBy("token").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x < y").select("token")
    told = save(told.join(mixed, "token"), "mixed")
    band = F.floor(F.log("n") / F.log(F.lit(1 / CLOSE)) + 1e-9).cast("int")
    bands = ceil(np.log(least) / np.log(CLOSE)) + 1
    near, far = told.where(F.col("at") > _dropped(F.col("n"), least, CLOSE)), told.withColumn("band", band)
    wider = far.withColumn("band", F.explode(F.array(*[F.col("band") - i for i in range(bands)])))
    ends = lambda x, rows, *also: side(x, rows, F.col("comp").alias(f"c{x}"), *also).hint("merge")
    na, nb = F.col("na"), F.col("nb")
    close = F.least(na, nb) >= F.greatest(na, nb) * CLOSE

    def likely(met: DataFrame, ratio: float) -> DataFrame:
        counts = met.groupBy("a", "b").agg(F.count(F.lit(1)).alias("m"), F.first("na").alias("na"), F.first("nb").alias("nb"))
        must = F.ceil((na + nb) * (least / (1 + least)) - 1e-6) - F.greatest(_dropped(na, least, ratio), _dropped(nb, least, ratio))
        return counts.where(F.col("m") >= must).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))

    pairs = likely(ends("a", near).join(ends("b", near), "token").where((F.col("ca") < F.col("cb")) & close & _possible(least)), CLOSE)
    met = ends("a", far, "band").join(ends("b", wider, "band"), ["token", "band"])
    pairs = pairs.unionByName(likely(met.where((F.col("ca") != F.col("cb")) & (na < nb) & ~close & (na >= nb * least - 1e-9) & _possible(least)), least)).distinct()
    return found.unionByName(_compared(texts, one, pairs, k, least))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, radius: int = RADIUS, least: float = SIMILARITY) -> DataFrame:
    """``docs`` with one row of each component: that with the least id, of such the one with the least
    hash of the text. Components join fingerprints within the radius and texts of similarity ``least``.
    Only where a row repeats in id and text are the kept rows shuffled once more."""
    tag = F.xxhash64(F.coalesce(text_col, F.lit("")))
    texts = bounded(docs).select(F.col(id_col).cast("long").alias("id"), tag.alias("tag"), F.col(text_col).cast("binary").alias("text"))
    rows = save(texts.mapInArrow(_sized(k, TEXT_SHINGLE), "id long, tag long, fp long, n long"), "fingerprints")
    near = save(link_forest(rows.select("fp").distinct(), radius), "near")
    named = groups(rows, radius, similar_texts(texts, rows, near, TEXT_SHINGLE, least), near)
    kept = rows.select("id", "tag", "fp").join(named, "fp").where(F.col("id").eqNullSafe(F.col("component_id")))
    own_id, own_tag = fresh(docs, "_id", "_tag")
    kept = save(kept.groupBy("head").agg(F.min_by(F.struct("id", "tag"), "tag").alias("_at")).select(F.col("_at.id").alias(own_id), F.col("_at.tag").alias(own_tag)), "kept")
    at = F.col(id_col).cast("long").eqNullSafe(F.col(own_id)) & (tag == F.col(own_tag))
    found = docs.join(kept, at, "left_semi")
    twice = rows.groupBy("id", "tag").count().where("count > 1").limit(1).count()
    return found.dropDuplicates([id_col, text_col]) if twice else found
