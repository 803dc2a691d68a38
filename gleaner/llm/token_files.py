"""Token files: concatenated ids with Elias-Fano encoded document boundaries.

Documents are dealt by range of their id, so that files in the order of their partition number hold
ascending ids. A file is a row of segments; a segment holds the ids of consecutive documents as one
little-endian array of 16-bit numbers (32-bit where the vocabulary needs it), and two Elias-Fano
sequences: where each document ends, and the documents' own ids. ``select`` reads one boundary
through samples of the upper bits; no 64-bit table of offsets exists.

Null texts count as empty: they hold the end id only. Null document ids come first. Documents with
equal ids follow each other, by a hash of the text. An empty table gives no segments.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Iterator
from itertools import compress, filterfalse, islice
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bounded

VOCABULARY, END_ID = "word_bpe_49k.json", 1
SEGMENT_TOKENS = 1 << 20
#: Every so many documents the place of its one bit is kept.
SELECT_EVERY = 256
#: Pieces whose ids each half of what a worker remembers holds, for speed alone. Two workers share an
#: executor's memory with its JVM, so what is remembered has to stay a small part of it.
REMEMBERED = 350_000
#: Bytes, by hash, that tell which pieces were met before.
MET = 1 << 22

SEGMENT_SCHEMA = "part int, segment int, first_token long, n_docs int, n_nulls int, n_tokens int, width int, ends binary, least_id long, doc_ids binary, ids binary"


# --- Elias-Fano -----------------------------------------------------------------------------

def ef_encode(values: np.ndarray) -> bytes:
    """A non-decreasing sequence of numbers from 0 up: n, number of low bits, number of upper words,
    packed low bits, upper bits in unary, samples for select."""
    n = len(values)
    values = values.astype(np.uint64)
    top = int(values[-1]) if n else 0
    low = max(0, (top // n).bit_length() - 1) if n else 0
    upper = np.zeros((((n + (top >> low) + 1) + 63) // 64) * 64, np.uint8)
    ones = (values >> np.uint64(low)).astype(np.int64) + np.arange(n)
    upper[ones] = 1
    bits = ((values[:, None] >> np.arange(low, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
    return struct.pack("<III", n, low, len(upper) // 64) + np.packbits(bits.ravel(), bitorder="little").tobytes() + np.packbits(upper, bitorder="little").tobytes() + ones[::SELECT_EVERY].astype("<u4").tobytes()


def _parts(blob: bytes) -> tuple[int, int, bytes, bytes, bytes]:
    n, low, words = struct.unpack_from("<III", blob)
    a = 12 + (n * low + 7) // 8
    return n, low, blob[12:a], blob[a:a + 8 * words], blob[a + 8 * words:]


def ef_decode(blob: bytes) -> np.ndarray:
    n, low, lower, upper, _ = _parts(blob)
    ones = np.flatnonzero(np.unpackbits(np.frombuffer(upper, np.uint8), bitorder="little"))[:n]
    high = (ones - np.arange(n)).astype(np.uint64) << np.uint64(low)
    bits = np.unpackbits(np.frombuffer(lower, np.uint8), count=n * low, bitorder="little").reshape(n, low)
    return high | (bits.astype(np.uint64) << np.arange(low, dtype=np.uint64)).sum(1, dtype=np.uint64)


def ef_select(blob: bytes, i: int) -> int:
    """Value number i, from the nearest sample on and the value's own low bits."""
    n, low, lower, upper, samples = _parts(blob)
    if not 0 <= i < n:
        raise IndexError(i)
    at = int(np.frombuffer(samples, "<u4")[i // SELECT_EVERY])
    left, byte = i % SELECT_EVERY, at // 8
    word = upper[byte] & (0xFF << at % 8)
    while left >= (ones := word.bit_count()):
        left, byte = left - ones, byte + 1
        word = upper[byte]
    for _ in range(left):
        word &= word - 1
    high = byte * 8 + (word & -word).bit_length() - 1 - i
    first = i * low
    chunk = int.from_bytes(lower[first // 8:(first + low + 7) // 8], "little") >> first % 8
    return high << low | chunk & ((1 << low) - 1)


# --- Tokens ---------------------------------------------------------------------------------

class _Recent(dict):
    """Ids of pieces. One that is missing is recent from now on if the older half has it; else it is new, and
    has a hole that is filled once its ids are known."""

    def __init__(self, older: dict[bytes, bytes]):
        self.older, self.new = older, {}

    def __missing__(self, piece: bytes) -> bytes | bytearray:
        ids = self.older.get(piece)
        if ids is None:
            return self.new.setdefault(piece, bytearray())
        self[piece] = ids
        return ids


_tokenizers: dict[str, object] = {}
#: For each vocabulary: the ids of stretches without white space and of their words and marks, in a recent and an older half.
_known: dict[str, tuple[_Recent, dict[bytes, bytes]]] = {}
_met: dict[str, bytearray] = {}
#: A word of letters that no normalisation joins with its neighbours, between ASCII marks. The
#: vocabularies with word ends cut text at the borders of letters and lower-case it.
#: Each line of several is such a word, or else whatever it is.
_WORDS = re.compile(r"^(?:([!-&(-/:-@\[-^`{-~]*)([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-^`{-~]*)|(.+))$", re.M)
_WORD_END = "</w>"


def _tokenizer(vocabulary: str):
    if vocabulary not in _tokenizers:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        path = vocabulary
        if not os.path.isabs(path):
            import public_tokenizers

            path = public_tokenizers.path(vocabulary)
        _tokenizers[vocabulary] = Tokenizer.from_file(str(path))
    return _tokenizers[vocabulary]


def _word_tokenizer(vocabulary: str):
    """A tokenizer with the same model for what ``_WORDS`` cuts out, in lower case: these rules change no such
    word and cut none, so it need only split at blanks. Under other rules the vocabulary's own."""
    if vocabulary not in _word_tokenizers:
        whole = _word_tokenizers[vocabulary] = _tokenizer(vocabulary)
        told = [json.loads(x.__getstate__()) if x else None for x in (whole.normalizer, whole.pre_tokenizer)]
        if told == [_LOWERED, _BY_LETTERS]:
            from tokenizers import Tokenizer, pre_tokenizers as pre

            _word_tokenizers[vocabulary] = Tokenizer(whole.model)
            _word_tokenizers[vocabulary].pre_tokenizer = pre.Sequence([pre.WhitespaceSplit(), pre.ByteLevel(add_prefix_space=False, use_regex=False)])
    return _word_tokenizers[vocabulary]


_word_tokenizers: dict[str, object] = {}
_LOWERED = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
_BY_LETTERS = {"type": "Sequence", "pretokenizers": [
    {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]}


def id_width(vocabulary: str, end_id: int) -> int:
    return 2 if max(_tokenizer(vocabulary).get_vocab_size(), end_id + 1) <= 1 << 16 else 4


def _encode_words(words: list[str], vocabulary: str, dtype: str) -> list[bytes]:
    """The ids of each word, all encoded as one text and cut where a token ends a word."""
    tokenizer = _word_tokenizer(vocabulary)
    ids = np.array(tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, np.int64)
    if vocabulary not in _ends:
        vocab = tokenizer.get_vocab()
        ends = np.zeros(max(vocab.values()) + 1, bool)
        ends[[i for t, i in vocab.items() if t.endswith(_WORD_END)]] = True
        _ends[vocabulary] = ends
    raw, cut = ids.astype(dtype).tobytes(), ((np.flatnonzero(_ends[vocabulary][ids]) + 1) * np.dtype(dtype).itemsize).tolist()
    if len(cut) == len(words):
        return [raw[a:b] for a, b in zip([0, *cut], cut)]
    return [np.array(e.ids, dtype).tobytes() for e in tokenizer.encode_batch_fast(words, add_special_tokens=False)]


_ends: dict[str, np.ndarray] = {}


def _recall(wanted: set[bytes], vocabulary: str) -> set[bytes]:
    """Those ``wanted`` pieces that are not known. What only the older half knows is recent from now on."""
    recent, older = _known[vocabulary]
    # Not ``difference``, which goes through all of a dict that is derived.
    old = {*filterfalse(recent.__contains__, wanted)}
    new = {*filterfalse(older.__contains__, old)}
    recent.update([(p, older[p]) for p in old.difference(new)])
    return new


def _learn(stretches: list[bytes], vocabulary: str, dtype: str) -> set[bytes]:
    """Encodes stretches that are not known yet, by their words and marks where they have such. All pieces
    that are known from now on."""
    recent = _known[vocabulary][0]
    recent[b""] = b""
    every = b"\n".join(stretches).decode()
    special = [t.content for t in _tokenizer(vocabulary).get_added_tokens_decoder().values() if t.content in every]
    found, new = _WORDS.findall(every), []
    plain = [not (m[3] or special and any(t in p.decode() for t in special)) for p, m in zip(stretches, found)]
    rest = [p for p, is_plain in zip(stretches, plain) if not is_plain]
    if any(plain):
        parts = ["\n".join(x).lower().encode().split(b"\n") for x in islice(zip(*compress(found, plain)), 3)]
        if new := [*_recall(set().union(*parts), vocabulary)]:
            recent.update(zip(new, _encode_words(b" ".join(new).decode().split(" "), vocabulary, dtype)))
        before, word, after = (map(recent.__getitem__, x) for x in parts)
        recent.update(zip(compress(stretches, plain), map(add, map(add, before, word), after)))
    for p, e in zip(rest, _tokenizer(vocabulary).encode_batch_fast([p.decode() for p in rest], add_special_tokens=False)):
        recent[p] = np.array(e.ids, dtype).tobytes()
    return {*stretches, *new}


def _forget(learned: set[bytes], vocabulary: str) -> None:
    """Forgets ``learned`` pieces that are met for the first time since the halves were exchanged: most never return."""
    recent, met = _known[vocabulary][0], _met.setdefault(vocabulary, bytearray(MET))
    for p in learned:
        at = hash(p) % MET
        if not met[at]:
            met[at] = 1
            del recent[p]


def encode_texts(texts: list[bytes | None], vocabulary: str, dtype: str) -> list[bytes]:
    """The ids of each whole text as an array's bytes.

    The vocabulary drops white space and looks at no piece across it, so a text's ids are those of
    its stretches between white space in turn, and a stretch seen before need not be encoded again.
    Once the recent half is full it becomes the older one, whose pieces stay if they are met again;
    from then on new pieces are remembered when they are met a second time.
    """
    if vocabulary not in _known:
        _known[vocabulary] = _Recent({}), {}
    recent, older = _known[vocabulary]
    if len(recent) > REMEMBERED:
        recent.older, older = {}, recent
        recent = _Recent(older)
        _known[vocabulary] = recent, older
        _met.pop(vocabulary, None)
    pieces = [[*map(recent.__getitem__, text.split())] if text else [] for text in texts]
    new, recent.new = recent.new, {}
    learned = _learn([*new], vocabulary, dtype)
    for piece, hole in new.items():
        hole += recent[piece]
    encoded = [*map(b"".join, pieces)]
    if older:
        _forget(learned, vocabulary)
    return encoded


def _writer(vocabulary: str, end_id: int, segment_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        width = id_width(vocabulary, end_id)
        dtype, part = f"<u{width}", TaskContext.get().partitionId()
        end = np.array([end_id], dtype).tobytes()
        names = [x.split()[0] for x in SEGMENT_SCHEMA.split(", ")]
        types = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
        schema = pa.schema([(n, types[x.split()[1]]) for n, x in zip(names, SEGMENT_SCHEMA.split(", "))])
        segment = first = 0
        docs: list[int | None] = []
        ids: list[bytes] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal segment, first, docs, ids, size
            ends = np.cumsum([len(x) // width for x in ids])
            own = np.array([d for d in docs if d is not None], np.int64)
            least = int(own[0]) if len(own) else 0
            values = [part, segment, first, len(docs), len(docs) - len(own), size, width, ef_encode(ends), least, ef_encode((own - least).astype(np.uint64)), b"".join(ids)]
            segment, first, docs, ids, size = segment + 1, first + size, [], [], 0
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, schema.types)], schema=schema)

        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                rows = batch.slice(at, 64)
                for d, x in zip(rows.column(0).to_pylist(), encode_texts(rows.column(1).to_pylist(), vocabulary, dtype)):
                    docs.append(d)
                    ids.append(x + end)
                    size += len(x) // width + 1
                    if size >= segment_tokens:
                        yield flush()
        if docs:
            yield flush()

    return run


def write_tokens(docs: DataFrame, path: str, vocabulary: str = VOCABULARY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", segment_tokens: int = SEGMENT_TOKENS) -> None:
    """Encodes every whole text, appends the end id and writes the segments to ``path``."""
    rows = bounded(docs).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    ranged = rows.repartitionByRange("id").sortWithinPartitions("id", F.xxhash64("text"))
    ranged.mapInArrow(_writer(vocabulary, end_id, segment_tokens), SEGMENT_SCHEMA).write.option("compression", "zstd").parquet(path)


def read_segment(row: dict) -> Iterator[tuple[int | None, int, np.ndarray]]:
    """(document id, first token within the partition, ids) of each document of a segment."""
    ids, ends = np.frombuffer(row["ids"], f"<u{row['width']}"), ef_decode(row["ends"]).astype(np.int64)
    own = ef_decode(row["doc_ids"]).astype(np.int64) + row["least_id"]
    docs = [None] * row["n_nulls"] + own.tolist()
    start = 0
    for d, end in zip(docs, ends.tolist()):
        yield d, row["first_token"] + start, ids[start:end]
        start = end


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(batch.num_rows):
            row = batch.slice(at, 1).to_pylist()[0]
            docs = [(d, row["base"] + start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())) for d, start, ids in read_segment(row)]
            cells = zip(*docs)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cells], ["doc_id", "start", "n_tokens", "ids_crc32"])


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files alone."""
    segments = spark.read.parquet(path)
    sums = segments.groupBy("part").agg(F.sum(F.col("n_tokens").cast("long")).alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))  # a row for each written partition
    rows = segments.join(F.broadcast(bases), "part")
    return rows.mapInArrow(_reader, "doc_id long, start long, n_tokens long, ids_crc32 long")
