"""Elias-Fano sequences, token ids against the tokenizer on whole texts, and the files' round trip."""

import sys
import zlib

import numpy as np
import pytest

from gleaner.llm import token_files
from gleaner.llm.token_files import _tokenizer, ef_decode, ef_encode, ef_select, encode_texts, read_tokens, write_tokens

VOCABULARY = "word_bpe_49k.json"
TEXTS = [
    None, "", "  \n ", "Hello, world! hello", "l'été n'est pas fini; ÉTÉ (été) x_y a_ 'tis don't I'LL",
    "été å, ǅ ΣΑΣ İstanbul ﬁn 12,5 3.14% 100km #tag", "<|endoftext|> <|startoftext|>x end", "Ünïcödé—dash … “quotes” ¿qué? ß ÿ × ÷ ª º µ",
    "word*** word$$$ WORD!! | a | b |", "日本語 текст עברית 😀😀 a😀b", "x" * 3000 + " " + "ab " * 2000, "tab\tvt\x0bff\x0cnbsp x y\u0085z",
]


@pytest.mark.parametrize("values", [[], [0], [5], [0, 0, 0], list(range(1000)), [3, 3, 900, 2**40, 2**40 + 1], list(np.random.default_rng(1).integers(0, 10**7, 3000).cumsum())])
def test_elias_fano(values):
    blob = ef_encode(np.array(values, np.uint64))
    assert ef_decode(blob).tolist() == [int(v) for v in values]
    for i in {0, len(values) // 2, len(values) - 1} if values else ():
        assert ef_select(blob, i) == values[i]
    with pytest.raises(IndexError):
        ef_select(blob, len(values))


def test_ids_are_those_of_whole_texts():
    want = [e.ids for e in _tokenizer(VOCABULARY).encode_batch([t or "" for t in TEXTS], add_special_tokens=False)]
    for _ in range(2):  # the second time from what the worker remembers
        got = encode_texts([None if t is None else t.encode() for t in TEXTS], VOCABULARY, "<u2")
        assert [np.frombuffer(x, "<u2").tolist() for x in got] == want


def test_round_trip(spark, tmp_path):
    rows = [(i * 3 % 11, t) for i, t in enumerate(TEXTS[:11])] + [(None, "null id"), (4, "again")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, part int").repartition(5)
    write_tokens(docs, str(tmp_path / "t"), segment_tokens=500)
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in read_tokens(spark, str(tmp_path / "t")).collect())
    assert [r[1] for r in got] == sorted((r[0] for r in rows), key=lambda x: (x is not None, x))
    start, by_id = 0, {}
    for d, t in rows:
        ids = _tokenizer(VOCABULARY).encode(t or "", add_special_tokens=False).ids + [1]
        by_id.setdefault(d, []).append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    for s, d, n, crc in got:
        assert s == start and (n, crc) in by_id[d]
        start += n
    write_tokens(docs.limit(0), str(tmp_path / "e"))
    assert read_tokens(spark, str(tmp_path / "e")).count() == 0


def test_a_worker_learns_a_piece_once(monkeypatch):
    learned, learn = [], token_files._learn
    monkeypatch.setattr(token_files, "_learn", lambda stretches, *how: (learned.append(len(stretches)), learn(stretches, *how))[1])
    monkeypatch.setattr(token_files, "_known", {})
    letters = "abcdefghijklmnopqrst"
    texts = [" ".join(a + b + c + d + e for b in letters for c in letters for d in letters for e in letters).encode() for a in letters[:2]]
    texts.append(texts[0].replace(b" ", b", "))
    for text in [*texts, texts[0]]:
        ids = encode_texts([text], VOCABULARY, "<u2")[0]
    assert learned == [160_000, 160_000, 159_999, 0]
    assert np.frombuffer(ids, "<u2").tolist() == _tokenizer(VOCABULARY).encode(texts[0].decode(), add_special_tokens=False).ids


def test_what_a_worker_remembers_stays_small_and_keeps_what_is_met_again(monkeypatch):
    learned, learn = [], token_files._learn
    monkeypatch.setattr(token_files, "_learn", lambda stretches, *how: (learned.extend(stretches), learn(stretches, *how))[1])
    monkeypatch.setattr(token_files, "_known", {})
    letters, marks = "abcdefghijklmnopqrst", ",.;:!?"
    for a, mark in zip(letters, marks):  # 960,000 pieces, each with a mark
        encode_texts([("often " + " ".join(a + b + c + d + e + mark for b in letters for c in letters for d in letters for e in letters)).encode()], VOCABULARY, "<u2")
    assert learned.count(b"often") == 1
    held = [x for known in token_files._known[VOCABULARY] for pair in (known, *known.items()) for x in (pair if isinstance(pair, tuple) else (pair,))]
    assert sum({id(x): sys.getsizeof(x) for x in held}.values()) < 150e6


def test_words_are_neither_normalised_nor_cut_again_and_pieces_are_looked_up_once(monkeypatch):
    monkeypatch.setattr(token_files, "_known", {})
    words = token_files._word_tokenizer(VOCABULARY)
    assert words is not _tokenizer(VOCABULARY) and words.normalizer is None
    letters = [chr(c) for c in [*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC0, 0x100)] if chr(c).isalpha()]
    marks = [chr(c) for c in range(0x21, 0x7F) if not chr(c).isalnum()]
    text = " ".join([*letters, *marks, *(a + b + c for a in marks for b in letters for c in marks[:9]), *(a + b for a in letters for b in letters)])
    want = _tokenizer(VOCABULARY).encode(text, add_special_tokens=False).ids
    asked = []
    monkeypatch.setattr(token_files._Recent, "__missing__", lambda self, piece, missing=token_files._Recent.__missing__: (asked.append(piece), missing(self, piece))[1])
    for _ in range(2):
        assert np.frombuffer(encode_texts([text.encode()], VOCABULARY, "<u2")[0], "<u2").tolist() == want
    assert len(asked) == len(set(asked)) == len(set(text.split()))  # none of them the second time
