import hashlib
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from gleaner.llm import edit_embedding as e


def walked(text):
    """The output of the walk, a character a step, with a pointer that moves by one bit a step."""
    import numpy as np

    bits = np.unpackbits(np.frombuffer(hashlib.shake_256(b"walk").digest(e.CLASSES * e.PERIOD // 8), np.uint8)).reshape(e.CLASSES, e.PERIOD)
    out, i, j = [], 0, 0
    while i < len(text):
        out.append(text[i])
        i += int(bits[(ord(text[i]) * 0x9E3779B1 & 0xFFFFFFFF) >> 28][j % e.PERIOD])
        j += 1
    return out


def slow(text):
    out = walked(text)
    return "".join("%x" % ((ord(out[p]) * 0x85EBCA6B & 0xFFFFFFFF) >> 28) for p in e._steps(16).tolist() if p < len(out))


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=400))
def test_walk_by_pairs_is_the_walk_by_steps(text):
    assert e.fingerprint(text) == slow(text)


def test_walk_does_not_depend_on_chunks(monkeypatch):
    text = "".join(random.Random(1).choice("abcdé 𝄞") for _ in range(5000))
    whole = e.fingerprint(text)
    monkeypatch.setattr(e, "CHUNK", 37)
    assert e.fingerprint(text) == whole == slow(text)


def text_of(draw, n):
    return "".join(draw.choice("etaoinshrdlu     ,.") for _ in range(n))


def test_few_edits_leave_few_steps_that_differ():
    """In general: how far two walks go apart before they meet again is a matter of chance with a long tail."""
    draw = random.Random(2)
    for n, times in ((300, 40), (3000, 40), (30000, 8)):
        like, banded, other = [], [], []
        for _ in range(times):
            a = text_of(draw, n)
            b = a[:n // 3] + "X" + a[n // 3 + 1:2 * n // 3] + "YZ" + a[2 * n // 3:]
            p, q = e.fingerprint(a), e.fingerprint(b)
            like.append(e.likeness(p, q))
            banded.append(not set(e.bands(p)).isdisjoint(e.bands(q)))
            other.append(e.likeness(p, e.fingerprint(text_of(draw, n))))
        assert sorted(like)[times // 2] > 0.95 and sum(x > 0.8 for x in like) / times >= 0.7 and min(like) > max(other)
        assert sum(banded) / times >= 0.95 and max(other) < 0.35


def test_likeness_is_the_share_of_steps_where_all_are_sampled():
    a, b = "abcabc", "abcabd"
    x, y = walked(a), walked(b)
    assert len(x) < e.SAMPLES and len(y) < e.SAMPLES
    p, q = slow(a), slow(b)
    assert e.likeness(p, q) == sum(c == d for c, d in zip(p, q)) / max(len(x), len(y))
    assert e.likeness("", "") == 1.0 and e.likeness("", p) == 0.0 == e.likeness(p, "") and e.likeness(p, p) == 1.0


def brute(rows):
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)"""
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: -r[0])
    for at, (i, text) in enumerate(rows):
        after = rows[(at + 1) % len(rows)][1]
        tail = len(text) // 3
        edited = text[:len(text) - tail] + after[:tail]
        a, b, c = slow(text), slow(edited), slow(after)
        yield i, len(text), hashlib.sha256(edited.encode()).hexdigest(), a, b, e.likeness(a, b), e.likeness(a, c), not set(e.bands(a)).isdisjoint(e.bands(b)), not set(e.bands(a)).isdisjoint(e.bands(c))


def told(spark, rows, slices=4):
    df = spark.createDataFrame([(t, i, 7) for i, t in rows], "text string, doc_id long, part int").repartition(slices)
    return sorted((tuple(r) for r in e.edit_fingerprints(df).collect()), key=str)


def test_against_brute_force(spark):
    draw = random.Random(4)
    rows = [(i * 3 - 50, text_of(draw, draw.randrange(200))) for i in range(150)] + [(900, None), (901, ""), (-70, "short"), (1000, "longer 𝄞" * 3000)]
    assert told(spark, rows) == sorted(brute(rows), key=str)
    for few in (rows[:1], rows[:2], [(1, None)]):
        assert told(spark, few) == sorted(brute(few), key=str)
    assert told(spark, []) == []


def test_null_and_repeated_ids_give_a_row_each(spark):
    rows = [(None, "a b c d e f")] * 40 + [(5, "x y z"), (5, "x y z"), (5, "other text")]
    got = told(spark, rows)
    assert len(got) == len(rows) and sum(r[0] is None for r in got) == 40


def test_near_copies_are_one_class(spark):
    draw = random.Random(6)
    texts = [text_of(draw, draw.randrange(80, 3000)) for _ in range(60)]
    rows, want = [], {}
    for i, t in enumerate(texts):
        rows += [(10 * i + 1, t), (10 * i + 2, t), (10 * i + 3, t[:len(t) // 2] + "Q" + t[len(t) // 2 + 1:])]
        want |= {10 * i + k: 10 * i + 1 for k in (1, 2, 3)}
    rows += [(9001, None), (9002, "")]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, band string")
    got = {r["doc_id"]: r["class_id"] for r in e.near_copies(df).collect()}
    assert got[9002] == 9001 and len(got) == len(rows)
    assert sum(got[i] == c for i, c in want.items()) / len(want) >= 0.97
    assert all(got[i] // 10 == i // 10 for i in want)
