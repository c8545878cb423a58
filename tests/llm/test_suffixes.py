import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import suffixes


@settings(max_examples=600, deadline=None)
@given(st.lists(st.integers(1, 3), max_size=60) | st.lists(st.integers(1, 200), max_size=80) | st.text("ab", max_size=40).map(lambda t: [ord(c) for c in t]))
def test_suffix_array(symbols):
    text = [*symbols, 0]
    assert suffixes.suffix_array(text) == sorted(range(len(text)), key=lambda k: text[k:])


def brute(texts, length):
    raws = [(t or "").encode() for t in texts]
    seen = {}
    for raw in raws:
        for k in range(len(raw) - length + 1):
            seen[raw[k : k + length]] = seen.get(raw[k : k + length], 0) + 1
    out = []
    for raw in raws:
        gone = bytearray(len(raw))
        for k in range(len(raw) - length + 1):
            if seen[raw[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        spans = sum(1 for k in range(len(raw)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((len(raw), sum(gone), spans, kept))
    return out


@pytest.mark.parametrize("most,fits", [(4096, 1 << 20), (3, 1 << 20), (4096, 0)])
def test_against_brute_force(spark, monkeypatch, most, fits):
    monkeypatch.setattr(suffixes, "BROADCAST_BYTES", fits)
    rng = random.Random(6)
    letters = "abé"
    make = lambda n: "".join(rng.choice(letters) for _ in range(n))
    shared = [make(n) for n in (15, 20, 21, 30, 60, 200)]
    texts = []
    for _ in range(60):
        texts.append("".join(rng.choice([make(rng.randint(0, 25)), rng.choice(shared), rng.choice(shared)[3:18]]) for _ in range(rng.randint(0, 6))))
    texts += ["ab" * 40, "z" * 30, "z" * 20, None, "", texts[3], texts[3], "q" * 19, "y" * 20]
    docs = spark.createDataFrame([(k if k % 9 else None, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, spans string")
    got = suffixes.cleaned(suffixes.removed_spans(docs, length=20, block=12, most_segments=most)).collect()
    want = brute(texts, 20)
    assert sorted((r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got) == sorted(want)
    named = {(r.doc_id, r.n_bytes, r.n_removed, bytes(r.kept)) for r in got if r.doc_id is not None}
    assert named == {(k, w[0], w[1], w[3]) for k, w in enumerate(want) if k % 9}
    assert suffixes.removed_spans(docs.limit(0)).count() == 0


def test_long_texts_come_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "BUFFER", 300)
    rng = random.Random(2)
    make = lambda n: "".join(rng.choice("abcdef") for _ in range(n))
    passage = make(400)
    texts = [make(700) + passage + make(500), make(10) + passage, make(2000), passage[:100] + make(3)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffixes.cleaned(suffixes.removed_spans(docs, length=50, block=32)).collect()}
    assert got == dict(enumerate(brute(texts, 50)))


def test_anchors_beyond_the_broadcast(spark, monkeypatch):
    """The way for more repeated anchors than a broadcast holds gives the same result; a small bitmap lets others through."""
    rng = np.random.default_rng(6)
    shared = [bytes(rng.integers(97, 123, 400, np.uint8)).decode() for _ in range(5)]
    texts = [bytes(rng.integers(97, 123, 300, np.uint8)).decode() + shared[k % 5] + bytes(rng.integers(97, 123, 90, np.uint8)).decode() for k in range(40)]
    docs = spark.createDataFrame(list(enumerate([*texts, texts[0], None])), "doc_id long, text string")
    key = lambda: sorted((r.doc_id, [tuple(s) for s in r.spans]) for r in suffixes.removed_spans(docs).collect())
    whole = key()
    assert sum(map(bool, (s for _, s in whole))) == 41
    monkeypatch.setattr(suffixes, "BROADCAST_BYTES", 0)
    for bits in (20, 4):
        monkeypatch.setattr(suffixes, "MARK_BITS", bits)
        got = suffixes.report(suffixes.cleaned(suffixes.removed_spans(docs))).collect()
        assert sorted((r.doc_id, r.n_removed) for r in got) == sorted((i, sum(b - a for a, b in merged(s))) for i, s in whole)


def merged(spans):
    out = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out
