import random

import numpy as np
import pytest

from tessera.llm import jaccard


def shingles(text, width):
    words = (text or "").encode().translate(jaccard.LOWER).split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[k : k + width]) for k in range(len(words) - width + 1)) if len(words) >= width else frozenset([("short", *words)])


def brute(rows, width, percent):
    sets = [shingles(t, width) for _, t in rows]
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    best = {}
    for k, (i, _) in enumerate(rows):
        best[find(k)] = min((x for x in (best.get(find(k)), i) if x is not None), default=None)
    return sorted((i, len(sets[k]), best[find(k)] if sets[k] else i) for k, (i, _) in enumerate(rows))


@pytest.mark.parametrize("block,short", [(2048, 96), (5, 4)])
def test_against_brute_force(spark, monkeypatch, block, short):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "SHORT", short)
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 3)))
    rows = []
    for _ in range(12):
        base = [word() for _ in range(rng.randint(3, 120))]
        for _ in range(rng.randint(1, 14)):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = word()
            rows.append(" ".join(copy))
    shared = " ".join(word() for _ in range(15))
    rows += [f"{shared} {' '.join(word() for _ in range(40))}" for _ in range(30)]
    rows += ["", None, " \t ", "a b", "A  B", "a b c", "a b c d", rows[0], rows[0].upper()]
    rng.shuffle(rows)
    rows = [(k * 3 - 20, t) for k, t in enumerate(rows)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, sid string")
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.join(docs, width=3, percent=80).collect())
    assert got == brute(rows, 3, 80)


@pytest.mark.parametrize("weak,small,size", [(True, True, 30), (False, True, 30), (True, False, 110), (False, False, 110)])
def test_single_links_of_borderline_families(spark, monkeypatch, weak, small, size):
    """Families just below the threshold, joined by one pair; other pairs of theirs come before it."""
    if small:
        monkeypatch.setattr(jaccard, "NEAREST", 1)
        monkeypatch.setattr(jaccard, "BLOCK", 64)
        monkeypatch.setattr(jaccard, "TILE_TOKENS", 4096)
        monkeypatch.setattr(jaccard, "SHORT", 4)
    core = [f"core{k}" for k in range(176)]
    rows, marked = [], {}
    for f in range(4):
        own = core + [f"family{f}w{k}" for k in range(22)]
        for m in range(size):
            x = "x" if m < 4 or m == 17 else f"m{m}x"
            y = "y" if 4 <= m < 8 or m == 17 else f"m{m}y"
            rows.append(" ".join([*own, f"f{f}{x}", f"f{f}{y}"]))
            if m == 17:
                marked[rows[-1]] = 6
        if f < 2:  # 178 of 222 words with one set of the next family, at most 177 of 223 with the others
            rows.append(" ".join([*own, f"f{f + 1}x", f"f{f + 1}y"]))
            marked[rows[-1]] = 1
    if weak:  # a bound that puts the links last: 3 bits, other pairs of their sets 2 at most
        sids = {jaccard.Shingler(1).sets([t.encode()])[0].tobytes(): v for t, v in marked.items()}
        monkeypatch.setattr(jaccard, "sketch", lambda tokens: bytes([sids.get(tokens.tobytes(), 0)]) + bytes(63))
    random.Random(5).shuffle(rows)
    rows = list(enumerate(rows))
    expected = brute(rows, 1, 80)
    assert len({c for _, _, c in expected}) == 2
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.join(docs, width=1, percent=80).collect())
    assert got == expected


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard.join(docs).count() == 0
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "x y"), (4, "x y"), (4, "x y")], "doc_id long, text string")
    got = sorted(jaccard.join(docs).collect(), key=str)
    assert [tuple(r) for r in got] == [(1, 0, 1), (2, 0, 2), (4, 1, 4), (4, 1, 4), (None, 1, 4)]


def test_sketch_never_exceeds_the_difference():
    rng = np.random.default_rng(0)
    for n in (1, 40, 300, 3000):
        x = np.unique(rng.integers(0, 1 << 63, n, np.uint64))
        y = np.unique(np.concatenate([x[n // 10 :], rng.integers(0, 1 << 63, n // 7, np.uint64)]))
        a, b = (np.frombuffer(jaccard.sketch(t), np.uint8) for t in (x, y))
        size = min(len(a), len(b))
        d = int(np.bitwise_count(jaccard.folded(a, size) ^ jaccard.folded(b, size)).sum())
        assert d <= len(x) + len(y) - 2 * jaccard.shared_count(x, y)
