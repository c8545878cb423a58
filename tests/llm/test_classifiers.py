import random

import numpy as np

from tessera.llm import quality, toxicity


def corpus(n, seed):
    """Clean prose; junk has shouting, symbols or runs of one word; toxic has slurs with a shared stem."""
    rng = random.Random(seed)
    syllables = ["an", "er", "th", "in", "re", "ou", "st", "ea"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    rows = []
    for i in range(n):
        words = [word() for _ in range(rng.randint(20, 160))]
        good, toxic = 1, 0
        if i % 4 == 1:
            good = 0
            words = [w.upper() + "!!" for w in words] if i % 8 == 1 else [w for w in words[:12] for _ in range(9)]
        elif i % 4 == 3:
            toxic = 1
            for k in range(0, len(words), 15):
                words[k] = "vile" + rng.choice(syllables)
        rows.append((i, " ".join(words), good, toxic))
    return rows


def frames(spark, rows):
    docs = spark.createDataFrame([r[:2] for r in rows] + [(None, None), (-5, ""), (-6, "z" * 100_000)], "doc_id long, text string")
    docs = docs.selectExpr("*", "'a' as score", "1 as label")
    return docs, spark.createDataFrame([(r[0], r[2], r[3]) for r in rows] + [(None, 1, 1), (0, None, None)], "doc_id long, quality int, toxic int")


def test_quality(spark):
    rows = corpus(400, 1)
    docs, labels = frames(spark, rows)
    model = quality.fit(docs, labels, "quality")
    got = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    assert len(got) == 403 and all(0 <= v <= 1 for v in got.values())
    held = [r for r in corpus(200, 2)]
    exact = [float(quality.Scorer(model).scores([r[1].encode()])[0]) for r in held]
    assert np.mean([(s >= 0.5) == bool(r[2]) for s, r in zip(exact, held, strict=True)]) > 0.97
    # the score is the softmax of the averaged vectors
    ids, part = quality.counted(held[3][1].encode())
    plain = quality.softmax(part @ model.vectors[ids] @ model.out + model.bias)[1]
    assert abs(plain - exact[3]) < 1e-4
    assert quality.score(docs, quality.fit(docs, labels.limit(0), "quality")).where("score <> 0.5").count() == 0
    assert quality.score(docs.limit(0), model).count() == 0


def test_quality_trains_on_packed_rows(spark, monkeypatch):
    """The driver holds the training rows in a fraction of their bytes, bit by bit what was counted; repeated ids are in order of their features."""
    rows = [(r[0], " ".join([r[1]] * 8), r[2], r[3]) for r in corpus(60, 5)]
    docs, labels = frames(spark, rows + [(2, "one more", 1, 0), (2, "", 1, 0)])
    seen = []
    real = quality.Model.trained
    monkeypatch.setattr(quality.Model, "trained", lambda found, *more: (seen.append(found), real(found, *more))[1])
    quality.fit(docs, labels, "quality", held_out=(1, 1))
    (found,) = seen
    texts = sorted([(r[0], r[1]) for r in rows] + [(2, "one more"), (2, "")], key=lambda t: (t[0], quality.counted(t[1].encode())[0].tobytes()))
    plain = [quality.counted(t.encode()) for _, t in texts]
    assert len(found) == 62 and all((a == i).all() and (b == p).all() and a.dtype == i.dtype and b.dtype == p.dtype for (a, b, _), (i, p) in zip(found, plain, strict=True))
    assert 2 * sum(map(len, found.data)) < sum(i.nbytes + p.nbytes for i, p in plain)


def test_toxicity(spark):
    rows = corpus(600, 3)
    docs, labels = frames(spark, rows)
    net = toxicity.fit(docs, labels)
    scored = toxicity.score(docs, net).collect()
    assert len(scored) == 603 and all(0 <= r.score <= 1 for r in scored)
    held = corpus(120, 4)
    found = toxicity.Scorer(net).scores([r[1].encode() for r in held])
    assert np.mean((found >= 0.7) == np.array([r[3] == 1 for r in held])) > 0.95
    assert toxicity.score(docs.limit(0), net).count() == 0
    assert toxicity.score(docs, toxicity.fit(docs, labels.limit(0))).where("score <> 0.5").count() == 0


def test_quality_reads_long_words_whole(monkeypatch):
    """Every n-gram of a word counts, wherever pieces are cut."""
    rng = random.Random(3)
    words = [bytes(rng.choice(b"abcdefgh") for _ in range(n)) for n in (5000, 1, 97, 300)]
    text = b" ".join([*words, words[2]])
    ids, share = quality.counted(text)
    monkeypatch.setattr(quality, "PIECE", 61)
    cut_ids, cut_share = quality.counted(text)
    assert (ids == cut_ids).all() and (share == cut_share).all()
    n_grams = sum(1 + sum(max(len(w) + 3 - n, 0) for n in quality.GRAMS) for w in [*words, words[2]])
    n_word_grams = len(words)  # bigrams; no trigram is repeated
    assert np.isclose(1 / (n_grams + n_word_grams), share[share > 0].min())
    # what stands in the middle of a word moves the score as learned
    clean, junk = (w * 400 for w in ("anerthin", "zqxjkvwz"))
    rows = [(*quality.counted(t.encode()), y) for t, y in ((clean, 1), (junk, 0)) for _ in range(20)]
    scorer = quality.Scorer(quality.Model.trained(rows, 8, 2.0))
    ends = "anerthin" * 8
    found = scorer.scores([(ends + clean + ends).encode(), (ends + junk + ends).encode()])
    assert found[0] > 0.8 and found[1] < 0.2


def test_toxicity_reads_long_words_whole():
    """Every n-gram of a long run of bytes is in a word of bounded size, also in its middle."""
    rng = random.Random(4)
    for n in (96, 97, 100, 140, 141, 5000):
        text = bytes(rng.choice(b"abcdefgh\xe4\xb8\x96") for _ in range(n))
        words = toxicity.normal(text)
        assert max(map(len, words)) <= toxicity.LONGEST
        for size in toxicity.SIZES:
            assert {text[k : k + size] for k in range(n - size + 1)} == {w[k : k + size] for w in words for k in range(len(w) - size + 1)}


def test_toxicity_gradient():
    """Back-propagation against finite differences."""
    net = toxicity.Network(1)
    for k in net.p:
        net.p[k] = net.p[k].astype(np.float64)
    rng = np.random.default_rng(0)
    gates = rng.normal(0, 1, (9, 2, 3 * toxicity.HIDDEN))
    ids = rng.integers(1, 9, (5, 12))
    ids[2, 7:] = 0
    y = np.array([0, 1, 1, 0, 1.0])
    _, g, d_gates = net.gradient(gates, ids, y)
    loss = lambda: net.gradient(gates, ids, y)[0]
    for name, array, grad in [(k, net.p[k], g[k]) for k in g] + [("gates", gates, d_gates)]:
        for _ in range(4):
            at = tuple(rng.integers(0, s) for s in array.shape)
            if name == "gates" and at[0] == 0:
                continue
            old = array[at]
            array[at] = old + 1e-3
            up = loss()
            array[at] = old - 1e-3
            down = loss()
            array[at] = old
            assert abs((up - down) / 2e-3 - grad[at]) < 2e-3 + 0.05 * abs(grad[at]), name


def test_windows_cover():
    for n in (0, 1, 48, 49, 72, 73, 1000):
        starts = toxicity.windows(n)
        assert starts[0] == 0 and starts[-1] + toxicity.WINDOW >= n
        assert all(b - a <= toxicity.STRIDE for a, b in zip(starts, starts[1:]))


def test_toxicity_is_the_worst_window(spark):
    """Scores against a plain loop over every window, one at a time."""
    rng = np.random.default_rng(0)
    vocab = [f"w{k}" for k in range(300)]
    texts = [" ".join(rng.choice(vocab, n)) for n in (0, 1, 5, 47, 48, 49, 72, 73, 200, 1000)] + [None]
    rows = [(" ".join(rng.choice(vocab, 30)) + (" w7 w7 w7" if y else ""), y) for y in (0, 1) for _ in range(40)]
    net = toxicity.train([(t.encode(), y) for t, y in rows])
    want = []
    for t in texts:
        words = toxicity.normal((t or "").encode())
        gates = np.concatenate([np.zeros((1, 2, 3 * toxicity.HIDDEN), np.float32), *([net.gates_of(words)] if words else [])])
        best = -np.inf
        for a in toxicity.windows(len(words)):
            ids = np.zeros((1, toxicity.WINDOW), np.int64)
            part = np.arange(len(words))[a : a + toxicity.WINDOW] + 1
            ids[0, : len(part)] = part
            best = max(best, float(net.forward(gates, ids)[0][0]))
        want.append(1 / (1 + np.exp(-best)))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.score for r in toxicity.score(docs, net).collect()}
    assert np.allclose([got[k] for k in range(len(texts))], want, atol=1e-5)
