import numpy as np

from tessera.llm import ann


def brute(rows, every, k):
    good = {}
    for i, v in rows:
        if i is None or v is None or len(v) != 8 or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            continue
        good[i] = min(good.get(i, list(v)), list(v))
    out = {}
    for q in good:
        if q % every == 0:
            scored = []
            for i, v in good.items():
                if i != q:
                    s = 0.0
                    for a, b in zip(good[q], v, strict=True):
                        s += a * b
                    scored.append((-s, i))
            out[q] = [(i, -s) for s, i in sorted(scored)[:k]]
    return out


def test_exact_with_completion(spark):
    rng = np.random.default_rng(4)
    rows = [(int(i), [float(x) for x in rng.normal(0, 1, 8)]) for i in range(700)]
    rows += [(1000 + i, rows[5][1]) for i in range(60)]
    rows += [(2000, None), (2020, [0.0] * 8), (2040, [1.0, None] * 4), (2060, [float("nan")] * 8), (2080, [float("inf")] * 8), (2100, [1.0]), (None, [1.0] * 8), (20, rows[3][1]), rows[40]]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, score string")
    got = {}
    for r in ann.search(frame, window=64).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    want = brute(rows, 20, 20)
    assert {q: [v for _, v in sorted(x.items())] for q, x in got.items()} == want


def test_queries_in_portions(spark, monkeypatch):
    rng = np.random.default_rng(5)
    frame = spark.createDataFrame([(i, [float(x) for x in rng.normal(0, 1, 8)]) for i in range(400)], "vec_id long, embedding array<double>")
    key = lambda d: sorted(tuple(r) for r in d.collect())
    whole = key(ann.search(frame, window=64))
    monkeypatch.setattr(ann, "BLOCK_BYTES", 300)
    assert key(ann.search(frame, window=64)) == whole


def test_few_and_empty(spark):
    frame = spark.createDataFrame([(0, [1.0, 0.0]), (7, [0.5, 1.0]), (9, [0.5, -1.0])], "vec_id long, embedding array<float>")
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in ann.search(frame).orderBy("rank").collect()] == [(0, 1, 7, 0.5), (0, 2, 9, 0.5)]
    assert ann.search(frame.limit(0)).count() == 0
    assert ann.search(frame.where("vec_id = 0")).count() == 0


def test_windows_alone_reach_most_neighbours(spark):
    """Windows that cover a twentieth of the rows, of vectors without any structure."""
    rng = np.random.default_rng(7)
    v = rng.normal(0, 1, (6000, 16))
    rows = [(i, [float(x) for x in r / np.linalg.norm(r)]) for i, r in enumerate(v)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    key = lambda d: {(r.query_id, r.vec_id) for r in d.collect()}
    some, full = key(ann.search(frame, every=50, window=100, complete=False)), key(ann.search(frame, every=50, window=100))
    assert len(some & full) / len(full) >= 0.9


def test_windows_alone_find_clustered_neighbours(spark):
    """On clustered vectors the windows alone already have most of the neighbours."""
    rng = np.random.default_rng(1)
    centres = rng.normal(0, 1, (120, 8))
    rows = [(i, [float(x) for x in centres[i % 120] * 3 + rng.normal(0, 0.05, 8)]) for i in range(6000)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    key = lambda d: {(r.query_id, r.vec_id) for r in d.collect()}
    some, full = key(ann.search(frame, every=50, window=256, complete=False)), key(ann.search(frame, every=50, window=256))
    assert len(some & full) / len(full) >= 0.9


def test_hilbert_is_a_walk():
    side = 8
    cells = np.stack(np.meshgrid(*[np.arange(side)] * 3, indexing="ij"), axis=-1).reshape(-1, 3)
    keys = ann.hilbert(cells, 3)
    assert sorted(keys) == list(range(side**3))
    walk = cells[np.argsort(keys)]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()
