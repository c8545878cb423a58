import random

from tessera.llm import decontam


def brute(text, items, width=10):
    found = decontam.words((text or "").encode())
    hit, who = set(), set()
    for item, t in items:
        w = decontam.words((t or "").encode())
        n = min(width, len(w))
        if not n:
            continue
        windows = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
        for k in range(len(found) - n + 1):
            if tuple(found[k : k + n]) in windows:
                hit.update(range(k, k + n))
                who.update([str(item)] if item is not None else [])
    return len(found), len(hit), sorted(who)


def test_against_brute_force(spark):
    rng = random.Random(3)
    vocab = ["a", "B", "c9", "Éa", "d-e", "ß"]
    make = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(k, make(rng.randint(1, 6))) for k in range(20)] + [(3, "a b"), (None, "a a"), (77, None), (78, " - ")]
    texts = [make(rng.randint(0, 40)) for _ in range(40)] + [None, "", "--", "a" * 5000]
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)] + [(None, texts[0], "x")], "doc_id long, text string, items string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for size in (1 << 20, 20):
        got = decontam.scan(docs, bench, width=4, automaton_bytes=size).collect()
        assert len(got) == len(texts) + 1
        for r in got:
            n, hit, who = brute(r.text, items, 4)
            assert (r.n_words, sum(s["last"] - s["first"] + 1 for s in r.spans), r["items"]) == (n, hit, who)
            for s in r.spans:
                inner = r.text[s["start"] : s["end"]].encode()
                assert decontam.words(inner) == decontam.words(r.text.encode())[s["first"] : s["last"] + 1]


def test_removed_and_empty(spark):
    docs = spark.createDataFrame([(1, "x y! Hello big world end"), (2, None)], "doc_id long, text string")
    bench = spark.createDataFrame([("q", "hello BIG world")], "item_id string, text string")
    out = {r.doc_id: r.text for r in decontam.removed(decontam.scan(docs, bench)).collect()}
    assert out == {1: "x y!  end", 2: None}
    assert decontam.report(decontam.scan(docs, bench.limit(0))).where("contaminated").count() == 0
    assert decontam.scan(docs.limit(0), bench).count() == 0
