import hashlib
import random
import re

from tessera.llm import secrets

ASSIGN = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base(text):
    text = text or ""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return [f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in sorted(out)]


def test_against_brute_force(spark):
    rng = random.Random(5)
    parts = ["password=", "Token : '", "api_KEY=", "secret=token:", "abcdef", "x" * 3, "AKIA", "ABCD0123EFGH4567", "deadbeef01" * 3, " é😀 ", '"', "==", "\n", "0123456789abcdef" * 2, "ſecret=abcdefg", "word"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(400)] + [None, "", "token=" + "a" * 50_000]
    docs = spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)] + [(None, texts[0], 1)], "doc_id long, text string, spans int")
    out = secrets.report(secrets.scan(docs, [0.0] * secrets.SIDE**2)).collect()
    assert len(out) == len(texts) + 1
    for r in out:
        want = base(texts[r.doc_id or 0])
        assert r.spans.split(",") == (want or [""]), texts[r.doc_id or 0]
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(w.startswith(k) for w in want) for k in secrets.KINDS[:3])


def test_models(spark):
    words = "the quick customer order finally arrived without delay while internationalization considerations remained outstanding".split()
    rng = random.Random(2)
    rows = [(k, " ".join(rng.choice(words) for _ in range(60))) for k in range(60)]
    odd = hashlib.sha256(b"q").hexdigest()[:20].upper() + "zQ9"
    rows.append((100, f"the {odd} order internationalization customer_order_arrived password=0123456789abc"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    ratios = secrets.train(secrets.samples(docs))
    scanned = secrets.scan(docs, ratios)
    got = {r.doc_id: r.spans for r in secrets.report(scanned).collect()}
    at = rows[-1][1].index("password")
    assert got.pop(100) == f"markov:4:27,assign:{at}:{at + 22}"
    assert set(got.values()) == {""}
    text = secrets.redacted(scanned).where("doc_id = 100").first().text
    assert text == "the [secret] order internationalization customer_order_arrived [secret]"
    plan = secrets.report(scanned)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert max(secrets.train(secrets.samples(docs.limit(0), made=0))) == 0
    assert secrets.scan(docs.limit(0), ratios).count() == 0


def test_overlapping_spans_are_redacted_once(spark):
    docs = spark.createDataFrame([(1, "a token=0123456789abcdef0123456789abcdef b"), (2, None)], "doc_id long, text string")
    out = {r.doc_id: r.text for r in secrets.redacted(secrets.scan(docs, [0.0] * secrets.SIDE**2)).collect()}
    assert out == {1: "a [secret] b", 2: None}


def test_precision_and_recall_of_added_spans(spark):
    """Held-out random strings are found; numbers, dates, UUIDs, paths and identifiers with digits are left alone."""
    import uuid

    rng = random.Random(11)
    draw = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    upper, lower, digits = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
    syllables = "ca sto mer re port in voi ce ship ment han dler quest clus ter sto rage ri ver gar den mar ket al to ne sil pro du tion bor tle fen gra hi jo ku lo".split()
    vocab = ["".join(rng.choice(syllables) for _ in range(rng.randint(2, 4))) for _ in range(1500)]
    word = lambda: rng.choice(vocab)
    docs = spark.createDataFrame([(k, " ".join(word() for _ in range(60))) for k in range(200)], "doc_id long, text string")
    ratios = secrets.train(secrets.samples(docs))
    kinds = {
        "base64": lambda: draw(upper + lower + digits + "+/", rng.randint(20, 44)),
        "letters and digits": lambda: draw(upper + lower + digits, rng.randint(18, 32)),
        "upper": lambda: draw(upper + digits, 20),
        "number": lambda: draw(digits, rng.randint(16, 24)),
        "date": lambda: f"20{rng.randint(10, 29)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}T{rng.randint(10, 23)}-{rng.randint(10, 59)}-{rng.randint(10, 59)}",
        "uuid": lambda: str(uuid.UUID(int=rng.getrandbits(128))),
        "path": lambda: f"/{word()}/{word()}/{word()}/v{rng.randint(1, 9)}",
        "name": lambda: f"{word()}_{word()}_{word()}_{rng.randint(1, 999)}",
    }
    secret = {"base64", "letters and digits", "upper"}
    rows = [(k, kind, f"before {make()} after") for kind, make in kinds.items() for k in range(100)]
    found = secrets.report(secrets.scan(spark.createDataFrame(rows, "doc_id long, kind string, text string"), ratios), "kind").collect()
    hit = {kind: sum(r.spans.startswith("markov") or ",markov" in r.spans for r in found if r.kind == kind) for kind in kinds}
    caught = sum(hit[k] for k in secret)
    assert caught >= 0.95 * 100 * len(secret), hit
    assert caught >= 0.95 * sum(hit.values()), hit
