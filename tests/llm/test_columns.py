"""Columns of the input that have the names of columns the operators make."""

import public_tokenizers

from tessera.llm import bpe, decontam, quality, toxicity
from tessera.llm.catalogue import judged


def test_input_columns_keep_their_values(spark):
    docs = spark.createDataFrame([("mine", 1, "hello WORLD", "n"), (None, 2, None, "m")], "__text string, doc_id long, text string, note string")
    bench = spark.createDataFrame([(1, "hello world")], "item_id long, text string")
    model = quality.Model.untrained()
    net = toxicity.train([])
    outs = [
        quality.score(docs, model),
        toxicity.score(docs, net),
        bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.json")),
        decontam.scan(docs, bench),
    ]
    for out in outs:
        rows = {r.doc_id: r for r in out.collect()}
        assert [(r["__text"], r.text, r.note) for r in (rows[1], rows[2])] == [("mine", "hello WORLD", "n"), (None, None, "m")]
    assert {r.doc_id: r.decoded for r in outs[2].collect()} == {1: "hello WORLD", 2: ""}
    assert {r.doc_id: r["items"] for r in outs[3].collect()} == {1: ["1"], 2: []}


def test_judged_columns(spark):
    import zlib

    rows = [(k, s) for k, s in enumerate([0.0, 0.29999, 0.3, 0.7, 0.69999, 1.0] * 5)] + [(None, 0.5)]
    scored = spark.createDataFrame(rows, "doc_id long, score double")
    for modulus, held, threshold in ((3, 1, 0.7), (5, 0, 0.3)):
        got = {r.doc_id: (r.held_out, r.score, r.predicted) for r in judged(scored, modulus, held, threshold).collect()}
        want = {i: (i is not None and zlib.crc32(str(i).encode()) % modulus == held, s, int(s >= threshold)) for i, s in rows}
        assert got == want
