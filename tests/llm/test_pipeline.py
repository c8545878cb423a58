import corpus_pipeline
import public_tokenizers
from tokenizers import Tokenizer


def test_each_decision(spark, tmp_path):
    """Planted cases against a plain reading of the five stages."""
    clean = [f"the {w} order of the house and the {w} garden in spring with rain number {k} of them all" for k, w in enumerate(["red", "blue", "old"])]
    leak = "what is the capital of the small green island in the northern sea"
    rows = [(k, t) for k, t in enumerate(clean)] + [(10, clean[0]), (11, clean[1]), (12, f"well {leak} indeed"), (13, leak), (14, "my password=abcdef123456 is here now"), (15, None), (16, "")]
    junk = [(100 + k, " ".join(f"{w}!!" for w in f"BUY NOW {k} CHEAP CLICK HERE {k} WIN".split())) for k in range(40)]
    prose = [(200 + k, f"on day {k} the river of the valley ran over stones {k * 7} and the people of town {k * 3} came to see it") for k in range(40)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows + junk + prose], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 0, 0) for i, _ in junk[:30]] + [(i, 1, 0) for i, _ in prose[:30]], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id: r.ids for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert not set(got) & {i for i, _ in junk}
    assert {0, 1, 2, 12, 14, 15, 16} <= set(got) and not {10, 11, 13} & set(got)
    assert {i for i, _ in prose} <= set(got)
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    read = lambda i: library.decode(got[i], skip_special_tokens=False)
    assert read(12) == "well  indeed" and read(14) == "my [secret] is here now" and read(0) == clean[0] and got[15] == []


def test_near_duplicates_share_four_fifths_of_five_words(spark):
    """A copy with a passage of a fifth of its length appended goes; one with much more stays."""
    words = [f"word{k}" for k in range(200)]
    more = [f"more{k}" for k in range(80)]
    texts = [words, words + more[:42], [f"other{k}" for k in range(80)] + words]
    docs = spark.createDataFrame([(k, " ".join(t), "en", "s", 0) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in corpus_pipeline.distinct(spark, docs, "").collect()) == [0, 2]


def test_stages():
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None


def test_empty_tables_extra_columns_and_repeated_rows(spark, tmp_path):
    """Empty tables give no rows; columns with names of the operators' own are no harm; of repeated rows one stays."""
    kinds = {"documents": "doc_id long, text string, lang string, source string, n_chars long, spans string, items int, __text string, score int", "labels": "doc_id long, quality int, toxic int", "benchmark": "item_id long, text string"}
    for name, kind in kinds.items():
        spark.createDataFrame([], kind).write.parquet(f"{tmp_path}/empty/{name}.parquet")
        rows = [(1, "one small text of seven words here", "en", "s", 34, "x", 1, "y", 2)] * 2 + [(None, None, None, None, None, None, None, None, None)] if name == "documents" else []
        spark.createDataFrame(rows, kind).write.parquet(f"{tmp_path}/few/{name}.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/empty").count() == 0
    got = corpus_pipeline.run(spark, f"{tmp_path}/few").collect()
    assert sorted((r.doc_id or 0, r.n_tokens > 0) for r in got) == [(0, False), (1, True)]
