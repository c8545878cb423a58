import hashlib

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tessera.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def pair():
    return Tokenizer.from_file(PATH), bpe.Codec(bpe.vocabulary(PATH))


TEXTS = st.text(st.characters(exclude_categories=["Cs"]), max_size=60) | st.lists(
    st.sampled_from(["the", " in", "  ", "\n\t", "é", "123", "'s", "'LL", "<|endoftext|>", "<|endof", "\x1c", "\x85", "日本", "𝒳", "!!", "a" * 70])
).map("".join)


@settings(max_examples=400, deadline=None)
@given(text=TEXTS)
def test_as_the_library(pair, text):
    library, codec = pair
    ids = library.encode(text, add_special_tokens=False).ids
    packed = codec.encode(text)
    assert list(memoryview(packed).cast("i")) == ids
    assert codec.decode(packed) == library.decode(ids, skip_special_tokens=False)


def test_long_run(pair):
    library, codec = pair
    text = "ab" * 40_000 + "　" * 3 + "x" * 1001
    assert list(memoryview(codec.encode(text)).cast("i")) == library.encode(text, add_special_tokens=False).ids


def test_rows(spark, pair):
    library, _ = pair
    rows = [(1, "Hello there", "a"), (1, "Hello there", "a"), (None, None, None), (2, "", "b"), (3, "x<|endoftext|>y " * 9, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = bpe.encode(docs, PATH)
    assert out.columns == ["doc_id", "text", "ids", "decoded"]
    got = {(r.doc_id, r.text): r for r in out.collect()}
    assert got[(None, None)].ids == [] and got[(None, None)].decoded == "" and got[(2, "")].ids == []
    for (_, text), r in got.items():
        assert r.ids == library.encode(text or "", add_special_tokens=False).ids
    digest = bpe.digests(out).where("doc_id = 3").first()
    joined = ",".join(map(str, got[(3, "x<|endoftext|>y " * 9)].ids))
    assert digest.ids_sha256 == hashlib.sha256(joined.encode()).hexdigest()
    assert out.count() == 5
    assert bpe.encode(docs.limit(0), PATH).count() == 0
