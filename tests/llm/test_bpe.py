import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from mnemosaic.llm import bpe
from mnemosaic.llm.common import table
from tokenizers import Tokenizer


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.default_vocabulary())


def check(texts, library):
    mine = bpe.load(bpe.default_vocabulary())
    got = mine.encode_batch(texts)
    for text, ids, want in zip(texts, got, library.encode_batch(texts, add_special_tokens=False)):
        assert ids.tolist() == want.ids, repr(text)
        assert mine.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_documents_match_the_library(spark, sf, library):
    docs = table(spark, sf, "documents")
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = bpe.encode_decode(docs).collect()
    assert len(got) == len(texts)
    for r in got:
        assert r.ids == library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.decoded == texts[r.doc_id]


def test_odd_texts(library):
    rng = random.Random(2)
    odd = ["", " ", "a" * 5000, "ab" * 3000, "  \n\n \t x", "don't they'll I'VE", "<|endoftext|>", "a<|endoftext|>  <|endoftext|>b", "héé ñ 漢字 مرحبا 😀👍🏽", "1234567890 ١٢٣", "\x00\x1c\x1d\x1f\x85\xa0 　 x", "\x1c\x1c a", "…—“”", "ſK İı"]
    odd += ["".join(rng.choice("aeinorst .,'\n  éß<|>") for _ in range(300)) for _ in range(50)]
    check(odd, library)


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    check([text], Tokenizer.from_file(bpe.default_vocabulary()))


def test_edges_of_input(spark):
    schema = "doc_id long, text string, ids string"
    got = bpe.encode_decode(spark.createDataFrame([(1, None, "x"), (2, "", "x"), (2, "", "x"), (None, "word " * 50000, "x")], schema)).collect()
    assert [len(r.ids) for r in sorted(got, key=lambda r: len(r.ids))][:3] == [0, 0, 0] and len(got) == 4
    assert bpe.encode_decode(spark.createDataFrame([], schema)).count() == 0
