import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer, models

from weftline.llm import token_counts as x
from weftline.llm.shared import public_tokenizer

PATH = public_tokenizer(x.VOCABULARY)


def library(pieces, byte_fallback):
    model = Tokenizer(models.Unigram([("", 0.0), *pieces], 0, byte_fallback))
    return lambda t: len(model.encode(x.MARK + t.replace(" ", x.MARK)).ids) if t else 0


@pytest.fixture(scope="module")
def public():
    pieces, bytes_too = x.read_vocabulary(PATH)
    assert bytes_too
    return x.counter(PATH), library(pieces, True)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "the", "ing", "É", "ß", "  ", " ", " ", "\n", "\t", "中", "😀", "▁", "<0x41>", ".", "ther", "1", "2024", "\x00", "aaaa"]), max_size=25).map("".join))
def test_counts_are_the_librarys(public, text):
    assert public[0].count(text) == public[1](text)


def test_vocabularies_with_ties():
    rnd = random.Random(5)
    for k in range(60):
        pieces = {x.MARK: -3.0} | {"".join(rnd.choice("abc" + x.MARK * (k % 2)) for _ in range(rnd.randint(1, 4))): float(-rnd.randint(1, 4)) / (1 + k % 3) for _ in range(12)}
        if k % 5 == 0:
            pieces |= {f"<0x{b:02X}>": 0.0 for b in range(256)}
        c, lib = x.UnigramCounter(list(pieces.items()), k % 5 == 0), library(list(pieces.items()), k % 5 == 0)
        for _ in range(60):
            t = "".join(rnd.choice("abcd \n") for _ in range(rnd.randint(0, 14)))
            assert c.count(t) == lib(t), (pieces, t)


def test_documents_and_awkward(spark, awkward, nothing, public):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = x.count_tokens(docs, PATH).collect()
    assert {r.doc_id: r.n_tokens for r in rows} == {d: public[1](t) for d, t in texts.items()}
    rows = x.count_tokens(awkward.withColumn("n_tokens", awkward.lang), PATH).collect()
    assert len(rows) == awkward.count() and {r.n_tokens for r in rows if r.doc_id in (3, 4)} == {0}
    assert x.count_tokens(nothing, PATH).count() == 0
