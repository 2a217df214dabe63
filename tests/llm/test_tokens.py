"""The encoders against the public libraries, and the pipeline's stages against what they promise."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from verdikt.llm import queries as R
from verdikt.llm import tokens as K

ODD = ["", "  a  b ", "it's  \n\n x  y", "ΑΣ ΣΑΣ", "İstanbul é ﬁ Ⅷ ½", "<|endoftext|> hi<|startoftext|>", "a\x1cb\x1d c", "日本語 한국어 🙂👩‍👩‍👧 ź", "tabs\tand\r\nlines\x0b\x0c\x85 end ", "I'LL we'Re don't 123", "\n\nx\n y\n", "a" * 3000, "!!!!???...,,,---", "x <| y", " em", "İıſ  z "]


def samples():
    r = random.Random(1)
    return ODD + ["".join(r.choice(" \n\t'sabcDEFé́ñΣ日0１.!<|>🙂 ") for _ in range(60)) for _ in range(300)]


def test_word_encoder_equals_library():
    path = R.word_tokenizer()
    mine, theirs = K.WordBpe(path), Tokenizer.from_file(path)
    for t in samples():
        ids = theirs.encode(t, add_special_tokens=False).ids
        assert mine.encode(t) == np.array(ids, dtype="<u4").tobytes(), t
        assert mine.decode(mine.encode(t)).decode() == theirs.decode(ids, skip_special_tokens=False)


def test_byte_encoder_equals_library():
    mine, theirs = K.ByteBpe(*R.byte_tokenizer()), Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for t in samples():
        assert mine.encode(t) == np.array(theirs.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes(), t


def test_backtracking_equals_merging():
    bpe = K.WordBpe(R.word_tokenizer()).bpe
    r = random.Random(2)
    for _ in range(1500):
        w = "".join(r.choice("abcdeinorst") for _ in range(r.randint(1, 24)))
        assert bpe.encode(w) == [bpe.ids[t] for t in bpe.merged(w + K.END)]


def test_digests_of_odd_rows(spark):
    df = spark.createDataFrame([(1, None, 9), (1, "a b", 9), (None, "x", 9), (2, "", 9)], "doc_id long, text string, n_tokens int")
    got = K.token_digests(df, R.word_tokenizer()).collect()
    empty = hashlib.sha256(b"").hexdigest()
    assert sorted((r.doc_id or -1, r.n_tokens) for r in got) == [(-1, 1), (1, 0), (1, 2), (2, 0)]
    assert {r.decoded_sha256 for r in got if r.n_tokens == 0} == {empty}
    assert K.encode_decode(df, R.word_tokenizer()).filter("decoded = 'a</w> b</w>'").count() == 1


@pytest.fixture(scope="module")
def documents(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")


def test_pipeline_stages(spark, data, documents):
    import corpus_pipeline as C
    from verdikt.llm import ngram_join

    kept = documents
    for name, stage in C.STAGES[:-1]:
        out = spark.createDataFrame(stage(spark, kept, data).toPandas(), kept.schema)
        assert out.columns == documents.columns and 0 < out.count() <= kept.count(), name
        kept = out
    left = ngram_join.ngram_components(kept, C.SHINGLE_WORDS, C.SIMILAR_PERCENT)
    assert left.filter("doc_id <> component_id").count() == 0
    packed = C.pack_sequences(spark, kept, data).toPandas()
    assert set(packed.doc_id) == {r.doc_id for r in kept.collect()}
    fill = packed.groupby("sequence_id").length.sum()
    assert fill.max() <= R.SEQUENCE and len(fill) <= -(-packed.length.sum() // R.SEQUENCE) + 1


def test_pipeline_keeps_one_of_repeated_and_odd_rows(spark, data, documents):
    import corpus_pipeline as C

    rows = [(1, "alpha beta gamma delta epsilon zeta", "en", "s", 1), (2, "alpha beta gamma delta epsilon zeta", "en", "s", 1), (1, "alpha beta gamma delta epsilon zeta", "en", "s", 1), (3, None, "en", "s", 0), (None, "alpha beta gamma delta epsilon zeta", None, None, None), (4, "", "en", "s", 0)]
    got = C.one_of_each(spark, spark.createDataFrame(rows, documents.schema), data).collect()
    assert sorted((r.doc_id or -1) for r in got) == [-1, 1, 3, 4]
    for _, stage in C.STAGES[:2]:
        assert stage(spark, documents.limit(0), data).count() == 0
