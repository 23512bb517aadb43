import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestream.llm import bpe
from lodestream.llm.common import tokenizer_dir
from lodestream.session import table

PATH = f"{tokenizer_dir()}/byte_bpe_50k.json"


def reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return t


def ids(texts):
    flat, start = bpe.Encoder(PATH).encode(texts)
    return [flat[a:b].tolist() for a, b in zip(start, start[1:])]


def test_same_ids_as_the_public_library():
    texts = ["", None, " ", "a" * 5000, "ab" * 3000 + "  \n\n\t x", "'S don't 's 'll", "<|endoftext|> a", "½²٣ x", "​﻿ zz", "हिन्दी 中文字符" * 50, "😀😀 x", "\x1c\x1d a\x85b\u2028c d", "word " * 2000]
    want = [e.ids for e in reference().encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert ids(texts) == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=8))
def test_any_text(texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    assert ids(texts) == [e.ids for e in reference().encode_batch(texts, add_special_tokens=False)]


def test_forgetting_words_changes_nothing(monkeypatch):
    monkeypatch.setattr(bpe, "MEMORY", 3)
    e = bpe.Encoder(PATH)
    first = e.encode(["some words to be learnt here"])[0].tolist()
    e.encode(["other ones"])
    assert e.encode(["some words to be learnt here"])[0].tolist() == first


def test_whole_table_edges_and_counts(spark, sf):
    docs = table(spark, sf, "documents")
    got = {r.doc_id: list(r.ids) for r in bpe.encode_texts(docs, "doc_id", "text").collect()}
    rows = docs.select("doc_id", "text").collect()
    want = reference().encode_batch([r.text or "" for r in rows], add_special_tokens=False)
    assert got == {r.doc_id: e.ids for r, e in zip(rows, want)} and len(got) == docs.count()
    counted = bpe.count_texts(docs.select("doc_id", "text"), "text")
    assert {r.doc_id: r.n_tokens for r in counted.collect()} == {k: len(v) for k, v in got.items()}
    odd = spark.createDataFrame([(None, None, 1), (1, "x", 2), (1, "x", 2)], "k long, t string, ids int")
    assert sorted(len(r.ids) for r in bpe.encode_texts(odd, "k", "t").collect()) == [0, 1, 1]
    assert bpe.encode_texts(odd.limit(0), "k", "t").count() == 0
    assert isinstance(np.int64(1) + 0, np.int64)
