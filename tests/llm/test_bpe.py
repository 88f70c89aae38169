import os
import random

import pytest

from wordloom.llm.bpe import TOKENIZERS, Encoder, encode_column

FILE = os.path.join(TOKENIZERS, "byte_bpe_50k.json")
pytestmark = pytest.mark.skipif(not os.path.exists(FILE), reason="no vocabulary here")


@pytest.fixture(scope="module")
def pair():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(FILE)
    t.encode_special_tokens = True
    return Encoder(open(FILE, "rb").read()), lambda s: t.encode(s, add_special_tokens=False).ids


def test_agrees_with_the_library(pair):
    own, library = pair
    rnd = random.Random(5)
    letters = "abeinostr  '’\n\t\r0123é漢字かな🙂👍́​\xa0<|endoftext|>{}()"
    texts = ["", " ", "a", "<|endoftext|> it's", "aaaaaaaaaaaaaaaa", "漢" * 300, "x" * 5000, "ab" * 4000]
    texts += ["".join(rnd.choice(letters) for _ in range(rnd.randrange(1, 200))) for _ in range(400)]
    for t in texts:
        assert own.encode(t) == library(t), t[:50]


def test_agrees_on_documents(pair, spark):
    import pyarrow.parquet as pq

    own, library = pair
    for t in pq.read_table("/root/testdata/sf0.01/documents.parquet")["text"].to_pylist():
        assert own.encode(t) == (library(t) if t else [])
        assert own.decode(own.encode(t)) == (t or "")
    assert own.decode(None) == "" and own.decode([10**9]) == ""


def test_rows(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (2, "hello", "y"), (None, "hello", "z")], "doc_id long, text string, ids string")
    out = encode_column(df, "doc_id", "text")
    assert out.columns == ["doc_id", "ids"]
    rows = sorted(out.collect(), key=lambda r: (r.doc_id or 0, len(r.ids)))
    assert [list(r.ids) for r in rows] == [[31373], [], [], [31373]]
    assert encode_column(df.limit(0), "doc_id", "text").count() == 0
