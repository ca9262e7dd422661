import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from arcweave.llm import bpe

PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def codec():
    return bpe.codec(PATH, P.PATTERN)


@pytest.fixture(scope="module")
def library(codec):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=codec.vocabulary.ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text())
def test_any_text(codec, library, text):
    ids = codec.encode(text)
    assert list(memoryview(ids).cast("I")) == library.encode_ordinary(text) and codec.decode(ids) == text.encode()


def test_odd_texts(codec, library):
    for text in ("", " ", "\x1c\x85\xa0 x", "it's 'S I'll", "ſ K", "a" * 5000, " " * 3000 + "x", "中文" * 500, "\n\n \n", "x²½Ⅷ٣", "<|endoftext|>", "×÷"):
        assert list(memoryview(codec.encode(text)).cast("I")) == library.encode_ordinary(text)


def test_appends_and_edits(codec):
    rng = random.Random(1)
    data = b"".join(rng.choice([b"the", b"ing", b"x", b"\xc3\xa9", b" ", b"tion"]) for _ in range(3000))
    whole = bpe.PrefixTable(codec.vocabulary, data)
    table = bpe.PrefixTable(codec.vocabulary)
    for a in range(0, len(data), 97):
        table.append(data[a : a + 97])
        assert table.ids() == bpe.PrefixTable(codec.vocabulary, data[: a + 97]).ids() if a < 400 else True
    assert table.last == whole.last
    for start, end, by in ((10, 12, b"zz"), (500, 500, b"hello"), (700, 900, b""), (0, 1, b"q"), (len(data) - 300, len(data) - 250, b"end")):
        made = whole.replace(start, end, by)
        data = data[:start] + by + data[end:]
        assert whole.data == data and whole.last == bpe.PrefixTable(codec.vocabulary, data).last and made < 600 + len(by)


def test_documents(spark, library):
    rows = [(1, "Hello, wörld", "x"), (2, None, "y"), (None, "", "z"), (1, "Hello, wörld", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids_sha256 string")
    got = bpe.encode_documents(docs, PATH, P.PATTERN, keep_ids=True).collect()
    assert len(got) == 4 and all(r.round_trip for r in got)
    for r, (i, text, _) in zip(got, rows):
        ids = library.encode_ordinary(text or "")
        assert (r.doc_id, r.n_tokens, r.ids) == (i, len(ids), ids)
        assert r.ids_sha256 == hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in ids)).hexdigest() and r.decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    assert bpe.encode_documents(docs.limit(0), PATH, P.PATTERN).count() == 0
