import hashlib

import corpus
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from barsmith.llm import bpe
from barsmith.llm.tokenizers import pattern, vocabulary

PATH = vocabulary("byte_bpe_multi_50k.tiktoken")
PIECES = ["a", "word", " ", "  ", "\n", "\t", "'s", "'", "r", "e", "12", "é", "一", "...", "!", " ", "xyz" * 9, " " * 12]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=60), st.integers(12, 40))
def test_stitched_equals_whole(parts, chunk):
    text = "".join(parts)
    assert bpe.stitch(text, PATH, pattern(), chunk, chunk // 2).tolist() == bpe.encode(text, PATH, pattern()).tolist()


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=200))
def test_round_trip(text):
    assert bpe.decode(bpe.encode(text, PATH, pattern()), PATH, pattern()) == text.encode()


@pytest.mark.parametrize("chunk,overlap", [(64, 24), (32768, 1024)])
def test_documents(spark, chunk, overlap):
    rows = corpus.texts()
    got = bpe.digests(bpe.encode_documents(corpus.table(spark), PATH, pattern(), chunk=chunk, overlap=overlap)).collect()
    want = []
    for i, t in rows:
        ids = bpe.encode(t or "", PATH, pattern())
        want.append((i, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_empty(spark):
    assert bpe.encode_documents(corpus.table(spark, []), PATH, pattern()).count() == 0
