import hashlib
import struct

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from talelake.llm.byte_bpe import Codec, encode_digests, encode_documents, load_ranks

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def known():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_ranks(PATH), special_tokens={})


def agree(known, texts):
    codec = Codec(PATH, public_tokenizers.PATTERN, True)
    for text, packed in zip(texts, codec.encode(texts), strict=True):
        assert list(struct.unpack(f"<{len(packed) // 4}I", packed)) == known.encode_ordinary(text), text
        assert codec.decode(packed) == text.encode()


def test_chosen_texts(known):
    agree(known, ["", " ", "a", "  two  spaces \n\n x", "it's we'll I'd", "naïve Straße ñandú 12³ ½x ª_b__", "x y z\x1cq\x85w", "日本語テキスト 🙂🙂", "a" * 5000, "ab" * 3000, "___foo_bar", "<|endoftext|>", "9" * 40])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=8))
def test_any_texts(known, texts):
    agree(known, texts)


def test_documents(spark, known):
    rows = [(1, "Hello world", 0), (1, "Hello world", 0), (2, None, 1), (3, "", 2), (None, "x", 3), (4, "word " * 60000, 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    found = encode_digests(docs, PATH, public_tokenizers.PATTERN, True).collect()
    want = []
    for doc, text, _ in rows:
        ids = known.encode_ordinary(text or "")
        want.append((doc, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, want))
    whole = encode_documents(docs, PATH, public_tokenizers.PATTERN, True).where("doc_id = 1").first()
    assert whole.ids == known.encode_ordinary("Hello world") and bytes(whole.decoded) == b"Hello world"
    assert encode_digests(docs.limit(0), PATH, public_tokenizers.PATTERN, True).count() == 0
