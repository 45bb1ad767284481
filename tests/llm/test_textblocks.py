import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from talelake.llm import textblocks as tb

TEXT = st.lists(st.one_of(st.none(), st.text(alphabet="aAbZ é\t\n\x0b\xa0日", max_size=40)), max_size=12)


def plain(text):
    return (text or "").encode().lower().split()


@settings(max_examples=200, deadline=None)
@given(TEXT, st.sampled_from([3, 17, 1 << 20]))
def test_words_and_shingles(texts, segment):
    old, tb.SEGMENT = tb.SEGMENT, segment
    try:
        data, offsets = tb.utf8(pa.array(texts, pa.string()))
        hashes, rows = tb.words(data, offsets)
        sets = tb.shingles(data, offsets, 4)
    finally:
        tb.SEGMENT = old
    want = [(i, w) for i, t in enumerate(texts) for w in plain(t)]
    assert rows.tolist() == [i for i, _ in want]
    by_word = {}
    for (_, w), h in zip(want, hashes.tolist(), strict=True):
        assert by_word.setdefault(w, h) == h
    assert len(set(by_word.values())) == len(by_word)
    for t, s in zip(texts, sets, strict=True):
        w = plain(t)
        assert len(s) == len({tuple(w[k : k + 4]) for k in range(max(1, len(w) - 3))} if w else ()) and (np.diff(s.astype(object)) > 0).all()


def test_slices():
    column = pa.array(["x y", None, "z", "w v u"])[1:]
    data, offsets = tb.utf8(column)
    assert bytes(data) == b"zw v u" and offsets.tolist() == [0, 0, 1, 6]
    one, two = tb.words(*tb.utf8(pa.array(["Ab c"])))[0], tb.words(*tb.utf8(pa.array(["q", "c aB"])))[0]
    assert one.tolist() == two[[2, 1]].tolist()
