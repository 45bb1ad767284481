"""The HTML functions on batches: a batch's texts are not all Python's at once."""

import tracemalloc

import pyarrow as pa
import pytest

from talelake.functions import text


@pytest.mark.parametrize("function, plain", [(text.html_paragraphs, text.paragraphs), (text.sanitise_html, text.sanitise)])
def test_a_batch_is_parsed_in_slices(function, plain):
    pages = [None, "", "<p>a</p><p> </p>b", "x\ny", "<ul><li>é &amp; e</li></ul>"] + [f"<p>{k}</p><p>{'long ' * 1000}</p>" for k in range(1500)]
    batch = pa.array(pages)
    tracemalloc.start()
    got = function.func(batch)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got.to_pylist() == [plain(x) for x in pages]
    assert peak < 3_000_000 < batch.nbytes  # of 7.5 MB of texts
    assert function.func(pa.array([], pa.string())).to_pylist() == []
