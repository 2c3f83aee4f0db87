import tracemalloc

import numpy as np
import pyarrow as pa

from pagetide.functions import html as H
from pagetide.functions.batches import by_pieces, pieces, row_bytes
from pagetide.operators import diffs


def python_peak(run, *columns):
    """(result, MB of Python objects at most); Arrow's own buffers don't count."""
    tracemalloc.start()
    try:
        out = run(*columns)
        return out, tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_pieces_cover_every_row_once():
    sizes = np.array([3, 0, 9, 4, 4, 4, 20, 0, 1])
    assert list(pieces(sizes, 8)) == [(0, 2), (2, 1), (3, 2), (5, 1), (6, 1), (7, 2)]
    assert list(pieces(np.zeros(0, np.int64), 8)) == []
    assert row_bytes(pa.array(["ab", None, "é"])).tolist() == [2, 0, 2]
    assert row_bytes(pa.array([["ab", "c"], None, [], ["d"]])).tolist() == [19, 0, 0, 9]
    assert row_bytes(pa.array([[1, 2], [], [3]], pa.list_(pa.int32()))).tolist() == [16, 0, 8]
    words = pa.array(["a", None, "bc", ""])
    assert by_pieces(lambda c: pa.array([x and x * 2 for x in c.to_pylist()], pa.string()), words, most=1).to_pylist() == ["aa", None, "bcbc", ""]
    assert len(by_pieces(lambda c: c, words.slice(0, 0))) == 0


def test_a_batch_of_pages_is_scanned_a_piece_at_a_time(spark):
    page = "".join(f'<p>line {i} of words</p><a href="/to/{i}">x</a>' for i in range(100))
    n = 1500
    html, url = pa.array([None, *[page] * n]), pa.array(["https://example.com/"] * (n + 1))
    scan = H._scanner().func
    out, peak = python_peak(scan, html, url)
    assert len(out) == n + 1 and out[0].as_py()["text"] is None and len(out[n].as_py()["links"]) == 100
    assert out[1].as_py() == scan(html.slice(n), url.slice(n))[0].as_py()
    assert peak < 25


def test_a_batch_of_gaps_is_compared_a_piece_at_a_time(spark):
    old = [f"line {i} of the version before" for i in range(100)]
    new = [*old[:50], "another", *old[51:]]
    n = 3000
    compared = diffs._compared(diffs.MAX_PAIRS).func
    kind = pa.list_(pa.string())
    out, peak = python_peak(compared, pa.array([[], *[old] * n], kind), pa.array([["x"], *[new] * n], kind))
    assert out[0].as_py() == [{"op": "+", "line": "x"}]
    assert [(e["op"], e["line"]) for e in out[n].as_py()] == diffs.script(old, new)
    assert peak < 25
    places = pa.array([list(range(200))] * n, pa.list_(pa.int32()))
    out, peak = python_peak(diffs._rising().func, places)
    assert len(out) == n and out[n - 1].as_py() == list(range(200))
    assert peak < 15
