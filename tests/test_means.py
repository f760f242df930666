"""Boundaries of columns are the means that SQL and the reference have, rounded at each addition."""

from quire.sources import pagefold


def test_word_at_the_very_edge_of_a_column():
    edges = [38.5, 38.6, 54.7, 67.7, 113.3, 195.9]
    plain = 0.0
    for e in edges:
        plain += e
    mid = sum(edges) / 6 - 10  # of the sum that is corrected for rounding
    assert mid < plain / 6 - 10
    span = lambda x, t: {"x": x, "width": 0.0, "font_size": 1.0, "text": t}
    lines = [{"spans": [span(0.0, "a"), span(e, "b")], "box": (0, i, 200, i + 1)} for i, e in enumerate(edges)]
    lines += [{"spans": [span(0.0, "x"), span(mid, "y"), span(200.0, "z")], "box": (0, i, 200, i + 1)} for i in (7, 8)]
    (table,) = pagefold.aligned(lines)
    assert table["rows"] == [["x y", "z"]] * 2
