"""What PDF files have in common is read once, with the same results."""

import random

import pytest

from quire.sources import pdf, pdfedit


def counted(monkeypatch, owner, name):
    """The calls of a function from now on."""
    calls, fn = [], getattr(owner, name)
    monkeypatch.setattr(owner, name, lambda *a, **k: calls.append(a) or fn(*a, **k))
    return calls


def one(text, **info):
    return pdf.write([{"spans": [{"text": text, "x": 72, "y": 700, "font_size": 12}], "segments": [(1, 2, 3, 2)]}], info)


def test_heads_of_objects_are_read_once_for_all_files(monkeypatch):
    first = pdf.read(one("a b"))
    calls = counted(monkeypatch, pdf.Lexer, "_dict")
    second = pdf.read(one("c d"))
    assert len(calls) < 3  # of nine objects and a trailer
    assert [s["text"] for s in first["spans"] + second["spans"]] == ["a b", "c d"]


def test_what_is_shared_is_not_changed_by_edits():
    before = pdf.read(one("a", title="T"))
    made = pdfedit.rotate(pdfedit.insert_blank(one("a", title="T"), after=[1], size=(9.0, 9.0)), degrees=90)
    assert len(pdf.read(made)["pages"]) == 2
    assert pdf.read(one("a", title="T")) == before


@pytest.mark.parametrize("end", [b"endobj", b"", b"stream"])
def test_heads_that_end_elsewhere(end):
    """A value that goes past the first word that may end it, and one without any end."""
    head = b"<< /A (x %s y) /B [1 2 R 3 0 R] /C 12" % end
    for tail in (b" >>\nendobj", b">>", b""):
        data = head + tail
        for _ in range(2):
            m = pdf._ENDS.search(data)
            lex = pdf.Lexer(data)
            assert pdf._head(data, 0, m.start() if m else len(data)) == (lex.next(), lex.at)


def slow_operations(content):
    """As operations() was: a token at a time."""
    lex, args, out = pdf.Lexer(content), [], []
    while (v := lex.next()) is not None:
        if not isinstance(v, pdf.Op):
            args.append(v)
        elif v == "null":
            args.append(None)
        elif v == "ID":
            m = pdf.re.compile(rb"\sEI(?=\s|$)").search(content, lex.at)
            lex.at = m.end() if m else len(content)
            args = []
        else:
            out.append((str(v), args))
            args = []
    return out


def test_operations_at_once_are_those_of_single_tokens():
    words = [b"1", b"-2.5", b".5", b"+3.", b"12ab", b"--1", b"(a b)", b"(a(b))", b"(\\051)", b"<41>", b"/F1", b"/F#31", b"Tj", b"Tf", b"TJ", b"m", b"l", b"S", b"f*", b"T*", b"'", b"true", b"null", b"R", b"BI", b"ID", b"EI", b"%c\n", b"[", b"]", b"<<", b">>", b"d0", b"re", b"-0", b"truex", b"{"]
    rng = random.Random(4)
    for _ in range(20_000):
        content = b"".join(rng.choice(words) + rng.choice([b" ", b"\n", b" ", b"\0", b"\r\n", b"", b"\t"]) for _ in range(rng.randrange(14)))
        a, b = pdf.operations(content), slow_operations(content)
        assert repr(a) == repr(b), content  # whole numbers stay whole


def test_fonts_without_maps_decode_as_a_whole():
    f = pdf.Font.__new__(pdf.Font)
    f.wide, f.map, f.diff, f.widths, f.default = False, {}, {}, {65: 0.1, 66: 0.2, 67: 700.3}, 600.0
    width = 0.0
    for c in b"ABC\x81\xe9A":
        width += f.widths.get(c, 600.0)
    assert f.decode(b"ABC\x81\xe9A") == ("ABC�éA", width / 1000)
    f.widths = {}
    assert f.decode(b"abc") == ("abc", 1.8)
