"""Plain archives are written and read without zipfile, as it would."""

import io
import random
import zipfile

import pytest

from quire.operators import convert
from quire.sources import archive, office


def counted(monkeypatch, owner, name):
    """The calls of a function from now on."""
    calls, fn = [], getattr(owner, name)
    monkeypatch.setattr(owner, name, lambda *a, **k: calls.append(a) or fn(*a, **k))
    return calls


def as_zipfile(entries, stored=0):
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        for i, (name, text) in enumerate(entries):
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), text, zipfile.ZIP_STORED if i < stored else zipfile.ZIP_DEFLATED)
    return buf.getvalue()


@pytest.mark.parametrize("stored", [0, 1])
def test_archives_are_written_as_zipfile_does(stored):
    entries = [("mimetype", "application/epub+zip"), ("é.xml", "ü" * 99), ("empty", ""), ("[Content_Types].xml", "<x/>")]
    assert convert._zip(entries, stored) == as_zipfile(entries, stored)
    assert convert._zip([]) == as_zipfile([])


def test_parts_that_all_files_have_are_packed_once(monkeypatch):
    convert.docx_bytes([{"type": "paragraph", "text": "a"}], {})
    calls = counted(monkeypatch, convert, "_packed")
    convert.docx_bytes([{"type": "paragraph", "text": "b"}], {})
    assert len(calls) == 2  # its text and what is said of it


def test_plain_archives_are_read_without_zipfile(monkeypatch):
    made = convert.docx_bytes([{"type": "paragraph", "text": "a"}], {"title": "t"})
    monkeypatch.setattr(zipfile, "ZipFile", lambda *a: pytest.fail("zipfile"))
    assert office.docx(made)["text"] == "a"


def taken(content):
    """What an archive gives, or the error."""
    try:
        a = archive.Archive(content)
    except Exception as e:  # zipfile's own ones too
        return type(e).__name__, str(e)
    out = []
    for n in a.names():
        try:
            out.append((n, a.read(n)))
        except Exception as e:
            out.append((n, type(e).__name__, str(e)))
    return out


def test_damaged_archives_give_what_zipfile_gives(monkeypatch):
    rng = random.Random(2)
    whole = convert._zip([("mimetype", "a" * 50), ("b.xml", "xyz" * 40), ("c", "")], 1)
    cases = [whole, b"x" + whole, whole + b"y", whole[:-1], as_zipfile([("a", "1"), ("a", "22")])]
    for _ in range(1500):
        c = bytearray(whole)
        for _ in range(rng.randrange(1, 3)):
            c[rng.randrange(len(c))] = rng.randrange(256)
        cases.append(bytes(c))
    fast = [taken(c) for c in cases]
    monkeypatch.setattr(archive, "directory", lambda content: None)
    for c, f in zip(cases, fast):
        s = taken(c)
        assert f == s, c


def test_slides_alike_are_read_once_and_not_shared(monkeypatch):
    made = convert.pptx_bytes([("T", ["same"]), ("T", ["same"])], {})
    first = office.slides(made)
    calls = counted(monkeypatch, office, "_slide")
    second = office.slides(made)
    assert not calls and first == second and first[0]["blocks"] == first[1]["blocks"]
    second[0]["blocks"][0]["text"] = "changed"
    assert office.slides(made) == first
