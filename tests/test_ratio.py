"""Texts that pack very well are kept through every format."""

import zipfile

import pytest

from quire.operators import convert
from quire.sources import archive, reader

BLOCKS = [{"type": "heading", "text": "h", "level": 1}, *[{"type": "paragraph", "text": "the same again"}] * 3000]


@pytest.mark.parametrize("fmt", ["docx", "xlsx", "pptx", "epub"])
def test_repeated_text_is_read_again(fmt):
    made = reader.parse(convert.generate(BLOCKS, fmt), None)
    assert made["error"] is None and made["format"] == fmt
    assert made["text"].count("the same again") == 3000


@pytest.mark.parametrize("fmt", ["docx", "xlsx"])
def test_word_and_excel_files_of_others_have_no_ratio(fmt, tmp_path):
    long = {"type": "paragraph", "text": "the same again " * 3000}
    mine = archive.Archive(convert.generate([long], fmt), archive.BY_SIZE)
    at = tmp_path / "f"
    with zipfile.ZipFile(at, "w", zipfile.ZIP_DEFLATED) as z:
        for n in mine.names():
            z.writestr(n, mine.read(n))
        assert max(i.file_size / i.compress_size for i in z.infolist()) > 100
    assert reader.parse(at.read_bytes(), None)["text"].count("the same again") == 3000
