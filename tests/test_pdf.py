import contextlib

import pytest

from tallyspark.sources import documents, pdf

WORDS = [(10.0 * i, 0.0, 10.0 * i + 5, 10.0, f"w{i}", 0, 0, i) for i in range(24)] + [(0.0, 0.0, 1.0, 1.0, " ", 0, 0, 25)]


class Page:
    def __init__(self, words):
        self.words = words

    def get_text(self, kind):
        if self.words is None:
            raise ValueError("damaged page")
        return self.words


class Library:
    """Stands for the PDF library: a file of three pages, locked if its bytes say so."""

    @contextlib.contextmanager
    def open(self, stream, filetype):
        yield File(stream)


class File(list):
    def __init__(self, raw):
        super().__init__([Page(WORDS), Page(WORDS[:3]), Page(None)])
        self.needs_pass = raw == b"locked"

    def authenticate(self, password):
        return password == "open"


def test_text_layer():
    rows = list(pdf.extractor(library=Library())(b"plain"))
    assert [r["kind"] for r in rows] == ["text"] * 24 + ["blank", "blank"] and rows[0]["x1"] == 5.0 and rows[-1]["page"] == 3
    seen = []
    rows = list(pdf.extractor(recognise=lambda page, scale: seen.append(scale) or [{"text": "read", "x0": 0.0, "x1": 1.0, "top": 0.0, "bottom": 1.0}], dpi=600, library=Library())(b"plain"))
    assert [r["kind"] for r in rows[24:]] == ["ocr", "blank"] and seen == [300 / 72]


def test_passwords():
    with pytest.raises(documents.PasswordRequired):
        list(pdf.extractor(library=Library())(b"locked"))
    assert len(list(pdf.extractor("open", library=Library())(b"locked"))) == 26


def test_missing_library(spark, tmp_path):
    try:
        import pymupdf  # noqa: F401
    except ImportError:
        (tmp_path / "a.pdf").write_bytes(b"x")
        assert "pymupdf" in documents.read_words(spark, str(tmp_path), pdf.extractor()).collect()[0]["status"]
