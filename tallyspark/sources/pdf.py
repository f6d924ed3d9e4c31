"""An extractor for documents.read_words(): the text layer of PDF files, by the library pymupdf where it is installed.

Pages with too few words in their text layer go to a recogniser, if one is given: a function of a page and its scale in
dots per point, which gives words as dicts of text, x0, x1, top and bottom in points. A page that can't be read is blank.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from tallyspark.functions import constants as K
from tallyspark.sources.documents import PasswordRequired

MOST_DPI = 300


def extractor(password: str | None = None, recognise: Callable | None = None, dpi: int = MOST_DPI, library=None) -> Callable[[bytes], Iterator[dict]]:
    """A function of a file's bytes for read_words(). library stands for pymupdf in tests."""

    def extract(raw: bytes) -> Iterator[dict]:
        pdf = library
        if pdf is None:
            try:
                import pymupdf as pdf
            except ImportError as error:
                raise RuntimeError("reading PDF files needs pymupdf") from error
        with pdf.open(stream=raw, filetype="pdf") as file:
            if file.needs_pass and not file.authenticate(password or ""):
                raise PasswordRequired
            for number, page in enumerate(file, 1):
                kind, words = "blank", []
                try:
                    words = [dict(zip(("x0", "top", "x1", "bottom", "text"), w)) for w in page.get_text("words") if w[4].strip()]
                    kind = "text"
                    if len(words) < K.TEXT_PAGE_WORDS:
                        words = list(recognise(page, min(dpi, MOST_DPI) / 72)) if recognise else []
                        kind = "ocr" if words else "blank"
                except Exception:  # one bad page must not stop the others
                    kind, words = "blank", []
                for i, w in enumerate(words or [{}]):
                    yield {"page": number, "kind": kind, "word_no": i} | w

    return extract
