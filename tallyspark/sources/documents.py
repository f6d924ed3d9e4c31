"""Statement files as words. Extraction is a function of one file's bytes, so that any PDF or OCR library can be used.

A file that can't be read gives no words but a status: ok, password, or the error; it never fails the job.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORDS = "source_file string, page int, kind string, word_no int, text string, x0 double, x1 double, top double, bottom double"
SCHEMA = WORDS + ", status string"
KINDS = {"page": "Int32", "word_no": "Int32", "x0": float, "x1": float, "top": float, "bottom": float} | dict.fromkeys(("kind", "text", "status"), object)


class PasswordRequired(Exception):
    """The file is encrypted and no password, or a wrong one, was given."""


def read_words(spark: SparkSession, path: str, extract: Callable[[bytes], Iterable[dict]], glob: str = "*.pdf") -> DataFrame:
    """SCHEMA rows of all files below path; extract gives dicts of page, kind, word_no, text, x0, x1, top and bottom."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        for batch in batches:
            for file, content in zip(batch["path"], batch["content"]):
                try:
                    rows, status = list(extract(bytes(content))), "ok"
                except PasswordRequired:
                    rows, status = [], "password"
                except Exception as error:  # one bad file must not stop the others
                    rows, status = [], str(error)[:200]
                own = rows or [{"kind": "blank"}]
                out = pd.DataFrame([{"source_file": file.rsplit("/", 1)[-1], "status": status} | r for r in own]).reindex(columns=names)
                yield out.astype(KINDS)

    return files.select("path", "content").mapInPandas(run, SCHEMA)


def page_kinds(words: DataFrame) -> DataFrame:
    """(source_file, page, kind) of pages."""
    return words.where("page is not null").groupBy("source_file", "page").agg(F.first("kind").alias("kind"))
