"""A corpus in stages: language identification, toxicity, near copies, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
one's docs; all but the last keep the columns of documents, whatever those are. Rows with null or empty texts have no
language and leave in the first stage. Rows with equal ids are separate documents; of rows with equal id and text the third stage
keeps one.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm import langid, ngram_join, packing, toxicity
from tallyspark.llm.common import stage_table, table
from tallyspark.llm.queries import small_batches, tokenizer_file

#: Word shingles and percentage from which documents are near copies.
WORDS, PERCENT = 5, 80
THRESHOLD = 0.7


def keep(docs: DataFrame, mask: Callable[[list], list[bool]]) -> DataFrame:
    """The rows of docs whose text mask() accepts, with all columns and no shuffle."""
    place = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array(mask(batch.column(place).to_pylist()), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def identified_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language compression can't tell."""
    small_batches(spark)
    sent, key = spark.sparkContext.broadcast(langid.dictionaries(docs)), uuid.uuid4().hex

    def mask(texts: list) -> list[bool]:
        own = langid.identifier(key, sent)
        return [not own.identify(x)[2] for x in texts]

    return keep(docs, mask)


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the classifier, trained on the labels of documents still here, calls toxic."""
    small_batches(spark)
    rows = toxicity.training_rows(docs, table(spark, sf_dir, "labels"))
    model = toxicity.train([t for t, _ in rows], [y for _, y in rows])
    sent, key = spark.sparkContext.broadcast(model.pack()), uuid.uuid4().hex

    def mask(texts: list) -> list[bool]:
        return (toxicity.model_of(key, sent).scores([x or "" for x in texts]) < THRESHOLD).tolist()

    return keep(docs, mask)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies the document with the smallest id stays; texts without words all stay."""
    small_batches(spark)
    return ngram_join.first_of_components(docs, WORDS, PERCENT)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sequences of the documents left: a row for each piece."""
    small_batches(spark)
    return packing.packing_report(docs, tokenizer_file("byte_bpe_50k.json"), lambda df: stage_table(df, "pieces")[0])


STAGES = [("language", identified_language), ("toxicity", not_toxic), ("near_copies", one_of_near_copies), ("packing", packed)]

#: No stage but the third can be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is written to the shared folder before the next one reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs, _ = stage_table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
