"""The queries of this subpackage: each runs one operator over its whole table."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm import interleave, langid, licenses, ngram_join, oph, packing, sentencepieces, toxicity, url_lists, warc
from tallyspark.llm.common import stage_table, table, work_folder
from tallyspark.ship import ship


def tokenizer_file(name: str) -> str:
    """A public tokenizer's file: in the folder TOKENIZER_DIR if that is set, else where the installed package has it."""
    if folder := os.environ.get("TOKENIZER_DIR"):
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of 1,000 rows: texts may be long, and a batch is what a Python worker holds. Sends the code, too."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return table(spark, sf_dir, "documents")


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return oph.fingerprint_report(documents(spark, sf_dir))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packing_report(documents(spark, sf_dir), tokenizer_file("byte_bpe_50k.json"), lambda df: stage_table(df, "pieces")[0])


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.link_components(documents(spark, sf_dir), words=4, percent=85)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    learned = langid.dictionaries(docs, ~langid.held_out(F.col("doc_id")))
    return langid.identify(docs, learned).select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepieces.piece_report(documents(spark, sf_dir), tokenizer_file("piece_bpe_32k.model"))


def op7_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    index = warc.write_bundles(warc.plan_records(table(spark, sf_dir, "pages")), work_folder(spark, "warc"))
    return warc.read_bundles(stage_table(index, "index")[0]).drop("bundle", "frame", "frame_offset")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    rows = toxicity.training_rows(docs, table(spark, sf_dir, "labels"), ~toxicity.held_out(F.col("doc_id")))
    model = toxicity.train([t for t, _ in rows], [y for _, y in rows])
    return toxicity.score(docs, model).select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op9_media_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interleave.media_report(documents(spark, sf_dir), lambda df: stage_table(df, "media")[0])


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_lists.url_report(table(spark, sf_dir, "pages"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_fingerprints, op2_license_scan, op3_best_fit_packing, op4_ngram_jaccard_join, op5_language_id, op6_sentencepiece, op7_warc_bundles, op8_toxicity, op9_media_sequences, op10_url_filter)}


def oracle_sql() -> dict[str, str]:
    return {"op2_license_scan": licenses.oracle(), "op4_ngram_jaccard_join": ngram_join.oracle(4, 85), "op7_warc_bundles": warc.SQL, "op10_url_filter": url_lists.SQL}
