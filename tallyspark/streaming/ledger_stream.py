"""A ledger as a stream: classified as it arrives, summed by month with a watermark, statements read batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.operators import assembly
from tallyspark.operators import ledger as L


def classified(rows: DataFrame) -> DataFrame:
    """Rules are one projection, so a stream is classified without state."""
    return L.classify(rows)


def daily_totals(rows: DataFrame, lateness: str = "3 days") -> DataFrame:
    """(day, category, debit, credit, transactions) of a stream with a timestamp `at`; later rows are left out."""
    by = rows.withWatermark("at", lateness).groupBy(F.window("at", "1 day").alias("w"), "category")
    return by.agg(F.sum("debit").alias("debit"), F.sum("credit").alias("credit"), F.count("*").alias("transactions")).select(F.col("w.start").cast("date").alias("day"), "category", "debit", "credit", "transactions")


def statements(words: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str):
    """Starts a query that turns each batch of statement words, whole files each, into reconciled transactions."""
    return words.writeStream.foreachBatch(lambda batch, n: sink(assembly.ledger_of(assembly.statement_lines(batch)), n)).option("checkpointLocation", checkpoint).start()
