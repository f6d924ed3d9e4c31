"""Views and edits of a ledger, and the rows to learn from."""

from __future__ import annotations

from datetime import date
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions import constants as K
from tallyspark.functions import scalars as S

KEY = ["source_file", "seq"]


def search(ledger: DataFrame, text: str | None = None, categories: list[str] | None = None, flags: list[str] | None = None, files: list[str] | None = None, first: date | None = None, last: date | None = None) -> DataFrame:
    """Rows that meet all conditions given: a pattern in the description, values, and days including both ends."""
    tests = []
    if text:
        tests.append(F.coalesce(F.col("description").rlike("(?i)" + text), F.lit(False)))
    tests += [F.col(c).isin(values) for c, values in (("category", categories), ("flag", flags), ("source_file", files)) if values]
    tests += [F.col("date") >= F.lit(first)] if first else []
    tests += [F.col("date") <= F.lit(last)] if last else []
    return ledger.where(reduce(lambda a, b: a & b, tests)) if tests else ledger


def filter_options(ledger: DataFrame) -> DataFrame:
    """(kind, value): all categories, flags that are not empty, and files."""
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("value")) for k in ("category", "flag", "source_file")]))
    return ledger.select(kinds.alias("o")).select("o.*").where("value is not null and not (kind = 'flag' and value = '')").distinct().orderBy("kind", "value")


def date_bounds(ledger: DataFrame) -> DataFrame:
    return ledger.agg(F.min("date").alias("first_date"), F.max("date").alias("last_date"))


def with_account(ledger: DataFrame, accounts: DataFrame) -> DataFrame:
    """Bank and account number of each row's file; a file without them keeps nulls. Spark broadcasts accounts if they are small."""
    return ledger.drop("bank_name", "account_number").join(accounts.select("source_file", F.col("bank").alias("bank_name"), "account_number"), "source_file", "left")


def overlay(ledger: DataFrame, edits: DataFrame, columns: list[str]) -> DataFrame:
    """The ledger with the edited values that are not null."""
    new = edits.select(*KEY, *[F.col(c).alias("new_" + c) for c in columns])
    return ledger.join(new, KEY, "left").withColumns({c: F.coalesce("new_" + c, c) for c in columns}).drop(*["new_" + c for c in columns])


def changed(before: DataFrame, after: DataFrame, column: str = "category") -> DataFrame:
    """Rows of after whose column differs from before, nulls included."""
    old = before.select(*KEY, F.col(column).alias("old"))
    return after.join(old, KEY).where(~F.col(column).eqNullSafe(F.col("old"))).drop("old")


def training_rows(before: DataFrame, after: DataFrame) -> DataFrame:
    """(description, direction, category, source): changed rows as the user's, and all that a rule classified."""
    cols = ["description", S.direction(F.col("debit")).alias("direction"), "category"]
    rules = after.where("method = 'rule'").select(*cols, F.lit("rule").alias("source"))
    return changed(before, after).select(*cols, F.lit("user").alias("source")).unionByName(rules)


def keep_last(rows: DataFrame, order: str) -> DataFrame:
    """Of rows with equal description, direction and category the last by order, as one aggregate with map-side combining."""
    keys = ["description", "direction", "category"]
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("r")).select(*keys, "r.*").select(*rows.columns)


def replicate_user_rows(rows: DataFrame, times: int = 3) -> DataFrame:
    """The user's rows so many times."""
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.when(F.col("source") == "user", times).otherwise(1))))


def classify(rows: DataFrame) -> DataFrame:
    """category, confidence and method by rules alone; what no rule matches is Others, 0, default."""
    way = S.direction(F.col("debit"))
    return rows.withColumn("category", S.category(F.col("description"), way)).withColumns(
        {"confidence": F.when(F.col("category").isNotNull(), F.lit(K.RULE_CONFIDENCE)).otherwise(0.0), "method": F.when(F.col("category").isNotNull(), "rule").otherwise("default"), "category": F.coalesce("category", F.lit(K.FALLBACK))}
    )


def gate(rows: DataFrame, least: float = K.MIN_CONFIDENCE) -> DataFrame:
    """A model's guesses (guess, probability) as category, confidence and method; those below least are Others, 0, default."""
    sure = F.col("probability") >= least
    return rows.withColumns({"category": F.when(sure, F.col("guess")).otherwise(K.FALLBACK), "confidence": F.when(sure, F.col("probability")).otherwise(0.0), "method": F.when(sure, "ml").otherwise("default")})


def union_files(parts: list[DataFrame]) -> DataFrame:
    """Ledgers of several files as one, with file_idx for their order; a column that one lacks is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [p.withColumn("file_idx", F.lit(i)) for i, p in enumerate(parts)])


def drop_empty_columns(rows: DataFrame) -> DataFrame:
    """Without the columns that are null in all rows: one pass of counts."""
    counts = rows.agg(*[F.count(F.col(c)).alias(c) for c in rows.columns]).first()
    return rows.select(*[c for c in rows.columns if counts[c]])


def running(ledger: DataFrame) -> Window:
    return Window.partitionBy("source_file").orderBy("seq")
