"""Summaries of a ledger (see plans.fixtures for its columns). Money is summed as decimals and returned as doubles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions import constants as K

MONEY = "decimal(38,2)"


def money(name: str) -> Column:
    """A column as an exact amount; what is no number is null."""
    return F.col(name).try_cast("decimal(18,2)")


def total(amount: Column) -> Column:
    """Sum of amounts, 0 if there is none."""
    return F.coalesce(F.sum(amount), F.lit(0)).cast("double")


def dated(ledger: DataFrame) -> DataFrame:
    return ledger.withColumn("date", F.col("date").try_cast("date")).withColumn("month", F.date_format("date", "yyyy-MM"))


def monthly_summary(ledger: DataFrame) -> DataFrame:
    rows = dated(ledger).where("month is not null").groupBy("month").agg(total(money("debit")).alias("debit"), total(money("credit")).alias("credit"), F.count("date").alias("transactions"), F.coalesce(F.sum(F.coalesce(money("credit"), F.lit(0)) - F.coalesce(money("debit"), F.lit(0))), F.lit(0)).cast("double").alias("net"))
    return rows.orderBy("month")


def breakdown(ledger: DataFrame, side: str) -> DataFrame:
    """Amount, number, mean and share of each category, of rows with something on this side ("debit" or "credit")."""
    rows = ledger.withColumn("x", money(side)).where("x > 0 and category is not null").groupBy("category").agg(F.sum("x").alias("s"), F.count("*").alias("transactions"))
    # a window over one row for each category
    share = F.bround(F.col("s").cast("double") / F.sum("s").over(Window.partitionBy()).cast("double") * 100, 1)
    return rows.select("category", F.col("s").cast("double").alias("amount"), "transactions", F.round(F.col("s").cast("double") / F.col("transactions"), 6).alias("avg"), share.alias("share")).orderBy(F.desc("amount"), "category")


def category_breakdown(ledger: DataFrame) -> DataFrame:
    return breakdown(ledger, "debit")


def income_breakdown(ledger: DataFrame) -> DataFrame:
    return breakdown(ledger, "credit")


def spending(ledger: DataFrame) -> DataFrame:
    """Rows with a debit and a counterparty."""
    return ledger.withColumn("x", money("debit")).where("x > 0 and counterparty <> ''")


def top_counterparties(ledger: DataFrame, n: int = 10) -> DataFrame:
    rows = spending(ledger).groupBy("counterparty").agg(F.sum("x").cast("double").alias("amount"), F.count("*").alias("transactions"))
    return rows.withColumn("avg", F.round(F.col("amount") / F.col("transactions"), 6)).orderBy(F.desc("amount"), "counterparty").limit(n)


def cashflow_summary(ledger: DataFrame) -> DataFrame:
    """One row. The closing balance is the last one by file and sequence; the top category the one of the largest debits."""
    last = F.max_by(F.when(F.col("balance").isNotNull(), money("balance")), F.when(F.col("balance").isNotNull(), F.struct("source_file", "seq")))
    rows = dated(ledger)
    one = rows.agg(total(money("credit")).alias("total_in"), total(money("debit")).alias("total_out"), F.coalesce(last, F.lit(0)).cast("double").alias("closing_balance"), F.greatest(F.count_distinct("month"), F.lit(1)).alias("months"), F.count("*").alias("n_transactions"))
    spent = ledger.where("debit is not null and category is not null").groupBy("category").agg(F.sum(money("debit")).alias("s"))
    top = spent.agg(F.min_by("category", F.struct(-F.col("s"), "category")).alias("top"))
    net = F.col("total_in") - F.col("total_out")
    return one.join(F.broadcast(top)).select(  # one row each
        F.bround("total_in", 2).alias("total_in"),
        F.bround("total_out", 2).alias("total_out"),
        F.bround(net, 2).alias("net"),
        F.bround("closing_balance", 2).alias("closing_balance"),
        F.when(F.col("total_in") != 0, F.bround(net / F.col("total_in") * 100, 1)).otherwise(0.0).alias("savings_rate"),
        F.bround(F.col("total_in") / F.col("months"), 2).alias("avg_monthly_in"),
        F.bround(F.col("total_out") / F.col("months"), 2).alias("avg_monthly_out"),
        F.when(F.col("total_out") > 0, F.coalesce("top", F.lit(""))).otherwise("").alias("top_category"),
        "n_transactions",
    )


def category_totals(ledger: DataFrame) -> DataFrame:
    """The export's summary: rows, debits, credits and net of each category."""
    rows = ledger.where("category is not null").groupBy("category").agg(F.count("*").alias("count"), total(money("debit")).alias("debit"), total(money("credit")).alias("credit"), F.sum(F.coalesce(money("credit"), F.lit(0)) - F.coalesce(money("debit"), F.lit(0))).cast("double").alias("net"))
    return rows.orderBy(F.desc("debit"), "category")


def anomalies(rows: DataFrame, columns: tuple[str, ...] = ("debit", "credit"), sigmas: float = K.ANOMALY_SIGMAS, order: str = "date") -> DataFrame:
    """Rows whose amount is at least so many deviations from the mean, on either side; once for each column."""
    parts = []
    for c in columns:
        x = F.col(c).try_cast("double")
        some = rows.where(x > 0)
        # one row of statistics, joined to all rows without a shuffle of them
        stats = some.agg(F.avg(x).alias("mu"), F.stddev_samp(x).alias("sigma"), F.count("*").alias("n"))
        hit = some.join(F.broadcast(stats)).where((F.col("n") >= 5) & (F.col("sigma") > 0)).where(F.abs(x - F.col("mu")) / F.col("sigma") >= sigmas)
        parts.append(hit.drop("mu", "sigma", "n").withColumn("anomaly", F.lit(f"High {c.capitalize()} (>{sigmas}σ)")))
    return reduce(DataFrame.unionByName, parts).orderBy(order)


def recurring(ledger: DataFrame) -> DataFrame:
    """Counterparties paid about weekly or monthly with amounts that hardly vary.

    Gaps follow from how often a payee was paid on each day, so a window never has more rows of a payee than days, however
    many payments there are; amounts are aggregated apart, with map-side combining.
    """
    rows = spending(dated(ledger)).where("date is not null")
    days = rows.groupBy("counterparty", "date").agg(F.count("*").alias("n"))
    days = days.withColumn("gap", F.date_diff("date", F.lag("date").over(Window.partitionBy("counterparty").orderBy("date"))))
    # a day's first payment follows the day before, the others follow it after no day
    gaps = days.select("counterparty", F.explode(F.array(F.struct("gap", F.lit(1).cast("long").alias("n")), F.struct(F.lit(0).alias("gap"), (F.col("n") - 1).alias("n")))).alias("g")).where("g.gap is not null and g.n > 0")
    median = gaps.groupBy("counterparty").agg(F.percentile("g.gap", 0.5, F.col("g.n")).alias("gap"))
    by = rows.groupBy("counterparty").agg(F.stddev_samp(F.col("x").cast("double")).alias("dev"), F.avg(F.col("x").cast("double")).alias("mean"), F.max("date").alias("last"), F.count("*").alias("count"))
    steady = by.join(median, "counterparty").where("(gap between 25 and 35 or gap between 6 and 8) and (dev is null or dev < 0.1 * mean) and count >= 2")
    return steady.select("counterparty", F.when(F.col("gap") > 15, "Monthly").otherwise("Weekly").alias("frequency"), F.bround("mean", 2).alias("avg_amount"), F.date_format("last", "yyyy-MM-dd").alias("latest_date"), "count").orderBy(F.desc("avg_amount"), "counterparty")


def balance_trend(ledger: DataFrame) -> DataFrame:
    """The last balance of each day, by file and sequence: an aggregate, so no day's rows are sorted in one task."""
    rows = dated(ledger).where("balance is not null and date is not null")
    return rows.groupBy("date").agg(F.max_by(money("balance"), F.struct("source_file", "seq")).cast("double").alias("balance")).orderBy("date")


def payee_frequency(ledger: DataFrame) -> DataFrame:
    return ledger.where("counterparty <> ''").groupBy("counterparty").agg(F.count("*").alias("count"), F.min(F.struct("source_file", "seq")).alias("first")).orderBy(F.desc("count"), "first").select("counterparty", "count")


def month_in_out(ledger: DataFrame) -> DataFrame:
    """The monthly summary with a row for either side."""
    return monthly_summary(ledger).unpivot("month", ["credit", "debit"], "type", "amount")


def top_categories(ledger: DataFrame, n: int) -> DataFrame:
    return category_breakdown(ledger).orderBy(F.desc("amount"), "category").limit(n)
