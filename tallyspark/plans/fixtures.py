"""Ledgers made from the driver's tables, in Spark and in SQL, which the registered queries run over.

A ledger has source_file, seq, date, description, ref, debit, credit, balance, flag, page, counterparty, category,
confidence and method; rows are ordered by (source_file, seq). Bank and account are added by ledger.with_account().
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyspark.functions import constants as K
from tallyspark.functions import scalars as S
from tallyspark.operators import ledger as L
from tallyspark.ship import ship

NARRATIONS = [
    "UPI/123456789/SWIGGY ORDER",
    "NEFT SALARY ACME CORP",
    "ATM CASH WDL",
    "UPI/AMAZON SHOPPING",
    "ACH/NETFLIX RECURRING",
    "SMS ALERT CHARGES",
    "HOME LOAN EMI",
    "INCOME TAX PAYMENT",
    "AIRTEL MOBILE RECHARGE",
    "POS UNKNOWN SHOP 42",
    "CASH DEPOSIT CDM",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as statements of their customers: one shuffle by customer gives sequence and running balance."""
    file = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    amount, is_credit = F.col("o_totalprice").cast("decimal(18,2)"), F.col("o_orderstatus") == "O"
    rows = table(spark, sf_dir, "orders").select(
        "o_custkey",
        "o_orderkey",
        F.concat(F.lit("stmt_"), F.col("o_custkey").cast("string")).alias("source_file"),
        F.row_number().over(file).cast("long").alias("seq"),
        F.to_date("o_orderdate").alias("date"),
        F.element_at(F.lit(NARRATIONS), (F.col("o_orderkey") % len(NARRATIONS) + 1).cast("int")).alias("description"),
        F.when(~is_credit, amount).alias("debit"),
        F.when(is_credit, amount).alias("credit"),
        (F.lit(100000).cast("decimal(18,2)") + F.sum(F.when(is_credit, amount).otherwise(-amount)).over(file.rowsBetween(Window.unboundedPreceding, 0))).cast("decimal(18,2)").alias("balance"),
    )
    return rows


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = raw_ledger(spark, sf_dir).withColumns(
        {
            "ref": S.reference(F.lit(""), F.col("description")),
            "flag": F.when(F.col("o_orderkey") % 53 == 0, "balance_mismatch").otherwise(""),
            "page": F.floor((F.col("seq") - 1) / 40).cast("int") + 1,
            "counterparty": S.counterparty(F.col("description")),
        }
    )
    rows = L.classify(rows)
    return rows.select("source_file", "seq", "date", "description", "ref", "debit", "credit", "balance", "flag", "page", "counterparty", "category", "confidence", "method")


def rules_sql(text: str = "description", way: str = "dir") -> str:
    """The rules as a CASE expression of DuckDB."""
    quote = lambda p: "'" + p.replace("'", "''") + "'"
    cases = " ".join(f"when {f'{way} = {quote(d)} and ' if d else ''}regexp_matches({text}, {quote(p)}, 'i') then {quote(c)}" for c, p, d in K.RULES)
    return f"case {cases} end"


def counterparty_sql(text: str = "description") -> str:
    noise = "|".join(K.NOISE)
    part = f"""list_filter(list_transform(regexp_split_to_array(coalesce({text}, ''), '[/\\-@|]'), lambda p: trim(p)),
      lambda p: length(p) >= 3 and regexp_matches(p, '[A-Za-z]{{3,}}') and not regexp_full_match(p, '(?i)(?:{noise})') and not regexp_matches(p, '[0-9]{{5,}}'))[1]"""
    return f"""coalesce(left((select string_agg(case when i > 1 and regexp_matches(substr(p, cast(i - 1 as bigint), 1), '\\pL') then lower(substr(p, cast(i as bigint), 1)) else upper(substr(p, cast(i as bigint), 1)) end, '' order by i)
      from (select {part} as p), lateral (select unnest(range(1, length(p) + 1)) as i)), 40), '')"""


def narrations_sql() -> str:
    return "[" + ", ".join(f"'{n}'" for n in NARRATIONS) + "]"


#: The table expressions that all SQL over the ledger begins with. Names are looked up once for each narration.
LEDGER = f"""
with o as (
  select o_custkey, o_orderkey, concat('stmt_', o_custkey) as source_file,
         row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as seq,
         cast(o_orderdate as date) as date,
         list_extract({narrations_sql()}, cast(o_orderkey % {len(NARRATIONS)} + 1 as bigint)) as description,
         case when o_orderstatus <> 'O' then cast(o_totalprice as decimal(18,2)) end as debit,
         case when o_orderstatus = 'O' then cast(o_totalprice as decimal(18,2)) end as credit,
         cast(100000 + sum(case when o_orderstatus = 'O' then cast(o_totalprice as decimal(18,2)) else -cast(o_totalprice as decimal(18,2)) end)
              over (partition by o_custkey order by o_orderdate, o_orderkey rows unbounded preceding) as decimal(18,2)) as balance
  from orders),
names as (select description, {counterparty_sql()} as counterparty, regexp_extract(description, '(?:^|[^A-Za-z0-9])([A-Z]{{0,2}}[0-9]{{6,}})(?:$|[^A-Za-z0-9])', 1) as ref
          from (select distinct description from o)),
l as (
  select o.*, names.counterparty, names.ref,
         case when o_orderkey % 53 = 0 then 'balance_mismatch' else '' end as flag,
         cast(floor((seq - 1) / 40) as integer) + 1 as page,
         case when coalesce(debit, 0) <> 0 then 'dr' else 'cr' end as dir
  from o join names using (description)),
kinds as (select distinct description, dir, {rules_sql()} as hit from (select distinct description, dir from l)),
ledger as (
  select source_file, seq, date, l.description, ref, debit, credit, balance, flag, page, counterparty,
         coalesce(hit, 'Others') as category, case when hit is null then 0.0 else 0.95 end::double as confidence,
         case when hit is null then 'default' else 'rule' end as method, l.dir, o_custkey, o_orderkey
  from l join kinds on l.description = kinds.description and l.dir = kinds.dir)
"""
