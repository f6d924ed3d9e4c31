"""Queries over the ledger fixture, each with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyspark.functions import constants as K
from tallyspark.functions import scalars as S
from tallyspark.operators import analytics as A
from tallyspark.operators import ledger as L
from tallyspark.plans.fixtures import LEDGER, counterparty_sql, ledger, rules_sql, table

QUERIES, SQL = {}, {}


def query(sql: str | None = None, on_ledger: bool = True):
    """Registers a function under its name, with SQL to which the ledger's table expressions are prefixed."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = (LEDGER if on_ledger else "") + sql
        return f

    return put


@query("""select strftime(date, '%Y-%m') as month, coalesce(sum(debit), 0)::double as debit, coalesce(sum(credit), 0)::double as credit,
 count(date) as transactions, (coalesce(sum(credit), 0) - coalesce(sum(debit), 0))::double as net from ledger where date is not null group by 1""")
def monthly_summary(spark, sf_dir):
    return A.monthly_summary(ledger(spark, sf_dir))


BREAKDOWN = """, b as (select category, sum({0}) as s, count(*) as transactions from ledger where {0} > 0 group by 1)
select category, s::double as amount, transactions, round(s::double / transactions, 6) as avg,
 round_even(s::double / (select sum(s)::double from b) * 100, 1) as share from b"""


@query(BREAKDOWN.format("debit"))
def category_breakdown(spark, sf_dir):
    return A.category_breakdown(ledger(spark, sf_dir))


@query(BREAKDOWN.format("credit"))
def income_breakdown(spark, sf_dir):
    return A.income_breakdown(ledger(spark, sf_dir))


@query("""select counterparty, sum(debit)::double as amount, count(*) as transactions, round(sum(debit)::double / count(*), 6) as avg
 from ledger where debit > 0 and counterparty <> '' group by 1 order by 2 desc, 1 limit 5""")
def top_counterparties(spark, sf_dir):
    return A.top_counterparties(ledger(spark, sf_dir), 5)


@query("""select round_even(i::double, 2) as total_in, round_even(o::double, 2) as total_out, round_even(i::double - o::double, 2) as net, round_even(c::double, 2) as closing_balance,
 case when i <> 0 then round_even((i::double - o::double) / i::double * 100, 1) else 0 end as savings_rate, round_even(i::double / m, 2) as avg_monthly_in, round_even(o::double / m, 2) as avg_monthly_out,
 coalesce((select category from ledger where debit is not null group by 1 order by sum(debit) desc, 1 limit 1), '') as top_category, n as n_transactions
 from (select sum(credit) as i, sum(debit) as o, greatest(count(distinct strftime(date, '%Y-%m')), 1) as m, count(*) as n,
       (select balance from ledger where balance is not null order by source_file desc, seq desc limit 1) as c from ledger)""")
def cashflow_summary(spark, sf_dir):
    return A.cashflow_summary(ledger(spark, sf_dir))


@query("""select category, count(*) as count, coalesce(sum(debit), 0)::double as debit, coalesce(sum(credit), 0)::double as credit,
 (coalesce(sum(credit), 0) - coalesce(sum(debit), 0))::double as net from ledger group by 1""")
def export_category_summary(spark, sf_dir):
    return A.category_totals(ledger(spark, sf_dir))


@query("""with s as (select avg(value) as mu, stddev_samp(value) as sigma, count(*) as n from events where value > 0)
select event_id, user_id, value, 'High Value (>3.0σ)' as anomaly from events, s where value > 0 and n >= 5 and sigma > 0 and abs(value - mu) / sigma >= 3.0""", False)
def anomaly_flags(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value")
    return A.anomalies(events, ("value",), order="ts").drop("ts")


@query(""", r as (select o_custkey as c, date '2020-01-01' + cast(seq * [30, 7, 91][cast(o_custkey % 3 + 1 as bigint)] as integer) as d, seq,
   case when o_custkey % 2 = 0 then 500 + seq else coalesce(debit, credit) end as x from ledger),
 g as (select *, d - lag(d) over (partition by c order by d, seq) as gap from r),
 a as (select c, median(gap) as gap, stddev_samp(x::double) as dev, avg(x::double) as mean, max(d) as last, count(*) as n from g where x > 0 group by c)
select concat('payee_', c) as counterparty, case when gap > 15 then 'Monthly' else 'Weekly' end as frequency, round_even(mean, 2) as avg_amount,
 strftime(last, '%Y-%m-%d') as latest_date, n as count from a where n >= 2 and (gap between 25 and 35 or gap between 6 and 8) and (dev is null or dev < 0.1 * mean)""")
def detect_recurring(spark, sf_dir):
    key = F.substring("source_file", 6, 20).cast("long")
    rows = ledger(spark, sf_dir).withColumn("counterparty", F.concat(F.lit("payee_"), key.cast("string")))
    step = F.element_at(F.array(F.lit(30), F.lit(7), F.lit(91)), (key % 3 + 1).cast("int"))
    rows = rows.withColumn("date", F.date_add(F.lit("2020-01-01").cast("date"), (F.col("seq") * step).cast("int")))
    return A.recurring(rows.withColumn("debit", F.when(key % 2 == 0, F.lit(500) + F.col("seq")).otherwise(F.coalesce("debit", "credit")).cast("decimal(18,2)")))


@query("select date, max_by(balance, struct_pack(a := source_file, b := seq))::double as balance from ledger where balance is not null and date is not null group by 1")
def balance_trend(spark, sf_dir):
    return A.balance_trend(ledger(spark, sf_dir))


@query("select counterparty, count(*) as count from ledger where counterparty <> '' group by 1")
def payee_frequency(spark, sf_dir):
    return A.payee_frequency(ledger(spark, sf_dir))


PLAIN = "source_file, seq, date, description, debit::double as debit, credit::double as credit, balance::double as balance, flag, category"


def plain(rows: DataFrame) -> DataFrame:
    return rows.select("source_file", "seq", "date", "description", *[F.col(c).cast("double").alias(c) for c in ("debit", "credit", "balance")], "flag", "category")


@query(f"select {PLAIN} from ledger where regexp_matches(description, 'upi.*(swiggy|amazon)', 'i')")
def ledger_search(spark, sf_dir):
    return plain(L.search(ledger(spark, sf_dir), text="upi.*(swiggy|amazon)"))


@query(f"select {PLAIN} from ledger where category in ('Food & Dining', 'Tax') and flag in ('balance_mismatch') and source_file <> ''")
def ledger_filter_in(spark, sf_dir):
    return plain(L.search(ledger(spark, sf_dir), categories=["Food & Dining", "Tax"], flags=["balance_mismatch"]))


@query(f"select {PLAIN} from ledger where date >= date '1995-03-01' and date <= date '1995-03-31'")
def ledger_date_range(spark, sf_dir):
    from datetime import date

    return plain(L.search(ledger(spark, sf_dir), first=date(1995, 3, 1), last=date(1995, 3, 31)))


@query("select distinct 'category' as kind, category as value from ledger union all select distinct 'flag', flag from ledger where flag <> '' union all select distinct 'source_file', source_file from ledger")
def filter_options(spark, sf_dir):
    return L.filter_options(ledger(spark, sf_dir))


@query("select min(date) as first_date, max(date) as last_date from ledger")
def date_bounds(spark, sf_dir):
    return L.date_bounds(ledger(spark, sf_dir))


@query(""", m as (select strftime(date, '%Y-%m') as month, coalesce(sum(credit), 0)::double as credit, coalesce(sum(debit), 0)::double as debit from ledger group by 1)
select month, 'credit' as type, credit as amount from m union all select month, 'debit', debit from m""")
def month_in_out_long(spark, sf_dir):
    return A.month_in_out(ledger(spark, sf_dir))


@query(BREAKDOWN.format("debit") + " order by amount desc, category limit 8")
def topk_category(spark, sf_dir):
    return A.top_categories(ledger(spark, sf_dir), 8)


@query("""select l.source_file, l.seq, case when c.c_custkey % 5 <> 0 then concat('Bank of ', c.c_nationkey) end as bank_name, case when c.c_custkey % 5 <> 0 then lpad(c.c_custkey::varchar, 12, '0') end as account_number
 from ledger l left join customer c on l.source_file = concat('stmt_', c.c_custkey)""")
def account_broadcast(spark, sf_dir):
    known = F.col("c_custkey") % 5 != 0
    accounts = table(spark, sf_dir, "customer").select(F.concat(F.lit("stmt_"), F.col("c_custkey").cast("string")).alias("source_file"), F.when(known, F.concat(F.lit("Bank of "), F.col("c_nationkey").cast("string"))).alias("bank"), F.when(known, F.lpad(F.col("c_custkey").cast("string"), 12, "0")).alias("account_number"))
    return L.with_account(ledger(spark, sf_dir), accounts).select("source_file", "seq", "bank_name", "account_number")


def edits(rows: DataFrame) -> DataFrame:
    """Every seventh row of a file as if a user had set its category."""
    return rows.where("seq % 7 = 0").select("source_file", "seq", F.when(F.col("seq") % 14 == 0, "Rent").alias("category"), F.when(F.col("seq") % 21 == 0, "checked").alias("flag"))


@query("select source_file, seq, case when seq % 14 = 0 then 'Rent' else category end as category, case when seq % 21 = 0 then 'checked' else flag end as flag from ledger")
def edit_overlay(spark, sf_dir):
    rows = ledger(spark, sf_dir)
    return L.overlay(rows, edits(rows), ["category", "flag"]).select("source_file", "seq", "category", "flag")


@query("select source_file, seq, 'Rent' as category from ledger where seq % 14 = 0 and category <> 'Rent'")
def changed_rows(spark, sf_dir):
    rows = ledger(spark, sf_dir)
    return L.changed(rows, L.overlay(rows, edits(rows), ["category"])).select("source_file", "seq", "category")


@query("""select description, dir as direction, 'Rent' as category, 'user' as source from ledger where seq % 14 = 0 and category <> 'Rent'
 union all select description, dir, case when seq % 14 = 0 then 'Rent' else category end, 'rule' from ledger where method = 'rule'""")
def training_rows(spark, sf_dir):
    rows = ledger(spark, sf_dir)
    return L.training_rows(rows, L.overlay(rows, edits(rows), ["category"]))


@query("""select description, dir as direction, category, max_by(source_file, struct_pack(a := o_orderkey)) as source, max(o_orderkey) as ord from ledger group by 1, 2, 3""")
def dedup_keep_last(spark, sf_dir):
    from tallyspark.plans.fixtures import raw_ledger

    rows = L.classify(raw_ledger(spark, sf_dir)).select("description", S.direction(F.col("debit")).alias("direction"), "category", F.col("source_file").alias("source"), F.col("o_orderkey").alias("ord"))
    return L.keep_last(rows, "ord")


@query("select source_file, seq, case when method = 'default' then 'user' else 'rule' end as source, copy from ledger, range(1, 4) as r(copy) where copy = 1 or method = 'default'")
def user_replication(spark, sf_dir):
    rows = ledger(spark, sf_dir).select("source_file", "seq", F.when(F.col("method") == "default", "user").otherwise("rule").alias("source"))
    return L.replicate_user_rows(rows).withColumn("copy", F.col("copy").cast("long"))


@query("select source_file, seq, description, category, confidence, method from ledger")
def rule_classify(spark, sf_dir):
    return ledger(spark, sf_dir).select("source_file", "seq", "description", "category", "confidence", "method")


#: A narration for each rule, in order, with its direction; then some that no rule or only the other direction's matches,
#: and shapes that names and features are cut from.
CASES = [
    ("cr", "ACME LTD PAYROLL MAY"), ("cr", "INT PD 01-04 TO 30-06"), ("cr", "NSDL FINAL DIV 2024"), ("cr", "ORDER REFUND/889911223"), ("dr", "NWD-422010-MUMBAI"), ("cr", "BY CASH BRANCH 12"),
    ("dr", "CGST ON LOCKER"), ("dr", "ADVANCE TAX AY2425"), ("dr", "BAJAJ FINSERV 5533"), ("dr", "STAR HEALTH RENEWAL"), ("dr", "ZERODHA BROKING"), ("dr", "UPI-ZOMATO-442211-PAY"), ("dr", "DMART RETAIL 0042"),
    ("dr", "MYNTRA/ONLINE/77"), ("dr", "OLA RIDE 9988"), ("dr", "IRCTC E-TICKET"), ("dr", "BBPS/MSEB/1234567"), ("dr", "JIO PREPAID"), ("dr", "SPOTIFY INDIA"), ("dr", "APOLLO PHARMACY"), ("dr", "UDEMY COURSE"), ("dr", "NOBROKER FLAT"),
    ("dr", "PHONEPE|WALLET"), ("dr", "TO SELF SAVINGS"), ("dr", "CHQ 000123 PAID"), ("dr", "IMPS/P2A/rahul sharma/x@ybl"),
    ("dr", "ACME LTD PAYROLL MAY"), ("cr", "SPOTIFY INDIA"), ("dr", "Misc 1234"), ("cr", ""), ("dr", "  o'neil & sons-12 "), ("dr", "ab/cd/12345 XYZ/Joe's Diner 42/REF"),
]


def _cases(i: int) -> str:
    return "[" + ", ".join("'" + c[i].replace("'", "''") + "'" for c in CASES) + "]"


def narrations(spark, sf_dir):
    pick = lambda i: F.element_at(F.lit([c[i] for c in CASES]), (F.col("event_id") % len(CASES) + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", pick(0).alias("way"), pick(1).alias("description"))


@query(f"""with c as (select {_cases(0)}[k] as way, {_cases(1)}[k] as description, k - 1 as k from (select unnest(range(1, {len(CASES) + 1})) as k)),
m as (select k, way, description, coalesce({rules_sql("description", "way")}, 'Others') as category, {counterparty_sql("description")} as counterparty,
  concat(array_to_string(list_filter(string_split(regexp_replace(lower(description), '[^a-z0-9 ]', ' ', 'g'), ' '), lambda w: w <> '' and not regexp_full_match(w, '[0-9]{{4,}}')), ' '), ' __', way, '__') as features from c)
select event_id, category, counterparty, features from events join m on event_id % {len(CASES)} = k""", False)
def rule_cases(spark, sf_dir):
    """Every rule, with names and features of narrations of many shapes."""
    rows = narrations(spark, sf_dir)
    found = L.classify(rows.withColumn("debit", F.when(F.col("way") == "dr", 1.0)))
    return found.select("event_id", "category", S.counterparty(F.col("description")).alias("counterparty"), S.featurise(F.col("description"), F.col("way")).alias("features"))


@query("""select event_id, case when p >= 0.5 then event_type else 'Others' end as category, case when p >= 0.5 then p else 0 end as confidence, case when p >= 0.5 then 'ml' else 'default' end as method
 from (select event_id, event_type, (event_id % 101)::double / 100 as p from events)""", False)
def min_conf_gate(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("guess"), ((F.col("event_id") % 101).cast("double") / 100).alias("probability"))
    return L.gate(rows).select("event_id", "category", "confidence", "method")


@query("select source_file, seq, dir as direction from ledger")
def direction(spark, sf_dir):
    return ledger(spark, sf_dir).select("source_file", "seq", S.direction(F.col("debit")).alias("direction"))


@query("""select source_file, seq, concat(array_to_string(list_filter(string_split(trim(regexp_replace(lower(description), '[^a-z0-9 ]', ' ', 'g')), ' '),
 lambda w: w <> '' and not regexp_full_match(w, '[0-9]{4,}')), ' '), ' __', dir, '__') as features from ledger""")
def featurise(spark, sf_dir):
    rows = ledger(spark, sf_dir)
    return rows.select("source_file", "seq", S.featurise(F.col("description"), S.direction(F.col("debit"))).alias("features"))


@query("select source_file, seq, counterparty from ledger")
def counterparty(spark, sf_dir):
    return ledger(spark, sf_dir).select("source_file", "seq", "counterparty")


@query("select source_file, seq, ref from ledger")
def ref_backfill(spark, sf_dir):
    return ledger(spark, sf_dir).select("source_file", "seq", "ref")


@query("""select source_file, seq, case when flag <> '' then 'flag' when coalesce(debit, 0) <> 0 then 'debit' when coalesce(credit, 0) <> 0 then 'credit' when seq % 2 = 0 then 'zebra' else 'none' end as style from ledger""")
def row_style(spark, sf_dir):
    return ledger(spark, sf_dir).select("source_file", "seq", S.row_style(F.col("flag"), F.col("debit"), F.col("credit"), F.col("seq")).alias("style"))


@query("select 0 as file_idx, source_file, seq, debit::double as amount from ledger where debit is not null union all select 1, source_file, seq, null from ledger where credit is not null")
def union_files(spark, sf_dir):
    rows = ledger(spark, sf_dir)
    both = L.union_files([rows.where("debit is not null").select("source_file", "seq", F.col("debit").cast("double").alias("amount")), rows.where("credit is not null").select("source_file", "seq")])
    return both.select("file_idx", "source_file", "seq", "amount")


@query(""", c as (select *, lag(balance, 1, 100000::decimal(18,2)) over (partition by source_file order by seq) as before from ledger)
select source_file, seq, abs(before + coalesce(credit, 0) - coalesce(debit, 0) - balance) <= 0.005 as ok from c""")
def chain_check(spark, sf_dir):
    before = F.lag("balance", 1, 100000).over(Window.partitionBy("source_file").orderBy("seq"))
    return ledger(spark, sf_dir).select("source_file", "seq", S.chain_ok(before, F.col("debit"), F.col("credit"), F.col("balance")).alias("ok"))


@query("""select o_orderkey, length(a) = length(b) and len(list_filter(range(1, length(a) + 1), lambda i: substr(a, i, 1) <> substr(b, i, 1))) <= 2 as near
 from (select o_orderkey, printf('%.2f', cast(o_totalprice as decimal(18,2))) as a, printf('%.2f', cast(o_totalprice as decimal(18,2)) + o_orderkey % 1000) as b from orders)""", False)
def near_digits(spark, sf_dir):
    amount = F.col("o_totalprice").cast("decimal(18,2)")
    return table(spark, sf_dir, "orders").select("o_orderkey", S.near_digits(amount, amount + F.col("o_orderkey") % 1000).alias("near"))


@query("""select o_orderkey, try_strptime(s, ['%d/%m/%y', '%d/%m/%Y', '%d-%m-%Y', '%d.%m.%Y', '%d %b %Y', '%d-%B-%Y', '%Y-%m-%d', '%d/%b/%Y'])::date as parsed
 from (select o_orderkey, [strftime(o_orderdate, '%d/%m/%Y'), strftime(o_orderdate, '%d-%m-%Y'), strftime(o_orderdate, '%d.%m.%Y'), strftime(o_orderdate, '%d/%m/%y'), strftime(o_orderdate, '%d %b %Y'),
   strftime(o_orderdate, '%d-%B-%Y'), strftime(o_orderdate, '%Y-%m-%d'), strftime(o_orderdate, '%d/%b/%Y')][cast(o_orderkey % 8 + 1 as bigint)] as s from orders)""", False)
def parse_date(spark, sf_dir):
    forms = ["dd/MM/yyyy", "dd-MM-yyyy", "dd.MM.yyyy", "dd/MM/yy", "dd MMM yyyy", "dd-MMMM-yyyy", "yyyy-MM-dd", "dd/MMM/yyyy"]
    text = F.element_at(F.array(*[F.date_format("o_orderdate", f) for f in forms]), (F.col("o_orderkey") % 8 + 1).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", S.parse_date(F.concat(F.lit("on "), text, F.lit(" paid"))).alias("parsed"))


@query("""select o_orderkey, cast(o_totalprice as decimal(18,2))::double as value, [null, 'cr', 'dr', 'neg', 'neg'][cast(o_orderkey % 5 + 1 as bigint)] as tag from orders""", False)
def parse_amount(spark, sf_dir):
    plain_text = F.format_number(F.col("o_totalprice").cast("decimal(18,2)"), 2)
    forms = F.array(plain_text, F.concat(plain_text, F.lit("Cr")), F.concat(F.lit("12.5 "), plain_text, F.lit(" Dr.")), F.concat(F.lit("("), plain_text, F.lit(")")), F.concat(F.lit("-"), plain_text))
    parsed = S.parse_amount(F.element_at(forms, (F.col("o_orderkey") % 5 + 1).cast("int")))
    return table(spark, sf_dir, "orders").select("o_orderkey", parsed.alias("p")).select("o_orderkey", "p.value", "p.tag")


@query("""select o_orderkey, case when coalesce(d, 0) <> 0 then d when c is null and a is not null and t in ('dr', 'neg') then a end as debit,
 case when coalesce(c, 0) <> 0 then c when d is null and a is not null and t = 'cr' then a end as credit, case when d is null and c is null and t is null then a end as pending
 from (select o_orderkey, case when o_orderkey % 5 = 3 then p end as d, case when o_orderkey % 5 = 4 then p end as c, case when o_orderkey % 5 < 3 then p end as a,
   [null, 'cr', 'dr', null, null][cast(o_orderkey % 5 + 1 as bigint)] as t from (select *, cast(o_totalprice as decimal(18,2))::double as p from orders))""", False)
def amount_direction(spark, sf_dir):
    from tallyspark.operators.reconcile import amounts

    text, k = F.col("o_totalprice").cast("decimal(18,2)").cast("string"), F.col("o_orderkey") % 5
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.when(k == 3, text).alias("debit"), F.when(k == 4, text).alias("credit"), F.lit(None).cast("string").alias("balance"), F.when(k == 1, F.concat(text, F.lit(" Cr"))).when(k == 2, F.concat(text, F.lit("Dr"))).when(k == 0, text).alias("amount"), F.lit(None).cast("string").alias("type"))
    return amounts(rows).select("o_orderkey", *[F.col(c).cast("double").alias(c) for c in ("debit", "credit", "pending")])


@query(""", m as (select strftime(date, '%Y-%m') as month, category, sum(debit) as s from ledger where debit > 0 group by 1, 2)
select month, count(*) as categories, sum(s)::double as amount from m group by 1""")
def month_category_counts(spark, sf_dir):
    rows = A.dated(ledger(spark, sf_dir)).where("debit > 0")
    return rows.groupBy("month").agg(F.count_distinct("category").alias("categories"), F.sum("debit").cast("double").alias("amount"))


#: Narrations that no rule matches, with misspellings, and the category that the user gave their like.
LEARNED = [("zorp bistro", "zorp bistrro", "Meals Out"), ("blim forecourt", "blimm forcourt", "Car"), ("quandle outfitter", "quandl outfiter", "Clothes")]


@query(f"""select event_id, case when event_id % 4 = 3 then 'Cash Withdrawal (ATM)' else [{", ".join(repr(c) for *_, c in LEARNED)}][cast(event_id % 4 + 1 as bigint)] end as category,
 case when event_id % 4 = 3 then 'rule' else 'ml' end as method from events""", False)
def ml_classify(spark, sf_dir):
    """A model of the user's labels tells misspelt narrations apart; what a rule matches stays the rule's."""
    from tallyspark.operators import learning

    labels = spark.createDataFrame([(f"{text} {w}", "dr", category, "user") for text, _, category in LEARNED for w in "north south east west hill lake park dale ford".split()], "description string, direction string, category string, source string")
    text = F.element_at(F.lit([odd for _, odd, _ in LEARNED] + ["ATM CASH"]), (F.col("event_id") % 4 + 1).cast("int"))
    rows = table(spark, sf_dir, "events").select("event_id", F.concat(text, F.lit(" "), F.col("event_id").cast("string")).alias("description"), F.lit(5.0).alias("debit"))
    return learning.classify(rows, learning.train(labels)).select("event_id", "category", "method")


@query("""select concat('shop ', k) as description, case when k % 2 = 0 then 'dr' else 'cr' end as direction, concat('c', k % 3) as category,
 case when k % 5 = 0 then 'user' else 'seed' end as source from (select distinct event_id % 60 as k from events)""", False)
def feedback_merge(spark, sf_dir):
    """New label rows replace old ones of equal description, direction and category."""
    from tallyspark.operators import learning

    k = F.col("event_id") % 60
    rows = table(spark, sf_dir, "events").select(k.alias("k"), F.concat(F.lit("shop "), k.cast("string")).alias("description"), F.when(k % 2 == 0, "dr").otherwise("cr").alias("direction"), F.concat(F.lit("c"), (k % 3).cast("string")).alias("category"))
    merged = learning.merge_feedback(rows.withColumn("source", F.lit("seed")).drop("k"), rows.where("k % 5 = 0").withColumn("source", F.lit("user")).drop("k"))
    return merged.select("description", "direction", "category", "source")


@query(""", w as (select source_file, seq, debit::double * case when o_orderkey % 211 = 0 then 9 else 1 end as x from ledger where debit > 0),
s as (select avg(x) as mu, stddev_samp(x) as sigma from w)
select source_file, seq, 'High Debit (>3.0σ)' as anomaly from w, s where abs(x - mu) / sigma >= 3""")
def ledger_anomalies(spark, sf_dir):
    from tallyspark.plans.fixtures import raw_ledger

    wild = raw_ledger(spark, sf_dir).withColumn("debit", F.col("debit").cast("double") * F.when(F.col("o_orderkey") % 211 == 0, 9).otherwise(1))
    return A.anomalies(wild, ("debit",)).select("source_file", "seq", "anomaly")


@query("""select strftime(date, '%Y-%m-%d %H:%M:%S') as "Date", description as "Description", ref as "Ref", debit::double as "Debit", credit::double as "Credit", balance::double as "Balance", flag as "Flag", page as "Page",
 counterparty as "Counterparty", 'Bank ' || o_custkey % 3 as "Bank Name", case when o_custkey % 2 = 0 then lpad(o_custkey::varchar, 8, '0') end as "Account Number", source_file as "Source File", category as "Category", confidence as "Confidence", method as "Method" from ledger""")
def export_rows(spark, sf_dir):
    """What an export has: all columns with their headers, bank and account joined by file."""
    from tallyspark.sources import export

    rows = ledger(spark, sf_dir)
    number = F.regexp_extract("source_file", r"(\d+)$", 1)
    accounts = rows.select("source_file").distinct().select("source_file", F.concat(F.lit("Bank "), (number.cast("long") % 3).cast("string")).alias("bank"), F.when(number.cast("long") % 2 == 0, F.lpad(number, 8, "0")).alias("account_number"))
    return export.for_export(L.with_account(rows, accounts)).withColumns({c: F.col(c).cast("double") for c in ("Debit", "Credit", "Balance")})
