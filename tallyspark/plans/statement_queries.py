"""Queries over statements printed from the ledger fixture, and over synthetic headers, tokens and lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.functions import constants as K
from tallyspark.functions import scalars as S
from tallyspark.operators import account, assembly, layout, payees
from tallyspark.operators.reconcile import reconcile
from tallyspark.plans.fixtures import LEDGER, ledger, raw_ledger, table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


ROWS_A_PAGE = 40
HEADER = [("Date", 40.0), ("Narration", 110.0), ("Withdrawal", 330.0), ("Deposit", 420.0), ("Balance", 510.0)]


def statement_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger printed as words: 40 rows a page below a header, columns at fixed places, 6 units a character."""
    rows = raw_ledger(spark, sf_dir).withColumns({"page": (F.floor((F.col("seq") - 1) / ROWS_A_PAGE) + 1).cast("int"), "row": ((F.col("seq") - 1) % ROWS_A_PAGE + 1).cast("int")})
    word = lambda text, x: F.struct(text.alias("text"), x.cast("double").alias("x0"))
    narration = S.let(F.split("description", " "), lambda tokens: F.transform(tokens, lambda t, i: word(t, F.lit(110) + 6 * F.aggregate(F.slice(tokens, 1, i), F.lit(0), lambda n, p: n + F.length(p) + 1))))
    fixed = F.array(word(F.date_format("date", "dd/MM/yyyy"), F.lit(40)), word(F.col("debit").cast("string"), F.lit(330)), word(F.col("credit").cast("string"), F.lit(420)), word(F.col("balance").cast("string"), F.lit(510)))
    placed = lambda row, ws: F.transform(ws, lambda w, n: F.struct(row.alias("row"), n.alias("n"), w.alias("w")))
    body = placed(F.col("row"), F.filter(F.concat(fixed, narration), lambda w: w["text"].isNotNull()))
    head = placed(F.lit(0), F.array(*[word(F.lit(t), F.lit(x)) for t, x in HEADER]))
    # a page's first row brings the header, so that the ledger is made once
    words = rows.select("source_file", "page", F.inline(F.when(F.col("row") == 1, F.concat(head, body)).otherwise(body)))
    return words.select("source_file", "page", F.lit("text").alias("kind"), (F.col("row") * 100 + F.col("n")).alias("word_no"), F.col("w.text").alias("text"), F.col("w.x0").alias("x0"), (F.col("w.x0") + 6 * F.length("w.text")).cast("double").alias("x1"), (F.col("row") * 12.0).cast("double").alias("top"), (F.col("row") * 12.0 + 10).cast("double").alias("bottom"))


@query(LEDGER + """select source_file, seq, date, description, ref, debit::double as debit, credit::double as credit, balance::double as balance,
 case when seq = 1 then 'first_row_unverified' else '' end as flag, page from ledger""")
def statement_round_trip(spark, sf_dir):
    found = assembly.ledger_of(assembly.statement_lines(statement_words(spark, sf_dir)))
    return found.select("source_file", "seq", "date", "description", "ref", *[F.col(c).cast("double").alias(c) for c in ("debit", "credit", "balance")], "flag", "page")


@query(LEDGER + """select distinct source_file, page, 0 as line_no, 'Date Narration Withdrawal Deposit Balance' as text from ledger
 union all select source_file, page, cast((seq - 1) % 40 + 1 as integer), concat_ws(' ', strftime(date, '%d/%m/%Y'), description, debit::varchar, credit::varchar, balance::varchar) from ledger""")
def line_grouping(spark, sf_dir):
    lines = layout.page_lines(statement_words(spark, sf_dir))
    return lines.select("source_file", "page", "line_no", layout.line_text(F.col("words")).alias("text"))


@query(LEDGER + "select distinct source_file, page, 0 as header_line, 'date,desc,debit,credit,balance' as keys from ledger")
def header_detect(spark, sf_dir):
    found = layout.page_layout(statement_words(spark, sf_dir)).where("header is not null")
    return found.select("source_file", "page", "header_line", F.array_join(F.transform("header", lambda a: a["key"]), ",").alias("keys"))


#: Columns at their print positions: of the numeric ones those with amounts in enough rows, and where texts begin.
INFERRED = LEDGER + """, t as (select source_file, page, count(*) as n, count(debit) as d, count(credit) as c, count(balance) as b,
  330 + 6 * max(length(debit::varchar)) as d1, 420 + 6 * max(length(credit::varchar)) as c1, 510 + 6 * max(length(balance::varchar)) as b1 from ledger group by 1, 2),
w as (select source_file, page, string_split(description, ' ') as ws from ledger),
x as (select source_file, page, list_sort(list(110 + 6 * i + 6 * coalesce(list_sum(list_transform(ws[1:i], lambda p: length(p))), 0))) as xs
      from (select source_file, page, ws, unnest(range(len(ws))) as i from w) where regexp_matches(ws[i + 1], '[A-Za-z]') group by 1, 2),
k as (select source_file, page, n, list_filter([case when d >= greatest(2, 0.2 * n) then [330, d1] end, case when c >= greatest(2, 0.2 * n) then [420, c1] end, case when b >= greatest(2, 0.2 * n) then [510, b1] end], lambda z: z is not null) as found from t)
select k.source_file, k.page, array_to_string(list_transform(range(1, len(found) + 1), lambda i: concat([['balance'], ['amount', 'balance'], ['debit', 'credit', 'balance']][len(found)][i], ':', found[i][1]::double, ':', found[i][2]::double)), ',')
  || ',date:40.0:80.0' || coalesce(',desc:' || (xs[len(xs) // 2 + 1])::double || ':' || (xs[len(xs) // 2 + 1] + 40)::double, '') as anchors
from k left join x on k.source_file = x.source_file and k.page = x.page where n >= 3 and len(found) > 0"""


@query(INFERRED)
def infer_anchors(spark, sf_dir):
    body = statement_words(spark, sf_dir).where("top > 0")
    found = layout.page_layout(body).where("inferred is not null")
    return found.select("source_file", "page", F.array_join(F.transform("inferred", lambda a: F.concat_ws(":", a["key"], a["x0"].cast("string"), a["x1"].cast("string"))), ",").alias("anchors"))


@query(LEDGER + ", p as (select distinct source_file, page from ledger) select source_file, page, case when page > 1 and page % 2 = 0 then 'a' || (page - 1)::varchar else 'a' || page::varchar end as anchor, false as inferred from p")
def anchor_carry(spark, sf_dir):
    pages = ledger(spark, sf_dir).select("source_file", "page").distinct()
    anchor = F.array(F.struct(F.concat(F.lit("a"), F.col("page").cast("string")).alias("key"), F.lit(0.0).alias("x0"), F.lit(1.0).alias("x1")))
    found = layout.carry_anchors(pages.withColumns({"header": F.when(F.col("page") % 2 == 1, anchor), "inferred": F.when(F.col("page") > 9, anchor)}))
    return found.select("source_file", "page", F.col("anchors")[0]["key"].alias("anchor"), F.col("was_inferred").alias("inferred"))


@query("select doc_id, n, case when n >= 20 then 'text' when doc_id % 3 > 0 then 'ocr' else 'blank' end as kind from (select doc_id, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+'), lambda t: t <> '')) as n from documents)")
def page_kind(spark, sf_dir):
    n = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda t: t != "")).cast("long")
    return table(spark, sf_dir, "documents").select("doc_id", n.alias("n")).select("doc_id", "n", layout.page_kind(F.col("n"), F.col("doc_id") % 3).alias("kind"))


@query("""with t as (select doc_id, n_chars, list_filter(regexp_split_to_array(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda t: t <> '') as tokens from documents where (doc_id % 100) / 100.0 >= 0.6)
select doc_id, i - 1 as word_no, tokens[i] as text, round((10 + (i - 1) * (n_chars / len(tokens))) / 2, 4) as x0, round((10 + (i - 1) * (n_chars / len(tokens)) + n_chars / len(tokens)) / 2, 4) as x1 from t, lateral (select unnest(range(1, len(tokens) + 1)) as i)""")
def ocr_token_split(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select("doc_id", "text", ((F.col("doc_id") % 100) / 100.0).alias("score"), F.lit(10.0).alias("x0"), (F.col("n_chars") + 10.0).alias("x1"), F.lit(0.0).alias("top"), F.lit(10.0).alias("bottom"), F.lit(2.0).alias("scale"))
    return layout.split_line_boxes(lines).select("doc_id", F.col("word_no").cast("long").alias("word_no"), "text", F.round("x0", 4).alias("x0"), F.round("x1", 4).alias("x1"))


@query("select event_id, event_type as text, (event_id % 500) / 2.0 as x0, (event_id % 500 + 30) / 2.0 as x1 from events where event_id % 100 > 25")
def ocr_conf_filter(spark, sf_dir):
    tokens = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("text"), (F.col("event_id") % 500).alias("left"), F.lit(5).alias("top"), F.lit(30).alias("width"), F.lit(10).alias("height"), (F.col("event_id") % 100).alias("conf"), F.lit(2.0).alias("scale"))
    return layout.ocr_words(tokens).select("event_id", "text", "x0", "x1")


HEADINGS = ["Date", "NARRATION", "Chq/Ref", "Withdrawal Amt.", "Debit/", "Dr/Cr", "Closing Balance", "Value", "Deposits", "Txn/Date", "S.No", "Remarks:"]
HEADING_KEYS = ["date", "desc", "ref", "debit", "debit", "type", "balance", None, "credit", None, "serial", "desc"]


def _strings(values) -> str:
    return "[" + ", ".join("null" if v is None else f"'{v}'" for v in values) + "]"


@query(f"select event_id, {_strings(HEADINGS)}[cast(event_id % {len(HEADINGS)} + 1 as bigint)] as heading, {_strings(HEADING_KEYS)}[cast(event_id % {len(HEADINGS)} + 1 as bigint)] as key from events")
def header_key_lookup(spark, sf_dir):
    heading = F.element_at(F.lit(HEADINGS), (F.col("event_id") % len(HEADINGS) + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", heading.alias("heading"), S.header_key(heading).alias("key"))


COLUMNS = [("date", 40.0, 80.0), ("desc", 110.0, 180.0), ("debit", 330.0, 380.0), ("credit", 420.0, 470.0), ("balance", 510.0, 560.0)]


@query("""with w as (select l_orderkey, l_linenumber, (l_orderkey * 7 + l_linenumber * 31) % 600 as x0, (l_orderkey * 7 + l_linenumber * 31) % 600 + 30 as x1, l_orderkey % 2 = 0 as num from lineitem),
g as (select *, greatest(330 - x1, x0 - 380, 0) as d, greatest(420 - x1, x0 - 470, 0) as c, greatest(510 - x1, x0 - 560, 0) as b from w)
select l_orderkey, l_linenumber, case when num and least(d, c, b) <= 30 then case least(d, c, b) when d then 'debit' when c then 'credit' else 'balance' end when x0 >= 104 then 'desc' else 'date' end as key from g""")
def nearest_column(spark, sf_dir):
    x = ((F.col("l_orderkey") * 7 + F.col("l_linenumber") * 31) % 600).cast("double")
    word = F.struct(F.when(F.col("l_orderkey") % 2 == 0, "12.50").otherwise("88374").alias("text"), x.alias("x0"), (x + 30).alias("x1"))
    anchors = F.array(*[F.struct(F.lit(k).alias("key"), F.lit(a).alias("x0"), F.lit(b).alias("x1")) for k, a, b in COLUMNS])
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", word.alias("w"), anchors.alias("anchors"))
    return rows.select("l_orderkey", "l_linenumber", layout.cell_key(F.col("w"), F.col("anchors")).alias("key"))


@query("select l_orderkey, list_sort(list(l_quantity))[count(*) // 2 + 1] as middle from lineitem group by 1")
def upper_median(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(layout.upper_median(F.collect_list("l_quantity")).alias("middle"))


@query("""with c as (select l_suppkey, l_extendedprice as x, l_extendedprice - lag(l_extendedprice) over (partition by l_suppkey order by l_extendedprice) > 25 as far from lineitem),
n as (select l_suppkey, x, sum(case when far then 1 else 0 end) over (partition by l_suppkey order by x rows unbounded preceding) as k from c)
select l_suppkey, k::bigint as cluster, count(*) as numbers, min(x) as x0, max(x) as x1 from n group by 1, 2""")
def amount_clusters(spark, sf_dir):
    spans = F.collect_list(F.struct(F.col("l_extendedprice").alias("x0"), F.col("l_extendedprice").alias("x1")))
    found = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(layout.clusters(spans).alias("c"))
    rows = found.select("l_suppkey", F.posexplode("c").alias("cluster", "c"))
    return rows.select("l_suppkey", F.col("cluster").cast("long").alias("cluster"), F.size("c").cast("long").alias("numbers"), F.array_min("c.x0").alias("x0"), F.array_max("c.x1").alias("x1"))


LINE_TEXTS = ["01/02/2024 SHOP 10.00 90.00", "Page 2 of 3", "Opening Balance 1,000.00", "TOTAL 55.00", "see total below", "B/F 12.50 Cr", "Closing  Balance : 5.00", "wrapped narration"]


@query(f"""with t as (select event_id, {_strings(LINE_TEXTS)}[cast(event_id % {len(LINE_TEXTS)} + 1 as bigint)] as text from events)
select event_id, text, event_id % 8 in (2, 5) as opening, event_id % 8 in (1, 3, 6) as footer from t""")
def footer_filter(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.element_at(F.lit(LINE_TEXTS), (F.col("event_id") % len(LINE_TEXTS) + 1).cast("int")).alias("text"))
    return rows.select("event_id", "text", S.is_opening(F.col("text")).alias("opening"), S.is_footer(F.col("text")).alias("footer"))


@query("select concat('u', user_id) as source_file, min_by(500 + event_id % 1000 + 0.25, struct_pack(a := event_id))::double as opening from events where event_id % 4 <> 0 group by 1")
def opening_balance(spark, sf_dir):
    amount = F.format_number((500 + F.col("event_id") % 1000 + 0.25).cast("decimal(18,2)"), 2)
    rows = table(spark, sf_dir, "events").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("source_file"), F.lit(1).alias("page"), F.col("event_id").alias("line_no"), F.lit("opening").alias("kind_of"), F.when(F.col("event_id") % 4 == 0, "Opening balance").otherwise(F.concat(F.lit("Opening balance 7 "), amount)).alias("text"))
    return assembly.opening_balances(rows)


def synthetic_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marked lines of orders: each third begins a row, each eleventh is a footer, each seventh stands far below."""
    k = F.col("seq")
    rows = raw_ledger(spark, sf_dir)
    amount = F.col("o_orderkey").cast("string")
    return rows.select("source_file", F.lit(1).alias("page"), k.alias("line_no"), F.when(k % 11 == 0, "footer").when(k % 3 == 1, "start").otherwise("more").alias("kind_of"), (k * 12.0 + F.floor(k / 7) * 30.0).alias("cy"), F.lit(10.0).alias("line_h"), F.when((k % 3 == 1) & (k % 11 != 0), F.col("date")).alias("day"), F.col("description").alias("desc"), F.when(k % 2 == 0, F.concat(F.lit("R"), amount)).alias("ref"), F.when(k % 3 == 2, amount).alias("debit"), F.lit(None).cast("string").alias("credit"), F.when(k % 4 == 0, amount).alias("balance"), F.lit(None).cast("string").alias("amount"), F.lit(None).cast("string").alias("type"), F.lit(None).cast("string").alias("date"))


ISLANDS = LEDGER + """, m as (select source_file, seq as line_no, description as d, o_orderkey as k, date, case when seq % 11 = 0 then 'footer' when seq % 3 = 1 then 'start' else 'more' end as kind, seq * 12.0 + floor(seq / 7) * 30.0 as cy from ledger),
i as (select *, sum(case when kind <> 'more' or cy - lag(cy, 1, 0) over (partition by source_file order by line_no) > 28 then 1 else 0 end) over (partition by source_file order by line_no) as island
      from (select *, lag(cy, 1, 0) over (partition by source_file order by line_no) as before from m)),
g as (select source_file, min(line_no) as line_no, min_by(kind, line_no) as kind, min_by(date, line_no) as day, string_agg(d, ' ' order by line_no) as descr,
      coalesce(string_agg(case when line_no % 2 = 0 then 'R' || k end, ' ' order by line_no), '') as ref,
      min_by(k::varchar, line_no) filter (where line_no % 3 = 2) as debit, min_by(k::varchar, line_no) filter (where line_no % 4 = 0) as balance, count(*) as n from i group by source_file, island)
"""
ISLANDS = ISLANDS.replace("cy - lag(cy, 1, 0) over (partition by source_file order by line_no) > 28 then", "cy - before > 28 then")


@query(ISLANDS + "select source_file, line_no, day, descr as description from g where kind = 'start'")
def row_assembly(spark, sf_dir):
    return assembly.assemble(synthetic_lines(spark, sf_dir)).select("source_file", "line_no", "day", F.col("desc").alias("description"))


@query(ISLANDS + "select source_file, line_no, ref, debit, balance from g where kind = 'start'")
def row_merge(spark, sf_dir):
    return assembly.assemble(synthetic_lines(spark, sf_dir)).select("source_file", "line_no", "ref", "debit", "balance")


@query(LEDGER + """, m as (select source_file, seq, date, seq % 5 = 1 as known from ledger),
b as (select *, sum(case when known then 1 else 0 end) over (partition by source_file order by seq) as grp, case when not known and month(date) < lag(month(date)) over (partition by source_file order by seq) then 1 else 0 end as back from m)
select source_file, seq, cast(first_value(year(date)) over (partition by source_file, grp order by seq) + sum(back) over (partition by source_file, grp order by seq rows unbounded preceding) as bigint) as year, cast(month(date) as integer) as month from b""")
def year_rollover(spark, sf_dir):
    yearless = F.try_to_date(F.concat(F.lit("1900"), F.date_format("date", "-MM-"), F.lpad(F.least(F.dayofmonth("date"), F.lit(28)).cast("string"), 2, "0")), "yyyy-MM-dd")
    rows = raw_ledger(spark, sf_dir).select("source_file", "seq", F.lit(1).alias("page"), F.col("seq").alias("line_no"), F.when(F.col("seq") % 5 == 1, F.col("date")).otherwise(yearless).alias("day"), F.lit(None).cast("int").alias("wrapped_year"))
    found = assembly.infer_years(rows)
    return found.select("source_file", "seq", F.year("day").cast("long").alias("year"), F.month("day").alias("month"))


PREFIXES = list(K.BANKS)


def headers_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A synthetic account header for each customer; every fifth IFSC code has the letter O for its zero, and every seventh
    customer has the bank's name instead of a code."""
    k = F.col("c_custkey")
    prefix = F.element_at(F.lit(PREFIXES), (k % len(PREFIXES) + 1).cast("int"))
    digits = F.lpad(k.cast("string"), 6, "0")
    lines = [
        F.lit("Account Holder Name: Asha Rao Account No: XX"), digits, F.lit("99\n"), F.when(k % 7 == 3, F.concat(F.lit("Welcome to "), F.element_at(F.lit(list(K.BANKS.values())), (k % len(PREFIXES) + 1).cast("int")))).otherwise(F.concat(F.lit("IFSC "), prefix, F.when(k % 5 == 0, "O").otherwise("0"), digits)),
        F.lit(" MICR Code: 400"), digits, F.lit("\nCustomer ID: C"), digits, F.lit(" PAN ABCDE"), F.substring(digits, 3, 4), F.lit("F\nMobile: 98765"), F.substring(digits, 2, 5), F.lit(" Email: user"), digits,
        F.lit("@mail.example.com\nBranch: Main_Street Address 5\nPeriod from 01-Apr-2024 to 30-Jun-2024\n"), F.element_at(F.lit(["Currency USD", "Paid in €", "£ account", "no sign"]), (k % 4 + 1).cast("int")), F.lit("\nOpening Balance: 1,"), F.substring(digits, 4, 3), F.lit(".50\n"),
    ]
    return table(spark, sf_dir, "customer").select(k.alias("custkey"), F.concat(F.lit("c"), k.cast("string")).alias("source_file"), F.concat(*lines).alias("text"))


HEADS = f"""with d as (select c_custkey as custkey, lpad(c_custkey::varchar, 6, '0') as digits, {_strings(PREFIXES)}[cast(c_custkey % {len(PREFIXES)} + 1 as bigint)] as prefix from customer),
h as (select custkey, concat('c', custkey) as source_file, digits, prefix, concat('Account Holder Name: Asha Rao Account No: XX', digits, '99', chr(10), case when custkey % 7 = 3 then 'Welcome to ' || {_strings(K.BANKS.values())}[cast(custkey % {len(PREFIXES)} + 1 as bigint)] else concat('IFSC ', prefix, case when custkey % 5 = 0 then 'O' else '0' end, digits) end,
 ' MICR Code: 400', digits, chr(10), 'Customer ID: C', digits, ' PAN ABCDE', substr(digits, 3, 4), 'F', chr(10), 'Mobile: 98765', substr(digits, 2, 5), ' Email: user', digits, '@mail.example.com', chr(10),
 'Branch: Main_Street Address 5', chr(10), 'Period from 01-Apr-2024 to 30-Jun-2024', chr(10), ['Currency USD', 'Paid in €', '£ account', 'no sign'][cast(custkey % 4 + 1 as bigint)], chr(10), 'Opening Balance: 1,', substr(digits, 4, 3), '.50', chr(10)) as text from d)
"""


@query(HEADS + r"select source_file, nullif(regexp_extract(regexp_replace(text, '\b([A-Z]{4})O([A-Z0-9]{6})\b', '\10\2', 'g'), '\b([A-Z]{4}0[A-Z0-9]{6})\b', 1), '') as ifsc from h")
def ifsc_fix(spark, sf_dir):
    return headers_text(spark, sf_dir).select("source_file", S.ifsc(S.fix_ifsc(F.col("text"))).alias("ifsc"))


@query(HEADS + f"select source_file, {_strings(K.BANKS.values())}[cast(custkey % {len(PREFIXES)} + 1 as bigint)] as bank from h")
def bank_lookup(spark, sf_dir):
    return account.account_info(headers_text(spark, sf_dir)).select("source_file", "bank")


@query(HEADS + "select source_file, ['USD', 'EUR', 'GBP', 'INR'][cast(custkey % 4 + 1 as bigint)] as currency from h")
def currency_detect(spark, sf_dir):
    return account.account_info(headers_text(spark, sf_dir)).select("source_file", "currency")


@query(HEADS + r"""select source_file, regexp_extract(text, '(?i)(?:a/?c|account)\s*(?:no|number|num|#)?\.?\s*[:\-]?\s*([Xx*\d]{6,20})', 1) as account_number,
 regexp_extract(text, '(?i)micr\s*(?:code|no)?\s*[:\-]?\s*(\d{9})', 1) as micr, regexp_extract(text, '(?i)(?:cust(?:omer)?|cif)\s*(?:id|no)\.?\s*[:\-]?\s*(\w{5,})', 1) as customer_id,
 regexp_extract(text, '\b([A-Z]{5}[0-9]{4}[A-Z])\b', 1) as pan, trim(regexp_extract(text, '(?i)(?:mobile|mob|phone|ph\.?)\s*[:\-]?\s*(\+?[0-9 \-]{10,14})', 1)) as mobile,
 regexp_extract(text, '([a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,})', 1) as email from h""")
def contact_extract(spark, sf_dir):
    return account.account_info(headers_text(spark, sf_dir)).select("source_file", "account_number", "micr", "customer_id", "pan", "mobile", "email")


@query(HEADS + "select source_file, 'Asha Rao' as account_holder, 'Main Street' as branch, '2024-04-01' as period_from, '2024-06-30' as period_to, (1000 + substr(digits, 4, 3)::integer + 0.5)::double as opening_balance, null::double as closing_balance from h")
def account_header(spark, sf_dir):
    return account.account_info(headers_text(spark, sf_dir)).select("source_file", "account_holder", "branch", "period_from", "period_to", "opening_balance", "closing_balance")


#: What is wrong with a row, by its order key modulo FAULTS.
FAULTS = 41


def dirty_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger with a fault in some rows: swapped columns (0), a wrong digit of the balance (1) or the amount (2), no
    balance (3), no amount (4), no direction (5), neither direction nor balance (6), wrong amount and balance (7), another balance (8)."""
    k = F.col("o_orderkey") % FAULTS
    amount = F.coalesce("debit", "credit")
    rows = raw_ledger(spark, sf_dir)
    wrong = lambda c: F.when(F.col(c).isNotNull(), (F.col(c) + F.when(k == 2, 10).when(k == 7, 7777777).otherwise(0)).cast("decimal(18,2)"))
    gone = k.isin(4, 5, 6)
    balance = F.when(~k.isin(3, 6), (F.col("balance") + F.when(k == 1, 100).when(k == 7, 123456789).when(k == 8, 9876543).otherwise(0)).cast("decimal(18,2)"))
    opening = F.when(F.col("o_custkey") % 5 > 0, F.lit(100000).cast("decimal(18,2)"))
    return rows.select("source_file", "seq", F.when(gone, None).when(k == 0, F.col("credit")).otherwise(wrong("debit")).alias("debit"), F.when(gone, None).when(k == 0, F.col("debit")).otherwise(wrong("credit")).alias("credit"), balance.alias("balance"), F.when(k.isin(5, 6), amount).alias("pending"), opening.alias("opening"), k.cast("int").alias("fault"))


def _near(a: str, b: str) -> str:
    """Near digits in SQL, of amounts written with two decimals."""
    x, y = (f"cast(cast(abs({v}) as decimal(18,2)) as varchar)" for v in (a, b))
    return f"(length({x}) = length({y}) and len(list_filter(range(1, length({x}) + 1), lambda i: {x}[i] <> {y}[i])) <= 2)"


#: One step of the recursion is one row of each file: what direction, what chain, what evidence, what is repaired.
DIRTY = f"""with recursive {LEDGER.strip().removeprefix("with ")},
f as (select source_file, seq, o_orderkey % {FAULTS} as fault, debit, credit, balance, o_custkey % 5 > 0 as opened from ledger),
g as (select source_file, seq, fault, opened,
  cast(case when fault in (4, 5, 6) then null when fault = 0 then credit else debit + case fault when 2 then 10 when 7 then 7777777 else 0 end end as decimal(18,2)) as dr,
  cast(case when fault in (4, 5, 6) then null when fault = 0 then debit else credit + case fault when 2 then 10 when 7 then 7777777 else 0 end end as decimal(18,2)) as cr,
  cast(case when fault not in (3, 6) then balance + case fault when 1 then 100 when 7 then 123456789 when 8 then 9876543 else 0 end end as decimal(18,2)) as bal,
  case when fault in (5, 6) then coalesce(debit, credit) end as pend from f),
d as (select *, lead(seq) over w is not null as more, lead(coalesce(cr, 0) - coalesce(dr, 0)) over w as next_move, lead(bal) over w as next_bal from g window w as (partition by source_file order by seq)),
r(source_file, seq, debit, credit, balance, flag, fault, start) as (
  select distinct source_file, 0::bigint, null::decimal(18,2), null::decimal(18,2), null::decimal(18,2), '', 0::bigint, case when opened then 100000::decimal(18,2) end from d
  union all
  select source_file, seq,
    case when flag = 'column_swap_fixed' then cr when flag in ('amount_corrected', 'amount_from_balance') then case when step > 0 then null else -step end else dr end,
    case when flag = 'column_swap_fixed' then dr when flag in ('amount_corrected', 'amount_from_balance') then case when step > 0 then step end else cr end,
    case when bal is null or flag = 'balance_corrected' then comp else bal end, flag, fault,
    case when bal is null then coalesce(comp, before) when flag = 'balance_corrected' then comp else bal end
  from (
    select *, case
      when bal is null then coalesce(nullif(f1, ''), 'balance_missing')
      when before is null or comp = bal then f1
      when known and step = -move then 'column_swap_fixed'
      when known and not goes_on and {_near("comp", "bal")} then 'balance_corrected'
      when known and not comp_goes_on and {_near("step", "coalesce(dr, cr)")} then 'amount_corrected'
      when known and comp_goes_on and not goes_on then 'balance_corrected'
      when step <> 0 and (goes_on or (not known and not more)) then 'amount_from_balance'
      else coalesce(nullif(f1, ''), 'balance_mismatch') end as flag
    from (
      select *, cast(before + move as decimal(18,2)) as comp, cast(bal - before as decimal(18,2)) as step,
        coalesce(more and bal + next_move = next_bal, false) as goes_on, coalesce(more and before + move + next_move = next_bal, false) as comp_goes_on
      from (
        select * replace (coalesce(start, case when known and bal is not null then bal - move end) as before),
          case when start is null and known and bal is not null then coalesce(nullif(f0, ''), 'first_row_unverified') else f0 end as f1
        from (
          select *, coalesce(cr, 0) - coalesce(dr, 0) as move, dr is not null or cr is not null as known, start as before
          from (
            select d.source_file, d.seq, d.fault, d.bal, d.more, d.next_move, d.next_bal, r.start,
              case when pend is null then dr when coalesce(r.start + pend = bal, false) then null else pend end as dr,
              case when pend is null then cr when coalesce(r.start + pend = bal, false) then pend end as cr,
              case when pend is null or coalesce(r.start + pend = bal, false) or coalesce(r.start - pend = bal, false) then '' else 'direction_guessed' end as f0
            from r join d on d.source_file = r.source_file and d.seq = r.seq + 1))))))
select source_file, seq, debit::double as debit, credit::double as credit, balance::double as balance, flag, fault::integer as fault from r where seq > 0"""


@query(DIRTY)
def reconcile_dirty(spark, sf_dir):
    found = reconcile(dirty_ledger(spark, sf_dir))
    return found.select("source_file", "seq", *[F.col(c).cast("double").alias(c) for c in ("debit", "credit", "balance")], "flag", "fault")


@query(LEDGER + "select source_file, seq, debit::double as debit, credit::double as credit, balance::double as balance, case when seq = 1 then 'first_row_unverified' else '' end as flag from ledger")
def reconcile_clean(spark, sf_dir):
    rows = raw_ledger(spark, sf_dir).select("source_file", "seq", "debit", "credit", "balance", F.lit(None).cast("decimal(18,2)").alias("pending"))
    return reconcile(rows).select("source_file", "seq", *[F.col(c).cast("double").alias(c) for c in ("debit", "credit", "balance")], "flag")


@query(LEDGER + """, o2 as (select source_file, seq, counterparty as name, case when seq % 3 = 0 then counterparty || ' In' else counterparty end as own from ledger),
c as (select source_file, name, own, count(*) as n, min(seq) as first from o2 group by 1, 2, 3),
lead as (select source_file, name, min_by(own, struct_pack(a := -n, b := first)) as counterparty from c group by 1, 2)
select o2.source_file, seq, lead.counterparty from o2 join lead on o2.source_file = lead.source_file and o2.name = lead.name""")
def consolidate_payees(spark, sf_dir):
    """Each third name is printed with another word; no other two names of the fixture are similar."""
    rows = ledger(spark, sf_dir)
    odd = F.when(F.col("seq") % 3 == 0, F.concat("counterparty", F.lit(" In"))).otherwise(F.col("counterparty"))
    return payees.consolidate(rows.withColumn("counterparty", odd)).select("source_file", "seq", "counterparty")


@query(LEDGER + """, t as (select distinct source_file, page, 0 as k, 'Date Narration Withdrawal Deposit Balance' as line from ledger
 union all select source_file, page, seq, concat_ws(' ', strftime(date, '%d/%m/%Y'), description, debit::varchar, credit::varchar, balance::varchar) from ledger)
select source_file, string_agg(line, chr(10) order by page, k) as text from t where page <= 3 group by 1""")
def first_pages_text(spark, sf_dir):
    return layout.page_text(layout.page_lines(statement_words(spark, sf_dir)), 3)


@query(HEADS + "select source_file, 'Asha Rao' as account_holder, ['USD', 'EUR', 'GBP', 'INR'][cast(custkey % 4 + 1 as bigint)] as currency, 3::bigint as pages, 1::bigint as ocr_pages from h")
def account_profile(spark, sf_dir):
    from tallyspark.operators.ledger import drop_empty_columns

    info = account.account_info(headers_text(spark, sf_dir)).select("source_file", "account_holder", "currency", "closing_balance")
    pages = info.select("source_file", F.explode(F.array(F.lit("text"), F.lit("ocr"), F.lit("blank"))).alias("kind"))
    return drop_empty_columns(account.with_pages(info, pages))


WARNED = LEDGER + """, n as (select source_file, o_custkey % 5 as k, count(*) filter (where page = 1) as rows from ledger group by 1, 2)
select source_file, case k when 0 then 1 when 1 then 1000 end as page,
  case k when 0 then 'column header unreadable, columns inferred from number positions' when 1 then 'blank or unreadable page, skipped' else 'no transaction table detected' end as message
from n where (k = 0 and rows >= 3) or k in (1, 2)"""


def faulty_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Printed statements by number: without header (0), with a blank page more (1), without dates (2), as they are (3, 4)."""
    words, k = statement_words(spark, sf_dir), F.regexp_extract("source_file", r"(\d+)$", 1).cast("long") % 5
    gone = ((k == 0) & (F.col("top") == 0)) | ((k == 2) & (F.col("top") > 0) & (F.col("x0") == 40))
    page = words.where((k == 1) & (F.col("page") == 1) & (F.col("word_no") == 0)).withColumns({"page": F.lit(1000), "kind": F.lit("blank"), "text": F.lit("")})
    return words.where(~gone).unionByName(page)


@query(WARNED)
def statement_warnings(spark, sf_dir):
    return assembly.warnings(faulty_statements(spark, sf_dir))


@query(LEDGER + """, w as (select source_file, seq, page, o_custkey, description as d, o_orderkey from ledger)
select l.source_file, l.seq, date, description, ref, debit::double as debit, credit::double as credit, balance::double as balance,
  case when seq = 1 then 'first_row_unverified' else '' end as flag, page, counterparty, 'State Bank of India' as bank_name, lpad(o_custkey::varchar, 9, '0') as account_number, category, confidence, method
from ledger l""")
def statement_to_ledger(spark, sf_dir):
    """From words to classified transactions with account and payee, as one run over files."""
    # an account line above the first page's header
    words = statement_words(spark, sf_dir)
    number = F.lpad(F.regexp_extract("source_file", r"(\d+)$", 1), 9, "0")
    first = words.where("page = 1 and word_no = 0")
    head = first.select("source_file", "page", "kind", F.explode(F.array(*[F.struct(F.lit(i).alias("n"), t.alias("t"), F.lit(float(x)).alias("x")) for i, (t, x) in enumerate([(F.lit("Account"), 40), (F.lit("No:"), 90), (number, 120), (F.lit("IFSC"), 240), (F.lit("SBIN0001234"), 270)])])).alias("w"))
    head = head.select("source_file", "page", "kind", (F.col("w.n") - 10).alias("word_no"), F.col("w.t").alias("text"), F.col("w.x").alias("x0"), (F.col("w.x") + 6 * F.length("w.t")).alias("x1"), F.lit(-24.0).alias("top"), F.lit(-14.0).alias("bottom"))
    found = assembly.statement_ledger(words.unionByName(head))
    return found.withColumns({c: F.col(c).cast("double") for c in ("debit", "credit", "balance")})


BARE = [("01/02/2024 SHOP 10.00 90.00", "01/02/2024", "SHOP", "10.00", "90.00"), ("5 Mar COFFEE BAR 1,000.50 2.00Dr", "5 Mar", "COFFEE BAR", "1,000.50", "2.00Dr"), ("2024-01-05 NO AMOUNTS HERE", "2024-01-05", "NO AMOUNTS HERE", None, None), ("wrapped narration 5.00", None, "wrapped narration 5.00", None, None)]


@query(f"""with t as (select event_id, cast(event_id % {len(BARE)} + 1 as bigint) as k from events)
select event_id, {_strings(b[0] for b in BARE)}[k] as text, {_strings(b[1] for b in BARE)}[k] as date, {_strings(b[2] for b in BARE)}[k] as "desc", {_strings(b[3] for b in BARE)}[k] as amount, {_strings(b[4] for b in BARE)}[k] as balance from t""")
def cells_without_columns(spark, sf_dir):
    """Lines of pages on which no columns are known."""
    text = F.element_at(F.lit([b[0] for b in BARE]), (F.col("event_id") % len(BARE) + 1).cast("int"))
    word = F.transform(F.split("text", " "), lambda t: F.struct(t.alias("text"), F.lit(0.0).alias("x0"), F.lit(1.0).alias("x1"), F.lit(0.0).alias("top"), F.lit(1.0).alias("bottom")))
    rows = table(spark, sf_dir, "events").select("event_id", text.alias("text")).withColumns({"words": word, "anchors": F.lit(None).cast("array<struct<key:string,x0:double,x1:double>>")})
    return layout.cells(rows).select("event_id", "text", "date", "desc", "amount", "balance")


@query("""select event_id, make_date(2024, cast(event_id % 12 + 1 as bigint), 5) as day, case when event_id % 4 = 3 then 'more' else 'start' end as kind_of
from events where event_id % 4 < 3 union all select event_id, null, 'more' from events where event_id % 4 = 3""")
def serial_before_date(spark, sf_dir):
    """Dates in cells with and without a serial number before them."""
    months = F.element_at(F.lit("Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split()), (F.col("event_id") % 12 + 1).cast("int"))
    day = F.concat(F.lit("05 "), months, F.lit(" 2024"))
    k = F.col("event_id") % 4
    cell = F.when(k == 0, F.concat(F.lit("17 "), day)).when(k == 1, day).when(k == 2, F.concat(F.lit(" 123  "), day)).otherwise("17 items")
    rows = table(spark, sf_dir, "events").select("event_id", cell.alias("date"), F.lit("line").alias("text"))
    return assembly.mark_lines(rows).select("event_id", "day", "kind_of")


@query(LEDGER + """, m as (select source_file, seq, date, seq % 5 = 0 as known, case when seq = 2 then year(date) + 1 end as wrapped from ledger),
a as (select *, case when known then year(date) when seq = 2 then wrapped end as anchor from m),
b as (select *, count(anchor) over (partition by source_file order by seq) as grp, case when anchor is null and month(date) < lag(month(date)) over (partition by source_file order by seq) then 1 else 0 end as back from a)
select source_file, seq, case when grp = 0 then 1900 else first_value(anchor) over (partition by source_file, grp order by seq) + sum(back) over (partition by source_file, grp order by seq rows unbounded preceding) end::bigint as year from b""")
def wrapped_year(spark, sf_dir):
    """The year of a row's second line counts until a dated row has one."""
    yearless = F.try_to_date(F.concat(F.lit("1900"), F.date_format("date", "-MM-"), F.lpad(F.least(F.dayofmonth("date"), F.lit(28)).cast("string"), 2, "0")), "yyyy-MM-dd")
    rows = raw_ledger(spark, sf_dir).select("source_file", "seq", F.lit(1).alias("page"), F.col("seq").alias("line_no"), F.when(F.col("seq") % 5 == 0, F.col("date")).otherwise(yearless).alias("day"), F.when(F.col("seq") == 2, F.year("date") + 1).cast("int").alias("wrapped_year"))
    return assembly.infer_years(rows).select("source_file", "seq", F.year("day").cast("long").alias("year"))


TOKENS = ["A/1", "  ", "\t", "", "x", "\u00a0", "\u3000b"]


@query("select event_id, event_id % 7 as k from events where event_id % 7 in (0, 4, 6)")
def text_layer_words(spark, sf_dir):
    """Tokens of white space of any kind are no words."""
    text = F.element_at(F.lit(TOKENS), (F.col("event_id") % 7 + 1).cast("int"))
    return layout.text_words(table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 7).alias("k"), text.alias("text"))).drop("text")


@query("""with l as (select event_id, event_id % 4 as k, (event_id % 100)::double as x from events)
select event_id, 0 as word_no, 'ab' as text, x / 2 as x0, (x + 7) / 2 as x1, 1.0::double as top, 4.0::double as bottom from l where k in (0, 1)
union all select event_id, 1, 'c', (x + 20) / 2, (x + 30) / 2, 0.5, 4.5 from l where k = 0
union all select event_id, 0, 'ab', 5.0, (10 + (x + 40) / 2) / 2, 0.0, 5.0 from l where k = 2
union all select event_id, 1, 'c', (10 + (x + 40) / 2) / 2, (x + 50) / 2, 0.0, 5.0 from l where k = 2""")
def box_words(spark, sf_dir):
    """Recognised lines: a box for each token (0), of which one is empty (1), too many boxes (2), a low score (3)."""
    k, x = F.col("event_id") % 4, (F.col("event_id") % 100).cast("double")
    box = lambda *points: F.array(*[F.struct((x + dx).alias("x"), F.lit(y).alias("y")) for dx, y in points])
    tokens = F.when(k == 0, F.array(F.lit("ab"), F.lit(" c"))).when(k == 1, F.array(F.lit("ab"), F.lit("\t"))).otherwise(F.array(F.lit("ab")))
    rows = table(spark, sf_dir, "events").select("event_id", F.lit("ab c").alias("text"), F.when(k == 3, 0.5).otherwise(0.75).alias("score"), F.lit(10.0).alias("x0"), (x + 50).alias("x1"), F.lit(0.0).alias("top"), F.lit(10.0).alias("bottom"), F.lit(2.0).alias("scale"), tokens.alias("tokens"), F.array(box((5, 8.0), (0, 2.0), (7, 3.0)), box((20, 1.0), (30, 9.0))).alias("boxes"))
    return layout.recognised_words(rows).select("event_id", "word_no", "text", "x0", "x1", "top", "bottom")


@query("""with e as (select event_id, event_id % 9 as d, (event_id // 9) % 9 as f from events),
j as (select *, d <= 6 as two, case when d <= 6 then f + d / 2.0 <= 6 else f <= 6 end as three from e),
c as (select event_id, two, three, 100.0 as a, 100.0 + d as b, 100.0 + d + f as c from j)
select event_id, 0 as line_no, case when two and three then 'c b a' when two then 'b a' else 'a' end as text,
  round(case when two and three then (a + b + c) / 3 when two then (a + b) / 2 else a end, 6)::double as cy, 10.0::double as line_h from c
union all select event_id, 1, case when two then 'c' when three then 'c b' else 'b' end, round(case when two then c when three then (b + c) / 2 else b end, 6)::double, 10.0 from c where not (two and three)
union all select event_id, 2, 'c', c::double, 10.0 from c where not two and not three""")
def running_mean_lines(spark, sf_dir):
    """Three words one below the other: a word joins a line while it is near the mean of those in it, by the median height."""
    first = F.lit(100.0)
    second = first + F.col("event_id") % 9
    third = second + F.floor(F.col("event_id") / 9) % 9
    words = F.array(*[F.struct(F.lit(i).alias("word_no"), F.lit(t).alias("text"), F.lit(x).alias("x0"), F.lit(x + 6).alias("x1"), (y - h / 2).alias("top"), (y + h / 2).alias("bottom")) for i, (t, x, y, h) in enumerate([("a", 100.0, first, 8), ("b", 50.0, second, 30), ("c", 0.0, third, 10)])])
    rows = table(spark, sf_dir, "events").select("event_id", words.alias("ws")).select(F.lit("f").alias("source_file"), F.col("event_id").alias("page"), F.lit("text").alias("kind"), F.inline("ws"))
    return layout.page_lines(rows).select(F.col("page").alias("event_id"), "line_no", layout.line_text(F.col("words")).alias("text"), F.round("cy", 6).alias("cy"), "line_h")


#: Words (text, x0, line) of headers, the line that counts, and the columns they name.
SHAPES = [
    ([("Date", 40, 0), ("Description", 110, 0), ("/", 180, 0), ("Ref", 190, 0), ("Debit", 330, 0), ("Credit", 420, 0), ("Balance", 510, 0)], 0, "date,desc,debit,credit,balance"),
    ([("Debit", 300, 0), ("Balance", 500, 0), ("in", 300, 1), ("Date", 40, 2), ("Particulars", 100, 2)], 2, "date,desc,debit,balance"),
    ([("Withdrawal", 300, 0), ("Balance", 500, 0), ("Date", 40, 1)], 1, "date,debit,balance"),
    ([("Debit", 300, 0), ("Balance", 500, 0), ("a", 0, 1), ("b", 0, 2), ("Date", 40, 3)], None, None),
    ([("S.No", 0, 0), ("Txn", 30, 0), ("Date", 50, 0), ("Value", 100, 0), ("Date", 132, 0), ("Withdrawal", 300, 0), ("Amt", 361, 0), ("Balance", 500, 0), ("Balance", 600, 0)], 0, "date,value_date,debit,balance"),
    ([("Date", 0, 0), ("Chq", 60, 0), ("Ref", 100, 0), ("Remarks", 200, 0), ("Amount", 300, 0), ("Dr/Cr", 400, 0), ("Balance", 500, 0)], 0, "date,ref,desc,amount,type,balance"),
    ([("words", 0, 0), ("Date", 0, 1), ("Withdrawal", 60, 1), ("Withdrawal", 130, 1), ("Balance", 500, 1), ("Date", 600, 1)], 1, "date,debit,balance,value_date"),
]


@query(f"select c_custkey, {str([n for _, n, _ in SHAPES]).replace('None', 'null')}[cast(c_custkey % {len(SHAPES)} + 1 as bigint)]::integer as header_line, {_strings(k for *_, k in SHAPES)}[cast(c_custkey % {len(SHAPES)} + 1 as bigint)] as keys from customer")
def header_shapes(spark, sf_dir):
    """Headers in one line and in two, with words that are read together, and none."""
    word = lambda i, t, x, y: F.struct(F.lit(i).alias("word_no"), F.lit(t).alias("text"), F.lit(float(x)).alias("x0"), F.lit(x + 6.0 * len(t)).alias("x1"), F.lit(12.0 * y).alias("top"), F.lit(12.0 * y + 10).alias("bottom"))
    shapes = F.array(*[F.array(*[word(i, *w) for i, w in enumerate(ws)]) for ws, _, _ in SHAPES])
    rows = table(spark, sf_dir, "customer").select(F.lit("f").alias("source_file"), F.col("c_custkey").alias("page"), F.lit("text").alias("kind"), F.inline(F.element_at(shapes, (F.col("c_custkey") % len(SHAPES) + 1).cast("int"))))
    return layout.page_layout(rows).select(F.col("page").alias("c_custkey"), "header_line", F.array_join(F.transform("header", lambda a: a["key"]), ",").alias("keys"))
