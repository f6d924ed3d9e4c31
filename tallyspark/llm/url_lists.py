"""URL filters with dated lists.

A list entry says that from its day on a host pattern (a host and everything below it) is blocked or allowed, until the
pattern's next entry; the action "drop" only ends what was before, so a parent's entry decides again. intervals() turns
entries into validity intervals; evaluate() joins each capture, as of the day it was fetched, with the entries then active
for its host and the host's parents: the longest pattern decides.

Of entries with equal pattern and day the greatest (action, category) counts. Entries without pattern or day, and
captures without host or day, match nothing; such captures are "unlisted". Every capture row is kept, repeats included,
with all its columns; only those named as evaluate()'s own are replaced by them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)"


def host_of(url):
    """The lower-case host of a URL column; null if there is none."""
    return F.nullif(F.lower(F.regexp_extract(url, HOST, 1)), F.lit(""))


def suffixes(host):
    """host and its parents of at least two labels (a host of one label: itself)."""
    parts = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def intervals(entries: DataFrame) -> DataFrame:
    """entries (pattern, listed_on date, action, category) as (pattern, valid_from, valid_to, action, category); valid_to is exclusive, null if open. Drops are ends, not entries."""
    one = entries.where("pattern is not null and listed_on is not null").groupBy(F.lower("pattern").alias("pattern"), F.col("listed_on").alias("valid_from")).agg(F.max(F.struct("action", "category")).alias("e"))
    return one.select("pattern", "valid_from", F.lead("valid_from").over(Window.partitionBy("pattern").orderBy("valid_from")).alias("valid_to"), "e.*").where("action is null or action <> 'drop'")


OWN = ["host", "verdict", "pattern", "category", "valid_from"]


def evaluate(captures: DataFrame, active: DataFrame, url: str = "url", fetched_on: str = "fetched_on") -> DataFrame:
    """captures with host, verdict (blocked, allowed, unlisted), pattern, category and valid_from.

    The as-of join runs over the distinct (host, day) pairs, on pattern and month, so that neither a common host nor a
    long history meets in one task; its result is joined to the captures.
    """
    kept = [c for c in captures.columns if c not in OWN]
    rows = captures.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("capture"), host_of(F.col(url)).alias("host"), F.col(fetched_on).alias("day"))
    days = rows.select("host", "day").where("host is not null and day is not null").distinct()
    horizon = rows.agg(F.max("day")).first()[0]
    end = F.date_sub(F.coalesce("valid_to", F.date_add(F.greatest(F.lit(horizon).cast("date"), F.col("valid_from")), 1)), 1)
    by_month = active.withColumn("month", F.explode(F.sequence(F.trunc("valid_from", "month"), F.trunc(end, "month"), F.expr("interval 1 month"))))
    asked = days.withColumn("pattern", F.explode(suffixes(F.col("host")))).withColumn("month", F.trunc("day", "month"))
    hits = asked.join(by_month, ["pattern", "month"]).where("day >= valid_from and (valid_to is null or day < valid_to)")
    best = hits.groupBy("host", "day").agg(F.max_by(F.struct("pattern", "action", "category", "valid_from"), F.length("pattern")).alias("e")).select("host", "day", "e")
    # captures without host or day join nothing: they do not travel, so that they cannot meet in one task
    asked = F.col("host").isNotNull() & F.col("day").isNotNull()
    none = rows.where(~asked).withColumn("e", F.lit(None).cast(best.schema["e"].dataType))
    found = rows.where(asked).join(best, ["host", "day"], "left").select(*rows.columns, "e").unionByName(none)
    verdict = F.when(F.col("e.action") == "block", "blocked").when(F.col("e.action") == "allow", "allowed").otherwise("unlisted")
    return found.select("capture.*", "host", verdict.alias("verdict"), "e.pattern", "e.category", "e.valid_from")


def sample_entries(hosts: DataFrame, per_pattern: int = 4) -> DataFrame:
    """A made-up history for the hosts (host) of a table and their parents: dated entries that follow from a pattern's MD5."""
    number = F.conv(F.substring(F.md5(F.concat(F.col("pattern"), F.lit("#"), F.col("n").cast("string"))), 1, 7), 16, 10).cast("int")
    rows = hosts.where("host is not null").select(F.explode(suffixes(F.col("host"))).alias("pattern")).distinct()
    rows = rows.withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(per_pattern)))).withColumn("h", number)
    kind = F.when(F.col("h") % 3 == 0, "allow").when(F.col("h") % 3 == 1, "block").otherwise("drop")
    category = F.element_at(F.array(F.lit("spam"), F.lit("adult"), F.lit("malware"), F.lit("copyright")), F.col("n"))
    return rows.select("pattern", F.date_add(F.lit("2023-01-01").cast("date"), F.col("h") % 730).alias("listed_on"), kind.alias("action"), category.alias("category"))


def fetch_day(page_id):
    """A made-up day of fetching for the pages table, which has none."""
    return F.date_add(F.lit("2023-01-01").cast("date"), F.pmod(page_id * 37, F.lit(730)).cast("int"))


def url_report(pages: DataFrame) -> DataFrame:
    """page_id, host, fetched_on, verdict, pattern, category, valid_from of every page, with the made-up days and list."""
    captures = pages.select("page_id", "url", fetch_day(F.col("page_id")).alias("fetched_on"))
    entries = sample_entries(pages.select(host_of(F.col("url")).alias("host")).distinct())
    return evaluate(captures, intervals(entries)).select("page_id", "host", "fetched_on", "verdict", "pattern", "category", "valid_from")


SQL = r"""
with p as (
  select page_id, nullif(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)', 1)), '') as host,
         date '2023-01-01' + cast(((page_id * 37) % 730) as integer) as fetched_on
  from pages),
h as (select distinct host, string_split(host, '.') as parts from p where host is not null),
s as (select host, array_to_string(parts[i:], '.') as pattern
      from h, lateral (select unnest(range(1, greatest(len(parts), 2)))) as u(i)),
pats as (select distinct pattern from s),
raw as (select pattern, n, cast(concat('0x', substr(md5(concat(pattern, '#', cast(n as varchar))), 1, 7)) as integer) as x
        from pats, range(1, 5) as r(n)),
e as (select pattern, date '2023-01-01' + cast(x % 730 as integer) as valid_from,
             max(struct_pack(a := case x % 3 when 0 then 'allow' when 1 then 'block' else 'drop' end,
                             c := list_extract(['spam', 'adult', 'malware', 'copyright'], cast(n as integer)))) as e
      from raw group by 1, 2),
iv as (select pattern, valid_from, lead(valid_from) over (partition by pattern order by valid_from) as valid_to, e.a as action, e.c as category from e),
m as (select p.page_id, p.host, p.fetched_on, iv.pattern, iv.action, iv.category, iv.valid_from,
             row_number() over (partition by p.page_id order by length(iv.pattern) desc) as k
      from p join s on p.host = s.host
      join iv on s.pattern = iv.pattern and iv.action in ('block', 'allow') and p.fetched_on >= iv.valid_from and (iv.valid_to is null or p.fetched_on < iv.valid_to))
select p.page_id, p.host, p.fetched_on,
       case m.action when 'block' then 'blocked' when 'allow' then 'allowed' else 'unlisted' end as verdict,
       m.pattern, m.category, m.valid_from
from p left join m on p.page_id = m.page_id and m.k = 1
"""
