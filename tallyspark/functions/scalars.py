"""Column functions: amounts, dates, names, keys. All stay within the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyspark.functions import constants as K


def whole(pattern: str) -> str:
    """A pattern for rlike that must match all of a string, in any case."""
    return rf"(?i)^(?:{pattern})$"


def found(text: Column, pattern: str, group: int = 1, flags: str = "im") -> Column:
    """The trimmed group of the first match, or null."""
    return F.when(text.rlike(f"(?{flags}){pattern}" if flags else pattern), F.trim(F.regexp_extract(text, f"(?{flags}){pattern}" if flags else pattern, group)))


def squeeze(text: Column) -> Column:
    """White space runs as one blank, none at the ends; null becomes empty."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))


def stripped(text: Column) -> Column:
    """Without white space at the ends, of any kind; null stays."""
    return F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def let(value: Column, f) -> Column:
    """f(value) with value computed once: a column that is used many times in an expression would be repeated in its code."""
    return F.transform(F.array(value), f)[0]


def parse_amount(text: Column) -> Column:
    """struct(value, tag): the last token with a digit as an absolute number, and dr, cr or neg; both null if there is none."""

    def parsed(s: Column) -> Column:
        token = F.try_element_at(F.filter(F.split(s, r"(?U)\s+"), lambda t: t.rlike(r"\d")), F.lit(-1))
        return let(F.struct(s.alias("s"), token.alias("token"), F.regexp_replace(token, r"[^\d.]", "").try_cast("double").alias("value")), tagged)

    def tagged(x: Column) -> Column:
        tag = F.coalesce(F.nullif(F.lower(F.regexp_extract(x["s"], r"(?i)(dr|cr)\.?$", 1)), F.lit("")), F.when(x["token"].rlike(r"^[-(]") | x["s"].rlike(r"^[-(]"), "neg"))
        return F.struct(x["value"].alias("value"), F.when(x["value"].isNotNull(), tag).alias("tag"))

    return let(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)^\s+|\s+$", ""), parsed)


def _month(name: Column, full: bool) -> Column:
    short = F.array_position(F.lit([m[:3] for m in K.MONTHS]), F.lower(name))
    long = F.array_position(F.lit(K.MONTHS), F.lower(name))
    return F.greatest(short, long) if full else short


def parse_date(text: Column) -> Column:
    """The first date in a text: day first, by number or English month name, or ISO; without a year it is of 1900.

    A year of two digits from 69 on is of the 20th century. Separators must agree. Long month names need a full year.
    """
    token = F.regexp_extract(F.coalesce(text, F.lit("")), "(?i)" + K.DATE, 1)
    token = F.trim(F.regexp_replace(F.regexp_replace(token, r"\s*([/\-.])\s*", "$1"), r"\s+", " "))
    shape = r"^(\d{1,2})([/\-. ])(\d{1,2}|[A-Za-z]+)(?:\2(\d{4}|\d{2}))?$"

    def parsed(t: Column) -> Column:
        # all empty if the shape doesn't fit
        parts = F.struct(*[F.regexp_extract(t, shape, i).alias(n) for i, n in enumerate(("day", "gap", "month", "year"), 1)])
        return F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(t, "yyyy-MM-dd")).otherwise(let(parts, dated))

    def dated(p: Column) -> Column:
        short, long = _month(p["month"], False), _month(p["month"], True)
        named = F.when(short > 0, short).when((long > 0) & (F.length(p["year"]) == 4) & (p["gap"] != "/"), long).cast("int")
        return let(F.struct(p["day"].alias("day"), F.when(p["month"].rlike(r"^\d"), F.when(p["gap"] != " ", p["month"].try_cast("int"))).when(p["gap"] != ".", named).alias("month"), p["year"].alias("year")), made)

    def made(p: Column) -> Column:
        year = p["year"].try_cast("int")
        full = F.when(p["year"] == "", F.lit(1900)).when(F.length(p["year"]) == 4, year).when(year >= 69, year + 1900).otherwise(year + 2000)
        return F.try_to_date(F.when(p["month"].isNotNull(), F.format_string("%04d-%02d-%s", full, p["month"], F.lpad(p["day"], 2, "0"))), "yyyy-MM-dd")

    # most dates are of one form, which needs no more than one look; most other texts have none
    plain = F.concat_ws("-", F.substring(text, 7, 4), F.substring(text, 4, 2), F.substring(text, 1, 2)).try_cast("date")
    return F.when(text.rlike(r"^\d{2}([/\-.])\d{2}\1[1-9]\d{3}$"), plain).when(text.rlike("(?i)" + K.DATE), let(token, parsed))


def direction(debit: Column, credit: Column | None = None) -> Column:
    """dr if there is a debit other than 0, else cr."""
    return F.when(F.coalesce(debit, F.lit(0)) != 0, "dr").otherwise("cr")


def title_case(text: Column) -> Column:
    """A letter after anything but a letter is a capital, any other letter is small."""
    chars = F.split(text, "")
    return F.array_join(F.transform(chars, lambda c, i: F.when((i > 0) & F.try_element_at(chars, F.greatest(i, F.lit(1))).rlike(r"\p{L}"), F.lower(c)).otherwise(F.upper(c))), "")


def counterparty(description: Column) -> Column:
    """The first part of a narration that looks like a name, in title case and at most 40 characters, or empty."""
    parts = F.transform(F.split(F.coalesce(description, F.lit("")), r"[/\-@|]"), lambda p: F.regexp_replace(p, r"(?U)^\s+|\s+$", ""))
    names = F.filter(parts, lambda p: (F.length(p) >= 3) & p.rlike("[A-Za-z]{3,}") & ~p.rlike(whole("|".join(K.NOISE))) & ~p.rlike(r"\d{5,}"))
    return F.coalesce(F.left(title_case(F.try_element_at(names, F.lit(1))), F.lit(40)), F.lit(""))


def featurise(description: Column, way: Column) -> Column:
    """Small letters and digits, without numbers of 4 digits and more, and the direction as a word."""
    words = F.split(F.trim(F.regexp_replace(F.lower(F.coalesce(description, F.lit(""))), "[^a-z0-9 ]", " ")), " +")
    return F.concat(F.array_join(F.filter(words, lambda w: (w != "") & ~w.rlike("^[0-9]{4,}$")), " "), F.lit(" __"), way, F.lit("__"))


def reference(ref: Column, description: Column) -> Column:
    """The reference, or else the first token of a description that looks like one, or empty."""
    own = F.trim(F.coalesce(ref, F.lit("")))
    return F.when(own != "", own).otherwise(F.regexp_extract(F.coalesce(description, F.lit("")), K.REFERENCE, 1))


def header_key(text: Column) -> Column:
    """The column that a header word names, or null. Of words joined by slashes all must name the same one."""
    table = F.create_map(*[F.lit(x) for key, words in K.HEADER_WORDS.items() for w in words.split() for x in (w, key)])

    def named(norm: Column) -> Column:
        bare = F.regexp_replace(norm, "^/+|/+$", "")
        return F.coalesce(F.try_element_at(table, norm), let(bare, joined))

    def joined(bare: Column) -> Column:
        keys = F.transform(F.filter(F.split(bare, "/"), lambda p: p != ""), lambda p: F.coalesce(F.try_element_at(table, p), F.lit("?")))
        same = let(F.array_distinct(keys), lambda k: F.when(bare.contains("/") & (F.size(k) == 1) & (k[0] != "?"), k[0]))
        return F.coalesce(F.try_element_at(table, bare), same)

    return let(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9/]", ""), named)


def gap(x0: Column, x1: Column, a0: Column, a1: Column) -> Column:
    """The empty space between two ranges of x, 0 if they overlap."""
    return F.greatest(a0 - x1, x0 - a1, F.lit(0.0))


def near_digits(a: Column, b: Column, most: int = 2) -> Column:
    """Whether two amounts, written with 2 decimals and without sign, are as long and differ in at most `most` characters."""
    x, y = (F.abs(v).cast("decimal(38,2)").cast("string") for v in (a, b))
    return (F.length(x) == F.length(y)) & (F.size(F.filter(F.zip_with(F.split(x, ""), F.split(y, ""), lambda p, q: p != q), lambda z: z)) <= most)


def chain_ok(before: Column, debit: Column, credit: Column, balance: Column) -> Column:
    """Whether a balance follows from the one before; false if either is missing."""
    zero = F.lit(0).cast("decimal(18,2)")
    return F.coalesce(F.abs(before + F.coalesce(credit, zero) - F.coalesce(debit, zero) - balance) <= F.lit(K.TOLERANCE), F.lit(False))


def fix_ifsc(text: Column) -> Column:
    return F.regexp_replace(text, K.IFSC_MISREAD, "$10$2")


def ifsc(text: Column) -> Column:
    return found(text, K.IFSC, flags="m")


def bank(text: Column) -> Column:
    """The bank of the first IFSC code, or else the first in the table whose name a text has."""
    table = F.create_map(*[F.lit(x) for kv in K.BANKS.items() for x in kv])
    named = F.coalesce(*[F.when(F.contains(F.lower(text), F.lit(v.lower())), v) for v in K.BANKS.values()])
    return F.coalesce(F.try_element_at(table, F.left(ifsc(text), F.lit(4))), named)


def currency(text: Column) -> Column:
    signs = [F.when(text.contains(s), c) for s, c in K.CURRENCY_SIGNS]
    return F.coalesce(*signs, F.upper(found(text, r"\b(INR|USD|EUR|GBP)\b")), F.lit("INR"))


def row_style(flag: Column, debit: Column, credit: Column, row: Column, zebra: bool = True) -> Column:
    """What colours an exported row: its flag, its debit, its credit, or every other row."""
    style = F.when(F.coalesce(flag, F.lit("")) != "", "flag").when(F.coalesce(debit, F.lit(0)) != 0, "debit").when(F.coalesce(credit, F.lit(0)) != 0, "credit")
    return F.coalesce(style.when(row % 2 == 0, "zebra") if zebra else style, F.lit("none"))


def is_opening(text: Column) -> Column:
    return text.rlike("(?i)" + K.OPENING)


def is_footer(text: Column) -> Column:
    return text.rlike("(?im)" + K.FOOTER)


def last_amount(text: Column) -> Column:
    """The value of the last token that is an amount, or null."""
    return parse_amount(F.try_element_at(F.filter(F.split(text, r"\s+"), lambda t: t.rlike(whole(K.AMOUNT))), F.lit(-1)))["value"]


def category(description: Column, way: Column) -> Column:
    """The category of the first rule that matches and whose direction fits, or null: one CASE expression."""
    out = F
    for name, pattern, needed in K.RULES:
        hit = F.coalesce(description, F.lit("")).rlike("(?i)" + pattern)
        out = out.when(hit if needed is None else hit & (way == needed), name)
    return out
