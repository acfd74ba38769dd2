"""Legal identifiers: register numbers, sections, articles, acts, dates; as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Ordinal suffixes in order, Roman numerals by length of their value.
SUFFIXES = "bis ter quater quinquies sexies septies octies novies decies undecies duodecies terdecies quaterdecies quinquiesdecies sexiesdecies septiesdecies octiesdecies".split()
ROMANS = "I II III IV V VI VII VIII IX X XI XII XIII XIV XV XVI XVII XVIII XIX XX".split()
SUFFIX = "(?:bis|ter|quater|quinquies|sexies|septies|octies|novies|decies)"


def norm_numero(raw: Column) -> Column:
    """Without leading zeros; '0' if nothing else is left; empty and null stay."""
    cut = F.regexp_replace(raw, "^0+", "")
    return F.when((raw != "") & (cut == ""), "0").otherwise(cut)


def norm_rv(raw: Column) -> Column:
    """Five to seven digits of a register number, without leading zeros and suffix; else as it stands."""
    found = F.regexp_extract(raw, r"^0*(\d{5,7})", 1)
    return F.when(found != "", found).otherwise(raw)


def norm_sezione(raw: Column) -> Column:
    cut = F.trim(raw)
    return F.when(F.lower(cut).isin("un", "unite", "u"), "U").when(F.lower(cut).isin("lav", "l"), "L").otherwise(cut)


def roman_value(raw: Column) -> Column:
    known = F.array(*map(F.lit, ROMANS))
    return F.nullif(F.array_position(known, F.upper(F.trim(raw))).cast("int"), F.lit(0))


def suffix_ordinal(suffix: Column) -> Column:
    """bis 2, ter 3, ...; 0 without suffix; 99 if unknown."""
    at = F.array_position(F.array(*map(F.lit, SUFFIXES)), F.lower(suffix)).cast("int")
    return F.when(F.coalesce(suffix, F.lit("")) == "", 0).when(at > 0, at + 1).otherwise(99)


def article_number(raw: Column) -> Column:
    return F.regexp_extract(F.lower(raw), r"(\d+)", 1).try_cast("int")


def article_suffix(raw: Column) -> Column:
    return F.nullif(F.regexp_extract(F.lower(raw), r"\d\s*(?:-\s*)?(" + "|".join(sorted(SUFFIXES, key=len, reverse=True)) + r")\b", 1), F.lit(""))


def article_identity(raw: Column) -> Column:
    """SPECIAL without number, SUFFIX with one, else BASE."""
    return F.when(article_number(raw).isNull(), "SPECIAL").when(article_suffix(raw).isNotNull(), "SUFFIX").otherwise("BASE")


def article_sort_key(raw: Column) -> Column:
    """Six digits and the suffix's ordinal: '002043.00', '000131.02'; without number '999999.99'."""
    number = article_number(raw)
    key = F.concat(F.lpad(number.cast("string"), 6, "0"), F.lit("."), F.lpad(suffix_ordinal(article_suffix(raw)).cast("string"), 2, "0"))
    return F.when(number.isNull(), "999999.99").otherwise(key)


def article_urn(base: Column, raw: Column, comma: Column | None = None, tilde: bool = False) -> Column:
    """base~art2043bis[-com1], or base:art2043bis[~com1] in the other notation."""
    article = F.concat(article_number(raw).cast("string"), F.coalesce(article_suffix(raw), F.lit("")))
    urn = F.concat(base, F.lit(":art" if tilde else "~art"), article)
    return urn if comma is None else F.concat(urn, F.coalesce(F.concat(F.lit("~com" if tilde else "-com"), comma.cast("string")), F.lit("")))


def parse_urn(urn: Column) -> Column:
    pattern = r"^(urn:nir:[^~]+?)[~:]art(\d+)([a-z]*)(?:[-~]com(\d+))?$"
    part = lambda i: F.nullif(F.regexp_extract(urn, pattern, i), F.lit(""))
    return F.struct(part(1).alias("base"), part(2).cast("int").alias("article"), part(3).alias("suffix"), part(4).cast("int").alias("comma"))


def canonical_id(code: Column, article: Column, suffix: Column, number: Column, year: Column) -> Column:
    """CC:2043, CPC:360:bis, LEGGE:241:1990."""
    act = code.isin("LEGGE", "DLGS", "DPR", "DL")
    return F.when(act, F.concat_ws(":", code, number, year.cast("string"))).otherwise(F.concat_ws(":", code, article, suffix))


def celex(kind: Column, year: Column, number: Column) -> Column:
    """3 YYYY type NNNN."""
    return F.concat(F.lit("3"), year.cast("string"), kind, F.lpad(number.cast("string"), 4, "0"))


def global_key(code: Column, raw: Column) -> Column:
    return F.concat_ws(":", F.lit("altalex"), F.lower(code), article_number(raw).cast("string"), F.coalesce(article_suffix(raw), F.lit("null")))


def compact_date(raw: Column) -> Column:
    """yyyyMMdd or ISO; the sentinel 99999999 and unreadable dates give null."""
    return F.when(raw == "99999999", None).otherwise(F.coalesce(F.try_to_timestamp(raw, F.lit("yyyyMMdd")), F.try_to_timestamp(raw, F.lit("yyyy-MM-dd"))).cast("date"))


def italian_date(text: Column) -> Column:
    """First dd/mm/yyyy in a text (also with . or -); null if it names no day."""
    pattern = r"(\d{1,2})[/.-](\d{1,2})[/.-](\d{4})"
    part = lambda i: F.regexp_extract(text, pattern, i)
    return F.try_to_timestamp(F.when(part(1) != "", F.concat_ws("-", part(3), F.lpad(part(2), 2, "0"), F.lpad(part(1), 2, "0"))), F.lit("yyyy-MM-dd")).cast("date")


def query_year(text: Column) -> Column:
    """The year 2010-2029 or 200x a query names."""
    return F.nullif(F.regexp_extract(text, r"\b(20[0-2][0-9])\b", 1), F.lit("")).cast("int")
