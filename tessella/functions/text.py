"""Normalisation of names and addresses as column expressions.

Everything but Unicode compatibility folding and transliteration is built from
native functions, so it stays inside generated code and is pushed with the scan.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Legal forms and their expansions, in order of application.
LEGAL_FORMS = (
    (r"\bpvt\s*\.?\s*ltd\s*\.?\b", "private limited"),
    (r"\bpvt\s*\.?\b", "private"),
    (r"\bltd\s*\.?\b", "limited"),
    (r"\bllp\s*\.?\b", "limited liability partnership"),
    (r"\bcorp\s*\.?\b", "corporation"),
    (r"\binc\s*\.?\b", "incorporated"),
    (r"\bllc\s*\.?\b", "limited liability company"),
    (r"\bco\s*\.?\b", "company"),
    (r"\bs\s*\.?\s*a\s*\.?\s*r\s*\.?\s*l\s*\.?\b", "societe a responsabilite limitee"),
    (r"\bs\s*\.?\s*a\s*\.?\s*s\s*\.?\s*u\s*\.?\b", "societe par actions simplifiee unipersonnelle"),
    (r"\bs\s*\.?\s*a\s*\.?\s*s\s*\.?\b", "societe par actions simplifiee"),
    (r"\bs\s*\.?\s*a\s*\.?\b", "societe anonyme"),
    (r"\be\s*\.?\s*u\s*\.?\s*r\s*\.?\s*l\s*\.?\b", "entreprise unipersonnelle a responsabilite limitee"),
)
# Expanded forms that the core name leaves out.
EXPANDED_FORMS = ("private limited", "limited liability company", "limited liability partnership", "societe a responsabilite limitee", "societe par actions simplifiee")
# Words that say little about a business.
GENERIC_WORDS = (
    "incorporated", "corporation", "company", "limited", "private",
    "llc", "inc", "corp", "ltd", "pvt", "llp", "sarl", "sas", "sa", "sasu", "eurl",
    "and", "the", "of", "in", "at", "by", "for", "with", "a", "an",
    "services", "service", "solutions", "enterprises", "enterprise",
    "holdings", "holding", "group", "international", "global", "technologies",
    "consulting", "management", "store", "shop", "mart", "market",
    "india", "us", "usa", "france", "center", "centre",
)
# Address abbreviations, in order of application.
ADDRESS_FORMS = (
    (r"\bst\s*\.?\b", "street"), (r"\brd\s*\.?\b", "road"), (r"\bave\s*\.?\b", "avenue"), (r"\bblvd\s*\.?\b", "boulevard"),
    (r"\bapt\s*\.?\b", "apartment"), (r"\bbldg\s*\.?\b", "building"), (r"\bste\s*\.?\b", "suite"), (r"\bfl\s*\.?\b", "floor"),
    (r"\bhwy\s*\.?\b", "highway"), (r"\bln\s*\.?\b", "lane"), (r"\bdr\s*\.?\b", "drive"), (r"\bct\s*\.?\b", "court"),
    (r"\bpl\s*\.?\b", "place"), (r"\bpk\s*\.?\b", "park"), (r"\bnagar\b", "nagar"), (r"\bmarg\b", "marg"),
)
# Parts of web addresses.
WEB_PARTS = (r"https?://", r"\bwww\.", r"\.(com|in|fr|org|net|co|io|biz|info)\b")
MISSING = ("nan", "null", "none")

NOT_WORD = r"[^\p{L}\p{N}_\s]"
NON_ASCII = r"[^\x00-\x7F]"


@F.pandas_udf(StringType())
def nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")


def fold_unicode(c: Column, ascii_only: bool = False) -> Column:
    """NFKC, lower case, trimmed; null becomes empty. Pure ASCII never leaves the JVM's data path."""
    c = F.coalesce(c, F.lit(""))
    if not ascii_only:
        c = F.coalesce(nfkc(F.when(c.rlike(NON_ASCII), c)), c)
    return F.regexp_replace(F.lower(c), r"(?U)^\s+|\s+$", "")


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def strip_web(c: Column) -> Column:
    for p in WEB_PARTS:
        c = F.regexp_replace(c, p, "")
    return c


def replace_all(c: Column, forms) -> Column:
    for p, r in forms:
        c = F.regexp_replace(c, "(?U)" + p, r)
    return c


def tokens(c: Column) -> Column:
    return F.filter(F.split(c, " "), lambda t: t != "")


def name_clean(c: Column, ascii_only: bool = False) -> Column:
    return squeeze(F.regexp_replace(strip_web(F.replace(fold_unicode(c, ascii_only), F.lit("&"), F.lit(" and "))), NOT_WORD, " "))


def suffix_expanded(clean: Column) -> Column:
    return squeeze(replace_all(clean, LEGAL_FORMS))


def suffix_core(clean: Column) -> Column:
    c = replace_all(clean, [(p, " ") for p, _ in LEGAL_FORMS])
    for e in EXPANDED_FORMS:
        c = F.replace(c, F.lit(e), F.lit(" "))
    c = squeeze(c)
    return F.when(c == "", clean).otherwise(c)


def informative(toks: Column) -> Column:
    return F.filter(toks, lambda t: ~t.isin(*GENERIC_WORDS) & (F.length(t) >= 2))


def sorted_name(toks: Column, inf: Column) -> Column:
    return F.array_join(F.array_sort(F.when(F.size(inf) > 0, inf).otherwise(toks)), " ")


def address_missing(c: Column) -> Column:
    return F.lower(F.trim(F.coalesce(c, F.lit("")))).isin("", *MISSING)


def address_clean(folded: Column) -> Column:
    return squeeze(replace_all(squeeze(F.regexp_replace(folded, NOT_WORD, " ")), ADDRESS_FORMS))


def primary_number(folded: Column) -> Column:
    bare = F.regexp_replace(folded, r"(?U)\b(flat no|house no|no)\s*[\.\-]?\s*", "")
    return F.regexp_replace(F.regexp_extract(bare, r"\b\d+[a-z0-9/\-]*", 0), r"^[-/]+|[-/]+$", "")


def normalize(df: DataFrame, ascii_only: bool = False) -> DataFrame:
    """df with the twelve derived columns and country_norm.

    Null fields count as empty. ascii_only promises ASCII input and keeps the
    whole plan free of Python.
    """
    df = df.withColumn("name_clean", name_clean(F.col("business_name"), ascii_only)).withColumn("a_folded", F.when(address_missing(F.col("business_address")), "").otherwise(fold_unicode(F.col("business_address"), ascii_only)))
    df = df.withColumns(
        {
            "name_suffix_norm": suffix_expanded(F.col("name_clean")),
            "name_core": suffix_core(F.col("name_clean")),
            "name_tokens": tokens(F.col("name_clean")),
            "addr_clean": address_clean(F.col("a_folded")),
            "addr_pin": F.regexp_extract("a_folded", r"\b\d{5,6}\b", 0),
            "addr_numbers": F.regexp_extract_all("a_folded", F.lit(r"\b\d+\b"), F.lit(0)),
            "addr_primary_num": primary_number(F.col("a_folded")),
            "addr_is_missing": address_missing(F.col("business_address")),
            "country_norm": F.upper(F.trim(F.coalesce("country", F.lit("")))),
        }
    )
    df = df.withColumns({"name_informative_tokens": informative(F.col("name_tokens")), "addr_tokens": tokens(F.col("addr_clean"))})
    return df.withColumn("name_sorted", sorted_name(F.col("name_tokens"), F.col("name_informative_tokens"))).drop("a_folded")


def normalize_baseline(df: DataFrame) -> DataFrame:
    """entity_id, name and country of the simplest matcher."""
    name = squeeze(F.regexp_replace(F.lower(F.coalesce("business_name", F.lit(""))), NOT_WORD, " "))
    return df.select("entity_id", name.alias("name"), F.lower(F.trim(F.coalesce("country", F.lit("")))).alias("country"))


# Transliteration: letters by the names that Unicode gives them, where no table is needed.
VOWEL_SIGNS = {"VIRAMA": "", "PULLI": ""}


@lru_cache(maxsize=10_000)
def romanised(ch: str) -> str:
    if ord(ch) < 128:
        return ch
    plain = "".join(x for x in unicodedata.normalize("NFKD", ch) if not unicodedata.combining(x))
    if plain and all(ord(x) < 128 for x in plain):
        return plain
    name = unicodedata.name(ch, "")
    words = name.split()
    if any(w in VOWEL_SIGNS for w in words):
        return ""
    if " LETTER " in name or "VOWEL SIGN" in name or " DIGIT " in name:
        if "DIGIT" in words:
            return str(unicodedata.digit(ch, ""))
        last = words[-1].lower()
        if "LATIN" in words:
            return words[words.index("LETTER") + 1][:2].lower()
        return last if len(last) <= 3 or "VOWEL" in words else last[:2]
    return ""


@F.pandas_udf(StringType())
def romanise(s: pd.Series) -> pd.Series:
    return s.map(lambda x: "".join(map(romanised, x)).lower().strip(), na_action="ignore")


def transliterate(c: Column) -> Column:
    """Rough Latin letters for any script; ASCII stays in the JVM."""
    c = F.coalesce(c, F.lit(""))
    return F.coalesce(romanise(F.when(c.rlike(NON_ASCII), c)), F.trim(F.lower(c)))


def is_non_ascii(c: Column) -> Column:
    return c.rlike(NON_ASCII)


def primary_script(c: Column) -> Column:
    """Script of the first letter that is Devanagari, Tamil or Latin; Latin if there is none."""
    first = F.regexp_extract(c, r"[\p{IsDevanagari}\p{IsTamil}\p{IsLatin}]", 0)
    return F.when(first.rlike(r"\p{IsDevanagari}"), "Devanagari").when(first.rlike(r"\p{IsTamil}"), "Tamil").otherwise("Latin")


def script_set(c: Column) -> Column:
    return F.array_compact(F.array(*[F.when(c.rlike(rf"\p{{Is{s}}}"), F.lit(s)) for s in ("Devanagari", "Latin", "Tamil")]))


def locality(addr_tokens: Column) -> Column:
    return F.coalesce(F.get(F.reverse(F.filter(addr_tokens, lambda t: (F.length(t) >= 3) & ~t.rlike(r"^\d+$"))), F.lit(0)), F.lit(""))


def acronym(toks: Column) -> Column:
    """Initials of three to six non-generic words; null otherwise."""
    some = F.filter(toks, lambda t: ~t.isin(*GENERIC_WORDS) & t.rlike(r"^[\p{L}\p{N}]"))
    return F.when(F.size(some).between(3, 6), F.array_join(F.transform(some, lambda t: F.substring(t, 1, 1)), ""))


def char_ngrams(c: Column, low: int = 2, high: int = 4) -> Column:
    """Character n-grams inside words that are padded with a space on either side; a
    word shorter than n gives itself once."""

    def of(w: Column) -> Column:
        p = F.concat(F.lit(" "), w, F.lit(" "))
        n = F.length(p)

        def grams(k: int) -> Column:
            return F.when(n >= k, F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.substring(p, i, F.lit(k)))).otherwise(F.array(p) if k == low else F.array().cast("array<string>"))

        return F.concat(*[grams(k) for k in range(low, high + 1)])

    return F.flatten(F.transform(tokens(squeeze(c)), of))


def word_ngrams(c: Column) -> Column:
    """Words of two and more characters, and pairs of neighbours."""
    w = F.regexp_extract_all(c, F.lit(r"(?U)\b\w\w+\b"), F.lit(0))
    return F.concat(w, F.filter(F.transform(w, lambda x, i: F.concat_ws(" ", F.get(w, i - 1), x)), lambda x: F.contains(x, F.lit(" "))))
