"""Text cleaning families and name / address canonicalisers, as column functions.

The six families differ in order and alphabet and give different keys, so they stay apart. All but Unicode
normalisation are built-in expressions; that one is an Arrow UDF, as Spark has no such function.

A null is the empty string everywhere.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Abbreviations, legal words and stopwords that the canonical forms and tokens are defined by.
NAME_WORDS = {
    "pvt": "private",
    "ltd": "limited",
    "corp": "corporation",
    "inc": "incorporated",
    "co": "company",
    "llc": "limited liability company",
    "llp": "limited liability partnership",
}
ADDRESS_WORDS = {
    "st": "street",
    "rd": "road",
    "ave": "avenue",
    "av": "avenue",
    "blvd": "boulevard",
    "dr": "drive",
    "ln": "lane",
    "hwy": "highway",
    "ctr": "center",
    "ct": "court",
    "pl": "place",
    "pkwy": "parkway",
    "ste": "suite",
}
LEGAL_WORDS = ("private", "limited", "incorporated", "corporation", "company", "llc", "llp")
LEGAL_ENDINGS = ("private limited", "pvt ltd", "pvt limited", "private ltd", "limited", "ltd", "llp", "incorporated", "inc", "corporation", "corp", "company", "co")
ADDRESS_SHORT = {"road": "rd", "street": "st", "avenue": "ave", "apartment": "apt", "building": "bldg", "highway": "hwy", "lane": "ln", "sector": "sec"}
STOPWORDS = ("the", "and", "of", "for", "in", "at", "on", "private", "limited", "incorporated", "corporation", "company", "llc", "llp")

#: Names expand by one shared table where a name and an address aren't told apart; there llc and llp stay.
SHARED_WORDS = {k: v for k, v in NAME_WORDS.items() if k not in ("llc", "llp")} | ADDRESS_WORDS


def col(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def unicode_form(c: Column | str, form: str = "NFKC", drop_marks: bool = False) -> Column:
    """Unicode normalisation; ``drop_marks`` leaves combining characters out afterwards. ASCII values pass as they are
    and only as nulls go through Python."""

    @F.pandas_udf("string")
    def apply(s: pd.Series) -> pd.Series:
        def one(x: str | None) -> str | None:
            if x is None:
                return None
            x = unicodedata.normalize(form, x)
            return "".join(ch for ch in x if not unicodedata.combining(ch)) if drop_marks else x

        return s.map(one, na_action="ignore")

    value = col(c)
    return F.coalesce(apply(F.when(F.octet_length(value) > F.length(value), value)), value)


def _runs_to_blank(c: Column, keep: str) -> Column:
    """Every run of characters outside ``keep`` (and so of blanks) is one blank; none at the ends."""
    return F.trim(F.regexp_replace(c, f"[^{keep}]+", " "))


# letters, numbers and underscore; combining marks are no word characters
_WORD = r"\p{L}\p{N}_"


def clean_unicode(c: Column | str) -> Column:
    """NRM-U: lower, NFKC, word characters. Capitals that NFKC makes stay."""
    return _runs_to_blank(unicode_form(F.lower(col(c))), _WORD)


def clean_folded(c: Column | str) -> Column:
    """NRM-UF: NRM-U, then accents off."""
    return unicode_form(clean_unicode(c), "NFKD", drop_marks=True)


def clean_tail(c: Column | str) -> Column:
    """NRM-T: NFKC, lower, ``&`` as ``and``, word characters."""
    return _runs_to_blank(F.replace(F.lower(unicode_form(c)), F.lit("&"), F.lit(" and ")), _WORD)


def clean_devanagari(c: Column | str) -> Column:
    """NRM-D: lower, NFKC, ASCII letters and digits and the Devanagari block."""
    return _runs_to_blank(unicode_form(F.lower(col(c))), "a-z0-9\\u0900-\\u097f")


def clean_ascii(c: Column | str) -> Column:
    """NRM-A: lower, ASCII letters and digits."""
    return _runs_to_blank(F.lower(col(c)), "a-z0-9")


def clean_and(c: Column | str) -> Column:
    """NRM-G: NRM-A with ``&`` as ``and``."""
    return clean_ascii(F.replace(F.lower(col(c)), F.lit("&"), F.lit(" and ")))


def country_plain(c: Column | str) -> Column:
    """NRM-C1."""
    return F.lower(F.trim(col(c)))


def words(c: Column | str) -> Column:
    """Blank-separated words; the empty string has none."""
    return F.filter(F.split(col(c), " "), lambda t: t != "")


def replace_words(c: Column | str, table: dict[str, str]) -> Column:
    """Each word that ``table`` has becomes its value."""
    known = F.create_map(*(F.lit(x) for kv in table.items() for x in kv))
    return F.array_join(F.transform(words(c), lambda t: F.coalesce(F.try_element_at(known, t), t)), " ")


def name_expanded(clean: Column | str) -> Column:
    """CAN-N1 of a cleaned name."""
    return replace_words(clean, NAME_WORDS)


def address_expanded(clean: Column | str) -> Column:
    """CAN-A1 of a cleaned address."""
    return replace_words(clean, ADDRESS_WORDS)


def shared_expanded(clean: Column | str) -> Column:
    """CAN-X of a cleaned name or address: one table for both."""
    return replace_words(clean, SHARED_WORDS)


def without_legal(expanded: Column | str) -> Column:
    """CAN-N2: legal words out, wherever they stand."""
    return F.array_join(F.filter(words(expanded), lambda t: ~t.isin(*LEGAL_WORDS)), " ")


def without_ending(clean: Column | str) -> Column:
    """CAN-N3: trailing legal phrases off, as many as there are; a name is never emptied."""
    return F.regexp_replace(col(clean), f"( ({'|'.join(LEGAL_ENDINGS)}))+$", "")


def name_chained(clean: Column | str) -> Column:
    """CAN-N4: expansions one after the other, so that ``pvt ltd`` gives ``private limited limited``."""
    c = col(clean)
    for short, full in (("pvt", "private limited"), ("ltd", "limited"), ("corp", "corporation"), ("inc", "incorporated"), ("co", "company")):
        c = F.regexp_replace(c, rf"(?<!\S){short}(?!\S)", full)
    return c


def address_shortened(clean: Column | str) -> Column:
    """CAN-A2: eight words abbreviated between blanks; of two in a row that share a blank only the first."""
    c = F.concat(F.lit(" "), col(clean), F.lit(" "))
    for full, short in ADDRESS_SHORT.items():
        c = F.replace(c, F.lit(f" {full} "), F.lit(f" {short} "))
    return F.trim(F.regexp_replace(c, " +", " "))


def compact(c: Column | str) -> Column:
    """CMP-1: ASCII letters and digits only."""
    return F.regexp_replace(col(c), "[^a-z0-9]", "")
