"""Tokens and blocking keys. Empty keys are empty strings and never block."""

from __future__ import annotations

from dataclasses import dataclass
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkweld.functions import text as t


def informative(c: Column | str) -> Column:
    """TOK-1: words of three characters or more that are no stopwords, in order, with repeats."""
    return F.filter(t.words(c), lambda w: (F.length(w) >= 3) & ~w.isin(*t.STOPWORDS))


def token_set(c: Column | str) -> Column:
    """TOK-2."""
    return F.array_distinct(informative(c))


def word_set(c: Column | str) -> Column:
    """TOK-3."""
    return F.array_distinct(t.words(c))


def char_grams(c: Column | str, n: int = 3) -> Column:
    """TOK-4: set of character n-grams of the blank-free text; a shorter text is its own, the empty one has none."""
    x = F.replace(t.col(c), F.lit(" "), F.lit(""))
    many = F.transform(F.sequence(F.lit(1), F.length(x) - (n - 1)), lambda i: F.substring(x, i, F.lit(n)))
    return F.when(x == "", F.array().cast("array<string>")).when(F.length(x) < n, F.array(x)).otherwise(F.array_distinct(many))


def prefix(c: Column | str, n: int) -> Column:
    """KEY-1."""
    return F.left(F.replace(t.col(c), F.lit(" "), F.lit("")), F.lit(n))


def suffix(c: Column | str, n: int) -> Column:
    return F.right(F.replace(t.col(c), F.lit(" "), F.lit("")), F.lit(n))


def first_token(c: Column | str, n: int = 4) -> Column:
    """KEY-3: first characters of the first informative token."""
    return F.left(F.coalesce(F.try_element_at(informative(c), F.lit(1)), F.lit("")), F.lit(n))


def last_token(c: Column | str, n: int = 4) -> Column:
    return F.left(F.coalesce(F.try_element_at(informative(c), F.lit(-1)), F.lit("")), F.lit(n))


def _last_match(c: Column, pattern: str) -> Column:
    return F.coalesce(F.try_element_at(F.regexp_extract_all(c, F.lit(pattern), F.lit(1)), F.lit(-1)), F.lit(""))


def postal(raw: Column | str, least: int = 4, most: int = 10) -> Column:
    """KEY-4a (4 to 10 digits) and KEY-4b (5 to 6): the last such number of the raw address."""
    edge = r"[\p{L}\p{N}_]"
    return _last_match(t.col(raw), rf"(?<!{edge})(\p{{Nd}}{{{least},{most}}})(?!{edge})")


def postal_word(clean: Column | str) -> Column:
    """KEY-4c: the last word of 4 to 10 ASCII letters and digits, often no number at all."""
    return _last_match(t.col(clean), r"(?<![\p{L}\p{N}_])([a-z0-9]{4,10})(?![\p{L}\p{N}_])")


@dataclass(frozen=True)
class Profile:
    """One family of derived columns: how names, addresses and countries become keys."""

    name: str
    clean: Callable[[Column | str], Column]
    name_canon: Callable[[Column], Column]
    address_canon: Callable[[Column], Column]
    country: Callable[[Column | str], Column]
    postal: Callable[[Column | str], Column] = postal
    compact_keys: bool = False

    def prepare(self, records: DataFrame) -> DataFrame:
        """KEY-7: ``records(entity_id, source, ord, business_name, business_address, country)`` with all derived columns."""
        x = records.select(
            "entity_id", "source", "ord", t.col("business_name").alias("business_name"), t.col("business_address").alias("business_address"), t.col("country").alias("country")
        )
        x = x.select("*", self.clean("business_name").alias("name_norm"), self.clean("business_address").alias("address_norm"), self.country("country").alias("country_norm"))
        x = x.select("*", self.name_canon(F.col("name_norm")).alias("name_canon"), self.address_canon(F.col("address_norm")).alias("address_canon"))
        if self.compact_keys:  # KEY-2: without legal words; where nothing is left, of the whole name
            key = t.compact(F.coalesce(F.nullif(F.col("name_canon"), F.lit("")), F.col("name_norm")))
            tokens = F.col("name_norm")
        else:
            key = tokens = F.col("name_canon")
        x = x.select(
            "*", prefix(key, 6).alias("prefix6"), prefix(key, 4).alias("prefix4"), suffix(key, 4).alias("suffix4"), first_token(tokens).alias("first4"),
            last_token(tokens).alias("last4"), self.postal("business_address").alias("postal"), token_set(tokens).alias("tokens"),
        )
        hashes = lambda xs: F.array_distinct(F.transform(xs, lambda w: F.xxhash64(w)))
        for what in ("name", "address"):  # sets that pairs compare, made once a record
            x = x.withColumn(f"{what}_words", hashes(token_set(f"{what}_canon"))).withColumn(f"{what}_grams", hashes(char_grams(f"{what}_canon")))
        both = (F.col("name_canon") != "") & (F.col("address_canon") != "")
        return x.withColumn("name_address", F.when(both, F.concat_ws(" | ", "name_canon", "address_canon")).otherwise(""))


PROFILES = {
    p.name: p
    for p in (
        Profile("unicode", t.clean_unicode, t.name_expanded, t.address_expanded, t.clean_unicode),
        Profile("folded", t.clean_folded, t.name_expanded, t.address_expanded, t.clean_folded),
        Profile("scoped", t.clean_unicode, t.name_expanded, t.address_expanded, t.country_plain),
        Profile("ascii", t.clean_ascii, t.name_expanded, t.address_expanded, t.country_plain),
        Profile("shared", lambda c: t.shared_expanded(t.clean_ascii(c)), t.without_legal, lambda c: c, t.country_plain, lambda c: postal(c, 5, 6), True),
        Profile("exact", t.clean_and, t.without_ending, t.address_shortened, t.country_plain),
        Profile("tail", t.clean_tail, t.name_chained, lambda c: c, t.clean_tail, lambda c: postal_word(t.clean_tail(c))),
        Profile("devanagari", t.clean_devanagari, lambda c: c, lambda c: c, t.col),
    )
}
