"""String similarities of record pairs, and the feature bundles over them.

Levenshtein and the set similarities are built-in expressions. The indel family needs a longest common subsequence,
which Spark lacks: an Arrow UDF over bit-parallel numbers.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkweld.functions import keys as k
from sparkweld.functions import text as t


def levenshtein_ratio(a: Column, b: Column) -> Column:
    """SIM-1: 0 to 100; equal texts 100, one empty 0."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(a == b, 100.0).when((a == "") | (b == ""), 0.0).otherwise(F.lit(100.0) * (1 - F.levenshtein(a, b) / F.greatest(longest, F.lit(1))))


def jaccard(a: Column, b: Column, scale: float = 100.0) -> Column:
    """Jaccard index of two arrays without repeats; 0 where one is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.lit(scale) * both / F.greatest(F.size(a) + F.size(b) - both, F.lit(1)))


def token_jaccard(a: Column, b: Column) -> Column:
    """SIM-2."""
    return jaccard(k.token_set(a), k.token_set(b))


def gram_jaccard(a: Column, b: Column) -> Column:
    """SIM-3."""
    return jaccard(k.char_grams(a), k.char_grams(b))


def word_jaccard(a: Column, b: Column) -> Column:
    """SIM-7: 0 to 1 over raw words."""
    return jaccard(k.word_set(a), k.word_set(b), 1.0)


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, with one bit a character of ``a``."""
    at: dict[str, int] = {}
    for i, ch in enumerate(a):
        at[ch] = at.get(ch, 0) | 1 << i
    full, rest = (1 << len(a)) - 1, (1 << len(a)) - 1
    for ch in b:
        hit = rest & at.get(ch, 0)
        rest = ((rest + hit) | (rest - hit)) & full
    return len(a) - rest.bit_count()


def indel(a: str, b: str) -> float:
    """SIM-4: twice the common subsequence over both lengths, 0 to 100; two empty texts are alike."""
    return 100.0 * 2 * lcs(a, b) / (len(a) + len(b)) if a or b else 100.0


def token_set(a: str, b: str) -> float:
    """SIM-5: the best ratio among the shared words and the shared words with either rest; 0 where one has no words."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    shared, left, right = sorted(x & y), sorted(x - y), sorted(y - x)
    if shared and (not left or not right):
        return 100.0
    s, u, v = " ".join(shared), " ".join(left), " ".join(right)
    gap = 1 if shared else 0
    su, sv = len(s) + gap + len(u), len(s) + gap + len(v)
    apart = len(u) + len(v) - 2 * lcs(u, v)
    best = 100.0 * (1 - apart / (su + sv))
    if shared:
        best = max(best, *(100.0 * (1 - (gap + len(w)) / (len(s) + n)) for w, n in ((u, su), (v, sv))))
    return best


def partial(a: str, b: str) -> float:
    """SIM-6: the best indel ratio of the shorter text with any stretch of its length in the longer, ends included."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 100.0 if not b else 0.0
    best = _best_stretch(a, b)
    return max(best, _best_stretch(b, a)) if len(a) == len(b) else best


def _best_stretch(a: str, b: str) -> float:
    """Stretches that begin or end with a character that ``a`` lacks are no better than shorter ones and are left out."""
    n, at = len(a), {}
    for i, ch in enumerate(a):
        at[ch] = at.get(ch, 0) | 1 << i
    full, best = (1 << n) - 1, 0.0
    for start in range(1 - n, len(b)):
        x, y = max(0, start), min(len(b), start + n)
        if 200.0 * min(n, y - x) / (n + y - x) <= best or b[y - 1 if start <= 0 else x] not in at:
            continue
        rest = full
        for ch in b[x:y]:
            hit = rest & at.get(ch, 0)
            rest = ((rest + hit) | (rest - hit)) & full
        best = max(best, 200.0 * (n - rest.bit_count()) / (n + y - x))
    return best


def _pairwise(f):
    def apply(a: pd.Series, b: pd.Series) -> pd.Series:
        known: dict[tuple[str, str], float] = {}  # of one batch: values repeat, as an S1 record has many candidates
        out = []
        for pair in zip(a, b):
            if (v := known.get(pair)) is None:
                v = known[pair] = f(*pair)
            out.append(v)
        return pd.Series(out, dtype="float64")

    # the UDF is made when it is used: workers import this module without a session
    return lambda a, b: F.pandas_udf(apply, "double")(t.col(a), t.col(b))


indel_ratio = _pairwise(indel)
token_set_ratio = _pairwise(token_set)
partial_ratio = _pairwise(partial)


def _same(a: Column, b: Column) -> Column:
    """SIM-8: both there and equal."""
    return ((a != "") & (a == b)).cast("int")


def composite(names: list[Column], addresses: list[Column], postal: Column, country: Column) -> Column:
    """SIM-11."""
    return 0.60 * F.greatest(*names) + 0.30 * F.greatest(*addresses) + 8.0 * postal + 2.0 * country


def _once(rows: DataFrame, columns: list[Column]) -> DataFrame:
    """``rows`` with more columns, computed in this place and once: a filter or an expression that uses them can't take
    them along to where it stands."""
    return rows.withColumn("_f", F.explode(F.array(F.struct(*columns)))).select("*", "_f.*").drop("_f")


def features(pairs: DataFrame, scale: str = "percent", least_name: float | None = None) -> DataFrame:
    """FEAT-A and FEAT-B: ``pairs`` has the prepared columns of both sides as ``a_*`` and ``b_*``; words and n-grams come
    as sets of hashes that were made once a record.

    ``scale="patched"`` gives Levenshtein and token similarity as 0 to 1 (the latter as token set ratio), grams as they
    are; the composite follows. ``least_name``: pairs whose names are less alike by all three go before addresses are compared.
    """
    if scale not in ("percent", "patched"):
        raise ValueError(f"scale: {scale}")
    c = lambda side, name: F.col(f"{side}_{name}")

    def alike(what: str) -> list[Column]:
        a, b = c("a", f"{what}_canon"), c("b", f"{what}_canon")
        if scale == "percent":
            lev, tok = levenshtein_ratio(a, b), jaccard(c("a", f"{what}_words"), c("b", f"{what}_words"))
        else:
            lev = levenshtein_ratio(a, b) / 100
            tok = F.when((a == "") & (b == ""), 1.0).otherwise(token_set_ratio(a, b) / 100)
        return [lev.alias(f"{what}_lev"), tok.alias(f"{what}_tok"), jaccard(c("a", f"{what}_grams"), c("b", f"{what}_grams")).alias(f"{what}_char")]

    sims = lambda w: [F.col(f"{w}_{s}") for s in ("lev", "tok", "char")]
    more = [_same(c("a", "postal"), c("b", "postal")).alias("postal_match"), _same(c("a", "country_norm"), c("b", "country_norm")).alias("country_match")]
    more += [F.abs(F.length(c("a", f"{w}_canon")) - F.length(c("b", f"{w}_canon"))).alias(f"{w}_len_diff") for w in ("name", "address")]
    more.append(_same(c("a", "name_canon"), c("b", "name_canon")).alias("exact_name"))
    x = _once(pairs, alike("name"))
    if least_name is not None:
        x = x.where(F.greatest(*sims("name")) >= least_name)
    x = _once(x, alike("address") + more)
    return x.withColumn("score", composite(sims("name"), sims("address"), F.col("postal_match"), F.col("country_match")))


FEATURES_A = ("name_lev", "name_tok", "name_char", "address_lev", "address_tok", "address_char", "postal_match", "country_match", "score")
FEATURES_B = (*FEATURES_A, "name_len_diff", "address_len_diff", "exact_name")
FEATURES_C = (
    "name_indel", "name_words", "name_stretch", "address_indel", "address_words", "same_country", "same_postal", "same_name", "same_address",
    "same_start", "word_overlap", "both_addresses",
)


def features_fuzzy(pairs: DataFrame) -> DataFrame:
    """FEAT-C: twelve columns over cleaned names and addresses."""
    n1, n2, a1, a2 = (F.col(c) for c in ("a_name_norm", "b_name_norm", "a_address_norm", "b_address_norm"))
    return pairs.select(
        "*", indel_ratio(n1, n2).alias("name_indel"), token_set_ratio(n1, n2).alias("name_words"), partial_ratio(n1, n2).alias("name_stretch"),
        indel_ratio(a1, a2).alias("address_indel"), token_set_ratio(a1, a2).alias("address_words"), _same(F.col("a_country_norm"), F.col("b_country_norm")).alias("same_country"),
        _same(F.col("a_postal"), F.col("b_postal")).alias("same_postal"), _same(n1, n2).alias("same_name"), _same(a1, a2).alias("same_address"),
        ((n1 != "") & (n2 != "") & (F.left(n1, F.lit(8)) == F.left(n2, F.lit(8)))).cast("int").alias("same_start"),
        word_jaccard(n1, n2).alias("word_overlap"), ((a1 != "") & (a2 != "")).cast("int").alias("both_addresses"),
    )
