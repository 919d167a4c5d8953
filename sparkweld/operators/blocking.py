"""Candidate generation: equi-joins on derived keys, their unions, and caps.

Passes are data. Both sides of any number of passes become rows ``(pass, key, scope)``, so that they are one exchange a
side and one join, which carries ids and keys only; texts are fetched for what is left (``fetch``). A country condition
is part of the key: a blank country that fits all is a second row and no OR. Passes that have a cap cut the reference
side to that many rows a key before the join, so that a hot key cannot multiply: with the order ``(pass, ord)`` the rows
cut there could not have survived the cap. Keys that very many S1 records have are dealt over several tasks. The ordered
passes, whose candidates are thousands a record, are met in blocks (``meet``).
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkweld.functions import keys as k
from sparkweld.operators import meet, score
from sparkweld.storage import spread_join


@dataclass(frozen=True)
class Pass:
    """Keys that must be equal and not empty. ``number`` orders passes."""

    name: str
    keys: tuple[str, ...]
    number: int


# the ten passes over prepared records
PASSES = tuple(
    Pass(name, keys, i + 1)
    for i, (name, keys) in enumerate(
        {
            "name": ("name_norm",),
            "canonical": ("name_canon",),
            "address": ("address_norm",),
            "name_address": ("name_canon", "address_canon"),
            "prefix6": ("prefix6",),
            "prefix4": ("prefix4",),
            "suffix4": ("suffix4",),
            "first4": ("first4",),
            "last4": ("last4",),
            "postal": ("postal",),
        }.items()
    )
)
BY_NAME = {p.name: p for p in PASSES}
# the shared-table order puts four-character prefixes before six
SHARED_ORDER = ("name", "canonical", "address", "name_address", "prefix4", "prefix6", "suffix4", "first4", "last4", "postal")
CAP, PASS_LIMIT, FINAL_CAP = 2000, 300, 500
TOKEN_FREQUENCY, TOKENS_PER_RECORD = 500, 5
COUNTRY = ("none", "equal", "nonempty", "wildcard")


_KEY = ["pass_no", "key", "scope"]


def keyed(records: DataFrame, passes: Iterable[Pass], country: str, refs: bool) -> DataFrame:
    """``(id, ord, pass_no, key, scope)``: a row for each pass whose keys a record has; wildcard countries give two."""
    if country not in COUNTRY:
        raise ValueError(f"country: {country}")
    rows = []
    for p in passes:
        there = F.lit(True)
        for key in p.keys:
            there = there & (F.col(key) != "")
        value = F.col(p.keys[0]) if len(p.keys) == 1 else F.concat_ws("\u001f", *p.keys)
        rows.append(F.struct(F.lit(p.number).alias("pass_no"), F.when(there, value).alias("key")))
    c = F.col("country_norm")
    # the scope * has every reference; an S1 record with a country meets its own and the blank ones
    wild = F.array(c, F.lit("*")) if refs else F.when(c == "", F.array(F.lit("*"))).otherwise(F.array(c, F.lit("")))
    scope = {"none": F.array(F.lit("")), "equal": F.array(c), "nonempty": F.when(c != "", F.array(c)), "wildcard": wild}[country]
    x = records.select(F.col("entity_id").alias("id"), "ord", scope.alias("scopes"), F.explode(F.array(*rows)).alias("p")).where("p.key is not null")
    return x.select("id", "ord", "p.pass_no", "p.key", F.explode("scopes").alias("scope"))


def candidates(s1: DataFrame, refs: DataFrame, passes: Iterable[Pass], country: str = "none", ref_limit: int | None = None) -> DataFrame:
    """Candidate rows ``(s1_id, ref_id, pass_no, ord)`` of several passes by one join.

    ``country``: no condition, equal, equal and not empty, or ``wildcard`` (an empty one on either side fits all).
    ``ref_limit``: keep the first so many references of a key by ``ord``; None: all, where a pass has no cap.
    """
    passes = list(passes)
    a = keyed(s1, passes, country, False).drop("ord").withColumnRenamed("id", "s1_id")
    b = keyed(refs, passes, country, True).withColumnRenamed("id", "ref_id")
    if ref_limit is not None:
        w = Window.partitionBy(*_KEY).orderBy("ord", "ref_id")
        b = b.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= ref_limit).drop("_n")
    met = spread_join(a, b, _KEY, ["s1_id"]) if ref_limit is not None else a.join(b, _KEY)
    return met.select("s1_id", "ref_id", F.col("pass_no").cast("int").alias("pass_no"), "ord")


def block(s1: DataFrame, refs: DataFrame, p: Pass, country: str = "none", ref_limit: int | None = None) -> DataFrame:
    """``candidates`` of one pass."""
    return candidates(s1, refs, [p], country, ref_limit)


def union_distinct(pairs: DataFrame) -> DataFrame:
    """SET-2: distinct ``(s1_id, ref_id)`` of several passes."""
    return pairs.select("s1_id", "ref_id").distinct()


def union_ordered(pairs: DataFrame) -> DataFrame:
    """SET-3: each pair with its first pass."""
    first = pairs.groupBy("s1_id", "ref_id").agg(F.min(F.struct("pass_no", "ord")).alias("f"))
    return first.select("s1_id", "ref_id", "f.pass_no", "f.ord")


def cap(pairs: DataFrame, n: int = CAP) -> DataFrame:
    """TOP-1: the first ``n`` candidates of each S1 record by pass, order and id, with their rank ``position``."""
    w = Window.partitionBy("s1_id").orderBy("pass_no", "ord", "ref_id")
    return pairs.withColumn("position", F.row_number().over(w)).where(F.col("position") <= n)


def _steps(passes: Iterable[Pass] = PASSES, tokens: Column | None = None, seats: bool = False) -> Column:
    """Lookups of the passes in their order; then of each of ``tokens``, as passes of their own if ``seats``."""
    value = lambda p: F.concat_ws("\u001f", *p.keys) if len(p.keys) > 1 else F.col(p.keys[0])
    there = lambda p: F.forall(F.array(*p.keys), lambda x: x != "")
    out = F.array(*(meet.step(p.number, p.number, F.when(there(p), value(p))) for p in passes))
    if tokens is None:
        return out
    after = len(PASSES) + 1
    return F.concat(out, F.transform(tokens, lambda w, i: meet.step(F.lit(after) + i if seats else after, after, w)))


def ordered_counts(s1: DataFrame, refs: DataFrame, n: int | None = CAP, ids: bool = False) -> DataFrame:
    """BLK-34..43, SET-3, TOP-1: ``(s1_id, n, new_pairs, ids)`` of every S1 record: its candidates by the ordered passes,
    the pairs that each pass is the first to find, and with ``ids`` the sorted ids, comma-joined; without ``n`` no cap."""
    return meet.meet(s1, _steps(), refs, _steps(), n, meet.groups(ids), meet.GROUP)


def ordered_candidates(s1: DataFrame, refs: DataFrame, n: int = CAP, truth: DataFrame | None = None, negatives: int | None = None, positives: bool = False) -> DataFrame:
    """BLK-34..43, SET-3, TOP-1: pairs of the ten ordered passes without country, each with its first pass, capped.

    ``truth``: ``label`` is 1 where the pair is true (JN-3); with it ``negatives`` keeps all positives and the first so
    many others of each S1 record (TOP-5), and ``positives`` these only.
    """
    x = meet.meet(s1, _steps(), refs, _steps(), n, meet.pairs(negatives, positives), meet.PAIR, truth)
    return x if truth is not None else x.drop("label")


def scored_candidates(
    s1: DataFrame, refs: DataFrame, n: int = CAP, truth: DataFrame | None = None, least_name: float | None = None, keep=None, patched: bool = False, negatives: int | None = None
) -> DataFrame:
    """``ordered_candidates`` with the columns of ``similarity.features``; what follows ``truth`` is as in ``score.scored``."""
    x = meet.meet(s1, _steps(), refs, _steps(), n, score.scored(least_name, keep, patched, negatives), score.SCHEMA, truth, score.TEXTS)
    return x if truth is not None else x.drop("label")


def matched_records(s1: DataFrame, refs: DataFrame, truth: DataFrame | None = None, n: int = CAP, least_name: float | None = None, keep=None, ids: bool = False) -> DataFrame:
    """``score.MATCHED`` of every S1 record: the pairs of ``scored_candidates`` are counted, or listed, in the blocks."""
    return meet.meet(s1, _steps(), refs, _steps(), n, score.matched(least_name, keep, ids), score.MATCHED, truth, score.TEXTS)


def matched_references(s1: DataFrame, refs: DataFrame, n: int = CAP, least_name: float | None = None, keep=None) -> DataFrame:
    """Distinct ``ref_id`` of the pairs of ``scored_candidates``."""
    return meet.meet(s1, _steps(), refs, _steps(), n, score.matched_references(least_name, keep), "ref_id string", None, score.TEXTS).distinct()


def reached_thresholds(s1: DataFrame, refs: DataFrame, truth: DataFrame, grid: tuple[float, ...], n: int = CAP, trees: score.Trees | None = None) -> DataFrame:
    """``score.REACHED`` of every S1 record: the pairs of ``scored_candidates`` by threshold of score or probability."""
    return meet.meet(s1, _steps(), refs, _steps(), n, score.reached(grid, trees), score.REACHED, truth, score.TEXTS)


def judged_candidates(s1: DataFrame, refs: DataFrame, trees: score.Trees, threshold: float, n: int = CAP) -> DataFrame:
    """ML-3: ``(s1_id, ref_id, probability)`` of the pairs of ``scored_candidates`` that reach ``threshold``."""
    return meet.meet(s1, _steps(), refs, _steps(), n, score.judged(trees, threshold), score.JUDGED, None, score.TEXTS)


def limited_candidates(s1: DataFrame, refs: DataFrame, per_pass: int = PASS_LIMIT, final: int = FINAL_CAP, country: str = "wildcard") -> DataFrame:
    """BLK-24..33, TOP-2, TOP-3: every pass cut to ``per_pass`` rows of each S1 record, then the union to ``final``.

    The first ``per_pass`` of an S1 record are among the first of each key and scope that it meets, which is cut before.
    """
    x = candidates(s1, refs, [Pass(n, BY_NAME[n].keys, i + 1) for i, n in enumerate(SHARED_ORDER)], country, per_pass)
    w = Window.partitionBy("s1_id", "pass_no").orderBy("ord", "ref_id")
    return cap(union_ordered(x.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= per_pass)), final)


def rare_token_candidates(s1: DataFrame, refs: DataFrame, most: int = TOKEN_FREQUENCY, per_record: int = TOKENS_PER_RECORD) -> DataFrame:
    """TOKB-1, BLK-06: pairs of one country that share one of each record's rarest tokens (ties by token)."""
    ref_tokens = refs.select(F.col("entity_id").alias("id"), F.col("country_norm").alias("c"), F.explode("tokens").alias("token"))
    freq = ref_tokens.groupBy("c", "token").agg(F.count("*").alias("f")).where(F.col("f") <= most)

    def rarest(x: DataFrame) -> DataFrame:
        w = Window.partitionBy("id").orderBy("f", "token")
        return x.join(freq, ["c", "token"]).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= per_record).select("id", "c", "token")

    a = rarest(s1.select(F.col("entity_id").alias("id"), F.col("country_norm").alias("c"), F.explode("tokens").alias("token")))
    b = rarest(ref_tokens).withColumnRenamed("id", "ref_id")
    return a.join(b, ["c", "token"]).select(F.col("id").alias("s1_id"), "ref_id").distinct()


def token_candidates(s1: DataFrame, refs: DataFrame, n: int = FINAL_CAP) -> DataFrame:
    """BLK-44: the ordered passes, then candidates by any token, in token order, up to ``n`` in all (no more than ``CAP``)."""
    s1_steps, ref_steps = _steps(tokens=k.informative("name_canon"), seats=True), _steps(tokens=F.col("tokens"))
    return meet.meet(s1, s1_steps, refs, ref_steps, n, meet.pairs(), meet.PAIR).drop("label")


def exact_candidates(s1: DataFrame, refs: DataFrame) -> DataFrame:
    """BLK-21..23, RULE-2: ``(s1_id, ref_id, is_match)``; equal canonical names alone are candidates, not matches."""
    x = candidates(s1, refs, [BY_NAME[p] for p in ("name", "canonical", "name_address")])
    return x.groupBy("s1_id", "ref_id").agg(F.max(F.col("pass_no") != BY_NAME["canonical"].number).alias("is_match"))


def scoped_candidates(s1: DataFrame, refs: DataFrame) -> DataFrame:
    """BLK-16..20, SET-2: cleaned name, canonical name, name with address, and postal word or name start within a country."""
    start = lambda x: x.withColumn("start8", F.when(F.length("name_norm") >= 8, F.left("name_norm", F.lit(8))).otherwise(""))
    a, b = start(s1), start(refs)
    anywhere = [Pass("name", ("name_norm",), 1), Pass("canonical", ("name_canon",), 2), Pass("name_address", ("name_canon", "address_norm"), 3)]
    within = [Pass("postal", ("postal",), 4), Pass("start", ("start8",), 5)]
    return union_distinct(candidates(a, b, anywhere).unionByName(candidates(a, b, within, "nonempty")))


def _scoped_steps() -> Column:
    """Lookups of ``scoped_candidates``."""
    key = lambda *cs: F.when(F.forall(F.array(*cs), lambda x: x != ""), F.concat_ws("\u001f", *cs))
    start = F.when(F.length("name_norm") >= 8, F.left("name_norm", F.lit(8))).otherwise("")
    keys = [key("name_norm"), key("name_canon"), key("name_canon", "address_norm"), key("postal", "country_norm"), key(start, F.col("country_norm"))]
    return F.array(*(meet.step(i, i, k) for i, k in enumerate(keys, 1)))


def fuzzy_candidates(s1: DataFrame, refs: DataFrame, most: int = 1024) -> DataFrame:
    """``scoped_candidates`` with the columns of ``similarity.features_fuzzy``. Postal words, which give most of the pairs,
    deal S1 records into blocks, smaller ones as there is no cap."""
    steps = _scoped_steps()
    return meet.meet(s1, steps, refs, steps, None, score.fuzzy(), score.FUZZY, None, score.FUZZY_TEXTS, ("postal", "country_norm", "name_norm"), most)


def rank_capped(pairs: DataFrame, n: int = CAP) -> DataFrame:
    """TOP-4: the first ``n`` of each S1 record: equal canonical names first, then equal postal keys, then ids."""
    differ = lambda c: (F.col(f"a_{c}") != F.col(f"b_{c}")).cast("int")
    w = Window.partitionBy("s1_id").orderBy(differ("name_canon"), differ("postal"), "ref_id")
    return pairs.withColumn("position", F.row_number().over(w)).where(F.col("position") <= n)


def fetch(pairs: DataFrame, s1: DataFrame, refs: DataFrame) -> DataFrame:
    """JN-1: pairs with the prepared columns of both records as ``a_*`` and ``b_*``; ids that are missing drop out."""
    cols = ("country_norm", "name_norm", "name_canon", "address_norm", "address_canon", "postal", "name_words", "name_grams", "address_words", "address_grams")
    a = s1.select(F.col("entity_id").alias("s1_id"), *(F.col(c).alias(f"a_{c}") for c in cols))
    b = refs.select(F.col("entity_id").alias("ref_id"), *(F.col(c).alias(f"b_{c}") for c in cols))
    return pairs.join(a, "s1_id").join(b, "ref_id")


def linked_truth(truth: DataFrame, s1: DataFrame, refs: DataFrame, passes: tuple[Pass, ...], country: str = "nonempty") -> DataFrame:
    """BLK-07..11: ``truth(s1_id, ref_id)`` with a flag for each pass and ``any_pass``: does its key link the pair?

    Starts from the true pairs, so no candidates are made; the id equalities carry the joins.
    """
    keys = sorted({key for p in passes for key in p.keys})
    a = s1.select(F.col("entity_id").alias("s1_id"), F.col("country_norm").alias("a_c"), *(F.col(c).alias(f"a_{c}") for c in keys))
    b = refs.select(F.col("entity_id").alias("ref_id"), F.col("country_norm").alias("b_c"), *(F.col(c).alias(f"b_{c}") for c in keys))
    x = truth.join(a, "s1_id", "left").join(b, "ref_id", "left")
    scope = F.lit(True) if country == "none" else (F.col("a_c") == F.col("b_c")) & ((F.col("a_c") != "") if country == "nonempty" else F.lit(True))
    flags = []
    for p in passes:
        hit = scope
        for key in p.keys:
            hit = hit & (F.col(f"a_{key}") != "") & (F.col(f"a_{key}") == F.col(f"b_{key}"))
        flags.append(F.coalesce(hit, F.lit(False)).alias(p.name))
    x = x.select("s1_id", "ref_id", *flags)
    found = F.lit(False)
    for p in passes:
        found = found | F.col(p.name)
    return x.withColumn("any_pass", found)
