"""DuckDB SQL of the parts that queries share. Tables, limits and pass order are written out here and not taken from the
operators, so that a wrong value there shows.

Queries with SQL use the ASCII profile, as DuckDB has no compatibility normalisation and counts bytes in ``levenshtein``,
or the ``shared`` and ``exact`` profiles, which are ASCII too.
"""

from __future__ import annotations

# Abbreviations, legal words and stopwords that the canonical forms and tokens are defined by.
_NAME_WORDS = {"pvt": "private", "ltd": "limited", "corp": "corporation", "inc": "incorporated", "co": "company", "llc": "limited liability company", "llp": "limited liability partnership"}
_ADDRESS_WORDS = {
    "st": "street", "rd": "road", "ave": "avenue", "av": "avenue", "blvd": "boulevard", "dr": "drive", "ln": "lane", "hwy": "highway", "ctr": "center", "ct": "court", "pl": "place",
    "pkwy": "parkway", "ste": "suite",
}
_SHARED_WORDS = {"pvt": "private", "ltd": "limited", "corp": "corporation", "inc": "incorporated", "co": "company", **_ADDRESS_WORDS}
_LEGAL_WORDS = ("private", "limited", "incorporated", "corporation", "company", "llc", "llp")
_LEGAL_ENDINGS = "private limited|pvt ltd|pvt limited|private ltd|limited|ltd|llp|incorporated|inc|corporation|corp|company|co"
_ADDRESS_SHORT = {"road": "rd", "street": "st", "avenue": "ave", "apartment": "apt", "building": "bldg", "highway": "hwy", "lane": "ln", "sector": "sec"}
_STOPWORDS = ("the", "and", "of", "for", "in", "at", "on", "private", "limited", "incorporated", "corporation", "company", "llc", "llp")
# The keys of the passes, in the order of the ordered cap and of the limit a pass.
KEYS = {
    "name": ("name_norm",), "canonical": ("name_canon",), "address": ("address_norm",), "name_address": ("name_canon", "address_canon"), "prefix6": ("prefix6",), "prefix4": ("prefix4",),
    "suffix4": ("suffix4",), "first4": ("first4",), "last4": ("last4",), "postal": ("postal",),
}
ORDER = ("name", "canonical", "address", "name_address", "prefix6", "prefix4", "suffix4", "first4", "last4", "postal")
LIMITED_ORDER = ("name", "canonical", "address", "name_address", "prefix4", "prefix6", "suffix4", "first4", "last4", "postal")
CAP, PASS_LIMIT, FINAL_CAP, NEGATIVES, TOKEN_FREQUENCY, TOKENS_PER_RECORD = 2000, 300, 500, 25, 500, 5


def _swap(c: str, table: dict[str, str]) -> str:
    case = "CASE x " + " ".join(f"WHEN '{a}' THEN '{v}'" for a, v in table.items()) + " ELSE x END"
    return f"array_to_string(list_transform(string_split({c}, ' '), lambda x: {case}), ' ')"


def _list(xs) -> str:
    return "(" + ", ".join(f"'{x}'" for x in xs) + ")"


def clean(c: str) -> str:
    return f"trim(regexp_replace(lower({c}), '[^a-z0-9]+', ' ', 'g'))"


def clean_and(c: str) -> str:
    return clean(f"replace(lower({c}), '&', ' and ')")


def shared(c: str) -> str:
    return _swap(clean(c), _SHARED_WORDS)


def without_legal(c: str) -> str:
    return f"array_to_string(list_filter(string_split({c}, ' '), lambda x: x NOT IN {_list(_LEGAL_WORDS)}), ' ')"


def without_ending(c: str) -> str:
    return f"regexp_replace({c}, '( ({_LEGAL_ENDINGS}))+$', '')"


def shortened(c: str) -> str:
    out = f"' ' || {clean_and(c)} || ' '"
    for full, short in _ADDRESS_SHORT.items():
        out = f"replace({out}, ' {full} ', ' {short} ')"
    return f"trim(regexp_replace({out}, ' +', ' ', 'g'))"


def informative(c: str) -> str:
    return f"list_filter(string_split({c}, ' '), lambda x: length(x) >= 3 AND x NOT IN {_list(_STOPWORDS)})"


def postal(c: str, least: int, most: int) -> str:
    return rf"coalesce(regexp_extract_all(' ' || regexp_replace({c}, '[^\p{{L}}\p{{N}}_]', '  ', 'g') || ' ', ' (\p{{Nd}}{{{least},{most}}}) ', 1)[-1], '')"


# the records of ``fixtures.documents`` and ``fixtures.parts``
DOCS = r"""w AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(n_chars, 0) AS n_chars, string_split(trim(regexp_replace(lower(coalesce(text, '')), '\s+', ' ', 'g')), ' ') AS w FROM documents),
rec AS (SELECT 'S' || (doc_id % 3 + 1) || '-' || doc_id AS entity_id, doc_id % 3 + 1 AS src, doc_id AS num,
  trim(CASE WHEN len(w) >= 6 AND doc_id // 3 % 5 >= 3 THEN array_to_string(w[1:2], ' ') || (['zq ', 'zqxjkv '])[doc_id // 3 % 5 - 2] || array_to_string(w[3:6], ' ') ELSE array_to_string(w[1:6], ' ') END
    || (['', '', '', '', ' Pvt. Ltd.', ' Private Limited', ' & Co.', ' Inc', ' Incorporated', ' Corp.', ' LLC', ' Limited'])[doc_id // 3 % 12 + 1]) AS name,
  trim(array_to_string(w[7:16], ' ') || (['', ' St.', ' Street', ' Rd', ' Road', ' Ave.', ' Avenue', ' Hwy', ' Highway', ' Lane', ' Building', ' Sector'])[doc_id // 3 % 12 + 1]
    || CASE WHEN doc_id % 4 = 3 THEN '' ELSE ', ' || (10000 + n_chars * 7919 % 90000) END) AS address,
  CASE WHEN doc_id % 10 = 9 THEN '' ELSE lang END AS country, CASE WHEN len(w) < 17 THEN '' ELSE lang || ':' || array_to_string(w[17:40], ' ') END AS rest FROM w)"""
PARTS = """rec AS (SELECT 'S' || (p_partkey % 3 + 1) || '-' || p_partkey AS entity_id, p_partkey % 3 + 1 AS src, p_partkey AS num, p_name AS name,
  p_brand || ' ' || p_type AS address, '' AS country FROM part)"""
_NORMS = {
    "ascii": (clean("name"), clean("address"), _swap("name_norm", _NAME_WORDS), _swap("address_norm", _ADDRESS_WORDS), "name_canon", "name_canon", (4, 10)),
    "shared": (shared("name"), shared("address"), without_legal("name_norm"), "address_norm", "coalesce(nullif(name_canon, ''), name_norm)", "name_norm", (5, 6)),
    "exact": (clean_and("name"), clean_and("address"), without_ending("name_norm"), shortened("address"), "name_canon", "name_canon", (4, 10)),
}


def prepared(profile: str = "ascii") -> str:
    """Relations ``p`` (all prepared records), ``a`` (S1) and ``r`` (references)."""
    name, address, name_canon, address_canon, key, tokens, (least, most) = _NORMS[profile]
    return f"""n0 AS (SELECT *, {name} AS name_norm, {address} AS address_norm, lower(trim(country)) AS country_norm FROM rec),
n1 AS (SELECT *, {name_canon} AS name_canon, {address_canon} AS address_canon FROM n0),
n2 AS (SELECT *, {informative(tokens)} AS toks, replace({key}, ' ', '') AS packed, {postal('address', least, most)} AS postal FROM n1),
p AS (SELECT entity_id, src, num, src * 1099511627776 + num AS ord, country_norm, name_norm, name_canon, address_norm, address_canon, postal, list_distinct(toks) AS tokens, toks,
  packed[1:6] AS prefix6, packed[1:4] AS prefix4, right(packed, 4) AS suffix4, coalesce(toks[1], '')[1:4] AS first4, coalesce(toks[-1], '')[1:4] AS last4,
  CASE WHEN name_canon <> '' AND address_canon <> '' THEN name_canon || ' | ' || address_canon ELSE '' END AS name_address FROM n2),
a AS (SELECT * FROM p WHERE src = 1), r AS (SELECT * FROM p WHERE src <> 1)"""


TRUTH = """s1 AS (SELECT rest, min(num) AS num FROM rec WHERE src = 1 AND rest <> '' GROUP BY rest),
truth AS (SELECT x.entity_id AS s1_id, y.entity_id AS ref_id FROM s1 JOIN rec x ON x.num = s1.num JOIN rec y ON y.rest = s1.rest AND y.src <> 1)"""
HEAD = f"WITH {DOCS},\n{prepared()}"
_COUNTRY = {
    "none": "", "equal": " AND a.country_norm = r.country_norm", "nonempty": " AND a.country_norm = r.country_norm AND a.country_norm <> ''",
    "wildcard": " AND (a.country_norm = r.country_norm OR a.country_norm = '' OR r.country_norm = '')",
}


def join(keys: tuple[str, ...], country: str = "none", number: int = 0) -> str:
    on = " AND ".join(f"a.{x} = r.{x} AND a.{x} <> ''" for x in keys) + _COUNTRY[country]
    return f"SELECT a.entity_id AS s1_id, r.entity_id AS ref_id, {number} AS pass_no, r.ord FROM a JOIN r ON {on}"


def passes(country: str = "none", order: tuple[str, ...] = ORDER) -> str:
    return "passes AS (" + " UNION ALL ".join(join(KEYS[n], country, i + 1) for i, n in enumerate(order)) + ")"


FIRST = "firsts AS (SELECT s1_id, ref_id, min(pass_no) AS pass_no, any_value(ord) AS ord FROM passes GROUP BY s1_id, ref_id)"


def capped(n: int = CAP) -> str:
    return f"capped AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY s1_id ORDER BY pass_no, ord, ref_id) AS position FROM firsts) WHERE position <= {n})"


def candidates(n: int = CAP, records: str = DOCS) -> str:
    return f"WITH {records},\n{prepared()},\n{passes()},\n{FIRST},\n{capped(n)}"


def limited(per_pass: int = PASS_LIMIT, final: int = FINAL_CAP) -> str:
    cut = f"cut AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY s1_id, pass_no ORDER BY ord, ref_id) AS n FROM passes) WHERE n <= {per_pass})"
    firsts = "firsts AS (SELECT s1_id, ref_id, min(pass_no) AS pass_no, any_value(ord) AS ord FROM cut GROUP BY 1, 2)"
    return f"WITH {DOCS},\n{prepared('shared')},\n{passes('wildcard', LIMITED_ORDER)},\n{cut},\n{firsts},\n{capped(final)} SELECT s1_id, ref_id, pass_no, position FROM capped"


def _lev(x: str, y: str) -> str:
    return f"CASE WHEN {x} = {y} THEN 100.0::DOUBLE WHEN {x} = '' OR {y} = '' THEN 0.0::DOUBLE ELSE 100.0::DOUBLE * (1 - levenshtein({x}, {y})::DOUBLE / greatest(length({x}), length({y}))) END"


def _jac(x: str, y: str) -> str:
    return f"CASE WHEN len({x}) = 0 OR len({y}) = 0 THEN 0.0::DOUBLE ELSE 100.0::DOUBLE * len(list_intersect({x}, {y})) / len(list_distinct(list_concat({x}, {y}))) END"


def grams(c: str) -> str:
    x = f"replace({c}, ' ', '')"
    return f"CASE WHEN {x} = '' THEN []::VARCHAR[] WHEN length({x}) < 3 THEN [{x}] ELSE list_distinct(list_transform(range(1, length({x}) - 1), lambda i: substr({x}, i, 3))) END"


_SIDES = ", ".join(f"{s}.{c} AS {s}_{c}" for s in "ab" for c in ("name_canon", "address_canon", "postal", "country_norm"))
_FEATURES = f"""f0 AS (SELECT c.s1_id, c.ref_id, c.pass_no, c.ord, {_SIDES} FROM capped c JOIN a ON a.entity_id = c.s1_id JOIN r b ON b.entity_id = c.ref_id),
f1 AS (SELECT *, {", ".join(f"list_distinct({informative(f'{s}_{w}_canon')}) AS {s}_{w}_t, {grams(f'{s}_{w}_canon')} AS {s}_{w}_g" for s in "ab" for w in ("name", "address"))} FROM f0),
f2 AS (SELECT *, {", ".join(f"{_lev(f'a_{w}_canon', f'b_{w}_canon')} AS {w}_lev, {_jac(f'a_{w}_t', f'b_{w}_t')} AS {w}_tok, {_jac(f'a_{w}_g', f'b_{w}_g')} AS {w}_char" for w in ("name", "address"))},
  CAST(a_postal <> '' AND a_postal = b_postal AS INTEGER) AS postal_match, CAST(a_country_norm <> '' AND a_country_norm = b_country_norm AS INTEGER) AS country_match,
  abs(length(a_name_canon) - length(b_name_canon)) AS name_len_diff, abs(length(a_address_canon) - length(b_address_canon)) AS address_len_diff,
  CAST(a_name_canon <> '' AND a_name_canon = b_name_canon AS INTEGER) AS exact_name FROM f1),
feats AS (SELECT *, greatest(name_lev, name_tok, name_char) AS best_name, greatest(address_lev, address_tok, address_char) AS best_address,
  0.6::DOUBLE * greatest(name_lev, name_tok, name_char) + 0.3::DOUBLE * greatest(address_lev, address_tok, address_char) + 8 * postal_match + 2 * country_match AS score FROM f2),
ruled AS (SELECT * FROM feats WHERE best_name >= 95 OR (best_name >= 88 AND best_address >= 70) OR (best_name >= 85 AND postal_match = 1))"""
CAND = candidates()
FULL = f"{CAND},\n{_FEATURES},\n{TRUTH}"
ENT = """tp AS (SELECT u.s1_id, count(*) AS tp FROM ruled u JOIN (SELECT DISTINCT * FROM truth) t USING (s1_id, ref_id) GROUP BY 1),
np AS (SELECT s1_id, count(*) AS np FROM ruled GROUP BY 1), nt AS (SELECT s1_id, count(DISTINCT ref_id) AS nt FROM truth GROUP BY 1),
ent AS (SELECT a.entity_id AS s1_id, coalesce(tp, 0) AS tp, coalesce(np, 0) - coalesce(tp, 0) AS fp, coalesce(nt, 0) - coalesce(tp, 0) AS fn,
  CASE WHEN coalesce(np, 0) + coalesce(nt, 0) = 0 THEN 1.0::DOUBLE WHEN coalesce(tp, 0) = 0 THEN 0.0::DOUBLE
    ELSE 1.25::DOUBLE * tp / (1.25::DOUBLE * tp + 0.25::DOUBLE * (nt - tp) + (np - tp)) END AS f05
  FROM a LEFT JOIN tp ON tp.s1_id = a.entity_id LEFT JOIN np ON np.s1_id = a.entity_id LEFT JOIN nt ON nt.s1_id = a.entity_id)"""
LABELLED = "l AS (SELECT c.*, CAST(t.s1_id IS NOT NULL AS INTEGER) AS label FROM capped c LEFT JOIN (SELECT DISTINCT * FROM truth) t USING (s1_id, ref_id))"
RARE = f"""tk AS (SELECT entity_id, src, country_norm AS c, unnest(tokens) AS token FROM p),
freq AS (SELECT c, token, count(*) AS f FROM tk WHERE src <> 1 GROUP BY 1, 2 HAVING count(*) <= {TOKEN_FREQUENCY}),
rare AS (SELECT * FROM (SELECT tk.*, row_number() OVER (PARTITION BY entity_id ORDER BY f, token) AS n FROM tk JOIN freq USING (c, token)) WHERE n <= {TOKENS_PER_RECORD})"""
#: Name, canonical name, name with address anywhere; postal key and name start within a country: over the ASCII profile.
SCOPED = """start AS (SELECT a.entity_id AS s1_id, r.entity_id AS ref_id FROM a JOIN r ON (a.name_norm = r.name_norm AND a.name_norm <> '')
  UNION SELECT a.entity_id, r.entity_id FROM a JOIN r ON a.name_canon = r.name_canon AND a.name_canon <> ''
  UNION SELECT a.entity_id, r.entity_id FROM a JOIN r ON a.name_canon = r.name_canon AND a.address_norm = r.address_norm AND a.name_canon <> '' AND a.address_norm <> ''
  UNION SELECT a.entity_id, r.entity_id FROM a JOIN r ON a.postal = r.postal AND a.postal <> '' AND a.country_norm = r.country_norm AND a.country_norm <> ''
  UNION SELECT a.entity_id, r.entity_id FROM a JOIN r ON a.name_norm[1:8] = r.name_norm[1:8] AND length(a.name_norm) >= 8 AND length(r.name_norm) >= 8 AND a.country_norm = r.country_norm AND a.country_norm <> '')"""
