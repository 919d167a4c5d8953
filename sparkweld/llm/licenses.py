"""License scans: winnowed template fingerprints pick candidates, banded sequence alignment reports them.

Templates are cut into words and winnowed (3-grams, two neighbouring ones a span; of templates under eight words every
3-gram, and a template of one or two words is one gram) into an inverted index from anchor to template and position.
A document's anchors that are in the index are chained by template: hits that follow each other in both texts, up to
half a template's length apart in diagonal, are one candidate stretch, so inserted or left out words do not part it.
Each stretch is aligned with its template word by word in a band around its diagonals, the document's ends being free.
A report has the share of template words that the alignment matches and the span of document words from the first match
to the last.

Templates are a parameter, a dictionary or a table (``templates_of``), and are sent to every task: their texts are
bounded by ``TEMPLATE_BYTES``, beyond which the call fails. Defined cases: null and empty texts have no report; of
overlapping reports that with most matched words stays, then that with the greatest coverage, then the template that is
named first; equal documents get equal reports; rows without an id are scanned too; templates without words never match;
extra columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkweld.llm.common import session, slices, table
from sparkweld.llm.decontaminate import _WORDS, words_of
from sparkweld.llm.license_texts import TEMPLATES
from sparkweld.llm.winnow import Words, anchors, grams, word_hashes

K, W = 3, 2
#: Templates of fewer words are indexed by all their 3-grams.
SHORT = 8
BAND = 6
COVERAGE = 0.8
TEMPLATE_BYTES = 16 << 20


def align(template: list[bytes], words: list[bytes], low: int | None = None, high: int | None = None) -> tuple[int, int, int]:
    """Words of the template that an alignment with ``words`` matches, and the span of words from first match to last.

    Scores: a match 1, a skipped or replaced word -1 (of the template) or -1 (of the document, inside the match); the
    document's ends are free. ``low`` and ``high``: the least and greatest diagonal (position in ``words`` less that in
    the template) that the alignment may use; None: any. Of equal scores that with more matches wins, then the earlier one.
    """
    n, least = len(words), -(10**9)
    # a cell: score, matches, first match (negated, to prefer an earlier one), stop of the last match
    row = [(0, 0, 0, 0)] * (n + 1)
    for i, t in enumerate(template):
        a = 0 if low is None else max(0, i + low)
        b = n if high is None else min(n, i + 1 + high)
        new = [(least, 0, 0, 0)] * (n + 1)
        for j in range(a, b + 1):
            s, m, f, e = row[j]
            best = (s - 1, m, f, e)
            if j:
                s, m, f, e = row[j - 1]
                take = (s + 1, m + 1, f if m else -(j - 1), j) if words[j - 1] == t else (s - 1, m, f, e)
                best = max(best, take)
                if j > a:
                    s, m, f, e = new[j - 1]
                    best = max(best, (s - 1, m, f, e))
            new[j] = best
        row = new
    s, m, f, e = max(row)
    return m, -f, e


def chains(hits: list[tuple[int, int]], length: int) -> list[tuple[int, int]]:
    """``hits`` (position in the document, position in the template), ascending: the least and greatest diagonal of each stretch."""
    most, done, open_ = max(1, length // 2), [], []  # of each: last positions, least and greatest diagonal
    for p, q in hits:
        still = []
        for c in open_:
            (still if p - c[0] <= length - c[1] + most else done).append(c)
        open_ = still
        fit = [c for c in open_ if c[0] < p and c[1] < q and abs(p - q - c[0] + c[1]) <= most]
        if fit:
            c = max(fit, key=lambda c: (c[1], c[0]))
            c[:] = [p, q, min(c[2], p - q), max(c[3], p - q)]
        elif not any(c[0] == p and c[1] == q for c in open_):
            open_.append([p, q, p - q, p - q])
    return sorted({(c[2], c[3]) for c in [*done, *open_]})


class Index:
    """Inverted index of template anchors."""

    def __init__(self, templates: dict[str, str]) -> None:
        self.names = list(templates)
        self.words = [words_of(templates[n].encode()) for n in self.names]
        #: by size of the gram: 0 for winnowed 3-grams, else every gram of that size
        self.at: dict[int, dict[int, list[tuple[int, int]]]] = defaultdict(lambda: defaultdict(list))
        for t, w in enumerate(self.words):
            if not w:
                continue
            h = word_hashes(w)
            if len(w) >= SHORT:
                kind, (pos, value, _, _) = 0, anchors(h, np.full(len(w), len(w)), K, W)
            else:
                kind = min(K, len(w))
                value = grams(h, kind)
                pos = np.arange(len(value))
            for p, v in zip(pos.tolist(), value.tolist()):
                self.at[kind][v].append((t, p))
        self.keys = {kind: np.sort(np.array(list(at), np.uint64)) for kind, at in self.at.items()}

    def hits(self, x: Words) -> dict[tuple[int, int], list[tuple[int, int]]]:
        """Positions in the document and the template, by document and template, ascending."""
        out: dict[tuple[int, int], list[tuple[int, int]]] = defaultdict(list)
        if not len(x.h):
            return out
        for kind, keys in self.keys.items():
            if kind == 0:
                pos, value, _, _ = anchors(x.h, x.ends, K, W)
            else:
                value = grams(x.h, kind)
                pos = np.flatnonzero(np.arange(kind, len(value) + kind) <= x.ends[: len(value)])
                value = value[pos]
            ok = keys[np.minimum(np.searchsorted(keys, value), len(keys) - 1)] == value
            pos, value = pos[ok], value[ok]
            doc = np.searchsorted(x.first + x.count, pos, "right")
            for d, p, v in zip(doc.tolist(), (pos - x.first[doc]).tolist(), value.tolist()):
                for t, q in self.at[kind][v]:
                    out[d, t].append((p, q))
        return out

    def reports(self, texts: list[bytes], coverage: float = COVERAGE, band: int = BAND) -> Iterator[tuple[int, str, int, float, int, int]]:
        """``(document, template, matched words, coverage, start, stop)`` in order of document and start."""
        x = Words(texts, _WORDS)
        found: dict[int, list[tuple[int, float, int, int, int]]] = defaultdict(list)
        for (d, t), hits in sorted(self.hits(x).items()):
            template, n = self.words[t], int(x.count[d])
            wide = min(band, (len(template) - 1) // 2)  # else a short template's neighbouring copies share a band
            for low, high in chains(sorted(hits), len(template)):
                a, b = max(0, low - wide), min(n, high + len(template) + wide)
                words = x.words(int(x.first[d]) + a, int(x.first[d]) + b)
                m, start, stop = align(template, words, low - a - wide, high - a + wide)
                if m and m / len(template) >= coverage:
                    found[d].append((-m, -m / len(template), t, a + start, a + stop))
        for d, all_found in found.items():
            taken: list[tuple[int, int, int, float, int]] = []  # spans that don't overlap, by start
            for m, share, t, start, stop in sorted(set(all_found)):
                i = bisect_left(taken, (start,))
                if (i == 0 or taken[i - 1][1] <= start) and (i == len(taken) or taken[i][0] >= stop):
                    insort(taken, (start, stop, -m, -share, t))
            for start, stop, m, share, t in taken:
                yield d, self.names[t], m, share, start, stop


def templates_of(rows: DataFrame, name_col: str = "license", text_col: str = "text") -> dict[str, str]:
    """Templates from a table, one row each, in order of their names; refused over ``TEMPLATE_BYTES`` of text."""
    some = rows.where(F.col(name_col).isNotNull() & F.col(text_col).isNotNull())
    size = some.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0))).first()[0]
    if size > TEMPLATE_BYTES:
        raise ValueError(f"{size} bytes of templates; {TEMPLATE_BYTES} at most")
    return {r[0]: r[1] for r in sorted(some.select(name_col, text_col).collect())}


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, coverage: float = COVERAGE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, license, matched, coverage, start, stop)``: a row a report, spans in words of the document."""
    session(docs.sparkSession)
    if sum(len(t.encode()) for t in templates.values()) > TEMPLATE_BYTES:
        raise ValueError(f"over {TEMPLATE_BYTES} bytes of templates")
    sent = docs.sparkSession.sparkContext.broadcast(dict(templates))

    def apply(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(sent.value)
        for rows, texts in slices(batches):
            found = list(index.reports(texts, coverage))
            if found:
                d, *rest = zip(*found)
                kinds = (pa.string(), pa.int32(), pa.float64(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(d, pa.int64())), *(pa.array(x, k) for x, k in zip(rest, kinds))], ["id", "license", "matched", "coverage", "start", "stop"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(apply, f"id {kind}, license string, matched int, coverage double, start int, stop int")


def query(spark, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
