"""Byte-level BPE encoding and decoding by a global shuffle of distinct words.

Texts are split into pre-tokens once. Documents are taken in blocks of some megabytes; a block keeps the positions of its
pre-tokens as numbers into its own list of distinct words, the commonest first, and both are written to one table under
the block's own name. From there the words alone are shuffled, by hash, so that every occurrence of a word from all blocks
meets in one task, which encodes it once. The ids go back to their block, meet the positions there and give each
document's ids; decoding looks up the ids of each distinct word in the token-byte table and reassembles by the same
positions. A very common word costs one entry a block and not one an occurrence.

Words and positions travel as packed columns. A long text is split in pieces, cut where the pattern begins a token
whatever comes before (known for the pattern in ``PLAIN``; for others a text is one piece), so a worker holds four bytes
for each of its pre-tokens beside the text and not an object.

Defined cases: a null text encodes as the empty one, which has no ids; texts that hold the names of special tokens are
ordinary text; repeated rows keep their rows; extra columns are ignored unless named in ``keep``; a result whose name is
a kept column's gets a trailing underscore.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkweld.llm.common import fresh, save, session, slices, table

#: Bytes of text in a block, and of a piece of a longer text that is split at once.
BLOCK, PIECE = 32 << 20, 1 << 20


def load_ranks(path: str) -> dict[bytes, int]:
    """A rank file: base64 of the token's bytes, a blank and the id, one token a line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def pack(x: np.ndarray) -> bytes:
    """Unsigned numbers as four byte planes, compressed."""
    return zstandard.compress(np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), 3)


def unpack(data: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(4, -1).T).view("<u4").ravel()


_BLANK = r" \t\n\r\x0b\x0c"
#: For one pattern, the same with the standard library's classes: equal on texts whose characters beyond ASCII are letters.
PLAIN = {
    r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""": (
        rf"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?[0-9]+| ?(?:[^\w{_BLANK}]|_)+|[{_BLANK}]+(?![^{_BLANK}])|[{_BLANK}]+"
    )
}


class Splitter:
    """Splits texts by a pattern, through the faster of two engines where both give the same."""

    #: Where a pattern of ``PLAIN`` begins a token: a blank between letters.
    SEAM = re.compile(rb"[A-Za-z](?= [A-Za-z])")

    def __init__(self, pattern: str) -> None:
        self.full = regex.compile(pattern).findall
        self.plain = re.compile(PLAIN[pattern]).findall if pattern in PLAIN else None
        self.letter = regex.compile(r"\p{L}").match
        self.letters: dict[str, bool] = {}

    def __call__(self, text: str) -> list[str]:
        if self.plain is None:
            return self.full(text)
        if not text.isascii():
            for ch in set(text):
                if ch > "\x7f" and not self.is_letter(ch):
                    return self.full(text)
        return self.plain(text)

    def pieces(self, text: bytes) -> Iterator[list[str]]:
        at = 0
        while self.plain is not None and len(text) - at > PIECE and (seam := self.SEAM.search(text, at + PIECE)):
            yield self(text[at : seam.end()].decode("utf-8"))
            at = seam.end()
        yield self((text[at:] if at else text).decode("utf-8"))

    def is_letter(self, ch: str) -> bool:
        if (known := self.letters.get(ch)) is None:
            known = self.letters[ch] = ch.isalpha() and self.letter(ch) is not None
        return known


WORDS, COUNTS, DOCUMENTS = 0, 1, 2
_SHAPE = "block long, kind int, bucket int, start int, sizes binary, data binary"
_KIND = pa.schema([("block", pa.int64()), ("kind", pa.int32()), ("bucket", pa.int32()), ("start", pa.int32()), ("sizes", pa.binary()), ("data", pa.binary())])


def _by_count(counts: np.ndarray) -> np.ndarray:
    """Numbers of a block's words by rank: the commonest first, so that positions pack well."""
    return np.argsort(-counts, kind="stable")


def _blocks(pattern: str, buckets: int):
    """Rows of blocks: the words of each bucket, numbered from ``start`` on; the count of each word, which gives its rank;
    and documents, their columns as an Arrow message and the rank of the word at each position."""

    def rows_of(block: int, held: list[pa.RecordBatch], ranks: list[np.ndarray], number: dict[str, int]) -> pa.RecordBatch:
        words = list(number)
        hashes = np.fromiter((xxhash.xxh3_64_intdigest(w.encode()) for w in words), np.uint64, len(words))
        bucket = (hashes % np.uint64(buckets)).astype(np.int64)
        counts = np.bincount(np.concatenate(ranks), minlength=len(words))
        by_word = np.array(sorted(range(len(words)), key=words.__getitem__), np.int64)
        laid = by_word[np.argsort(bucket[by_word], kind="stable")]
        rank = np.empty(len(words), np.uint32)
        rank[laid[_by_count(counts[laid])]] = np.arange(len(words), dtype=np.uint32)
        out, kind = [], bucket[laid]
        edges = [0, *(np.flatnonzero(np.diff(kind)) + 1).tolist(), len(words)] if words else []
        for at, stop in zip(edges, edges[1:]):
            some = [words[i].encode() for i in laid[at:stop].tolist()]
            out.append((block, WORDS, int(kind[at]), at, pack(np.array([len(w) for w in some])), zstandard.compress(b"".join(some), 9)))
        out.append((block, COUNTS, -1, len(words), pack(counts[laid]), b""))
        d = 0
        for rows in held:
            mine = ranks[d : d + len(rows)]
            d += len(rows)
            head = rows.select([n for n in rows.schema.names if n != "text"])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, head.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                w.write_batch(head)
            sizes = pack(np.array([len(r) for r in mine]))
            body = len(sizes).to_bytes(4, "little") + sizes + pack(rank[np.concatenate(mine)])
            out.append((block, DOCUMENTS, -1, 0, sink.getvalue().to_pybytes(), body))
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _KIND)], schema=_KIND)

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        split, block = Splitter(pattern), TaskContext.get().partitionId() << 32
        held, ranks, size, number = [], [], 0, defaultdict(int)
        number.default_factory = number.__len__
        for rows, texts in slices(batches):
            held.append(rows)
            for t in texts:
                size += len(t)
                parts = [np.fromiter(map(number.__getitem__, p), np.uint32, len(p)) for p in split.pieces(t)]
                ranks.append(parts[0] if len(parts) == 1 else np.concatenate(parts))
            if size >= BLOCK:
                yield rows_of(block, held, ranks, number)
                held, ranks, size, block = [], [], 0, block + 1
                number.clear()
        if held:
            yield rows_of(block, held, ranks, number)

    return scan


def _cut(data: bytes, sizes: np.ndarray) -> list[bytes]:
    ends = np.cumsum(sizes.astype(np.int64)).tolist()
    return [data[a:b] for a, b in zip([0, *ends], ends)]


def _encode(ranks, pattern: str):
    """Rows of words become rows of ids, every distinct word encoded once a task."""

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        encode = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks.value, special_tokens={})._encode_single_piece
        known: dict[bytes, list[int]] = {}
        for b in batches:
            sizes, data = [], []
            for lens, packed in zip(b.column(4).to_pylist(), b.column(5).to_pylist()):
                ids = []
                for w in _cut(zstandard.decompress(packed), unpack(lens)):
                    if (x := known.get(w)) is None:
                        if len(known) >= 1_000_000:  # a task's words can outgrow memory: those seen last stay
                            known.clear()
                        x = known[w] = encode(w)
                    ids.append(x)
                sizes.append(pack(np.fromiter(map(len, ids), np.int64, len(ids))))
                data.append(pack(np.array([i for x in ids for i in x], np.int64)))
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(sizes, pa.binary()), pa.array(data, pa.binary())], schema=_KIND)

    return scan


def _assemble(token_bytes, want_ids: bool, digest: bool):
    """Sorted rows of a block: first its words' ids, then these by rank, then its documents."""

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, ready = [], None
        for b in batches:
            for _, kind, _, start, first, data in zip(*(c.to_pylist() for c in b.columns)):
                if kind == WORDS:
                    parts.append((start, unpack(first), unpack(data)))
                elif kind == COUNTS:
                    parts.sort(key=lambda p: p[0])
                    if sum(len(p[1]) for p in parts) != start:
                        raise RuntimeError("a block lacks words")
                    ready, parts = _tables(parts, _by_count(unpack(first).astype(np.int64)), token_bytes.value, digest), []
                else:
                    yield _documents(first, data, ready, want_ids, digest)

    return scan


def _tables(parts: list, seat: np.ndarray, token_bytes: list[bytes], digest: bool) -> tuple:
    """By rank: the number of ids, where they begin in the list of all, that list, and with ``digest`` their decimal text and bytes."""
    sizes = np.concatenate([np.zeros(0, np.int64), *(p[1].astype(np.int64) for p in parts)])
    ids = np.concatenate([np.zeros(0, np.int64), *(p[2].astype(np.int64) for p in parts)])
    begins = np.cumsum(sizes) - sizes
    sizes, begins = sizes[seat], begins[seat]
    if not digest:
        return sizes, begins, ids, None, None
    flat = ids.tolist()
    text = [b"%d" % i for i in flat]
    raw = [token_bytes[i] for i in flat]  # the join with the token-byte table, once a distinct word
    spans = list(zip(begins.tolist(), (begins + sizes).tolist()))
    return sizes, begins, ids, [b" ".join(text[a:b]) for a, b in spans], [b"".join(raw[a:b]) for a, b in spans]


def _sha(parts: list[bytes], own: np.ndarray, gap: bytes) -> str:
    """SHA-256 of the words' parts with a gap between, some at a time."""
    out, step = hashlib.sha256(), 1 << 16
    for i in range(0, len(own), step):
        out.update((gap if i else b"") + gap.join(map(parts.__getitem__, own[i : i + step].tolist())))
    return out.hexdigest()


def _documents(head: bytes, data: bytes, ready: tuple, want_ids: bool, digest: bool) -> pa.RecordBatch:
    rows = pa.ipc.open_stream(head).read_all().combine_chunks().to_batches()
    n = int.from_bytes(data[:4], "little")
    sizes, at = unpack(data[4 : 4 + n]).astype(np.int64), unpack(data[4 + n :])
    lens, begins, ids, text, raw = ready
    ends = np.cumsum(sizes)
    total = np.concatenate(([0], np.cumsum(lens[at])))
    cols = [*rows[0].columns, pa.array(total[ends] - total[ends - sizes])]
    if want_ids:
        index = np.repeat(begins[at] - total[:-1], lens[at]) + np.arange(total[-1])
        cols.append(pa.ListArray.from_arrays(pa.array(np.concatenate(([0], total[ends])).astype(np.int32)), pa.array(ids[index].astype(np.int32))))
    if digest:
        each = [at[x:y] for x, y in zip((ends - sizes).tolist(), ends.tolist())]
        cols += [pa.array([_sha(text, own, b" ") for own in each], pa.string()), pa.array([_sha(raw, own, b"") for own in each], pa.string())]
    return pa.RecordBatch.from_arrays(cols, [f"c{i}" for i in range(len(cols))])


def encode(
    docs: DataFrame, ranks: dict[bytes, int], pattern: str, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text", ids: bool = True, digest: bool = False
) -> DataFrame:
    """``keep`` columns and ``n_tokens`` of each document, with ``ids`` its ids, and with ``digest`` SHA-256 of the ids'
    decimal text (``ids_sha256``) and of the decoded bytes (``decoded_sha256``)."""
    spark = session(docs.sparkSession)
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sc = spark.sparkContext
    sent = sc.broadcast(ranks)  # bounded by the vocabulary
    names = [None] * (max(ranks.values(), default=-1) + 1)
    for token, i in ranks.items():
        names[i] = token
    token_bytes = sc.broadcast(names)
    kept = docs.select(*keep)
    rows = docs.select(*(F.col(c).alias(f"k{i}") for i, c in enumerate(keep)), F.col(text_col).alias("text"))
    blocks = save(rows.mapInArrow(_blocks(pattern, buckets), _SHAPE), "blocks", "kind")
    cols = _KIND.names
    words = blocks.where(F.col("kind") == WORDS).select(*cols).repartition(buckets, "bucket").mapInArrow(_encode(sent, pattern), _SHAPE)
    met = words.unionByName(blocks.where(F.col("kind") != WORDS).select(*cols)).repartition(buckets, "block").sortWithinPartitions("block", "kind")
    more = [("n_tokens", "long")] + ([("ids", "array<int>")] if ids else []) + ([("ids_sha256", "string"), ("decoded_sha256", "string")] if digest else [])
    kinds = [f.dataType.simpleString() for f in kept.schema.fields] + [t for _, t in more]
    out = met.mapInArrow(_assemble(token_bytes, ids, digest), ", ".join(f"c{i} {t}" for i, t in enumerate(kinds)))
    return out.toDF(*keep, *(fresh(kept, n) for n, _ in more))


def decode(rows: DataFrame, ranks: dict[bytes, int], ids_col: str = "ids") -> DataFrame:
    """``rows`` with a binary column ``decoded``: the bytes of their ids, by a join with the token-byte table.

    A null list decodes to null; an id that the table lacks is left out, as a table join would; where ``rows`` have a
    column ``decoded`` the new one gets a trailing underscore.
    """
    name = fresh(rows, "decoded")
    spark = session(rows.sparkSession)
    names = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, i in ranks.items():
        names[i] = token
    sent = spark.sparkContext.broadcast(names)

    def join(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for b in batches:
            lists = b.column(b.schema.names.index(ids_col)).to_pylist()
            out = [None if x is None else b"".join(known[i] for i in x if i is not None and 0 <= i < len(known)) for x in lists]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.binary())], [*b.schema.names, name])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(join, f"{fields}, `{name}` binary")


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return encode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN, ids=False, digest=True)
