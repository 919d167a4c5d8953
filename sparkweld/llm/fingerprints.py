"""Document fingerprints: invertible Bloom lookup sketches, in DataFrame operations only.

A text is cut into paragraphs: runs of at most eight words that end with their sentence or line. The first sixteen words
give runs of two words beside, so that short texts have several too. Each distinct run is a 64-bit digest. The set of
digests goes into a sketch: each digest is added to one cell of each of three subtables, a cell being a count, the XOR of
its digests and the XOR of their check hashes. Sketches of equal size subtract cell by cell. Peeling then recovers the
digests in which two sets differ: a cell that holds a single digest, which its check hash shows, gives the digest up, and
it is taken out of its other cells. A step peels one subtable, where a digest has just one cell, so that nothing is taken
out twice.

* ``fingerprint`` is made of the digests' leading 32 bits: their number and the sketch of ``BASE`` cells a subtable, its
  cells that aren't empty written out. It is bounded, whatever the text's length.
* The likeness of two fingerprints is a function of the two strings: the sketches subtract and are peeled. Where nothing
  is left, the number of differing digests is exact; else what is left is estimated from the squares of the remaining
  counts. The likeness is the Jaccard index that follows from both sizes and that number. As sketches are sums, a text and
  its edited version are subtracted while their cells are added up, which is the same as to subtract the strings.
* The digests in which a text and its edited version differ are recovered whole for every document: from sketches that
  are sized for the difference that the fingerprints show, retried twice as large with other hashes on failure.

A document's next one is found from the order of ids and text hashes alone, sorted by range; only the head of the next
text that the edit needs moves to the document. Nothing depends on the number of rows with one id or none, and rows that
are equal in id and text are one class.

Defined cases: a null text is the empty text; two texts without paragraphs are alike (1.0), one without and one with are
not (0.0); the paragraphs' order, repeats and blank space between them do not count; rows with equal ids are ordered by
a hash of the text; rows without an id come last; of rows equal in id and text each but the last is followed by its
equal; the only row is its own next document; an empty table gives an empty one; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkweld.llm.common import drop, save, table

#: A run of at most eight words of one line, which ends with a sentence; the first sixteen words; and two words.
PARAGRAPH = r"(?:\S*[^\s.!?][^\S\n]+){0,7}\S+"
OPENING, PAIR = r"^\s*(?:\S+\s+){0,15}\S+", r"\S+(?:\s+\S+)?"
#: Cells of a fingerprint's subtable, and steps of a peeling.
BASE, STEPS = 16, 12
#: Cells of a larger subtable for each differing digest, and beside these.
CELLS, MORE_CELLS = 0.75, 8
#: Digests that a task takes, about.
TASK_DIGESTS = 250_000
ATTEMPTS = 12
#: Equal rows that are written out together.
REPEATS = 4096


def digests(text: str | Column) -> Column:
    """The distinct digests of a text."""
    col = F.col(text) if isinstance(text, str) else text
    runs = F.transform(F.regexp_extract_all(col, F.lit(PARAGRAPH), F.lit(0)), lambda p: F.xxhash64(p))
    first = F.regexp_extract_all(F.regexp_extract(col, OPENING, 0), F.lit(PAIR), F.lit(0))
    return F.array_distinct(F.concat(F.transform(first, lambda p: F.xxhash64(p, F.lit(2))), runs))


_KEY, _NEXT = ["k1", "k2"], ["j1", "j2"]


def order(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, k1, k2, size)``, the keys being 128 bits of id and text; returns ``(doc_id, k1, k2, size, n, j1, j2)``,
    one row a class of equal rows with the class that comes next, by descending id; after the last comes the first."""
    classes = docs.groupBy("doc_id", *_KEY, "size").agg(F.count("*").alias("n"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    down = [F.desc_nulls_last("doc_id"), *_KEY]
    x = save(classes.repartitionByRange(parts, *down).withColumn("part", F.spark_partition_id()), "order")
    key = F.struct(*_KEY)
    # the first class of each part follows the last one of the part before: one row a part
    first = F.min_by(key, F.struct(F.col("doc_id").isNull().alias("a"), F.bitwise_not("doc_id").alias("b"), *_KEY)).alias("first")
    whole = Window.partitionBy(F.lit(0)).orderBy("part")
    ends = x.groupBy("part").agg(first)
    ends = ends.select("part", F.coalesce(F.lead("first").over(whole), F.first("first").over(whole)).alias("beyond"))
    inside = F.lead(key).over(Window.partitionBy("part").orderBy(*down))
    x = x.withColumn("inside", inside).join(F.broadcast(ends), "part").withColumn("next", F.coalesce("inside", "beyond"))
    return x.select("doc_id", *_KEY, "size", "n", F.col("next.k1").alias("j1"), F.col("next.k2").alias("j2"))


def versions(docs: DataFrame) -> DataFrame:
    """``(row, doc_id, times, k1, k2, j1, j2, n_chars, edited_sha256, own, kept, tail)``: each class of equal rows with the
    digests of its text and of the edited text, which are the first ``kept`` of ``own`` and ``tail``; of several equal rows
    all but one are a second row with themselves next."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select("doc_id", F.xxhash64("doc_id", "text").alias("k1"), F.xxhash64("text", F.lit(7), "doc_id").alias("k2"), "text")
    known = save(order(rows.select("doc_id", *_KEY, F.length("text").alias("size"))), "next")
    third = F.floor(F.col("size") / 3).cast("int")
    before = known.select(F.col("j1").alias("k1"), F.col("j2").alias("k2"), F.col("k1").alias("i1"), F.col("k2").alias("i2"), third.alias("want"))
    # every distinct text moves to its class, and from there the head that the class before it needs
    texts = rows.select(*_KEY, "text").dropDuplicates(_KEY)
    heads = texts.join(before, _KEY).select(F.col("i1").alias("k1"), F.col("i2").alias("k2"), F.left("text", F.col("want")).alias("piece"))
    x = texts.join(known, _KEY).join(heads, _KEY)
    head = F.left("text", F.col("size") - third)
    then = F.struct(F.lit(1).cast("long").alias("times"), F.concat(head, "piece").alias("edited"), "j1", "j2")
    same = F.struct((F.col("n") - 1).alias("times"), F.concat(head, F.left("text", third)).alias("edited"), F.col("k1").alias("j1"), F.col("k2").alias("j2"))
    x = x.select("doc_id", *_KEY, "size", "text", F.explode(F.when(F.col("n") > 1, F.array(then, same)).otherwise(F.array(then))).alias("v"))
    x = x.select("doc_id", "v.times", *_KEY, "v.j1", "v.j2", F.col("size").cast("long").alias("n_chars"), F.sha2("v.edited", 256).alias("edited_sha256"), digests("text").alias("own"), digests("v.edited").alias("new"))
    unlike = F.array_position(F.zip_with("own", "new", lambda a, b: a.eqNullSafe(b)), False).cast("int")
    kept = F.when(unlike > 0, unlike - 1).otherwise(F.least(F.size("own"), F.size("new")))
    x = x.withColumn("kept", kept).withColumn("tail", F.slice("new", F.col("kept") + 1, F.greatest(F.lit(0), F.size("new") - F.col("kept"))))
    return x.drop("new").withColumn("row", F.monotonically_increasing_id())


def _cell(key: Column | str, sub: int, size: Column | str, seed: int) -> Column:
    size = F.col(size) if isinstance(size, str) else size
    return size * sub + F.pmod(F.xxhash64(key, F.lit(3 * seed + sub)), size)


def _check(key: Column | str) -> Column:
    return F.shiftrightunsigned(F.xxhash64(key, F.lit(-1)), 40)


def _added(rows: DataFrame, also: tuple[str, ...] = ()) -> DataFrame:
    """Cells of equal place added up; empty ones drop out."""
    x = rows.groupBy(*also, "row", "pair", "size", "cell").agg(F.sum("n").alias("n"), F.bit_xor("key").alias("key"), F.bit_xor("check").alias("check"))
    return x.where("n <> 0 or key <> 0 or check <> 0")


def sketch(sets: DataFrame, seed: int = 0) -> DataFrame:
    """``sets(row, pair, n, size, keys)``: digests, each counted ``n`` (1, or -1 to subtract), in subtables of ``size``
    cells; returns cells ``(row, pair, size, cell, n, key, check)``. Sets of one row and pair add up."""
    x = sets.select("row", "pair", F.col("n").cast("long").alias("n"), F.col("size").cast("long").alias("size"), F.explode("keys").alias("key"))
    at = F.explode(F.array(*(_cell("key", s, "size", seed) for s in range(3)))).alias("cell")
    return _added(x.select("row", "pair", "n", "size", "key", _check("key").alias("check"), at))


#: Pairs from this number on hold digests that were recovered, a cell being one digest.
FOUND = 10


def peel(cells: DataFrame, seed: int = 0, steps: int = STEPS, also: tuple[str, ...] = ()) -> DataFrame:
    """Cells that can't be peeled, and a row for each recovered digest: its pair is raised by ``FOUND``, ``key`` is the
    digest and ``n`` the side that has it (1 or -1). Rows are dealt by ``row``, or by columns ``also`` that go with it."""
    for i in range(steps):
        sub = i % 3
        pure = (F.col("pair") < FOUND) & (F.abs("n") == 1) & (F.col("check") == _check("key")) & (F.col("cell") == _cell("key", sub, "size", seed))
        row = lambda pair, cell, n, key, check: F.struct(pair.alias("pair"), cell.alias("cell"), n.alias("n"), key.alias("key"), check.alias("check"))
        same = row(*(F.col(c) for c in ("pair", "cell", "n", "key", "check")))
        taken = [row(F.col("pair"), _cell("key", s, "size", seed), -F.col("n"), F.col("key"), F.col("check")) for s in range(3) if s != sub]
        found = row(F.col("pair") + FOUND, F.col("key"), F.col("n"), F.col("key"), F.col("check"))
        x = cells.select(*also, "row", "size", F.explode(F.when(pure, F.array(found, *taken)).otherwise(F.array(same))).alias("e"))
        cells = _added(x.select(*also, "row", "size", "e.*"), also)
    return cells


def written(cells: DataFrame) -> DataFrame:
    """``(row, fingerprint, edited_fingerprint)`` of the cells of pairs 0 and 1."""
    out = []
    for p, name in ((0, "fingerprint"), (1, "edited_fingerprint")):
        held = F.array_sort(F.collect_list(F.when(F.col("pair") == p, F.struct("cell", "n", "key", "check"))))
        text = F.transform(held, lambda c: F.concat_ws(".", F.hex(c["cell"]), F.hex(c["n"]), F.hex(c["key"]), F.hex(c["check"])))
        total = F.coalesce(F.sum(F.when(F.col("pair") == p, F.col("n"))), F.lit(0))
        out.append(F.lower(F.concat_ws(":", (total / 3).cast("long").cast("string"), F.array_join(text, ":"))).alias(name))
    return cells.groupBy("row").agg(*out)


EMPTY = "0:"


def _number(fingerprint: Column) -> Column:
    return F.substring_index(fingerprint, ":", 1).cast("long")


def _read(fingerprint: Column, sign: int) -> Column:
    """The cells of a fingerprint's text."""
    number = lambda x: F.conv(x, 16, -10).cast("long")

    def cell(c: Column) -> Column:
        p = F.split(c, r"\.")
        return F.struct(number(p[0]).alias("cell"), (number(p[1]) * sign).alias("n"), number(p[2]).alias("key"), number(p[3]).alias("check"))

    return F.transform(F.filter(F.split(fingerprint, ":"), lambda c: F.contains(c, F.lit("."))), cell)


def compared(pairs: DataFrame, also: tuple[str, ...] = ()) -> DataFrame:
    """``pairs(row, a, b)``, two fingerprints; their difference, peeled: cells that are left and recovered digests.

    Equal fingerprints have none. Where the pairs are dealt by ``also`` this needs no shuffle.
    """
    both = F.explode(F.concat(_read(F.col("a"), 1), _read(F.col("b"), -1))).alias("c")
    cells = pairs.where("a <> b").select(*also, "row", both).select(*also, "row", F.lit(0).alias("pair"), F.lit(BASE).cast("long").alias("size"), "c.*")
    return peel(_added(cells, also), 0, STEPS, also)


def differing(peeled: DataFrame, also: tuple[str, ...] = ()) -> DataFrame:
    """``(row, differ)``: how many digests of a pair differ, those recovered and those that cells are left of.

    In each subtable the squares of the counts add up to the remaining digests, but for those that meet.
    """
    cell, n = F.col("pair") < FOUND, F.col("n")
    total = lambda x: F.coalesce(F.sum(F.when(cell, x)), F.lit(0))
    x = peeled.groupBy(*also, "row").agg(F.count(F.when(~cell, 1)).alias("found"), F.count(F.when(cell, 1)).alias("left"), total(n * n).alias("squares"), (total(n) / 3).alias("net"))
    rest = (F.col("squares") - 3 * F.col("net") * F.col("net") / BASE) / (3 * (1 - 1 / BASE))
    rest = F.greatest(F.round(rest), F.abs("net"), F.lit(1.0))
    return x.select("row", (F.col("found") + F.when(F.col("left") > 0, rest).otherwise(0.0)).alias("differ"))


def likeness(a: Column, b: Column, differ: Column) -> Column:
    """Jaccard index of two fingerprints that differ in so many digests."""
    both = (_number(a) + _number(b)).cast("double")
    d = F.least(F.coalesce(differ, F.lit(0.0)), both)
    return F.when(both == 0, 1.0).otherwise((both - d) / F.greatest(both + d, F.lit(1.0)))


def _edited(kept: str = "kept", tail: str = "tail") -> Column:
    return F.concat(F.slice("own", F.lit(1), F.col(kept)), tail)


def _signed(sets: DataFrame, size: Column) -> DataFrame:
    """``sets(row, own, edited, ...)``: entries of one pair, the first set less the second."""
    entry = lambda n, keys: F.struct(F.lit(n).alias("n"), F.col(keys).alias("keys"))
    return sets.select("row", F.lit(0).alias("pair"), size.alias("size"), F.explode(F.array(entry(1, "own"), entry(-1, "edited"))).alias("e")).select("row", "pair", "size", "e.*")


def differences(sets: DataFrame, tasks: int) -> tuple[DataFrame, list[DataFrame]]:
    """``sets(row, own, kept, tail, differ)``, digest sets as ``versions`` has them, and the expected number of differing
    ones, dealt by ``row``; returns ``(row, key, n)``: the digests that only the first (n 1) or only the second set (-1)
    has, each row's sketch being decoded whole, and the tables that this is read from."""
    out, rest, spent = [], sets, []
    for attempt in range(1, ATTEMPTS + 1):
        size = F.ceil(F.col("differ") * CELLS * 2 ** (attempt - 1)) + MORE_CELLS
        x = _signed(rest.select("row", "own", _edited().alias("edited"), "differ"), size)
        peeled = save(peel(sketch(x, attempt), attempt).select("row", "pair", "key", "n"), "recovered")
        failed = save(peeled.where(F.col("pair") < FOUND).select("row").distinct(), "failed")
        spent += [peeled, failed]
        found = peeled.where(F.col("pair") >= FOUND).select("row", "key", "n")
        if failed.isEmpty():
            out.append(found)
            break
        out.append(found.join(failed, "row", "left_anti"))
        rest = rest.join(failed, "row", "left_semi").repartition(tasks, "row")
    else:
        raise RuntimeError("sketches can't be decoded")
    every = out[0]
    for x in out[1:]:
        every = every.unionByName(x)
    return every, spent


def fingerprints(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, gone, come)`` for each
    row of ``docs(doc_id, text)``; ``gone`` and ``come``: the recovered digests that only the text or only the edited text has."""
    spark = docs.sparkSession
    rows = save(versions(docs), "versions")
    # a task's cells fit in its memory: tasks follow the number of digests and not the session's setting
    total = rows.agg(F.sum(2 * F.size("own") + F.size("tail")).alias("n")).first().n or 0
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // TASK_DIGESTS))
    leading = lambda keys: F.array_distinct(F.transform(keys, lambda k: F.shiftrightunsigned(k, 32)))
    dealt = rows.select("row", "own", "kept", "tail").repartition(tasks, "row").select("row", leading(F.col("own")).alias("own"), leading(_edited()).alias("edited"))
    entry = lambda pair, keys: F.struct(F.lit(pair).alias("pair"), F.col(keys).alias("keys"))
    both = dealt.select("row", F.lit(1).alias("n"), F.lit(BASE).alias("size"), F.explode(F.array(entry(0, "own"), entry(1, "edited"))).alias("e")).select("row", "n", "size", "e.*")
    prints = save(written(sketch(both)), "prints")
    edit = save(differing(peel(sketch(_signed(dealt, F.lit(BASE))))), "differ-edited")
    # the next class's fingerprint comes to the row; of a class's rows the one whose next is another, or the only one
    keys = rows.select("row", "times", *_KEY, *_NEXT)
    ahead = keys.groupBy(*_KEY).agg(F.min("row").alias("next")).select(F.col("k1").alias("j1"), F.col("k2").alias("j2"), "next")
    ahead = save(keys.join(ahead, _NEXT).select("row", "next"), "ahead")
    b = prints.select(F.col("row").alias("next"), F.col("fingerprint").alias("b"))
    pairs = ahead.join(prints.select("row", F.col("fingerprint").alias("a")), "row", "left").join(b, "next", "left")
    pairs = pairs.select("row", "next", F.coalesce("a", F.lit(EMPTY)).alias("a"), F.coalesce("b", F.lit(EMPTY)).alias("b"))
    following = save(differing(compared(pairs, ("next",)), ("next",)), "differ-next")
    # both sides are dealt alike, so the join moves neither again
    sets = rows.select("row", "own", "kept", "tail").repartition(tasks, "row").join(edit.repartition(tasks, "row"), "row")
    found, spent = differences(sets, tasks)
    side = lambda n, c: F.array_sort(F.collect_list(F.when(F.col("n") == n, F.col("key")))).alias(c)
    recovered = save(found.groupBy("row").agg(side(1, "gone"), side(-1, "come")), "differences")
    drop(*spent)
    sizes = prints.select(F.col("row").alias("next"), F.concat(F.substring_index("fingerprint", ":", 1), F.lit(":")).alias("next_size"))
    near = ahead.join(sizes, "next", "left").join(edit.withColumnRenamed("differ", "differ0"), "row", "left").join(following.withColumnRenamed("differ", "differ1"), "row", "left")
    out = rows.drop("own", "kept", "tail").join(near.drop("next"), "row").join(prints, "row", "left").join(recovered, "row", "left")
    name = lambda c: F.coalesce(c, F.lit(EMPTY))
    none = F.array().cast("array<long>")
    out = out.select(
        "doc_id", "times", "n_chars", "edited_sha256", name("fingerprint").alias("fingerprint"), name("edited_fingerprint").alias("edited_fingerprint"),
        likeness(name("fingerprint"), name("edited_fingerprint"), F.col("differ0")).alias("near_edited"),
        likeness(name("fingerprint"), name("next_size"), F.col("differ1")).alias("near_next"), F.coalesce("gone", none).alias("gone"), F.coalesce("come", none).alias("come"),
    )
    if not rows.where("times > 1").isEmpty():  # equal rows are written out by several tasks where they are many
        step = F.explode(F.sequence(F.lit(0).cast("long"), F.col("times") - 1, F.lit(REPEATS).cast("long"))).alias("at")
        out = out.select("*", step).repartition(tasks)
        out = out.select("*", F.explode(F.sequence(F.col("at"), F.least(F.col("at") + REPEATS, F.col("times")) - 1)).alias("copy"))
    return out.drop("times", "at", "copy")


def query(spark, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
