"""Blocking, decisions, metrics and checks against plain Python and against their own invariants."""

import random

import pytest
from pyspark.sql import functions as F

from sparkweld.functions.keys import PROFILES
from sparkweld.operators import blocking as b
from sparkweld.operators import match, metrics, validate
from sparkweld.plans import fixtures as fx
from sparkweld.sources import tsv


def records(spark, n=120, seed=3):
    rng = random.Random(seed)
    words = ["acme", "zed", "foods", "llc", "ltd", "pvt", "steel", "co", ""]
    rows = []
    for i in range(n):
        name = " ".join(rng.choices(words, k=rng.randrange(1, 4)))
        addr = " ".join(rng.choices(["12 st", "main road", "560001", "9 ave", ""], k=2))
        rows.append((f"S{i % 3 + 1}-{i}", name, addr, rng.choice(["US", "India", ""])))
    return spark.createDataFrame(rows, "entity_id string, business_name string, business_address string, country string")


def collector(s1, refs, keys, cap):
    """The sequential form: pass after pass, first-seen order, until the cap."""
    out = {}
    for a in s1:
        seen = []
        for pass_no, names in keys:
            for r in sorted(refs, key=lambda r: (r.ord, r.entity_id)):
                if all(a[n] and a[n] == r[n] for n in names) and r.entity_id not in seen and len(seen) < cap:
                    seen.append(r.entity_id)
        out[a.entity_id] = seen
    return out


@pytest.mark.parametrize("cap", [3, 10, 1000])
def test_one_join_equals_the_sequential_collector(spark, cap):
    s1, refs = fx.sides(records(spark), "ascii")
    want = collector(s1.collect(), refs.collect(), [(p.number, p.keys) for p in b.PASSES], cap)
    got = {}
    for r in b.ordered_candidates(s1, refs, cap).orderBy("s1_id", "position").collect():
        got.setdefault(r.s1_id, []).append(r.ref_id)
    assert got == {k: v for k, v in want.items() if v}


def test_country_modes(spark):
    s1, refs = fx.sides(records(spark), "ascii")
    n = {c: b.block(s1, refs, b.BY_NAME["canonical"], c).count() for c in b.COUNTRY}
    assert n["nonempty"] <= n["equal"] <= n["wildcard"] <= n["none"]
    with pytest.raises(ValueError):
        b.block(s1, refs, b.BY_NAME["name"], "other")
    for mode in b.COUNTRY:
        fits = {"none": lambda x, y: True, "equal": lambda x, y: x == y, "nonempty": lambda x, y: x == y != "", "wildcard": lambda x, y: x == y or "" in (x, y)}[mode]
        rows = [(x, y) for x in s1.collect() for y in refs.collect() if x.name_canon and x.name_canon == y.name_canon and fits(x.country_norm, y.country_norm)]
        got = b.block(s1, refs, b.BY_NAME["canonical"], mode).select("s1_id", "ref_id").collect()
        assert sorted(map(tuple, got)) == sorted((x.entity_id, y.entity_id) for x, y in rows)


@pytest.mark.parametrize("profile", sorted(PROFILES))
def test_every_profile_prepares_and_blocks(spark, profile):
    s1, refs = fx.sides(records(spark, 60), profile)
    x = b.union_ordered(b.candidates(s1, refs, b.PASSES, "wildcard"))
    assert x.count() == x.select("s1_id", "ref_id").distinct().count()


def test_empty_keys_never_block(spark):
    df = spark.createDataFrame([("S1-1", "", "", ""), ("S2-2", None, None, None)], "entity_id string, business_name string, business_address string, country string")
    s1, refs = fx.sides(df, "ascii")
    assert b.ordered_candidates(s1, refs).count() == 0 and b.limited_candidates(s1, refs).count() == 0
    assert b.rare_token_candidates(s1, refs).count() == 0 and b.scoped_candidates(s1, refs).count() == 0 and b.exact_candidates(s1, refs).count() == 0


def test_f05_forms_agree(spark):
    df = spark.range(12 * 12 * 12).select((F.col("id") % 12).alias("tp"), (F.floor(F.col("id") / 12) % 12).alias("fp"), F.floor(F.col("id") / 144).alias("fn"))
    x = df.select(F.max(F.abs(metrics.f05(F.col("tp"), F.col("tp") + F.col("fp"), F.col("tp") + F.col("fn")) - metrics.f05_counts(F.col("tp"), F.col("fp"), F.col("fn")))).alias("d"))
    assert x.first().d < 1e-12


def test_f05_golden(spark):
    df = spark.createDataFrame([(2, 1, 0), (1, 0, 1), (0, 0, 0), (0, 1, 0), (0, 0, 1)], "tp long, fp long, fn long")
    got = [round(r[0], 6) for r in df.select(metrics.f05(F.col("tp"), F.col("tp") + F.col("fp"), F.col("tp") + F.col("fn"))).collect()]
    assert got == [0.714286, 0.833333, 1.0, 0.0, 0.0]


def test_entities_restrict_to_known_ids(spark):
    ids = spark.createDataFrame([("S1-1",), ("S1-2",)], "s1_id string")
    truth = spark.createDataFrame([("S1-1", "S2-1"), ("S1-1", "S2-9")], "s1_id string, ref_id string")
    pred = spark.createDataFrame([("S1-1", "S2-1"), ("S1-1", "S2-1"), ("S1-2", "S3-7")], "s1_id string, ref_id string")
    got = {r.s1_id: (r.tp, r.fp, r.fn) for r in metrics.entities(ids, truth, pred).collect()}
    assert got == {"S1-1": (1, 0, 1), "S1-2": (0, 1, 0)}
    valid = spark.createDataFrame([("S2-1",)], "ref_id string")
    got = {r.s1_id: (r.tp, r.fp, r.fn, r.f05) for r in metrics.entities(ids, truth, pred, valid).collect()}
    assert got == {"S1-1": (1, 0, 0, 1.0), "S1-2": (0, 0, 0, 1.0)}


def test_floor_percentiles(spark):
    rng = random.Random(2)
    for n in (1, 2, 7, 100):
        xs = [rng.randrange(20) for _ in range(n)]
        df = spark.createDataFrame([(x,) for x in xs], "n long")
        got = {r.q: r.value for r in metrics.floor_percentiles(df).collect()}
        assert got == {q: sorted(xs)[int(q * (n - 1))] for q in (0.5, 0.9, 0.95, 0.99)}


def test_threshold_curve_and_best(spark):
    ids = spark.createDataFrame([("a",), ("b",), ("c",)], "s1_id string")
    truth = spark.createDataFrame([("a", "x"), ("b", "y")], "s1_id string, ref_id string")
    scored = spark.createDataFrame([("a", "x", 0.9, 1), ("a", "z", 0.4, 0), ("b", "y", 0.6, 1), ("c", "x", 0.3, 0)], "s1_id string, ref_id string, probability double, label int")
    curve = match.threshold_curve(scored, truth, ids, (0.2, 0.5, 0.7))
    got = {r.threshold: round(r.macro_f05, 6) for r in curve.collect()}
    assert got == {0.2: round((1.25 / 2.25 + 1 + 0) / 3, 6), 0.5: 1.0, 0.7: round(2 / 3, 6)}
    assert match.best_threshold(curve)[0] == 0.5


def test_negatives_and_split(spark):
    rows = [("a", f"r{i}", 1, i, int(i == 30)) for i in range(40)]
    x = match.cap_negatives(spark.createDataFrame(rows, "s1_id string, ref_id string, pass_no int, ord long, label int"), 25)
    assert x.count() == 26 and x.where("label = 1").count() == 1
    s = spark.range(2000).select(F.col("id").cast("string").alias("s1_id"))
    assert 200 < s.where(match.held_out()).count() < 400


def test_model_round_trip(spark, tmp_path):
    rows = [(f"s{i}", f"r{i}", float(i % 100), int(i % 100 > 50)) for i in range(300)]
    pairs = spark.createDataFrame(rows, "s1_id string, ref_id string, score double, label int")
    model = match.train(pairs, ("score",), trees=3, depth=2)
    match.save_model(model, 0.4, str(tmp_path / "m"))
    again, threshold = match.load_model(spark, str(tmp_path / "m"))
    assert threshold == 0.4
    a, c = (sorted(match.probability(m, pairs).select("s1_id", "probability").collect()) for m in (model, again))
    assert a == c and all((r.probability > 0.5) == (int(r.s1_id[1:]) % 100 > 50) for r in a)


def test_own_output_passes_own_checks(spark, tmp_path):
    s1, refs = fx.sides(records(spark), "ascii")
    pairs = b.exact_candidates(s1, refs)
    ids = fx.ids(s1)
    tsv.write_tsv(tsv.id_lists(ids, pairs.where("is_match")), str(tmp_path / "m"), ("source1_entity_id",), single=True)
    tsv.write_tsv(tsv.id_lists(ids, pairs, "candidate_entity_ids"), str(tmp_path / "c"), ("source1_entity_id",), single=True)
    found = validate.validate(spark, str(tmp_path / "m"), str(tmp_path / "c"), ids, refs.select(F.col("entity_id").alias("id")))
    assert found.collect() == [] and validate.passed(found)
    back = tsv.split_ids(tsv.read_tsv(spark, str(tmp_path / "m"), validate.MATCHES))
    assert {tuple(r) for r in back.collect()} == {tuple(r) for r in pairs.where("is_match").select("s1_id", "ref_id").collect()}


HEAD = "source1_entity_id\tmatched_entity_ids\n"


@pytest.mark.parametrize(
    "content, rules",
    [
        (None, {"VAL-01"}), ("", {"VAL-01"}), ("source1_entity_id,matched_entity_ids\n", {"VAL-02"}), ("a\tb\n", {"VAL-03"}),
        (HEAD + "S1-1\t\nS1-2 S2-1\nS1-2\t\n", {"VAL-04"}), (HEAD + "S1-1\t\nS1-1\tS2-1\nS1-2\t\n", {"VAL-05"}),
        (HEAD + "S1-1\tS2-1,S2-1\nS1-2\t\n", {"VAL-06"}), (HEAD + "S1-1\tS1-2\nS1-2\t\n", {"VAL-07"}), (HEAD + "S1-1\tS2-1,,S3-1\nS1-2\t\n", {"VAL-08"}),
        (HEAD + "S1-1\tS2-77\nS1-2\t\n", {"VAL-09"}), (HEAD + "S1-1\t\n", {"VAL-10"}), (HEAD + "S1-1\t\nS1-2\t\nS1-9\t\n", {"VAL-11"}),
        (HEAD + "S1-1\tS2-1\tx\nS1-2\t\n", {"VAL-09"}), (HEAD + "S1-1\tS2-1\nS1-2\t\n", set()),
    ],
)
def test_validator_rules(spark, tmp_path, content, rules):
    path = tmp_path / "f.tsv"
    if content is not None:
        path.write_text(content)
    need = spark.createDataFrame([("S1-1",), ("S1-2",)], "s1_id string")
    valid = spark.createDataFrame([("S2-1",), ("S3-1",)], "id string")
    found = validate.validate(spark, str(path), None, need, valid)
    assert {r.rule for r in found.where("severity <> 'warning'").collect()} == rules
    assert validate.passed(found) == (not rules)


def test_matches_outside_candidates_only_warn(spark, tmp_path):
    (tmp_path / "m.tsv").write_text(HEAD + "S1-1\tS2-1\n")
    (tmp_path / "c.tsv").write_text("source1_entity_id\tcandidate_entity_ids\nS1-1\tS3-1\n")
    found = validate.validate(spark, str(tmp_path / "m.tsv"), str(tmp_path / "c.tsv"), spark.createDataFrame([("S1-1",)], "s1_id string"))
    assert {r.rule for r in found.collect()} == {"VAL-13", "VAL-14"} and validate.passed(found)
    assert {(r.rule, r.n, r.examples) for r in validate.report(found).collect()} == {("VAL-13", 1, "S1-1"), ("VAL-14", 1, "ids")}


def test_sources(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("Company_Name\tID\tCountry Code\n\"A \"\"x\"\"\"\tS2-1\tUS\nNA\t\t\n", encoding="utf-8-sig")
    rows = tsv.read_any(spark, str(tmp_path / "a.tsv")).collect()
    assert [tuple(r) for r in rows] == [("S2-1", 'A "x"', "", "US"), ("", "NA", "", "")]
    with pytest.raises(ValueError, match="lacks"):
        tsv.read_tsv(spark, str(tmp_path / "a.tsv"), ("entity_id",))
    assert tsv.resolve(["Name", "my_id"], ("id",)) == "my_id" and tsv.resolve(["x"], ("id",), False) is None
    lists = spark.createDataFrame([("S1-1", "S2-1, S3-2;S2-1"), ("S1-2", "NaN"), ("S1-3", None)], "source1_entity_id string, matched_entity_ids string")
    assert sorted(map(tuple, tsv.split_ids(lists, ",;", empty_words=True).collect())) == [("S1-1", "S2-1"), ("S1-1", "S3-2")]
    assert tsv.split_ids(lists, ",;", distinct=False, empty_words=True).count() == 3
    assert tsv.summary_text({"rows": 3, "f05": 0.5}) == "rows  3\nf05   0.50000000\n"


def test_lines_are_numbered_and_bytes_are_checked(spark, tmp_path):
    need = spark.createDataFrame([("S1-1",)], "s1_id string")
    lines = [HEAD.strip()] + [f"S1-1{' ' * (i % 50)}\t" if i != 700 else "no tab" for i in range(2, 1500)]
    (tmp_path / "m.tsv").write_text("\n".join(lines) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    found = validate.validate(spark, str(tmp_path / "m.tsv"), None, need).where("rule = 'VAL-04'").collect()
    assert [r.item for r in found] == ["700: no tab"]
    rows = tsv.read_tsv(spark, str(tmp_path / "m.tsv"))
    assert tsv.first_rows(rows, 10).count() == 10 and [r.chunk for r in tsv.in_chunks(rows, 400, 3).groupBy("chunk").count().orderBy("chunk").collect()] == [0, 1, 2]
    spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    (tmp_path / "v.tsv").write_bytes(HEAD.encode() + "S1-1\tS2-\ufffd\n".encode())
    assert "VAL-16" not in {r.rule for r in validate.validate(spark, str(tmp_path / "v.tsv"), None, need).collect()}
    (tmp_path / "x.tsv").write_bytes(HEAD.encode() + b"S1-1\tS2-\xff\n")
    assert "VAL-16" in {r.rule for r in validate.validate(spark, str(tmp_path / "x.tsv"), None, need).collect()}
    assert validate.counts(validate.rows_of(spark.createDataFrame([(1, HEAD.strip()), (2, "S1-1\t"), (3, "S1-2\tS2-1,S2-2")], "number long, line string"), HEAD.strip())).first() == (2, 1, 1, 2)


def test_files_in_files_out(spark, tmp_path, capsys):
    from sparkweld import cli

    head = "entity_id\tbusiness_name\tbusiness_address\tcountry\n"
    (tmp_path / "s1.tsv").write_text(head + "S1-1\tAcme Foods Pvt Ltd\t12 Main St 56001\tUS\nS1-2\tNorth Steel\t9 Hill Road\tUS\n")
    (tmp_path / "s2.tsv").write_text(head + "S2-1\tACME Foods Private Limited\t12 main street 56001\tUS\nS2-2\tNorthern Lights\tx\t\n")
    (tmp_path / "s3.tsv").write_text(head + "S3-1\tacme foods\t12 Main Street\tUS\n")
    (tmp_path / "t.tsv").write_text("source1_entity_id\tmatched_entity_ids\nS1-1\tS2-1,S3-1\nS1-2\t\n")
    files = [str(tmp_path / f"s{i}.tsv") for i in (1, 2, 3)]
    out = str(tmp_path / "out")
    assert cli.main(["match", *files, "--out", out, "--truth", str(tmp_path / "t.tsv")], spark) == 0
    got = {r.source1_entity_id: r.matched_entity_ids for r in tsv.read_tsv(spark, f"{out}/matching_results.tsv").collect()}
    assert got == {"S1-1": "S2-1,S3-1", "S1-2": ""}
    detail = {r["source1_entity_id"]: (r["TP"], r["F0.5"]) for r in tsv.read_tsv(spark, f"{out}/f05_entity_details.tsv").collect()}
    assert detail == {"S1-1": ("2", "1.00000000"), "S1-2": ("0", "1.00000000")} and "macro F0.5" in capsys.readouterr().out
    assert spark.read.option("header", True).csv(f"{out}/blocking_results.csv").columns == ["pass_no", "retrieved", "n_true", "recall"]
    assert cli.main(["validate", f"{out}/matching_results.tsv", "--candidates", f"{out}/candidate_pairs.tsv", "--s1", files[0], "--others", *files[1:]], spark) == 0
    assert cli.main(["match", *files, "--out", out, "--first", "1"], spark) == 0 and tsv.read_tsv(spark, f"{out}/matching_results.tsv").count() == 1
    (tmp_path / "bad.tsv").write_text("source1_entity_id\tmatched_entity_ids\nS1-1\tS1-2\n")
    assert cli.main(["validate", str(tmp_path / "bad.tsv"), "--s1", files[0]], spark) == 1 and "VAL-07" in capsys.readouterr().out
    (tmp_path / "twice.tsv").write_text(head + "S2-1\ta\tb\tc\nS2-1\ta\tb\tc\n")
    with pytest.raises(ValueError, match="S2-1"):
        cli.main(["match", files[0], str(tmp_path / "twice.tsv"), "--out", out], spark)


def test_missing_values_and_empty_lists(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("entity_id\tcountry\nS1-1\tNA\nS1-2\tnull\nS1-3\tNamibia\n")
    read = lambda **k: [r.country for r in tsv.read_tsv(spark, str(tmp_path / "a.tsv"), **k).collect()]
    assert read() == ["NA", "null", "Namibia"] and read(missing=True) == ["", "", "Namibia"]
    lists = spark.createDataFrame([("S1-1", "S2-1,S2-1"), ("S1-2", ""), ("S1-3", None)], "source1_entity_id string, matched_entity_ids string")
    assert tsv.singletons(lists) == 2 and tsv.split_ids(lists, distinct=False).count() == 2
    pairs = tsv.split_ids(lists)
    tsv.write_candidates(pairs.withColumn("chunk", F.lit(0)), str(tmp_path / "c"), "chunk")
    assert [r.candidate_source for r in spark.read.parquet(str(tmp_path / "c")).collect()] == ["S2"]


def test_profile(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, "x")], "a int, b string")
    assert {tuple(r) for r in metrics.null_profile(df).collect()} == {("a", 3, 0), ("b", 3, 2)}
    assert tuple(metrics.duplicate_rows(df).first()) == (3, 1)
