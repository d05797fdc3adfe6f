"""Core operators: golden tables, brute force, edge cases."""

import datetime
import itertools
import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from oodmill.functions import arrays, text
from oodmill.functions.dates import lenient_date
from oodmill.functions.identifiers import accession, entry_code, sample_id
from oodmill.operators import evaluation, metrics, ood, profile, ranked, retention, similarity
from oodmill.operators.graph import connected_components
from oodmill.operators.ranked import average_rank, descending, first_per_group, nulls_last, running_totals, share_split


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column(F.col("v")).alias("x")).first()["x"]


@pytest.mark.parametrize(
    "value, want",
    [
        ("01-JUL-79", "1979-07-01"), ("31-MAY-81", "1981-05-31"), ("1-JAN-25", "2025-01-01"), ("2020-02-30", None), ("0000-00-00", None), ("20200229", "2020-02-29"),
        ("2020/01/05", "2020-01-05"), ("2020-01-05T00:00:00.000+00:00", "2020-01-05"), ("2020-01-05 10:00:00", "2020-01-05"), ("9 May 1981", "1981-05-09"), ("TBD", None), ("", None), (None, None),
        (" 2020-01-05 ", "2020-01-05"), ("May 9, 1981", "1981-05-09"), ("30-FEB-90", None),
    ],
)
def test_dates(spark, value, want):
    got = one(spark, value, lenient_date)
    assert got == (datetime.date.fromisoformat(want) if want else None)


@pytest.mark.parametrize(
    "value, want",
    [("sp|Z4I9P6RH81|LIPQ_FGMPH", "Z4I9P6RH81"), ("tr|s3u249cqy2|S3U249CQY2_GHJQP", "S3U249CQY2"), ("UniProtKB:X4TWT7OUU3", "X4TWT7OUU3"), ("X3ZAW3OED2.4", "X3ZAW3OED2"), (" S0PMF3AX18\t", "S0PMF3AX18"), ("UNDEFINED", None), ("n/a", None), ("", None), (None, None)],
)
def test_accessions(spark, value, want):
    assert one(spark, value, accession) == want


@pytest.mark.parametrize("value, want", [("6QQM98 ", "6qqm98"), ("------", None), ("none", None), ("?", None), (None, None), ("90Jmnh", "90jmnh")])
def test_entry_codes(spark, value, want):
    assert one(spark, value, entry_code) == want


@pytest.mark.parametrize("value, want", [("2BKNXG_A", "2bknxg_A"), (" 1rgelw_aB\t", "1rgelw_aB"), ("AF-R3M526WSR9-F1 ", "AF-R3M526WSR9-F1"), ("", None), (None, None)])
def test_sample_ids(spark, value, want):
    assert one(spark, value, sample_id) == want


def test_text_functions(spark):
    assert one(spark, "acXBz", text.clean_strip) == "AC"
    assert one(spark, "BZJUO1", text.clean_map) == "NQLCKA"
    assert one(spark, " a; b;;a ", text.tokens) == ["a", "b"]
    assert one(spark, "1.2.-", text.ec_padded) == "1.2.-.-"
    assert one(spark, "1.2.3.4", text.ec_level) == 4
    assert one(spark, ["1.2.3.4", "1.2.3.9", "2.1.1.1"], text.ec_third_level, "array<string>") == ["1.2.3.-", "2.1.1.-"]
    assert one(spark, "a/b/AF-X.pdb", text.stem) == "AF-X"
    assert one(spark, ["ala", "XXX"], text.residue_letters, "array<string>") == "AX"
    got = one(spark, "Kd=10nM", text.affinity)
    assert (got["kind"], got["relation"], round(got["p"], 6)) == ("Kd", "=", 8.0)
    assert one(spark, "junk", text.affinity) is None
    assert one(spark, "a Cat-like fold", text.keyword_ngrams) == ["cat", "like", "fold", "cat like", "like fold"]


def test_array_functions(spark):
    bins = [one(spark, v, lambda c: arrays.right_closed_bin(c, 1.0, 3.0, 0.5), "double") for v in (1.0, 1.2, 1.5, 1.6, 3.0, 3.1, None)]
    assert bins == [None, 0, 0, 1, 3, None, None]
    assert [one(spark, v, lambda c: arrays.clipped_bin(c, 0.0, 1.0, 0.5), "double") for v in (-1.0, 0.3, 1.0)] == ["clip_lo", "bin_0", "clip_hi"]
    assert one(spark, "[1 0,nan -1]", arrays.parse_ints) == [1, 0, -1, -1]
    assert one(spark, [1, 0, -1, 1], arrays.masked_ratio, "array<int>") == pytest.approx(2 / 3)
    assert one(spark, [-1], arrays.masked_ratio, "array<int>") is None
    assert one(spark, [0.1, -2.0, 3.0], arrays.on_bits, "array<double>") == [0, 2]
    assert one(spark, 2.5, lambda c: arrays.discretise(c, [1.0, 2.0, 3.0]), "double") == 2
    assert one(spark, [1, 2], lambda c: arrays.padded(c, 4), "array<int>") == [1, 2, 0, 0]
    assert one(spark, [1.0, -1.0], lambda c: arrays.hyperplane_token(c, [[1, 0], [0, 1], [1, -1]]), "array<double>") == 5


def test_components_of_chains_hubs_and_loops(spark):
    edges = [(f"n{i}", f"n{i + 1}") for i in range(300)] + [("hub", f"s{i}") for i in range(300)] + [("x", "x"), (None, "y"), ("n3", "n3")]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "u string, v string")).collect()}
    assert {got[f"n{i}"] for i in range(301)} == {"n0"}
    assert {got[f"s{i}"] for i in range(300)} | {got["hub"]} == {"hub"}
    assert got["x"] == "x" and "y" not in got
    assert len(got) == 301 + 301 + 1


def test_components_of_nothing(spark):
    assert connected_components(spark.createDataFrame([], "u string, v string")).count() == 0


def test_running_totals_match_python(spark):
    rng = np.random.default_rng(0)
    rows = [(int(rng.integers(5)) if i % 4 else 0, int(rng.integers(50)), i) for i in range(2000)]
    df = spark.createDataFrame(rows, "k int, v int, i int")
    got = {r["i"]: (r["position"], r["cum_v"]) for r in running_totals(df, [F.col("v"), F.col("i")], ["v"], ["k"]).collect()}
    by = defaultdict(list)
    for k, v, i in rows:
        by[k].append((v, i))
    for part in by.values():
        total = 0
        for n, (v, i) in enumerate(sorted(part), 1):
            total += v
            assert got[i] == (n, total)


def test_first_per_group_orders_nulls_last(spark):
    df = spark.createDataFrame([("a", None, 1), ("a", 2, 2), ("a", 3, 3), ("b", None, 4)], "g string, v int, i int")
    up = first_per_group(df, ["g"], [nulls_last(F.col("v")), F.col("i")])
    down = first_per_group(df, ["g"], [descending(F.col("v")), F.col("i")])
    assert sorted(r["i"] for r in up.collect()) == [2, 4]
    assert sorted(r["i"] for r in down.collect()) == [3, 4]


def test_share_split_is_exhaustive(spark):
    got = Counter(r["split"] for r in share_split(spark.range(10), [F.col("id")], 0.7, 0.1).collect())
    assert got == {"train": 7, "test": 3} or got == {"train": 7, "val": 1, "test": 2} or got == {"train": 7, "val": 0, "test": 3}
    assert share_split(spark.range(0), [F.col("id")], 0.7, 0.1).count() == 0


def test_average_rank(spark):
    got = {r["value"]: r["avg_rank"] for r in average_rank(spark.createDataFrame([(5,), (1,), (5,), (None,)], "v int"), "v").collect()}
    assert got == {1: 1.0, 5: 2.5}


def test_auroc_mirrors_and_ap_is_one_on_separable(spark):
    rng = np.random.default_rng(1)
    rows = [("r", float(rng.integers(6)), int(rng.integers(2))) for _ in range(200)] + [("s", float(i), int(i >= 50)) for i in range(100)] + [("one", 1.0, 1)]
    df = spark.createDataFrame(rows, "g string, x double, y int")
    a = {r["g"]: r for r in metrics.ranking(df, ["g"], "x", "y").collect()}
    b = {r["g"]: r for r in metrics.ranking(df.withColumn("x", -F.col("x")), ["g"], "x", "y").collect()}
    assert a["r"]["auroc"] == pytest.approx(1 - b["r"]["auroc"])
    assert a["s"]["auroc"] == 1.0 and a["s"]["auprc"] == 1.0
    assert a["one"]["auroc"] is None


def test_fmax_matches_brute_force(spark):
    rng = np.random.default_rng(2)
    score, y = rng.random((30, 8)), (rng.random((30, 8)) < 0.3).astype(int)
    rows = [(i, float(score[i, c]), int(y[i, c])) for i in range(30) for c in range(8)]
    got = metrics.fmax(spark.createDataFrame(rows, "row int, score double, y long"), "row", "score", "y").first()
    best = 0.0
    for t in np.linspace(0.01, 0.99, 500):
        said = score >= t
        tp = (said & (y == 1)).sum(1)
        p = np.divide(tp, said.sum(1), out=np.zeros(30), where=said.sum(1) > 0).mean()
        r = np.divide(tp, y.sum(1), out=np.zeros(30), where=y.sum(1) > 0).mean()
        best = max(best, 2 * p * r / (p + r + 1e-10))
    assert got["f1"] == pytest.approx(best, abs=1e-6)


def test_code_flags_and_new_pairs(spark):
    ref = spark.createDataFrame([(1, ["a", "b"]), (2, ["a"]), (3, ["c", "d"])], "id int, c array<string>")
    test = spark.createDataFrame([(10, ["a", "z"]), (11, ["z"]), (12, []), (13, None), (14, ["a", "c"])], "id int, c array<string>")
    flags = {"all_new": ("all", F.col("freq") == 0), "any_new": ("any", F.col("freq") == 0)}
    got = {r["id"]: (r["all_new"], r["any_new"]) for r in ood.code_flags(test, "id", "c", ood.code_frequency(ref, "c"), flags).collect()}
    assert got == {10: (False, True), 11: (True, True), 12: (False, False), 13: (False, False), 14: (False, False)}
    pairs = {r["id"]: r["ood_combinatorial"] for r in ood.new_pairs(test, ref, "id", "c").collect()}
    assert pairs == {10: True, 11: False, 12: False, 13: False, 14: True}


def test_ladder_is_nested_and_orphans_are_low(spark):
    test = spark.createDataFrame([("q1",), ("q2",), ("q3",)], "q string")
    hits = spark.createDataFrame([("q1", "t", 95.0, 0.1), ("q1", "u", 20.0, 0.1), ("q2", "t", 30.0, 0.1)], "query string, target string, score double, evalue double")
    got = {r["q"]: r for r in ood.with_best_hits(test, "q", hits, ood.SEQ_CUTS).collect()}
    assert not got["q1"]["seq_redundancy_90"] and got["q2"]["seq_redundancy_40"] and not got["q2"]["seq_redundancy_30"]
    assert got["q3"]["ood_orphan"] and got["q3"]["seq_redundancy_30"]


def test_prefix_pairs_match_brute_force(spark):
    rng = np.random.default_rng(6)
    sets = {i: sorted(set(rng.integers(0, 30, int(rng.integers(1, 12))).tolist())) for i in range(80)} | {99: []}
    df = spark.createDataFrame(list(sets.items()), "id int, s array<int>")
    want = {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if sets[a] and sets[b] and len(set(sets[a]) & set(sets[b])) / len(set(sets[a]) | set(sets[b])) >= 0.5}
    assert {(r["a"], r["b"]) for r in similarity.prefix_pairs(df, "id", "s", 0.5).collect()} == want


def test_radius_pairs_match_brute_force(spark):
    rng = np.random.default_rng(7)
    pts = rng.random((60, 3)) - 0.5
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(pts)], "id int, x double, y double, z double")
    got = {(r["l"], r["r"]) for r in similarity.radius_pairs(df, df, "id", ("x", "y", "z"), 0.3).collect()}
    assert got == {(i, j) for i in range(60) for j in range(60) if math.dist(pts[i], pts[j]) <= 0.3}


def test_cliques_are_cliques(spark):
    pairs = spark.createDataFrame([(1, 2), (2, 3), (1, 3), (3, 4), (6, 7)], "a bigint, b bigint")
    got = {r["id"]: r["clique"] for r in similarity.clique_partition(spark.createDataFrame([(i,) for i in range(1, 9)], "id bigint"), "id", pairs).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 6, 7: 6, 8: 8}


def test_leakage_fixpoint_is_idempotent(spark):
    df = spark.createDataFrame([(1, "train"), (2, "val"), (3, "test"), (4, "test")], "id int, split string")
    pairs = spark.createDataFrame([(1, 2), (2, 3)], "a int, b int")
    first = similarity.leakage_fixpoint(df, "id", "split", pairs)
    again = similarity.leakage_fixpoint(first, "id", "split", pairs)
    assert sorted(map(tuple, first.collect())) == sorted(map(tuple, again.collect())) == [(1, "train"), (2, "train"), (3, "train"), (4, "test")]


def test_leakage_fixpoint_follows_long_chains(spark):
    # 1 is train and reached over 100 links; 201-202 hold no train row; 300 is linked to a row that is not there
    held = [(1, "train"), *[(i, "val" if i % 2 else "test") for i in range(2, 102)], (201, "val"), (202, "test"), (300, "val"), (400, "train"), (500, None)]
    links = [*[(i + 1, i) for i in range(1, 101)], (201, 202), (300, 999), (999, 400), (500, 400), (201, 500)]
    df, pairs = spark.createDataFrame(held, "id bigint, split string"), spark.createDataFrame(links, "a int, b int")
    got = dict(map(tuple, similarity.leakage_fixpoint(df, "id", "split", pairs).collect()))
    assert got == {i: s if i > 101 else "train" for i, s in held}


def test_retention_keeps_all_when_nothing_shifts(spark):
    rng = np.random.default_rng(8)
    rows = [(i, "ab"[i % 2], float(rng.random()), 2.0, "s" if i >= 200 else "none") for i in range(400)]
    df = spark.createDataFrame(rows, "id int, profile string, e double, e0 double, scenario string")
    got = retention.matched_retention(df, "id", "profile", "e", "e0", ["scenario"], F.col("scenario") == "none", draws=10).collect()
    assert len(got) == 1 and got[0]["n"] == 200 and got[0]["dpr"] == pytest.approx(1.0, abs=0.1)


# -- column quality

FLAGS = "row_id bigint, load_id int, feed_id int, flag string, chain string, value double, load int, n int"


def flags(spark, rows):
    return spark.createDataFrame(rows, FLAGS)


def test_quality_issues(spark):
    rows, i = [], 0
    for load, feed, missing, true in ((1, 1, 0, 50), (2, 1, 11, 50), (4, 1, 11, 20), (3, 2, 50, 0), (9, 2, 50, 50)):
        for k in range(100):
            i += 1
            flag = None if k < missing else "True" if k < missing + true else "False"
            rows.append((i, load, feed, flag, "A", 0.0, 7, 7))
    rows += [(1001, 1, 1, "True\n", "A B", 0.0, 7, 7), (1002, 1, 1, "", "ABCDE", 0.0, 7, 7), (1002, 1, 1, "true", "A\n", 0.0, 7, 7), (1003, None, None, "x", None, 0.0, 7, 7)]
    got = Counter(map(tuple, profile.quality_issues(flags(spark, rows), {"flag": "True|False", "chain": "[A-Za-z0-9]{1,4}"}, "load_id", "feed_id", "row_id").collect()))
    assert got == Counter([
        (1, "flag", "pattern", 1001), (1, "flag", "pattern", 1002), (1, "chain", "pattern", 1001), (1, "chain", "pattern", 1002), (1, "chain", "pattern", 1002), (None, "flag", "pattern", 1003),
        (2, "flag", "null_shift", 0), (4, "flag", "value_shift", 0), (9, "flag", "value_shift", 0),  # 11/100 - 1/103 > 0.10
    ])


def test_quality_of_an_empty_table(spark):
    assert profile.quality_issues(flags(spark, []), {"flag": "x"}, "load_id", "feed_id", "row_id").count() == 0


def test_profile_is_exact(spark):
    rng = np.random.default_rng(9)
    rows = [(i, 1 + i % 2, 1, None if rng.random() < 0.1 else str(int(rng.integers(5))), "A", float(rng.normal(i % 2, 1)) if rng.random() < 0.9 else float("nan"), 1, 1) for i in range(400)]
    got = {(r["load"], r["column_name"]): r for r in profile.column_profile(flags(spark, rows), "load_id", "feed_id", ["value"], ["flag"]).collect()}
    for load in (1, 2):
        values = sorted(r[5] for r in rows if r[1] == load and not math.isnan(r[5]))
        r = got[load, "value"]
        assert (r["rows"], r["nulls"], r["distinct_values"]) == (200, 200 - len(values), len(values))
        assert (r["min_num"], r["max_num"], r["q50"]) == (values[0], values[-1], values[math.ceil(0.5 * len(values)) - 1])
    a, b = ([r[5] for r in rows if r[1] == k and not math.isnan(r[5])] for k in (1, 2))
    ks = max(abs(np.mean([x <= v for x in a]) - np.mean([x <= v for x in b])) for v in a + b)
    assert got[2, "value"]["ks"] == pytest.approx(ks, abs=1e-6)
    assert got[1, "value"]["ks"] is None


# -- task kinds, ranges, class-wise F


@pytest.mark.parametrize(
    "labels, want",
    [(["[0 1]", "[1]"], "residual"), (["a;b", "c"], "multilabel"), (["0", "1", None], "binary"), (["1", "2", "3"], "single_label"), (["0.5", "2"], "regression"), (["1.10.8", "x"], "single_label"), (["5", "7"], "regression")],
)
def test_task_type(spark, labels, want):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(labels)], "i int, label string")
    assert metrics.task_type(df, "label", "i") == want


def test_macro_fmax(spark):
    rows = [("a", 0.9, 1), ("a", 0.8, 0), ("a", 0.7, 1), ("b", 0.5, 1), ("b", 0.4, 0), ("c", 0.3, 0)]
    got = metrics.macro_fmax(spark.createDataFrame(rows, "l string, s double, y int"), "l", "s", "y").first()
    assert got["classes"] == 2 and got["macro_fmax"] == pytest.approx((0.8 + 1.0) / 2)


def test_ranges(spark):
    assert [tuple(r) for r in one(spark, "1-3, 7,x,-2", text.ranges)] == [(1, 3), (7, 7), (-2, -2)]
    assert one(spark, "1-3,7", lambda c: text.in_ranges(F.lit(3), text.ranges(c))) and not one(spark, "1-3,7", lambda c: text.in_ranges(F.lit(5), text.ranges(c)))
    at = lambda f, n, code: one(spark, "x", lambda c: f(F.lit(n), F.lit(code), F.lit(10), F.lit("A"), F.lit(20), F.lit(" ")))
    assert at(text.in_range_by_code, 10, "A") and not at(text.in_range_by_code, 10, "B") and at(text.in_range_by_code, 15, "Z")
    assert at(text.in_range_by_order, 10, "B") and not at(text.in_range_by_order, 10, " ")
    assert [one(spark, v, lambda c: text.mismatch(c, F.lit("ACDE"))) for v in ("ACDE", "ACDF", "AC", "A" * 20, None)] == ["exact", "same_length", "near", "large", None]


def test_null_predictors(spark):
    train = spark.createDataFrame([(0.0,), (1.0,), (1.0,), (4.0,)], "y double")
    assert metrics.null_errors(train, train.limit(1), "y").first()[1:] == (1.0, 1.5)


# -- evaluation, flags and pools


def test_strata_fall_back_smallest_first():
    cell = evaluation.Cell
    # nothing shifted: large but no stratum; one cross cell; the small cells of the flag and of rank 30 fall back
    cells = [cell(91, 2, (False,), 100), cell(50, 2, (False,), 40), cell(30, 2, (True,), 12), cell(30, 1, (True,), 10), cell(70, 1, (False,), 15)]
    got = {(k, n): sum(c.n for c in m) for k, n, m in evaluation.choose_strata(cells, ["odd"], 20)}
    assert got == {("cross", "50|2|none"): 40, ("fallback", "seq 30"): 22}  # struct 1 keeps 15 after the claim, odd none
    assert evaluation.choose_strata([], ["odd"]) == []


def test_reference_pool_relaxes(spark):
    rows = [(i, "none" if i < 30 else "odd", i % 2 == 0, 91.0 if i < 25 else 50.0, 2.0 if i < 5 else 1.0) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, scenario string, usual boolean, s double, t double")
    size = lambda least, **k: df.where(evaluation.reference_pool(df, F.col("scenario") == "none", F.col("usual"), "s", "t", least)).count()
    assert [size(n) for n in (2, 10, 14, 16, 100)] == [3, 13, 15, 30, 30]


def test_failing_tasks_stand_alone(spark):
    def broken():
        return spark.range(3).select(F.raise_error(F.lit("no")).cast("double").alias("value"))

    got = evaluation.evaluate_all({"good": lambda: spark.range(1).select(F.lit(1.0).alias("value")), "bad": broken}, "value double", spark).collect()
    assert {r["task"]: (r["value"], r["error"] is None) for r in got} == {"good": (1.0, True), "bad": (None, False)}


def test_booleans_of_every_kind(spark):
    df = spark.createDataFrame([(True, 0.6, " YES "), (None, float("nan"), "no"), (False, 0.5, None), (True, None, "1.0")], "b boolean, x double, t string")
    got = df.select(*[text.as_bool(F.col(c), k) for c, k in (("b", "boolean"), ("x", "double"), ("t", "string"))]).collect()
    assert [tuple(r) for r in got] == [(True, True, True), (False, False, False), (False, False, False), (True, False, True)]


def test_affinities_as_they_are_written(spark):
    for s, p in (("Kd=741.3+/-53.1uM", 3.13), ("Ki=5nm", 8.301), ("Kd≤5nM", 8.301), ("IC50 < 5 nM", 8.301), ("Kd=3μM // x", 5.523)):
        assert abs(one(spark, s, text.affinity)["p"] - p) < 1e-3
    assert all(one(spark, s, text.affinity) is None for s in ("Kd=5xM", "Kd=0nM", "", "Kx=1nM"))


def test_quantile_and_thresholds(spark):
    df = spark.createDataFrame([(float(v),) for v in [5, 1, 1, 3, 9]] + [(None,)], "v double")
    assert ranked.quantile(df, "v", 0.5) == 3.0 and ranked.quantile(df, "v", 0.25) == 1.0 and abs(ranked.quantile(df, "v", 0.9) - 7.4) < 1e-9
    assert ranked.quantile(df.limit(0), "v", 0.5) is None
    s = spark.createDataFrame([(1, 0.9, 1), (1, 0.2, 0), (2, 0.4, 1), (2, 0.3, 0)], "row int, score double, y int")
    best = metrics.fmax(s, "row", "score", "y", "distinct").first()
    assert best["threshold"] == 0.4 and abs(best["f1"] - 1) < 1e-6
    fixed = metrics.fmax(s, "row", "score", "y", [0.5]).first()
    assert (fixed["precision"], fixed["recall"]) == (0.5, 0.5)
