"""The registered retention queries on small tables, against brute force."""

import hashlib
from collections import defaultdict
from statistics import fmean

import pytest

from oodmill.operators import retention as operator
from oodmill.plans import retention

FLAGS = [*retention.SEQ.values(), *retention.STR.values()]


def stored(spark, path, rows):
    """rows: (dataset, y, scenario flag or None); rows without a flag are the pool."""
    data = [(i, d, float(y), "True", flag == "ood_orphan", flag == "ood_longtail", *[False] * len(FLAGS)) for i, (d, y, flag) in enumerate(rows)]
    kinds = "row_id bigint, dataset string, idr_ratio double, default_flag string, ood_orphan boolean, ood_longtail boolean, " + ", ".join(f"{f} boolean" for f in FLAGS)
    spark.createDataFrame(data, kinds).write.parquet(f"{path}/ood_flags.parquet")
    return str(path)


def test_controls_are_averaged_over_fifty_draws(spark, tmp_path):
    rows = [("a", (i * 37 % 60) / 100, None) for i in range(60)] + [("b", 0.5 + (i * 17 % 40) / 100, None) for i in range(40)]
    rows += [("a", 0.9, "ood_orphan")] * 15 + [("b", 0.1, "ood_orphan")] * 10
    pool, overall = defaultdict(list), fmean(y for _, y, flag in rows if not flag)
    for i, (d, y, flag) in enumerate(rows):
        if not flag:
            pool[d].append((i, y))
    mean, b, b0 = {d: fmean(y for _, y in held) for d, held in pool.items()}, [], []
    for k in range(1, 51):
        drawn = [(d, y) for d, n in (("a", 15), ("b", 10)) for _, y in sorted(pool[d], key=lambda r: hashlib.md5(f"{k}:{r[0]}".encode()).hexdigest())[:n]]
        b.append(fmean(abs(y - mean[d]) for d, y in drawn))
        b0.append(fmean(abs(y - overall) for _, y in drawn))
    got = retention.matched_control_retention(spark, stored(spark, tmp_path, rows)).collect()
    assert [(r["scenario"], r["n"]) for r in got] == [("ood_orphan", 25)]
    assert (got[0]["b"], got[0]["b0"]) == pytest.approx((fmean(b), fmean(b0)), abs=1.1e-5)


def test_strata_without_reference_advantage_have_no_ratio(spark, tmp_path):
    # in a, the mean is further from most rows than the overall mean is, so the predictor is worse than the null one
    rows = [("a", i < 10, None) for i in range(40)] + [("b", 0, None)] * 40 + [("a", i < 20, "ood_orphan") for i in range(40)] + [("b", 0, "ood_longtail")] * 40
    got = retention.retention_summary(spark, stored(spark, tmp_path, rows)).first()
    assert got["strata"] == 1 and (got["prodpr"], got["worst"]) == pytest.approx((1.0, 1.0))


def test_small_reference_advantage_has_no_ratio(spark):
    rows = [(i, "p", e, 1.0, s) for i, (s, e) in enumerate([("none", 0.995)] * 30 + [("x", 0.5)] * 30)]
    df = spark.createDataFrame(rows, "id int, profile string, e double, e0 double, scenario string")
    got = operator.matched_retention(df, "id", "profile", "e", "e0", ["scenario"], operator.F.col("scenario") == "none", draws=2).first()
    assert got["dpr"] is None and got["b"] == pytest.approx(0.995)
