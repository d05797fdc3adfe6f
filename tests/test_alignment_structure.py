import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from oodmill.operators import alignment, structure

words = st.text("ACDE", max_size=12)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return row[-1]


@settings(max_examples=150, deadline=None)
@given(words, words)
def test_alignment_has_the_edit_distance(a, b):
    pairs = alignment.align(a, b)
    assert all(i < k and j < m for (i, j), (k, m) in zip(pairs, pairs[1:], strict=False))
    cost = sum(a[i] != b[j] for i, j in pairs) + len(a) + len(b) - 2 * len(pairs)
    assert cost == distance(a, b)


def test_identity():
    assert alignment.identity("ACDE", "ACDE") == 1.0
    assert alignment.identity("ACDE", "ACE") == 0.75
    assert alignment.identity("", "A") == 0.0 and alignment.identity(None, "A") is None
    assert alignment.identity_cascade("CD", "ACDE") == 1.0
    assert alignment.identity_cascade("ACDE", "ACXY") == 0.5
    assert alignment.best_window("CD", "AACDCD") == (2, 2)
    assert alignment.best_window("CDE", "A") == (-1, 0)


def test_transfer():
    assert alignment.transfer("ACDEFGHIKL", [1, 0, 0, 0, 0, 0, 0, 0, 0, 1], "ACDEFGHIKL") == [1, 0, 0, 0, 0, 0, 0, 0, 0, 1]
    assert alignment.transfer("ACDEFGHIKL", list(range(10)), "ACDEFGHIKLM") == [*range(10), -1]
    assert alignment.transfer("ACDE", [1, 1, 1, 1], "WWWW") is None
    assert alignment.transfer("ACDE", [1], "ACDE") is None
    assert alignment.transfer_blocks("ACDE", [1, 2, 3, 4], "AXDEF") == [1, 2, 3, 4, -1]
    assert alignment.transfer_runs(["AC", "E"], "ACDE", [1, 2, 3, 4]) == [1, 2, 4]
    # a run that stands twice or never stays -1, the others keep their labels; runs that claim one place are refused
    assert alignment.transfer_runs(["A", "DE", "W"], "ACADE", [1, 2, 3, 4, 5]) == [-1, 4, 5, -1]
    assert alignment.transfer_runs(["CD", "DE"], "ACDE", [1, 2, 3, 4]) is None
    assert alignment.crop("CD", "ACDE") == ("substring", 1, 3)
    assert alignment.crop("ACDEFGHIKL", "WACDEFGHWKLW")[0] == "aligned"
    assert alignment.crop("ACDE", "WWWW") == ("none", -1, -1)


def test_alignment_columns(spark):
    df = spark.createDataFrame([("ACDE", "ACE", [1, 2, 3, 4]), ("A", None, [1]), ("ACDE", "ACE", [1, 2, 3, 4])], "a string, b string, l array<int>")
    assert sorted(str(r["identity"]) for r in alignment.with_identity(df, "a", "b").collect()) == ["0.75", "0.75", "None"]
    assert [r["labels_out"] for r in alignment.with_transfer(df, "a", "l", "b").collect()] == [[1, 2, 4], None, [1, 2, 4]]


def test_structures(spark):
    rng = np.random.default_rng(0)
    true = rng.normal(0, 5, (20, 3))
    turn, _ = np.linalg.qr(rng.normal(size=(3, 3)))
    turn *= np.sign(np.linalg.det(turn))
    model = true @ turn + 7
    assert structure.rmsd(model, true) == pytest.approx(0, abs=1e-8)
    assert structure.gdt_ts(model, true) == 1.0
    assert structure.lddt(model, true) == 1.0
    rows = [("p", *map(float, m), *map(float, t)) for m, t in zip(model, true, strict=True)] + [("q", 0.0, 0.0, 0.0, 0.0, 0.0, 0.0), ("p", None, 0.0, 0.0, 0.0, 0.0, 0.0)]
    got = {r["k"]: r for r in structure.compared(spark.createDataFrame(rows, "k string, x double, y double, z double, tx double, ty double, tz double"), "k").collect()}
    assert got["p"]["atoms"] == 20 and got["p"]["rmsd"] == pytest.approx(0, abs=1e-6) and got["q"]["rmsd"] is None
