"""Global alignment of sequence pairs and transfer of residue labels, in Arrow batches of pairs."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oodmill.session import merged


def align(a: str, b: str) -> list[tuple[int, int]]:
    """Positions put opposite each other by a global alignment of least edit distance; ties prefer pairs to gaps.

    Each row of the table is one vector step: gaps along it are a running minimum.
    """
    if not a or not b:
        return []
    x, y = (np.frombuffer(s.encode("utf-32-le"), np.uint32) for s in (a, b))
    n, m = len(x), len(y)
    steps = np.arange(m + 1)
    table = np.empty((n + 1, m + 1), np.int32)
    table[0] = steps
    for i in range(1, n + 1):
        best = np.empty(m + 1, np.int32)
        best[0] = i
        np.minimum(table[i - 1, :-1] + (y != x[i - 1]), table[i - 1, 1:] + 1, out=best[1:])
        table[i] = np.minimum.accumulate(best - steps) + steps
    pairs, i, j = [], n, m
    while i and j:
        if table[i, j] == table[i - 1, j - 1] + (x[i - 1] != y[j - 1]):
            i, j = i - 1, j - 1
            pairs.append((i, j))
        elif table[i, j] == table[i - 1, j] + 1:
            i -= 1
        else:
            j -= 1
    return pairs[::-1]


def identity(a: str | None, b: str | None) -> float | None:
    """Matches over alignment length; NULL if either is missing, 0 for an empty one."""
    if a is None or b is None:
        return None
    if a == b:
        return 1.0 if a else 0.0
    pairs = align(a, b)
    length = len(a) + len(b) - len(pairs)
    return sum(a[i] == b[j] for i, j in pairs) / length if length else 0.0


def identity_cascade(a: str | None, b: str | None) -> float | None:
    """1 if equal or one holds the other, else matches at equal positions over the longer length."""
    if a is None or b is None:
        return None
    if a == b or a in b or b in a:
        return 1.0 if a and b else 0.0
    return sum(p == q for p, q in zip(a, b, strict=False)) / max(len(a), len(b))


def best_window(query: str, target: str) -> tuple[int, int]:
    """(start, matches) of the window of target as long as query with most equal letters; the first of equals; start
    is -1 where target is shorter."""
    n = len(query)
    if not n or len(target) < n:
        return -1, 0
    x, y = (np.frombuffer(s.encode("utf-32-le"), np.uint32) for s in (query, target))
    hits = (np.lib.stride_tricks.sliding_window_view(y, n) == x).sum(1)
    return int(hits.argmax()), int(hits.max())


def transfer(source: str, labels: list[int], target: str, least_identity: float = 0.75, sure: float = 0.85, coverage: float = 0.75) -> list[int] | None:
    """Labels of source carried to target through an alignment, -1 opposite gaps; None unless the identity of the
    opposite letters reaches `sure`, or least_identity at enough coverage."""
    if len(source) != len(labels):
        return None
    if source == target:
        return list(labels)
    pairs = align(source, target)
    if not pairs:
        return None
    same = sum(source[i] == target[j] for i, j in pairs) / len(pairs)
    if not (same >= sure or same >= least_identity and len(pairs) / max(1, len(target)) >= coverage):
        return None
    out = [-1] * len(target)
    for i, j in pairs:
        out[j] = labels[i]
    return out


def transfer_blocks(source: str, labels: list[int], target: str) -> list[int]:
    """Labels carried over equal and equally long replaced stretches of a longest-block comparison, -1 elsewhere."""
    out = [-1] * len(target)
    for tag, i1, i2, j1, j2 in SequenceMatcher(None, source, target, autojunk=False).get_opcodes():
        if tag == "equal" or tag == "replace" and i2 - i1 == j2 - j1:
            out[j1:j2] = labels[i1:i2]
    return out


def transfer_runs(runs: list[str], sequence: str, labels: list[int]) -> list[int] | None:
    """Labels of a sequence carried to the residues of a structure, given as unbroken runs of letters: a run that stands
    exactly once in the sequence takes the labels of its place, all others are -1; None if two runs claim one place."""
    out: list[int] = []
    taken: set[int] = set()
    for letters in runs:
        at = sequence.find(letters) if letters else -1
        if at < 0 or sequence.find(letters, at + 1) >= 0:
            out += [-1] * len(letters)
            continue
        places = range(at, at + len(letters))
        if not taken.isdisjoint(places):
            return None
        taken.update(places)
        out += [labels[p] for p in places]
    return out


def crop(sequence: str, structure: str, least: float = 0.9) -> tuple[str, int, int]:
    """(how, start, end) of the stretch of structure that shows sequence: exact, substring, aligned or none."""
    if sequence == structure:
        return "exact", 0, len(structure)
    at = structure.find(sequence) if sequence else -1
    if at >= 0:
        return "substring", at, at + len(sequence)
    same = [(i, j) for i, j in align(sequence, structure) if sequence[i] == structure[j]]
    if same and len(same) / len(sequence) >= least:
        return "aligned", same[0][1], same[-1][1] + 1
    return "none", -1, -1


def with_identity(pairs: DataFrame, a: str, b: str, out: str = "identity") -> DataFrame:
    """pairs with the alignment identity of two text columns; equal pairs of texts are aligned once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(v=[identity(x, y) for x, y in zip(batch["x"], batch["y"], strict=True)])

    distinct = pairs.select(F.col(a).alias("x"), F.col(b).alias("y")).distinct()
    scored = distinct.mapInPandas(run, "x string, y string, v double").select(F.col("x").alias("_x"), F.col("y").alias("_y"), F.col("v").alias(out))
    return pairs.join(merged(scored), F.col(a).eqNullSafe(F.col("_x")) & F.col(b).eqNullSafe(F.col("_y")), "left").drop("_x", "_y")


def with_transfer(df: DataFrame, source: str, labels: str, target: str, out: str = "labels_out") -> DataFrame:
    """df with the labels of source carried to target; NULL where the alignment is not accepted."""
    kept = [c for c in df.columns if c != out]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*kept).schema) + f", `{out}` array<int>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = zip(batch[source], batch[labels], batch[target], strict=True)
            batch[out] = [None if s is None or x is None or t is None else transfer(s, list(x), t) for s, x, t in rows]
            yield batch

    return df.select(*kept).mapInPandas(run, schema)
