"""Superposition and distance measures of structures, one protein a group."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def superposed(mobile: np.ndarray, fixed: np.ndarray) -> np.ndarray:
    """mobile moved onto fixed by the rotation and shift of least squared distance."""
    a, b = mobile - mobile.mean(0), fixed - fixed.mean(0)
    u, _, vt = np.linalg.svd(a.T @ b)
    turn = np.diag([1.0] * (a.shape[1] - 1) + [np.sign(np.linalg.det(u @ vt)) or 1.0])
    return a @ (u @ turn @ vt) + fixed.mean(0)


def rmsd(mobile: np.ndarray, fixed: np.ndarray) -> float:
    return float(np.sqrt(((superposed(mobile, fixed) - fixed) ** 2).sum(1).mean()))


def gdt_ts(mobile: np.ndarray, fixed: np.ndarray) -> float:
    """Mean share of points within 1, 2, 4 and 8 after superposition."""
    d = np.sqrt(((superposed(mobile, fixed) - fixed) ** 2).sum(1))
    return float(np.mean([(d <= c).mean() for c in (1, 2, 4, 8)]))


def lddt(model: np.ndarray, true: np.ndarray, radius: float = 15.0) -> float:
    """Share of true distances within radius that the model keeps, over tolerances 0.5, 1, 2 and 4; no superposition."""
    pair = lambda x: np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    want, have = pair(true), pair(model)
    near = (want < radius) & ~np.eye(len(true), dtype=bool)
    if not near.any():
        return 0.0
    off = np.abs(want - have)[near]
    return float(np.mean([(off < t).mean() for t in (0.5, 1, 2, 4)]))


def compared(atoms: DataFrame, key: str) -> DataFrame:
    """(key, atoms, rmsd, gdt_ts, lddt) of each protein; atoms: key, x, y, z and tx, ty, tz of the same atom.

    The points of one protein meet in one task; proteins are bounded. Rows with a missing coordinate are left out;
    fewer than three points give NULL.
    """
    clean = atoms.dropna(subset=["x", "y", "z", "tx", "ty", "tz"])

    def run(part: pd.DataFrame) -> pd.DataFrame:
        m, t = part[["x", "y", "z"]].to_numpy(float), part[["tx", "ty", "tz"]].to_numpy(float)
        few = len(m) < 3
        return pd.DataFrame({key: [part[key].iat[0]], "atoms": [len(m)], "rmsd": [None if few else rmsd(m, t)], "gdt_ts": [None if few else gdt_ts(m, t)], "lddt": [None if few else lddt(m, t)]})

    kind = dict(atoms.dtypes)[key]
    return clean.groupBy(key).applyInPandas(run, f"`{key}` {kind}, atoms bigint, rmsd double, gdt_ts double, lddt double")
