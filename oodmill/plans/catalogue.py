"""All queries of the core, with their SQL."""

from __future__ import annotations

from oodmill.plans import basics, content, curation, evaluation, files, novelty, quality, relational, retention

MODULES = [basics, evaluation, files, relational, novelty, content, curation, retention, quality]


def queries() -> dict:
    return {k: q for m in MODULES for k, q in m.QUERIES.items()}


def oracles() -> dict:
    return {k: q for m in MODULES for k, q in m.ORACLES.items()}
