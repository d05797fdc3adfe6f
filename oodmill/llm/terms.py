"""Frequency of every term over the whole collection, by last-seen counters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oodmill.session import cut

COUNTS = "term string, occurrences bigint, records bigint"


class Counters:
    """Last-seen counters: a term holds its occurrences, its records and the record it was last seen in; a token whose
    record differs from that one opens a new record, so no set of records is kept for a term."""

    def __init__(self) -> None:
        self.place: dict[str, int] = {}
        self.occurrences, self.records, self.last = (np.zeros(1024, np.int64) for _ in range(3))
        self.seen = 0

    def add(self, terms: pa.ListArray) -> None:
        """Counts the records of a batch, in order."""
        size = np.diff(terms.offsets.to_numpy())
        record = np.repeat(np.arange(self.seen + 1, self.seen + 1 + len(terms)), size)
        self.seen += len(terms)
        if not len(record):
            return
        coded = pa.compute.dictionary_encode(terms.values.slice(terms.offsets[0].as_py(), len(record)))
        slot = np.array([self.place.setdefault(t, len(self.place)) for t in coded.dictionary.to_pylist()], np.int64)
        if len(self.place) > len(self.last):
            more = 2 * len(self.place) - len(self.last)
            self.occurrences, self.records, self.last = (np.r_[x, np.zeros(more, np.int64)] for x in (self.occurrences, self.records, self.last))
        token = slot[coded.indices.to_numpy(zero_copy_only=False)]
        # tokens of a term stand together, in the order of their records
        order = np.argsort(token, kind="stable")
        token, record = token[order], record[order]
        first = np.r_[True, token[1:] != token[:-1]]
        before = np.where(first, self.last[token], np.r_[0, record[:-1]])
        start = np.flatnonzero(first)
        self.occurrences[token[start]] += np.diff(np.r_[start, len(token)])
        self.records[token[start]] += np.add.reduceat((record != before).astype(np.int64), start)
        self.last[token[start]] = record[np.r_[start[1:], len(token)] - 1]

    def batch(self) -> pa.RecordBatch:
        n = len(self.place)
        return pa.RecordBatch.from_pydict(
            {"term": pa.array(list(self.place), pa.string()), "occurrences": pa.array(self.occurrences[:n]), "records": pa.array(self.records[:n])}
        )


def _partial(batches: Iterator[pa.RecordBatch], most: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """Counters of one partition, and the number of its records under no term. A record lies in one batch, so counters
    may be handed on and begun again between batches: at most `most` terms and those of a batch are held."""
    counters, records = Counters(), 0
    for batch in batches:
        counters.add(batch.column(0))
        if len(counters.place) > most:
            records += counters.seen
            yield counters.batch()
            counters = Counters()
    yield counters.batch()
    yield pa.RecordBatch.from_pydict({"term": pa.array([None], pa.string()), "occurrences": pa.array([0]), "records": pa.array([records + counters.seen])})


def _counted(df: DataFrame, terms: Column) -> DataFrame:
    """Counters merged by term, each term in one hash partition; the row without a term has the number of records."""
    tokens = df.select(F.filter(terms, lambda t: t.isNotNull()).cast("array<string>").alias("terms")).where(F.size("terms") > 0)
    return tokens.mapInArrow(_partial, COUNTS).groupBy("term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))


def term_frequency(df: DataFrame, terms: Column) -> DataFrame:
    """(term, occurrences, records) of an array column of canonical terms.

    NULL terms, NULL and empty arrays count nowhere; a repeated term in one record adds occurrences but one record;
    repeated rows are separate records. Counters are built where the rows lie, record after record, and only they are
    shuffled, so a term that a third of all rows carry sends no more than any other. An empty table gives an empty
    result.
    """
    return _counted(df, terms).where("term is not null")


def label_terms(label: Column) -> Column:
    """The EC and GO terms of a label text, each in one spelling; what is neither is no term.

    GO terms become GO: and seven digits; EC terms lose prefix and blanks, become lower case and get four places.
    """
    parts = F.transform(F.split(F.lower(label), "[;,|]"), lambda t: F.regexp_replace(t, r"[\s ]+", ""))

    def canonical(t: Column) -> Column:
        go = F.regexp_extract(t, r"^(?:go)?[:_\-]*(\d{7})$", 1)
        ec = F.regexp_replace(t, r"^ec[:_\-]*", "")
        places = F.filter(F.split(ec, r"\."), lambda p: ~p.isin("", "-"))
        padded = F.concat_ws(".", F.slice(F.concat(places, F.array_repeat(F.lit("-"), 4)), 1, 4))
        return F.when(go != "", F.concat(F.lit("GO:"), go)).when(ec.rlike(r"^[1-9]\d*(\.(\d+|n\d+|-)?){0,3}$"), padded)

    return F.filter(F.transform(parts, canonical), lambda t: t.isNotNull())


def term_verdicts(df: DataFrame, terms: Column, rare_below: int = 3, common_above: float = 0.05) -> DataFrame:
    """term_frequency with a verdict: rare in fewer than rare_below records, common in more than common_above of them.

    The share is of records with at least one term. A term that is both (a tiny collection) is rare.
    """
    counted = cut(_counted(df, terms))  # one row a term; the table itself is read once
    total = counted.where("term is null").agg(F.coalesce(F.sum("records"), F.lit(0))).first()[0]
    verdict = F.when(F.col("records") < rare_below, "rare").when(F.col("records") * 1_000_000 > total * round(common_above * 1_000_000), "common")
    return counted.where("term is not null").select("term", "occurrences", "records", verdict.alias("verdict"))
