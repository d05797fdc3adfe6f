"""Identifiers as the sources type them, brought to one spelling; NULL where the text names nothing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The public form of ten-character UniProt accessions and of six-character entry codes.
ACCESSION = r"[A-NR-Z][0-9](?:[A-Z][A-Z0-9]{2}[0-9]){2}"
ENTRY = r"[1-9][a-z0-9]{5}"
BLANK = r"[\s\u00A0\u2000-\u200B\uFEFF]"


def _filled(c: Column) -> Column:
    return F.when(c != "", c)


def accession(c: Column) -> Column:
    """Bare upper-case accession; database prefixes, versions, entry names and blanks fall away."""
    return _filled(F.regexp_extract(F.upper(c), rf"(?<![A-Z0-9])({ACCESSION})(?![A-Z0-9])", 1))


def accessions(c: Column) -> Column:
    """All accessions in a text such as code__chain_acc--code__chain_acc, in order."""
    return F.regexp_extract_all(F.upper(c), F.lit(rf"(?<![A-Z0-9])({ACCESSION})(?![A-Z0-9])"), F.lit(1))


def entry_code(c: Column) -> Column:
    """Lower-case entry code; placeholders such as ------ or none become NULL."""
    return _filled(F.regexp_extract(F.lower(c), rf"(?<![a-z0-9])({ENTRY})(?![a-z0-9])", 1))


def sample_id(c: Column) -> Column:
    """unique_id with outer blanks gone and the entry code in lower case; the chain keeps its case."""
    bare = F.regexp_replace(c, f"^{BLANK}+|{BLANK}+$", "")
    entry = F.regexp_extract(bare, r"^([1-9][A-Za-z0-9]{5})_", 1)
    model = bare.rlike(r"(?i)^AF-[A-Z0-9]+-F\d+$")
    return _filled(
        F.when(entry != "", F.concat(F.lower(entry), F.substring(bare, 7, 1_000))).when(model, F.upper(bare)).otherwise(bare)
    )


def model_accession(c: Column) -> Column:
    """Accession of a predicted model's name, AF-accession-F1, with or without version and hash; else NULL."""
    return _filled(F.regexp_extract(c, r"^AF-(.+?)-F1(?:-model_v6(?:-[0-9a-f]{8})?)?$", 1))


def letters(c: Column) -> Column:
    """A sequence is its letters in upper case, nothing else; NULL if none is left."""
    return _filled(F.regexp_replace(F.upper(c), "[^A-Z]", ""))


def split_name(c: Column) -> Column:
    return _filled(F.regexp_replace(F.lower(c), f"^{BLANK}+|{BLANK}+$", ""))
