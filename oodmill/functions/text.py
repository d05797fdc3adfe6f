"""String functions on columns: sequences, labels, hierarchical codes, affinities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the twenty standard residues.
STANDARD = "ACDEFGHIKLMNPQRSTVWY"
# Three-letter residue names (standard, then common modified ones) and their letters.
RESIDUES = {
    "ALA": "A", "ARG": "R", "ASN": "N", "ASP": "D", "CYS": "C", "GLN": "Q", "GLU": "E", "GLY": "G", "HIS": "H", "ILE": "I", "LEU": "L", "LYS": "K",
    "MET": "M", "PHE": "F", "PRO": "P", "SER": "S", "THR": "T", "TRP": "W", "TYR": "Y", "VAL": "V", "MSE": "M", "SEC": "U", "PYL": "O",
}
# Affinity units in mol per litre; M alone is written in upper case, the others also in lower case.
MOLAR = {"fM": 1e-15, "pM": 1e-12, "nM": 1e-9, "uM": 1e-6, "\u03bcM": 1e-6, "mM": 1e-3, "M": 1.0, "fm": 1e-15, "pm": 1e-12, "nm": 1e-9, "um": 1e-6}
# The form of affinity texts, and of the error in them.
AFFINITY = "^(Kd|Ki|IC50|EC50)(<=|>=|[=<>~\u2264\u2265])([0-9]+\\.?[0-9]*(?:[eE][-+]?[0-9]+)?)([a-zA-Z\u03bc\u00b5]+)"
ERROR = r"\+/-\s*[0-9]+\.?[0-9]*"
# Tags in the notes of affinity lines.
NOTES = {
    "incomplete_ligand": r"\[Incomplete ligand\]", "covalent_complex": r"\[Covalent complex\]", "different_protein": r"\[Different protein in assay\]",
    "different_ligand": r"\[Different ligand in assay\]", "uncommon_element": r"\[Uncommon element:\s*([^\]]+)\]", "disulfide_bond": r"\[Disulfide bond\]",
}


def clean_strip(c: Column) -> Column:
    """Upper case, everything but standard residues removed."""
    return F.regexp_replace(F.upper(c), f"[^{STANDARD}]", "")


def clean_map(c: Column) -> Column:
    """Upper case, ambiguous residues mapped to a near one, anything else to A."""
    return F.regexp_replace(F.translate(F.upper(c), "BZJUO", "NQLCK"), f"[^{STANDARD}]", "A")


def clean_drop(c: Column) -> Column:
    """Ambiguous letters removed, the rest kept as it is."""
    return F.translate(c, "XBZJU", "")


def tokens(c: Column, separators: str = ";") -> Column:
    """Trimmed distinct tokens in first-seen order, empty ones dropped; NULL gives NULL."""
    return F.array_distinct(F.filter(F.transform(F.split(c, f"[{separators}]"), lambda t: F.trim(t)), lambda t: t != ""))


def code_prefix(c: Column, k: int) -> Column:
    """First k places of a dotted code; shorter codes stay whole."""
    return F.array_join(F.slice(F.split(c, r"\."), 1, k), ".")


def ec_level(c: Column) -> Column:
    """Number of places that are filled."""
    return F.size(F.filter(F.split(c, r"\."), lambda p: ~p.isin("", "-")))


def ec_padded(c: Column) -> Column:
    """Code with open places written as -, four places in all."""
    given = F.filter(F.split(c, r"\."), lambda p: ~p.isin("", "-"))
    return F.array_join(F.slice(F.concat(given, F.array_repeat(F.lit("-"), 4)), 1, 4), ".")


def ec_third_level(codes: Column) -> Column:
    """Codes cut to three places and a dash, distinct in first-seen order."""
    return F.array_distinct(F.transform(codes, lambda c: F.concat(code_prefix(c, 3), F.lit(".-"))))


def affinity(c: Column) -> Column:
    """struct(kind, relation, p): p is -log10 of the molar value of texts such as Kd=10nM, IC50<5uM or Kd=7.3+/-0.2uM (the
    error is left out); NULL if the text is none, its unit is unknown or its value is not positive."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(c), ERROR, ""), r"\s+", "")
    part = lambda k: F.regexp_extract(bare, AFFINITY, k)
    scale = F.create_map(*[F.lit(x) for kv in MOLAR.items() for x in kv])
    unit = F.replace(part(4), F.lit("\u00b5"), F.lit("\u03bc"))
    molar = part(3).try_cast("double") * F.coalesce(F.try_element_at(scale, unit), F.try_element_at(scale, F.lower(unit)))
    return F.when(molar > 0, F.struct(part(1).alias("kind"), part(2).alias("relation"), (-F.log10(molar)).alias("p")))


def note_tags(c: Column) -> Column:
    """struct of the six tags of a note: whether it stands there, for the uncommon element which."""
    cells = [
        F.nullif(F.trim(F.regexp_extract(c, f"(?i){p}", 1)), F.lit("")).alias(k) if k == "uncommon_element" else F.coalesce(c.rlike(f"(?i){p}"), F.lit(False)).alias(k)
        for k, p in NOTES.items()
    ]
    return F.struct(*cells)


def as_bool(c: Column, kind: str) -> Column:
    """A flag given as boolean, number (above 0.5) or text (1, 1.0, true, t, yes, y); NULL, NaN and other texts are False."""
    if kind == "boolean":
        return F.coalesce(c, F.lit(False))
    if kind == "string":
        return F.coalesce(F.lower(F.trim(c)).isin("1", "1.0", "true", "t", "yes", "y"), F.lit(False))
    return F.coalesce(F.nanvl(c.cast("double"), F.lit(0.0)), F.lit(0.0)) > 0.5


def residue_letters(names: Column) -> Column:
    """One-letter sequence of an array of three-letter residue names; unknown ones become X."""
    letters = F.create_map(*[F.lit(x) for kv in RESIDUES.items() for x in kv])
    return F.array_join(F.transform(names, lambda n: F.coalesce(F.try_element_at(letters, F.upper(n)), F.lit("X"))), "")


def go_terms(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"(GO:\d{7,})"), F.lit(1))


def words(c: Column) -> Column:
    """Lower-case words of letters and digits, in order."""
    return F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda w: w != "")


def ngrams(w: Column, stop: tuple[str, ...] = ()) -> Column:
    """Distinct words and pairs of neighbours of an array of words, without those that are a stop term. The array should be
    a column of its own (split in an earlier projection), as it is read several times."""
    n = F.greatest(F.size(w) - 1, F.lit(0))
    # both halves are arrays of their own: a lambda that looked back into w would split the text again for each word
    pairs = F.zip_with(F.slice(w, 1, n), F.slice(w, 2, n), lambda x, y: F.concat_ws(" ", x, y))
    every = F.array_distinct(F.concat(w, pairs))
    return F.array_except(every, F.array(*[F.lit(t) for t in stop])) if stop else every


def keyword_ngrams(c: Column, stop: tuple[str, ...] = ()) -> Column:
    """Distinct one- and two-word keywords: hyphens part words, one-letter words are dropped, and so are keywords that
    are a stop term."""
    return ngrams(F.filter(words(c), lambda x: F.length(x) > 1), stop)


def stem(c: Column) -> Column:
    """File name without folders and extension."""
    return F.regexp_replace(F.element_at(F.split(c, "/"), -1), r"\.(pdb|cif|ent)(\.gz)?$", "")


def is_predicted(c: Column) -> Column:
    low = F.lower(c)
    return low.startswith("af-") | low.startswith("af__") | low.contains("alphafold")


def ranges(c: Column) -> Column:
    """Array of struct(beg, end) of a text such as 1-3,7; parts that are no range are left out."""
    part = lambda t, k: F.regexp_extract(t, r"^\s*(-?\d+)(?:\s*-\s*(-?\d+))?\s*$", k)
    read = F.transform(F.split(c, ","), lambda t: F.when(part(t, 1) != "", F.struct(part(t, 1).try_cast("int").alias("beg"), F.coalesce(part(t, 2).try_cast("int"), part(t, 1).try_cast("int")).alias("end"))))
    return F.filter(read, lambda r: r.isNotNull())


def in_ranges(position: Column, segments: Column) -> Column:
    """Whether a position lies in one of the inclusive ranges."""
    return F.exists(segments, lambda s: position.between(s["beg"], s["end"]))


def in_range_by_code(number: Column, code: Column, beg: Column, beg_code: Column, end: Column, end_code: Column) -> Column:
    """Inside the open range of residue numbers, or at an end point with the same insertion code."""
    return ((number > beg) & (number < end)) | ((number == beg) & (code == beg_code)) | ((number == end) & (code == end_code))


def in_range_by_order(number: Column, code: Column, beg: Column, beg_code: Column, end: Column, end_code: Column) -> Column:
    """Inside the closed range of (number, insertion code) in order; a bound that cannot be read accepts everything."""
    at = F.struct(number.alias("n"), code.alias("c"))
    low, high = F.struct(beg.alias("n"), beg_code.alias("c")), F.struct(end.alias("n"), end_code.alias("c"))
    return beg.isNull() | end.isNull() | ((at >= low) & (at <= high))


def mismatch(a: Column, b: Column) -> Column:
    """How far a sequence is from that of its structure: exact, same_length, near (up to five residues) or large."""
    gap = F.abs(F.length(a) - F.length(b))
    return F.when(a == b, "exact").when(gap == 0, "same_length").when(gap <= 5, "near").when(gap.isNotNull(), "large")


def overlap_ratio(a: Column, b: Column) -> Column:
    """Equal letters at equal places over the longer length; 0 if either is empty."""
    same = F.aggregate(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: (x.isNotNull() & y.isNotNull() & (x == y)).cast("int")), F.lit(0), lambda n, x: n + F.coalesce(x, F.lit(0)))
    return F.when((a == "") | (b == ""), 0.0).otherwise(same / F.greatest(F.length(a), F.length(b)))


def identity_cascade(a: Column, b: Column) -> Column:
    """1 if equal or one holds the other, else equal letters at equal places over the longer length; NULL if either is."""
    held = (a != "") & (b != "") & (a.contains(b) | b.contains(a))
    return F.when(held, 1.0).otherwise(overlap_ratio(a, b))


def side(first: Column, second: Column, wanted: Column) -> Column:
    """Which of two members of a pair, possibly swapped, a sequence is: by equality, by a length only one of them has, else
    by equal letters at equal places, the first on ties."""
    one, two = F.length(first) == F.length(wanted), F.length(second) == F.length(wanted)
    near = F.when(overlap_ratio(first, wanted) >= overlap_ratio(second, wanted), "first_by_likeness").otherwise("second_by_likeness")
    return F.when(first == wanted, "first").when(second == wanted, "second").when(one & ~two, "first_by_length").when(two & ~one, "second_by_length").otherwise(near)


def entry_metadata(c: Column) -> Column:
    """struct of a nested entry document in which each part may be a list or one object: the first method, the X-ray
    resolution or else that of the EM reconstruction, R-factors and the day of deposition."""
    at = lambda part, key: F.coalesce(F.get_json_object(c, f"$.{part}[0].{key}"), F.get_json_object(c, f"$.{part}.{key}"))
    number = lambda x: x.try_cast("double")
    return F.struct(
        F.upper(F.get_json_object(c, "$.rcsb_id")).alias("pdb_id"), at("exptl", "method").alias("method"), F.coalesce(number(at("refine", "ls_d_res_high")), number(at("em_3d_reconstruction", "resolution"))).alias("resolution"),
        number(at("refine", "ls_R_factor_R_work")).alias("r_work"), number(at("refine", "ls_R_factor_R_free")).alias("r_free"), F.get_json_object(c, "$.rcsb_accession_info.deposit_date").alias("deposition_date"),
    )
