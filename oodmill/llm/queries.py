"""The pN_ queries over the test tables, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oodmill.functions.dates import lenient_date
from oodmill.functions.identifiers import BLANK, accession, accessions, entry_code, letters, sample_id, split_name
from oodmill.llm import fusion, grouping, leakage, neardup, overlap, packing, pii, terms
from oodmill.session import cut, merged, table


def _pair_key() -> F.Column:
    """The unordered pair of bare accessions; UNDEFINED is no protein and leaves no key."""
    a, b = accession(F.col("protein_a_id")), accession(F.col("protein_b_id"))
    rep, old = accessions(F.col("representative_id")), accessions(F.col("pair_key"))
    own = F.when(a.isNotNull() & b.isNotNull(), F.array(a, b))
    two = F.coalesce(own, F.when(F.size(rep) == 2, rep), F.when(F.size(old) == 2, old))
    undefined = F.lit(False)
    for c in ("protein_a_id", "protein_b_id"):
        undefined = undefined | F.coalesce(F.upper(F.regexp_replace(c, f"{BLANK}+", "")).endswith("UNDEFINED"), F.lit(False))
    return F.when(~undefined, F.concat_ws("__", F.array_sort(two)))


def _fields() -> list[fusion.Field]:
    day = lenient_date(F.col("release_date"))
    res = F.col("resolution")
    return [
        fusion.Field("structure_priority", F.when(F.col("structure_priority").between(0, 3), F.col("structure_priority")), "high"),
        fusion.Field("resolution", F.when(~F.isnan(res) & res.between(0.4, 15.0), res), "low"),
        fusion.Field("release", F.when(F.year(day).between(1976, 2025), F.datediff(day, F.lit("1970-01-01").cast("date"))), "high"),
    ]


def _source() -> F.Column:
    tidy = lambda c: F.coalesce(F.lower(F.trim(F.regexp_replace(c, r"[^A-Za-z]+", " "))), F.lit(""))
    return F.concat_ws("|", tidy(F.col("method")), tidy(F.col("split")))


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    got = fusion.best_records(table(spark, sf, "ppi_pairs_corrected_seq95"), F.nullif(_pair_key(), F.lit("")), "row_id", _fields())
    return got.select(F.col("key").alias("pair_key"), "row_id", "resolution_row_id", "release_row_id")


def _representative() -> F.Column:
    """representative_id in one spelling: codes in lower case, bare accessions, the sides in order; NULL if it is none."""
    sides = F.transform(F.split("representative_id", "--"), lambda t: F.struct(entry_code(F.regexp_extract(t, "^(.*?)__", 1)).alias("code"), F.regexp_extract(t, "__([A-Za-z0-9]+)_", 1).alias("chain"), accession(t).alias("acc")))
    whole = F.filter(sides, lambda x: x["code"].isNotNull() & (x["chain"] != "") & x["acc"].isNotNull())
    return F.when(F.size(whole) == 2, F.array_join(F.array_sort(F.transform(whole, lambda x: F.concat(x["code"], F.lit("__"), x["chain"], F.lit("_"), x["acc"]))), "--"))


def p1_fused(spark: SparkSession, sf: str) -> DataFrame:
    """The values of greatest posterior of each pair, and the record that holds most of it."""
    fields = [*_fields(), fusion.Field("representative_id", _representative(), "any")]
    got = fusion.survivors(table(spark, sf, "ppi_pairs_corrected_seq95"), F.nullif(_pair_key(), F.lit("")), "row_id", _source(), fields, prior="flat")
    rounded = [F.round(f"{f.name}_posterior", 4).alias(f"{f.name}_posterior") for f in fields]
    return got.select(F.col("key").alias("pair_key"), "row_id", "structure_priority", "resolution", F.date_add(F.lit("1970-01-01").cast("date"), F.col("release").cast("int")).alias("release_date"), "representative_id", *rounded)


def _overlaps(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "sample_multilabel")
    return overlap.cross_split_pairs(df, "row_id", sample_id(F.col("unique_id")), letters(F.col("aa_seq")), split_name(F.col("split")))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return _overlaps(spark, sf).select(F.least("train_row", "eval_row").alias("row_id_a"), F.greatest("train_row", "eval_row").alias("row_id_b"))


def p2_report(spark: SparkSession, sf: str) -> DataFrame:
    """Per split and source of the held-out record: pairs, held-out records found in train, and their spans."""
    rows = table(spark, sf, "sample_multilabel").select(F.col("row_id").alias("eval_row"), split_name(F.col("split")).alias("split"), F.upper(F.trim("struct_source")).alias("struct_source"))
    return (
        _overlaps(spark, sf)
        .join(rows, "eval_row")
        .groupBy("split", "struct_source")
        .agg(F.count("*").alias("pairs"), F.count_distinct("eval_row").alias("records"), F.count_if("same_id").alias("same_id"), F.count("containment").alias("alike"), F.max("longest").alias("longest"))
    )


def _sequences(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "sample_multilabel").select("row_id", letters(F.col("aa_seq")).alias("seq"))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return neardup.near_duplicates(_sequences(spark, sf), "row_id", "seq")


def p3_groups(spark: SparkSession, sf: str) -> DataFrame:
    return neardup.near_duplicate_groups(_sequences(spark, sf), "row_id", "seq")


def _number(code: F.Column) -> F.Column:
    """Codes and accessions are at most ten letters or digits, so each is a whole number to the base 36, one to one."""
    return F.conv(code, 36, 10).cast("bigint")


def _tied(spark: SparkSession, sf: str) -> DataFrame:
    chains = table(spark, sf, "annotated_chains")
    return grouping.tied_groups(chains, "row_id", {"entry": _number(entry_code(F.col("pdb_id"))), "acc": _number(accession(F.col("uniprot")))})


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    rows = cut(_tied(spark, sf).where("component is not null"))
    # accessions have one length, so the least number is the least text
    groups = rows.groupBy("component").agg(F.count("*").alias("n"), F.min("acc").alias("acc")).where("n > 1 and acc is not null")
    named = groups.select("component", F.lpad(F.conv(F.col("acc").cast("string"), 10, 36), 10, "0").alias("group_key"))
    return rows.join(merged(named), "component").select("row_id", "group_key")


def _stratified(spark: SparkSession, sf: str) -> DataFrame:
    """(row_id, group_key, split and the labels) of every row."""
    shares = {r["split"]: r["share"] for r in table(spark, sf, "split_targets").collect()}
    rows = _tied(spark, sf).withColumn("group", F.coalesce(F.concat(F.lit("tie:"), F.col("component")), F.concat(F.lit("row:"), F.col("row_id"))))
    chains = table(spark, sf, "annotated_chains")
    method = F.upper(F.regexp_replace(F.coalesce("method", F.lit("")), "[^A-Za-z]", ""))
    labels = {
        "ec": F.coalesce("has_ec", F.lit(False)), "go": F.coalesce("has_go", F.lit(False)), "xray": method.startswith("XRAY"), "em": method.startswith("ELECTRON"),
        "nmr": method.contains("NMR"), "many_ec": F.coalesce(F.col("ec_count") > 1, F.lit(False)),
    }
    held = cut(rows.join(chains.select("row_id", *[c.alias(n) for n, c in labels.items()]), "row_id"))
    splits = grouping.stratified_group_split(held, "group", {n: F.col(n) for n in labels}, shares)
    return held.select("row_id", "group", *labels).join(merged(splits.select("group", "split")), "group").select("row_id", F.col("group").alias("group_key"), "split", *labels)


def p5_splits(spark: SparkSession, sf: str) -> DataFrame:
    """(row_id, group_key, split): every row; rows that nothing ties are groups of their own."""
    return _stratified(spark, sf).select("row_id", "group_key", "split")


def p5_shares(spark: SparkSession, sf: str) -> DataFrame:
    """Per split: groups, rows, the share of all rows beside the one wanted, and of the rows of each label."""
    got = _stratified(spark, sf)
    labels = got.columns[3:]
    one = got.groupBy("split").agg(F.count_distinct("group_key").alias("groups"), F.count("*").alias("rows"), *[F.count_if(F.col(c)).alias(c) for c in labels])
    whole = one.agg(*[F.sum(c).alias(f"all_{c}") for c in ("rows", *labels)])
    return table(spark, sf, "split_targets").join(one, "split", "left").crossJoin(F.broadcast(whole)).select(
        "split", "groups", "rows", F.round("share", 4).alias("wanted"), *[F.round(F.col(c) / F.col(f"all_{c}"), 4).alias(f"{c}_share") for c in ("rows", *labels)]
    )


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return p6_terms(spark, sf).where("verdict is not null").select("term", "verdict")


def p6_terms(spark: SparkSession, sf: str) -> DataFrame:
    return terms.term_verdicts(table(spark, sf, "sample_multilabel"), terms.label_terms(F.col("label")))


def p7_containers(spark: SparkSession, sf: str) -> DataFrame:
    kinds = {r["container_kind"]: r["capacity_tokens"] for r in table(spark, sf, "pack_capacities").collect()}
    return packing.pack(table(spark, sf, "documents"), "doc_id", "text", kinds)


def p7_room(spark: SparkSession, sf: str) -> DataFrame:
    """Per container kind: containers, tokens held and the share of their room left unused."""
    kinds = table(spark, sf, "pack_capacities").select("container_kind", "capacity_tokens")
    boxes = p7_containers(spark, sf).groupBy("container_kind", "container_id").agg(F.sum("tokens").alias("held"))
    room = F.count("*") * F.first("capacity_tokens")
    return boxes.join(F.broadcast(kinds), "container_kind").groupBy("container_kind").agg(
        F.count("*").alias("containers"), F.sum("held").alias("tokens"), F.round(1 - F.sum("held") / room, 6).alias("unused_share")
    )


def _leaks(spark: SparkSession, sf: str) -> DataFrame:
    return leakage.leaked(table(spark, sf, "documents"), "doc_id", "text", table(spark, sf, "eval_items"), "item_id", "item_text")


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return _leaks(spark, sf).select("doc_id", "item_id")


def p8_clean_documents(spark: SparkSession, sf: str) -> DataFrame:
    """The documents that disclose no test item."""
    return leakage.without_leaks(table(spark, sf, "documents"), "doc_id", _leaks(spark, sf)).select("doc_id", "source", "doc_kind", "n_chars")


def p8_spans(spark: SparkSession, sf: str) -> DataFrame:
    """Where the passages stand in the documents."""
    return leakage.leaked_spans(table(spark, sf, "documents"), "doc_id", "text", table(spark, sf, "eval_items"), "item_id", "item_text")


def p8_cut_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Every document, the leaked passages cut out of its text."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return leakage.without_passages(docs, "text", table(spark, sf, "eval_items"), "item_id", "item_text")


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return pii.mentions(table(spark, sf, "documents"), "doc_id", "text").select("doc_id", "pii_type", "start_char")


def p9_redacted(spark: SparkSession, sf: str) -> DataFrame:
    return pii.redacted(table(spark, sf, "documents"), "doc_id", "text")


QUERIES = {f.__name__: f for f in (p1_found, p1_fused, p2_found, p2_report, p3_found, p3_groups, p5_found, p5_splits, p5_shares, p6_found, p6_terms, p7_containers, p7_room, p8_found, p8_clean_documents, p8_spans, p8_cut_documents, p9_found, p9_redacted)}
_ACC = "[A-NR-Z][0-9](?:[A-Z][A-Z0-9]{2}[0-9]){2}"
_ONE = f"(?:^|[^A-Z0-9])({_ACC})(?:[^A-Z0-9]|$)"
_LETTERS = "regexp_replace(upper(aa_seq), '[^A-Z]', '', 'g')"
_WINDOWS = f"""s as (select row_id, lower(trim(split, E' \\t\\n\\r')) as split, trim(unique_id, E' \\t\\n\\r') as u, {_LETTERS} as q from sample_multilabel),
w as (select row_id, split, unnest(list_distinct(list_transform(range(1, length(q) - 3), lambda i: substr(q, i, 5)))) as w from s where length(q) >= 5), n as (select row_id, count(*) as n from w group by 1)"""

ORACLES: dict[str, str] = {
    "p1_found": f"""
with c as (select *, nullif(regexp_extract(upper(protein_a_id), '{_ONE}', 1), '') as a, nullif(regexp_extract(upper(protein_b_id), '{_ONE}', 1), '') as b,
  regexp_extract_all(upper(representative_id), '{_ACC}') as rep, regexp_extract_all(upper(pair_key), '{_ACC}') as old, trim(release_date) as d from ppi_pairs_corrected_seq95
  where not coalesce(upper(trim(protein_a_id)) = 'UNDEFINED', false) and not coalesce(upper(trim(protein_b_id)) = 'UNDEFINED', false)),
k as (select row_id, list_sort(case when a is not null and b is not null then [a, b] when len(rep) = 2 then rep when len(old) = 2 then old end) as two,
  case when structure_priority between 0 and 3 then structure_priority end as p, case when resolution between 0.4 and 15 then resolution end as r,
  try_strptime(case when regexp_matches(d, '^\\d{{4}}-\\d{{2}}-\\d{{2}}') then left(d, 10) else d end, ['%Y-%m-%d', '%Y/%m/%d', '%Y%m%d', '%d-%b-%y', '%d %b %Y']) as day from c),
v as (select two[1] || '__' || two[2] as pair_key, row_id, p, r, case when year(day) between 1976 and 2025 then day end as day from k where two is not null)
select pair_key, first(row_id order by p desc nulls last, r nulls last, day desc nulls last, row_id) as row_id, coalesce(first(row_id order by r, row_id) filter (r is not null), 0) as resolution_row_id,
  coalesce(first(row_id order by day desc, row_id) filter (day is not null), 0) as release_row_id from v group by 1 having count(*) > 1""".replace("\\\\d", "\\d"),
    "p2_found": f"""
with {_WINDOWS}, t as (select * from w where split = 'train'), e as (select * from w where split in ('val', 'test')),
p as (select t.row_id as x, e.row_id as y, count(*) as s from t join e on t.w = e.w group by all),
i as (select row_id, split, case when regexp_matches(u, '^[1-9][A-Za-z0-9]{{5}}_') then lower(left(u, 6)) || substr(u, 7) else u end as u from s where u <> ''),
f as (select x, y from p join n a on a.row_id = x join n b on b.row_id = y where s >= 0.8 * least(a.n, b.n) - 1e-9
  union select a.row_id, b.row_id from i a join i b on a.u = b.u where a.split = 'train' and b.split in ('val', 'test'))
select least(x, y) as row_id_a, greatest(x, y) as row_id_b from f""",
    "p3_found": f"""
with {_WINDOWS}, p as (select x.row_id as a, y.row_id as b, count(*) as s from w x join w y on x.w = y.w and x.row_id < y.row_id group by all)
select a as row_id_a, b as row_id_b from p join n x on x.row_id = a join n y on y.row_id = b where s >= 0.6 * (x.n + y.n - s) - 1e-9""",
    "p6_found": """
with t as (select row_id, regexp_replace(unnest(regexp_split_to_array(lower(label), '[;,|]')), '\\s+', '', 'g') as t from sample_multilabel where label is not null),
g as (select row_id, regexp_extract(t, '^(?:go)?[:_-]*(\\d{7})$', 1) as go, regexp_replace(t, '^ec[:_-]*', '') as ec from t),
c as (select distinct row_id, case when go <> '' then 'GO:' || go when regexp_matches(ec, '^[1-9]\\d*(\\.(\\d+|n\\d+|-)?){0,3}$') then
  array_to_string(list_slice(list_concat(list_filter(string_split(ec, '.'), lambda p: p not in ('', '-')), ['-', '-', '-', '-']), 1, 4), '.') end as term from g),
n as (select term, count(*) as n from c where term is not null group by 1), r as (select count(distinct row_id) as r from c where term is not null)
select term, case when n < 3 then 'rare' else 'common' end as verdict from n, r where n < 3 or n > 0.05 * r""".replace("\\\\", "\\"),
    "p6_terms": """
with t as (select row_id, regexp_replace(unnest(regexp_split_to_array(lower(label), '[;,|]')), '\\s+', '', 'g') as t from sample_multilabel where label is not null),
g as (select row_id, regexp_extract(t, '^(?:go)?[:_-]*(\\d{7})$', 1) as go, regexp_replace(t, '^ec[:_-]*', '') as ec from t),
c as (select row_id, case when go <> '' then 'GO:' || go when regexp_matches(ec, '^[1-9]\\d*(\\.(\\d+|n\\d+|-)?){0,3}$') then
  array_to_string(list_slice(list_concat(list_filter(string_split(ec, '.'), lambda p: p not in ('', '-')), ['-', '-', '-', '-']), 1, 4), '.') end as term from g),
n as (select term, count(*) as occurrences, count(distinct row_id) as records from c where term is not null group by 1), r as (select count(distinct row_id) as r from c where term is not null)
select term, occurrences, records, case when records < 3 then 'rare' when records > 0.05 * r then 'common' end as verdict from n, r""".replace("\\\\", "\\"),
    "p5_found": f"""
with recursive k as (select row_id, nullif(regexp_extract(lower(pdb_id), '(?:^|[^a-z0-9])([1-9][a-z0-9]{{5}})(?:[^a-z0-9]|$)', 1), '') as e, nullif(regexp_extract(upper(uniprot), '{_ONE}', 1), '') as a from annotated_chains),
b as (select distinct 'e' || e as x, 'a' || a as y from k where e is not null and a is not null union select distinct 'a' || a, 'e' || e from k where e is not null and a is not null),
r(n, l) as (select x, x from b union select b.y, r.l from r join b on b.x = r.n and r.l < b.y), p as (select n, min(l) as c from r group by n),
g as (select k.row_id, k.a, coalesce(p.c, coalesce('e' || e, 'a' || a)) as c from k left join p on p.n = coalesce('e' || e, 'a' || a) where e is not null or a is not null),
s as (select c, count(*) as n, min(a) as group_key from g group by c) select row_id, group_key from g join s using (c) where n > 1 and group_key is not null""",
    "p3_groups": f"""
with recursive q as (select row_id, {_LETTERS} as q from sample_multilabel where aa_seq is not null), c as (select q, min(row_id) as class_id from q where q <> '' group by q),
w as (select class_id, unnest(list_distinct(list_transform(range(1, length(q) - 3), lambda i: substr(q, i, 5)))) as w from c where length(q) >= 5), n as (select class_id, count(*) as n from w group by 1),
p as (select x.class_id as a, y.class_id as b, count(*) as s from w x join w y on x.w = y.w and x.class_id <> y.class_id group by all),
l as (select a, b from p join n x on x.class_id = a join n y on y.class_id = b where s >= 0.6 * (x.n + y.n - s) - 1e-9), k as (select a, count(*) as links from l group by a),
r(n, l) as (select a, a from l union select l.b, r.l from r join l on l.a = r.n and r.l < l.b), g as (select n, min(l) as group_id from r group by n)
select s.row_id, c.class_id, coalesce(g.group_id, c.class_id) as group_id, coalesce(links, 0) as links from sample_multilabel s left join q on q.row_id = s.row_id and q.q <> '' left join c on c.q = q.q
  left join k on k.a = c.class_id left join g on g.n = c.class_id""",
}
