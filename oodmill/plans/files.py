"""Writers and readers as queries: whole tables are written in a format to the shared folder and read again; what comes
back must be what SQL finds in the table itself."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oodmill.functions import text
from oodmill.session import cut, shared_dir, table
from oodmill.sources import readers, sinks

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def fresh(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one."""
    return f"{shared_dir(spark)}/{name}-{uuid4().hex}"


@query("select o_orderstatus, count(*) as n, sum(o_custkey) as keys, round(sum(o_totalprice), 2) as total from orders group by 1")
def csv_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Written as CSV, read with a schema and only the columns wanted."""
    path = fresh(spark, "csv")
    sinks.csv(table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"), path)
    got = readers.csv(spark, path, "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double", ["o_custkey", "o_orderstatus", "o_totalprice"])
    return got.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.sum("o_custkey").alias("keys"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("select doc_id::varchar as doc_id, md5(coalesce(regexp_replace(text, '[\\x00-\\x1f\\x7f-\\x9f]', ' ', 'g'), '')) as content, coalesce(source, '') as source from documents".replace("\\\\", "\\"))
def csv_text_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """All columns as text as written: quotes and separators inside fields survive, no value is taken for missing."""
    path = fresh(spark, "csv")
    docs = table(spark, sf, "documents").select("doc_id", F.regexp_replace("text", "[\\x00-\\x1f\\x7f-\\x9f]", " ").alias("text"), "source")
    docs.write.option("header", True).option("escape", '"').option("emptyValue", "").option("nullValue", "").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return readers.csv(spark, path).select("doc_id", F.md5("text").alias("content"), "source")


@query("select l_orderkey::varchar as query, count(*) as n, max(2 * l_quantity) as best, min(l_tax) as evalue from lineitem group by 1")
def hits_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Headerless gzip tables of hits with comment lines; scores given as fractions."""
    path = fresh(spark, "hits")
    l = table(spark, sf, "lineitem")
    rows = l.select(F.concat_ws("\t", "l_orderkey", "l_partkey", (F.col("l_quantity") / 50).cast("string"), F.col("l_tax").cast("string")).alias("value"))
    sinks.lines(rows.union(l.where("l_linenumber = 1").select(F.concat(F.lit("# query "), "l_orderkey"))), path, compression="gzip")
    got = readers.tsv(spark, path, readers.HIT, comment="#").withColumn("score", F.round(F.col("score") * 100, 6))
    return got.groupBy("query").agg(F.count("*").alias("n"), F.max("score").alias("best"), F.min("evalue").alias("evalue"))


@query("select l_partkey::varchar as rep, count(*) as members from lineitem group by 1")
def clusters_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    path = fresh(spark, "clusters")
    sinks.lines(table(spark, sf, "lineitem").select(F.concat_ws("\t", "l_partkey", "l_orderkey").alias("value")), path)
    return readers.clusters(spark, path).groupBy("rep").agg(F.count("*").alias("members"))


@query("select event_type, count(*) as n, count(distinct user_id) as users, max(ts) as last from events where event_id % 3 = 0 group by 1")
def json_lines_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """One object a line; the keys wanted are a semi join."""
    path = fresh(spark, "json")
    e = table(spark, sf, "events")
    e.select(F.col("event_id").cast("string").alias("key"), "user_id", "event_type", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts")).write.json(path)
    wanted = e.where("event_id % 3 = 0").select(F.col("event_id").cast("string").alias("key"))
    got = readers.json_lines(spark, path, "key string, user_id bigint, event_type string, ts string", wanted)
    return got.groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"), F.max(F.col("ts").cast("timestamp_ntz")).alias("last"))


@query("select n_nationkey::varchar as key, n_name as name, n_regionkey as region from nation")
def json_object_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """One object of keys to values, as small dictionaries come (a dimension of fixed size)."""
    path = fresh(spark, "object")
    entries = F.map_from_entries(F.collect_list(F.struct(F.col("n_nationkey").cast("string"), F.struct(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region")))))
    table(spark, sf, "nation").agg(F.to_json(entries).alias("value")).write.text(path)
    return readers.json_object(spark, path, "struct<name:string,region:int>").select("key", "value.name", "value.region")


@query("""
with s as (select lower(trim(split)) as split, 'id' || (row_id % 700)::varchar as id, regexp_replace(upper(aa_seq), '[^A-Z]', '', 'g') as q from sample_multilabel),
f as (select split, id, min(q) as q from s where q <> '' group by all), r as (select id, coalesce(max(q) filter (split = 'test'), max(q) filter (split = 'val'), max(q) filter (split = 'train')) as q from f where split in ('train', 'val', 'test') group by id)
select id, md5(q) as sequence from r where q is not null""")
def fasta_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """A file a split, read in order; of an id in several files the last wins, a file that is not there is left out."""
    path = fresh(spark, "fasta")
    s = table(spark, sf, "sample_multilabel").select(F.lower(F.trim("split")).alias("split"), F.concat(F.lit("id"), (F.col("row_id") % 700).cast("string")).alias("id"), F.regexp_replace(F.upper("aa_seq"), "[^A-Z]", "").alias("q")).where("q <> ''")
    for split in ("train", "val", "test"):
        sinks.fasta(s.where(F.col("split") == split), "id", "q", f"{path}/{split}")
    return readers.fasta(spark, [f"{path}/{x}" for x in ("train", "missing", "val", "test")]).select("id", F.md5("sequence").alias("sequence"))


_FLAGS = ["ood_orphan", "ood_extremeshort", "ood_extremelong", "ood_longtail"]


@query(" union all ".join(f"select '{f}' as subset, count(*) as n, sum(row_id) as ids from ood_flags where {f}" for f in _FLAGS))
def flag_files(spark: SparkSession, sf: str) -> DataFrame:
    """One folder a flag with the rows where it is True, read back by a pattern over all of them."""
    path = fresh(spark, "flags")
    sinks.by_flag(table(spark, sf, "ood_flags").select("row_id", *_FLAGS), _FLAGS, path)
    return spark.read.option("basePath", path).parquet(f"{path}/subset=*").groupBy(F.col("subset").cast("string").alias("subset")).agg(F.count("*").alias("n"), F.sum("row_id").cast("bigint").alias("ids"))


@query("""
select 'good' as route, count(*) as n, sum(row_id)::bigint as ids from annotated_chains where resolution between 0.4 and 4 union all select 'bad', count(*), sum(row_id)::bigint from annotated_chains where not coalesce(resolution between 0.4 and 4, false)""")
def routed_files(spark: SparkSession, sf: str) -> DataFrame:
    """Rows that pass in one place, all others, NULL included, in another."""
    path = fresh(spark, "routed")
    sinks.routed(table(spark, sf, "annotated_chains").select("row_id", "resolution"), F.col("resolution").between(0.4, 4), f"{path}/good", f"{path}/bad")
    sides = [spark.read.parquet(f"{path}/{r}").agg(F.lit(r).alias("route"), F.count("*").alias("n"), F.sum("row_id").cast("bigint").alias("ids")) for r in ("good", "bad")]
    return sides[0].union(sides[1])


@query("select c_mktsegment, count(*) as n, round(sum(c_acctbal + 1), 2) as balance from customer group by 1")
def checked_overwrite(spark: SparkSession, sf: str) -> DataFrame:
    """A column replaced, all others proved untouched, and written as a new version beside the old one."""
    path = fresh(spark, "versions")
    old = table(spark, sf, "customer")
    sinks.versioned(old, path, "1")
    sinks.versioned(sinks.overwritten(spark.read.parquet(f"{path}/version=1"), "c_custkey", {"c_acctbal": F.col("c_acctbal") + 1}), path, "2")
    return spark.read.parquet(f"{path}/version=2").groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


@query("""
select '| r_regionkey | r_name |' || chr(10) || '|---|---|' || chr(10) || string_agg('| ' || r_regionkey::varchar || ' | ' || r_name || ' |', chr(10) order by r_regionkey) as markdown from region""")
def markdown_table(spark: SparkSession, sf: str) -> DataFrame:
    """A small report as a Markdown table."""
    return spark.createDataFrame([(sinks.markdown(table(spark, sf, "region").select("r_regionkey", "r_name").orderBy("r_regionkey")),)], "markdown string")


@query("""
select event_type, count(*) as n from events where user_id not in (select user_id from events where event_type = 'error' and event_id % 50 = 0) group by 1""")
def resumed_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Items that a log has not finished."""
    e = table(spark, sf, "events")
    log = e.select("user_id", F.when((F.col("event_type") == "error") & (F.col("event_id") % 50 == 0), "success").otherwise("failed").alias("status"))
    return readers.unprocessed(e.select("user_id", "event_type"), log, "user_id").groupBy("event_type").agg(F.count("*").alias("n"))


_NAMES = sorted(k for k in text.RESIDUES if k not in ("MSE", "SEC", "PYL"))
_THREE = "[" + ", ".join(f"'{n}'" for n in _NAMES) + "]"
_ONE = "".join(text.RESIDUES[n] for n in _NAMES)
_RES = f"""r as (select c_nationkey as file, chr((65 + ascii(c_mktsegment) % 26)::int) as chain, c_custkey % 10000 as resseq, min('{_ONE}'[(c_custkey % 20 + 1)::int]) as letter, count(*) as atoms from customer group by all)"""


def _residues(spark: SparkSession, sf: str) -> DataFrame:
    """Invented residues: a file a nation, a chain a segment, a residue a customer."""
    name = F.element_at(F.array(*[F.lit(n) for n in _NAMES]), (F.col("c_custkey") % 20 + 1).cast("int"))
    c = table(spark, sf, "customer").select(
        F.col("c_nationkey").alias("file"), F.char((65 + F.ascii("c_mktsegment") % 26).cast("int")).alias("chain"), (F.col("c_custkey") % 10000).cast("int").alias("resseq"), F.lit(" ").alias("icode"), name.alias("name"),
        *[(F.col("c_custkey") % k * 0.5).alias(a) for k, a in ((17, "x"), (19, "y"), (23, "z"))],
    )
    return c


@query(f"with {_RES} select file, chain, count(*) as residues, sum(atoms) as atoms, string_agg(letter, '' order by resseq) as sequence from r group by all")
def structure_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Fixed-column ATOM records written a file, read to residues, counted and joined to chain sequences."""
    path = fresh(spark, "pdb")
    made = _residues(spark, sf)
    sinks.structures(made, "file", path)
    number = F.regexp_extract("path", r"file=(-?\d+)/", 1).cast("int")
    residues = cut(readers.pdb_residues(spark, f"{path}/file=*").withColumn("path", number))
    sequences = readers.chain_sequences(residues).select(F.col("path").alias("file"), "chain", "sequence")
    counts = residues.groupBy(F.col("path").alias("file"), "chain").agg(F.count("*").alias("residues"))
    atoms = made.groupBy("file", "chain").agg(F.count("*").alias("atoms"))
    return counts.join(sequences, ["file", "chain"]).join(atoms, ["file", "chain"])


@query(f"""
with {_RES.replace("min('" + _ONE + "'", "min('" + _ONE + "'")}, m as (select file, chain, resseq, letter from r)
select file, chain, count(*) as residues, string_agg(letter, '' order by resseq) as sequence from m group by all""")
def cif_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """mmCIF atom loops with two models and missing author names, read to the residues of the first model."""
    path = fresh(spark, "cif")
    r = _residues(spark, sf)
    atom = F.concat_ws(" ", F.lit("ATOM"), F.when(F.col("resseq") % 2 == 0, F.col("chain")).otherwise("."), F.col("chain"), F.col("resseq").cast("string"), F.col("resseq").cast("string"), F.col("name"), F.col("m").cast("string"))
    body = r.withColumn("m", F.explode(F.array(F.lit(1), F.lit(2)))).select("file", F.lit(1).alias("part"), "m", "chain", "resseq", atom.alias("value"))
    names = ["group_PDB", "auth_asym_id", "label_asym_id", "auth_seq_id", "label_seq_id", "label_comp_id", "pdbx_PDB_model_num"]
    files = r.select("file").distinct()
    head = files.select("file", F.lit(0).alias("part"), F.posexplode(F.array(*[F.lit(x) for x in ["data_x", "loop_", *[f"_atom_site.{n}" for n in names]]])).alias("m", "value")).select("file", "part", "m", F.lit("").alias("chain"), F.lit(0).alias("resseq"), "value")
    tail = files.select("file", F.lit(2).alias("part"), F.lit(0).alias("m"), F.lit("").alias("chain"), F.lit(0).alias("resseq"), F.lit("#").alias("value"))
    sinks.lines(head.unionByName(body).unionByName(tail), path, "part", "m", "chain", "resseq", key="file")
    got = readers.cif_residues(spark, f"{path}/file=*").select(F.regexp_extract("path", r"file=(-?\d+)/", 1).cast("int").alias("file"), "chain", F.col("seq_id").cast("int").alias("resseq"), "letter")
    ordered = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("resseq", "letter"))), lambda s: s["letter"]), "")
    return got.groupBy("file", "chain").agg(F.count("*").alias("residues"), ordered.alias("sequence"))


@query("select p_brand as comp, arg_min(p_name, p_partkey) as descriptor from part group by 1")
def cif_descriptors(spark: SparkSession, sf: str) -> DataFrame:
    """A descriptor loop: the first descriptor of each component, quoted values included."""
    path = fresh(spark, "descriptors")
    p = table(spark, sf, "part").select((F.col("p_partkey") * 0).alias("file"), F.lit(1).alias("part"), "p_partkey", F.concat(F.lit("'"), "p_brand", F.lit("' SMILES '"), F.regexp_replace("p_name", "'", ""), F.lit("'")).alias("value"))
    head = spark.range(1).select(F.lit(0).alias("file"), F.lit(0).alias("part"), F.posexplode(F.array(*[F.lit(x) for x in ["loop_", *[f"_pdbx_chem_comp_descriptor.{n}" for n in ("comp_id", "type", "descriptor")]]])).alias("p_partkey", "value"))
    sinks.lines(head.unionByName(p), path, "part", "p_partkey", key="file")
    loop = readers.cif_loop(spark, f"{path}/file=0", "_pdbx_chem_comp_descriptor")
    return loop.groupBy(F.col("values")["comp_id"].alias("comp")).agg(F.min_by(F.col("values")["descriptor"], "row").alias("descriptor"))


@query("select c_nationkey as file, n_regionkey % 3 as molecule, c_mktsegment as chain, '1.2.' || (n_regionkey % 3)::varchar || '.4' as ec from customer join nation on n_nationkey = c_nationkey group by all")
def compounds_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """EC numbers of the chains of molecules, from COMPND records."""
    path = fresh(spark, "compnd")
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), (F.col("n_regionkey") % 3).alias("molecule"))
    c = table(spark, sf, "customer").select("c_nationkey", "c_mktsegment").distinct().join(F.broadcast(n), "c_nationkey")
    per = c.groupBy("c_nationkey", "molecule").agg(F.array_join(F.array_sort(F.collect_set("c_mktsegment")), ", ").alias("chains"))
    texts = F.array(F.concat(F.lit("MOL_ID: "), (F.col("molecule") + 1).cast("string"), F.lit(";")), F.concat(F.lit("CHAIN: "), "chains", F.lit(";")), F.concat(F.lit("EC: 1.2."), F.col("molecule").cast("string"), F.lit(".4;")))
    lines = per.select(F.col("c_nationkey").alias("file"), F.posexplode(texts).alias("i", "t")).select("file", "i", F.concat(F.rpad(F.lit("COMPND"), 10, " "), F.rpad("t", 70, " ")).alias("value"))
    sinks.lines(lines, path, "i", key="file")
    got = readers.compounds(spark, f"{path}/file=*").select(F.regexp_extract("path", r"file=(-?\d+)/", 1).cast("int").alias("file"), "chain", "ec")
    return got.select("file", F.split("ec", r"\.")[2].cast("int").alias("molecule"), "chain", "ec")


@query("""
select 'GO:' || lpad(n_nationkey::varchar, 7, '0') as id, n_name as name, case when n_regionkey % 2 = 0 then 'biological_process' else 'molecular_function' end as namespace, 'GO:' || lpad((n_nationkey % 7)::varchar, 7, '0') as parent from nation where n_nationkey % 5 <> 4""")
def ontology_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Term stanzas with names, namespaces and parents; obsolete terms are left out."""
    path = fresh(spark, "obo")
    number = lambda c: F.concat(F.lit("GO:"), F.lpad(c.cast("string"), 7, "0"))
    k = F.col("n_nationkey")
    stanza = F.concat_ws(
        "\n", F.lit("[Term]"), F.concat(F.lit("id: "), number(k)), F.concat(F.lit("name: "), "n_name"), F.concat(F.lit("namespace: "), F.when(F.col("n_regionkey") % 2 == 0, "biological_process").otherwise("molecular_function")),
        F.concat(F.lit("is_a: "), number(k % 7), F.lit(" ! parent")), F.when(k % 5 == 4, "is_obsolete: true"),
    )
    sinks.lines(table(spark, sf, "nation").select(F.concat(stanza, F.lit("\n")).alias("value")), path)
    return readers.obo_terms(spark, path).select("id", "name", "namespace", F.col("parents")[0].alias("parent"))


@query("""
select 'IPR' || lpad(c_custkey::varchar, 6, '0') as child, 'IPR' || lpad(n_nationkey::varchar, 6, '9') as parent from customer join nation on n_nationkey = c_nationkey
union all select 'IPR' || lpad(n_nationkey::varchar, 6, '9'), 'IPR' || lpad(n_regionkey::varchar, 6, '8') from nation""")
def tree_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """An indented tree of three levels, a file a root, read to its edges."""
    path = fresh(spark, "tree")
    ident = lambda c, fill: F.concat(F.lit("IPR"), F.lpad(c.cast("string"), 6, fill))
    n = table(spark, sf, "nation")
    r, k = ident(F.col("n_regionkey"), "8"), ident(F.col("n_nationkey"), "9")
    entry = lambda level, i: F.concat(F.lit("--" * level), i, F.lit("::name::"))
    roots = n.select(F.col("n_regionkey").alias("file")).distinct().select("file", F.lit(-1).alias("a"), F.lit(-1).cast("bigint").alias("b"), entry(0, ident(F.col("file"), "8")).alias("value"))
    mid = n.select(F.col("n_regionkey").alias("file"), F.col("n_nationkey").alias("a"), F.lit(-1).cast("bigint").alias("b"), entry(1, k).alias("value"))
    c = table(spark, sf, "customer").join(F.broadcast(n.select(F.col("n_nationkey").alias("c_nationkey"), "n_regionkey")), "c_nationkey")
    leaf = c.select(F.col("n_regionkey").alias("file"), F.col("c_nationkey").alias("a"), F.col("c_custkey").alias("b"), entry(2, ident(F.col("c_custkey"), "0")).alias("value"))
    sinks.lines(roots.union(mid).union(leaf), path, "a", "b", key="file")
    return readers.indented_tree(spark, f"{path}/file=*")


@query("""
select 'IPR' || lpad(o_custkey::varchar, 6, '0') as entry, string_agg(distinct 'GO:' || lpad((o_orderkey % 50)::varchar, 7, '0'), ';' order by 'GO:' || lpad((o_orderkey % 50)::varchar, 7, '0')) as terms from orders where o_orderkey % 9 > 1 group by 1""")
def mapping_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Mapping lines with exactly one entry and a term; comments and lines with two entries fall away."""
    path = fresh(spark, "map")
    e, g = F.concat(F.lit("IPR"), F.lpad(F.col("o_custkey").cast("string"), 6, "0")), F.concat(F.lit("GO:"), F.lpad((F.col("o_orderkey") % 50).cast("string"), 7, "0"))
    k = F.col("o_orderkey") % 9
    line = F.when(k == 0, F.concat(F.lit("! "), e, F.lit(" > "), g)).when(k == 1, F.concat(e, F.lit(" IPR999999 > "), g)).otherwise(F.concat(F.lit("InterPro:"), e, F.lit(" name > GO:term ; "), g))
    sinks.lines(table(spark, sf, "orders").select(line.alias("value")), path)
    return readers.interpro2go(spark, path).select("entry", F.array_join("terms", ";").alias("terms"))


@query("""
select c_custkey::varchar as code, case when c_custkey % 7 = 0 then null else c_custkey % 40 / 10.0 end as resolution, (1980 + c_custkey % 40)::int as year, round(-log10((c_custkey % 90 + 1) * case c_custkey % 4 when 0 then 1e-9 when 1 then 1e-6 when 2 then 1e-9 else 1e-3 end), 6) as p,
  case c_custkey % 3 when 0 then '=' when 1 then '<=' else '~' end as relation, c_custkey % 5 = 1 as covalent, case when c_custkey % 5 = 2 then 'Zn' end as element from customer where c_custkey % 11 <> 0""")
def affinity_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Index lines with errors, lower-case units, signs of two kinds and tagged notes; short lines are rejects."""
    path = fresh(spark, "index")
    k = F.col("c_custkey")
    res = F.when(k % 7 == 0, "NMR").otherwise((k % 40 / 10.0).cast("string"))
    sign = F.when(k % 3 == 0, "=").when(k % 3 == 1, "<=").otherwise("~")
    unit = F.when(k % 4 == 0, "nM").when(k % 4 == 1, "uM").when(k % 4 == 2, "nm").otherwise("mM")
    value = F.concat(F.lit("Kd"), sign, (k % 90 + 1).cast("string"), F.when(k % 2 == 0, "+/-3.1").otherwise(""), unit)
    note = F.when(k % 5 == 1, "(LIG) [Covalent complex]").when(k % 5 == 2, "(LIG) [uncommon element: Zn ]").otherwise("(LIG)")
    line = F.when(k % 11 == 0, F.concat_ws("  ", k.cast("string"), res)).otherwise(F.concat(F.concat_ws("  ", k.cast("string"), res, (1980 + k % 40).cast("string"), value), F.lit("   // "), k.cast("string"), F.lit(".pdf "), note))
    c = table(spark, sf, "customer").select(line.alias("value"))
    sinks.lines(c.union(spark.range(1).select(F.lit("# head"))), path)
    good, _ = readers.affinity_index(spark, path)
    a, t = text.affinity(F.col("affinity")), text.note_tags(F.col("note"))
    return good.select("code", "resolution", "year", F.round(a["p"], 6).alias("p"), a["relation"].alias("relation"), t["covalent_complex"].alias("covalent"), t["uncommon_element"].alias("element"))


@query("select p_partkey::varchar as domain, (p_size % 4 + 1)::varchar || '.' || (p_size % 9 * 10)::varchar || '.' || (p_partkey % 30)::varchar || '.' || (p_partkey % 7)::varchar as code from part")
def domains_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """A domain list: names and four code numbers in columns."""
    path = fresh(spark, "domains")
    part = lambda c: c.cast("string")
    rows = table(spark, sf, "part").select(F.concat_ws("   ", part(F.col("p_partkey")), part(F.col("p_size") % 4 + 1), part(F.col("p_size") % 9 * 10), part(F.col("p_partkey") % 30), part(F.col("p_partkey") % 7), F.lit("1"), F.lit("140")).alias("value"))
    sinks.lines(rows.union(spark.range(1).select(F.lit("# CATH list"))), path)
    return readers.domain_list(spark, path)


@query(f"""
with r as (select c_nationkey as file, c_custkey as k, chr((65 + ascii(c_mktsegment) % 26)::int) as chain, '{_ONE}'[(c_custkey % 20 + 1)::int] as residue, case c_custkey % 4 when 0 then 'H' when 1 then 'E' when 2 then 'C' else 'T' end as state from customer where c_custkey % 13 <> 0)
select file, string_agg(residue, '' order by k) as residues, string_agg(state, '' order by k) as states from r group by file""")
def dssp_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Fixed-column state files: breaks are skipped, blank states are coil."""
    path = fresh(spark, "dssp")
    k = F.col("c_custkey")
    one = F.when(k % 13 == 0, "!").otherwise(F.element_at(F.array(*[F.lit(c) for c in _ONE]), (k % 20 + 1).cast("int")))
    state = F.when(k % 4 == 0, "H").when(k % 4 == 1, "E").when(k % 4 == 2, " ").otherwise("T")
    line = F.concat(F.lpad((k % 10000).cast("string"), 5, " "), F.lpad((k % 10000).cast("string"), 5, " "), F.lit(" "), F.char((65 + F.ascii("c_mktsegment") % 26).cast("int")), F.lit(" "), one, F.lit("  "), state, F.lit("  tail"))
    c = table(spark, sf, "customer").select(F.col("c_nationkey").alias("file"), k.alias("k"), line.alias("value"))
    head = c.select("file").distinct().select("file", F.lit(-1).cast("bigint").alias("k"), F.lit("  #  RESIDUE AA STRUCTURE").alias("value"))
    sinks.lines(head.unionByName(c), path, "k", key="file")
    got = readers.dssp(spark, f"{path}/file=*").select(F.regexp_extract("path", r"file=(-?\d+)/", 1).cast("int").alias("file"), "line", "residue", "state")
    join = lambda col: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", col))), lambda s: s[col]), "")
    return got.groupBy("file").agg(join("residue").alias("residues"), join("state").alias("states"))


@query("select n_regionkey as folder, count(*) as files, '.txt' as suffix from nation group by 1")
def folder_listing(spark: SparkSession, sf: str) -> DataFrame:
    """The files below a folder as a relation, one a key written, contents unread."""
    path = fresh(spark, "list")
    n = table(spark, sf, "nation").select(F.concat_ws("-", "n_regionkey", "n_nationkey").alias("file"), F.col("n_name").alias("value"))
    sinks.lines(n, path, key="file")
    files = readers.listing(spark, path, "part-*")
    return files.groupBy(F.regexp_extract("path", r"file=(\d+)-", 1).cast("int").alias("folder")).agg(F.count("*").alias("files"), F.max("suffix").alias("suffix"))
