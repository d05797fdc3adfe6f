"""Readers of the file formats protein tables come in. All give DataFrames; none touches the driver."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from oodmill.functions.text import RESIDUES

HIT = StructType([StructField("query", StringType()), StructField("target", StringType()), StructField("score", DoubleType()), StructField("evalue", DoubleType())])
CLUSTER = StructType([StructField("rep", StringType()), StructField("member", StringType())])


def csv(spark: SparkSession, path: str, schema: StructType | str | None = None, columns: list[str] | None = None, line_breaks: bool = False) -> DataFrame:
    """CSV with header; without a schema every column is text as written, empty fields are empty texts.

    Only where fields hold line breaks must line_breaks be set: a file is then one task, else it is split.
    """
    reader = spark.read.option("header", True).option("quote", '"').option("escape", '"').option("multiLine", line_breaks)
    df = reader.schema(schema).csv(path) if schema else reader.option("nullValue", "\0").option("emptyValue", "").csv(path)
    if not schema:
        df = df.fillna("")
    return df.select(*[F.col(f"`{c}`") for c in columns]) if columns else df


def tsv(spark: SparkSession, path: str, schema: StructType | str, comment: str | None = None) -> DataFrame:
    """Tab-separated without header, gzip read as it is, comment lines skipped."""
    reader = spark.read.option("sep", "\t").schema(schema)
    return (reader.option("comment", comment) if comment else reader).csv(path)


def hits(spark: SparkSession, path: str, fraction: bool = False) -> DataFrame:
    """Hit table; scores given as fractions become percent."""
    df = tsv(spark, path, HIT)
    return df.withColumn("score", F.col("score") * 100) if fraction else df


def clusters(spark: SparkSession, path: str) -> DataFrame:
    return tsv(spark, path, CLUSTER)


def predictions(spark: SparkSession, path: str) -> DataFrame:
    """(path, row_id, class_id, score) of .npy and .npz files; of an archive the usual keys first, else its first."""

    def load(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io

        import numpy as np

        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                held = np.load(io.BytesIO(content), allow_pickle=False)
                if hasattr(held, "files"):
                    key = next((k for k in ("predictions", "logits", "probs", "scores") if k in held.files), held.files[0])
                    held = held[key]
                grid = held.reshape(len(held), -1).astype(float)
                rows, classes = grid.shape
                yield pd.DataFrame({"path": path, "row_id": np.repeat(np.arange(rows), classes), "class_id": np.tile(np.arange(classes), rows).astype("int32"), "score": grid.ravel()})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(load, "path string, row_id bigint, class_id int, score double")


def newest(spark: SparkSession, path: str, key: Column) -> DataFrame:
    """(key, path): of the files with one key the newest, ties to the last name."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "modificationTime")
    return files.groupBy(key.alias("key")).agg(F.max_by("path", F.struct("modificationTime", "path")).alias("path"))


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file, folder or pattern names anything, in whatever file system it lies."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    found = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(where)
    return found is not None and len(found) > 0


def listing(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, name, stem, suffix, bytes, modified) of the files below a folder, as a relation; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return files.select("path", name.alias("name"), F.regexp_replace(name, r"\.[^.]*$", "").alias("stem"), F.regexp_extract(name, r"(\.[^.]*)$", 1).alias("suffix"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))


def fasta(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(id, sequence); of headers like sp|ACC|NAME the second field is the id. Of ids in several files the last wins; files
    that are not there are left out."""
    parts = []
    for priority, path in [(i, p) for i, p in enumerate(paths) if exists(spark, p)]:
        records = spark.read.option("lineSep", "\n>").text(path).select(F.regexp_replace("value", "^>", "").alias("r"))
        head, body = F.substring_index("r", "\n", 1), F.expr("substring(r, instr(r, '\n') + 1)")
        name = F.element_at(F.split(F.trim(head), r"\s+"), 1)
        ident = F.when(name.rlike(r"^(sp|tr)\|"), F.split(name, r"\|")[1]).otherwise(name)
        parts.append(records.where("instr(r, '\n') > 0").select(ident.alias("id"), F.regexp_replace(body, r"\s+", "").alias("sequence"), F.lit(priority).alias("p")))
    if not parts:
        return spark.createDataFrame([], "id string, sequence string")
    return reduce(DataFrame.unionByName, parts).groupBy("id").agg(F.max_by("sequence", "p").alias("sequence"))


def pdb_residues(spark: SparkSession, path: str) -> DataFrame:
    """(path, chain, resseq, icode, letter, line): first ATOM line of each residue, from fixed columns."""
    lines = spark.read.format("binaryFile").load(path).select("path", F.posexplode(F.split(F.col("content").cast("string"), "\n")).alias("line", "t"))
    part = lambda a, n: F.trim(F.substring("t", a, n))
    letters = F.create_map(*[F.lit(x) for kv in RESIDUES.items() for x in kv])
    atoms = lines.where("t like 'ATOM  %' or (t like 'HETATM%' and substring(t, 18, 3) = 'MSE')").select(
        "path", "line", F.substring("t", 22, 1).alias("chain"), part(23, 4).try_cast("int").alias("resseq"), part(27, 1).alias("icode"), F.coalesce(F.try_element_at(letters, part(18, 3)), F.lit("X")).alias("letter")
    )
    return atoms.groupBy("path", "chain", "resseq", "icode").agg(F.min("line").alias("line"), F.min_by("letter", "line").alias("letter"))


def chain_sequences(residues: DataFrame) -> DataFrame:
    """(path, chain, sequence): residues in the order of their first line."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("line", "letter"))), lambda s: s["letter"])
    return residues.groupBy("path", "chain").agg(F.array_join(ordered, "").alias("sequence"))


def cif_loop(spark: SparkSession, path: str, category: str) -> DataFrame:
    """(path, row, values): the rows of one loop of mmCIF files as maps from item name to value; files are read one by
    one where they lie, gzip or plain."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import gzip
        import shlex

        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                text = (gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content).decode("utf-8", "replace")
                names, rows, state = [], [], ""
                for line in text.splitlines():
                    if line.startswith("loop_"):
                        names, state = [], "names"
                    elif state == "names" and line.startswith("_"):
                        names.append(line.strip())
                    elif names and names[0].startswith(f"{category}."):
                        if not line.strip() or line[0] in "#_" or line.startswith(("loop_", "data_")):
                            state, names = "", []
                            continue
                        state = "rows"
                        cells = shlex.split(line, posix=True) if '"' in line or "'" in line else line.split()
                        if len(cells) == len(names):
                            rows.append({n.split(".", 1)[1]: v for n, v in zip(names, cells, strict=True)})
                    else:
                        state, names = "", []
                yield pd.DataFrame({"path": path, "row": range(len(rows)), "values": rows})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(read, "path string, row bigint, values map<string,string>")


def cif_residues(spark: SparkSession, path: str) -> DataFrame:
    """(path, chain, seq_id, letter) of the first model; author names where given, else labels."""
    v = lambda k: F.try_element_at("values", F.lit(k))
    known = lambda a, b: F.when(v(a).isin(".", "?") | v(a).isNull(), v(b)).otherwise(v(a))
    atoms = cif_loop(spark, path, "_atom_site").select(
        "path", "row", known("auth_asym_id", "label_asym_id").alias("chain"), known("auth_seq_id", "label_seq_id").alias("seq_id"), v("label_comp_id").alias("comp"), v("group_PDB").alias("kind"), F.coalesce(v("pdbx_PDB_model_num").try_cast("int"), F.lit(1)).alias("model")
    )
    first = atoms.groupBy("path").agg(F.min("model").alias("model"))
    letters = F.create_map(*[F.lit(x) for kv in RESIDUES.items() for x in kv])
    return (
        atoms.where("kind = 'ATOM'").join(first, ["path", "model"]).groupBy("path", "chain", "seq_id")
        .agg(F.min("row").alias("line"), F.min_by(F.coalesce(F.try_element_at(letters, F.col("comp")), F.lit("X")), "row").alias("letter"))
    )


def obo_terms(spark: SparkSession, path: str) -> DataFrame:
    """(id, name, namespace, parents) of the terms that are not obsolete."""
    stanzas = spark.read.option("lineSep", "\n\n").text(path).where("value like '[Term]%' and value not like '%is_obsolete: true%'")
    one = lambda k: F.regexp_extract("value", rf"(?m)^{k}: (.*)$", 1)
    return stanzas.select(one("id").alias("id"), one("name").alias("name"), one("namespace").alias("namespace"), F.regexp_extract_all("value", F.lit(r"(?m)^is_a: (\S+)"), F.lit(1)).alias("parents"))


def indented_tree(spark: SparkSession, path: str) -> DataFrame:
    """(child, parent) edges of a tree written by leading dashes, two a level; entries are ID::name::."""

    def edges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for content in batch["content"]:
                stack: list[str] = []
                for line in content.decode("utf-8").splitlines():
                    if "::" not in line:
                        continue
                    name = line.lstrip("-")
                    level = (len(line) - len(name)) // 2
                    ident = name.split("::")[0]
                    del stack[level:]
                    if stack:
                        out.append((ident, stack[-1]))
                    stack.append(ident)
            yield pd.DataFrame(out, columns=["child", "parent"])

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(edges, "child string, parent string")


def interpro2go(spark: SparkSession, path: str) -> DataFrame:
    """(entry, terms) of the mapping lines with exactly one entry and at least one term."""
    lines = spark.read.text(path).where("value not like '!%'")
    found = lines.select(F.regexp_extract_all("value", F.lit(r"(IPR\d{6})"), F.lit(1)).alias("e"), F.regexp_extract_all("value", F.lit(r"(GO:\d{7})"), F.lit(1)).alias("g"))
    return found.where("size(array_distinct(e)) = 1 and size(g) > 0").select(F.col("e")[0].alias("entry"), F.explode("g").alias("g")).groupBy("entry").agg(F.array_sort(F.collect_set("g")).alias("terms"))


def affinity_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(entries, rejects) of index lines `code resolution year affinity // note`; # opens a comment."""
    lines = spark.read.text(path).where("trim(value) <> '' and value not like '#%'")
    cells = F.split(F.trim(F.substring_index("value", "//", 1)), r"\s+")
    parsed = lines.select("value", cells.alias("c"), F.trim(F.when(F.instr("value", "//") > 0, F.substring_index("value", "//", -1)).otherwise("")).alias("note"))
    good = parsed.where("size(c) >= 4").select(F.lower(F.col("c")[0]).alias("code"), F.col("c")[1].try_cast("double").alias("resolution"), F.col("c")[2].try_cast("int").alias("year"), F.element_at("c", 4).alias("affinity"), "note")
    return good, parsed.where("size(c) < 4").select("value")


def domain_list(spark: SparkSession, path: str) -> DataFrame:
    """(domain, code) of a domain list: name, then class, architecture, topology and superfamily numbers."""
    c = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).where("trim(value) <> '' and value not like '#%'").select(c.alias("c")).where("size(c) >= 5").select(F.col("c")[0].alias("domain"), F.concat_ws(".", *[F.col("c")[i] for i in range(1, 5)]).alias("code"))


def dssp(spark: SparkSession, path: str) -> DataFrame:
    """(path, line, chain, residue, state) of DSSP files; breaks are skipped, blank states are C."""
    lines = spark.read.format("binaryFile").load(path).select("path", F.posexplode(F.split(F.col("content").cast("string"), "\n")).alias("line", "t"))
    starts = lines.where("t like '  #  RESIDUE%'").groupBy("path").agg(F.min("line").alias("start"))
    body = lines.join(starts, "path").where("line > start and length(t) > 16 and substring(t, 14, 1) <> '!'")
    state = F.substring("t", 17, 1)
    return body.select("path", "line", F.substring("t", 12, 1).alias("chain"), F.substring("t", 14, 1).alias("residue"), F.when(state == " ", "C").otherwise(state).alias("state"))


def json_object(spark: SparkSession, path: str, value_schema: str, keys: DataFrame | None = None) -> DataFrame:
    """(key, value) of one large JSON object of keys to values, optionally only wanted keys (a column `key`)."""
    whole = spark.read.option("wholetext", True).text(path)
    pairs = whole.select(F.explode(F.from_json("value", f"map<string,{value_schema}>")).alias("key", "value"))
    return pairs.join(keys, "key", "left_semi") if keys is not None else pairs


def json_lines(spark: SparkSession, path: str, schema: str, keys: DataFrame | None = None) -> DataFrame:
    """One JSON object a line with a column key; this form can be split, so large objects should be written so."""
    df = spark.read.schema(schema).json(path)
    return df.join(keys, "key", "left_semi") if keys is not None else df


def unprocessed(items: DataFrame, log: DataFrame, key: str, done: tuple[str, ...] = ("success", "empty")) -> DataFrame:
    """Items a log has not finished; failed ones come again."""
    return items.join(log.where(F.col("status").isin(*done)).select(key).distinct(), key, "left_anti")


def verified(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """(name, ok): files checked against wanted (name, md5)."""
    files = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.md5("content").alias("is"))
    return wanted.join(files, "name", "left").select("name", F.coalesce(F.col("is") == F.lower("md5"), F.lit(False)).alias("ok"))


def compounds(spark: SparkSession, path: str) -> DataFrame:
    """(path, chain, ec) from the COMPND records of PDB files: every chain of a molecule with every EC number of it."""
    lines = spark.read.format("binaryFile").load(path).select("path", F.posexplode(F.split(F.col("content").cast("string"), "\n")).alias("line", "t")).where("t like 'COMPND%'")
    text = lines.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", F.substring("t", 11, 70).alias("t")))), lambda s: F.rtrim(s["t"])), "").alias("t"))
    molecule = text.select("path", F.explode(F.split("t", "MOL_ID:")).alias("m")).where("m like '%EC:%'")
    listed = lambda k: F.transform(F.split(F.regexp_extract("m", rf"{k}:([^;]*)", 1), ","), lambda v: F.trim(v))
    return molecule.select("path", F.explode(listed("CHAIN")).alias("chain"), listed("EC").alias("e")).select("path", "chain", F.explode("e").alias("ec")).where("ec <> '' and chain <> ''")
