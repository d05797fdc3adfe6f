"""Readers, writers and streams on small files."""

import gzip
import hashlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from oodmill.sources import readers, sinks
from oodmill.streaming import events


def test_csv_keeps_text_as_written(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,label,chain\n1,1.10.8.10,NA\n2,,"x,y"\n')
    got = [tuple(r) for r in readers.csv(spark, str(tmp_path / "a.csv")).orderBy("id").collect()]
    assert got == [("1", "1.10.8.10", "NA"), ("2", "", "x,y")]


def test_hits_with_comments_and_gzip(spark, tmp_path):
    with gzip.open(tmp_path / "h.tsv.gz", "wt") as f:
        f.write("# made by x\nq\tt\t0.5\t1e-5\n")
    df = readers.tsv(spark, str(tmp_path / "h.tsv.gz"), readers.HIT, "#")
    assert [tuple(r) for r in df.collect()] == [("q", "t", 0.5, 1e-5)]


def test_fasta_round_trip_and_last_file_wins(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">sp|P1|X some\nAC\nDE\n>q2\nGG\n")
    (tmp_path / "b.fa").write_text(">q2\nTT\n")
    got = dict(map(tuple, readers.fasta(spark, [str(tmp_path / "a.fa"), str(tmp_path / "b.fa")]).collect()))
    assert got == {"P1": "ACDE", "q2": "TT"}
    sinks.fasta(spark.createDataFrame(list(got.items()), "id string, s string"), "id", "s", str(tmp_path / "out"))
    assert dict(map(tuple, readers.fasta(spark, [str(tmp_path / "out")]).collect())) == got


def test_pdb_sequence(spark, tmp_path):
    line = "ATOM  {:>5}  {:<3} {} {}{:>4}{}   {:8.3f}{:8.3f}{:8.3f}\n"
    body = line.format(1, "N", "ALA", "A", 1, " ", 0, 0, 0) + line.format(2, "CA", "ALA", "A", 1, " ", 0, 0, 0) + line.format(3, "N", "GLY", "A", 2, " ", 0, 0, 0) + line.format(4, "N", "SER", "A", 2, "A", 0, 0, 0) + line.format(5, "N", "TRP", "B", 9, " ", 0, 0, 0)
    (tmp_path / "x.pdb").write_text(body)
    got = {r["chain"]: r["sequence"] for r in readers.chain_sequences(readers.pdb_residues(spark, str(tmp_path / "x.pdb"))).collect()}
    assert got == {"A": "AGS", "B": "W"}


def test_cif_first_model(spark, tmp_path):
    head = "data_x\nloop_\n" + "".join(f"_atom_site.{c}\n" for c in ("group_PDB", "label_comp_id", "label_asym_id", "auth_asym_id", "auth_seq_id", "pdbx_PDB_model_num"))
    (tmp_path / "x.cif").write_text(head + "ATOM ALA A X 1 1\nATOM ALA A X 1 1\nATOM GLY A X 2 1\nATOM TRP A X 3 2\n#\n")
    got = readers.cif_residues(spark, str(tmp_path / "x.cif"))
    assert [(r["chain"], r["sequence"]) for r in readers.chain_sequences(got).collect()] == [("X", "AG")]


def test_ontologies(spark, tmp_path):
    (tmp_path / "o.obo").write_text("format-version: 1.2\n\n[Term]\nid: GO:0000001\nname: a\nnamespace: p\nis_a: GO:0000002 ! b\n\n[Term]\nid: GO:0000003\nname: c\nnamespace: f\nis_obsolete: true\n")
    assert [(r["id"], r["parents"]) for r in readers.obo_terms(spark, str(tmp_path / "o.obo")).collect()] == [("GO:0000001", ["GO:0000002"])]
    (tmp_path / "t.txt").write_text("I1::a::\n--I2::b::\n----I3::c::\n--I4::d::\n")
    assert sorted(map(tuple, readers.indented_tree(spark, str(tmp_path / "t.txt")).collect())) == [("I2", "I1"), ("I3", "I2"), ("I4", "I1")]
    (tmp_path / "i2g").write_text("!c\nInterPro:IPR000001 x > GO:y ; GO:0000009\nInterPro:IPR000001 IPR000002 > GO:y ; GO:0000008\n")
    assert [tuple(r) for r in readers.interpro2go(spark, str(tmp_path / "i2g")).collect()] == [("IPR000001", ["GO:0000009"])]


def test_index_domains_and_states(spark, tmp_path):
    (tmp_path / "idx").write_text("# c\n1ABC 2.0 1999 Kd=10nM // note\nbad line\n")
    good, bad = readers.affinity_index(spark, str(tmp_path / "idx"))
    assert [tuple(r) for r in good.collect()] == [("1abc", 2.0, 1999, "Kd=10nM", "note")] and bad.count() == 1
    (tmp_path / "dom").write_text("#x\n1oaiA00 1 10 8 10 1 1\n")
    assert [tuple(r) for r in readers.domain_list(spark, str(tmp_path / "dom")).collect()] == [("1oaiA00", "1.10.8.10")]
    row = lambda n, aa, s: f"{n:5d}{n:5d} A {aa}  {s}"
    (tmp_path / "d.dssp").write_text("HEADER\n  #  RESIDUE AA\n" + "\n".join([row(1, "M", "H") + "  ", row(2, "!", " ") + "  ", row(3, "K", " ") + "  "]) + "\n")
    assert [(r["residue"], r["state"]) for r in readers.dssp(spark, str(tmp_path / "d.dssp")).orderBy("line").collect()] == [("M", "H"), ("K", "C")]


def test_predictions_json_and_checks(spark, tmp_path):
    np.save(tmp_path / "p.npy", np.array([[0.1, 0.9], [0.4, 0.6]]))
    assert readers.predictions(spark, str(tmp_path / "p.npy")).where("class_id = 1").count() == 2
    (tmp_path / "j.json").write_text('{"a": {"x": 1}, "b": {"x": 2}}')
    keys = spark.createDataFrame([("b",)], "key string")
    assert [(r["key"], r["value"]["x"]) for r in readers.json_object(spark, str(tmp_path / "j.json"), "struct<x:int>", keys).collect()] == [("b", 2)]
    (tmp_path / "f.bin").write_bytes(b"abc")
    wanted = spark.createDataFrame([("f.bin", hashlib.md5(b"abc").hexdigest()), ("gone", "0")], "name string, md5 string")
    assert dict(map(tuple, readers.verified(spark, str(tmp_path / "*.bin"), wanted).collect())) == {"f.bin": True, "gone": False}
    log = spark.createDataFrame([("a", "success"), ("b", "write_error")], "id string, status string")
    assert [r["id"] for r in readers.unprocessed(spark.createDataFrame([("a",), ("b",), ("c",)], "id string"), log, "id").orderBy("id").collect()] == ["b", "c"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, True, None), (2, False, True)], "id int, ood_a boolean, ood_b boolean")
    sinks.by_flag(df, ["ood_a", "ood_b"], str(tmp_path / "flags"))
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "flags")).collect())) == [(1, "ood_a"), (2, "ood_b")]
    sinks.routed(df, F.col("ood_b"), str(tmp_path / "good"), str(tmp_path / "bad"))
    assert (spark.read.parquet(str(tmp_path / "good")).count(), spark.read.parquet(str(tmp_path / "bad")).count()) == (1, 1)
    assert sinks.overwritten(df, "id", {"ood_a": F.lit(None).cast("boolean")}).where("ood_a is null").count() == 2
    assert sinks.markdown(df.select("id").orderBy("id")).splitlines()[2] == "| 1 |"
    sinks.versioned(df, str(tmp_path / "v"), "1")
    with pytest.raises(Exception, match="exist"):
        sinks.versioned(df, str(tmp_path / "v"), "1")


def run_stream(df, tmp_path, mode="append"):
    out = []
    q = df.writeStream.outputMode(mode).foreachBatch(lambda batch, _: out.extend(batch.collect())).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    return out


@pytest.fixture
def stream(spark, tmp_path):
    ts = pd.to_datetime(["2024-01-01 00:05", "2024-01-01 00:50", "2024-01-01 01:10", "2024-01-01 06:00", "2024-01-01 06:00"])
    pdf = pd.DataFrame({"event_id": [1, 2, 3, 4, 4], "ts": ts, "user_id": [1, 1, 2, 1, 1], "event_type": "a", "value": [1.0, 2.0, 3.0, 4.0, 4.0], "props": ""})
    spark.createDataFrame(pdf).withColumn("ts", F.col("ts").cast("timestamp_ntz")).coalesce(1).write.parquet(str(tmp_path / "events"))
    return events.event_stream(spark, str(tmp_path / "events"))


def test_tumbling_windows_close_behind_the_watermark(stream, tmp_path):
    got = run_stream(events.tumbling(stream), tmp_path)
    assert sorted(r["n"] for r in got) == [1, 2]


def test_sessions_and_deduplication(stream, tmp_path):
    assert len(run_stream(events.deduplicated(stream, ["event_id"]), tmp_path)) == 4


def test_state_a_user(stream, tmp_path):
    got = {r["user_id"]: (r["n"], r["most"]) for r in run_stream(events.running_extremes(stream), tmp_path, "update")}
    assert got == {1: (4, 4.0), 2: (1, 3.0)}


def test_annotation_against_a_fixed_reference(spark, stream, tmp_path):
    ref = spark.createDataFrame([("b", 3)], "code string, freq long")
    got = run_stream(events.annotated(events.known_only(stream, spark.createDataFrame([(1,)], "user_id long"), "user_id"), ref, "code", "event_type"), tmp_path)
    assert len(got) == 4 and all(r["ood_new"] for r in got)


def test_compounds(spark, tmp_path):
    (tmp_path / "c.pdb").write_text("COMPND    MOL_ID: 1;\nCOMPND   2 CHAIN: A, B;\nCOMPND   3 EC: 1.2.3.4, 2.1.1.1;\nCOMPND   4 MOL_ID: 2;\nCOMPND   5 CHAIN: C;\nATOM\n")
    got = sorted((r["chain"], r["ec"]) for r in readers.compounds(spark, str(tmp_path / "c.pdb")).collect())
    assert got == [("A", "1.2.3.4"), ("A", "2.1.1.1"), ("B", "1.2.3.4"), ("B", "2.1.1.1")]
