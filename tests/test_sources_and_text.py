import hashlib
import json

import pytest
from pyspark.sql import functions as F

from classtilt import sources
from classtilt.operators import provenance as prov


def test_readers(spark, rows, tmp_path):
    (tmp_path / "d.csv").write_text("a,t\n1,x\n2.5,y\n")
    assert dict(sources.src_dataset(spark, str(tmp_path / "d.csv"), "t").dtypes) == {"a": "double", "t": "string"}
    with pytest.raises(ValueError, match="target"):
        sources.src_dataset(spark, str(tmp_path / "d.csv"), "zz")
    (tmp_path / "r.csv").write_text('dataset_id,notes,categorical_columns\nd1,,"a; b;"\nd2,"x, y",\n')
    table = sources.src_provenance(spark, str(tmp_path / "r.csv"), ["dataset_id", "notes"])
    assert rows(table, "dataset_id", "notes") == [("d1", ""), ("d2", "x, y")]
    assert rows(sources.src_overrides(table)) == [("d1", "a"), ("d1", "b")]
    with pytest.raises(ValueError, match="missing"):
        sources.src_provenance(spark, str(tmp_path / "r.csv"), ["other"])
    (tmp_path / "m.json").write_text('{\n "status": "complete",\n "counts": {"valid": 3}\n}')
    row = sources.src_manifest(spark, str(tmp_path / "m.json"), "status string, counts struct<valid: bigint>").first()
    assert row["status"] == "complete" and row["counts"]["valid"] == 3
    (tmp_path / "p.md").write_text(f"text\n| `a/b` | `{'AB' * 32}` |\n| x | y |\n")
    assert rows(sources.src_hash_table(spark, str(tmp_path / "p.md"))) == [("a/b", "ab" * 32)]
    digest = sources.src_digest(spark, str(tmp_path / "d.csv")).first()
    assert digest["sha256"] == hashlib.sha256((tmp_path / "d.csv").read_bytes()).hexdigest() and digest["length"] == 14


def test_catalogue_drops_incomplete_items(spark, rows):
    names = ["NumberOfInstances", "NumberOfClasses", "MinorityClassSize", "MajorityClassSize", "NumberOfFeatures", "NumberOfNumericFeatures", "NumberOfSymbolicFeatures"]

    def item(did, name, values, drop=None):
        quality = [{"name": n, "value": str(v)} for n, v in zip(names, values) if n != drop]
        return (json.dumps({"did": did, "name": name, "version": 1, "quality": quality}),)

    good = [500.0, 3, 50, 100, 6, 5, 1]
    data = [item(1, "fine", good), item(2, "part", good, "NumberOfFeatures"), item(3, "har", good), item(4, "thyroid-x", good), item(5, "two", [500, 2, 50, 100, 6, 5, 1]), item(6, "mix", [500, 3, 50, 300, 6, 3, 3])]
    got = sources.src_catalog(spark.createDataFrame(data, "item string"))
    assert rows(got, "data_id", "feature_type", "band", "d_raw") == [(1, "numeric", "mild_ir_2_to_5", 5), (6, "mixed", "moderate_ir_5_to_20", 5)]


def test_writers(spark, rows, tmp_path):
    df = spark.createDataFrame([("a", 1, [0.5]), ("b", 2, [1.0])], "dataset string, n int, r array<double>")
    root = str(tmp_path / "out")
    sources.snk_partitioned(df, f"{root}/results")
    sources.snk_partitioned(df.filter("dataset = 'b'").withColumn("n", F.lit(9)), f"{root}/results")
    assert rows(spark.read.parquet(f"{root}/results"), "dataset", "n") == [("a", 1), ("b", 9)]
    sources.snk_table(df, f"{root}/failures")
    both = sources.snk_union(spark, root, expected=2)
    assert both.count() == 4
    with pytest.raises(ValueError):
        sources.snk_union(spark, root, expected=3)
    sources.snk_table(df, f"{root}/csv", "csv")
    assert rows(spark.read.option("header", True).csv(f"{root}/csv"), "r") == [("[0.5]",), ("[1.0]",)]
    sources.snk_manifest(df.agg(F.count("*").alias("n")), f"{root}/manifest")
    assert sources.src_manifest(spark, f"{root}/manifest", "n bigint").first()["n"] == 2


def test_identity_and_redaction(spark, rows):
    revision = "0123456789abcdef0123456789ABCDEF01234567"
    data = [(1, f"mail me: a.b@c.org at /home/me/x rev {revision}"), (2, r"C:\Users\me\file"), (3, "Private NAME here"), (4, "nothing @ all"), (5, None)]
    df = spark.createDataFrame(data, "id int, text string")
    assert rows(prov.txt_identity_scan(df, "id", "text", ["name"])) == [(1, "email"), (1, "local_path"), (1, "revision"), (2, "local_path"), (3, "term:name")]
    done = {r["id"]: r for r in prov.txt_redact(df, "text").collect()}
    assert done[1]["text"] == "mail me: <email> at <local-path> rev <revision>" and done[2]["text"] == "<local-path>"
    assert (done[1]["emails"], done[4]["emails"], done[5]["emails"], done[4]["text"]) == (1, 0, None, "nothing @ all")


def test_json_redaction_and_rebinding(spark, rows):
    df = spark.createDataFrame([('{"a": {"Git_Head": "x\\"y", "n": 1}, "source_commit": 5}',)], "j string")
    assert json.loads(prov.txt_json_redact(df, "j").first()["j"]) == {"a": {"Git_Head": None, "n": 1}, "source_commit": None}
    refs = spark.createDataFrame([("p", "1"), ("q", "2")], "path string, sha256 string")
    assert rows(prov.txt_hash_rebind(refs, spark.createDataFrame([("p", "9")], refs.schema)), "path", "sha256") == [("p", "9"), ("q", "2")]


def test_paths_and_digests(spark, rows):
    paths = ["ok/a.txt", "OK/a.txt", "/abs", "c:/x", "a\\b", "a//b", "../x", "", "results/x.csv", "results/.gitkeep", "artifacts/environment/v2/metadata.json"]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    found = rows(prov.prov_path_rules(df, "p"))
    assert {p for p, _ in found} == {"ok/a.txt", "OK/a.txt", "/abs", "c:/x", "a\\b", "a//b", "../x", ""}
    assert rows(prov.prov_generated_paths(df, "p")) == [("results/x.csv",)]
    want = hashlib.sha256("\x00".join(["a", "b"]).encode()).hexdigest()
    assert prov.prov_set_digest(spark.createDataFrame([("b",), ("a",)], "p string"), "p").first()["digest"] == want
    members = spark.createDataFrame([("a", "1"), ("b", "2")], "name string, sha256 string")
    listed = spark.createDataFrame([("a", "9"), ("c", "3")], members.schema)
    assert rows(prov.prov_member_digest(members, listed)) == [("a", "digest mismatch"), ("b", "present but not listed"), ("c", "listed but missing")]
