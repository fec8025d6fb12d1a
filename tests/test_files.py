"""Readers and sinks by round trips, with quotes, line ends, broken bytes and nulls."""

import pytest

from strandlake.sources import files


def local(path):
    return str(path).removeprefix("file://")


def test_csv(spark, tmp_path):
    rows = [(1, 'a "quoted", b', 1.5), (2, "ü", None), (3, None, -0.0)]
    files.write_csv(spark.createDataFrame(rows, "k long, s string, v double"), f"{tmp_path}/a")
    assert sorted(map(tuple, files.read_csv(spark, f"{tmp_path}/a", "k long, s string, v double").collect())) == rows
    assert [r["v"] for r in files.read_csv(spark, f"{tmp_path}/a", "k long, s string, v double", ["v"]).collect()].count(None) == 1
    assert dict(files.read_csv_auto(spark, f"{tmp_path}/a").dtypes) == {"k": "int", "s": "string", "v": "double"}
    (tmp_path / "broken.csv").write_bytes(b"k,s\n1,caf\xe9\nx,ok\n")
    got = [tuple(r) for r in files.read_csv(spark, f"{tmp_path}/broken.csv", "k long, s string").collect()]
    assert got == [(1, "caf�"), (None, "ok")]
    files.csv_to_parquet(spark, f"{tmp_path}/a", f"{tmp_path}/p")
    assert spark.read.parquet(f"{tmp_path}/p").count() == 3


def test_json(spark, tmp_path):
    df = spark.createDataFrame([(1, {"b": 2}, [1.0, 2.5], "z")], "z int, m map<string,int>, a array<double>, k string")
    files.write_json(df.selectExpr("z", "struct(k AS y, z AS x) AS s", "a", "k"), f"{tmp_path}/j")
    text = spark.read.text(f"{tmp_path}/j").first()[0]
    assert text == '{"a":[1.0,2.5],"k":"z","s":{"x":1,"y":"z"},"z":1}'
    assert files.read_json(spark, f"{tmp_path}/j", lines=True).first()["s"]["x"] == 1
    for bad in ("double('nan')", "array(1.0D, double('infinity'))", "named_struct('q', double('-infinity'))", "map('k', double('nan'))"):
        with pytest.raises(Exception, match="NaN or infinite"):
            files.write_json(spark.sql(f"SELECT {bad} AS v"), f"{tmp_path}/bad")


def test_fasta(spark, tmp_path):
    (tmp_path / "x.fa").write_bytes(b"; note\n>a first words\nAC\nGT\n\n>b\r\nTT\r\nG\r\n>a again\n  CC \n>empty\n>c\nA\xffB\n")
    got = {r["id"]: r["sequence"] for r in files.read_fasta(spark, f"{tmp_path}/x.fa").collect()}
    assert got == {"a": "CC", "b": "TTG", "empty": "", "c": "A�B"}
    long = "ACDEFGHIKL" * 13
    files.write_fasta(spark.createDataFrame([("q", long), ("r", ""), (None, "A"), ("s", None)], "i string, s string"), f"{tmp_path}/w", "i", "s")
    assert {r["id"]: r["sequence"] for r in files.read_fasta(spark, f"{tmp_path}/w").collect()} == {"q": long, "r": ""}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
    try:
        (tmp_path / "y.fa").write_text("".join(f">s{i}\n{'A' * (i % 7)}\n{'C' * 5}\n" for i in range(60)))
        assert {r["id"]: r["sequence"] for r in files.read_fasta(spark, f"{tmp_path}/y.fa").collect()} == {f"s{i}": "A" * (i % 7) + "CCCCC" for i in range(60)}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_alignments(spark, tmp_path):
    (tmp_path / "P1.afa").write_text(">human\nA-C\n>10090_Q1\nAGC\n>9999_Z\nAAA\n>10090x\nCCC\n")
    (tmp_path / "P2.afa").write_text(">P2\nAA\n>10090_Q2_b\nA-\n")
    (tmp_path / "P3.afa").write_text(">10090_Q3\nA-\n")
    (tmp_path / "P1.0a_1f.afa").write_text(">human\nTTT\n>10090_Q9\nTTT\n")
    got = sorted(map(tuple, files.read_alignments(spark, str(tmp_path), ["10090"]).select("accession", "taxon", "member", "sequence", "main_sequence").collect()))
    assert got == [("P1", "10090", "Q1", "AGC", "A-C"), ("P2", "10090", "Q2_b", "A-", "AA")]


def test_caches_and_receipts(spark, tmp_path):
    made = []
    make = lambda: made.append(1) or spark.range(3)
    assert files.cached(spark, f"{tmp_path}/c", make).count() == files.cached(spark, f"{tmp_path}/c", make).count() == 3 and made == [1]
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "one").write_text("1")
    (tmp_path / "d" / "two").write_text("22")
    before = files.materialised(spark, files.manifest(spark, f"{tmp_path}/d"), "before")
    first = files.tree_digest(before, f"{tmp_path}/d").first()
    (tmp_path / "d" / "two").write_text("23")
    now = files.manifest(spark, f"{tmp_path}/d")
    assert {r["file"].rsplit("/", 1)[1]: r["reason"] for r in files.receipts_hold(before, now).collect()} == {"one": "ok", "two": "hash"}
    assert first["files"] == 2 and files.tree_digest(now, f"{tmp_path}/d").first()["digest"] != first["digest"]


def test_config():
    schema = {"seed": (int, 0, 10), "name": str, "rate": (float, 0.0, 1.0)}
    assert files.checked_config({"seed": 1, "name": "x", "rate": 0.5}, schema)["seed"] == 1
    with pytest.raises(ValueError, match="unknown: more; missing: rate; seed: 11; name: 3"):
        files.checked_config({"seed": 11, "name": 3, "more": 1}, schema)
