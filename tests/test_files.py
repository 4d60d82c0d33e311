"""Readers and writers on small files."""

import gzip
import lzma

import numpy as np
import pandas as pd
import pytest

from matrixloom.sources import files, sinks


def test_delimited_files(spark, tmp_path):
    with gzip.open(tmp_path / "a.csv.gz", "wt", encoding="latin-1") as f:
        f.write("id , x\n1,é\n2,b\n")
    df = files.delimited(spark, str(tmp_path / "a.csv.gz"), encoding="ISO-8859-1")
    assert df.columns == ["id", "x"] and [r["x"] for r in df.collect()] == ["é", "b"]
    assert files.positional(df, 1, 2).columns == ["x"]


def test_json_and_exactly_one(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"g": "a", "s": "Human"}, {"g": "a", "s": "Mouse"}, {"g": "b", "s": "human"}]')
    df = files.json_records(spark, str(tmp_path / "a.json"), "g string, s string")
    assert files.exactly_one(df, "g", "lower(s) = 'human'").count() == 2
    with pytest.raises(ValueError):
        files.exactly_one(df, "g", "true")
    with pytest.raises(ValueError):
        files.strict_json('{"a": NaN}')


def test_arrays_and_records(spark, tmp_path):
    np.savez(tmp_path / "a.npz", u=np.arange(6.0).reshape(2, 3))
    rows = files.array_archive(spark, str(tmp_path / "a.npz"), ["u"]).orderBy("row").collect()
    assert [r["x"] for r in rows] == [[0, 1, 2], [3, 4, 5]]
    (tmp_path / "r.sdf.xz").write_bytes(lzma.compress(b"one\n$$$$\ntwo\nlines\n$$$$\n"))
    got = files.delimited_records(spark, str(tmp_path / "r.sdf.xz")).orderBy("number").collect()
    assert [r["record"] for r in got] == ["one\n", "two\nlines\n"]
    (tmp_path / "bad.sdf").write_bytes(b"one\n$$$$\ntwo\n")
    with pytest.raises(Exception, match="ends inside a record"):
        files.delimited_records(spark, str(tmp_path / "bad.sdf")).collect()


def test_fixed_width_and_simulated(spark):
    lines = spark.createDataFrame([("ATOM   12  CA  ALA",)], "value string")
    assert files.fixed_width(lines, {"kind": (11, 14), "residue": (15, 18)}).first()[1:] == ("CA", "ALA")
    a, b = (sorted(map(tuple, files.simulated(spark, 20, 4, 7).repartition(n).collect())) for n in (1, 5))
    assert a == b and len(a) == 80


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(2, 0.1234567890123456), (1, float("nan"))], "k int, v double")
    assert {r["value"] for r in sinks.json_lines(df).collect()} == {'{"k":1,"v":null}', '{"k":2,"v":0.1234567890123456}'}
    sinks.to_csv(df, str(tmp_path / "out"), 5)
    assert {r["v"] for r in spark.read.csv(str(tmp_path / "out"), header=True).collect()} == {"0.12346", "NaN"}


def test_manifests(spark, tmp_path):
    for n in ("a", "b"):
        (tmp_path / n).write_text(n)
    found = sinks.manifest(spark, str(tmp_path))
    assert [r["name"] for r in found.collect()] == ["a", "b"]
    declared = spark.createDataFrame([("a", 1, sinks.digest(b"a")), ("c", 1, sinks.digest(b"c")), ("b", 1, sinks.digest(b"x"))], "name string, length long, sha256 string")
    assert {tuple(r) for r in sinks.manifest_faults(found, declared).collect()} == {("c", "missing"), ("b", "changed")}
    assert files.gated(spark, str(tmp_path / "a"), sinks.digest(b"a"))
    with pytest.raises(ValueError):
        files.gated(spark, str(tmp_path / "a"), sinks.digest(b"b"))


def test_one_gzip_file_with_equal_bytes(spark, tmp_path):
    """Bytes follow from the rows, not from how they are dealt; pieces are whole gzip members; odd texts come back."""
    rows = [(k, None if k % 7 == 0 else f'a "{k}", b\nc' if k % 5 == 0 else f"é{k}", k / 8) for k in range(1000)]
    df = spark.createDataFrame(rows, "k int, t string, v double")
    for name, parts in (("one", 1), ("many", 16)):
        sinks.to_csv_gz(df.repartition(parts), f"{tmp_path}/{name}.csv.gz", ["k"], 300)
    one, many = ((tmp_path / f"{n}.csv.gz").read_bytes() for n in ("one", "many"))
    assert one == many and sinks.csv_members(df, ["k"], 300).count() == 4
    back = pd.read_csv(tmp_path / "one.csv.gz")
    assert back["k"].tolist() == list(range(1000)) and back["v"].tolist() == [r[2] for r in rows]
    assert [None if pd.isna(t) else t for t in back["t"]] == [r[1] for r in rows]
    sinks.to_csv_gz(df.limit(0), f"{tmp_path}/none.csv.gz", ["k"])
    assert gzip.decompress((tmp_path / "none.csv.gz").read_bytes()) == b"k,t,v\n"


def test_digests_of_long_files_are_made_in_rounds(spark, tmp_path, monkeypatch):
    """Before, one task held each whole file."""
    import hashlib
    import random

    rng = random.Random(2)
    noise = rng.randbytes(70_000)
    mark = b"\xef\xbb\xbf"
    texts = [b"a", noise, noise + b"\n", mark + noise, mark + noise + b"\n", b"\n" * 9000, b"\r\n" * 5000 + b"\r", bytes(30_000), mark * 3000, mark + b"\n" * 8000, noise[:8192]]
    for k, t in enumerate(texts):
        (tmp_path / f"{k} %.bin").write_bytes(t)
    with gzip.open(tmp_path / "p.gz", "wb") as f:
        f.write(noise)
    held = []
    monkeypatch.setattr(files, "WHOLE", 1000)
    monkeypatch.setattr(files, "ROUND", 20_000)
    monkeypatch.setattr(files, "PIECE", 3000)
    monkeypatch.setattr(files, "_added", lambda s, p, f=files._added: held.append(p.groupBy("name").agg({"bytes": "count"}).count()) or f(s, p))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7000")
    try:
        got = sorted((r["path"].rsplit("/", 1)[1], r["length"], r["sha256"]) for r in files.digests(spark, str(tmp_path)).collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    want = sorted((f.name, f.stat().st_size, hashlib.sha256(f.read_bytes()).hexdigest()) for f in tmp_path.iterdir())
    assert got == want
    assert len(held) == 4 and held[-1] >= 4
