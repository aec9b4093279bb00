import gzip
import hashlib
import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from scanloom.operators.sets import ContractError
from scanloom.sources import tables, volumes
from scanloom.streaming import streams


def test_csv_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("﻿case_id,v\n1,2.5\n2,NaN\n3,\n".encode())
    typed = tables.csv_typed(spark, str(tmp_path / "a.csv"), "case_id int, v double")
    assert [r["v"] for r in typed.orderBy("case_id").collect()] == [2.5, None, None]
    assert tables.csv_typed(spark, str(tmp_path / "none.csv"), "case_id int").count() == 0
    assert tables.csv_text(spark, str(tmp_path / "a.csv")).columns == ["case_id", "v"]
    assert tables.csv_text(spark, str(tmp_path / "none.csv")).count() == 0
    with pytest.raises(ContractError, match="who"):
        tables.mapping_csv(spark, str(tmp_path / "a.csv"), ["case_id", "who"])
    (tmp_path / "b.csv").write_text("case_id,w\n1,x\n3,y\n")
    both = tables.csv_joined(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")], types={"case_id": "int"})
    assert sorted((r["case_id"], r["w"]) for r in both.collect()) == [(1, "x"), (3, "y")]


def test_json_sources(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a": 1}\n\nnot json\n[1]\n{"a": 2}\n{"a": \n')
    assert sorted(r["a"] for r in tables.json_lines(spark, str(tmp_path / "a.jsonl"), "a int").collect()) == [1, 2]
    (tmp_path / "o.json").write_text('{\n "a": 5\n}')
    assert tables.json_object(spark, str(tmp_path / "o.json"), "a int").first()["a"] == 5
    assert tables.json_object(spark, str(tmp_path / "no.json"), "a int").count() == 0
    (tmp_path / "s.json").write_text(json.dumps({"train": ["x", "y"], "val": ["z"]}))
    got = tables.split_documents(tables.whole_texts(spark, str(tmp_path / "s.json"))).collect()
    assert sorted((r["fold"], r["split"], r["id"]) for r in got) == [(0, "train", "x"), (0, "train", "y"), (0, "val", "z")]
    (tmp_path / "d.json").write_text(json.dumps({"training": [{"image": "a", "label": "b", "fold": 0}, {"image": "c", "label": "d"}]}))
    records = tables.datalist(tables.whole_texts(spark, str(tmp_path / "d.json")), "training", "/base/")
    train, val = tables.fold_parts(records, 0)
    assert [r["image"] for r in val.collect()] == ["/base/a"] and [r["image"] for r in train.collect()] == ["/base/c"]


def test_listings_and_checks(spark, tmp_path):
    for case, names in {"c1": ["c1-t1n.nii.gz", "c1-t2w.nii.gz"], "c2": ["c2-t1n.nii.gz"]}.items():
        (tmp_path / "in" / case).mkdir(parents=True)
        for n in names:
            (tmp_path / "in" / case / n).write_bytes(n.encode())
    files = tables.listing(spark, str(tmp_path / "in"))
    assert files.count() == 3 and tables.parent_folders(files, [".nii.gz"]).count() == 2
    done = tables.completeness(tables.modality_files(files, ["t1n", "t2w"]), ["t1n", "t2w"])
    assert {r["folder"].rsplit("/", 1)[1]: (r["complete"], r["missing"]) for r in done.collect()} == {"c1": (True, ""), "c2": (False, "t2w")}
    asked = spark.createDataFrame([(f"file:{tmp_path}/in/c1/c1-t1n.nii.gz", "file:/nowhere")], "image string, label string")
    assert [r["path"] for r in tables.missing_files(asked, ["image", "label"], files).collect()] == ["file:/nowhere"]
    md5 = lambda s: hashlib.md5(s.encode()).hexdigest()
    expected = spark.createDataFrame([("c1-t1n.nii.gz", md5("c1-t1n.nii.gz")), ("c2-t1n.nii.gz", "0"), ("gone", "1")], "name string, md5 string")
    assert sorted(r["name"] for r in tables.checksums(spark, str(tmp_path / "in"), expected).collect()) == ["c2-t1n.nii.gz", "gone"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, None, "x|y")], "id int, b string, a string")
    tables.write_csv(df, str(tmp_path / "out"), ["id"])
    assert spark.read.option("header", "true").csv(str(tmp_path / "out")).columns == ["id", "a", "b"]
    assert tables.markdown(df, 5).splitlines()[2] == "| 1 |  | x\\|y |"
    log = spark.createDataFrame([("a", 1, 10), ("a", 2, 20), ("b", 1, 5)], "k string, n int, v int")
    assert sorted((r["k"], r["v"]) for r in tables.last_saved(log, "k", "n").collect()) == [("a", 20), ("b", 5)]
    (tmp_path / "src").write_text("data")
    plan = spark.createDataFrame([(str(tmp_path / "src"), str(tmp_path / "to" / "f")), (None, str(tmp_path / "to" / "g"))], "s string, t string")
    acts = tables.copy_actions(plan, "s", "t", "copy", spark.createDataFrame([], "path string"))
    assert sorted(r["action"] for r in tables.materialise(acts, "s", "t").collect()) == ["copy", "missing_source"]
    assert (tmp_path / "to" / "f").read_text() == "data" and not os.path.exists(tmp_path / "to" / "g")


def test_volumes(spark, tmp_path):
    affine = np.array([[-1.5, 0, 0, 10], [0, 2, 0, -5], [0, 0, 3, 1], [0, 0, 0, 1]], float)
    values = np.arange(24, dtype=np.int16).reshape(2, 3, 4)
    data = volumes.write_nifti(values, affine)
    got, a, spacing = volumes.read_nifti(gzip.compress(data))
    assert np.array_equal(got, values) and np.allclose(a, affine) and np.allclose(spacing, (1.5, 2, 3))
    rows = spark.createDataFrame([("a.nii.gz", bytearray(gzip.compress(data))), ("b.nii", bytearray(b"broken"))], "name string, content binary")
    (tmp_path / "v").mkdir()
    volumes.write_volumes(rows, str(tmp_path / "v"))
    np.save(tmp_path / "v" / "c.npy", np.zeros((2, 2)))
    found = {r["path"].rsplit("/", 1)[1]: r for r in volumes.headers(volumes.binary_files(spark, str(tmp_path / "v"))).collect()}
    assert found["a.nii.gz"]["shape"] == [2, 3, 4] and found["a.nii.gz"]["affine_hash"] == volumes.affine_hash(affine) and found["a.nii.gz"]["dtype"] == "int16"
    assert found["b.nii"]["error"] and found["c.npy"]["shape"] == [2, 2]
    vox = volumes.voxels(volumes.binary_files(spark, str(tmp_path / "v"), "*.nii.gz"))
    assert vox.count() == 23 and vox.agg(F.sum("value")).first()[0] == values.sum()
    with pytest.raises(ValueError):
        volumes.reader_for("x.txt")


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k in range(3):
        (tmp_path / "in" / f"{k}.csv").write_text("g,v,w,ts\n" + "".join(f"g{i % 2},{i + k},1,2024-01-01T00:0{k}:0{i}\n" for i in range(4)))
    schema = "g string, v double, w double, ts timestamp"
    stream = streams.csv_chunks(spark, str(tmp_path / "in"), schema)
    for _ in range(2):  # the second run finds nothing new
        streams.run_available(stream, streams.append_log(str(tmp_path / "log")), str(tmp_path / "cp"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 12
    last = {}
    streams.run_available(streams.running_average(stream, ["g"], "v", "w"), lambda b, n: last.update({r["g"]: r["average"] for r in b.collect()}), str(tmp_path / "cp2"), "update")
    assert last == {"g0": 2.0, "g1": 3.0}
    seen = []
    streams.run_available(streams.windowed_counts(stream, "ts", "g", "1 minute", "10 minutes"), lambda b, n: seen.extend(b.collect()), str(tmp_path / "cp3"), "update")
    assert sum(r["n"] for r in seen) == 12


def test_mounted_folders_are_listed_by_tasks_as_spark_lists_them(spark, tmp_path):
    for k in range(60):
        folder = tmp_path / "in" / f"s{k % 7}" / f"case {k}"
        folder.mkdir(parents=True)
        (folder / "image.nii").write_bytes(b"x" * k)
        (folder / ("_hidden.nii" if k % 2 else ".hidden.nii")).write_bytes(b"y")
        (folder / "notes.txt").write_text("n")
    for root in (f"{tmp_path}/in", f"file://{tmp_path}/in", f"file:{tmp_path}/in/"):
        read = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.nii").load(root)
        want = read.select("path", "length", "modificationTime").collect()
        got = tables.listing(spark, root, "*.nii")
        assert "binaryFile" not in got._jdf.queryExecution().toString()
        assert len(want) == 59 and sorted(map(tuple, got.collect())) == sorted(map(tuple, want))
    assert tables.listing(spark, f"{tmp_path}/none").collect() == []
    assert [r["size"] for r in tables.listing(spark, f"{tmp_path}/in/s1/case 8/image.nii").collect()] == [8]


def test_json_objects_of_many_files(spark, tmp_path):
    whole = {k: (json.dumps({"a": k, "b": [k]}, indent=1) if k % 3 else "[{\"a\": 1}]" if k % 2 else "{broken") for k in range(300)}
    for k, text in whole.items():
        (tmp_path / "in" / str(k % 3)).mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / str(k % 3) / f"{k}.json").write_text(text)
    (tmp_path / "in" / "top.json").write_bytes(b"\xef\xbb\xbf \n{\"a\": -1, \"b\": null}")
    (tmp_path / "in" / "zipped.json.gz").write_bytes(gzip.compress(b"{\"a\": -2}"))
    (tmp_path / "in" / "odd.json").write_bytes(b"{\"a\": \"\xff\"}")
    (tmp_path / "in" / "kind.json").write_text("{\"a\": \"text\"}")
    (tmp_path / "in" / "empty.json").write_text("")
    got = tables.json_object(spark, str(tmp_path / "in"), "a int, b array<int>", deep=True)
    want = {(k, (k,)) for k in whole if k % 3} | {(-1, None), (-2, None)}
    assert {(r["a"], r["b"] and tuple(r["b"])) for r in got.collect()} == want
    assert got.rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism
    assert {r["a"] for r in tables.json_object(spark, f"file:{tmp_path}/in", "a int, b array<int>").collect()} == {-1, -2}
