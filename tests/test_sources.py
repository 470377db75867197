import hashlib

import pytest

from tarnsift.operators import prep as M
from tarnsift.sources import tables as S


def test_class_files(spark, tmp_path):
    for n in ("a", "b"):
        (tmp_path / f"{n}.csv").write_text("ID,label\n1,x\n2,y\n")
    df = S.read_class_files(spark, str(tmp_path), ["a.csv", "b.csv"], "ID int, label string")
    assert df.count() == 4 and {r[0] for r in df.select("file").distinct().collect()} == {"a.csv", "b.csv"}
    with pytest.raises(ValueError):
        S.read_class_files(spark, str(tmp_path), ["a.csv"], "ID int, label string")


def test_flows_are_trimmed_and_widened(spark, tmp_path):
    (tmp_path / "f.csv").write_text(" A , Label\n1,x\n")
    df = S.read_flows(spark, str(tmp_path / "f.csv"))
    assert df.dtypes == [("A", "double"), ("Label", "string")]


def test_splits_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1.0, 0, "train"), (2.0, 1, "train"), (3.0, 1, "val"), (4.0, 0, "test")], "x double, label int, split string")
    S.write_splits(df, str(tmp_path / "s"), "label")
    parts = S.read_splits(spark, str(tmp_path / "s"), "label")
    assert {k: v.count() for k, v in parts.items()} == {"train": 2, "val": 1, "test": 1} and parts["val"].columns[0] == "label"
    assert S.verify_saved(df, "label", ["x"], balanced="train").count() == 3
    with pytest.raises(ValueError):
        S.verify_saved(df.withColumn("x", df.x * float("inf")), "label", ["x"])


def test_inventory_and_results(spark, tmp_path):
    (tmp_path / "code").mkdir()
    (tmp_path / "code" / "a.txt").write_text("hi")
    r = S.file_inventory(spark, str(tmp_path), {"code/": "source"}).collect()
    assert [tuple(x) for x in r] == [("code/a.txt", 2, hashlib.sha256(b"hi").hexdigest(), "source")]
    run = tmp_path / "D" / "seed_42" / "dp"
    run.mkdir(parents=True)
    (run / "s.json").write_text('{"f1": 0.5}')
    got = S.read_run_results(spark, str(tmp_path / "D" / "seed_*" / "*" / "*.json")).first()
    assert (got["dataset"], got["seed"], got["method"], got["f1"]) == ("D", 42, "dp", 0.5)


def test_fitted_state(spark, tmp_path):
    train = spark.createDataFrame([(1.0, "a"), (3.0, "b"), (None, "b"), (5.0, None)], "x double, c string")
    model = M.fit(train, ["x"], ["c"])
    M.save_model(model, str(tmp_path / "m"))
    out = M.transform(spark.createDataFrame([(None, "zz"), (3.0, None)], "x double, c string"), M.load_model(spark, str(tmp_path / "m"))).collect()
    assert out[0]["x"] == out[1]["x"] == 0.0
    assert (out[0]["c=a"], out[0]["c=b"], out[1]["c=b"]) == (0, 0, 1)


class _Session:
    """What shared_dir looks at of a session."""

    def __init__(self, master, folder=None):
        self.sparkContext = type("C", (), {"master": master, "applicationId": "app-1"})()
        self.conf = type("F", (), {"get": lambda self, key, default: folder})()


def test_a_cluster_needs_a_shared_folder_and_replaced_tables_go(spark):
    from tarnsift.sources.shared import shared_dir, stored

    assert shared_dir(_Session("spark://host:7077", "hdfs://x/y")) == "hdfs://x/y" and shared_dir(_Session("local[4]")).startswith("file://")
    with pytest.raises(ValueError):
        shared_dir(_Session("local-cluster[3,2,1000]"))
    first = stored(spark.range(5), "one")
    second = stored(first.where("id > 2"), "two", instead_of=first)
    folder = first.inputFiles() and first.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file://")
    assert second.count() == 2 and not __import__("os").path.exists(folder)
