import gzip

import pytest
from pyspark.sql import functions as F

from marginspark.functions import vectors as V
from marginspark.sources import sinks, text
from marginspark.workspace import Workspace, shared_dir
from tests.conftest import SMALL
from workload import fixtures as fx


def write(path, lines):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("".join(f"{line}\n" for line in lines))


def test_points_and_rejects(spark, ws, tmp_path):
    good = [f"{i}.5,{i * 2},{1 if i % 2 else -1}" for i in range(40)]
    bad = ["1,x,1", "1,2,0", "1,1", "", "1,2,3,1", "1,nan,1"]
    write(tmp_path / "in/a.txt", good[:10] + bad[:3] + good[10:20])
    write(tmp_path / "in/b.txt", bad[3:] + good[20:])
    points, rejected = text.read_points(spark, str(tmp_path / "in"), workspace=ws)
    rows = points.orderBy("id").collect()
    assert [r["id"] for r in rows] == list(range(40))
    assert [r["x"] for r in rows] == [[i + 0.5, 2.0 * i, 1.0] for i in range(40)]
    assert [r["y"] for r in rows] == [1 if i % 2 else -1 for i in range(40)]
    reasons = {r["line"]: r["reason"] for r in rejected.collect()}
    assert set(reasons) == set(bad)
    assert reasons["1,x,1"] == reasons["1,nan,1"] == "non-numeric field"
    assert reasons["1,2,0"] == "label is not +1 or -1"
    assert reasons["1,1"] == "wrong number of fields"
    assert text.check_points(points) == (40, 3)


def test_ids_follow_the_file_order_over_many_splits(spark, ws, tmp_path, monkeypatch):
    lines = [f"{i},{i},1" for i in range(5000)]
    write(tmp_path / "in/a.txt", lines[:4000])
    write(tmp_path / "in/b.txt", lines[4000:])
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        points, rejected = text.read_points(spark, str(tmp_path / "in"), workspace=ws)
        assert points.where("x[0] <> id").count() == 0
        assert points.count() == 5000 and rejected.count() == 0
        # a directory that is too long to travel makes no difference
        monkeypatch.setattr(text, "MAX_BROADCAST_SPLITS", 0)
        again, _ = text.read_points(spark, str(tmp_path / "in"), workspace=ws)
        assert again.where("x[0] <> id").count() == 0 and again.count() == 5000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_files_that_cannot_be_split(spark, ws, tmp_path):
    """Ids of compressed files skip their bad lines, with no window in the plan
    and one stored copy of the rows."""
    folder = tmp_path / "in"
    folder.mkdir()
    lines = [f"{i},{i},1" if i % 7 else "bad" for i in range(3000)]
    for name, own in (("a", lines[:1000]), ("b", lines[1000:1001]), ("c", lines[1001:])):
        with gzip.open(folder / f"{name}.txt.gz", "wt") as out:
            out.write("\n".join(own) + "\n")
    points, rejected = text.read_points(spark, str(folder), workspace=ws)
    want = [i for i in range(3000) if i % 7]
    assert [r["x"][0] for r in points.orderBy("id").collect()] == want
    assert [r["id"] for r in points.orderBy("id").collect()] == list(range(len(want)))
    assert rejected.count() == 3000 - len(want)
    assert "Window" not in points._jdf.queryExecution().optimizedPlan().toString()
    stored = {f.parent.name.split("-", 1)[1] for f in tmp_path.rglob("_SUCCESS")}
    assert stored == {"good", "directory", "rejected"}


def test_no_good_lines(spark, ws, tmp_path):
    write(tmp_path / "in/a.txt", ["x,1", "y,2"])
    points, rejected = text.read_points(spark, str(tmp_path / "in"), workspace=ws)
    assert points.count() == 0 and rejected.count() == 2


def test_orders_survive_the_round_trip(spark, ws, tmp_path):
    points = fx.orders(spark, SMALL)
    features = F.slice("x", 1, 3)
    line = F.concat_ws(",", V.join_text(features), F.col("y").cast("string"))
    points.orderBy("id").coalesce(1).select(line.alias("value")).write.text(
        str(tmp_path / "t")
    )
    back, rejected = text.read_points(spark, str(tmp_path / "t"), workspace=ws)
    assert rejected.count() == 0
    want = [tuple(r["x"]) for r in points.orderBy("id").collect()]
    assert [tuple(r["x"]) for r in back.orderBy("id").collect()] == want


def test_other_separators_and_ragged_points(spark, tmp_path):
    lines = spark.createDataFrame([("1|2|1",), ("3|4|-1",)], "value string")
    parsed = text.parse_lines(lines, "|", 3).collect()
    assert [r["x"] for r in parsed] == [[1.0, 2.0, 1.0], [3.0, 4.0, 1.0]]
    rows = [([1.0], 1), ([1.0, 2.0], -1)]
    ragged = spark.createDataFrame(rows, "x array<double>, y int")
    with pytest.raises(ValueError, match="differ"):
        text.check_points(ragged)
    with pytest.raises(ValueError, match="no points"):
        text.check_points(ragged.where("false"))
    with pytest.raises(ValueError, match="labels"):
        text.check_points(ragged.limit(1).withColumn("y", F.lit(None).cast("int")))


def test_weights_as_text(spark, tmp_path):
    model = spark.createDataFrame([(1, -2.5), (0, 0.5)], "j int, w double")
    sinks.write_weights_text(model, str(tmp_path / "w"))
    assert spark.read.text(str(tmp_path / "w")).first()[0] == "0.5,-2.5"


def test_workspace_drops_its_own_tables_only(spark, tmp_path):
    ws = Workspace(spark, str(tmp_path))
    table = ws.save(spark.range(10), "t")
    assert table.count() == 10 and len(list(tmp_path.rglob("*.parquet")))
    ws.drop(spark.range(3))
    ws.drop(None)
    ws.drop(table)
    assert not list(tmp_path.rglob("*.parquet"))


def test_release_keeps_what_is_named(spark, tmp_path):
    ws = Workspace(spark, str(tmp_path))
    before = ws.save(spark.range(1), "before")
    mark = ws.mark()
    ws.save(spark.range(2), "helper")
    result = ws.save(spark.range(3), "result")
    ws.release(mark, result)
    assert before.count() == 1 and result.count() == 3
    assert len({f.parent for f in tmp_path.rglob("*.parquet")}) == 2


class FakeContext:
    def __init__(self, master, folder=None):
        self.master, self.folder = master, folder

    def getCheckpointDir(self):
        return self.folder


class FakeSession:
    def __init__(self, master, conf=None, folder=None):
        self.sparkContext = FakeContext(master, folder)
        self.conf = conf or {}


def test_clusters_must_name_the_shared_folder():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(FakeSession("yarn"))
    named = FakeSession("yarn", {"spark.checkpoint.dir": "hdfs://shared/ck"})
    assert shared_dir(named) == "hdfs://shared/ck"
    assert shared_dir(FakeSession("yarn", folder="hdfs://x")) == "hdfs://x"
