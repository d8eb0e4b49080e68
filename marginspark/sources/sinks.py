"""Where jobs write their per-level results, traces and models.

A hierarchical run writes each level's coefficients and its row of history into
folders of their own, and then a mark that commits the level.  Readers see
committed levels only, whatever a stopped job has left behind, and the run may
be taken up again after the last of them.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginspark.functions import vectors as V


def _hadoop(spark: SparkSession, folder: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def _names(spark: SparkSession, folder: str) -> list[str]:
    fs, path = _hadoop(spark, folder)
    return [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []


def require_empty(spark: SparkSession, folder: str) -> None:
    """Raise if ``folder`` holds anything: asked before a job starts, so that no
    work is lost and no two runs are mixed in one folder."""
    if _names(spark, folder):
        raise FileExistsError(f"{folder} is not empty; choose another output folder")


def _by_id(coefs: DataFrame) -> DataFrame:
    return coefs.repartitionByRange("id").sortWithinPartitions("id")


def append_coefs(coefs: DataFrame, folder: str) -> None:
    """Non-zero coefficients, one folder per level, in the order of id."""
    _by_id(coefs).write.mode("append").partitionBy("level").parquet(f"{folder}/coef")


@dataclass(frozen=True)
class Commit:
    """What the mark of a level says: where the level's rows and coefficients
    are stored for the job itself, and the milliseconds until then."""

    level: int
    state: str
    coef: str
    elapsed_ms: int


class RunFolder:
    """The output of one hierarchical run: ``history/level=L`` (one row: sizes
    and milliseconds since the start) and ``coef/level=L``.  Marks and settings
    lie in ``history/_run``, which Spark's readers pass over."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        self.marks = f"{self.folder}/history/_run"

    def begin(self, settings: dict, resume: bool = False) -> list[Commit]:
        """The levels committed so far, first level first.  A folder that holds
        a run is refused unless that is to be resumed with the same settings."""
        said = json.dumps(settings, sort_keys=True)
        if "settings" not in _names(self.spark, self.marks):
            for table in ("history", "coef"):
                require_empty(self.spark, f"{self.folder}/{table}")
            self._put("settings", said)
        elif not resume:
            raise FileExistsError(f"{self.folder} holds another run; resume it or choose another folder")
        elif self._get("settings") != said:
            raise ValueError(f"{self.folder} holds a run with other settings: {self._get('settings')}")
        return self.commits()

    def commits(self) -> list[Commit]:
        names = [n for n in _names(self.spark, self.marks) if n.startswith("level-") and n.endswith(".json")]
        found = [Commit(**json.loads(self._get(n))) for n in names]
        return sorted(found, key=lambda c: -c.level)

    def commit(self, coefs: DataFrame, history: DataFrame, mark: Commit) -> None:
        """Write a level.  What a stopped job left of it is overwritten."""
        at = f"level={mark.level}"
        _by_id(coefs.drop("level")).write.mode("overwrite").parquet(f"{self.folder}/coef/{at}")
        history.drop("level").coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/history/{at}")
        self._put(f"level-{mark.level}.json", json.dumps(asdict(mark)))

    def read(self, table: str, schema: str) -> DataFrame:
        """``history`` or ``coef`` of the committed levels."""
        paths = [f"{self.folder}/{table}/level={c.level}" for c in self.commits()]
        if not paths:
            return self.spark.createDataFrame([], schema)
        reader = self.spark.read.option("basePath", f"{self.folder}/{table}")
        return self.spark.createDataFrame([], schema).unionByName(reader.parquet(*paths))

    def _put(self, name: str, said: str) -> None:
        """A small file that is there as a whole or not at all."""
        fs, path = _hadoop(self.spark, f"{self.marks}/{name}")
        _, made = _hadoop(self.spark, f"{self.marks}/{name}.part")
        out = fs.create(made, True)
        try:
            out.write(bytearray(said, "utf-8"))
        finally:
            out.close()
        fs.delete(path, False)
        if not fs.rename(made, path):
            raise OSError(f"cannot write {path}")

    def _get(self, name: str) -> str:
        file = f"{self.marks}/{name}"
        return self.spark.read.text(file, wholetext=True).first()[0]


def append_trace(trace: DataFrame, folder: str) -> None:
    """One row per inner round: the weights and the batch loss."""
    trace.coalesce(1).write.mode("append").parquet(f"{folder}/trace")


def write_weights_text(model: DataFrame, path: str, sep: str = ",") -> None:
    """Long-form weights ``(j, w)`` as one delimited line."""
    ordered = F.sort_array(F.collect_list(F.struct("j", "w")))
    line = V.join_text(F.transform(ordered, lambda e: e["w"]), sep)
    model.agg(line.alias("value")).coalesce(1).write.text(path)
