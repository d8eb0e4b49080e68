import pytest

from marginspark import train
from tests.conftest import blobs


@pytest.fixture
def lines(tmp_path):
    X, y = blobs(120)
    rows = [f"{a},{b},{t}" for (a, b, _), t in zip(X, y)]
    (tmp_path / "in.txt").write_text("\n".join([*rows, "1,2,7"]) + "\n")
    return str(tmp_path / "in.txt")


@pytest.mark.parametrize(
    "job,tables",
    [("distribution_aware", {"history", "coef"}), ("svrg", {"trace"}), ("block_svrg", {"trace"})],
)
def test_text_in_weights_out(spark, tmp_path, lines, job, tables):
    out = tmp_path / "out"
    train.main(
        [lines, str(out), "--job", job, "--levels", "3", "--epochs", "2", "--steps", "3",
         "--landmarks", "5", "--sweeps", "-1", "--eta", "0.001", "--blocks", "5"],
        spark,
    )
    assert {p.name for p in out.iterdir()} == tables | {"weights", "rejected"}
    weights = spark.read.text(str(out / "weights")).collect()
    assert len(weights) == 1
    w = [float(v) for v in weights[0][0].split(",")]
    assert len(w) == 3
    assert [r["line"] for r in spark.read.parquet(str(out / "rejected")).collect()] == ["1,2,7"]
    if job == "distribution_aware":
        assert w[0] > 0 and w[1] > 0
        assert spark.read.parquet(str(out / "history")).count() == 2
