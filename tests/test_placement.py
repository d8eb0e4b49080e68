import numpy as np
import pytest
from pyspark.sql import functions as F

from marginspark.operators import placement, sampling
from tests.conftest import blobs, frame


@pytest.fixture(scope="module")
def keyed(spark):
    """Key 0 has two thirds of the rows."""
    X, y = blobs(900)
    key = F.when(F.col("id") % 3 < 2, 0).otherwise((F.col("id") % 5).cast("int"))
    return frame(spark, X, y).withColumn("cid", key).repartition(7).cache()


@pytest.mark.parametrize("limit", [0, 10_000])
def test_local_index(spark, ws, keyed, limit):
    got = placement.local_index(keyed, "cid", workspace=ws, max_window_rows=limit).toPandas()
    for _, g in got.groupby("cid"):
        assert g.sort_values("id")["slot"].tolist() == list(range(len(g)))


def test_global_index(spark, ws, keyed):
    got = placement.global_index(keyed.where("id % 2 = 1"), workspace=ws).toPandas()
    assert got.sort_values("id")["idx"].tolist() == list(range(450))


@pytest.mark.parametrize("limit", [0, 10_000])
@pytest.mark.parametrize("rotate", [False, True])
def test_deal_gives_every_part_its_share(spark, ws, keyed, limit, rotate):
    dealt = placement.stratified_deal(keyed, "cid", 8, rotate, ws, limit).toPandas()
    assert sorted(dealt["id"]) == list(range(900))
    counts = dealt.groupby(["cid", "part"]).size().unstack(fill_value=0)
    assert (counts.max(axis=1) - counts.min(axis=1) <= 1).all()


def test_merge_modes(spark, keyed):
    rows = keyed.withColumns({"slot": F.col("id").cast("int"), "part": F.lit(9)})
    assert placement.merge_deal(rows, 4).where("part <> id % 4").count() == 0
    assert placement.merge_deal(rows, 4, "pairwise").where("part <> 1").count() == 0
    with pytest.raises(ValueError):
        placement.merge_deal(rows, 4, "other")


def test_samples_depend_on_ids_only(spark, keyed):
    a = sampling.bernoulli(keyed, 0.4, 3).select("id").toPandas()["id"]
    b = sampling.bernoulli(keyed.repartition(3), 0.4, 3).select("id").toPandas()["id"]
    assert set(a) == set(b) and 250 < len(a) < 470
    assert set(a) != set(sampling.bernoulli(keyed, 0.4, 4).toPandas()["id"])


def test_draw_with_replacement(spark, ws, keyed):
    draws = sampling.draw_with_replacement(keyed, 5000, 1, workspace=ws).toPandas()
    assert sorted(draws["step"]) == list(range(5000))
    hits = np.bincount(draws["id"], minlength=900)
    assert hits.max() > 1 and abs(hits.std() ** 2 / hits.mean() - 1) < 0.3
    again = sampling.draw_with_replacement(keyed.repartition(2), 5000, 1, workspace=ws)
    again = again.toPandas().sort_values("step")["id"].tolist()
    assert draws.sort_values("step")["id"].tolist() == again


def test_stratified_draws_keep_the_shares(spark, ws, keyed):
    draws = sampling.draw_with_replacement(keyed, 100, 1, "cid", ws).toPandas()
    sizes = keyed.groupBy("cid").count().toPandas().set_index("cid")["count"]
    want = np.ceil(sizes * 100 / 900).astype(int)
    assert draws.groupby("cid").size().to_dict() == want.to_dict()
    assert sorted(draws["step"]) == list(range(int(want.sum())))


@pytest.mark.parametrize("limit", [0, 1000])
def test_null_keys_are_numbered_too(spark, ws, limit):
    rows = [(i, None if i % 3 else i % 2) for i in range(40)]
    keyed = spark.createDataFrame(rows, "id bigint, key int").repartition(4)
    got = placement.local_index(keyed, "key", workspace=ws, max_window_rows=limit).toPandas()
    assert len(got) == 40
    for _, own in got.groupby("key", dropna=False):
        assert own.sort_values("id")["slot"].tolist() == list(range(len(own)))


def test_draws_follow_their_counters(spark, ws):
    """Ids and steps by the rule in plain Python, for two strata of unlike size."""
    import hashlib

    def number(text, digits=13):
        return int(hashlib.md5(text.encode()).hexdigest()[:digits], 16)

    rows = [(i, 0 if i % 7 else 1) for i in range(900)]
    frame = spark.createDataFrame(rows, "id bigint, cid int").repartition(5)
    for stratum, total in (("cid", 40), (None, 25)):
        groups = {}
        for i, c in rows:
            groups.setdefault(c if stratum else 0, []).append(i)
        buckets = sampling.bucket_count(len(rows), len(groups))
        tickets = []
        for c, ids in groups.items():
            ids.sort(key=lambda i: (number(f"9:{i}", 8) % buckets, i))
            quota = -(-len(ids) * total // len(rows)) if stratum else total
            for d in range(quota):
                at = number(f"9:draw:{c}:{d}") % len(ids)
                tickets.append((number(f"9:step:{c}:{d}"), c, d, ids[at]))
        want = [(step, t[3]) for step, t in enumerate(sorted(tickets))]
        got = sampling.draw_with_replacement(frame, total, 9, stratum, ws).collect()
        assert sorted((r.step, r.id) for r in got) == want


@pytest.mark.parametrize("total, rows", [(0, 5), (3, 0)])
def test_nothing_to_draw_is_told(spark, ws, total, rows):
    frame = spark.range(rows).select("id")
    with pytest.raises(ValueError):
        sampling.draw_with_replacement(frame, total, 1, None, ws)
