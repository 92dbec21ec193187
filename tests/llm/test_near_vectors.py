"""Linking vectors whose blocks are many: exact, and no vector is copied for the blocks that it meets."""

import numpy as np

from docloom.llm import covertree


def shuffled(spark) -> int:
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
    return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))


def test_vectors_travel_once_however_many_blocks(spark):
    r = np.random.default_rng(5)
    x = r.normal(size=(1500, 32))
    x = np.r_[x, x[:200] + 0.2 * r.normal(size=(200, 32)), x[:30], np.tile(x[7], (40, 1)), x[40] + 0.02 * r.normal(size=(60, 32))].astype(np.float32)
    df = spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<float>").repartition(6)
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    i, j = np.nonzero(u @ u.T >= 0.9)
    broadcast, before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold"), shuffled(spark)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with blocks too large for it
    try:
        got = covertree.near_duplicates(df, block_rows=16).orderBy("vec_id").collect()  # over 100 blocks
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    sent = shuffled(spark) - before
    assert [g["n_links"] for g in got] == (np.bincount(i) - 1).tolist() and max(np.bincount(i)) > 60
    assert [g["component_id"] for g in got] == covertree.least_labels(len(x), i, j).tolist()
    assert sent < 8 * x.nbytes


def test_near_loses_no_pair_to_rounding():
    r = np.random.default_rng(6)
    u = covertree.unit(r.normal(size=(300, 700)) + 1)
    f, least = u.astype(np.float32), float(np.median(u @ u.T))
    found = {(a, b) for i, j, _ in covertree.near(f, f, least) for a, b in zip(i.tolist(), j.tolist())}
    assert found >= {*zip(*(k.tolist() for k in np.nonzero(u @ u.T >= least)))} and len(found) < 0.6 * 300**2
