"""Packing keeps near copies apart and spreads repeated rows over the shards."""

from collections import Counter

from docloom.llm import packing, queries
from pyspark.sql import functions as F


def test_near_copies_do_not_share_a_bin(spark):
    base = [f"w{k}" for k in range(60)]
    texts = [" ".join(base), "  ".join(base), " ".join([*base[:-1], "other"]), " ".join([*base, "more"])]
    other = [" ".join(f"v{k}-{n}" for n in range(60)) for k in range(4)]
    rows = [*enumerate([*texts, *other]), (None, texts[0])]
    docs = spark.createDataFrame([(i, t, f"s{k}") for k, (i, t) in enumerate(rows)], "doc_id long, text string, source string")
    got = queries.packed(docs).collect()
    assert len(got) == 9
    bins = {}
    for r in got:
        bins.setdefault((r["shard"], r["bin"]), []).append(r["doc_id"])
    assert all(sum(i is None or i < 4 for i in ids) <= 1 for ids in bins.values())
    assert max(map(len, bins.values())) > 1  # texts that are not near copies still share bins


def test_repeated_rows_are_spread(spark):
    docs = spark.createDataFrame([(1, 10)] * 400 + [(k, 10) for k in range(2, 402)], "doc_id long, n int")
    got = packing.pack(docs, F.col("n"), F.lit(None), F.lit(None).cast("string"), capacity=100, shard_rows=100).collect()
    assert len(got) == 800
    assert max(Counter(r["shard"] for r in got if r["doc_id"] == 1).values()) < 120
