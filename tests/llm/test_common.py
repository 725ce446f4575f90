"""Shared helpers: joins of hot groups, bit maps, shards, merges of pairs, and the descent."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerline.llm.common import discard, gather, in_map, join_groups, key_map, materialize, range_shards, scatter, small_side, text_groups, with_shard, without_rows
from ledgerline.llm.ordinal_quality import minimize
from ledgerline.llm.pair_merge import PairMerger


def test_join_of_hot_groups_is_a_left_join(spark):
    """A third of the rows in one group, nulls and keys without a group among the rest."""
    rows = [(i, "hot" if i % 3 == 0 else None if i % 11 == 0 else f"k{i % 700}") for i in range(6000)]
    groups = [("hot", 1, 2000), *((f"k{i}", i, 6) for i in range(0, 700, 2))]
    df, g = spark.createDataFrame(rows, "i long, k string"), spark.createDataFrame(groups, "k string, v long, c long")
    want = {k: (v, c) for k, v, c in groups}
    got = {r["i"]: (r["v"], r["c"]) for r in join_groups(df, g, "k", "c", 6000).collect()}
    assert got == {i: want.get(k, (None, None)) for i, k in rows}
    assert join_groups(df.limit(0), g, "k", "c", 0).count() == 0 and join_groups(df, g.limit(0), "k", "c", 6000).count() == 6000


@pytest.mark.parametrize("bits", [6, 12, 25])
def test_maps_miss_no_key(spark, bits):
    keys = spark.range(0, 300, 3).select(F.xxhash64("id").alias("hash"))
    rows = in_map(spark.range(300), key_map(keys, bits), F.xxhash64("id"), "hit", bits).collect()
    assert len(rows) == 300 and all(r["hit"] for r in rows if r["id"] % 3 == 0)
    if bits == 25:
        assert not any(r["hit"] for r in rows if r["id"] % 3)


@pytest.mark.parametrize("bits", [6, 25])
def test_rows_go_by_key(spark, bits):
    docs = spark.createDataFrame([(i % 40, f"t{i % 40}", "x") for i in range(80)], "key int, row string, maybe string")
    gone = spark.createDataFrame([(b"%d" % i,) for i in range(10)], "key binary")
    twins = spark.createDataFrame([(b"%d" % i,) for i in range(10, 20)], "key binary")
    out = without_rows(docs, F.col("key").cast("string").cast("binary"), gone, twins, bits)
    assert out.columns == docs.columns
    got = sorted(r["key"] for r in out.collect())
    assert [k for k in got if k < 20] == list(range(10, 20)) and set(got) == set(range(10, 40))
    if bits == 25:
        assert got == sorted([*range(10, 20), *range(20, 40), *range(20, 40)])


def test_shards_are_even_and_in_order(spark):
    rng = random.Random(2)
    ids = [rng.choice([rng.randrange(1000), rng.randrange(-(1 << 62), 1 << 62), 5]) for _ in range(3000)] + [None] * 500
    df = spark.createDataFrame([(d, i % 7 + 1) for i, d in enumerate(ids)], "id long, w long").withColumn("h", F.xxhash64("id", "w", F.monotonically_increasing_id()))
    df = materialize(df, "test-shards")
    shards = range_shards(df, "id", "h", F.col("w"), 8)
    rows = with_shard(df, "id", "h", shards, "s").collect()
    load = {}
    for r in rows:
        load[r["s"]] = load.get(r["s"], 0) + r["w"]
    total = sum(load.values())
    assert set(load) <= set(range(shards.count)) and shards.count <= 24 and max(load.values()) <= 2.5 * total / 8
    order = sorted(rows, key=lambda r: (r["s"], r["id"] is not None, r["id"] or 0))
    assert [r["id"] for r in order] == sorted((r["id"] for r in rows), key=lambda x: (x is not None, x or 0))
    assert range_shards(df.limit(0), "id", "h", F.col("w"), 8).count == 1
    assert small_side(df, 3500) and not small_side(df, 3499)
    assert not small_side(materialize(spark.createDataFrame([("x" * 1000,)], "t string"), "test-wide"), 10, 999)
    discard(df)
    with pytest.raises(Exception):
        df.count()


def test_runs_gather_and_scatter():
    values, counts = gather(np.array([1, 2, 3, 4, 5, 6]), np.array([2, 0, 3, 1]), np.array([3, 0, 0, 1, 2]))
    assert values.tolist() == [6, 1, 2, 1, 2, 3, 4, 5] and counts.tolist() == [1, 2, 2, 0, 3]
    values, counts = scatter(3, [(np.array([2]), np.array([7, 8]), np.array([2])), (np.array([0, 1]), np.array([5]), np.array([0, 1]))])
    assert values.tolist() == [5, 7, 8] and counts.tolist() == [0, 1, 2]


def test_groups_of_texts_keep_their_rows():
    texts = [None, "", "a", "b" * 5_000_000, "c", "d" * 3_000_000, "e" * 3_000_000, "f"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(8)), pa.array([None if t is None else t.encode() for t in texts], pa.binary())], names=["i", "t"])
    parts = list(text_groups([batch, batch.slice(0, 0)]))
    assert [i for p, _ in parts for i in p.column(0).to_pylist()] == list(range(8)) and [t for _, s in parts for t in s.to_pylist()] == texts and len(parts) > 2


def test_pairs_merge_as_one_by_one():
    rng = random.Random(4)
    for shared in (False, True):
        left, right, rank, made, symbol = [], [], [], [], 6
        for r in range(60):
            a, b = rng.randrange(symbol), rng.randrange(symbol)
            if (a, b) in zip(left, right):
                continue
            left.append(a)
            right.append(b)
            rank.append(r // 3 if shared else r)
            made.append(symbol)
            symbol += 1
        table = {(a, b): (k, m) for a, b, k, m in zip(left, right, rank, made)}
        merge = PairMerger(left, right, rank, made)
        words = [[rng.randrange(6) for _ in range(rng.randrange(1, 30))] for _ in range(400)]

        def plain(w):
            w = list(w)
            while True:
                found = [(table[p][0], i) for i, p in enumerate(zip(w, w[1:])) if p in table]
                if not found:
                    return w
                i = min(found)[1]
                w[i : i + 2] = [table[w[i], w[i + 1]][1]]

        out, counts = merge(np.array([x for w in words for x in w]), np.array([len(w) for w in words]))
        ends = np.cumsum(counts)
        assert [out[e - c : e].tolist() for e, c in zip(ends, counts)] == [plain(w) for w in words]


def test_descent_finds_the_least_of_a_bowl():
    scale = np.array([1.0, 10.0, 100.0, 0.1])
    best = minimize(lambda x: (float(scale @ (x - 3) ** 2), 2 * scale * (x - 3)), np.zeros(4), 60)
    assert np.abs(best - 3).max() < 1e-4
