from pyspark.sql import functions as F

from tideline.llm.sharding import MapStore, SlotMap, even_map, rebalance, shard
from tideline.session import shared_folder


def test_rebalance_is_even_and_moves_little():
    sizes = {s: (s * 7919) % 1000 + (30_000 if s == 3 else 1) for s in range(512)}
    first = even_map(512, 8)
    second = rebalance(first, sizes, 8)
    load = [sum(sizes[s] for s in range(512) if second.shards[s] == k) for k in range(8)]
    assert second.version == 1 and max(load) <= 1.01 * sum(load) / 8
    assert sum(a != b for a, b in zip(first.shards, second.shards, strict=True)) < 256
    assert rebalance(second, sizes, 8, 0.02).shards == second.shards


def test_a_hot_slot_leaves_the_others_even():
    sizes = {s: 1_000_000 if s == 3 else 1 + s % 100 for s in range(512)}
    final = rebalance(even_map(512, 8), sizes, 8)
    load = sorted(sum(sizes[s] for s in range(512) if final.shards[s] == k) for k in range(8))
    assert load[-1] >= 1_000_000 and load[-2] <= 1.05 * load[0]


def test_rebalance_empties_lost_shards_and_fills_new_ones():
    sizes = dict.fromkeys(range(64), 10)
    fewer = rebalance(even_map(64, 4), sizes, 3)
    assert set(fewer.shards) == {0, 1, 2}
    more = rebalance(SlotMap(0, (0,) * 64), sizes, 4)
    assert sorted(more.shards.count(k) for k in range(4)) == [16] * 4


def _run(spark, rows, n=4):
    df = spark.createDataFrame(rows, "doc_id long, size long, shard string, _before string")
    store = MapStore(spark, shared_folder(spark, "map"))
    return store, shard(df, ["doc_id"], F.col("size"), n, store, order=["doc_id", "size"], n_slots=64)


def test_positions_are_gapless_and_rows_whole(spark):
    rows = [(i % 400 if i % 50 else None, 1 + i % 17, "old", "x") for i in range(1000)]
    store, out = _run(spark, rows)
    got = out.toPandas()
    assert sorted(got["size"]) == sorted(r[1] for r in rows) and got["doc_id"].isna().sum() == 20
    for _, part in got.groupby("shard"):
        assert sorted(part["slot"]) == list(range(len(part)))
    assert (got.groupby("virtual_slot")["shard"].nunique() == 1).all()
    saved = store.load(1)
    assert all(saved.shards[v] == s for v, s in zip(got["virtual_slot"], got["shard"], strict=True))
    assert store.load(0) == even_map(64, 4)


def test_empty_table(spark):
    store, out = _run(spark, [])
    assert out.count() == 0 and store.load(1).n_slots == 64
