"""Sharding by fixed virtual slots.

Records hash into thousands of slots that never change. Bytes and rows are summed per slot; a small map, of one row per
slot, says which shard a slot belongs to. Rebalancing edits the map: slots move from the fullest to the emptiest shard
until sizes are near equal, and every edited map is stored as a new version beside the old ones. Only the map (at most
``n_slots`` rows) reaches the driver.

Edge cases: a null or empty text counts no bytes (its record still counts one, so that empty records spread too); null
keys hash like a value of their own; repeated rows share a slot; an empty table gives an empty result and an even map;
other columns are passed through whatever their names, but for ``virtual_slot``, ``shard`` and ``slot``, which are replaced.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tideline.llm.rows import packed, unpacked


@dataclass(frozen=True)
class SlotMap:
    version: int
    shards: tuple[int, ...]  # by slot

    @property
    def n_slots(self) -> int:
        return len(self.shards)


def even_map(n_slots: int, n_shards: int) -> SlotMap:
    return SlotMap(0, tuple(s % n_shards for s in range(n_slots)))


def slot_of(keys: list[str], n_slots: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(n_slots)).cast("int")


def slot_table(df: DataFrame, size: Column) -> DataFrame:
    """Bytes and rows per virtual slot."""
    return df.groupBy("virtual_slot").agg(F.sum(size).alias("bytes"), F.count("*").alias("rows"))


def rebalance(current: SlotMap, sizes: dict[int, int], n_shards: int, tolerance: float = 0.001) -> SlotMap:
    """The next version of the map: few slots moved, until no shard is over the mean by more than ``tolerance`` or no
    single move helps. Slots of shards that are gone move first; shards that are new fill up."""
    held: dict[int, list[int]] = {s: [] for s in range(n_shards)}
    load = dict.fromkeys(held, 0)
    homeless = []
    for slot, shard in enumerate(current.shards):
        if shard in held:
            held[shard].append(slot)
            load[shard] += sizes.get(slot, 0)
        else:
            homeless.append(slot)
    lightest = [(load[s], s) for s in held]
    heapq.heapify(lightest)
    for slot in sorted(homeless, key=lambda x: (-sizes.get(x, 0), x)):
        _, shard = heapq.heappop(lightest)
        held[shard].append(slot)
        load[shard] += sizes.get(slot, 0)
        heapq.heappush(lightest, (load[shard], shard))
    mean = sum(load.values()) / n_shards
    for _ in range(4 * current.n_slots):
        high, low = max(load, key=lambda s: (load[s], -s)), min(load, key=lambda s: (load[s], s))
        gap = load[high] - load[low]
        if load[high] <= mean * (1 + tolerance) and load[low] >= mean * (1 - tolerance):
            break
        movable = [x for x in held[high] if 0 < sizes.get(x, 0) < gap]
        if not movable:  # a shard of one hot slot; the others go on without it
            del load[high]
            if len(load) < 2:
                break
            mean = sum(load.values()) / len(load)
            continue
        slot = min(movable, key=lambda x: (abs(2 * sizes[x] - gap), x))
        held[high].remove(slot)
        held[low].append(slot)
        load[high] -= sizes[slot]
        load[low] += sizes[slot]
    shards = [0] * current.n_slots
    for shard, slots in held.items():
        for slot in slots:
            shards[slot] = shard
    return SlotMap(current.version + 1, tuple(shards))


class MapStore:
    """Versions of a slot map as Parquet folders; a version is never rewritten."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def save(self, slot_map: SlotMap) -> None:
        rows = [(slot_map.version, slot, shard) for slot, shard in enumerate(slot_map.shards)]
        frame = self.spark.createDataFrame(rows, "version int, virtual_slot int, shard int")
        frame.coalesce(1).write.parquet(f"{self.path}/version={slot_map.version}")

    def table(self, version: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/version={version}").select("virtual_slot", "shard")

    def load(self, version: int) -> SlotMap:
        rows = sorted(tuple(r) for r in self.table(version).collect())
        return SlotMap(version, tuple(shard for _, shard in rows))


RESULT = ("virtual_slot", "shard", "slot")


def _assign(frame: DataFrame, shards: DataFrame, rows_per_slot: DataFrame, order: list[str]) -> DataFrame:
    """A packed frame with ``virtual_slot`` plus ``shard`` and ``slot``, a gapless position in the shard.

    Positions are numbered within a virtual slot and shifted by the rows of the shard's slots before it, so no task
    holds a shard.
    """
    placed = rows_per_slot.select("virtual_slot", "rows").join(shards, "virtual_slot")
    before = W.partitionBy("shard").orderBy("virtual_slot").rowsBetween(W.unboundedPreceding, -1)
    placed = placed.select("virtual_slot", "shard", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("_before"))
    within = W.partitionBy("virtual_slot").orderBy(*[F.col("whole")[c] for c in order])
    numbered = frame.withColumn("_row", F.row_number().over(within))
    # At most n_slots rows are broadcast.
    return numbered.join(F.broadcast(placed), "virtual_slot").withColumn("slot", F.col("_before") + F.col("_row") - 1)


def shard(df: DataFrame, keys: list[str], size: Column, n_shards: int, store: MapStore, order: list[str], n_slots: int = 4096) -> DataFrame:
    """Hash, sum, rebalance and place: ``df`` with ``virtual_slot``, ``shard`` and ``slot``, a gapless position in the
    shard by virtual slot and ``order``. Versions 0 (even) and 1 (by bytes) of the map are in ``store``."""
    frame = packed(df, {"virtual_slot": slot_of(keys, n_slots), "_size": size}, RESULT)
    counts = slot_table(frame, F.col("_size")).collect()  # at most n_slots rows
    first = even_map(n_slots, n_shards)
    final = rebalance(first, {r["virtual_slot"]: r["bytes"] for r in counts}, n_shards)
    store.save(first)
    store.save(final)
    rows = df.sparkSession.createDataFrame([(r["virtual_slot"], r["rows"]) for r in counts], "virtual_slot int, rows long")
    placed = _assign(frame.drop("_size"), store.table(final.version), rows, order)
    return unpacked(placed, df, RESULT, **{c: c for c in RESULT})
