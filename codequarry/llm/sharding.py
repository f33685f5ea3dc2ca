"""Sharding by fixed virtual slots and a versioned slot-to-shard map.

A record's virtual slot is a hash of its key alone. A map, one row a slot, says
which shard holds each slot; growing or rebalancing writes an edited map as the
next version and moves only the slots that the edit names.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codequarry.llm.common import cut, read, shared_dir

SLOTS = 4096
SHARDS = 24
MAP_SCHEMA = "version int, shards int, slot int, shard int, rows long, bytes long"


@dataclass(frozen=True)
class SlotMap:
    """Which shard each virtual slot lies in; bounded by the number of slots."""

    version: int
    shards: int
    owner: tuple[int, ...]

    @classmethod
    def first(cls, shards: int, slots: int = SLOTS) -> SlotMap:
        """Version 1: runs of slots of equal length, by the two numbers alone."""
        if not 0 < shards <= slots:
            raise ValueError("there must be at least one slot a shard")
        return cls(1, shards, tuple(s * shards // slots for s in range(slots)))

    def grown(self) -> SlotMap:
        """The next version with one more shard, which takes slots from the fullest shards; none moves between old ones."""
        owner, new = list(self.owner), self.shards
        mine: dict[int, list[int]] = {k: [] for k in range(new)}
        for s, k in enumerate(owner):
            mine[k].append(s)
        for _ in range(len(owner) // (new + 1)):
            fullest = max(mine, key=lambda k: (len(mine[k]), -k))
            owner[mine[fullest].pop()] = new
        return replace(self, version=self.version + 1, shards=new + 1, owner=tuple(owner))

    def rebalanced(self, loads: dict[int, int], tolerance: float = 0.02) -> SlotMap:
        """The next version, with slots moved from the heaviest to the lightest shard while that narrows the gap.

        loads: bytes of each slot, absent ones 0. It ends at a spread of tolerance times the
        mean, or where no single slot of the heaviest shard improves matters.
        """
        owner, total = list(self.owner), [0] * self.shards
        for s, k in enumerate(owner):
            total[k] += loads.get(s, 0)
        mean = sum(total) / self.shards
        for _ in range(4 * len(owner)):
            heavy, light = max(range(self.shards), key=lambda k: (total[k], -k)), min(range(self.shards), key=lambda k: (total[k], k))
            gap = total[heavy] - total[light]
            fits = [s for s, k in enumerate(owner) if k == heavy and 0 < loads.get(s, 0) < gap]
            if gap <= tolerance * mean or not fits:
                break
            s = min(fits, key=lambda s: (abs(loads[s] - gap / 2), s))
            owner[s] = light
            total[heavy] -= loads[s]
            total[light] += loads[s]
        return replace(self, version=self.version + 1, owner=tuple(owner))

    def shard_of(self, slot: Column) -> Column:
        """The shard of a column of slots: one literal that folds into an array."""
        return F.get(F.split(F.lit(",".join(map(str, self.owner))), ",").cast("array<int>"), slot)

    def moved(self, later: SlotMap) -> dict[int, tuple[int, int]]:
        return {s: (a, b) for s, (a, b) in enumerate(zip(self.owner, later.owner, strict=True)) if a != b}


class SlotMapStore:
    """Versions of a map as one Parquet table; a version once written never changes."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def save(self, m: SlotMap, loads: dict[int, tuple[int, int]] | None = None) -> None:
        """loads: rows and bytes of each slot as the version was made; absent ones have none."""
        rows = [(m.version, m.shards, s, k, *((loads or {}).get(s, (0, 0)))) for s, k in enumerate(m.owner)]
        self.spark.createDataFrame(rows, MAP_SCHEMA).coalesce(1).write.mode("errorifexists").parquet(f"{self.path}/v{m.version:06d}")

    def load(self, version: int) -> SlotMap:
        rows = sorted(self.spark.read.schema(MAP_SCHEMA).parquet(f"{self.path}/v{version:06d}").collect(), key=lambda r: r["slot"])
        return SlotMap(version, rows[0]["shards"], tuple(r["shard"] for r in rows))

    def loads(self, version: int) -> DataFrame:
        """shard, slots, rows and bytes of a version: what a decision to rebalance goes by."""
        rows = self.spark.read.schema(MAP_SCHEMA).parquet(f"{self.path}/v{version:06d}")
        return rows.groupBy("shard").agg(F.count("*").alias("slots"), F.sum("rows").alias("rows"), F.sum("bytes").alias("bytes"))


def virtual_slot(key: Column, slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(slots)).cast("int")


def placed(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32 and virtual_slot of each row."""
    text = F.col(f"`{text_col}`")
    return docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 8).alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
    ).withColumn("virtual_slot", virtual_slot(F.col("doc_id"), slots))


def loads_of(rows: DataFrame) -> dict[int, tuple[int, int]]:
    """Rows and bytes of each virtual slot that has rows; at most one entry a slot."""
    sums = rows.groupBy("virtual_slot").agg(F.count("*").alias("n"), F.sum("size").alias("b"))
    return {r["virtual_slot"]: (r["n"], r["b"]) for r in sums.collect()}


def assign(docs: DataFrame, now: SlotMap, later: SlotMap, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Where each row lies now and after the edit, and its position in its shard.

    Columns: doc_id, size, text_crc32, law, shard, slot (from 0, without gaps, by
    virtual slot and then id), grown_shard, virtual_slot. The texts are read once and never
    moved: only these narrow rows are shuffled. A slot with over four times the mean number
    of rows, as when one id repeats, is numbered in as many parts as needed.

    A null id is a key like any other. A null text has size 8 and checksum 0. Repeated
    rows each have a position. An empty table gives none.
    """
    return numbered(cut(placed(docs, id_col=id_col, text_col=text_col, slots=len(now.owner))), now, later)


def numbered(rows: DataFrame, now: SlotMap, later: SlotMap) -> DataFrame:
    """assign() of rows of placed(), which must be cut."""
    slots = len(now.owner)
    loads = rows.groupBy("virtual_slot").agg(F.count("*").alias("n"))  # at most one row a slot
    mean = F.greatest(F.sum("n").over(Window.partitionBy()) / slots, F.lit(64.0))
    parts = loads.select("virtual_slot", F.when(F.col("n") > 4 * mean, F.ceil(F.col("n") / mean)).otherwise(1).cast("int").alias("parts"))
    dealt = rows.join(F.broadcast(parts), "virtual_slot").withColumn("part", F.pmod(F.monotonically_increasing_id(), F.col("parts")).cast("int"))
    dealt = cut(dealt.drop("parts"))
    counts = dealt.groupBy("virtual_slot", "part").agg(F.count("*").alias("n")).withColumn("shard", now.shard_of(F.col("virtual_slot")))
    before = Window.partitionBy("shard").orderBy("virtual_slot", "part").rowsBetween(Window.unboundedPreceding, -1)
    # at most 2 * slots rows: a part has at least a mean's worth
    starts = counts.select("virtual_slot", "part", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    place = Window.partitionBy("virtual_slot", "part").orderBy(F.col("doc_id").asc_nulls_last(), "text_crc32", "size")
    return dealt.join(F.broadcast(starts), ["virtual_slot", "part"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
        (F.col("start") + F.row_number().over(place) - 1).alias("slot"),
        later.shard_of(F.col("virtual_slot")).alias("grown_shard"), "virtual_slot",
    )


def query(spark, sf_dir: str) -> DataFrame:
    rows = cut(placed(read(spark, sf_dir, "documents")))
    loads = loads_of(rows)
    store = SlotMapStore(spark, f"{shared_dir(spark)}/slot-map-{uuid.uuid4().hex}")
    first = SlotMap.first(SHARDS)
    store.save(first, loads)
    store.save(first.grown(), loads)
    return numbered(rows, store.load(1), store.load(2))
