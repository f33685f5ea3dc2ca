"""Several indexes as one, by a manifest of who owns which package version.

A manifest is one small JSON file: {"version": 1, "shards": [{"id", "root", "prefix", "packages": [[ecosystem, name,
version], ...]}]}. Tables are unions, so order and limits hold over all shards. A question about
one package or version is asked of the shards that own it, and of none if nobody does.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codequarry.index import Index, shard_of, sharded
from codequarry.operators.store import Store


def write_manifest(spark: SparkSession, path: str, stores: Sequence[Store]) -> None:
    """The manifest of stores, staged and then renamed: readers see the old or the new one."""
    shards = []
    for i, s in enumerate(stores):
        p = s.table("packages").select(F.col("id").alias("package_id"), "ecosystem", "name")
        owned = s.table("package_versions").where("index_state = 'complete'").join(p, "package_id").select("ecosystem", "name", "version").orderBy("ecosystem", "name", "version")
        shards.append({"id": i, "root": s.root, "prefix": s.prefix.rstrip("_"), "packages": [list(r) for r in owned.collect()]})
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    final, staged = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.staged")
    fs = final.getFileSystem(conf)
    out = fs.create(staged, True)
    out.write(bytearray(json.dumps({"version": 1, "shards": shards}).encode()))
    out.close()
    fs.delete(final, False)
    if not fs.rename(staged, final):
        raise RuntimeError(f"can't put {path} in place")


def read_manifest(spark: SparkSession, path: str) -> list[dict]:
    (row,) = spark.read.option("wholetext", True).text(path).collect()
    found = json.loads(row[0])
    if found.get("version") != 1:
        raise ValueError(f"manifest of version {found.get('version')!r}")
    return found["shards"]


class ShardedIndex(Index):
    """An Index over the shards of a manifest."""

    def __init__(self, spark: SparkSession, manifest: list[dict]):
        self.manifest = manifest
        self.parts = {m["id"]: Index.open(spark, m["root"], prefix=m["prefix"]) for m in manifest}
        if not self.parts:
            raise ValueError("a manifest names one shard at least")
        super().__init__(next(iter(self.parts.values())).store)
        self.table = sharded([*self.parts.values()]).table

    @property
    def shard_count(self) -> int:
        return len(self.parts)

    def owners(self, ecosystem: str, name: str, version: str | None = None) -> list[int]:
        return [m["id"] for m in self.manifest if any(p[:2] == [ecosystem, name] and version in (None, p[2]) for p in m["packages"])]

    def of(self, ecosystem: str, name: str, version: str | None = None) -> Index:
        """The owning shards alone; a package that no shard owns has no rows."""
        ids = self.owners(ecosystem, name, version)
        if ids:
            return sharded([self.parts[i] for i in ids])
        empty = Index(self.store)
        empty.table = lambda t: self.store.table(t).limit(0)
        return empty

    def package_counts(self) -> DataFrame:
        """Packages of one ecosystem and name count together, under the smallest id."""
        return super().package_counts().groupBy("ecosystem", "name").agg(F.min("id").alias("id"), F.sum("n").alias("n")).select("id", "ecosystem", "name", "n").orderBy(F.desc("n"), "name", "ecosystem")


def open_sharded(spark: SparkSession, path: str) -> ShardedIndex:
    return ShardedIndex(spark, read_manifest(spark, path))


def build(spark: SparkSession, sources: DataFrame, root: str, shards: int, **options) -> ShardedIndex:
    """Sources dealt out by their version's hash, an index a shard, and the manifest last."""
    key = shard_of(F.xxhash64("ecosystem", "name", "version"), shards)
    stores = []
    for i in range(shards):
        store = Store(spark, f"{root}/shard-{i:04d}")
        store.index(sources.where(key == i), **options)
        stores.append(store)
    write_manifest(spark, f"{root}/manifest.json", stores)
    return open_sharded(spark, f"{root}/manifest.json")
