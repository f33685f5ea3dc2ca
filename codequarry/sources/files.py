"""Where sources come from: paths, rows, registries, entry lists and tarballs."""

from __future__ import annotations

import io
import tarfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codequarry.functions.text import version_key
from codequarry.ship import map_pandas

SOURCE_SCHEMA = "path string, source string, ecosystem string, name string, version string, source_ref string, ordinal long"
MOST_BYTES = 5_000_000


def source_filter(path: Column, content: Column) -> Column:
    """.ex and .exs files, no resource forks, valid UTF-8, at most 5 MB."""
    base = F.element_at(F.split(path, "/"), -1)
    return (path.endswith(".ex") | path.endswith(".exs")) & ~base.startswith("._") & (F.length(content) <= MOST_BYTES) & F.is_valid_utf8(content.cast("string"))


def from_rows(spark: SparkSession, rows, *, ecosystem: str = "local", name: str = "local", version: str = "0.0.0") -> DataFrame:
    """Rows of (path, source) or (path, source, {ecosystem, name, version, source_ref})."""
    made = []
    for i, (path, source, *more) in enumerate(rows):
        o = more[0] if more else {}
        made.append((path, source, o.get("ecosystem", ecosystem), o.get("name", name), o.get("version", version), o.get("source_ref"), i))
    return spark.createDataFrame(made, SOURCE_SCHEMA)


def from_paths(spark: SparkSession, paths: str | list[str], *, ecosystem: str = "local", name: str = "local", version: str = "0.0.0", relative_to: str | None = None) -> DataFrame:
    """Files below directories, or matching globs, read by Spark itself."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("ignoreMissingFiles", True).load(paths)
    path = F.regexp_replace("path", "^[a-z]+:/*(?=/)", "")
    if relative_to:
        path = F.when(path.startswith(relative_to.rstrip("/") + "/"), F.substring(path, len(relative_to.rstrip("/")) + 2, 100_000)).otherwise(path)
    kept = files.where(source_filter(F.col("path"), F.col("content")))
    return kept.select(
        path.alias("path"), F.col("content").cast("string").alias("source"), F.lit(ecosystem).alias("ecosystem"), F.lit(name).alias("name"),
        F.lit(version).alias("version"), F.lit(None).cast("string").alias("source_ref"), F.xxhash64(path).alias("ordinal"),
    )


def latest(packages: DataFrame) -> DataFrame:
    """name and its latest version. packages: name, versions array<string>."""
    every = all_versions(packages)
    return every.groupBy("name").agg(F.max_by("version", version_key(F.col("version"))).alias("version"))


def all_versions(packages: DataFrame) -> DataFrame:
    return packages.select("name", F.explode("versions").alias("version"))


def top(packages: DataFrame, limit: int = 300) -> DataFrame:
    """The packages most often downloaded. packages: name, downloads, and more."""
    return packages.orderBy(F.desc_nulls_last("downloads"), "name").limit(limit)


def entries(spark: SparkSession, path: str, report: bool = False) -> DataFrame:
    """name and version of an NDJSON list, or of the failures in a JSON report."""
    if report:
        rows = spark.read.schema("failures array<struct<name: string, version: string>>").option("multiLine", True).json(path)
        return rows.select(F.explode("failures").alias("f")).select("f.name", "f.version")
    return spark.read.schema("name string, version string").json(path).where("name IS NOT NULL")


def round_robin(entries_: DataFrame, mirrors: list[str]) -> DataFrame:
    """Each entry with the mirrors in the order to try them, beginning at a hash of the entry."""
    n = len(mirrors)
    first = F.pmod(F.xxhash64("name", "version"), F.lit(n)).cast("int")
    ring = F.array(*[F.lit(m) for m in mirrors + mirrors])
    return entries_.withColumn("mirrors", F.slice(ring, first + 1, n))


def from_tarballs(spark: SparkSession, path: str, *, ecosystem: str = "hex") -> DataFrame:
    """Sources within name-version.tar files; a package's inner contents.tar.gz is opened too. Unsafe paths raise."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.tar*").option("recursiveFileLookup", True).load(path)
    stem = F.regexp_extract("path", r"([^/]+?)(?:\.tar(?:\.gz)?|\.tgz)$", 1)
    rows = files.select(F.regexp_extract(stem, r"^(.*?)-\d", 1).alias("name"), F.regexp_extract(stem, r"-(\d.*)$", 1).alias("version"), "content", F.col("path").alias("ref"))

    def members(content: bytes):
        with tarfile.open(fileobj=io.BytesIO(content)) as tar:
            for m in tar:
                if not m.isfile():
                    continue
                if m.name.startswith("/") or ".." in m.name.split("/"):
                    raise ValueError(f"unsafe path in a tarball: {m.name}")
                data = tar.extractfile(m).read()
                if m.name == "contents.tar.gz":
                    yield from members(data)
                else:
                    yield m.name, data

    def run(frames):
        import pandas as pd

        for frame in frames:
            for r in frame.itertuples(index=False):
                found = [(p, d) for p, d in members(r.content)]
                yield pd.DataFrame({"path": [p for p, _ in found], "content": [d for _, d in found], "name": r.name, "version": r.version, "ref": r.ref, "ordinal": range(len(found))})

    out = map_pandas(rows, run, "path string, content binary, name string, version string, ref string, ordinal long")
    out = out.where(source_filter(F.col("path"), F.col("content")))
    return out.select("path", F.col("content").cast("string").alias("source"), F.lit(ecosystem).alias("ecosystem"), "name", "version", F.col("ref").alias("source_ref"), "ordinal")
