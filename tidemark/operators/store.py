"""Keyed tables on Parquet: versioned upserts, look-ups, marks, expiry, snapshots."""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


#: Ids, at most, that multi_get looks up at once; they are broadcast.
MULTI_GET = 100_000


def upsert(base: DataFrame, changes: DataFrame, key: str = "id", version: str = "version") -> DataFrame:
    """The row of the highest version of each key; of equal versions that of the changes."""
    both = base.withColumn("__late", F.lit(0)).unionByName(changes.withColumn("__late", F.lit(1)))
    newest = W.partitionBy(key).orderBy(F.desc(version), F.desc("__late"))
    return both.withColumn("__n", F.row_number().over(newest)).where("__n = 1").drop("__n", "__late")


def multi_get(rows: DataFrame, ids: list[str]) -> DataFrame:
    """Rows of these ids in the ids' order; repeated ids once, unknown ones dropped."""
    if len(ids) > MULTI_GET:
        raise ValueError(f"{len(ids)} ids; {MULTI_GET} are the most that one call looks up")
    spark = rows.sparkSession
    wanted = spark.createDataFrame([(x, k) for k, x in enumerate(dict.fromkeys(ids))], "id string, __at int")
    return rows.join(F.broadcast(wanted), "id").orderBy("__at").drop("__at")


def in_window(items: DataFrame, start: Column, end: Column, field: str = "detected_at") -> DataFrame:
    """Items of a half-open window, oldest first."""
    return items.where((F.col(field) >= start) & (F.col(field) < end)).orderBy(field, "id")


def list_runs(runs: DataFrame, day: str, job: str | None = None) -> DataFrame:
    """A day's runs, newest first, with their position."""
    out = runs.where(F.col("day") == day)
    out = out.where(F.col("job") == job) if job else out
    rows = out.withColumn("__hour", F.date_trunc("hour", F.col("started_at")))
    return ordinals(rows, [F.desc("__hour")], ["__hour"], [F.desc("started_at"), F.desc("id")], "position").drop("__hour").orderBy("position")


def mark(marks: Column, digest_id: Column) -> Column:
    return F.array_union(marks, F.array(digest_id))


def unmark(marks: Column, digest_id: Column) -> Column:
    return F.array_remove(marks, digest_id)


def live(rows: DataFrame, now: Column) -> DataFrame:
    """Rows that have not expired; rows without an expiry stay."""
    return rows.where(F.col("expires_at").isNull() | (F.col("expires_at") > now))


def ordinals(rows: DataFrame, ranges: list[Column], keys: list[str], order: list[Column], name: str) -> DataFrame:
    """rows numbered from 1 over all: by `ranges`, an order of the columns `keys`, and by `order` within each range.

    Ranges are counted, the counts summed up, and rows numbered range by range. Only the counts, a row for each
    range, are in one task.
    """
    counts = rows.groupBy(*keys).agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(W.orderBy(*ranges).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(*keys, before.alias("__start"))
    within = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("__within", within).join(starts, keys).withColumn(name, (F.col("__start") + F.col("__within")).cast("int")).drop("__start", "__within")


class SnapshotStore:
    """Tables in a folder, a writer at a time. Rows are in buckets by a hash of their key, files are never changed, and a
    manifest names the files of each bucket: a change rewrites the buckets that it touches, an append none.

    A reader sees the old or the new version whole: the manifest is written last, through Hadoop's file system, so the
    folder may be in any store that Spark reaches. Files that none of the last KEEP manifests names are removed.
    """

    KEEP, FILES, PIECES = 3, 8, 64

    def __init__(self, spark: SparkSession, root: str, buckets: int = 16):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _versions(self, table: str) -> list[int]:
        folder = self._path(f"{self.root}/{table}/manifests")
        return sorted(int(s.getPath().getName()) for s in self._fs.listStatus(folder)) if self._fs.exists(folder) else []

    def version(self, table: str) -> int:
        """The current version, or -1 where there is none."""
        return max(self._versions(table), default=-1)

    def _manifest(self, table: str, version: int) -> dict:
        stream = self._fs.open(self._path(f"{self.root}/{table}/manifests/{version}"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _bucket(self, key: str) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def _rows(self, manifest: dict, buckets: Iterable[str] | None = None) -> DataFrame:
        paths = [f"{self.root}/{f}" for b, files in manifest["buckets"].items() if buckets is None or b in buckets for f in files]
        schema = StructType.fromJson(manifest["schema"])
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def read(self, table: str) -> DataFrame | None:
        v = self.version(table)
        return None if v < 0 else self._rows(self._manifest(table, v))

    def _publish(self, table: str, rows: DataFrame, key: str, old: dict, replace: bool) -> int:
        """Write rows by bucket; the manifest's buckets that they fall into are replaced or get more files. A bucket of more
        than spark.sql.adaptive.advisoryPartitionSizeInBytes is written by several tasks, small ones together by one. Buckets are dealt in
        PIECES, as what one task has of a bucket goes to one task, and a table may come from few tasks."""
        v = self.version(table) + 1
        folder = f"{table}/data/{v}"
        dealt = rows.withColumns({"__bucket": self._bucket(key), "__piece": F.pmod(F.hash(key), F.lit(self.PIECES))}).hint("rebalance", "__bucket", "__piece").drop("__piece")
        dealt.write.mode("overwrite").partitionBy("__bucket").parquet(f"{self.root}/{folder}")
        found = [s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.root}/{folder}"))]
        new = {x.split("=")[1]: f"{folder}/{x}" for x in found if x.startswith("__bucket=")}
        buckets = dict(old["buckets"]) | {b: [f] if replace else [*old["buckets"].get(b, []), f] for b, f in new.items()}
        stream = self._fs.create(self._path(f"{self.root}/{table}/manifests/{v}"), False)
        stream.write(bytearray(json.dumps({"schema": rows.schema.jsonValue(), "key": key, "buckets": buckets}).encode()))
        stream.close()
        self._expire(table)
        return v

    def _expire(self, table: str) -> None:
        versions = self._versions(table)
        kept = {f for v in versions[-self.KEEP :] for files in self._manifest(table, v)["buckets"].values() for f in files}
        for v in versions[: -self.KEEP]:
            folder = self._path(f"{self.root}/{table}/data/{v}")
            left = 0
            for s in self._fs.listStatus(folder) if self._fs.exists(folder) else ():
                name = s.getPath().getName()
                if name.startswith("__bucket=") and f"{table}/data/{v}/{name}" not in kept:
                    self._fs.delete(s.getPath(), True)
                else:
                    left += name.startswith("__bucket=")
            if not left:
                self._fs.delete(folder, True)
            self._fs.delete(self._path(f"{self.root}/{table}/manifests/{v}"), False)

    def commit(self, table: str, rows: DataFrame, key: str = "id") -> int:
        """A table as a whole."""
        return self._publish(table, rows, key, {"buckets": {}}, True)

    def _touched(self, table: str, changes: DataFrame, key: str) -> tuple[dict, DataFrame]:
        """The current manifest, and its rows of the buckets that changes fall into: no more than there are buckets."""
        manifest = self._manifest(table, self.version(table))
        hit = {str(r.b) for r in changes.select(self._bucket(key).alias("b")).distinct().collect()}
        return manifest, self._rows(manifest, hit)

    def append(self, table: str, rows: DataFrame, key: str = "id") -> int:
        """Rows whose keys the table does not have yet; no file is read or rewritten, until a bucket has FILES of them."""
        if self.version(table) < 0:
            return self.commit(table, rows, key)
        manifest = self._manifest(table, self.version(table))
        if max(map(len, manifest["buckets"].values()), default=0) < self.FILES:
            return self._publish(table, rows, key, manifest, False)
        manifest, base = self._touched(table, rows, key)
        return self._publish(table, base.unionByName(rows.select(base.columns)), key, manifest, True)

    def insert(self, table: str, rows: DataFrame, key: str = "id") -> int:
        """Rows of keys that the table does not have; others are left out."""
        if self.version(table) < 0:
            return self.commit(table, rows, key)
        _, base = self._touched(table, rows, key)
        return self.append(table, rows.join(base.select(key), key, "left_anti").select(rows.columns), key)

    def upsert(self, table: str, changes: DataFrame, key: str = "id", version: str = "version") -> int:
        """Of each key the row of the highest version."""
        if self.version(table) < 0:
            return self.commit(table, changes, key)
        manifest, base = self._touched(table, changes, key)
        return self._publish(table, upsert(base, changes, key, version), key, manifest, True)

    def replace(self, table: str, rows: DataFrame, key: str = "id") -> int:
        """Rows take the place of those of their keys."""
        manifest, base = self._touched(table, rows, key)
        return self._publish(table, base.join(rows.select(key), key, "left_anti").select(base.columns).unionByName(rows.select(base.columns)), key, manifest, True)

    def prune(self, table: str, now: Column) -> int:
        """Write a table without the rows that have expired."""
        rows = self.read(table)
        return self.commit(table, live(rows, now), self._manifest(table, self.version(table))["key"])

    def dump(self, tables: list[str]) -> Mapping[str, DataFrame]:
        return {t: df for t in tables if (df := self.read(t)) is not None}

    def seed(self, tables: Mapping[str, DataFrame]) -> None:
        """Tables as `dump` gave them."""
        for name, rows in tables.items():
            self.commit(name, rows)
