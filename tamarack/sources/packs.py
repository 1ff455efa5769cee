"""Objects in packs: many small ones by keys, as rows of Parquet files.

A file of its own takes a block of the disk at least, and its folders too; for pages that
is several times their text. Here each write makes one pack, a folder of Parquet files
with rows (prefix, object_key, data), and a snapshot store names the packs that count, so
a write is seen whole or not at all. A pack replaces the prefixes that it has: an object is
there if no later pack has a folder above it as a prefix. A row without a key says that
the object with its prefix as key is deleted. Bodies are written where they lie, in order
of their keys, and are not shuffled; of several packs, names say which rows are left.

Keys are those of ``objects``: others are refused, as are keys that come twice, and the
write fails. ``repack`` makes one pack of all, ``vacuum`` removes those that don't count.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .objects import KeyRefused, checked
from .scratch import written
from .store import SnapshotStore

PACK = "prefix string, object_key string, data binary"
#: How often a write is published anew where other writers were first.
TRIES = 20


def _checked(key: Column, what: str) -> Column:
    """As ``objects.checked``, in the plan."""
    plain = F.replace(F.coalesce(key, F.lit("")), F.lit("\\"), F.lit("/"))
    return F.when(plain.rlike(r"(^|/)([._/]|\z)"), F.raise_error(F.concat(F.lit(f"not a {what} below the root: "), plain))).otherwise(plain)


class PackedObjects:
    """Objects below a root that Spark can write to."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.store = SnapshotStore(spark, self.root, buckets=1)

    def write(self, rows: DataFrame) -> None:
        """Store rows (prefix, object_key, data or text) and replace each prefix by them."""
        prefix, key = _checked(F.col("prefix"), "prefix"), _checked(F.col("object_key"), "key")
        named = rows.select(prefix.alias("prefix"), key.alias("object_key"), F.col("data").cast("binary").alias("data"))
        inside = F.when(F.startswith("object_key", F.concat("prefix", F.lit("/"))), F.col("object_key")).otherwise(F.raise_error(F.concat("object_key", F.lit(" is not below "), "prefix")))
        self._add(named.select("prefix", inside.alias("object_key"), F.coalesce("data", F.lit(b"")).alias("data")))

    def _add(self, rows: DataFrame, instead: list | None = None) -> None:
        """Write rows as a pack and publish it, for a repack in the place of others."""
        path = f"{self.root}/objects/{uuid.uuid4().hex}"
        try:
            rows.sortWithinPartitions("object_key").write.option("compression", "zstd").parquet(path)
            pack = self.spark.read.schema(PACK).parquet(path)
            if twice := pack.where("object_key is not null").groupBy("object_key").count().where("count > 1").head(1):
                raise KeyRefused(f"{twice[0][0]!r} comes twice")
            some = instead is not None or pack.head(1)
        except BaseException:
            self._remove(path)
            raise
        # from here on it may be named: what isn't goes with the next vacuum
        self._publish(path, instead) if some else self._remove(path)

    def _remove(self, path: str) -> None:
        self.store._fs.delete(self.store._path(path), True)

    def _publish(self, path: str, instead: list | None) -> None:
        for left in reversed(range(TRIES)):
            seen, now = self.store.current()[0], self._packs()
            if not {p["path"] for p in instead or []} <= {p["path"] for p in now}:
                raise OSError("another writer has repacked")
            # later than all that is there, or as late as what it takes the place of
            number = max((p["number"] for p in instead or now), default=-1) + (instead is None)
            row = self.spark.createDataFrame([(path, number)], "path string, number int")
            gone = self.spark.createDataFrame([(p["path"],) for p in instead or []], "path string")
            try:
                self.store.commit({"object_packs": (row.select("path").unionByName(gone), row)}, since=seen)
                return
            except OSError:
                if not left:
                    raise

    def _packs(self) -> list:
        """(path, number) of the packs, oldest first: one for each write since the last repack."""
        return sorted(self.store.read("object_packs").collect(), key=lambda p: p["number"])

    def _rows(self, packs: list) -> DataFrame:
        """prefix, object_key, data of what is there."""
        read = self.spark.read.schema(PACK).parquet
        if len(packs) < 2:
            return (read(packs[0]["path"]) if packs else self.spark.createDataFrame([], PACK)).where("object_key is not null")
        whole = None
        for i, p in enumerate(packs):
            one = read(p["path"]).withColumn("_pack", F.lit(i))
            whole = one if whole is None else whole.unionByName(one)
        last = whole.groupBy("prefix").agg(F.max("_pack").alias("_last"))
        rows = whole.where("object_key is not null").withColumn("_folder", F.regexp_replace("object_key", r"/[^/]*\z", ""))
        parts = F.split("_folder", "/")
        above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
        over = rows.select("_folder").distinct().select("_folder", F.explode(above).alias("prefix")).join(last, "prefix")
        newest = over.groupBy("_folder").agg(F.max("_last").alias("_newest"))
        gone = whole.where("object_key is null").groupBy(F.col("prefix").alias("_key")).agg(F.max("_pack").alias("_gone"))
        left = rows.join(newest, "_folder").where("_pack >= _newest").join(gone, (F.col("object_key") == F.col("_key")) & (F.col("_pack") < F.col("_gone")), "left_anti")
        return left.select("prefix", "object_key", "data")

    def _below(self, prefix: str) -> DataFrame:
        rows = self._rows(self._packs())
        key = F.col("object_key")
        return rows.where((key == checked(prefix)) | key.startswith(f"{checked(prefix)}/")) if prefix else rows

    def bodies(self, prefix: str = "") -> DataFrame:
        """object_key, data of the objects below a prefix (or of the one with that key)."""
        return self._below(prefix).select("object_key", "data")

    def heads(self, prefix: str = "") -> DataFrame:
        """object_key, size of the objects below a prefix (or of the one with that key)."""
        return self._below(prefix).select("object_key", F.octet_length("data").cast("long").alias("size"))

    def delete(self, keys: DataFrame) -> DataFrame:
        """Remove the objects with these keys; object_key, deleted: whether there was one."""
        keys = keys.select(_checked(F.col("object_key"), "key").alias("object_key")).distinct()
        there = self.heads().select("object_key", F.lit(True).alias("deleted"))
        out = written(keys.join(there, "object_key", "left").select("object_key", F.coalesce("deleted", F.lit(False)).alias("deleted")))
        self._add(out.where("deleted").select(F.col("object_key").alias("prefix"), F.lit(None).cast("string").alias("object_key"), F.lit(None).cast("binary").alias("data")))
        return out

    def delete_prefix(self, prefix: str) -> int:
        """Remove all below a prefix, or the object with that key; how many there were."""
        return self.delete(self.bodies(prefix.rstrip("/")).select("object_key")).where("deleted").count()

    def repack(self) -> None:
        """One pack of all that is there; what is written meanwhile stays."""
        packs = self._packs()
        if len(packs) > 1:
            self._add(self._rows(packs), packs)

    def vacuum(self, keep: int = 2, older_than: float = 24 * 3600.0) -> int:
        """As that of the store."""
        return self.store.vacuum(keep, older_than)
