"""A versioned chunk index on Parquet.

A collection is a folder of versions and marks.  A change reads the current version, takes the next
number (a folder that only one writer can make), writes that version whole and then makes its mark, so a
reader never sees a half-made version, a failed job changes nothing, and of two writers at once the
second one fails instead of overwriting the first.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chunkyard.functions import text as X


def with_point_ids(chunks: DataFrame, collection: str) -> DataFrame:
    return chunks.withColumn("point_id", X.point_id(F.lit(collection), F.col("file_path"), F.col("name"), F.col("start_line")))


def upserted(existing: DataFrame, new: DataFrame, key: str = "point_id", order: Column | None = None) -> DataFrame:
    """Existing rows but those of the same key, and one of each new key: the last by ``order``, or by all columns where that ties."""
    last = [F.desc(order)] if order is not None else []
    ties = F.desc(F.xxhash64(*[c for c in new.columns if c != key]))
    one = new.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*last, ties))).where("_n = 1").drop("_n")
    return existing.join(one.select(key), key, "left_anti").unionByName(one, allowMissingColumns=True)


def without_files(existing: DataFrame, paths: DataFrame, column: str = "file_path") -> DataFrame:
    return existing.join(paths.select(F.col(paths.columns[0]).alias(column)), column, "left_anti")


def renamed_file(existing: DataFrame, old: str, new: str) -> DataFrame:
    """The path, and the ids and links that have it within."""
    moved = lambda c: F.when(F.col(c) == old, new).otherwise(F.col(c))
    fix = lambda i: F.when(i.startswith(old + "::"), F.concat(F.lit(new), F.substr(i, F.lit(len(old) + 1)))).otherwise(i)
    out = existing.withColumn("file_path", moved("file_path"))
    out = out.withColumn("id", fix(F.col("id"))) if "id" in out.columns else out
    return out.withColumns({c: F.transform(c, fix) for c in ("calls", "called_by") if c in out.columns})


def renamed_repo(existing: DataFrame, new_url: str) -> DataFrame:
    return existing.withColumn("repo_url", F.lit(new_url))


def name_map(chunks: DataFrame, order: str = "start_line") -> DataFrame:
    """name and id: full names and last segments; of several the last written, by file, line and id where the table has them."""
    by = F.struct(*[c for c in ("file_path", order, "id") if c in chunks.columns])
    pairs = chunks.select("id", by.alias("turn"), F.explode(F.array_distinct(F.array("name", X.last_segment(F.col("name"))))).alias("name")).where("name <> ''")
    return pairs.groupBy("name").agg(F.max_by("id", "turn").alias("id"))


def lookup(chunks: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return chunks.join(ids.select(F.col(ids.columns[0]).alias(key)).distinct(), key, "left_semi")


def collection_counts(chunks: DataFrame, column: str = "collection") -> DataFrame:
    """Chunks of each collection and in all ("total")."""
    out = chunks.rollup(column).agg(F.grouping(column).alias("_all"), F.count(F.lit(1)).alias("n"))
    return out.select(F.when(F.col("_all") == 1, "total").otherwise(F.col(column)).alias(column), "n")


class Index:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self):
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.root)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def _entries(self, path: str) -> list[str]:
        fs, new = self._fs()
        return sorted(s.getPath().getName() for s in fs.listStatus(new(path))) if fs.exists(new(path)) else []

    def collections(self) -> list[str]:
        return [c for c in self._entries(self.root) if self.version(c) is not None]

    def version(self, collection: str) -> int | None:
        """The version pointed to: the highest whose mark is there."""
        marks = [int(e.removeprefix("current-")) for e in self._entries(f"{self.root}/{collection}") if e.startswith("current-")]
        return max(marks, default=None)

    def read(self, collection: str) -> DataFrame | None:
        v = self.version(collection)
        return None if v is None else self.spark.read.parquet(f"{self.root}/{collection}/v{v:06d}")

    def exists(self, path: str) -> bool:
        fs, new = self._fs()
        return fs.exists(new(path))

    def replace(self, collection: str, chunks: DataFrame, finish: Callable[[str, int, DataFrame], None] | None = None) -> int:
        """Write the next version, let ``finish`` add to it (collection, version, its rows), then make its mark."""
        size = chunks.select(F.size("vector").alias("n")).where("vector is not null").distinct().limit(2).collect() if "vector" in chunks.columns else []
        old = self.read(collection)
        before = old.select(F.size("vector").alias("n")).where("vector is not null").limit(1).collect() if old is not None and "vector" in old.columns else []
        if len(size) > 1 or (size and before and size[0].n != before[0].n):
            raise ValueError(f"vectors of {sorted({r.n for r in size + before})} dimensions in one collection")
        fs, new = self._fs()
        v, folder = (self.version(collection) or 0) + 1, f"{self.root}/{collection}"
        claim = new(f"{folder}/writing-{v:06d}")
        try:
            fs.create(claim, False).close()
        except Exception as e:
            raise RuntimeError(f"version {v} of {collection} is being written by someone else") from e
        try:
            chunks.write.mode("overwrite").parquet(f"{folder}/v{v:06d}")
            if finish is not None:
                finish(collection, v, self.spark.read.parquet(f"{folder}/v{v:06d}"))
            fs.create(new(f"{folder}/current-{v:06d}"), True).close()
        finally:
            fs.delete(claim, False)
        return v

    def upsert(self, collection: str, chunks: DataFrame, removed_files: DataFrame | None = None, finish: Callable | None = None) -> int:
        new, old = with_point_ids(chunks, collection), self.read(collection)
        if old is None:
            return self.replace(collection, upserted(new.limit(0), new), finish)
        return self.replace(collection, upserted(old if removed_files is None else without_files(old, removed_files), new), finish)

    def delete_files(self, collection: str, paths: DataFrame, finish: Callable | None = None) -> int | None:
        old = self.read(collection)
        return None if old is None else self.replace(collection, without_files(old, paths), finish)

    def rename_file(self, collection: str, old_path: str, new_path: str, finish: Callable | None = None) -> int:
        old = self.read(collection)
        if old is None:
            raise KeyError(collection)
        return self.replace(collection, with_point_ids(renamed_file(old, old_path, new_path), collection), finish)

    def rename_repo(self, collection: str, new_collection: str, new_url: str, finish: Callable | None = None) -> int:
        old = self.read(collection)
        if old is None:
            raise KeyError(collection)
        v = self.replace(new_collection, with_point_ids(renamed_repo(old, new_url), new_collection), finish)
        if new_collection != collection:
            fs, new = self._fs()
            fs.delete(new(f"{self.root}/{collection}"), True)
        return v

    def everything(self) -> DataFrame | None:
        """The chunks of all collections, with ``collection``."""
        out = None
        for name in self.collections():
            part = self.read(name).withColumn("collection", F.lit(name))
            out = part if out is None else out.unionByName(part, allowMissingColumns=True)
        return out

    def export_text(self, collection: str | None, path: str) -> None:
        """Descriptions and texts of a collection, or of all, as text; of all, in a folder a collection."""
        chunks = self.read(collection) if collection is not None else self.everything()
        if chunks is None:
            raise KeyError(collection)
        rows = chunks.select(X.enriched_text(F.col("description"), F.col("text")).alias("value"), *([] if collection is not None else ["collection"]))
        (rows.write if collection is not None else rows.write.partitionBy("collection")).text(path)
