"""What the operators of this package share: reading tables, staging, Arrow mapping."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from chunkyard.session import shared_path, written

#: Rows of an Arrow batch that become Python objects at once; bounds a worker's memory.
SLICE_ROWS = 512
SLICE_BYTES = 16 << 20
#: Bytes of an Arrow batch.
BATCH_BYTES = 8 << 20
#: Bytes of a row group that a Python worker writes.
GROUP_BYTES = 4 << 20


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def scratch_path(spark: SparkSession, name: str) -> str:
    return shared_path(spark, name)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder once and read it back."""
    return written(df, name)


def stage_mapped(df: DataFrame, make: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, name: str) -> DataFrame:
    """``df.mapInArrow(make, schema)``, staged.  In a mounted folder (``file:``) the Python workers write the files.

    So large values do not go through the JVM's heap, and the JVM forks no ``chmod``, as Hadoop's local file system does for
    each file (until such a child has begun its program, the JVM's memory counts twice).  A file is its attempt's own; the driver
    moves those of the tasks that ended well into the table's folder.  For any other store Spark writes.
    """
    spark, path = df.sparkSession, scratch_path(df.sparkSession, name)
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    where = there.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(there).toUri()
    if where.getScheme() != "file":
        return stage(df.mapInArrow(make, schema), name)
    made, arrow = where.getPath(), to_arrow_schema(T._parse_datatype_string(schema))
    being = f"{made}.writing"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, writer, held = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.parquet", None, []
        for batch in make(batches):
            held.append(batch)
            if sum(b.nbytes for b in held) >= GROUP_BYTES:
                writer = writer or pq.ParquetWriter(f"{being}/{file}", arrow, compression="none", use_dictionary=False, write_statistics=False)
                writer.write_table(pa.Table.from_batches(held, arrow))
                held = []
        if held:
            writer = writer or pq.ParquetWriter(f"{being}/{file}", arrow, compression="none", use_dictionary=False, write_statistics=False)
            writer.write_table(pa.Table.from_batches(held, arrow))
        if writer:
            writer.close()
            yield pa.RecordBatch.from_pydict({"file": [file]})

    for folder in (made, being):
        os.makedirs(folder)
    for r in df.mapInArrow(write, "file string").collect():  # a row for each task
        os.rename(f"{being}/{r['file']}", f"{made}/{r['file']}")
    return spark.read.schema(schema).parquet(path)


def file_system(path: str):
    """Arrow's file system for a path in the shared folder, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id's text modulo ``modulus``; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % F.lit(modulus)


def slices(batch: pa.RecordBatch, rows: int = SLICE_ROWS, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in parts of at most ``rows`` rows and of ``most`` bytes of strings, or of one row that has more."""
    size = np.zeros(batch.num_rows, dtype=np.int64)
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) or pa.types.is_binary(column.type):
            size += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, at = np.cumsum(size), 0
    while at < batch.num_rows:
        upto = int(np.searchsorted(ends, ends[at] - size[at] + most, "right"))
        upto = min(at + rows, max(at + 1, upto))
        yield batch.slice(at, upto - at)
        at = upto


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores before it as no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken or not name.startswith("_"):
        name = "_" + name
    return name


def map_slices(df: DataFrame, schema: T.StructType, start: Callable[[], Callable[[dict], dict]], rows: int = SLICE_ROWS) -> DataFrame:
    """Run ``start()`` once in each task; it returns the function from a slice's columns to the output's columns."""
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = start()
        for batch in batches:
            for part in slices(batch, rows):
                out = step(part.to_pydict())
                if out is not None:
                    yield pa.RecordBatch.from_pydict(out, schema=arrow)

    return df.mapInArrow(run, schema)


def batches_of(spark: SparkSession, most: int = BATCH_BYTES) -> None:
    """Texts go to Python in Arrow batches of about ``most`` bytes, so that the buffers on both sides stay small."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", most)


def text_rows(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, text (null: empty) and ``more``; whatever else the table has is left out."""
    batches_of(docs.sparkSession)
    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)
