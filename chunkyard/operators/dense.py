"""Dense retrieval: exact cosine top-k.

Queries are few and checked: they are broadcast while their vectors fit ``BROADCAST_BYTES``, and in
blocks of queries beyond that, so the vectors stay where they are and never shuffle.  A task makes at most
``best.CELLS`` scores at once and keeps k rows a query, whatever the number of queries and vectors.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from chunkyard.operators.best import CELLS, Best, rounded

BROADCAST_BYTES = 32 << 20


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 where either is null or zero."""
    length = norm(a) * norm(b)
    return F.coalesce(F.when(length > 0, dot(a, b) / length), F.lit(0.0))


def ranked(scored: DataFrame, k: int, query: str, key: str) -> DataFrame:
    order = Window.partitionBy(query).orderBy(F.desc("score"), F.asc(key))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k_sql(vectors: DataFrame, queries: DataFrame, k: int, query: str = "query_id", key: str = "vec_id", places: int = 6) -> DataFrame:
    """By SQL expressions: right for few vectors, and the check on ``top_k``.  ``queries`` has query and vector, within BROADCAST_BYTES."""
    if (queries.agg(F.sum(8 * F.size("vector"))).first()[0] or 0) > BROADCAST_BYTES:
        raise ValueError("too many query vectors to broadcast: use top_k")
    pairs = vectors.select(key, "embedding", norm(F.col("embedding")).alias("n")).join(F.broadcast(queries.select(query, "vector", norm(F.col("vector")).alias("qn"))))
    length = F.col("n") * F.col("qn")
    score = F.round(F.coalesce(F.when(length > 0, dot(F.col("embedding"), F.col("vector")) / length), F.lit(0.0)), places)
    return ranked(pairs.select(query, key, score.alias("score")), k, query, key)


def top_k(vectors: DataFrame, queries: DataFrame, k: int, query: str = "query_id", key: str = "vec_id", places: int = 6, block_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """By matrix products in Arrow batches: each task keeps k rows a query, then the window picks k of those."""
    size = queries.agg(F.sum(8 * F.size("vector"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    keyed = queries.select(query, "vector", F.pmod(F.xxhash64(query), F.lit(blocks)).alias("block"))
    out = None
    for b in range(blocks):
        rows = keyed.where(F.col("block") == b).select(query, "vector").toLocalIterator()
        part = _block(vectors, [(r[0], list(r[1])) for r in rows], k, query, key, places, queries.schema[query].dataType)
        out = part if out is None else out.unionByName(part)
    return ranked(out, k, query, key)


def _matrix(vectors: pa.Array, width: int) -> np.ndarray:
    """A row for each vector; zeros for those that are null, of another length or have a null."""
    out = np.zeros((len(vectors), width))
    fits = pc.fill_null(pc.equal(pc.list_value_length(vectors), width), False)
    flat = vectors.filter(fits).flatten()
    if width and len(flat):
        out[fits.to_numpy(zero_copy_only=False)] = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
        if flat.null_count:
            out[np.isnan(out).any(1)] = 0
    return out


def block_of(ids: list, asked: np.ndarray, k: int, schema: pa.Schema, places: int):
    """From batches of keys and vectors to the k best of these queries in all of them."""

    def run(batches):
        norms, best, step = np.sqrt((asked * asked).sum(1)), Best(len(ids), k, schema.field(1).type), max(1, CELLS // max(1, len(ids)))
        for batch in batches if len(ids) else ():
            for at in range(0, batch.num_rows, step):
                keys = batch.column(0).slice(at, step)
                m = _matrix(batch.column(1).slice(at, step), asked.shape[1])
                length = np.sqrt((m * m).sum(1))[:, None] * norms[None, :]
                score = m @ asked.T
                np.divide(score, length, out=score, where=length > 0)
                score[length == 0] = 0
                score = rounded(score, places)
                row, hit = np.nonzero(score >= best.least)
                best.add(hit, score[row, hit], keys.take(pa.array(row)))
        number, score, keys = best.settle()
        for at in range(0, len(number), 10_000):
            part = slice(at, at + 10_000)
            yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in number[part].tolist()], schema.field(0).type), keys[part], pa.array(score[part])], schema=schema)

    return run


def _block(vectors: DataFrame, asked: list[tuple], k: int, query: str, key: str, places: int, of: T.DataType) -> DataFrame:
    matrix = np.array([v for _, v in asked], dtype=np.float64) if asked else np.zeros((0, 1))
    shipped = vectors.sparkSession.sparkContext.broadcast(([i for i, _ in asked], matrix))
    schema = T.StructType([T.StructField(query, of), T.StructField(key, vectors.schema[key].dataType), T.StructField("score", T.DoubleType())])
    arrow = to_arrow_schema(schema)
    return vectors.select(key, "embedding").where(F.col(key).isNotNull()).mapInArrow(lambda batches: block_of(*shipped.value, k, arrow, places)(batches), schema)
