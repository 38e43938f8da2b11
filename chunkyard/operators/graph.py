"""The call graph: resolving names, edges both ways, expanding hits, hops."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chunkyard.functions import text as X
from chunkyard.session import written


def symbol_table(chunks: DataFrame, stored: DataFrame | None = None, order: str = "start_line") -> DataFrame:
    """name and id for each full name and last segment; of several the last written wins, new ones before stored."""
    by = [F.col("file_path"), F.col(order), F.col("id")] if "file_path" in chunks.columns else [F.col(order), F.col("id")]
    names = chunks.select("id", F.explode(F.array_distinct(F.array("name", X.last_segment(F.col("name"))))).alias("symbol"), F.struct(F.lit(1).alias("new"), *by).alias("turn")).where("symbol <> ''")
    table = names.groupBy("symbol").agg(F.max_by("id", "turn").alias("id"))
    if stored is not None:
        table = table.unionByName(stored.select(F.col("name").alias("symbol"), "id").join(table.select("symbol"), "symbol", "left_anti"))
    return table.select(F.col("symbol").alias("name"), "id")


def call_edges(chunks: DataFrame, symbols: DataFrame) -> DataFrame:
    """src, dst for every name in ``raw`` that is known, but a chunk's own."""
    wanted = chunks.select(F.col("id").alias("src"), F.explode("raw").alias("name"))
    return wanted.join(symbols.select("name", F.col("id").alias("dst")), "name").where("src <> dst").select("src", "dst").distinct()


def with_edges(chunks: DataFrame, edges: DataFrame) -> DataFrame:
    """The chunks with calls and called_by, sorted."""
    out = edges.groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_set("dst")).alias("calls"))
    back = edges.groupBy(F.col("dst").alias("id")).agg(F.array_sort(F.collect_set("src")).alias("called_by"))
    none = F.array().cast("array<string>")
    plain = chunks.drop("calls", "called_by")
    return plain.join(out, "id", "left").join(back, "id", "left").withColumns({c: F.coalesce(c, none) for c in ("calls", "called_by")})


def resolve(chunks: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    return with_edges(chunks, call_edges(chunks, symbol_table(chunks, stored)))


def expand(hits: DataFrame, edges: DataFrame, key: str = "query_id") -> DataFrame:
    """Called chunks of the hits (key, id, name, rank): key, id, reason of the first parent by rank and place.

    ``edges`` has src, dst and pos (the place among the source's calls)."""
    found = hits.join(edges, hits["id"] == edges["src"]).groupBy(key, F.col("dst").alias("id")).agg(F.min_by("name", F.struct("rank", "pos")).alias("parent"))
    return found.select(key, "id", F.concat(F.lit("calls:"), F.col("parent")).alias("expand_reason"))


def first_wins(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def callers(seeds: DataFrame, edges: DataFrame, hops: int, key: str = "query_id") -> DataFrame:
    """key, id, hop: what reaches the seeds over called-by edges in at most ``hops`` steps, each at its first hop.

    Each hop is one join and one anti-join; lineage is cut after each, so plans do not grow.
    """
    seen = seeds.select(key, "id", F.lit(0).alias("hop")).distinct()
    level = seen
    for hop in range(1, hops + 1):
        step = level.join(edges, level["id"] == edges["dst"]).select(key, F.col("src").alias("id")).distinct()
        level = written(step.join(seen.select(key, "id"), [key, "id"], "left_anti").withColumn("hop", F.lit(hop)), "hop")
        seen = seen.unionByName(level)
    return seen
