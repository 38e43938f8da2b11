"""The ingest plan: files to chunks with edges, stamped, described, embedded, indexed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkyard.functions import text as X
from chunkyard.operators import graph, lines, symbols
from chunkyard.sources import files as sources
from chunkyard.sources.index import name_map

_COLUMNS = ["path", "doc_type", "language", "name", "parent", "start_line", "raw", "text", "symbol_names"]


def chunk_files(files: DataFrame, parsers: dict | None = None, keep_long: bool = True) -> DataFrame:
    """Chunks of files (path, text), each kind by its chunker; ids are made from relative paths."""
    sorted_out = sources.classify(files)
    of = lambda *kinds: sorted_out.where(F.col("kind").isin(*kinds)).drop("kind")
    plain = [lines.config_chunks(of("config")), lines.markdown_chunks(of("markdown")), lines.sliding_windows(of("text", "unknown")), lines.notebook_chunks(of("notebook"))]
    out = symbols.symbol_chunks(of("code"), parsers, keep_long).select(*_COLUMNS)
    for part in plain:
        out = out.unionByName(part.withColumns({"parent": F.lit(""), "raw": F.array().cast("array<string>"), "symbol_names": F.lit(None).cast("array<string>")}).select(*_COLUMNS))
    return out.withColumnRenamed("path", "file_path").withColumn("id", X.chunk_id(F.col("file_path"), F.col("name"), F.col("start_line")))


def build(files: DataFrame, repo_url: str, branch: str, commit_sha: str, stored: DataFrame | None = None, parsers: dict | None = None, describer: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Chunks with calls both ways and their origin; ``stored`` chunks of other files resolve names too."""
    chunks = graph.resolve(chunk_files(files, parsers), None if stored is None else name_map(stored)).drop("raw")
    stamped = chunks.withColumns({"repo_url": F.lit(repo_url), "branch": F.lit(branch), "commit_sha": F.lit(commit_sha), "description": F.lit(None).cast("string")})
    return describer(stamped) if describer else stamped
