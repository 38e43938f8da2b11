"""Benchmark corpora, JSON tables and result files: what an evaluation reads and leaves behind."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkyard.functions import text as X
from chunkyard.operators import evaluate
from chunkyard.sources import files as sources

RETRIEVED = "array<struct<rank: int, file_path: string, name: string, score: double>>"
#: Tables that come as JSON.
CORPUS = "chunk_id string, language string, query string, code string, file_path string"
ANSWERS = f"query string, expected_file string, expected_name string, collection string, hit boolean, hit_rank int, retrieved {RETRIEVED}"
VOCABULARY = "k1 double, b double, avgdl double, next_id int, vocab map<string, int>, idf map<string, double>"
SHARDS = ("0000", "0001", "0002")


def read_json(spark: SparkSession, path: str, schema: str, field: str | None = None) -> DataFrame:
    """A JSON document as a table: an array's elements, one object, or what stands in the array ``field`` of an object."""
    wanted = schema if field is None else f"{field} array<struct<{', '.join(f'{k}: {t}' for k, t in _fields(schema))}>>"
    rows = spark.read.option("multiLine", True).schema(wanted).json(path)
    return rows if field is None else rows.select(F.explode(field).alias("r")).select("r.*")


def _fields(schema: str) -> list[tuple[str, str]]:
    from pyspark.sql.types import StructType

    return [(f.name, f.dataType.simpleString()) for f in StructType.fromDDL(schema).fields]


def commit_table(spark: SparkSession, path: str) -> DataFrame:
    """repo, sha, done from a JSON object with a repository in each field."""
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string, struct<sha: string, done: boolean>>")).alias("repo", "v"))
    return rows.select("repo", "v.sha", F.coalesce("v.done", F.lit(False)).alias("done"))


def read_shards(spark: SparkSession, base: str, subset: str, splits: tuple[str, ...] = ("test", "train"), shards: tuple[str, ...] = SHARDS) -> DataFrame | None:
    """The first split that has any of the shards <base>/<subset>/<split>/<shard>.parquet, whole; None if none has."""
    new = spark._jvm.org.apache.hadoop.fs.Path
    for split in splits:
        paths = [f"{base}/{subset}/{split}/{s}.parquet" for s in shards]
        found = [p for p in paths if new(p).getFileSystem(spark._jsc.hadoopConfiguration()).exists(new(p))]
        if found:
            return spark.read.parquet(*found)
    return None


def corpus(rows: DataFrame, language: str, suffix: str, n: int = 200) -> DataFrame:
    """CORPUS rows of a language: n pairs of query and code, the same ones each time."""
    pairs = sources.benchmark_pairs(rows).withColumn("pair", F.sha2(F.concat_ws("\n", "query", "code"), 256)).withColumn("language", F.lit(language))
    kept = sources.sampled(pairs.dropDuplicates(["pair"]), "language", "pair", n)
    from pyspark.sql import Window

    number = F.lpad((F.row_number().over(Window.partitionBy("language").orderBy("pair")) - 1).cast("string"), 4, "0")
    named = kept.withColumn("chunk_id", F.concat_ws("_", "language", number))
    path = F.concat("language", F.lit("/"), "chunk_id", F.lit(suffix))
    return named.select("chunk_id", "language", X.strip(F.col("query")).alias("query"), X.strip(F.col("code")).alias("code"), path.alias("file_path"))


def corpus_files(rows: DataFrame) -> DataFrame:
    """path and text of the files that a corpus stands for, as ``Engine.ingest`` takes them."""
    return rows.select(F.col("file_path").alias("path"), sources.commented(F.col("file_path"), F.col("query"), F.col("code")).alias("text"))


def write_files(files: DataFrame, root: str) -> None:
    """One file each, below the root, by the tasks: through Arrow's file systems, so the root may be any shared store."""

    def write(batches):
        import posixpath

        from pyarrow import fs

        for batch in batches:
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if posixpath.normpath(path).startswith(("..", "/")):
                    raise ValueError(f"a path outside the root: {path}")
                system, at = fs.FileSystem.from_uri(root if "://" in root else f"file://{root.removeprefix('file:')}")
                system.create_dir(posixpath.dirname(f"{at}/{path}"), recursive=True)
                with system.open_output_stream(f"{at}/{path}") as out:
                    out.write((text or "").encode())
            yield batch.slice(0, 0)

    files.select("path", "text").mapInArrow(write, "path string, text string").count()


def write_json(rows: DataFrame, path: str) -> None:
    """JSON lines."""
    rows.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_evaluation(judged: DataFrame, config: dict, path: str, by: str | None = None) -> None:
    """What an evaluation leaves: config, metrics (and those by a column), results and false hits, as JSON in folders of ``path``."""
    spark = judged.sparkSession
    write_json(spark.createDataFrame([{k: str(v) for k, v in config.items()}]), f"{path}/config")
    write_json(evaluate.metrics(judged) if by is None else evaluate.metrics_by(judged, by), f"{path}/metrics")
    write_json(judged, f"{path}/results")
    kept = [c for c in judged.columns if c in ("query", "expected_file", "expected_name", "target", "target_file", "language")]
    write_json(evaluate.false_hits(judged, *kept), f"{path}/false_hits")


def documented(rows: DataFrame, documentation: Column, order: str, n: int) -> DataFrame:
    """The first n rows with documentation."""
    return rows.where(F.coalesce(X.strip(documentation), F.lit("")) != "").orderBy(order).limit(n)


def first_repositories(rows: DataFrame, repository: str, order: str, n: int = 3) -> DataFrame:
    """The n repositories that come first, each once: repository and first (the place of its first row)."""
    return rows.groupBy(repository).agg(F.min(order).alias("first")).orderBy("first", repository).limit(n)
