"""Retrieval quality: hits, Recall@K, MRR, failures, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chunkyard.functions import text as X


def docstring_match(r: Column, row: Column | None = None) -> Column:
    """The expected file is in the path, or the expected name in the name; empty expectations match nothing."""
    inside = lambda whole, part: (F.coalesce(part, F.lit("")) != "") & F.contains(F.coalesce(whole, F.lit("")), part)
    return inside(r["file_path"], F.col("expected_file")) | inside(r["name"], F.col("expected_name"))


def name_part_match(r: Column) -> Column:
    """Any dotted part of the target is in the lower-cased name."""
    return F.exists(F.split(F.lower("target"), r"\."), lambda p: F.contains(F.lower(F.coalesce(r["name"], F.lit(""))), p))


def file_match(r: Column) -> Column:
    """The target's path is in the result's path."""
    return F.contains(X.normal_path(r["file_path"]), X.normal_path(F.col("target_file")))


def judged(answers: DataFrame, match, depth: int | None = None) -> DataFrame:
    """The answers (with ``retrieved``, an array of rank, file_path, name, score) with hit and hit_rank.

    ``depth`` is the K of Recall@K; without it, expanded rows after the K-th can be hits too.
    """
    seen = F.col("retrieved") if depth is None else F.filter("retrieved", lambda r: r["rank"] <= depth)
    first = F.array_min(F.transform(F.filter(seen, match), lambda r: r["rank"]))
    return answers.withColumn("hit_rank", first).withColumn("hit", F.col("hit_rank").isNotNull())


def _measures() -> list[Column]:
    return [
        F.round(F.coalesce(F.avg(F.col("hit").cast("double")), F.lit(0.0)), 4).alias("recall"),
        F.round(F.coalesce(F.avg(F.coalesce(1 / F.col("hit_rank"), F.lit(0.0))), F.lit(0.0)), 4).alias("mrr"),
        F.coalesce(F.sum(F.col("hit").cast("long")), F.lit(0)).alias("hits"),
        F.count(F.lit(1)).alias("total"),
    ]


def metrics(rows: DataFrame) -> DataFrame:
    return rows.agg(*_measures())


def metrics_by(rows: DataFrame, column: str) -> DataFrame:
    """For each value, and over all (with the value "overall"), from one aggregation."""
    out = rows.rollup(column).agg(F.grouping(column).alias("_all"), *_measures())
    return out.withColumn(column, F.when(F.col("_all") == 1, "overall").otherwise(F.col(column))).drop("_all")


def false_hits(rows: DataFrame, *kept: str) -> DataFrame:
    return rows.where(~F.col("hit")).select(*kept, F.transform("retrieved", lambda r: F.struct(r["file_path"], r["name"])).alias("retrieved"))


def report(measures: DataFrame, failures: DataFrame, title: str, shown: int = 10) -> str:
    """A Markdown report; the metrics are at most 1,000 rows and the failures at most ``shown``."""
    head = measures.columns
    table = [f"| {' | '.join(head)} |", "|" + "-|" * len(head), *(f"| {' | '.join(str(v) for v in r)} |" for r in measures.limit(1000).collect())]
    bad = failures.select(X.markdown_cell(F.col("query")).alias("query"), X.markdown_cell(F.to_json("retrieved")).alias("retrieved")).limit(shown).collect()
    return "\n".join([f"# {title}", "", *table, "", "## Not found", "", "| query | retrieved |", "|-|-|", *(f"| {r.query} | {r.retrieved} |" for r in bad)]) + "\n"
