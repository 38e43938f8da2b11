"""Reading repositories and benchmark corpora."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkyard.functions import text as X

# What is not read.
SKIP_DIRS = [".git", "__pycache__", "node_modules", ".venv", "venv", "dist", "build", ".mypy_cache", ".pytest_cache"]
SKIP_EXTS = [
    ".pyc", ".pyo", ".pyd", ".so", ".dll", ".exe", ".bin", ".png", ".jpg", ".jpeg", ".gif", ".svg", ".ico",
    ".woff", ".woff2", ".ttf", ".eot", ".mp4", ".mp3", ".wav", ".zip", ".tar", ".gz", ".lock", ".sum",
]
# Languages by suffix.
LANGUAGES = {
    ".py": "python", ".js": "javascript", ".jsx": "javascript", ".ts": "typescript", ".tsx": "tsx", ".go": "go", ".html": "html",
    ".css": "css", ".scss": "css", ".java": "java", ".rs": "rust", ".rb": "ruby", ".cpp": "cpp", ".cc": "cpp", ".cxx": "cpp", ".c": "c",
    ".cs": "c_sharp", ".php": "php", ".kt": "kotlin", ".swift": "swift", ".lua": "lua", ".r": "r", ".sh": "bash", ".bash": "bash",
}
# What begins a comment, by suffix.
COMMENTS = {".py": "#", ".java": "//", ".cpp": "//", ".js": "//", ".cs": "//", ".php": "//", ".c": "//"}


def wanted(path: Column) -> Column:
    """No skipped folder on the path and no skipped suffix; only the parts below the root count."""
    return ~F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, SKIP_DIRS))) & ~X.suffix(path).isin(SKIP_EXTS)


def scan(spark: SparkSession, root: str) -> DataFrame:
    """path (below the root) and text of all wanted files; broken UTF-8 is replaced, blank files are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = re.sub("^[a-z0-9]+:/*(?=/)", "", root.rstrip("/"))
    below = F.substr(F.regexp_replace("path", "^[a-z0-9]+:/*(?=/)", ""), F.lit(len(base) + 2))
    named = files.select(below.alias("path"), "content").where(wanted(F.col("path")))
    return named.select("path", F.call_function("try_validate_utf8", F.col("content").cast("string")).alias("text"), "content").select("path", F.coalesce("text", _lossy("content")).alias("text")).where(X.strip(F.col("text")) != "")


def _lossy(column: str) -> Column:
    return F.call_function("make_valid_utf8", F.col(column).cast("string"))


def head_commit(folder: str) -> str | None:
    """The commit of a local clone, from its files; None where there is none."""
    from pathlib import Path

    try:
        head = (Path(folder) / ".git/HEAD").read_text().strip()
        if not head.startswith("ref: "):
            return head
        ref = head.removeprefix("ref: ")
        own = Path(folder) / ".git" / ref
        if own.exists():
            return own.read_text().strip()
        packed = [line.split(" ") for line in (Path(folder) / ".git/packed-refs").read_text().splitlines() if line.endswith(f" {ref}")]
        return packed[0][0] if packed else None
    except OSError:
        return None


def walk_order(files: DataFrame) -> DataFrame:
    """The files by path, for where their order matters."""
    return files.orderBy("path")


def classify(files: DataFrame) -> DataFrame:
    """path and text with kind (which chunker), doc_type and language."""
    ext, name = X.suffix(F.col("path")), F.lower(X.file_name(F.col("path")))
    language = F.lit("")
    for suffix, of in LANGUAGES.items():
        language = F.when(ext == suffix, of).otherwise(language)
    kind = (
        F.when(ext == ".ipynb", "notebook").when(ext.isin(".yaml", ".yml", ".json", ".toml"), "config").when(ext.isin(".md", ".rst", ".mdx"), "markdown")
        .when(ext.isin(".txt", ".log", ".csv", ""), "text").when(ext.isin(list(LANGUAGES)), "code").otherwise("unknown")
    )
    code = F.when(ext.isin(".css", ".scss"), "style").when(ext == ".html", "markup").when(name.startswith("test_") | F.contains(name, F.lit(".spec.")) | F.contains(name, F.lit("_test.")), "test").otherwise("code")
    return files.select("path", "text", kind.alias("kind"), F.when(kind == "code", code).otherwise(kind).alias("doc_type"), F.when(kind == "code", language).otherwise("").alias("language"))


def manifest(files: DataFrame) -> DataFrame:
    return files.select("path", F.sha2("text", 256).alias("sha"))


def manifest_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """path and change (added, modified, removed) between two manifests."""
    both = before.select("path", F.col("sha").alias("old")).join(after.select("path", F.col("sha").alias("new")), "path", "full_outer")
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "modified")
    return both.select("path", change.alias("change")).where("change is not null")


def benchmark_pairs(rows: DataFrame) -> DataFrame:
    """query and code from the first present of their usual columns; incomplete pairs are left out."""
    first = lambda *names: F.coalesce(*[F.col(n) for n in names if n in rows.columns])
    return rows.select(first("text", "comment", "nl").alias("query"), first("code", "snippet").alias("code")).dropna()


def sampled(rows: DataFrame, group: str, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows of each group, the same ones each time."""
    from pyspark.sql import Window

    order = Window.partitionBy(group).orderBy(F.xxhash64(F.col(key), F.lit(seed)), key)
    return rows.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= n).drop("_n")


def commented(path: Column, query: Column, code: Column) -> Column:
    """A benchmark file: its query as a comment, then its code."""
    sign = F.lit("#")
    for suffix, c in COMMENTS.items():
        sign = F.when(X.suffix(path) == suffix, c).otherwise(sign)
    return F.concat(sign, F.lit(" "), query, F.lit("\n\n"), code, F.lit("\n"))
