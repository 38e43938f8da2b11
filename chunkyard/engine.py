"""The engine's public face: ingest, search, refresh, rename, evaluate."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkyard.functions import text as X
from chunkyard.operators import bm25, describe
from chunkyard.plans import ingest, search
from chunkyard.session import written
from chunkyard.sources import files as sources
from chunkyard.sources.index import Index, name_map
from chunkyard.streaming.refresh import JOB, Refresher, unfinished


class Engine:
    """``embedder`` is an expression (``column``) or a call from texts to vectors; ``describer`` answers prompts; ``scorer`` re-ranks.

    Each version of a collection has its sparse model beside it: postings sorted by token, IDF and statistics.
    """

    def __init__(self, spark: SparkSession, root: str, embedder=None, describer: Callable[[str], str] | None = None, scorer: Callable | None = None):
        self.spark, self.index, self.embedder, self.describer, self.scorer = spark, Index(spark, f"{root}/index"), embedder or describe.HashEmbedder(), describer, scorer
        self.models, self.states = f"{root}/models", f"{root}/state"

    @staticmethod
    def collection_of(repo_url: str) -> str:
        last = repo_url.split("@")[-1].rstrip("/").split("/")[-1].replace(".git", "")
        return "".join(c if c.isascii() and (c.isalnum() or c in "_-") else "_" for c in last)

    def ingest(self, files: DataFrame | str, repo_url: str, branch: str = "main", commit_sha: str = "", changed: DataFrame | None = None, describe_chunks: bool = False, mode: str = "replace", collection: str | None = None) -> int:
        """Index files (a table of path and text, or a folder): whole, or only ``changed`` (path, change), or ``upsert_only``."""
        collection = collection or self.collection_of(repo_url)
        found = sources.scan(self.spark, files) if isinstance(files, str) else files
        old = self.index.read(collection) if changed is not None else None
        if changed is not None and old is not None:
            found = found.join(changed.where("change <> 'removed'").select("path"), "path", "left_semi")
            old = old.join(changed.select(F.col("path").alias("file_path")), "file_path", "left_anti")
        describer = (lambda c: describe.describe(c, self.describer)) if describe_chunks else None
        chunks = search.with_vectors(ingest.build(found, repo_url, branch, commit_sha, old, describer=describer), self.embedder)
        if old is not None:
            version = self.index.upsert(collection, chunks, changed.select("path"), self.save_model)
        elif mode == "upsert_only":
            version = self.index.upsert(collection, chunks, finish=self.save_model)
        else:
            version = self.index.replace(collection, self.index_rows(chunks, collection), self.save_model)
        return version

    @staticmethod
    def index_rows(chunks: DataFrame, collection: str) -> DataFrame:
        from chunkyard.sources.index import with_point_ids

        return with_point_ids(chunks, collection)

    def save_model(self, collection: str, version: int, chunks: DataFrame) -> None:
        """The sparse model of a version, written before the version is pointed to."""
        posted, stats = bm25.staged(bm25.tokenized(chunks, "id"), "id")
        idf, path = bm25.idf_table(bm25.document_frequency(posted), stats), self._model_path(collection, version)
        posted.repartitionByRange("token").sortWithinPartitions("token", "id").write.mode("overwrite").parquet(f"{path}/postings")
        idf.repartitionByRange("token").sortWithinPartitions("token").write.mode("overwrite").parquet(f"{path}/vocab")
        stats.withColumns({"k1": F.lit(X.K1), "b": F.lit(X.B)}).write.mode("overwrite").parquet(f"{path}/stats")

    def _model_path(self, collection: str, version: int) -> str:
        return f"{self.models}/{collection}/v{version:06d}"

    def model(self, collection: str) -> search.Model | None:
        """The stored model of the version pointed to; None for a version that was written without one."""
        version = self.index.version(collection)
        if version is None or not self.index.exists(f"{self._model_path(collection, version)}/stats/_SUCCESS"):
            return None
        read = lambda name: self.spark.read.parquet(f"{self._model_path(collection, version)}/{name}")
        return search.Model(read("postings"), read("vocab"), read("stats"))

    def query_vector(self, query: str) -> list[float]:
        """Only what is embedded gets the instruction."""
        if not hasattr(self.embedder, "column"):
            return [float(x) for x in self.embedder([X.INSTRUCTION + query])[0]]
        asked = self.spark.createDataFrame([(query,)], "q string").select(self.embedder.column(X.instructed(F.col("q"))).alias("v"))
        return [float(x) for x in asked.first().v]

    def search(self, request: search.SearchRequest) -> DataFrame:
        chunks = self.index.read(request.collection)
        if chunks is None:
            raise KeyError(request.collection)
        vector = self.query_vector(request.query) if request.search_mode != "sparse" else None
        return search.search(chunks, request, vector, self.scorer, self.model(request.collection))

    def respond(self, request: search.SearchRequest) -> dict:
        """results (a table), count, and sources: how many were found, and how many reached along calls."""
        results = written(self.search(request), "results")
        return {"results": results, **search.counts(results, request)}

    def name_map(self, collection: str) -> DataFrame:
        return name_map(self.index.read(collection))

    def rename_file(self, repo_url: str, old_path: str, new_path: str) -> int:
        return self.index.rename_file(self.collection_of(repo_url), old_path, new_path, self.save_model)

    def rename_repo(self, old_url: str, new_url: str) -> int:
        return self.index.rename_repo(self.collection_of(old_url), self.collection_of(new_url), new_url, self.save_model)

    def delete_files(self, repo_url: str, paths: DataFrame) -> int | None:
        return self.index.delete_files(self.collection_of(repo_url), paths, self.save_model)

    def snapshot(self, collection: str) -> DataFrame:
        return written(self.index.read(collection), collection)

    def trigger(self, events_dir: str, repo_url: str, branch: str = "main", changed_files: list[str] | None = None, before_sha: str = "", after_sha: str = "", full: bool = True) -> None:
        """Put a job by hand where the stream of push events is read; a full one names neither files nor commits."""
        job = (repo_url, branch, None if full else changed_files, None if full else before_sha, None if full else after_sha)
        self.spark.createDataFrame([job], JOB).select(F.lit("manual").alias("provider"), F.lit("trigger").alias("event"), F.current_timestamp().cast("double").alias("at"), F.to_json(F.struct("*")).alias("body")).write.mode("append").json(events_dir)

    def refresher(self, files_of: Callable[[str, str], DataFrame | str | None]) -> Refresher:
        """The streaming loop over this engine.  ``files_of`` gives a repository's files at a branch (a table or a folder), alone or
        with their commit, or None where there are none; such a repository stays unfinished."""

        def refresh(todo: DataFrame) -> DataFrame:
            done = []
            for job in todo.toLocalIterator():  # a row a repository of the batch; each is a job of its own over the cluster
                files, commit = self._checked_out(files_of(job.repo, job.branch), job.after_sha)
                if files is None:
                    continue
                names = job.changed_files
                changed = None if names is None else self.spark.createDataFrame([(n, "modified") for n in names], "path string, change string")
                self.ingest(files, job.repo, job.branch, commit or "", changed)
                done.append((job.repo, commit))
            return self.spark.createDataFrame(done, "repo string, sha string")

        def delete(gone: DataFrame) -> None:
            for r in gone.select("repo").distinct().toLocalIterator():
                self.delete_files(r.repo, gone.where(F.col("repo") == r.repo).select("file_path"))

        return Refresher(self.spark, self.states, refresh, delete)

    @staticmethod
    def _checked_out(found, commit: str | None) -> tuple:
        return found if isinstance(found, tuple) else (found, commit)

    def recover(self, files_of: Callable[[str, str], DataFrame | str | None]) -> list[str]:
        """Run again, in full, what was begun and not done; the repositories that are done now."""
        loop, done = self.refresher(files_of), []
        for r in unfinished(loop.state()).toLocalIterator():
            files, commit = self._checked_out(files_of(r.repo, "main"), r.sha)
            if files is not None:
                self.ingest(files, r.repo, commit_sha=commit or "")
                done.append((r.repo, commit))
        loop.record(self.spark.createDataFrame(done, "repo string, sha string"))
        return [repo for repo, _ in done]
