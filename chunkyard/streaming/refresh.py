"""Push events to an index that is kept fresh: parsing, job coalescing, state, the streaming loop.

A micro-batch is what the reference system's worker drains from a repository's queue.  Jobs of one
repository are merged by aggregation; all repositories of a batch are refreshed in one pass.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chunkyard.functions import text as X
from chunkyard.schema import COMMIT_STATE, PUSH_ONE, PUSH_TWO
from chunkyard.session import written

NO_FILES = "array<string>"
#: A job that is put in by hand.
JOB = "repo string, branch string, changed_files array<string>, before_sha string, after_sha string"


def _files(commits: Column, *kinds: str) -> Column:
    """Distinct files of these kinds over all commits, in order."""
    each = F.transform(commits, lambda c: F.flatten(F.filter(F.array(*[c[k] for k in kinds]), lambda a: a.isNotNull())))
    return F.array_distinct(F.flatten(F.coalesce(each, F.array().cast("array<array<string>>"))))


def parse_pushes(events: DataFrame) -> DataFrame:
    """Jobs from events (seq, provider: one or two, event, body): repo, seq, branch, changed_files, removed_files, before_sha, after_sha.

    The first kind names its files; of the second, each change is a job with a range of commits; "manual" ones are jobs as they are.
    """
    pushes = events.where(F.col("event").isin("push", "repo:push", "trigger"))
    one = pushes.where("provider = 'one'").select("seq", F.from_json("body", PUSH_ONE).alias("b"))
    one = one.select(
        F.col("b.repository.clone_url").alias("repo"), "seq", X.branch_of(F.coalesce("b.ref", F.lit(""))).alias("branch"), _files(F.col("b.commits"), "added", "modified").alias("changed_files"),
        _files(F.col("b.commits"), "removed").alias("removed_files"), F.col("b.before").alias("before_sha"), F.col("b.after").alias("after_sha"),
    )
    two = pushes.where("provider = 'two'").select("seq", F.from_json("body", PUSH_TWO).alias("b"))
    two = two.select("seq", F.coalesce("b.repository.links.html.href", "b.repository.full_name").alias("repo"), F.explode("b.push.changes").alias("c"))
    none = F.lit(None).cast(NO_FILES)
    two = two.select("repo", "seq", F.coalesce("c.new.name", F.lit("main")).alias("branch"), none.alias("changed_files"), F.array().cast(NO_FILES).alias("removed_files"), F.col("c.old.target.hash").alias("before_sha"), F.col("c.new.target.hash").alias("after_sha"))
    by_hand = pushes.where("provider = 'manual'").select("seq", F.from_json("body", JOB).alias("b")).select("b.repo", "seq", F.coalesce("b.branch", F.lit("main")).alias("branch"), "b.changed_files", F.array().cast(NO_FILES).alias("removed_files"), "b.before_sha", "b.after_sha")
    return one.unionByName(two).unionByName(by_hand)


def read_events(spark: SparkSession, path: str, stream: bool = True) -> DataFrame:
    """Events (JSON lines of provider, event, at, body) from a folder, in order of ``at`` as ``seq``."""
    reader = (spark.readStream if stream else spark.read).schema("provider string, event string, at double, body string")
    return reader.json(path).withColumn("seq", (F.coalesce("at", F.lit(0.0)) * 1_000_000).cast("long"))


def known_gate(jobs: DataFrame, state: DataFrame) -> DataFrame:
    """Jobs of repositories without a successful commit on record become full; jobs without anything to do are left out."""
    known = state.where("sha is not null").select("repo").distinct().withColumn("known", F.lit(True))
    gated = jobs.join(known, "repo", "left").withColumn("known", F.coalesce("known", F.lit(False)))
    idle = F.col("known") & F.col("changed_files").isNotNull() & (F.size("changed_files") == 0)
    full = ~F.col("known")
    return gated.where(~idle).withColumns({"changed_files": F.when(~full, F.col("changed_files")), "before_sha": F.when(~full, F.col("before_sha")), "after_sha": F.when(~full, F.col("after_sha"))}).drop("known")


def coalesce_jobs(jobs: DataFrame, repo: str = "repo", order: str = "seq") -> DataFrame:
    """One job a repository: n_jobs, the last one's branch, and the files of all in order, each once.

    One job stays as it is.  Of several, no files and no range in one make all of them full, and so
    does a range; merged jobs have no range, and no files at all mean full.
    """
    files, ranged = F.col("changed_files"), F.coalesce("before_sha", F.lit("")) != ""
    grouped = jobs.groupBy(repo).agg(
        F.count(F.lit(1)).alias("n_jobs"),
        F.max_by(F.struct("branch", "changed_files", "before_sha", "after_sha"), F.col(order)).alias("last"),
        F.max(files.isNull() & ~ranged).alias("any_full"),
        F.max(files.isNull() & ranged).alias("any_range"),
        F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.when(files.isNotNull(), F.struct(F.col(order).alias("o"), files.alias("f"))))), lambda x: x["f"]))).alias("files"),
    )
    alone = F.col("n_jobs") == 1
    merged = F.when(~F.col("any_full") & ~F.col("any_range") & (F.size("files") > 0), F.col("files"))
    return grouped.select(
        repo,
        "n_jobs",
        F.col("last.branch").alias("branch"),
        F.when(alone, F.col("last.changed_files")).otherwise(merged).alias("changed_files"),
        F.when(alone, F.col("last.before_sha")).alias("before_sha"),
        F.when(alone, F.col("last.after_sha")).alias("after_sha"),
    )


def inject_sha(jobs: DataFrame, state: DataFrame) -> DataFrame:
    """The last successful commit as the start of jobs that have neither files nor a start."""
    last = state.where("sha is not null").groupBy("repo").agg(F.max("sha").alias("last_sha"))
    need = F.col("changed_files").isNull() & (F.coalesce("before_sha", F.lit("")) == "")
    return jobs.join(last, "repo", "left").withColumn("before_sha", F.when(need, F.coalesce("last_sha", "before_sha")).otherwise(F.col("before_sha"))).drop("last_sha")


def started(state: DataFrame, jobs: DataFrame) -> DataFrame:
    """State with the jobs' repositories marked as not done; their commits stay."""
    return _put(state, jobs.join(state.select("repo", "sha"), "repo", "left").select("repo", "sha", F.lit(False).alias("done")))


def finished(state: DataFrame, done: DataFrame) -> DataFrame:
    """State with repositories (repo, sha) marked as done."""
    return _put(state, done.select("repo", "sha", F.lit(True).alias("done")))


def _put(state: DataFrame, new: DataFrame) -> DataFrame:
    return state.join(new.select("repo"), "repo", "left_anti").unionByName(new)


def unfinished(state: DataFrame) -> DataFrame:
    """What to recover after a crash: begun and not done."""
    return state.where(~F.col("done")).select("repo", "sha")


def logged(jobs: DataFrame, path: str) -> None:
    """Append the jobs to a log of JSON lines, each with the time it was put there."""
    jobs.select(F.to_json(F.struct(*jobs.columns), {"ignoreNullFields": "false"}).alias("job"), F.unix_micros(F.current_timestamp()).alias("at")).write.mode("append").json(path)


def remaining(log: DataFrame, done: DataFrame) -> DataFrame:
    """What is left of a log (job, at) without the jobs that are done, compared by value."""
    return log.join(done.select(F.to_json(F.struct(*done.columns), {"ignoreNullFields": "false"}).alias("job")), "job", "left_anti")


def pending(depths: DataFrame) -> DataFrame:
    """Repositories that have jobs waiting."""
    return depths.where("pending > 0")


def queue_depth(jobs: DataFrame, repo: str = "repo") -> DataFrame:
    return jobs.groupBy(repo).agg(F.count(F.lit(1)).alias("pending"))


def idle_sessions(events: DataFrame, key: str, at: str, gap_minutes: int = 30) -> DataFrame:
    """A worker's life: from an event until none came for the gap.  key, session (from 0), first, last, n."""
    own = Window.partitionBy(key).orderBy(at)
    gap = F.unix_micros(F.col(at).cast("timestamp")) - F.unix_micros(F.lag(at).over(own).cast("timestamp"))
    marked = events.withColumn("_new", F.coalesce((gap >= gap_minutes * 60_000_000).cast("int"), F.lit(0)))
    numbered = marked.withColumn("session", F.sum("_new").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(key, "session").agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count(F.lit(1)).alias("n"))


def tumbling_counts(events: DataFrame, at: str = "ts", kind: str = "event_type", width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events of each kind by window of event time; for streams and tables alike.  An extension: the reference has no event time."""
    timed = events.withColumn(at, F.col(at).cast("timestamp"))
    timed = timed.withWatermark(at, late) if events.isStreaming else timed
    return timed.groupBy(F.window(at, width).alias("w"), kind).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), kind, "n", "total")


class Refresher:
    """The streaming loop: ``refresh`` gets the merged jobs and gives repo and sha of what it finished."""

    def __init__(self, spark: SparkSession, state_path: str, refresh: Callable[[DataFrame], DataFrame], delete: Callable[[DataFrame], None] | None = None):
        self.spark, self.state_path, self.refresh, self.delete = spark, state_path.rstrip("/"), refresh, delete

    def _last(self) -> str | None:
        """The newest state whose write completed."""
        jvm = self.spark._jvm
        new = jvm.org.apache.hadoop.fs.Path
        fs = new(self.state_path).getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in fs.listStatus(new(self.state_path))] if fs.exists(new(self.state_path)) else []
        done = [n for n in names if n.startswith("s") and fs.exists(new(f"{self.state_path}/{n}/_SUCCESS"))]
        return max(done, key=lambda n: (n[:13], int(n[14:])), default=None)

    def state(self) -> DataFrame:
        last = self._last()
        return self.spark.read.schema(COMMIT_STATE).parquet(f"{self.state_path}/{last}") if last else self.spark.createDataFrame([], COMMIT_STATE)

    def _write(self, state: DataFrame, batch: int, step: int) -> None:
        """The state is a row a repository; each step writes a folder of its own, so a batch can be run again."""
        state.write.mode("overwrite").parquet(f"{self.state_path}/s{batch:012d}-{step}")

    def record(self, done: DataFrame) -> None:
        """Mark repositories (repo, sha) as done outside a batch: after the last batch's state, and before the next one's."""
        state = written(finished(self.state(), done), "state")
        last = self._last()
        self._write(state, int(last[1:13]) if last else 0, 2 + (int(last[14:]) if last else 0))

    def batch(self, events: DataFrame, number: int) -> None:
        jobs = written(parse_pushes(events), "jobs")
        if self.delete is not None:  # before anything new is put in
            self.delete(jobs.select("repo", F.explode("removed_files").alias("file_path")).distinct())
        state = self.state()
        todo = written(inject_sha(coalesce_jobs(known_gate(jobs.drop("removed_files"), state)), state), "todo")
        self._write(started(state, todo), number, 0)
        self._write(finished(self.state(), self.refresh(todo)), number, 1)

    def start(self, events: DataFrame, checkpoint: str, **trigger):
        return events.writeStream.foreachBatch(self.batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
