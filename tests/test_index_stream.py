import json

import duckdb
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__
from chunkyard.engine import Engine
from chunkyard.plans.search import SearchRequest
from chunkyard.sources import files as sources
from chunkyard.sources import index
from chunkyard.streaming import refresh

JOB = "repo string, seq long, branch string, changed_files array<string>, before_sha string, after_sha string"


def test_upsert_is_idempotent_and_last_wins(spark):
    row = lambda *xs: spark.createDataFrame(list(xs), "point_id string, v int")
    once = index.upserted(row(("a", 1), ("b", 1)), row(("b", 2), ("b", 3), ("c", 1)), order=F.col("v"))
    twice = index.upserted(once, row(("b", 2), ("b", 3), ("c", 1)), order=F.col("v"))
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect())) == [("a", 1), ("b", 3), ("c", 1)]


def test_manifest_diff(spark):
    m = lambda *xs: sources.manifest(spark.createDataFrame(list(xs), "path string, text string"))
    diff = sources.manifest_diff(m(("a", "1"), ("b", "1"), ("c", "1")), m(("b", "2"), ("c", "1"), ("d", "1")))
    assert sorted(map(tuple, diff.collect())) == [("a", "removed"), ("b", "modified"), ("d", "added")]


def test_scan_skips_and_repairs(spark, tmp_path):
    for path, raw in {"a.py": b"x = 1", "node_modules/b.py": b"x", "c.png": b"x", "d.txt": b"\xffab", "e.txt": b"  \n", "sub/f.md": b"# T"}.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_bytes(raw)
    assert sorted((r.path, r.text) for r in sources.scan(spark, str(tmp_path)).collect()) == [("a.py", "x = 1"), ("d.txt", "�ab"), ("sub/f.md", "# T")]


def test_engine_from_files_to_renames(spark, tmp_path):
    url = "https://example.com/some/repo.git"
    engine = Engine(spark, str(tmp_path))
    files = lambda *xs: spark.createDataFrame(list(xs), "path string, text string")
    assert Engine.collection_of(url) == "repo"
    engine.ingest(files(("m.py", "def load_user():\n    return save_user()\n\n\ndef save_user():\n    return 1\n"), ("r.md", "# Notes\nabout users")), url, commit_sha="s1")
    first = engine.index.read("repo")
    assert {r.name for r in first.select("name").collect()} >= {"load_user", "save_user", "section::0"}
    found = engine.search(SearchRequest("load_user", "repo", top_k=1)).orderBy("place").collect()
    assert found[0].name in ("load_user", "[file_context]") and engine.index.collections() == ["repo"]
    changed = spark.createDataFrame([("m.py", "modified"), ("r.md", "removed")], "path string, change string")
    engine.ingest(files(("m.py", "def load_user():\n    return 2\n")), url, commit_sha="s2", changed=changed)
    assert {r.file_path for r in engine.index.read("repo").collect()} == {"m.py"}
    engine.rename_file(url, "m.py", "n.py")
    assert all(r.file_path == "n.py" and r.id.startswith("n.py::") for r in engine.index.read("repo").collect())
    engine.rename_repo(url, "https://example.com/other")
    assert engine.index.collections() == ["other"] and engine.index.read("repo") is None
    engine.index.delete_files("other", spark.createDataFrame([("n.py",)], "p string"))
    assert engine.index.read("other").count() == 0


def merged_by_hand(jobs):
    """The stated rules, over (files, before, after) in order."""
    if len(jobs) == 1:
        return jobs[0]
    if any(f is None for f, _, _ in jobs):
        return None, None, None
    files = list(dict.fromkeys(x for f, _, _ in jobs for x in f))
    return files or None, None, None


@settings(max_examples=4, deadline=None)
@given(st.lists(st.lists(st.tuples(st.one_of(st.none(), st.lists(st.sampled_from("abc"), max_size=3)), st.one_of(st.none(), st.just("s")), st.one_of(st.none(), st.just("t"))), min_size=1, max_size=4), min_size=5, max_size=12))
def test_jobs_merge_as_stated(spark, repos):
    rows = [(f"r{i}", j, f"b{j}", f, b, a) for i, jobs in enumerate(repos) for j, (f, b, a) in enumerate(jobs)]
    made = {r.repo: (r.changed_files, r.before_sha, r.after_sha, r.branch) for r in refresh.coalesce_jobs(spark.createDataFrame(rows, JOB)).collect()}
    for i, jobs in enumerate(repos):
        assert made[f"r{i}"] == (*merged_by_hand(jobs), f"b{len(jobs) - 1}")


def test_gate_and_injection(spark):
    state = spark.createDataFrame([("known", "s0", True), ("begun", None, False)], "repo string, sha string, done boolean")
    jobs = spark.createDataFrame([("known", 1, "m", ["a"], "x", "y"), ("known", 2, "m", [], "x", "y"), ("known", 3, "m", None, None, None), ("new", 1, "m", ["a"], "x", "y"), ("begun", 1, "m", None, "x", "y")], JOB)
    gated = refresh.known_gate(jobs, state)
    assert sorted((r.repo, r.seq, r.changed_files, r.before_sha) for r in gated.collect()) == [("begun", 1, None, None), ("known", 1, ["a"], "x"), ("known", 3, None, None), ("new", 1, None, None)]
    assert {(r.repo, r.seq): r.before_sha for r in refresh.inject_sha(gated, state).collect()}["known", 3] == "s0"
    assert [r.repo for r in refresh.unfinished(state).collect()] == ["begun"]


def test_stream_refreshes_and_restarts(spark, tmp_path):
    source, done = tmp_path / "in", []
    source.mkdir()

    def push(seq, name, files):
        body = {"repository": {"clone_url": name}, "ref": "refs/heads/dev", "before": "b", "after": "a", "commits": [{"added": files, "modified": [], "removed": ["gone"]}]}
        (source / f"{seq}.json").write_text(json.dumps({"seq": seq, "provider": "one", "event": "push", "body": json.dumps(body)}) + "\n")

    def work(jobs):
        rows = jobs.collect()
        done.append(sorted((r.repo, r.branch, r.changed_files) for r in rows))
        return spark.createDataFrame([(r.repo, "a") for r in rows], "repo string, sha string")

    def run():
        events = spark.readStream.schema("seq long, provider string, event string, body string").json(str(source))
        refresher = refresh.Refresher(spark, str(tmp_path / "state"), work)
        query = refresher.start(events, str(tmp_path / "ck"))
        query.awaitTermination()
        return {r.repo: (r.sha, r.done) for r in refresher.state().collect()}

    push(1, "r1", ["x"])
    push(2, "r1", ["y"])
    assert run() == {"r1": ("a", True)} and done == [[("r1", "dev", None)]]
    push(3, "r1", ["z"])
    push(4, "r1", ["x", "z"])
    push(5, "r2", ["q"])
    assert run() == {"r1": ("a", True), "r2": ("a", True)}
    assert done[1] == [("r1", "dev", ["z", "x"]), ("r2", "dev", None)]


def test_second_provider_gives_a_job_a_change(spark):
    change = lambda n: {"new": {"name": n, "target": {"hash": f"n{n}"}}, "old": {"target": {"hash": "o"}}}
    body = {"repository": {"full_name": "team/r"}, "push": {"changes": [change("m"), change("d")]}}
    events = spark.createDataFrame([(1, "two", "repo:push", json.dumps(body)), (2, "two", "issue", json.dumps(body))], "seq long, provider string, event string, body string")
    assert sorted((r.repo, r.branch, r.before_sha, r.after_sha) for r in refresh.parse_pushes(events).collect()) == [("team/r", "d", "o", "nd"), ("team/r", "m", "o", "nm")]


def test_sessions_and_windows(spark):
    rows = [(1, "2024-01-01 00:00:00", "a", 1.0), (1, "2024-01-01 00:29:59", "a", 2.0), (1, "2024-01-01 01:00:00", "b", 3.0)]
    events = spark.createDataFrame(rows, "u int, t string, event_type string, value double").withColumn("ts", F.to_timestamp("t"))
    assert sorted((r.session, r.n) for r in refresh.idle_sessions(events, "u", "ts").collect()) == [(0, 2), (1, 1)]
    assert sorted((r.event_type, r.n, r.total) for r in refresh.tumbling_counts(events).collect()) == [("a", 2, 3.0), ("b", 1, 3.0)]


def test_files_of_a_job_alone_are_named_once(spark, tmp_path):
    """Repositories of one, two and three jobs against the registered SQL; 106 and 211 name one file twice, 97 and 194 none."""
    rows = [(i, i // n + 1000 * n, "push") for n in (1, 2, 3) for i in (*range(60 * n, 60 * n + 30), 97, 106, 194, 211)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    named = "repo n_jobs branch files before_sha".split()
    theirs = db.execute(f"SELECT {', '.join(named)} FROM ({__spark_entry__.oracle_sql()['job_coalesce']})").fetchall()
    mine = [tuple(r) for r in __spark_entry__.queries()["job_coalesce"](spark, str(tmp_path)).select(*named).collect()]
    assert sorted(mine, key=str) == sorted(theirs, key=str)
