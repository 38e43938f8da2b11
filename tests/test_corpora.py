"""Benchmark corpora, JSON tables, result files, the stored model, triggers, recovery, the command line."""

import json

import pytest
from pyspark.sql import functions as F

from chunkyard import __main__ as command_line
from chunkyard import session
from chunkyard.engine import Engine
from chunkyard.operators import bm25, evaluate
from chunkyard.plans import search as plan
from chunkyard.sources import corpora
from chunkyard.sources import files as sources
from chunkyard.streaming import refresh


def test_json_tables(spark, tmp_path):
    (tmp_path / "corpus.json").write_text(json.dumps([{"chunk_id": "Py_0000", "language": "Py", "query": "q", "code": "c", "file_path": "Py/x.py"}, {"chunk_id": "Py_0001"}]))
    rows = corpora.read_json(spark, str(tmp_path / "corpus.json"), corpora.CORPUS).orderBy("chunk_id").collect()
    assert [(r.chunk_id, r.code) for r in rows] == [("Py_0000", "c"), ("Py_0001", None)]
    (tmp_path / "results.json").write_text(json.dumps({"config": {"k": 5}, "results": [{"query": "a", "expected_file": "f", "expected_name": "n", "hit": False, "hit_rank": None, "retrieved": [{"rank": 1, "file_path": "g", "name": "m", "score": 0.5}]}]}))
    answers = corpora.read_json(spark, str(tmp_path / "results.json"), corpora.ANSWERS, "results").collect()
    assert len(answers) == 1 and answers[0].retrieved[0].name == "m" and answers[0].hit is False
    (tmp_path / "vocab.json").write_text(json.dumps({"k1": 1.5, "b": 0.75, "avgdl": 8.5, "next_id": 2, "vocab": {"aa": 0, "bb": 1}, "idf": {"0": 1.25, "1": 0.5}}))
    v = corpora.read_json(spark, str(tmp_path / "vocab.json"), corpora.VOCABULARY).first()
    assert v.vocab == {"aa": 0, "bb": 1} and v.idf["0"] == 1.25
    (tmp_path / "commits.json").write_text(json.dumps({"r1": {"sha": "abc", "done": True}, "r2": {"sha": None}}))
    assert sorted(map(tuple, corpora.commit_table(spark, str(tmp_path / "commits.json")).collect())) == [("r1", "abc", True), ("r2", None, False)]


def test_shards_fall_back_to_another_split(spark, tmp_path):
    rows = spark.createDataFrame([("find the sum", "def s(): pass"), (" two ", "x"), (None, "y"), ("z", None)], "text string, code string")
    rows.coalesce(1).write.parquet(str(tmp_path / "Python/train/0001.parquet"))
    assert corpora.read_shards(spark, str(tmp_path), "Java") is None
    found = corpora.read_shards(spark, str(tmp_path), "Python")
    assert found.count() == 4
    made = corpora.corpus(found, "Python", ".py", 5)
    assert [(r.chunk_id, r.file_path) for r in made.orderBy("chunk_id").collect()] == [("Python_0000", "Python/Python_0000.py"), ("Python_0001", "Python/Python_0001.py")]
    assert {r.query for r in made.collect()} == {"find the sum", "two"} and sorted(made.collect()) == sorted(corpora.corpus(found.repartition(3), "Python", ".py", 5).collect())
    corpora.write_files(corpora.corpus_files(made), str(tmp_path / "repo"))
    back = {r.path: r.text for r in sources.scan(spark, str(tmp_path / "repo")).collect()}
    assert set(back) == {"Python/Python_0000.py", "Python/Python_0001.py"} and all(t.startswith("# ") and t.endswith("\n") for t in back.values())
    with pytest.raises(Exception, match="outside"):
        corpora.write_files(spark.createDataFrame([("../x", "t")], "path string, text string"), str(tmp_path / "repo"))
    other = spark.createDataFrame([("n", "c1")], "nl string, snippet string")
    assert [tuple(r) for r in sources.benchmark_pairs(other).collect()] == [("n", "c1")]


def test_evaluation_files(spark, tmp_path):
    retrieved = [(1, "a/f.py", "m", 0.5)]
    rows = spark.createDataFrame([("q1", "f.py", "", "py", retrieved), ("q2", "zz", "", "go", retrieved), ("q3", "zz", "", "go", [])], f"query string, expected_file string, expected_name string, language string, retrieved {corpora.RETRIEVED}")
    corpora.write_evaluation(evaluate.judged(rows, evaluate.docstring_match), {"top_k": 5}, str(tmp_path / "out"), "language")
    read = lambda name: spark.read.json(str(tmp_path / "out" / name))
    assert {(r.language, r.recall, r.hits, r.total) for r in read("metrics").collect()} == {("overall", 0.3333, 1, 3), ("py", 1.0, 1, 1), ("go", 0.0, 0, 2)}
    assert sorted(r.query for r in read("false_hits").collect()) == ["q2", "q3"] and read("results").count() == 3 and read("config").first().top_k == "5"


def test_documented_rows_and_first_repositories(spark):
    rows = spark.createDataFrame([(1, "r2", " "), (2, "r1", "doc"), (3, "r2", "doc"), (4, "r1", None), (5, "r3", "doc"), (6, "r4", "doc")], "n int, repo string, doc string")
    kept = corpora.documented(rows, F.col("doc"), "n", 3)
    assert [r.n for r in kept.orderBy("n").collect()] == [2, 3, 5]
    assert [r.repo for r in corpora.first_repositories(rows, "repo", "n").orderBy("first").collect()] == ["r2", "r1", "r3"]


FILES = [("a/m.py", "def alpha():\n    return beta()\n"), ("b.js", "function beta() { return gamma(); }\n"), ("c.md", "# Alpha notes\nwords about alpha and delta\n")]


def engine(spark, root, files=FILES, **more):
    e = Engine(spark, str(root), **more)
    e.ingest(spark.createDataFrame(files, "path string, text string"), "https://example.com/shop.git", commit_sha="c1")
    return e


def test_the_stored_model_searches_as_the_texts_do(spark, tmp_path):
    e = engine(spark, tmp_path)
    request = plan.SearchRequest("alpha delta unknownword", "shop", 3, search_mode="sparse", expand_calls=False)
    stored = [(r.id, r.score) for r in e.search(request).orderBy("place").collect()]
    direct = [(r.id, r.score) for r in plan.search(e.index.read("shop"), request).orderBy("place").collect()]
    assert stored == direct and stored
    assert e.search(plan.SearchRequest("alpha", "shop", 3, branch="other", search_mode="sparse")).count() == 0
    answer = e.respond(plan.SearchRequest("alpha", "shop", 2))
    assert answer["count"] == answer["sources"]["vector"] + answer["sources"]["expanded"] == answer["results"].count() and answer["sources"]["search_mode"] == "hybrid"
    assert e.respond(plan.SearchRequest("alpha", "shop", 2, repo_url="none"))["sources"] == {}
    assert "token" in e.model("shop").postings.columns and any(r.calls for r in e.index.read("shop").where("name = 'alpha'").collect())
    with pytest.raises(ValueError, match="corpus"):
        bm25.refit(None, e.index.read("shop"))


def test_a_model_embedder_gets_the_instruction_for_queries_only(spark, tmp_path):
    asked = []

    def call(batch):
        asked.extend(batch)
        return [[float(len(t)), 1.0] for t in batch]

    e = engine(spark, tmp_path, embedder=call)
    e.search(plan.SearchRequest("where is alpha", "shop", 1, search_mode="dense")).collect()
    assert [t for t in asked if t.endswith("where is alpha")] == ["Represent this code search query for retrieving relevant code: where is alpha"]
    with pytest.raises(ValueError, match="dimensions"):
        Engine(spark, str(tmp_path)).ingest(spark.createDataFrame(FILES, "path string, text string"), "https://example.com/shop.git")


def test_two_writers_do_not_share_a_version(spark, tmp_path):
    e = engine(spark, tmp_path)
    (tmp_path / "index/shop/writing-000002").touch()
    with pytest.raises(RuntimeError, match="version 2"):
        e.rename_file("https://example.com/shop.git", "c.md", "d.md")
    assert e.index.version("shop") == 1 and e.index.everything().select("collection").distinct().count() == 1
    e.index.export_text(None, str(tmp_path / "text"))
    assert spark.read.text(str(tmp_path / "text")).where("value like '%delta%'").count() == 1


def test_trigger_refresh_and_recovery(spark, tmp_path):
    e, url = engine(spark, tmp_path), "https://example.com/shop.git"
    files = spark.createDataFrame([*FILES, ("new.py", "def fresh():\n    pass\n")], "path string, text string")
    e.trigger(str(tmp_path / "events"), url)
    missing = e.refresher(lambda repo, branch: None)
    missing.batch(refresh.read_events(spark, str(tmp_path / "events"), stream=False), 0)
    assert [tuple(r) for r in refresh.unfinished(missing.state()).collect()] == [(url, None)]
    assert e.recover(lambda repo, branch: (files, "c2")) == [url] and refresh.unfinished(missing.state()).count() == 0
    assert e.index.read("shop").where("name = 'fresh'").count() == 1
    jobs = spark.createDataFrame([(url, "main", ["c.md"], None, "c3")], refresh.JOB)
    jobs.select(F.lit("manual").alias("provider"), F.lit("trigger").alias("event"), F.lit(1.0).alias("at"), F.to_json(F.struct("*")).alias("body")).write.json(str(tmp_path / "more"))
    changed = spark.createDataFrame([("c.md", "# Alpha notes\nrewritten\n")], "path string, text string")
    e.refresher(lambda repo, branch: changed).start(refresh.read_events(spark, str(tmp_path / "more")), str(tmp_path / "checkpoint")).awaitTermination(120)
    assert e.index.read("shop").where("text like '%rewritten%'").count() == 1 and e.index.read("shop").where("name = 'fresh'").count() == 1


def test_job_log_and_queues(spark, tmp_path):
    jobs = spark.createDataFrame([("r1", "main", ["a"], None, "x"), ("r2", "main", None, None, None)], refresh.JOB)
    refresh.logged(jobs, str(tmp_path / "log"))
    log = spark.read.schema("job string, at long").json(str(tmp_path / "log"))
    assert log.count() == 2 and "r2" in refresh.remaining(log, jobs.where("repo = 'r1'")).first().job
    depths = spark.createDataFrame([("r1", 2), ("r2", 0)], "repo string, pending long")
    assert [r.repo for r in refresh.pending(depths).collect()] == ["r1"]
    assert plan.health(depths, refresh.queue_depth(jobs)) == {"collections": {"r1": 2, "r2": 0}, "pending": {"r1": 1, "r2": 1}}


def test_command_line_and_commits(spark, tmp_path, capsys):
    repo = tmp_path / "repo"
    for path, text in FILES:
        (repo / path).parent.mkdir(parents=True, exist_ok=True)
        (repo / path).write_text(text)
    (repo / ".git/refs/heads").mkdir(parents=True)
    (repo / ".git/HEAD").write_text("ref: refs/heads/main\n")
    (repo / ".git/refs/heads/main").write_text("feed\n")
    assert sources.head_commit(str(repo)) == "feed" and sources.head_commit(str(tmp_path)) is None
    root = ["--root", str(tmp_path / "index")]
    assert command_line.main([*root, "ingest", str(repo), "--repo", "https://example.com/shop.git", "--skip-descriptions"], spark) == 0
    command_line.main([*root, "search", "alpha", "--collection", "shop", "--mode", "sparse"], spark)
    command_line.main([*root, "collections"], spark)
    out = capsys.readouterr().out
    assert "version 1 of shop" in out and "1. " in out and out.rstrip().endswith("shop")
    assert [r.path for r in sources.walk_order(sources.scan(spark, str(repo))).collect()] == ["a/m.py", "b.js", "c.md"]
    assert Engine(spark, str(tmp_path / "index")).index.read("shop").first().commit_sha == "feed"


def test_scratch_is_one_folder_and_goes_as_one(spark, tmp_path, monkeypatch):
    assert session.shared_dir(spark).endswith(f"/chunkyard/{spark.sparkContext.applicationId}")
    monkeypatch.setattr(session, "shared_dir", lambda s: f"{tmp_path}/shared")
    assert session.written(spark.range(3), "x").count() == 3 and (tmp_path / "shared").exists()
    assert session.discard(spark) and not session.discard(spark) and not (tmp_path / "shared").exists()


def test_tables_of_few_files_are_dealt_out(spark, tmp_path):
    spark.range(10).coalesce(1).write.parquet(str(tmp_path / "one"))
    spark.range(10).repartition(4).write.parquet(str(tmp_path / "many"))
    spread = [session.spread(spark.read.parquet(str(tmp_path / n)))._jdf.queryExecution().toString() for n in ("one", "many")]
    assert "RoundRobinPartitioning" in spread[0] and "RoundRobinPartitioning" not in spread[1]
