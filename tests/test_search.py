import math
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chunkyard import queries
from chunkyard.functions import text as X
from chunkyard.operators import best, bm25, dense, describe, evaluate, fusion, graph
from chunkyard.plans import search as plan

DOCS = [(1, "alpha beta beta"), (2, "alpha gamma"), (3, ""), (4, "delta")]


def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id long, text string")


def test_weights_by_hand(spark):
    d = bm25.tokenized(docs(spark))
    posted, stats = bm25.postings(d), bm25.corpus_stats(d)
    assert stats.first().avgdl == 6 / 4
    w = {(r.doc_id, r.token): r.weight for r in bm25.weights(posted, bm25.idf_table(bm25.document_frequency(posted), stats), stats).collect()}
    idf = math.log(1 + (4 - 1 + 0.5) / 1.5)
    assert w[1, "beta"] == round(idf * 2 * 2.5 / (2 + 1.5 * (0.25 + 0.75 * 3 / 1.5)), 6)


def test_stale_idf_modes(spark):
    old, _ = bm25.refit(None, docs(spark), mode="last_batch")
    batch = spark.createDataFrame([(9, "alpha")], "doc_id long, text string")
    merged = {r.token: r.idf for r in bm25.refit(old, batch, mode="last_batch")[0].collect()}
    before = {r.token: r.idf for r in old.collect()}
    assert merged["beta"] == before["beta"] and merged["alpha"] == pytest.approx(math.log(1 + 0.5 / 1.5))
    both = {r.token: r.idf for r in bm25.refit(old, batch, docs(spark).unionByName(batch))[0].collect()}
    assert both["alpha"] == pytest.approx(math.log(1 + (5 - 3 + 0.5) / 3.5))


def test_sparse_search_leaves_out_documents_without_shared_terms(spark):
    asked = spark.createDataFrame([(0, "alpha beta"), (1, "unknown")], "query_id long, text string")
    found = [(r.query_id, r.rank, r.doc_id) for r in bm25.search(docs(spark), asked, 3).orderBy("query_id", "rank").collect()]
    assert found == [(0, 1, 1), (0, 2, 2)]


def test_both_dense_ways_agree(spark):
    rows = [(i, [float((i * 7 + j * 3) % 11 - 5) for j in range(8)]) for i in range(60)] + [(60, [0.0] * 8)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    asked = vectors.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    take = lambda df: sorted((r.query_id, r.rank, r.vec_id, r.score) for r in df.collect())
    assert take(dense.top_k(vectors, asked, 5)) == take(dense.top_k_sql(vectors, asked, 5))
    assert take(dense.top_k(vectors, asked, 5, block_bytes=64)) == take(dense.top_k_sql(vectors, asked, 5))
    assert dense.top_k(vectors, asked.limit(0), 5).count() == 0


@settings(max_examples=4, deadline=None)
@given(st.permutations(range(6)), st.permutations(range(6)))
def test_fusion_is_symmetric(spark, a, b):
    ranked = lambda order: spark.createDataFrame([(0, d, r + 1, 1.0 / (r + 1)) for r, d in enumerate(order)], "query_id long, doc_id long, rank int, score double")
    take = lambda x, y: [(r.doc_id, r.score) for r in fusion.fuse(ranked(x), ranked(y), 6).orderBy("rank").collect()]
    assert take(a, b) == take(b, a)
    expected = {d: round(1 / (2 + a.index(d)) + 1 / (2 + b.index(d)), 6) for d in range(6)}
    assert dict(take(a, b)) == expected


def chunks(spark):
    rows = [("a", "f.py", "run", "alpha beta", ["b"], []), ("b", "f.py", "help", "gamma", ["c"], ["a"]), ("c", "g.py", "end", "delta", [], ["b"])]
    table = spark.createDataFrame(rows, "id string, file_path string, name string, text string, calls array<string>, called_by array<string>")
    return plan.with_vectors(table.withColumns({"doc_type": F.lit("code"), "language": F.lit("python"), "description": F.lit(None).cast("string"), "repo_url": F.lit("u"), "branch": F.lit("main")}), describe.HashEmbedder(16))


def test_search_expands_and_merges(spark):
    found = plan.search(chunks(spark), plan.SearchRequest("alpha beta", top_k=1, search_mode="sparse")).orderBy("place").collect()
    assert [(r.id, r.expand_reason) for r in found] == [("a", None), ("b", "calls:run")]
    back = plan.search(chunks(spark), plan.SearchRequest("delta", top_k=1, search_mode="sparse", expand_calls=False, called_by_hops=2)).collect()
    assert sorted((r.id, r.expand_reason) for r in back) == [("a", "called_by (hop 2)"), ("b", "called_by (hop 1)"), ("c", None)]
    text = plan.as_text(plan.search(chunks(spark), plan.SearchRequest("alpha", top_k=1, search_mode="sparse"))).orderBy("place").first().block
    assert text.startswith("1. ") and "(score " in text


def test_rerank_and_filter(spark):
    scorer = lambda pdf: pdf["name"].map({"run": 0.1, "help": 0.9})
    asked = plan.SearchRequest("alpha", top_k=2, search_mode="sparse", use_rerank=True, branch="main")
    assert [r.id for r in plan.search(chunks(spark), asked, scorer=scorer).orderBy("place").collect()] == ["b", "a"]
    assert plan.search(chunks(spark), plan.SearchRequest("alpha", search_mode="sparse", branch="other")).count() == 0


def test_requests_are_checked(spark):
    for bad in ({"query": " "}, {"query": "x", "search_mode": "both"}, {"query": "x", "top_k": 0}):
        with pytest.raises(ValueError):
            plan.SearchRequest(**bad)
    with pytest.raises(ValueError):
        plan.search(chunks(spark), plan.SearchRequest("x"))


def test_names_resolve_to_the_last_written(spark):
    rows = [("1", "a.py", "x.f", 1, ["g", "f"]), ("2", "b.py", "f", 1, ["f", "nope"]), ("3", "b.py", "g", 5, ["g"])]
    made = spark.createDataFrame(rows, "id string, file_path string, name string, start_line int, raw array<string>")
    stored = spark.createDataFrame([("g", "old"), ("nope", "9")], "name string, id string")
    edges = sorted((r.src, r.dst) for r in graph.call_edges(made, graph.symbol_table(made, stored)).collect())
    assert edges == [("1", "2"), ("1", "3"), ("2", "9")]
    back = {r.id: r.called_by for r in graph.resolve(made, stored).collect()}
    assert back == {"1": [], "2": ["1"], "3": ["1"]}


def test_hops_stop_in_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "d")], "src string, dst string")
    seeds = spark.createDataFrame([(0, "a"), (1, "d")], "query_id long, id string")
    assert sorted((r.query_id, r.id, r.hop) for r in graph.callers(seeds, edges, 5).collect()) == [(0, "a", 0), (0, "b", 2), (0, "c", 1), (1, "d", 0)]


def test_evaluation(spark):
    r = lambda *xs: [(i + 1, p, n, 1.0) for i, (p, n) in enumerate(xs)]
    rows = [("q1", "py", "a.py", "", "x.f", "A.py", r(("z", "q"), ("src/a.py", "g"))), ("q2", "go", "", "", "y", "b.go", r(("z", "w"))), ("q3", "go", "z", "", "", "c", [])]
    answers = spark.createDataFrame(rows, "query string, language string, expected_file string, expected_name string, target string, target_file string, retrieved array<struct<rank:int,file_path:string,name:string,score:double>>")
    judged = evaluate.judged(answers, evaluate.docstring_match)
    assert [(x.recall, x.mrr, x.hits, x.total) for x in evaluate.metrics(judged).collect()] == [(0.3333, 0.1667, 1, 3)]
    assert {x.language: x.hits for x in evaluate.metrics_by(judged, "language").collect()} == {"overall": 1, "py": 1, "go": 0}
    assert evaluate.metrics(evaluate.judged(answers, evaluate.docstring_match, 1)).first().hits == 0
    assert evaluate.metrics(evaluate.judged(answers, evaluate.file_match)).first().hits == 1
    assert evaluate.metrics(judged.limit(0)).first().total == 0
    assert "| q2 |" in evaluate.report(evaluate.metrics(judged), judged.where("not hit"), "T")


ODD = ["", None, "aB ABc ABCd aBCdE HTTPServer2Go x1Y2 éA Aé the The THE", "fooBar", "A", "Ab", "bC", "C", "ABC", "D", "def", "xxxYZa", "aaB", "Ccc dDD", "E f", "ZZ", "Za", "don't i18n\n__init__", "日本 go 中go"]


def test_counts_of_a_batch_are_those_of_the_expression(spark):
    c = bm25.Counts(pa.array(ODD).slice(1))
    got = {(int(i), c.words[int(t)].as_py(), int(n)) for i, t, n in zip(c.text, c.token, c.tf, strict=True)}
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(ODD[1:])], "doc_id long, text string")
    assert got == {tuple(r) for r in bm25.postings(bm25.tokenized(rows)).select("doc_id", "token", "tf").collect()}
    assert c.length.tolist() == [r.n for r in rows.select("doc_id", F.size(X.tokens(F.col("text"))).alias("n")).orderBy("doc_id").collect()]


def test_counts_are_made_within_rows_and_nothing_is_shuffled_by_document(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)], "doc_id long, text string")
    plan = bm25.counted(rows)._jdf.queryExecution().toString()
    assert "hashpartitioning(doc_id" not in plan and "HashAggregate" not in plan
    assert "hashpartitioning(doc_id" not in bm25.frequencies(rows)._jdf.queryExecution().toString()


@pytest.mark.parametrize("name", ["eval_hits", "oov_query_terms", "document_frequency", "term_frequency", "idf_table"])
def test_queries_cut_no_tokens_into_rows(spark, monkeypatch, name):
    """A row for every token of every document is what took these queries' time and memory."""
    monkeypatch.setattr(X, "tokens", lambda text: pytest.fail("tokens of texts as an array, to be exploded"))
    queries.QUERIES[name](spark, "/root/testdata/sf0.001").write.format("noop").mode("overwrite").save()


def test_rows_of_one_document_are_added_up(spark):
    rows = spark.createDataFrame([(1, "red fox red"), (1, "red fox red"), (1, "one more fox"), (2, "blue fox"), (None, "red"), (None, "red")], "doc_id long, text string")
    expected = sorted(map(tuple, bm25.postings(bm25.tokenized(rows)).collect()), key=str)
    assert sorted(map(tuple, bm25.counted(rows).where(F.col("token") != bm25.MARK).collect()), key=str) == expected
    found, stats = bm25.statistics(bm25.frequencies(rows))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, bm25.document_frequency(bm25.postings(bm25.tokenized(rows))).collect()))
    assert tuple(stats.first()) == tuple(bm25.corpus_stats(bm25.tokenized(rows)).first())


def test_weights_of_frequent_tokens_are_not_shuffled(spark, monkeypatch):
    """The same weights whether all, some or no tokens are sent; nulls, empty texts, keys with several rows and tokens without IDF too."""
    for rows in ([(i, t) for i, t in enumerate(ODD * 3)], [(None, "red"), (1, "red red fox")], [(1, "red fox"), (1, "red fox"), (2, "fox")], [(1, None)]):
        corpus = spark.createDataFrame(rows, "doc_id long, text string")
        tokened = bm25.tokenized(corpus)
        posted, stats = bm25.postings(tokened), bm25.corpus_stats(tokened)
        idf = bm25.idf_table(bm25.document_frequency(posted), stats).where("token <> 'fox'")
        expected = sorted(map(tuple, bm25.weights(posted, idf, stats).collect()), key=str)
        for n in (1, 3, 1000):
            monkeypatch.setattr(bm25, "MOST_SENT", n)
            assert sorted(map(tuple, bm25.weights_of(corpus, idf, stats).collect()), key=str) == expected
    few = spark.createDataFrame([(i, f"red fox w{i}") for i in range(9)], "doc_id long, text string")
    found, stats = bm25.statistics(bm25.frequencies(few))
    monkeypatch.setattr(bm25, "MOST_SENT", 1000)
    plan = bm25.weights_of(few, bm25.idf_table(found, stats), stats)._jdf.queryExecution().toString()
    assert "Join" not in plan and "hashpartitioning" not in plan


def test_search_in_batches_is_the_search_by_joins(spark, monkeypatch):
    """Ties, documents that are left out, queries without tokens, cells and waiting rows in small steps."""
    words = "red green blue fox dog cat sun moon".split()
    rows = [(i, " ".join(words[(i * j + j) % (3 + i % 6)] for j in range(1, 2 + i % 7))) for i in range(300)]
    corpus = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    asked = spark.createDataFrame([(i, f"{words[i % 8]} {words[i % 3]} nowhere") for i in range(20)] + [(90, ""), (91, None), (92, "unseen")], "query_id long, text string")
    for keep in (None, F.col("doc_id") % 3 == 1):
        by = lambda: sorted(map(tuple, bm25.search(corpus, asked, 4, keep).select("query_id", "rank", "doc_id", "score").collect()))
        monkeypatch.undo()
        whole = by()
        monkeypatch.setattr(bm25, "MOST_ASKED", 3)
        joined = by()
        monkeypatch.setattr(bm25, "MOST_ASKED", 1000)
        monkeypatch.setattr(bm25, "CELLS", 64)
        monkeypatch.setattr(best, "WAITING", 1)
        assert whole == joined == by() and len(whole) == 80


def test_best_rows_of_a_task_are_bounded_and_exact():
    rng = np.random.default_rng(1)
    found, rows = best.Best(7, 3, pa.int64()), []
    for _ in range(40):
        query, score, key = rng.integers(0, 7, 50), rng.integers(0, 9, 50) / 4, rng.integers(0, 10**6, 50)
        rows += zip(query.tolist(), score.tolist(), key.tolist(), strict=True)
        found.add(query, score, pa.array(key))
    q, s, k = found.settle()
    expected = [r for i in range(7) for r in sorted((r for r in rows if r[0] == i), key=lambda r: (-r[1], r[2]))[:3]]
    assert list(zip(q.tolist(), s.tolist(), k.to_pylist(), strict=True)) == expected


def test_memory_of_the_dense_search_does_not_grow_with_the_queries(spark):
    """2,000 queries against a batch of 10,000 vectors would be 160 MB of scores at once, and as much again to sort them."""
    rng = np.random.default_rng(2)
    asked, rows = rng.normal(size=(2000, 4)), rng.normal(size=(10_000, 4))
    run = dense.block_of([*range(2000)], asked, 2, pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())]), 6)
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(10_000)), pa.array(list(rows))], names=["vec_id", "embedding"])
    tracemalloc.start()
    out = pa.Table.from_batches(run(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 120e6 and out.num_rows == 4000
    score = (asked / np.linalg.norm(asked, axis=1)[:, None]) @ (rows / np.linalg.norm(rows, axis=1)[:, None]).T
    assert np.allclose(np.sort(np.array(out["score"]).reshape(2000, 2), axis=1), np.sort(score, axis=1)[:, -2:], atol=1e-6)
