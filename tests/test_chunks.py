import json

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chunkyard.operators import lines, symbols
from chunkyard.plans import ingest


def files(spark, texts):
    return spark.createDataFrame([(f"f{i}", t) for i, t in enumerate(texts)], "path string, text string")


def got(df):
    return sorted((r.path, r.start_line, r.name, r.text) for r in df.collect())


@settings(max_examples=5, deadline=None)
@given(st.lists(st.integers(0, 60), min_size=5, max_size=10), st.integers(2, 12), st.integers(0, 5))
def test_windows_cover_every_line(spark, sizes, window, overlap):
    overlap = min(overlap, window - 1)
    texts = ["\n".join(f"line{j}" for j in range(n)) for n in sizes]
    made = got(lines.sliding_windows(files(spark, texts), window, overlap))
    expected = [(f"f{i}", s, f"chunk::{s}", "\n".join(t.splitlines()[s : s + window])) for i, t in enumerate(texts) for s in range(0, len(t.splitlines()), window - overlap)]
    assert made == sorted(expected)


def test_default_window_sizes(spark):
    texts = ["\n".join(["x"] * n) for n in (1, 350, 351, 400, 401, 750)]
    counts = {r.path: r["count"] for r in lines.sliding_windows(files(spark, texts)).groupBy("path").count().collect()}
    assert [counts[f"f{i}"] for i in range(6)] == [1, 1, 2, 2, 2, 3]


def test_markdown(spark):
    made = got(lines.markdown_chunks(files(spark, ["intro\n# One\na\n#### deep\n## Two\n### Three\nb", "plain", "# \n\n"])))
    assert [(p, n, t) for p, _, n, t in made] == [
        ("f0", "section::0", "intro"), ("f0", "section::1", "# One\na\n#### deep"), ("f0", "section::2", "## Two"), ("f0", "section::3", "### Three\nb"), ("f1", "section::0", "plain"), ("f2", "section::0", "#"),
    ]


def test_config(spark):
    long = "# head\na: 1\n  b: 2\n# note\nc: 3\n\n// x\nd: 4"
    made = got(lines.config_chunks(files(spark, [long, "short: 1"]), 5))
    assert made == [("f0", 0, "config::0", "# head"), ("f0", 1, "config::1", "a: 1\n  b: 2\n# note"), ("f0", 4, "config::4", "c: 3\n\n// x"), ("f0", 7, "config::7", "d: 4"), ("f1", 0, "[config]", "short: 1")]
    edge = got(lines.config_chunks(files(spark, ["k" * 1203, "k" * 1204])))
    assert [n for _, _, n, _ in edge] == ["[config]", "config::0"]


def test_notebook(spark):
    cell = lambda kind, source: {"cell_type": kind, "source": source}
    book = {"cells": [cell("markdown", "# A"), cell("markdown", ["b", "c"]), cell("raw", "r"), cell("code", " "), cell("code", ["x = 1\n", "y"]), cell("code", "z"), cell("markdown", "end")]}
    made = [(r.name, r.start_line, r.doc_type, r.text) for r in lines.notebook_chunks(files(spark, [json.dumps(book), "{}"])).orderBy("start_line", F.desc("name")).collect()]
    assert made == [("md::0", 0, "notebook_markdown", "# A\n\nbc"), ("cell::0", 0, "notebook", "x = 1\ny"), ("cell::1", 1, "notebook", "z"), ("md::2", 2, "notebook_markdown", "end")]


SOURCE = "import os\nfrom a.b import c\n\nLIMIT = 3\n\n\nclass Store:\n    size = 1\n\n    @property\n    def put(self):\n        return self.check(os.path.join('a'))\n\n    class Inner:\n        def deep(self):\n            pass\n\n\nasync def run():\n    return Store()\n"


def test_python_symbols():
    made = symbols.Chunker(SOURCE, "code", "python").chunks(symbols.PARSERS)
    by = {c["name"]: c for c in made}
    assert list(by) == ["[file_context]", "Store[context]", "Store.put", "Store.Inner[context]", "Store.Inner.deep", "run"]
    assert by["Store.put"]["text"].startswith("# context: inside Store\n    @property")
    assert by["Store.put"]["raw"] == ["check", "join"] and by["Store.put"]["start_line"] == 9
    assert by["[file_context]"]["symbol_names"][:2] == ["Store", "run"] and by["run"]["raw"] == ["Store"]


def test_large_function_is_split_and_bad_source_falls_back():
    body = "".join(f"    def part{i}():\n        return {i}\n" for i in range(120))
    made = symbols.Chunker("def big():\n    x = 1\n" + body, "code", "python").chunks(symbols.PARSERS)
    assert [c["name"] for c in made[1:4]] == ["big[header]", "big.part0", "big.part1"]
    assert [c["name"] for c in symbols.Chunker("def (:\n", "code", "python").chunks(symbols.PARSERS)] == ["chunk::0"]
    assert [c["name"] for c in symbols.Chunker("fn main() {}", "code", "rust").chunks(symbols.PARSERS)] == ["chunk::0"]


def test_all_kinds_together(spark):
    rows = [("a/m.py", SOURCE), ("b.md", "# T\nx"), ("c.yaml", "k: 1"), ("d.txt", "one"), ("e.ipynb", '{"cells": [{"cell_type": "code", "source": "q"}]}'), ("f.rs", "fn x() {}")]
    made = ingest.build(spark.createDataFrame(rows, "path string, text string"), "https://example.com/r", "main", "s1")
    kinds = {r.file_path: r.doc_type for r in made.select("file_path", "doc_type").collect()}
    assert kinds["b.md"] == "markdown" and kinds["c.yaml"] == "config" and kinds["d.txt"] == "text" and kinds["e.ipynb"] == "notebook" and kinds["f.rs"] == "code"
    calls = {r.name: r.calls for r in made.collect()}
    assert calls["run"] == ["a/m.py::Store[context]::6"] or calls["run"] == []
