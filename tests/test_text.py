import hashlib
import hmac
import re
import uuid

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chunkyard.functions import text as X

CUT = re.compile(r"[^a-zA-Z0-9]+|(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])")


def one(spark, texts, column):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [r.x for r in rows.select("i", column(F.col("t")).alias("x")).orderBy("i").collect()]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet="abAB19 _-éÉ.\n", max_size=30), min_size=40, max_size=60))
def test_tokens_as_plain_python(spark, texts):
    expected = [[t for t in CUT.sub(" ", x).lower().split() if len(t) > 1 and t not in X.STOPWORDS] for x in texts]
    assert one(spark, texts, X.tokens) == expected


def test_tokens_cut_at_case(spark):
    assert one(spark, ["parseHTTPResponse2Json the X", None, ""], X.tokens) == [["parse", "http", "response2json"], [], []]


def test_lines_and_strip_as_python(spark):
    texts = ["", "a", "a\n", "a\r\nb\rc\x0bd\x0ce\x1cf\x85g h", "\n\n", " \t x \n"]
    assert one(spark, texts, X.lines) == [t.splitlines() for t in texts]
    texts = ["  x ", " y z　", "", "\x1cq\x1f"]
    assert one(spark, texts, X.strip) == [t.strip() for t in texts]


def test_uuid5_is_pythons(spark):
    names = ["docs:a/b.py:f:3", "", "é:ü:名:0"]
    assert one(spark, names, X.uuid5_url) == [str(uuid.uuid5(uuid.NAMESPACE_URL, n)) for n in names]


def test_names(spark):
    urls = ["https://tok@example.com/a/my.repo.git", "https://example.com/x.github.io/", "git"]
    assert one(spark, urls, X.repo_name) == ["my_repo", "xhub_io", "git"]
    assert one(spark, ["a.py::f::3", "section::3", "x"], X.short_id) == ["f", "section", "x"]
    assert one(spark, ["a/B.PY", ".bashrc", "x.tar.gz", "n", "e."], X.suffix) == [".py", "", ".gz", "", ""]
    assert one(spark, ["Score: 7", "12/10", "none", None], X.score_from_text) == [0.7, 1.0, 0.0, 0.0]


def test_signature(spark):
    body, secret = '{"a": "é"}', "key" * 30
    good = "sha256=" + hmac.new(secret.encode(), body.encode(), hashlib.sha256).hexdigest()
    row = spark.range(1).select(X.signature_ok(F.lit(body), F.lit(secret), F.lit(good)).alias("a"), X.signature_ok(F.lit(body), F.lit("no"), F.lit(good)).alias("b")).first()
    assert (row.a, row.b) == (True, False)
