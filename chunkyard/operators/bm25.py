"""Sparse retrieval: postings, statistics, weights, scores, top-k.

Tokens of a document are counted within its row, in Arrow batches (``counted``): no count is shuffled, unless a key
has several rows, whose counts have to be added up.  Frequencies are summed in each batch first.  A search takes two
passes: the frequencies of its queries' tokens, then scores batch by batch, of which each task keeps k rows a query.
An index stages the counts of all tokens, with a mark for every document that carries its length, sorted by
token, so that a search reads the row groups of its tokens.  Queries are weighted as documents are, so a token's
IDF counts twice in a score; that is the model, not textbook BM25.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from chunkyard.functions import text as X
from chunkyard.operators.best import CELLS, Best, rounded
from chunkyard.session import spread, written

#: No token has less than two characters, so this one can stand for a document itself.
MARK = ""
#: Bytes of text in an Arrow batch.
BATCH_BYTES = 8 << 20
#: Counts of queries' tokens that are sent to every task; more are joined.
MOST_ASKED = 200_000
#: Tokens whose IDF is sent to every task; that of the others is joined.
MOST_SENT = 200_000
_BYTES = np.arange(256)
_UPPER, _LOWER = (_BYTES >= 65) & (_BYTES <= 90), (_BYTES >= 97) & (_BYTES <= 122)
_WORD = _UPPER | _LOWER | ((_BYTES >= 48) & (_BYTES <= 57))
_LOW = (_BYTES + 32 * _UPPER).astype(np.uint8)


class Counts:
    """The tokens of a batch of texts, as ``X.tokens`` cuts them: each text's ``length``, and the text, token (a
    number in ``words``) and count of each pair, by text."""

    def __init__(self, texts: pa.Array):
        n = len(texts)
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        _, offsets, data = texts.buffers()
        ends = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, np.int64)
        raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.empty(0, np.uint8)
        ends = ends - ends[0]
        word, upper, lower = _WORD[raw], _UPPER[raw], _LOWER[raw]
        #: At i: nothing goes on from i - 1 to i.
        cut = np.zeros(len(raw) + 1, dtype=bool)
        cut[ends] = True
        inside = ~cut[2:-1] if len(raw) > 2 else np.empty(0, bool)
        between = lower[:-1] & upper[1:]
        between[:-1] |= upper[:-2] & upper[1:-1] & lower[2:] & inside
        cut[1:-1] |= between
        cut[1:-1] |= ~word[:-1] | ~word[1:]
        cut[0] = cut[-1] = True
        starts = np.flatnonzero(word & cut[:-1])
        sizes = np.flatnonzero(word & cut[1:]) + 1 - starts
        word[starts[sizes < 2]] = False
        starts, sizes = starts[sizes >= 2], sizes[sizes >= 2]
        flat = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)), pa.py_buffer(_LOW[raw[word]])])
        numbered = flat.dictionary_encode()
        code, self.words = numbered.indices.to_numpy(), numbered.dictionary.cast(pa.string())
        text = np.searchsorted(ends, starts, "right") - 1
        real = ~pc.is_in(self.words, pa.array(X.STOPWORDS)).to_numpy(zero_copy_only=False)[code] if len(code) else np.empty(0, bool)
        text, code = text[real], code[real]
        self.length = np.bincount(text, minlength=n)
        pair, self.tf = np.unique(text * max(1, len(self.words)) + code, return_counts=True)
        self.text, self.token = pair // max(1, len(self.words)), pair % max(1, len(self.words))

    def only(self, wanted: pa.Array) -> None:
        """Leave the pairs of other tokens out; tokens become places in ``wanted``."""
        at = pc.fill_null(pc.index_in(self.words, wanted), -1).to_numpy().astype(np.int64)
        keep = at[self.token] >= 0 if len(self.token) else np.empty(0, bool)
        self.text, self.token, self.tf, self.words = self.text[keep], at[self.token[keep]] if len(keep) else self.token, self.tf[keep], wanted


def _mapped(docs: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType) -> DataFrame:
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return spread(docs).mapInArrow(run, schema)


def _shipped(docs: DataFrame, wanted: list[str] | None):
    return None if wanted is None else docs.sparkSession.sparkContext.broadcast(wanted)


def repeated(docs: DataFrame, key: str = "doc_id") -> bool:
    """Whether a key has several rows."""
    return not docs.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()


def _rows(docs: DataFrame, key: str, wanted: list[str] | None = None) -> DataFrame:
    """key, length, token, tf of each row by itself, with its mark."""
    schema = T.StructType([T.StructField(key, docs.schema[key].dataType), T.StructField("length", T.IntegerType()), T.StructField("token", T.StringType()), T.StructField("tf", T.LongType())])
    arrow, shipped = to_arrow_schema(schema), _shipped(docs, wanted)

    def run(batches):
        for batch in batches:
            c, n = Counts(batch.column(1)), batch.num_rows
            if shipped is not None:
                c.only(pa.array(shipped.value, pa.string()))
            of = np.concatenate([c.text, np.arange(n)])
            token = pa.concat_arrays([c.words.take(pa.array(c.token, pa.int64())), pa.array([MARK] * n, pa.string())])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of)), pa.array(c.length[of], pa.int32()), token, pa.array(np.concatenate([c.tf, np.ones(n, np.int64)]), pa.int64())], schema=arrow)

    return _mapped(docs.select(key, "text"), run, schema)


def counted(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, length, token, tf, and a row with MARK for each document."""
    rows = _rows(docs, key)
    return rows.groupBy(key, "length", "token").agg(F.sum("tf").alias("tf")) if repeated(docs, key) else rows


def frequencies(docs: DataFrame, key: str = "doc_id", wanted: list[str] | None = None, unique: bool | None = None) -> DataFrame:
    """token, df, total: in how many documents a token is; for MARK the number of documents, and the total of their lengths."""
    if not (not repeated(docs, key) if unique is None else unique):
        rows, mark = _rows(docs, key, wanted).groupBy(key, "length", "token").agg(F.sum("tf").alias("tf")), F.col("token") == MARK
        each = rows.select("token", F.when(mark, F.col("tf")).otherwise(1).alias("df"), F.when(mark, F.col("tf") * F.col("length")).otherwise(0).alias("total"))
    else:
        shipped = _shipped(docs, wanted)

        def run(batches):
            for batch in batches:
                c = Counts(batch.column(0))
                if shipped is not None:
                    c.only(pa.array(shipped.value, pa.string()))
                df = np.bincount(c.token, minlength=len(c.words))
                at = np.flatnonzero(df)
                token = pa.concat_arrays([c.words.take(pa.array(at, pa.int64())), pa.array([MARK], pa.string())])
                yield pa.RecordBatch.from_pydict({"token": token, "df": pa.array([*df[at], batch.num_rows], pa.int64()), "total": pa.array([*[0] * len(at), int(c.length.sum())], pa.int64())})

        each = _mapped(docs.select("text"), run, T.StructType([T.StructField("token", T.StringType()), T.StructField("df", T.LongType()), T.StructField("total", T.LongType())]))
    return each.groupBy("token").agg(F.sum("df").alias("df"), F.sum("total").alias("total"))


def statistics(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """token and df of ``frequencies``, and its statistics as ``corpus_stats`` has them."""
    mark = F.col("token") == MARK
    stats = found.where(mark).agg(F.coalesce(F.sum("df"), F.lit(0)).alias("n_docs"), F.coalesce(F.sum("total"), F.lit(0)).alias("total_len"))
    return found.where(~mark).select("token", "df"), stats.withColumn("avgdl", F.col("total_len") / F.greatest(F.col("n_docs"), F.lit(1)))


def tokenized(docs: DataFrame, key: str = "doc_id", text: str = "text", *more: str) -> DataFrame:
    return spread(docs).select(key, X.tokens(F.col(text)).alias("tokens"), *more)


def postings(tokened: DataFrame, key: str = "doc_id", only: DataFrame | None = None) -> DataFrame:
    """key, length (all tokens), token, tf; ``only`` names the tokens wanted."""
    rows = tokened.select(key, F.size("tokens").alias("length"), F.explode("tokens").alias("token"))
    if only is not None:
        rows = rows.join(only, "token", "left_semi")
    return rows.groupBy(key, "length", "token").agg(F.count(F.lit(1)).alias("tf"))


def document_frequency(posted: DataFrame) -> DataFrame:
    return posted.groupBy("token").agg(F.count(F.lit(1)).alias("df"))


def corpus_stats(tokened: DataFrame) -> DataFrame:
    """One row: n_docs (those without tokens too), total_len, avgdl."""
    stats = tokened.agg(F.count(F.lit(1)).alias("n_docs"), F.coalesce(F.sum(F.size("tokens")), F.lit(0)).alias("total_len"))
    return stats.withColumn("avgdl", F.col("total_len") / F.greatest(F.col("n_docs"), F.lit(1)))


def idf_table(frequencies: DataFrame, stats: DataFrame) -> DataFrame:
    """token, df, idf.  The statistics are one row, which is all that is broadcast."""
    return frequencies.join(F.broadcast(stats.select("n_docs"))).select("token", "df", X.idf(F.col("n_docs"), F.col("df")).alias("idf"))


def weights(posted: DataFrame, idf: DataFrame, stats: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, token, weight: positive ones, to six places; a token without IDF counts 1.0."""
    full = posted.join(idf.select("token", "idf"), "token", "left").join(F.broadcast(stats.select("avgdl")))
    weight = F.round(F.coalesce("idf", F.lit(1.0)) * X.tf_weight(F.col("tf"), F.col("length"), F.col("avgdl")), 6)
    return full.select(key, "token", weight.alias("weight")).where("weight > 0")


def weights_of(docs: DataFrame, idf: DataFrame, stats: DataFrame, key: str = "doc_id") -> DataFrame:
    """``weights`` of all tokens of documents; ``idf`` (read more than once) has df too.  The most frequent tokens, up to MOST_SENT, are
    weighted where they are counted, which is most of the rows; only those of rarer tokens are shuffled to meet their IDF."""
    if repeated(docs, key):
        return weights(counted(docs, key).where(F.col("token") != MARK), idf, stats, key)
    level = F.floor(F.log2("df") * 16)
    n_of = sorted(idf.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n")).collect(), reverse=True)
    sent = n_of[: int(np.searchsorted(np.cumsum([r["n"] for r in n_of]), MOST_SENT, "right"))]
    rows = idf.where(level >= sent[-1]["level"]).collect() if sent else []
    whole, avgdl = len(sent) == len(n_of), max(stats.first()["avgdl"], 1.0)
    shipped = docs.sparkSession.sparkContext.broadcast((pa.array([r["token"] for r in rows], pa.string()), np.array([r["idf"] for r in rows] + [1.0])))
    head = [T.StructField(key, docs.schema[key].dataType), T.StructField("token", T.StringType())]
    near, far = T.StructType([*head, T.StructField("weight", T.DoubleType())]), T.StructType([*head, T.StructField("length", T.IntegerType()), T.StructField("tf", T.LongType())])

    def rows_of(known: bool, arrow: pa.Schema):
        def run(batches):
            words, own = shipped.value
            for batch in batches:
                c = Counts(batch.column(1))
                place = pc.fill_null(pc.index_in(c.words, words), -1).to_numpy().astype(np.int64)[c.token] if len(c.token) else np.empty(0, np.int64)
                if known:
                    w = _weight(own[place], avgdl, c.tf, c.length[c.text])
                    at = np.flatnonzero((w > 0) & ((place >= 0) | whole))
                    more = [pa.array(w[at])]
                else:
                    at = np.flatnonzero(place < 0)
                    more = [pa.array(c.length[c.text[at]], pa.int32()), pa.array(c.tf[at], pa.int64())]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(c.text[at])), c.words.take(pa.array(c.token[at])), *more], schema=arrow)

        return run

    made = _mapped(docs.select(key, "text"), rows_of(True, to_arrow_schema(near)), near)
    return made if whole else made.unionByName(weights(_mapped(docs.select(key, "text"), rows_of(False, to_arrow_schema(far)), far), idf, stats, key))


def scores(query_weights: DataFrame, doc_weights: DataFrame, query: str = "query_id", key: str = "doc_id") -> DataFrame:
    """query, key, score of the documents that share a token."""
    joined = query_weights.select(query, "token", F.col("weight").alias("wq")).join(doc_weights, "token")
    return joined.groupBy(query, key).agg(F.round(F.sum(F.col("wq") * F.col("weight")), 6).alias("score"))


def top_k(scored: DataFrame, k: int, query: str = "query_id", key: str = "doc_id", rank: str = "rank") -> DataFrame:
    """The k best of each query; ties by key.  The rank filter stands on the window, so each task keeps k rows a query."""
    order = Window.partitionBy(query).orderBy(F.desc("score"), F.asc(key))
    return scored.withColumn(rank, F.row_number().over(order)).where(F.col(rank) <= k)


def staged(tokened: DataFrame, key: str = "doc_id", only: DataFrame | None = None, *more: str) -> tuple[DataFrame, DataFrame]:
    """Postings (of the tokens in ``only``, or all) and statistics of all documents, from one pass over the tokens."""
    rows = tokened.select(key, *more, F.size("tokens").alias("length"), F.explode(F.array_append("tokens", F.lit(MARK))).alias("token"))
    if only is not None:
        rows = rows.join(only.select("token").union(only.sparkSession.createDataFrame([(MARK,)], "token string")), "token", "left_semi")
    found = written(rows.groupBy(key, *more, "length", "token").agg(F.count(F.lit(1)).alias("tf")), "postings")
    stats = found.where(F.col("token") == MARK).agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("n_docs"), F.coalesce(F.sum(F.col("tf") * F.col("length")), F.lit(0)).alias("total_len"))
    return found.where(F.col("token") != MARK), stats.withColumn("avgdl", F.col("total_len") / F.greatest(F.col("n_docs"), F.lit(1)))


def search(docs: DataFrame, queries: DataFrame, k: int, keep: Column | None = None, key: str = "doc_id", query: str = "query_id") -> DataFrame:
    """Ranked documents for each query (query_id, text).  Statistics are the whole corpus's; ``keep`` limits what is ranked, before ranking."""
    kept = F.lit(True) if keep is None else F.coalesce(keep, F.lit(False))
    asked = written(counted(queries, query).where(F.col("token") != MARK), "asked")
    rows = asked.limit(MOST_ASKED + 1).collect()
    if len(rows) <= MOST_ASKED and not repeated(docs, key):
        return _search(docs, rows, k, kept, key, query, queries.schema[query])
    tokened = spread(docs).select(key, X.tokens(F.col("text")).alias("tokens"), kept.alias("kept"))
    found, stats = staged(tokened, key, asked.select("token").distinct(), "kept")
    return search_postings(found, idf_table(document_frequency(found), stats), stats, asked, k, key, query)


def _weight(idf: np.ndarray, avgdl: float, tf: np.ndarray, length: np.ndarray) -> np.ndarray:
    """As in ``weights``."""
    return rounded(idf * (tf * (X.K1 + 1)) / (tf + X.K1 * (1 - X.B + X.B * length / avgdl)), 6)


def _search(docs: DataFrame, asked: list, k: int, kept: Column, key: str, query: str, of: T.StructField) -> DataFrame:
    """``search`` of few queries over documents whose keys are unique: each task scores its documents and keeps the best."""
    wanted = sorted({r["token"] for r in asked})
    found = {r["token"]: r for r in frequencies(docs, key, wanted, unique=True).collect()}
    n, total = (found[MARK]["df"], found[MARK]["total"]) if MARK in found else (0, 0)
    wanted = [t for t in wanted if t in found]
    place, ids = {t: i for i, t in enumerate(wanted)}, list(dict.fromkeys(r[query] for r in asked))
    number, avgdl = {q: i for i, q in enumerate(ids)}, max(total / max(n, 1), 1.0)
    idf = np.array([math.log(1 + (n - found[t]["df"] + 0.5) / (found[t]["df"] + 0.5)) for t in wanted])

    known = sorted((place[r["token"]], number[r[query]], r["tf"], r["length"]) for r in asked if r["token"] in place)
    token, to, tf, length = np.array(known, np.int64).reshape(-1, 4).T
    edges = np.searchsorted(token, np.arange(len(wanted) + 1))
    shipped = docs.sparkSession.sparkContext.broadcast((wanted, idf, avgdl, edges, to, _weight(idf[token], avgdl, tf, length), ids))
    schema = T.StructType([T.StructField(query, of.dataType), T.StructField(key, docs.schema[key].dataType), T.StructField("score", T.DoubleType())])
    arrow = to_arrow_schema(schema)

    def run(batches):
        wanted, idf, avgdl, edges, to, own, ids = shipped.value
        wanted, best, step = pa.array(wanted, pa.string()), Best(len(ids), k, arrow.field(1).type), max(1, CELLS // max(1, len(ids)))
        for batch in batches:
            c = Counts(batch.column(1))
            c.only(wanted)
            w = _weight(idf[c.token], avgdl, c.tf, c.length[c.text])
            for at in range(0, batch.num_rows, step):
                a, b = np.searchsorted(c.text, [at, at + step])
                n_docs, most = min(step, batch.num_rows - at), edges[c.token[a:b] + 1] - edges[c.token[a:b]]
                cells, scores, ends = n_docs * len(ids), np.zeros(n_docs * len(ids)), np.cumsum(most)
                shared = np.zeros(cells, dtype=bool)
                while a < b:  # as many pairs of a document's token and a query's as there may be cells
                    upto = max(1, int(np.searchsorted(ends, CELLS, "right")))
                    n_each = most[:upto]
                    pair = np.arange(n_each.sum()) + np.repeat(edges[c.token[a : a + upto]] - np.cumsum(n_each) + n_each, n_each)
                    cell = np.repeat(c.text[a : a + upto] - at, n_each) * len(ids) + to[pair]
                    scores += np.bincount(cell, np.repeat(w[a : a + upto], n_each) * own[pair], cells)
                    shared[cell] = True
                    a, ends, most = a + upto, ends[upto:] - ends[upto - 1], most[upto:]
                scores = rounded(scores, 6)
                hit = np.flatnonzero(shared & (scores >= np.tile(best.least, n_docs)))
                best.add(hit % len(ids), scores[hit], batch.column(0).take(pa.array(hit // len(ids) + at)))
        number, score, keys = best.settle()
        if len(number):
            yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in number.tolist()], arrow.field(0).type), keys, pa.array(score)], schema=arrow)

    return top_k(_mapped(docs.where(kept).select(key, "text"), run, schema), k, query, key)


def search_postings(found: DataFrame, idf: DataFrame, stats: DataFrame, asked: DataFrame, k: int, key: str = "doc_id", query: str = "query_id") -> DataFrame:
    """Ranked documents from stored postings (key, length, token, tf and kept) and the postings of the queries."""
    known = asked.join(idf.select("token"), "token", "left_semi")
    return top_k(scores(weights(known, idf, stats, query), weights(found.where("kept"), idf, stats, key), query, key), k, query, key)


def unknown_terms(queries: DataFrame, docs: DataFrame, query: str = "query_id") -> DataFrame:
    """Query tokens that no document has."""
    asked = written(counted(queries, query).where(F.col("token") != MARK).select(query, "token").distinct(), "asked")
    terms = [r.token for r in asked.select("token").distinct().limit(MOST_ASKED + 1).collect()]
    # Whose rows they are is all the same here, so no key has to be unique.
    return asked.join(frequencies(docs, docs.columns[0], terms if len(terms) <= MOST_ASKED else None, unique=True), "token", "left_anti").select(query, "token")


def refit(old_idf: DataFrame | None, batch: DataFrame, corpus: DataFrame | None = None, mode: str = "global") -> tuple[DataFrame, DataFrame]:
    """IDF and statistics after a batch.

    ``global`` counts the corpus (old and new); ``last_batch`` counts the batch alone and keeps the
    old IDF of tokens that it lacks, as the reference system does.
    """
    if mode not in ("global", "last_batch"):
        raise ValueError(f"no such mode: {mode}")
    if mode == "global" and corpus is None:
        raise ValueError("global statistics need the whole corpus")
    found, stats = statistics(written(frequencies(batch if mode == "last_batch" else corpus), "frequencies"))
    new = idf_table(found, stats).select("token", "idf")
    if mode == "global" or old_idf is None:
        return new, stats
    merged = old_idf.select("token", F.col("idf").alias("old")).join(new, "token", "full_outer")
    return merged.select("token", F.coalesce("idf", "old").alias("idf")), stats
