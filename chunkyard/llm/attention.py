"""Quality classifier: attention-based multiple-instance learning over passages.

A document is a bag of passages of ``PASSAGE_BYTES`` bytes, over its whole text.  A passage is encoded
from counts of byte classes, of pairs of them, and of how many of its four-byte windows are distinct,
through a learned layer; gated attention (tanh times sigmoid) learns from document labels which
passages matter, and the document's score is a logistic function of the weighted sum of its passages.
Everything is trained together by Adam, over every passage of a sample of labelled documents: of each
label those that come first by hash, at most ``TRAIN_DOCS`` of them and ``TRAIN_BYTES`` of text together.
That is the only bound; the sample is taken from the labelled documents that the table has.

Edge cases: null and empty text is one passage without bytes and gets a score; a document's labels are
averaged, a half counts as good; null labels are left out; of several texts under one labelled doc_id the one of
least hash is learned from; without labels of both kinds there is
nothing to learn and every score is 0.5; null doc_ids count as empty text for the hold-out and never
have labels; repeated rows are each scored; an empty table gives no rows; other columns are ignored (and kept by
``keep_good``).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chunkyard.llm.common import batches_of, map_slices, remainder, slices, text_rows

PASSAGE_BYTES = 512
TRAIN_DOCS = 1500
#: Bytes of the sample's texts, of each label.
TRAIN_BYTES = 16 << 20
LEAST_SCORE = 0.3
HIDDEN, GATE, EPOCHS, BATCH, RATE, DECAY = 32, 16, 24, 64, 0.01, 1e-4
#: Bytes whose features are made at once.
PIECE_BYTES = 1 << 20

_CLASSES = ["aeiouy", "bcdfghjklmnpqrstvwxz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", "\n\r", ".,;:", "!?", "#*$%&", "|<>", "\"'()[]{}-", "@/\\_=+^~`"]
N_CLASSES = len(_CLASSES) + 2
N_FEATURES = N_CLASSES + N_CLASSES * N_CLASSES + 2


def _class_table() -> np.ndarray:
    table = np.full(256, N_CLASSES - 1, dtype=np.int64)  # control characters
    table[128:] = N_CLASSES - 2
    for k, members in enumerate(_CLASSES):
        for m in members:
            table[ord(m)] = k
    return table


_CLASS_OF = _class_table()


def _features(raw: np.ndarray, passage: np.ndarray, count: int) -> np.ndarray:
    """A row for each passage; ``passage`` names each byte's."""
    kinds = _CLASS_OF[raw]
    size = np.bincount(passage, minlength=count).astype(np.float32)
    each = np.maximum(size, 1)[:, None]
    single = np.bincount(passage * N_CLASSES + kinds, minlength=count * N_CLASSES).reshape(count, -1) / each
    joined = passage[1:] == passage[:-1]
    pair = ((passage[1:] * N_CLASSES + kinds[1:]) * N_CLASSES + kinds[:-1])[joined]
    double = np.bincount(pair, minlength=count * N_CLASSES * N_CLASSES).reshape(count, -1) / each
    distinct = np.zeros(count)
    if len(raw) > 3:
        word = raw.astype(np.uint32)
        window = word[:-3] | (word[1:-2] << 8) | (word[2:-1] << 16) | (word[3:] << 24)
        inside = passage[3:] == passage[:-3]
        keys = np.sort((passage[:-3][inside].astype(np.uint64) << np.uint64(32)) | window[inside])
        new = np.ones(len(keys), dtype=bool)
        new[1:] = keys[1:] != keys[:-1]
        distinct = np.bincount((keys[new] >> np.uint64(32)).astype(np.int64), minlength=count)
    return np.concatenate([single, double, distinct[:, None] / each, size[:, None] / PASSAGE_BYTES], axis=1).astype(np.float32)


def encode(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The passages' features, one document after another, and each document's count of passages."""
    raws = [t.encode("utf-8", "replace") for t in texts]
    counts = np.array([max(1, -(-len(r) // PASSAGE_BYTES)) for r in raws], dtype=np.int64)
    parts, held, sizes, used = [], [], [], 0

    def flush() -> None:
        nonlocal held, sizes, used
        if sizes:
            passages = [max(1, -(-n // PASSAGE_BYTES)) for n in sizes]
            first = np.cumsum(passages) - passages
            where = np.concatenate([f + np.arange(n) // PASSAGE_BYTES for f, n in zip(first.tolist(), sizes, strict=True)])
            parts.append(_features(np.frombuffer(b"".join(held), dtype=np.uint8), where.astype(np.int64), int(sum(passages))))
        held, sizes, used = [], [], 0

    step = PIECE_BYTES // PASSAGE_BYTES * PASSAGE_BYTES
    for raw in raws:
        for at in range(0, max(1, len(raw)), step):
            held.append(raw[at : at + step])
            sizes.append(len(held[-1]))
            used += sizes[-1]
            if used >= PIECE_BYTES:
                flush()
    flush()
    return (np.concatenate(parts) if parts else np.zeros((0, N_FEATURES), np.float32)), counts


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


class AttentionModel:
    def __init__(self, mean: np.ndarray, scale: np.ndarray, weights: dict[str, np.ndarray]):
        self.mean, self.scale, self.weights = mean, scale, weights

    def _forward(self, x: np.ndarray, counts: np.ndarray):
        w, first = self.weights, np.cumsum(counts) - counts
        bag = np.repeat(np.arange(len(counts)), counts)
        hidden = np.maximum(x @ w["w1"] + w["b1"], 0)
        t, s = np.tanh(hidden @ w["v"]), _sigmoid(hidden @ w["u"])
        e = (t * s) @ w["a"]
        a = np.exp(e - np.maximum.reduceat(e, first)[bag])
        a /= np.add.reduceat(a, first)[bag]
        z = np.add.reduceat(a[:, None] * hidden, first, axis=0)
        return bag, first, hidden, t, s, a, z, z @ w["c"] + w["b"][0]

    def scores(self, x: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """A document's probability of the label 1."""
        return _sigmoid(self._forward(np.clip((x - self.mean) / self.scale, -8, 8), counts)[-1])

    def gradients(self, x: np.ndarray, counts: np.ndarray, y: np.ndarray, importance: np.ndarray) -> dict[str, np.ndarray]:
        w = self.weights
        bag, first, hidden, t, s, a, z, logit = self._forward(x, counts)
        d = (_sigmoid(logit) - y) * importance / len(y)
        dz = d[:, None] * w["c"]
        da = (dz[bag] * hidden).sum(1)
        de = a * (da - np.add.reduceat(a * da, first)[bag])
        dg = de[:, None] * w["a"]
        dt, ds = dg * s * (1 - t * t), dg * t * s * (1 - s)
        dh = (a[:, None] * dz[bag] + dt @ w["v"].T + ds @ w["u"].T) * (hidden > 0)
        return {"w1": x.T @ dh, "b1": dh.sum(0), "v": hidden.T @ dt, "u": hidden.T @ ds, "a": (t * s).T @ de, "c": z.T @ d, "b": np.array([d.sum()])}

    @staticmethod
    def train(bags: list[np.ndarray], labels: np.ndarray, seed: int = 7) -> AttentionModel:
        everything = np.concatenate(bags)
        mean, scale = everything.mean(0), everything.std(0) + 1e-3
        bags = [np.clip((b - mean) / scale, -8, 8) for b in bags]
        rng = np.random.default_rng(seed)
        shape = {"w1": (N_FEATURES, HIDDEN), "b1": (HIDDEN,), "v": (HIDDEN, GATE), "u": (HIDDEN, GATE), "a": (GATE,), "c": (HIDDEN,), "b": (1,)}
        model = AttentionModel(mean, scale, {k: (rng.normal(0, s[0] ** -0.5, s) if len(s) == 2 or k in "ac" else np.zeros(s)) for k, s in shape.items()})
        importance = np.where(labels == 1, 0.5 / max(labels.mean(), 1e-6), 0.5 / max(1 - labels.mean(), 1e-6))
        first = {k: np.zeros_like(v) for k, v in model.weights.items()}
        second = {k: np.zeros_like(v) for k, v in model.weights.items()}
        step = 0
        for _ in range(EPOCHS):
            order = rng.permutation(len(bags))
            for at in range(0, len(bags), BATCH):
                own, step = order[at : at + BATCH], step + 1
                g = model.gradients(np.concatenate([bags[i] for i in own]), np.array([len(bags[i]) for i in own]), labels[own], importance[own])
                for k, w in model.weights.items():
                    d = g[k] + DECAY * w
                    first[k] = 0.9 * first[k] + 0.1 * d
                    second[k] = 0.999 * second[k] + 0.001 * d * d
                    w -= RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
        return model


def training_labels(labels: DataFrame, modulus: int = 5) -> DataFrame:
    """doc_id and y of labelled documents that are not held out."""
    known = labels.where("doc_id is not null and quality is not null").where(remainder(F.col("doc_id"), modulus) != 0)
    return known.groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("y"))


def sample_of(docs: DataFrame, labels: DataFrame, per_label: int = TRAIN_DOCS, most_bytes: int = TRAIN_BYTES) -> DataFrame:
    """doc_id, text and y of the documents to learn from."""
    text = F.coalesce("text", F.lit(""))
    there = docs.select("doc_id", F.struct(F.xxhash64(text).alias("hash"), F.octet_length(text).alias("size")).alias("own")).join(training_labels(labels), "doc_id")
    there = there.groupBy("doc_id", "y").agg(F.min("own").alias("own")).select("doc_id", "y", "own.*")
    chosen = []
    for y in (0, 1):  # two bounded top-n, so that no task and no side of the join is larger than the sample
        used = 0
        for r in there.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_label).collect():
            used += r["size"]
            if used > most_bytes:
                break
            chosen.append((r.doc_id, r.hash, y))
    small = docs.sparkSession.createDataFrame(chosen, "doc_id long, hash long, y int")
    kept = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("hash")).join(F.broadcast(small), ["doc_id", "hash"])
    return kept.dropDuplicates(["doc_id"]).select("doc_id", "text", "y")


def fit(docs: DataFrame, labels: DataFrame, per_label: int = TRAIN_DOCS, most_bytes: int = TRAIN_BYTES) -> AttentionModel | None:
    sample = sample_of(docs, labels, per_label, most_bytes)

    def start():
        def step(columns: dict) -> dict:
            x, counts = encode(columns["text"])
            return {"doc_id": columns["doc_id"], "y": columns["y"], "bag": [b.tobytes() for b in np.split(x, np.cumsum(counts)[:-1])]}

        return step

    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("y", T.IntegerType()), T.StructField("bag", T.BinaryType())])
    rows = sorted(map_slices(sample, schema, start).toLocalIterator())
    y = np.array([r.y for r in rows], dtype=float)
    if len(set(y.tolist())) < 2:
        return None
    return AttentionModel.train([np.frombuffer(r.bag, dtype=np.float32).reshape(-1, N_FEATURES) for r in rows], y)


def scores_of(model: AttentionModel | None, texts: list[str]) -> list[float]:
    if model is None:
        return [0.5] * len(texts)
    return model.scores(*encode(texts)).tolist() if texts else []


def score_documents(docs: DataFrame, model: AttentionModel | None) -> DataFrame:
    """doc_id and score of every document."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("score", T.DoubleType())])

    def start():
        return lambda columns: {"doc_id": columns["doc_id"], "score": scores_of(shipped.value, columns["text"])}

    return map_slices(text_rows(docs), schema, start)


def keep_good(docs: DataFrame, model: AttentionModel | None, least: float = LEAST_SCORE) -> DataFrame:
    """The documents, with all their columns, that score ``least`` or more."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def keep(batches):
        for batch in batches:
            for part in slices(batch):
                scores = scores_of(shipped.value, [t or "" for t in part.column(at).to_pylist()])
                yield part.filter(pa.array([s >= least for s in scores], pa.bool_()))

    batches_of(docs.sparkSession)
    return docs.mapInArrow(keep, docs.schema)
