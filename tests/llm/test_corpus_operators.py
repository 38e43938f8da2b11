"""Operators that gather over the corpus, against brute force."""

import math
import re
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow.parquet as pq
import pytest
import xxhash
from pyspark.sql import functions as F

from chunkyard.llm import common, ctw, simhash

LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
WORD = re.compile("[^\x20\x09-\x0d]+")
TEXTS = [(i, f"Some text number {i} about cats and dogs " * (1 + i % 4)) for i in range(40)] + [(50, None), (51, ""), (52, " \n"), (53, "one two"), (53, "one two"), (54, "x" * 20_000 + " y" * 9_000), (None, "a null id é")]


def docs(spark, rows=TEXTS):
    return spark.createDataFrame([(i, t, "clash", 0) for i, t in rows], "doc_id long, text string, fp string, block int")


def test_base_scores_by_hand(spark):
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2
    tokens = [(i, [*WORD.findall((t or "").translate(LOW)), None]) for i, t in TEXTS]
    c = Counter(w for i, ws in tokens if not held(i) for w in ws)
    n, v = sum(c.values()), len(c)
    expected = sorted(((i, held(i), len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), 4)) for i, ws in tokens), key=str)
    got = ctw.score_documents(docs(spark)).collect()
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got), key=str) == expected
    assert all(r.score < 0 for r in got)
    assert ctw.score_documents(docs(spark).limit(0)).count() == 0


def log_kt(zeros, ones):
    return math.lgamma(zeros + 0.5) + math.lgamma(ones + 0.5) - math.log(math.pi) - math.lgamma(zeros + ones + 1)


def weighted(bits, depth, d=0):
    """Straight from the definition: log of the weighted probability of (context, bit) pairs at one node."""
    ones = sum(b for _, b in bits)
    kt = log_kt(len(bits) - ones, ones)
    if d == depth:
        return kt
    parts: dict = {}
    for context, b in bits:
        parts.setdefault(context[len(context) - 1 - d], []).append((context, b))
    return math.log(0.5) + np.logaddexp(kt, sum(weighted(p, depth, d + 1) for p in parts.values()))


def test_tree_is_the_weighting_by_definition():
    texts, depth = [b"abracadabra", b"abab", b"", b"cab"], 2
    runs, sizes = ctw.runs_of(texts, depth)
    assert sizes.tolist() == [12, 5, 1, 4]
    own, counts = np.unique(runs, return_counts=True)
    tree = ctw.ContextTree.grow(own, counts.astype(float), depth)
    pairs = [(bytes([r >> 16 & 255, r >> 8 & 255]), r & 255) for r in runs.tolist()]
    first = [(c, x >> 7) for c, x in pairs]
    # The next bit's probability at a known context is the ratio of weighted probabilities with and without it,
    # up to the update of the estimates: compare with the weights that follow from the counts.
    keys, one, weight = tree.orders[0]
    kt = log_kt(sum(1 - b for _, b in first), sum(b for _, b in first))
    children = sum(weighted([x for x in first if x[0][1] == s], depth, 1) for s in {c[1] for c, _ in first})
    at = keys.tolist().index(1)
    assert math.isclose(weight[at], math.exp(kt) / (math.exp(kt) + math.exp(children)), rel_tol=1e-4)
    assert math.isclose(one[at], (sum(b for _, b in first) + 0.5) / (len(first) + 1), rel_tol=1e-6)


def test_probabilities_sum_to_one_and_texts_are_ranked():
    texts = [b"the cat sat on the mat", b"the dog sat on the log"] * 5
    runs, _ = ctw.runs_of(texts, 3)
    own, counts = np.unique(runs, return_counts=True)
    tree = ctw.ContextTree.grow(own, counts.astype(float), 3)
    for context in (b"the", b"zzz", b"\xff\xff\xff", b"qat"):
        base = int.from_bytes(context, "big") << 8
        assert math.isclose((10 ** tree.log10_of(np.arange(256, dtype=np.uint64) + np.uint64(base))).sum(), 1, rel_tol=1e-5)
    scorer = ctw.Scorer(tree)
    a, b, empty = scorer.score([b"the cat sat", b"xq!zk#vw%jp", b""])
    assert a > b and empty < 0
    assert np.allclose(scorer.score([b"the cat sat", b"the cat sat"]), [a, a])


def test_what_was_seen_very_often_leaves_the_rest_a_probability():
    runs, _ = ctw.runs_of([b"aaaa"], 3)
    for often in (3e7, 3e9):
        tree = ctw.ContextTree.grow(np.unique(runs), np.full(len(np.unique(runs)), often), 3)
        base = int.from_bytes(b"aaa", "big") << 8
        found = tree.log10_of(np.arange(256, dtype=np.uint64) + np.uint64(base))
        assert np.isfinite(found).all() and math.isclose((10**found).sum(), 1, rel_tol=1e-5)
        # 0x61 against 0x60: its last bit was always 1.
        assert -math.log10(often) - 2 < found[0x60] < -math.log10(often) + 1


def log10_by_hand(trained, text, depth):
    """A text's log10 probability after the definition: at each bit, every node on the context's path mixes its own
    estimate with what is below it, by how well each has explained the training bits."""
    mark = lambda t: b"\xff" * depth + t + b"\xff"
    events: dict = {}
    for t in map(mark, trained):
        for i in range(depth, len(t)):
            for k in range(8):
                events.setdefault((k, t[i] >> (8 - k)), []).append((t[i - depth : i], t[i] >> (7 - k) & 1))

    def chance(bits, context, d):
        """P(1) at the node d deep, and the node's weighted log probability of its training bits."""
        kt = log_kt(sum(1 - b for _, b in bits), sum(b for _, b in bits))
        own = (sum(b for _, b in bits) + 0.5) / (len(bits) + 1)
        if d == depth:
            return own
        below = [x for x in bits if x[0][depth - 1 - d] == context[depth - 1 - d]]
        children = sum(weighted([x for x in bits if x[0][depth - 1 - d] == s], depth, d + 1) for s in {c[depth - 1 - d] for c, _ in bits})
        if not below:  # no training text went this way
            return own
        w = 1 / (1 + math.exp(min(700, children - kt)))
        return w * own + (1 - w) * chance(below, context, d + 1)

    total, t = 0.0, mark(text)
    for i in range(depth, len(t)):
        for k in range(8):
            bits = events.get((k, t[i] >> (8 - k)), [])
            p = chance(bits, t[i - depth : i], 0) if bits else 0.5
            total += math.log10(p if t[i] >> (7 - k) & 1 else 1 - p)
    return total


def test_scores_of_whole_texts_by_the_definition(spark):
    rows = [(i, f"cab ab{'ra' * (i % 4)} é{i % 3}\nabc") for i in range(14)] + [(40, ""), (41, None), (None, "abracad"), (42, "zz top")]
    trained = [(t or "").encode() for i, t in rows if zlib.crc32(b"" if i is None else str(i).encode()) % 7 != 2]
    for depth in (3, 5):
        got = {r.doc_id: r for r in ctw.score_documents(docs(spark, rows), depth=depth).collect()}
        for i, t in rows:
            expected = log10_by_hand(trained, (t or "").encode(), depth)
            assert math.isclose(got[i].score, expected, rel_tol=1e-5, abs_tol=1e-4)
            assert math.isclose(got[i].bits_per_byte, -expected * math.log2(10) / max(1, len((t or "").encode())), rel_tol=1e-4)


def test_blocks_change_no_score(spark, monkeypatch):
    rows = [*TEXTS, *((300 + i, f"words {i * i} more{i} words " * (i % 9)) for i in range(40))]
    result = lambda: sorted((str(r.doc_id), r.n_known, round(r.base_score, 6), round(r.score, 3)) for r in ctw.score_documents(docs(spark, rows).repartition(2)).collect())
    whole = result()
    monkeypatch.setattr(ctw, "BLOCK_BYTES", 900)
    assert result() == whole


def test_blobs_are_staged_without_the_jvms_writer(spark, monkeypatch):
    """Python workers write the staged tables, in row groups of bounded size, and only the files of tasks that ended well are read."""
    staged = []
    monkeypatch.setattr(ctw, "stage_mapped", lambda *a: staged.append(common.stage_mapped(*a)) or staged[-1])
    monkeypatch.setattr(common, "stage", lambda *a: pytest.fail("written by Spark"))
    monkeypatch.setattr(common, "GROUP_BYTES", 2_000)
    monkeypatch.setattr(ctw, "BLOCK_BYTES", 900)
    assert ctw.score_documents(docs(spark)).count() == len(TEXTS)
    files = [[f.removeprefix("file:").replace("///", "/") for f in df.inputFiles()] for df in staged]
    assert len(files) == 4 and all(files)
    assert all(pq.ParquetFile(f).metadata.created_by.startswith("parquet-cpp") for own in files for f in own)
    asks = [pq.ParquetFile(f).metadata for f in files[1]]
    assert sum(m.num_row_groups for m in asks) > len(asks)
    folder = Path(files[1][0]).parent
    Path(f"{folder}.writing", "part-of-a-lost-task.parquet").write_bytes(b"half")
    assert staged[1].count() == sum(m.num_rows for m in asks)


def test_depth_is_the_same_for_every_input_and_shards_change_no_score(spark):
    rng = np.random.default_rng(5)
    noise = [(200 + i, bytes(rng.integers(33, 127, 3000, dtype=np.uint8)).decode()) for i in range(30)]
    rows = [*TEXTS, *noise]
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2
    own, counts = np.unique(ctw.runs_of([(t or "").encode() for i, t in rows if not held(i)], 5)[0], return_counts=True)
    scorer = ctw.Scorer(ctw.ContextTree.grow(own, counts.astype(float), 5))
    expected = sorted((str(i), round(scorer.score([(t or "").encode()])[0], 2)) for i, t in rows)
    got = sorted((str(r.doc_id), r.score) for r in ctw.score_documents(docs(spark, rows).repartition(3)).collect())
    assert [i for i, _ in got] == [i for i, _ in expected]
    assert np.allclose([x for _, x in got], [x for _, x in expected], rtol=1e-5, atol=0.02)


def fingerprint_by_hand(text):
    words = WORD.findall((text or "").translate(LOW))
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components_by_hand(fps, bits=4):
    parent = {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    values = sorted(parent)
    for i, x in enumerate(values):
        for y in values[i + 1 :]:
            if (x ^ y).bit_count() <= bits:
                a, b = find(x), find(y)
                parent[max(a, b)] = min(a, b)
    return {f: find(f) for f in values}


def test_near_duplicates_by_hand(spark):
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()
    long = [" ".join(words[(i * k + 3 * k) % 20] for i in range(300)) for k in (1, 3, 7, 9)]
    rows = [*TEXTS, *((100 + i, t) for i, t in enumerate(long)), *((200 + i, t + " end" * (1 + i)) for i, t in enumerate(long)), *((300 + i, t.upper()) for i, t in enumerate(long))]
    fps = [fingerprint_by_hand(t) for _, t in rows]
    root = components_by_hand(fps)
    least: dict = {}
    for (i, _), f in zip(rows, fps, strict=True):
        if i is not None:
            least[root[f]] = min(least.get(root[f], i), i)
    expected = sorted(((i, f, least.get(root[f])) for (i, _), f in zip(rows, fps, strict=True)), key=str)
    got = simhash.near_duplicates(docs(spark, rows)).collect()
    assert sorted(((r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in got), key=str) == expected
    kept = simhash.drop_near_duplicates(docs(spark, rows))
    assert kept.columns == docs(spark).columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted({str(c) for _, _, c in expected})
    assert simhash.near_duplicates(docs(spark).limit(0)).count() == 0


def test_different_texts_under_one_or_no_id_are_all_kept(spark):
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()
    a, b, c, d = (" ".join(words[(i * k + 3 * k) % 20] for i in range(300)) for k in (1, 3, 7, 9))
    rows = [(None, a), (None, b), (None, b), (None, b.upper()), (7, c), (7, d), (7, d), (3, c), (None, d)]
    fps = [fingerprint_by_hand(t) for t in (a, b, c, d)]
    assert len(set(components_by_hand(fps).values())) == 4
    kept = [(r.doc_id, r.text) for r in simhash.drop_near_duplicates(docs(spark, rows)).collect()]
    assert {(i, t.lower()) for i, t in kept} == {(None, a), (None, b), (3, c), (7, d)} and len(kept) == 4


def test_variants_take_few_bytes_at_every_size():
    fps = np.random.default_rng(1).integers(0, 2**63, simhash.BLOCK).astype(np.uint64)
    for corpus in (50_000, 5_000_000, 50_000_000, 5_000_000_000):
        packed = simhash.pack_block(fps, simhash.buckets_of(corpus))
        assert sum(len(x) for _, x in packed) / (len(fps) * len(simhash.ball_masks())) < 5
    made, whose = simhash.variants_of(*simhash.unpack(simhash.pack_block(fps[:1], 1)[0][1]))
    assert sorted(made.tolist()) == sorted((fps[0] ^ simhash.ball_masks()).tolist()) and set(whose.tolist()) == {int(fps[0])}


def test_buckets_link_all_however_they_are_cut(monkeypatch):
    rng = np.random.default_rng(3)
    made = set()
    for base in rng.integers(0, 2**63, 20).tolist():
        for _ in range(25):
            x = base
            for j in rng.integers(0, 64, rng.integers(0, 5)).tolist():
                x ^= 1 << j
            made.add(x)
    fps = np.array(sorted(made), dtype=np.uint64)
    expected = components_by_hand(fps.tolist())
    for number, block, stretch in ((1, 4096, 1 << 20), (4, 100, 1 << 20), (64, 7, 5000), (512, 300, 600)):
        monkeypatch.setattr(simhash, "RANGE_VARIANTS", stretch)
        buckets: dict = {}
        for at in range(0, len(fps), block):
            for bucket, blob in simhash.pack_block(fps[at : at + block], number):
                buckets.setdefault(bucket, []).append(blob)
        met = [simhash.meet_in_bucket(b) for b in buckets.values()]
        a, b = simhash.forest(np.concatenate([x for x, _ in met]), np.concatenate([y for _, y in met]))
        found = {f: f for f in fps.tolist()} | dict(zip(a.tolist(), b.tolist(), strict=True))
        assert found == expected


def test_any_column_may_clash(spark):
    rows = spark.createDataFrame([(1, "one two three four five", "a", 1, "s"), (2, "one two three four five", "b", 2, "t"), (3, "else", "c", 3, "u")], "doc_id long, text string, _key string, salt_ int, fp string")
    kept = simhash.drop_near_duplicates(rows)
    assert kept.columns == rows.columns and sorted((r.doc_id, r._key, r.salt_, r.fp) for r in kept.collect()) == [(1, "a", 1, "s"), (3, "c", 3, "u")]
    assert simhash.drop_near_duplicates(rows.limit(0)).count() == 0


def test_a_hub_of_very_many_links(spark):
    pairs = spark.range(1, 20_001).select(F.col("id").alias("a"), F.lit(0).cast("long").alias("b"))
    assert simhash.components(pairs).groupBy("root").count().collect()[0].asDict() == {"root": 0, "count": 20_000}


def test_long_chains_become_one_component(spark):
    pairs = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (5, 5)], "a long, b long")
    roots = {r.node: r.root for r in simhash.components(pairs).collect()}
    assert roots == {i: 0 for i in range(1, 61)} | {101: 100}
