"""The registered queries over small tables, against brute force: digests, hold-outs, verdicts."""

import hashlib
import math
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_corpus_operators import WORD, components_by_hand, fingerprint_by_hand, log10_by_hand
from test_text_operators import counts_by_hand, spans_by_hand
from tokenizers import Tokenizer

import __spark_entry__
from chunkyard.llm import bpe, licenses, pii, rules, tokenfile

LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
GOOD = "The {0} river runs past {1} old stones, and in the {2} evening people of the village walk along. They talk of {0} ships and of {1} harvests. "


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("tables"))
    names = "amber birch cedar delta ember fjord grove heath inlet jetty".split()
    body = lambda i: "".join(GOOD.format(names[i % 10], names[(i * 7 + j) % 10], names[(i + j * 3) % 10]) for j in range(3))
    rows = [(i, body(i) + f"Entry {i * 7919}.") for i in range(60)] + [(100 + i, f"BUY {names[i % 10].upper()} NOW!! #$% " * 14) for i in range(40)]
    rows += [(300 + i, " ".join(f"the word{(i * 37 + j * j * 3) % 9973}x of" for j in range(40)) + ".") for i in range(10)]
    rows += [(200, None), (201, ""), (202, body(3) + "Entry 23757."), (203, "short é text"), (204, "one\none\none\n" * 30), (None, "Ünïcode 12,5 <|endoftext|> a.b@c.de, 10.0.0.25"), (205, "w " * 3000), (206, body(5) + " Write to jo.doe@mail.example.com or +1 (229) 555-4838.")]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(i, int(i < 100), 0) for i, _ in rows if i is not None and i < 200], "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    return root, rows


def run(spark, made, name):
    return __spark_entry__.queries()[name](spark, made[0])


def crc(i):
    return zlib.crc32(b"" if i is None else str(i).encode())


def as_list(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def test_op1(spark, made):
    found = run(spark, made, "op1_quality").collect()
    assert sorted(str(r.doc_id) for r in found) == sorted(str(i) for i, _ in made[1])
    assert all(r.held_out == (crc(r.doc_id) % 5 == 0) and r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for r in found)
    held = [r for r in found if r.held_out and r.doc_id is not None and r.doc_id < 200]
    assert held and np.mean([(r.doc_id < 100) == bool(r.predicted) for r in held]) == 1


def test_op4(spark, made):
    library = Tokenizer.from_file(bpe.default_vocabulary())
    expected = []
    for i, t in made[1]:
        ids = library.encode(t or "", add_special_tokens=False).ids
        expected.append((i, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert as_list(run(spark, made, "op4_bpe"), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(expected, key=str)


def em_by_hand(votes):
    """Posteriors of each vote pattern, by the textbook steps of two classes with independent votes."""
    counted = sorted(Counter(votes).items())
    n_rules = len(counted[0][0])
    good, bad, share = np.tile([0.02, 0.1, 0.88], (n_rules, 1)), np.tile([0.3, 0.2, 0.5], (n_rules, 1)), 0.8

    def posterior(pattern):
        up = math.log(share / (1 - share)) + sum(math.log(good[j][v + 1] / bad[j][v + 1]) for j, v in enumerate(pattern))
        return 1 / (1 + math.exp(-max(-500, min(500, up))))

    for _ in range(rules.EM_ROUNDS):
        p = np.array([posterior(v) for v, _ in counted])
        n = np.array([c for _, c in counted])
        new = []
        for w in (n * p, n * (1 - p)):
            new.append(np.array([[(sum(x for x, (v, _) in zip(w, counted, strict=True) if v[j] == k) + 1) / (w.sum() + 3) for k in (-1, 0, 1)] for j in range(n_rules)]))
        share = ((n * p).sum() + 1) / (n.sum() + 2)
        good, bad = new
    return {v: posterior(v) for v, _ in counted}


def test_op6(spark, made):
    columns = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    found = run(spark, made, "op6_rules")
    assert as_list(found, "doc_id", *columns) == sorted(((i, *counts_by_hand(t)) for i, t in made[1]), key=str)
    posteriors = em_by_hand([tuple(r.votes) for r in rules.judge(spark.read.parquet(f"{made[0]}/documents.parquet")).collect()])
    judged = {str(r.doc_id): r for r in rules.judge(spark.read.parquet(f"{made[0]}/documents.parquet")).collect()}
    for r in found.collect():
        failed = r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words
        expected = posteriors[tuple(judged[str(r.doc_id)].votes)]
        assert r.base_failed == failed and math.isclose(r.posterior, expected, rel_tol=1e-6, abs_tol=1e-12) and r.kept == (not failed and expected >= rules.LEAST_POSTERIOR)
    assert len(posteriors) > 2 and 0 < sum(r.kept for r in found.collect()) < len(made[1])


def test_op7(spark, made):
    texts = {str(i): t or "" for i, t in made[1]}
    for r in run(spark, made, "op7_pii").collect():
        base = spans_by_hand(texts[str(r.doc_id)])
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest() and set(base.split(",")) - {""} <= set(r.spans.split(","))
        kinds = Counter(x.split(":")[0] for x in base.split(",") if x)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(kinds[k] for k in pii.KINDS[:4])
        assert r.spans.split(",") == sorted(r.spans.split(","), key=lambda x: (int(x.split(":")[1]), pii.KINDS.index(x.split(":")[0])) if x else 0)


def test_op8(spark, made):
    rows = made[1]
    tokens = {str(i): [*WORD.findall((t or "").translate(LOW)), None] for i, t in rows}
    c = Counter(w for i, _ in rows if crc(i) % 7 != 2 for w in tokens[str(i)])
    n, v = sum(c.values()), len(c)
    found = {str(r.doc_id): r for r in run(spark, made, "op8_ctw").collect()}
    assert len(found) == len(rows)
    for i, _ in rows:
        r, own = found[str(i)], tokens[str(i)]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (crc(i) % 7 == 2, len(own), sum(c[w] > 0 for w in own), n)
        assert math.isclose(r.base_score, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in own), rel_tol=1e-9)
    few = [(t or "").encode() for i, t in rows if crc(i) % 7 != 2]
    expected = log10_by_hand(few, b"short \xc3\xa9 text", 5)
    assert math.isclose(found["203"].score, expected, rel_tol=1e-5) and math.isclose(found["203"].bits_per_byte, -expected * math.log2(10) / 13, rel_tol=1e-5)


def test_op9(spark, made):
    fps = {str(i): fingerprint_by_hand(t) for i, t in made[1]}
    root = components_by_hand(list(fps.values()))
    least: dict = {}
    for i, _ in made[1]:
        if i is not None:
            least[root[fps[str(i)]]] = min(i, least.get(root[fps[str(i)]], i))
    expected = sorted(((i, f"{fps[str(i)]:016x}", least.get(root[fps[str(i)]])) for i, _ in made[1]), key=str)
    assert as_list(run(spark, made, "op9_simhash"), "doc_id", "fingerprint", "component_id") == expected


def test_op10(spark, made):
    library = Tokenizer.from_file(tokenfile.default_vocabulary())
    start, expected = 0, []
    for i, t in sorted(made[1], key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        expected.append((i, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    assert as_list(run(spark, made, "op10_token_files"), "doc_id", "start", "n_tokens", "ids_crc32") == sorted(expected, key=str)


def test_op2_rows_are_reported_by_their_own_text(spark):
    notice = licenses.KNOWN_NOTICES["notice:MIT"]
    rows = [(None, "a\n" + notice), (None, "b"), (1, notice), (1, notice), (1, "x"), (2, licenses.KNOWN_TEXTS["Zlib"] + "\n\n"), (3, "q " * 200_000 + "\n" + notice)]
    docs = spark.createDataFrame([(i, t, "clash", 0) for i, t in rows], "doc_id long, text string, digest string, row int")
    found = sorted(((r.doc_id, r.license_id, ",".join(r.notices)) for r in licenses.scan_licenses(docs).collect()), key=str)
    assert found == sorted([(None, None, "notice:MIT"), (None, None, ""), (1, "notice:MIT", "notice:MIT"), (1, "notice:MIT", "notice:MIT"), (1, None, ""), (2, "Zlib", ""), (3, None, "notice:MIT")], key=str)
    assert licenses.scan_licenses(docs.limit(0)).count() == 0
    given = spark.createDataFrame([("own", "My, own   TEXT"), ("later", "my own text")], "license_id string, text string")
    assert [r.license_id for r in licenses.scan_licenses(docs.limit(1).withColumn("text", F.lit("my own text!")), given).collect()] == ["later"]
    assert len(set(licenses.KNOWN_DIGESTS.values())) == len(licenses.KNOWN_DIGESTS) and all(len(d) == 64 for d in licenses.KNOWN_DIGESTS.values())


@pytest.mark.parametrize("name", [n for n in __spark_entry__.queries() if n.startswith("op") and n not in ("op3_chat", "op5_decontamination")])
def test_empty_tables(spark, made, tmp_path, name):
    spark.read.parquet(f"{made[0]}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{made[0]}/labels.parquet").limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    assert __spark_entry__.queries()[name](spark, str(tmp_path)).count() == 0
