"""The whole pipeline on a made corpus, stage by stage, and the registered queries."""

import importlib

from test_corpus_operators import components_by_hand, fingerprint_by_hand
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from chunkyard.llm import attention, bpe
from chunkyard.llm.common import stage

GOOD = "The {0} river runs past {1} old stone houses, and in the {2} evening people of the village walk along its quiet banks. They talk of {0} harvests and of {1} ships. "
ITEM = "which seven silver lanterns hung above the northern gate during winter"


def tables(spark, root):
    words = "amber birch cedar delta ember fjord grove heath inlet jetty knoll larch marsh north ocean piper quarry ridge shore thorn".split()
    body = lambda i: "".join(GOOD.format(words[(i * 3 + j) % 20], words[(i * 7 + j * j) % 20], words[(i + 5 * j) % 20]) for j in range(2 + i % 3))
    good = [(i, body(i) + f"Entry {i * 7919} closes {words[i % 20]} {words[(i // 20) % 20]} book {i}.") for i in range(120)]
    bad = [(1000 + i, f"BUY {words[i % 20].upper()} NOW!! CHEAP!! " * 12) for i in range(120)]
    rows = [*good, *bad, (2000, good[3][1]), (2001, good[5][1] + " Asked: " + ITEM + "?"), (2002, good[7][1] + " Write to jo.doe@mail.example.com soon."), (2003, None), (2004, "")]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(i, int(i < 1000), 0) for i, _ in good + bad], "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")


def test_stages_one_after_another(spark, tmp_path):
    root = str(tmp_path)
    tables(spark, root)
    docs = spark.read.parquet(f"{root}/documents.parquet")
    seen = {}
    for name, step in corpus_pipeline.STAGES:
        out = step(spark, docs, root)
        if name != "encoding":
            assert out.columns == docs.columns
        docs = seen[name] = stage(out, name)
    ids = {name: {r.doc_id for r in df.select("doc_id").collect()} for name, df in seen.items()}
    assert not {i for i in ids["quality"] if 1000 <= i < 2000} and {i for i in range(120)} <= ids["quality"]
    assert 2000 not in ids["near_duplicates"] and 3 in ids["near_duplicates"]
    assert 2001 not in ids["decontamination"] and ids["near_duplicates"] - ids["decontamination"] <= {2001}
    texts = {r.doc_id: r for r in seen["personal_data"].collect()}
    assert all("@" not in (r.text or "") and r.n_chars == len(r.text or "") for r in texts.values() if r.text is not None)
    assert ids["personal_data"] == ids["encoding"] == ids["decontamination"]
    # Against brute force: the least id of each component of the fingerprints, and the library's own ids.
    kept = [(r.doc_id, fingerprint_by_hand(r.text)) for r in seen["quality"].collect()]
    root = components_by_hand([f for _, f in kept])
    assert ids["near_duplicates"] == {min(i for i, f in kept if root[f] == c) for c in set(root.values())}
    library = Tokenizer.from_file(bpe.default_vocabulary())
    for r in seen["encoding"].collect():
        assert list(memoryview(bytes(r.ids_le)).cast("I")) == library.encode(texts[r.doc_id].text or "", add_special_tokens=False).ids


def test_stages_take_odd_rows(spark, tmp_path):
    """Null, repeated and clashing ids, null texts, columns of names that stages might want, an empty table."""
    root = str(tmp_path)
    tables(spark, root)
    words = "amber birch cedar delta ember fjord grove heath inlet jetty knoll larch marsh north ocean piper quarry ridge shore thorn".split()
    text = lambda k: "The harbour of the town is old. " + " ".join(words[(i * k + 3 * k) % 20] for i in range(120)) + "."
    rows = [(None, text(1)), (None, text(3)), (None, text(3)), (5, text(7)), (5, text(9)), (5, text(9)), (6, text(7)), (7, None), (8, None), (9, text(11) + " Mail a.b@c-d.org now."), (10, text(13) + " " + ITEM)]
    odd = spark.createDataFrame([(i, t, "en", "s", len(t or ""), "k", 1, "p", "h") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, _key string, salt_ int, _pieces string, hash string")
    docs, columns = odd, odd.columns
    for name, step in corpus_pipeline.STAGES[1:]:
        out = step(spark, docs, root)
        if name != "encoding":
            assert out.columns == columns
            docs = stage(out, name)
        else:
            coded = out.collect()
    kept = sorted(((r.doc_id, r.text) for r in docs.collect()), key=str)
    assert kept == sorted([(None, text(1)), (None, text(3)), (5, text(7)), (5, text(9)), (7, None), (9, text(11) + " Mail [EMAIL] now.")], key=str)
    assert len(coded) == len(kept) and {(r._key, r.salt_, r._pieces, r.hash) for r in docs.collect()} == {("k", 1, "p", "h")}
    assert all(r.n_chars == len(r.text) for r in docs.collect() if r.text is not None)
    good = corpus_pipeline.quality(spark, odd, root)
    assert good.columns == columns and all((r.doc_id, r.text) in rows for r in good.collect())
    empty = odd.limit(0)
    for name, step in corpus_pipeline.STAGES:
        assert step(spark, empty, root).count() == 0, name


def test_stages_are_named_operators():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "personal_data", "encoding"]
    known = __spark_entry__.queries()
    assert "pipeline" in known and {f"op{n}" for n in range(1, 11)} == {k.split("_")[0] for k in known if k.startswith("op") and k[2:3].isdigit()}


def test_a_missing_label_table_column_is_an_error_not_a_guess(spark):
    try:
        attention.training_labels(spark.createDataFrame([(1, 1)], "doc_id long, toxic int")).collect()
    except Exception as e:
        assert "quality" in str(e)
    else:
        raise AssertionError("no error")


def test_nothing_else_imports_the_package():
    assert importlib.import_module("chunkyard.queries") and not any("llm" in m for m in vars(importlib.import_module("chunkyard.queries")))
