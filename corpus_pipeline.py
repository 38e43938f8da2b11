"""The corpus pipeline: five stages, each over all that its predecessor kept, written and read again.

1. quality classifier: documents scoring under 0.3 go;
2. SimHash near-duplicates: one document stays of each component, that of least id (null last);
3. benchmark decontamination: documents in which any benchmark item's window occurs go;
4. personal data: spans are replaced by their kind in brackets, n_chars follows;
5. byte-pair encoding: ids and decoded text of what is left.

Null and empty texts go through every stage: they are scored, are near-duplicates of each other, have no
hits, no spans and no ids.  Rows are judged by their texts, whether their doc_id is null, repeated or their
own; empty tables stay empty; without labels of both kinds nothing is rejected in stage 1.

All but the last return the columns of documents, further columns included.  The classifier learns from the labelled documents
of its own input that are not held out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chunkyard.llm import attention, bpe, decontaminate, pii, simhash
from chunkyard.llm.common import load, stage


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return attention.keep_good(docs, attention.fit(docs, load(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, load(spark, sf_dir, "benchmark"), least_items=1)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs, pii.fit(spark))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("personal_data", personal_data), ("encoding", encoding)]
#: The classifier, the fingerprints' hash and the tokenizer are not SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for k, (name, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stage(docs, name)
    return docs
