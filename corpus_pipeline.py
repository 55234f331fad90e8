"""From raw documents to packed training sequences: toxicity, near duplicates, benchmark
decontamination, personal data, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept. All
but the last return rows of ``documents``: rejected documents are gone, kept ones are
whole (with personal data redacted after stage four). ``run`` writes each stage's result
as Parquet in the shared folder and reads it again for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparklog.llm import decontam, jaccard, packing, pii, runtime, toxicity
from sparklog.llm.queries import BYTE_VOCABULARY


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the subword-bag model, trained on ``labels``, scores below 0.5."""
    model = toxicity.fit(docs, runtime.table(spark, sf_dir, "labels"))
    return toxicity.scored(docs, model, keep_below=0.5)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a Jaccard similarity of 0.8 or more of five-word shingles."""
    return jaccard.keep_one(docs, n_words=5, num=80, den=100)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no item of ``benchmark`` occurs within its edit budget."""
    return decontam.drop_leaks(docs, runtime.table(spark, sf_dir, "benchmark"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind in brackets."""
    return pii.redact_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 tokens."""
    return packing.pack(docs, BYTE_VOCABULARY, end_id=1, length=2048)


STAGES = [
    ("toxicity", drop_toxic),
    ("near duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("personal data", redact_personal_data),
    ("packing", pack_sequences),
]

#: Trained models and tokenizers are beyond SQL; tests compare each stage with plain versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = runtime.table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        with runtime.temporary(spark) as written:  # what a stage wrote on the way goes once its result is whole
            docs = runtime.cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
            written.remove(docs._cut_path)
        if before is not None:
            runtime.drop(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
