"""The corpus pipeline: toxic documents go, near-copies go, leaked benchmark texts go, personal data is masked, the rest is tokenized.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read
again before the next stage. All but the last return the columns of ``documents``.

Cases: null and empty texts pass the toxicity stage, count as copies of each other in the
near-copy stage, and end as zero tokens; repeated rows are copies of each other; an empty
table stays empty; further columns of the documents are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.llm import bpe, decontaminate, pii, simhash, toxicity
from flowlens.llm.textio import held_out, table
from flowlens.session import stage

#: Documents with this toxicity score or more go.
TOXIC = 0.7


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose toxicity score is below the limit."""
    model = toxicity.fit(docs.filter(~held_out(F.col("doc_id"), 3, 1)), table(spark, sf_dir, "labels"))
    return docs.filter(toxicity.score("text", model) < TOXIC)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-copies stays, the one with the smallest id."""
    return simhash.keep_one(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span of personal data or secrets becomes the name of its kind; n_chars follows the new text."""
    masked = docs.withColumn("text", pii.mask("text", pii.fit(docs)))
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, with their number and whether they decode to the text."""
    return bpe.tokenized(docs, bpe.default_path(), keep=("doc_id", "lang", "source"))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash", drop_near_copies),
    ("decontaminate", drop_leaks),
    ("pii", mask_personal_data),
    ("bpe", tokenize),
]

#: SQL can't express the trained models of the stages. A test holds the rows of ``run`` against a corpus whose
#: fate is known: fingerprints, groups, tiles and masks in plain Python, tokens by the tokenizers library.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
