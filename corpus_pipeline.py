"""From raw documents to packed sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next one's docs. All but the last return the columns of documents.

Every stage takes null ids, null and empty texts, repeated rows, empty tables and extra columns of any
name. Rows without words pass the first four and are packed as their end id alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fleetvitals.llm import best_fit_pack, count_rtree_join, line_chunks, lsa_decontam, queries, toxicity_chain
from fleetvitals.llm._scratch import settle, table


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxic documents go, at the threshold too; all others stay as they are."""
    model = queries.toxicity_model(spark, docs, sf_dir)
    return toxicity_chain.keep_clean(docs, model, "toxic")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier place keeps are cut from the text; every row stays, and rows equal in
    id and text leave each other alone."""
    return line_chunks.line_dedup(docs)


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of five words and a similarity of 0.8 join, the first stays: the one
    with the smallest id (null first), then text hash. Of repeated rows one stays, and all without
    words do."""
    return count_rtree_join.keep_one(docs, size=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go; those without words stay."""
    return lsa_decontam.keep_uncontaminated(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document in its sequence; repeated rows are packed one by one."""
    return best_fit_pack.pack_documents(docs, queries.word_tokenizer())


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("ngram_join", ngram_join),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: The first, fourth and last stage cannot be said in SQL; tests hold every stage to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        docs = out if name == STAGES[-1][0] else settle(out)
    return docs
