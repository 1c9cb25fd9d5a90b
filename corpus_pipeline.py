"""Corpus pipeline: documents to packed training sequences.

Each stage calls one operator of ``pagefold.llm`` and works on every row that
the stage before kept:

1. toxicity         -- rows that score 0.7 or more go
2. near_duplicates  -- of each SimHash component the row with the smallest id stays
3. decontamination  -- rows with benchmark passages go
4. personal_data    -- spans are replaced by their kind
5. packing          -- what is left, as sequences of at most 4096 tokens

Cases, for every stage: a null text counts as empty; empty texts are not toxic, are one
near-duplicate group of which the smallest id stays, hold no benchmark passage and no
personal data (a null stays null), and pack as one end token.  Rows with null ids take
part; a group without any other id keeps one of them.  Repeated rows are duplicates, so
one stays after stage 2.  Columns besides ``doc_id`` and ``text`` pass through unchanged
whatever their names; an empty table gives an empty result.

All but the last return the columns of documents.  ``run`` writes each stage's
result and reads it again, so a lost executor costs no more than a stage.  Part
of the stages uses tokenizer and hash libraries, so there is no SQL for the whole.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pagefold.llm import op1_toxicity, op2_pii, op3_simhash, op6_packing, op7_decontaminate
from pagefold.llm.common import read, save
from pagefold.plans.catalog import register


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op1_toxicity.remove_toxic(docs, read(spark, sf_dir, "labels", "doc_id", "toxic"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op3_simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op7_decontaminate.remove_contaminated(docs, read(spark, sf_dir, "benchmark", "item_id", "text"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op2_pii.redact_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op6_packing.pack_documents(docs, public_tokenizers.path(op6_packing.VOCABULARY))


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("decontamination", decontamination),
          ("personal_data", personal_data), ("packing", packing)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of all documents that the stages keep."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    *stages, (_, last) = STAGES
    for name, stage in stages:
        docs = save(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return last(spark, docs, sf_dir)


register("pipeline", oracle=ORACLE_SQL)(run)
