"""The corpus pipeline: stages over documents, each written as Parquet and read again by the next one."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from treeline.llm import ngramjoin, packing, quality, toxicity
from treeline.llm.queries import LEAST, table
from treeline.llm.sampling import remainder
from treeline.llm.session import Stored


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose quality score is LEAST or more, all their columns and repeated rows; learns from labels as op6 does, on the stage's own documents.

    Null and empty texts, null ids and unlabelled documents are scored like others; an empty table stays empty.
    """
    model = quality.fit(docs, table(spark, sf_dir, "labels"), remainder("doc_id", 5) != 0)
    return quality.keep(docs, model, LEAST)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose toxicity score is below LEAST, all their columns and repeated rows; learns from labels as op7 does, on the stage's own documents.

    Null and empty texts have the score of a text without any mark; an empty table stays empty.
    """
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), remainder("doc_id", 4) != 2)
    return toxicity.keep(docs, model, LEAST)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest doc_id of each group of near copies, by five-word shingles at 0.8.

    Rows that repeat a doc_id stay or go together; texts without words and null ids stay; an empty table stays empty.
    """
    return ngramjoin.one_of_each(docs, 5, 80)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 2048 tokens: a null or empty text is its end mark, repeated rows are packed once each."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), 2048)


STAGES = [("quality", quality_stage), ("toxicity", toxicity_stage), ("near_duplicates", near_duplicate_stage), ("packing", packing_stage)]

#: The stages learn models and run a tokenizer, which SQL cannot express. Tests hold what a stage keeps against its operator's scores or components,
#: and the operators' kernels, interactions, lattices, joins and packings against brute force on small inputs.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents, each over all that the one before kept; a stage's table goes when the next one is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        kept = Stored(stage(spark, docs, sf_dir), f"stage-{name}")
        if before:
            before.drop()
        docs, before = kept.df, kept
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict:
    return {"pipeline": run}
