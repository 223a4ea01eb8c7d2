"""A corpus from documents to packed sequences: each stage reads what its predecessor wrote.

Toxic documents go; repeated multi-line passages are cut from the rest; one document of each near-duplicate group stays; sources are mixed
to their target weights (documents repeat or drop out as the mix says); what is left is packed into sequences.

Defined cases, of all stages: an empty table gives an empty one. Extra columns of documents, of any name, are dropped after the first stage. Null
ids and repeated rows are rows like others, except where near dedup keeps one of a group. Each stage states the rest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import line_dedup, mixing, near_copies, packing, toxicity
from quarry.llm.common import Scratch, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that score 0.5 or more. The lexicon is learnt from the labels that sf_dir has for these documents.

    Null and empty texts score as texts without a match, so they stay unless all labels are toxic. Very long texts are scored whole, by their
    share of toxic words. Equal texts are judged alike.
    """
    return toxicity.filtered(docs, toxicity.train(docs, table(spark, sf_dir, "labels"))).select(*COLUMNS)


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated multi-line passages are cut out but for their first occurrence; n_chars follows the text.

    No row goes: null texts stay null, and a text that is cut out whole is empty. The first occurrence is that of the least doc_id (null last),
    ties by text hash. Equal rows are cut alike and don't cut each other; very long texts are cut whole, passages within them too.
    """
    got = line_dedup.cleaned(docs)
    return got.withColumn("n_chars", F.when(F.col("line_removed") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def near_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each group of near duplicates (five-word shingles, Jaccard similarity of 0.8 or more).

    Candidates come by SimHash and Golay keys and are verified by their shingles; an exact check follows for groups that these left apart.
    Texts without words (null, empty, blank) are one group. Ids that tie (repeated or null) are told apart by text hash, then by the other
    columns. Very long texts are compared whole.
    """
    return near_copies.deduplicated(docs).select(*COLUMNS)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it.

    Texts without words (null, empty, blank) have size 0: they come before the cut or behind it like others, by the hash of their id, and a null
    source is a source of its own. Very long texts are taken whole. Documents alike in id and size are interchangeable where the cut falls.
    """
    return mixing.mixed(docs).select(*COLUMNS)


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document in a sequence.

    Null and empty texts are their end id alone; repeated rows are packed as often as they occur; very long texts span sequences.
    """
    return packing.query(docs)


STAGES = [
    ("toxicity", toxicity_filter),
    ("line_dedup", line_deduplication),
    ("simhash", near_deduplication),
    ("mixing", source_mixing),
    ("packing", sequence_packing),
]

#: SQL can express neither the learnt filter nor the tokenizer; tests hold the pipeline to its operators instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scratch = Scratch(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        docs = scratch.cut(stage(spark, docs, sf_dir), f"{k}_{name}")
        if k:
            scratch.drop(f"{k - 1}_{STAGES[k - 1][0]}")
    return docs
