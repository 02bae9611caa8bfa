"""The corpus pipeline: each stage works on what the one before kept.

``run`` applies STAGES to ``documents``; between stages the rows are written as
Parquet to the shared folder and read again. All stages but the last return the
columns of ``documents``. A doc_id stands for one document.

All stages read whole tables; an empty one stays empty, nulls may stand in any
column, and columns beside those of ``documents`` pass, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronofold.llm import decontaminate, language_id, near_dedup, packing, suffix_dedup
from chronofold.llm.common import discard, free_name, lasting, table

#: Texts in a known language score 0.39 at least (10,000 of sf0.1, single words
#: among them); in others, in Latin script, 0.18 to 0.29, and random letters,
#: of ten words or more, 0.28 at most.
LEAST_SCORE = 0.3


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the profiles know; texts that are null or have no letter go, and those that score less than LEAST_SCORE.

    Each row is judged alone, so repeated rows stay or go together. Of equal
    scores the language that sorts first counts, which decides nothing here.
    """
    guess, score = free_name(docs, "lang_pred"), free_name(docs, "lang_score")
    found = language_id.identify(docs, language_id.fit(docs), lang_into=guess, score_into=score)
    return found.where((F.col(guess) != language_id.UNKNOWN) & (F.col(score) >= LEAST_SCORE)).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest doc_id.

    Of rows that share a doc_id one stays, that with the smallest hash of its
    text, and of equal rows any, which are the same. Rows without a doc_id
    stay, and so do null texts and those without words, which are like nothing.
    """
    kept = near_dedup.near_duplicates(docs).where("kept and doc_id is not null").select("doc_id").distinct()
    order = free_name(docs, "order")
    one = docs.join(kept, "doc_id", "left_semi").withColumn(order, F.row_number().over(W.partitionBy("doc_id").orderBy(F.xxhash64("text")))).where(F.col(order) == 1)
    return one.select(*docs.columns).unionByName(docs.where("doc_id is null"))


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of 50 words or more that a document before them has; n_chars follows the text.

    Documents of which no word remains go. Rows that share a doc_id are one
    document: passages that only they share stay, and each is cut by its own
    spans. Null texts and rows without a doc_id stay as they are, with the
    length of their text, null for null.
    """
    return suffix_dedup.drop_repeats(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no ten words of a benchmark item stand in a row, nor an item of fewer.

    Rows that share a doc_id are judged together, and so are those without one.
    Null and empty texts stay.
    """
    found = decontaminate.contamination(decontaminate.matches(docs, table(spark, sf_dir, "benchmark")))
    bad = found.where("n_hit > 0").select(F.col("doc_id").alias("bad_id"))
    return docs.join(bad, docs.doc_id.eqNullSafe(bad.bad_id), "left_anti")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of at most 1024 tokens.

    Every row is a document, repeated ones too; null and empty texts are their
    end token alone. Pieces of equal length are alike to the plan, and which
    of them goes where is not fixed.
    """
    return packing.pack(docs)


STAGES = [
    ("language_id", keep_known_languages),
    ("near_dedup", drop_near_duplicates),
    ("suffix_dedup", drop_repeated_passages),
    ("decontamination", drop_contaminated),
    ("packing", pack_sequences),
]

#: SQL has no tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all documents that pass the stages. Intermediate tables go once the next stage is written."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, lasting(lambda stage=stage, docs=docs: stage(spark, docs, sf_dir))
        if k:
            discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
