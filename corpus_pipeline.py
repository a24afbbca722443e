"""The corpus pipeline: five stages, each written as Parquet and read again by the next.

Every stage takes null and empty texts, repeated rows and ids, null ids and
sources, and other columns of any name, which it carries; no rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vecfolio.llm.common import forget, packed, settled, table, unpacked
from vecfolio.llm.line_dedup import dedup_lines
from vecfolio.llm.mixing import mixed_documents
from vecfolio.llm.pieces import encode_documents, piece_model
from vecfolio.llm.simhash import drop_near_duplicates
from vecfolio.llm.toxicity import held_out_model, score_documents


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't predicted toxic, by a model of the labels of this input.

    A null or empty text stays, unless most labels say toxic; repeated rows go or stay together.
    """
    model = held_out_model(spark, sf_dir, docs.select("doc_id", "text"))
    need = ["doc_id", "text"]
    scored = score_documents(packed(docs, need), model)
    return unpacked(scored.filter("predicted = 0"), docs.columns, need)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without chunks of lines that an earlier place has.

    A null text stays null; a text of which nothing is left becomes empty. n_chars stays as it was.
    """
    return dedup_lines(docs, edges=True).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates (five-word shingles, similarity 0.8 or more).

    SimHashes within 8 bits meet by the generalised pigeonhole search, pairs further apart by
    least hashes; the shingle sets of all that met decide.
    The least (doc_id, hash of the row) stays; texts without words, null ones too, are one class.
    """
    return drop_near_duplicates(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources by target weights: a row for each document and pass that took words of it.

    A text of which a pass took a part is that part; documents without words aren't in the mix.
    """
    return mixed_documents(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix with its texts' SentencePiece ids, and whether they decode to the text; a null text has none."""
    return encode_documents(docs, piece_model())


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", near_dedup),
    ("mixing", mixing),
    ("sentencepiece", encoding),
]

#: Hashes, a fitted model and a tokenizer take part, so SQL can't express the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        docs, path = settled(lambda stage=stage, docs=docs: stage(spark, docs, sf_dir))
        forget(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
