"""From raw documents to packed training sequences, stage by stage.

Each stage takes all documents that the one before has kept and returns documents with the same
columns; the last returns packed pieces. Models are fitted on the labelled documents of
the input folder, so that a stage does not depend on what earlier ones left of the labels.

Null and empty texts are documents without words: the models judge them like others, they are
nobody's near duplicate, nothing is cut from them, and they pack as an end token. Rows without an id pass the
duplicate stages untouched. Further columns are carried along, whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsflow.llm.boosted import fit_quality_rules, quality_rules
from newsflow.llm.near_duplicates import near_duplicates
from newsflow.llm.packing import pack
from newsflow.llm.pairwise import fit_quality, quality_scores
from newsflow.llm.queries import table
from newsflow.llm.repeats import remove_repeats
from newsflow.llm.store import quoted, small_input, written
from newsflow.llm.token_pieces import token_pieces
from newsflow.llm.token_queries import END, SEQUENCE, WORD_BPE
from newsflow.session import ship_package

# Fitted models and iterative decisions have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def _rows(docs: DataFrame) -> DataFrame:
    """(row, text): a document's columns as one value, so that no name can clash with an operator's."""
    return small_input(docs).select(F.struct(*map(quoted, docs.columns)).alias("row"), "text")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the pairwise ranking puts at or above its threshold."""
    ship_package(spark)
    model = fit_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return quality_scores(_rows(docs), model, "row").filter("predicted = 1").select("row.*")


def keep_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the boosted trees accept, unless most of their words (50 at least) are in repeated windows.

    The other half of op10's base rule, fewer than 50 words, is left to the query: it would also reject short clean texts.
    """
    ship_package(spark)
    trees = fit_quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return quality_rules(_rows(docs), trees, "row").filter("verdict and not (n_words >= 50 and 100 * n_repeat_words > 50 * n_words)").select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, 0.8), the one with the smallest id.

    Of rows that share an id, which are one group, the smallest row stays.
    """
    ship_package(spark)
    gone = near_duplicates(docs, width=5, percent=80).filter("not kept").select("doc_id").distinct()
    many = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 and doc_id is not null").select("doc_id")
    # A row as one value, so that no column's name can clash.
    stay = docs.select("doc_id", F.struct(*map(quoted, docs.columns)).alias("row")).join(gone, "doc_id", "left_anti")
    single = stay.join(many, "doc_id", "left_anti").select("row")
    rows = stay.join(many, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("row").alias("row")).select("row")
    return single.unionByName(rows).select("row.*")


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the 13-word windows that an earlier document has; documents of which nothing is left go."""
    ship_package(spark)
    cut = remove_repeats(docs, width=13, whole_rows=True).filter("n_removed = 0 or n_removed < n_words")
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("row.text"))
    size = F.when(F.col("n_removed") > 0, F.length("kept").cast("long")).otherwise(F.col("row.n_chars"))
    new = {"text": text, "n_chars": size}
    return cut.select(*[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents with their sequence and offset."""
    ship_package(spark)
    pieces = token_pieces(small_input(docs.select("doc_id", "text")), public_tokenizers.path(WORD_BPE), SEQUENCE, END)
    return pack(pieces, SEQUENCE)


STAGES = [
    ("quality classifier", keep_quality),
    ("quality rules", keep_rules),
    ("near duplicates", drop_near_duplicates),
    ("substring dedup", cut_repeats),
    ("best-fit packing", pack_documents),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of ``sf_dir``; each one's result is written before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
