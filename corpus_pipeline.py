"""Corpus pipeline: what is toxic or of low quality goes, near copies go but one, sources are mixed, documents are packed.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each stage's rows as Parquet to the
shared folder and rereads them as the next stage's ``docs``. All stages but the last return the columns of documents. Columns
that a stage doesn't know travel in one structure, so no name of theirs can clash with its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from motorlens.llm import near_copies as near_copies_
from motorlens.llm import op1_mixing, op2_packing, op4_quality, op8_toxicity
from motorlens.llm.store import dropped, packed, saved, table, unpacked


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity stays below the threshold of their language. A null or empty text is scored as one blank word;
    repeated rows stay or go together; without labels of both kinds all stay; an empty table stays empty; a very long text is scored
    whole, in spans."""
    model = op8_toxicity.train(docs, table(spark, sf_dir, "labels"))
    own = ("lang", "text")
    kept = op8_toxicity.scored(packed(docs, *own), model).where(F.col("score") < op8_toxicity.language_threshold(model))
    return unpacked(kept, docs.columns, *own)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality reaches the threshold; all, where there are no labels of both kinds to learn from. A null or empty
    text is scored as one chunk of zeros; repeated rows stay or go together; an empty table stays empty; a very long text is scored whole,
    chunk by chunk."""
    model = op4_quality.train(docs, table(spark, sf_dir, "labels"))
    if not model.fitted:
        return docs
    kept = op8_toxicity.scored(packed(docs, "text"), model).where(F.col("score") >= op4_quality.THRESHOLD)
    return unpacked(kept, docs.columns, "text")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts linked by a similarity of 0.8 or more of their five-word shingles: that with the
    smallest doc_id. Links come from operator 5 (SimHash, vantage-point trees, star contraction), each checked exactly, and an exact
    filter finds those between texts that these leave apart. Rows without a doc_id are told apart by nothing and stay; of repeated rows of one doc_id one stays; texts without
    words are copies of each other; an empty table stays empty; a very long text's words are cut out span by span. A tie can't be: of rows
that share a doc_id the one whose text has the smallest hash stays."""
    groups = near_copies_.near_copy_groups(docs)
    kept = groups.groupBy("group").agg(F.min("first_id").alias("kept")).where("kept is not null").select("kept")
    own = ("doc_id", "text")
    one = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"), "text")
    first = packed(docs, *own).join(kept, F.col("doc_id").cast("long") == F.col("kept"), "left_semi").withColumn("n", F.row_number().over(one)).where("n = 1")
    return unpacked(first, docs.columns, *own).unionByName(docs.where("doc_id is null"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their sources takes them. A null or empty text has size 0 and comes with its block; a null
    source is one of its own; repeated rows are drawn together; an empty table stays empty; a very long text is counted whole."""
    own = ("doc_id", "source", "text")
    return unpacked(op1_mixing.mix(packed(docs, *own)), docs.columns, *own)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of each piece in sequences of at most 2048 tokens. A null or empty text is one piece with the end id; repeated
    rows are packed each; an empty table gives no rows; a very long text is cut into many pieces."""
    return op2_packing.packed_documents(docs)


STAGES = [
    ("toxicity", toxicity),
    ("quality", quality),
    ("near copies", near_copies),
    ("mixing", mixing),
    ("packing", packing),
]

#: Two stages are trained classifiers, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, docs = docs, saved(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
        dropped(before)  # what a stage wrote is read by the next one only
    return docs
