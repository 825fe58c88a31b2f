"""A corpus from documents to packed training sequences, in five stages.

Each stage is written as Parquet and read again by the next, and its own tables
are deleted then; all but the last return the columns of documents. The stages
are held together by `run`.

Every stage takes nulls in any column, empty and very long texts, repeated rows,
further columns (which go no further) and an empty table, from which it makes an
empty one. What becomes of such rows is said at each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import classifier, mixing, ngram_join, packing, pii
from quire.llm.queries import PII_KEY
from quire.llm.workspace import Workspace, scratch

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Ids (8 bytes each) up to which dropped documents are broadcast, after they have been counted.
BROADCAST_IDS = 1_000_000


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores 0.3 or more. It learns from the labelled documents that reach it.

    Texts that are null or empty get the bias as their score; without a labelled document all score 0.5 and stay.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    weights = classifier.train(docs, labels.where(~held_out))
    return classifier.score(docs.select(*COLUMNS), weights).where("score >= 0.3").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links on five-word n-grams at a similarity of 0.8: the one with the least id.

    Of rows that share the kept id, the first by text, language and source stays. Rows without an id are all kept.
    """
    docs = docs.select(*COLUMNS)
    groups = ngram_join.similar_components(docs, size=5, percent=80)
    work = Workspace(spark)
    gone = work.table(groups.where("component_id <> doc_id").select("doc_id").distinct())
    again = work.table(groups.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"))
    n = gone.count()
    kept = docs.join(F.broadcast(gone) if n <= BROADCAST_IDS else gone, "doc_id", "left_anti")
    m = again.count()
    if not m:
        return kept.select(*COLUMNS)
    side = F.broadcast(again) if m <= BROADCAST_IDS else again
    twice = kept.join(side, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct(*COLUMNS[1:])).alias("row"))
    return kept.join(side, "doc_id", "left_anti").select(*COLUMNS).unionByName(twice.select("doc_id", "row.*"))


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data are replaced by pseudonyms, and the length is counted anew where a text has changed. Null and empty texts stay."""
    made = pii.pseudonymise(docs.select(*COLUMNS), key=PII_KEY)
    return made.withColumn("n_chars", F.when(F.size("pii") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources flattened until one is used twice; a document that is repeated has a row for each use, and none is left out.

    Rows without a source are a source of their own; documents without words are in each of their source's epochs.
    """
    return mixing.Mixture(docs.select(*COLUMNS)).realise()


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of each use of a document in the packed sequences; one without words has a row without a place."""
    return packing.pack(docs)


STAGES = [("quality classifier", quality), ("n-gram Jaccard join", near_duplicates), ("pii", private_data), ("mixing", mix), ("best-fit packing", pack)]

#: SQL can express neither the trained classifier nor keyed digests; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = Workspace(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        if k == len(STAGES) - 1:
            return stage(spark, docs, sf_dir)
        with scratch():
            after = work.table(stage(spark, docs, sf_dir))
        work.drop(docs)
        docs = after
