"""What the pipeline's stages do with a documents table: filters, one of each group, copies by a mix.

Stages keep all columns of their input, whatever further ones there are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import crf_toxicity, lang_bloom, mixing, prefix_join
from .common import materialize, tune


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents with a toxicity score below a half. Null and empty texts have the score of no toxic tokens."""
    tune(docs.sparkSession)
    model = crf_toxicity.learn(docs, labels)
    return docs.where(crf_toxicity.score_udf(model)(F.col("text")) < 0.5)


def of_a_language(docs: DataFrame) -> DataFrame:
    """Documents that language identification gives a language. Null texts, those without a letter or without evidence and even splits go."""
    tune(docs.sparkSession)
    return docs.where(lang_bloom.accepted_udf(lang_bloom.learn(docs))(F.col("text")))


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs, and a column that tells its rows apart: doc_id, or where that has nulls or repeats, a new number (kept by writing the table)."""
    n = docs.agg(F.count(F.lit(1)).alias("rows"), F.count("doc_id").alias("ids")).first()
    if n["rows"] == n["ids"] and docs.groupBy("doc_id").count().where("count > 1").isEmpty():
        return docs, "doc_id"
    name = "row_number"
    while name in docs.columns:
        name += "_"
    return materialize(docs.withColumn(name, F.monotonically_increasing_id()), "numbered"), name


def one_of_each_group(docs: DataFrame) -> DataFrame:
    """Of each component of similar documents the one with the least id. Null texts and those without words are alone and stay."""
    tune(docs.sparkSession)
    rows, key = numbered(docs)
    joined = prefix_join.join(rows.select(F.col(key).alias("doc_id"), "text"))
    gone = joined.where("doc_id != component_id").select(F.col("doc_id").alias(key))
    return rows.join(gone, key, "left_anti").select(*docs.columns)


def mixed(docs: DataFrame) -> DataFrame:
    """Each document as often as the mix takes its words, to the nearest whole number (none, once or twice; a half counts up), in the order of the schedule.

    A copy stands where the schedule first takes a piece of that passage. Documents
    without words (null and empty texts too) take no part in a mix and go. Files
    are cut by ranges of slots and sorted within, so that they follow the schedule.
    """
    tune(docs.sparkSession)
    rows, key = numbered(docs)
    taken = mixing.mix(mixing.sized(rows.select(F.col(key).alias("doc_id"), "source", "text"), "doc_id"))
    copies = taken.where("size > 0").select(F.col("doc_id").alias(key), F.slice("passes", F.lit(1), F.round(F.col("taken") / F.col("size")).cast("int")).alias("_slots"))
    copies = copies.select(key, F.explode("_slots").alias("_slot"))
    return rows.join(copies, key).repartitionByRange("_slot").sortWithinPartitions("_slot", key).select(*docs.columns)
