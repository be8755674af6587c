"""A corpus from documents to training batches: five stages, each written as Parquet and read again as the next one's input."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm import decontaminate, jaccard, packing, quality, toxicity
from tidewell.llm.common import materialize

#: Rows of a list of ids that may be broadcast.
MAX_BROADCAST_ROWS = 1_000_000
#: Columns that stages add for a while; they replace columns of these names.
ROW, QUALITY, TOXICITY = "_pipeline_row_", "_pipeline_quality_", "_pipeline_toxicity_"


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with a stored number for each row, so that rows that repeat an id, or have none, have a fate of their own."""
    return materialize(docs.withColumn(ROW, F.monotonically_increasing_id()), "keyed")


def _without(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """docs but those rows (one column, ROW); broadcast only while they are few."""
    gone = materialize(rows, "dropped-rows")
    return docs.join(F.broadcast(gone) if gone.count() <= MAX_BROADCAST_ROWS else gone, ROW, "left_anti").drop(ROW)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of quality, as a classifier sees it that learned from the labels outside the held-out fold."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score(docs, model, name=QUALITY).where(F.col(QUALITY) >= quality.THRESHOLD).drop(QUALITY)


def keep_civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not toxic, by their nearest labelled examples."""
    index = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, index, name=TOXICITY, evidence=False).where(F.col(TOXICITY) < toxicity.THRESHOLD).drop(TOXICITY)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, the first by id (nulls last), of each component of five-word shingle Jaccard of 0.8 and more."""
    docs = _keyed(docs)
    found = jaccard.jaccard_components(docs, 5, (80, 100), id_col=ROW).select(F.col("doc_id").alias(ROW), "component_id")
    rows = materialize(docs.select(ROW, "doc_id").join(found, ROW), "components")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", ROW)).alias("first")
    kept = rows.groupBy("component_id").agg(first).select(F.col("component_id").alias("_c_"), F.col(f"first.{ROW}").alias("_kept_"))
    gone = rows.join(kept, F.col("component_id") == F.col("_c_")).where(F.col(ROW) != F.col("_kept_")).select(ROW)
    return _without(docs, gone)


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    docs = _keyed(docs)
    found = decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col=ROW, near_terms=0)
    return _without(docs, found.where("contaminated").select(F.col("doc_id").alias(ROW)))


def pack_batches(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bucket, batch and place of every remaining document."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_quality),
    ("toxicity", keep_civil),
    ("near_duplicates", keep_one_of_each),
    ("decontamination", keep_uncontaminated),
    ("packing", pack_batches),
]
#: The classifiers' models can't be put in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; each stage's result is in shared storage before the next one reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
