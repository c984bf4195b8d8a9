"""The engine's inputs built from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import concepts as C
from ..operators import graph, linking


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def turns(spark: SparkSession, d: str) -> DataFrame:
    """(source_file, idx, role, content) of the logged conversations."""
    role = F.when(F.col("role") == "user", "human").otherwise(F.col("role"))
    return table(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("source_file"), F.col("turn").alias("idx"), role.alias("role"), F.col("text").alias("content"))


def mentions(spark: SparkSession, d: str, role: str = "assistant") -> DataFrame:
    """The concepts that the rule-based extractor names, turn by turn."""
    return C.extract_by_rule(turns(spark, d).where(F.col("role") == role), ["source_file", "idx"])


def concepts(spark: SparkSession, d: str, role: str = "assistant") -> DataFrame:
    return C.group_by_slug(mentions(spark, d, role)).withColumn("status", F.lit("active"))


def links(spark: SparkSession, d: str) -> DataFrame:
    return linking.score_links(graph.stored(concepts(spark, d)))


def users_as_concepts(spark: SparkSession, d: str) -> DataFrame:
    """The users of the event log as concepts that their events reinforce."""
    seen = table(spark, d, "events").groupBy("user_id").agg(F.max("ts").alias("last_reinforced_at"), F.array_sort(F.collect_set("event_type")).alias("source_files"), F.round(F.avg("value") / 1000, 6).alias("confidence"))
    return seen.select(F.format_string("user-%d", "user_id").alias("slug"), F.format_string("User %d", "user_id").alias("name"), "last_reinforced_at", "source_files", F.least("confidence", F.lit(1.0)).alias("confidence"), F.lit("active").alias("status"))
