"""Keeping the fact and the bulletins current: keyed merges without a table format."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cutline.sources.bindings import KEY, last_wins

FACT = [*KEY, "cutoff_value", "cutoff_date", "is_current", "is_unavailable"]


def upsert_cutoffs(stored: DataFrame, batch: DataFrame, order: list[str]) -> DataFrame:
    """Stored rows with those of the batch in place of the same key; within the batch the last in `order` wins."""
    new = last_wins(batch.select(*FACT, *order), KEY, order).select(FACT)
    return stored.select(FACT).join(new, KEY, "left_anti").unionByName(new)


def upsert_bulletins(stored: DataFrame, batch: DataFrame) -> DataFrame:
    """One row per month; a stored URL stays unless it is empty."""
    new = batch.groupBy("publication_date").agg(F.max("url").alias("new_url"))
    return stored.join(new, "publication_date", "full").select("publication_date", F.coalesce(F.nullif("url", F.lit("")), "new_url").alias("url"))


def new_bulletins(links: DataFrame, stored: DataFrame) -> DataFrame:
    return links.join(stored.select("publication_date").distinct(), "publication_date", "left_anti")


def write(fact: DataFrame, path: str) -> None:
    """Overwrite the months that fact has, and no others."""
    fact.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("publication_date").parquet(path)
