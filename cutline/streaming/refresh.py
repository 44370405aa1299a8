"""The daily refresh as a stream over a folder of saved pages."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cutline.functions.vocabulary import month_of_name
from cutline.operators import store
from cutline.shared import checkpoint_dir, stored
from cutline.sources import pages


def _stored(spark: SparkSession, fact: str, schema: StructType) -> DataFrame:
    """The fact as it is; empty before the first refresh."""
    try:
        return spark.read.schema(schema).parquet(fact).select(schema.names)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def failed_pages(spark: SparkSession, log: str) -> DataFrame:
    """(url) of the pages whose latest outcome in the log is an error."""
    try:
        outcomes = spark.read.parquet(log)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return spark.createDataFrame([], "url string")
    return outcomes.groupBy("url").agg(F.max_by(F.col("error").isNotNull(), "at").alias("bad")).where("bad").select("url")


def refresh(spark: SparkSession, folder: str, fact: str, checkpoint: str, mode: str = "full", log: str | None = None, attempts: int = 3, delay: float = 1.0, parse: Callable = pages.page_tables) -> None:
    """Take in all pages that are new in the folder, then stop.

    mode: "full" writes a page's values over stored ones of the same key; "incremental" passes over
    pages of months that are stored. Rows that vanish from a page stay. Replays change nothing: each
    month that a batch has is merged and overwritten as a whole. A page that cannot be parsed leaves the
    others alone. log: a folder for the outcome of each page (see pages.outcomes) with the seconds that
    its batch took; a batch that is run again replaces its own outcomes.

    With a log, pages that failed are read from the folder and tried again: `attempts` times in all, after `delay` seconds,
    then twice as many, and so on. Those that still fail are first in the next refresh. Without a log a failed page is
    not taken again, since the stream has passed it.
    """
    if mode not in ("full", "incremental"):
        raise ValueError(f"mode is full or incremental, not {mode!r}")
    checkpoint_dir(spark)

    def take(batch: DataFrame, number: int) -> None:
        began = time.time()
        found = batch.withColumn("publication_date", month_of_name(F.col("url"))).where("publication_date is not null")
        schema = pages.unpivot(pages.tables(found)).select(store.FACT).schema
        stored = _stored(spark, fact, schema)
        if mode == "incremental":
            found = store.new_bulletins(found, stored)
        rows = pages.tables(found, parse=parse).persist()
        new = store.upsert_cutoffs(spark.createDataFrame([], schema), pages.unpivot(rows), ["page_ix", "table_ix", "row_ix", "col_ix"]).persist()
        months = stored.join(new.select("publication_date").distinct(), "publication_date", "left_semi")
        # stored before the write, which replaces the files that it is read from
        store.write(months.join(new, store.KEY, "left_anti").unionByName(new).checkpoint(), fact)
        if log:
            pages.outcomes(rows).withColumns({"seconds": F.lit(time.time() - began), "at": F.lit(time.time())}).write.mode("overwrite").parquet(f"{log}/batch={number}")
        new.unpersist()
        rows.unpersist()

    def again() -> bool:
        """Tries the failed pages once more; whether there were any."""
        names = stored(failed_pages(spark, log))
        if names.isEmpty():
            return False
        saved = spark.read.text(folder, wholetext=True).select(F.col("_metadata.file_name").alias("url"), F.col("value").alias("content"))
        # an own batch for each try: numbers below 0, which the stream does not use
        tried = spark.read.parquet(log).agg(F.min("batch")).first()[0]
        take(saved.join(names, "url", "left_semi"), min(tried, 0) - 1)
        return True

    if log:
        again()
    files = spark.readStream.format("text").option("wholetext", True).load(folder).select(F.col("_metadata.file_name").alias("url"), F.col("value").alias("content"))
    files.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    for tries in range(1, attempts if log else 1):
        if failed_pages(spark, log).isEmpty():
            break
        time.sleep(delay * 2 ** (tries - 1))
        again()
