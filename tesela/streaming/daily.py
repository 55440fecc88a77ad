"""Streaming forms of the daily summary and of the online median, equal to their batch forms."""

from __future__ import annotations

from bisect import insort
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesela.runtime import ready_workers


def daily_counts(events: DataFrame, stamp: str, key: str, value: str, late: str = "2 days") -> DataFrame:
    """Count and total per day and key; rows later than the watermark are left out. Works on a stream and on a table."""
    at = F.col(stamp).cast("timestamp")
    rows = events.select(at.alias("_at"), key, value)
    if events.isStreaming:
        rows = rows.withWatermark("_at", late)
    return rows.groupBy(F.window("_at", "1 day").alias("w"), key).agg(F.count(F.lit(1)).alias("filas"), F.sum(F.col(value).try_cast("decimal(18,4)")).cast("double").alias("total")).select(F.to_date("w.start").alias("fecha"), key, "filas", "total")


def running_median(values: DataFrame, key: str, value: str) -> DataFrame:
    """Per key and micro-batch: values so far and their median, with the sorted history as state."""

    def step(k: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        seen = list(state.get[0]) if state.exists else []
        for batch in batches:
            for v in batch[value].dropna():
                insort(seen, float(v))
        state.update((seen,))
        n = len(seen)
        yield pd.DataFrame({key: [k[0]], "n": [n], "mediana": [(seen[(n - 1) // 2] + seen[n // 2]) / 2 if n else None]})

    ready_workers(values.sparkSession)
    kind = dict(values.dtypes)[key]
    return values.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, n bigint, mediana double", "seen array<double>", "update", "NoTimeout")


def replayed(spark, path: str, schema, query: str, build, mode: str = "complete", files_per_batch: int = 1) -> DataFrame:
    """Run ``build(stream)`` over the files of a folder to the end and return the result table."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    run = build(stream).writeStream.outputMode(mode).format("memory").queryName(query).trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.table(query)
