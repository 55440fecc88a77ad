"""Answers of slow outside services, kept in a cache table; the fetcher is passed in."""

from __future__ import annotations

import datetime as dt
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesela.operators.dedup import first_by
from tesela.runtime import cut, ready_workers
from tesela.sources.files import read_or_empty
from tesela.sources.sinks import append_history


def pending(scope: DataFrame, cache: DataFrame, keys: list[str], retry_failed: bool = False) -> DataFrame:
    """Keys of ``scope`` that the cache has no answer for; with ``retry_failed`` also those whose latest answer is an error."""
    latest = first_by(cache, keys, F.col("requested_at").desc_nulls_last())
    settled = latest.where("status not in ('pending', 'api_error', 'request_error')" if retry_failed else "status != 'pending'")
    return scope.join(settled.select(*keys), keys, "left_anti")


def fetch(todo: DataFrame, keys: list[str], fetcher: Callable[[dict], dict], order: list[str], budget: int, at: str) -> DataFrame:
    """Answers for the first ``budget`` keys in ``order``: the keys with ``status``, ``valor`` and ``requested_at`` = ``at``.

    ``fetcher`` gets a key as a dict and returns ``{"status": ..., "valor": ...}``; an exception becomes ``request_error``. The
    budget is the feature: each call costs.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for key in batch[keys].to_dict("records"):
                try:
                    answer = fetcher(key)
                except Exception as error:  # noqa: BLE001
                    answer = {"status": "request_error", "valor": str(error)}
                out.append({**key, "status": answer.get("status"), "valor": str(answer.get("valor")), "requested_at": at})
            yield pd.DataFrame(out, columns=[*keys, "status", "valor", "requested_at"])

    ready_workers(todo.sparkSession)
    chosen = todo.orderBy(*order).limit(budget).select(*keys)
    kinds = dict(todo.dtypes)
    return chosen.mapInPandas(run, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", status string, valor string, requested_at string")


def refreshed(cache: DataFrame, answers: DataFrame, keys: list[str]) -> DataFrame:
    """The cache with the latest answer per key."""
    return first_by(cache.unionByName(answers), keys, F.col("requested_at").desc_nulls_last(), F.col("status"))


def run_batches(scope: DataFrame, path: str, keys: list[str], fetcher: Callable[[dict], dict], order: list[str], batch_size: int = 250, most_batches: int = 4, most_seconds: float = 1_200.0, retry_failed: bool = False, fatal: tuple[str, ...] = ("denied", "over_limit"), clock: Callable[[], float] = time.time) -> DataFrame:
    """Fetch what ``scope`` still lacks, batch after batch, into the cache table at ``path``; one row per batch tells how it went.

    ``lote, pedidos, ok, errores, motivo``: why the run went on (``sigue``) or stopped: ``sin_pendientes``, ``lotes_agotados``, ``tiempo_agotado`` or ``estado_fatal``, when the
    service answered with one of ``fatal``. Every batch is appended before the next begins, so a run that breaks off loses at most
    one, and the next run goes on from the cache.
    """
    spark, began, log = scope.sparkSession, clock(), []
    kinds = dict(scope.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", status string, valor string, requested_at string"
    tried = spark.createDataFrame([], ", ".join(f"{k} {kinds[k]}" for k in keys))
    while True:
        todo = pending(scope.select(*keys).distinct(), read_or_empty(spark, path, schema), keys, retry_failed).join(tried, keys, "left_anti")
        reason = "lotes_agotados" if len(log) == most_batches else "tiempo_agotado" if clock() - began > most_seconds else "sin_pendientes" if todo.isEmpty() else ""
        if reason:
            log.append((len(log) + 1, 0, 0, 0, reason))
            break
        at = dt.datetime.fromtimestamp(clock(), dt.timezone.utc).isoformat()
        answers = cut(fetch(todo, keys, fetcher, order, batch_size, at))
        append_history(answers, path)
        tried = cut(tried.unionByName(answers.select(*keys)))  # a failed key is asked once a run
        states = {r[0]: r[1] for r in answers.groupBy("status").count().collect()}
        stop = any(s in fatal for s in states)
        log.append((len(log) + 1, sum(states.values()), states.get("ok", 0), sum(states.values()) - states.get("ok", 0), "estado_fatal" if stop else "sigue"))
        if stop:
            break
    return spark.createDataFrame(log, "lote int, pedidos bigint, ok bigint, errores bigint, motivo string")
