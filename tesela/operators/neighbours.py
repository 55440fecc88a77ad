"""Exact nearest neighbours of a query set against all rows, in blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tesela.operators.dedup import first_by
from tesela.runtime import ready_workers

#: Queries held on the executors at a time; queries whose distances to a batch are computed together.
BLOCK, TILE = 20_000, 1_000


class Best:
    """The ``k`` nearest rows so far of each of a set of queries."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, k: int):
        self.ids, self.q, self.k = ids, q, k
        self.query, self.row, self.dist = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)

    def _keep(self, query: np.ndarray, row: np.ndarray, dist: np.ndarray, most: int) -> tuple[np.ndarray, ...]:
        order = np.lexsort((row, dist, query))
        query, row, dist = query[order], row[order], dist[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        return query[place < most], row[place < most], dist[place < most]

    def see(self, xi: np.ndarray, x: np.ndarray) -> None:
        size = (x * x).sum(1)
        for a in range(0, len(self.ids), TILE):
            q = self.q[a : a + TILE]
            d = np.maximum(0, (q * q).sum(1)[:, None] - 2 * q @ x.T + size)
            d[self.ids[a : a + TILE, None] == xi] = np.inf
            # everything not beyond the k-th, with room for the rounding of these distances
            top = np.partition(d, min(self.k, d.shape[1]) - 1, axis=1)[:, min(self.k, d.shape[1]) - 1]
            query, at = np.nonzero((d <= (top + 1e-9 * (1 + top))[:, None]) & np.isfinite(d))
            exact = np.sqrt(((q[query] - x[at]) ** 2).sum(1))
            new = self._keep(query + a, xi[at], exact, self.k)
            old = (self.query >= a) & (self.query < a + TILE)
            kept = self._keep(*(np.concatenate([o[old], n]) for o, n in zip((self.query, self.row, self.dist), new)), self.k)
            self.query, self.row, self.dist = (np.concatenate([o[~old], n]) for o, n in zip((self.query, self.row, self.dist), kept))


def nearest(queries: DataFrame, rows: DataFrame, row: str, vector: str, k: int) -> DataFrame:
    """``consulta, vecino, dist, puesto``: the ``k`` nearest rows, by euclidean distance, of each query, itself left out; ties by id.

    Queries go to the executors in blocks of at most BLOCK rows; each task keeps and gives out only its ``k`` best per query, and
    those are ranked. Rows without a vector are left out; vectors must have one length.
    """
    spark, total = rows.sparkSession, queries.count()
    ready_workers(spark)
    blocks, out = max(1, -(-total // BLOCK)), None
    for block in range(blocks):
        own = queries.where(F.col(vector).isNotNull() & (F.pmod(F.xxhash64(row), F.lit(blocks)) == block)).select(row, vector).collect()
        shared = spark.sparkContext.broadcast((np.array([r[0] for r in own], np.int64), np.array([r[1] for r in own], float)))

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            ids, q = shared.value
            best = Best(ids, q, k)
            for batch in batches:
                if len(ids) and len(batch):
                    best.see(batch[row].to_numpy(np.int64), np.stack(batch[vector].to_numpy()).astype(float))
            yield pd.DataFrame({"consulta": ids[best.query], "vecino": best.row, "dist": best.dist})

        found = rows.where(F.col(vector).isNotNull() & F.col(row).isNotNull()).select(row, vector).mapInPandas(run, "consulta bigint, vecino bigint, dist double")
        out = found if out is None else out.unionByName(found)
    return out.withColumn("puesto", F.row_number().over(Window.partitionBy("consulta").orderBy("dist", "vecino"))).where(F.col("puesto") <= k)


def vote(near: DataFrame, labels: DataFrame, weight: Column | None = None) -> DataFrame:
    """``consulta, voto, votos``: the class with most votes among the neighbours, or with the greatest sum of ``weight``; ties go to the smaller class. ``labels`` is ``vecino, voto``."""
    total = F.count(F.lit(1)) if weight is None else F.round(F.sum(weight), 9)
    votes = near.join(labels, "vecino").groupBy("consulta", "voto").agg(total.alias("votos"))
    return first_by(votes, ["consulta"], F.desc("votos"), F.asc("voto"))
