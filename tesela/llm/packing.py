"""Items into containers of fixed capacity by bounded-space online packing.

Every partition keeps a fixed number of open windows, puts each item where it leaves least space, and emits the
fullest window when none has room. The windows still open at the end of the partitions are packed again,
as items, in ever fewer partitions.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesela.llm.tokens import VOCABULARY, encoder
from tesela.runtime import cut, ready_workers

#: Windows open at a time in a partition; leftover windows taken by one task of a merging round.
OPEN_WINDOWS, MERGED_TOGETHER = 64, 20_000
#: Rows of closed windows given out at a time; besides them a task holds only the rows of its open windows.
FRAME_ROWS = 10_000


class Packer:
    """Online best-fit packing with at most ``open_windows`` open windows; ids count up from ``first``."""

    def __init__(self, capacity: int, open_windows: int, first: int):
        self.capacity, self.open_windows, self.next = capacity, open_windows, first
        self.room: list[tuple[int, int]] = []  # (free, id), ascending
        self.held: dict[int, list[tuple]] = {}  # rows of the open windows
        self.done: list[tuple] = []  # rows of windows closed since the last frame

    def _close(self, window: int) -> None:
        self.done += [(*row, window, True) for row in self.held.pop(window)]

    def place(self, size: int, row: tuple) -> None:
        """Put an item of ``size`` into the window where it leaves least space, and keep its ``row`` there."""
        at = bisect_left(self.room, (size, -1))
        if at < len(self.room):
            free, window = self.room.pop(at)
        else:
            if len(self.room) == self.open_windows:
                self._close(self.room.pop(0)[1])
            free, window = self.capacity, self.next
            self.next += 1
            self.held[window] = []
        self.held[window].append(row)
        if free > size:
            insort(self.room, (free - size, window))
        else:
            self._close(window)

    def frames(self, columns: list[str], last: bool = False) -> Iterator[pd.DataFrame]:
        """A frame of the rows of closed windows, once there are enough or ``last``, when those of the open windows come too; adds the window and whether it is closed."""
        if last:
            self.done += [(*row, w, False) for w, rows in self.held.items() for row in rows]
        if self.done and (last or len(self.done) >= FRAME_ROWS):
            yield pd.DataFrame(self.done, columns=columns)
            self.done = []


def _first_id() -> int:
    return TaskContext.get().partitionId() << 33


def _pack(df: DataFrame, capacity: int, open_windows: int) -> DataFrame:
    """Pack the rows ``ventana, usado`` of each partition: adds ``a``, the window taken, and ``cerrada``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        packer, columns = Packer(capacity, open_windows, _first_id()), ["ventana", "usado", "a", "cerrada"]
        for batch in batches:
            for v, u in zip(batch.ventana.tolist(), batch.usado.tolist()):
                packer.place(u, (v, u))
            yield from packer.frames(columns)
        yield from packer.frames(columns, last=True)

    return df.mapInPandas(run, "ventana bigint, usado bigint, a bigint, cerrada boolean")


def pack_documents(documents: DataFrame, capacity: int, vocabulary: str = VOCABULARY, open_windows: int = OPEN_WINDOWS) -> DataFrame:
    """``doc_id, pieza, tok_ini, tok_fin, contenedor``: the container of each document or piece of one.

    A document of up to ``capacity`` tokens is whole (``pieza`` 0); a longer one is cut into pieces of ``capacity`` tokens, less
    where that would split a character, and a rest that is packed like any other item. Null and empty texts have
    no tokens and take no space; rows without an id are left out; repeated texts and ids are items of their own. No container exceeds ``capacity``.
    """
    if capacity < 8:
        raise ValueError("capacity must be at least 8 tokens")
    ready_workers(documents.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoding, lengths = encoder(vocabulary)
        packer, columns = Packer(capacity, open_windows, _first_id()), ["doc_id", "pieza", "tok_ini", "tok_fin", "ventana", "cerrada"]
        for batch in batches:
            for doc, text in zip(batch.doc_id.tolist(), batch.text.tolist()):
                tokens = encoding.encode_ordinary(text) if text else []
                cuts = [0, len(tokens)]
                if len(tokens) > capacity:
                    raw = np.frombuffer(text.encode(), np.uint8)
                    ends = np.cumsum(lengths[tokens])[:-1]
                    whole = np.append(np.flatnonzero((raw[ends] & 0xC0) != 0x80) + 1, len(tokens))
                    cuts = [0]
                    while cuts[-1] < len(tokens):
                        far = whole[np.searchsorted(whole, cuts[-1] + capacity, "right") - 1]
                        cuts.append(int(far) if far > cuts[-1] else cuts[-1] + capacity)
                for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    packer.place(b - a, (doc, i, a, b))
            yield from packer.frames(columns)
        yield from packer.frames(columns, last=True)

    packed = cut(documents.select("doc_id", "text").where("doc_id is not null").mapInPandas(run, "doc_id bigint, pieza int, tok_ini int, tok_fin int, ventana bigint, cerrada boolean"))
    done = packed.where("cerrada")
    rest = packed.where("not cerrada")
    windows = cut(rest.groupBy("ventana").agg(F.sum(F.col("tok_fin") - F.col("tok_ini")).alias("usado")))
    home = windows.select("ventana", F.col("ventana").alias("a"))
    round_no, parts = 0, 2
    while parts > 1:
        parts = max(1, math.ceil(windows.count() / MERGED_TOGETHER))
        round_no += 1
        # a round's windows get negative ids of their own, clear of those of the partitions and of other rounds
        merged = cut(_pack(windows.repartition(parts, "ventana").sortWithinPartitions(F.desc("usado"), "ventana"), capacity, open_windows).withColumn("a", -(F.col("a") + 1) - F.lit(round_no).cast("bigint") * F.lit(1 << 56)))
        home = cut(home.join(merged.select(F.col("ventana").alias("a"), F.col("a").alias("_to")), "a", "left").select("ventana", F.coalesce("_to", "a").alias("a")))
        windows = cut(merged.where("not cerrada").groupBy(F.col("a").alias("ventana")).agg(F.sum("usado").alias("usado")))
    moved = rest.join(home, "ventana").select("doc_id", "pieza", "tok_ini", "tok_fin", F.col("a").alias("contenedor"))
    return done.select("doc_id", "pieza", "tok_ini", "tok_fin", F.col("ventana").alias("contenedor")).unionByName(moved)


def container_fill(packed: DataFrame, capacity: int) -> DataFrame:
    """One row: containers, tokens, and the share of space left unused."""
    each = packed.groupBy("contenedor").agg(F.sum(F.col("tok_fin") - F.col("tok_ini")).alias("n"))
    return each.agg(F.count(F.lit(1)).alias("contenedores"), F.sum("n").alias("tokens"), F.max("n").alias("mayor"), (F.lit(1.0) - F.sum("n") / (F.count(F.lit(1)) * capacity)).alias("libre"))


def container_checks(packed: DataFrame, documents: DataFrame, capacity: int) -> DataFrame:
    """``control, valor``: documents packed, documents left out, containers beyond ``capacity``, pieces that don't follow on each other, and documents cut although they would fit."""
    size = F.col("tok_fin") - F.col("tok_ini")
    over = packed.groupBy("contenedor").agg(F.sum(size).alias("n")).where(F.col("n") > capacity)
    each = packed.groupBy("doc_id").agg(F.count(F.lit(1)).alias("piezas"), F.max("pieza").alias("ultima"), F.sum(size).alias("suma"), F.max("tok_fin").alias("fin"))
    lost = documents.select("doc_id").where("doc_id is not null").join(each, "doc_id", "left_anti")
    named = lambda name, df: df.agg(F.lit(name).alias("control"), F.count(F.lit(1)).alias("valor"))
    parts = [("documentos", each), ("perdidos", lost), ("excedidos", over), ("con_huecos", each.where("suma != fin or ultima != piezas - 1")), ("cortados_sin_motivo", each.where((F.col("piezas") > 1) & (F.col("fin") <= capacity)))]
    out = [named(n, df) for n, df in parts]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3]).unionByName(out[4])
