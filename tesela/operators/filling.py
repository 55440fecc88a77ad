"""Missing numeric and categorical fields from similar records: other sources of the group, and nearby days of the source.

Every field gives three discrete variables: its own bin or category, that of the other sources of its group on that
day, and that of the same source on nearby days. A Chow-Liu tree is learnt over them from the counts of their pairs, all that
the driver sees; message passing gives each missing field's posterior for every distinct combination of evidence,
which is decoded to the most likely category or to the median of the most likely bin.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tesela.operators.quantiles import exact_quantile
from tesela.runtime import SMALL_TABLE_ROWS, cut, has_at_most, ready_workers, salted_lookup

# Statuses that count as present, upper ends of the rain bins in mm (the first bin is dry, the last open).
STATUSES = ["observed", "duplicate_collapsed", "missing_source"]
BIN_ENDS = [0.0, 1.0, 5.0, 10.0, 20.0, 40.0, 80.0]


def bin_of(v: Column, ends: list[float]) -> Column:
    """Number of the bin that holds a value, ``ends`` being the bins' closed upper ends; -1 for null."""
    out = F.when(v.isNull(), -1)
    for i, end in enumerate(ends):
        out = out.when(v <= end, i)
    return out.otherwise(len(ends))


class ChowLiu:
    """The tree with the greatest mutual information over variables of ``sizes`` states.

    ``pairs`` has the counts ``(a, b, state of a, state of b, n)`` of rows where both variables a < b are known, ``singles`` those of one ``(a, state, n)``.
    """

    def __init__(self, sizes: list[int], pairs: list[tuple], singles: list[tuple]):
        self.sizes = sizes
        self.joint = {(a, b): np.full((sizes[a], sizes[b]), 0.1) for a, b in combinations(range(len(sizes)), 2)}
        for a, b, x, y, n in pairs:
            self.joint[a, b][x, y] += n
        self.weight = {}
        for e, table in self.joint.items():
            table /= table.sum()
            self.weight[e] = float((table * np.log(table / np.outer(table.sum(1), table.sum(0)))).sum())
        self.joint |= {(b, a): t.T for (a, b), t in self.joint.items()}
        self.near: dict[int, list[int]] = {i: [] for i in range(len(sizes))}
        root = list(range(len(sizes)))
        for a, b in sorted(self.weight, key=lambda e: (-round(self.weight[e], 9), e)):
            if root[a] != root[b]:
                self.near[a].append(b)
                self.near[b].append(a)
                root = [root[a] if r == root[b] else r for r in root]
        self.own = [np.full(k, 0.1) for k in sizes]
        self.seen: list[set[int]] = [set() for _ in sizes]  # states that some row shows
        for a, x, n in singles:
            self.own[a][x] += n
            self.seen[a].add(x)
        self.own = [t / t.sum() for t in self.own]

    def posterior(self, target: int, combos: np.ndarray) -> np.ndarray:
        """Probabilities of the states of ``target`` for each row of known states (-1 is missing), by messages towards it; its own value is not evidence."""

        def message(node: int, to: int) -> np.ndarray:
            belief = np.ones((len(combos), self.sizes[node]))
            seen = combos[:, node] >= 0
            belief[seen] = 0
            belief[np.flatnonzero(seen), combos[seen, node]] = 1
            for other in self.near[node]:
                if other != to:
                    belief *= message(other, node)
            joint = self.joint[to, node]
            return belief @ (joint / joint.sum(1, keepdims=True)).T

        out = np.tile(self.own[target], (len(combos), 1))
        for other in self.near[target]:
            out = out * message(other, target)
        return out / out.sum(1, keepdims=True)


def learn_tree(counted: DataFrame, names: list[str], sizes: list[int], count: str = "_n") -> ChowLiu:
    """The tree over the integer columns ``names`` of counted combinations. Only counts of pairs of states are gathered, whatever the number of rows."""
    known = [F.col(f"`{n}`") >= 0 for n in names]
    state = lambda i: F.col(f"`{names[i]}`")
    cells = [F.when(known[a] & known[b], F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), state(a).alias("x"), state(b).alias("y"))) for a, b in combinations(range(len(names)), 2)]
    cells += [F.when(known[a], F.struct(F.lit(a).alias("a"), F.lit(-1).alias("b"), state(a).alias("x"), F.lit(-1).alias("y"))) for a in range(len(names))]
    rows = counted.select(F.explode(F.array_compact(F.array(*cells))).alias("c"), count).groupBy("c.a", "c.b", "c.x", "c.y").agg(F.sum(count).alias("n")).collect()
    return ChowLiu(sizes, [tuple(r) for r in rows if r.b >= 0], [(r.a, r.x, r.n) for r in rows if r.b < 0])


def evidence(rows: DataFrame, row: str, group: str, source: str, day: str, numeric: dict[str, list[float]], categorical: dict[str, list[str]], days: int) -> DataFrame:
    """``rows`` with ``own_<field>``, ``peer_<field>`` and ``near_<field>`` for each field: bin or category numbers, -1 where there is none.

    Source-days are aggregated before any join. A null group, source or day is no evidence for any other row; on the same day a
    repeated row of the source is evidence for a row that lacks the field, never for the row that has it.
    """
    fields = [*numeric, *categorical]
    code = {f: F.coalesce(*[F.when(F.col(f) == s, i) for i, s in enumerate(states)]) for f, states in categorical.items()}
    rows = rows.select(*rows.columns, *[F.col(f).cast("double").alias(f"_v_{f}") if f in numeric else code[f].alias(f"_v_{f}") for f in fields])
    mean = lambda c: F.sum(F.col(c).cast("decimal(24,9)")).cast("double") / F.count(c)  # noqa: E731  exact, so the order of rows doesn't matter
    one = lambda f, c: mean(c) if f in numeric else F.min(c)
    seen = cut(rows.groupBy(group, source, day).agg(*[one(f, f"_v_{f}").alias(f"_d_{f}") for f in fields]))
    known = seen.where(F.col(group).isNotNull() & F.col(source).isNotNull() & F.col(day).isNotNull())
    sums = [a for f in numeric for a in (F.sum(F.col(f"_d_{f}").cast("decimal(24,9)")).alias(f"_s_{f}"), F.count(f"_d_{f}").alias(f"_k_{f}"))]
    sums += [F.count_if(F.col(f"_d_{f}") == i).alias(f"_k{i}_{f}") for f, states in categorical.items() for i in range(len(states))]
    grouped = known.groupBy(group, day).agg(*sums)
    line = Window.partitionBy(source).orderBy("_day")
    own = seen.where(F.col(source).isNotNull() & F.col(day).isNotNull()).groupBy(source, day).agg(*[one(f, f"_d_{f}").alias(f"_o_{f}") for f in fields]).withColumn("_day", F.unix_date(day))
    before, after = line.rangeBetween(-days, -1), line.rangeBetween(1, days)
    spot = lambda f: F.when(F.col(f"_o_{f}").isNotNull(), F.struct(F.col("_day").alias("d"), F.col(f"_o_{f}").alias("v")))
    own = own.withColumns({f"_{s}_{f}": step(spot(f), ignorenulls=True).over(w) for f in fields for s, step, w in (("b", F.last, before), ("a", F.first, after))})

    def nearest(f: str) -> Column:
        b, a = F.col(f"_b_{f}"), F.col(f"_a_{f}")
        tie = (b.v + a.v) / 2 if f in numeric else F.least(b.v, a.v)
        back, ahead = F.col("_day") - b.d, a.d - F.col("_day")
        return F.when(b.isNull() | a.isNull(), F.coalesce(b.v, a.v)).when(back == ahead, tie).when(back < ahead, b.v).otherwise(a.v)

    own = own.select(source, day, *[f"_o_{f}" for f in fields], *[nearest(f).alias(f"_near_{f}") for f in fields])
    both = seen.join(grouped, [group, day], "left").join(own, [source, day], "left")

    def peers(f: str) -> Column:
        mine = F.col(f"_d_{f}")
        if f in numeric:
            left = F.col(f"_k_{f}") - F.when(mine.isNotNull(), 1).otherwise(0)
            return F.when(left > 0, (F.col(f"_s_{f}") - F.coalesce(mine.cast("decimal(24,9)"), F.lit(0))).cast("double") / left)
        others = [F.col(f"_k{i}_{f}") - F.when(mine == i, 1).otherwise(0) for i in range(len(categorical[f]))]
        return F.when(sum(others, F.lit(0)) > 0, -F.greatest(F.struct(F.lit(-1).cast("bigint").alias("n"), F.lit(0).alias("i")), *[F.struct(o.cast("bigint").alias("n"), F.lit(-i).alias("i")) for i, o in enumerate(others)]).i)

    key = [group, source, day]
    both = both.select(*[F.col(k).alias(f"_{k}") for k in key], *[peers(f).alias(f"_peer_{f}") for f in fields], *[f"_o_{f}" for f in fields], *[f"_near_{f}" for f in fields])
    full = rows.join(both, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in key], "left")
    numbered = lambda f, v: bin_of(v, numeric[f]) if f in numeric else F.coalesce(v, F.lit(-1)).cast("int")
    near = lambda f: F.when(F.col(f"_v_{f}").isNull(), F.coalesce(f"_o_{f}", f"_near_{f}")).otherwise(F.col(f"_near_{f}"))
    kept = [c for c in rows.columns if not c.startswith("_v_")]
    return full.select(*kept, *[numbered(f, v).alias(f"{n}_{f}") for f in fields for n, v in (("own", F.col(f"_v_{f}")), ("peer", F.col(f"_peer_{f}")), ("near", near(f)))])


def fill_missing(rows: DataFrame, row: str, group: str, source: str, day: str, numeric: dict[str, list[float]], categorical: dict[str, list[str]], days: int = 3) -> DataFrame:
    """``row`` and, for each field, ``<field>_llena`` and ``<field>_via`` for every row of ``rows``.

    ``numeric`` gives the upper ends of each numeric field's bins, ``categorical`` the categories of the others; null, and a text that is no category, is
    missing. ``*_via`` marks a missing cell that was filled: ``grupo`` if another ``source`` of the same ``group`` has the
    field that day, else ``tiempo`` if the same source has it at most ``days`` days away (on the same day in a repeated row
    included); ``*_llena`` holds the present or filled value and is null for cells that can't be filled. States that no row
    shows are not decoded to. Ties go to the lower bin and the earlier category. An empty table gives no rows.
    """
    fields = [*numeric, *categorical]
    names = [f"{n}_{f}" for f in fields for n in ("own", "peer", "near")]
    size = {f: len(numeric[f]) + 1 if f in numeric else len(categorical[f]) for f in fields}
    coded = cut(evidence(rows.select(row, group, source, day, *fields), row, group, source, day, numeric, categorical, days).drop(group, source, day))
    counted = cut(coded.groupBy(*names).agg(F.count(F.lit(1)).alias("_n")))
    tree = learn_tree(counted, names, [size[f] for f in fields for _ in range(3)])
    medians = {f: {r[0]: r[1] for r in exact_quantile(coded.where(F.col(f"own_{f}") >= 0), f"own_{f}", f, 0.5, "_m").collect()} for f in numeric}  # a row per bin
    hidden = {f: [k for k in range(size[f]) if k not in tree.seen[3 * i]] for i, f in enumerate(fields)}

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            combos, out = batch[names].to_numpy(int), batch[names].copy()
            for i, f in enumerate(fields):
                chance = np.round(tree.posterior(3 * i, combos), 12)
                chance[:, hidden[f]] = -1
                values = [medians[f].get(k) for k in range(size[f])] if f in numeric else categorical[f]
                out[f"_fill_{f}"] = pd.Series([values[k] if len(hidden[f]) < size[f] else None for k in chance.argmax(1)], out.index, float if f in numeric else object)
            yield out

    ready_workers(rows.sparkSession)
    kinds = ", ".join([*(f"`{n}` int" for n in names), *(f"`_fill_{f}` {'double' if f in numeric else 'string'}" for f in fields)])
    decoded = cut(counted.select(*names).mapInPandas(decode, kinds))
    out = coded.join(F.broadcast(decoded), names, "left") if has_at_most(decoded, SMALL_TABLE_ROWS) else salted_lookup(coded, decoded, names, spread=F.xxhash64(row))
    via = lambda f: F.when(F.col(f"own_{f}") >= 0, None).when(F.col(f"_fill_{f}").isNull(), None).when(F.col(f"peer_{f}") >= 0, "grupo").when(F.col(f"near_{f}") >= 0, "tiempo")
    out = out.withColumns({f"{f}_via": via(f) for f in fields})
    held = lambda f: F.when(F.col(f"own_{f}") >= 0, F.col(f).cast("double") if f in numeric else F.col(f)).when(F.col(f"{f}_via").isNotNull(), F.col(f"_fill_{f}"))
    return out.select(row, *[c for f in fields for c in (held(f).alias(f"{f}_llena"), F.col(f"{f}_via"))])


def fill_rain(lluvia: DataFrame, days: int = 3) -> DataFrame:
    """``row_id, mm_llena, mm_via, status_llena, status_via`` for every row of the rain table; see ``fill_missing``.

    A rain value is present if it is a number from 0 to 500, a status if it is one of STATUSES ignoring case and
    outer blanks.
    """
    status = F.lower(F.regexp_replace("lluvia_status", "^[\\s\\u00a0]+|[\\s\\u00a0]+$", ""))
    mm = F.when((F.col("lluvia_mm") >= 0) & (F.col("lluvia_mm") <= 500), F.col("lluvia_mm").cast("double"))
    rows = lluvia.select("row_id", "cuenca", "pluviometro", "fecha", mm.alias("mm"), F.when(status.isin(STATUSES), status).alias("status"))
    return fill_missing(rows, "row_id", "cuenca", "pluviometro", "fecha", {"mm": BIN_ENDS}, {"status": STATUSES}, days)


def filled_cells(filled: DataFrame) -> DataFrame:
    """``row_id, campo, via`` for each cell that was filled."""
    cells = F.array(F.struct(F.lit("lluvia_mm").alias("campo"), F.col("mm_via").alias("via")), F.struct(F.lit("lluvia_status").alias("campo"), F.col("status_via").alias("via")))
    return filled.select("row_id", F.explode(cells).alias("c")).where("c.via is not null").select("row_id", "c.campo", "c.via")
