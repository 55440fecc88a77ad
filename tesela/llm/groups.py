"""Pairwise matches to groups by low-diameter decomposition.

Each level lets clusters grow from exponentially shifted start times until every node is reached, contracts every cluster
to one vertex, and recurses on the edges between clusters; the assignments are composed at the end. Edges,
labels and results are tables of the cluster; the driver sees only row counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesela.runtime import cut, salted_lookup

#: A node with more links than this, or than a ten-thousandth of all, has its links spread over SALTS tasks.
HOT_LINKS, SALTS = 1_000_000, 64


def _meet(links: DataFrame, end: str, other: str, nodes: DataFrame, hot: list) -> DataFrame:
    """Join ``links`` at ``end`` with ``nodes`` (one row per ``node``); the links of each of ``hot`` are spread over SALTS tasks."""
    nodes = nodes.withColumnRenamed("node", end)
    if not hot:
        return links.join(nodes, end)
    left = links.withColumn("_salt", F.when(F.col(end).isin(hot), F.pmod(F.xxhash64(other), F.lit(SALTS)).cast("int")).otherwise(0))
    right = nodes.withColumn("_salt", F.explode(F.when(F.col(end).isin(hot), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    return left.join(right, [end, "_salt"]).drop("_salt")


def _hot_ends(links: DataFrame, total: int) -> list:
    """The nodes whose links must be spread; at most 10,000 can have more than a ten-thousandth of all."""
    if total <= HOT_LINKS:
        return []
    bound = max(HOT_LINKS, total // 10_000)
    return [r[0] for r in links.groupBy("a").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > bound).select("a").collect()]


def looped(edges: DataFrame) -> DataFrame:
    """``a, b``: each edge both ways and once, and for each node a link to itself, which carries its own state over from hop to hop."""
    ways = F.explode(F.array(*[F.struct(F.col(x).alias("a"), F.col(y).alias("b")) for x, y in ("ab", "ba", "aa", "bb")])).alias("w")
    return edges.select(ways).select("w.a", "w.b").distinct()


def grow_clusters(links: DataFrame, beta: float, seed: int = 0, hot: list | None = None, hops_at_once: int = 6) -> DataFrame:
    """``node, label``: the low-diameter decomposition of the graph of ``links`` (see ``looped``).

    A node starts a cluster ``Exp(beta)`` hops early and takes the label of whoever reaches it first, so an edge is cut with a
    probability of at most ``1 - exp(-beta)`` and a cluster's radius is logarithmic in the number of nodes. Growth goes on until nothing changes; in each
    hop only nodes that were reached earlier than before go on to their neighbours. A centre always keeps its own label.
    """
    start = lambda c: F.ln((F.pmod(F.xxhash64(F.lit(seed), c), F.lit(1 << 53)) + 1) / float((1 << 53) + 1)) / beta
    self = F.col("a") == F.col("b")

    def hop(messages: DataFrame) -> DataFrame:
        """``node, at, label, moved`` from ``a, b, at, label``: the earliest of a node's own state and what its neighbours offer a hop later."""
        best = F.min(F.struct(F.when(self, F.col("at")).otherwise(F.col("at") + 1).alias("at"), "label")).alias("first")
        state = messages.groupBy(F.col("b").alias("node")).agg(best, F.max(F.when(self, F.col("at"))).alias("_own"))
        return state.select("node", F.col("first.at").alias("at"), F.col("first.label").alias("label"), (F.col("first.at") < F.col("_own")).alias("moved"))

    # starts are a function of the node, so the first hop needs no join
    state = hop(links.select("a", "b", start(F.col("a")).alias("at"), F.col("a").alias("label")))
    while True:
        for _ in range(hops_at_once):
            state = hop(_meet(links, "a", "b", state, hot or []).where(self | F.col("moved")))  # only moved nodes go on to their neighbours
        state = cut(state)
        if state.where("moved").isEmpty():
            return state.select("node", "label")


def low_diameter_groups(edges: DataFrame, beta: float = 0.4, max_levels: int = 200) -> DataFrame:
    """``node, root``: equal roots for exactly those nodes that the edges ``a, b`` link directly or indirectly.

    Null ends, self-pairs and repeated edges are ignored; nodes without an edge to another node don't appear. An
    empty input gives no rows. Links of hot nodes, and members of hot clusters when labels are composed, are salted. Each level leaves at
    most a share of ``1 - exp(-beta)`` of the edges in expectation; ``beta`` is halved from level to level, down to 0.1, as contracted
    graphs are narrow and larger clusters then save levels.
    """
    one = edges.select("a", "b").where("a is not null and b is not null and a != b")
    links = cut(looped(one))
    labels: list[tuple[DataFrame, int]] = []
    while total := links.count():
        if len(labels) == max_levels:
            raise RuntimeError(f"no end after {max_levels} levels")
        hot = _hot_ends(links, total)
        label = grow_clusters(links, max(0.1, beta / 2 ** len(labels)), len(labels), hot)
        labels.append((label, total))
        half = _meet(links.where("a < b"), "a", "b", label.withColumnRenamed("label", "la"), hot)
        between = _meet(half, "b", "a", label.withColumnRenamed("label", "lb"), hot).select(F.col("la").alias("a"), F.col("lb").alias("b"))
        links = cut(looped(between.where("a != b")))
    if not labels:
        return one.select(F.col("a").alias("node"), F.col("a").alias("root")).limit(0)
    out = labels[-1][0].select("node", F.col("label").alias("root"))
    for label, total in reversed(labels[:-1]):
        higher = out.select(F.col("node").alias("label"), "root")
        # a cluster's members all meet its one row, so hot clusters are spread by member
        parts = salted_lookup(label, higher, ["label"], spread=F.xxhash64("node")) if total > HOT_LINKS else label.join(higher, "label", "left")
        out = parts.select("node", F.coalesce("root", "label").alias("root"))
    return out


def territorial_groups(zonas: DataFrame, pares: DataFrame, zonificados: DataFrame) -> DataFrame:
    """``entidad, miembro, grupo`` for every destination and zone; see ``low_diameter_groups``.

    Destinations are linked by ``cluster_root`` and by pairs whose decision is match, zones by claims that carry several.
    ``grupo`` is the smallest member, destinations as numbers and zones as text; unlinked members are their own group.
    """
    known = zonas.where("destino_id is not null").select("destino_id").distinct()
    matched = pares.where(F.lower(F.regexp_replace("decision", "^[\\s\\u00a0]+|[\\s\\u00a0]+$", "")) == "match").select(F.col("destino_a").alias("a"), F.col("destino_b").alias("b"))
    pairs = zonas.select(F.col("destino_id").alias("a"), F.col("cluster_root").alias("b")).unionByName(matched).where("a != b")
    for end in ("a", "b"):
        pairs = pairs.join(known.withColumnRenamed("destino_id", end), end, "left_semi")
    pairs = pairs.select(F.concat(F.lit("d"), F.col("a").cast("string")).alias("a"), F.concat(F.lit("d"), F.col("b").cast("string")).alias("b"))
    carried = zonificados.where("zona_id is not null").select("reclamo_id", F.concat(F.lit("z"), "zona_id").alias("b"))
    several = carried.where("reclamo_id is not null").groupBy("reclamo_id").agg(F.min("b").alias("a"), F.max("b").alias("_last")).where("a != _last").select("reclamo_id", "a")
    shared = carried.join(several, "reclamo_id").where("a != b").select("a", "b")
    groups = low_diameter_groups(pairs.unionByName(shared))
    groups = groups.withColumn("_number", F.when(F.col("node").startswith("d"), F.substring("node", 2, 30)).try_cast("bigint"))
    least = groups.groupBy("root").agg(F.min("_number").alias("_n"), F.min("node").alias("_t"))
    named = salted_lookup(groups.drop("_number"), least, ["root"], "inner", spread=F.xxhash64("node")).select("node", F.coalesce(F.col("_n").cast("string"), F.expr("substring(_t, 2)")).alias("grupo"))
    members = known.select(F.concat(F.lit("d"), F.col("destino_id").cast("string")).alias("node")).unionByName(carried.select(F.col("b").alias("node")).distinct())
    miembro = F.expr("substring(node, 2)")
    entidad = F.when(F.col("node").startswith("d"), "destino").otherwise("zona")
    return members.join(named, "node", "left").select(entidad.alias("entidad"), miembro.alias("miembro"), F.coalesce("grupo", miembro).alias("grupo"))
