"""References to keys that are missing, deleted or arrive later, by bitmaps over dictionary-encoded keys.

Keys of references and parents get integers from one dictionary, numbered in key order inside range
partitions, so that neighbours share a word. A bitmap is kept as its non-empty 64-bit words, one row
each: per word and period for the references, per word and month of first load for the parents, whose bits
are added up from month to month. The AND-NOT of the two leaves the bits of references that had no living
parent when their period began; only those are decoded and looked at row by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tesela.runtime import cut, salted_lookup

_W = "[\\s\\u00a0]*"
_N = f"{_W}0*(\\d+)(?:\\.0*)?{_W}"


def pair_key(text: Column) -> Column:
    """The two numbers that a claim reference stands for, as ``t-o`` without leading zeros; null if it names none."""
    pattern = f"^{_N}[-/_\\u2010-\\u2015\\u2212]{_N}$"
    return F.when(text.rlike(pattern), F.regexp_replace(text, pattern, "$1-$2"))


def number_key(text: Column) -> Column:
    """The number that a reference stands for, without leading zeros; null if it names none."""
    return F.when(text.rlike(f"^{_N}$"), F.regexp_replace(text, f"^{_N}$", "$1"))


def _bits(df: DataFrame, *by: str) -> DataFrame:
    """Bitmap words of ``id`` per ``by``."""
    return df.select(F.shiftright("id", 6).alias("word"), F.expr("shiftleft(1L, cast(id & 63 as int))").alias("bit"), *by).groupBy("word", *by).agg(F.bit_or("bit").alias("bits"))


def orphan_references(refs: DataFrame, parents: DataFrame) -> DataFrame:
    """Classify references: ``ref_id, campo, clase, periodo`` for those that are missing, deleted or late.

    ``refs`` has ``ref_id, campo, key, at`` with one row per reference, a null ``key`` standing for a text that
    names no key; ``parents`` has ``campo, key, loaded, deleted`` with any number of rows per key: the earliest
    load counts, and one deleted row deletes the key. ``periodo`` is the month of ``at`` (null if that is null,
    and such a reference is never late). Repeated references each give a row. Empty inputs give no rows or
    only ``missing``. Hot keys are reduced to one row per key and period before any join, and the
    final lookup is salted.
    """
    refs = refs.select("ref_id", "campo", "key", "at", F.date_format("at", "yyyy-MM").alias("periodo"))
    keyed = refs.where(F.col("key").isNotNull())
    used = keyed.groupBy("campo", "key", F.coalesce("periodo", F.lit("")).alias("p")).agg(F.lit(1).alias("_one")).drop("_one")
    owners = parents.where(F.col("key").isNotNull()).groupBy("campo", "key").agg(F.min("loaded").alias("first_loaded"), F.max(F.coalesce("deleted", F.lit(False))).alias("gone"))
    codes = cut(used.select("campo", "key").unionByName(owners.select("campo", "key")).repartitionByRange("campo", "key").dropDuplicates(["campo", "key"]).sortWithinPartitions("campo", "key").withColumn("id", F.monotonically_increasing_id()))
    asked = _bits(used.join(codes, ["campo", "key"]).select("id", "p"), "p")
    alive = _bits(owners.where("not gone and first_loaded is not null").join(codes, ["campo", "key"]).select("id", F.date_format("first_loaded", "yyyy-MM").alias("since")), "since")
    # along the months of a word the parents' bits add up; a month's references come before the parents it loads
    months = asked.select("word", F.col("p").alias("month"), F.lit(0).alias("side"), "bits").unionByName(alive.select("word", F.col("since").alias("month"), F.lit(1).alias("side"), "bits"))
    upto = Window.partitionBy("word").orderBy("month", "side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    months = months.withColumn("have", F.bit_or(F.when(F.col("side") == 1, F.col("bits"))).over(upto)).where("side = 0")
    left = months.select("word", F.col("month").alias("p"), F.expr("bits & ~coalesce(have, 0L)").alias("bits")).where("bits != 0")
    places = F.explode(F.expr("filter(sequence(0, 63), x -> (shiftrightunsigned(bits, x) & 1L) = 1L)"))
    decoded = left.select("p", "word", places.alias("place")).select("p", (F.col("word") * 64 + F.col("place")).alias("id"))
    suspects = decoded.join(codes, "id").join(owners, ["campo", "key"], "left").select("campo", "key", "p", F.col("gone").isNotNull().alias("known"), "gone", "first_loaded")
    rows = keyed.withColumn("p", F.coalesce("periodo", F.lit("")))
    checked = salted_lookup(rows, suspects, ["campo", "key", "p"], "inner", spread=F.xxhash64("ref_id"))
    kind = F.when(~F.col("known"), "missing").when(F.col("gone"), "deleted").when(F.col("first_loaded") > F.col("at"), "late")
    no_key = refs.where(F.col("key").isNull()).select("ref_id", "campo", F.lit("missing").alias("clase"), "periodo")
    return checked.select("ref_id", "campo", kind.alias("clase"), "periodo").where("clase is not null").unionByName(no_key)


def task_orphans(tareas: DataFrame, reclamos: DataFrame, tareas_ref: DataFrame) -> DataFrame:
    """Orphan references of the task table to claims and to task kinds: ``tarea_row_id, campo, clase, periodo``."""
    one = lambda campo, key: F.struct(F.lit(campo).alias("campo"), key.alias("key"), F.col(campo).isNotNull().alias("given"))
    refs = tareas.select(F.col("tarea_row_id").alias("ref_id"), F.col("cargado_en").alias("at"), F.explode(F.array(one("reclamo_id", pair_key(F.col("reclamo_id"))), one("tarea_id", number_key(F.col("tarea_id"))))).alias("r"))
    refs = refs.where("r.given").select("ref_id", "r.campo", "r.key", "at")
    claims = reclamos.select(F.lit("reclamo_id").alias("campo"), F.coalesce(pair_key(F.col("reclamo_id")), F.concat_ws("-", F.col("numero_tramite").cast("string"), F.col("numero_orden").cast("string"))).alias("key"), F.col("cargado_en").alias("loaded"), F.col("baja_en").isNotNull().alias("deleted"))
    kinds = tareas_ref.select(F.lit("tarea_id").alias("campo"), number_key(F.col("tarea_id").cast("string")).alias("key"), F.col("alta_en").alias("loaded"), F.col("baja_en").isNotNull().alias("deleted"))
    return orphan_references(refs, claims.unionByName(kinds)).withColumnRenamed("ref_id", "tarea_row_id")


def orphan_counts(orphans: DataFrame) -> DataFrame:
    """Orphan references per parent table, kind and month: ``tabla, clase, periodo, referencias``."""
    parent = F.when(F.col("campo") == "reclamo_id", "reclamos_clean").otherwise("tareas_ref")
    return orphans.groupBy(parent.alias("tabla"), "clase", "periodo").agg(F.count(F.lit(1)).alias("referencias"))
