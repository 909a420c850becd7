"""References to records that do not exist at the time of the reference."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symweave.session import stage, width

#: The lifetimes, and the judged periods, of all heavy keys together are broadcast up to this many rows; beyond it they are met by a shuffle with salt.
BROADCAST_ROWS = 20_000
_END = "9999-12-31 00:00:00"
_NO_PERIOD = "0001-01-01"


def lifetimes(*tables: DataFrame) -> DataFrame:
    """``(id, born, died)`` of all tables, equal ones once; a record that is not removed dies at the end of time."""
    parts = [t.select("id", F.col("indexed_at").alias("born"), F.coalesce(F.col("removed_at"), F.lit(_END).cast(t.schema["removed_at"].dataType)).alias("died")) for t in tables]
    all_rows = parts[0]
    for p in parts[1:]:
        all_rows = all_rows.unionByName(p)
    return all_rows.where(F.col("id").isNotNull() & F.col("born").isNotNull()).groupBy("id", "born").agg(F.max("died").alias("died"))


def reference_ends(edges: DataFrame) -> DataFrame:
    """``(edge_id, side, key, at)``: both ends of every edge that are not null."""
    ends = F.array(F.struct(F.lit("source").alias("side"), F.col("source").alias("key")), F.struct(F.lit("target").alias("side"), F.col("target").alias("key")))
    return edges.select("edge_id", F.col("indexed_at").alias("at"), F.explode(ends).alias("e")).select("edge_id", "e.side", "e.key", "at").where(F.col("key").isNotNull())


def _month(at: str) -> Column:
    return F.trunc(F.col(at).cast("date"), "month")


def _period(at: str) -> Column:
    """The month, or a stand-in for references without a time, so that periods can be joined."""
    return F.coalesce(_month(at), F.lit(_NO_PERIOD).cast("date"))


def references_per_period(ends: DataFrame) -> DataFrame:
    """``(key, period, n_refs, first, last)``: references pre-aggregated per key and month of the reference, combined before the shuffle; first and last are the ends of their times."""
    return ends.groupBy("key", _period("at").alias("period")).agg(F.count("*").alias("n_refs"), F.min("at").alias("first"), F.max("at").alias("last"))


def judged_periods(refs: DataFrame, alive: DataFrame) -> DataFrame:
    """``(key, period, verdict)`` of the references per period that are not all met: ``all`` are orphans, or ``some`` may be.

    A record that lives through first to last meets every reference of the period, one that lives at no time between them meets none. A period without times is all orphans.
    """
    overlaps = (F.col("key") == F.col("_id")) & (F.col("born") <= F.col("last")) & (F.col("died") > F.col("first"))
    whole = (F.col("born") <= F.col("first")) & (F.col("died") > F.col("last"))
    verdict = F.max(F.when(F.col("_id").isNull(), 0).when(whole, 2).otherwise(1)).alias("v")
    met = refs.join(alive, overlaps, "left").groupBy("key", "period").agg(verdict)
    return met.where("v < 2").select("key", "period", F.when(F.col("v") == 0, "all").otherwise("some").alias("verdict"))


def heavy_keys(refs: DataFrame, tasks: int) -> list[str]:
    """Keys with more than 1/tasks of all references, of which there are fewer than ``tasks``, from counts per key and period."""
    total = refs.agg(F.sum("n_refs")).first()[0] or 0
    per_key = refs.groupBy("key").agg(F.sum("n_refs").alias("n")).where(F.col("n") > total / tasks)
    return [r["key"] for r in per_key.select("key").collect()]


def _salted(ends: DataFrame, side: DataFrame, salts: int) -> tuple[DataFrame, DataFrame]:
    """Both tables with a column ``_salt``: each row of ``ends`` has one of ``salts`` values, each of ``side`` all of them."""
    return ends.withColumn("_salt", F.pmod(F.xxhash64("edge_id", "at"), F.lit(salts)).cast("int")), side.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))


def orphan_references(edges: DataFrame, *tables: DataFrame, tasks: int | None = None) -> DataFrame:
    """``(edge_id, side, key, at)`` of every end of an edge that names no record alive at the edge's indexed_at.

    Skew-aware split: references are pre-aggregated per key and period, so that a hot key is one row a month. Keys with more than 1/``tasks`` of all references are heavy (fewer than ``tasks``, four times the
    shuffle partitions by default): their periods are checked against a broadcast of their own lifetimes, those of the other keys by a shuffled join. Edges come in only for periods with orphans: where all references are
    orphans they come out as they are, where some may be, each is checked at its own time. Edges of heavy keys meet a broadcast, or, past BROADCAST_ROWS rows, a shuffle with salt; others a shuffle. Both parts are united.

    A record is alive from indexed_at on and before removed_at; ids are compared byte for byte. Null ends are no references. An edge without
    indexed_at finds no record alive, so its ends are orphans. Edges delivered several times come out once. Empty nodes make every end an orphan. Extra columns are ignored.

    When the query is built, the references per period are counted and written to the shared folder, and the heavy keys come to the driver.
    """
    spark = edges.sparkSession
    tasks = tasks or 4 * width(spark)
    alive = lifetimes(*tables).select(F.col("id").alias("_id"), "born", "died")
    ends = reference_ends(edges).withColumn("period", _period("at"))
    refs = stage(references_per_period(ends), "references")
    heavy = heavy_keys(refs, tasks)
    is_heavy = F.col("key").isin(heavy) if heavy else F.lit(False)

    def small(side: DataFrame) -> bool:
        return side.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS

    def expanded(own: DataFrame, judged: DataFrame, own_alive: DataFrame) -> DataFrame:
        on = [c for c in ("key", "period", "_salt") if c in judged.columns]
        met = own.join(judged, on)
        fits = (F.col("key") == F.col("_id")) & (F.col("born") <= F.col("at")) & (F.col("died") > F.col("at"))
        if "_salt" in own_alive.columns:
            own_alive = own_alive.withColumnRenamed("_salt", "_s")
            fits = fits & (F.col("_salt") == F.col("_s"))
        left = met.where("verdict = 'some'").join(own_alive, fits, "left_anti")
        return met.where("verdict = 'all'").unionByName(left).select("edge_id", "side", "key", "at")

    light = refs.where(~is_heavy)
    found = expanded(ends.where(~is_heavy), stage(judged_periods(light, alive), "judged"), alive)
    if heavy:
        keys = spark.createDataFrame([(k,) for k in heavy], "_k string")
        own_alive = stage(alive.join(F.broadcast(keys), F.col("_id") == F.col("_k"), "left_semi"), "lifetimes")
        judged = stage(judged_periods(refs.where(is_heavy), F.broadcast(own_alive) if small(own_alive) else own_alive), "judged")
        own = ends.where(is_heavy)
        if small(own_alive) and small(judged):
            found = found.unionByName(expanded(own, F.broadcast(judged), F.broadcast(own_alive)))
        else:
            own, judged = _salted(own, judged, tasks)
            found = found.unionByName(expanded(own, judged, _salted(own, own_alive, tasks)[1]))
    return found.dropDuplicates(["edge_id", "side", "key", "at"])


def orphan_report(edges: DataFrame, *tables: DataFrame, tasks: int | None = None) -> DataFrame:
    """``(side, period, n_orphans, n_keys)``: orphan ends and their distinct keys per side of the edges table and month; pre-aggregated per key."""
    found = orphan_references(edges, *tables, tasks=tasks)
    per_key = found.groupBy("side", _month("at").alias("period"), "key").agg(F.count("*").alias("n"))
    return per_key.groupBy("side", "period").agg(F.sum("n").alias("n_orphans"), F.count("*").alias("n_keys"))
