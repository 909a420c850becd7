"""What changed between consecutive full snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _set_of(column: str, defaults: dict[str, str] | None = None) -> Column:
    """A list of structs as a set: no nulls, no repetition, in one order; null and empty lists are equal."""
    items = F.filter(F.col(column), lambda x: x.isNotNull())
    for field, value in (defaults or {}).items():
        items = F.transform(items, lambda x: x.withField(field, F.coalesce(x[field], F.lit(value))))
    return F.array_sort(F.array_distinct(F.coalesce(items, F.array().cast("array<void>"))))


def snapshot_changes(snapshots: DataFrame) -> DataFrame:
    """``(snapshot_no, file, change)`` for every file that was added, removed or changed since the snapshot before.

    Each row is reduced to a digest of its normalised content, the valid row of a (snapshot, file) is kept by a
    map-side combined maximum, and one window per file over the snapshot numbers does the rest: a lagging digest that
    differs is a change, a gap in the numbers is a removal followed by an addition. A window holds one short row per snapshot.

    Lists count as sets, null as empty; the case of hash does not matter, a null hash equals only null; a null confidence is
    ``resolved``. Of several rows the one with the greatest received_at counts, null being the least; on a tie the
    greatest digest. Rows with a null file or snapshot_no are no files and are left out. A number between the first and the last that has
    no rows is an empty snapshot. Empty input gives no rows. Extra columns are ignored.

    When the query is built, the first and last snapshot number are read.
    """
    content = F.struct(F.lower("hash").alias("hash"), _set_of("nodes").alias("nodes"), _set_of("edges", {"confidence": "resolved"}).alias("edges"))
    digest = F.unhex(F.sha2(F.to_json(content), 256))
    rows = snapshots.where(F.col("file").isNotNull() & F.col("snapshot_no").isNotNull())
    ends = rows.agg(F.min("snapshot_no"), F.max("snapshot_no")).first()
    first, last = (0, 0) if ends[0] is None else ends
    valid = rows.select("snapshot_no", "file", F.struct(F.col("received_at").alias("at"), digest.alias("digest")).alias("row")).groupBy("file", "snapshot_no").agg(F.max("row").alias("row"))
    by_file = Window.partitionBy("file").orderBy("snapshot_no")
    seen = valid.select("file", "snapshot_no", F.col("row.digest").alias("digest"), F.lag("snapshot_no").over(by_file).alias("before"), F.lag("row.digest").over(by_file).alias("old"), F.lead("snapshot_no").over(by_file).alias("after"))
    there = F.col("before").eqNullSafe(F.col("snapshot_no") - 1)
    here = F.when((F.col("snapshot_no") > first) & ~there, "added").when(there & (F.col("digest") != F.col("old")), "changed")
    gone = F.when((F.col("snapshot_no") < last) & ~F.col("after").eqNullSafe(F.col("snapshot_no") + 1), "removed")
    events = F.array(F.struct(F.col("snapshot_no").cast("int").alias("snapshot_no"), here.alias("change")), F.struct((F.col("snapshot_no") + 1).cast("int").alias("snapshot_no"), gone.alias("change")))
    return seen.select("file", F.explode(events).alias("e")).where(F.col("e.change").isNotNull()).select("e.snapshot_no", "file", "e.change")


def change_rates(snapshots: DataFrame) -> DataFrame:
    """Counts of :func:`snapshot_changes` per snapshot and change."""
    return snapshot_changes(snapshots).groupBy("snapshot_no", "change").agg(F.count("*").alias("n_files"))
