"""Accounting of usage events: deltas of counters, sums that keep unknowns, grouping sets, ledgers and paired bootstrap."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


_ORDER = ["ts", "event_id"]


def _by_slice(rows: DataFrame, slice_: str = "date_trunc('hour', ts)") -> tuple[DataFrame, Window, Window]:
    """Rows of a user cut into slices of time, so that a user with a third of all events is many short windows: (rows, within a slice, over the slices)."""
    return rows.withColumn("slice", F.expr(slice_)), Window.partitionBy("user_id", "slice").orderBy(*_ORDER), Window.partitionBy("user_id").orderBy("slice")


def counter_deltas(events: DataFrame) -> DataFrame:
    """``(user_id, event_id, segment, delta)`` of cumulative counters: equal repeats give nothing, a fall starts a new segment with its own value.

    Windows reach over one user's slice of time; the last value of the slice before and the number of falls up to it come from one row per slice. value is the counter.
    """
    rows, inside, over = _by_slice(events.select("user_id", "event_id", "ts", "value"))
    ends = rows.groupBy("user_id", "slice").agg(F.max_by("value", F.struct(*_ORDER)).alias("end"))
    given = ends.select("user_id", "slice", F.lag("end").over(over).alias("given"))
    rows = rows.join(given, ["user_id", "slice"]).withColumn("first", F.row_number().over(inside) == 1)
    rows = rows.withColumn("old", F.when(F.col("first"), F.col("given")).otherwise(F.lag("value").over(inside)))
    reset = F.col("old").isNull() | (F.col("value") < F.col("old"))
    rows = rows.withColumn("reset", reset.cast("int"))
    falls = rows.groupBy("user_id", "slice").agg(F.sum("reset").alias("falls"))
    earlier = falls.select("user_id", "slice", F.coalesce(F.sum("falls").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("earlier"))
    rows = rows.join(earlier, ["user_id", "slice"]).withColumn("segment", F.col("earlier") + F.sum("reset").over(inside)).withColumn("delta", F.when(F.col("reset") == 1, F.col("value")).otherwise(F.col("value") - F.col("old")))
    return rows.where("reset = 1 or delta <> 0").select("user_id", "event_id", "segment", F.round("delta", 4).alias("delta"))


def sums_with_unknowns(events: DataFrame, keys: list[str], value: str = "value", id: str = "event_id") -> DataFrame:
    """``(keys, n, total)`` where total is null if any value is unknown; repeated rows of one ``id`` count once, with the greatest value."""
    once = events.groupBy(*keys, id).agg(F.max(value).alias("v"))
    return once.groupBy(*keys).agg(F.count("*").alias("n"), F.round(F.when(F.count("v") == F.count("*"), F.sum("v")), 4).alias("total"))


def conflicts(events: DataFrame, key: list[str] = ("event_id",), content: list[str] = ("ts", "user_id", "event_type", "value", "props")) -> DataFrame:
    """``(key, n_versions)`` of keys that were delivered with different contents."""
    rows = events.groupBy(*key, F.xxhash64(*content).alias("v")).agg(F.count("*").alias("n"))
    return rows.groupBy(*key).agg(F.count("*").alias("n_versions")).where("n_versions > 1")


def campaign(events: DataFrame) -> DataFrame:
    """``(event_type, user_id, level, n, accepted, rate, per_accepted)`` per type and user, per type, per user and in all.

    A type of a user is a cell, its attempts are the events in order, and it is accepted if the last one has a value above the mean of
    the type. Ratios with nothing below are null.
    """
    means = events.groupBy("event_type").agg(F.avg("value").alias("mean"))
    cells = events.groupBy("event_type", "user_id").agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.max_by("value", F.struct("ts", "event_id")).alias("last"))
    cells = cells.join(means, "event_type").withColumn("ok", (F.col("last") > F.col("mean")).cast("long"))
    out = cells.cube("event_type", "user_id").agg(F.grouping_id().alias("level"), F.sum("n").alias("n"), F.sum("ok").alias("accepted"), F.count("*").alias("cells"), F.sum("total").alias("total"))
    return out.select("event_type", "user_id", F.col("level").cast("int").alias("level"), "n", "accepted", F.round(F.try_divide("accepted", "cells"), 6).alias("rate"), F.round(F.try_divide("total", "accepted"), 4).alias("per_accepted"))


def ledger(events: DataFrame, epoch: str = "date_trunc('day', ts)") -> DataFrame:
    """``(event_type, status, n)``: an item (user and type) is ``new`` at its first event, ``rehydrated`` at its first in a later epoch, else ``repeated``.

    Counts only: an item has one new event, and one rehydrated event for each of its other epochs.
    """
    epochs = events.groupBy("event_type", "user_id", F.expr(epoch).alias("epoch")).agg(F.count("*").alias("n"))
    items = epochs.groupBy("event_type", "user_id").agg(F.count("*").alias("epochs"), F.sum("n").alias("n"))
    total = items.groupBy("event_type").agg(F.count("*").alias("new"), F.sum(F.col("epochs") - 1).alias("rehydrated"), F.sum(F.col("n") - F.col("epochs")).alias("repeated"))
    return total.unpivot("event_type", ["new", "rehydrated", "repeated"], "status", "n").where("n > 0")


def read_audit(events: DataFrame) -> DataFrame:
    """``(verdict, n)`` over the other events of each user: ``same`` if the last purchase had an equal value class, ``changed`` if not, ``unknown`` before any.

    The last write is carried forward within a user's slice of time, and from slice to slice by one row each.
    """
    level = F.floor(F.col("value") / 10).cast("long")
    rows, inside, over = _by_slice(events.select("user_id", "event_id", "ts", (F.col("event_type") == "purchase").alias("write"), level.alias("level")))
    ends = rows.groupBy("user_id", "slice").agg(F.max_by("level", F.when(F.col("write"), F.struct(*_ORDER))).alias("end"))
    given = ends.select("user_id", "slice", F.last("end", ignorenulls=True).over(over.rowsBetween(Window.unboundedPreceding, -1)).alias("given"))
    before = F.last(F.when(F.col("write"), F.col("level")), ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.join(given, ["user_id", "slice"]).withColumn("written", F.coalesce(before, "given"))
    verdict = F.when(F.col("written").isNull(), "unknown").when(F.col("written") == F.col("level"), "same").otherwise("changed")
    return rows.where("not write").groupBy(verdict.alias("verdict")).agg(F.count("*").alias("n"))


def percentiles(events: DataFrame, buckets: int = 1024) -> DataFrame:
    """``(event_type, n, median, p95)`` by place in the sorted values: n // 2 and n * 95 // 100.

    Values are counted in equal ranges of a type, the ranges that hold the places are found from the counts, and only their distinct values are ordered.
    """
    rows = events.where("value is not null").select("event_type", "value")
    ends = rows.groupBy("event_type").agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.count("*").alias("n"))
    values = rows.groupBy("event_type", "value").agg(F.count("*").alias("c")).join(ends, "event_type")
    values = values.withColumn("bucket", F.coalesce(F.floor(F.try_divide((F.col("value") - F.col("lo")) * (buckets - 1), F.col("hi") - F.col("lo"))), F.lit(0)))
    by = Window.partitionBy("event_type").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counts = values.groupBy("event_type", "bucket").agg(F.sum("c").alias("b")).withColumn("before", F.sum("b").over(by) - F.col("b"))
    places = ends.select("event_type", "n", F.posexplode(F.array(F.floor(F.col("n") / 2), F.floor(F.col("n") * 95 / 100))).alias("which", "place"))
    asked = places.join(counts, "event_type").where((F.col("place") >= F.col("before")) & (F.col("place") < F.col("before") + F.col("b")))
    inside = Window.partitionBy("event_type", "which").orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    near = asked.join(values.select("event_type", "bucket", "value", "c"), ["event_type", "bucket"]).withColumn("upto", F.col("before") + F.sum("c").over(inside))
    hit = near.where(F.col("upto") > F.col("place")).groupBy("event_type", "n", "which").agg(F.min("value").alias("v"))
    pick = lambda k: F.max(F.when(F.col("which") == k, F.col("v")))
    return hit.groupBy("event_type", "n").agg(pick(0).alias("median"), pick(1).alias("p95"))


def _draw(seed: int, *key: str) -> Column:
    """A number from 0 to 1 from a hash of the key."""
    digits = F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in key])), 1, 12)
    return F.conv(digits, 16, 10).cast("double") / float(1 << 48)


def _poisson(draw: str) -> Column:
    """The Poisson number of mean 1 for a draw from 0 to 1."""
    weight = F.lit(0)
    for k in range(12):
        weight = weight + F.when(F.col(draw) >= sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)), 1).otherwise(0)
    return weight


def paired_bootstrap(pairs: DataFrame, resamples: int = 1000, seed: int = 7) -> DataFrame:
    """``(metric, ratio, low, high)``: the ratio of the sums of b and a over tasks, with a 95 % interval from resampled tasks.

    ``pairs`` has metric, task, a and b, one row per task. Each resample takes a task a Poisson number of times, drawn from a hash of seed, metric, task and resample, so that every task of the cluster draws for its own rows and
    sums per resample are combined before the shuffle; only ``resamples`` ratios of a metric meet in one row. The ends are the ratios at place int((n - 1) q). An
    interval is null if a resample has no sum for a.
    """
    numbered = pairs.select("metric", "task", "a", "b", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))).alias("resample")).withColumn("u", _draw(seed, "metric", "task", "resample")).withColumn("w", _poisson("u"))
    sums = numbered.groupBy("metric", "resample").agg(F.sum(F.col("a") * F.col("w")).alias("a"), F.sum(F.col("b") * F.col("w")).alias("b"))
    ratios = sums.groupBy("metric").agg(F.sort_array(F.collect_list(F.try_divide("b", "a"))).alias("r"), F.count(F.when(F.col("a") != 0, 1)).alias("n"))
    whole = pairs.groupBy("metric").agg(F.try_divide(F.sum("b"), F.sum("a")).alias("ratio"))
    ends = [F.when(F.col("n") == resamples, F.get("r", F.lit(int((resamples - 1) * q)))).alias(name) for name, q in (("low", 0.025), ("high", 0.975))]
    return whole.join(ratios, "metric", "left").select("metric", "ratio", *ends)


def attempts(events: DataFrame) -> DataFrame:
    """``(attempt, kind, status, started, finished)`` of a journal of ``started`` and ``finished`` events (attempt, event, at, kind): one row per attempt.

    status is ``finished``, ``interrupted_unknown`` for a start without an end, ``conflict`` for several starts or ends, ``orphan_end`` for an end without a start. Counted per attempt, combined before the shuffle.
    """
    is_start, is_end = F.col("event") == "started", F.col("event") == "finished"
    rows = events.where(F.col("attempt").isNotNull()).groupBy("attempt").agg(
        F.min("kind").alias("kind"), F.count(F.when(is_start, 1)).alias("s"), F.count(F.when(is_end, 1)).alias("e"), F.min(F.when(is_start, F.col("at"))).alias("started"), F.max(F.when(is_end, F.col("at"))).alias("finished"))
    status = F.when((F.col("s") > 1) | (F.col("e") > 1), "conflict").when(F.col("s") == 0, "orphan_end").when(F.col("e") == 0, "interrupted_unknown").otherwise("finished")
    return rows.select("attempt", "kind", status.alias("status"), "started", "finished")


def normalised_usage(usage: DataFrame) -> DataFrame:
    """``(request, provider, total, uncached, cached, valid)`` of request usage (request, provider, input, cached, created, output, reasoning).

    ``anthropic`` counts cached and created tokens beside its input, others within it. A request is valid if cached is at most total, created at most uncached and reasoning at most output; an unknown counter makes
    sums that need it null and the request not valid.
    """
    beside = F.col("provider") == "anthropic"
    total = F.when(beside, F.col("input") + F.col("cached") + F.col("created")).otherwise(F.col("input"))
    uncached = F.when(beside, F.col("input") + F.col("created")).otherwise(F.col("input") - F.col("cached"))
    valid = (F.col("cached") <= total) & (F.col("created") <= uncached) & (F.col("reasoning") <= F.col("output"))
    return usage.select("request", "provider", total.alias("total"), uncached.alias("uncached"), "cached", F.coalesce(valid, F.lit(False)).alias("valid"))


def page_fusion(pages: DataFrame) -> DataFrame:
    """``(collection, n_pages, n_records, n_repeated, complete)`` of pages (collection, page, offset, next_offset, record): records that pages of one collection share count once.

    A collection is complete if its first page begins at 0, each page begins where the one before says, and the last says nothing. One row per page reaches the window; a page's records are counted before.
    """
    per_page = pages.groupBy("collection", "page").agg(F.min("offset").alias("offset"), F.max("next_offset").alias("next_offset"), F.count("record").alias("n"))
    by = Window.partitionBy("collection").orderBy("offset", "page")
    linked = per_page.withColumn("given", F.lag("next_offset").over(by)).withColumn("first", F.row_number().over(by) == 1)
    ok = F.when(F.col("first"), F.col("offset") == 0).otherwise(F.col("given").eqNullSafe(F.col("offset")))
    chain = linked.groupBy("collection").agg(F.count("*").alias("n_pages"), F.sum("n").alias("n_all"), (F.min(F.coalesce(ok, F.lit(False)).cast("int")) == 1).alias("chained"), F.max_by(F.col("next_offset").isNull(), F.struct("offset", "page")).alias("ended"))
    records = pages.where("record is not null").groupBy("collection", "record").agg(F.count("*").alias("c")).groupBy("collection").agg(F.count("*").alias("n_records"))
    met = chain.join(records, "collection", "left")
    n = F.coalesce("n_records", F.lit(0))
    return met.select("collection", "n_pages", n.alias("n_records"), (F.col("n_all") - n).alias("n_repeated"), (F.col("chained") & F.col("ended")).alias("complete"))
