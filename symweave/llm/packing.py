"""Filling containers of fixed capacity with items: best-fit decreasing over a segment tree of remaining capacities."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from symweave.session import ship, stage, width


class Room:
    """A segment tree over the remaining capacities 0..capacity: which of them have open containers."""

    def __init__(self, capacity: int):
        self.leaves = 1
        while self.leaves < capacity + 1:
            self.leaves *= 2
        self.open = [False] * (2 * self.leaves)
        self.runs: list[list] = [[] for _ in range(capacity + 1)]

    def add(self, room: int, first: int, count: int) -> None:
        """``count`` containers, numbered from ``first`` on, have ``room`` left."""
        self.runs[room].append((first, count))
        i = room + self.leaves
        while i and not self.open[i]:
            self.open[i] = True
            i //= 2

    def tightest(self, size: int) -> int:
        """The least room of at least ``size`` that some container has, -1 if there is none; logarithmic."""
        i = size + self.leaves
        if self.open[i]:
            return size
        while i > 1:
            if i % 2 == 0 and self.open[i + 1]:
                i += 1
                while i < self.leaves:
                    i = 2 * i if self.open[2 * i] else 2 * i + 1
                return i - self.leaves
            i //= 2
        return -1

    def take(self, room: int, most: int) -> tuple[int, int]:
        """Close at most ``most`` containers with that room: a run ``(first, count)`` of neighbouring numbers."""
        first, count = self.runs[room].pop()
        if count > most:
            self.runs[room].append((first + most, count - most))
            count = most
        if not self.runs[room]:
            i = room + self.leaves
            self.open[i] = False
            while i > 1 and not (self.open[i] or self.open[i ^ 1]):
                i //= 2
                self.open[i] = False
        return first, count


def best_fit_decreasing(sizes: list[tuple[int, int]], capacity: int, first: int = 0) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing of ``(size, number of items)``, sizes from 1 to ``capacity``.

    Items of one size are alike, so they are placed in runs: a run fills containers of equal room one after another, as many items to each
    as fit, which is where best fit puts them one by one. Returns segments ``(size, first item, items, first container, items per
    container)``: item k of a size stands in container ``first container + (k - first item) // items per container``. Containers are
    numbered from ``first`` on.
    """
    room, out = Room(capacity), []
    for size, items in sorted(sizes, reverse=True):
        at = 0
        while at < items:
            space = room.tightest(size)
            if space < 0:
                each = capacity // size
                count = max(1, (items - at) // each)
                start, space = first, capacity
                first += count
            else:
                each = space // size
                start, count = room.take(space, max(1, (items - at) // each))
            each = min(each, items - at)
            out.append((size, at, each * count, start, each))
            at += each * count
            room.add(space - size * each, start, count)
    return out


def _ranked(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Items of each size numbered from 0 on without a window over a whole size: (numbered items, sizes with their counts).

    Places within (size, block) come from a window, those before the block from the counts of the blocks.
    """
    counts = items.groupBy("budget", "capacity", "size", "block").agg(F.count("*").alias("n"))
    so_far = Window.partitionBy("budget", "size").orderBy("block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = counts.select("budget", "size", "block", (F.sum("n").over(so_far) - F.col("n")).alias("before"))
    inside = Window.partitionBy("budget", "size", "block").orderBy("doc_id", "part")
    placed = items.withColumn("rn", F.row_number().over(inside) - 1).join(before, ["budget", "size", "block"])
    return placed.withColumn("k", F.col("rn") + F.col("before")), counts.groupBy("budget", "capacity", "size").agg(F.sum("n").alias("n"))


#: Every item is packed once for each capacity, and so many capacities at once.
BUDGETS_AT_ONCE = 1000
#: So many segments of containers are broadcast; beyond it they are copied to every block of items and met by a shuffle.
BROADCAST_SEGMENTS = 200_000


def pack(sizes: DataFrame, budgets: DataFrame) -> DataFrame:
    """``(budget, doc_id, part, tokens, container)`` for every item and every capacity.

    ``sizes`` has doc_id and n_tokens, ``budgets`` budget and max_tokens. The number of items of each size, at most ``capacity`` rows a
    budget however many items there are, goes through :func:`best_fit_decreasing`; its segments are joined back to the
    items, which are numbered within their size by block. So no task holds the items of a budget, and the containers are those of best-fit decreasing over all.

    An item above the capacity is split into full containers and a rest that is packed like other items; part counts
    its pieces from 0. Items of no tokens lie in container 0. A null n_tokens is 0. Repeated rows are items of their own; a null doc_id is a document like others. Budgets with a
    null, zero or negative capacity are left out, equal budgets count once. No items give no rows. Containers are numbered from 0 without gaps. Extra columns are ignored.

    When the query is built, the budgets come to the driver, and items and segments are written to the shared folder.
    """
    ship(sizes.sparkSession)
    rooms = budgets.select("budget", F.col("max_tokens").cast("int").alias("capacity")).where("capacity > 0").dropDuplicates().collect()
    parts = [_pack(sizes, rooms[i : i + BUDGETS_AT_ONCE]) for i in range(0, max(1, len(rooms)), BUDGETS_AT_ONCE)]
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def _pack(sizes: DataFrame, rooms: list) -> DataFrame:
    all_rooms = F.array(*[F.struct(F.lit(r["budget"]).alias("budget"), F.lit(r["capacity"]).alias("capacity")) for r in rooms]).cast("array<struct<budget:string,capacity:int>>")
    docs = sizes.select("doc_id", F.coalesce("n_tokens", F.lit(0)).cast("int").alias("n_tokens"), F.monotonically_increasing_id().alias("row"), F.explode(all_rooms).alias("r"))
    each = docs.select("doc_id", "row", "n_tokens", "r.*").withColumn("full", F.floor(F.col("n_tokens") / F.col("capacity")).cast("int"))
    cut = F.transform(F.when(F.col("full") > 0, F.sequence(F.lit(0), F.col("full") - 1)).otherwise(F.array().cast("array<int>")), lambda i: F.struct(i.alias("part"), F.col("capacity").alias("size")))
    left = F.col("n_tokens") - F.col("full") * F.col("capacity")
    last = F.when((left > 0) | (F.col("full") == 0), F.array(F.struct(F.col("full").alias("part"), left.alias("size")))).otherwise(F.array().cast("array<struct<part:int,size:int>>"))
    blocks = max(64, 4 * width(sizes.sparkSession))
    pieces = each.select("budget", "capacity", "doc_id", "row", F.explode(F.concat(cut, last)).alias("p")).select("budget", "capacity", "doc_id", "p.part", "p.size", F.pmod(F.xxhash64("row", "p.part"), F.lit(blocks)).cast("int").alias("block"))
    pieces = stage(pieces, "items")
    ranked, counts = _ranked(pieces.where("size > 0"))

    def fill(rows: pd.DataFrame) -> pd.DataFrame:
        found = best_fit_decreasing(list(zip(rows["size"].tolist(), rows["n"].tolist())), int(rows["capacity"].iloc[0]))
        out = pd.DataFrame(found, columns=["size", "first_item", "items", "first_container", "each"])
        out.insert(0, "budget", rows["budget"].iloc[0])
        return out

    segments = stage(counts.groupBy("budget").applyInPandas(fill, "budget string, size int, first_item long, items long, first_container long, each long"), "segments")
    # an item's segment is the last that begins at or before its number
    marks = segments.groupBy("budget", "size").agg(F.array_sort(F.collect_list(F.struct("first_item", "first_container", "each"))).alias("segments"))
    if segments.count() <= BROADCAST_SEGMENTS:
        met = ranked.join(F.broadcast(marks), ["budget", "size"])
    else:
        met = ranked.join(marks.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))), ["budget", "size", "block"])
    found = met.withColumn("s", F.element_at(F.filter("segments", lambda s: s["first_item"] <= F.col("k")), -1))
    packed = found.select("budget", "doc_id", "part", F.col("size").alias("tokens"), (F.col("s.first_container") + F.floor((F.col("k") - F.col("s.first_item")) / F.col("s.each"))).cast("long").alias("container"))
    empty = pieces.where("size = 0").select("budget", "doc_id", "part", F.col("size").alias("tokens"), F.lit(0).cast("long").alias("container"))
    return packed.unionByName(empty)


def container_report(packed: DataFrame, budgets: DataFrame) -> DataFrame:
    """``(budget, capacity, n_containers, n_items, tokens, unused)`` per capacity."""
    per = packed.groupBy("budget", "container").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("items"))
    total = per.groupBy("budget").agg(F.count("*").alias("n_containers"), F.sum("items").alias("n_items"), F.sum("tokens").alias("tokens"))
    return total.join(budgets.select("budget", F.col("max_tokens").alias("capacity")).dropDuplicates(), "budget").select("budget", "capacity", "n_containers", "n_items", "tokens", (F.col("n_containers") * F.col("capacity") - F.col("tokens")).alias("unused"))
