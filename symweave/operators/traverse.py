"""Closures over the graph: one shuffle join a level, each level written to the shared folder."""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from symweave.functions.scalars import CONTAINERS, repository, test_path, utf16_order
from symweave.operators.skew import load_plan, slots
from symweave.session import Levels, ship, stage, width

#: Relations that carry a change from the target to the source.
IMPACT = ["references", "calls", "extends", "implements", "with", "on", "overrides", "registers", "imports", "exports", "part", "part_of"]
#: A task of the fixpoint over files holds about this many links.
LINKS_PER_TASK = 200_000
HEIRS = ["extends", "implements", "with", "overrides"]


def closure(starts: DataFrame, edges: DataFrame, kinds: list[str], *, reverse: bool = True, depth: int | None = None) -> DataFrame:
    """``(start, id, distance)``: the nodes that each of ``starts`` (column id) reaches over edges of ``kinds``, itself left out.

    Level by level: the new nodes of a level are joined with distinct pairs of ends, those seen before are taken out. Ends when a level is empty or at ``depth``.
    """
    here, there = ("target", "source") if reverse else ("source", "target")
    steps = stage(edges.where(F.col("kind").isin(kinds)).select(F.col(here).alias("a"), F.col(there).alias("b")).where("a is not null and b is not null").distinct(), "steps")
    levels = Levels(edges.sparkSession, "closure")
    last = levels.add(starts.select(F.col("id").alias("start"), F.col("id").alias("id")).distinct())
    while depth is None or levels.count <= depth:
        new = last.join(steps, F.col("id") == F.col("a")).select("start", F.col("b").alias("id")).distinct()
        last = levels.add(new.join(levels.all(), ["start", "id"], "left_anti"))
        if last.isEmpty():
            break
    return levels.all().where("level > 0").select("start", "id", F.col("level").alias("distance"))


def implementations(starts: DataFrame, edges: DataFrame) -> DataFrame:
    """Everything that extends, implements, mixes in or overrides the starts, over any number of steps."""
    return closure(starts, edges, HEIRS)


def ranked(rows: DataFrame, order: list[str], name: str = "place") -> DataFrame:
    """``rows`` with their place from 0 on in ``order`` as column ``name``, written to the shared folder.

    Rows are sorted by ranges, each range in a task of its own; a place is the one within the range and the number of rows in ranges before, so no task ranks all rows. Only the sizes of the ranges meet in one task.
    """
    placed = stage(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.partitionBy(F.lit(1)).orderBy("_part")) - F.col("_n")).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return placed.withColumn("_r", rank).join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_r") - 1).drop("_part", "_r", "_before")


def _edge_key() -> Column:
    return utf16_order(F.concat_ws("|", "source", "target", "kind", "file", F.col("start_offset").cast("string")))


def impact_ways(edges: DataFrame, known: DataFrame) -> DataFrame:
    """``(a, next, reason, cls, key)``: how a change goes from a node to the next: to the sources of its incoming edges, from a container to its members, to what it overrides, and to its parent unless that is a file.

    Of several sites of one way the first by the key of the edge stays. Only nodes are reached.
    """
    used = edges.where("source is not null and target is not null").where(F.col("kind").isin([*IMPACT, "contains"])).withColumn("key", _edge_key())
    incoming = used.where("kind <> 'contains'").select(F.col("target").alias("a"), F.col("source").alias("next"), F.col("kind").alias("reason"), F.lit(0).alias("cls"), "key")
    members = used.where("kind = 'contains'").join(known.where(F.col("kind").isin(CONTAINERS)).select("id"), F.col("source") == F.col("id")).select(F.col("source").alias("a"), F.col("target").alias("next"), F.lit("member_of_changed_container").alias("reason"), F.lit(1).alias("cls"), "key")
    bound = used.where("kind = 'overrides'").select(F.col("source").alias("a"), F.col("target").alias("next"), F.lit("dispatch_contract").alias("reason"), F.lit(2).alias("cls"), "key")
    folder = known.where("kind <> 'file'").select(F.col("id").alias("pid"))
    parents = known.where("parent is not null").select("id", "parent").join(folder, F.col("parent") == F.col("pid")).select(F.col("id").alias("a"), F.col("parent").alias("next"), F.lit("container_of_affected_member").alias("reason"), F.lit(3).alias("cls"), F.lit(b"").alias("key"))
    ways = incoming.unionByName(members).unionByName(bound).unionByName(parents).groupBy("a", "next", "reason", "cls").agg(F.min("key").alias("key"))
    return ways.join(known.select("id"), F.col("next") == F.col("id"), "left_semi")


def impact(seeds: DataFrame, edges: DataFrame, nodes: DataFrame, depth: int = 6) -> DataFrame:
    """``(id, distance, via, reason)``: what a change of all ``seeds`` (column id) affects within ``depth`` steps; seeds have distance 0.

    Ways are those of :func:`impact_ways`. Of several ways of one level the first counts, by the place of the node handing on in the order of discovery, the class of the way and the key of its edge; seeds stand in the
    order of their ids. nodes must be one row per id; only nodes are reached. One level is a join with the ways, an anti-join with what was reached and a sort by ranges.
    """
    known = stage(nodes.select("id", "kind", "parent"), "known")
    ways = stage(impact_ways(edges, known), "ways")
    none = F.lit(None).cast("string")
    first = seeds.select("id").join(known.select("id"), "id", "left_semi").distinct()
    levels = Levels(edges.sparkSession, "impact")
    last = levels.add(ranked(first.select("id", none.alias("via"), none.alias("reason"), utf16_order("id").alias("_o")), ["_o"]).drop("_o"))
    for _ in range(depth):
        best = F.min(F.struct("place", "cls", "key", "reason", F.col("id").alias("via"))).alias("w")
        met = last.select("id", "place").join(ways, F.col("id") == F.col("a")).groupBy("next").agg(best)
        seen = levels.all().select(F.col("id").alias("seen"))
        new = met.join(seen, F.col("next") == F.col("seen"), "left_anti").select(F.col("next").alias("id"), "w.via", "w.reason", F.col("w.place").alias("_p"), F.col("w.cls").alias("_c"), F.col("w.key").alias("_k"))
        last = levels.add(ranked(new, ["_p", "_c", "_k", "id"]).select("id", "via", "reason", "place"))
        if last.isEmpty():
            break
    return levels.all().select("id", F.col("level").alias("distance"), "via", "reason")


def impact_files(reached: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(file, distance, n_nodes)``: the files of the nodes that :func:`impact` reaches beyond the seeds, with the least distance."""
    return reached.where("distance > 0").join(nodes.select("id", "file"), "id").groupBy("file").agg(F.min("distance").alias("distance"), F.count("*").alias("n_nodes"))


def depth_limited(seeds: DataFrame, edges: DataFrame, nodes: DataFrame, depth: int) -> DataFrame:
    """``(depth, n_reached, n_files, depth_limited)``: how far a change goes within ``depth`` steps, and whether it would go on."""
    reached = stage(impact(seeds, edges, nodes, depth + 1), "reached")
    near = reached.where(F.col("distance") <= depth)
    files = impact_files(near, nodes).agg(F.count("*").alias("n_files"))
    counts = reached.agg(F.count(F.when((F.col("distance") > 0) & (F.col("distance") <= depth), 1)).alias("n_reached"), (F.count(F.when(F.col("distance") > depth, 1)) > 0).alias("depth_limited"))
    return counts.select(F.lit(depth).alias("depth"), "n_reached", "depth_limited").join(files).select("depth", "n_reached", "n_files", "depth_limited")


def paths(reached: DataFrame) -> DataFrame:
    """``(id, distance, path)``: the ids from a seed to every node of :func:`impact`, walked back over ``via`` one level at a time."""
    reached = stage(reached, "reached")
    levels = Levels(reached.sparkSession, "paths")
    last = levels.add(reached.where("distance = 0").select("id", "distance", F.array("id").alias("path")))
    while not last.isEmpty():
        above = last.select(F.col("id").alias("_a"), F.col("path").alias("_p"))
        last = levels.add(reached.where(F.col("distance") == levels.count).join(above, F.col("via") == F.col("_a")).select("id", "distance", F.concat("_p", F.array("id")).alias("path")))
    return levels.all().drop("level")


def path_to(pairs: DataFrame, edges: DataFrame, depth: int = 6) -> DataFrame:
    """``(start, destination, step, source, target, kind, file, start_offset)``: the relations of one shortest way from each start to its destinations, over calls and, in either direction, overrides.

    ``pairs`` has start and destination. The first way found counts: by the place of the node in the start's level, calls and overrides of its own before overrides of it, then kind and key of the edge. All
    starts go on level by level; ways that lead to no destination are dropped at the end by walking back. Pairs without a way within ``depth`` give no rows.
    """
    columns = ["source", "target", "kind", "file", "start_offset"]
    used = edges.where("kind in ('calls', 'overrides') and source is not null and target is not null").select(*columns, _edge_key().alias("key"))
    rank = F.struct("kind", "key")
    ways = used.select(F.col("source").alias("a"), F.col("target").alias("next"), F.lit(0).alias("way"), rank.alias("rank"), *columns)
    back = used.where("kind = 'overrides'").select(F.col("target").alias("a"), F.col("source").alias("next"), F.lit(1).alias("way"), rank.alias("rank"), *columns)
    edge = F.struct(*columns)
    first = F.min(F.struct("way", "rank", edge.alias("edge"))).alias("f")
    ways = stage(ways.unionByName(back).groupBy("a", "next").agg(first).select("a", "next", "f.way", "f.rank", "f.edge"), "ways")
    pairs = stage(pairs.select("start", "destination").where("start is not null and destination is not null and start <> destination").distinct(), "pairs")
    levels = Levels(edges.sparkSession, "shortest")
    none = F.lit(None)
    last = levels.add(pairs.select("start", F.col("start").alias("id")).distinct().select("start", "id", F.lit(0).cast("long").alias("place"), none.cast("string").alias("via"), none.cast("struct<source:string,target:string,kind:string,file:string,start_offset:bigint>").alias("edge")))
    by_place = Window.partitionBy("start").orderBy("w.place", "w.way", "w.rank", "next")
    for _ in range(depth):
        met = last.select("start", "id", "place").join(ways, F.col("id") == F.col("a")).groupBy("start", "next").agg(F.min(F.struct("place", "way", "rank", F.col("id").alias("via"), "edge")).alias("w"))
        seen = levels.all().select("start", F.col("id").alias("next"))
        new = met.join(seen, ["start", "next"], "left_anti")
        last = levels.add(new.select("start", F.col("next").alias("id"), (F.row_number().over(by_place) - 1).cast("long").alias("place"), "w.via", "w.edge"))
        if last.isEmpty():
            break
    reached = levels.all()
    found = Levels(edges.sparkSession, "steps")
    at = found.add(pairs.join(reached.select("start", F.col("id").alias("destination"), "level", "via", "edge").where("level > 0").withColumnRenamed("level", "step"), ["start", "destination"]).select("start", "destination", "step", "via", "edge"))
    for _ in range(depth):
        above = at.where("step > 1").select("start", "destination", (F.col("step") - 1).alias("_s"), F.col("via").alias("_v"))
        at = found.add(above.join(reached.select("start", F.col("id").alias("_v"), F.col("level").alias("_s"), "via", "edge"), ["start", "_v", "_s"]).select("start", "destination", F.col("_s").alias("step"), "via", "edge"))
        if at.isEmpty():
            break
    return found.all().select("start", "destination", "step", *[F.col(f"edge.{c}").alias(c) for c in columns])


def _relax(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hand rounds on within a partition: rows (slot, file, target, round, fresh) are links (round null) or files with their round; gives every round that got less, those of other slots as messages."""
    table = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
    if table is None or not table.num_rows:
        return
    rows = zip(*[table.column(c).to_pylist() for c in ("file", "target", "round", "fresh")])
    users, rounds, todo = defaultdict(list), {}, []
    for file, target, number, fresh in rows:
        if number is None:
            users[target].append(file)
        else:
            rounds[file] = number
            if fresh:
                todo.append((number, file))
    heapq.heapify(todo)
    less: dict[str, int] = {}
    while todo:
        number, file = heapq.heappop(todo)
        if number > rounds.get(file, number):
            continue
        for user in users.get(file, ()):
            if number + 1 < less.get(user, rounds.get(user, 1 << 30)):
                less[user] = number + 1
                if user in users or user in rounds:
                    rounds[user] = number + 1
                    heapq.heappush(todo, (number + 1, user))
    yield pa.RecordBatch.from_pydict({"file": pa.array(list(less), pa.string()), "round": pa.array(list(less.values()), pa.int32())})


def affected_files(changed: DataFrame, dependencies: DataFrame, scopes: DataFrame | None = None, groups: DataFrame | None = None) -> DataFrame:
    """``(file, round)``: files to index again: the ``changed``, and those that depend on one that is affected, over any number of steps; round is the least number of steps.

    ``dependencies`` has file and target. ``scopes`` has file and scope: a file of a touched scope is affected too, two steps after the file that touches it. ``groups`` has from_scope and
    to_scope: files of to_scope are affected by every file of from_scope, three steps on (a language that is built with another).

    Links lie in the task of their target's repository; a task hands rounds on as far as its links go, and only what leaves it is sent on. So rounds of jobs are counted by how often a chain changes
    task, not by its length. A repository above LINKS_PER_TASK links is cut by file.
    """
    spark = dependencies.sparkSession
    ship(spark)
    links = dependencies.select("file", "target").where("file is not null and target is not null")
    if scopes is not None:
        mark = lambda c: F.concat(F.lit("scope\u0000"), F.col(c))
        own = scopes.select("file", "scope").where("file is not null and scope is not null")
        links = links.unionByName(own.select(mark("scope").alias("file"), F.col("file").alias("target"))).unionByName(own.select("file", mark("scope").alias("target")))
        if groups is not None:
            links = links.unionByName(groups.select(mark("to_scope").alias("file"), mark("from_scope").alias("target")))
    links = stage(links.distinct().withColumn("home", F.regexp_replace(repository("target"), "^scope\u0000", "")), "links")
    tasks = max(width(spark), -(-links.count() // LINKS_PER_TASK))
    plan = load_plan(links, "home", tasks, LINKS_PER_TASK)
    placed = stage(slots(links, "home", plan, ["target"]).select(F.col("_slot").alias("slot"), "file", "target"), "placed")
    homes = placed.select("slot", F.col("target").alias("file")).distinct()
    rounds = stage(changed.select("file").where("file is not null").distinct().select("file", F.lit(0).alias("round"), F.lit(True).alias("fresh")), "rounds")
    while True:
        here = rounds.join(homes, "file").select("slot", "file", F.lit(None).cast("string").alias("target"), "round", "fresh")
        rows = placed.select("slot", "file", "target", F.lit(None).cast("int").alias("round"), F.lit(False).alias("fresh")).unionByName(here)
        less = rows.repartitionById(tasks, "slot").mapInArrow(_relax, "file string, round int").groupBy("file").agg(F.min("round").alias("new"))
        met = rounds.select("file", "round").join(less, "file", "full")
        rounds = stage(met.select("file", F.least("round", "new").alias("round"), (F.col("new").isNotNull() & (F.col("round").isNull() | (F.col("new") < F.col("round")))).alias("fresh")), "rounds")
        if rounds.where("fresh").isEmpty():
            break
    return rounds.where(~F.col("file").startswith("scope\u0000")).select("file", "round")


def nearest_scope(files: DataFrame, markers: DataFrame) -> DataFrame:
    """``(file, scope)``: for every file the deepest directory above it that is in ``markers`` (column dir), null for none: a longest-prefix join."""
    parts = F.split("file", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    rows = files.select("file").distinct().withColumn("dir", F.explode(above))
    found = rows.join(markers.select("dir").distinct().withColumn("hit", F.lit(True)), "dir", "left")
    depth = F.when(F.col("hit"), F.size(F.split("dir", "/")) - F.when(F.col("dir") == "", 1).otherwise(0))
    return found.groupBy("file").agg(F.max(F.struct(depth.alias("depth"), F.when(F.col("hit"), F.col("dir")).alias("dir"))).alias("m")).select("file", F.col("m.dir").alias("scope"))


def interval_islands(windows: DataFrame, key: str = "file", gap: int = 1) -> DataFrame:
    """``(key, start_line, end_line, n_windows)``: windows of lines merged where they overlap or touch.

    Equal windows are counted once each before the shuffle; a running maximum of the ends finds where an island begins.
    """
    distinct = windows.groupBy(key, "start_line", "end_line").agg(F.count("*").alias("n"))
    order = Window.partitionBy(key).orderBy("start_line", "end_line")
    before = F.max("end_line").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = distinct.withColumn("new", F.when(before.isNull() | (F.col("start_line") > before + gap), 1).otherwise(0)).withColumn("island", F.sum("new").over(order))
    return marked.groupBy(key, "island").agg(F.min("start_line").alias("start_line"), F.max("end_line").alias("end_line"), F.sum("n").alias("n_windows")).drop("island")


def contracts(starts: DataFrame, edges: DataFrame, depth: int = 6) -> DataFrame:
    """``(start, id, distance)``: declarations bound to the starts by overrides in either direction, within ``depth`` steps."""
    pairs = edges.where("kind = 'overrides'").select("source", "target")
    both = pairs.unionByName(pairs.select(F.col("target").alias("source"), F.col("source").alias("target"))).withColumn("kind", F.lit("overrides"))
    return closure(starts, both, ["overrides"], depth=depth)


def flow(starts: DataFrame, edges: DataFrame, depth: int = 3) -> DataFrame:
    """``(start, id, distance)``: what the starts call, over calls, and over overrides in either direction, within ``depth`` steps."""
    out = edges.where("kind in ('calls', 'overrides')").select("source", "target")
    back = edges.where("kind = 'overrides'").select(F.col("target").alias("source"), F.col("source").alias("target"))
    return closure(starts, out.unionByName(back).withColumn("kind", F.lit("flow")), ["flow"], reverse=False, depth=depth)


def tests_of(starts: DataFrame, edges: DataFrame, nodes: DataFrame, depth: int = 4) -> DataFrame:
    """``(start, id, file, distance)``: nodes of files that look like tests and reach the starts over references, calls and overrides."""
    reached = closure(starts, edges, ["references", "calls", "overrides"], depth=depth).withColumnRenamed("id", "node")
    places = nodes.where(test_path("file")).select("id", "file")
    return reached.join(places, F.col("node") == F.col("id")).select("start", "id", "file", "distance")
