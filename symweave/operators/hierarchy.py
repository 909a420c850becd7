"""Parent-child links of unknown depth: paths, depths, roots, subtree sizes, descendants and cycles."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symweave.operators.skew import load_plan, slots
from symweave.session import ship, stage, width

#: A task holds about this many links; there are at least as many tasks as shuffle partitions.
LINKS_PER_TASK = 200_000
#: A batch of paths has about this many steps in all.
PATH_STEPS = 1_000_000


def _rows(batches: Iterator[pa.RecordBatch]) -> list[list]:
    """The columns of a whole partition, which holds about LINKS_PER_TASK rows."""
    table = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
    return [] if table is None else [c.to_pylist() for c in table.columns]


def _peel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Take away leaves while there are any in this partition; a node is a leaf when nothing of its ``kids`` is left."""
    columns = _rows(batches)
    if not columns:
        return
    ids, parents, slots, kids, size, height = columns
    place = {n: i for i, n in enumerate(ids)}
    done, local = [False] * len(ids), [False] * len(ids)
    ready = [i for i, k in enumerate(kids) if k == 0]
    while ready:
        i = ready.pop()
        done[i] = True
        above = place.get(parents[i])
        if above is not None and above != i:
            local[i] = True
            size[above] += size[i]
            height[above] = max(height[above], height[i] + 1)
            kids[above] -= 1
            if kids[above] == 0:
                ready.append(above)
    yield pa.RecordBatch.from_pydict({"id": pa.array(ids, pa.string()), "parent": pa.array(parents, pa.string()), "slot": pa.array(slots, pa.int32()), "kids": pa.array(kids, pa.int64()), "size": pa.array(size, pa.int64()), "height": pa.array(height, pa.int32()), "done": done, "local": local})


def _descend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hand paths down while the parent of a node is settled in this partition, depth first: only the path of the node at hand is kept, and rows leave as they are settled."""
    columns = _rows(batches)
    if not columns:
        return
    ids, parents, slots, size, height, above = columns
    below = defaultdict(list)
    place = set(ids)
    first = []
    for i, p in enumerate(parents):
        if p is None or above[i] is not None:
            first.append(i)
        elif p in place:
            below[p].append(i)
    settled = [False] * len(ids)
    rows: list[int] = []
    paths: list = []
    room = PATH_STEPS

    def batch() -> pa.RecordBatch:
        pick = lambda values, kind: pa.array([values[i] for i in rows], kind)
        out = {"id": pick(ids, pa.string()), "parent": pick(parents, pa.string()), "slot": pick(slots, pa.int32()), "size": pick(size, pa.int64()), "height": pick(height, pa.int32())}
        out |= {"path": pa.array(paths, pa.list_(pa.string())), "local": [parents[i] in place for i in rows]}
        return pa.RecordBatch.from_pydict(out)

    for start in first:
        path = list(above[start] or [])
        todo = [(start, len(path))]
        while todo:
            i, depth = todo.pop()
            del path[depth:]
            path.append(ids[i])
            settled[i] = True
            rows.append(i)
            paths.append(path.copy())
            room -= len(path)
            if room < 0:
                yield batch()
                rows, paths, room = [], [], PATH_STEPS
            todo += [(j, depth + 1) for j in below.get(ids[i], ())]
    waiting = [i for i, s in enumerate(settled) if not s]
    rows += waiting
    paths += [None] * len(waiting)
    yield batch()


def _links(nodes: DataFrame) -> tuple[DataFrame, int]:
    """One ``(id, parent, slot)`` per id with a parent that exists or null, placed near its file; and the number of tasks.

    Files are bin-packed to tasks by their number of links, which keeps most branches in one task; a file above LINKS_PER_TASK is cut by the hash of the id.
    """
    spark = nodes.sparkSession
    rows = nodes.select("id", "parent").where(F.col("id").isNotNull()).groupBy("id").agg(F.max("parent").alias("parent"))
    known = rows.select(F.col("id").alias("known"))
    rows = rows.join(known, F.col("parent") == F.col("known"), "left").select("id", F.col("known").alias("parent"))
    rows = stage(rows.withColumn("home", F.substring_index("id", "::", 1)), "links")
    tasks = max(width(spark), -(-rows.count() // LINKS_PER_TASK))
    plan = load_plan(rows, "home", tasks, LINKS_PER_TASK)
    return slots(rows, "home", plan, ["id"]).select("id", "parent", F.col("_slot").alias("slot")), tasks


def peel(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame, int]:
    """Bottom-up leaf peeling: (peeled nodes of each round, residual nodes, number of tasks).

    In a round every task peels what it can of its own links, then the sizes and heights of peeled nodes go to parents in other tasks. So
    rounds are counted by how often a branch changes task, not by its depth. What is left when no message is sent is exactly the nodes
    on cycles, as trees that hang below a cycle are peeled. All rounds run when the query is built; each is written to the shared folder.
    """
    spark = nodes.sparkSession
    ship(spark)
    links, tasks = _links(nodes)
    kids = links.where(F.col("parent").isNotNull()).groupBy("parent").agg(F.count("*").alias("kids")).withColumnRenamed("parent", "_p")
    rest = links.join(kids, F.col("id") == F.col("_p"), "left").select("id", "parent", "slot", F.coalesce("kids", F.lit(0)).cast("long").alias("kids"), F.lit(1).cast("long").alias("size"), F.lit(0).alias("height"))
    peeled = []
    schema = "id string, parent string, slot int, kids long, size long, height int, done boolean, local boolean"
    while True:
        out = stage(rest.repartitionById(tasks, "slot").mapInArrow(_peel, schema), "peel")
        peeled.append(out.where("done").select("id", "parent", "slot", "size", "height"))
        sent = out.where("done and not local and parent is not null")
        left = out.where("not done")
        if sent.isEmpty():
            return peeled, left, tasks
        news = sent.groupBy("parent").agg(F.count("*").alias("_k"), F.sum("size").alias("_s"), F.max(F.col("height") + 1).alias("_h")).withColumnRenamed("parent", "_p")
        rest = left.join(news, F.col("id") == F.col("_p"), "left").select("id", "parent", "slot", (F.col("kids") - F.coalesce("_k", F.lit(0))).alias("kids"), (F.col("size") + F.coalesce("_s", F.lit(0))).alias("size"), F.greatest("height", F.coalesce("_h", F.lit(0))).cast("int").alias("height"))


def cycle_nodes(nodes: DataFrame) -> DataFrame:
    """``(node_id)``: the nodes that reach themselves by following parent.

    A node that is its own parent is a case; nodes below a circle are none. Rows with a null id are left out, repeated rows count
    once, an id with several parents takes the greatest. Empty input gives no rows. Extra columns are ignored.
    """
    return peel(nodes)[1].select(F.col("id").alias("node_id"))


def _down(rest: DataFrame, tasks: int) -> tuple[DataFrame, DataFrame]:
    """(nodes with their path, nodes that no path reaches): ``above`` is the path to hand on, or null; a node without a parent starts one."""
    schema = "id string, parent string, slot int, size long, height int, path array<string>, local boolean"
    settled = []
    while True:
        out = stage(rest.repartitionById(tasks, "slot").mapInArrow(_descend, schema), "paths")
        new = out.where("path is not null")
        settled.append(new)
        waiting = out.where("path is null")
        door = waiting.where("not local").select(F.col("id").alias("_id"), F.col("parent").alias("_parent"))
        given = stage(door.join(new.select(F.col("id").alias("_p"), "path"), F.col("_parent") == F.col("_p")).select("_id", F.col("path").alias("above")), "doors")
        if given.isEmpty():
            break
        rest = waiting.join(given, F.col("id") == F.col("_id"), "left").select("id", "parent", "slot", "size", "height", "above")
    out = settled[0]
    for more in settled[1:]:
        out = out.unionByName(more)
    return out, waiting


def _settle(nodes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """(nodes of trees with their path, nodes below cycles, nodes on cycles, number of tasks)."""
    peeled, left, tasks = peel(nodes)
    rest = peeled[0]
    for more in peeled[1:]:
        rest = rest.unionByName(more)
    return *_down(rest.withColumn("above", F.lit(None).cast("array<string>")), tasks), left, tasks


def hierarchy(nodes: DataFrame) -> DataFrame:
    """``(node_id, parent, root, depth, path, n_descendants, height, status)`` for every id.

    Leaves are peeled bottom-up (:func:`peel`), which gives n_descendants and height; in reverse order, from the roots down, each
    node then takes its parent's path. status is ``tree``, ``cycle`` or ``below_cycle``; the last two have no root, depth or path, and nodes on a cycle
    no counts. A parent that is null or does not exist makes a root of depth 0; parent is then null. Other cases as in :func:`cycle_nodes`.
    """
    out, waiting, left, _ = _settle(nodes)
    tree = out.select(F.col("id").alias("node_id"), "parent", F.get("path", F.lit(0)).alias("root"), (F.size("path") - 1).alias("depth"), "path", (F.col("size") - 1).alias("n_descendants"), "height", F.lit("tree").alias("status"))
    no = [F.lit(None).cast("string").alias("root"), F.lit(None).cast("int").alias("depth"), F.lit(None).cast("array<string>").alias("path")]
    below = waiting.select(F.col("id").alias("node_id"), "parent", *no, (F.col("size") - 1).alias("n_descendants"), "height", F.lit("below_cycle").alias("status"))
    cycle = left.select(F.col("id").alias("node_id"), "parent", *no, F.lit(None).cast("long").alias("n_descendants"), F.lit(None).cast("int").alias("height"), F.lit("cycle").alias("status"))
    return tree.unionByName(below).unionByName(cycle)


def descendants(nodes: DataFrame) -> DataFrame:
    """``(ancestor, descendant, distance)`` for every node of a tree and each node above it.

    The pairs come out as rows, since a list of all descendants would put an unbounded tree into one row.
    """
    tree = hierarchy(nodes).where("status = 'tree'").select("node_id", "depth", F.posexplode(F.slice("path", 1, F.col("depth"))).alias("at", "ancestor"))
    return tree.select("ancestor", F.col("node_id").alias("descendant"), (F.col("depth") - F.col("at")).alias("distance"))


def _pairs(paths: DataFrame) -> DataFrame:
    """``(ancestor, descendant, distance)`` of each node and what stands before it in its path."""
    up = F.size("path") - 1
    return paths.select("id", up.alias("depth"), F.posexplode(F.slice("path", 1, up)).alias("at", "ancestor")).select("ancestor", F.col("id").alias("descendant"), (F.col("depth") - F.col("at")).alias("distance"))


def _rings(cycle: DataFrame) -> DataFrame:
    """``(ancestor, descendant, distance)`` of different nodes of one cycle: jumps of twice the length each round, so as many rounds as the logarithm of the longest cycle."""
    jump = cycle.select(F.col("id").alias("_from"), F.col("parent").alias("_to"))
    pairs = cycle.select(F.col("parent").alias("ancestor"), F.col("id").alias("descendant"), F.lit(1).alias("distance"))
    length, done = 1, []
    while True:
        pairs = stage(pairs, "rings")
        whole = pairs.where("ancestor = descendant").select(F.col("descendant").alias("_d"), F.col("distance").alias("_length"))
        done.append(pairs.join(whole, F.col("descendant") == F.col("_d")).where("distance < _length").select("ancestor", "descendant", "distance"))
        pairs = pairs.join(whole, F.col("descendant") == F.col("_d"), "left_anti")
        if pairs.isEmpty():
            break
        pairs = pairs.unionByName(pairs.join(jump, F.col("ancestor") == F.col("_from")).select(F.col("_to").alias("ancestor"), "descendant", (F.col("distance") + length).alias("distance")))
        again = jump.select(F.col("_from").alias("_mid"), F.col("_to").alias("_end"))
        jump = stage(jump.join(again, F.col("_to") == F.col("_mid")).select("_from", F.col("_end").alias("_to")), "jumps")
        length *= 2
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def all_descendants(nodes: DataFrame) -> DataFrame:
    """``(ancestor, descendant, distance)`` for every node, be it in a tree, on a cycle or below one, and each node above it.

    :func:`descendants` has the trees only. Nodes on a cycle are each other's descendants, with the shorter way up as their distance, and what hangs
    below a cycle descends from all of its nodes; no node is its own descendant. Below a cycle, paths are handed down from the nodes whose parent is on it as from roots.
    """
    tree, waiting, left, tasks = _settle(nodes)
    known = waiting.select(F.col("id").alias("_known"))
    first = F.when(F.col("_known").isNull(), F.array().cast("array<string>")).alias("above")
    below, _ = _down(waiting.join(known, F.col("parent") == F.col("_known"), "left").select("id", "parent", "slot", "size", "height", first), tasks)
    tops = below.where(F.size("path") == 1).select(F.col("id").alias("_top"), F.col("parent").alias("ancestor"))
    doors = below.select(F.get("path", F.lit(0)).alias("_first"), F.col("id").alias("descendant"), F.size("path").alias("distance")).join(tops, F.col("_first") == F.col("_top")).select("ancestor", "descendant", "distance")
    rings = _rings(left)
    ring = rings.select(F.col("ancestor").alias("_above"), F.col("descendant").alias("_at"), F.col("distance").alias("_more"))
    far = doors.join(ring, F.col("ancestor") == F.col("_at")).select(F.col("_above").alias("ancestor"), "descendant", (F.col("distance") + F.col("_more")).alias("distance"))
    return _pairs(tree).unionByName(_pairs(below)).unionByName(doors).unionByName(far).unionByName(rings)
