"""Per-key results where a few keys hold most rows: fragment and replicate by estimated load."""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symweave.session import stage, width

#: Light keys are planned by hash bucket, so the plan has at most this many entries besides the large keys; a bucket takes as many tasks as its load asks for.
BUCKETS = 4096
#: A task gets about this many rows; there are at least as many tasks as shuffle partitions.
ROWS_PER_TASK = 100_000


def pack(loads: list[tuple[object, int]], tasks: int, least: int = 1) -> tuple[dict, dict]:
    """Bin-pack keys to tasks, largest first onto the least loaded task.

    A key above the mean load of a task, and above ``least``, is cut into shards in proportion to its load. Returns
    ``({key: [task of each shard]}, {task: load})``. Equal loads keep the order of ``loads``.
    """
    total = sum(n for _, n in loads)
    share = max(least, -(-total // max(1, tasks)))
    pieces = []
    for key, load in loads:
        shards = min(tasks, max(1, -(-load // share)))
        pieces += [(load / shards, key)] * shards
    pieces.sort(key=lambda p: -p[0])
    heap = [(0.0, t) for t in range(tasks)]
    placed: dict = {}
    for load, key in pieces:
        have, task = heapq.heappop(heap)
        placed.setdefault(key, []).append(task)
        heapq.heappush(heap, (have + load, task))
    return placed, {t: load for load, t in heap}


def _bucket(key: str) -> Column:
    return F.pmod(F.xxhash64(F.col(key)), F.lit(BUCKETS)).cast("int")


def load_plan(rows: DataFrame, key: str, tasks: int, least: int = 1) -> tuple[DataFrame, DataFrame, int]:
    """(tasks of each large key, tasks of each bucket, number of rows); the first two are small tables to broadcast.

    Two map-side combined counts: one by hash bucket (at most BUCKETS rows), one by key inside the buckets that hold
    more than a task's share. A large key has more than 1/tasks of the rows, so there are fewer than ``tasks`` of them. What is left of a bucket is cut in proportion to its
    load like a large key, but by the hash of the key, so that each of its light keys stays in one task.
    """
    spark = rows.sparkSession
    counted = {r["b"]: r["n"] for r in rows.groupBy(_bucket(key).alias("b")).agg(F.count("*").alias("n")).collect()}
    total = sum(counted.values())
    share = max(least, -(-total // tasks))
    full = [b for b, n in counted.items() if n > share]
    large: dict = {}
    if full:
        keys = rows.where(_bucket(key).isin(full)).groupBy(key, _bucket(key).alias("b")).agg(F.count("*").alias("n"))
        for r in keys.where(F.col("n") > share).collect():
            large[r[key]] = r["n"]
            counted[r["b"]] -= r["n"]
    loads = [(("key", k), n) for k, n in sorted(large.items(), key=lambda x: -x[1])]
    loads += [(("bucket", b), n) for b, n in sorted(counted.items()) if n]
    placed, _ = pack(loads, tasks, least)
    kind = rows.schema[key].dataType.simpleString()
    big = spark.createDataFrame([(k[1], s) for k, s in placed.items() if k[0] == "key"], f"_key {kind}, _shards array<int>")
    rest = spark.createDataFrame([(k[1], s) for k, s in placed.items() if k[0] == "bucket"], "_bucket int, _tasks array<int>")
    return big, rest, total


def slots(rows: DataFrame, key: str, plan: tuple, value: list[str]) -> DataFrame:
    """``rows`` with their task ``_slot``: a row of a large key lies in the shard of its ``value`` columns, one of a light key where its key does."""
    big, rest, _ = plan
    met = rows.withColumn("_bucket", _bucket(key)).join(F.broadcast(big.withColumnRenamed("_key", "_k")), F.col(key).eqNullSafe(F.col("_k")), "left").join(F.broadcast(rest), "_bucket", "left")
    return met.withColumn("_slot", F.coalesce(_shard("_shards", *value), _shard("_tasks", key, F.lit(1)), F.lit(0)).cast("int")).drop("_bucket", "_k", "_shards", "_tasks")


def _shard(tasks: str, *value: str | Column) -> Column:
    return F.when(F.col(tasks).isNotNull(), F.get(tasks, F.pmod(F.xxhash64(*value), F.size(tasks)).cast("int")))


def copies(rows: DataFrame, key: str, plan: tuple) -> DataFrame:
    """``rows`` of the matching side with every task ``_slot`` that may hold their key: all shards of a large key, one task of a light one."""
    big, rest, _ = plan
    met = rows.withColumn("_bucket", _bucket(key)).join(F.broadcast(big.withColumnRenamed("_key", "_k")), F.col(key) == F.col("_k"), "left").join(F.broadcast(rest), "_bucket", "left")
    return met.withColumn("_slot", F.explode(F.coalesce("_shards", F.array(F.coalesce(_shard("_tasks", key, F.lit(1)), F.lit(0)))))).drop("_bucket", "_k", "_shards", "_tasks")


def balanced_join(rows: DataFrame, key: str, side: DataFrame, side_key: str, *, spread_by: list[str], tasks: int | None = None) -> DataFrame:
    """``rows`` with the row of ``side`` that has their key (side_key, unique), where a few keys hold most rows: rows of a large key lie in shards by ``spread_by``, the side's row is copied to those shards.

    Rows without a match and null keys are left out. The load is counted when the query is built; ``rows`` should be a table or a staged result, as they are read for that too.
    """
    tasks = tasks or max(width(rows.sparkSession), -(-rows.count() // ROWS_PER_TASK))
    rows = rows.where(F.col(key).isNotNull())
    plan = load_plan(rows, key, tasks)
    placed = slots(rows, key, plan, spread_by).repartitionById(tasks, "_slot")
    copied = copies(side.where(F.col(side_key).isNotNull()), side_key, plan).withColumnRenamed("_slot", "_to").repartitionById(tasks, "_to")
    return placed.join(copied, (F.col("_slot") == F.col("_to")) & (F.col(key) == F.col(side_key))).drop("_slot", "_to")


def skewed_key_report(edges: DataFrame, nodes: DataFrame | None = None, *, key: str = "target", group: str = "kind", distinct: tuple[str, ...] = ("source", "file"), tasks: int | None = None) -> DataFrame:
    """Per ``(key, group)``: rows, distinct values of each column of ``distinct`` and the matching node.

    Rows are summed per (key, group, column, value) first, combined before their shuffle, so a value that comes very often with a key is one row from each task. Then
    fragment-replicate by estimated load: the load of each key is counted, keys are bin-packed to tasks, a key above
    a task's share is cut into proportionate shards, and its row of the matching side ``nodes`` is copied to exactly those
    shards. A sum is placed within its key's shards by its group, column and value, so that the
    distinct counts of the shards add up. Columns: key, group, n_rows, n_<column> for each column, node_name, node_kind,
    total_rows (rows of the whole input).

    Nulls: a null key or group is a key of its own; null values count as rows, not as distinct values. Repeated rows count as
    rows. Empty input gives no rows. Extra columns are ignored. A target with several nodes rows takes the one that
    is not removed, then the latest, then the greatest name; one without a node gets nulls.

    When the query is built, the sums are written to the shared folder and the load per bucket and of large keys comes to the driver; ``edges`` are read once.
    """
    spark = edges.sparkSession
    rows = edges.select(F.col(key).alias("_key"), F.col(group).alias("_group"), *[F.col(c).cast("string").alias(f"_v{i}") for i, c in enumerate(distinct)])
    facts = rows.select("_key", "_group", F.posexplode(F.array(*[F.col(f"_v{i}") for i in range(len(distinct))])).alias("_which", "_value"))
    sums = stage(facts.groupBy("_key", "_group", "_which", "_value").agg(F.count("*").alias("_n")), "sums")
    counted = sums.where("_which = 0").agg(F.sum("_n").alias("total")).first()["total"] or 0
    tasks = tasks or max(width(spark), -(-sums.count() // ROWS_PER_TASK))
    plan = load_plan(sums, "_key", tasks)
    placed = slots(sums, "_key", plan, ["_group", "_which", "_value"]).repartitionById(tasks, "_slot")
    # the aggregation and the join keep the placement: their keys begin with _slot
    n_rows = F.sum(F.when(F.col("_which") == 0, F.col("_n")).otherwise(0)).alias("n_rows")
    part = placed.groupBy("_slot", "_key", "_group").agg(n_rows, *[F.sum(((F.col("_which") == i) & F.col("_value").isNotNull()).cast("long")).alias(f"n_{c}") for i, c in enumerate(distinct)])

    if nodes is not None:
        side = nodes.select(F.col("id").alias("_id"), F.struct(F.col("removed_at").isNull().alias("alive"), F.col("indexed_at"), F.col("name"), F.col("kind")).alias("_node")).where(F.col("_id").isNotNull())
        side = copies(side, "_id", plan).repartitionById(tasks, "_slot").groupBy("_slot", "_id").agg(F.max("_node").alias("_node"))
        part = part.join(side.withColumnRenamed("_slot", "_s"), (F.col("_slot") == F.col("_s")) & (F.col("_key") == F.col("_id")), "left")
    else:
        part = part.withColumn("_node", F.lit(None).cast("struct<name:string,kind:string>"))
    out = [F.sum("n_rows").alias("n_rows"), *[F.sum(f"n_{c}").alias(f"n_{c}") for c in distinct], F.max("_node.name").alias("node_name"), F.max("_node.kind").alias("node_kind")]
    return part.groupBy(F.col("_key").alias(key), F.col("_group").alias(group)).agg(*out).withColumn("total_rows", F.lit(counted).cast("long"))


def heavy_keys(edges: DataFrame, nodes: DataFrame | None = None, *, share: float = 0.01, **kw) -> DataFrame:
    """The rows of :func:`skewed_key_report` with a non-null key that hold at least ``share`` of all rows; the whole report, nodes included, is written to the shared folder first."""
    found = stage(skewed_key_report(edges, nodes, **kw), "keys")
    return found.where(F.col(kw.get("key", "target")).isNotNull() & (F.col("n_rows") >= F.lit(share) * F.col("total_rows")))
