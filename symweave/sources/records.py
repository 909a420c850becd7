"""Reading, checking and keeping file records: text and hashes, JSON records, rule violations, versioned tables."""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from symweave.functions.scalars import language, repository
from symweave.operators.nested import flat_table, nested_objects
from symweave.session import scratch, stage, table

#: Directories that a scan leaves out; a scan's own cache folder is a parameter.
IGNORED = [".git", ".dart_tool", "build", "node_modules", "vendor", "target", "dist", ".venv", "venv", "__pycache__", ".mypy_cache", ".ruff_cache", ".pytest_cache", ".tox", ".nox", ".build", ".gradle", "DerivedData", ".tools"]
#: So many file names with several rows are broadcast; beyond it they are met by a shuffle.
BROADCAST_FILES = 200_000


def scan_directory(spark: SparkSession, root: str, pattern: str = "*", largest: int = 1 << 20, cache: str | None = None) -> DataFrame:
    """``(file, text, sha256, size, skipped)`` of the files below ``root``, without ignored directories and the folder ``cache``.

    A file above ``largest`` bytes has no text; it is ``skipped`` if its language is known.
    """
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    base = root.rstrip("/") + "/"
    file = F.element_at(F.split("path", base, 2), 2)
    left_out = F.array(*[F.lit(d) for d in [*IGNORED, *([cache] if cache else [])]])
    rows = rows.select(file.alias("file"), "length", "content").where(~F.arrays_overlap(F.split("file", "/"), left_out))
    large = F.col("length") > largest
    return rows.select("file", F.when(~large, F.decode("content", "UTF-8")).alias("text"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("size"), (large & (language("file") != "unknown")).alias("skipped"))


def one_text(sources: DataFrame) -> DataFrame:
    """``(file, text)``: one row per file with a text, the greatest of several.

    Names are counted first, so that only texts of files with several rows are shuffled; the others stay where they are read. Null files and texts are left out.
    """
    rows = sources.select("file", "text").where("file is not null and text is not null")
    several = stage(rows.groupBy("file").count().where("count > 1").select("file"), "several")
    several = F.broadcast(several) if several.count() <= BROADCAST_FILES else several
    return rows.join(several, "file", "left_anti").unionByName(rows.join(several, "file", "left_semi").groupBy("file").agg(F.max("text").alias("text")))


def hash_report(sources: DataFrame) -> DataFrame:
    """``(repo, n_files, n_missing, n_same, n_stale)``: whether the SHA-256 of each file's text is the one given; of several rows the greatest digest counts. Digests are shuffled, not texts."""
    digest = F.struct(F.sha2("text", 256).alias("digest"), F.col("sha256").alias("given"))
    rows = sources.where("file is not null").groupBy("file").agg(F.max(digest).alias("r"))
    there, same = F.col("r.digest").isNotNull(), F.col("r.digest").eqNullSafe(F.col("r.given"))
    count = lambda c: F.count(F.when(c, 1))
    return rows.groupBy(repository("file").alias("repo")).agg(F.count("*").alias("n_files"), count(~there).alias("n_missing"), count(there & same).alias("n_same"), count(there & ~same).alias("n_stale"))


def record_nodes(files: DataFrame) -> DataFrame:
    """``(file, id, name, kind, line, qualified, parent)`` of the nodes at the top of each current record, null for absent fields; the rows of :func:`nested_objects`, whatever shape the record has."""
    rows = flat_table(nested_objects(files), "nodes[]", ["id", "name", "kind", "line", "q", "parent"])
    return rows.select("file", *[F.col(f"f_{c}").alias(c) for c in ("id", "name", "kind", "line")], F.col("f_q").alias("qualified"), F.col("f_parent").alias("parent"))


def text_units(text: str, file: str) -> Column:
    """The length of a text in the units in which its language counts offsets: UTF-16 units, bytes for go, characters for others."""
    lang = language(file)
    return F.when(lang.isin("dart", "typescript", "javascript", "java"), F.octet_length(F.encode(text, "UTF-16BE")) / 2).when(lang == "go", F.octet_length(text)).otherwise(F.length(text)).cast("long")


def violations(nodes: DataFrame, edges: DataFrame, sources: DataFrame) -> DataFrame:
    """``(rule, n)``: rows that break a rule of records: spans, lines and offsets beyond the text in its language's units, ids outside their file, shape of externals, unresolved and repeated edges.

    Each text is measured where it is read; only its measures are shuffled.
    """
    measures = F.struct(F.sha2("text", 256).alias("digest"), text_units("text", "file").alias("units"), F.size(F.split("text", "\n")).alias("lines"))
    texts = sources.where("file is not null and text is not null").groupBy("file").agg(F.max(measures).alias("m")).select("file", "m.units", "m.lines")
    own = nodes.where("kind <> 'external'")
    met = own.join(texts, "file")
    parts = [
        own.where("line < 1 or end_line < line or length < 0").select(F.lit("bad_span").alias("rule")),
        own.where("not startswith(id, concat(file, '::'))").select(F.lit("foreign_id").alias("rule")),
        nodes.where("kind = 'external' and (id <> concat('uri::', file) or start_offset <> 0 or length <> 0 or line <> 0 or end_line <> 0)").select(F.lit("bad_external").alias("rule")),
        met.where("start_offset + length > units").select(F.lit("beyond_text").alias("rule")),
        met.where("end_line > lines").select(F.lit("beyond_lines").alias("rule")),
        edges.where("confidence <> 'resolved'").select(F.lit("unresolved").alias("rule")),
        edges.where("line < 1").select(F.lit("bad_site").alias("rule")),
        edges.groupBy("edge_id").agg(F.count("*").alias("n")).where("n > 1").select(F.lit("repeated_edge").alias("rule")),
    ]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows.groupBy("rule").agg(F.count("*").alias("n"))


MANIFEST = "version int, bucket int, full boolean, tag long, columns string"


class KeptTable:
    """A table in a shared folder, cut into buckets by its key; a change writes only the buckets that it touches.

    Every change is a folder of Parquet data and then one row per touched bucket in the table's manifest, appended in one file: until that is there, readers see the state
    before. A reader keeps the files it has opened. One writer at a time; ``tag`` tells which changes were made already.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, buckets: int = 32):
        self.spark, self.path, self.key, self.buckets = spark, path, key, buckets

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def _manifest(self) -> dict:
        """The newest change of every bucket; at most ``buckets`` rows reach the driver."""
        try:
            rows = self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifest")
        except AnalysisException:
            return {}
        newest = F.max(F.struct("version", "full", "tag", "columns")).alias("m")
        return {r["bucket"]: r["m"] for r in rows.groupBy("bucket").agg(newest).collect()}

    def tag(self) -> int | None:
        """The greatest tag of a change, null before the first."""
        return max((m["tag"] for m in self._manifest().values() if m["tag"] is not None), default=None)

    def _read(self, state: dict) -> DataFrame:
        schema = StructType.fromJson(json.loads(max(state.values(), key=lambda m: m["version"])["columns"]))
        paths = [f"{self.path}/v{m['version']}/_bucket={b}" for b, m in state.items() if m["full"]]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def read(self) -> DataFrame:
        state = self._manifest()
        if not state:
            raise ValueError("nothing was written")
        return self._read(state)

    def _put(self, rows: DataFrame, state: dict, touched: list[int], tag: int | None) -> None:
        version = max((m["version"] for m in state.values()), default=-1) + 1
        rows.withColumn("_bucket", self._bucket()).repartition(len(touched), "_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/v{version}")
        written = self.spark.read.schema(StructType([*rows.schema.fields, StructField("_bucket", IntegerType())])).parquet(f"{self.path}/v{version}")
        full = {r[0] for r in written.select("_bucket").distinct().collect()}
        entries = [(version, b, b in full, tag, rows.schema.json()) for b in touched]
        self.spark.createDataFrame(entries, MANIFEST).coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")

    def write(self, rows: DataFrame, tag: int | None = None) -> None:
        """Replace the whole table."""
        self._put(rows, self._manifest(), list(range(self.buckets)), tag)

    def upsert(self, rows: DataFrame, deleted: DataFrame | None = None, tag: int | None = None) -> None:
        """Replace the rows of all keys in ``rows`` and drop those in ``deleted``; only buckets that hold one of these keys are read and written."""
        state = self._manifest()
        if not state:
            self.write(rows, tag)
            return
        rows = stage(rows, "news")
        gone = rows.select(self.key) if deleted is None else rows.select(self.key).unionByName(deleted.select(self.key))
        gone = stage(gone.distinct(), "gone")
        touched = sorted(r[0] for r in gone.select(self._bucket()).distinct().collect())
        if touched:
            kept = self._read({b: m for b, m in state.items() if b in touched}).join(gone, self.key, "left_anti")
            self._put(kept.unionByName(rows), state, touched, tag)


def upsert_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """``(file, hash)``: the last snapshot, reached by keeping the first in a versioned table and writing only what changed in each later one."""
    from symweave.operators.diff import detect_changes, valid_snapshots

    kept = KeptTable(spark, scratch(spark, "files"), "file")
    rows = valid_snapshots(table(spark, d, "file_snapshots")).select("snapshot_no", "file", F.lower("hash").alias("hash"))
    numbers = sorted(r[0] for r in rows.select("snapshot_no").distinct().collect())
    for n in numbers:
        now = rows.where(F.col("snapshot_no") == n).drop("snapshot_no")
        if not numbers.index(n):
            kept.write(now)
            continue
        changes = detect_changes(kept.read(), now)
        kept.upsert(now.join(changes.where("change = 'changed'"), "file", "left_semi"), changes.where("change = 'deleted'"))
    return kept.read()
