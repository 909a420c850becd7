"""Differences between versions: files, declarations, relations with multiplicity, diagnostics and positions."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from symweave.functions.scalars import language
from symweave.session import ship, stage


def valid_snapshots(snapshots: DataFrame) -> DataFrame:
    """One row per (snapshot_no, file): the one received last, null times being the oldest."""
    row = F.struct("received_at", "hash", "nodes", "edges")
    kept = snapshots.where(F.col("file").isNotNull() & F.col("snapshot_no").isNotNull()).groupBy("snapshot_no", "file").agg(F.max(row).alias("r"))
    return kept.select("snapshot_no", "file", "r.hash", "r.nodes", "r.edges")


def detect_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """``(file, change)`` of two tables of file and hash: ``changed`` for a new or different hash, ``deleted``; a full outer join."""
    a, b = old.select(F.col("file").alias("f"), F.lower("hash").alias("h"), F.lit(True).alias("there")), new.select("file", F.lower("hash").alias("hash"), F.lit(True).alias("here"))
    met = a.join(b, F.col("f") == F.col("file"), "full")
    change = F.when(F.col("here").isNull(), "deleted").when(F.col("there").isNull() | ~F.col("h").eqNullSafe(F.col("hash")), "changed")
    return met.select(F.coalesce("file", "f").alias("file"), change.alias("change")).where("change is not null")


def file_changes(snapshots: DataFrame) -> DataFrame:
    """``(snapshot_no, file, change)`` of every snapshot against the one before, by hash alone: ``changed`` for a new or different hash, ``deleted``. One window per file over its snapshots."""
    ends = snapshots.agg(F.min("snapshot_no"), F.max("snapshot_no")).first()
    rows = valid_snapshots(snapshots).select("snapshot_no", "file", F.lower("hash").alias("hash"))
    by = Window.partitionBy("file").orderBy("snapshot_no")
    seen = rows.select("snapshot_no", "file", "hash", F.lag("snapshot_no").over(by).alias("before"), F.lag("hash").over(by).alias("old"), F.lead("snapshot_no").over(by).alias("after"))
    new = ~F.col("before").eqNullSafe(F.col("snapshot_no") - 1) | ~F.col("hash").eqNullSafe(F.col("old"))
    here = F.when((F.col("snapshot_no") > (ends[0] or 0)) & new, "changed")
    gone = F.when((F.col("snapshot_no") < (ends[1] or 0)) & ~F.col("after").eqNullSafe(F.col("snapshot_no") + 1), "deleted")
    events = F.array(F.struct("snapshot_no", here.alias("change")), F.struct((F.col("snapshot_no") + 1).cast("int").alias("snapshot_no"), gone.alias("change")))
    return seen.select("file", F.explode(events).alias("e")).where("e.change is not null").select("e.snapshot_no", "file", "e.change")


def relation_correspondence(snapshots: DataFrame, intervals: DataFrame | None = None) -> DataFrame:
    """``(snapshot_no, file, unchanged, relocated, uncertain, removed, added, removed_multiplicity, added_multiplicity)``: how the relations of a file answer to those of the snapshot before.

    In a file with an equal hash a site's position is its own; in a changed one it is where ``intervals`` (snapshot_no, file, before_start, after_start, length, before_line, after_line; see
    :func:`site_intervals`) put it, by an as-of join, or unknown. Equal relations are matched one to one as a multiset by counts, so no list of them is gathered. A site without a counterpart is ``uncertain`` if its
    position is unknown and the file is in both snapshots, else removed. Multiplicities compare the numbers of relations with equal source, target, kind and confidence.
    """
    ends = snapshots.agg(F.min("snapshot_no"), F.max("snapshot_no")).first()
    files = valid_snapshots(snapshots)
    now = files.select("snapshot_no", "file", F.lower("hash").alias("hash"))
    then = now.select((F.col("snapshot_no") + 1).cast("int").alias("snapshot_no"), "file", F.col("hash").alias("old_hash"), F.lit(True).alias("there"))
    pairs = now.withColumn("here", F.lit(True)).join(then, ["snapshot_no", "file"], "full").where((F.col("snapshot_no") > (ends[0] or 0)) & (F.col("snapshot_no") <= (ends[1] or 0)))
    pairs = pairs.select("snapshot_no", "file", F.coalesce("here", F.lit(False)).alias("here"), F.coalesce("there", F.lit(False)).alias("there"), (~(F.col("here").eqNullSafe(F.col("there")) & F.col("hash").eqNullSafe(F.col("old_hash")))).alias("moved"))
    edge = ["source", "target", "kind", "confidence", "line", "start_offset"]
    sites = files.select("snapshot_no", "file", F.explode("edges").alias("e")).where("e is not null").select("snapshot_no", "file", "e.source", "e.target", "e.kind", F.coalesce("e.confidence", F.lit("resolved")).alias("confidence"), "e.line", "e.start_offset")
    sites = sites.groupBy("snapshot_no", "file", *edge).agg(F.count("*").alias("n"))
    old = sites.withColumn("snapshot_no", (F.col("snapshot_no") + 1).cast("int")).join(pairs, ["snapshot_no", "file"]).withColumn("to_line", F.when(~F.col("moved"), F.col("line"))).withColumn("to_offset", F.when(~F.col("moved"), F.col("start_offset")))
    if intervals is not None:
        old = _relocated(old, intervals)
    old = old.withColumn("known", F.col("to_line").isNotNull() & F.col("to_offset").isNotNull())
    same = (F.col("line") == F.col("to_line")) & (F.col("start_offset") == F.col("to_offset"))
    moved = old.groupBy("snapshot_no", "file", "source", "target", "kind", "confidence", F.col("to_line").alias("line"), F.col("to_offset").alias("start_offset"), "known", "here").agg(F.sum("n").alias("m"), F.coalesce(F.sum(F.when(same, F.col("n"))), F.lit(0)).alias("stays"))
    new = sites.join(pairs.select("snapshot_no", "file"), ["snapshot_no", "file"], "left_semi").withColumnRenamed("n", "k")
    on = ["snapshot_no", "file", *edge]
    met = moved.where("known").join(new, on, "full").select(*on, F.coalesce("m", F.lit(0)).alias("m"), F.coalesce("stays", F.lit(0)).alias("stays"), F.coalesce("k", F.lit(0)).alias("k"))
    hit = F.least("m", "k")
    # a site that stays where it is takes its counterpart before one that moves there
    sure = met.select("snapshot_no", "file", F.least("stays", hit).alias("unchanged"), (hit - F.least("stays", hit)).alias("relocated"), F.lit(0).cast("long").alias("uncertain"), (F.col("m") - hit).alias("removed"), (F.col("k") - hit).alias("added"))
    zero = F.lit(0).cast("long")
    lost = moved.where("not known").select("snapshot_no", "file", zero.alias("unchanged"), zero.alias("relocated"), F.when(F.col("here"), F.col("m")).otherwise(zero).alias("uncertain"), F.when(F.col("here"), zero).otherwise(F.col("m")).alias("removed"), zero.alias("added"))
    kinds = ["unchanged", "relocated", "uncertain", "removed", "added"]
    per_file = sure.unionByName(lost).groupBy("snapshot_no", "file").agg(*[F.sum(c).alias(c) for c in kinds])
    key = ["snapshot_no", "file", "source", "target", "kind", "confidence"]
    signed = old.select(*key, (-F.col("n")).alias("w")).unionByName(new.select(*key, F.col("k").alias("w")))
    net = signed.groupBy(*key).agg(F.sum("w").alias("w")).groupBy("snapshot_no", "file").agg(F.sum(F.greatest(-F.col("w"), zero)).alias("removed_multiplicity"), F.sum(F.greatest("w", zero)).alias("added_multiplicity"))
    return per_file.join(net, ["snapshot_no", "file"])


def review(snapshots: DataFrame) -> DataFrame:
    """``(snapshot_no, section, phase, source, target, kind, file, line, start_offset, n)``: the evidence that a review of each snapshot against the one before needs.

    source_changes are files by hash, removed_symbols, added_symbols and changed_symbols declarations of a file by id (kind, name and parent), affected_consumers relations of the snapshot before that lead to a removed
    symbol, removed_relations and added_relations sites without a counterpart; in a changed file no site has one. n counts equal rows. A declaration's relation leads from itself to itself. phase is ``before`` or ``current``.
    """
    ends = snapshots.agg(F.min("snapshot_no"), F.max("snapshot_no")).first()
    files = stage(valid_snapshots(snapshots), "snapshots")
    inside = (F.col("snapshot_no") > (ends[0] or 0)) & (F.col("snapshot_no") <= (ends[1] or 0))
    later = (F.col("snapshot_no") + 1).cast("int").alias("snapshot_no")
    now = files.select("snapshot_no", "file", F.lower("hash").alias("hash"), F.lit(True).alias("here"))
    then = files.select(later, "file", F.lower("hash").alias("old"), F.lit(True).alias("there"))
    pairs = now.join(then, ["snapshot_no", "file"], "full").where(inside)
    moved = ~(F.col("here").eqNullSafe(F.col("there")) & F.col("hash").eqNullSafe(F.col("old")))
    pairs = stage(pairs.select("snapshot_no", "file", F.col("here").isNotNull().alias("here"), F.col("there").isNotNull().alias("there"), moved.alias("moved")), "pairs")
    nothing = F.lit(None).cast("long")
    own = F.concat("file", F.lit("::file"))
    event = F.when(~F.col("there"), "source_added").when(~F.col("here"), "source_removed").otherwise("source_changed")
    one = F.lit(1).cast("long").alias("n")
    phase = lambda gone: F.when(gone, "before").otherwise("current").alias("phase")
    sources = pairs.where("moved").select("snapshot_no", F.lit("source_changes").alias("section"), phase(~F.col("here")), own.alias("source"), own.alias("target"), event.alias("kind"), "file", F.lit(1).cast("long").alias("line"), F.lit(0).cast("long").alias("start_offset"), one)

    declared = files.select("snapshot_no", "file", F.explode("nodes").alias("d")).where("d.id is not null").groupBy("snapshot_no", "file", F.col("d.id").alias("id")).agg(F.min(F.struct("d.kind", "d.name", "d.parent")).alias("body"), F.min("d.line").alias("line"))
    old = declared.select(later, "file", "id", F.col("body").alias("old_body"), F.col("line").alias("old_line"))
    met = declared.join(old, ["snapshot_no", "file", "id"], "full").where(inside)
    section = F.when(F.col("body").isNull(), "removed_symbols").when(F.col("body.kind") == "file", None).when(F.col("old_body").isNull(), "added_symbols").when(F.col("body") != F.col("old_body"), "changed_symbols")
    symbols = stage(met.select("snapshot_no", "file", "id", section.alias("section"), F.coalesce("line", "old_line").alias("line")).where("section is not null"), "symbols")
    declarations = symbols.select("snapshot_no", "section", phase(F.col("section") == "removed_symbols"), F.col("id").alias("source"), F.col("id").alias("target"), F.lit("declaration").alias("kind"), "file", "line", nothing.alias("start_offset"), one)

    edge = ["source", "target", "kind", "confidence", "line", "start_offset"]
    sites = files.select("snapshot_no", "file", F.explode("edges").alias("e")).where("e is not null").select("snapshot_no", "file", "e.source", "e.target", "e.kind", F.coalesce("e.confidence", F.lit("resolved")).alias("confidence"), "e.line", "e.start_offset")
    sites = stage(sites.groupBy("snapshot_no", "file", *edge).agg(F.count("*").alias("n")), "sites")
    before = sites.withColumn("snapshot_no", (F.col("snapshot_no") + 1).cast("int")).where(inside)
    gone = symbols.where("section = 'removed_symbols'").select("snapshot_no", F.col("id").alias("target")).distinct()
    columns = ["snapshot_no", "section", "phase", "source", "target", "kind", "file", "line", "start_offset", "n"]
    users = before.where("kind in ('calls', 'references', 'overrides')").join(gone, ["snapshot_no", "target"]).withColumn("section", F.lit("affected_consumers")).withColumn("phase", F.lit("before")).select(*columns)
    both = before.withColumn("w", -F.col("n")).unionByName(sites.where(inside).withColumn("w", F.col("n"))).join(pairs.select("snapshot_no", "file", "moved"), ["snapshot_no", "file"])
    # the sites of a changed file have no counterpart, so those of before and after are counted apart
    net = both.withColumn("side", F.when(F.col("moved"), F.signum("w")).otherwise(0)).groupBy("snapshot_no", "file", *edge, "side").agg(F.sum("w").alias("w")).where("w <> 0")
    lost = F.col("w") < 0
    relations = net.select("snapshot_no", F.when(lost, "removed_relations").otherwise("added_relations").alias("section"), phase(lost), "source", "target", "kind", "file", "line", "start_offset", F.abs("w").alias("n"))
    return sources.unionByName(declarations).unionByName(users).unionByName(relations)


def _relocated(old: DataFrame, intervals: DataFrame) -> DataFrame:
    """Sites of changed files with the line and offset where the interval that begins last at or before them puts them; an as-of join by one order per file."""
    key = ["snapshot_no", "file"]
    span = F.struct("before_start", "after_start", "length", "before_line", "after_line")
    marks = intervals.select(*key, F.col("before_start").alias("_at"), F.lit(0).alias("_side"), span.alias("_span"))
    rows = old.withColumn("_at", F.col("start_offset")).withColumn("_side", F.lit(1)).withColumn("_span", F.lit(None).cast(marks.schema["_span"].dataType))
    by = Window.partitionBy(*key).orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = rows.unionByName(marks, allowMissingColumns=True).withColumn("_last", F.last("_span", ignorenulls=True).over(by)).where("_side = 1")
    step = F.col("start_offset") - F.col("_last.before_start")
    held = F.col("moved") & (F.col("line") == F.col("_last.before_line")) & (step < F.col("_last.length"))
    to_line, to_offset = F.when(held, F.col("_last.after_line")).otherwise(F.col("to_line")), F.when(held, F.col("_last.after_start") + step).otherwise(F.col("to_offset"))
    return both.withColumn("to_line", to_line).withColumn("to_offset", to_offset).drop("_at", "_side", "_span", "_last")


def site_intervals(texts: DataFrame) -> DataFrame:
    """``(file, before_start, after_start, length, before_line, after_line)``: pieces of text that stand in both versions of a file, from a table of (file, before, after).

    Lines that occur once in both texts are anchors; if their order differs, the file has no pieces. Between two anchors lines are paired in turn if both sides have as many; equal ones are pieces, and of a single
    changed line its parts up to a semicolon that occur once on both sides. Offsets count in the units of the file's language, lines keep their ends. Other columns (``snapshot_no``) are kept as keys. One file's
    lines are compared within a row's task; files are spread over the cluster.
    """
    keys = [c for c in texts.columns if c not in ("file", "before", "after")]
    unit = F.when(language("file").isin("dart", "typescript", "javascript", "java"), "utf16").when(language("file") == "go", "bytes").otherwise("characters")
    rows = texts.where("before is not null and after is not null and file is not null").select(*keys, "file", "before", "after", unit.alias("unit"))
    ship(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, values = [], []
            for i, r in enumerate(batch.select(["before", "after", "unit"]).to_pylist()):
                for piece in _pieces(r["before"], r["after"], r["unit"]):
                    owner.append(i)
                    values.append(piece)
            at = pa.array(owner, pa.int64())
            columns = list(zip(*values)) or [()] * 5
            yield pa.RecordBatch.from_arrays([*[batch.column(c).take(at) for c in [*keys, "file"]], *[pa.array(c, pa.int64()) for c in columns]], names=[*keys, "file", "before_start", "after_start", "length", "before_line", "after_line"])

    schema = ", ".join(f"`{c}` {texts.schema[c].dataType.simpleString()}" for c in keys)
    return rows.mapInArrow(run, f"{schema}{', ' if keys else ''}file string, before_start long, after_start long, length long, before_line long, after_line long")


def _pieces(before: str, after: str, unit: str) -> list[tuple[int, int, int, int, int]]:
    """The pieces of one file for :func:`site_intervals`."""
    size = {"utf16": lambda t: len(t.encode("utf-16-le", "surrogatepass")) // 2, "bytes": lambda t: len(t.encode()), "characters": len}[unit]
    a, b = ([x for x in re.split(r"(?<=\n)", t) if x] for t in (before, after))
    start = [list(accumulate(map(size, lines), initial=0)) for lines in (a, b)]
    once = [{t: i for i, t in enumerate(lines) if count[t] == 1} for lines, count in ((a, Counter(a)), (b, Counter(b)))]
    anchors = sorted((i, once[1][t]) for t, i in once[0].items() if t in once[1])
    if any(x[1] >= y[1] for x, y in zip(anchors, anchors[1:])):
        return []
    out = []
    left = (0, 0)
    for right in [*anchors, (len(a), len(b))]:
        gap = right[0] - left[0]
        if gap == right[1] - left[1]:
            for k in range(gap):
                i, j = left[0] + k, left[1] + k
                if a[i] == b[j]:
                    out.append((start[0][i], start[1][j], size(a[i]), i + 1, j + 1))
                elif gap == 1:
                    for m in re.finditer(r"[^;]*;", a[i]):
                        part = m[0].strip()
                        if part and a[i].count(part) == 1 and b[j].count(part) == 1:
                            out.append((start[0][i] + size(a[i][: a[i].index(part)]), start[1][j] + size(b[j][: b[j].index(part)]), size(part), i + 1, j + 1))
        if right[0] < len(a):
            out.append((start[0][right[0]], start[1][right[1]], size(a[right[0]]), right[0] + 1, right[1] + 1))
        left = (right[0] + 1, right[1] + 1)
    return sorted(out)


def declaration_changes(snapshots: DataFrame) -> DataFrame:
    """``(snapshot_no, file, id, change)``: declarations added, removed or changed between consecutive snapshots of the files in both.

    One shuffle by file and id: each declaration's versions stand in one short window, one row per snapshot.
    """
    rows = valid_snapshots(snapshots).select("snapshot_no", "file", F.explode("nodes").alias("n")).where("n.id is not null").groupBy("file", "n.id", "snapshot_no").agg(F.min(F.to_json("n")).alias("body"))
    files = valid_snapshots(snapshots).select("file", "snapshot_no")
    by = Window.partitionBy("file", "id").orderBy("snapshot_no")
    seen = rows.select("file", "id", "snapshot_no", "body", F.lag("snapshot_no").over(by).alias("before"), F.lag("body").over(by).alias("old"), F.lead("snapshot_no").over(by).alias("after"))
    there = F.col("before").eqNullSafe(F.col("snapshot_no") - 1)
    here = F.when(~there, "added").when(F.col("old") != F.col("body"), "changed")
    gone = F.when(~F.col("after").eqNullSafe(F.col("snapshot_no") + 1), "removed")
    events = F.array(F.struct("snapshot_no", here.alias("change")), F.struct((F.col("snapshot_no") + 1).cast("int").alias("snapshot_no"), gone.alias("change")))
    changes = seen.select("file", "id", F.explode(events).alias("e")).where("e.change is not null").select("e.snapshot_no", "file", "id", "e.change")
    both = files.join(files.select("file", (F.col("snapshot_no") + 1).cast("int").alias("snapshot_no")), ["file", "snapshot_no"], "left_semi")
    return changes.join(both, ["file", "snapshot_no"], "left_semi").select("snapshot_no", "file", "id", "change")


def relation_changes(snapshots: DataFrame) -> DataFrame:
    """``(snapshot_no, source, target, kind, confidence, removed, added)``: how many sites of a relation went or came since the snapshot before.

    Sites are distinct (line, start_offset); relations are compared as multisets, so a moved site is no change. Both snapshots of a pair go through one
    signed count, combined before its shuffle.
    """
    sites = valid_snapshots(snapshots).select("snapshot_no", "file", F.explode(F.array_distinct(F.transform("edges", lambda e: e.withField("confidence", F.coalesce(e["confidence"], F.lit("resolved")))))).alias("e"))
    signed = F.array(F.struct("snapshot_no", F.lit(1).alias("w")), F.struct((F.col("snapshot_no") + 1).cast("int").alias("snapshot_no"), F.lit(-1).alias("w")))
    last = snapshots.agg(F.min("snapshot_no"), F.max("snapshot_no")).first()
    rows = sites.select("e.source", "e.target", "e.kind", "e.confidence", F.explode(signed).alias("s")).where((F.col("s.snapshot_no") > last[0]) & (F.col("s.snapshot_no") <= last[1]))
    net = rows.groupBy("s.snapshot_no", "source", "target", "kind", "confidence").agg(F.sum("s.w").alias("net")).where("net <> 0")
    return net.select("snapshot_no", "source", "target", "kind", "confidence", F.greatest(-F.col("net"), F.lit(0)).alias("removed"), F.greatest("net", F.lit(0)).alias("added"))


def diagnostic_changes(files: DataFrame) -> DataFrame:
    """``(file, diagnostic, change)``: diagnostics that are ``new`` in or ``resolved`` by a file's newest delivery, against the one before, by their exact text."""
    rows = files.where("file is not null and indexed_at is not null").select("file", "indexed_at", "diagnostics").groupBy("file", "indexed_at").agg(F.max("diagnostics").alias("diagnostics"))
    by = Window.partitionBy("file").orderBy(F.desc("indexed_at"))
    two = rows.select("file", "diagnostics", F.row_number().over(by).alias("n"), F.lead("diagnostics").over(by).alias("old"), F.lead("indexed_at").over(by).alias("before")).where("n = 1 and before is not null")
    none = F.array().cast("array<string>")
    now, old = F.coalesce("diagnostics", none), F.coalesce("old", none)
    found = F.concat(F.transform(F.array_except(now, old), lambda d: F.struct(d.alias("diagnostic"), F.lit("new").alias("change"))), F.transform(F.array_except(old, now), lambda d: F.struct(d.alias("diagnostic"), F.lit("resolved").alias("change"))))
    return two.select("file", F.explode(found).alias("d")).select("file", "d.diagnostic", "d.change")


def preceding_declaration(sites: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(edge_id, node_id)``: the declaration of the site's file that begins last at or before the site's offset: an as-of join.

    Both tables are laid in one order per file, and the last declaration is carried forward; ties by id. Null offsets find nothing. A file with a third of all
    sites is cut into ranges of offsets, over which the carried value is handed on.
    """
    width = 1 << 12
    both = sites.select("file", F.col("start_offset").alias("at"), F.lit(1).alias("side"), "edge_id", F.lit(None).cast("string").alias("id"))
    both = both.unionByName(nodes.where("kind <> 'file'").select("file", F.col("start_offset").alias("at"), F.lit(0).alias("side"), F.lit(None).cast("long").alias("edge_id"), "id")).where("at is not null and file is not null")
    both = both.withColumn("range", F.floor(F.col("at") / width))
    inside = Window.partitionBy("file", "range").orderBy("at", "side", "id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carried = both.withColumn("node_id", F.last("id", ignorenulls=True).over(inside)).where("side = 1")
    ends = both.where("side = 0").groupBy("file", "range").agg(F.max(F.struct("at", "id")).alias("m"))
    asked = both.select("file", "range").distinct().join(ends, ["file", "range"], "left")
    before = Window.partitionBy("file").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    handed = asked.select("file", "range", F.last("m.id", ignorenulls=True).over(before).alias("handed"))
    return carried.join(handed, ["file", "range"]).select("edge_id", F.coalesce("node_id", "handed").alias("node_id")).where("node_id is not null")


def moved_lines(old: DataFrame, new: DataFrame) -> DataFrame:
    """``(file, old_line, new_line)``: lines that occur once in both texts of a file, and so tell where a site has gone.

    Tables of (file, text); lines count from 1. Each text's lines are counted within the file, and those that are unique on both sides are joined.
    """

    def unique(t: DataFrame, place: str) -> DataFrame:
        rows = t.where("text is not null").select("file", F.posexplode(F.split(F.regexp_replace("text", "\r\n", "\n"), "\n")).alias("n", "body"))
        return rows.groupBy("file", "body").agg(F.count("*").alias("c"), (F.min("n") + 1).alias(place)).where("c = 1").drop("c")

    return unique(old, "old_line").join(unique(new, "new_line"), ["file", "body"]).select("file", "old_line", "new_line")
