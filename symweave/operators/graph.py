"""The code graph as tables: one row per node and edge, joins of edges with their ends, and counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from symweave.functions.scalars import directory, language, repository, utf16_order
from symweave.operators.skew import balanced_join
from symweave.operators.traverse import closure
from symweave.session import stage

NODE = ["id", "name", "kind", "file", "line", "qualified", "end_line", "start_offset", "length", "parent", "tags", "synthetic"]
IDENTITY = ["source", "target", "kind", "file", "start_offset"]


def latest_nodes(*tables: DataFrame) -> DataFrame:
    """One row per id: the one indexed last (ties by all columns). Map-side combined; rows with a null id are left out."""
    rows = tables[0]
    for t in tables[1:]:
        rows = rows.unionByName(t)
    packed = F.struct("indexed_at", "removed_at", *[c for c in NODE if c not in ("id", "tags")], "tags")
    return rows.where(F.col("id").isNotNull()).groupBy("id").agg(F.max(packed).alias("n")).select("id", *[F.col(f"n.{c}").alias(c) for c in [*NODE[1:], "indexed_at", "removed_at"]])


def distinct_edges(edges: DataFrame) -> DataFrame:
    """One row per identity (source, target, kind, file, start_offset): the first by edge_id. Line and confidence are no part of it."""
    rest = F.struct("edge_id", "line", F.coalesce("confidence", F.lit("resolved")).alias("confidence"), "indexed_at")
    return edges.groupBy(*IDENTITY).agg(F.min(rest).alias("e")).select(*IDENTITY, "e.*")


def dangling_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(kind, n_edges, n_dropped)``: delivered edges per kind and those with an end that no node has; nodes must be one row per id.

    References are counted per pair of ends before the joins, so a hot target is one row per source.
    """
    pairs = edges.groupBy("kind", "source", "target").agg(F.count("*").alias("n"))
    ids = nodes.select("id")
    good = pairs.join(ids, pairs["source"] == ids["id"], "left_semi").join(ids, F.col("target") == ids["id"], "left_semi").groupBy("kind").agg(F.sum("n").alias("kept"))
    total = pairs.groupBy(F.col("kind").alias("k")).agg(F.sum("n").alias("n_edges"))
    return total.join(good, F.col("k").eqNullSafe(F.col("kind")), "left").select(F.col("k").alias("kind"), "n_edges", (F.col("n_edges") - F.coalesce("kept", F.lit(0))).alias("n_dropped"))


def unreferenced(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that no edge has as an end: candidates for removal of external symbols."""
    ends = edges.select(F.explode(F.array("source", "target")).alias("end")).where(F.col("end").isNotNull()).distinct()
    return nodes.join(ends, nodes["id"] == ends["end"], "left_anti")


def relations(edges: DataFrame, nodes: DataFrame, kinds: list[str] | None, direction: str = "in") -> DataFrame:
    """Callers, callees and references of every node: ``(target_id, id, kind, name, file, line, tags, relation, direction, site_file, site_line, confidence)``.

    ``in`` gives the sources of edges that lead to target_id, ``out`` the targets of those that leave it; None takes every kind. Both ends must exist. The end that a few nodes hold most of is met by fragments and copies
    of the node's row (:func:`symweave.operators.skew.balanced_join`), so no task gets all edges of a hot node.
    """
    own, other = ("target", "source") if direction == "in" else ("source", "target")
    rows = edges.where(F.col("kind").isin(kinds)) if kinds else edges
    rows = stage(rows.select(F.col(own).alias("target_id"), F.col(other).alias("other"), F.col("kind").alias("relation"), F.col("file").alias("site_file"), F.col("line").alias("site_line"), "start_offset", "confidence"), "relations")
    ends = nodes.select("id", "kind", "name", "file", "line", F.array_join("tags", ",").alias("tags"))
    ids = nodes.select(F.col("id").alias("own"))
    spread_by = ["relation", "site_file", "site_line", "start_offset"]
    if direction == "in":
        met = balanced_join(rows, "target_id", ids, "own", spread_by=["other", *spread_by]).drop("own").join(ends, F.col("other") == F.col("id"))
    else:
        met = balanced_join(rows, "other", ends, "id", spread_by=["target_id", *spread_by]).join(ids, F.col("target_id") == F.col("own"), "left_semi")
    return met.select("target_id", "id", "kind", "name", "file", "line", "tags", "relation", F.lit(direction).alias("direction"), "site_file", "site_line", "confidence")


def neighbour_rows(edges: DataFrame, nodes: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    """The relations of every node in both directions; an edge of a node to itself comes out twice."""
    return relations(edges, nodes, kinds, "out").unionByName(relations(edges, nodes, kinds, "in"))


def inspect(edges: DataFrame, nodes: DataFrame, limit: int = 20) -> DataFrame:
    """``(id, callers, callers_omitted, implementations, implementations_omitted)`` of every symbol that is called or implemented: how many there are, and how many a page of ``limit`` leaves out."""
    there = nodes.select("id")
    calls = edges.where("kind = 'calls'").groupBy("source", "target").agg(F.count("*").alias("n"))
    calls = calls.join(there, F.col("source") == F.col("id"), "left_semi").groupBy(F.col("target").alias("id")).agg(F.sum("n").alias("callers")).join(there, "id", "left_semi")
    heirs = closure(there, edges, ["extends", "implements", "with", "overrides"]).where("start <> id")
    heirs = heirs.join(there, "id", "left_semi").groupBy(F.col("start").alias("id")).agg(F.count("*").alias("implementations"))
    zero, rest = F.lit(0).cast("long"), lambda c: F.greatest(F.col(c) - limit, F.lit(0)).cast("long").alias(f"{c}_omitted")
    met = calls.join(heirs, "id", "full").select("id", F.coalesce("callers", zero).alias("callers"), F.coalesce("implementations", zero).alias("implementations"))
    return met.select("id", "callers", rest("callers"), "implementations", rest("implementations"))


def compact(nodes: DataFrame) -> DataFrame:
    """``(id, row)``: every symbol as JSON without what is absent: tags if there are any, synthetic if it is."""
    tags, synthetic = F.when(F.size("tags") > 0, F.col("tags")), F.when(F.col("synthetic"), F.lit(True))
    return nodes.select("id", F.to_json(F.struct("id", "kind", "name", "file", "line", tags.alias("tags"), synthetic.alias("synthetic"))).alias("row"))


def file_filters(files: DataFrame, prefixes: list[str]) -> DataFrame:
    """``(prefix, valid, suggestion)``: whether some file begins with each of the request's prefixes, and if none does, the one longer prefix that ends with it at a directory's begin, null for several.

    A prefix that is absolute, leads upwards or holds a backslash or colon is an error.
    """
    for p in prefixes:
        if p.startswith("/") or "\\" in p or ":" in p or ".." in p.split("/"):
            raise ValueError(f"no path relative to the root: {p}")
    spark = files.sparkSession
    asked = spark.createDataFrame([(p,) for p in prefixes], "prefix string")
    rows = files.select("file").where("file is not null").distinct().select("file", F.explode(F.array(*[F.lit(p) for p in prefixes])).alias("prefix")).where(F.contains("file", F.col("prefix")))
    ends = F.filter(F.sequence(F.lit(2), F.length("file")), lambda i: (F.substring(F.col("file"), i - 1, F.lit(1)) == "/") & F.startswith(F.substring(F.col("file"), i, F.length("file")), F.col("prefix")))
    longer = F.transform(ends, lambda i: F.substring(F.col("file"), F.lit(1), i - 1 + F.length("prefix")))
    per = rows.select("prefix", F.startswith("file", F.col("prefix")).alias("valid"), F.explode_outer(longer).alias("longer")).groupBy("prefix", "longer").agg(F.max("valid").alias("valid"))
    per = per.groupBy("prefix").agg(F.max("valid").alias("valid"), F.count("longer").alias("n"), F.min("longer").alias("longer"))
    met = asked.join(per, "prefix", "left")
    valid = F.coalesce("valid", F.lit(False))
    return met.select("prefix", valid.alias("valid"), F.when(~valid & (F.col("n") == 1), F.col("longer")).alias("suggestion"))


def row_text_order(*columns: str) -> list:
    """The order of rows by their tab-joined text, as code units: line 10 comes before 9."""
    return [utf16_order(F.concat_ws("\t", *[F.col(c).cast("string") for c in columns]))]


def neighbours(edges: DataFrame) -> DataFrame:
    """``(id, kind, n_out, n_in)`` per node and relation; an edge to itself counts on both sides. Combined before the shuffle."""
    ends = F.array(F.struct(F.col("source").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("target").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    rows = edges.select("kind", F.explode(ends).alias("e")).where(F.col("e.id").isNotNull())
    return rows.groupBy("e.id", "kind").agg(F.sum("e.o").alias("n_out"), F.sum("e.i").alias("n_in"))


def file_dependencies(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(file, other_file, kind, direction, n_edges)`` for edges, other than contains, between nodes of different files.

    Edges are counted per pair of ends first, then per pair of files, so hot ends meet the joins as few rows.
    """
    pairs = edges.where("kind <> 'contains'").groupBy("source", "target", "kind").agg(F.count("*").alias("n"))
    place = nodes.select("id", "file")
    a = place.select(F.col("id").alias("sid"), F.col("file").alias("source_file"))
    b = place.select(F.col("id").alias("tid"), F.col("file").alias("target_file"))
    crossing = pairs.join(a, F.col("source") == F.col("sid")).join(b, F.col("target") == F.col("tid")).where("source_file <> target_file")
    files = crossing.groupBy("source_file", "target_file", "kind").agg(F.sum("n").alias("n_edges"))
    both = F.array(F.struct(F.col("source_file").alias("file"), F.col("target_file").alias("other_file"), F.lit("out").alias("direction")), F.struct(F.col("target_file").alias("file"), F.col("source_file").alias("other_file"), F.lit("in").alias("direction")))
    return files.select(F.explode(both).alias("d"), "kind", "n_edges").select("d.file", "d.other_file", "kind", "d.direction", "n_edges")


def search(nodes: DataFrame, query: str, *, kind: str | None = None, tag: str | None = None, lang: str | None = None, prefix: str = "") -> DataFrame:
    """Symbols whose name or qualified name holds ``query`` in any case: ``(id, kind, name, file, line, rank)``.

    rank is 0 for the exact name, 1 for a prefix, 2 otherwise; external nodes never count, file nodes only if asked for. prefix is a raw
    prefix of the path. Order by rank, then :func:`utf16_order` of id, for pages.
    """
    text = query.lower()
    rows = nodes.where(F.col("kind") != "external").where(F.col("kind") == kind if kind else F.col("kind") != "file")
    rows = rows.where(F.col("file").startswith(prefix) & (F.lower("name").contains(text) | F.lower("qualified").contains(text)))
    if tag:
        rows = rows.where(F.array_contains("tags", tag))
    if lang:
        rows = rows.where(language("file") == lang)
    rank = F.when(F.lower("name") == text, 0).when(F.lower("name").startswith(text), 1).otherwise(2)
    return rows.select("id", "kind", "name", "file", "line", rank.alias("rank"))


def page(rows: DataFrame, order: list, offset: int = 0, limit: int = 50) -> DataFrame:
    """One page of ``rows`` in ``order``; a limit is what a page is."""
    return rows.orderBy(*order).offset(offset).limit(limit)


def resolve(targets: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(target, tier, n_matches, id)``: how every text of ``targets`` names nodes.

    Tiers: 0 the exact id, 1 a file's path, 2 the qualified name, 3 the name; only the least tier with a match counts. id is the match if
    there is just one; tier and id are null if there is none.
    """
    wanted = targets.select("target").where(F.col("target").isNotNull()).distinct()
    keys = F.array(F.struct(F.lit(0).alias("tier"), F.col("id").alias("key")), F.struct(F.lit(1).alias("tier"), F.when(F.col("kind") == "file", F.col("file")).alias("key")), F.struct(F.lit(2).alias("tier"), F.col("qualified").alias("key")), F.struct(F.lit(3).alias("tier"), F.col("name").alias("key")))
    names = nodes.select("id", F.explode(keys).alias("k")).select("id", "k.*").where(F.col("key").isNotNull()).groupBy("key", "tier").agg(F.countDistinct("id").alias("n"), F.min("id").alias("id"))
    best = wanted.join(names, F.col("target") == F.col("key"), "left").groupBy("target").agg(F.min(F.struct("tier", "n", "id")).alias("b"))
    return best.select("target", "b.tier", F.coalesce("b.n", F.lit(0)).alias("n_matches"), F.when(F.col("b.n") == 1, F.col("b.id")).alias("id"))


def resolve_candidates(targets: DataFrame, nodes: DataFrame, most: int = 10) -> DataFrame:
    """``(target, place, id)``: the first ``most`` nodes, by id, that each ambiguous text of ``targets`` names in its least tier; cut before the shuffle."""
    unclear = resolve(targets, nodes).where("n_matches > 1").select("target", "tier")
    keys = F.array(F.struct(F.lit(1).alias("tier"), F.when(F.col("kind") == "file", F.col("file")).alias("key")), F.struct(F.lit(2).alias("tier"), F.col("qualified").alias("key")), F.struct(F.lit(3).alias("tier"), F.col("name").alias("key")))
    named = nodes.select("id", F.explode(keys).alias("k")).select("id", "k.tier", F.col("k.key").alias("target")).where("target is not null")
    place = F.row_number().over(Window.partitionBy("target").orderBy(utf16_order("id")))
    return named.join(unclear, ["target", "tier"], "left_semi").withColumn("place", place).where(F.col("place") <= most).select("target", "place", "id")


def unlinked_homonyms(nodes: DataFrame, linked: DataFrame) -> DataFrame:
    """``(id, n)``: how many other nodes have a symbol's name and are not among the declarations bound to it (``linked``: start, id); symbols without any are left out. Counted by name, so no pairs of homonyms are made."""
    named = nodes.where("name is not null").select("id", "name")
    counts = named.groupBy("name").agg(F.count("*").alias("all"))
    own = linked.where("start <> id").join(named.select(F.col("id").alias("start"), "name"), "start").join(named.select("id", F.col("name").alias("other")), "id").where("name = other").groupBy(F.col("start").alias("id")).agg(F.count("*").alias("own"))
    met = named.where("name is not null").join(counts, "name").join(own, "id", "left")
    return met.select("id", (F.col("all") - 1 - F.coalesce("own", F.lit(0))).alias("n")).where("n > 0")


def diagnostic_identities(files: DataFrame) -> DataFrame:
    """``(file, identity, severity, n)`` of the diagnostics of the current records: a digest of file and text by which one is known again in a later delivery; null severity means error, text that is no JSON object has none."""
    newest = files.where("file is not null").groupBy("file").agg(F.max(F.struct("indexed_at", "diagnostics")).alias("r")).select("file", F.explode("r.diagnostics").alias("d")).where("d is not null")
    is_object = F.col("d").startswith("{") & F.col("d").endswith("}")
    severity = F.when(is_object, F.coalesce(F.get_json_object("d", "$.severity"), F.lit("error")))
    return newest.groupBy("file", F.substring(F.sha2(F.concat("file", F.lit("\u0000"), "d"), 256), 1, 16).alias("identity"), severity.alias("severity")).agg(F.count("*").alias("n"))


def diagnostic_samples(files: DataFrame, limit: int = 20, most: int = 512) -> DataFrame:
    """``(file, place, severity, code, message, truncated)``: the first ``limit`` diagnostics of the current records by file and place, messages cut at ``most`` characters; a report, so a limit."""
    newest = files.where("file is not null").groupBy("file").agg(F.max(F.struct("indexed_at", "diagnostics")).alias("r")).select("file", F.posexplode("r.diagnostics").alias("place", "d"))
    rows = newest.where(F.col("d").startswith("{") & F.col("d").endswith("}"))
    message = F.get_json_object("d", "$.message")
    rows = rows.select("file", "place", F.coalesce(F.get_json_object("d", "$.severity"), F.lit("error")).alias("severity"), F.get_json_object("d", "$.code").alias("code"), F.substring(message, 1, most).alias("message"), F.coalesce(F.length(message) > most, F.lit(False)).alias("truncated"))
    return rows.orderBy(utf16_order("file"), "place").limit(limit)


def covering(sites: DataFrame, spans: DataFrame, site: str) -> DataFrame:
    """Every pair of a site (columns ``site``, file, line) and a span (file, line, end_line and more) of its file whose lines hold the site's: (site, the span's columns, line of the span as ``line``).

    A range join within files: every span is listed under blocks of lines of a width above its own, one block or two a span, and a site asks one block
    of each width that its file has. So a file with many spans or sites does not compare all pairs.
    """
    widths = [1 << k for k in range(4, 31, 2)]
    spans = spans.where("line is not null and end_line >= line")
    level = F.array_min(F.filter(F.array(*[F.lit(w) for w in widths]), lambda w: w > F.col("end_line") - F.col("line")))
    blocks = spans.withColumn("_w", level).withColumn("_block", F.explode(F.array_distinct(F.array(F.floor(F.col("line") / F.col("_w")), F.floor(F.col("end_line") / F.col("_w"))))))
    some = blocks.groupBy("file").agg(F.collect_set("_w").alias("_ws"))
    asked = sites.select(site, "file", F.col("line").alias("_at")).join(some, "file").withColumn("_w", F.explode("_ws")).withColumn("_block", F.floor(F.col("_at") / F.col("_w")))
    return asked.join(blocks, ["file", "_w", "_block"]).where("_at between line and end_line").drop("_w", "_ws", "_block", "_at")


def innermost(sites: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(edge_id, node_id)``: the smallest declaration of the site's file whose lines hold the site's line; ties by id."""
    spans = nodes.where("kind <> 'file'").select("id", "file", "line", "end_line", (F.col("end_line") - F.col("line")).alias("span"))
    met = covering(sites.select("edge_id", "file", "line"), spans, "edge_id")
    return met.groupBy("edge_id").agg(F.min(F.struct("span", "id")).alias("m")).select("edge_id", F.col("m.id").alias("node_id"))


def homonyms(nodes: DataFrame) -> DataFrame:
    """``(name, kind, n_nodes, n_files)`` of names that several nodes of a kind share; counted per file first."""
    per_file = nodes.where("kind not in ('file', 'external')").groupBy("name", "kind", "file").agg(F.count("*").alias("n"))
    return per_file.groupBy("name", "kind").agg(F.sum("n").alias("n_nodes"), F.count("*").alias("n_files")).where("n_nodes > 1")


def derived_overrides(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(member, base_member, class, base)``: members of a class that have the name of a member of any class above it, over any number of extends, implements and with."""
    kinds = ["extends", "implements", "with"]
    heirs = closure(edges.where(F.col("kind").isin(kinds)).select(F.col("source").alias("id")).where("id is not null").distinct(), edges, kinds, reverse=False)
    members = nodes.where("kind in ('method', 'getter', 'setter', 'field') and parent is not null").select("id", "name", "parent")
    own = members.select(F.col("id").alias("member"), "name", F.col("parent").alias("start"))
    above = members.select(F.col("id").alias("base_member"), F.col("name").alias("base_name"), F.col("parent").alias("base"))
    met = heirs.select("start", F.col("id").alias("base")).where("start <> base").join(own, "start").join(above, "base").where("name = base_name")
    return met.select("member", "base_member", F.col("start").alias("class"), "base")


def architecture(nodes: DataFrame, edges: DataFrame, files: DataFrame) -> DataFrame:
    """``(section, key, n)``: files, languages, kinds, tags, directories, relations, confidences and severities of the whole graph.

    Kinds and directories leave out file and external nodes, relations count distinct edges of all. Each section is a map-side combined count.
    """
    own = nodes.where("kind not in ('file', 'external')")
    newest = files.where(F.col("file").isNotNull()).groupBy("file").agg(F.max_by("diagnostics", "indexed_at").alias("diagnostics"))
    severity = F.coalesce(F.get_json_object("d", "$.severity"), F.lit("error"))
    parts = [
        newest.select(F.lit("languages").alias("section"), language("file").alias("key")),
        own.select(F.lit("kinds").alias("section"), F.col("kind").alias("key")),
        own.select(F.lit("tags").alias("section"), F.explode("tags").alias("key")),
        own.select(F.lit("directories").alias("section"), directory("file").alias("key")),
        edges.select(F.lit("relations").alias("section"), F.col("kind").alias("key")),
        edges.select(F.lit("confidences").alias("section"), F.col("confidence").alias("key")),
        newest.select(F.explode("diagnostics").alias("d")).where(F.col("d").startswith("{") & F.col("d").endswith("}")).select(F.lit("severities").alias("section"), severity.alias("key")),
    ]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows.groupBy("section", "key").agg(F.count("*").alias("n"))


def hubs(edges: DataFrame, nodes: DataFrame, limit: int = 20) -> DataFrame:
    """``(id, kind, n_in)``: the ``limit`` nodes with the most incoming edges of any kind, ties by id; a top-k report."""
    degree = edges.groupBy("target").agg(F.count("*").alias("n_in"))
    return nodes.join(degree, F.col("id") == F.col("target")).select("id", "kind", "n_in").orderBy(F.desc("n_in"), utf16_order("id")).limit(limit)


def ranked_callers(edges: DataFrame, nodes: DataFrame, k: int = 3) -> DataFrame:
    """``(target, source, n, place)``: the ``k`` most frequent callers of every target; calls are counted per pair before the window."""
    calls = edges.where("kind = 'calls'").groupBy("target", "source").agg(F.count("*").alias("n"))
    calls = calls.join(nodes.select("id"), F.col("source") == F.col("id"), "left_semi")
    by = Window.partitionBy("target").orderBy(F.desc("n"), "source")
    return calls.withColumn("place", F.row_number().over(by)).where(F.col("place") <= k)


def structural_implementations(nodes: DataFrame, holders: tuple[str, ...] = ("class", "struct")) -> DataFrame:
    """``(id, interface)``: classes and structs that have a method of every name that an interface's methods have; division by counts.

    Names are distinct per holder, and an interface without methods has no implementations. Only names of interfaces meet the join.
    """
    methods = nodes.where("kind = 'method' and parent is not null").select("parent", "name").distinct()
    asked = methods.join(nodes.where("kind = 'interface'").select(F.col("id").alias("interface")), F.col("parent") == F.col("interface")).select("interface", "name")
    needed = asked.groupBy("interface").agg(F.count("*").alias("needed"))
    owners = nodes.where(F.col("kind").isin(list(holders))).select("id")
    had = methods.join(owners, methods["parent"] == owners["id"]).select("id", F.col("name").alias("had"))
    met = asked.join(had, F.col("name") == F.col("had")).groupBy("id", "interface").agg(F.count("*").alias("n"))
    return met.join(needed, "interface").where("n = needed").select("id", "interface")


def health(files: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(repo, n_files, n_symbols, n_edges, n_unresolved, n_diagnostics)`` per repository; each table is counted on its own before the joins."""
    newest = files.where(F.col("file").isNotNull()).groupBy("file").agg(F.max(F.struct("indexed_at", "unresolved_calls", "diagnostics")).alias("f"))
    a = newest.groupBy(repository("file").alias("repo")).agg(F.count("*").alias("n_files"), F.coalesce(F.sum("f.unresolved_calls"), F.lit(0)).alias("n_unresolved"), F.sum(F.coalesce(F.size("f.diagnostics"), F.lit(0))).alias("n_diagnostics"))
    b = nodes.where("kind not in ('file', 'external')").groupBy(repository("file").alias("r")).agg(F.count("*").alias("n_symbols"))
    c = edges.groupBy(repository("file").alias("q")).agg(F.count("*").alias("n_edges"))
    met = a.join(b, F.col("repo") == F.col("r"), "left").join(c, F.col("repo") == F.col("q"), "left")
    return met.select("repo", "n_files", F.coalesce("n_symbols", F.lit(0)).alias("n_symbols"), F.coalesce("n_edges", F.lit(0)).alias("n_edges"), "n_unresolved", "n_diagnostics")


def redelivered(edges: DataFrame) -> DataFrame:
    """``(edge_id, copies, versions)`` of edges that came more than once: equal rows and different ones, by a digest of the row."""
    rows = edges.groupBy("edge_id", F.xxhash64("source", "target", "kind", "file", "line", "start_offset", "confidence", "indexed_at", "received_at").alias("v")).agg(F.count("*").alias("n"))
    return rows.groupBy("edge_id").agg(F.sum("n").alias("copies"), F.count("*").alias("versions")).where("copies > 1")


def multiset_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of two tables of equal columns that do not balance, with ``side`` a or b and how many are left over; one signed count."""
    columns = a.columns
    both = a.withColumn("_w", F.lit(1)).unionByName(b.select(*columns).withColumn("_w", F.lit(-1)))
    net = both.groupBy(*columns).agg(F.sum("_w").alias("_n")).where("_n <> 0")
    return net.select(*columns, F.when(F.col("_n") > 0, "a").otherwise("b").alias("side"), F.abs("_n").alias("left_over"))
