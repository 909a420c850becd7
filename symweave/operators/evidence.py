"""Evidence of a change: the relations that a task on each symbol needs, by recipe, deduplicated, ordered, counted and paged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from symweave.functions.scalars import test_path, under, utf16_order
from symweave.operators.graph import covering
from symweave.operators.traverse import closure, interval_islands, ranked
from symweave.session import stage

EDGE = ["source", "target", "kind", "file", "line", "start_offset", "confidence"]
#: The places of sections in the order of evidence, all others have place 5.
PLACES = {"declarations": 0, "contracts": 1, "contract": 1, "usages": 2, "callers": 2, "composition": 2, "flow": 3, "tests": 4, "test_candidates": 8, "module_context": 9}
#: Sections that may be left out, and those that make a relation required if it stands in them too.
OPTIONAL = ["container", "dependencies", "consumers", "forwarding_context", "impact", "test_candidates", "module_context", "candidates"]
UPGRADE = ["usages", "contracts", "callers", "flow", "diagnostic_changes"]
#: Relations that bind declarations to each other.
CONTRACT = ["overrides", "binds_field", "accessor_pair", "super_parameter"]
#: The sections that a focus of ``explain_symbol`` brings to the front.
FOCUS = {"dependencies": ["dependencies"], "implementation": ["implementations", "contracts"], "contract": ["contracts", "container"]}

_LINK, _SITE, _DIRECTIVE = "compiler_resolved_symbol_link", "resolved_static_site", "file-level directive; not an obligatory symbol edit"
_DECLARED = "indexed_declaration; range is not an editable token span"


def context(nodes: DataFrame, edges: DataFrame, symbols: DataFrame | None = None, relations: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) with the auxiliary ``symbols`` and ``relations`` of the records: a node that the graph has too stays as the graph has it, equal relations count once.

    Columns of nodes: id, kind, file, line, start_offset, parent; of edges those of EDGE.
    """
    columns = ["id", "kind", "file", "line", "start_offset", "parent"]
    nodes, edges = nodes.select(*columns), edges.select(*EDGE)
    if symbols is not None:
        more = symbols.select(*columns).where("id is not null").groupBy("id").agg(F.max(F.struct(*columns[1:])).alias("n")).select("id", *[f"n.{c}" for c in columns[1:]])
        nodes = nodes.unionByName(more.join(nodes, "id", "left_anti"))
    if relations is not None:
        edges = edges.unionByName(relations.select(*EDGE).distinct())
    return nodes, edges


def _fact(rows: DataFrame, step: int, section: str | Column, reason: str | Column, distance: str | Column | int) -> DataFrame:
    as_column = lambda v: F.lit(v) if isinstance(v, (str, int)) else v
    return rows.select("start", F.lit(step).alias("step"), as_column(section).alias("section"), as_column(reason).alias("reason"), as_column(distance).cast("int").alias("distance"), *EDGE)


class Recipes:
    """The relations that tasks on ``starts`` (column id) need, for all of them at once: every part is a join or a closure over all starts.

    nodes must be one row per id; edges have the columns of EDGE; ``cases`` are test cases (file, framework, name, line, end_line, ordinal).
    Rows are ``(start, step, section, reason, distance, edge...)``, steps being the order in which a task asks. Joins with the edges of a hot node are left to adaptive execution, which splits them.
    """

    def __init__(self, starts: DataFrame, nodes: DataFrame, edges: DataFrame, cases: DataFrame | None = None, depth: int = 2):
        self.nodes, self.edges, self.cases, self.depth = stage(nodes, "nodes"), stage(edges.where("source is not null and target is not null"), "edges"), cases, depth
        self.starts = stage(starts.select(F.col("id").alias("start")).where("start is not null").distinct().join(self.nodes.select(F.col("id").alias("start")), "start", "left_semi"), "starts")
        self.linked_ids: DataFrame | None = None

    def _start(self) -> DataFrame:
        return self.starts.select("start", F.col("start").alias("id"), F.lit(0).alias("distance"))

    def _reached(self, pairs: DataFrame, depth: int) -> DataFrame:
        """The starts and what they reach over ``pairs`` (source, target) within ``depth`` steps."""
        far = closure(self.starts.select(F.col("start").alias("id")), pairs.withColumn("kind", F.lit("way")), ["way"], reverse=False, depth=depth)
        return self._start().unionByName(far.select("start", "id", "distance"))

    def _pairs(self, kinds: list[str], incoming: bool) -> DataFrame:
        rows = self.edges.where(F.col("kind").isin(kinds))
        return rows.select(F.col("target").alias("source"), F.col("source").alias("target")) if incoming else rows.select("source", "target")

    def _at(self, reached: DataFrame, kinds: list[str], end: str) -> DataFrame:
        """(start, distance of the node reached, edge) of the edges of ``kinds`` that have a reached node as their ``end``."""
        return reached.select("start", F.col("id").alias("_id"), "distance").join(self.edges.where(F.col("kind").isin(kinds)), F.col("_id") == F.col(end)).drop("_id")

    def declared(self, ids: DataFrame, step: int, section: str) -> DataFrame:
        met = ids.select("start", "id").join(self.nodes.select("id", "file", "line", "start_offset"), "id")
        row = met.select("start", F.col("id").alias("source"), F.col("id").alias("target"), F.lit("declaration").alias("kind"), "file", "line", "start_offset", F.lit("resolved").alias("confidence"))
        return _fact(row, step, section, _DECLARED, 0)

    def linked(self) -> DataFrame:
        """(start, id, distance): each start and the declarations bound to it in either direction."""
        if self.linked_ids is None:
            self.linked_ids = stage(self._reached(self._pairs(CONTRACT, False).unionByName(self._pairs(CONTRACT, True)), self.depth), "linked")
        return self.linked_ids

    def contracts(self, step: int) -> DataFrame:
        linked = self.linked()
        sites = self._at(linked, CONTRACT, "target").unionByName(self._at(linked, CONTRACT, "source"))
        return _fact(sites, step, "contracts", _LINK, F.col("distance") + 1).unionByName(self.declared(linked.where("distance > 0"), step, "declarations"))

    def incoming(self, ids: DataFrame, step: int, kinds: list[str], section: str, reason: str = _SITE) -> DataFrame:
        return _fact(self._at(ids, kinds, "target"), step, section, reason, 1)

    def outgoing(self, step: int, kinds: list[str], section: str, reason: str, distance: int = 1) -> DataFrame:
        return _fact(self._at(self._start(), kinds, "source"), step, section, reason, distance)

    def directives(self, step: int, imports: bool) -> DataFrame:
        kinds = [*(["imports"] if imports else []), "exports", "part", "part_of"]
        files = self.starts.join(self.nodes.select(F.col("id").alias("start"), F.concat("file", F.lit("::file")).alias("id")), "start").withColumn("distance", F.lit(0))
        return _fact(self._at(files, kinds, "target").unionByName(self._at(files, kinds, "source")), step, "module_context", _DIRECTIVE, 1)

    def walk(self, step: int, incoming: bool, section: str) -> DataFrame:
        """Calls in one direction and overrides in both, every relation that is passed within the depth."""
        pairs = self._pairs(["calls", "overrides"], incoming).unionByName(self._pairs(["overrides"], not incoming))
        near = self._reached(pairs, self.depth - 1)
        ends = ("target", "source") if incoming else ("source", "target")
        sites = self._at(near, ["calls", "overrides"], ends[0]).unionByName(self._at(near, ["overrides"], ends[1]))
        reason = F.when(F.col("kind") == "calls", "static_call; runtime order unknown").otherwise("possible_dispatch; not proven runtime call")
        return _fact(sites, step, section, reason, F.col("distance") + 1)

    def tests(self, step: int, framework: str | None = None, scope: str | None = None) -> DataFrame:
        """Relations that lead to the starts from within a test case, by an interval join of lines, or else from a path that looks like a test's."""
        kinds = ["references", "calls", "overrides"]
        sites = self.edges.where(F.col("kind").isin(kinds)).withColumn("site", F.xxhash64(*EDGE))
        if self.cases is not None:
            cases = self.cases.where(F.col("framework") == framework) if framework else self.cases
            found = covering(sites.select("site", "file", "line"), cases.select("file", "line", "end_line", "ordinal", "framework", "name"), "site")
            first = found.groupBy("site").agg(F.min(F.struct("ordinal", "framework", "name")).alias("case"))
            sites = sites.join(first, "site", "left")
        else:
            sites = sites.withColumn("case", F.lit(None).cast("struct<ordinal:int,framework:string,name:string>"))
        said = F.concat(F.lit("resolved test case "), F.coalesce("case.framework", F.lit("")), F.lit(": "), F.coalesce("case.name", F.lit("")), F.lit("; static reference does not prove execution/assertion"))
        own = F.col("case").isNotNull()
        guess = test_path("file") if framework is None else F.lit(False)
        sites = sites.where(own | guess).select(*EDGE, F.when(own, "tests").otherwise("test_candidates").alias("section"), F.when(own, said).otherwise("heuristic test-file classification with resolved graph link; runner/assertions unknown").alias("reason"))
        if scope is not None:
            sites = sites.where(under("file", scope))
        near = self._reached(self._pairs(kinds, True), self.depth - 1)
        met = near.select("start", F.col("id").alias("_id"), "distance").join(sites, F.col("_id") == F.col("target"))
        return _fact(met, step, F.col("section"), F.col("reason"), F.col("distance") + 1)

    def collect(self, intent: str) -> DataFrame:
        """The evidence of one of the recipes rename, change_signature, find_tests, explain_symbol, trace_flow, move_symbol, remove_symbol and replace_dependency."""
        one, parts = self._start(), [self.declared(self._start(), 0, "declarations")]
        if intent == "rename":
            parts += [self.contracts(1), self.incoming(self.linked(), 2, ["references", "calls", "parameter_reference"], "usages"), self.directives(3, False)]
        elif intent == "change_signature":
            parts += [self.contracts(1), self.incoming(self.linked(), 2, ["calls", "references"], "callers"), self.walk(3, True, "forwarding_context"), self.tests(4), self.outgoing(5, ["contains"], "contract", "indexed_member", 0)]
        elif intent == "find_tests":
            parts += [self.tests(1)]
        elif intent == "explain_symbol":
            parents = self.starts.join(self.nodes.where("parent is not null").select(F.col("id").alias("start"), F.col("parent").alias("id")), "start")
            parts += [self.declared(parents, 1, "container"), self.contracts(2)]
            parts += [self.incoming(one, 3, ["overrides", "implements", "extends", "with"], "implementations", "resolved implementation/subtype; runtime selection unknown")]
            parts += [self.outgoing(4, ["calls", "references", "extends", "implements", "with", "on"], "dependencies", "resolved direct dependency; role tags are hints")]
            parts += [self.incoming(one, 5, ["calls", "references"], "consumers")]
        elif intent == "trace_flow":
            parts += [self.walk(1, False, "flow")]
        elif intent == "move_symbol":
            parts += [self.incoming(one, 1, ["references", "calls"], "consumers"), self.contracts(2), self.directives(3, True)]
        elif intent == "remove_symbol":
            users = [self.incoming(one, 1, ["calls", "references", "overrides", "registers"], "consumers"), self.incoming(self.linked(), 3, ["references", "parameter_reference", "calls"], "consumers")]
            inner = F.when(F.col("source") == F.col("start"), "internal_group").otherwise(F.col("section"))
            parts += [*[u.withColumn("section", inner) for u in users], self.contracts(2), self.directives(4, True), self.tests(5)]
        elif intent == "replace_dependency":
            parts += [self.incoming(one, 1, ["calls", "references", "registers", "implements", "extends"], "composition"), self.contracts(2), self.tests(3)]
        else:
            raise ValueError(intent)
        rows = parts[0]
        for more in parts[1:]:
            rows = rows.unionByName(more)
        return rows


def deduplicate(evidence: DataFrame, by: str = "start") -> DataFrame:
    """One row per ``by`` and edge: the section that was found first stays, others go to also_sections with their reasons, joined by ``; ``.

    A relation that is not resolved stands in the section candidates, its own one is an other section. evidence_id is the beginning of the SHA-256 of the edge. Lists hold sections and their
    reasons only, of which there are few.
    """
    found = evidence.groupBy(by, *EDGE, "section").agg(F.min(F.struct("step", "distance", "reason")).alias("f"))
    every = F.sort_array(F.collect_list(F.struct("f.step", "f.distance", "section", "f.reason")))
    rows = found.groupBy(by, *EDGE).agg(every.alias("all"))
    first = F.get("all", F.lit(0))
    sure = F.coalesce("confidence", F.lit("resolved")) == "resolved"
    reasons = F.aggregate("all", F.lit(""), lambda text, x: F.when(text == "", x["reason"]).when(F.contains(text, x["reason"]), text).otherwise(F.concat(text, F.lit("; "), x["reason"])))
    doubt = F.concat(F.lit("provider confidence "), F.col("confidence"), F.lit(": "), first["reason"])
    others = F.transform(F.slice("all", 2, 100), lambda x: x["section"])
    place = F.to_json(F.struct("source", "target", "kind", "file", "line", F.col("start_offset").alias("offset"), F.coalesce("confidence", F.lit("resolved")).alias("confidence")))
    evidence_id = F.substring(F.sha2(F.concat(F.lit('["current",'), place, F.lit("]")), 256), 1, 16)
    return rows.select(
        by, *EDGE, F.when(sure, first["section"]).otherwise("candidates").alias("section"), F.array_join(F.when(sure, others).otherwise(F.array(first["section"])), ",").alias("also_sections"),
        F.when(sure, reasons).otherwise(doubt).alias("reason"), first["distance"].alias("distance"), evidence_id.alias("evidence_id"),
    )


def required(evidence: DataFrame, focus: str | None = None) -> DataFrame:
    """Adds ``required``: whether the section is none of OPTIONAL or one of the other sections is in UPGRADE; a ``focus`` of explain_symbol makes its sections required too."""
    others = F.split("also_sections", ",")
    need = ~F.col("section").isin(OPTIONAL) | F.arrays_overlap(others, F.array(*[F.lit(s) for s in UPGRADE]))
    return evidence.withColumn("required", need | F.col("section").isin(FOCUS[focus]) if focus else need)


def evidence_order(focus: str | None = None) -> list[Column]:
    """Place of the section, distance, file, line, offset and key of the edge, text by code units; sections of a ``focus`` come first after declarations, others two places later."""
    place = F.coalesce(F.create_map(*[F.lit(x) for p in PLACES.items() for x in p])[F.col("section")], F.lit(5))
    if focus:
        place = F.when(F.col("section") == "declarations", 0).when(F.col("section").isin(FOCUS[focus]), 1).otherwise(place + 2)
    return [place, F.col("distance"), utf16_order("file"), F.col("line"), F.col("start_offset"), utf16_order(F.concat_ws("|", "source", "target", "kind", "file", F.col("start_offset").cast("string")))]


def section_totals(evidence: DataFrame, by: str = "start") -> DataFrame:
    """``(by, section, n, n_files)`` counted over the section and the other sections of every edge; per file before the shuffle."""
    rows = evidence.select(by, "file", F.explode(F.array_except(F.array_union(F.array("section"), F.split("also_sections", ",")), F.array(F.lit("")))).alias("section"))
    return rows.groupBy(by, "section", "file").agg(F.count("*").alias("n")).groupBy(by, "section").agg(F.sum("n").alias("n"), F.count("*").alias("n_files"))


def first_page(evidence: DataFrame, max_items: int = 40, max_files: int = 12, max_chars: int | None = None, by: str = "start") -> DataFrame:
    """The first rows of each ``by`` in evidence order: at most ``max_items``, from at most ``max_files`` files, and with ``max_chars`` as long as the rows as JSON have no more characters.

    The first ``max_items`` rows are cut before the shuffle, so a symbol with very many relations is a short window too.
    """
    order = Window.partitionBy(by).orderBy(*evidence_order())
    top = evidence.withColumn("position", F.row_number().over(order)).where(F.col("position") <= max_items)
    here = Window.partitionBy(by).orderBy("position")
    first = F.when(F.row_number().over(Window.partitionBy(by, "file").orderBy("position")) == 1, 1).otherwise(0)
    rows = top.withColumn("_first", first).withColumn("_files", F.sum("_first").over(here)).where(F.col("_files") <= max_files)
    if max_chars is not None:
        rows = rows.withColumn("_chars", F.sum(F.length(F.to_json(F.struct("section", *EDGE, "reason", "distance")))).over(here)).where((F.col("_chars") <= max_chars) | (F.col("position") == 1)).drop("_chars")
    return rows.drop("_first", "_files")


def dictionary(evidence: DataFrame, column: str) -> DataFrame:
    """``(value, code, n)``: a dense code from 0 for every value of a column, by code units of its text; ranges of values are sorted in tasks of their own."""
    values = evidence.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")).where("value is not null")
    return ranked(values.withColumn("_o", utf16_order("value")), ["_o"], "code").select("value", "code", "n")


def grouped_sites(evidence: DataFrame, by: str = "start") -> DataFrame:
    """``(by, target, kind, confidence, section, file, sites)``: relations with equal attributes as one row per file, sites as ``line:offset`` in order."""
    rows = evidence.groupBy(by, "target", "kind", "confidence", "section", "file").agg(F.sort_array(F.collect_set(F.struct("line", "start_offset"))).alias("s"))
    return rows.select(by, "target", "kind", "confidence", "section", "file", F.array_join(F.transform("s", lambda x: F.concat_ws(":", x["line"].cast("string"), x["start_offset"].cast("string"))), " ").alias("sites"))


def source_windows(evidence: DataFrame, around: int = 2) -> DataFrame:
    """``(file, start_line, end_line)`` around every different site, from line 1 on, merged where they overlap or touch."""
    sites = evidence.where("line is not null and file is not null").select("file", "line").distinct()
    return interval_islands(sites.select("file", F.greatest(F.col("line") - around, F.lit(1)).alias("start_line"), (F.col("line") + around).alias("end_line")))
