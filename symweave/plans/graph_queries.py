"""Queries of the graph, version, evidence, accounting and stream operators over whole tables, with their SQL."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from symweave.functions.scalars import language, repository, test_path
from symweave.operators import accounting, diff, evidence, graph, lexical, nested, reading, traverse
from symweave.plans.problems import RECORDS, flat_sql
from symweave.session import stage, table
from symweave.sources import records
from symweave.streaming import changes


def _nodes(s: SparkSession, d: str) -> DataFrame:
    return graph.latest_nodes(table(s, d, "nodes"), table(s, d, "library_nodes"))


def _edges(s: SparkSession, d: str) -> DataFrame:
    return graph.distinct_edges(table(s, d, "edges"))


def _removed(s: SparkSession, d: str) -> DataFrame:
    return _nodes(s, d).where("removed_at is not null and kind <> 'file'").select("id")


def _symbols(s: SparkSession, d: str) -> DataFrame:
    return _nodes(s, d).where("kind not in ('file', 'external')").select("id")


def _record_tables(s: SparkSession, d: str, tables: dict[str, dict[str, str]]) -> list[DataFrame]:
    """Flat tables of the current records with typed fields; the records are read once."""
    objects = stage(nested.nested_objects(table(s, d, "files"), whole={k: list(v) for k, v in tables.items()}).where(F.col("table").isin(list(tables))), "objects")
    typed = lambda fields: [F.col(f"f_{c}").try_cast(t).alias(c) for c, t in fields.items()]
    return [nested.flat_table(objects, place, list(fields)).select(F.col("file").alias("record"), "ordinal", *typed(fields)) for place, fields in tables.items()]


def _recipes(s: SparkSession, d: str) -> evidence.Recipes:
    site = {"file": "string", "line": "long", "offset": "long"}
    places = {"intent.symbols[]": {"id": "string", "kind": "string", "parent": "string", **site}, "intent.relations[]": {"source": "string", "target": "string", "kind": "string", "confidence": "string", **site}, "intent.tests[]": {"framework": "string", "name": "string", "line": "long", "end": "long"}}
    symbols, relations, cases = _record_tables(s, d, places)
    relations = relations.withColumn("confidence", F.coalesce("confidence", F.lit("resolved"))).withColumnRenamed("offset", "start_offset")
    nodes, edges = evidence.context(_nodes(s, d), _edges(s, d), symbols.withColumnRenamed("offset", "start_offset"), relations)
    return evidence.Recipes(_symbols(s, d), nodes, edges, cases.select(F.col("record").alias("file"), "ordinal", "framework", "name", "line", F.col("end").alias("end_line")))


def _found(s: SparkSession, d: str, intent: str = "remove_symbol") -> DataFrame:
    return evidence.required(evidence.deduplicate(_recipes(s, d).collect(intent)))


def graph_nodes(s, d):
    return _nodes(s, d).withColumn("tags", F.array_join("tags", ","))


def graph_edges(s, d):
    return _edges(s, d)


def graph_dangling(s, d):
    return graph.dangling_edges(table(s, d, "edges"), _nodes(s, d))


def graph_unreferenced(s, d):
    return graph.unreferenced(_nodes(s, d), table(s, d, "edges")).select("id", "kind")


def graph_callers(s, d):
    return graph.relations(_edges(s, d), _nodes(s, d), ["calls"], "in")


def graph_callees(s, d):
    return graph.relations(_edges(s, d), _nodes(s, d), ["calls"], "out")


def graph_references(s, d):
    return graph.relations(_edges(s, d), _nodes(s, d), ["references"], "in")


def graph_neighbours(s, d):
    return graph.neighbours(_edges(s, d))


def graph_neighbour_rows(s, d):
    return graph.neighbour_rows(_edges(s, d), _nodes(s, d))


def graph_inspect(s, d):
    return graph.inspect(_edges(s, d), _nodes(s, d))


def graph_compact(s, d):
    return graph.compact(_nodes(s, d))


PREFIXES = ["lib/", "src/graph/", "packages/wharf/", "amber", "src/engine/policy_frame", "nowhere/"]


def graph_file_filters(s, d):
    return graph.file_filters(table(s, d, "files"), PREFIXES)


def graph_dependencies(s, d):
    return graph.file_dependencies(_edges(s, d), _nodes(s, d))


def graph_search(s, d):
    return graph.search(_nodes(s, d), "store")


def graph_search_page(s, d):
    rows = graph.search(_nodes(s, d), "e", kind="struct", lang="go")
    return graph.page(rows, ["rank", graph.utf16_order("id")], 2, 20)


def graph_resolve(s, d):
    return graph.resolve(table(s, d, "edges").select(F.element_at(F.split("target", "::"), -1).alias("target")).select(F.substring_index("target", "#", 1).alias("target")), _nodes(s, d))


def graph_candidates(s, d):
    names = _edges(s, d).where("target is not null").select(F.element_at(F.split("target", r"[.:#/]"), -2).alias("target")).where("target is not null and target <> ''")
    return graph.resolve_candidates(names, _nodes(s, d))


def graph_unlinked_homonyms(s, d):
    return graph.unlinked_homonyms(_nodes(s, d), _recipes(s, d).linked())


def graph_diagnostics(s, d):
    return graph.diagnostic_samples(table(s, d, "files"), 200)


def graph_diagnostic_identities(s, d):
    return graph.diagnostic_identities(table(s, d, "files"))


def graph_callers_page(s, d):
    rows = graph.relations(_edges(s, d), _nodes(s, d), ["calls"], "in")
    return graph.page(rows, [*graph.row_text_order("target_id", "id", "kind", "name", "file", "line", "tags", "relation", "direction", "site_file", "site_line", "confidence")], 10, 50)


def graph_innermost(s, d):
    return graph.innermost(table(s, d, "edges").select("edge_id", "file", "line").distinct(), _nodes(s, d))


def graph_homonyms(s, d):
    return graph.homonyms(_nodes(s, d))


def graph_derived_overrides(s, d):
    return graph.derived_overrides(_edges(s, d), _nodes(s, d))


def graph_architecture(s, d):
    return graph.architecture(_nodes(s, d), _edges(s, d), table(s, d, "files"))


def graph_hubs(s, d):
    return graph.hubs(_edges(s, d), _nodes(s, d))


def graph_ranked_callers(s, d):
    return graph.ranked_callers(_edges(s, d), _nodes(s, d))


def graph_health(s, d):
    return graph.health(table(s, d, "files"), _nodes(s, d), _edges(s, d))


def graph_redelivered(s, d):
    return graph.redelivered(table(s, d, "edges"))


def graph_multiset(s, d):
    columns = ["source", "target", "kind", "file", "start_offset"]
    return graph.multiset_difference(table(s, d, "edges").select(*columns), _edges(s, d).select(*columns))


def closure_contracts(s, d):
    return _recipes(s, d).linked().where("distance > 0")


def closure_flow(s, d):
    return traverse.flow(_symbols(s, d), _edges(s, d))


def closure_tests(s, d):
    return traverse.tests_of(_symbols(s, d), _edges(s, d), _nodes(s, d), 2)


def closure_implementations(s, d):
    return traverse.implementations(_symbols(s, d), _edges(s, d))


def closure_impact(s, d):
    return traverse.impact(_removed(s, d), _edges(s, d), _nodes(s, d))


def closure_impact_files(s, d):
    return traverse.impact_files(closure_impact(s, d), _nodes(s, d))


def closure_depth(s, d):
    return traverse.depth_limited(_removed(s, d), _edges(s, d), _nodes(s, d), 2)


def closure_paths(s, d):
    return traverse.paths(closure_impact(s, d)).withColumn("path", F.array_join("path", " "))


def closure_path_to(s, d):
    tests = _nodes(s, d).where(test_path("file")).where("kind not in ('file', 'external')").select("id")
    reached = traverse.flow(tests, _edges(s, d), 3).where("distance > 1")
    return traverse.path_to(reached.select("start", F.col("id").alias("destination")), _edges(s, d), 3)


def _dependencies(s, d):
    return diff_current(s, d).select("file", F.explode("dependencies").alias("target"))


def diff_current(s, d):
    row = F.struct("indexed_at", "hash", "dependencies")
    return table(s, d, "files").where("file is not null").groupBy("file").agg(F.max(row).alias("r")).select("file", "r.hash", "r.dependencies")


def closure_affected_files(s, d):
    return traverse.affected_files(diff.file_changes(table(s, d, "file_snapshots")).select("file"), _dependencies(s, d))


def diff_files(s, d):
    return diff.file_changes(table(s, d, "file_snapshots"))


def diff_correspondence(s, d):
    return diff.relation_correspondence(table(s, d, "file_snapshots"))


def diff_review(s, d):
    return diff.review(table(s, d, "file_snapshots"))


def diff_declarations(s, d):
    return diff.declaration_changes(table(s, d, "file_snapshots"))


def diff_relations(s, d):
    return diff.relation_changes(table(s, d, "file_snapshots"))


def diff_diagnostics(s, d):
    return diff.diagnostic_changes(table(s, d, "files"))


def diff_preceding(s, d):
    return diff.preceding_declaration(table(s, d, "edges").select("edge_id", "file", "start_offset").distinct(), _nodes(s, d))


def _lines(s, d):
    return lexical.line_documents(table(s, d, "sources"), _nodes(s, d))


def lexical_frequencies(s, d):
    return lexical.document_frequencies(_lines(s, d))


def lexical_bm25(s, d):
    return lexical.rank(_lines(s, d), "switch total default", _nodes(s, d)).withColumn("score", F.round("score", 6))


def lexical_overlap(s, d):
    return lexical.rank(_lines(s, d), "HashMap record string", _nodes(s, d), ranking="overlap").withColumn("score", F.round("score", 6))


def lexical_filtered(s, d):
    return lexical.rank(_lines(s, d), "switch total return", _nodes(s, d), lang="go", kind="method").withColumn("score", F.round("score", 6))


def lexical_grouped(s, d):
    return lexical.grouped(lexical.scored(_lines(s, d), "switch total default", _nodes(s, d))).withColumn("score", F.round("score", 6))


def lexical_expanded(s, d):
    return lexical.expanded(lexical.rank(_lines(s, d), "switch total default", _nodes(s, d)), _edges(s, d), "dependencies")


def lexical_per_file(s, d):
    return lexical.best_per_file(_lines(s, d), ["switch", "total", "default"])


def lexical_postings(s, d):
    return lexical.name_postings(_nodes(s, d), 20)


def lexical_posting_blocks(s, d):
    return lexical.posting_blocks(_nodes(s, d))


def evidence_extract(s, d):
    numbers = lambda *names: dict.fromkeys(names, "long")
    kinds = {"statements": numbers("line", "end", "offset", "end_offset") | {"scope": "string", "block": "string"}, "bindings": {"id": "string", **numbers("offset")}, "uses": numbers("offset") | {"scope": "string", "binding": "string", "read": "boolean", "write": "boolean"}, "controls": numbers("offset") | {"kind": "string"}}
    statements, bindings, uses, controls = (t.drop("ordinal").withColumnRenamed("record", "file") for t in _record_tables(s, d, {f"intent.ast.{k}[]": f for k, f in kinds.items()}))
    blocks = statements.where("line is not null and end is not null").groupBy("file", "scope", "block").agg(F.min("line").alias("start_line"), F.max("end").alias("end_line"))
    wanted = blocks.select(F.concat_ws("|", "file", "scope", "block").alias("region"), "file", "start_line", "end_line")
    return reading.extraction(stage(reading.regions(statements, wanted), "regions"), bindings, uses, controls)


def evidence_fusion(s, d):
    """The evidence of each symbol in pages of 40, put together again."""
    by = Window.partitionBy("start").orderBy(*evidence.evidence_order())
    rows = _found(s, d).withColumn("n", F.row_number().over(by) - 1).withColumn("page", F.floor(F.col("n") / 40))
    last = rows.groupBy("start").agg(F.max("page").alias("last"))
    pages = rows.join(last, "start").select(F.col("start").alias("collection"), "page", (F.col("page") * 40).alias("offset"), F.when(F.col("page") < F.col("last"), (F.col("page") + 1) * 40).alias("next_offset"), F.col("evidence_id").alias("record"))
    return accounting.page_fusion(pages)


INTENTS = ["rename", "change_signature", "find_tests", "explain_symbol", "trace_flow", "move_symbol", "remove_symbol", "replace_dependency"]


def _intent(name: str):
    return lambda s, d: _found(s, d, name)


def evidence_sections(s, d):
    return evidence.section_totals(_found(s, d))


def evidence_page(s, d):
    return evidence.first_page(_found(s, d)).drop("evidence_id")


def evidence_files(s, d):
    return evidence.dictionary(_found(s, d), "file")


def evidence_groups(s, d):
    return evidence.grouped_sites(_found(s, d))


def evidence_windows(s, d):
    return evidence.source_windows(_found(s, d))


def usage_deltas(s, d):
    return accounting.counter_deltas(table(s, d, "events"))


def usage_sums(s, d):
    return accounting.sums_with_unknowns(table(s, d, "events").withColumn("value", F.expr("case when event_id % 97 <> 0 then value end")), ["user_id", "event_type"])


def usage_conflicts(s, d):
    e = table(s, d, "events").select("event_id", "ts", "user_id", "event_type", "value", "props")
    return accounting.conflicts(e.unionByName(e.withColumn("event_id", F.floor(F.col("event_id") / 2).cast("long"))))


def usage_identities(s, d):
    """Relations whose site was delivered with different lines or confidences."""
    return accounting.conflicts(table(s, d, "edges").where("source is not null and target is not null"), graph.IDENTITY, ["line", "confidence"])


def usage_unresolved(s, d):
    """Unresolved calls of the current records by repository and language, unknown if one is."""
    rows = table(s, d, "files").where("file is not null").groupBy("file").agg(F.max(F.struct("indexed_at", "unresolved_calls")).alias("r"))
    return accounting.sums_with_unknowns(rows.select("file", repository("file").alias("repo"), language("file").alias("language"), F.col("r.unresolved_calls").alias("n")), ["repo", "language"], "n", "file")


def usage_campaign(s, d):
    return accounting.campaign(table(s, d, "events"))


def usage_ledger(s, d):
    return accounting.ledger(table(s, d, "events"))


def usage_read_audit(s, d):
    return accounting.read_audit(table(s, d, "events"))


def usage_percentiles(s, d):
    return accounting.percentiles(table(s, d, "events"))


def usage_bootstrap(s, d):
    day = F.dayofmonth("ts")
    rows = table(s, d, "events").groupBy(F.col("event_type").alias("metric"), F.col("user_id").alias("task")).agg(F.sum(F.when(day <= 15, F.col("value")).otherwise(0.0)).alias("a"), F.sum(F.when(day > 15, F.col("value")).otherwise(0.0)).alias("b"))
    return accounting.paired_bootstrap(rows).select("metric", *[F.round(c, 6).alias(c) for c in ("ratio", "low", "high")])


def usage_attempts(s, d):
    event = F.when(F.col("event_type") == "purchase", "finished").when(F.col("event_type") == "view", "started")
    return accounting.attempts(table(s, d, "events").select(F.concat_ws(" ", "user_id", F.date_format("ts", "yyyy-MM-dd")).alias("attempt"), event.alias("event"), F.col("ts").alias("at"), F.lit("day").alias("kind")))


def source_freshness(s, d):
    return reading.freshness(table(s, d, "files"), table(s, d, "sources"))


def source_snippets(s, d):
    return reading.snippets(_nodes(s, d).where("kind not in ('file', 'external')"), table(s, d, "sources"))


def source_merged(s, d):
    return reading.merge_windows(source_snippets(s, d).select("file", "start_line", "text"))


def source_generation(s, d):
    return reading.generation(diff_current(s, d))


def source_hashes(s, d):
    return records.hash_report(table(s, d, "sources"))


def source_record_nodes(s, d):
    return records.record_nodes(table(s, d, "files"))


def source_violations(s, d):
    return records.violations(_nodes(s, d), table(s, d, "edges"), table(s, d, "sources"))


def source_upsert(s, d):
    return records.upsert_round_trip(s, d)


def stream_windows(s, d):
    return changes.tumbling(s, d)


def stream_sessions(s, d):
    return changes.sessions(table(s, d, "events"))


def stream_sliding(s, d):
    return changes.sliding(table(s, d, "events")).drop("users")


def stream_dedup(s, d):
    return changes.deduplicated(s, d)


def stream_index(s, d):
    return changes.maintained_index(s, d)


_LISTED = [
    graph_nodes, graph_edges, graph_dangling, graph_unreferenced, graph_callers, graph_callees, graph_references, graph_neighbours, graph_neighbour_rows, graph_inspect, graph_compact, graph_file_filters, graph_dependencies, graph_search, graph_search_page, graph_resolve, graph_candidates, graph_unlinked_homonyms, graph_diagnostics, graph_diagnostic_identities, graph_callers_page,
    graph_innermost, graph_homonyms, graph_derived_overrides, graph_architecture, graph_hubs, graph_ranked_callers, graph_health, graph_redelivered, graph_multiset,
    closure_contracts, closure_flow, closure_tests, closure_implementations, closure_impact, closure_impact_files, closure_depth, closure_paths, closure_path_to, closure_affected_files,
    diff_files, diff_correspondence, diff_review, diff_declarations, diff_relations, diff_diagnostics, diff_preceding,
    lexical_frequencies, lexical_bm25, lexical_overlap, lexical_filtered, lexical_grouped, lexical_expanded, lexical_per_file, lexical_postings, lexical_posting_blocks,
    evidence_sections, evidence_page, evidence_files, evidence_groups, evidence_windows, evidence_extract, evidence_fusion,
    usage_deltas, usage_sums, usage_conflicts, usage_identities, usage_unresolved, usage_campaign, usage_ledger, usage_read_audit, usage_percentiles, usage_bootstrap, usage_attempts,
    source_hashes, source_record_nodes, source_violations, source_upsert, source_freshness, source_snippets, source_merged, source_generation,
    stream_windows, stream_sessions, stream_sliding, stream_dedup, stream_index,
]
QUERIES = {f.__name__: f for f in _LISTED} | {f"evidence_{name}": _intent(name) for name in INTENTS}

_N = """n0 as (select id, name, kind, file, line, qualified, end_line, start_offset, length, parent, tags, synthetic, indexed_at, removed_at from nodes
    union all select id, name, kind, file, line, qualified, end_line, start_offset, length, parent, tags, synthetic, indexed_at, removed_at from library_nodes),
  n as (select * exclude (rn) from (select *, row_number() over (partition by id order by indexed_at desc, removed_at desc nulls last) rn from n0) where rn = 1)"""
_E = """e as (select source, target, kind, file, start_offset, edge_id, line, coalesce(confidence, 'resolved') confidence, indexed_at
  from (select *, row_number() over (partition by source, target, kind, file, start_offset order by edge_id) rn from edges) where rn = 1)"""
_V = "v as (select * from (select *, row_number() over (partition by snapshot_no, file order by received_at desc nulls last) rn from file_snapshots) where rn = 1)"
_CUR = "cur as (select * from (select *, row_number() over (partition by file order by indexed_at desc nulls last) rn from files where file is not null) where rn = 1)"
_LANG = """case regexp_extract(file, '[^.]*$') when 'dart' then 'dart' when 'ts' then 'typescript' when 'tsx' then 'typescript' when 'js' then 'javascript' when 'mjs' then 'javascript'
  when 'java' then 'java' when 'go' then 'go' when 'py' then 'python' when 'rs' then 'rust' when 'swift' then 'swift' when 'kt' then 'kotlin' when 'm' then 'objectivec' when 'h' then 'objectivec' else 'unknown' end"""


def _rel(kind: str, own: str, other: str, direction: str) -> str:
    return f"""select e.{own} target_id, b.id, b.kind, b.name, b.file, b.line, array_to_string(b.tags, ',') tags, e.kind relation, '{direction}' direction, e.file site_file, e.line site_line, e.confidence
      from e join n a on a.id = e.{own} join n b on b.id = e.{other} where {kind}"""


_WAYS = """key0 as (select *, concat_ws('|', source, target, kind, file, start_offset) k from e where source is not null and target is not null),
w0 as (select e.target a, e.source nx, e.kind reason, 0 cls, e.k from key0 e where e.kind in ('references','calls','extends','implements','with','on','overrides','registers','imports','exports','part','part_of')
  union all select e.source, e.target, 'member_of_changed_container', 1, e.k from key0 e join n on n.id = e.source where e.kind = 'contains' and n.kind in ('file','class','mixin','enum','extension','extension_type','interface','struct','record','type')
  union all select e.source, e.target, 'dispatch_contract', 2, e.k from key0 e where e.kind = 'overrides'
  union all select n.id, p.id, 'container_of_affected_member', 3, '' from n join n p on p.id = n.parent where p.kind <> 'file'),
w as (select w0.* from w0 join n on n.id = w0.nx where a is not null),
l0 as (select id, null::varchar via, null::varchar reason, row_number() over (order by id) pos from n where removed_at is not null and kind <> 'file')"""


def _impact(depth: int) -> str:
    """The levels of the impact as l0, l1, ... and all of them as ``im``."""
    seen, sql = "select id from l0", ""
    parts = ["select id, 0 distance, via, reason from l0"]
    for k in range(1, depth + 1):
        sql += f""", c{k} as (select nx id, l{k - 1}.id via, w.reason, pos, cls, w.k, row_number() over (partition by nx order by pos, cls, w.k) rn from w join l{k - 1} on w.a = l{k - 1}.id where nx not in ({seen})),
        l{k} as (select id, via, reason, row_number() over (order by pos, cls, k, id) pos from c{k} where rn = 1)"""
        seen += f" union all select id from l{k}"
        parts.append(f"select id, {k}, via, reason from l{k}")
    return f"with recursive {_N}, {_E}, {_WAYS}{sql}, im as (" + " union all ".join(parts) + ")"


_TERMS = """list_distinct(list_concat(list_transform(regexp_extract_all({t}, '[\\p{{L}}\\p{{N}}]+'), lambda w: lower(w)),
  list_transform(string_split(trim(regexp_replace(regexp_replace({t}, '([\\p{{Ll}}\\p{{N}}])(\\p{{Lu}})', '\\1 \\2', 'g'), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' '), lambda w: lower(w))))"""


def _terms(t: str) -> str:
    return f"list_filter({_TERMS.format(t=t)}, lambda w: w <> '')"


_DOCS = f"""tx as (select file, max(text) t from sources where file is not null and text is not null group by file),
li as (select file, string_split(t, chr(10)) ls from tx),
lb as (select file, unnest(range(1, len(ls) + 1)) line, unnest(ls) body from li),
la as (select * from (select lb.*, n.id anchor, row_number() over (partition by lb.file, lb.line order by n.end_line - n.line, n.id) rn from lb left join n on n.file = lb.file and n.kind <> 'file' and lb.line between n.line and n.end_line) where rn = 1),
dd as (select file, cast(line as int) line, anchor, {_terms('body')} own, list_distinct(list_concat({_terms('file')}, coalesce({_terms('anchor')}, []))) ft from la),
doc as (select file, line, anchor, list_distinct(list_concat(own, ft)) terms, ft from dd where len(own) > 0)"""


def _scored(query: list[str], ranking: str = "bm25", scope: str = "true") -> str:
    """The rows with a term of the query as ``sc``; none of these queries names a declaration."""
    one = []
    for t in query:
        df = f"(select count(*) from doc where {scope} and list_contains(terms, '{t}'))"
        if ranking == "overlap":
            one.append(f"case when list_contains(terms, '{t}') then ln((N + 1) / ({df} + 1)) + 1 else 0 end")
        else:
            one.append(f"case when list_contains(terms, '{t}') then ln(1 + (N - {df} + 0.5) / ({df} + 0.5)) * 2.2 / (1 + 1.2 * (0.25 + 0.75 * len(terms) / A)) * case when list_contains(ft, '{t}') then 2 else 1 end else 0 end")
    return f"""with {_N}, {_E}, {_DOCS}, ix as (select count(*) N, greatest(avg(len(terms)), 1) A from doc where {scope}),
      sc as (select file, line, anchor, {' + '.join(one)} score, cast(len(list_intersect(terms, [{', '.join(repr(t) for t in query)}])) as int) matched from doc, ix where {scope} and len(list_intersect(terms, [{', '.join(repr(t) for t in query)}])) > 0)"""


_TOP = "select file, line, anchor, round(score, 6) score, matched from sc order by sc.score desc, file, line limit 50"


_CONTEXT = f"""{RECORDS}, {_N}, {_E},
sy as (select * from (select value ->> '$.id' id, value ->> '$.kind' kind, value ->> '$.file' file, try_cast(value ->> '$.line' as bigint) line, try_cast(value ->> '$.offset' as bigint) start_offset, value ->> '$.parent' parent,
  row_number() over (partition by value ->> '$.id' order by value ->> '$.kind' desc nulls last, value ->> '$.file' desc nulls last, try_cast(value ->> '$.line' as bigint) desc nulls last, try_cast(value ->> '$.offset' as bigint) desc nulls last, value ->> '$.parent' desc nulls last) rn
  from obj where "table" = 'intent.symbols[]' and value ->> '$.id' is not null) where rn = 1),
cn as (select id, kind, file, line, start_offset, parent from n union all select id, kind, file, line, start_offset, parent from sy where id not in (select id from n)),
ce as (select source, target, kind, file, line, start_offset, confidence from e where source is not null and target is not null union all
  select distinct value ->> '$.source', value ->> '$.target', value ->> '$.kind', value ->> '$.file', try_cast(value ->> '$.line' as bigint), try_cast(value ->> '$.offset' as bigint), coalesce(value ->> '$.confidence', 'resolved') from obj
  where "table" = 'intent.relations[]' and value ->> '$.source' is not null and value ->> '$.target' is not null),
tc as (select file, ordinal, value ->> '$.framework' framework, value ->> '$.name' as name, try_cast(value ->> '$.line' as bigint) a, try_cast(value ->> '$.end' as bigint) b from obj where "table" = 'intent.tests[]'),
st as (select id as start from n where kind not in ('file', 'external')),
lk as (select start, start id, 0 d from st union select lk.start, case when ce.source = lk.id then ce.target else ce.source end, lk.d + 1 from lk join ce on lk.id in (ce.source, ce.target) where ce.kind in ('overrides', 'binds_field', 'accessor_pair', 'super_parameter') and lk.d < 2),
ln as (select start, id, min(d) d from lk group by all),
wi as (select start, start id, 0 d from st union select wi.start, case when ce.target = wi.id then ce.source else ce.target end, wi.d + 1 from wi join ce on (ce.target = wi.id and ce.kind in ('calls', 'overrides')) or (ce.source = wi.id and ce.kind = 'overrides') where wi.d < 1),
wo as (select start, start id, 0 d from st union select wo.start, case when ce.source = wo.id then ce.target else ce.source end, wo.d + 1 from wo join ce on (ce.source = wo.id and ce.kind in ('calls', 'overrides')) or (ce.target = wo.id and ce.kind = 'overrides') where wo.d < 1),
tr as (select start, start id, 0 d from st union select tr.start, ce.source, tr.d + 1 from tr join ce on ce.target = tr.id where ce.kind in ('calls', 'references', 'overrides') and tr.d < 1)"""
_CE = "ce.source, ce.target, ce.kind, ce.file, ce.line, ce.start_offset, ce.confidence"


def _declared(ids: str, step: int, section: str) -> str:
    return f"select x.start, {step} step, '{section}' section, 'indexed_declaration; range is not an editable token span' reason, 0 distance, cn.id source, cn.id target, 'declaration' kind, cn.file, cn.line, cn.start_offset, 'resolved' confidence from ({ids}) x join cn on cn.id = x.id"


def _incoming(ids: str, step: int, kinds: str, section: str, reason: str = "resolved_static_site", end: str = "target", distance: str = "1") -> str:
    return f"select x.start, {step}, {section}, '{reason}', {distance}, {_CE} from ({ids}) x join ce on ce.{end} = x.id where ce.kind in ({kinds})"


_ONE, _LN = "select start, start id, 0 d from st", "select * from ln"
_LINKS = "'overrides', 'binds_field', 'accessor_pair', 'super_parameter'"


def _contracts(step: int) -> list[str]:
    return [*[_incoming(_LN, step, _LINKS, "'contracts'", "compiler_resolved_symbol_link", end, "x.d + 1") for end in ("target", "source")], _declared("select * from ln where d > 0", step, "declarations")]


def _directives(step: int, kinds: str) -> list[str]:
    files = "select st.start, cn.file || '::file' id from st join cn on cn.id = st.start"
    return [_incoming(files, step, kinds, "'module_context'", "file-level directive; not an obligatory symbol edit", end) for end in ("target", "source")]


def _walk(step: int, near: str, ends: tuple, section: str) -> list[str]:
    near = f"select start, id, min(d) d from {near} group by all"
    parts = [_incoming(near, step, kinds, f"'{section}'", "?", end, "x.d + 1") for end, kinds in zip(ends, ("'calls', 'overrides'", "'overrides'"))]
    return [p.replace("'?'", "case when ce.kind = 'calls' then 'static_call; runtime order unknown' else 'possible_dispatch; not proven runtime call' end") for p in parts]


def _tests(step: int) -> list[str]:
    near = "select start, id, min(d) d from tr group by all"
    case = "(select list_sort(list([lpad(ordinal::varchar, 9, '0'), coalesce(framework, ''), coalesce(name, '')]))[1] from tc where tc.file = ce.file and ce.line between tc.a and tc.b)"
    sites = f"""select *, {case} c from ce where kind in ('calls', 'references', 'overrides')"""
    return [f"""select x.start, {step}, case when ce.c is not null then 'tests' else 'test_candidates' end, case when ce.c is not null then 'resolved test case ' || ce.c[2] || ': ' || ce.c[3] || '; static reference does not prove execution/assertion'
      else 'heuristic test-file classification with resolved graph link; runner/assertions unknown' end, x.d + 1, {_CE} from ({near}) x join ({sites}) ce on ce.target = x.id
      where ce.c is not null or regexp_matches(ce.file, '(^|/)(tests?|integration_test|__tests__)/|_test\\.|\\.test\\.|\\.spec\\.|Test\\.(java|kt)$')"""]


_INNER = "case when ce.source = x.start then 'internal_group' else 'consumers' end"
_PARTS = {
    "rename": [*_contracts(1), _incoming(_LN, 2, "'references', 'calls', 'parameter_reference'", "'usages'"), *_directives(3, "'exports', 'part', 'part_of'")],
    "change_signature": [*_contracts(1), _incoming(_LN, 2, "'calls', 'references'", "'callers'"), *_walk(3, "wi", ("target", "source"), "forwarding_context"), *_tests(4), _incoming(_ONE, 5, "'contains'", "'contract'", "indexed_member", "source", "0")],
    "find_tests": _tests(1),
    "explain_symbol": [
        _declared("select cn.id as start, cn.parent id from cn join st on st.start = cn.id", 1, "container"), *_contracts(2),
        _incoming(_ONE, 3, "'overrides', 'implements', 'extends', 'with'", "'implementations'", "resolved implementation/subtype; runtime selection unknown"),
        _incoming(_ONE, 4, "'calls', 'references', 'extends', 'implements', 'with', 'on'", "'dependencies'", "resolved direct dependency; role tags are hints", "source"), _incoming(_ONE, 5, "'calls', 'references'", "'consumers'"),
    ],
    "trace_flow": _walk(1, "wo", ("source", "target"), "flow"),
    "move_symbol": [_incoming(_ONE, 1, "'references', 'calls'", "'consumers'"), *_contracts(2), *_directives(3, "'imports', 'exports', 'part', 'part_of'")],
    "remove_symbol": [_incoming(_ONE, 1, "'calls', 'references', 'overrides', 'registers'", _INNER), *_contracts(2), _incoming(_LN, 3, "'references', 'parameter_reference', 'calls'", _INNER), *_directives(4, "'imports', 'exports', 'part', 'part_of'"), *_tests(5)],
    "replace_dependency": [_incoming(_ONE, 1, "'calls', 'references', 'registers', 'implements', 'extends'", "'composition'"), *_contracts(2), *_tests(3)],
}


def _evidence(intent: str) -> str:
    """The evidence of one recipe: ``fd`` has one row per start and relation."""
    parts = " union all ".join([_declared(_ONE, 0, "declarations"), *_PARTS[intent]])
    return f"""with recursive {_CONTEXT}, ev as ({parts}),
    f1 as (select start, source, target, kind, file, line, start_offset, confidence, section, min({{'s': step, 'd': distance, 'r': reason}}) f from ev group by all),
    f2 as (select start, source, target, kind, file, line, start_offset, confidence, list_sort(list({{'s': f.s, 'd': f.d, 'n': section, 'r': f.r}})) every from f1 group by all),
    fd as (select * exclude (every), case when confidence = 'resolved' then every[1].n else 'candidates' end section,
      case when confidence = 'resolved' then array_to_string(list_transform(every[2:], lambda x: x.n), ',') else every[1].n end also_sections,
      case when confidence = 'resolved' then list_reduce(list_transform(every, lambda x: x.r), lambda a, b: case when contains(a, b) then a else a || '; ' || b end) else 'provider confidence ' || confidence || ': ' || every[1].r end reason,
      every[1].d distance, substr(sha256('["current",' || to_json({{'source': source, 'target': target, 'kind': kind, 'file': file, 'line': line, 'offset': start_offset, 'confidence': confidence}})::varchar || ']'), 1, 16) evidence_id from f2),
    fq as (select *, section not in ('container', 'dependencies', 'consumers', 'forwarding_context', 'impact', 'test_candidates', 'module_context', 'candidates')
      or list_has_any(string_split(also_sections, ','), ['usages', 'contracts', 'callers', 'flow', 'diagnostic_changes']) required from fd)"""


_RM = _evidence("remove_symbol")

_FC = """fc as (select b.snapshot_no, b.file, 'changed' change from v b left join v a on a.file = b.file and a.snapshot_no = b.snapshot_no - 1 where b.snapshot_no > 1 and (a.file is null or lower(a.hash) is distinct from lower(b.hash))
  union all select a.snapshot_no + 1, a.file, 'deleted' from v a left join v b on a.file = b.file and b.snapshot_no = a.snapshot_no + 1 where a.snapshot_no < 5 and b.file is null)"""


def _steps(depth: int) -> str:
    """Levels of the shortest ways from every start, each with the first relation that leads to a node."""
    parts, seen = [], "q0"
    for k in range(1, depth + 1):
        parts.append(f"""d{k} as (select q.start, w.nx id, q.pos, q.id via, w.way, w.source, w.target, w.kind, w.file, w.start_offset, w.k, row_number() over (partition by q.start, w.nx order by q.pos, w.way, w.kind, w.k) rn
        from q{k - 1} q join w on w.a = q.id where not exists (select 1 from {seen} z where z.start = q.start and z.id = w.nx)),
      q{k} as (select start, id, row_number() over (partition by start order by pos, way, kind, k, id) - 1 pos, via, source, target, kind, file, start_offset from d{k} where rn = 1)""")
        seen = f"(select start, id from q{k} union all select start, id from {seen.replace(' z', '')})"
    return ",\n      ".join(parts)


_STEPS = _steps(3)

_POISSON = " + ".join(f"case when v >= {sum(math.exp(-1) / math.factorial(j) for j in range(k + 1))!r} then 1 else 0 end" for k in range(12))


def _field(section: str, name: str, kind: str = "varchar") -> str:
    """A field of a row of the packed ast, by place, or of an object."""
    place = nested.PACKED[section].index(name)
    return f"try_cast(case when row_of then value ->> '$[{place}]' else value ->> '$.{name}' end as {kind})"


_SNIPPETS = f"""with {_N}, tx as (select file, string_split(max(text), chr(10)) ls from sources where file is not null and text is not null group by file),
      q as (select id, file, ls, greatest(line - 2, 1) a, least(end_line + 2, len(ls)) z from n join tx using (file) where kind not in ('file', 'external') and line >= 1 and end_line >= line and line <= len(ls)),
      r as (select id, file, a, z, array_to_string(ls[a:least(z, a + 119)], chr(10)) w from q),
      u as (select *, length(w) + length(regexp_replace(w, '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g')) > 16000 big from r),
      sn as (select id, file, a start_line, a + len(string_split(case when big then w[1:16000] else w end, chr(10))) - 1 end_line, a + 119 < z or big truncated, case when big then w[1:16000] else w end as text from u)"""

ORACLES = {
    "graph_diagnostic_identities": """with c as (select file, diagnostics from (select file, diagnostics, row_number() over (partition by file order by indexed_at desc nulls last, diagnostics desc nulls last) rn from files where file is not null) where rn = 1),
      x as (select file, unnest(diagnostics) d from c), y as (select * from x where d is not null)
      select file, sha256(file || chr(0) || d)[1:16] identity, case when starts_with(d, '{') and ends_with(d, '}') then case when json_valid(d) then coalesce(d ->> '$.severity', 'error') else 'error' end end severity, count(*) n from y group by all""",
    "usage_identities": """with v as (select distinct source, target, kind, file, start_offset, line, confidence from edges where source is not null and target is not null)
      select source, target, kind, file, start_offset, count(*) n_versions from v group by all having count(*) > 1""",
    "usage_unresolved": f"""with c as (select file, unresolved_calls u from (select file, unresolved_calls, row_number() over (partition by file order by indexed_at desc nulls last, unresolved_calls desc nulls last) rn from files where file is not null) where rn = 1)
      select split_part(file, '/', 1) repo, {_LANG} as "language", count(*) n, case when count(u) = count(*) then sum(u)::bigint end total from c group by 1, 2""",
    "graph_callers_page": f"""with {_N}, {_E}, r as ({_rel("e.kind = 'calls'", 'target', 'source', 'in')}) select * from r
      order by concat_ws(chr(9), target_id, id, kind, name, file, line, tags, relation, direction, site_file, site_line, confidence) limit 50 offset 10""",
    "diff_review": f"""with {_V}, pr as (select coalesce(b.snapshot_no, a.snapshot_no + 1) sn, coalesce(b.file, a.file) file, a.file is not null there, b.file is not null here, a.file is null or b.file is null or lower(a.hash) is distinct from lower(b.hash) mv
        from v b full join v a on a.file = b.file and a.snapshot_no = b.snapshot_no - 1 where coalesce(b.snapshot_no, a.snapshot_no + 1) between 2 and 5),
      dx as (select snapshot_no sn, file, unnest(nodes) d from v), dc as (select sn, file, d.id id, min({{'kind': d.kind, 'name': d.name, 'parent': d.parent}}) body, min(d.line) line from dx where d.id is not null group by all),
      dm as (select coalesce(b.sn, a.sn + 1) sn, coalesce(b.file, a.file) file, coalesce(b.id, a.id) id, b.body nb, a.body ob, coalesce(b.line, a.line) line from dc b full join dc a on a.file = b.file and a.id = b.id and a.sn = b.sn - 1 where coalesce(b.sn, a.sn + 1) between 2 and 5),
      sy as (select sn, file, id, line, case when nb is null then 'removed_symbols' when nb.kind = 'file' then null when ob is null then 'added_symbols' when nb is distinct from ob then 'changed_symbols' end section from dm),
      ex as (select snapshot_no sn, file, e.source, e.target, e.kind, coalesce(e.confidence, 'resolved') confidence, e.line, e.start_offset, count(*) n from (select snapshot_no, file, unnest(edges) e from v) where e is not null group by all),
      od as (select * replace (sn + 1 as sn) from ex where sn < 5),
      rl as (select x.sn, x.file, source, target, kind, confidence, line, start_offset, case when mv then sign(w) else 0 end side, sum(w) w from (select * exclude (n), -n w from od union all select * exclude (n), n from ex where sn > 1) x join pr on pr.sn = x.sn and pr.file = x.file group by all having sum(w) <> 0)
      select cast(sn as int) snapshot_no, 'source_changes' section, case when here then 'current' else 'before' end phase, file || '::file' source, file || '::file' target, case when not there then 'source_added' when not here then 'source_removed' else 'source_changed' end kind, file, 1::bigint line, 0::bigint start_offset, 1::bigint n from pr where mv
      union all select sn, section, case when section = 'removed_symbols' then 'before' else 'current' end, id, id, 'declaration', file, line, null, 1 from sy where section is not null
      union all select od.sn, 'affected_consumers', 'before', source, target, kind, od.file, line, start_offset, n from od where kind in ('calls', 'references', 'overrides') and exists (select 1 from sy where sy.sn = od.sn and sy.id = od.target and section = 'removed_symbols')
      union all select sn, case when w < 0 then 'removed_relations' else 'added_relations' end, case when w < 0 then 'before' else 'current' end, source, target, kind, file, line, start_offset, abs(w)::bigint from rl""",
    "graph_diagnostics": """with c as (select file, diagnostics from (select file, diagnostics, row_number() over (partition by file order by indexed_at desc nulls last, diagnostics desc nulls last) rn from files where file is not null) where rn = 1),
      x as (select file, unnest(range(len(diagnostics))) place, unnest(diagnostics) d from c), y as (select * from x where starts_with(d, '{') and ends_with(d, '}'))
      select file, cast(place as int) place, case when json_valid(d) then coalesce(d ->> '$.severity', 'error') else 'error' end severity, case when json_valid(d) then d ->> '$.code' end code, case when json_valid(d) then (d ->> '$.message')[1:512] end message,
        case when json_valid(d) then coalesce(length(d ->> '$.message') > 512, false) else false end truncated from y order by file, place limit 200""",
    "graph_unlinked_homonyms": f"""with recursive {_CONTEXT}, c as (select id, count(*) over (partition by name) k, name from n where name is not null),
      o as (select ln.start id, count(*) k from ln join n a on a.id = ln.start join n b on b.id = ln.id where ln.start <> ln.id and a.name = b.name group by ln.start)
      select c.id, c.k - 1 - coalesce(o.k, 0) n from c left join o using (id) where c.k - 1 - coalesce(o.k, 0) > 0""",
    "graph_candidates": f"""with {_N}, t as (select distinct regexp_split_to_array(target, '[.:#/]')[-2] target from edges where target is not null),
      k as (select id, 0 tier, id as key from n union all select id, 1, file from n where kind = 'file' union all select id, 2, qualified from n union all select id, 3, name from n),
      m as (select t.target, min(tier) tier from t join k on k.key = t.target where t.target <> '' group by t.target), c as (select m.target, k.id, row_number() over (partition by m.target order by k.id) place, count(*) over (partition by m.target) n from m join k on k.key = m.target and k.tier = m.tier)
      select target, cast(place as int) place, id from c where n > 1 and place <= 10""",
    "evidence_extract": f"""with recursive {RECORDS}, sm as (select file, {_field('statements', 'line', 'bigint')} line, {_field('statements', 'end', 'bigint')} "end", {_field('statements', 'offset', 'bigint')} o, {_field('statements', 'end_offset', 'bigint')} eo, {_field('statements', 'scope')} scope, {_field('statements', 'block')} block from obj where "table" = 'intent.ast.statements[]'),
      bd as (select file, {_field('bindings', 'id')} id, {_field('bindings', 'offset', 'bigint')} o from obj where "table" = 'intent.ast.bindings[]'),
      us as (select file, {_field('uses', 'offset', 'bigint')} o, {_field('uses', 'scope')} scope, {_field('uses', 'binding')} binding, {_field('uses', 'read', 'boolean')} rd, {_field('uses', 'write', 'boolean')} wr from obj where "table" = 'intent.ast.uses[]'),
      ct as (select file, {_field('controls', 'offset', 'bigint')} o, {_field('controls', 'kind')} kind from obj where "table" = 'intent.ast.controls[]'),
      wt as (select concat_ws('|', file, scope, block) region, file, min(line) a, max("end") z from sm where line is not null and "end" is not null group by file, scope, block),
      ins as (select wt.region, wt.a, wt.z, sm.* from wt join sm on sm.file = wt.file and sm.line >= wt.a and sm.line <= wt.z and sm."end" <= wt.z),
      ag as (select region, file, count(case when line = a and "end" = z then 1 end) nx, max(case when line = a and "end" = z then {{'o': o, 'eo': eo, 's': scope}} end) one,
        min(case when line = a then {{'o': o, 'eo': eo, 's': scope, 'b': block}} end) fi, max(case when "end" = z then {{'eo': eo, 'o': o, 's': scope, 'b': block}} end) la from ins group by region, file),
      rg as (select region, file, one.s scope, one.o lo, one.eo hi from ag where nx = 1 union all
        select i.region, i.file, ag.fi.s, min(i.o), max(i.eo) from ag join ins i on i.region = ag.region and i.file = ag.file and i.scope is not distinct from ag.fi.s and i.block is not distinct from ag.fi.b
        where nx <> 1 and fi is not null and la is not null and fi.s is not distinct from la.s and fi.b is not distinct from la.b group by i.region, i.file, ag.fi.s),
      ou as (select rg.region, rg.file, us.binding, us.rd, us.wr from rg join us on us.file = rg.file and us.o >= rg.lo and us.o < rg.hi join (select distinct file, id, o from bd) bd on bd.file = rg.file and bd.id = us.binding where bd.o < rg.lo or bd.o >= rg.hi),
      fa as (select region, file, 'capture_reads' fact, binding from ou where rd union all select region, file, 'external_mutations', binding from ou where wr
        union all select b.region, b.file, 'locals_used_after', b.id from (select distinct rg.region, rg.file, bd.id, rg.scope, rg.hi from rg join bd on bd.file = rg.file and bd.o >= rg.lo and bd.o < rg.hi) b join us on us.file = b.file and us.binding = b.id and us.scope is not distinct from b.scope and us.o >= b.hi
        union all select rg.region, rg.file, 'control_exits', ct.kind from rg join ct on ct.file = rg.file and ct.o >= rg.lo and ct.o < rg.hi)
      select region, file, fact, binding, count(*) n from fa group by all""",
    "evidence_fusion": f"{_RM} select start collection, cast(ceil(count(*) / 40) as bigint) n_pages, count(distinct evidence_id) n_records, count(*) - count(distinct evidence_id) n_repeated, true complete from fq group by start",
    "usage_bootstrap": f"""with p as (select event_type metric, user_id task, sum(case when dayofmonth(ts) <= 15 then value else 0 end) a, sum(case when dayofmonth(ts) > 15 then value else 0 end) b from events group by all),
      d as (select *, unnest(range(1000)) rs from p), u as (select *, ('0x' || md5('7|' || metric || '|' || task || '|' || rs)[1:12])::bigint / 281474976710656.0::double v from d),
      w as (select *, {_POISSON} w from u), s as (select metric, rs, sum(a * w) a, sum(b * w) b from w group by all), q as (select metric, list_sort(list(case when a <> 0 then b / a end), 'asc', 'nulls first') r, count(case when a <> 0 then 1 end) n from s group by metric),
      o as (select metric, sum(b) / nullif(sum(a), 0) ratio from p group by metric)
      select metric, round(ratio, 6) ratio, round(case when n = 1000 then r[25] end, 6) low, round(case when n = 1000 then r[975] end, 6) high from o join q using (metric)""",
    "usage_attempts": """with x as (select user_id || ' ' || strftime(ts, '%Y-%m-%d') attempt, case event_type when 'purchase' then 'finished' when 'view' then 'started' end ev, ts from events),
      g as (select attempt, count(case when ev = 'started' then 1 end) s, count(case when ev = 'finished' then 1 end) e, min(case when ev = 'started' then ts end) started, max(case when ev = 'finished' then ts end) finished from x group by attempt)
      select attempt, 'day' kind, case when s > 1 or e > 1 then 'conflict' when s = 0 then 'orphan_end' when e = 0 then 'interrupted_unknown' else 'finished' end status, started, finished from g""",
    "source_generation": f"""with {_CUR}, d as (select distinct sha256(coalesce(file, '') || chr(0) || coalesce(lower(hash), '-')) h from cur),
      t as (select count(*) k, sum(('0x' || h[1:14])::bigint) a, sum(('0x' || h[15:28])::bigint) b, sum(('0x' || h[29:42])::bigint) c, sum(('0x' || h[43:56])::bigint) e from d)
      select k n_files, sha256(concat_ws('|', k, a, b, c, e))[1:20] generation from t""",
    "source_snippets": f"{_SNIPPETS} select * from sn",
    "source_merged": f"""{_SNIPPETS}, l as (select file, start_line, unnest(range(len(string_split(text, chr(10))))) k, unnest(string_split(text, chr(10))) body from sn),
      o as (select file, start_line + k line, min(body) body, max(body) other, count(case when k = 0 then 1 end) begun from l group by all), g as (select *, line - row_number() over (partition by file order by line) island from o)
      select file, min(line) start_line, max(line) end_line, cast(sum(begun) as bigint) n_windows, bool_or(body <> other) conflict, string_agg(body, chr(10) order by line) as text from g group by file, island""",
    "source_freshness": """with c as (select file, lower(hash) hash from (select file, hash, row_number() over (partition by file order by indexed_at desc nulls last, lower(hash) desc nulls last) rn from files where file is not null) where rn = 1),
      t as (select file, max(sha256(text)) digest from sources where file is not null and text is not null group by file)
      select file, case when digest is null then 'missing' when digest = hash then 'same' else 'stale' end state from c left join t using (file)""",
    "graph_file_filters": f"""with p as (select unnest({PREFIXES!r}) prefix), f as (select distinct file from files where file is not null), x as (select prefix, file, unnest(range(2, length(file) + 1)) i from p, f where contains(file, prefix)),
      c as (select distinct prefix, file[1:i - 1 + length(prefix)] longer from x where file[i - 1] = '/' and starts_with(file[i:], prefix)), g as (select prefix, count(*) k, min(longer) longer from c group by prefix)
      select prefix, exists(select 1 from f where starts_with(file, prefix)) as valid, case when not exists(select 1 from f where starts_with(file, prefix)) and k = 1 then longer end suggestion from p left join g using (prefix)""",
    "graph_compact": f"""with {_N} select id, '{{' || array_to_string(list_filter(['"id":' || to_json(id)::varchar, '"kind":' || to_json(kind)::varchar, '"name":' || to_json(name)::varchar, '"file":' || to_json(file)::varchar, '"line":' || line,
      case when len(tags) > 0 then '"tags":' || to_json(tags)::varchar end, case when synthetic then '"synthetic":true' end], lambda x: x is not null), ',') || '}}' as row from n""",
    "graph_inspect": f"""with recursive {_N}, {_E}, st as (select distinct target a, source b from e where kind in ('extends', 'implements', 'with', 'overrides') and source is not null and target is not null),
      r as (select id as start, id, 0 d from n union select r.start, st.b, r.d + 1 from r join st on st.a = r.id where r.d < 40), h as (select start id, count(distinct id) k from r where start <> id and id in (select id from n) group by start),
      c as (select target id, count(*) k from e where kind = 'calls' and source in (select id from n) and target in (select id from n) group by target)
      select id, coalesce(c.k, 0) callers, greatest(coalesce(c.k, 0) - 20, 0) callers_omitted, coalesce(h.k, 0) implementations, greatest(coalesce(h.k, 0) - 20, 0) implementations_omitted from c full join h using (id)""",
    "graph_neighbour_rows": f"with {_N}, {_E} {_rel('true', 'source', 'target', 'out')} union all {_rel('true', 'target', 'source', 'in')}",
    "lexical_postings": f"""with {_N}, q as (select id, unnest({_terms('qualified')}) term from n where kind not in ('file', 'external')), r as (select *, row_number() over (partition by term order by id) k, count(*) over (partition by term) df from q)
      select term, df, string_agg(id, ' ' order by k) first_ids from r where k <= 20 group by term, df""",
    "lexical_expanded": f"""{_scored(['switch', 'total', 'default'])}, tp as (select * from sc order by score desc, file, line limit 50), a as (select distinct anchor from tp where anchor is not null),
      x as (select e.* from e join a on a.anchor = e.source where e.kind in ('calls', 'references', 'overrides') order by a.anchor, list_position(['calls', 'references', 'overrides'], e.kind), concat_ws('|', source, target, kind, file, start_offset) limit 40)
      select distinct source, target, kind, file, line, start_offset from x""",
    "lexical_grouped": f"""{_scored(['switch', 'total', 'default'])}, g as (select *, coalesce(anchor, file || '::file') grp from sc), r as (select *, row_number() over (partition by grp order by score desc, file, line) k, count(*) over (partition by grp) c from g),
      m as (select grp, string_agg(line::varchar, ' ' order by k) ml from r where k <= 3 group by grp) select file, line, anchor, round(score, 6) score, matched, c match_count, ml match_lines from r join m using (grp) where k = 1 order by r.score desc, file, line limit 50""",
    "lexical_filtered": f"{_scored(['switch', 'total', 'return'], scope='file like $$%.go$$')} select file, line, anchor, round(score, 6) score, matched from sc where anchor in (select id from n where kind = 'method') order by sc.score desc, file, line limit 50",
    "diff_correspondence": f"""with {_V}, x as (select snapshot_no, file, e.source, e.target, e.kind, coalesce(e.confidence, 'resolved') confidence, e.line, e.start_offset from (select snapshot_no, file, unnest(edges) e from v) where e is not null),
      pr as (select coalesce(b.snapshot_no, a.snapshot_no + 1) sn, coalesce(b.file, a.file) file, a.file is not null there, b.file is not null here, a.file is null or b.file is null or lower(a.hash) is distinct from lower(b.hash) mv
        from v b full join v a on a.file = b.file and a.snapshot_no = b.snapshot_no - 1 where coalesce(b.snapshot_no, a.snapshot_no + 1) between 2 and 5),
      o as (select pr.sn, pr.here, pr.mv, x.* from x join pr on pr.sn = x.snapshot_no + 1 and pr.file = x.file), nw as (select pr.sn, pr.mv, x.* from x join pr on pr.sn = x.snapshot_no and pr.file = x.file),
      oc as (select sn, file, source, target, kind, confidence, line, start_offset, any_value(mv) mv, any_value(here) here, count(*) m from o group by all), nc as (select sn, file, source, target, kind, confidence, line, start_offset, count(*) k from nw group by all),
      j as (select coalesce(oc.sn, nc.sn) sn, coalesce(oc.file, nc.file) file, coalesce(m, 0) m, coalesce(k, 0) k, coalesce(oc.mv, true) mv, oc.here from oc full join nc on oc.sn = nc.sn and oc.file = nc.file and oc.source is not distinct from nc.source and oc.target is not distinct from nc.target
        and oc.kind is not distinct from nc.kind and oc.confidence = nc.confidence and oc.line is not distinct from nc.line and oc.start_offset is not distinct from nc.start_offset),
      f as (select sn, file, sum(case when mv then 0 else least(m, k) end) unchanged, 0 relocated, sum(case when mv and here then m else 0 end) uncertain, sum(case when mv and here then 0 when mv then m else m - least(m, k) end) removed, sum(case when mv then k else k - least(m, k) end) added from j group by all),
      s as (select sn, file, source, target, kind, confidence, sum(w) w from (select sn, file, source, target, kind, confidence, -1 w from o union all select sn, file, source, target, kind, confidence, 1 from nw) group by all),
      t as (select sn, file, sum(greatest(-w, 0)) rm, sum(greatest(w, 0)) ad from s group by all)
      select cast(sn as int) snapshot_no, file, unchanged::bigint unchanged, relocated::bigint relocated, uncertain::bigint uncertain, removed::bigint removed, added::bigint added, rm::bigint removed_multiplicity, ad::bigint added_multiplicity from f join t using (sn, file)""",
    "closure_path_to": f"""with recursive {_N}, {_E}, u as (select *, concat_ws('|', source, target, kind, file, start_offset) k from e where kind in ('calls', 'overrides') and source is not null and target is not null),
      y as (select source a, target nx, 0 way, * from u union all select target, source, 1, * from u where kind = 'overrides'),
      ww as (select *, row_number() over (partition by a, nx order by way, kind, k) rn from y), w as (select * from ww where rn = 1),
      q0 as (select id as start, id, 0 pos, null::varchar via, null::varchar source, null::varchar target, null::varchar kind, null::varchar file, null::bigint start_offset from n
        where kind not in ('file', 'external') and regexp_matches(file, '(^|/)(tests?|integration_test|__tests__)/|_test\\.|\\.test\\.|\\.spec\\.|Test\\.(java|kt)$')),
      {_STEPS},
      al as (select 1 step, * from q1 union all select 2, * from q2 union all select 3, * from q3),
      bk as (select al.start, al.id destination, al.step, al.via, al.source, al.target, al.kind, al.file, al.start_offset from al where step > 1
        union all select bk.start, bk.destination, al.step, al.via, al.source, al.target, al.kind, al.file, al.start_offset from bk join al on al.start = bk.start and al.id = bk.via and al.step = bk.step - 1)
      select start, destination, step, source, target, kind, file, start_offset from bk""",
    "closure_paths": f"""{_impact(6)}, p as (select id, distance, id path from im where distance = 0 union all select im.id, im.distance, p.path || ' ' || im.id from p join im on im.via = p.id and im.distance = p.distance + 1) select id, distance, path from p""",
    "closure_depth": f"""{_impact(3)} select 2 depth, count(case when distance between 1 and 2 then 1 end) n_reached, (select count(distinct coalesce(file, '')) from im join n using (id) where distance between 1 and 2) n_files,
      count(case when distance > 2 then 1 end) > 0 depth_limited from im""",
    "closure_impact_files": f"{_impact(6)} select file, min(distance) distance, count(*) n_nodes from im join n using (id) where distance > 0 group by file",
    "graph_nodes": f"with {_N} select * replace (array_to_string(tags, ',') as tags) from n",
    "graph_edges": f"with {_E} select * from e",
    "graph_dangling": f"with {_N} select edges.kind, count(*) n_edges, count(*) - count(case when a.id is not null and b.id is not null then 1 end) n_dropped from edges left join n a on a.id = source left join n b on b.id = target group by edges.kind",
    "graph_unreferenced": f"with {_N} select id, kind from n where id not in (select source from edges where source is not null) and id not in (select target from edges where target is not null)",
    "graph_callers": f"with {_N}, {_E} {_rel("e.kind = 'calls'", 'target', 'source', 'in')}",
    "graph_callees": f"with {_N}, {_E} {_rel("e.kind = 'calls'", 'source', 'target', 'out')}",
    "graph_references": f"with {_N}, {_E} {_rel("e.kind = 'references'", 'target', 'source', 'in')}",
    "graph_neighbours": f"with {_E}, x as (select source id, kind, 1 o, 0 i from e union all select target, kind, 0, 1 from e) select id, kind, cast(sum(o) as bigint) n_out, cast(sum(i) as bigint) n_in from x where id is not null group by id, kind",
    "graph_dependencies": f"""with {_N}, {_E}, c as (select a.file sf, b.file tf, e.kind, count(*) k from e join n a on a.id = e.source join n b on b.id = e.target where e.kind <> 'contains' and a.file <> b.file group by all)
      select sf file, tf other_file, kind, 'out' direction, k n_edges from c union all select tf, sf, kind, 'in', k from c""",
    "graph_search": f"""with {_N} select id, kind, name, file, line, case when lower(name) = 'store' then 0 when starts_with(lower(name), 'store') then 1 else 2 end rank
      from n where kind not in ('external', 'file') and (contains(lower(name), 'store') or contains(lower(qualified), 'store'))""",
    "graph_search_page": f"""with {_N} select id, kind, name, file, line, case when lower(name) = 'e' then 0 when starts_with(lower(name), 'e') then 1 else 2 end rank
      from n where kind = 'struct' and {_LANG} = 'go' and (contains(lower(name), 'e') or contains(lower(qualified), 'e')) order by rank, id limit 20 offset 2""",
    "graph_resolve": f"""with {_N}, t as (select distinct split_part(list_last(string_split(target, '::')), '#', 1) target from edges where target is not null),
      k as (select id, 0 tier, id as key from n union all select id, 1, file from n where kind = 'file' union all select id, 2, qualified from n union all select id, 3, name from n),
      g as (select key, tier, count(distinct id) c, min(id) id from k where key is not null group by key, tier),
      b as (select target, tier, c, id, row_number() over (partition by target order by tier) rn from t left join g on g.key = t.target)
      select target, tier, coalesce(c, 0) n_matches, case when c = 1 then id end id from b where rn = 1""",
    "graph_innermost": f"""with {_N}, s as (select distinct edge_id, file, line from edges), m as (select edge_id, n.id, row_number() over (partition by edge_id order by n.end_line - n.line, n.id) rn
      from s join n on n.file = s.file and s.line between n.line and n.end_line where n.kind <> 'file') select edge_id, id node_id from m where rn = 1""",
    "graph_homonyms": f"with {_N} select name, kind, count(*) n_nodes, count(distinct coalesce(file, '')) n_files from n where kind not in ('file', 'external') group by name, kind having count(*) > 1",
    "graph_derived_overrides": f"""with recursive {_N}, {_E}, h as (select source, target from e where kind in ('extends', 'implements', 'with') and source is not null and target is not null union select h.source, e.target from h join e on e.source = h.target where e.kind in ('extends', 'implements', 'with') and e.target is not null),
      m as (select * from n where kind in ('method', 'getter', 'setter', 'field') and parent is not null)
      select a.id member, b.id base_member, h.source "class", h.target base from h join m a on a.parent = h.source join m b on b.parent = h.target where a.name = b.name and h.source <> h.target""",
    "graph_architecture": f"""with {_N}, {_E}, {_CUR}, own as (select * from n where kind not in ('file', 'external')),
      x as (select 'languages' section, {_LANG} as key from cur union all select 'kinds', kind from own union all select 'tags', unnest(tags) from own
        union all select 'directories', case when len(string_split(file, '/')) < 3 then '.' else array_to_string(string_split(file, '/')[2:least(3, len(string_split(file, '/')) - 1)], '/') end from own
        union all select 'relations', kind from e union all select 'confidences', confidence from e
        union all select 'severities', coalesce(json_extract_string(d, '$.severity'), 'error') from (select unnest(diagnostics) d from cur) where starts_with(d, '{{') and ends_with(d, '}}') and json_valid(d))
      select section, key, count(*) n from x group by all""",
    "graph_hubs": f"with {_N}, {_E}, g as (select target, count(*) n_in from e group by target) select n.id, n.kind, n_in from n join g on g.target = n.id order by n_in desc, n.id limit 20",
    "graph_ranked_callers": f"""with {_N}, {_E}, c as (select target, source, count(*) n from e where kind = 'calls' and source in (select id from n) group by all),
      r as (select *, row_number() over (partition by target order by n desc, source) place from c) select target, source, n, cast(place as int) place from r where place <= 3""",
    "closure_implementations": f"""with recursive {_N}, {_E}, st as (select distinct target a, source b from e where kind in ('extends', 'implements', 'with', 'overrides') and source is not null and target is not null),
      r as (select id as start, id, 0 d from n where kind not in ('file', 'external') union select r.start, st.b, r.d + 1 from r join st on st.a = r.id where r.d < 40)
      select start, id, cast(min(d) as int) distance from r group by start, id having min(d) > 0""",
    "graph_health": f"""with {_N}, {_E}, fx as (select file, unresolved_calls, diagnostics, row_number() over (partition by file order by indexed_at desc nulls last) rn from files where file is not null),
      a as (select split_part(file, '/', 1) repo, count(*) n_files, cast(coalesce(sum(unresolved_calls), 0) as bigint) n_unresolved, cast(sum(coalesce(len(diagnostics), 0)) as bigint) n_diagnostics from fx where rn = 1 group by 1),
      b as (select split_part(file, '/', 1) repo, count(*) k from n where kind not in ('file', 'external') group by 1), c as (select split_part(file, '/', 1) repo, count(*) k from e group by 1)
      select a.repo, n_files, coalesce(b.k, 0) n_symbols, coalesce(c.k, 0) n_edges, n_unresolved, n_diagnostics from a left join b using (repo) left join c using (repo)""",
    "graph_redelivered": """with v as (select edge_id, source, target, kind, file, line, start_offset, confidence, indexed_at, received_at, count(*) n from edges group by all)
      select edge_id, cast(sum(n) as bigint) copies, count(*) versions from v group by edge_id having sum(n) > 1""",
    "graph_multiset": "select source, target, kind, file, start_offset, 'a' side, count(*) - 1 left_over from edges group by all having count(*) > 1",
    "closure_contracts": f"with recursive {_CONTEXT} select start, id, d distance from ln where d > 0",
    "closure_flow": f"""with recursive {_N}, {_E}, st as (select source a, target b from e where kind in ('calls', 'overrides') and source is not null and target is not null union select target, source from e where kind = 'overrides' and source is not null and target is not null),
      r as (select distinct id as start, id, 0 d from n where kind not in ('file', 'external') union select r.start, st.b, r.d + 1 from r join st on st.a = r.id where r.d < 3)
      select start, id, cast(min(d) as int) distance from r group by start, id having min(d) > 0""",
    "closure_tests": f"""with recursive {_N}, {_E}, st as (select distinct target a, source b from e where kind in ('references', 'calls', 'overrides') and source is not null and target is not null),
      r as (select id as start, id, 0 d from n where kind not in ('file', 'external') union select r.start, st.b, r.d + 1 from r join st on st.a = r.id where r.d < 2),
      m as (select start, id, cast(min(d) as int) distance from r group by start, id having min(d) > 0)
      select m.start, m.id, n.file, m.distance from m join n on n.id = m.id where regexp_matches(n.file, '(^|/)(tests?|integration_test|__tests__)/|_test\\.|\\.test\\.|\\.spec\\.|Test\\.(java|kt)$')""",
    "stream_sliding": """with x as (select event_type, date_trunc('day', ts) as day from events), y as (select event_type, day started from x union all select event_type, day - interval 1 day from x),
      z as (select event_type, started, count(*) n from y group by all) select event_type, started, n from z""",
    "closure_impact": f"{_impact(6)} select * from im",
    "diff_files": f"with {_V}, {_FC} select cast(snapshot_no as int) snapshot_no, file, change from fc",
    "closure_affected_files": f"""with recursive {_V}, {_CUR}, {_FC}, dep as (select distinct file, unnest(dependencies) target from cur),
      r as (select distinct file, 0 k from fc union select dep.file, r.k + 1 from r join dep on dep.target = r.file where r.k < 60) select file, cast(min(k) as int) round from r group by file""",
    "diff_declarations": f"""with {_V}, x as (select snapshot_no, file, unnest(nodes) n from v), y as (select snapshot_no, file, n.id id, min(n) body from x where n.id is not null group by all),
      c as (select b.snapshot_no, b.file, b.id, case when a.id is null then 'added' else 'changed' end change from y b left join y a on a.file = b.file and a.id = b.id and a.snapshot_no = b.snapshot_no - 1 where a.id is null or a.body is distinct from b.body
        union all select a.snapshot_no + 1, a.file, a.id, 'removed' from y a left join y b on a.file = b.file and a.id = b.id and b.snapshot_no = a.snapshot_no + 1 where b.id is null)
      select cast(snapshot_no as int) snapshot_no, file, id, change from c where exists (select 1 from v where v.file = c.file and v.snapshot_no = c.snapshot_no) and exists (select 1 from v where v.file = c.file and v.snapshot_no = c.snapshot_no - 1)""",
    "diff_relations": f"""with {_V}, x as (select distinct snapshot_no, file, e.source, e.target, e.kind, e.line, e.start_offset, coalesce(e.confidence, 'resolved') confidence from (select snapshot_no, file, unnest(edges) e from v)),
      w as (select snapshot_no, source, target, kind, confidence, 1 w from x union all select snapshot_no + 1, source, target, kind, confidence, -1 from x),
      g as (select snapshot_no, source, target, kind, confidence, cast(sum(w) as bigint) net from w where snapshot_no between 2 and 5 group by all)
      select cast(snapshot_no as int) snapshot_no, source, target, kind, confidence, greatest(-net, 0) removed, greatest(net, 0) added from g where net <> 0""",
    "diff_diagnostics": """with f as (select file, indexed_at, max(diagnostics) d from files where file is not null and indexed_at is not null group by all),
      t as (select file, d, row_number() over w rn, lead(d) over w old, lead(indexed_at) over w bef from f window w as (partition by file order by indexed_at desc)), u as (select * from t where rn = 1 and bef is not null)
      select distinct file, unnest(list_filter(coalesce(d, []), lambda x: not list_contains(coalesce(old, []), x))) diagnostic, 'new' change from u
      union all select distinct file, unnest(list_filter(coalesce(old, []), lambda x: not list_contains(coalesce(d, []), x))), 'resolved' from u""",
    "diff_preceding": f"""with {_N}, s as (select distinct edge_id, file, start_offset from edges where start_offset is not null), m as (select edge_id, n.id, row_number() over (partition by edge_id order by n.start_offset desc, n.id desc) rn
      from s join n on n.file = s.file and n.start_offset <= s.start_offset where n.kind <> 'file') select edge_id, id node_id from m where rn = 1""",
    "lexical_frequencies": f"with {_N}, {_DOCS} select t term, count(*) df from (select unnest(terms) t from doc) group by t",
    "lexical_bm25": f"{_scored(['switch', 'total', 'default'])} {_TOP}",
    "lexical_overlap": f"{_scored(['hashmap', 'record', 'string', 'hash', 'map'], 'overlap')} {_TOP}",
    "lexical_per_file": f"""with {_N}, {_DOCS}, h as (select file, line, len(list_intersect(terms, ['switch', 'total', 'default'])) m from doc), r as (select *, row_number() over (partition by file order by m desc, line) rn, count(*) over (partition by file) c from h where m > 0)
      select file, line, cast(m as int) matched, c n_matches from r where rn = 1""",
    **{f"evidence_{name}": f"{_evidence(name)} select * from fq" for name in INTENTS},
    "evidence_sections": f"{_RM}, u as (select distinct start, source, target, kind, file, line, start_offset, confidence, unnest(list_concat([section], string_split(also_sections, ','))) section from fq) select start, section, count(*) n, count(distinct coalesce(file, '')) n_files from u where section <> '' group by all",
    "evidence_page": f"""{_RM}, o as (select * exclude (evidence_id), row_number() over (partition by start order by case section when 'declarations' then 0 when 'contracts' then 1 when 'contract' then 1 when 'usages' then 2 when 'callers' then 2 when 'composition' then 2 when 'flow' then 3
        when 'tests' then 4 when 'test_candidates' then 8 when 'module_context' then 9 else 5 end, distance, file, line, start_offset, concat_ws('|', source, target, kind, file, start_offset)) position from fq),
      p as (select *, row_number() over (partition by start, file order by position) k from o where position <= 40), q as (select *, sum(case when k = 1 then 1 else 0 end) over (partition by start order by position) files from p)
      select * exclude (k, files) replace (cast(position as int) as position) from q where files <= 12""",
    "evidence_files": f"{_RM}, u as (select file, count(*) n from fq where file is not null group by file) select file as value, row_number() over (order by file) - 1 code, n from u",
    "evidence_groups": f"""{_RM}, u as (select distinct start, target, kind, confidence, section, file, line, start_offset from fq)
      select start, target, kind, confidence, section, file, string_agg(concat_ws(':', line, start_offset), ' ' order by line nulls first, start_offset nulls first) sites from u group by all""",
    "evidence_windows": f"""{_RM}, g as (select distinct file, greatest(line - 2, 1) a, line + 2 b from fq where line is not null and file is not null),
      m as (select *, case when max(b) over x is null or a > max(b) over x + 1 then 1 else 0 end nw from g window x as (partition by file order by a, b rows between unbounded preceding and 1 preceding)),
      i as (select *, sum(nw) over (partition by file order by a, b) k from m) select file, min(a) start_line, max(b) end_line, count(*) n_windows from i group by file, k""",
    "usage_deltas": """with l as (select user_id, event_id, ts, value, lag(value) over (partition by user_id order by ts, event_id) old from events),
      r as (select *, old is null or value < old rs from l), g as (select *, sum(case when rs then 1 else 0 end) over (partition by user_id order by ts, event_id) segment from r)
      select user_id, event_id, cast(segment as bigint) segment, round(case when rs then value else value - old end, 4) delta from g where rs or value - old <> 0""",
    "usage_sums": """with x as (select user_id, event_type, event_id, max(case when event_id % 97 <> 0 then value end) v from events group by all)
      select user_id, event_type, count(*) n, round(case when count(v) = count(*) then sum(v) end, 4) total from x group by all""",
    "usage_conflicts": """with x as (select event_id, ts, user_id, event_type, value, props from events union all select event_id // 2, ts, user_id, event_type, value, props from events),
      y as (select distinct * from x) select event_id, count(*) n_versions from y group by event_id having count(*) > 1""",
    "usage_campaign": """with m as (select event_type, avg(value) mean from events group by 1), c as (select event_type, user_id, count(*) n, sum(value) total, arg_max(value, {'a': ts, 'b': event_id}) l from events group by 1, 2),
      k as (select c.*, case when l > mean then 1 else 0 end ok from c join m using (event_type))
      select event_type, user_id, cast(grouping(event_type, user_id) as int) "level", cast(sum(n) as bigint) n, cast(sum(ok) as bigint) accepted, round(sum(ok) / count(*), 6) rate, round(case when sum(ok) > 0 then sum(total) / sum(ok) end, 4) per_accepted from k group by cube (event_type, user_id)""",
    "usage_ledger": """with x as (select event_type, row_number() over (partition by user_id, event_type order by ts, event_id) a, row_number() over (partition by user_id, event_type, date_trunc('day', ts) order by ts, event_id) b from events)
      select event_type, case when a = 1 then 'new' when b = 1 then 'rehydrated' else 'repeated' end status, count(*) n from x group by all""",
    "usage_read_audit": """with x as (select event_type, cast(floor(value / 10) as bigint) lv, last_value(case when event_type = 'purchase' then cast(floor(value / 10) as bigint) end ignore nulls)
        over (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding) wr from events)
      select case when wr is null then 'unknown' when wr = lv then 'same' else 'changed' end verdict, count(*) n from x where event_type <> 'purchase' group by 1""",
    "usage_percentiles": """with x as (select event_type, value, row_number() over (partition by event_type order by value) - 1 p, count(*) over (partition by event_type) n from events where value is not null)
      select event_type, max(n) n, max(case when p = n // 2 then value end) median, max(case when p = n * 95 // 100 then value end) p95 from x group by 1""",
    "source_hashes": """with x as (select file, m[1] t, m[2] h from (select file, arg_max([text, sha256], coalesce(sha256(text), '') || coalesce(sha256, '')) m from sources where file is not null group by file))
      select split_part(file, '/', 1) repo, count(*) n_files, count(case when t is null then 1 end) n_missing, count(case when t is not null and sha256(t) = h then 1 end) n_same, count(case when t is not null and sha256(t) is distinct from h then 1 end) n_stale from x group by 1""",
    "source_violations": f"""with {_N}, tx as (select file, arg_max(text, sha256(text)) t from sources where file is not null and text is not null group by file),
      sx as (select file, len(string_split(t, chr(10))) lines, case when {_LANG} in ('dart', 'typescript', 'javascript', 'java') then length(t) + length(regexp_replace(t, '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g'))
        when {_LANG} = 'go' then octet_length(encode(t)) else length(t) end units from tx),
      o as (select * from n where kind <> 'external'), m as (select o.*, lines, units from o join sx using (file)),
      x as (select 'bad_span' rule from o where line < 1 or end_line < line or length < 0 union all select 'foreign_id' from o where not starts_with(id, file || '::')
        union all select 'bad_external' from n where kind = 'external' and (id <> 'uri::' || file or start_offset <> 0 or length <> 0 or line <> 0 or end_line <> 0)
        union all select 'beyond_text' from m where start_offset + length > units union all select 'beyond_lines' from m where end_line > lines
        union all select 'unresolved' from edges where confidence <> 'resolved' union all select 'bad_site' from edges where line < 1
        union all select 'repeated_edge' from (select edge_id from edges group by edge_id having count(*) > 1))
      select rule, count(*) n from x group by rule""",
    "source_record_nodes": flat_sql("nodes[]", ["id", "name", "kind", "line", "q", "parent"]).replace("select file, path, parent, ordinal,", "select file,").replace('"f_q"', "qualified").replace('"f_', '"'),
    "source_upsert": """with c as (select file, lower(hash) hash from (select *, row_number() over (partition by file order by received_at desc nulls last) rn from file_snapshots where snapshot_no = 5) where rn = 1)
      select file, hash from c""",
    "stream_windows": "select event_type, date_trunc('day', ts) as day, count(*) n, round(sum(value), 4) total from events group by all",
    "stream_sessions": """with x as (select *, case when lag(ts) over (partition by user_id order by ts) is null or ts >= lag(ts) over (partition by user_id order by ts) + interval 1 hour then 1 else 0 end nw from events),
      g as (select *, sum(nw) over (partition by user_id order by ts rows unbounded preceding) k from x) select user_id, min(ts) started, max(ts) + interval 1 hour ended, count(*) n from g group by user_id, k""",
    "stream_dedup": "select user_id, count(distinct event_id) n from events group by user_id",
    "stream_index": "select user_id, max(ts) as last_at, count(distinct event_id) n from events group by user_id",
}
