"""Queries of the general problems over their whole tables, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symweave.operators import hierarchy, nested, references, skew, snapshots
from symweave.session import table


def _all_nodes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nodes").unionByName(table(spark, d, "library_nodes"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return skew.heavy_keys(table(spark, d, "edges"), _all_nodes(spark, d)).select("target", "kind")


def p1_keys(spark: SparkSession, d: str) -> DataFrame:
    return skew.skewed_key_report(table(spark, d, "edges"), _all_nodes(spark, d)).drop("total_rows")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return snapshots.snapshot_changes(table(spark, d, "file_snapshots"))


def p3_rates(spark: SparkSession, d: str) -> DataFrame:
    return snapshots.change_rates(table(spark, d, "file_snapshots"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return nested.nested_objects(table(spark, d, "files")).select("file", "path")


def p4_tables(spark: SparkSession, d: str) -> DataFrame:
    return nested.table_sizes(nested.nested_objects(table(spark, d, "files")))


#: The flat tables that are registered as queries, with their place in a record and their fields.
FLAT = {
    "p4_nodes": ("nodes[]", ["id", "name", "kind", "line", "end", "parent"]),
    "p4_edges": ("edges[]", ["source", "target", "kind", "file", "line", "offset", "confidence"]),
    "p4_diagnostics": ("diagnostics[]", ["severity", "code", "message", "line"]),
    "p4_related": ("diagnostics[].related[]", ["file", "line", "message"]),
    "p4_bindings": ("intent.ast.bindings[]", list(nested.PACKED["bindings"])),
    "p4_uses": ("intent.ast.uses[]", list(nested.PACKED["uses"])),
    "p4_statements": ("intent.ast.statements[]", list(nested.PACKED["statements"])),
    "p4_controls": ("intent.ast.controls[]", list(nested.PACKED["controls"])),
    "p4_symbols": ("intent.symbols[]", ["id", "name", "kind", "file", "line"]),
    "p4_relations": ("intent.relations[]", ["source", "target", "kind", "file", "line", "offset"]),
    "p4_tests": ("intent.tests[]", ["file", "name", "framework", "line", "end"]),
}


#: The flat tables of objects that stand in no list.
SINGLE = {
    "p4_records": ("", ["file", "hash", "dependencies", "unresolvedCalls"]),
    "p4_intents": ("intent", ["capabilities"]),
    "p4_asts": ("intent.ast", ["format", "version", "offset_unit", "scopes"]),
}


def _flat(place: str, fields: list[str], listed: bool = True):
    find = nested.nested_objects if listed else nested.single_objects
    return lambda spark, d: nested.flat_table(find(table(spark, d, "files"), whole={place: fields}), place, fields)


def p4_single(spark: SparkSession, d: str) -> DataFrame:
    return nested.single_objects(table(spark, d, "files")).select("file", "path", "parent", "table")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.cycle_nodes(table(spark, d, "nodes"))


def p5_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.hierarchy(table(spark, d, "nodes")).withColumn("path", F.array_join("path", "/"))


def p5_descendants(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.descendants(table(spark, d, "nodes"))


def p5_all_descendants(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.all_descendants(table(spark, d, "nodes"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return references.orphan_references(table(spark, d, "edges"), table(spark, d, "nodes"), table(spark, d, "library_nodes")).select("edge_id", "side").distinct()


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    return references.orphan_report(table(spark, d, "edges"), table(spark, d, "nodes"), table(spark, d, "library_nodes"))


QUERIES = {
    "p1_found": p1_found, "p1_keys": p1_keys, "p3_found": p3_found, "p3_rates": p3_rates, "p4_found": p4_found, "p4_tables": p4_tables, **{k: _flat(*v) for k, v in FLAT.items()},
    "p4_single": p4_single, **{k: _flat(*v, listed=False) for k, v in SINGLE.items()},
    "p5_found": p5_found, "p5_hierarchy": p5_hierarchy, "p5_descendants": p5_descendants, "p5_all_descendants": p5_all_descendants, "p6_found": p6_found, "p6_report": p6_report,
}

_NODE = """best as (select id, max(struct_pack(a := removed_at is null, b := indexed_at, c := name, d := kind)) n
  from (select id, removed_at, indexed_at, name, kind from nodes union all select id, removed_at, indexed_at, name, kind from library_nodes) group by id)"""

_CHANGES = """v as (
  select snapshot_no, file, lower(hash) h, list_sort(list_distinct(list_filter(coalesce(nodes, []), lambda x: x is not null))) n,
    list_sort(list_distinct(list_transform(list_filter(coalesce(edges, []), lambda x: x is not null), lambda x:
      {'source': x.source, 'target': x.target, 'kind': x.kind, 'line': x.line, 'start_offset': x.start_offset, 'confidence': coalesce(x.confidence, 'resolved')}))) e,
    row_number() over (partition by snapshot_no, file order by received_at desc nulls last) rn
  from file_snapshots),
w as (select * from v where rn = 1),
c as (
  select b.snapshot_no, b.file, case when a.file is null then 'added' else 'changed' end change
  from w b left join w a on a.file = b.file and a.snapshot_no = b.snapshot_no - 1
  where b.snapshot_no > 1 and (a.file is null or a.h is distinct from b.h or a.n is distinct from b.n or a.e is distinct from b.e)
  union all
  select a.snapshot_no + 1, a.file, 'removed' from w a left join w b on a.file = b.file and b.snapshot_no = a.snapshot_no + 1
  where a.snapshot_no < 5 and b.file is null)"""

_TREE = """l as (select a.id, case when b.id is not null then a.parent end parent
  from (select id, max(parent) parent from nodes group by id) a left join (select distinct id from nodes) b on a.parent = b.id),
up as (select id, parent as above from l where parent is not null union select up.id, l.parent from up join l on up.above = l.id where l.parent is not null),
cyc as (select id from up where id = above),
t as (select id, parent, id root, 0 depth, id path from l where parent is null
  union all select l.id, l.parent, t.root, t.depth + 1, t.path || '/' || l.id from t join l on l.parent = t.id)"""

_ORPHANS = """n as (select id, indexed_at, removed_at from nodes union all select id, indexed_at, removed_at from library_nodes),
x as (select edge_id, indexed_at, 'source' side, source k from edges union all select edge_id, indexed_at, 'target', target from edges),
o as (select distinct edge_id, side, k, cast(date_trunc('month', indexed_at) as date) period from x
  where k is not null and not exists (select 1 from n where n.id = x.k and n.indexed_at <= x.indexed_at and (n.removed_at is null or n.removed_at > x.indexed_at)))"""

_LISTS = "'nodes','edges','diagnostics','related','fixes','edits','symbols','relations','tests','children','bindings','uses','statements','controls'"
RECORDS = f"""c0 as (select file, record from (select file, record, row_number() over (partition by file order by indexed_at desc nulls last, record desc nulls last) rn from files where file is not null) where rn = 1),
c1 as (select file, case when json_valid(record) and json_type(record) = 'VARCHAR' then record ->> '$' else record end record from c0),
c2 as (select file, case when json_valid(record) and json_type(record) = 'VARCHAR' then record ->> '$' else record end record from c1),
rec as (select file, record from c2 where json_valid(record) and json_type(record) in ('OBJECT', 'ARRAY')),
doc as (select file, '' prefix, record j from rec union all select file, 'intent', record ->> '$.intent' from rec where json_type(record, '$.intent') = 'VARCHAR' and json_valid(record ->> '$.intent')),
tree as (select file, prefix, t.id, t.parent up, t.key, t.type, t.value from doc, json_tree(doc.j) t),
good as (select file from tree group by file having count(case when type = 'DOUBLE' and value::varchar in ('NaN', 'Infinity', '-Infinity') then 1 end) = 0),
walk as (select file, prefix, id, prefix path, '' parent, prefix tab, 0 ordinal, false listed, type, value, '' as name, false packed, false as row_of from tree where up is null and file in (from good)
  union all select t.file, t.prefix, t.id,
    case when w.type = 'ARRAY' then w.path || '[' || t.key || ']' else case when w.path = '' then '' else w.path || '.' end || t.key || case when t.type = 'OBJECT' and t.key in ({_LISTS}) then '[0]' else '' end end,
    case when w.listed then w.path else w.parent end,
    case when w.type = 'ARRAY' then w.tab || '[]' else case when w.tab = '' then '' else w.tab || '.' end || t.key || case when t.type = 'OBJECT' and t.key in ({_LISTS}) then '[]' else '' end end,
    case when w.type = 'ARRAY' then t.key::int else 0 end,
    case when w.type = 'ARRAY' then t.type = 'OBJECT' or (t.type = 'ARRAY' and w.packed and json_array_length(t.value) = case w.name when 'bindings' then 9 when 'uses' then 8 else 6 end) else t.type = 'OBJECT' and t.key in ({_LISTS}) end,
    t.type, t.value, case when w.type = 'ARRAY' then w.name else t.key end,
    w.type = 'OBJECT' and t.type = 'ARRAY' and t.key in ('bindings', 'uses', 'statements', 'controls') and coalesce(w.value ->> '$.format' = 'pcg-ast-1', false),
    w.type = 'ARRAY' and w.packed and t.type = 'ARRAY'
  from walk w join tree t on t.file = w.file and t.prefix = w.prefix and t.up = w.id where not (w.row_of and w.listed)),
obj as (select file, path, parent, tab "table", ordinal, type, value, name, row_of from walk where listed)"""


SINGLE_RECORDS = f"""{RECORDS}, one as (select file, path, parent, tab "table", ordinal, value from walk where type = 'OBJECT' and not listed)"""


def single_sql(place: str, fields: list[str]) -> str:
    """The SQL of a flat table of objects that stand in no list."""
    names = ", ".join(f"""value ->> '$.{c}' "f_{c}\"""" for c in fields)
    return f"""with recursive {SINGLE_RECORDS} select file, path, parent, ordinal, {names} from one where "table" = '{place}'"""


def flat_sql(place: str, fields: list[str]) -> str:
    """The SQL of a flat table; a field of a packed row is found by its place."""
    packed = nested.PACKED.get(place.split(".")[-1].removesuffix("[]"), ())
    one = lambda c: f"case when row_of then value ->> '$[{packed.index(c)}]' else value ->> '$.{c}' end" if c in packed else f"value ->> '$.{c}'"
    return f"""with recursive {RECORDS} select file, path, parent, ordinal, {', '.join(f'{one(c)} "f_{c}"' for c in fields)} from obj where "table" = '{place}'"""


ORACLES = {
    "p4_found": f"with recursive {RECORDS} select file, path from obj",
    "p4_tables": f"""with recursive {RECORDS} select "table", count(*) n_rows, count(distinct file) n_files, count(case when parent <> '' then 1 end) n_linked from obj group by "table\"""",
    **{k: flat_sql(*v) for k, v in FLAT.items()},
    "p4_single": f"""with recursive {SINGLE_RECORDS} select file, path, parent, "table" from one""",
    **{k: single_sql(*v) for k, v in SINGLE.items()},
    "p1_found": "select target, kind from edges where target is not null group by target, kind having count(*) >= 0.01 * (select count(*) from edges)",
    "p1_keys": f"""with {_NODE}, k as (select target, kind, count(*) n_rows, count(distinct source) n_source, count(distinct file) n_file from edges group by target, kind)
      select k.*, best.n.c node_name, best.n.d node_kind from k left join best on best.id = k.target""",
    "p3_found": f"with {_CHANGES} select cast(snapshot_no as int) snapshot_no, file, change from c",
    "p3_rates": f"with {_CHANGES} select cast(snapshot_no as int) snapshot_no, change, count(*) n_files from c group by all",
    "p5_found": f"with recursive {_TREE} select id node_id from cyc",
    "p5_hierarchy": f"""with recursive {_TREE}, d as (select above, count(*) n from up group by above),
      hb as (select id root0, id, 0 k from l where id not in (select id from cyc) and id not in (select id from t)
        union all select hb.root0, l.id, hb.k + 1 from hb join l on l.parent = hb.id)
      select l.id node_id, l.parent, t.root, t.depth, t.path, case when cyc.id is null then coalesce(d.n, 0) end n_descendants,
        case when cyc.id is not null then null when t.id is not null then coalesce((select max(x.depth) - t.depth from up u join t x on x.id = u.id where u.above = l.id), 0)
          else (select max(k) from hb where root0 = l.id) end height,
        case when t.id is not null then 'tree' when cyc.id is not null then 'cycle' else 'below_cycle' end status
      from l left join t on t.id = l.id left join d on d.above = l.id left join cyc on cyc.id = l.id""",
    "p5_descendants": f"""with recursive {_TREE} select u.above ancestor, u.id descendant, b.depth - a.depth distance
      from up u join t a on a.id = u.above join t b on b.id = u.id""",
    "p5_all_descendants": """with recursive l as (select a.id, case when b.id is not null then a.parent end parent from (select id, max(parent) parent from nodes where id is not null group by id) a left join (select distinct id from nodes) b on a.parent = b.id),
      up as (select id, parent as above, 1 d, [parent] seen from l where parent is not null and parent <> id union all
        select up.id, l.parent, up.d + 1, list_append(up.seen, l.parent) from up join l on l.id = up.above where l.parent is not null and l.parent <> up.id and not list_contains(up.seen, l.parent))
      select above ancestor, id descendant, d distance from up""",
    "p6_found": f"with {_ORPHANS} select edge_id, side from o",
    "p6_report": f"with {_ORPHANS} select side, period, count(*) n_orphans, count(distinct k) n_keys from o group by all",
}
