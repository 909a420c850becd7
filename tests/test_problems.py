"""The general problems against brute force on small tables, with nulls, ties, repeated rows, empty tables and extra columns."""

import json
import random
from collections import Counter, defaultdict
from datetime import datetime as T

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from symweave.operators import hierarchy, nested, references, skew, snapshots

EDGES = "edge_id long, source string, target string, kind string, file string, indexed_at timestamp_ntz, id string, _key string, n long"
NODES = "id string, name string, kind string, parent string, indexed_at timestamp_ntz, removed_at timestamp_ntz, key string, born string"
A, B, C = T(2025, 1, 1), T(2025, 2, 1), T(2025, 3, 1)


def edges(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", 1) for r in rows], EDGES)


def nodes(spark, rows):
    return spark.createDataFrame([(*r, "k", "b") for r in rows], NODES)


def test_pack_balances_and_splits_large_keys():
    placed, loads = skew.pack([("hot", 600), *[(i, 4) for i in range(100)]], 10)
    assert len(placed["hot"]) == 6 and all(len(placed[i]) == 1 for i in range(100))
    assert max(loads.values()) <= 1.2 * sum(loads.values()) / 10


def test_skewed_report_equals_brute_force(spark):
    rng = random.Random(1)
    rows = []
    for i in range(3000):
        hot = rng.random() < 0.5
        rows.append((i, rng.choice([None, *[f"s{k}" for k in range(400)]]), "hot" if hot else rng.choice([None, *[f"t{k}" for k in range(300)]]), rng.choice(["calls", None, "uses"]), rng.choice([None, "f1", "f2", "f3"]), A))
    rows += rows[:50]
    side = nodes(spark, [("hot", "a", "class", None, A, B), ("hot", "b", "class", None, A, None), ("hot", "c", "class", None, C, C), ("t1", None, None, None, None, None), (None, "z", "z", None, A, None)])
    found = {(r.target, r.kind): r for r in skew.skewed_key_report(edges(spark, rows), side, tasks=8).collect()}
    want = defaultdict(list)
    for r in rows:
        want[r[2], r[3]].append(r)
    assert set(found) == set(want)
    for k, group in want.items():
        r = found[k]
        assert (r.n_rows, r.n_source, r.n_file) == (len(group), len({g[1] for g in group} - {None}), len({g[4] for g in group} - {None}))
        assert r.node_name == ("b" if k[0] == "hot" else None) and r.total_rows == len(rows)
    heavy = {(r.target, r.kind) for r in skew.heavy_keys(edges(spark, rows), tasks=8).collect()}
    assert heavy == {k for k, g in want.items() if k[0] is not None and len(g) >= 0.01 * len(rows)}


def test_skewed_report_of_nothing(spark):
    assert skew.skewed_key_report(edges(spark, []), nodes(spark, [])).count() == 0
    assert skew.heavy_keys(edges(spark, [])).count() == 0


SNAP = "snapshot_no int, file string, hash string, nodes array<struct<id:string,name:string>>, edges array<struct<source:string,line:long,confidence:string>>, received_at timestamp_ntz, digest string, row string"


def snap(spark, rows):
    return spark.createDataFrame([(*r, "d", "r") for r in rows], SNAP)


def test_snapshot_changes(spark):
    n1, n2 = [("a", "x"), ("b", None)], [("b", None), ("a", "x"), ("a", "x")]
    rows = [
        (1, "same", "AB", n1, None, A), (2, "same", "ab", n2, [], A), (3, "same", "ab", n1, None, B), (3, "same", "old", n1, None, A),
        (1, "gap", "h", None, None, A), (3, "gap", "h", None, None, A),
        (1, "conf", "h", None, [("s", 1, None)], A), (2, "conf", "h", None, [("s", 1, "resolved")], A), (3, "conf", "h", None, [("s", 2, "resolved")], A),
        (1, "null", None, None, None, None), (2, "null", None, None, None, None), (3, "null", "h", None, None, None),
        (2, "new", "h", None, None, A), (2, "new", "h", None, None, A), (None, "x", "h", None, None, A), (2, None, "h", None, None, A),
    ]
    found = {tuple(r) for r in snapshots.snapshot_changes(snap(spark, rows)).collect()}
    assert found == {(2, "gap", "removed"), (3, "gap", "added"), (3, "conf", "changed"), (3, "null", "changed"), (2, "new", "added"), (3, "new", "removed")}
    assert snapshots.snapshot_changes(snap(spark, [])).count() == 0


def test_orphans(spark):
    known = nodes(spark, [("a", "a", "c", None, A, C), ("a", "a", "c", None, A, C), ("b", "b", "c", None, B, None), (None, "q", "q", None, A, None), ("late", "l", "c", None, None, None)])
    rows = [(1, "a", "b", "k", "f", A), (2, "a", "b", "k", "f", B), (2, "a", "b", "k", "f", B), (3, "a", "A", "k", "f", C), (4, None, "late", "k", "f", C), (5, "b", "b", "k", "f", None)]
    want = {(1, "target"), (3, "source"), (3, "target"), (4, "target"), (5, "source"), (5, "target")}
    for share in (1, 3, 200):
        found = [(r.edge_id, r.side) for r in references.orphan_references(edges(spark, rows), known, tasks=share).collect()]
        assert set(found) == want and len(found) == len(want)
    assert references.orphan_references(edges(spark, []), known).count() == 0
    assert references.orphan_references(edges(spark, rows), nodes(spark, [])).count() == 9
    report = {(r.side, str(r.period)): (r.n_orphans, r.n_keys) for r in references.orphan_report(edges(spark, rows), known).collect()}
    assert report[("target", "2025-01-01")] == (1, 1) and report[("target", "2025-03-01")] == (2, 2)


@pytest.mark.parametrize("most", [0, 1, 20_000])
def test_orphans_by_brute_force_with_hot_keys(spark, monkeypatch, most):
    monkeypatch.setattr(references, "BROADCAST_ROWS", most)
    rng = random.Random(5)
    days = [T(2025, m, d) for m in (1, 2, 3) for d in (1, 2, 15, 28)]
    life = [(k, "n", "c", None, rng.choice([*days, None]), rng.choice([None, None, *days])) for k in ["hot", "hot", "warm", *[f"k{i}" for i in range(30)]]]
    rows = [(i % 900, rng.choice(["hot", "hot", "warm", None, f"k{rng.randrange(40)}"]), rng.choice(["hot", f"k{rng.randrange(40)}"]), "k", "f", rng.choice([*days, None])) for i in range(1000)]
    want = set()
    for i, source, target, _, _, at in rows:
        for side, k in (("source", source), ("target", target)):
            if k is not None and not (at and any(n[0] == k and n[4] and n[4] <= at and (n[5] is None or n[5] > at) for n in life)):
                want.add((i, side, k, at))
    found = [tuple(r) for r in references.orphan_references(edges(spark, rows), nodes(spark, life), tasks=5).collect()]
    assert set(found) == want and len(found) == len(want)


def test_a_hot_value_is_one_row_a_task_and_buckets_are_cut(spark):
    rows = [(i, None, "hot", "calls", "one", A) for i in range(4000)] + [(i, f"s{i}", f"t{i % 700}", "calls", "f", A) for i in range(2000)]
    sums = edges(spark, rows).groupBy("target", "kind", "source").count()
    big, rest, total = skew.load_plan(sums.withColumnRenamed("target", "_key"), "_key", 10, 1)
    assert total == 2001 and big.count() == 0
    placed = skew.slots(sums.withColumnRenamed("target", "_key"), "_key", (big, rest, total), ["source"]).groupBy("_key").agg(F.countDistinct("_slot").alias("n"))
    assert placed.where("n > 1").count() == 0
    full = skew.load_plan(spark.range(5000).select((F.col("id") % 3).cast("string").alias("_key")), "_key", 12, 1)
    assert {len(r["_shards"]) for r in full[0].collect()} == {4} and full[1].count() == 0


def _brute(record):
    """Paths of listed objects by plain recursion."""
    out = []

    def walk(v, path, listed, key, packed):
        if isinstance(v, dict):
            if listed:
                out.append(path)
            for k, x in v.items():
                if k == "intent" and path == "" and isinstance(x, str):
                    x = json.loads(x)
                p = f"{path}.{k}" if path else k
                if isinstance(x, dict) and k in nested.LIST_KEYS:
                    walk(x, p + "[0]", True, k, False)
                else:
                    walk(x, p, False, k, v.get("format") == "pcg-ast-1")
        elif isinstance(v, list):
            for i, x in enumerate(v):
                if isinstance(x, list) and packed and key in nested.PACKED and len(x) == len(nested.PACKED[key]):
                    out.append(f"{path}[{i}]")
                else:
                    walk(x, f"{path}[{i}]", isinstance(x, dict), key, packed)

    walk(record, "", False, "", False)
    return out


RECORD = {
    "nodes": [{"id": "a", "children": [{"id": "b", "tags": ["x"], "children": {"id": "c"}}]}, None, {"id": "d"}],
    "edges": {"source": "a", "line": 3},
    "extra": [[{"deep": 1}], 5, {"e": {"list": [{"z": None}]}}],
    "intent": json.dumps({"ast": {"format": "pcg-ast-1", "controls": [[1, 2, 3, 4, 0, "return"], [1, 2]], "uses": [{"line": 1}]}, "tests": {"name": "t"}}),
}


def test_nested_objects(spark):
    rows = [
        ("f", json.dumps({"nodes": [{"old": 1}]}), A), ("f", json.dumps(RECORD), B), ("f", json.dumps(RECORD), B),
        ("text", json.dumps(json.dumps({"nodes": [{"id": "q"}]})), A), ("cut", '{"nodes": [{"id": 1}', A), ("nan", '{"nodes": [{"id": NaN}]}', A),
        ("null", None, A), ("empty", "", A), ("plain", "3", A), ("root", '[{"a": 1}]', None), (None, '{"nodes": [{}]}', A), ("thrice", json.dumps(json.dumps(json.dumps({"nodes": [{"id": "q"}]}))), A),
        ("deep", '{"children": ' * 6000 + "1" + "}" * 6000, A), ("deeper", '{"a": ' * 100_000 + '[{"x": 1}]' + "}" * 100_000, A), ("deep and cut", '{"a": ' * 100_000 + '[{"x": 1}]' + "}" * 99_999, A),
    ]
    files = spark.createDataFrame([(*r, "p", "t") for r in rows], "file string, record string, indexed_at timestamp_ntz, path string, row string")
    found = defaultdict(list)
    for r in nested.nested_objects(files).select("file", F.when(F.length("path") < 1000, F.col("path")).alias("path"), F.length("path").alias("n")).collect():
        found[r.file].append(r.path or r.n)
    assert sorted(found.pop("f")) == sorted(_brute(RECORD))
    assert len(found["deep"]) == 5999 and max(x for x in found.pop("deep") if isinstance(x, int)) == 5999 * 12 - 1
    assert dict(found) == {"text": ["nodes[0]"], "thrice": ["nodes[0]"], "root": ["[0]"], "deeper": [200_002]}
    full = nested.nested_objects(files).where("file = 'f'")
    by = {r.path: r for r in full.collect()}
    assert by["nodes[0].children[0].children[0]"].parent == "nodes[0].children[0]" and by["nodes[0].children[0].children[0]"].table == "nodes[].children[].children[]"
    assert by["intent.ast.controls[0]"].fields["kind"] == "return" and by["nodes[2]"].ordinal == 2 and by["nodes[0].children[0]"].fields["tags"] == '["x"]'
    flat = {r.path: r for r in nested.flat_table(full, "nodes[]", ["id", "missing"]).collect()}
    assert set(flat) == {"nodes[0]", "nodes[2]"} and flat["nodes[2]"].f_id == "d" and flat["nodes[2]"].f_missing is None
    assert nested.nested_objects(files.where("false")).count() == 0


def test_nested_objects_leave_nothing_out(spark):
    packed = {"format": "pcg-ast-1", "version": 1, "bindings": [[1, {"a": 1}, 3, [{"b": 2}], 5, 6, 7, 8, 9], [1, [2]]]}
    deep = "[" * 50_000 + "1" + "]" * 50_000
    records = {
        "cells": json.dumps({"intent": json.dumps({"ast": packed, "capabilities": ["x"]}), "unresolvedCalls": 2}),
        "one path": '{"a": [[{"z": 1}]], "a[0]": [{"z": 2}], "b.c": [{"z": 3}], "b": {"c": [{"z": 4}]}}',
        "repeated": '{"nodes": [{"id": 1, "id": 2}], "nodes": [{"id": 3}, {"id": 4}]}',
        "repeated and deep": '{"x": ' + deep + ', "nodes": [{"id": 1, "id": 2}], "nodes": [{"id": 3}]}',
        "long": '{"nodes": [{"line": ' + "9" * 5000 + "}]}",
        "half a pair": '{"nodes": [{"name": "\\ud83d"}]}', "pair": '{"nodes": [{"name": "\\ud83d\\ude00 \\\\ud83d"}]}',
        "keys": '{"": {"intent": "{\\"tests\\": [{}]}"}}',
        "fields": '{"nodes": [{"id": {"k": [1, 1e400]}, "name": [[1, 2], {"x": 1}], "tags": [[1], [2.50]], "at": {"line": 3, "to": {"line": 4}}, "many": ' + deep + "}]}",
    }
    files = spark.createDataFrame([(f, r, A) for f, r in records.items()], "file string, record string, indexed_at timestamp_ntz")
    rows = nested.nested_objects(files, whole={"nodes[]": ["id"]}).collect()
    found = defaultdict(list)
    for r in rows:
        found[r.file].append((r.path, r.fields.get("z", r.fields.get("id"))))
    at = "intent.ast.bindings[0]"
    assert [p for p, _ in found["cells"]] == [at, at + "[1]", at + "[3][0]"]
    assert {r.parent for r in rows if r.path.startswith(at + "[")} == {at}
    assert found["one path"] == [("a[0][0]", "1"), ("a[0][0]", "2"), ("b.c[0]", "3"), ("b.c[0]", "4")]
    assert found["repeated"] == [("nodes[0]", "1"), ("nodes[0]", "3"), ("nodes[1]", "4")] and found["repeated and deep"] == [("nodes[0]", "1"), ("nodes[0]", "3")]
    assert "half a pair" not in found and "keys" not in found
    by = {(r.file, r.path): r for r in rows}
    assert by["long", "nodes[0]"].fields["line"] == "9" * 5000 and by["pair", "nodes[0]"].fields["name"] == "\U0001f600 \\ud83d"
    assert by["fields", "nodes[0]"].fields == {"id": '{"k":[1,1e400]}', "name": "[[1,2],null]", "tags": "[[1],[2.5]]", "many": deep}
    # what stands in no list has rows of its own
    single = {(r.file, r.path): r for r in nested.single_objects(files).collect()}
    assert single["fields", "nodes[0].at"].fields == {"line": "3"} and single["fields", "nodes[0].at.to"].parent == "nodes[0]" and single["fields", "nodes[0].at.to"].fields == {"line": "4"}
    assert single["cells", ""].fields == {"unresolvedCalls": "2"} and single["cells", "intent"].fields == {"capabilities": '["x"]'}
    assert single["cells", "intent.ast"].fields == {"format": "pcg-ast-1", "version": "1", "bindings": "[null,[1,[2]]]"}


def test_nested_fields_are_those_of_the_sql(spark, tmp_path):
    numbers = ["1.0", "1e5", "1.5e-7", "-0.0", "1E22", "1e16", "1e21", "123e18", "1.25e20", "0.00001", "1e-6", "-2.5e-6", "1e-7", "1e300", "-1.5e-300", "1e400", "9" * 5000, "18446744073709551616", "-0", "5e-324"]
    values = [*numbers, "[" + ",".join(numbers) + "]", "true", "null", '{"a":[1,{"b":"\\u0001\\u001f\\u007f/ä\\u2028"}]}', '[[1],"x",[]]', "{}", '"t"']
    records = [(str(i), f'{{"nodes":[{{"id":{v},"line":[{v}]}}],"intent":{{"capabilities":{v},"ast":{{"format":"pcg-ast-1","controls":[[1,2,3,4,5,{v}]]}}}}}}', A) for i, v in enumerate(values)]
    spark.createDataFrame(records, "file string, record string, indexed_at timestamp_ntz").write.parquet(f"{tmp_path}/files.parquet")
    duck = duckdb.connect()
    duck.sql(f"create view files as from '{tmp_path}/files.parquet/*.parquet'")
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    for name in ("p4_nodes", "p4_controls", "p4_intents", "p4_single"):
        df = queries[name](spark, str(tmp_path))
        columns = ", ".join(f'"{c}"' for c in df.columns)
        assert sorted(map(str, map(tuple, df.collect()))) == sorted(map(str, duck.sql(f"select {columns} from ({sql[name]})").fetchall()))


def test_hierarchy(spark):
    links = [("r.py::r", None), ("r.py::a", "r.py::r"), ("q.py::b", "r.py::a"), ("r.py::c", "q.py::b"), ("lost", "nowhere"), ("self", "self"), ("x", "y"), ("y", "z"), ("z", "x"), ("hang", "x"), ("hang2", "hang"), (None, "r.py::r")]
    links += [links[1], links[1]] + [(f"chain::{i}", f"chain::{i - 1}" if i else None) for i in range(300)]
    rows = nodes(spark, [(i, "n", "k", p, A, None) for i, p in links])
    assert {r.node_id for r in hierarchy.cycle_nodes(rows).collect()} == {"self", "x", "y", "z"}
    tree = {r.node_id: r for r in hierarchy.hierarchy(rows).collect()}
    assert tree["r.py::c"].path == ["r.py::r", "r.py::a", "q.py::b", "r.py::c"] and tree["r.py::c"].depth == 3 and tree["r.py::r"].n_descendants == 3 and tree["r.py::r"].height == 3
    assert tree["lost"].root == "lost" and tree["lost"].parent is None and tree["hang2"].status == "below_cycle" and tree["hang"].n_descendants == 1 and tree["self"].status == "cycle"
    assert tree["chain::299"].depth == 299 and tree["chain::0"].n_descendants == 299 and len(tree) == 311
    pairs = hierarchy.descendants(rows).groupBy("ancestor").agg(F.count("*").alias("n")).collect()
    assert {r.ancestor: r.n for r in pairs if r.n} == {k: r.n_descendants for k, r in tree.items() if r.status == "tree" and r.n_descendants}
    assert hierarchy.hierarchy(rows.where("false")).count() == 0


def test_random_forests(spark):
    rng = random.Random(3)
    for _ in range(2):
        links = {f"f{rng.randrange(5)}::{i}": None for i in range(120)}
        names = list(links)
        for n in names:
            links[n] = rng.choice([None, rng.choice(names), rng.choice(names)])
        rows = nodes(spark, [(i, "n", "k", p, A, None) for i, p in links.items()])
        cycle = set()
        for n in names:
            at, k = links[n], 0
            while at is not None and at != n and k < 200:
                at, k = links[at], k + 1
            if at == n:
                cycle.add(n)
        assert {r.node_id for r in hierarchy.cycle_nodes(rows).collect()} == cycle


def test_descendants_on_and_below_cycles(spark):
    rng = random.Random(4)
    links = {f"f{i % 5}::{i}": None for i in range(120)}
    for n in links:
        links[n] = rng.choice([None, *rng.sample(sorted(links), 12)])
    links |= {f"ring::{i}": f"ring::{(i + 1) % 37}" for i in range(37)} | {"hang::a": "ring::3", "hang::b": "hang::a", "far::c": "hang::b", "self": "self", "below": "self"}
    want = set()
    for n in links:
        seen, at = {n}, links[n]
        while at is not None and at not in seen:
            want.add((at, n, len(seen)))
            seen.add(at)
            at = links[at]
    rows = nodes(spark, [(i, "n", "k", p, A, None) for i, p in links.items()])
    found = [tuple(r) for r in hierarchy.all_descendants(rows).collect()]
    assert set(found) == want and len(found) == len(want)
    assert {("hang::a", "far::c", 2), ("ring::2", "far::c", 39), ("self", "below", 1)} <= want
    assert set(map(tuple, hierarchy.descendants(rows).collect())) < want
    assert hierarchy.all_descendants(rows.where("false")).count() == 0


@pytest.mark.parametrize("name", ["p1_found", "p3_found", "p4_found", "p5_found", "p6_found"])
def test_registered(spark, tables, name):
    import __spark_entry__

    columns = {"p1_found": ["target", "kind"], "p3_found": ["snapshot_no", "file", "change"], "p4_found": ["file", "path"], "p5_found": ["node_id"], "p6_found": ["edge_id", "side"]}
    df = __spark_entry__.queries()[name](spark, tables)
    assert df.columns == columns[name] and df.count() > 0
    assert max(Counter(map(tuple, df.collect())).values()) == 1
