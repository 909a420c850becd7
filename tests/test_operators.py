"""Operators that no query with SQL covers, on small tables."""

import hashlib
import math
import os
import random
from datetime import datetime as T

import pytest
from pyspark.sql import functions as F

from symweave import session
from symweave.functions import scalars
from symweave.operators import accounting, diff, evidence, graph, lexical, reading, skew, traverse
from symweave.sources import records
from symweave.streaming import changes


def test_scan_leaves_out_ignored_directories_and_long_texts(spark, tmp_path):
    for name, text in (("a/b.py", "x = 1\n"), ("node_modules/c.js", "1"), ("a/long.go", "x" * 50), ("ü/é.kt", "val ä = 1")):
        os.makedirs(tmp_path / os.path.dirname(name), exist_ok=True)
        (tmp_path / name).write_text(text, encoding="utf-8")
    rows = {r.file: r for r in records.scan_directory(spark, f"file:{tmp_path}", largest=20).collect()}
    assert sorted(rows) == ["a/b.py", "a/long.go", "ü/é.kt"] and rows["a/long.go"].text is None and rows["ü/é.kt"].text == "val ä = 1"
    assert rows["a/b.py"].size == 6 and len(rows["a/b.py"].sha256) == 64 and [f for f, r in rows.items() if r.skipped] == ["a/long.go"]


def test_kept_table_writes_touched_buckets_only_and_keeps_what_was_opened(spark, tmp_path):
    kept = records.KeptTable(spark, f"file:{tmp_path}/t", "file", 8)
    assert kept.tag() is None
    row = lambda *r: spark.createDataFrame(list(r), "file string, n int")
    kept.upsert(row(*[(c, i) for i, c in enumerate("abcdefghij")]), tag=0)
    old = kept.read()
    kept.upsert(row(("b", 30), ("z", 4)), row(("a", 0)), tag=1)
    again = records.KeptTable(spark, f"file:{tmp_path}/t", "file", 8)
    assert again.tag() == 1 and old.count() == 10
    assert dict(map(tuple, again.read().collect())) == {c: i for i, c in enumerate("abcdefghij") if c != "a"} | {"b": 30, "z": 4}
    assert 1 <= len([p for p in os.listdir(tmp_path / "t" / "v1") if p.startswith("_bucket")]) <= 3
    kept.upsert(row(), again.read())
    assert kept.read().count() == 0


def test_texts_of_files_with_several_rows(spark, monkeypatch):
    rows = spark.createDataFrame([("a", "x"), ("a", "y"), ("a", None), ("b", "x"), ("c", None), (None, "x")], "file string, text string")
    for most in (0, 10):
        monkeypatch.setattr(records, "BROADCAST_FILES", most)
        assert sorted(map(tuple, records.one_text(rows).collect())) == [("a", "y"), ("b", "x")]


def test_units_of_texts(spark):
    rows = spark.createDataFrame([("a.dart", "ä😀"), ("a.go", "ä😀"), ("a.py", "ä😀")], "file string, text string")
    assert [r[0] for r in rows.orderBy("file").select(records.text_units("text", "file")).collect()] == [3, 6, 2]


def _event_files(spark, folder):
    rows = [(i, T(2025, 1, 1 + i % 9, i % 24), i % 4, "ab"[i % 2], float(i)) for i in range(60)]
    for n, part in enumerate((rows[:30], rows[20:50], rows[45:], rows[:5])):
        df = spark.createDataFrame([(*r, "{}") for r in part], "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
        df.coalesce(1).write.mode("append").parquet(f"file:{folder}/part{n}.parquet")
    return rows


def test_streams_over_several_batches(spark, tmp_path):
    rows = _event_files(spark, tmp_path)
    opened = {"pattern": "*.parquet", "files_per_batch": 1}
    folder = f"file:{tmp_path}/*"
    users = {u: (max(r[1] for r in rows if r[2] == u), sum(r[2] == u for r in rows)) for u in range(4)}
    assert {r.user_id: (r.last_at, r.n) for r in changes.maintained_index(spark, folder, **opened).collect()} == users
    assert {r.user_id: r.n for r in changes.deduplicated(spark, folder, **opened).collect()} == {u: n for u, (_, n) in users.items()}
    twice = rows[:30] + rows[20:50] + rows[45:] + rows[:5]
    want = {}
    for _, ts, _, kind, value in twice:
        key = kind, ts.replace(hour=0)
        n, total = want.get(key, (0, 0.0))
        want[key] = n + 1, total + value
    assert {(r.event_type, r.day): (r.n, r.total) for r in changes.tumbling(spark, folder, **opened).collect()} == want


def test_scratch_of_an_application_is_removed(spark):
    rows = session.stage(spark.range(3))
    assert rows.count() == 3
    session.release(spark)
    assert not os.path.exists(session.scratch(spark, "x").removeprefix("file://").rsplit("/", 1)[0])


def test_nearest_scope_is_the_deepest_marked_directory(spark):
    files = spark.createDataFrame([("a/b/c/d.py",), ("a/x.py",), ("z.py",), ("q/r.py",)], "file string")
    marks = spark.createDataFrame([("a",), ("a/b",), ("a/b/c/d.py",), ("q/rr",)], "dir string")
    assert {r.file: r.scope for r in traverse.nearest_scope(files, marks).collect()} == {"a/b/c/d.py": "a/b", "a/x.py": "a", "z.py": None, "q/r.py": None}
    root = spark.createDataFrame([("",)], "dir string")
    assert {r.scope for r in traverse.nearest_scope(files, root).collect()} == {""}


def test_affected_files_with_scopes(spark):
    changed = spark.createDataFrame([("a",)], "file string")
    needs = spark.createDataFrame([("b", "a"), ("c", "b"), ("a", "c"), ("x", "y"), (None, "a")], "file string, target string")
    assert {r.file: r.round for r in traverse.affected_files(changed, needs).collect()} == {"a": 0, "b": 1, "c": 2}
    scopes = spark.createDataFrame([("a", "s"), ("x", "s"), ("z", "t"), ("w", "u")], "file string, scope string")
    assert {r.file: r.round for r in traverse.affected_files(changed, needs, scopes).collect()} == {"a": 0, "b": 1, "c": 2, "x": 2}
    groups = spark.createDataFrame([("s", "u")], "from_scope string, to_scope string")
    assert {r.file: r.round for r in traverse.affected_files(changed, needs, scopes, groups).collect()} == {"a": 0, "b": 1, "c": 2, "x": 2, "w": 3}


def _edges(spark, rows):
    return spark.createDataFrame([(s, t, k, "f", i) for i, (s, t, k) in enumerate(rows)], "source string, target string, kind string, file string, start_offset long")


def test_impact_takes_the_first_way(spark):
    nodes = spark.createDataFrame([("Repo", "class", "f"), ("Repo.fetch", "method", "Repo"), ("Mem.fetch", "method", None), ("use", "function", None), ("f", "file", None)], "id string, kind string, parent string")
    edges = _edges(spark, [("Repo", "Repo.fetch", "contains"), ("Mem.fetch", "Repo.fetch", "overrides"), ("use", "Repo.fetch", "calls"), ("gone", "Repo.fetch", "calls")])
    seeds = spark.createDataFrame([("Mem.fetch",), ("absent",)], "id string")
    found = {r.id: (r.distance, r.via, r.reason) for r in traverse.impact(seeds, edges, nodes).collect()}
    assert found == {"Mem.fetch": (0, None, None), "Repo.fetch": (1, "Mem.fetch", "dispatch_contract"), "use": (2, "Repo.fetch", "calls"), "Repo": (2, "Repo.fetch", "container_of_affected_member")}
    assert {r.id for r in traverse.impact(seeds, edges, nodes, 1).collect()} == {"Mem.fetch", "Repo.fetch"}
    ways = {r.id: r.path for r in traverse.paths(traverse.impact(seeds, edges, nodes)).collect()}
    assert ways["use"] == ["Mem.fetch", "Repo.fetch", "use"] and len(ways) == 4
    known = nodes.withColumn("file", F.lit("f"))
    assert tuple(traverse.depth_limited(seeds, edges, known, 1).first()) == (1, 1, 1, True) and tuple(traverse.depth_limited(seeds, edges, known, 2).first()) == (2, 3, 1, False)


def test_impact_goes_in_the_order_of_discovery(spark):
    rng = random.Random(6)
    names = [f"n{i}" for i in range(40)]
    nodes = spark.createDataFrame([(n, rng.choice(["class", "function", "method"]), rng.choice([None, *names])) for n in names], "id string, kind string, parent string")
    links = sorted({(rng.choice(names), rng.choice(names), rng.choice(["calls", "references", "overrides", "contains", "other"])) for _ in range(90)})
    rows = [(s, t, k, "f", i) for i, (s, t, k) in enumerate(links)]
    edges = spark.createDataFrame(rows, "source string, target string, kind string, file string, start_offset long")
    kind, parent = {r.id: r.kind for r in nodes.collect()}, {r.id: r.parent for r in nodes.collect()}
    key = lambda e: f"{e[0]}|{e[1]}|{e[2]}|{e[3]}|{e[4]}"
    ordered = sorted(rows, key=key)
    seen, queue = {"n3": (0, None, None), "n7": (0, None, None)}, ["n3", "n7"]
    while queue:
        at = queue.pop(0)
        ways = [(e[0], e[2]) for e in ordered if e[1] == at and e[2] in traverse.IMPACT]
        ways += [(e[1], "member_of_changed_container") for e in ordered if e[0] == at and e[2] == "contains" and kind[at] == "class"] + [(e[1], "dispatch_contract") for e in ordered if e[0] == at and e[2] == "overrides"]
        ways += [(parent[at], "container_of_affected_member")] if parent[at] else []
        for to, why in ways:
            if to not in seen and seen[at][0] < 4:
                seen[to] = (seen[at][0] + 1, at, why)
                queue.append(to)
    found = {r.id: (r.distance, r.via, r.reason) for r in traverse.impact(spark.createDataFrame([("n7",), ("n3",)], "id string"), edges, nodes, 4).collect()}
    assert found == seen and len(found) > 15


def test_only_the_shortest_path_is_returned(spark):
    side = [("s", f"x{i}", "calls") for i in range(20)] + [(f"x{i}", f"y{i}", "calls") for i in range(20)]
    edges = _edges(spark, [*side, ("s", "a", "calls"), ("impl", "a", "overrides"), ("impl", "goal", "calls"), ("s", "b", "calls"), ("b", "c", "calls"), ("c", "d", "calls"), ("d", "goal", "calls"), ("goal", "back", "calls")])
    pairs = spark.createDataFrame([("s", "goal"), ("s", "nowhere"), ("goal", "s"), ("s", "s"), (None, "s")], "start string, destination string")
    rows = {(r.start, r.destination, r.step): (r.source, r.target, r.kind) for r in traverse.path_to(pairs, edges).collect()}
    assert rows == {("s", "goal", 1): ("s", "a", "calls"), ("s", "goal", 2): ("impl", "a", "overrides"), ("s", "goal", 3): ("impl", "goal", "calls")}
    assert traverse.path_to(pairs, edges, 2).count() == 0


def test_affected_files_over_long_chains(spark, monkeypatch):
    monkeypatch.setattr(traverse, "LINKS_PER_TASK", 40)
    rng = random.Random(9)
    links = [(f"r{i % 3}/f{i}", f"r{(i - 1) % 3 if i % 50 == 0 else i % 3}/f{i - (1 if i % 50 == 0 else 3)}") for i in range(3, 400)] + [(f"r0/f{rng.randrange(400)}", f"r1/f{rng.randrange(400)}") for _ in range(60)]
    rounds, todo = {"r0/f0": 0, "r1/f100": 0}, ["r0/f0", "r1/f100"]
    while todo:
        at = todo.pop(0)
        for user, target in links:
            if target == at and user not in rounds:
                rounds[user] = rounds[at] + 1
                todo.append(user)
    changed = spark.createDataFrame([("r0/f0",), ("r1/f100",), (None,)], "file string")
    assert {r.file: r.round for r in traverse.affected_files(changed, spark.createDataFrame(links, "file string, target string")).collect()} == rounds


def test_closure_ends_on_circles(spark):
    edges = spark.createDataFrame([("b", "a", "extends"), ("c", "b", "implements"), ("a", "c", "with"), ("d", "c", "calls")], "source string, target string, kind string")
    starts = spark.createDataFrame([("a",)], "id string")
    assert {r.id: r.distance for r in traverse.implementations(starts, edges).collect()} == {"b": 1, "c": 2}


def test_relation_text_order_puts_line_10_before_9(spark):
    rows = spark.createDataFrame([("x", 9), ("x", 10)], "name string, line int")
    assert [r.line for r in rows.orderBy(*graph.row_text_order("name", "line")).collect()] == [10, 9]


def test_code_unit_order(spark):
    rows = spark.createDataFrame([("Ｚ.dart",), ("😀.dart",)], "file string")
    assert rows.orderBy(scalars.utf16_order("file")).first().file == "😀.dart"


def test_terms_and_predicates(spark):
    row = spark.range(1).selectExpr("'lib/UserRepository.fetch_value réseau' t", "'a/b/c_test.go' p")
    got = row.select(scalars.terms("t").alias("t"), scalars.language("p").alias("l"), scalars.test_path("p").alias("x"), scalars.under("p", "a/b").alias("u"), scalars.under("p", "a/b/c").alias("v"), scalars.directory("p").alias("d")).first()
    assert set(got.t) == {"lib", "user", "repository", "userrepository", "fetch", "value", "réseau"} and (got.l, got.x, got.u, got.v, got.d) == ("go", True, True, False, "b")


def test_resolve_takes_the_least_tier(spark):
    nodes = spark.createDataFrame([("f::A.m#method", "method", "f", "A.m", "m"), ("g::m#function", "function", "g", "m", "m"), ("f::file", "file", "f", "f", "f")], "id string, kind string, file string, qualified string, name string")
    wanted = spark.createDataFrame([("f::A.m#method",), ("f",), ("A.m",), ("m",), ("none",), (None,)], "target string")
    found = {r.target: (r.tier, r.n_matches, r.id) for r in graph.resolve(wanted, nodes).collect()}
    assert found == {"f::A.m#method": (0, 1, "f::A.m#method"), "f": (1, 1, "f::file"), "A.m": (2, 1, "f::A.m#method"), "m": (2, 1, "g::m#function"), "none": (None, 0, None)}


SNAPS = "snapshot_no int, file string, hash string, nodes array<struct<id:string>>, edges array<struct<source:string,target:string,kind:string,line:long,start_offset:long,confidence:string>>, received_at timestamp_ntz"


def _compared(spark, before, after, old_sites, new_sites, file="a.ts"):
    site = lambda text, at: ("s", "t", "calls", text.count("\n", 0, at) + 1, at, None)
    rows = [(n, file, t, None, [site(t, i) for i in sites], T(2025, n, 1)) for n, t, sites in ((1, before, old_sites), (2, after, new_sites))]
    texts = spark.createDataFrame([(2, file, before, after)], "snapshot_no int, file string, before string, after string")
    return tuple(diff.relation_correspondence(spark.createDataFrame(rows, SNAPS), diff.site_intervals(texts)).first())[2:]


def test_relations_that_moved_answer_to_each_other(spark):
    old = "".join(f"target({i});\n" for i in range(100))
    new = "// prefix\n" + old
    places = lambda t: [i for i in range(len(t)) if t.startswith("target(", i)]
    assert _compared(spark, old, new, places(old), places(new)) == (0, 100, 0, 0, 0, 0, 0)
    assert _compared(spark, "target(1); target(1);\n", "target(1);\n", [0, 11], [0]) == (0, 0, 2, 0, 1, 1, 0)
    assert _compared(spark, "a();target(1);b();\n", "a(); target(1);b();\n", [0, 4, 14], [0, 5, 15]) == (1, 2, 0, 0, 0, 0, 0)
    assert _compared(spark, "same\n", "same\n", [0, 0], [0]) == (1, 0, 0, 1, 0, 1, 0)


def test_intervals_count_in_the_units_of_the_language(spark):
    texts = spark.createDataFrame([(f, "ä😀\nx\n", "ä😀\nnew\nx\n") for f in ("a.ts", "a.go", "a.py")] + [("b.py", "x\ny\n", "y\nx\n"), ("c.py", None, "x"), ("d.py", "", "")], "file string, before string, after string")
    found = {}
    for r in diff.site_intervals(texts).collect():
        found.setdefault(r.file, []).append(tuple(r)[1:])
    assert {f: sorted(v) for f, v in found.items()} == {f: [(0, 0, n, 1, 1), (n, n + 4, 2, 2, 3)] for f, n in (("a.ts", 4), ("a.go", 7), ("a.py", 3))}
    assert diff.site_intervals(texts.where("false")).count() == 0


def test_moved_lines(spark):
    old = spark.createDataFrame([("f", "a\nb\nb\nc")], "file string, text string")
    new = spark.createDataFrame([("f", "x\r\na\r\nc\r\nb")], "file string, text string")
    assert {(r.old_line, r.new_line) for r in diff.moved_lines(old, new).collect()} == {(1, 2), (4, 3)}


_NODES = "id string, kind string, file string, line long, end_line long, qualified string, name string, tags array<string>"


def test_lines_are_found_by_their_declaration(spark):
    nodes = spark.createDataFrame([("x.py::file", "file", "x.py", 1, 9, "x.py", "x.py", []), ("x.py::Store.loadAll#method", "method", "x.py", 2, 5, "Store.loadAll", "loadAll", ["hot"]), ("x.py::Store.inner#method", "method", "x.py", 3, 4, "Store.inner", "inner", []), ("x.py::Zap#class", "class", "x.py", 3, 4, "Zap", "Zap", [])], _NODES)
    sources = spark.createDataFrame([("x.py", "alpha beta\nalpha\r\nbeta\n...\ngamma alpha\n"), ("x.py", None), ("y.py", "delta\n"), (None, "alpha")], "file string, text string")
    docs = lexical.line_documents(sources, nodes)
    found = {(r.file, r.line): r for r in docs.collect()}
    assert set(found) == {("x.py", 1), ("x.py", 2), ("x.py", 3), ("x.py", 5), ("y.py", 1)}
    assert [found["x.py", i].anchor for i in (1, 2, 3, 5)] == [None, "x.py::Store.loadAll#method", "x.py::Store.inner#method", "x.py::Store.loadAll#method"]
    assert {"load", "all", "loadall", "store", "method"} <= set(found["x.py", 2].field_terms) <= set(found["x.py", 2].terms)
    best = lexical.rank(docs, "beta alpha", nodes, ranking="overlap").collect()
    assert [(r.line, r.matched) for r in best] == [(1, 2), (3, 1), (2, 1), (5, 1)] and best[1].score == pytest.approx(math.log(6 / 3) + 1) and best[3].score == pytest.approx(math.log(6 / 4) + 1)
    exact = lexical.rank(docs, "Store.inner", nodes).collect()
    assert exact[0].line == 3 and exact[0].score > 1000 and len(exact) == 3
    assert [r.line for r in lexical.rank(docs, "alpha", nodes, kind="method", tag="hot").collect()] == [2, 5] and lexical.rank(docs, "alpha", nodes, lang="go").count() == 0
    assert [r.line for r in lexical.rank(docs, "alpha", nodes, anchor="x.py::Store.loadAll#method").collect()] == [2, 5] and lexical.rank(docs, "delta", nodes, prefix="x.py").count() == 0
    groups = {r.anchor: (r.line, r.match_count, r.match_lines) for r in lexical.grouped(lexical.scored(docs, "alpha gamma", nodes)).collect()}
    assert groups == {"x.py::Store.loadAll#method": (5, 2, "5 2"), None: (1, 1, "1")}
    edges = spark.createDataFrame([("a", "x.py::Store.inner#method", k, "f", 1, i) for i, k in enumerate(["references", "calls", "contains", "calls"])] + [("x.py::Store.inner#method", "b", "calls", "f", 1, 1)], "source string, target string, kind string, file string, line long, start_offset long")
    chosen = lexical.rank(docs, "Store.inner", nodes, limit=1)
    assert sorted(r.start_offset for r in lexical.expanded(chosen, edges).collect()) == [0, 1, 3] and [r.start_offset for r in lexical.expanded(chosen, edges, steps=1).collect()] == [1]
    assert [r.target for r in lexical.expanded(chosen, edges, "dependencies").collect()] == ["b"]
    with pytest.raises(ValueError):
        lexical.rank(docs, "...", nodes)
    assert lexical.line_documents(sources.where("false"), nodes).count() == 0


_EVIDENCE = "start string, step int, section string, reason string, distance int, source string, target string, kind string, file string, line long, start_offset long, confidence string"


def test_evidence_keeps_the_first_section_and_adds_others_with_their_reasons(spark):
    edge, sure, unsure = ("a", "b", "calls", "f", 1, 2), "resolved", "heuristic"
    rows = [("b", 2, "usages", "resolved_static_site", 1, *edge, sure), ("b", 1, "contracts", "link", 3, *edge, sure), ("b", 1, "contracts", "link", 2, *edge, sure), ("b", 3, "consumers", "link", 1, *edge, sure)]
    rows += [("b", 1, "callers", "site", 1, *edge, unsure), ("b", 2, "usages", "other", 1, *edge, unsure), ("c", 1, "consumers", "site", 1, *edge, sure), ("d", 1, "module_context", "x", 1, *edge, sure), ("d", 2, "flow", "y", 1, *edge, sure)]
    found = {(r.start, r.confidence): r for r in evidence.required(evidence.deduplicate(spark.createDataFrame(rows, _EVIDENCE))).collect()}
    assert len(found) == 4 and all(len(r.evidence_id) == 16 for r in found.values())
    pick = lambda *k: (found[k].section, found[k].also_sections, found[k].reason, found[k].distance, found[k].required)
    assert pick("b", sure) == ("contracts", "usages,consumers", "link; resolved_static_site", 2, True)
    assert pick("b", unsure) == ("candidates", "callers", "provider confidence heuristic: site", 1, True)
    assert pick("c", sure) == ("consumers", "", "site", 1, False) and pick("d", sure) == ("module_context", "flow", "x; y", 1, True)


def _recipes(spark, nodes, edges, cases=(), depth=2):
    nodes = spark.createDataFrame([(i, k, f, line, 0, p) for i, k, f, line, p in nodes], "id string, kind string, file string, line long, start_offset long, parent string")
    edges = spark.createDataFrame([(s, t, k, f, line, o, "resolved") for s, t, k, f, line, o in edges], "source string, target string, kind string, file string, line long, start_offset long, confidence string")
    cases = spark.createDataFrame(list(cases), "file string, ordinal int, framework string, name string, line long, end_line long")
    return evidence.Recipes(nodes.where("kind not in ('file', 'external')").select("id"), nodes, edges, cases, depth)


def _sections(recipes, intent, start):
    rows = evidence.deduplicate(recipes.collect(intent)).where(f"start = '{start}'").collect()
    return {(r.section, r.source, r.target, r.start_offset, r.distance) for r in rows if r.section != "declarations"}


def test_recipes_keep_distinct_sites_and_follow_links(spark):
    nodes = [("f", "file", "api.py", 1, None), ("api", "function", "api.py", 2, "f"), ("caller", "function", "api.py", 3, "f"), ("helper", "function", "api_test.py", 4, None), ("base", "method", "b.py", 1, None), ("impl", "method", "c.py", 1, None), ("other", "function", "d.py", 1, None)]
    edges = [("caller", "api", "calls", "api.py", 3, 30), ("caller", "api", "references", "api.py", 3, 34), ("caller", "api", "references", "api.py", 3, 38), ("helper", "caller", "calls", "api_test.py", 4, 7), ("impl", "base", "overrides", "c.py", 1, 1), ("other", "base", "calls", "d.py", 1, 2), ("impl", "api", "calls", "c.py", 1, 9), ("x", "api.py::file", "exports", "x.py", 1, 0), ("impl", "impl", "calls", "c.py", 2, 3)]
    kit = _recipes(spark, nodes, edges, [("api.py", 0, "unit", "first", 3, 3), ("api.py", 1, "unit", "second", 1, 9)])
    assert _sections(kit, "rename", "api") == {("usages", "caller", "api", o, 1) for o in (30, 34, 38)} | {("usages", "impl", "api", 9, 1), ("module_context", "x", "api.py::file", 0, 1)}
    assert _sections(kit, "rename", "impl") == {("contracts", "impl", "base", 1, 1), ("usages", "other", "base", 2, 1), ("usages", "impl", "impl", 3, 1)}
    assert ("internal_group", "impl", "impl", 3, 1) in _sections(kit, "remove_symbol", "impl") and ("consumers", "other", "base", 2, 1) in _sections(kit, "remove_symbol", "impl")
    assert _sections(kit, "find_tests", "api") == {("tests", "caller", "api", o, 1) for o in (30, 34, 38)} | {("test_candidates", "helper", "caller", 7, 2)}
    reasons = {r.reason for r in kit.collect("find_tests").where("section = 'tests'").collect()}
    assert reasons == {"resolved test case unit: first; static reference does not prove execution/assertion"}
    assert kit.tests(1, framework="none").count() == 0 and kit.tests(1, scope="api_test.py").where("section = 'tests'").count() == 0
    assert _sections(kit, "trace_flow", "other") == {("flow", "other", "base", 2, 1), ("flow", "impl", "base", 1, 2)}
    assert _sections(kit, "explain_symbol", "caller") == {("container", "f", "f", 0, 0), *[("dependencies", "caller", "api", o, 1) for o in (30, 34, 38)], ("consumers", "helper", "caller", 7, 1)}
    with pytest.raises(ValueError):
        kit.collect("guess")


def test_context_takes_the_graph_first(spark):
    node, edge = "id string, kind string, file string, line long, start_offset long, parent string", "source string, target string, kind string, file string, line long, start_offset long, confidence string"
    nodes, edges = evidence.context(
        spark.createDataFrame([("a", "class", "f", 1, 0, None)], node), spark.createDataFrame([("a", "a", "calls", "f", 1, 0, "resolved")], edge),
        spark.createDataFrame([("a", "parameter", "g", 1, 0, None), ("b", "parameter", "g", 1, 0, None), ("b", "parameter", "g", 1, 0, None), (None, "x", "g", 1, 0, None)], node), spark.createDataFrame([("a", "b", "binds_field", "f", 1, 0, "resolved")] * 2, edge),
    )
    assert sorted((r.id, r.kind) for r in nodes.collect()) == [("a", "class"), ("b", "parameter")] and edges.count() == 2


def test_page_stops_at_files_items_and_characters(spark):
    rows = [(s, 1, "usages", "calls", 1, "a", "b", "calls", f"f{i // 2}", i, i, "resolved") for i in range(10) for s in ("s", "t")]
    df = evidence.deduplicate(spark.createDataFrame(rows, _EVIDENCE))
    got = evidence.first_page(df, max_items=8, max_files=2).where("start = 's'").collect()
    assert {r.file for r in got} == {"f0", "f1"} and sorted(r.position for r in got) == [1, 2, 3, 4]
    assert evidence.first_page(df, max_chars=10).count() == 2 and evidence.first_page(df, max_chars=400).where("start = 't'").count() == 2


def test_dictionary_is_dense_and_ordered(spark):
    rows = spark.createDataFrame([(v,) for v in ["b", "a", "ü", "aa", "a", None, "a-long-value-1", "a-long-value-2"]], "file string")
    found = {r.value: (r.code, r.n) for r in evidence.dictionary(rows, "file").collect()}
    assert found == {"a": (0, 2), "a-long-value-1": (1, 1), "a-long-value-2": (2, 1), "aa": (3, 1), "b": (4, 1), "ü": (5, 1)}


def test_bootstrap_holds_the_ratio_and_is_null_without_sums(spark):
    rng = random.Random(3)
    pairs = spark.createDataFrame([("m", i, float(i + 1), 2.0 * (i + 1)) for i in range(30)] + [("none", 1, 0.0, 1.0)] + [("wide", i, 1.0, float(rng.random() < 0.5)) for i in range(200)], "metric string, task int, a double, b double")
    got = {r.metric: r for r in accounting.paired_bootstrap(pairs, 200).collect()}
    assert got["m"].ratio == pytest.approx(2) and got["m"].low == pytest.approx(2) and got["m"].high == pytest.approx(2) and got["none"].ratio is None and got["none"].low is None
    half = 1.96 * math.sqrt(got["wide"].ratio * (1 - got["wide"].ratio) / 200)
    assert got["wide"].high - got["wide"].low == pytest.approx(2 * half, rel=0.35) and got["wide"].low < got["wide"].ratio < got["wide"].high
    assert accounting.paired_bootstrap(pairs.where("false")).count() == 0


def test_attempts_of_a_journal(spark):
    at = lambda d: T(2025, 1, d)
    rows = [("a", "started", at(1)), ("a", "finished", at(2)), ("b", "started", at(1)), ("c", "started", at(1)), ("c", "started", at(2)), ("d", "finished", at(3)), (None, "started", at(1)), ("a", "note", at(9))]
    found = {r.attempt: (r.status, r.started, r.finished) for r in accounting.attempts(spark.createDataFrame([(*r, "k") for r in rows], "attempt string, event string, at timestamp_ntz, kind string")).collect()}
    assert found == {"a": ("finished", at(1), at(2)), "b": ("interrupted_unknown", at(1), None), "c": ("conflict", at(1), None), "d": ("orphan_end", None, at(3))}


def test_usage_of_providers(spark):
    rows = [("1", "anthropic", 10, 5, 3, 7, 2), ("2", "openai", 10, 4, 0, 7, 2), ("3", "openai", 10, 14, 0, 7, 2), ("4", "openai", 10, None, 0, 7, 2), ("5", "openai", 10, 4, 0, 1, 2)]
    found = {r.request: (r.total, r.uncached, r.valid) for r in accounting.normalised_usage(spark.createDataFrame(rows, "request string, provider string, input long, cached long, created long, output long, reasoning long")).collect()}
    assert found == {"1": (18, 13, True), "2": (10, 6, True), "3": (10, -4, False), "4": (10, None, False), "5": (10, 6, False)}


def test_pages_are_put_together(spark):
    rows = [("a", 0, 0, 2, "x"), ("a", 0, 0, 2, "y"), ("a", 1, 2, None, "y"), ("b", 0, 0, 2, "x"), ("b", 1, 3, None, "z"), ("c", 0, 0, 2, "x"), ("d", 0, 1, None, "x"), ("e", 0, 0, None, None)]
    found = {r.collection: tuple(r)[1:] for r in accounting.page_fusion(spark.createDataFrame(rows, "collection string, page long, offset long, next_offset long, record string")).collect()}
    assert found == {"a": (2, 2, 1, True), "b": (2, 2, 0, False), "c": (1, 1, 0, False), "d": (1, 1, 0, False), "e": (1, 0, 0, True)}


def test_snippets_are_clamped_and_cut(spark):
    text = "α😀\r\nsecond\r\n" + "\n".join(f"line {i}" for i in range(3, 30))
    nodes = spark.createDataFrame([("a", "f", 1, 2), ("b", "f", 10, 20), ("c", "f", 0, 1), ("d", "f", 40, 41), ("e", "g", 1, 1), ("h", "f", 28, 99)], "id string, file string, line long, end_line long")
    sources = spark.createDataFrame([("f", text), ("g", None)], "file string, text string")
    own = {r.id: r for r in reading.snippets(nodes, sources, context=0).collect()}
    assert set(own) == {"a", "b", "h"} and own["a"].text == "α😀\r\nsecond\r" and (own["a"].start_line, own["a"].end_line, own["a"].truncated) == (1, 2, False)
    assert own["h"].text == "line 28\nline 29"
    cut = {r.id: r for r in reading.snippets(nodes, sources, context=2, max_lines=3, max_units=2).collect()}
    assert cut["a"].text == "α" and cut["a"].truncated and (cut["b"].start_line, cut["b"].end_line, cut["b"].text) == (8, 8, "li")
    with pytest.raises(ValueError):
        reading.snippets(nodes, sources, context=21)
    files = spark.createDataFrame([("f", "0" * 64, T(2025, 1, 1)), ("f", hashlib.sha256(text.encode()).hexdigest().upper(), T(2025, 1, 2)), ("g", "x", None), ("k", "x", None)], "file string, hash string, indexed_at timestamp_ntz")
    states = spark.createDataFrame([("f", text), ("g", "other"), ("g", None)], "file string, text string")
    assert dict(map(tuple, reading.freshness(files, states).collect())) == {"f": "same", "g": "stale", "k": "missing"}


def test_windows_are_merged_and_conflicts_told(spark):
    rows = [("f", 1, "a\nb\nc"), ("f", 3, "c\nd"), ("f", 5, "e"), ("f", 9, "x\r\ny"), ("f", 10, "z"), ("g", 1, "q"), ("g", 1, "q"), (None, 1, "q"), ("h", 1, None)]
    found = {(r.file, r.start_line): tuple(r)[2:] for r in reading.merge_windows(spark.createDataFrame(rows, "file string, start_line long, text string")).collect()}
    assert found == {("f", 1): (5, 3, False, "a\nb\nc\nd\ne"), ("f", 9): (10, 2, True, "x\r\ny"), ("g", 1): (1, 2, False, "q")}


def test_extraction_of_a_region(spark):
    # 1 value = input   2 value += 1   3 result = value * 2   4 return result
    statements = spark.createDataFrame([("f", i, i, 10 * i, 10 * i + 9, "s0", "b0") for i in range(1, 5)] + [("f", 3, 3, 31, 33, "s0", "inner")], "file string, line long, end long, offset long, end_offset long, scope string, block string")
    bindings = spark.createDataFrame([("f", "value", 10), ("f", "result", 30), ("f", "far", 5)], "file string, id string, offset long")
    uses = spark.createDataFrame([("f", 20, "s0", "value", True, True), ("f", 35, "s0", "value", True, False), ("f", 45, "s0", "result", True, False), ("f", 36, "s0", None, True, False), ("f", 46, "s1", "result", True, False)], "file string, offset long, scope string, binding string, read boolean, write boolean")
    controls = spark.createDataFrame([("f", 40, "return")], "file string, offset long, kind string")
    wanted = spark.createDataFrame([("mid", "f", 2, 3), ("all", "f", 1, 4), ("one", "f", 2, 2), ("none", "f", 9, 12)], "region string, file string, start_line long, end_line long")
    found = reading.regions(statements, wanted)
    assert {r.region: (r.start_offset, r.end_offset, r.n_statements) for r in found.collect()} == {"mid": (20, 39, 2), "all": (10, 49, 4), "one": (20, 29, 1)}
    facts = {(r.region, r.fact, r.binding): r.n for r in reading.extraction(found, bindings, uses, controls).collect()}
    assert facts == {("mid", "capture_reads", "value"): 2, ("mid", "external_mutations", "value"): 1, ("mid", "locals_used_after", "result"): 1, ("one", "capture_reads", "value"): 1, ("one", "external_mutations", "value"): 1, ("all", "control_exits", "return"): 1}


def test_inert_edits_and_unchanged_sources(spark):
    rows = [("a.dart", "x\n", "// c\n \nx\n", True), ("a.dart", "// c\nx\n", "x\n", True), ("a.py", "x\n", "// c\nx\n", False), ("a.py", "x\n", "\n\nx\n", True), ("a.dart", "x\n", "y\nx\n", False), ("a.dart", "x\n", "// \\ c\nx\n", False), ("a.dart", "x\n", "x\n", False), ("a.dart", "x\n", "// cx\n", False), ("a.dart", None, "x", False)]
    df = spark.createDataFrame(rows, "file string, a string, b string, want boolean")
    assert [r for r in df.select(reading.inert_leading_edit("file", "a", "b").alias("got"), "want", "a", "b").collect() if r.got != r.want] == []
    df = spark.createDataFrame([("a\nb\nc", 2, 3, "x\na\nb\nc", 3, 4, True), ("a\nb", 1, 2, "a\nc", 1, 2, False), ("a\nb", 1, 3, "a\nb", 1, 3, False), ("a", 0, 1, "a", 0, 1, False)], "t string, l long, e long, u string, m long, f long, want boolean")
    assert [r for r in df.select(reading.unchanged_source("t", "l", "e", "u", "m", "f").alias("got"), "want").collect() if r.got != r.want] == []


def test_generation_tells_tables_apart_whatever_their_order(spark):
    name = lambda *rows: reading.generation(spark.createDataFrame(list(rows), "file string, hash string")).first().generation
    assert name(("a", "1"), ("b", None)) == name(("b", None), ("a", "1"), ("a", "1")) and len(name(("a", "1"))) == 20
    assert len({name(("a", "1"), ("b", "2")), name(("a", "2"), ("b", "1")), name(("a", "1")), name(("a", None))}) == 4


def test_relations_of_a_hot_node(spark, monkeypatch):
    monkeypatch.setattr(skew, "ROWS_PER_TASK", 20)
    nodes = spark.createDataFrame([(f"n{i}", "function", f"n{i}", "f", i, ["t"]) for i in range(60)], "id string, kind string, name string, file string, line long, tags array<string>")
    edges = spark.createDataFrame([(f"n{i}", "n0", "calls", "f", 1, i, "resolved") for i in range(1, 60)] * 2 + [("n1", "gone", "calls", "f", 1, 1, "resolved"), ("n5", "n5", "references", "f", 1, 1, "resolved"), (None, "n0", "calls", "f", 1, 1, "resolved")], "source string, target string, kind string, file string, line long, start_offset long, confidence string")
    callers = graph.relations(edges, nodes, ["calls"], "in").collect()
    assert len(callers) == 118 and {r.target_id for r in callers} == {"n0"} and {r.id for r in callers} == {f"n{i}" for i in range(1, 60)} and callers[0].tags == "t"
    assert graph.relations(edges, nodes, ["calls"], "out").count() == 118
    assert graph.neighbour_rows(edges, nodes).where("target_id = 'n5' and relation = 'references'").count() == 2
    seen = {r.id: tuple(r)[1:] for r in graph.inspect(edges, nodes).collect()}
    assert seen == {"n0": (118, 98, 0, 0)}


def test_file_filters_suggest_one_longer_prefix(spark):
    files = spark.createDataFrame([("app/lib/a.dart",), ("app/lib/b.dart",), ("x/src/a.go",), ("y/src/b.go",), (None,)], "file string")
    found = {r.prefix: (r.valid, r.suggestion) for r in graph.file_filters(files, ["lib/", "src/", "app/", "none", "ib/"]).collect()}
    assert found == {"lib/": (False, "app/lib/"), "src/": (False, None), "app/": (True, None), "none": (False, None), "ib/": (False, None)}
    for bad in ("/a", "a/../b", "a:b", "a\\b"):
        with pytest.raises(ValueError):
            graph.file_filters(files, [bad])


def test_globs(spark):
    df = spark.createDataFrame([("a/b.ts",), ("a/b/c.test.ts",), ("x.go",), ("a/{b}.ts",)], "file string")
    fits = lambda *g: [r.file for r in df.where(scalars.glob("file", *g)).collect()]
    assert fits(["a/*.ts"]) == ["a/b.ts", "a/b/c.test.ts", "a/{b}.ts"] and fits(["**/*.ts", "?.go"], ["*.test.*"]) == ["a/b.ts", "x.go", "a/{b}.ts"]
    assert fits(["*.{go,rs}"]) == ["x.go"] and fits(["[!a].go"]) == ["x.go"] and fits(["[!x].go"]) == [] and fits([]) == []


def test_candidates_of_ambiguous_names(spark):
    nodes = spark.createDataFrame([(f"f::m{i}", "method", "f", f"A{i}.m", "m") for i in range(15)] + [("f::one", "class", "f", "one", "one")], "id string, kind string, file string, qualified string, name string")
    found = graph.resolve_candidates(spark.createDataFrame([("m",), ("one",), ("no",), ("m",)], "target string"), nodes).collect()
    assert [r.id for r in sorted(found, key=lambda r: r.place)] == sorted(f"f::m{i}" for i in range(15))[:10] and {r.target for r in found} == {"m"}


def test_review_of_snapshots(spark):
    schema = "snapshot_no int, file string, hash string, nodes array<struct<id:string,name:string,kind:string,line:long,end_line:long,parent:string>>, edges array<struct<source:string,target:string,kind:string,line:long,start_offset:long,confidence:string>>, received_at timestamp_ntz"
    node = lambda i, kind="class", line=1: (i, i, kind, line, line, None)
    edge = lambda s, t, at=0: (s, t, "calls", 1, at, None)
    rows = [
        (1, "a", "1", [node("a::file", "file"), node("x"), node("y")], [edge("x", "y"), edge("x", "y")], T(2025, 1, 1)), (2, "a", "2", [node("a::file", "file", 2), node("x", "struct"), node("z")], [edge("x", "y")], T(2025, 1, 2)),
        (1, "b", "1", None, [edge("q", "y"), edge("q", "y"), edge("q", "x", 5)], T(2025, 1, 1)), (2, "b", "1", None, [edge("q", "y"), edge("q", "x", 6)], T(2025, 1, 2)), (2, "c", "1", [], [], T(2025, 1, 2)),
    ]
    found = {(r.section, r.phase, r.source, r.target, r.kind, r.start_offset, r.n) for r in diff.review(spark.createDataFrame(rows, schema)).collect()}
    assert found == {
        ("source_changes", "current", "a::file", "a::file", "source_changed", 0, 1), ("source_changes", "current", "c::file", "c::file", "source_added", 0, 1),
        ("changed_symbols", "current", "x", "x", "declaration", None, 1), ("added_symbols", "current", "z", "z", "declaration", None, 1), ("removed_symbols", "before", "y", "y", "declaration", None, 1),
        ("affected_consumers", "before", "x", "y", "calls", 0, 2), ("affected_consumers", "before", "q", "y", "calls", 0, 2),
        ("removed_relations", "before", "x", "y", "calls", 0, 2), ("added_relations", "current", "x", "y", "calls", 0, 1), ("removed_relations", "before", "q", "y", "calls", 0, 1), ("removed_relations", "before", "q", "x", "calls", 5, 1), ("added_relations", "current", "q", "x", "calls", 6, 1),
    }


def test_compact_rows_leave_out_what_is_absent(spark):
    rows = spark.createDataFrame([("a", "class", "A", "f", 1, ["t"], True), ("b", "class", None, "f", 1, [], False)], "id string, kind string, name string, file string, line long, tags array<string>, synthetic boolean")
    assert [r.row for r in graph.compact(rows).orderBy("id").collect()] == ['{"id":"a","kind":"class","name":"A","file":"f","line":1,"tags":["t"],"synthetic":true}', '{"id":"b","kind":"class","file":"f","line":1}']


def test_deltas_skip_repeats_and_start_again_after_a_fall(spark):
    rows = [(1, i, T(2025, 1, 1, 0, i), v) for i, v in enumerate([5.0, 5.0, 9.0, 2.0, 3.0])]
    df = spark.createDataFrame(rows, "user_id long, event_id long, ts timestamp_ntz, value double")
    assert [(r.event_id, r.segment, r.delta) for r in accounting.counter_deltas(df).orderBy("event_id").collect()] == [(0, 1, 5.0), (2, 1, 4.0), (3, 2, 2.0), (4, 2, 1.0)]


def test_structural_implementations_need_every_method(spark):
    rows = [("I", "interface", "I", None), ("I.a", "method", "a", "I"), ("I.b", "method", "b", "I"), ("E", "interface", "E", None), ("A", "class", "A", None), ("A.a", "method", "a", "A"), ("A.b", "method", "b", "A"), ("A.c", "method", "c", "A"), ("B", "struct", "B", None), ("B.a", "method", "a", "B"), ("B.a2", "method", "a", "B")]
    nodes = spark.createDataFrame(rows, "id string, kind string, name string, parent string")
    assert [tuple(r) for r in graph.structural_implementations(nodes).collect()] == [("A", "I")]


def test_multiset_difference(spark):
    a, b = spark.createDataFrame([(1,), (1,), (2,), (None,)], "x int"), spark.createDataFrame([(1,), (3,), (None,)], "x int")
    assert {tuple(r) for r in graph.multiset_difference(a, b).collect()} == {(1, "a", 1), (2, "a", 1), (3, "b", 1)}


def test_posting_blocks_hold_every_id(spark):
    rows = [(f"f{i % 7}::é{i}", "function", f"load.Item{i}") for i in range(250)] + [("x", "file", "load"), (None, "function", "load"), ("f0::é0", "function", "load.Item0"), ("n", "function", None)]
    df = spark.createDataFrame(rows, "id string, kind string, qualified string")
    blocks = [r for r in lexical.posting_blocks(df, 20).collect() if r.term == "load"]
    ids = [i for r in sorted(blocks, key=lambda r: r.block) for i in r.ids]
    assert sorted(ids) == sorted({r[0] for r in rows[:250]}) and len(blocks) > 5
    for r in sorted(blocks, key=lambda r: r.block):
        own = r.ids
        assert ids[r.first : r.first + len(own)] == own and own == sorted(own, key=lambda x: x.encode("utf-16-be")) and len(own) < 60
    assert sorted(r.block for r in blocks) == list(range(len(blocks)))
    assert lexical.posting_blocks(df.where("false")).count() == 0
