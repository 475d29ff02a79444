"""Shortest paths: results against a plain search, and plans without broadcasts."""

from __future__ import annotations

import random

from cipherledger.operators import reach


def _plain(edges: set[tuple[str, str]], pairs: set[tuple[str, str]]) -> set[tuple[str, str, int, str]]:
    out = set()
    for source in {s for s, _ in pairs}:
        best, level = {source: (source,)}, {source: (source,)}
        while level:
            step: dict[str, tuple[str, ...]] = {}
            for node, path in level.items():
                for a, b in edges:
                    if a == node and b not in best:
                        step[b] = min(step.get(b, (*path, b)), (*path, b))
            best |= step
            level = step
        out |= {(source, t, len(best[t]) - 1, " ".join(best[t])) for s, t in pairs if s == source and t in best}
    return out


def test_shortest_paths_send_no_table_through_the_driver(spark, monkeypatch):
    rng = random.Random(4)
    edges = {(f"n{rng.randrange(30)}", f"n{rng.randrange(30)}") for _ in range(45)} | {(f"c{i}", f"c{i + 1}") for i in range(11)} | {("c11", "c0")}
    pairs = {(f"n{rng.randrange(33)}", f"n{rng.randrange(33)}") for _ in range(40)} | {("c0", "c0"), ("c0", "c9"), ("c3", "c2"), ("c4", "c5"), ("c5", "n1")}
    plans, kept = [], reach.kept
    monkeypatch.setattr(reach, "kept", lambda df, name: (plans.append(df._jdf.queryExecution().executedPlan().toString()), kept(df, name))[1])
    nulls = [(None, "n1"), ("n1", None)]
    e = spark.createDataFrame([*sorted(edges), *nulls], "caller string, callee string")
    got = reach.shortest_paths(e, spark.createDataFrame([*sorted(pairs), *nulls], "source string, target string"))
    plans.append(got._jdf.queryExecution().executedPlan().toString())
    assert {(r.source, r.target, r.depth, " ".join(r.path)) for r in got.collect()} == _plain(edges, pairs)
    assert got.count() == len(_plain(edges, pairs))
    assert len(plans) > 10
    assert not [p for p in plans if "Broadcast" in p or "NestedLoop" in p]
    # A hop reads written tables: its plan joins edges, seen nodes, targets and what the sources have left, at whatever depth.
    assert max(p.count("SortMergeJoin") for p in plans) <= 4


def test_the_call_graph_sends_no_table_through_the_driver(spark, monkeypatch):
    text = ["@app.route('/')", "def a(x):", "    b(x)", "    os.path.join(x)", "def b(x):", "    c(", "        x)", "def c(x):", "    missing(x)"]
    lines = spark.createDataFrame([(f"m{k}.py", i + 1, line) for k in range(3) for i, line in enumerate(text)], "file_path string, line_no int, line string")
    plans, kept = [], reach.kept
    monkeypatch.setattr(reach, "kept", lambda df, name: (plans.append(df._jdf.queryExecution().executedPlan().toString()), kept(df, name))[1])
    functions, calls = reach.code_graph(lines)
    edges = reach.assemble(functions, calls)[1]
    plans.append(edges._jdf.queryExecution().executedPlan().toString())
    names = [("a", "b", False), ("a", "os.path.join", True), ("b", "c", False), ("c", "missing", True)]
    want = {(f"m{k}.{a}", b if "." in b else f"m{k}.{b}", external) for k in range(3) for a, b, external in names}
    assert {tuple(r) for r in edges.collect()} == want
    assert len(plans) == 6
    assert not [p for p in plans if "Broadcast" in p or "NestedLoop" in p]


def test_callees_are_resolved_by_name_then_by_module(spark):
    functions = spark.createDataFrame([("m.f",), ("m.g",), ("lone",)], "qualified_name string")
    calls = spark.createDataFrame([("m.f", "g"), ("m.f", "lone"), ("m.f", "m.g"), ("m.f", "x.y"), ("m.f", "h"), ("top", "g"), ("m.g", None)], "caller string, callee string")
    want = {("m.f", "m.g", False), ("m.f", "lone", False), ("m.f", "x.y", True), ("m.f", "h", True), ("top", "g", True), ("m.g", None, True)}
    assert {tuple(r) for r in reach.resolve_callees(calls, functions).collect()} == want
