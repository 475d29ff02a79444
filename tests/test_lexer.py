"""Lexing, statements, calls and scopes against Python's own tree, with blocks of a few lines and of many."""

from __future__ import annotations

import ast
import random

import pytest
from pyspark.sql import functions as F

from cipherledger.operators import detect, lexer, reach, scan
from cipherledger.plans import detection, run
from cipherledger.sources import tables
from cipherledger.sources.rule_files import load_detection_rules

LINES = "file_path string, line_no int, line string"
PIECES = [
    ['x = f("a\\"b # c", g(1, (2, [3])), k={"q": h(4)})'],
    ["y = m.n('it\\'s', r'\\d(', rb\"z)\", f'{x}')  # c(1)"],
    ["z = rsa.generate_private_key(", "    public_exponent=pick(65537, (1)),  # (", "    key_size=3072,", ")"],
    ['t = """ q(1)', "def no(): (", '  still \\""" r(2)', '""" + s.u(v(5))'],
    ["w = a(1) + \\", "    b(2)"],
    ["u = '''x''' + p('''(''') + p(\"\")"],
    ["v = [", "  c(", "1),", "def_(2)]"],
    ["# def gone(): e(1)"],
    [""],
    ["pass"],
]


def _source(r: random.Random, depth: int = 0) -> list[str]:
    out: list[str] = []
    for _ in range(r.randint(1, 5)):
        kind = r.randrange(5) if depth < 4 else 4
        name = f"n{r.randint(0, 999)}"
        if kind == 0:
            out += [f"class {name}(Base):", *_source(r, depth + 1)]
        elif kind == 1:
            out += [*(["@app.route(path('/x'))"] if r.random() < 0.4 else []), *(["@cache"] if r.random() < 0.3 else []), f"def {name}(self,", "x=(1)): # odd margin", *_source(r, depth + 1)]
        elif kind == 2:
            out += ["if cond(1):", *_source(r, depth + 1)]
        else:
            out += r.choice(PIECES)
    out += [f"last{depth}(0)"]
    inside, indented = False, []
    for line in out:  # text between triple quotes stays at the margin that it has
        indented.append(line if inside or depth == 0 else "    " + line)
        inside ^= line.count('"""') - line.count('\\"""') == 1
    return indented


def _tree(source: str, module: str):
    functions, edges, calls = [], [], []

    def name(f):
        if isinstance(f, ast.Name):
            return "", f.id
        return (ast.unparse(f.value), f.attr) if isinstance(f, ast.Attribute) else None

    def visit(node, scope):
        if isinstance(node, ast.ClassDef | ast.FunctionDef):
            if isinstance(node, ast.FunctionDef):
                functions.append((".".join([module, *scope, node.name]), node.lineno))
                for d in node.decorator_list:
                    visit(d, scope)
            for x in node.body:
                visit(x, [*scope, node.name])
            return
        if isinstance(node, ast.Call):
            m, f = name(node.func)
            calls.append((node.lineno, f, len(node.args), tuple(k.arg for k in node.keywords)))
            if scope:
                edges.append((".".join([module, *scope]), f"{m}.{f}" if m else f"{module}.{f}", node.lineno))
        for x in ast.iter_child_nodes(node):
            visit(x, scope)

    for x in ast.parse(source).body:
        visit(x, [])
    return sorted(functions), sorted(edges), sorted(calls)


@pytest.mark.parametrize("block", [3, 1024])
def test_equal_to_the_tree(spark, monkeypatch, block):
    monkeypatch.setattr(scan, "BLOCK", block)
    r = random.Random(4)
    files = {f"pkg/m{k}.py": "\n".join(_source(r)) for k in range(12)}
    df = spark.createDataFrame([(p, i + 1, line) for p, s in files.items() for i, line in enumerate(s.split("\n"))], LINES).repartition(3)
    fns, edges, calls = [], [], []
    for p, s in files.items():
        f, e, c = _tree(s, p[:-3].replace("/", "."))
        fns, edges, calls = fns + f, edges + e, calls + [(p, *x) for x in c]
    assert len(fns) > 20 and len(calls) > 100
    got_fns, got_edges = reach.code_graph(df)
    assert sorted((x.qualified_name, x.start_line) for x in got_fns.collect()) == sorted(fns)
    assert sorted(tuple(x) for x in got_edges.collect()) == sorted(edges)
    got = [(x.file_path, x.line_no, x.function, len(x.args), tuple(k.split("=")[0].strip() for k in x.keywords)) for x in detect.call_sites(df).collect()]
    assert sorted(got) == sorted(calls)


def test_other_languages(spark, monkeypatch):
    monkeypatch.setattr(scan, "BLOCK", 2)
    code = {
        "a.c": ["int a = MD5(x); /* open MD5(y)", "  MD5(z) */ RSA_new(\"a\\\\\", 'c', \"q // \\\" (\" ); // RSA_free()", "#define K NID_sha1 /* c */", 'char *s = "one \\', 'MD5(two)"; RSA_sign(', "1);"],
        "b.js": ["const s = `x ${MD5(1)}", "still crypto.createHash('md5')`; crypto.createHash(", "  'sha1')"],
        "C.java": ['String s = """', "  MD5(1)", '  """; MessageDigest.getInstance("MD5");'],
        "d.txt": ["x(1) // y(2)"],
    }
    df = spark.createDataFrame([(p, i + 1, line) for p, ls in code.items() for i, line in enumerate(ls)], LINES)
    got = {(x.file_path, x.line_no, x.function, tuple(x.args)) for x in detect.call_sites(df).collect()}
    assert got == {("a.c", 1, "MD5", ("x",)), ("a.c", 2, "RSA_new", ("a\\\\", "c", 'q // \\" (')), ("a.c", 5, "RSA_sign", ("1",)), ("b.js", 2, "createHash", ("sha1",)), ("C.java", 3, "getInstance", ("MD5",)), ("d.txt", 1, "x", ("1",))}
    assert {x.code for x in lexer.lexed(df).filter("file_path = 'a.c' AND line_no = 3").collect()} == {"#define K NID_sha1  "}
    empty = spark.createDataFrame([], LINES)
    assert lexer.statements(empty).count() == 0 and detect.call_sites(empty).count() == 0
    null = spark.createDataFrame([("a.py", 1, None), ("a.py", 1, None), ("a.py", 2, "f(1)"), ("a.py", 2, "f(1)")], LINES)
    assert lexer.statements(null).count() == 4


def test_sizes_and_receivers_over_lines(spark):
    code = ["k = rsa.generate_private_key(", "    public_exponent=65537,", "    key_size=3072)", "hashlib.x.md5(a)", "hashlib.md5(a)", "x = hashlib.new(", '  "sha1", b)']
    df = spark.createDataFrame([("a.py", i + 1, line) for i, line in enumerate(code)], LINES)
    got = {(x.line_number, x.algorithm) for x in detect.to_assets(detect.detect(df, detection.detection_table(spark))).collect()}
    assert got == {(1, "RSA-3072"), (5, "MD5"), (6, "SHA-1")}


def test_one_bad_file_stops_nothing(spark, tmp_path):
    (tmp_path / "a.py").write_bytes(b"# caf\xe9\nhashlib.md5(x)\n")
    (tmp_path / "b.py").write_text("y = 1\nz = 2")
    (tmp_path / "c.py").write_text("")
    (tmp_path / "d.py").write_text("x" * 300)
    lines = tables.read_lines(spark, str(tmp_path), 200)
    assert sorted((x.file_path[-4:], x.line_no, x.line) for x in lines.collect() if x.line) == [("a.py", 1, "# caf�"), ("a.py", 2, "hashlib.md5(x)"), ("b.py", 1, "y = 1"), ("b.py", 2, "z = 2")]
    assert {(x.file_path[-4:], x.reason) for x in tables.read_problems(spark, str(tmp_path), 200).collect()} == {("a.py", "not UTF-8"), ("d.py", "too large")}


def test_stage_that_fails_at_run_time(spark, monkeypatch):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("a.py", 1, "hashlib.md5(x)"), ("a.py", 2, "DES.new(k)")], LINES)
    real = run.risk.score
    monkeypatch.setattr(run.risk, "score", lambda a, *more, **named: real(a, *more, **named).withColumn("x", F.raise_error(F.lit("no score"))))
    out = run.run(df, skip=("reachability",))
    assert (out.status, out.failed) == ("partial", "risk") and "no score" in (out.error or "")
    assert out.completed == ["discovery", "inventory", "enrichment", "classification", "ownership"]
    assert {x.algorithm for x in out.assets.collect()} == {"MD5", "DES-56"} or out.assets.count() == 2
    assert "classification" in out.assets.columns and "risk" not in out.assets.columns


def test_symbol_rules_meet_names_by_whole_name_and_by_stems_of_any_length(spark):
    stems = ["RSA_sign", "RS", "RSA_*", "RSA*", "RS*", "R*", "*", "RSA_signer", "MD*"]
    rule = load_detection_rules(spark).filter("kind = 'c_symbol' AND language = 'c'").limit(1)
    rules = rule.drop("rule_id", "rule_function", "role").crossJoin(spark.createDataFrame([(s, s) for s in stems], "rule_id string, rule_function string")).withColumn("role", F.lit("any"))
    rules = rules.select(*rule.columns)
    lines = spark.createDataFrame([("a.c", 1, "    RSA_sign(x);"), ("a.c", 2, "    RS(x);"), ("b.c", 1, "    y = MD5_x;")], "file_path string, line_no int, line string")
    got = {(r.file_path, r.line_no, r.observed_symbol, r.rule_id) for r in detect.match_symbols(lines, rules).collect()}
    names = [("a.c", 1, "RSA_sign"), ("a.c", 1, "x"), ("a.c", 2, "RS"), ("a.c", 2, "x"), ("b.c", 1, "y"), ("b.c", 1, "MD5_x")]
    assert got == {(*n, s) for n in names for s in stems if n[2] == s or s.endswith("*") and n[2].startswith(s[:-1])}
