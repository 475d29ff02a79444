"""Call graph and reachability: graph tables, multi-source search, as-of lookup of functions, verdicts."""

from __future__ import annotations

import tempfile
import uuid
from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans import rules as R
from .lexer import lexed, statement_calls, statements
from .scan import block_scan


def scratch(spark) -> str:  # noqa: ANN001
    """The folder that spark.checkpoint.dir names; where it is unset, a temporary one in local mode and an error on a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="spark-scratch-")


def kept(df: DataFrame, name: str) -> DataFrame:
    path = f"{scratch(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def named_entry(name: Column) -> Column:
    low = F.lower(name)
    return name.isin(*R.ENTRY_NAMES) | low.isin(*R.ENTRY_NAMES) | low.startswith("handle_") | low.startswith("on_") | low.startswith("process_")


def module_of(path: Column) -> Column:
    return F.replace(F.regexp_replace(path, r"\.[A-Za-z]+$", ""), F.lit("/"), F.lit("."))


SCOPE = "array<struct<indent:int,name:string>>"


def scoped_lines(lines: DataFrame) -> DataFrame:
    """First lines of the statements of Python files, with the definitions around them: (file_path, line_no, code, scope, name, is_class, decorators).

    A statement lies in the definitions above it that no statement between has closed by an indent as small or smaller: a
    stack that each statement cuts to smaller indents and a definition grows by itself, kept by an associative scan.
    `scope` is the module with the names of all of them (null outside definitions); `name` is set on definitions, with
    the names of the decorators right above a function. A tab counts as one character of indent.
    """
    x = statements(lines).filter("language = 'python'").filter("start = line_no AND trim(code) <> ''")
    x = x.withColumns({
        "_i": F.length(F.regexp_extract("code", r"^(\s*)", 1)),
        "is_class": F.col("code").rlike(r"^\s*class\s+\w+"),
        "name": F.nullif(F.regexp_extract("code", r"^\s*(?:class|(?:async\s+)?def)\s+(\w+)", 1), F.lit("")),
        "_d": F.nullif(F.regexp_extract("code", r"^\s*@((?:\w+\.)*\w+)", 1), F.lit("")),
    }).drop("line", "language", "start")
    own = F.when(F.col("name").isNotNull(), F.array(F.struct(F.col("_i").alias("indent"), F.col("name").alias("name")))).otherwise(F.array().cast(SCOPE))
    cut = lambda stack, at: F.filter(stack, lambda d: d["indent"] < at)
    both = lambda f, g: F.struct(F.least(f["least"], g["least"]).alias("least"), F.concat(cut(f["own"], g["least"]), g["own"]).alias("own"))
    x = block_scan(x, "_open", F.struct(F.col("_i").alias("least"), own.alias("own")), F.array().cast(SCOPE), SCOPE, lambda s, a: F.concat(cut(s, a["least"]), a["own"]), both)
    # Decorators right above: kept until a statement that is neither one nor a definition.
    text = "array<string>"
    given = F.struct((F.col("_d").isNull()).alias("fresh"), F.when(F.col("_d").isNotNull(), F.array("_d")).otherwise(F.array().cast(text)).alias("own"))
    joined = lambda f, g: F.struct((f["fresh"] | g["fresh"]).alias("fresh"), F.when(g["fresh"], g["own"]).otherwise(F.concat(f["own"], g["own"])).alias("own"))
    x = block_scan(x, "_above", given, F.array().cast(text), text, lambda s, a: F.when(a["fresh"], a["own"]).otherwise(F.concat(s, a["own"])), joined)
    around = cut(F.col("_open"), F.col("_i"))
    scope = F.when(F.size(around) > 0, F.concat_ws(".", module_of(F.col("file_path")), F.transform(around, lambda d: d["name"])))
    return x.select("file_path", "line_no", "code", scope.alias("scope"), "name", "is_class", F.when(F.col("name").isNotNull() & ~F.col("is_class"), F.col("_above")).alias("decorators"))


def functions_of(lines: DataFrame, scopes: DataFrame | None = None) -> DataFrame:
    """Function table of code lines (scopes: their scoped_lines, where they are there): name qualified by all definitions around it, file, definition line, entry flag and its reason."""
    last = F.transform("decorators", lambda d: F.element_at(F.split(d, r"\."), -1))
    routed = F.exists(last, lambda d: d.rlike(R.ROUTES))
    reason = F.when(routed, F.concat(F.lit("route decorator: @"), F.get("decorators", F.lit(0)))).when(named_entry(F.col("name")), F.concat(F.lit("entry-point function name: "), F.col("name")))
    x = (scoped_lines(lines) if scopes is None else scopes).filter("name IS NOT NULL AND NOT is_class")
    full = F.concat_ws(".", F.coalesce("scope", module_of(F.col("file_path"))), "name")
    return x.select(full.alias("qualified_name"), "file_path", F.col("line_no").alias("start_line"), reason.isNotNull().alias("is_entry_point"), reason.alias("entry_reason"))


def call_edges(lines: DataFrame, scopes: DataFrame | None = None) -> DataFrame:
    """(caller, callee, call_line) of each call inside a definition (scopes: as in functions_of); a name without dots gets the module of its file, dotted names stay. Calls in a definition's own head aren't edges."""
    inside = (scoped_lines(lines) if scopes is None else scopes).filter("scope IS NOT NULL AND name IS NULL").select("file_path", F.col("line_no").cast("long").alias("start"), "scope")
    x = statement_calls(lines).filter("language = 'python'").join(inside.hint("merge"), ["file_path", "start"])
    callee = F.when(F.col("module").isNull(), F.concat(module_of(F.col("file_path")), F.lit("."), F.col("function"))).otherwise(F.concat("module", F.lit("."), "function"))
    return x.select(F.col("scope").alias("caller"), callee.alias("callee"), F.col("line_no").alias("call_line"))


def read_once(lines: DataFrame) -> DataFrame:
    """statements() of the lines, written, and lexed() before it too: each scan reads its lines twice, so scans in a row would repeat those before them. Statements come back as they are."""
    return lines if "start" in lines.columns else kept(statements(kept(lexed(lines), "lexed")), "statements")


def code_graph(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """functions_of and call_edges of the lines, written once: lines are lexed a single time, and no search works them out again."""
    read = read_once(lines)
    scopes = kept(scoped_lines(read), "scopes")
    return kept(functions_of(read, scopes), "functions"), kept(call_edges(read, scopes), "edges")


def assemble(functions: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (functions and edge ends, with entry flag) and distinct resolved edges.

    Where no function is an entry, top-level functions whose name says so become entries (the fallback).
    """
    e = resolve_callees(edges, functions)
    names = functions.groupBy("qualified_name").agg(F.max("is_entry_point").alias("is_entry_point"))
    any_entry = names.agg(F.coalesce(F.max("is_entry_point"), F.lit(False)).alias("_any"))
    parts = F.split("qualified_name", r"\.")
    fallback = (F.size(parts) == 2) & named_entry(F.element_at(parts, -1))
    entries = names.crossJoin(F.broadcast(any_entry)).select(F.col("qualified_name").alias("node"), F.when(F.col("_any"), F.col("is_entry_point")).otherwise(fallback).alias("is_entry_point"), F.lit(True).alias("defined"))
    ends = e.select(F.col("caller").alias("node")).union(e.select("callee"))
    nodes = entries.union(ends.select("node", F.lit(False), F.lit(False))).groupBy("node").agg(F.max("is_entry_point").alias("is_entry_point"), F.max("defined").alias("defined"))
    return nodes, e.select("caller", "callee", "external")


def graph_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, entry points and external nodes."""
    n = nodes.agg(F.count("*").alias("nodes"), F.count_if("is_entry_point").alias("entry_points"), F.count_if(~F.col("defined")).alias("external_nodes"))
    return n.crossJoin(F.broadcast(edges.agg(F.count("*").alias("edges"))))


def shortest_paths(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """(source, target, depth, path) of the pairs that a path of edges (caller, callee) joins; the least path of the shortest ones.

    One frontier for all sources: a hop joins it with the edges and drops what the source has seen; a source stops once
    its targets are found (left: how many aren't), and no source starts that isn't in a pair. Tables are joined by
    sorting, so none goes through the driver, and a hop reads what those before it wrote, so no task sorts for several.
    """
    e = kept(edges.select(F.col("caller").alias("node"), F.col("callee").alias("next")).dropna().distinct(), "edges").hint("merge")
    wanted = kept(pairs.select("source", F.col("target").alias("node")).dropna().distinct(), "pairs")
    front = wanted.groupBy("source").agg(F.count("*").alias("left"), F.max(F.col("source") == F.col("node")).alias("hit"))
    new = kept(front.select("source", F.col("source").alias("node"), F.lit(0).alias("depth"), F.array("source").alias("path"), "left", "hit"), "front")
    targets = wanted.withColumn("hit", F.lit(True)).hint("merge")
    seen, found = new.select("source", "node"), new.filter("hit")
    for depth in count(1):  # a hop finds nodes not seen before or ends the search
        met = new.filter("hit").groupBy("source").agg(F.count("*").alias("_n"))
        front = new.join(met.hint("merge"), "source", "left").withColumn("left", F.col("left") - F.coalesce("_n", F.lit(0))).filter("left > 0")
        step = front.join(e, "node").select("source", F.col("next").alias("node"), "left", F.concat("path", F.array("next")).alias("path"))
        step = step.groupBy("source", "node").agg(F.min("path").alias("path"), F.first("left").alias("left"))
        step = step.join(seen.hint("merge"), ["source", "node"], "left_anti").join(targets, ["source", "node"], "left")
        new = kept(step.select("source", "node", F.lit(depth).alias("depth"), "path", "left", F.coalesce("hit", F.lit(False)).alias("hit")), "front")
        if new.isEmpty():
            break
        seen, found = seen.unionByName(new.select("source", "node")), found.unionByName(new.filter("hit"))
        if depth % 8 == 0:
            seen, found = kept(seen, "seen"), kept(found, "found")
    return found.select("source", F.col("node").alias("target"), "depth", "path")


def resolve_callees(calls: DataFrame, functions: DataFrame) -> DataFrame:
    """(caller, callee, external): a known name, else for a name without dots one of the caller's module, else an external node."""
    known = functions.select("qualified_name").distinct().hint("merge")
    module = F.regexp_extract("caller", r"^(.*)\.[^.]*$", 1)
    local = F.when(~F.col("callee").contains(".") & (module != ""), F.concat(module, F.lit("."), F.col("callee")))
    x = calls.select("caller", "callee", F.coalesce(local, "callee").alias("_l"))  # not null, so such rows spread by their name
    x = x.join(known.select(F.col("qualified_name").alias("callee"), F.lit(True).alias("_k")), "callee", "left")
    x = x.join(known.select(F.col("qualified_name").alias("_l"), F.lit(True).alias("_m")), "_l", "left")
    found = F.when(F.col("_k").isNull() & F.col("_m").isNotNull(), F.col("_l")).otherwise(F.col("callee"))
    return x.select("caller", found.alias("callee"), (F.col("_k").isNull() & F.col("_m").isNull()).alias("external")).distinct()


def search(functions: DataFrame, calls: DataFrame) -> DataFrame:
    """(node, depth, entry_ord, path) of every node reachable from an entry point; ties go to the earliest entry, then the least path.

    A frontier loop: each hop joins the frontier with the edges and drops nodes already seen. Stored tables cut lineage.
    """
    edges = kept(resolve_callees(calls, functions).select(F.col("caller").alias("node"), F.col("callee").alias("next")), "edges")
    front = functions.filter("is_entry_point").groupBy(F.col("qualified_name").alias("node")).agg(F.min("fn_ord").alias("entry_ord"))
    front = kept(front.select("node", F.lit(0).alias("depth"), "entry_ord", F.array("node").alias("path")), "front")
    seen = front
    for depth in count(1):  # a hop finds nodes not seen before or ends the search
        step = front.join(edges, "node").select(F.col("next").alias("node"), F.lit(depth).alias("depth"), "entry_ord", F.concat("path", F.array("next")).alias("path"))
        step = step.groupBy("node").agg(F.min(F.struct("depth", "entry_ord", "path")).alias("b")).select("node", "b.*")
        front = kept(step.join(seen.select("node"), "node", "left_anti"), "front")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
        if depth % 8 == 0:
            seen = kept(seen, "seen")
    return seen


def containing_function(assets: DataFrame, functions: DataFrame) -> DataFrame:
    """Assets with the function of their file that starts at or before their line, latest first; ties to the greatest name.

    Files are the same if their paths are equal or one ends in / and the other. An as-of join: both tables are merged per
    file and line and the last function is carried forward. Only paths without an equal one meet the others, by their
    last part; the paths are distinct ones, and many functions of a file are no more than one row there.
    """
    files = functions.select(F.col("file_path").alias("fn_path")).distinct()
    own = assets.select("file_path").distinct()
    same = own.join(files, F.col("file_path") == F.col("fn_path"))
    last = lambda c: F.element_at(F.split(c, "/"), -1)
    others = own.join(files, F.col("file_path") == F.col("fn_path"), "left_anti").withColumn("_l", last("file_path"))
    suffix = others.join(files.withColumn("_l", last("fn_path")), "_l").filter(F.endswith("fn_path", F.concat(F.lit("/"), "file_path")) | F.endswith("file_path", F.concat(F.lit("/"), "fn_path")))
    pairs = same.union(suffix.select("file_path", "fn_path"))
    placed = functions.join(pairs, functions["file_path"] == pairs["fn_path"]).select(pairs["file_path"].alias("file_path"), F.col("start_line").cast("int").alias("line_number"), "qualified_name")
    fn = placed.groupBy("file_path", "line_number").agg(F.max("qualified_name").alias("_f")).select("file_path", "line_number", F.lit(0).alias("_k"), "_f", F.lit(None).cast("long").alias("seq"))
    at = assets.select("file_path", "line_number", F.lit(1).alias("_k"), F.lit(None).cast("string").alias("_f"), "seq")
    w = Window.partitionBy("file_path").orderBy("line_number", "_k").rowsBetween(Window.unboundedPreceding, 0)
    return fn.union(at).withColumn("function", F.last("_f", ignorenulls=True).over(w)).filter("_k = 1").select("seq", "file_path", "line_number", "function")


def verdicts(assets: DataFrame, functions: DataFrame, calls: DataFrame) -> DataFrame:
    """(seq, function, reachable, depth, path, entry): true on a path from an entry, else false.

    Null off source code, outside functions and where no function is an entry at all. A verdict that an asset of another
    surface brings along in a column `reachable` (infrastructure is set to true when it is found) stays.
    """
    src = assets.filter(F.col("source_surface") == "source_code")
    found = containing_function(src, functions).join(search(functions, calls).select(F.col("node").alias("function"), "depth", "path"), "function", "left")
    entries = functions.agg(F.coalesce(F.max("is_entry_point"), F.lit(False)).alias("_any"))
    unknown = F.col("function").isNull() | ~F.col("_any")
    judged = found.crossJoin(F.broadcast(entries)).select("seq", "function", F.when(unknown, F.lit(None).cast("boolean")).otherwise(F.col("depth").isNotNull()).alias("_r"), "depth", "path", F.get("path", F.lit(0)).alias("entry"))
    given = F.col("reachable") if "reachable" in assets.columns else F.lit(None).cast("boolean")
    kept = assets.select("seq", F.when(F.col("source_surface") != "source_code", given).alias("_g"))
    return kept.join(judged, "seq", "left").select("seq", "function", F.coalesce("_g", "_r").alias("reachable"), "depth", "path", "entry")


def context(surface: Column, function: Column, any_entry: Column, reachable: Column, path: Column, what: Column, location: Column) -> Column:
    """Text on how an asset is exposed: another surface, no function around it, no entry at all, a path, or none."""
    unknown = lambda why: F.concat(F.lit("Reachability undetermined for "), what, F.lit(" at "), location, F.lit(": "), why)
    return (
        F.when(surface != "source_code", unknown(F.concat(F.lit("surface '"), surface, F.lit("' is outside the call graph"))))
        .when(function.isNull(), unknown(F.lit("no containing function in the call graph")))
        .when(~any_entry, F.concat(F.lit("No entry points in the call graph, reachability undetermined for "), what, F.lit(" at "), location))
        .when(reachable, F.concat(F.lit("Reachable from entry point '"), F.get(path, F.lit(0)), F.lit("' via: "), F.array_join(path, " → "), F.lit(" ["), what, F.lit(" at "), location, F.lit("]")))
        .otherwise(F.concat(F.lit("No call-graph path from any entry point to "), what, F.lit(" at "), location))
    )


def report(judged: DataFrame, nodes: DataFrame | None = None, edges: DataFrame | None = None) -> DataFrame:
    """One row: counts of the three verdicts, their rate without the unknown, and of the graph where it is given."""
    r = judged.agg(F.count("*").alias("total"), F.count_if("reachable").alias("reachable"), F.count_if(~F.col("reachable")).alias("unreachable"), F.count_if(F.col("reachable").isNull()).alias("unknown"))
    known = F.col("reachable") + F.col("unreachable")
    r = r.withColumn("rate", F.round(F.when(known > 0, F.col("reachable") / known).otherwise(0.0), 4))
    return r if nodes is None or edges is None else r.crossJoin(F.broadcast(graph_counts(nodes, edges)))


def entry_list(nodes: DataFrame) -> DataFrame:
    return nodes.filter("is_entry_point").select(F.col("node").alias("entry_point")).orderBy("entry_point")
