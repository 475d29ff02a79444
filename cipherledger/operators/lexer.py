"""Code of source lines without comments, literals masked, and the statements that lines form.

Both run as associative scans (scan.py). A line's lexical action says, for each state it may begin in, the state it ends
in; its bracket action adds to the depth, which never falls below 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import language_of
from .scan import block_scan

# States at the end of a line: code, in a literal between triple double or single quotes, in a double or single quoted one
# that a backslash continues, in a block comment, in a template literal.
CODE, TRIPLE, TRIPLE_SINGLE, DOUBLE, SINGLE, COMMENT, TEMPLATE = range(7)
_BODY = {
    TRIPLE: r'[^"\\]*+(?:(?:\\.|"(?!""))[^"\\]*+)*+', TRIPLE_SINGLE: r"[^'\\]*+(?:(?:\\.|'(?!''))[^'\\]*+)*+", DOUBLE: r'[^"\\]*+(?:\\.[^"\\]*+)*+',
    SINGLE: r"[^'\\]*+(?:\\.[^'\\]*+)*+", COMMENT: r"[^*]*+(?:\*(?!/)[^*]*+)*+", TEMPLATE: r"[^`\\]*+(?:\\.[^`\\]*+)*+",
}
_OPEN = {TRIPLE: '"""', TRIPLE_SINGLE: "'''", DOUBLE: '"', SINGLE: "'", COMMENT: "/*", TEMPLATE: "`"}
_QUOTED = lambda s: f"{_OPEN[s]}{_BODY[s]}{_OPEN[s]}"
_COMMENTED = rf"/\*{_BODY[COMMENT]}\*/|//.*"
#: Quotes that a backslash at the end of the line continues, and others, which end with the line.
_CUT = r"""(["'](?=.*(?<!\\)(?:\\\\)*+\\$))"""
#: Tokens of a line that begins in code; group 1 is what opens a literal or comment that goes on, group 2 a quote that nothing closes.
TOKENS = {
    "python": rf"[rRbBuUfFtT]{{0,2}}(?:{_QUOTED(TRIPLE)}|{_QUOTED(TRIPLE_SINGLE)}|(?!\"\"\"){_QUOTED(DOUBLE)}|(?!'''){_QUOTED(SINGLE)}|(?:(\"\"\"|'''|{_CUT[1:-1]})|([\"'])).*)|#.*|\w++|[^\w\"'#]++",
    "java": rf"{_QUOTED(TRIPLE)}|(?!\"\"\"){_QUOTED(DOUBLE)}|{_QUOTED(SINGLE)}|{_COMMENTED}|(?:(\"\"\"|/\*|{_CUT[1:-1]})|([\"'])).*|[^\"'/]++|/",
    "javascript": rf"{_QUOTED(DOUBLE)}|{_QUOTED(SINGLE)}|{_QUOTED(TEMPLATE)}|{_COMMENTED}|(?:(`|/\*|{_CUT[1:-1]})|([\"'])).*|[^\"'`/]++|/",
    "c": rf"(?:u8|[uUL])?(?:{_QUOTED(DOUBLE)}|{_QUOTED(SINGLE)})|{_COMMENTED}|(?:(/\*|{_CUT[1:-1]})|([\"'])).*|\w++|[^\w\"'/]++|/",
}


def _tokens(text: Column, group: int) -> Column:
    """Tokens by the line's language; files of unknown language are read as C. Lines of a file come together, so the pattern is seldom compiled."""
    pattern = F.lit(TOKENS["c"])
    for name in ("python", "java", "javascript"):
        pattern = F.when(F.col("language") == name, F.lit(TOKENS[name])).otherwise(pattern)
    return F.regexp_extract_all(text, pattern, F.lit(group))


def _end_state(text: Column) -> Column:
    """State at the end of a text that begins in code."""
    by_opener = F.create_map(*[F.lit(x) for s, mark in _OPEN.items() for x in (mark, s)])
    return F.coalesce(F.try_element_at(by_opener, F.try_element_at(_tokens(text, 1), F.lit(-1))), F.lit(CODE))


def _closing(s: int) -> str:
    return f"^{_BODY[s]}{r'\*/' if s == COMMENT else _OPEN[s]}"


def _after(text: Column, s: int) -> Column:
    """What is left of a line that begins in state s, null if the state goes on."""
    return F.when(text.rlike(_closing(s)), F.regexp_replace(text, _closing(s), "")) if s else text


def _action(text: Column) -> Column:
    """State after the line for each state before it."""
    ends = [F.when(text.rlike("[\"'`]|/[*]"), _end_state(text)).otherwise(CODE)]
    for s in range(1, 7):
        stays = F.lit(s) if s not in (DOUBLE, SINGLE) else F.when(text.rlike(r"(?<!\\)(?:\\\\)*\\$"), s).otherwise(CODE)
        ends.append(F.when(text.rlike(_closing(s)), _end_state(F.regexp_replace(text, _closing(s), ""))).otherwise(stays))
    return F.array(*[e.cast("int") for e in ends])


def _masked(text: Column) -> Column:
    """Code of a text that begins in code: each literal as hexadecimal digits between double quotes, comments gone, an open literal as an empty one."""
    python = F.col("language") == "python"

    def token(t: Column, opener: Column) -> Column:
        body = F.regexp_replace(t, "^[A-Za-z0-9]*", "")
        skip = F.when(body.startswith('"""') | body.startswith("'''"), 3).otherwise(1)
        content = F.substring(body, skip + 1, F.length(body) - 2 * skip)
        literal = F.when(opener != "", '""').otherwise(F.concat(F.lit('"'), F.hex(F.encode(content, "UTF-8")), F.lit('"')))
        comment = F.when(opener != "", "").otherwise(" ")
        return F.when(t.startswith("/*"), comment).when((python & t.startswith("#")) | t.startswith("//"), "").when(t.rlike("^[A-Za-z0-9]{0,2}[\"'`]"), literal).otherwise(t)

    pairs = F.arrays_zip(_tokens(text, 0).alias("t"), _tokens(text, 1).alias("o"), _tokens(text, 2).alias("c"))
    marked = F.array_join(F.transform(pairs, lambda x: token(x["t"], F.concat(x["o"], x["c"]))), "")
    return F.when(text.rlike("[\"'`#]|/[*/]"), marked).otherwise(text)


def lexed(lines: DataFrame) -> DataFrame:
    """(file_path, line_no, line, language, code, inside, _block): what is left of each line without comments, its literals masked; inside: it begins in a literal.

    Literals and comments are followed over lines, with escapes, prefixes and continued quotes. A null line is empty; files
    of other languages have a null language and are read as C. A table of lexed lines or statements comes back as it is.
    """
    if "code" in lines.columns:
        return lines
    x = lines.select("file_path", "line_no", F.coalesce("line", F.lit("")).alias("line"), language_of(F.col("file_path")).alias("language"))
    text = F.col("line")
    x = block_scan(x, "_in", _action(text), F.lit(CODE), "int", lambda s, a: F.get(a, s), lambda f, g: F.transform(f, lambda s: F.get(g, s)))
    rest = F.when(F.col("_in") == CODE, text)
    for s in range(1, 7):
        rest = rest.when(F.col("_in") == s, _after(text, s))
    lead = F.when((F.col("_in") == COMMENT) & (F.col("_rest") != ""), " ").otherwise("")
    x = x.withColumn("_rest", F.coalesce(rest, F.lit(""))).withColumn("code", F.concat(lead, _masked(F.col("_rest"))))
    return x.select("file_path", "line_no", "line", "language", "code", F.col("_in").isin(TRIPLE, TRIPLE_SINGLE, DOUBLE, SINGLE, TEMPLATE).alias("inside"), "_block")


def _bracket_action() -> Column:
    """(add, least, join): depth d becomes max(d + add, least); join: a backslash joins the next line. A definition at the margin of a Python file starts afresh."""
    python = F.col("language") == "python"
    marks = F.regexp_replace(F.regexp_replace("code", r"[^()\[\]{}]", ""), F.when(python, "~").otherwise(r"[{}]"), "")
    zero = F.struct(F.lit(0).alias("add"), F.lit(0).alias("least"))
    moved = lambda a, c: F.when(c.rlike(r"[(\[{]"), F.struct((a["add"] + 1).alias("add"), (a["least"] + 1).alias("least"))).otherwise(F.struct((a["add"] - 1).alias("add"), F.greatest(a["least"] - 1, F.lit(0)).alias("least")))
    a = F.when(marks == "", zero).otherwise(F.aggregate(F.split(marks, "(?<=.)(?=.)", -1), zero, moved))
    fresh = python & F.col("code").rlike(r"^(?:def|class|async\s+def)\b|^@\w")
    add = F.when(fresh, F.lit(-(1 << 40))).otherwise(a["add"].cast("long"))
    return F.struct(add.alias("add"), a["least"].cast("long").alias("least"), F.col("code").rlike(r"\\$").alias("join"))


def statements(lines: DataFrame) -> DataFrame:
    """lexed() with `start`: the first line of the statement that a line belongs to.

    A line goes on with a statement where a literal or bracket is open before it, or a backslash joins it. Braces count in Python
    alone; elsewhere they hold blocks. A table of statements comes back as it is.
    """
    if "start" in lines.columns:
        return lines
    x = lexed(lines)
    state = "struct<depth:bigint,join:boolean>"
    act = lambda s, a: F.struct(F.greatest(s["depth"] + a["add"], a["least"]).alias("depth"), a["join"].alias("join"))
    both = lambda f, g: F.struct((f["add"] + g["add"]).alias("add"), F.greatest(f["least"] + g["add"], g["least"]).alias("least"), g["join"].alias("join"))
    x = block_scan(x, "_at", _bracket_action(), F.struct(F.lit(0).cast("long").alias("depth"), F.lit(False).alias("join")), state, act, both)
    fresh = (F.col("language") == "python") & F.col("code").rlike(r"^(?:def|class|async\s+def)\b|^@\w")
    x = x.withColumn("_own", F.when((fresh | ((F.col("_at.depth") <= 0) & ~F.col("_at.join"))) & ~F.col("inside"), F.col("line_no").cast("long")))
    x = block_scan(x.drop("_at"), "_from", F.col("_own"), F.lit(None), "bigint", lambda s, a: F.coalesce(a, s), lambda f, g: F.coalesce(g, f))
    return x.select("file_path", "line_no", "line", "language", "code", F.coalesce("_own", "_from", F.col("line_no").cast("long")).alias("start"), "_block")


#: Text between brackets, up to eight deep; possessive, so long texts need no stack.
_INNER = r"[^()\[\]{}]*+"
for _ in range(8):
    _INNER = rf"[^()\[\]{{}}]*+(?:[(\[{{]{_INNER}[)\]}}][^()\[\]{{}}]*+)*+"
#: Receiver, name and arguments; arguments are looked at only, so nested calls are found too.
CALL = rf"(?:([A-Za-z_][\w.]*)\.)?\b([A-Za-z_]\w*)\((?=({_INNER}))"
#: Where a line begins in the text of a statement: its number, and its first characters in hexadecimal.
LINE = r"\x01(\d+):([0-9A-F]*)\x02"
_NAMES = r"^(?:(.*)\.)?([^.]*)\($"
_ARGUMENT = rf"(?:[^,()\[\]{{}}]|[(\[{{]{_INNER}[)\]}}]?)++"


def statement_calls(lines: DataFrame, snippet: int = 512) -> DataFrame:
    """(file_path, line_no, pos, language, start, snippet, siblings, module, function, raw) of each call, over as many lines as it takes.

    line_no: where the call begins; pos: its place among the calls of its statement; siblings: of the whole statement;
    raw: its arguments up to the bracket that closes it (or the first one that nothing closes), literals
    masked. A statement is a row, at most a file; an exploded row holds no more of it than its own arguments.
    """
    x = statements(lines).filter("code <> ''")
    part = F.struct("line_no", F.hex(F.encode(F.substring("line", 1, snippet), "UTF-8")).alias("line"), F.regexp_replace("code", r"\\$", " ").alias("code"))
    x = x.groupBy("file_path", "language", "start").agg(F.array_sort(F.collect_list(part)).alias("parts"))
    code = F.array_join("parts.code", " ")
    marked = F.array_join(F.transform("parts", lambda p: F.concat(F.lit("\x01"), p["line_no"].cast("string"), F.lit(":"), p["line"], F.lit("\x02"), p["code"])), "")
    text = F.regexp_replace(marked, r"\b(def|class)\s+\w+", "$1 ")  # a definition is no call
    # A token is a mark of LINE or what stands before a call's bracket; its parts are read from it, so the text is matched twice only.
    found = F.arrays_zip(*[F.regexp_extract_all(text, F.lit(f"{LINE}|{CALL}"), F.lit(k)).alias(n) for k, n in ((0, "t"), (5, "a"))])
    x = x.filter(code.contains("(")).select("file_path", "language", "start", siblings(code).alias("siblings"), F.posexplode(found).alias("_i", "s"))
    along = Window.partitionBy("file_path", "language", "start").orderBy("_i")
    mark = F.col("s.t").startswith("\x01")
    x = x.withColumn("_on", F.last(F.when(mark, F.col("s.t")), ignorenulls=True).over(along))
    x = x.withColumn("pos", F.sum(F.when(mark, 0).otherwise(1)).over(along) - 1).filter(~mark)
    return x.select(
        "file_path",
        F.regexp_extract("_on", LINE, 1).cast("int").alias("line_no"),
        F.col("pos").cast("int").alias("pos"),
        "language",
        "start",
        F.decode(F.unhex(F.regexp_extract("_on", LINE, 2)), "UTF-8").alias("snippet"),
        "siblings",
        F.nullif(F.regexp_extract("s.t", _NAMES, 1), F.lit("")).alias("module"),
        F.regexp_extract("s.t", _NAMES, 2).alias("function"),
        F.regexp_replace("s.a", "\x01[^\x02]*\x02", " ").alias("raw"),
    )


def siblings(code: Column) -> Column:
    """Identifiers of a statement: distinct, below 80 characters, the first eight."""
    tokens = F.regexp_extract_all(F.regexp_replace(code, '"[0-9A-F]*"', '""'), F.lit(r"[A-Za-z_]\w*"), F.lit(0))
    return F.slice(F.array_distinct(F.filter(tokens, lambda t: F.length(t) < 80)), 1, 8)


def arguments(raw: Column) -> Column:
    """Arguments of a call, cut at commas outside brackets."""
    parts = F.regexp_extract_all(raw, F.lit(_ARGUMENT), F.lit(0))
    return F.filter(F.transform(parts, lambda a: F.trim(a)), lambda a: a != "")
