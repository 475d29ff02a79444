"""Document fingerprints: a Merkle tree of clauses, paragraphs and sections for each text.

Equal texts have equal roots; where roots differ, the differing sections, paragraphs and clauses locate the edit.
DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let, text_of

#: A clause: up to 16 words, or fewer where one of them ends in a mark, with the white space behind.
CLAUSE = r"(?:\S++\s++){0,15}?\S*[.!?,;:|](?:\s++|$)|(?:\S++\s++){0,15}\S++\s*|\s+"
#: Rows of one neighbour bucket, so that a window's partition stays small at any table size.
BUCKET_ROWS = 2000
#: Quantiles of the ids that the plan holds at most; buckets within two of them divide the ids between evenly.
CUTS = 1000
_LOW = -(2**63)


def tree(text: Column) -> Column:
    """Nested nodes: array<struct<node, paragraphs: array<struct<node, leaves: array<bigint>>>>>. The cuts keep every character; a leaf is a clause's 64-bit digest."""
    node = lambda kids: F.sha2(F.array_join(kids, " "), 256)

    def paragraph(p: Column) -> Column:
        clauses = F.regexp_extract_all(p, F.lit(CLAUSE), F.lit(0))
        return F.struct(F.sha2(p, 256).alias("node"), F.transform(clauses, lambda s: F.xxhash64(s)).alias("leaves"))

    def section(s: Column) -> Column:
        return let(F.transform(F.split(s, r"(?<=\n)(?=.)", -1), paragraph), lambda x: F.struct(node(x["node"]).alias("node"), x.alias("paragraphs")))

    return F.transform(F.split(text, r"(?s)(?<=\n\n)(?=.)", -1), section)


def fingerprint_of(text: Column) -> Column:
    """struct<root, sections, leaves>: the root over the section nodes, the tree below it, and its leaves in order."""
    leaves = lambda t: F.flatten(F.transform(t, lambda s: F.flatten(s["paragraphs"]["leaves"])))
    return let(tree(text), lambda t: F.struct(F.sha2(F.array_join(t["node"], " "), 256).alias("root"), t.alias("sections"), leaves(t).alias("leaves")))


def written(f: Column) -> Column:
    """`root:section/section...`, a section as `node=paragraph;paragraph...`, a paragraph as `node,leaf.leaf...`.

    The root has 64 hexadecimal digits, nodes their first 16, leaves are 64-bit hexadecimal numbers: enough to tell what is
    equal within two texts, while the roots tell whether they are equal.
    """
    short = lambda x: F.substring(x["node"], 1, 16)
    paragraph = lambda p: F.concat(short(p), F.lit(","), F.array_join(F.transform(p["leaves"], lambda x: F.hex(x)), "."))
    section = lambda s: F.concat(short(s), F.lit("="), F.array_join(F.transform(s["paragraphs"], paragraph), ";"))
    return F.concat(f["root"], F.lit(":"), F.array_join(F.transform(f["sections"], section), "/"))


def read(fingerprint: Column) -> Column:
    """The tree of a written fingerprint: array<struct<node, paragraphs: array<struct<node, leaves: array<string>>>>>; null has no section."""
    cut = lambda x, mark, k: F.substring_index(x, mark, k)
    paragraph = lambda p: F.struct(cut(p, ",", 1).alias("node"), F.filter(F.split(cut(p, ",", -1), r"\."), lambda x: x != "").alias("leaves"))
    section = lambda s: F.struct(cut(s, "=", 1).alias("node"), F.transform(F.split(cut(s, "=", -1), ";"), paragraph).alias("paragraphs"))
    return F.transform(F.when(fingerprint.isNull(), F.expr("array()").cast("array<string>")).otherwise(F.split(cut(fingerprint, ":", -1), "/")), section)


def located_edits(pairs: DataFrame, a: str, b: str, id_col: str = "doc_id") -> DataFrame:
    """(id, section, paragraph, clause), from 0, of a's clauses that b lacks, for rows with two written fingerprints; no text is needed.

    The walk goes down level by level with an anti-join at each: rows with equal roots are left out, then sections whose
    node b has, then paragraphs, then clauses. A text's clauses are rows, so a very long one spreads over tasks. Repeated
    rows count once; rows that share an id but not their fingerprints stay apart, and a null id is an id. A null
    fingerprint has nothing to find or to offer. Other columns aren't read, whatever their names.
    """
    root = lambda c: F.coalesce(F.substring_index(F.col(c), ":", 1), F.lit(""))
    x = pairs.select(F.col(id_col).alias("_id"), F.col(a).alias("_a"), F.col(b).alias("_b"))
    x = x.withColumn("_k", F.concat_ws("|", F.coalesce(F.col("_id").cast("string"), F.lit("-")), root("_a"), root("_b")))
    x = x.filter(root("_a") != root("_b")).dropDuplicates(["_k"])
    own = x.select("_id", "_k", F.posexplode(read(F.col("_a"))).alias("section", "_s"))
    other = x.select("_k", F.explode(read(F.col("_b"))).alias("_s"))
    pars = lambda df, *more: df.select("_k", *more, F.posexplode("_s.paragraphs").alias("paragraph", "_p"))
    open_ = _lacking(own, other, F.col("_s.node"))
    open_ = _lacking(pars(open_, "_id", "section"), pars(other), F.col("_p.node"))
    clauses = open_.select("_id", "_k", "section", "paragraph", F.posexplode("_p.leaves").alias("clause", "_leaf"))
    left = _lacking(clauses, pars(other).select("_k", F.explode("_p.leaves").alias("_leaf")), F.col("_leaf"))
    return left.select(F.col("_id").alias(id_col), "section", "paragraph", "clause")


def _lacking(mine: DataFrame, theirs: DataFrame, what: Column) -> DataFrame:
    """Rows of mine whose `what` no row of theirs with the same key has."""
    return mine.withColumn("_w", what).join(theirs.select("_k", what.alias("_w")), ["_k", "_w"], "left_anti").drop("_w")


def likeness(a: Column, b: Column) -> Column:
    """Share of leaves that two fingerprints have in common: of the distinct leaves (Dice), or of the leaves place by place, whichever is larger; 1 if the roots are equal."""

    def share(x: Column) -> Column:
        sets = let(F.struct(F.array_distinct(x["a"]).alias("a"), F.array_distinct(x["b"]).alias("b")), lambda y: F.lit(2.0) * F.size(F.array_intersect(y["a"], y["b"])) / (F.size(y["a"]) + F.size(y["b"])))
        placed = F.lit(2.0) * F.size(F.filter(F.arrays_zip(x["a"], x["b"]), lambda y: y["a"] == y["b"])) / (F.size(x["a"]) + F.size(x["b"]))
        return F.greatest(sets, placed)

    both = let(F.struct(a["leaves"].alias("a"), b["leaves"].alias("b")), share)
    return F.when(a["root"] == b["root"], F.lit(1.0)).otherwise(both)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_chars, fingerprint) for every row; null text counts as empty, which has no leaves. Other columns aren't read, whatever their names."""
    t = text_of(text_col)
    return docs.select(F.col(id_col), F.length(t).cast("long").alias("n_chars"), written(fingerprint_of(t)).alias("fingerprint"))


def differing_branches(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """For rows with two texts: positions (section, paragraph, clause) of a's leaves that the paragraphs of b lack.

    The walk goes down from the roots: sections whose node b has anywhere are left out whole, then paragraphs, and only
    in the others are clauses compared. Columns of the input stay; `differing` is replaced.
    """
    told = lambda s, i: F.transform(s["paragraphs"], lambda p, j: F.struct(i.alias("section"), j.alias("paragraph"), s["node"].alias("above"), p["node"].alias("node"), p["leaves"].alias("leaves")))
    kept = [c for c in pairs.columns if c != "differing"]
    sides = F.struct(tree(text_of(a)).alias("a"), tree(text_of(b)).alias("b"))

    def walk(x: Column) -> Column:
        left = F.flatten(F.transform(x["a"], told))
        pars = F.flatten(F.transform(x["b"], lambda s: s["paragraphs"]["node"]))
        leaves = F.flatten(F.transform(x["b"], lambda s: F.flatten(s["paragraphs"]["leaves"])))
        open_ = F.filter(left, lambda p: ~F.array_contains(x["b"]["node"], p["above"]) & ~F.array_contains(pars, p["node"]))
        clauses = lambda p: F.filter(F.transform(p["leaves"], lambda v, k: F.struct(p["section"].alias("section"), p["paragraph"].alias("paragraph"), k.alias("clause"), v.alias("leaf"))), lambda c: ~F.array_contains(leaves, c["leaf"]))
        return F.flatten(F.transform(open_, clauses))

    return pairs.select(*[F.col(f"`{c}`") for c in kept], F.transform(let(sides, walk), lambda c: F.struct(c["section"], c["paragraph"], c["clause"])).alias("differing"))


def edited_against_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_rows: int = BUCKET_ROWS, max_cuts: int = CUTS) -> DataFrame:
    """Fingerprints of every text and of its edit with the start of the next text in descending id order.

    Neighbours are found in id buckets of about `bucket_rows` rows: at most `max_cuts` quantiles of the ids cut ranges,
    and each range is cut evenly by its ids. The first row of the bucket below serves a bucket's last row, and the
    highest row serves the lowest. Repeated ids are ordered by text; a null id is the lowest. Null text counts as empty;
    long texts are taken whole. An empty table gives an empty table; a single row is its own next one. Other columns
    aren't read, whatever their names.
    """
    base = docs.select(F.col(id_col).cast("long").alias("_id"), text_of(text_col).alias("_t")).withColumn("_low", F.coalesce("_id", F.lit(_LOW)))
    n = base.count()
    parts = max(1, -(-n // bucket_rows))
    ranges = min(parts, max_cuts)
    asked = [i / ranges for i in range(ranges + 1)]
    cuts = sorted(set(base.select(F.percentile_approx("_low", asked, min(1_000_000, 100 * ranges))).first()[0] or []))
    rows = base.withColumns(dict(zip(("_r", "_b"), _bucket(F.col("_low"), cuts, -(-parts // ranges)), strict=True)))
    heads = rows.groupBy("_r", "_b").agg(F.max_by(F.struct("_id", "_t"), F.struct("_low", "_t"))["_t"].alias("_ht"))
    # Each bucket's text below comes from the bucket before it in its range, else from the last bucket of a lower range, else from the top.
    ids = heads.select("_r", "_b").withColumn("_prev", F.lag("_b").over(Window.partitionBy("_r").orderBy("_b")))
    tops = ids.groupBy("_r").agg(F.max("_b").alias("_max"))  # a row for each range, of which there are few
    tops = tops.select("_r", F.lag("_max").over(Window.orderBy("_r")).alias("_lower"), F.max("_max").over(Window.partitionBy()).alias("_top"))
    link = ids.join(tops, "_r").select("_b", F.coalesce("_prev", "_lower", "_top").alias("_from"))
    below = link.join(heads.select(F.col("_b").alias("_from"), "_ht"), "_from").select("_b", "_ht")
    w = Window.partitionBy("_b").orderBy(F.col("_low").desc(), F.col("_t").desc())
    rows = rows.select("_id", "_t", "_b", F.lead("_t").over(w).alias("_next")).join(below, "_b")
    k = F.floor(F.length("_t") / 3).cast("int")
    follows = F.coalesce("_next", "_ht")
    edited = F.concat(F.substring("_t", F.lit(1), F.length("_t") - k), F.substring(follows, F.lit(1), k))
    rows = rows.select("_id", F.length("_t").cast("long").alias("n_chars"), edited.alias("_e"), fingerprint_of(F.col("_t")).alias("_f"), fingerprint_of(follows).alias("_nf"))
    rows = rows.select("_id", "n_chars", F.sha2("_e", 256).alias("edited_sha256"), "_f", "_nf", fingerprint_of(F.col("_e")).alias("_ef"))
    return rows.select(
        F.col("_id").alias(id_col),
        "n_chars",
        "edited_sha256",
        written(F.col("_f")).alias("fingerprint"),
        written(F.col("_ef")).alias("edited_fingerprint"),
        likeness(F.col("_f"), F.col("_ef")).alias("near_edited"),
        likeness(F.col("_f"), F.col("_nf")).alias("near_next"),
    )


def _bucket(value: Column, cuts: list[int], pieces: int) -> tuple[Column, Column]:
    """The range of a value, and its bucket: ids of a range are cut evenly into `pieces`. Both ascend with the value."""
    if len(cuts) < 2:
        return F.lit(0).cast("long"), F.lit(0).cast("long")

    def at(lo: int, hi: int) -> Column:  # how many cuts are <= value, by a balanced tree that stays in generated code
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(value < F.lit(cuts[mid]), at(lo, mid)).otherwise(at(mid + 1, hi))

    r = F.greatest(F.lit(0), F.least(F.lit(len(cuts) - 2), at(0, len(cuts)) - 1))
    table = F.array(*[F.lit(c).cast("double") for c in cuts])
    low, high = F.get(table, r), F.get(table, r + 1)
    piece = F.floor((value.cast("double") - low) / F.greatest(high - low, F.lit(1.0)) * pieces)
    piece = F.greatest(F.lit(0), F.least(F.lit(pieces - 1), piece)).cast("long")
    return r.cast("long"), r.cast("long") * pieces + piece
