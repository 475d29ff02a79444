"""A whole run over code lines and assets of other surfaces: stages in order, with switches, and what was reached where one fails."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import classify, detect, enrich, inventory, reach, reads, risk
from ..sources.rule_files import RuleTables, load_detection_rules

#: Stages that a caller may leave out.
OPTIONAL = ("enrichment", "ownership", "reachability")
#: Stages that add columns without a shuffle.
NARROW = ("enrichment", "classification", "risk", "recommendation")


@dataclass
class Result:
    """Assets after the last stage that ended, stages done, and the stage that failed with its error."""

    assets: DataFrame | None = None
    completed: list[str] = field(default_factory=list)
    failed: str | None = None
    error: str | None = None
    tables: dict[str, DataFrame] = field(default_factory=dict)

    @property
    def status(self) -> str:
        return "complete" if self.failed is None else "partial" if self.completed else "failed"


def numbered(assets: DataFrame) -> DataFrame:
    """Findings of code lines with the seq of their place: file, line, position and rule."""
    place = F.struct("file_path", "line_number", "pos", "rule_id")
    return assets.withColumn("seq", F.xxhash64(F.to_json(place)).bitwiseAND(F.lit((1 << 62) - 1)))


def discover(lines: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """The source surface alone: findings of code lines as assets."""
    return numbered(detect.to_assets(detect.detect(lines, load_detection_rules(lines.sparkSession) if rules is None else rules)))


def merged(findings: DataFrame) -> DataFrame:
    """Deduplicated findings; where they carry something that a displaced record can hand on, such blanks are filled."""
    handed_on = any(g[0] in findings.columns for g in inventory.BLANKS)
    return inventory.winners(inventory.levels(findings)) if handed_on else inventory.deduplicate(findings)


def run(lines: DataFrame, others: dict[str, DataFrame] | None = None, *, rules: DataFrame | None = None, tables: RuleTables | None = None, owner_rules: DataFrame | None = None, answers: DataFrame | None = None, skip: tuple[str, ...] = (), greenfield: bool = False, more: dict[str, Callable[[DataFrame], DataFrame]] | None = None) -> Result:
    """Runs the stages in order; a stage that fails leaves the rows of the stage before it, and its name.

    others: assets of other surfaces by name, with seq and the columns that a finding has. answers: (seq, raw) of the
    enrichment's responder. tables: a user's rule tables, of which `rules` is the detection part. more: further stages by name, put behind the others. What a stage gives is written to the
    shared folder and read again, so nothing is worked out twice and a lost executor costs one stage; stages in NARROW
    are column expressions and run within the next one that is written. Where that write fails, they are tried one by
    one, so the failing stage is named and the rows before it can be read.
    """
    bad = set(skip) - set(OPTIONAL)
    if bad:
        raise ValueError(f"these stages can't be left out: {sorted(bad)}")
    out, t = Result(), tables or RuleTables()
    rules = t.detection if rules is None else rules

    read: dict[str, DataFrame] = {}  # the lines' statements, for discovery and the call graph

    def discovery(_: DataFrame | None) -> DataFrame:
        read["lines"] = reach.read_once(lines)
        return discover(read["lines"], rules)

    def reachable(a: DataFrame) -> DataFrame:
        fns, calls = reach.code_graph(read["lines"])
        fns = fns.withColumn("fn_ord", F.xxhash64("qualified_name"))
        judged = reach.verdicts(a, fns, calls).select("seq", "function", "reachable", F.col("path").alias("reachability_path"))
        x = a.drop("reachable").join(judged, "seq", "left")
        entries = F.lit(not fns.filter("is_entry_point").isEmpty())
        place = F.concat_ws(":", "file_path", F.col("line_number").cast("string"))
        return x.withColumn("exposure_context", reach.context(F.col("source_surface"), F.col("function"), entries, F.col("reachable"), F.col("reachability_path"), F.col("algorithm"), place))

    stages: list[tuple[str, Callable[[DataFrame | None], DataFrame]]] = [
        ("discovery", discovery),
        ("inventory", lambda a: merged(inventory.union_surfaces({"source_code": a, **(others or {})}))),
        ("enrichment", lambda a: a if answers is None else enrich.apply(a, answers)),
        ("classification", lambda a: classify.classify(a, t.classes)),
        ("ownership", lambda a: a if owner_rules is None else classify.assign_owners(a, owner_rules)),
        ("reachability", reachable),
        ("risk", lambda a: risk.score(a, t.profile.z, mappings=t.mappings, years=t.years, shelf_life=t.profile.shelf_life, harvest=t.profile.harvest)),
        ("recommendation", lambda a: risk.recommend(a, greenfield)),
        ("migration", lambda a: risk.migration(a, impacts=t.impacts, weights=t.weights, step_lists=t.steps)),
        *(more or {}).items(),
    ]
    written: DataFrame | None = None  # assets as last written, before the stages that wait
    waiting: list[tuple[str, Callable[[DataFrame | None], DataFrame]]] = []
    for name, stage in stages:
        if name in skip:
            continue
        try:
            next_ = stage(out.assets)
            if name in NARROW:
                waiting.append((name, stage))
            else:
                written = next_ = reach.kept(next_, name)
                waiting = []
        except Exception as problem:  # any failure ends the run with what there is
            _stop(out, written, [*waiting, (name, stage)], problem)
            return out
        out.assets = next_
        out.completed.append(name)
    try:
        scanned = ("source_code", *(others or {}))
        out.tables = {"completeness": reads.completeness(out.assets, scanned), "components": reads.components(out.assets), "dashboard": reads.dashboard(out.assets), **reports(out.assets, out.status)}
    except Exception as problem:
        out.failed, out.error = "tables", str(problem).splitlines()[0]
    return out


def reports(assets: DataFrame, status: str = "complete") -> dict[str, DataFrame]:
    """The rest of what a run tells: relationships, what depends on what, coverage rates, and the lines of both reports.

    Relationships by a sibling symbol need observed_symbol and sibling_symbols; without them only surfaces are linked.
    """
    cross = reads.cross_surface_edges(assets).drop("family").withColumn("_k", F.lit(0))
    siblings = {"observed_symbol", "sibling_symbols", "snippet"} <= set(assets.columns)
    edges = reads.linked(reads.invokes_edges(assets).withColumnRenamed("k", "_k").unionByName(cross) if siblings else cross)
    return {
        "edges": edges,
        "dependencies": reads.dependencies(edges, assets),
        "quality": reads.quality(assets),
        "report": reads.report_lines(assets, status=status),
        "migration_report": reads.migration_report(assets),
    }


def _stop(out: Result, written: DataFrame | None, waiting: list[tuple[str, Callable[[DataFrame | None], DataFrame]]], problem: Exception) -> None:
    """Finds the stage that failed: those that waited for a write are written one by one, from the last written table on, and the rows before the failing one stay."""
    names = {name for name, _ in waiting}
    out.completed = [name for name in out.completed if name not in names]
    out.assets = written
    for name, stage in waiting:
        try:
            out.assets = reach.kept(stage(out.assets), name)
        except Exception as found:
            out.failed, out.error = name, str(found).splitlines()[0]
            return
        out.completed.append(name)
    # Every stage ran this time, as where an executor was lost: the last one's failure is told, its rows stay.
    out.failed, out.error = waiting[-1][0], str(problem).splitlines()[0]
    out.completed.remove(waiting[-1][0])


def rerun_after_enrichment(stored: DataFrame, answers: DataFrame, greenfield: bool = False) -> DataFrame:
    """Stored assets with their answers applied, and all later stages anew; the stored reachability stays."""
    fresh = [c for c in ("seq", "algorithm", "purpose", "source_surface", "file_path", "line_number", "confidence", "rule_id", "snippet", "finding_type", "owner", "reachable", "reachability_path", "scan_id", "key_size_bits") if c in stored.columns]
    return risk.migration(risk.recommend(risk.score(classify.classify(enrich.apply(stored.select(*fresh), answers))), greenfield))
