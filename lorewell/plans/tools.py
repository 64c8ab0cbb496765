"""The engine's operators as named tools with checked parameters, so that one call serves any caller; which tools a mode shows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorewell.operators import campaigns, comparison, duplicates, links, notes_overview, reports, review, schedule, search, taxonomy
from lorewell.plans import metadata, triage
from lorewell.sources.tables import notes

DEFAULT_MODE, JUDGING_MODE = "default", "calibration-review"


@dataclass(frozen=True)
class Parameter:
    """A parameter's type, default (required without one), bounds that numbers are clamped to, or the values it may have."""

    kind: type
    default: object = None
    required: bool = False
    low: float | None = None
    high: float | None = None
    choices: tuple = ()
    says: str = ""

    def checked(self, name: str, value: object) -> object:
        if value is None:
            if self.required:
                raise ValueError(f"{name} is required")
            return self.default
        if self.kind is float and isinstance(value, int) and not isinstance(value, bool):
            value = float(value)
        if not isinstance(value, self.kind) or isinstance(value, bool) is not (self.kind is bool):
            raise TypeError(f"{name} must be {self.kind.__name__}")
        if self.choices and value not in self.choices:
            raise ValueError(f"{name} must be one of {', '.join(map(str, self.choices))}")
        if isinstance(value, str) and self.required and not value.strip():
            raise ValueError(f"{name} must not be empty")
        if isinstance(value, int | float) and not isinstance(value, bool):
            value = max(value, self.kind(self.low)) if self.low is not None else value
            value = min(value, self.kind(self.high)) if self.high is not None else value
        return value

    def schema(self) -> dict:
        names = {str: "string", int: "integer", float: "number", bool: "boolean", tuple: "array"}
        known = {"type": names[self.kind], "default": self.default, "minimum": self.low, "maximum": self.high, "enum": list(self.choices) or None, "description": self.says or None}
        return {k: v for k, v in known.items() if v is not None}


@dataclass(frozen=True)
class Tool:
    """What a tool does with (spark, folder of tables, checked parameters); writes: whether its result is a plan of changes."""

    says: str
    run: Callable[..., DataFrame]
    parameters: dict[str, Parameter] = field(default_factory=dict)
    writes: bool = False
    risk: str = "low"
    mode: str = DEFAULT_MODE

    def schema(self) -> dict:
        return {"description": self.says, "type": "object", "properties": {k: p.schema() for k, p in self.parameters.items()}, "required": [k for k, p in self.parameters.items() if p.required], "additionalProperties": False}


def _limit(default: int, high: int) -> Parameter:
    return Parameter(int, default, low=1, high=high, says="rows at most")


QUERY, FOLDER = Parameter(str, required=True, says="words to look for"), Parameter(str, says="notes under this folder only")


def _twins(s: SparkSession, d: str, p: dict) -> DataFrame:
    f = duplicates.features(notes(s, d))
    if p["path"]:
        return duplicates.ranked(duplicates.scored(duplicates.focus_pairs(f, p["path"]), f, p["threshold"]), p["limit"])
    pairs = duplicates.exact_pairs(f, max(p["threshold"], 46)) if p["mode"] == "exact" else duplicates.blocked_pairs(duplicates.block_keys(f))
    return duplicates.ranked(duplicates.scored(pairs, f, p["threshold"]), p["limit"])


def _note(s: SparkSession, d: str, p: dict) -> DataFrame:
    n = notes(s, d)
    return triage.looked_up(s.createDataFrame([(p["note"],)], "asked string"), n).join(n, "rel_path").select("rel_path", "by", "title", "tags", "out_links", "last_modified")


TOOLS: dict[str, Tool] = {
    "search_notes": Tool("Notes by words in title, tags, frontmatter and text.", lambda s, d, p: search.lexical_search(notes(s, d), p["query"], p["limit"]), {"query": QUERY, "limit": _limit(20, 200)}),
    "semantic_search": Tool("Notes by weighed terms and concepts.", lambda s, d, p: search.semantic_search(search.index_of(s, d), p["query"], p["limit"], p["min_score"], p["folder"], archived=p["archived"]), {"query": QUERY, "limit": _limit(10, 50), "min_score": Parameter(int, 12, low=0, high=100), "folder": FOLDER, "archived": Parameter(bool, False)}),
    "list_notes": Tool("Notes of a folder, tags or a status.", lambda s, d, p: notes_overview.filtered(notes(s, d), p["folder"], p["tags"], p["status"]).select("rel_path", "title"), {"folder": FOLDER, "tags": Parameter(tuple, ()), "status": Parameter(str)}),
    "read_note": Tool("One note by path, file name or title.", _note, {"note": Parameter(str, required=True)}),
    "find_duplicates": Tool("Pairs of notes that may be one.", _twins, {"threshold": Parameter(int, 60, low=1, high=100), "limit": _limit(20, 100), "mode": Parameter(str, "blocked", choices=("blocked", "exact")), "path": Parameter(str, says="only pairs with this note")}),
    "find_broken_links": Tool("Links that lead nowhere.", lambda s, d, p: links.broken(links.resolved_of(s, d))),
    "suggest_links": Tool("Notes that name others without a link.", lambda s, d, p: triage.plain_mentions(notes(s, d), links.edges_of(s, d))),
    "suggest_links_v2": Tool("The same with confidence.", lambda s, d, p: search.mentions(notes(s, d), links.edges_of(s, d), p["per_note"], p["limit"], p["min_confidence"]), {"per_note": Parameter(int, 5, low=1, high=20), "limit": _limit(100, 500), "min_confidence": Parameter(float, 0.55, low=0.0, high=1.0)}),
    "todo_list": Tool("Open tasks.", lambda s, d, p: notes_overview.open_todos(notes(s, d))),
    "weekly_review": Tool("What changed in the last days.", lambda s, d, p: notes_overview.weekly_review(notes(s, d), p["days"]), {"days": Parameter(int, 7, low=1, high=90)}),
    "lint_frontmatter": Tool("Issues of frontmatter.", lambda s, d, p: notes_overview.frontmatter_lint(notes(s, d), p["profile"]), {"profile": Parameter(str, choices=tuple(notes_overview.PROFILES))}),
    "fix_frontmatter": Tool("What would mend frontmatter.", lambda s, d, p: metadata.frontmatter_fixes(notes(s, d), p["profile"]), {"profile": Parameter(str, choices=tuple(notes_overview.PROFILES))}, True, "medium"),
    "migrate_metadata": Tool("Fields that captures and claims lack.", lambda s, d, p: metadata.metadata_backfill(notes(s, d)), writes=True),
    "schedule": Tool("What to look at next.", lambda s, d, p: schedule.schedule(notes(s, d), horizon=p["horizon_days"]), {"horizon_days": Parameter(int, schedule.HORIZON, low=1, high=365)}),
    "review": Tool("All findings in order of weight.", lambda s, d, p: review.page(review.of_vault(s, d), p["limit"]), {"limit": _limit(50, 200)}),
    "low_quality_notes": Tool("Notes of low quality.", lambda s, d, p: notes_overview.judged_notes(s, d).filter(F.col("score") <= p["max_score"]).select("rel_path", "score").orderBy("score", "rel_path").limit(p["limit"]), {"max_score": Parameter(int, 49, low=0, high=100), "limit": _limit(20, 200)}),
    "triage_inbox": Tool("Where the notes of a folder belong.", lambda s, d, p: triage.triaged(b := triage.inbox(n := notes(s, d), p["folder"], p["limit"]), triage.sure_twins(b, n), taxonomy.SAMPLE, least=p["min_confidence"], apply_low=p["apply_low_confidence"]), {"folder": Parameter(str, "Inbox"), "limit": _limit(triage.BATCH, 25), "min_confidence": Parameter(float, 5.0, low=0.0), "apply_low_confidence": Parameter(bool, False)}, True, "medium"),
    "open_questions": Tool("Gaps and contradictions.", lambda s, d, p: reports.open_questions(notes(s, d))),
    "compare_predictors": Tool("Differences of two predictors with intervals.", lambda s, d, p: comparison.compare(comparison.sample_pairs(s, d), p["rounds"], p["seed"]), {"rounds": Parameter(int, 1000, low=100, high=5000), "seed": Parameter(str, "comparison")}),
    "campaign_roots": Tool("Receipts of sealed campaigns.", lambda s, d, p: campaigns.QUERIES["campaign_roots"](s, d), mode=JUDGING_MODE),
}


def visible(mode: str = DEFAULT_MODE) -> dict[str, Tool]:
    """The tools that a mode shows; an unknown mode is an error."""
    if mode not in (DEFAULT_MODE, JUDGING_MODE):
        raise ValueError(f"no mode {mode}")
    return {name: t for name, t in TOOLS.items() if t.mode == mode}


def call(spark: SparkSession, sf_dir: str, name: str, mode: str = DEFAULT_MODE, **given: object) -> DataFrame:
    """A tool's result. Unknown tools and parameters, missing ones, wrong types and values are errors before anything runs;
    numbers beyond their bounds are clamped."""
    tool = visible(mode).get(name)
    if tool is None:
        raise KeyError(f"no tool {name} in mode {mode}")
    if unknown := given.keys() - tool.parameters.keys():
        raise ValueError(f"{name} has no parameter {', '.join(sorted(unknown))}")
    return tool.run(spark, sf_dir, {k: p.checked(k, given.get(k)) for k, p in tool.parameters.items()})
