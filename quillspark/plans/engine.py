"""The engine's entry points, one per task a user runs: each takes and returns DataFrames."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from ..functions import detect, lint, tokens
from ..functions import text as T
from ..operators import reduce as R
from ..operators.registry import DEFAULT, Registry
from ..sources.tables import kept

#: A pipe reduces from this confidence on; a payload is classified from 0.55 on.
PIPE_CONFIDENCE = 0.4


@dataclass(frozen=True)
class Config:
    """Settings; an overlay's scalars win even where they are defaults, the lists are united in order."""

    mode: str = "safe"
    pinned_constraints: tuple[str, ...] = ()
    include_paths: tuple[str, ...] = ()
    ignore_paths: tuple[str, ...] = ()
    protected_literals: tuple[str, ...] = ()
    retain_days: int = 90
    port: int = 4173
    extra: dict = field(default_factory=dict)

    def merged(self, overlay: Config) -> Config:
        both = lambda n: tuple(dict.fromkeys((*getattr(self, n), *getattr(overlay, n))))
        return replace(overlay, **{n: both(n) for n in ("pinned_constraints", "include_paths", "ignore_paths")})

    def validated(self) -> Config:
        if self.retain_days < 1:
            raise ValueError("retain_days must be at least 1")
        if not 1 <= self.port <= 65535:
            raise ValueError("port must be between 1 and 65535")
        return self


@F.pandas_udf(FloatType())
def _parsed(texts: pd.Series) -> pd.Series:
    """0.9 for TOML, else 0; the grammar needs a parser."""
    import tomllib

    def one(text: str | None) -> float:
        try:
            tomllib.loads(text or "=")
        except (tomllib.TOMLDecodeError, RecursionError):
            return 0.0
        return 0.9

    return texts.map(one).astype("float32")


def config_score(text: Column) -> Column:
    """Detector score of configuration: TOML 0.9 by its parser, else the rule without parsers, which covers YAML too.

    A YAML parser is no part of every installation, and a score must not depend on the worker.
    """
    structured = ~detect.looks_like_trace(text) & detect.looks_structured(text)
    found = _parsed(F.when(structured, text))
    return F.when(structured & (found > 0), found).otherwise(detect.ini(text))


def estimate(texts: DataFrame, family: str = "claude") -> DataFrame:
    return texts.select("id", tokens.estimate(F.col("text"), family).alias("e")).select("id", "e.*")


def classified(texts: DataFrame, parsers: bool = False, registry: Registry = DEFAULT) -> DataFrame:
    """texts with the best detector of the registry and the class."""
    t = F.col("text")
    scored = texts.withColumn("_config", config_score(t)) if parsers else texts
    top = scored.withColumn("_best", detect.best(registry.scores(t, F.col("_config") if parsers else None), registry.kinds))
    return top.withColumn("_c", detect.classify(t, F.col("_best"), class_of=registry.classes)).select(*texts.columns, "_best", "_c.class", "_c.kind", "_c.confidence")


def pipe(texts: DataFrame, registry: Registry = DEFAULT) -> DataFrame:
    """(id, output, kind): reduced where a detector is confident enough and the result is strictly smaller."""
    kind = F.when(F.col("_best.score") >= F.lit(PIPE_CONFIDENCE).cast("float"), F.col("_best.kind"))
    known = kept(classified(texts, registry=registry).select("id", "text", kind.alias("kind")))  # no class is asked for, so none is found
    reduced = R.reduce_all(known, registry.operators, held=True).select("id", "reduced", "before_tokens", "after_tokens")
    smaller = F.col("after_tokens") < F.col("before_tokens")
    out = known.join(reduced, "id", "left")
    return out.select("id", F.when(smaller, F.col("reduced")).otherwise(F.col("text")).alias("output"), F.when(smaller, F.col("kind")).alias("kind"))


def pipe_payloads(payloads: DataFrame, registry: Registry = DEFAULT) -> DataFrame:
    """(id, output, kind) of payloads (id, payload) as bytes: what is UTF-8 goes through pipe, all else, null too, comes out as it came in."""
    text = F.col("payload").cast("string")
    readable = F.coalesce(F.is_valid_utf8(text), F.lit(False))
    texts = pipe(payloads.where(readable).select("id", text.alias("text")), registry)
    passed = payloads.where(~readable).select("id", F.col("payload").alias("output"), F.lit(None).cast("string").alias("kind"))
    return texts.select("id", F.col("output").cast("binary").alias("output"), "kind").unionByName(passed)


def intercept(texts: DataFrame, registry: Registry = DEFAULT) -> DataFrame:
    """(id, class, confidence, output, before_tokens, after_tokens, findings): classify, reduce, lint prompts and unknown texts."""
    known = kept(classified(texts, registry=registry))
    reduced = R.reduce_all(known.where("kind is not null"), registry.operators, held=True).select("id", "reduced")
    linted = lint.with_parts(known.where(F.col("class").isin("prompt", "unknown")).select("id", "text")).select("id", F.transform(lint.findings(F.col("text")), lambda f: f["code"]).alias("findings"))
    out = known.join(reduced, "id", "left").join(linted, "id", "left").withColumn("output", F.coalesce("reduced", "text"))
    return out.select("id", "class", "confidence", "output", tokens.estimated(F.col("text")).alias("before_tokens"), tokens.estimated(F.col("output")).alias("after_tokens"), "findings")


def attachment(objective: Column, subtask: Column, constraints: Column, facts: Column, files: Column, actions: Column) -> Column:
    """Session memory as lines: first six facts, last six files newest first, first five actions; empty without content."""
    joined = lambda label, items, by: F.when(F.size(items) > 0, F.concat(F.lit(label + ": "), F.array_join(items, by)))
    newest = F.slice(F.reverse(files), 1, 6)
    rows = [F.concat(F.lit("objective: "), objective), F.concat(F.lit("current_subtask: "), subtask), joined("hard_constraints", constraints, " | "), joined("pinned_facts", F.slice(facts, 1, 6), " | "), joined("modified_files", newest, ", "), joined("next_actions", F.slice(actions, 1, 5), " | ")]
    body = F.array_join(F.array_compact(F.array(*rows)), "\n")
    return F.when(body == "", "").otherwise(F.concat(F.lit("[session memory]\n"), body, F.lit("\n[/session memory]")))


def report_passed(report: Column) -> Column:
    """Whether a JSON report has cases and all of them passed."""
    n = lambda k: F.coalesce(F.get_json_object(report, f"$.summary.{k}").cast("long"), F.lit(0).cast("long"))
    return (n("total_cases") > 0) & (n("total_cases") == n("passed_cases"))


def status_line(text: Column) -> Column:
    """The first non-empty line, at most 120 characters."""
    return F.left(F.coalesce(T.first(T.trimmed_lines(text)), F.lit("")), F.lit(120))


def relative_path(path: Column, root: Column) -> Column:
    """A path under root without it and without leading slashes; others without leading slashes."""
    under = path.startswith(F.concat(F.rtrim(root, F.lit("/")), F.lit("/")))
    return F.ltrim(F.when(under, F.substr(path, F.length(F.rtrim(root, F.lit("/"))) + 2)).otherwise(path), F.lit("/"))


def _cut(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most - 3)), F.lit("..."))).otherwise(text)


def status(branch: Column, dirty: Column, objective: Column, failures: Column) -> Column:
    """One line on branch, changed files, objective (80 characters) and newest failure (60); empty without any."""
    last = F.get(failures, F.size(failures) - 1)
    parts = [
        F.concat(F.lit("branch="), branch),
        F.when(dirty > 0, F.concat(F.lit("uncommitted="), dirty.cast("string"))),
        F.concat(F.lit('objective="'), _cut(objective, 80), F.lit('"')),
        F.when(F.size(failures) > 0, F.concat(F.lit('last_failure="'), _cut(last, 60), F.lit('"'))),
    ]
    line = F.array_join(F.array_compact(F.array(*parts)), " | ")
    return F.when(line == "", "").otherwise(F.concat(F.lit("[session] "), line))


def brief(handoff: Column, git: Column, graph_stale: Column, hot: Column, flags: Column, hot_shown: int = 3) -> Column:
    """What a session starts with, a line per part that is there: handoff path, git state (struct of readers.git_states), graph, hot files (array of struct(path, touches)), flags of the last session."""
    state = [
        F.concat(F.lit("branch `"), git["branch"], F.lit("`")),
        F.when(git["dirty"] > 0, F.concat(git["dirty"].cast("string"), F.lit(" uncommitted"))),
        F.when(git["upstream"].isNotNull() & (git["ahead"] > 0), F.concat(git["ahead"].cast("string"), F.lit(" ahead of `"), git["upstream"], F.lit("`"))),
        F.when(git["upstream"].isNotNull() & (git["behind"] > 0), F.concat(git["behind"].cast("string"), F.lit(" behind `"), git["upstream"], F.lit("`"))),
    ]
    top = F.transform(F.slice(hot, 1, hot_shown), lambda h: F.concat(F.lit("`"), h["path"], F.lit("` ("), h["touches"].cast("string"), F.lit(")")))
    lines = [
        F.concat(F.lit("Handoff: continue from `"), handoff, F.lit("`.")),
        F.when(git["branch"].isNotNull(), F.concat(F.lit("Git: "), F.array_join(F.array_compact(F.array(*state)), ", "), F.lit("."))),
        F.when(graph_stale, F.lit("Graph: stale, build it again.")),
        F.when(F.size(hot) > 0, F.concat(F.lit("Hot: "), F.array_join(top, ", "), F.lit("."))),
        F.when(F.size(flags) > 0, F.concat(F.lit("Last session: "), F.array_join(flags, "; "), F.lit("."))),
    ]
    body = F.array_join(F.array_compact(F.array(*lines)), "\n")
    return F.when(body == "", "").otherwise(F.concat(F.lit("[session brief]\n"), body, F.lit("\n[/session brief]")))
