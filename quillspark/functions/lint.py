"""Prompt lint: findings, structured rewrite, and text extraction for sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as T
from . import tokens
from .detect import ACTION_WORDS

#: Markers of the rules, in their order.
OVERBROAD = ["entire repo", "whole repo", "entire codebase", "whole codebase", "all files", "everything"]
VERBS = r"\b(build|implement|fix|debug|add|update|refactor|review|document|scaffold|reduce|write|investigate)\b"
SUCCESS = ["acceptance criteria", "done when", "verify", "test", "tests", "success criteria", "must pass"]
STATIC = ["mission", "product thesis", "hard requirements", "non-negotiable"]
PATH = r"(?:\./|\.\./|/)[A-Za-z0-9_\-./]+|(?:[A-Za-z0-9_.-]+/)+[A-Za-z0-9_.-]+\.[A-Za-z0-9]+"
CONSTRAINT = ["must", "Must", "do not", "Do not", "never", "Never"]

#: Texts of a rewrite.
NO_OBJECTIVE = "State the concrete task outcome in one sentence."
NARROW = "Narrow the task to the specific files, modules, or subsystems that need to change."
NO_CONSTRAINTS = "- Add constraints only if they materially change execution."
NO_PATHS = "- Add file or module paths when known."
NO_CRITERIA = "- Define how success will be verified."
REVIEW = "A concise review with findings ordered by severity."
DOCUMENTATION = "Updated documentation with any required implementation changes."
CHANGES = "Working code changes with tests or verification notes."
ARTIFACT = "A concrete implementation or analysis artifact, not just general advice."
STATUS_UPDATED = "STATUS.md is updated to reflect the new milestone."
TESTS_RUN = "Relevant tests or verification steps are run and reported."
SAFE_MODE = "Safe-mode protections are preserved and visible."
DEFAULT_CRITERIA = ["Relevant tests or checks pass for the touched scope.", "The output clearly states what changed and any remaining risks."]
NO_PATHS_FOUND = "No file or module paths detected"
NO_CRITERIA_FOUND = "No explicit verification or acceptance language detected"


def _strip(s: Column, chars: str) -> Column:
    return F.btrim(s, F.lit(chars))


def paths(text: Column) -> Column:
    """Distinct paths, without commas and full stops around them."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(PATH), F.lit(0)), lambda p: _strip(p, ",.")))


def sorted_paths(text: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(PATH), F.lit(0))))


def duplicate_lines(text: Column) -> Column:
    """Trimmed lines that occur more than once, in order of first appearance."""
    rows = T.trimmed_lines(text)
    return F.array_distinct(F.filter(rows, lambda x, i: F.array_position(F.slice(rows, i + 2, F.size(rows)), x) > 0))


def _hits(text: Column, markers: list[str]) -> Column:
    return F.filter(F.array(*[F.lit(m) for m in markers]), lambda m: F.lower(text).contains(m))


def first_line(text: Column) -> Column:
    return T.first(T.trimmed_lines(text))


def with_parts(df: DataFrame, text: str = "text") -> DataFrame:
    """df with what several rules share, each computed once: _repeated, _repeated_text, _paths, _objective, _constraints."""
    t = F.col(text)
    out = df.withColumns({"_repeated": duplicate_lines(t), "_paths": paths(t), "_objective": objective(t), "_constraints": constraints(t)})
    return out.withColumn("_repeated_text", F.array_join("_repeated", "\n"))


def findings(text: Column) -> Column:
    """Array of struct(code, severity, waste_source, estimated_waste_tokens, evidence), in the rules' order; on with_parts."""
    low = F.lower(text)
    repeated, broad, static = F.col("_repeated"), _hits(text, OVERBROAD), _hits(text, STATIC)

    def found(when: Column, code: str, severity: str, source: str, waste: Column | int, evidence: Column) -> Column:
        w = (F.lit(waste) if isinstance(waste, int) else waste).cast("int")
        return F.when(when, F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"), F.lit(source).alias("waste_source"), w.alias("estimated_waste_tokens"), evidence.alias("evidence")))

    rules = [
        found(F.size(repeated) > 0, "redundant_constraints", "medium", "redundancy", tokens.estimated(F.col("_repeated_text")), repeated),
        found(F.size(broad) > 0, "overbroad_scope", "high", "overbreadth", 60, broad),
        found((F.size("_paths") == 0) & T.contains_any(low, ["repo", "codebase", "project"]), "missing_file_scope", "medium", "missing_scope", 35, F.array(F.lit(NO_PATHS_FOUND))),
        found(~low.rlike(VERBS), "ambiguous_objective", "medium", "ambiguity", 25, F.array(F.coalesce(first_line(text), F.lit("")))),
        found(~T.contains_any(low, SUCCESS), "missing_acceptance_criteria", "medium", "missing_acceptance_criteria", 30, F.array(F.lit(NO_CRITERIA_FOUND))),
        found((F.size(static) >= 2) & (F.size(T.trimmed_lines(text)) > 12), "buried_static_context", "low", "buried_static_context", 45, static),
    ]
    return F.array_compact(F.array(*rules))


def constraints(text: Column) -> Column:
    """The first eight distinct bullet, must and never lines."""
    rows = F.filter(T.trimmed_lines(text), lambda x: x.startswith("-") | T.contains_any(x, CONSTRAINT))
    return F.slice(F.array_distinct(F.transform(rows, lambda x: F.regexp_replace(x, "^(?:- )+", ""))), 1, 8)


def objective(text: Column) -> Column:
    rows = T.trimmed_lines(text)
    return F.coalesce(T.first(F.filter(rows, lambda x: x.rlike("(?i)" + VERBS))), T.first(rows), F.lit(NO_OBJECTIVE))


def deliverable(text: Column) -> Column:
    low = F.lower(text)
    return (
        F.when(low.contains("review"), REVIEW)
        .when(T.contains_any(low, ["document", "write docs"]), DOCUMENTATION)
        .when(T.contains_any(low, ["fix", "implement", "build", "scaffold", "add"]), CHANGES)
        .otherwise(ARTIFACT)
    )


def acceptance(text: Column) -> Column:
    low = F.lower(text)
    found = F.array_compact(
        F.array(
            F.when(low.contains("status.md"), F.lit(STATUS_UPDATED)),
            F.when(T.contains_any(low, ["test", "verify"]), F.lit(TESTS_RUN)),
            F.when(low.contains("safe mode"), F.lit(SAFE_MODE)),
        )
    )
    default = F.array(*[F.lit(x) for x in DEFAULT_CRITERIA])
    return F.when(F.size(found) == 0, default).otherwise(found)


def _listed(items: Column, placeholder: str) -> Column:
    return F.when(F.size(items) == 0, F.lit(placeholder)).otherwise(F.array_join(F.transform(items, lambda x: F.concat(F.lit("- "), x)), "\n"))


def rewrite(text: Column) -> Column:
    """The prompt under six headings; on with_parts."""
    found = F.col("_paths")
    scope = F.when(F.size(found) == 0, F.lit(NARROW)).otherwise(F.concat(F.lit("Focus on: "), F.array_join(found, ", ")))
    parts = {
        "Objective": F.col("_objective"),
        "Scope": scope,
        "Constraints": _listed(F.col("_constraints"), NO_CONSTRAINTS),
        "Relevant Files or Modules": _listed(found, NO_PATHS),
        "Deliverable": deliverable(text),
        "Acceptance Criteria": _listed(acceptance(text), NO_CRITERIA),
    }
    return F.concat_ws("\n\n", *[F.concat(F.lit(k + "\n"), v) for k, v in parts.items()])


def preview(text: Column, new: Column) -> Column:
    """The first 8 lines of the prompt and the first 12 of its rewrite `new`; all of the rewrite if nothing was found."""
    old_rows = F.transform(F.slice(T.lines(text), 1, 8), lambda x: F.concat(F.lit("- "), T.trim(x)))
    new_rows = F.transform(F.slice(T.lines(new), 1, 12), lambda x: F.concat(F.lit("+ "), x))
    whole = F.concat(F.lit("+ "), F.replace(new, F.lit("\n"), F.lit("\n+ ")))
    return F.when(F.size(findings(text)) == 0, whole).otherwise(F.concat(F.array_join(old_rows, "\n"), F.lit("\n"), F.array_join(new_rows, "\n")))


def failed_approaches(text: Column) -> Column:
    return F.filter(T.trimmed_lines(text), lambda x: T.starts_with_any(x, ["tried ", "attempted "]) | T.contains_any(x, ["didn't work", "failed approach"]))


def first_action(text: Column) -> Column:
    return T.first(F.filter(T.trimmed_lines(text), lambda x: T.contains_any(F.lower(x), ACTION_WORDS)))


def hard_constraints(text: Column) -> Column:
    return F.filter(T.trimmed_lines(text), lambda x: T.contains_any(x, ["must", "do not", "never", "safe mode"]))


def turn(text: Column) -> Column:
    """At most 320 characters."""
    t = T.trim(text)
    return F.when(F.length(t) > 320, F.concat(F.left(t, F.lit(320)), F.lit("..."))).otherwise(t)
