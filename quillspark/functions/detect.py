"""What kind of text it is: detector scores, dispatch and classes.

Scores are sums of 32-bit floats in a fixed order, capped at 1; ties go to the
later kind.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T

KINDS = ["stack_trace", "test_log", "build_log", "lint_output", "json", "config"]
CLASS_OF = {"stack_trace": "stack_trace", "test_log": "test_log", "build_log": "test_log", "lint_output": "test_log", "json": "json", "config": "config"}
#: Words that make a text of two lines a prompt.
ACTION_WORDS = ["build", "implement", "fix", "update", "document", "review", "scaffold", "reduce", "write", "investigate", "proceed"]


def _total(parts: list[tuple[Column, float]]) -> Column:
    total = F.lit(0.0).cast("float")
    for hit, weight in parts:
        total = (total + F.when(hit, F.lit(weight).cast("float")).otherwise(F.lit(0.0).cast("float"))).cast("float")
    return F.least(total, F.lit(1.0).cast("float"))


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def _at_lines(text: Column) -> Column:
    return F.size(F.filter(T.lines(text), lambda x: T.trim_start(x).startswith("at ")))


# The detectors' markers and weights, in the order in which they are added.


def stack_trace(text: Column) -> Column:
    c, at = text.contains, _at_lines(text)
    rust = c("stack backtrace:") | c("panicked at")
    head = T.trim_start
    frames = F.size(F.filter(T.lines(text), lambda x: head(x).startswith("0:") | (head(x).rlike("^[0-9]") & x.contains("::"))))
    return _total([(c("Traceback (most recent call last)"), 0.65), (at >= 3, 0.55), ((at >= 1) & (at < 3), 0.25), (rust, 0.5), (rust & (frames >= 3), 0.2), (c("Error:") | c("Exception"), 0.2)])


def test_log(text: Column) -> Column:
    c = text.contains
    return _total(
        [
            (c("PASS ") | c("FAIL "), 0.5),
            (c("Test Suites:") | c("Ran all test suites"), 0.35),
            (c("AssertionError") | c("expected"), 0.2),
            (c("✓ ") & c("✗ ") | c("Test Files"), 0.5),
            (c("test result: ok.") | c("test result: FAILED") | c("running ") & c(" tests"), 0.5),
            (c("passed") & c("failed") | c("PASSED") | c("FAILED"), 0.4),
        ]
    )


def build_log(text: Column) -> Column:
    c = text.contains
    commands = ["$ cargo build", "$ npm run build", "$ pnpm build", "$ yarn build", "$ go build", "$ gradle", "$ mvn", "$ tsc"]
    return _total(
        [
            (c("Compiling ") & c(" v"), 0.55),
            (c("error[E") | c("warning["), 0.3),
            (c("added ") & c(" packages"), 0.45),
            (c("npm warn") | c("npm ERR!"), 0.3),
            (c("webpack compiled") | c("vite") & (c("build") | c("transforming")), 0.45),
            (c("chunk ") & c(" kB"), 0.3),
            (c("error TS") | c("tsc") & c("--"), 0.4),
            (c("go build") | c("go: downloading"), 0.4),
            (c("> Task :") | c("BUILD SUCCESSFUL") | c("BUILD FAILED"), 0.45),
            (c("[INFO] Building ") | c("[INFO] BUILD ") | c("[ERROR]"), 0.4),
            (c("Downloading "), 0.15),
            (T.contains_any(text, commands), 0.2),
        ]
    )


def lint_output(text: Column) -> Column:
    c = text.contains
    return _total(
        [
            (c("warning[") | c("error["), 0.5),
            (c("eslint") | (_count(text, r"(?m)^\s*\d+:\d+\s+(?:error|warning)\s+") > 0), 0.4),
            (c("pylint") | c("flake8") | (_count(text, r"[CWERFI]\d{4}[:\s]") > 0), 0.4),
            (c("error TS"), 0.4),
            (_count(text, r"(?:warning|error):") >= 3, 0.3),
        ]
    )


def is_json(text: Column) -> Column:
    """Whether the whole text is one JSON value.

    The parser stops after the first value, so the text is read as the only
    element of an array and as the only member of an object: what follows a
    value would have to be a bracket for one and a brace for the other.
    """
    listed = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    member = F.try_parse_json(F.concat(F.lit('{"a": '), text, F.lit("}")))
    element = lambda i: F.try_variant_get(listed, f"$[{i}]", "variant")
    return listed.isNotNull() & member.isNotNull() & element(0).isNotNull() & element(1).isNull()


def json(text: Column) -> Column:
    """Any valid JSON value counts."""
    return F.when(is_json(text), F.lit(0.95).cast("float")).otherwise(F.lit(0.0).cast("float"))


def looks_like_trace(text: Column) -> Column:
    return (_at_lines(text) >= 2) & T.contains_any(text, ["Error:", "Exception", "Traceback (most recent call last)"])


def looks_like_ini(text: Column) -> Column:
    return F.exists(T.trimmed_lines(text), lambda x: (x.startswith("[") & x.endswith("]")) | x.contains("=") | x.contains(":"))


def looks_structured(text: Column) -> Column:
    """A section line, or two lines that assign."""
    kept = F.filter(T.trimmed_lines(text), lambda x: ~x.startswith("#") & ~x.startswith("//"))
    sections = F.size(F.filter(kept, lambda x: x.startswith("[") & x.endswith("]")))
    assigns = F.size(F.filter(kept, lambda x: x.contains("=") | (x.contains(":") & ~x.contains("://") & ~x.endswith(".") & ~x.endswith("?"))))
    return (sections > 0) | (assigns >= 2)


def ini(text: Column) -> Column:
    """The configuration score that needs no parser."""
    return F.when(~looks_like_trace(text) & looks_like_ini(text), F.lit(0.7).cast("float")).otherwise(F.lit(0.0).cast("float"))


def scores(text: Column, config: Column | None = None) -> Column:
    """struct of the six scores; config as given, else by the rule without parsers."""
    found = [stack_trace(text), test_log(text), build_log(text), lint_output(text), json(text), ini(text) if config is None else config]
    return F.struct(*[s.alias(k) for s, k in zip(found, KINDS, strict=True)])


def best(s: Column, kinds: list[str] = KINDS) -> Column:
    """struct(score, kind) of the highest score above 0, the later kind of equals; null if all are 0."""
    ranked = F.array_max(F.array(*[F.struct(s[k].alias("score"), F.lit(i).alias("at"), F.lit(k).alias("kind")) for i, k in enumerate(kinds)]))
    return F.when(ranked["score"] > 0, F.struct(ranked["score"].alias("score"), ranked["kind"].alias("kind")))


def is_prompt_like(text: Column) -> Column:
    acts = F.exists(F.array(F.lower(text)), lambda low: T.contains_any(low, ACTION_WORDS))  # in lower case once, not a word
    return (F.size(T.lines(text)) >= 2) & acts


def classify(text: Column, top: Column, hint: Column | None = None, class_of: dict[str, str] = CLASS_OF) -> Column:
    """struct(class, kind, confidence): hint, else the best detector from 0.55 on, else prompt, else unknown."""
    klass = lambda kind: F.create_map(*[F.lit(x) for kv in class_of.items() for x in kv])[kind]
    value = lambda c, k, x: F.struct(c.alias("class"), k.cast("string").alias("kind"), F.round(x.cast("double"), 4).alias("confidence"))
    none = F.lit(None)
    out = F.when(hint.isNotNull(), value(F.coalesce(klass(hint), F.lit("unknown")), hint, F.lit(1.0))) if hint is not None else F
    return out.when(top["score"] >= F.lit(0.55).cast("float"), value(klass(top["kind"]), top["kind"], top["score"])).when(is_prompt_like(text), value(F.lit("prompt"), none, F.lit(0.6))).otherwise(value(F.lit("unknown"), none, F.lit(0.0)))
